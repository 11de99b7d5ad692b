"""Licence scan by sentence rules.

Texts are cut into units at line ends and sentence ends and normalised; runs of units that equal
a known licence sentence become its identifier, so a sentence may be wrapped over lines. The
identifiers of a text, in order, are matched against ordered licence rules: each rule is a
sequence of identifiers, longer rules come first and use up what they match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised, by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache2-use", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-free-2+", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-free-3+", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("lgpl-free-2.1+", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-free-3+", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-free-3+", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("epl2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4", "licensed under cc by nd 4 0"),
    ("cc0", "licensed under cc0 1 0"),
]

# Identifier -> names by which a sentence refers to a licence, normalised.
NAMES: dict[str, tuple[str, ...]] = {
    "mit-ref": ("mit license",),
    "apache2-ref": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "gpl-ref-2": ("gnu general public license version 2", "gnu general public license v2 0"),
    "gpl-ref-3": ("gnu general public license version 3", "gnu general public license v3 0"),
    "lgpl-ref-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"),
    "lgpl-ref-3": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0"),
    "agpl-ref-3": ("gnu affero general public license version 3", "gnu affero general public license v3 0"),
    "bsd2-ref": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "bsd3-ref": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "isc-ref": ("isc license",),
    "zlib-ref": ("zlib license",),
    "mpl2-ref": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "epl2-ref": ("eclipse public license version 2 0", "eclipse public license 2 0"),
}

# Licence names as they follow ``SPDX-License-Identifier:``.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Zlib",
    "MPL-2.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0",
)

SUBJECTS = ("", "this project is ", "this file is ", "this work is ", "this software is ", "this code is ", "this program is ")
VERBS = ("licensed", "released", "distributed")
SENTENCES += [(i, f"{who}{verb} under the {name}") for i, names in NAMES.items() for name in names for who in SUBJECTS for verb in VERBS]
SENTENCES += [(f"spdx-{name}", "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")) for name in SPDX]

#: (licence, identifiers in order); the first rule that fits uses its sentences up.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("Apache-2.0", ("apache2-use", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("GPL-2.0-or-later", ("gpl-free-2+", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free-3+", "gpl-hope", "gpl-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("LGPL-2.1-or-later", ("lgpl-free-2.1+",)),
    ("LGPL-3.0-or-later", ("lgpl-free-3+",)),
    ("AGPL-3.0-or-later", ("agpl-free-3+",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-use",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-ref",)),
    ("GPL-2.0-or-later", ("gpl-free-2+",)),
    ("GPL-3.0-or-later", ("gpl-free-3+",)),
    ("GPL-2.0", ("gpl-ref-2",)),
    ("GPL-3.0", ("gpl-ref-3",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("LGPL-2.1", ("lgpl-ref-2.1",)),
    ("LGPL-3.0", ("lgpl-ref-3",)),
    ("AGPL-3.0", ("agpl-ref-3",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("ISC", ("isc-ref",)),
    ("Zlib", ("zlib-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    *[(name, (f"spdx-{name}",)) for name in SPDX],
]

#: Word parts of which nearly every licence sentence holds one.
ANCHORS = ("licen", "warrant", "copyright", "permission", "redistribut", "mozilla", "unencumbered")
CUT = r"[\r\n]+|[.!?;:]+(?:[ \t\n\r\f]+|$)"
MARKS = r"[^a-z0-9]+"


def most_units(sentences: Sequence[tuple[str, str]]) -> int:
    """Units that a sentence can be wrapped over: a unit that is not empty holds at least one word."""
    return max((len(s.split(" ")) for _, s in sentences), default=0)


def _first_words(sentences: Sequence[tuple[str, str]]) -> str:
    return "|".join(sorted({s.split(" ")[0] for _, s in sentences}))


def licence_sentences(text: Column, sentences: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(units of the text, function of them to the known sentences among them) as two steps."""
    words = _first_words(sentences)
    relevant = F.coalesce(text != "", F.lit(False))
    if all(any(a in s for a in ANCHORS) for _, s in sentences):
        # then a text without any anchor holds no known sentence and need not be cut
        relevant = F.coalesce(text.rlike(f"(?i)(?:{'|'.join(ANCHORS)})"), F.lit(False))
    clean = F.transform(F.split(text, CUT), lambda u: F.trim(F.regexp_replace(F.lower(u), MARKS, " ")))
    units = F.when(relevant, F.filter(clean, lambda u: u != "")).otherwise(F.array().cast("array<string>"))
    known = F.create_map(*[F.lit(x) for sid, s in sentences for x in (s, sid)])
    col = F.col("units")

    def at(i: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.least(F.lit(most_units(sentences)), F.size(col) - i + 1)),
            lambda w: F.struct(i.alias("unit"), w.alias("units"), F.try_element_at(known, F.array_join(F.slice(col, i, w), " ")).alias("sentence")),
        )
        # the longest sentence that starts here
        return F.slice(F.reverse(F.filter(windows, lambda m: m["sentence"].isNotNull())), 1, 1)

    spaced = F.array(*[F.lit(s + " ") for s in sorted({s for _, s in sentences})])

    def begins(i: Column) -> Column:
        unit = F.element_at(col, i)
        return unit.rlike(f"^(?:{words})(?: |$)") & F.exists(spaced, lambda s: F.startswith(s, F.concat(unit, F.lit(" "))))

    starts = F.filter(F.sequence(F.lit(1), F.size(col)), begins)
    found = F.when(F.size(col) > 0, F.flatten(F.transform(starts, at))).otherwise(F.array())
    return units, found


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Sequence[tuple[str, str]] = SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
) -> DataFrame:
    """(id, licences array, sentences array of (unit, units, sentence)): one row per row of ``docs``.

    ``unit`` is the position (from 1) of the first unit of a sentence among the non-empty units,
    ``units`` how many it spans. Licences come in the order of the rules, each once; both arrays
    are empty for a NULL or empty text and for one without known sentences. Repeated rows stay, a
    NULL id is kept, other columns are ignored, an empty table gives no rows.
    """
    units, found = licence_sentences(F.col("text"), sentences)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = rows.select("id", units.alias("units")).select("id", found.alias("sentences"))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(ids) + "|").alias("ids")) for name, ids in rules])
    # identifiers keep a bar on either side, so that neighbours do not share one
    text = F.concat_ws("", F.transform(F.col("sentences"), lambda m: F.concat(F.lit("|"), m["sentence"], F.lit("|"))))
    joined = F.replace(text, F.lit("||"), F.lit("|"))
    start = F.struct(joined.alias("left"), F.array().cast("array<string>").alias("names"))

    def use(acc: Column, rule: Column) -> Column:
        fits = F.contains(acc["left"], rule["ids"])
        names = F.when(fits, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"])
        return F.struct(F.when(fits, F.replace(acc["left"], rule["ids"], F.lit("|"))).otherwise(acc["left"]).alias("left"), names.alias("names"))

    matched = F.when(F.size("sentences") > 0, F.aggregate(ordered, start, use)["names"]).otherwise(F.array().cast("array<string>"))
    return seen.select(F.col("id").alias(id_col), matched.alias("licences"), "sentences")
