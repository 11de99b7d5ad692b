import textwrap

from panelforge.llm.licences import scan_licences
from panelforge.llm.q_urls import RULES
from panelforge.llm.urls import best_rule, judge_urls

from .cases import documents, empty


def test_host_path_and_longest_rule(spark):
    urls = [
        "HTTP://WWW.Example.ORG/en/17?x#y", "http://a.example.org/es/1", "http://example.org/fr", "http://notexample.org/es/1",
        "https://x.com/de/9", "https://x.com/fr/9", "https://x.com", "no scheme", None, "http://x.com?a=http://y.org/z", "a://b://c/d", "http://org/",
        "http://x.net/" + "a/" * 5000,
    ]
    df = spark.createDataFrame([(i, u, "r", "t") for i, u in enumerate(urls)] + [(0, urls[0], "r", "t")], "page_id long, url string, rule string, template string")
    got = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in judge_urls(df, RULES).collect()}
    assert got[0] == ("www.example.org", "/en/17", "example.org/en/1", "block")
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/fr", "org/", "allow")
    assert got[3] == ("notexample.org", "/es/1", "org/", "allow")
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == ("x.com", "", None, "allow")
    assert got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert got[9][:3] == ("x.com", "", None)
    assert got[10][:2] == ("b:", "//c/d")
    assert got[11][2] == "org/"
    assert judge_urls(df, RULES).count() == len(urls) + 1
    assert judge_urls(df.where("false"), RULES).count() == 0


def test_a_template_of_blocked_pages_is_rejected(spark):
    rules = [("block", "shop.com", "/deals/1"), ("allow", "shop.com", "/help/")]
    rows = [f"http://shop.com/deals/1{i}" for i in range(40)] + [f"http://shop.com/deals/2{i}" for i in range(9)] + [f"http://shop.com/help/{i}" for i in range(40)]
    rows += [f"http://shop.com/about/{w}" for w in ("us", "them")]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r for r in judge_urls(df, rules).collect()}
    # unlabelled pages of the blocked template go, those of other templates stay
    assert got["http://shop.com/deals/23"]["verdict"] == "block" and got["http://shop.com/deals/23"]["rule"] is None
    assert got["http://shop.com/about/us"]["verdict"] == "allow"
    assert got["http://shop.com/help/3"]["template"] == "/help/*/$"
    assert got["http://shop.com/about/us"]["template"] == "/*/*/$"


def test_a_small_labelled_branch_does_not_decide_for_others(spark):
    rows = [f"http://big.com/en/{i}" for i in range(600)] + [f"http://big.com/de/{i}" for i in range(10)] + ["http://big.com/fr/1"]
    rows += [f"http://lone.com/en/{i}" for i in range(60)] + [f"http://lone.com/de/{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = [(rows[r["page_id"]], r["template"], r["verdict"]) for r in judge_urls(df, RULES).collect()]
    assert {v for u, _, v in got if "/en/" in u} == {"allow"}
    assert {(t, v) for u, t, v in got if "/de/" in u} == {("/de/*/$", "block")}


def test_licence_sentences_and_rules(spark):
    texts = [
        "Intro | table\nLicensed under the Apache License,\n Version 2.0.\nBody",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "We talk about the license of this software.",
        "Released under the MIT License. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        None, "",
    ]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, units string, sentences string")
    got = {r["doc_id"]: r for r in scan_licences(df).collect()}
    assert got[0]["licences"] == ["Apache-2.0"] and [(s["unit"], s["units"]) for s in got[0]["sentences"]] == [(2, 2)]
    assert got[1]["licences"] == ["MIT"] and [s["sentence"] for s in got[1]["sentences"]] == ["mit-grant", "mit-notice"]
    assert got[2]["licences"] == [] and len(got[2]["sentences"]) == 1
    assert got[3]["licences"] == [] and got[3]["sentences"] == []
    assert got[4]["licences"] == ["MIT", "CC-BY-NC-4.0"] and len(got[4]["sentences"]) == 3
    assert got[5]["licences"] == [] and got[6]["licences"] == []
    docs = documents(spark)
    assert scan_licences(docs).count() == docs.count()
    assert scan_licences(empty(docs)).count() == 0


def test_unlabelled_branches_never_share_a_labelled_template(spark):
    rules = [("block", "half.com", "/de/"), ("allow", "half.com", "/a/"), ("block", "half.com", "/b/"), ("block", "two.com", "/spam/1"), ("block", "two.com", "/junk/1"), ("block", "d.com", "/7")]
    # four blocked pages, 500 unlabelled ones, elsewhere half of the labelled pages blocked
    rows = [f"http://half.com/de/{i}" for i in range(4)] + [f"http://half.com/en/{i}" for i in range(500)]
    rows += [f"http://half.com/{x}/{i}" for x in "ab" for i in range(30)]
    # two branches that are blocked alike, and one without labels
    rows += [f"http://two.com/{x}/1{i}" for x in ("spam", "junk") for i in range(50)] + [f"http://two.com/{x}/2{i}" for x in ("spam", "junk") for i in range(5)]
    rows += [f"http://two.com/news/{i}" for i in range(500)]
    # a branch of numbers with labels, beside unlabelled words
    rows += [f"http://d.com/7{i}" for i in range(30)] + [f"http://d.com/8{i}" for i in range(5)] + [f"http://d.com/{w}" for w in ("us", "them")]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r for r in judge_urls(df, rules).collect()}
    assert {got[u]["verdict"] for u in rows if "/en/" in u or "/news/" in u} == {"allow"}
    assert got["http://half.com/en/7"]["template"] != got["http://half.com/de/3"]["template"]
    # the two blocked branches merge with each other, and decide for their own unlabelled pages
    assert {got[f"http://two.com/{x}/23"]["template"] for x in ("spam", "junk")} == {"/#/*/$"}
    assert {got[f"http://two.com/{x}/23"]["verdict"] for x in ("spam", "junk")} == {"block"}
    assert got["http://d.com/83"]["verdict"] == "block" and got["http://d.com/83"]["template"] == "/*/$"
    assert got["http://d.com/us"]["verdict"] == "allow" and got["http://d.com/us"]["template"] == "/?/$"


def test_of_equally_long_rules_the_first_wins(spark):
    one = spark.createDataFrame([("a.com", "/x/y")], "host string, path string")
    rules = [("allow", "a.com", "/x"), ("block", "com", "/x/y")]
    chosen = one.select(best_rule(one["host"], one["path"], rules).alias("a"), best_rule(one["host"], one["path"], rules[::-1]).alias("b")).first()
    assert (chosen["a"], chosen["b"]) == (0, 0)


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)


def test_wrapped_licences_and_longer_rules(spark):
    narrow = "\n".join(textwrap.fill(p, 24) for p in MIT.split("\n"))
    texts = [
        narrow, MIT.replace(" ", "\n"), BSD + ENDORSE, BSD, "This file is licensed under the MIT License.", "// SPDX-License-Identifier: Apache-2.0\nint main;",
        "SPDX-License-Identifier: GPL-2.0-or-later", "Distributed under the GNU Lesser General Public License v3.0.",
        "This is free and unencumbered software released into the public domain.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in scan_licences(df).collect()}
    want = [["MIT"], ["MIT"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["MIT"], ["Apache-2.0"], ["GPL-2.0-or-later"], ["LGPL-3.0"], ["Unlicense"]]
    assert [got[i] for i in range(len(texts))] == want
