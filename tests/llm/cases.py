"""Small frames with every odd case that the operators must handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# column names that operators use inside
CLASHING = ("id", "row", "key", "copies", "copy", "h", "n", "fp", "rule", "template", "component_id")

TEXTS = [
    "one two three four five six seven eight",
    "one two\tthree four five six seven  eight",
    "one two three four five six seven nine",
    "",
    None,
    " \n\t ",
    "word " * 30_000,
    "Für Élise <|endoftext|> naïve Σίσυφος ΣΑΣ",
    "it's 3 o'clock, isn't it?\r\n\x0b\x0cend",
    "a",
    "a b",
]


def documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, copies, ties, a repeated row, clashing columns."""
    rows = [(i, t, None if i % 5 == 4 else "en", None if i == 3 else f"src{i % 2}", i) for i, t in enumerate(TEXTS)]
    rows += [(20, TEXTS[0], "en", "src0", 20), (21, TEXTS[0], "en", "src1", 21), (2, TEXTS[2], "en", "src0", 2), (None, "lost words here", None, None, None)]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    wide = [r + tuple("x" for _ in CLASHING) for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def empty(df: DataFrame) -> DataFrame:
    return df.where("false")


def by_id(rows, key="doc_id"):
    return sorted(rows, key=lambda r: (r[key] is None, r[key] if r[key] is not None else 0, repr(r)))
