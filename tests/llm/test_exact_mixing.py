import hashlib
import math
import re
from collections import Counter

from panelforge.llm.exact import drop_exact_copies, exact_groups
from panelforge.llm.mixing import mix_sources, mixed_documents, source_targets

from .cases import TEXTS, by_id, documents, empty


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(squeeze(r["text"]), []).append(r)
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out += [(r["doc_id"], best["doc_id"], len(g), hashlib.sha256(norm.encode()).hexdigest()) for r in g]
    return sorted(out, key=repr)


def test_exact_groups_match_brute_force_with_and_without_hot_texts(spark):
    docs = documents(spark)
    want = brute_exact(docs.select("doc_id", "text").collect())
    for hot in (1_000, 1):
        got = exact_groups(docs, hot_rows=hot).collect()
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == want
        # exactly one row of each text stays, also when the row is repeated
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len({r["text_sha256"] for r in got})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_copies_are_dropped_with_all_columns(spark):
    docs = documents(spark)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert len(rows) == len({squeeze(t) for t in [*TEXTS, "lost words here"]})
    assert {r["h"] for r in rows} == {"x"}
    assert drop_exact_copies(empty(docs)).count() == 0


def test_targets_refill_and_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    # 1.5 * 2510 words; a stops at 20, the rest is shared 2 : 1 : 5 and NULL stops at 1000
    assert got["a"] == 20.0 and got[None] == 1000.0
    assert math.isclose(sum(got.values()), 1.5 * 2510)
    assert math.isclose(got["b"], 1830.0) and math.isclose(got["c"], 915.0)


def test_mix_is_near_its_targets_and_stable(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    small, large = (by_id(mix_sources(docs, bucket_rows=b).collect()) for b in (10, 100_000))
    assert [tuple(r) for r in small] == [tuple(r) for r in large]
    for s in range(3):
        rows = [r for r in small if r["doc_id"] % 3 == s]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 7
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)


def test_quality_comes_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 8.0 if i < 1500 else 0.25) for i in range(3000)], "id long, weight double")
    third = [r for r in mix_sources(docs, quality=quality).collect() if r["doc_id"] % 3 == 2]
    good, poor = (sum(r["taken"] for r in third if (r["doc_id"] < 1500) is g) for g in (True, False))
    # the target is five sixths of the source: all good documents come, then poor ones
    assert good == 5000 and 3300 <= poor <= 3340


def test_mix_handles_odd_rows(spark):
    docs = documents(spark)
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mix_sources(empty(docs)).count() == 0
    assert mixed_documents(empty(docs)).count() == 0


def test_rows_of_one_id_share_its_copies(spark):
    rows = [(None, f"a b c {i % 40}", "s") for i in range(200)] + [(7, "d e", "s")] * 30 + [(100 + i, "f g h", "t") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mix_sources(docs).collect()
    got = mixed_documents(docs).collect()
    assert len(got) == sum(r["copies"] for r in copies)
    for key, number in ((None, 200), (7, 30)):
        total = sum(r["copies"] for r in copies if r["doc_id"] == key)
        taken = Counter(r["text"] for r in got if r["doc_id"] == key)
        there = Counter(t for i, t, _ in rows if i == key)
        assert sum(taken.values()) == total
        # as evenly as it goes: every row floor or ceiling of the mean
        assert all(total // number * there[t] <= taken[t] <= -(-total // number) * there[t] for t in there)
    again = mixed_documents(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
