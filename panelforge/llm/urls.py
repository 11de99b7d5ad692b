"""URL filter: explicit rules first, then a path-template tree per host.

A rule is (verdict, domain, path): it fits its domain and all subdomains when the path of the
URL starts with the rule's; of the rules that fit, the longest wins. Pages under a rule are the
labelled pages of the tree:

1. variable segments become wildcards: digit runs and overlong segments by their shape;
2. labelled sibling branches merge with each other, into ``#``, unless the share of blocked pages
   of all other labelled siblings lies outside a branch's own interval (Wilson), or there are none:
   such a branch keeps its name. Few labels mean a wide interval, so no count of pages is asked for;
3. branches without labelled pages merge with each other, into ``*`` (``?`` where a labelled branch
   is called ``*``), and never with labelled ones;
4. a template is rejected when its share of blocked pages, smoothed towards its host and the
   host towards all pages, reaches ``purity``; one without labelled pages is not.

Levels are aggregates and joins over (host, shape) rows, so a host with a third of all pages is
pre-aggregated before every shuffle and never sits in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import side

DEPTH = 4
LONG_SEGMENT = 40
#: Square of the normal quantile of the intervals: 95 %.
DIFFERS = 3.84
SMOOTH = 5.0
PURITY = 0.8

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), upper, lower)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Position in ``rules`` of the longest rule that fits, the first of equally long ones; NULL when none does."""
    out = F.lit(None).cast("int")
    for i, (_, domain, start) in sorted(enumerate(rules), key=lambda x: (len(x[1][1]) + len(x[1][2]), -x[0])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _segments(path: Column, depth: int) -> list[Column]:
    """The first segments by shape, then one for all that is deeper; ``$`` ends a path, empty follows."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    out = []
    for i in range(depth):
        seg = F.get(parts, i)
        shape = F.when(F.length(seg) > LONG_SEGMENT, F.lit("*")).otherwise(F.regexp_replace(seg, r"[0-9]+", "*"))
        out.append(F.when(F.size(parts) > i, shape).when(F.size(parts) == i, F.lit("$")).otherwise(F.lit("")))
    out.append(F.when(F.size(parts) > depth, F.lit("**")).when(F.size(parts) == depth, F.lit("$")).otherwise(F.lit("")))
    return out


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]


def path_templates(shapes: DataFrame, keys: Sequence[str], differs: float = DIFFERS) -> DataFrame:
    """Add ``template`` to (host, ``keys``, pages, labelled, blocked), one level of the tree at a time."""
    current = shapes.withColumn("template", F.lit(""))
    for s in keys:
        child = store(current.groupBy("host", "template", F.col(s).alias("seg")).agg(*_sums()))
        starred = F.bool_or((F.col("seg") == "*") & (F.col("labelled") > 0)).alias("starred")
        parent = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("labelled", "blocked")], starred)
        wide = F.lit(0) + F.octet_length("host") + F.octet_length("template")
        both = child.join(side(store(parent), wide), ["host", "template"])
        n, b = F.col("labelled"), F.col("blocked")
        rest = F.try_divide(F.col("all_blocked") - b, F.col("all_labelled") - n)
        centre = (b + differs / 2) / (n + differs)
        half = F.sqrt(F.lit(differs)) * F.sqrt(F.try_divide(b * (n - b), n) + differs / 4) / (n + differs)
        own = rest.isNull() | (rest < centre - half) | (rest > centre + half)
        step = (
            F.when(F.col("seg") == "", F.col("template"))
            .when(F.col("seg").isin("$", "**"), F.concat("template", F.lit("/"), "seg"))
            .when(n == 0, F.concat("template", F.when(F.col("starred"), F.lit("/?")).otherwise(F.lit("/*"))))
            .when(own, F.concat("template", F.lit("/"), "seg"))
            .otherwise(F.concat("template", F.lit("/#")))
        )
        named = store(both.select("host", "template", F.col("seg").alias(s), step.alias("next")))
        named = side(named, wide + F.octet_length(s) + F.octet_length("next"))
        current = current.join(named, ["host", "template", s]).drop("template").withColumnRenamed("next", "template")
    return current


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int = DEPTH,
    smooth: float = SMOOTH,
    purity: float = PURITY,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity): one row per page.

    The longest rule that fits decides, of equally long ones the first in the list.
    A NULL URL and one without ``://`` have an empty host and path; they form a host of their
    own. Repeated rows are judged alike and all returned, a NULL id is kept, other columns are
    ignored, and an empty table gives no rows. Without any labelled page nothing is rejected.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    which = best_rule(F.col("host"), F.col("path"), rules)
    names = F.array(*[F.lit(d + p) for _, d, p in rules])
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules])
    keys = [f"s{i + 1}" for i in range(depth + 1)]
    ruled = parts.withColumn("_rule", which).select(
        "id", "host", "path",
        F.get(names, F.col("_rule")).alias("rule"),
        F.get(verdicts, F.col("_rule")).alias("ruled"),
        *[c.alias(k) for k, c in zip(keys, _segments(F.col("path"), depth))],
    )
    counted = ruled.groupBy("host", *keys).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count("ruled").alias("labelled"),
        F.count_if(F.col("ruled") == "block").alias("blocked"),
    )
    tree = store(path_templates(store(counted), keys))
    total = tree.agg(*_sums()).first()
    overall = (total["blocked"] or 0) / total["labelled"] if total["labelled"] else 0.0
    hosts = tree.groupBy("host").agg(*_sums()).select(
        "host", ((F.col("blocked") + smooth * overall) / (F.col("labelled") + smooth)).alias("prior")
    )
    templates = tree.groupBy("host", "template").agg(*_sums())
    scored = templates.join(side(store(hosts), F.octet_length("host")), "host").select(
        "host", "template", ((F.col("blocked") + smooth * F.col("prior")) / (F.col("labelled") + smooth)).alias("purity"),
        (F.col("labelled") > 0).alias("judged"),
    )
    lookup = tree.select("host", *keys, "template").join(
        side(store(scored), F.octet_length("host") + F.octet_length("template")), ["host", "template"]
    )
    wide = F.octet_length("host") + F.octet_length("template") + sum((F.octet_length(k) for k in keys), F.lit(0))
    judged = ruled.join(side(store(lookup), wide), ["host", *keys])
    method = F.when(F.col("judged") & (F.col("purity") >= purity), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )
