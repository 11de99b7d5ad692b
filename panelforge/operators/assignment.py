"""The assignment with the largest gain, by an auction over a table of edges.

Every node may stay alone. To let prices start anywhere, the graph is doubled: each node is a
bidder and an object, an edge (a, b) lets bidder a have object b and bidder b have object a, and a
node may have itself for nothing. A largest perfect matching of that graph holds a largest matching
of the edges. In a round all bidders without an object bid for the one of most value to them, at
the price that makes it worth their second choice, less a step; an object goes to the highest
bidder (Bertsekas, "The Auction Algorithm", 1988). Gains are whole numbers times the number of
nodes plus one, so a last step of 1 proves the result; earlier steps are larger and keep rounds few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import store

#: Steps shrink by this factor from a share of the largest gain down to 1.
SHRINK = 8


def candidate_edges(edges: DataFrame) -> DataFrame:
    """The edges (a, b, gain) that a largest assignment can be made of.

    Of ``m`` nodes on one side at most ``m - 1`` others are taken by the rest, so the best ``m``
    partners of a node are enough; the smaller side bounds what is kept by its square.
    """
    sides = edges.agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).first()
    by_a = Window.partitionBy("a").orderBy(F.desc("gain"), "b")
    by_b = Window.partitionBy("b").orderBy(F.desc("gain"), "a")
    kept = edges.withColumn("at", F.row_number().over(by_b)).where(F.col("at") <= max(sides["b"], 1))
    best = edges.withColumn("at", F.row_number().over(by_a)).where(F.col("at") <= max(sides["a"], 1))
    return kept.drop("at").join(best.select("a", "b"), ["a", "b"])


def _doubled(edges: DataFrame, scale: int) -> DataFrame:
    """(p, o, gain) of the doubled graph; a node is a struct of its side and name."""
    left = F.struct(F.lit(0).alias("side"), F.col("a").cast("string").alias("name"))
    right = F.struct(F.lit(1).alias("side"), F.col("b").cast("string").alias("name"))
    gain = (F.col("gain") * F.lit(scale)).alias("gain")
    both = edges.select(left.alias("p"), right.alias("o"), gain).unionAll(edges.select(right.alias("p"), left.alias("o"), gain))
    alone = both.select("p").distinct().select("p", F.col("p").alias("o"), F.lit(0).cast("long").alias("gain"))
    return both.unionAll(alone)


def _bids(edges: DataFrame, state: DataFrame, step: int) -> DataFrame:
    """(o, bid, winner) of all bidders without an object."""
    free = edges.join(state.where(F.col("owner").isNotNull()).select(F.col("owner").alias("p")), "p", "left_anti")
    valued = free.join(state.select("o", "price"), "o").withColumn("value", F.col("gain") - F.col("price"))
    order = Window.partitionBy("p").orderBy(F.desc("value"), "o")
    first = valued.withColumn("at", F.row_number().over(order)).where("at <= 2")
    best = first.groupBy("p").agg(
        F.max_by("o", F.when(F.col("at") == 1, 1).otherwise(0)).alias("o"),
        F.max("value").alias("value"),
        F.min("value").alias("second"),
        F.max_by("price", F.when(F.col("at") == 1, 1).otherwise(0)).alias("price"),
    )
    bid = F.col("price") + F.col("value") - F.col("second") + F.lit(step)
    return best.select("o", bid.alias("bid"), "p").groupBy("o").agg(F.max(F.struct("bid", "p")).alias("m")).select("o", "m.bid", F.col("m.p").alias("winner"))


def largest_assignment(edges: DataFrame) -> DataFrame:
    """(a, b, gain) of an assignment of most gain; gains are whole numbers, those above 0 count."""
    edges = store(candidate_edges(store(edges.where(F.col("gain") > 0).groupBy("a", "b").agg(F.max("gain").alias("gain")))))
    size = edges.agg(F.countDistinct("a") + F.countDistinct("b"), F.max("gain")).first()
    if not size[0]:
        return edges
    scale = size[0] + 1
    doubled = store(_doubled(edges, scale))
    state = store(doubled.select("o").distinct().select("o", F.lit(0).cast("long").alias("price"), F.expr("cast(null as struct<side:int,name:string>)").alias("owner")))
    step = max(1, size[1] * scale // 2)
    while True:
        state = store(state.withColumn("owner", F.expr("cast(null as struct<side:int,name:string>)")))
        while True:
            bids = store(_bids(doubled, state, step))
            if bids.isEmpty():
                break
            state = store(
                state.join(bids, "o", "left").select("o", F.coalesce("bid", "price").alias("price"), F.coalesce("winner", "owner").alias("owner"))
            )
        if step == 1:
            break
        step = max(1, step // SHRINK)
    taken = state.where((F.col("o.side") == 1) & (F.col("owner.side") == 0)).select(F.col("owner.name").alias("_a"), F.col("o.name").alias("_b"))
    return edges.join(taken, (F.col("a").cast("string") == F.col("_a")) & (F.col("b").cast("string") == F.col("_b"))).select("a", "b", "gain")
