"""Personalised PageRank over a weighted bag of edges, as joins on long ids."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Links of one source beyond which they are split in pieces, to each of which its rank is sent.
SPLIT_LINKS = 100_000
#: Damping, iterations and tolerance where none, or a bad one, is given. Fixed values.
DAMPING, ITERATIONS, TOLERANCE = 0.85, 25, 1e-6


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, score) of all nodes; seeds (id, weight) that are no nodes are left out, none at all means uniform.

    Mass that leads to missing nodes is lost, that of nodes without outgoing weight goes to the
    seeds. It ends after the step whose L1 change is below the tolerance, or after `iterations`;
    it is not run to convergence.
    """
    damping = damping if 0 < damping < 1 else DAMPING
    iterations = iterations if iterations > 0 else ITERATIONS
    tolerance = tolerance if tolerance > 0 else TOLERANCE
    spark, s = nodes.sparkSession, Scratch(nodes.sparkSession, "pagerank")

    ids = nodes.select("id").where("id is not null").distinct()
    given = seeds.where("id is not null and weight > 0").groupBy("id").agg(F.sum("weight").alias("seed"))
    base = ids.join(given, "id", "left").select(F.monotonically_increasing_id().alias("v"), "id", F.coalesce("seed", F.lit(0.0)).alias("seed"))
    base, n = s.cut_counting(base, seeded=F.sum("seed"))
    if not n["rows"]:
        return ids.select("id", F.lit(0.0).alias("score"))
    total = n["seeded"] or 0.0
    p0 = F.col("seed") / total if total > 0 else F.lit(1.0 / n["rows"])

    e = edges.where("src is not null").select("src", "dst", F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")).alias("w"))
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))  # parallel edges first: fewer rows to shuffle from here on
    e = s.cut(e.join(base.select(F.col("id").alias("src"), F.col("v").alias("s")), "src").select("s", "dst", "w"))
    out = s.cut(e.groupBy("s").agg(F.sum("w").alias("out"), F.ceil(F.count(F.lit(1)) / SPLIT_LINKS).cast("int").alias("pieces")).where("out > 0"))
    share = e.join(base.select(F.col("id").alias("dst"), F.col("v").alias("t")), "dst").join(out, "s")
    piece = F.pmod(F.xxhash64("t"), "pieces").cast("int").alias("piece")
    # the links lie by source and piece once and for all: each round moves ranks and sums only
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = share.select("s", piece, "t", (F.col("w") / F.col("out")).alias("share")).repartition(width, "s", "piece")
    share = share.persist(StorageLevel.MEMORY_AND_DISK)
    still = base.select("v", p0.alias("p0")).join(out.select(F.col("s").alias("v"), "pieces"), "v", "left")
    still = still.select("v", "p0", F.coalesce("pieces", F.lit(0)).alias("pieces"))

    dangling = F.sum(F.when(F.col("pieces") == 0, F.col("rank")))
    rank, n = s.cut_counting(still.withColumn("rank", F.col("p0")), dangling=dangling)
    try:
        for _ in range(iterations):
            back = damping * float(n["dangling"] or 0.0) + 1 - damping
            # what reaches a node and the node's own row meet in one aggregation
            none = F.lit(None)
            spread = rank.where("pieces > 0").select(F.col("v").alias("s"), F.col("rank").alias("r"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
            reached = share.join(spread.hint("shuffle_hash"), ["s", "piece"]).select(F.col("t").alias("v"), (F.col("share") * F.col("r")).alias("mass"), none.cast("double").alias("p0"), none.cast("int").alias("pieces"), none.cast("double").alias("rank"))
            own = rank.select("v", F.lit(0.0).alias("mass"), "p0", "pieces", "rank")
            met = reached.unionByName(own).groupBy("v").agg(F.sum("mass").alias("mass"), *[F.max(c).alias(c) for c in ("p0", "pieces", "rank")])
            new = F.col("mass") * damping + F.col("p0") * back
            nxt = met.select("v", "p0", "pieces", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
            nxt, n = s.cut_counting(nxt, dangling=dangling, moved=F.sum("moved"))
            s.drop(rank)
            rank = nxt
            if (n["moved"] or 0.0) < tolerance:
                break
    finally:
        share.unpersist()
    s.drop(e, out)
    return base.select("v", "id").join(rank.select("v", "rank"), "v").select("id", F.col("rank").alias("score"))
