"""Graph operators over edge tables: iterative joins with lineage cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import checkpoint


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of the connected component of every node that has an edge.

    Rounds grow with the logarithm of the longest chain; a graph that hasn't settled after ``max_rounds`` raises an error.

    Alternating large-star and small-star rounds; each node links to the least node it knows, so long chains shorten
    geometrically and a node of any degree is only ever aggregated, never collected. Null ends and self-loops are dropped.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    state, before = checkpoint(links), None
    for _ in range(max_rounds):
        both = state.select("u", "v").unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u")
        state = checkpoint(small.select("v", "m").where("v <> m").toDF("u", "v").unionAll(lowest.toDF("u", "v")).distinct())
        total = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == before:
            break
        before = tuple(total)
    else:
        raise ValueError(f"components not settled after {max_rounds} rounds")
    ends = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = state.select(F.col("v").alias("node")).distinct().join(state.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return ends.unionByName(roots.select("node", F.col("node").alias("component")))


def undirected(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(u, v, weight) in both directions."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).alias("weight"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` of each seed at their least hop; ``edges`` (u, v), ``seeds`` (seed)."""
    links = edges.select("u", "v").distinct()
    reached = front = checkpoint(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        onward = front.join(links, front["node"] == links["u"]).select("seed", F.col("v").alias("node")).distinct()
        front = checkpoint(onward.join(reached, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def spread(edges: DataFrame, seeds: DataFrame, decay: float = 0.7, hops: int = 2, cutoff: float = 0.01) -> DataFrame:
    """(node, energy): spreading activation that keeps the greatest energy to reach a node; ``seeds`` (node, energy)."""
    best = front = checkpoint(seeds.groupBy("node").agg(F.max("energy").alias("energy")))
    for _ in range(hops):
        sent = front.join(edges, front["node"] == edges["u"]).select(F.col("v").alias("node"), (F.col("energy") * decay * F.col("weight")).alias("energy"))
        gain = sent.where(F.col("energy") >= cutoff).groupBy("node").agg(F.max("energy").alias("energy"))
        better = gain.join(best.withColumnRenamed("energy", "had"), "node", "left").where("had is null or energy > had")
        front = checkpoint(better.select("node", "energy"))
        if front.isEmpty():
            break
        best = checkpoint(best.unionByName(front).groupBy("node").agg(F.max("energy").alias("energy")))
    return best


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength) of two-way edges (u, v, weight)."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.count_distinct("v").alias("degree"), F.sum("weight").alias("strength"))


def decayed(edges: DataFrame, now, fired: str = "last_fired", half_life_days: float = 30.0, floor: float = 0.0) -> DataFrame:
    """Edges with half-life decay of ``weight`` since they last fired; those below ``floor`` are pruned."""
    from palimpsest.functions.scoring import half_life, seconds_between

    days = seconds_between(F.lit(now).cast("timestamp_ntz"), F.col(fired)) / 86400
    return edges.withColumn("weight", half_life(F.col("weight"), days, half_life_days)).where(F.col("weight") >= floor)


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): label propagation over two-way edges; a node takes the label of most weight around it, the least on ties."""
    labels = checkpoint(edges.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = edges.join(labels.toDF("v", "label"), "v").groupBy("u", "label").agg(F.sum(F.round("weight", 6).cast("decimal(18,6)")).alias("w"))  # sums that don't depend on their order
        # of equal weights the least label: the greatest weight first, then the least label among its votes
        top = votes.groupBy("u").agg(F.max("w").alias("w"))
        labels = checkpoint(votes.join(top, ["u", "w"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label")))
    return labels


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) over two-way edges: each triangle is found once, at its two lowest-degree corners' edge."""
    degree = edges.groupBy("u").agg(F.count_distinct("v").alias("d"))
    one = edges.select("u", "v").where("u < v").distinct()
    ranked = one.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = ranked.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.toDF("a", "b").join(out.toDF("a", "c"), "a").where("b < c")
    closed = wedge.join(one.toDF("b", "c"), ["b", "c"], "left_semi")
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
