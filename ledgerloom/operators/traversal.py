"""Graph algorithms as joins over edge tables (group I). Edges are (src, dst[, rel, seq]).

Breadth-first searches join the frontier to the edges and drop what was visited by an anti join; each step ends in a written table, so
the lineage stays short and a lost executor costs one step. Nodes that don't occur in the edges are kept as seeds only if they are
known nodes; self loops lead nowhere; parallel edges count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from .pattern import symmetric


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """id, depth of the nodes within ``hops`` steps of the seeds."""
    over = (edges if directed else symmetric(edges)).select("src", "dst").distinct()
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, hops + 1):
        step = frontier.select(F.col("id").alias("src")).join(over, "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def ring_neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id, depth where each step after the first goes two steps from the ring before (I2), so two hops may reach a distance of three."""
    over = symmetric(edges).select("src", "dst").distinct()
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    ring = seen.select("id")
    for d in range(1, hops + 1):
        one = ring.select(F.col("id").alias("src")).join(over, "src").select(F.col("dst").alias("id")).distinct()
        reach = one if d == 1 else one.unionByName(one.select(F.col("id").alias("src")).join(over, "src").select(F.col("dst").alias("id"))).distinct()
        new = written(reach.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "ring")
        seen, ring = seen.unionByName(new), new.select("id")
    return seen


def eccentricity(edges: DataFrame, seeds: DataFrame, most: int = 1000) -> int:
    """The depth of the deepest level that an undirected search from the seeds reaches (I7); an error if it goes deeper than ``most``."""
    over = written(symmetric(edges).select("src", "dst").distinct(), "sym")
    seen = frontier = seeds.select("id").distinct()
    for depth in range(most):
        step = frontier.select(F.col("id").alias("src")).join(over, "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(seen, "id", "left_anti"), "level")
        if frontier.isEmpty():
            return depth
        seen = written(seen.unionByName(frontier), "seen")
    raise ValueError(f"the search goes deeper than {most} levels")


def two_hop_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """a, b, c, n_hops: out-edge paths of one and two edges from the starts (I5); the second edge leads to neither start nor neighbour."""
    e = edges.select("src", "dst").distinct()
    one = starts.select(F.col("id").alias("a")).distinct().join(e.withColumnsRenamed({"src": "a", "dst": "b"}), "a")
    two = one.join(e.withColumnsRenamed({"src": "b", "dst": "c"}), "b").where("c <> a AND c <> b")
    return one.select("a", "b", F.lit(None).cast("string").alias("c"), F.lit(1).alias("n_hops")).unionByName(two.select("a", "b", "c", F.lit(2).alias("n_hops")))


def simple_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 4) -> DataFrame:
    """path (array of nodes), n_hops: all directed simple paths between given (s, t) pairs of at most ``cutoff`` edges (I8). A search is
    cut at nodes from which no asked target can be reached in the edges that are left."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    near = pairs.select(F.col("t").alias("v"), "t").distinct().withColumn("left", F.lit(0))
    back = near
    for d in range(1, cutoff):
        back = back.select(F.col("v").alias("dst"), "t").join(e, "dst").select(F.col("src").alias("v"), "t").distinct().withColumn("left", F.lit(d))
        near = near.unionByName(back)
    near = written(near.groupBy("v", "t").agg(F.min("left").alias("left")), "near")
    open_ = pairs.select("t", F.array("s").alias("path"), F.col("s").alias("at")).distinct()
    out = []
    for d in range(1, cutoff + 1):
        step = open_.join(e, open_["at"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.join(near, (F.col("dst") == F.col("v")) & (near["t"] == open_["t"])).where(F.col("left") <= cutoff - d)
        grown = written(step.select(open_["t"], F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")), "paths")
        out.append(grown.where("at = t").select("path", F.lit(d).alias("n_hops")))
        open_ = grown.where("at <> t")
    return reduce(DataFrame.unionByName, out)


def without_self_loops(edges: DataFrame) -> DataFrame:
    """I10."""
    return edges.where("src <> dst")


def trimmed(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """Nodes by (depth, id) up to a number, and edges between them up to a number, those at a seed first (F8)."""
    kept = nodes.orderBy("depth", "id").limit(most_nodes)
    seeds = kept.where("depth = 0").select("id").limit(most_nodes)
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    at = inside
    for end in ("src", "dst"):
        at = at.join(F.broadcast(seeds.select(F.col("id").alias(f"{end}_seed"))), F.col(end) == F.col(f"{end}_seed"), "left")
    at_seed = F.col("src_seed").isNotNull() | F.col("dst_seed").isNotNull()
    ranked = at.groupBy("src", "dst", "rel").agg(F.min(F.when(at_seed, 0).otherwise(1)).alias("p"))
    return kept, ranked.orderBy("p", "src", "dst", "rel").limit(most_edges).drop("p")


def ledger(edges: DataFrame) -> DataFrame:
    """line: distinct lines ``[A] --(REL: description)--> [B]``, long descriptions cut."""
    text = F.coalesce("description", F.lit(""))
    shown = F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text)
    label = F.when(text == "", F.col("rel")).otherwise(F.concat("rel", F.lit(": "), shown))
    return edges.select(F.concat(F.lit("["), "src", F.lit("] --("), label, F.lit(")--> ["), "dst", F.lit("]")).alias("line")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (the least id in it), by rounds of large-star and small-star joins, which need a logarithmic number of rounds."""
    e = written(symmetric(edges).select("src", "dst").where("src <> dst").distinct(), "cc")
    while True:
        least = lambda x: x.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = e.join(least(e), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct().where("src <> dst")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        roots = least(down)
        small = down.join(roots, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(roots.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        new = written(symmetric(small).distinct(), "cc")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return nodes.select("id").distinct().join(e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")), "id", "left").select("id", F.least("id", F.coalesce("m", F.col("id"))).alias("component"))


def collapsed(edges: DataFrame) -> DataFrame:
    """The last written edge of each ordered pair, by seq."""
    n = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.col("seq").desc()))
    return edges.withColumn("__n", n).where("__n = 1").drop("__n")
