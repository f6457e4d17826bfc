"""Consolidating pairwise links into groups: connected components by low-diameter decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import cut, drop_cut

#: Rounds of growth in one level. Fewer rounds leave more links for the next level but never change the result.
GROW_ROUNDS = 5
#: Rate of the exponential start shifts; 1 / BETA is the mean head start in rounds.
BETA = 0.15


def _starts(vertices: DataFrame, level: int) -> DataFrame:
    """Exponential head start of each vertex, from a hash of the vertex and the level (the same on every retry)."""
    u = (F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 40)).cast("double") + 1.0) / float((1 << 40) + 1)
    return vertices.withColumn("t", F.log(u) / BETA)  # log(u) <= 0: the greater the shift, the earlier the start


def _grow(edges: DataFrame, level: int) -> DataFrame:
    """One low-diameter decomposition: (v, c), c the centre of the cluster that reaches v first.

    ``edges`` holds both directions. Every vertex starts its own cluster at -shift; in each round a vertex takes the
    earliest (arrival, centre) among its own and its neighbours' plus 1. Arrivals are aggregated by ``min`` per vertex
    (partial on the map side), so a vertex with very many links is no hot task, and the vertex side of the join has
    one row a vertex, so that a skewed edge side can be split by adaptive execution.
    """
    verts = edges.select(F.col("a").alias("v")).distinct()
    # a loop of weight 0 carries a vertex's own arrival along, so that every round is one join and one aggregate
    steps = edges.withColumn("w", F.lit(1.0)).unionByName(verts.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("w")))
    state = _starts(verts, level).select("v", F.struct(F.col("t").alias("t"), F.col("v").alias("c")).alias("s"))
    for _ in range(GROW_ROUNDS):
        sent = steps.join(state, steps["a"] == state["v"], "inner").select(F.col("b").alias("v"), F.struct((F.col("s.t") + F.col("w")).alias("t"), F.col("s.c").alias("c")).alias("s"))
        state = sent.groupBy("v").agg(F.min("s").alias("s"))
    return state.select("v", F.col("s.c").alias("c"))


def link_groups(pairs: DataFrame, left: str, right: str, *, max_levels: int = 100, report: list[int] | None = None) -> DataFrame:
    """Give every record one group: (``member``, ``group``), group being the least member linked directly or indirectly.

    A pair with a null side is ignored; a pair of a record with itself names the record; repeated and reversed pairs
    change nothing; an empty input gives no row. ``left`` and ``right`` must have one orderable type (a struct works).
    Other columns are ignored. ``report`` gets the number of links before each level and after the last.

    Low-diameter decomposition: clusters grow from exponentially shifted start times for a few rounds, each cluster
    contracts to one vertex, the links between clusters form the next level's graph, and so on until no link is left.
    The assignments of all levels are composed from the last to the first. Vertices are numbers given to the different
    names when these are written, not hashes, so no two names can be taken for one, however many there are. Each level is
    written to the shared folder; links are never brought to the driver.
    """
    p = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    ends = p.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    names = cut(ends.withColumn("v", F.monotonically_increasing_id()), "names")
    at = lambda end, as_: names.select(F.col("n").alias(end), F.col("v").alias(as_))
    # loops only name a vertex; repeated pairs go before the names are looked up
    one = p.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(_both(one.join(at("a", "ia"), "a").join(at("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))), "links")
    levels: list[DataFrame] = []
    for level in range(max_levels):
        links = edges.count() // 2
        if report is not None:
            report.append(links)
        if not links:
            break
        grown = cut(_grow(edges, level), "clusters")
        levels.append(grown)
        ca, cb = grown.select(F.col("v").alias("a"), F.col("c").alias("ca")), grown.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        # halves suffice for the contraction; the other directions are put back after the distinct
        nxt = edges.where("a < b").join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        nxt = cut(_both(nxt), "links")
        drop_cut(edges)
        edges = nxt
    else:
        raise RuntimeError(f"links are left after {max_levels} levels")
    comp = None
    for grown in reversed(levels):
        if comp is None:
            comp = grown.select("v", F.col("c").alias("r"))
        else:
            up = comp.select(F.col("v").alias("c"), "r")
            comp = grown.join(up, "c", "left").select("v", F.coalesce("r", "c").alias("r"))
    placed = names.withColumn("r", F.col("v")) if comp is None else names.join(comp, "v", "left").select("v", "n", F.coalesce("r", "v").alias("r"))
    placed = cut(placed, "placed")
    for done in [names, edges, *levels]:
        drop_cut(done)
    least = placed.groupBy("r").agg(F.min("n").alias("group"))
    return placed.join(least, "r").select(F.col("n").alias("member"), "group")


def _both(e: DataFrame) -> DataFrame:
    """Distinct links without loops, in both directions."""
    one = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return one.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
