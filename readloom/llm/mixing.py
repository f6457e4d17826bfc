"""Mixing of sources to target shares of the total size, by thresholds on hashes."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash bits that one pass resolves; a pass brings at most 2**BITS sums for each target row to the driver.
BITS = 10
HASH_BITS = 60


def mix_sources(docs: DataFrame, targets: DataFrame, *, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Choose a selection in which each source holds its target share of the total size.

    ``docs``: ``doc_id``, ``source``, ``size`` (one row a document; best a written table, since it is read in several
    passes). ``targets``: ``source``, ``target_share``, ``max_repeats`` (a small table of parameters, one row a source).

    Returns (selection, report). Selection: ``doc_id``, ``source``, ``size``, ``repeats`` (how often the document occurs,
    1 or more). Report, one row a target: ``source``, ``target_share``, ``max_repeats``, ``available``, ``taken``,
    ``reached_share``.

    A source that is to give more than it has is taken whole floor(wanted / available) times, and the rest of the want is
    filled by the documents whose hash lies under a threshold. The threshold is found without sorting: sums of sizes by
    source and hash bucket, the bucket in which the budget runs out, then only that bucket in finer buckets, and so on
    until it holds one document; that document is taken if this comes nearer to the want. So the selections of growing
    totals are nested, and every source ends within half a document of its want.

    ``total``: the size of the whole selection; None: the greatest at which every source present can hold its share
    within ``max_repeats``. A source of ``targets`` without any size can't hold a share: it is reported with 0 and the
    others keep their proportions. Where a given ``total`` asks more than ``max_repeats`` allows, the source gives all it
    may and the report shows the shortfall. Documents of other or null sources, of null or zero size, and of
    sources with a null or non-positive share or repeats are not selected; repeated target rows of a source: the greatest
    share counts; empty tables give an empty selection.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id"), F.col("source"), F.col("size").cast("bigint").alias("size"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS).alias("_h")).where("size > 0")
    goal = {r[0]: (float(r[1]), int(r[2])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share"), F.max_by("max_repeats", "target_share")).collect()}
    named = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    # only sources of the targets are summed: the result is no longer than the parameter table
    have = {r[0]: int(r[1]) for r in d.join(named.select("source"), "source").groupBy("source").agg(F.sum("size")).collect() if r[0] in goal}
    weight = sum(goal[s][0] for s in have)
    if total is None:
        total = min((goal[s][1] * n * weight / goal[s][0] for s, n in have.items()), default=0.0)
    whole, budget = {}, {}
    for s, n in have.items():
        want = min(goal[s][0] / weight * total, goal[s][1] * n)
        whole[s] = min(int(want // n), goal[s][1])
        budget[s] = want - whole[s] * n if whole[s] < goal[s][1] else 0.0
    # nested thresholds: (bits resolved, bucket at that depth, budget left in the bucket)
    limit = {s: 0 for s in have}  # hashes below are taken
    at = {s: (0, 0, b) for s, b in budget.items() if b > 0}
    while at:
        edge = spark.createDataFrame([(s, bits, bucket) for s, (bits, bucket, _) in at.items()], "source string, bits int, bucket bigint")
        inside = d.join(F.broadcast(edge), "source").where(F.expr(f"shiftright(_h, {HASH_BITS} - bits) = bucket"))  # edge: at most one row a target
        fine = F.expr(f"shiftright(_h, {HASH_BITS} - least(bits + {BITS}, {HASH_BITS}))")
        sums: dict[str, list] = {}
        for s, b, size, n in inside.groupBy("source", fine.alias("b")).agg(F.sum("size"), F.count("*")).collect():
            sums.setdefault(s, []).append((b, size, n))
        for s, (bits, _, left) in list(at.items()):
            depth = min(bits + BITS, HASH_BITS)
            del at[s]
            for b, size, n in sorted(sums.get(s, [])):
                if size > left:
                    if n == 1 or depth == HASH_BITS:  # one document is left to decide
                        limit[s] = (b + (size - left < left)) << (HASH_BITS - depth)
                    else:
                        limit[s] = b << (HASH_BITS - depth)
                        at[s] = (depth, b, left)
                    break
                left -= size
                limit[s] = (b + 1) << (HASH_BITS - depth)
    rows = [(s, whole[s], limit[s]) for s in have]
    cutoff = spark.createDataFrame(rows, "source string, _whole int, _limit bigint")
    chosen = (
        d.join(F.broadcast(cutoff), "source")  # at most one row a target
        .withColumn("repeats", F.col("_whole") + (F.col("_h") < F.col("_limit")).cast("int"))
        .where("repeats > 0")
        .select("doc_id", "source", "size", "repeats")
    )
    taken = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"))
    avail = spark.createDataFrame([(s, n) for s, n in have.items()], "source string, available bigint")
    report = named.join(avail, "source", "left").join(taken, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("taken", F.lit(0)).alias("taken"))
    all_taken = report.agg(F.sum("taken").alias("_t"))
    report = report.crossJoin(all_taken).withColumn("reached_share", F.when(F.col("_t") > 0, F.col("taken") / F.col("_t")).otherwise(0.0)).drop("_t")  # one row beside the targets
    return chosen, report


