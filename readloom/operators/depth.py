"""Coverage: depth per position, region reports, quantiles and cumulative histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.flags import DUP, QCFAIL, SECONDARY, UNMAPPED, gate
from readloom.operators.intervals import overlap_join, pad_regions


def position_depth(aln: DataFrame, regions: DataFrame, *, min_mapq: int = 0, min_fm: int = 0, require_fp: bool = False, padding: int = 0, max_depth: int | None = None, sample: str | None = None) -> DataFrame:
    """Depth at every covered position of the regions: region_id, [sample,] ref_pos, collapsed, raw, singleton.

    ``aln``: contig, pos, endpos, flag, mapq, fm, fp. collapsed counts reads, raw sums family sizes, singleton counts
    families of one read. ``max_depth`` bounds the reads of a position that count (the pile-up's cap), first by start.
    Reads meet regions by bins first and only their overlap is exploded, so positions outside regions never exist.
    """
    used = aln.where(gate(skip=UNMAPPED | SECONDARY | QCFAIL | DUP, min_mapq=min_mapq, min_fm=min_fm, require_fp=require_fp))
    keys = ["region_id", *([sample] if sample else [])]
    hit = overlap_join(used.select("contig", "pos", "endpos", F.coalesce("fm", F.lit(1)).alias("fm"), *([sample] if sample else [])), pad_regions(regions, padding).select("region_id", "contig", "start_pos", "end_pos"))
    e = hit.select(*keys, "fm", "pos", F.explode(F.sequence(F.greatest("pos", "r_start"), F.least("endpos", "r_end") - 1)).alias("ref_pos"))
    if max_depth is not None:
        w = Window.partitionBy(*keys, "ref_pos").orderBy("pos", "fm")
        e = e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_depth)
    return e.groupBy(*keys, "ref_pos").agg(F.count("*").alias("collapsed"), F.sum("fm").cast("bigint").alias("raw"), F.count(F.when(F.col("fm") == 1, 1)).alias("singleton"))


def _lengths(regions: DataFrame, padding: int, sample: str | None, names: list[str] | None) -> DataFrame:
    """region_id, [sample,] region_len: every region, for every sample of ``names``."""
    r = pad_regions(regions, padding).select("region_id", (F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("region_len")).groupBy("region_id").agg(F.sum("region_len").alias("region_len"))
    return r if sample is None else r.withColumn(sample, F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")))


def _samples(aln: DataFrame, sample: str | None) -> list[str] | None:
    """Names of the samples: one a file, so few."""
    return None if sample is None else sorted(r[0] for r in aln.select(sample).where(F.col(sample).isNotNull()).distinct().collect())


def region_depth(aln: DataFrame, regions: DataFrame, *, padding: int = 0, sample: str | None = None, **gates) -> DataFrame:
    """Per region [and sample]: length, total, mean, sample deviation and CV of the three depths, and the share of singletons.

    ``sample``: a column of ``aln`` with the sample of each alignment; every region is then reported for every sample.
    Uncovered positions count with depth 0 by the region's length; they are never made rows.
    """
    keys = ["region_id", *([sample] if sample else [])]
    d = position_depth(aln, regions, padding=padding, sample=sample, **gates)
    kinds = ("collapsed", "raw", "singleton")
    got = d.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(f"{c}_total") for c in kinds], *[F.sum(F.col(c).cast("double") * F.col(c)).alias(f"_{c}") for c in kinds])
    g = _lengths(regions, padding, sample, _samples(aln, sample)).join(got, keys, "left")
    n, out = F.col("region_len"), [*keys, "region_len"]
    for c in kinds:
        total = F.coalesce(f"{c}_total", F.lit(0))
        var = (F.coalesce(f"_{c}", F.lit(0.0)) - total.cast("double") * total / n) / (n - 1)
        out += [total.alias(f"{c}_total"), (total / n).alias(f"{c}_mean"), F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias(f"{c}_stdev")]
    g = g.select(*out)
    for c in kinds:
        g = g.withColumn(f"{c}_cv", F.when(F.col(f"{c}_mean") > 0, F.col(f"{c}_stdev") / F.col(f"{c}_mean")))
    return g.withColumn("pct_singleton", F.when(F.col("collapsed_total") > 0, 100.0 * F.col("singleton_total") / F.col("collapsed_total")))


def depth_quantiles(aln: DataFrame, regions: DataFrame, *, n_quantiles: int = 4, padding: int = 0, sample: str | None = None, **gates) -> DataFrame:
    """Per region [and sample] and i = 1 .. n_quantiles - 1 the collapsed and raw depth at sorted position len * i / n + 1 (0-based, clamped).

    Ranks come from counts of equal depths, so that nothing but (region, depth) pairs is ordered.
    """
    keys = ["region_id", *([sample] if sample else [])]
    d = position_depth(aln, regions, padding=padding, sample=sample, **gates)
    long = d.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("depth")) for c in ("collapsed", "raw")])).alias("_x")).select(*keys, "_x.kind", "_x.depth")
    h = long.groupBy(*keys, "kind", "depth").agg(F.count("*").alias("n"))
    size = _lengths(regions, padding, sample, _samples(aln, sample)).withColumn("kind", F.explode(F.array(F.lit("collapsed"), F.lit("raw"))))
    bare = size.join(h.groupBy(*keys, "kind").agg(F.sum("n").alias("_n")), [*keys, "kind"], "left").select(*keys, "kind", F.lit(0).cast("bigint").alias("depth"), (F.col("region_len") - F.coalesce("_n", F.lit(0))).alias("n")).where("n > 0")
    h = h.select(*keys, "kind", F.col("depth").cast("bigint").alias("depth"), "n").unionByName(bare)
    by = Window.partitionBy(*keys, "kind")
    h = h.withColumn("upto", F.sum("n").over(by.orderBy("depth"))).withColumn("len", F.sum("n").over(by))
    q = h.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n_quantiles - 1)))).withColumn("at", F.least(F.expr(f"len * i div {n_quantiles} + 1"), F.col("len") - 1))
    return q.where("upto > at and upto - n <= at").select(*keys, "kind", F.col("i").cast("int").alias("i"), "depth")


def depth_histogram(aln: DataFrame, regions: DataFrame, *, padding: int = 0, include_zero: bool = False, sample: str | None = None, **gates) -> DataFrame:
    """[sample,] depth, n_bases and pct_bases with at least that depth. Only covered positions count unless ``include_zero``.

    With ``sample`` the depths of all samples are listed for each: one that has no position of just that depth has the
    count of the next greater one, or 0.
    """
    d = position_depth(aln, regions, padding=padding, sample=sample, **gates)
    own = [sample] if sample else []
    h = d.groupBy(*own, F.col("collapsed").alias("depth")).agg(F.count("*").alias("n"))
    names = _samples(aln, sample)
    if include_zero:
        size = _lengths(regions, padding, sample, names).groupBy(*own).agg(F.sum("region_len").alias("_len"))
        seen = h.groupBy(*own).agg(F.sum("n").alias("_n"))
        bare = size.join(seen, own, "left") if own else size.crossJoin(seen)  # one row each
        h = h.unionByName(bare.select(*own, F.lit(0).cast("bigint").alias("depth"), (F.col("_len") - F.coalesce("_n", F.lit(0))).alias("n")).where("n > 0"))
    if sample:
        every = h.select("depth").distinct().withColumn(sample, F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")))
        h = every.join(h, [sample, "depth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # one row a depth: bounded by the greatest depth
    w = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(1))
    h = h.withColumn("n_bases", F.sum("n").over(w.orderBy(F.desc("depth")))).withColumn("_t", F.sum("n").over(w))
    return h.select(*own, "depth", "n_bases", F.when(F.col("_t") > 0, 100.0 * F.col("n_bases") / F.col("_t")).alias("pct_bases"))


def capture_summary(aln: DataFrame, regions: DataFrame, *, padding: int = 0, sample: str | None = None, **gates) -> DataFrame:
    """One row [a sample]: mean depths over all region positions and the share of singletons by raw and by collapsed depth."""
    own = [sample] if sample else []
    r = region_depth(aln, regions, padding=padding, sample=sample, **gates)
    n = F.sum("region_len")
    s = r.groupBy(*own).agg(*[(F.sum(f"{c}_total") / n).alias(f"mean_{c}") for c in ("collapsed", "raw", "singleton")])
    return s.withColumn("pct_singleton_raw", F.when(F.col("mean_raw") > 0, 100.0 * F.col("mean_singleton") / F.col("mean_raw"))).withColumn("pct_singleton_collapsed", F.when(F.col("mean_collapsed") > 0, 100.0 * F.col("mean_singleton") / F.col("mean_collapsed")))


def named_mean_depth(report: DataFrame, regions: DataFrame, prefix: str) -> DataFrame:
    """n_regions and the mean over regions, whose names begin with ``prefix``, of their mean depths (``report`` as :func:`region_depth` gives it)."""
    named = report.join(regions.where(F.col("region_name").startswith(prefix)).select("region_id").distinct(), "region_id", "left_semi")
    return named.agg(F.count("*").alias("n_regions"), *[F.avg(f"{c}_mean").alias(f"mean_{c}") for c in ("collapsed", "raw", "singleton")])
