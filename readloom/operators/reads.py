"""Record-wise operators on alignments: filter, split, cap, mark of pairs, on-target and family statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import aligned_fraction, unclipped_start
from readloom.functions.flags import NOT_PRIMARY, QCFAIL, READ2, REVERSE, any_of, gate
from readloom.functions.seq import ambiguous_fraction
from readloom.operators.intervals import overlap_flag, overlaps, pad_regions


def _filter_condition(min_fm, min_mapq, skip_flags, require_flags, min_aligned_fraction, single_end) -> Column:
    ok = gate(skip=skip_flags, require=require_flags, min_mapq=min_mapq, min_fm=min_fm)
    if min_aligned_fraction > 0:
        own = aligned_fraction(F.col("cigar")) >= min_aligned_fraction
        ok = ok & (own if single_end else (F.col("mf").isNull() | (F.col("mf") >= min_aligned_fraction) | own))
    return F.coalesce(ok, F.lit(False))


def filter_reads(aln: DataFrame, *, min_fm: int = 0, min_mapq: int = 0, skip_flags: int = 0, require_flags: int = 0, min_aligned_fraction: float = 0.0, regions: DataFrame | None = None, padding: int = 0, invert: bool = False, single_end: bool = False) -> DataFrame:
    """Alignments that pass all conditions; with ``invert`` all the others. A condition on a null value fails (an absent fm counts 1)."""
    ok = _filter_condition(min_fm, min_mapq, skip_flags, require_flags, min_aligned_fraction, single_end)
    if regions is None:
        return aln.where(~ok if invert else ok)
    r = pad_regions(regions, padding)
    if not invert:
        return overlaps(aln.where(ok), r)
    return overlap_flag(aln, r, "_hit").where(~(ok & F.col("_hit"))).drop("_hit")


def flag_passing(aln: DataFrame, name: str = "passed", *, min_fm: int = 0, min_mapq: int = 0, skip_flags: int = 0, require_flags: int = 0, min_aligned_fraction: float = 0.0, regions: DataFrame | None = None, padding: int = 0, single_end: bool = False) -> DataFrame:
    """All alignments with a boolean column: does :func:`filter_reads` pass it? One pass over the input."""
    ok = _filter_condition(min_fm, min_mapq, skip_flags, require_flags, min_aligned_fraction, single_end)
    if regions is None:
        return aln.withColumn(name, ok)
    return overlap_flag(aln, pad_regions(regions, padding), "_hit").withColumn(name, ok & F.col("_hit")).drop("_hit")


def split_reads(aln: DataFrame, **conditions) -> tuple[DataFrame, DataFrame]:
    """(passing, refused); together they are the input. To write both, :func:`flag_passing` and ``write_split`` take one pass."""
    return filter_reads(aln, **conditions), filter_reads(aln, **conditions, invert=True)


def cap_qualities(aln: DataFrame, *, min_pv: int = 0, min_fraction: float = 0.0, min_fm: int = 0, cap: int = 93, keep_failing: bool = False) -> DataFrame:
    """Set qualities to ``cap`` where pv and agreeing fraction suffice, else to 2 (or leave them with ``keep_failing``).

    ``aln``: flag, qual, fm, fa, pv. Families below ``min_fm`` are dropped. fa and pv are in sequencing order, qual in reference order.
    """
    if cap > 93:
        raise ValueError("a quality can't exceed 93")
    if not (min_pv or min_fraction or min_fm):
        raise ValueError("name at least one threshold")
    turn = lambda c: F.when(any_of(F.col("flag"), REVERSE), F.reverse(F.col(c))).otherwise(F.col(c))
    cell = F.arrays_zip(turn("pv").alias("pv"), turn("fa").alias("fa"), F.split("qual", "").alias("q"))
    good = lambda x: (x["pv"] >= min_pv) & (x["fa"] / F.col("fm") >= min_fraction)
    new = F.transform(cell, lambda x: F.when(good(x), F.lit(chr(cap + 33))).otherwise(x["q"] if keep_failing else F.lit("#")))
    return aln.where(F.coalesce("fm", F.lit(1)) >= min_fm).withColumn("qual", F.array_join(new, ""))


def mark_pairs(aln: DataFrame, *, drop_qcfail: bool = False, min_insert: int = 0, min_unambiguous: float = 0.0, add_aligned_fraction: bool = False, single_end: bool = False) -> DataFrame:
    """Tags of the mate on each of a pair: su, mu (unclipped starts), lm (mate's length), mate_sa; QC fail from fp.

    ``aln``: qname, flag, pos, isize, seq, cigar, sa, fp. Mates are the two primary records of a name (first and second
    of the pair); they meet by an equi-join. A name without its mate gets null mate tags. Either mate's fp 0 marks both.
    """
    rev = any_of(F.col("flag"), REVERSE)
    base = aln.withColumn("su", unclipped_start(F.col("pos"), F.col("cigar"), rev)).withColumn("_frac", 1 - ambiguous_fraction(F.col("seq")))
    if single_end:
        out = base.withColumn("_fp0", F.col("fp") == 0).withColumn("_best", F.col("_frac"))
    else:
        prim = base.where(~any_of(F.col("flag"), NOT_PRIMARY))
        side = F.when(any_of(F.col("flag"), READ2), 2).otherwise(1)
        mate = prim.select(F.col("qname").alias("_q"), (3 - side).alias("_side"), F.col("su").alias("mu"), F.length("seq").alias("lm"), F.col("sa").alias("mate_sa"), F.col("fp").alias("_mfp"), F.col("_frac").alias("_mfrac"), aligned_fraction(F.col("cigar")).alias("mf"))
        out = base.withColumn("_s", side).join(mate, (F.col("qname") == F.col("_q")) & (F.col("_s") == F.col("_side")), "left").drop("_q", "_s", "_side")
        out = out.withColumn("_fp0", (F.coalesce("fp", F.lit(1)) == 0) | (F.coalesce("_mfp", F.lit(1)) == 0)).withColumn("_best", F.greatest("_frac", "_mfrac")).drop("_mfp", "_mfrac")
        if not add_aligned_fraction:
            out = out.drop("mf")
    out = out.withColumn("flag", F.when(F.col("_fp0"), F.col("flag").bitwiseOR(QCFAIL)).otherwise(F.col("flag")))
    if min_insert:
        out = out.where(F.abs("isize") >= min_insert)
    if min_unambiguous:
        out = out.where(F.col("_best") >= min_unambiguous)
    if drop_qcfail:
        out = out.where(~any_of(F.col("flag"), QCFAIL))
    return out.drop("_frac", "_fp0", "_best")


def target_rate(aln: DataFrame, regions: DataFrame, *, padding: int = 0, min_mapq: int = 0) -> DataFrame:
    """One row: reads, raw reads (by family size) and families above 1, each with those on target, skipped, and fractions.

    ``aln``: flag, mapq, contig, pos, endpos, fm. Whether a read is on target is one existence join; all counts are then
    one aggregate.
    """
    skip = any_of(F.col("flag"), 3844) | (F.coalesce("mapq", F.lit(0)) < min_mapq)
    fm = F.coalesce("fm", F.lit(1))
    both = overlap_flag(aln.select("contig", "pos", "endpos", fm.alias("fm"), skip.alias("skip")), pad_regions(regions, padding), "hit")
    use, on = ~F.col("skip"), ~F.col("skip") & F.col("hit")
    n = lambda c: F.count(F.when(c, 1))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("fm"))), F.lit(0)).cast("bigint")
    big = F.col("fm") > 1
    j = both.agg(n(use).alias("n_reads"), n(on).alias("n_target"), s(use).alias("raw_reads"), s(on).alias("raw_target"), n(use & big).alias("n_real"), n(on & big).alias("real_target"), n(F.col("skip")).alias("n_skipped"))
    frac = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).alias(f"{a}_fraction")
    return j.select("*", frac("n_target", "n_reads"), frac("raw_target", "raw_reads"), frac("real_target", "n_real"))


def family_reason(min_mapq: int, min_fm: int, skip_fp_fail: bool) -> Column:
    """Why a record isn't counted as a family, in the order of the tests; 'pass' otherwise, null for second mates."""
    return (
        F.when(any_of(F.col("flag"), READ2), F.lit(None)).when(any_of(F.col("flag"), NOT_PRIMARY), "flag").when(F.col("mapq") < min_mapq, "mapq")
        .when(F.coalesce("fm", F.lit(0)) < min_fm, "fm").when((F.coalesce("fp", F.lit(0)) == 0) & F.lit(skip_fp_fail), "fp").otherwise("pass")
    )


def famstats(aln: DataFrame, *, min_mapq: int = 0, min_fm: int = 0, skip_fp_fail: bool = False) -> DataFrame:
    """One row of family statistics over the first mates: passes and failures by reason, sums, means, duplex fractions."""
    r = aln.withColumn("_r", family_reason(min_mapq, min_fm, skip_fp_fail)).where("_r is not null")
    ok, fm, rv = F.col("_r") == "pass", F.col("fm"), F.greatest(F.coalesce("rv", F.lit(0)), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    s = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("bigint")
    dup = ok & (F.coalesce("dr", F.lit(0)) != 0)
    fp0 = (F.coalesce("fp", F.lit(0)) == 0) & F.col("_r").isin("pass", "fp")
    a = r.agg(
        n(ok).alias("n_pass"), n(F.col("_r") == "flag").alias("n_flag_fail"), n(F.col("_r") == "mapq").alias("n_mapq_fail"), n(F.col("_r") == "fm").alias("n_fm_fail"), n(fp0).alias("n_fp_fail"),
        s(ok, fm).alias("fm_sum"), s(ok & (fm > 1), fm).alias("real_fm_sum"), s(ok, rv).alias("rv_sum"), s(ok & (fm > 1), rv).alias("real_rv_sum"), n(ok & (fm > 1)).alias("n_real"),
        n(dup).alias("n_duplex"), s(dup, fm).alias("duplex_fm"), s(dup, rv).alias("duplex_rv"), F.sum(F.when(dup, rv / fm)).alias("_frac"),
    )
    d = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    return a.select(
        *[c for c in a.columns if c != "_frac"], d("rv_sum", "fm_sum").alias("rv_fraction"), d("fm_sum", "n_pass").alias("mean_fm"), d("real_fm_sum", "n_real").alias("mean_real_fm"),
        d("n_duplex", "n_pass").alias("duplex_fraction"), d("duplex_fm", "fm_sum").alias("duplex_raw_fraction"), d("_frac", "n_duplex").alias("mean_duplex_rv"), d("duplex_rv", "duplex_fm").alias("pooled_duplex_rv"),
    )


def family_histograms(aln: DataFrame, **conditions) -> DataFrame:
    """kind ('fm', 'rv', 'np'), value, n_families; one pass over the passing first mates by grouping sets."""
    r = aln.withColumn("_r", family_reason(conditions.get("min_mapq", 0), conditions.get("min_fm", 0), conditions.get("skip_fp_fail", False))).where("_r = 'pass'")
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("int").alias("value")) for k, v in (("fm", F.col("fm")), ("rv", F.coalesce("rv", F.lit(-1))), ("np", F.when(F.col("np") > 0, F.col("np"))))])).alias("_x")
    return r.select(one).select("_x.*").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n_families"))


def family_fraction(aln: DataFrame, min_fm: int) -> DataFrame:
    """Share of raw reads in families of ``min_fm`` reads or more (first mates, primary, fp not 0)."""
    r = aln.where(~any_of(F.col("flag"), NOT_PRIMARY | READ2) & (F.coalesce("fp", F.lit(1)) != 0))
    return r.agg(F.sum(F.when(F.col("fm") >= min_fm, F.col("fm")).otherwise(0)).cast("bigint").alias("fm_above"), F.sum("fm").cast("bigint").alias("fm_total")).withColumn("fraction", F.col("fm_above") / F.col("fm_total"))


def family_sum(aln: DataFrame, by: list[str]) -> DataFrame:
    """Sum of family sizes (raw reads) and of reversed reads over primary first mates, by file or any key."""
    r = aln.where(~any_of(F.col("flag"), NOT_PRIMARY | READ2))
    return r.groupBy(*by).agg(F.sum("fm").cast("bigint").alias("fm_sum"), F.sum("rv").cast("bigint").alias("rv_sum"))


def primary_count(aln: DataFrame) -> DataFrame:
    """Number of primary records."""
    return aln.where(~any_of(F.col("flag"), NOT_PRIMARY)).agg(F.count("*").alias("n_primary"))


