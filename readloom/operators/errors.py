"""Error cubes against a reference, their marginals, quality imputation, and error rates by family size and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import aligned_bases, reference_length
from readloom.functions.flags import DUP, NOT_PRIMARY, PROPER, QCFAIL, READ2, REVERSE, UNMAPPED, any_of, gate
from readloom.functions.phred import to_phred
from readloom.operators.intervals import overlap_join, overlaps, pad_regions

_SKIP = UNMAPPED | NOT_PRIMARY | QCFAIL | DUP


#: Letters of a reference piece; an alignment of no greater span finds all its letters in one piece.
PIECE = 16384


def reference_pieces(ref: DataFrame) -> DataFrame:
    """contig, piece, letters: the letters from piece * PIECE on, 2 * PIECE of them, so that pieces overlap by half.

    ``ref``: contig, seq; or such pieces already (``read_fasta_pieces``), which are left as they are.
    """
    if "letters" in ref.columns:
        return ref.select("contig", "piece", "letters")
    parts = F.posexplode(F.regexp_extract_all(F.upper("seq"), F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))
    p = ref.select("contig", parts.alias("piece", "letters"))
    return p.withColumn("letters", F.concat("letters", F.coalesce(F.lead("letters").over(Window.partitionBy("contig").orderBy("piece")), F.lit(""))))


def _observed(aln: DataFrame, ref: DataFrame, keep: list[str], arrays: list[str] = ()) -> DataFrame:
    """Aligned bases beside the reference letter, N on either side left out: ``keep``, mate, ref_pos, cycle, base, qual, err.

    ``ref``: contig, seq. The reference is cut in pieces; an alignment meets the piece in which it begins by an equi-join, and
    keeps the letters it spans before its bases are exploded. Only the bases of alignments that span more than a piece
    meet their pieces one by one. Spark broadcasts the pieces if their size allows.
    """
    mate = F.when(any_of(F.col("flag"), READ2), 2).otherwise(1)
    pieces = reference_pieces(ref)
    a = aln.withColumn("mate", mate).withColumn("_span", reference_length(F.col("cigar"))).withColumn("_begin", F.col("pos")).withColumn("piece", F.floor(F.col("pos") / PIECE).cast("int"))
    cols = list(dict.fromkeys(["contig", "mate", *keep]))
    rev = any_of(F.col("flag"), REVERSE)
    near = a.where(F.col("_span") <= PIECE).join(pieces, ["contig", "piece"]).withColumn("_ref", F.substring("letters", F.col("pos") - F.col("piece") * PIECE + 1, F.col("_span"))).drop("letters")
    near = aligned_bases(near, [*cols, "_begin", "_ref"], reverse=rev, arrays=list(arrays)).withColumn("_l", F.substring("_ref", F.col("ref_pos") - F.col("_begin") + 1, F.lit(1))).drop("_begin", "_ref")
    far = aligned_bases(a.where(F.col("_span") > PIECE), cols, reverse=rev, arrays=list(arrays)).withColumn("piece", F.floor(F.col("ref_pos") / PIECE).cast("int")).join(pieces, ["contig", "piece"])
    far = far.withColumn("_l", F.substring("letters", F.col("ref_pos") - F.col("piece") * PIECE + 1, F.lit(1))).drop("piece", "letters")
    j = near.unionByName(far)
    j = j.where(F.col("base").isin("A", "C", "G", "T") & F.col("_l").isin("A", "C", "G", "T"))
    return j.withColumn("err", (F.col("base") != F.col("_l")).cast("int")).drop("_l")


def error_cube(aln: DataFrame, ref: DataFrame, *, min_mapq: int = 0, min_pv: int = 0, min_fm: int = 0, max_fm: int | None = None, duplex: bool | None = None, proper_only: bool = False, require_fp: bool = False, contig: str | None = None, regions: DataFrame | None = None, padding: int = 0) -> DataFrame:
    """Observations and errors by mate, base, qual, cycle: mate, base, qual, cycle, obs, err."""
    a = aln.where(gate(skip=_SKIP, require=PROPER if proper_only else 0, min_mapq=min_mapq, min_fm=min_fm, max_fm=max_fm, require_fp=require_fp))
    if duplex is not None:
        both = (F.col("rv") > 0) & (F.col("rv") < F.col("fm"))
        a = a.where(F.coalesce(both, F.lit(False)) == F.lit(duplex))
    if contig is not None:
        a = a.where(F.col("contig") == contig)
    if regions is not None:
        a = overlaps(a, pad_regions(regions, padding))
    o = _observed(a, ref, [], ["pv"] if min_pv else [])
    if min_pv:
        o = o.where(F.col("pv_at") >= min_pv)
    return o.groupBy("mate", "base", "qual", "cycle").agg(F.count("*").alias("obs"), F.sum("err").cast("bigint").alias("err"))


def _rate(err: str, obs: str) -> Column:
    return F.when(F.col(obs) > 0, F.col(err) / F.col(obs))


def cube_marginals(cube: DataFrame) -> DataFrame:
    """kind ('base_cycle', 'cycle', 'global'), mate, base, cycle, obs, err, expected: sums of a cube without masked qualities (2).

    expected is the number of errors that the qualities promise. One pass by grouping sets.
    """
    c = cube.where("qual > 2").withColumn("exp", F.col("obs") * F.pow(F.lit(10.0), F.col("qual") * -0.1))
    g = c.groupingSets([["mate", "base", "cycle"], ["mate", "cycle"], ["mate"]], "mate", "base", "cycle").agg(F.grouping_id().alias("_g"), F.sum("obs").alias("obs"), F.sum("err").alias("err"), F.sum("exp").alias("expected"))
    return g.select(F.when(F.col("_g") == 0, "base_cycle").when(F.col("_g") == 2, "cycle").otherwise("global").alias("kind"), "mate", "base", "cycle", "obs", "err", "expected")


def trim_cycles(cube: DataFrame, *, min_obs: int = 1) -> DataFrame:
    """The cube up to the greatest cycle that has at least ``min_obs`` observations of any base and quality, for both mates alike."""
    top = cube.groupBy("cycle").agg(F.sum("obs").alias("_n")).where(F.col("_n") >= min_obs).agg(F.max("cycle").alias("_top"))
    return cube.crossJoin(top).where(F.col("cycle") <= F.col("_top")).drop("_top")  # one row


#: Rate of a cell without observations in the full table (fixed value of the format).
NO_RATE = -1337.0


def full_rates(cube: DataFrame, *, quals: int = 45) -> DataFrame:
    """Every cell of mate, cycle, base and quality (2 .. 1 + quals): rate, NO_RATE where nothing was observed, and obs.

    The grid is made of the cube's cycles, so it has cycles x 2 x 4 x quals rows.
    """
    grid = cube.select("cycle").distinct()
    for name, items in (("mate", F.sequence(F.lit(1), F.lit(2))), ("base", F.split(F.lit("A,C,G,T"), ",")), ("qual", F.sequence(F.lit(2), F.lit(1 + quals)))):
        grid = grid.select("*", F.explode(items).alias(name))
    j = grid.join(cube, ["mate", "base", "qual", "cycle"], "left")
    return j.select("mate", "base", "qual", "cycle", F.when(F.col("obs") > 0, F.col("err") / F.col("obs")).otherwise(NO_RATE).alias("rate"), F.coalesce("obs", F.lit(0)).alias("obs"))


def quality_offsets(cube: DataFrame, *, min_obs: int = 10000) -> DataFrame:
    """Shift of every (mate, base, cycle): measured phred minus phred of the expected errors, 0 under ``min_obs`` observations."""
    m = cube_marginals(cube).where("kind = 'base_cycle'")
    shift = F.when(F.col("obs") >= min_obs, to_phred(F.col("err") / F.col("obs")) - to_phred(F.col("expected") / F.col("obs"))).otherwise(0)
    return m.select("mate", "base", "cycle", shift.alias("shift"))


def cycle_rates(cube: DataFrame) -> DataFrame:
    """cycle, r1_rate, r2_rate, r1_err, r1_obs, r2_err, r2_obs; a null rate without observations."""
    side = lambda m, c: F.coalesce(F.sum(F.when(F.col("mate") == m, F.col(c))), F.lit(0)).cast("bigint")
    g = cube.where("qual > 2").groupBy("cycle").agg(*[side(m, c).alias(f"r{m}_{c}") for m in (1, 2) for c in ("err", "obs")])
    return g.select("cycle", _rate("r1_err", "r1_obs").alias("r1_rate"), _rate("r2_err", "r2_obs").alias("r2_rate"), "r1_err", "r1_obs", "r2_err", "r2_obs")


def impute_quality(cube: DataFrame, *, min_obs: int = 10000) -> DataFrame:
    """New quality of every cell: mate, cycle, base, qual, new_qual - the table that :func:`rescale_quality` reads.

    The shift of a (mate, base, cycle) is measured phred minus phred of the expected errors, 0 under ``min_obs`` observations;
    the new quality is at least 2; masked cells (2) stay.
    """
    d = quality_offsets(cube, min_obs=min_obs)
    new = F.when(F.col("qual") <= 2, 2).otherwise(F.greatest(F.lit(2), F.col("qual") + F.coalesce("shift", F.lit(0))))
    return cube.join(d, ["mate", "base", "cycle"], "left").select("mate", "cycle", "base", "qual", new.cast("int").alias("new_qual"))


def error_by_family_size(aln: DataFrame, ref: DataFrame, *, min_pv: int = 0, min_fraction: float = 0.0, min_mapq: int = 0, duplex: bool | None = None, require_fp: bool = False) -> DataFrame:
    """fm, r1_rate, r2_rate, r1_err, r1_obs, r2_err, r2_obs over bases with enough pv and agreeing fraction."""
    a = aln.where(gate(skip=UNMAPPED | QCFAIL | DUP | 0x100, min_mapq=min_mapq, require_fp=require_fp, duplex=duplex)).withColumn("fm", F.coalesce("fm", F.lit(0)))
    arrays = [c for c, on in (("pv", min_pv > 0), ("fa", min_fraction > 0)) if on]
    o = _observed(a, ref, ["fm"], arrays)
    if min_pv:
        o = o.where(F.col("pv_at") >= min_pv)
    if min_fraction:
        o = o.where(F.col("fa_at") / F.col("fm") >= min_fraction)
    side = lambda m, v: F.coalesce(F.sum(F.when(F.col("mate") == m, v)), F.lit(0)).cast("bigint")
    g = o.groupBy("fm").agg(*[side(m, v).alias(f"r{m}_{n}") for m in (1, 2) for n, v in (("err", F.col("err")), ("obs", F.lit(1)))])
    return g.select("fm", _rate("r1_err", "r1_obs").alias("r1_rate"), _rate("r2_err", "r2_obs").alias("r2_rate"), "r1_err", "r1_obs", "r2_err", "r2_obs")


def error_by_region(aln: DataFrame, ref: DataFrame, regions: DataFrame, *, min_mapq: int = 0, min_fm: int = 0, require_fp: bool = False, padding: int = 0) -> DataFrame:
    """region_id, errors, obs, pct_error: all bases of every read that overlaps a region count for it.

    Reads are counted first, one row a read, and only these two numbers meet the regions.
    """
    a = aln.where(gate(skip=_SKIP, min_mapq=min_mapq, min_fm=min_fm, require_fp=require_fp))
    per = _observed(a, ref, ["read_id", "start0", "endpos"]) if "start0" in a.columns else _observed(a.withColumn("start0", F.col("pos")), ref, ["read_id", "start0", "endpos"])
    per = per.groupBy("read_id", "contig", "start0", "endpos").agg(F.count("*").alias("obs"), F.sum("err").alias("err"))
    j = overlap_join(per, pad_regions(regions, padding).select("region_id", "contig", "start_pos", "end_pos"), start="start0")
    return j.groupBy("region_id").agg(F.sum("err").cast("bigint").alias("errors"), F.sum("obs").cast("bigint").alias("obs")).withColumn("pct_error", F.when(F.col("obs") > 0, 100.0 * F.col("errors") / F.col("obs")))


def weighted_error_sweep(by_fm: DataFrame, sizes: DataFrame) -> DataFrame:
    """For every m: mean error over family sizes of m or more, weighted by how many families have that size.

    ``by_fm``: fm, rate; ``sizes``: fm, n_families. One row a family size, so the reverse cumulative window is small.
    """
    j = by_fm.join(sizes, "fm").where("rate is not null")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("fm"))
    return j.select("fm", (F.sum(F.col("rate") * F.col("n_families")).over(w) / F.sum("n_families").over(w)).alias("mean_error"))
