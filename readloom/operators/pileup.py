"""Pile-ups of unique observations, allele counts, tumor/normal comparison and vetting of variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import aligned_bases, aligned_fraction, aligned_length, reference_length
from readloom.functions.flags import PROPER, REVERSE, any_of
from readloom.functions.phred import fisher_pv
from readloom.operators.errors import PIECE, reference_pieces
from readloom.operators.intervals import overlap_flag, overlaps, pad_regions


@dataclass(frozen=True)
class Thresholds:
    """What an observation and an allele must reach; the defaults let everything through but one count."""

    min_fm: int = 0
    min_pv: int = 0
    min_fa: int = 0
    min_fraction: float = 0.0
    md_threshold: int = 0
    min_mapq: int = 0
    min_count: int = 1
    min_duplex: int = 0
    min_overlap: int = 0


def _gates(skip_flags: int, skip_improper: bool, min_aligned_fraction: float) -> dict[str, Column]:
    """Failing gates of an alignment, in the order of the tests."""
    out = {"flag": any_of(F.col("flag"), skip_flags)} if skip_flags else {}
    if skip_improper:
        out["improper"] = ~any_of(F.col("flag"), PROPER)
    if min_aligned_fraction > 0:
        out["aligned_fraction"] = F.coalesce(aligned_fraction(F.col("cigar")) < min_aligned_fraction, F.lit(True))
    return out


def gate_counts(aln: DataFrame, *, skip_flags: int = 0, skip_improper: bool = False, min_aligned_fraction: float = 0.0) -> DataFrame:
    """reason, n_reads, n_bases: how many alignments and aligned letters each gate of :func:`observations` refuses ('pass': none).

    Tests are exclusive, the first that fails counts. Deleted and skipped positions of passing alignments are counted as 'deletion' (n_bases).
    """
    reason = F.lit("pass")
    for name, bad in reversed(_gates(skip_flags, skip_improper, min_aligned_fraction).items()):
        reason = F.when(bad, name).otherwise(reason)
    r = aln.select(reason.alias("reason"), reference_length(F.col("cigar")).alias("_r"), aligned_length(F.col("cigar")).alias("_a"))
    g = r.groupBy("reason").agg(F.count("*").alias("n_reads"), F.sum("_a").cast("bigint").alias("n_bases"), F.sum(F.col("_r") - F.col("_a")).cast("bigint").alias("_d"))
    each = F.when(F.col("reason") == "pass", F.array(F.struct("reason", "n_reads", "n_bases"), F.struct(F.lit("deletion").alias("reason"), "n_reads", F.col("_d").alias("n_bases")))).otherwise(F.array(F.struct("reason", "n_reads", "n_bases")))
    return g.select(F.explode(each).alias("_x")).select("_x.*").where("reason <> 'deletion' or n_bases > 0")


def observations(aln: DataFrame, *, skip_flags: int = 0, skip_improper: bool = False, min_aligned_fraction: float = 0.0, regions: DataFrame | None = None, padding: int = 0, loci: DataFrame | None = None, sample: str | None = None) -> DataFrame:
    """One row per name and position: [sample,] contig, ref_pos, qname, base, pv, fa, fm, dr, rv, mapq, is_rev, overlap.

    ``aln``: qname, flag, contig, pos, endpos, cigar, seq, qual, mapq, fm, dr, rv, fa, pv. Records of a name that cover one
    position become one observation: those with a letter agree (fa summed, pv combined; N members don't count), or differ
    (N, fa 0, pv 0), or are all N (N, fa and pv as if they agreed); fm and rv are summed over all, mapq and ``md`` (:func:`mismatch_density`, where present) are the greatest, strand and
    dr those of the least flag, overlap is 1. Any number of records may meet.

    Only positions of ``regions`` and of ``loci`` (contig, ref_pos) are built: alignments meet these before their letters are
    taken apart. ``sample``: a column that is carried along; names of different samples don't meet.

    Only alignments that overlap another of their name are brought together letter by letter; that is found on whole
    alignments, laid out by name, and the letters are aggregated in that same layout. The letters of all others never move.
    """
    gate = F.lit(True)
    for bad in _gates(skip_flags, skip_improper, min_aligned_fraction).values():
        gate = gate & ~bad
    a = aln.where(gate)
    inside = None
    if regions is not None:
        inside = pad_regions(regions, padding).select("contig", "start_pos", "end_pos")
        a = overlaps(a, inside)
    if loci is not None:
        points = loci.select("contig", "ref_pos").distinct()
        a = overlaps(a, points.select("contig", F.col("ref_pos").alias("start_pos"), (F.col("ref_pos") + 1).alias("end_pos")))
    md = ["md"] if "md" in aln.columns else []
    own = [*([sample] if sample else []), "contig", "qname"]
    keep = [*own, "flag", "fm", "dr", "rv", "mapq", *md]
    n = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: alignments become many rows here
    by = Window.partitionBy(*own).orderBy("pos", "endpos")
    laid = a.select(*keep, "pos", "endpos", "cigar", "seq", "qual", "fa", "pv").repartition(n, *own)
    laid = laid.withColumn("_met", F.coalesce(F.max("endpos").over(by.rowsBetween(Window.unboundedPreceding, -1)) > F.col("pos"), F.lit(False)) | F.coalesce(F.lead("pos").over(by) < F.col("endpos"), F.lit(False)))
    b = aligned_bases(laid, [*keep, "_met"], reverse=any_of(F.col("flag"), REVERSE), arrays=["fa", "pv"])
    if loci is not None:
        b = b.join(points, ["contig", "ref_pos"], "left_semi")
    dr, rv = F.coalesce("dr", F.lit(0)), F.coalesce("rv", F.lit(0))
    code = F.instr(F.lit("ACGTN"), F.col("base"))  # numbers only, so that the aggregate hashes
    b = b.select(*own, "ref_pos", "_met", F.when(code > 0, code).otherwise(5).alias("code"), F.coalesce("pv_at", F.lit(0)).alias("pv"), F.coalesce("fa_at", F.lit(0)).alias("fa"), "fm", dr.alias("dr"), rv.alias("rv"), "mapq", "flag", *md)
    if inside is not None:
        b = overlaps(b.withColumn("_e", F.col("ref_pos") + 1), inside, start="ref_pos", end="_e").drop("_e")
    rev = lambda c: any_of(c, REVERSE)
    letter = lambda c: F.substring(F.lit("ACGTN"), c, F.lit(1))
    lone = b.where(~F.col("_met")).select(*own, "ref_pos", letter(F.col("code")).alias("base"), "pv", "fa", "fm", "dr", "rv", "mapq", rev(F.col("flag")).alias("is_rev"), F.lit(0).alias("overlap"), *md)
    seen = lambda c: F.when(F.col("code") < 5, F.col(c))
    g = b.where("_met").groupBy(*own, "ref_pos").agg(
        F.count("*").alias("n"), F.count(seen("code")).cast("int").alias("k"), F.min(seen("code")).alias("lo"), F.max(seen("code")).alias("hi"), F.sum(seen("pv")).alias("ps"), F.max(seen("pv")).alias("p1"), F.sum(seen("fa")).cast("int").alias("fs"),
        F.sum("fm").cast("int").alias("fm"), F.sum("rv").cast("int").alias("rv"), F.max("mapq").alias("mapq"), F.min(F.col("flag") * 2 + F.col("dr")).alias("_f"), F.sum("pv").alias("pn"), F.sum("fa").cast("int").alias("fn"), *[F.max(c).alias(c) for c in md],
    )
    one, agree, dark = F.col("n") == 1, F.col("lo") == F.col("hi"), F.col("k") == 0
    met = g.select(
        *own, "ref_pos", F.when(agree, letter(F.col("lo"))).otherwise("N").alias("base"),
        F.when(one, F.col("pn")).when(F.col("k") == 1, F.col("p1")).when(dark | agree, fisher_pv(F.when(dark, F.col("n")).otherwise(F.col("k")), F.when(dark, F.col("pn")).otherwise(F.col("ps")))).otherwise(0).cast("int").alias("pv"),
        F.when(one | dark, F.col("fn")).when(agree, F.col("fs")).otherwise(0).alias("fa"), "fm", (F.col("_f") % 2).cast("int").alias("dr"), "rv", "mapq", rev(F.floor(F.col("_f") / 2).cast("int")).alias("is_rev"), (~one).cast("int").alias("overlap"), *md,
    )
    return lone.unionByName(met)


def _flags(t: Thresholds) -> dict[str, Column]:
    """Failing thresholds of an observation; not exclusive."""
    f = {
        "fm": F.col("fm") < t.min_fm, "pv": F.col("pv") < t.min_pv, "fa": F.col("fa") < t.min_fa,
        "fr": F.col("fa") / F.col("fm") < t.min_fraction, "mq": F.col("mapq") < t.min_mapq,
    }
    if t.md_threshold:
        f["md"] = F.col("md") >= t.md_threshold
    return f


def allele_counts(obs: DataFrame, ref: DataFrame | None, t: Thresholds = Thresholds(), keys: list[str] = ("contig", "ref_pos"), *, seen_only: bool = True) -> DataFrame:
    """Per position and letter (N left out, counted as ambig): counts, failures by reason, duplex, overlap, qss, pass, quantity, fractions.

    With ``ref`` (contig, seq or pieces) also is_ref and allele_order (the reference's letter first, then by letter).
    n_clash: overlaps (of the row of N: those that were masked). ``seen_only`` False keeps the rows of N.

    ``quantity``: confident observations plus what is left of the suspects' expected true calls after the errors expected from the
    other letters. Sums over the position are windows over its few letters.
    """
    keys = list(keys)
    bad = _flags(t)
    fail = F.lit(False)
    for c in bad.values():
        fail = fail | F.coalesce(c, F.lit(False))
    o = obs.withColumn("_f", fail).withColumn("_p", F.pow(F.lit(10.0), F.col("pv") * -0.1))
    n = lambda c: F.count(F.when(c, 1))
    s = lambda c: F.coalesce(F.sum(F.when(~F.col("_f"), F.col(c))), F.lit(0)).cast("bigint")
    g = o.groupBy(*keys, "base").agg(
        F.count("*").alias("n_obs"), n(F.col("_f")).alias("n_failed"), n(~F.col("_f")).alias("n_pass"), *[n(F.coalesce(c, F.lit(False))).alias(f"{k}_failed") for k, c in bad.items()],
        s("dr").alias("n_duplex"), s("overlap").alias("n_overlap"), F.coalesce(F.sum(F.when(~F.col("_f"), F.col("is_rev").cast("int"))), F.lit(0)).cast("bigint").alias("n_reverse"),
        F.sum("overlap").cast("bigint").alias("n_clash"), s("pv").alias("qss"), F.sum(F.when(F.col("_f"), 1 - F.col("_p")).otherwise(0.0)).alias("_true"), F.sum("_p").alias("_err"),
    )
    at = Window.partitionBy(*keys)  # at most five letters
    seen = F.col("base") != "N"
    g = g.withColumn("ambig", F.coalesce(F.sum(F.when(~seen, F.col("n_obs"))).over(at), F.lit(0))).withColumn("depth", F.sum(F.when(seen, F.col("n_obs")).otherwise(0)).over(at)).withColumn("_all", F.sum(F.when(seen, F.col("_err")).otherwise(0.0)).over(at))
    g = g.where(seen) if seen_only else g
    suspects = F.floor(F.col("_true") + 0.5)
    wrong = F.floor((F.col("_all") - F.col("_err")) / 3 + 0.5)
    g = g.withColumn("pass", (F.col("n_duplex") >= t.min_duplex) & (F.col("n_pass") >= t.min_count) & (F.col("n_overlap") >= t.min_overlap))
    g = g.withColumn("quantity", (F.col("n_pass") + F.greatest(F.lit(0), suspects - wrong)).cast("bigint")).withColumn("allele_fraction", F.col("n_obs") / F.col("depth")).withColumn("reverse_fraction", F.when(F.col("n_pass") > 0, F.col("n_reverse") / F.col("n_pass")))
    g = g.drop("_true", "_err", "_all")
    if ref is not None:  # letters of the reference by piece, never a whole contig beside a row; reference first, then by letter
        g = g.withColumn("piece", F.floor(F.col("ref_pos") / PIECE).cast("int")).join(reference_pieces(ref), ["contig", "piece"], "left")
        g = g.withColumn("is_ref", F.coalesce(F.col("base") == F.substring("letters", F.col("ref_pos") - F.col("piece") * PIECE + 1, F.lit(1)), F.lit(False))).drop("letters", "piece")
        g = g.withColumn("allele_order", F.row_number().over(at.orderBy(F.desc("is_ref"), "base")) - 1)
    return g


def somatic_calls(tumor: DataFrame, normal: DataFrame) -> DataFrame:
    """Alleles that pass in the tumor and not in the normal, at positions that both samples cover."""
    side = lambda d, name: d.withColumn("_side", F.lit(name))
    return somatic_samples(side(tumor, "t").unionByName(side(normal, "n")), "_side", "t", "n").drop("_side")


def somatic_samples(calls: DataFrame, sample: str, tumor: str, normal: str) -> DataFrame:
    """:func:`somatic_calls` of two samples in one table of :func:`allele_counts` with the sample among its keys.

    One pass: the few letters of a position stand in one window, in which each tumor allele finds the normal's. Columns
    normal_pass, normal_obs and somatic are added to the tumor's rows.
    """
    at, same = Window.partitionBy("contig", "ref_pos"), Window.partitionBy("contig", "ref_pos", "base")
    n = F.col(sample) == normal
    c = calls.where(F.col(sample).isin(tumor, normal)).withColumn("_covered", F.max(n.cast("int")).over(at))
    c = c.withColumn("normal_pass", F.coalesce(F.max(F.when(n, F.col("pass"))).over(same), F.lit(False))).withColumn("normal_obs", F.coalesce(F.max(F.when(n, F.col("n_obs"))).over(same), F.lit(0)))
    return c.where((F.col(sample) == tumor) & (F.col("_covered") == 1)).withColumn("somatic", F.col("pass") & ~F.col("normal_pass")).drop("_covered")


def vet_variants(variants: DataFrame, obs: DataFrame, t: Thresholds = Thresholds(), *, regions: DataFrame | None = None, padding: int = 0, vet_all: bool = False) -> DataFrame:
    """Check the alleles of known single-letter variants: variant_id, allele, allele_index, n_obs, n_pass, n_failed, n_duplex, n_overlap, depth_duplex, disc_overlap, quantity, qss, vet_pass.

    ``variants``: variant_id, contig, pos, alleles. Records with a longer allele and those outside the regions (unless
    ``vet_all``) have null counts: they are passed on as they are. '<*>' is skipped. A variant without a pile-up has null counts.
    ``obs`` best holds only the variants' positions (``observations(..., loci=variant_loci(variants))``); it is read once,
    and what meets the variants is one row a position. depth_duplex: duplex observations of the position; disc_overlap:
    overlaps that come out N.
    """
    snv = F.forall("alleles", lambda a: (F.length(a) == 1) | (a == "<*>"))
    v = variants.withColumn("_snv", snv)
    if regions is not None and not vet_all:
        v = overlap_flag(v.withColumn("_e", F.col("pos") + 1), pad_regions(regions, padding), "_in", end="_e").withColumn("_snv", F.col("_snv") & F.col("_in")).drop("_e", "_in")
    e = v.select("variant_id", "contig", F.col("pos").alias("ref_pos"), "_snv", F.posexplode("alleles").alias("allele_index", "allele")).where("allele <> '<*>'")
    fields = ["n_obs", "n_pass", "n_failed", "n_duplex", "n_overlap", "quantity", "qss", "pass"]
    c = allele_counts(obs, None, t, seen_only=False)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    at = c.groupBy("contig", "ref_pos").agg(F.collect_list(F.struct(F.col("base").alias("b"), *fields)).alias("_a"), total("n_duplex").alias("_d"), total(F.when(F.col("base") == "N", F.col("n_clash"))).alias("_o"))  # at most five letters
    j = e.join(at.where(F.exists("_a", lambda x: x["b"] != "N")), ["contig", "ref_pos"], "left").withColumn("_x", F.get(F.filter("_a", lambda x: x["b"] == F.col("allele")), F.lit(0)))
    use = F.col("_snv") & F.col("_a").isNotNull()
    z = lambda n, v=None: F.when(use, F.coalesce(F.col(v or f"_x.{n}"), F.lit(0))).alias(n)
    return j.select("variant_id", "contig", "ref_pos", "allele", "allele_index", *[z(n) for n in fields[:5]], z("depth_duplex", "_d"), z("disc_overlap", "_o"), z("quantity"), z("qss"), F.when(use, F.coalesce("_x.pass", F.lit(False))).alias("vet_pass"))


def variant_loci(variants: DataFrame) -> DataFrame:
    """Positions of single-letter variants: contig, ref_pos."""
    snv = F.forall("alleles", lambda a: (F.length(a) == 1) | (a == "<*>"))
    return variants.where(snv).select("contig", F.col("pos").alias("ref_pos")).distinct()


def vet_records(vetted: DataFrame) -> DataFrame:
    """One row a variant with arrays per allele in order (a variant has few alleles)."""
    cells = F.array_sort(F.collect_list(F.struct("allele_index", "allele", "vet_pass", "n_failed", "n_duplex", "n_pass", "n_overlap", "quantity", "qss")))
    g = vetted.groupBy("variant_id", "contig", "ref_pos").agg(cells.alias("_c"), F.max("depth_duplex").alias("depth_duplex"), F.max("disc_overlap").alias("disc_overlap"))
    take = lambda f: F.transform("_c", lambda x: x[f]).alias(f)
    return g.select("variant_id", "contig", "ref_pos", *[take(f) for f in ("allele", "vet_pass", "n_failed", "n_duplex", "n_pass", "n_overlap", "quantity", "qss")], "depth_duplex", "disc_overlap")


def locus_fraction(obs: DataFrame, loci: DataFrame, *, min_fm: int = 0) -> DataFrame:
    """Reference and alternative counts and fraction at loci (contig, ref_pos, ref_base, alt_base)."""
    o = obs.where(F.col("fm") >= min_fm).groupBy("contig", "ref_pos", "base").agg(F.count("*").alias("n")).join(loci, ["contig", "ref_pos"])
    n = lambda c: F.coalesce(F.sum(F.when(F.col("base") == F.col(c), F.col("n"))), F.lit(0))
    g = o.groupBy("contig", "ref_pos").agg(n("ref_base").alias("n_ref"), n("alt_base").alias("n_alt"))
    return g.withColumn("alt_fraction", F.when(F.col("n_ref") + F.col("n_alt") > 0, F.col("n_alt") / (F.col("n_ref") + F.col("n_alt"))))


def mismatch_density(aln: DataFrame, ref: DataFrame, keep: list[str], *, flank: int = 20) -> DataFrame:
    """Mismatches (N left out) of a read against the reference over the window of 2 x flank + 1 letters.

    ``keep``, md. The reference index ignores indels, as the measure is defined; a read begins and ends within two neighbouring pieces of it (32 768 letters at most). Reads no shorter than the window count whole;
    the window around any position of a shorter one covers all its letters, so ``flank`` changes no result.
    """
    a = aln.withColumn("piece", F.floor(F.col("pos") / PIECE).cast("int"))
    j = a.join(reference_pieces(ref), ["contig", "piece"])
    span = F.substring("letters", F.col("pos") - F.col("piece") * PIECE + 1, F.length("seq"))
    bad = F.aggregate(F.zip_with(F.split("seq", ""), F.split(span, ""), lambda x, y: F.when((x != y) & (x != "N") & (y != "N"), 1).otherwise(0)), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return j.select(*keep, bad.alias("md"))


def base_family_sizes(obs: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """Families behind every letter of a position: contig, ref_pos, base, fm, n; of ``loci`` (contig, ref_pos) only, where given."""
    o = obs if loci is None else obs.join(loci.select("contig", "ref_pos").distinct(), ["contig", "ref_pos"], "left_semi")
    return o.groupBy("contig", "ref_pos", "base", "fm").agg(F.count("*").alias("n"))
