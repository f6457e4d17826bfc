"""Collapse of read families to consensus reads with per-base statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.phred import MASK_QUAL, fisher_pv
from readloom.session import cut

#: Families of more reads than this take the road with aggregation before the shuffle; the result is the same.
HOT = 20_000
MIN_AGREED = 0.5


_BASES = "ACGTN"


def _once(reads: DataFrame, family: list[str], hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(reads laid out by family, the keys of families of more than ``hot`` reads or None): one shuffle of whole reads.

    Hot keys are looked for by a count with partial aggregation and written, so that Spark joins them by their measured size.
    """
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: few bytes become many rows here, so partitions mustn't be merged by size
    sizes = reads.groupBy(*family).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(family)])
    if not reads.select(F.lit(1)).limit(hot + 1).count() > hot:
        return reads.repartition(n, *family), None
    big = cut(sizes, "hot")
    if not big.limit(1).count():
        return reads.repartition(n, *family), None
    on = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(family)]
    return reads.join(big, on, "left_anti").repartition(n, *family), reads.join(big, on, "left_semi")


def _bases(reads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, pos, code (0..4 for A C G T N), q: one row a letter with a quality."""
    named = reads.where("length(seq) > 0 and length(qual) > 0").select(*keys, F.upper("seq").alias("seq"), "qual")
    e = named.select(*keys, "seq", "qual", F.explode(F.expr("sequence(1, cast(least(length(seq), length(qual)) as int))")).alias("pos"))
    at = F.instr(F.lit("ACGT"), F.substring("seq", F.col("pos"), F.lit(1)))
    return e.select(*keys, F.col("pos").alias("pos"), F.when(at > 0, at - 1).otherwise(4).alias("code"), (F.ascii(F.substring("qual", F.col("pos"), F.lit(1))) - 33).alias("q"))


def position_stats(reads: DataFrame, family: list[str], *, stranded: bool = False, hot: int = HOT) -> DataFrame:
    """Per family and position the count, sum and greatest of the phreds of every letter, in columns (n, s, m with 0..4 for A C G T N).

    ``stranded``: columns for the forward (f) and the reverse (r) reads apart. Reads need ``strand``, ``seq``, ``qual``.
    Letters other than A, C, G, T count as N. A position needs a letter and a quality: where they differ in length, the
    longer's rest is ignored; null or empty reads give no row.

    Reads are shuffled whole, once, by family, and taken apart after it, so that the shuffle carries reads and not bases; one hash
    aggregate of fixed-width numbers uses that same partitioning. Hot families are taken apart before the shuffle, where
    the partial aggregate shrinks them to a row a position in every task, so no task ever holds one.
    """
    cold, warm = _once(reads, family, hot)
    stats = _stats(cold, family, stranded)
    return stats if warm is None else stats.unionByName(_stats(warm, family, stranded))


def _stats(reads: DataFrame, family: list[str], stranded: bool) -> DataFrame:
    rev = F.col("strand").eqNullSafe("R")
    sides = [("f", ~rev), ("r", rev)] if stranded else [("", F.lit(True))]
    aggs = []
    for side, own in sides:
        for k in range(5):
            here = own & (F.col("code") == k)
            aggs += [F.count(F.when(here, 1)).alias(f"{side}n{k}"), F.coalesce(F.sum(F.when(here, F.col("q"))), F.lit(0)).alias(f"{side}s{k}"), F.max(F.when(here, F.col("q"))).alias(f"{side}m{k}")]
    return _bases(reads, [*family, "strand"]).groupBy(*family, "pos").agg(*aggs)


def _winner(side: str = "") -> Column:
    """The letter of greatest phred sum as a struct (s, k, n, m), the later of A C G T N among equals; null without reads."""
    cell = lambda k: F.when(F.col(f"{side}n{k}") > 0, F.struct(F.col(f"{side}s{k}").alias("s"), F.lit(k).alias("k"), F.col(f"{side}n{k}").alias("n"), F.col(f"{side}m{k}").alias("m")))
    return F.greatest(*[cell(k) for k in range(5)])


def _letter(w: str) -> Column:
    """The letter of a winner; N where every sum is 0."""
    return F.when(F.col(w).isNull(), F.lit(None)).when(F.col(f"{w}.s") > 0, F.substring(F.lit(_BASES), F.col(f"{w}.k") + 1, F.lit(1))).otherwise("N")


def consensus_positions(stats: DataFrame, family: list[str], *, stranded: bool = False, length_basis: str = "forward") -> DataFrame:
    """One row per family and position: base, qual, pv, fa, depth, n_count of the winning letter, the letters of both strands.

    Unstranded: the letter of greatest phred sum; it is kept if its combined p-value is above 2 and more than half of the
    family agrees, else the position is N with pv 2. Stranded: the winners of both strands must agree (sums are
    added), or one is N (the other is taken); otherwise N, pv 0, fa 0. ``length_basis``: which reads the p-value and the
    half are taken over in a duplex family, 'forward' or 'total'.
    """
    total = lambda side: sum((F.col(f"{side}n{k}") for k in range(1, 5)), F.col(f"{side}n0"))
    if not stranded:
        g = stats.select(*family, "pos", total("").alias("depth"), F.col("n4").alias("n_count"), _winner().alias("w"))
        g = g.select(*family, "pos", "depth", "n_count", _letter("w").alias("won"), fisher_pv(F.col("depth").cast("int"), F.col("w.s")).alias("pv"), F.col("w.n").alias("agree"), F.col("w.m").alias("mq"), F.col("depth").alias("basis"), F.lit(False).alias("clash"), F.lit(None).cast("string").alias("fb"), F.lit(None).cast("string").alias("rb"))
    else:
        p = stats.select(*family, "pos", _winner("f").alias("f"), _winner("r").alias("r"), total("f").alias("fd"), total("r").alias("rd"), (F.col("fn4") + F.col("rn4")).alias("n_count"))
        p = p.withColumn("depth", F.col("fd") + F.col("rd")).withColumn("fb", _letter("f")).withColumn("rb", _letter("r"))
        same = F.col("fb") == F.col("rb")
        use_f = F.col("rb").isNull() | (F.col("rb") == "N")
        use_r = F.col("fb").isNull() | (F.col("fb") == "N")
        pick = lambda c, both, none: F.when(same, both).when(use_f, F.col(f"f.{c}")).when(use_r, F.col(f"r.{c}")).otherwise(none)
        basis = F.col("depth") if length_basis == "total" else F.when(F.col("fd") > 0, F.col("fd")).otherwise(F.col("rd"))
        p = p.select(
            *family, "pos", "depth", "n_count", "fb", "rb", F.when(same | use_f, F.col("fb")).when(use_r, F.col("rb")).otherwise("N").alias("won"), pick("s", F.col("f.s") + F.col("r.s"), 0).alias("sum"),
            pick("n", F.col("f.n") + F.col("r.n"), 0).alias("agree"), pick("m", F.greatest("f.m", "r.m"), MASK_QUAL).alias("mq"), basis.alias("basis"), (~(F.coalesce(same, F.lit(False)) | use_f | use_r)).alias("clash"),
        )
        g = p.withColumn("pv", F.when(F.col("clash"), 0).otherwise(fisher_pv(F.col("basis").cast("int"), F.col("sum"))))
    good = (F.col("pv") > 2) & (F.col("agree") / F.col("basis") > MIN_AGREED) & ~F.col("clash")
    base = F.when(good, F.col("won")).otherwise("N")
    return g.select(
        *family, "pos", base.alias("base"), F.when(good | (F.col("won") == "N"), F.col("mq")).otherwise(MASK_QUAL).cast("int").alias("qual"),
        F.when(F.col("clash"), 0).when(good, F.col("pv")).otherwise(MASK_QUAL).alias("pv"), F.col("agree").cast("int").alias("fa"), F.col("depth").cast("int").alias("depth"), F.col("n_count").cast("int").alias("n_count"), "won", "fb", "rb",
    )


def collapse_families(reads: DataFrame, family: list[str], read_id: str, *, stranded: bool = True, length_basis: str = "forward", hot: int = HOT) -> DataFrame:
    """Consensus of every family: ``family``, fm, rv, dr, fp, nf, strand_distance, seq, qual, fa, pv.

    fm reads, rv on the reverse strand, dr 1 with both strands, fp of the first read by id, nf mean differences per read
    (letters neither agreeing nor N, by reads). strand_distance: positions at which the consensus letters of the two strands
    differ (null without both, and unstranded). Reads of null family keys form families of their own key; a read without
    letters counts for fm only. ``reads``: family, read_id, strand, fp, seq, qual; other columns are ignored.
    """
    own = reads.select(*[F.col(c) for c in family], F.col(read_id).alias("_id"), "strand", "fp", "seq", "qual")
    cold, warm = _once(own, family, hot)
    parts = [p for p in (cold, warm) if p is not None]
    meta = [p.groupBy(*family).agg(F.count("*").cast("int").alias("fm"), F.count(F.when(F.col("strand") == "R", 1)).cast("int").alias("rv"), F.min(F.struct("_id", "fp"))["fp"].alias("fp")) for p in parts]
    pos = [consensus_positions(_stats(p, family, stranded), family, stranded=stranded, length_basis=length_basis) for p in parts]
    out = _joined(meta[0], pos[0], family)
    return out if warm is None else out.unionByName(_joined(meta[1], pos[1], family))


def _joined(meta: DataFrame, pos: DataFrame, family: list[str]) -> DataFrame:
    meta = meta.withColumn("dr", ((F.col("rv") > 0) & (F.col("rv") < F.col("fm"))).cast("int"))
    miss = F.col("depth") - F.col("fa") - F.when(F.col("won") != "N", F.col("n_count")).otherwise(0)
    cells = F.array_sort(F.collect_list(F.struct("pos", "base", "qual", "fa", "pv")))  # one cell a position: bounded by the read length
    apart = F.sum(F.when(F.col("fb").isNotNull() & F.col("rb").isNotNull(), (F.col("fb") != F.col("rb")).cast("int")))
    built = pos.groupBy(*family).agg(cells.alias("_c"), F.sum(miss).alias("_miss"), apart.cast("int").alias("strand_distance"))
    take = lambda f: F.transform("_c", lambda x: x[f])
    out = built.select(*family, F.array_join(take("base"), "").alias("seq"), F.array_join(F.transform("_c", lambda x: F.char(x["qual"] + 33)), "").alias("qual"), take("fa").alias("fa"), take("pv").alias("pv"), "_miss", "strand_distance")
    on = [meta[c].eqNullSafe(out[c]) for c in family]
    j = meta.join(out, on, "left")
    return j.select(*[meta[c] for c in family], "fm", "rv", "dr", "fp", (F.coalesce("_miss", F.lit(0)) / F.col("fm")).alias("nf"), "strand_distance", "seq", "qual", "fa", "pv")


def align_lengths(reads: DataFrame, family: list[str], read_id: str) -> DataFrame:
    """Reads of families whose members differ in length (barcodes of variable length), brought to the length of the family's first read by id.

    A longer or shorter read that passes (fp not 0) is left out; one that fails is aligned at its right end: its first
    letters are cut off, or N with quality '#' put before it. Reads without letters are left as they are.
    """
    first = reads.where("length(seq) > 0").groupBy(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(family)]).agg(F.min_by(F.length("seq"), read_id).alias("_len"))
    on = [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(family)]
    j = reads.join(first, on, "left").select(*reads.columns, "_len")
    n, fails = F.length("seq"), F.coalesce(F.col("fp"), F.lit(1)) == 0
    fit = lambda c, pad: F.when(n > F.col("_len"), F.expr(f"right({c}, _len)")).otherwise(F.lpad(F.col(c), F.col("_len"), pad))
    odd = F.coalesce(n != F.col("_len"), F.lit(False)) & (n > 0)
    return j.where(~odd | fails).withColumns({"seq": F.when(odd, fit("seq", "N")).otherwise(F.col("seq")), "qual": F.when(odd, fit("qual", "#")).otherwise(F.col("qual"))}).drop("_len")


def strand_distances(families: DataFrame) -> DataFrame:
    """Histogram of the distance between the strands of duplex families: strand_distance, n_families."""
    return families.where("dr = 1 and strand_distance is not null").groupBy("strand_distance").agg(F.count("*").alias("n_families"))


def family_counters(families: DataFrame) -> DataFrame:
    """One row: duplex families, others, others of more than one read, and the reads of each."""
    n = lambda c: F.count(F.when(c, 1))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("fm"))), F.lit(0)).cast("bigint")
    dup = F.col("dr") == 1
    return families.agg(n(dup).alias("n_duplex"), n(~dup).alias("n_single_strand"), n(~dup & (F.col("fm") > 1)).alias("n_single_strand_real"), s(dup).alias("duplex_reads"), s(F.lit(True)).alias("n_reads"))


def accumulator_consensus(acc: DataFrame, keep: list[str]) -> DataFrame:
    """Consensus positions of stored family accumulators: ``keep``, pos, base, agree, phred_sum, pv, qual.

    ``acc``: fm, readlen, nuc_counts, phred_sums (5 x readlen, order A C G T N), max_phreds. Accumulators that are null or of
    another length give no row.
    """
    n = F.col("readlen") * 5
    ok = acc.where((F.size("nuc_counts") == n) & (F.size("phred_sums") == n) & (F.length("max_phreds") == n) & (F.col("readlen") > 0))
    e = ok.select(*keep, "fm", F.posexplode(F.sequence(F.lit(0), F.col("readlen") - 1)).alias("pos", "_i"), "nuc_counts", "phred_sums", "max_phreds")
    cell = lambda k: F.struct(F.get("phred_sums", F.col("pos") * 5 + k).alias("s"), F.lit(k).alias("k"))
    e = e.withColumn("w", F.array_max(F.array(*[cell(k) for k in range(5)])))
    k = F.when(F.col("w.s") > 0, F.col("w.k")).otherwise(4)
    at = F.col("pos") * 5 + k
    return e.select(*keep, "pos", F.substring(F.lit("ACGTN"), k + 1, F.lit(1)).alias("base"), F.get("nuc_counts", at).alias("agree"), F.col("w.s").alias("phred_sum"), fisher_pv(F.col("fm"), F.col("w.s")).alias("pv"), (F.ascii(F.substring("max_phreds", at + 1, F.lit(1))) - 33).alias("qual"))
