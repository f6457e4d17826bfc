"""Positional rescue: merging of families whose barcodes nearly agree and that lie at one alignment signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from readloom.functions.flags import MATE_REVERSE, MATE_UNMAPPED, NOT_PRIMARY, READ2, REVERSE, UNMAPPED, any_of
from readloom.functions.phred import fisher_pv
from readloom.functions.seq import hamming, revcomp
from readloom.operators.stacks import merge_stacks, pack_blocks
from readloom.session import cut, drop_cut, ship

#: Rows of a stack that one task holds; larger stacks are merged by joins. Buckets of stacks in which rows are counted to find them.
HOT, BUCKETS = 100_000, 1 << 18


def signature(*, single_end: bool = False, unclipped: bool = False) -> list[Column]:
    """What two reads must share to come from one molecule: position, strand, length, mate, and the same of the mate."""
    at = F.col("su") if unclipped else F.col("pos")
    own = [F.col("contig"), at, any_of(F.col("flag"), REVERSE), F.length("seq")]
    if single_end:
        return own
    mate = F.col("mu") if unclipped else F.col("mate_pos")
    return [*own, any_of(F.col("flag"), READ2), F.col("mate_contig"), mate, any_of(F.col("flag"), MATE_REVERSE), F.col("lm")]


def with_signature(aln: DataFrame, *, single_end: bool = False, unclipped: bool = False) -> tuple[DataFrame, list[str]]:
    """The alignments with their :func:`signature` in columns sig_0, sig_1, ..., and these columns' names."""
    cols = signature(single_end=single_end, unclipped=unclipped)
    names = [f"sig_{i}" for i in range(len(cols))]
    return aln.withColumns(dict(zip(names, cols))), names


def rescue_parents(names: DataFrame, sig: list[str], name: str, *, mismatch_limit: int = 2) -> DataFrame:
    """For each different name of a stack the first greater name within ``mismatch_limit`` letters: sig, name, parent.

    Names of one length only. With t mismatches one of t + 1 pieces is equal, so names meet by an equi-join on (signature,
    piece) and a stack isn't compared pair by pair.
    """
    t = mismatch_limit
    n = names.select(*sig, name).where(F.col(name).isNotNull()).distinct()
    cutp = lambda i: F.floor(F.length(name) * i / (t + 1)).cast("int")
    pieces = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring(name, cutp(i) + 1, cutp(i + 1) - cutp(i)).alias("p")) for i in range(t + 1)]))
    k = n.withColumn("_x", pieces).select(*sig, name, F.length(name).alias("_l"), "_x.i", "_x.p")
    a, b = k.alias("a"), k.select(*sig, F.col(name).alias("_other"), "_l", "i", "p").alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in sig] + [F.col("a._l") == F.col("b._l"), F.col("a.i") == F.col("b.i"), F.col("a.p") == F.col("b.p"), F.col(f"a.{name}") < F.col("b._other")]
    near = a.join(b, on).where(hamming(F.col(f"a.{name}"), F.col("b._other")) <= t)
    return near.groupBy(*[F.col(f"a.{c}").alias(c) for c in sig], F.col(f"a.{name}").alias(name)).agg(F.min("_other").alias("parent"))


def _moves(names: DataFrame, sig: list[str], name: str, mismatch_limit: int) -> DataFrame:
    """_s0, _s1, ..., _n, _p: the names that are merged into others and where each ends up, chains included; a written table.

    A merged record keeps the greater name, so the merges form a forest over the names; its roots are found by doubling
    pointers, each round written to the shared folder. The number of rounds is the logarithm of the longest chain.
    """
    parents = rescue_parents(names, sig, name, mismatch_limit=mismatch_limit)
    ids = [f"_s{i}" for i in range(len(sig))]
    hop = cut(parents.select(*[F.col(c).alias(i) for c, i in zip(sig, ids)], F.col(name).alias("_n"), F.col("parent").alias("_p")), "hops")
    while True:
        a, b = hop.alias("a"), hop.select(*ids, F.col("_n").alias("_p"), F.col("_p").alias("_pp")).alias("b")
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ids] + [F.col("a._p") == F.col("b._p")]
        nxt = cut(a.join(b, on, "left").select(*[F.col(f"a.{c}").alias(c) for c in ids], "a._n", F.coalesce("_pp", "a._p").alias("_p"), F.col("_pp").isNotNull().alias("_moved")), "hops")
        drop_cut(hop)
        hop = nxt
        if not nxt.where("_moved").limit(1).count():
            return hop


def rescue_roots(names: DataFrame, sig: list[str], name: str, *, mismatch_limit: int = 2) -> DataFrame:
    """sig, name, root: where each name ends up when every name is merged into the first greater one nearby."""
    every = names.select(*sig, name).where(F.col(name).isNotNull()).distinct()
    return _rooted(every, _moves(names, sig, name, mismatch_limit), sig, name)


def _rooted(rows: DataFrame, moves: DataFrame, sig: list[str], name: str) -> DataFrame:
    """The rows with the root of their name: its own, unless it is merged into another. Few names are, so the moves are a small side."""
    on = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(sig)] + [F.col(name) == F.col("_n")]
    return rows.join(moves, on, "left").select(*rows.columns, F.coalesce("_p", F.col(name)).alias("root"))


def rescue(aln: DataFrame, sig: list[str], *, name: str = "barcode", read_id: str = "read_id", mismatch_limit: int = 2, trust_unmasked: bool = False, infer: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merge nearly equal families of a stack: (records, their bases).

    ``aln``: ``sig`` (see :func:`with_signature`), ``name``, ``read_id``, flag, fm, rv, np, nc, seq, qual, fa, pv and any
    other columns. Secondary and supplementary records are left out; unmapped ones (or with an unmapped mate) and records
    without a name stay by themselves. Records: all columns of ``aln``, root and n_merged; of a merged record every column is
    that of the member with the greatest name (then id), but fm and rv are summed, np counts the records before
    (1 where absent), nc sums the letters changed and is null for what wasn't merged, dr is 1 where 0 < rv < fm, and
    seq, qual, fa, pv are built anew.

    A position whose members agree keeps its letter with fa summed, pv combined by Fisher's method over all members and
    the greatest quality; below pv 3, or where members differ, it is N with fa 0, pv 0 and quality 2.
    ``trust_unmasked``: N members don't count against a letter, and nc counts the positions they gain. ``infer``: no barcodes;
    all records of a stack merge, absent tags are fm 1, fp 1, fa 1 and pv the quality.

    fa and pv lie in sequencing order, seq and qual in reference order; members share their strand, which the signature
    holds. Every row is moved once, to the partition of its stack, where near names are found and letters merged in
    batches of whole stacks (:mod:`readloom.operators.stacks`); stacks of more than HOT rows are merged by joins. Both results are
    lazy, and bases move only the columns that they need. The merge of several
    p-values is done at once and not pair after pair, so it depends on no order and needs no row-wise fold; for two
    members both are the same.
    """
    prim = aln.where(~any_of(F.col("flag"), NOT_PRIMARY))
    if "dr" not in prim.columns:
        prim = prim.withColumn("dr", F.lit(None).cast("int"))
    rev = any_of(F.col("flag"), REVERSE)
    if infer:
        phred = F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33)
        prim = prim.withColumns({"fm": F.coalesce("fm", F.lit(1)), "fa": F.coalesce("fa", F.transform(phred, lambda _: F.lit(1))), "pv": F.coalesce("pv", F.when(rev, F.reverse(phred)).otherwise(phred))})
        if "fp" in prim.columns:
            prim = prim.withColumn("fp", F.coalesce("fp", F.lit(1)))
    own = F.concat(F.lit("#"), F.col(read_id).cast("string"))
    alone = any_of(F.col("flag"), UNMAPPED | MATE_UNMAPPED) | (F.lit(False) if infer else F.col(name).isNull())
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("bigint")
    prim = prim.withColumns({"fm": z("fm", 1), "rv": z("rv", 0), "np": z("np", 1), "nc": F.col("nc").cast("bigint")})
    hot = _hot_stacks(prim.where(~alone), sig)

    def records(cols: list[str]) -> DataFrame:
        m = prim.where(~alone)
        by = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(sig)]
        few = m if hot is None else m.join(F.broadcast(hot), by, "left_anti")
        out = _by_kernel(few.select(*cols), sig, None if infer else name, read_id, mismatch_limit, trust_unmasked)
        if hot is not None:
            much = m.join(F.broadcast(hot), by, "left_semi")
            out = out.unionByName(_by_joins(much, sig, name, read_id, mismatch_limit, trust_unmasked, infer).select(*out.columns))
        return out.unionByName(prim.where(alone).select(*cols, own.alias("root"), F.lit(1).cast("bigint").alias("n_merged")))

    out = records(prim.columns).withColumn("dr", F.when((F.col("rv") > 0) & (F.col("rv") < F.col("fm")), 1).otherwise(F.coalesce("dr", F.lit(0))).cast("int"))
    key = [*sig, "root"]
    codes = _letters(records(list(dict.fromkeys([*sig, *([] if infer else [name]), read_id, "flag", "seq", "qual", "fa", "pv"]))), key)
    return out, codes.select(*key, "base_pos", F.substring(F.lit("ACGTN"), F.col("code"), F.lit(1)).alias("base"), "fa", "pv", "qual")


def _hot_stacks(rows: DataFrame, sig: list[str]) -> DataFrame | None:
    """_s0, _s1, ...: the stacks of more than HOT rows, a written table; None without any.

    Rows are first counted by buckets of stacks, of which there is a fixed number; stacks are counted one by one only in buckets over HOT.
    """
    bucket = F.pmod(F.xxhash64(*sig), F.lit(BUCKETS))
    full = cut(rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("_bucket"), "buckets")
    if full.isEmpty():
        drop_cut(full)
        return None
    n = rows.join(F.broadcast(full), bucket == F.col("_bucket"), "left_semi").groupBy(*sig).agg(F.count("*").alias("_n"))
    hot = cut(n.where(F.col("_n") > HOT).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(sig)]), "hot")
    return None if hot.isEmpty() else hot


def _by_kernel(m: DataFrame, sig: list[str], name: str | None, read_id: str, limit: int, trust: bool) -> DataFrame:
    """The records of stacks of up to HOT rows: each row is moved once, in a compressed block, to the partition of its stack, and whole stacks are merged there."""
    ship(m.sparkSession)
    types = StructType([StructField(f.name, f.dataType) for f in m.schema] + [StructField("root", StringType()), StructField("n_merged", LongType())])
    arrow = to_arrow_schema(types)
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = m.withColumn("_bucket", F.pmod(F.xxhash64(*sig), F.lit(2 * parts)).cast("int")).mapInArrow(pack_blocks, "_bucket int, block binary")
    laid = blocks.repartitionById(parts, (F.col("_bucket") / 2).cast("int")).sortWithinPartitions("_bucket")
    return laid.mapInArrow(lambda batches: merge_stacks(batches, sig=sig, name=name, read_id=read_id, limit=limit, trust=trust, schema=arrow), types)


def _by_joins(m: DataFrame, sig: list[str], name: str, read_id: str, mismatch_limit: int, trust_unmasked: bool, infer: bool) -> DataFrame:
    """The records of stacks that no task should hold: names, members and letters meet by joins and aggregates."""
    m = cut(m, "stacks")  # read several times below, by column
    cols = m.columns
    m = m.withColumn("root", F.lit("*")) if infer else _rooted(m, _moves(m, sig, name, mismatch_limit), sig, name)
    key = [*sig, "root"]
    k = [f"_k{i}" for i in range(len(key))]
    multi = cut(m.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(a) for c, a in zip(key, k)], F.col("_n").alias("n_merged")), "merged")
    on = [F.col(c).eqNullSafe(F.col(a)) for c, a in zip(key, k)]
    single = m.join(multi, on, "left_anti").withColumn("n_merged", F.lit(1).cast("bigint"))
    many = m.join(multi, on).drop(*k)
    built = ["fm", "rv", "np", "nc", "dr", "seq", "qual", "fa", "pv"]
    rest = [c for c in cols if c not in built and c not in sig]
    rec = many.groupBy(*key).agg(
        F.max("n_merged").alias("n_merged"), F.max_by(F.struct(*rest), F.struct(F.col(name) if not infer else F.lit(0), F.col(read_id))).alias("_lead"),
        F.sum("fm").alias("fm"), F.sum("rv").alias("rv"), F.sum("np").alias("np"), F.sum(F.coalesce("nc", F.lit(0))).alias("_nc"), F.max(F.col("dr")).alias("dr"),
    )
    g = _letters(many, key).groupBy(*key, "base_pos").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("code") < 5, 1)).cast("int").alias("k"), F.min(F.when(F.col("code") < 5, F.col("code"))).alias("lo"), F.max(F.when(F.col("code") < 5, F.col("code"))).alias("hi"),
        F.sum(F.when(F.col("code") < 5, F.col("fa"))).alias("fa"), F.sum(F.when(F.col("code") < 5, F.col("pv"))).alias("pv"), F.max(F.when(F.col("code") < 5, F.col("qual"))).alias("q"),
    )
    agree = (F.col("lo") == F.col("hi")) & ((F.col("k") == F.col("n")) | F.lit(trust_unmasked))
    pv = F.when(F.col("k") == 1, F.col("pv")).otherwise(fisher_pv(F.col("k"), F.col("pv"))).cast("int")
    ok = F.coalesce(agree & (pv > 2), F.lit(False))
    cell = F.struct("base_pos", F.when(ok, F.substring(F.lit("ACGTN"), F.col("lo"), F.lit(1))).otherwise("N").alias("b"), F.when(ok, F.col("q")).otherwise(2).cast("int").alias("q"), F.when(ok, F.col("fa")).otherwise(0).cast("int").alias("fa"), F.when(ok, pv).otherwise(0).alias("pv"))
    texts = g.groupBy(*key).agg(F.array_sort(F.collect_list(cell)).alias("_c"), F.sum(F.when(ok & (F.col("k") < F.col("n")), 1).otherwise(0)).alias("_gained"))  # one cell a position: bounded by the read length
    texts = texts.select(*[F.col(c).alias(a) for c, a in zip(key, k)], "_c", "_gained")
    take = lambda f: F.transform("_c", lambda x: x[f])
    flip = lambda c: F.when(any_of(F.col("_lead.flag"), REVERSE), F.reverse(c)).otherwise(c)
    new = {
        "seq": F.array_join(take("b"), ""), "qual": F.array_join(F.transform("_c", lambda x: F.char(x["q"] + 33)), ""), "fa": flip(take("fa")), "pv": flip(take("pv")),
        "nc": F.col("_nc") + F.coalesce("_gained", F.lit(0)), "fm": F.col("fm"), "rv": F.col("rv"), "np": F.col("np"), "dr": F.col("dr"),
    }
    merged = rec.join(texts, on, "left").select(*[(F.col(c) if c in sig else new[c] if c in new else F.col(f"_lead.{c}")).alias(c) for c in cols], "root", "n_merged")
    return single.select(*cols, "root", "n_merged").unionByName(merged)


def _letters(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, base_pos (reference order), code (1..5 for A C G T N), fa, pv, qual: one row a letter; fa and pv are read from the end on the reverse strand."""
    e = rows.select(*keep, "flag", "seq", "qual", "fa", "pv", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("base_pos")).where(F.length("seq") > 0)
    at = F.when(any_of(F.col("flag"), REVERSE), F.length("seq") - 1 - F.col("base_pos")).otherwise(F.col("base_pos"))
    code = F.instr(F.lit("ACGTN"), F.upper(F.substring("seq", F.col("base_pos") + 1, F.lit(1))))
    return e.select(*keep, "base_pos", F.when(code > 0, code).otherwise(5).alias("code"), F.get("fa", at).alias("fa"), F.get("pv", at).alias("pv"), (F.ascii(F.substring("qual", F.col("base_pos") + 1, F.lit(1))) - 33).alias("qual"))


def route(aln: DataFrame, *, route_supplementary: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept alignments, reads to realign as name, mate, sp, seq, qual in sequencing order): merged records (nc not null) are to be realigned.

    ``route_supplementary``: also those that have supplementary alignments themselves or by their mate (sp 1). The reads
    are laid out by name with mate 1 first, so each written part holds whole pairs in order.
    """
    split = F.lit(False)
    if route_supplementary:
        split = F.col("sa").isNotNull() | F.col("mate_sa").isNotNull()
    out = F.col("nc").isNotNull() | split
    rev = any_of(F.col("flag"), REVERSE)
    again = aln.where(out).select(F.col("qname").alias("name"), F.when(any_of(F.col("flag"), READ2), 2).otherwise(1).alias("mate"), split.cast("int").alias("sp"), F.when(rev, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(rev, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
    return aln.where(~out), again.repartition("name").sortWithinPartitions("name", "mate")


def orphans(aln: DataFrame) -> DataFrame:
    """Names that don't have exactly two records."""
    return aln.groupBy("qname").agg(F.count("*").alias("n")).where("n <> 2")

