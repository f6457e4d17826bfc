"""Deterministic read, alignment, region, reference and variant views over the test tables, in Spark and as SQL text.

The expressions are integer arithmetic that both engines share; only the difference of dates is spelled differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.session import spread, table

#: Letters of each reference contig.
REF_LEN = 4096

_contig = "CASE {k} % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"
_ref_index = "((({r}) * ({r}) + 3 * ({r})) % 11) % 4"

_ALN = [
    ("read_id", "l_orderkey * 8 + l_linenumber"),
    ("qname", "'q' || cast(l_orderkey AS string) || '_' || cast(l_linenumber - 1 - (l_linenumber - 1) % 2 AS string)"),
    ("contig", _contig.format(k="l_orderkey")),
    ("pos", "cast({days} AS int)"),
    ("len", "cast(l_quantity AS int)"),
    ("shape", "cast(CASE WHEN l_quantity < 8 THEN 0 ELSE l_partkey % 4 END AS int)"),
    ("mapq", "cast(round(l_discount * 600) AS int)"),
    ("flag", "cast(1 + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_suppkey % 3 = 0 THEN 16 ELSE 0 END + CASE WHEN l_suppkey % 5 > 0 THEN 2 ELSE 0 END"
             " + CASE WHEN l_partkey % 17 = 0 THEN 2048 ELSE 0 END + CASE WHEN l_partkey % 19 = 0 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 23 = 0 THEN 512 ELSE 0 END + CASE WHEN l_partkey % 29 = 0 THEN 1024 ELSE 0 END AS int)"),
    ("fm", "l_linenumber"),
    ("rv", "cast(l_suppkey % (l_linenumber + 1) AS int)"),
    ("fp", "cast(CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE 1 END AS int)"),
    ("np", "cast(l_suppkey % 4 AS int)"),
    ("isize", "cast(l_partkey % 400 - 200 AS int)"),
    ("barcode", "(" + " || ".join(f"substring('ACGT', cast(floor(l_partkey / {4 ** i}) AS int) % 4 + 1, 1)" for i in range(5)) + " || substring('ACGT', l_linenumber % 4 + 1, 1))"),
]
#: More columns, from those above.
_ALN2 = [
    ("endpos", "pos + CASE shape WHEN 2 THEN len - 2 WHEN 3 THEN len + 1 ELSE len END"),
    ("cigar", "CASE shape WHEN 2 THEN '2S' || cast(len - 2 AS string) || 'M' WHEN 3 THEN '4M1D' || cast(len - 4 AS string) || 'M' ELSE cast(len AS string) || 'M' END"),
    ("dr", "CASE WHEN rv > 0 AND rv < fm THEN 1 ELSE 0 END"),
    ("is_rev", "(flag % 32) >= 16"),
]
_rpos = "pos + {i} + CASE WHEN shape = 2 THEN -2 WHEN shape = 3 AND {i} >= 4 THEN 1 ELSE 0 END"
_bad = "(read_id * 31 + {i} * 17) % 19 = 0"
_is_n = "(read_id * 7 + {i} * 5) % 41 = 0"
_letter = "CASE WHEN " + _is_n + " THEN 'N' ELSE substring('ACGT', cast((" + _ref_index.format(r=_rpos) + " + CASE WHEN " + _bad + " THEN 1 + read_id % 3 ELSE 0 END) % 4 AS int) + 1, 1) END"
_q = "cast(2 + (read_id * 13 + {i} * 5) % 40 AS int)"
_pv = "cast(2 + (read_id * 13 + {i} * 5) % 40 + 10 * fm AS int)"
_fa = "cast(greatest(1, fm - (read_id + {i}) % 2) AS int)"


#: Letter, quality, pv and fa of a read at its letter {i} in reference order, for SQL twins.
LETTER, QUAL, PV, FA = _letter, _q, _pv, _fa


def _cols(cols: list[tuple[str, str]], **kw) -> str:
    return ", ".join(f"{e.format(**kw) if kw else e} AS {n}" for n, e in cols)


_SPARK_DAYS = "datediff(l_shipdate, date'1992-01-01')"


def alignments(spark: SparkSession, sf_dir: str, *, bases: bool = True) -> DataFrame:
    """Alignments from lineitem; with ``bases`` also seq, qual (reference order) and fa, pv (sequencing order)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    a = (spread(items) if bases else items).selectExpr(*[f"{e.format(days=_SPARK_DAYS) if 'days' in e else e} AS {n}" for n, e in _ALN]).selectExpr("*", *[f"{e} AS {n}" for n, e in _ALN2])
    if not bases:
        return a
    seqd = "IF(is_rev, len - 1 - i, i)"
    slow = {
        "seq": f"array_join(transform(sequence(0, len - 1), i -> {_letter.format(i='i')}), '')",
        "qual": f"array_join(transform(sequence(0, len - 1), i -> char(33 + {_q.format(i='i')})), '')",
        "fa": f"transform(sequence(0, len - 1), i -> {_fa.format(i='(' + seqd + ')')})",
        "pv": f"transform(sequence(0, len - 1), i -> {_pv.format(i='(' + seqd + ')')})",
    }
    return a.selectExpr("*", *[f"{e} AS {n}" for n, e in _PLACES]).selectExpr(*a.columns, *[f"IF({_TABLED}, {_FAST[c]}, {slow[c]}) AS {c}" for c in slow])


# The letters of a read repeat (the reference every 11 positions, qualities every 8, wrong letters every 19, N every 41), so those of usual reads
# are cut from tables by expressions of generated code; the lambdas above, which are interpreted letter by letter, are left for all others.
_MOST = 50
_TABLED = f"len BETWEEN 1 AND {_MOST} AND pos >= 2 AND read_id >= 0 AND fm BETWEEN 1 AND 7"
_REF = "".join("ACGT"[(r * r + 3 * r) % 11 % 4] for r in range(11 + _MOST))
_QUALS = "".join(chr(35 + v + 5 * (k % 8)).replace("'", "\\'") for v in range(5) for k in range(64))
_ints = lambda x: "cast(split('" + ",".join(map(str, x)) + "', ',') AS array<int>)"
_PVS = _ints(2 + v + 5 * (k * up % 8) + 10 * fm for up in (1, -1) for fm in range(1, 8) for v in range(5) for k in range(64))
_FAS = _ints(max(1, fm - k % 2) for fm in range(1, 8) for k in range(2 + _MOST))
#: The letters as in the reference, and for the tables where a read begins in them.
_PLACES = [
    ("_b", f"CASE shape WHEN 2 THEN substring('{_REF}', (pos - 2) % 11 + 1, len) WHEN 3 THEN substring('{_REF}', pos % 11 + 1, 4) || substring('{_REF}', (pos + 5) % 11 + 1, len - 4) ELSE substring('{_REF}', pos % 11 + 1, len) END"),
    ("_bad", "cast(read_id * 6 % 19 AS int)"),
    ("_n", "cast(read_id * 15 % 41 AS int)"),
    ("_v", "cast(read_id * 13 % 5 AS int)"),
    ("_u", "cast(read_id * 13 % 40 AS int) DIV 5"),
]


def _put(text: str, letter: str, at: str) -> str:
    return f"overlay({text} PLACING IF({at} < len, {letter}, '') FROM {at} + 1 FOR IF({at} < len, 1, 0))"


def _seq() -> str:
    text = "_b"
    for at in ("_bad", "(_bad + 19)", "(_bad + 38)"):
        x = f"substring(_b, {at} + 1, 1)"
        text = _put(text, f"CASE read_id % 3 WHEN 0 THEN translate({x}, 'ACGT', 'CGTA') WHEN 1 THEN translate({x}, 'ACGT', 'GTAC') ELSE translate({x}, 'ACGT', 'TACG') END", at)
    return _put(_put(text, "'N'", "_n"), "'N'", "(_n + 41)")


_FAST = {
    "seq": _seq(),
    "qual": f"substring('{_QUALS}', cast(_v * 64 + _u + 1 AS int), len)",
    "fa": f"slice({_FAS}, cast((fm - 1) * {2 + _MOST} + (read_id + IF(is_rev, len - 1, 0)) % 2 + 1 AS int), len)",
    "pv": f"slice({_PVS}, cast(IF(is_rev, 2240 + (fm - 1) * 320 + _v * 64 + (8 - (_u + len - 1) % 8) % 8, (fm - 1) * 320 + _v * 64 + _u) + 1 AS int), len)",
}


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 regions from nation."""
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey AS region_id", _contig.format(k="n_nationkey") + " AS contig", "1100 + n_nationkey * 100 AS start_pos", "1130 + n_nationkey * 100 AS end_pos", "n_name AS region_name")


def reference(spark: SparkSession) -> DataFrame:
    """Three contigs of REF_LEN letters."""
    seq = f"array_join(transform(sequence(0, {REF_LEN - 1}), r -> substring('ACGT', cast({_ref_index.format(r='r')} AS int) + 1, 1)), '')"
    return spark.range(3, numPartitions=1).selectExpr(_contig.format(k="id") + " AS contig", f"{seq} AS seq")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants from orders; every tenth has a longer allele, every seventh an unspecific one."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS variant_id", _contig.format(k="o_orderkey") + " AS contig", "datediff(o_orderdate, date'1992-01-01') AS pos")
    ref = f"substring('ACGT', cast({_ref_index.format(r='pos')} AS int) + 1, 1)"
    alt = f"substring('ACGT', cast(({_ref_index.format(r='pos')} + 1 + variant_id % 3) % 4 AS int) + 1, 1)"
    return o.selectExpr("variant_id", "contig", "pos", f"CASE WHEN variant_id % 10 = 0 THEN array({ref}, {alt} || 'A') WHEN variant_id % 7 = 0 THEN array({ref}, {alt}, '<*>') ELSE array({ref}, {alt}) END AS alleles")


def reads_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads_marked with rows delivered twice counted once, barcodes and sequences in upper case, and without reads that have no barcode."""
    r = table(spark, sf_dir, "reads_marked")
    r = r.select("read_id", "library_id", "mate", F.upper(F.trim("barcode")).alias("barcode"), "strand", "fp", F.upper("seq").alias("seq"), "qual").where("barcode is not null")
    return r.dropDuplicates(["read_id"])


_DUCK_DAYS = "date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)"

#: Common table expressions for DuckDB.
CTE = {
    "aln": "aln AS (SELECT *, " + _cols(_ALN2) + " FROM (SELECT " + ", ".join(f"{e.format(days=_DUCK_DAYS) if 'days' in e else e} AS {n}" for n, e in _ALN) + " FROM lineitem))",
    "bed": f"bed AS (SELECT n_nationkey AS region_id, {_contig.format(k='n_nationkey')} AS contig, 1100 + n_nationkey * 100 AS start_pos, 1130 + n_nationkey * 100 AS end_pos FROM nation)",
    "bases": (
        "bases AS (SELECT * FROM (SELECT *, " + _rpos.format(i="i") + " AS ref_pos, " + _letter.format(i="i") + " AS base, " + _q.format(i="i") + " AS qual, " + _pv.format(i="i") + " AS pv, " + _fa.format(i="i") + " AS fa, "
        f"substring('ACGT', cast({_ref_index.format(r=_rpos.format(i='i'))} AS int) + 1, 1) AS ref_base, CASE WHEN is_rev THEN len - 1 - i ELSE i END AS cycle FROM (SELECT *, unnest(range(0, len)) AS i FROM aln)) WHERE shape <> 2 OR i >= 2)"
    ),
    "variants": (
        "variants AS (SELECT *, substring('ACGT', CAST(" + _ref_index.format(r="pos") + " AS INT) + 1, 1) AS r, substring('ACGT', CAST((" + _ref_index.format(r="pos") + " + 1 + variant_id % 3) % 4 AS INT) + 1, 1) AS a "
        "FROM (SELECT o_orderkey AS variant_id, " + _contig.format(k="o_orderkey") + " AS contig, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS pos FROM orders))"
    ),
    "reads": "reads AS (SELECT DISTINCT ON (read_id) read_id, library_id, mate, upper(trim(barcode)) AS barcode, strand, fp, upper(seq) AS seq, qual FROM reads_marked WHERE barcode IS NOT NULL)",
}


def with_(*names: str, extra: str = "") -> str:
    """WITH clause of the named views (and more)."""
    need = []
    for n in names:
        need += ["aln", n] if n == "bases" else [n]
    return "WITH " + ", ".join(CTE[n] for n in dict.fromkeys(need)) + (", " + extra if extra else "") + " "
