import math

from pyspark.sql import functions as F

from readloom.functions import cigar, flags, phred, seq


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_fisher_values(spark):
    rows = spark.createDataFrame([(2, 80), (4, 160), (1, 40), (3, 120), (5, 0), (1, 5000), (300, 9000), (1, 3000)], "n int, s int").select("n", "s", phred.fisher_pv(F.col("n"), F.col("s")).alias("pv")).collect()
    got = {(r.n, r.s): r.pv for r in rows}
    assert got[2, 80] == 67 and got[4, 160] == 120 and got[1, 40] == 40 and got[3, 120] == 94
    assert got[5, 0] == 0 and got[1, 5000] == 3117 and got[1, 3000] == 3000
    x = 9000 * math.log(10) / 10
    tail = sum(math.exp(k * math.log(x) - math.lgamma(k + 1) - x) for k in range(300))
    assert got[300, 9000] == (3117 if 300 * math.log(x) - x - math.lgamma(300) < phred.LOG_TINY else math.floor(-10 * math.log10(tail) + 0.5))


def test_agreed_is_fisher_of_two(spark):
    df = spark.createDataFrame([(67, 40), (78, 40), (2, 2), (0, 0), (1000, 2500)], "p int, q int")
    r = df.select("p", "q", phred.agreed_pv(F.col("p"), F.col("q")).alias("a"), phred.fisher_pv(F.lit(2), F.col("p") + F.col("q")).alias("f")).collect()
    assert [x.a for x in r[:2]] == [93, 104]
    assert all(x.a == x.f for x in r)


def test_phred_conversion(spark):
    r = one(spark, phred.to_phred(F.lit(0.001)).alias("a"), phred.to_phred(F.lit(0.0)).alias("b"), phred.to_phred(F.lit(None).cast("double")).alias("c"), phred.to_prob(F.lit(20)).alias("d"))
    assert (r.a, r.b, r.c) == (30, 3117, None) and abs(r.d - 0.01) < 1e-12


def test_homopolymer_counts_one_more_than_the_threshold(spark):
    df = spark.createDataFrame([("AAAA",), ("AAAT",), ("ACGN",), ("",), (None,)], "b string")
    assert [r[0] for r in df.select(seq.homopolymer_fail(F.col("b"), 3)).collect()] == [True, False, True, False, None]


def test_homing_and_barcode_expressions(spark):
    df = spark.createDataFrame([("ACGTTGACC",), ("ACGTATGAC",), ("ACGTACCCC",)], "s string")
    trim, ok = seq.homing_trim(F.col("s"), "tga", 4, 5)
    assert [tuple(r) for r in df.select(trim, ok).collect()] == [(7, 1), (8, 1), (7, 0)]
    try:
        seq.check_homing("ACGN")
        raise AssertionError
    except ValueError:
        pass
    r = one(spark, *seq.canonical_barcode(F.lit("TT"), F.lit("AC")), seq.hamming(F.lit("ACGT"), F.lit("ACCA")).alias("h"), seq.hamming(F.lit("A"), F.lit("AC")).alias("n"), seq.base_code(F.lit("CATG"), 4).alias("c"), seq.base_code(F.lit("CANG"), 4).alias("d"), seq.revcomp(F.lit("ACGN")).alias("rc"), seq.ambiguous_fraction(F.lit("ANNC")).alias("f"), *[x.alias(f"m{i}") for i, x in enumerate(seq.mask_prefix(F.lit("ACGT"), F.lit("IIII"), 2))])
    assert tuple(r) == ("ACTT", "R", 2, None, 0b01001110, None, "NCGT", 0.5, "NNGT", "##II")


def test_cigar_expressions(spark):
    c = F.lit("2H3S4M1I2D5M1S")
    r = one(spark, cigar.reference_length(c).alias("r"), cigar.aligned_fraction(c).alias("f"), cigar.lead_clip(c).alias("l"), cigar.tail_clip(c).alias("t"), cigar.unclipped_start(F.lit(100), c, F.lit(False)).alias("a"), cigar.unclipped_start(F.lit(100), c, F.lit(True)).alias("b"))
    assert (r.r, r.l, r.t, r.a, r.b) == (11, 3, 1, 97, 112) and abs(r.f - 9 / 14) < 1e-12


def test_aligned_bases_walk(spark):
    df = spark.createDataFrame([(1, 10, "2S2M1I1D2M", "NNACGTT", "!!IIIII", True, [7, 6, 5, 4, 3, 2, 1]), (2, 5, "3M", "ACG", "III", False, [1, 2, 3])], "id int, pos int, cigar string, seq string, qual string, rev boolean, fa array<int>")
    got = cigar.aligned_bases(df, ["id"], reverse=F.col("rev"), arrays=["fa"], gaps=True).orderBy("id", "ref_pos").collect()
    first = [(r.ref_pos, r.base, r.cycle, r.fa_at, r.is_del) for r in got if r.id == 1]
    assert first == [(10, "A", 4, 3, False), (11, "C", 3, 4, False), (12, None, 1, None, True), (13, "T", 1, 6, False), (14, "T", 0, 7, False)]
    assert [(r.ref_pos, r.base, r.fa_at) for r in got if r.id == 2] == [(5, "A", 1), (6, "C", 2), (7, "G", 3)]


def test_gate_defaults(spark):
    df = spark.createDataFrame([(1, 0, 9, None, None, None), (2, 4, 9, 3, 1, 1), (3, 0, 9, 3, 0, 1), (4, None, None, 3, 1, 0)], "id int, flag int, mapq int, fm int, fp int, dr int")
    ids = lambda **k: sorted(r.id for r in df.where(flags.gate(**k)).collect())
    assert ids() == [1, 2, 3, 4]
    assert ids(skip=4) == [1, 3, 4]
    assert ids(min_fm=1) == [1, 2, 3, 4] and ids(min_fm=2) == [2, 3, 4]
    assert ids(require_fp=True) == [1, 2, 4] and ids(duplex=True) == [2, 3] and ids(min_mapq=5) == [1, 2, 3]
