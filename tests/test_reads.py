import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions.phred import fisher_pv
from readloom.operators import depth, intervals, pileup, reads, rescue, stacks

ALN = "read_id int, qname string, flag int, contig string, pos int, endpos int, mapq int, cigar string, seq string, qual string, fm int, fp int, rv int, dr int, np int, nc int, isize int, fa array<int>, pv array<int>, barcode string, sa string, mf double"


def aln(spark, *rows):
    base = dict(qname="q", flag=0, contig="1", pos=10, endpos=14, mapq=60, cigar="4M", seq="ACGT", qual="IIII", fm=1, fp=1, rv=0, dr=0, np=None, nc=None, isize=100, fa=[1, 1, 1, 1], pv=[40, 40, 40, 40], barcode="AAAA", sa=None, mf=None)
    names = [c.split()[0] for c in ALN.split(", ")]
    full = [{"read_id": i, **base, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ALN)


def regions(spark, *rows):
    return spark.createDataFrame(list(rows), "region_id int, contig string, start_pos int, end_pos int")


def test_filter_and_its_complement(spark):
    a = aln(spark, {}, {"fm": None}, {"flag": 4}, {"mapq": None}, {"contig": None}, {"pos": 50, "endpos": 54}, {"contig": "2"})
    kw = dict(min_fm=1, min_mapq=10, skip_flags=4, regions=regions(spark, (1, "1", 0, 11), (2, "1", 2, 30)))
    good, bad = reads.split_reads(a, **kw)
    assert sorted(r.read_id for r in good.collect()) == [0, 1]
    assert sorted(r.read_id for r in bad.collect()) == [2, 3, 4, 5, 6]


def test_overlap_edges(spark):
    a = aln(spark, {}, {"pos": 0, "endpos": 10}, {"pos": 14, "endpos": 20}, {"pos": 0, "endpos": 50_000}, {"pos": 8191, "endpos": 8193})
    r = regions(spark, (1, "1", 10, 14), (2, "1", 8192, 8300))
    assert sorted(x.read_id for x in intervals.overlaps(a, r).collect()) == [0, 3, 4]
    assert sorted((x.read_id, x.region_id) for x in intervals.overlap_join(a, r).collect()) == [(0, 1), (3, 1), (3, 2), (4, 2)]
    assert [tuple(x) for x in intervals.pad_regions(regions(spark, (1, "1", 3, 5), (2, "1", 5, 5)), 10).collect()] == [(1, "1", 0, 15)]


def test_cap(spark):
    a = aln(spark, {"fm": 4, "fa": [4, 1, 4, 4], "pv": [200, 200, 10, 200], "flag": 16}, {"fm": 4, "fa": [4, 1, 4, 4], "pv": [200, 200, 10, 200]}, {"fm": 1})
    got = {r.read_id: r.qual for r in reads.cap_qualities(a, min_pv=137, min_fraction=0.7, min_fm=2, cap=49).collect()}
    assert got == {0: "R##R", 1: "R##R"}
    keep = {r.read_id: r.qual for r in reads.cap_qualities(a.where("read_id = 1"), min_pv=137, min_fraction=0.7, cap=49, keep_failing=True).collect()}
    assert keep == {1: "RIIR"}
    for bad in (dict(cap=94, min_pv=1), {}):
        with pytest.raises(ValueError):
            reads.cap_qualities(a, **bad)


def test_mark_pairs_sets_qc_on_both(spark):
    a = aln(spark, {"flag": 65, "fp": 0}, {"flag": 129, "pos": 30, "cigar": "1S3M", "flag": 129}, {"qname": "alone", "flag": 65})
    got = {r.read_id: r for r in reads.mark_pairs(a).collect()}
    assert got[0].flag == 65 | 512 and got[1].flag == 129 | 512 and got[2].flag == 65
    assert (got[0].mu, got[1].mu, got[0].lm, got[2].mu) == (29, 10, 4, None)
    assert reads.mark_pairs(a, drop_qcfail=True).count() == 1


def test_famstats_order_of_reasons(spark):
    a = aln(spark, {"flag": 128}, {"flag": 256, "mapq": 0}, {"mapq": 0}, {"fm": 1}, {"fm": 3, "fp": 0, "rv": 1, "dr": 1}, {"fm": 2, "np": 2})
    s = reads.famstats(a, min_mapq=10, min_fm=2).first()
    assert (s.n_flag_fail, s.n_mapq_fail, s.n_fm_fail, s.n_fp_fail, s.n_pass, s.fm_sum, s.n_duplex) == (1, 1, 1, 1, 2, 5, 1)
    assert reads.famstats(a, min_mapq=10, min_fm=2, skip_fp_fail=True).first().n_pass == 1
    h = {(r.kind, r.value): r.n_families for r in reads.family_histograms(a, min_mapq=10, min_fm=2).collect()}
    assert h == {("fm", 3): 1, ("fm", 2): 1, ("rv", 1): 1, ("rv", 0): 1, ("np", 2): 1}


def test_target_rate(spark):
    a = aln(spark, {}, {"pos": 100, "endpos": 104, "fm": 3}, {"flag": 4})
    t = reads.target_rate(a, regions(spark, (1, "1", 0, 12), (2, "1", 5, 13))).first()
    assert (t.n_reads, t.n_target, t.raw_reads, t.raw_target, t.n_real, t.real_target, t.n_skipped) == (2, 1, 4, 1, 1, 0, 1)
    e = reads.target_rate(a.where("false"), regions(spark, (1, "1", 0, 12))).first()
    assert e.n_reads == 0 and e.n_reads_fraction is None if "n_reads_fraction" in e.asDict() else e.n_target_fraction is None


def test_depth_counts_and_cap(spark):
    a = aln(spark, {}, {"fm": 3}, {"pos": 12, "endpos": 16})
    r = regions(spark, (1, "1", 11, 14))
    d = {x.ref_pos: (x.collapsed, x.raw, x.singleton) for x in depth.position_depth(a, r).collect()}
    assert d == {11: (2, 4, 1), 12: (3, 5, 2), 13: (3, 5, 2)}
    assert {x.collapsed for x in depth.position_depth(a, r, max_depth=2).collect()} == {2}
    h = {x.depth: (x.n_bases, round(x.pct_bases, 3)) for x in depth.depth_histogram(a, r).collect()}
    assert h == {2: (3, 100.0), 3: (2, 66.667)}
    q = depth.region_depth(a, regions(spark, (1, "1", 11, 14), (2, "2", 0, 4))).where("region_id = 2").first()
    assert q.collapsed_total == 0 and q.pct_singleton is None


def test_mates_merge(spark):
    a = aln(spark, {"flag": 65, "seq": "ACNT"}, {"flag": 129, "seq": "AGGT", "fa": [2, 2, 2, 2], "pv": [67, 67, 67, 67]}, {"qname": "other"})
    o = {(r.qname, r.ref_pos): r for r in pileup.observations(a).collect()}
    assert (o["q", 10].base, o["q", 10].pv, o["q", 10].fa, o["q", 10].overlap) == ("A", 93, 3, 1)
    assert (o["q", 11].base, o["q", 11].pv) == ("N", 0) and (o["q", 12].base, o["q", 12].fa) == ("G", 2)
    c = {(r.ref_pos, r.base): r for r in pileup.allele_counts(pileup.observations(a), None).collect()}
    assert c[11, "C"].ambig == 1 and c[10, "A"].n_obs == 2 and c[10, "A"].quantity == 2


def test_mismatch_density_reaches_observations(spark):
    a = aln(spark, {"flag": 65, "seq": "ACGT"}, {"flag": 129, "seq": "AGGA"}, {"qname": "other", "seq": "ANGT"})
    ref = spark.createDataFrame([("1", "T" * 10 + "ACGT" + "T" * 10)], "contig string, seq string")
    o = pileup.observations(pileup.mismatch_density(a, ref, a.columns))
    assert {(r.qname, r.md) for r in o.collect()} == {("q", 2), ("other", 0)}
    c = {(r.ref_pos, r.base): (r.n_obs, r.md_failed) for r in pileup.allele_counts(o, None, pileup.Thresholds(md_threshold=2)).collect()}
    assert c[10, "A"] == (2, 1) and "md" not in pileup.observations(a).columns


def test_vet_passes_unfit_records_on(spark):
    a = aln(spark, {}, {"qname": "r2"})
    v = spark.createDataFrame([(1, "1", 10, ["A", "C", "<*>"]), (2, "1", 10, ["A", "AC"]), (3, "1", 99, ["A", "C"]), (4, "1", 11, ["C", "G"])], "variant_id int, contig string, pos int, alleles array<string>")
    got = {(r.variant_id, r.allele): (r.n_obs, r.vet_pass) for r in pileup.vet_variants(v, pileup.observations(a), regions=regions(spark, (1, "1", 0, 11))).collect()}
    assert got == {(1, "A"): (2, True), (1, "C"): (0, False), (2, "A"): (None, None), (2, "AC"): (None, None), (3, "A"): (None, None), (3, "C"): (None, None), (4, "C"): (None, None), (4, "G"): (None, None)}


def test_rescue_chains_and_conservation(spark):
    a = aln(spark, {"barcode": "AAAA", "fm": 2, "rv": 1}, {"barcode": "AAAC"}, {"barcode": "ACAC", "seq": "ACGA"}, {"barcode": "TTTT"}, {"barcode": "AAAC", "pos": 99}, {"barcode": "GGGG", "flag": 4})
    rec, bases = rescue.rescue(a, ["contig", "pos"], mismatch_limit=1)
    got = {(r.pos, r.root): (r.n_merged, r.fm, r.rv, r.dr, r.np) for r in rec.collect()}
    assert got == {(10, "ACAC"): (3, 4, 1, 1, 3), (10, "TTTT"): (1, 1, 0, 0, 1), (99, "AAAC"): (1, 1, 0, 0, 1), (10, "#5"): (1, 1, 0, 0, 1)}
    b = {r.base_pos: (r.base, r.fa, r.pv) for r in bases.where("root = 'ACAC'").collect()}
    assert b[0] == ("A", 3, 94) and b[3] == ("N", 0, 0)
    assert rec.agg(F.sum("fm")).first()[0] == a.agg(F.sum("fm")).first()[0]
    assert rescue.rescue(a, ["contig", "pos"], infer=True)[0].count() == 3


def test_rescue_reads_tags_in_sequencing_order_and_keeps_nameless_reads(spark):
    back = {"flag": 16, "fa": [1, 2, 3, 4], "pv": [11, 12, 13, 14], "seq": "ACGT"}
    a = aln(spark, {**back, "barcode": "AAAA"}, {**back, "barcode": "AAAC", "fm": 3}, {**back, "barcode": "TTTT", "pos": 70}, {"barcode": None, "fm": 5}, {"barcode": None, "fm": 7})
    a, sig = rescue.with_signature(a, single_end=True)
    rec, bases = rescue.rescue(a, sig, mismatch_limit=1)
    rows = {r.root: r for r in rec.collect()}
    assert rec.agg(F.sum("fm")).first()[0] == a.agg(F.sum("fm")).first()[0] and len(rows) == 4
    assert rows["AAAC"].fa == [2, 4, 6, 8] and rows["AAAC"].n_merged == 2 and rows["AAAC"].nc == 0 and rows["TTTT"].nc is None
    by = {(r.root, r.base_pos): (r.base, r.fa) for r in bases.collect()}
    assert [by["TTTT", i] for i in range(4)] == [("A", 4), ("C", 3), ("G", 2), ("T", 1)]  # by reference position
    assert [by["AAAC", i] for i in range(4)] == [("A", 8), ("C", 6), ("G", 4), ("T", 2)]
    again = rescue.route(rec.withColumn("qname", F.col("root")))[1].collect()
    assert [(r.name, r.seq) for r in again] == [("AAAC", "ACGT")]  # its own reverse complement


def test_three_records_of_a_name_meet(spark):
    a = aln(spark, {"fm": 1}, {"flag": 131, "fm": 2}, {"flag": 147, "fm": 4, "seq": "ACNT"})
    o = {r.ref_pos: (r.base, r.fm, r.fa, r.overlap) for r in pileup.observations(a).collect()}
    assert o[10] == ("A", 7, 3, 1) and o[12] == ("G", 7, 2, 1)


def test_depth_of_several_samples(spark):
    a = aln(spark, {}, {"pos": 12, "endpos": 16}, {"fm": 4}).withColumn("s", F.when(F.col("fm") > 1, "x").otherwise("y"))
    r = regions(spark, (1, "1", 8, 18), (2, "1", 500, 505))
    got = {(x.region_id, x.s): (x.region_len, x.collapsed_total, x.raw_total) for x in depth.region_depth(a, r, sample="s").collect()}
    assert got == {(1, "x"): (10, 4, 16), (1, "y"): (10, 8, 8), (2, "x"): (5, 0, 0), (2, "y"): (5, 0, 0)}
    h = {(x.s, x.depth): x.n_bases for x in depth.depth_histogram(a, r, sample="s", include_zero=True).collect()}
    assert h == {("x", 0): 15, ("x", 1): 4, ("x", 2): 0, ("y", 0): 15, ("y", 1): 6, ("y", 2): 2}


def test_long_rows_meet_regions_by_wide_bins(spark):
    a = aln(spark, {"pos": 5, "endpos": 10}, {"pos": 100_000, "endpos": 900_000}, {"pos": 1, "endpos": 2, "contig": "2"}, {"contig": None}, {"pos": 5, "endpos": 2_000_000_000})
    r = regions(spark, (1, "1", 9, 11), (2, "1", 700_000, 700_001), (3, "1", 1_999_999_999, 2_000_000_001))
    assert {x.read_id for x in intervals.overlaps(a, r).collect()} == {0, 1, 4}
    assert {x.read_id for x in intervals.overlaps(a, r, how="left_anti").collect()} == {2, 3}
    assert {(x.read_id, x.hit) for x in intervals.overlap_flag(a, r, "hit").collect()} == {(0, True), (1, True), (2, False), (3, False), (4, True)}


def test_rescue_of_two_is_the_pairwise_merge(spark):
    a = aln(spark, {"barcode": "AAAA", "pv": [67] * 4, "fa": [2] * 4}, {"barcode": "AAAC"})
    b = rescue.rescue(a, ["contig", "pos"])[1].collect()
    assert {(r.fa, r.pv) for r in b} == {(3, 93)}


def test_errors_against_reference_pieces(spark):
    from readloom.operators import errors

    seq = ("ACGT" * 12_000)[: 3 * errors.PIECE + 100]
    ref = spark.createDataFrame([("1", seq)], "contig string, seq string")
    p = errors.PIECE
    rows = [{"pos": p - 2, "endpos": p + 2, "seq": seq[p - 2 : p + 1] + "N"}, {"pos": p - 2, "endpos": p + 2, "seq": "A" + seq[p - 1 : p + 2]}, {"pos": 5, "endpos": 5 + 4 + 2 * p, "cigar": f"2M{2 * p}N2M", "seq": seq[5:7] + seq[7 + 2 * p : 9 + 2 * p]}]
    cube = errors.error_cube(aln(spark, *rows), ref)
    got = cube.groupBy().agg(F.sum("obs"), F.sum("err")).first()
    assert tuple(got) == (11, 1)
    rates = {r.cycle: r.r1_err for r in errors.cycle_rates(cube).collect()}
    assert rates == {0: 1, 1: 0, 2: 0, 3: 0}
    by = errors.error_by_region(aln(spark, *rows), ref, regions(spark, (1, "1", p, p + 1), (2, "1", 0, 6), (3, "2", 0, 6)))
    assert {r.region_id: (r.errors, r.obs) for r in by.collect()} == {1: (1, 11), 2: (0, 4)}


def _stacks(spark, n=900):
    r = random.Random(3)
    word = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    rows = []
    for i in range(n):
        k = r.choice([0, 1, 5, 5, 5, 7])
        tags = [[r.choice([None, 0, 1, 2, 40, 300]) if r.random() < 0.1 else r.randint(1, 60) for _ in range(max(0, k - r.choice([0, 0, 0, 1])))] for _ in range(2)]
        rows.append((i // 2, r.choice(["1", "2", None]), r.choice([10, 11, 12, 13]), r.choice([0, 16, 16, 4, 256]), r.choice([None, word("ACGT", 5), word("AC", 6), word("ACé", 6), ""]), r.choice([None, 1, 2, 5]),
                     r.choice([None, 0, 1]), r.choice([None, 2]), r.choice([None, None, 1]), r.choice([None, None, 0, 1]), word("AAAAAcN", k), r.choice([None] + 9 * [word("#5I", k)]), tags[0] if r.random() < 0.9 else None, tags[1], f"x{i}"))
    return spark.createDataFrame(rows, "read_id int, contig string, pos int, flag int, barcode string, fm int, rv int, np int, nc int, dr int, seq string, qual string, fa array<int>, pv array<int>, qname string").dropDuplicates(["read_id", "barcode", "contig", "pos"])


@pytest.mark.parametrize("kw", [{}, {"trust_unmasked": True}, {"infer": True}, {"mismatch_limit": 1}])
def test_rescue_in_stacks_is_the_rescue_by_joins(spark, monkeypatch, kw):
    a = _stacks(spark).cache()
    key = lambda d: sorted(str(sorted(x.asDict().items())) for x in d.collect())
    monkeypatch.setattr(stacks, "BATCH_ROWS", 50)
    monkeypatch.setattr(stacks, "PAIRS", 40)
    monkeypatch.setattr(stacks, "BLOCK_ROWS", 70)
    got = [key(d) for d in rescue.rescue(a, ["contig", "pos"], **kw)]
    monkeypatch.setattr(rescue, "HOT", 60)
    some = [key(d) for d in rescue.rescue(a, ["contig", "pos"], **kw)]
    monkeypatch.setattr(rescue, "HOT", 0)
    every = [key(d) for d in rescue.rescue(a, ["contig", "pos"], **kw)]
    assert got == every and some == every and len(got[0]) > 5


def test_fisher_in_numbers_is_the_expression(spark):
    d = spark.range(40 * 600).selectExpr("cast(id % 40 AS int) AS n", "cast(id div 40 * 3 AS bigint) AS s")
    rows = d.select("n", "s", fisher_pv(F.col("n"), F.col("s")).alias("pv")).collect()
    n, s, pv = (np.array([r[i] for r in rows]) for i in range(3))
    assert np.array_equal(stacks.fisher(n, s.astype(float)), pv)


def test_rescue_moves_every_read_once(spark):
    rec, bases = rescue.rescue(_stacks(spark, 40), ["contig", "pos"])
    for d in rec, bases:
        assert str(d._jdf.queryExecution().optimizedPlan()).count("Repartition") == 1
        assert "Join" not in str(d._jdf.queryExecution().optimizedPlan())
