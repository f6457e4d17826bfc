import math
import random
from collections import Counter, defaultdict


from readloom.functions.phred import LOG_TINY
from readloom.operators.barcodes import mark_inline, mark_secondary, rescale_quality, rescale_reads
from readloom.operators.collapse import align_lengths, collapse_families

SCHEMA = "read_id int, barcode string, strand string, fp int, seq string, qual string"


def pv(n, s):
    if s <= 0:
        return 0
    x = s * math.log(10) / 10
    if x >= n and n * math.log(x) - x - math.lgamma(n) < LOG_TINY:
        return 3117
    return max(0, math.floor(-10 * math.log10(sum(math.exp(k * math.log(x) - math.lgamma(k + 1) - x) for k in range(n))) + 0.5))


def model(reads):
    """Unstranded consensus of each family, record by record."""
    fam = defaultdict(list)
    for r in sorted(reads):
        fam[r[1]].append(r)
    out = {}
    for b, rs in fam.items():
        n = max(min(len(r[4]), len(r[5])) for r in rs)
        seq, fa, pvs, miss = "", [], [], 0
        for i in range(n):
            c, s = Counter(), Counter()
            for r in rs:
                if i < min(len(r[4]), len(r[5])):
                    x = r[4][i] if r[4][i] in "ACGT" else "N"
                    c[x] += 1
                    s[x] += ord(r[5][i]) - 33
            depth = sum(c.values())
            w = max(c, key=lambda x: (s[x], "ACGTN".index(x)))
            won = w if s[w] > 0 else "N"
            p = pv(depth, s[w])
            good = p > 2 and c[w] / depth > 0.5
            seq += won if good else "N"
            fa.append(c[w])
            pvs.append(p if good else 2)
            miss += depth - c[w] - (c["N"] if won != "N" else 0)
        out[b] = (len(rs), sum(r[2] == "R" for r in rs), rs[0][3], seq, fa, pvs, round(miss / len(rs), 9))
    return out


def test_against_a_model_in_python(spark):
    rng = random.Random(5)
    reads = []
    for i in range(300):
        n = rng.randrange(4, 12)
        reads.append((i, rng.choice(["AAA", "CCC", "GGG", "hot"]) if rng.random() < 0.8 else f"B{i}", rng.choice("FR"), rng.randrange(2), "".join(rng.choice("ACGTN" if rng.random() < 0.3 else "A") for _ in range(n)), "".join(chr(33 + rng.randrange(0, 41)) for _ in range(n + rng.randrange(-1, 2)))))
    df = spark.createDataFrame(reads, SCHEMA)
    want = model(reads)
    for hot in (20_000, 40):  # the road of hot families gives the same
        got = {r.barcode: (r.fm, r.rv, r.fp, r.seq, r.fa, r.pv, round(r.nf, 9)) for r in collapse_families(df, ["barcode"], "read_id", stranded=False, hot=hot).collect()}
        assert got == want


def test_duplex_family(spark):
    rows = [(i, "AT", "R" if i < 2 else "F", 1, "ACGT" if i else "ACGA", "IIII") for i in range(7)] + [(9, "GG", "F", 0, "ACGT", "IIII")]
    got = {r.barcode: r for r in collapse_families(spark.createDataFrame(rows, SCHEMA), ["barcode"], "read_id").collect()}
    a, b = got["AT"], got["GG"]
    assert (a.fm, a.rv, a.dr, round(a.nf, 2)) == (7, 2, 1, 0.14)
    assert (b.fm, b.rv, b.dr, b.fp, b.seq) == (1, 0, 0, 0, "ACGT")
    # reverse strand's last letter is tied between A and T: the later letter wins there, so both strands agree
    assert a.seq == "ACGT" and a.fa == [7, 7, 7, 6]


def test_strands_that_differ_give_n(spark):
    rows = [(1, "X", "F", 1, "AAN", "III"), (2, "X", "R", 1, "CAG", "III")]
    r = collapse_families(spark.createDataFrame(rows, SCHEMA), ["barcode"], "read_id").first()
    assert r.seq == "NAG" and r.pv[0] == 0 and r.fa == [0, 2, 1]


def test_null_and_empty_reads(spark):
    rows = [(1, None, "F", 1, None, None), (2, None, "F", 1, "AC", "II"), (3, "e", "F", None, "", "")]
    got = {r.barcode: r for r in collapse_families(spark.createDataFrame(rows, SCHEMA), ["barcode"], "read_id").collect()}
    assert got[None].fm == 2 and got[None].seq == "AC" and got["e"].seq is None and got["e"].fm == 1
    assert collapse_families(spark.createDataFrame([], SCHEMA), ["barcode"], "read_id").count() == 0


def test_marking(spark):
    raw = "read_id int, name string, seq string, qual string"
    r1 = spark.createDataFrame([(1, "a", "TTTTGACCC", "IIIIIIIII"), (2, "b", "AANNGACCC", "IIIIIIIII"), (3, "c", None, None)], raw)
    r2 = spark.createDataFrame([(1, "a", "ACGTGAAAA", "JJJJJJJJJ"), (2, "b", "ACGTGAAAA", "JJJJJJJJJ"), (3, "c", "ACGT", "JJJJ")], raw)
    got = {(r.read_id, r.mate): r for r in mark_inline(r1, r2, barcode_len=3, homing="TGA").collect()}
    assert (got[1, 1].barcode, got[1, 1].strand, got[1, 1].fp, got[1, 1].seq) == ("ACGTTT", "R", 1, "AAA")
    assert got[1, 2].seq == "CCC" and got[2, 1].fp == 0 and got[3, 1].barcode is None and got[3, 1].fp == 0
    ix = spark.createDataFrame([(1, "a", "CG", "II"), (2, "b", "CG", "II")], raw)
    s = {(r.read_id, r.mate): r for r in mark_secondary(r1, ix, r2, salt=2).collect()}
    assert s[1, 1].barcode == "TTCGAC" and s[1, 1].strand == "Z" and s[1, 2].seq == "GTGAAAA" and len(s) == 4


def test_rescale(spark):
    b = spark.createDataFrame([(1, 0, "A", 30), (1, 0, "N", 30), (1, 1, "A", 30)], "mate int, cycle int, base string, qual int")
    t = spark.createDataFrame([(1, 0, 30, "A", 400)], "mate int, cycle int, qual int, base string, new_qual int")
    assert sorted((r.cycle, r.base, r.qual) for r in rescale_quality(b, t).collect()) == [(0, "A", 93), (0, "N", 2), (1, "A", 30)]


def test_marked_families_by_hand(spark):
    """Seven reads, two of them reversed, with one letter astray in one: fm 7, rv 2, nf 1/7, duplex; and a lone read that failed."""
    s = "ACGTCAGGTTCTCAAA"
    rows = [(i, "AAAC", "R" if i < 2 else "F", 1, s if i != 3 else s[:5] + "T" + s[6:], "F" * 16) for i in range(7)] + [(9, "TTTT", "F", 0, s, "F" * 16)]
    got = {r.barcode: r for r in collapse_families(spark.createDataFrame(rows, SCHEMA), ["barcode"], "read_id").collect()}
    f, lone = got["AAAC"], got["TTTT"]
    assert (f.fm, f.rv, f.dr, f.fp, round(f.nf, 2), f.seq, f.strand_distance) == (7, 2, 1, 1, 0.14, s, 0) and f.fa == [7] * 5 + [6] + [7] * 10
    assert (lone.fm, lone.fp, lone.dr, lone.nf, lone.strand_distance) == (1, 0, 0, 0, None)


def test_lengths_of_a_family(spark):
    rows = [(1, "A", "F", 1, "ACGT", "IIII"), (2, "A", "F", 1, "ACG", "III"), (3, "A", "F", 0, "CGT", "III"), (4, "A", "F", 0, "TTACGT", "IIIIII"), (5, "A", "F", None, "AC", "II"), (6, "A", "F", 0, "", ""), (7, None, "F", 0, "AA", "II"), (8, None, "F", 0, "A", "I")]
    got = {r.read_id: (r.seq, r.qual) for r in align_lengths(spark.createDataFrame(rows, SCHEMA), ["barcode"], "read_id").collect()}
    assert got == {1: ("ACGT", "IIII"), 3: ("NCGT", "#III"), 4: ("ACGT", "IIII"), 6: ("", ""), 7: ("AA", "II"), 8: ("NA", "#I")}


def test_whole_reads_are_rescaled(spark):
    t = spark.createDataFrame([(1, 0, 40, "A", 10), (1, 2, 40, "G", 120), (2, 1, 40, "C", 7)], "mate int, cycle int, qual int, base string, new_qual int")
    r = spark.createDataFrame([(1, 1, "ACGN", "IIII"), (2, 2, "ACGT", "II"), (3, 3, "A", "I"), (4, 1, None, None), (5, 1, "", "")], "read_id int, mate int, seq string, qual string")
    got = {x.read_id: x.qual for x in rescale_reads(r, t).collect()}
    assert got == {1: "+I~#", 2: "I(", 3: "I", 4: None, 5: ""}


def test_files_to_files(spark, tmp_path):
    from readloom.plans import tools
    from readloom.sources import fastq

    mates = {1: [], 2: []}
    for i in range(12):
        for m in (1, 2):
            half = "AACC" if (i + m) % 2 else "GGTT"
            mates[m].append(f"@r{i}\n{half}TG{'ACGTACGT' if half == 'AACC' else 'TTTTCCCC'}\n+\n{'I' * 14}\n")
    for m in (1, 2):
        for lane in "ab":
            (tmp_path / f"{lane}_R{m}.fq").write_text("".join(mates[m][:6] if lane == "a" else mates[m][6:]))
    (tmp_path / "rescale.txt").write_text("\n".join("|".join([":".join(["20,20,20,20"] * 45)] * 2) for _ in range(8)) + "\n")
    f = tools.collapse_fastq(spark, str(tmp_path / "out"), str(tmp_path / "*_R1.fq"), str(tmp_path / "*_R2.fq"), barcode_len=4, homing="TG", rescaler=str(tmp_path / "rescale.txt"))
    rows = {r.mate: r for r in f.collect()}
    assert {m: (r.barcode, r.fm, r.rv, r.dr, r.fp, r.seq, set(r.qual)) for m, r in rows.items()} == {1: ("AACCGGTT", 12, 6, 1, 1, "ACGTACGT", {"5"}), 2: ("AACCGGTT", 12, 6, 1, 1, "TTTTCCCC", {"5"})}
    out = fastq.read_fastq(spark, str(tmp_path / "out" / "r2")).collect()
    assert [(r.name, r.seq) for r in out] == [("AACCGGTT", "TTTTCCCC")] and "FM:i:12" in out[0].comment
