import gzip
import random
import struct

import pytest

from readloom.plans import catalog
from readloom.sources import bam, bed, fasta, fastq, reports, sam, vcf

FQ = "@r1 1:N:0:ACGT\nACGT\n+\nIIII\n@r2\nNN\n+\n##\n"


def test_fastq_round_trip(spark, tmp_path):
    (tmp_path / "x_R1.fq").write_text(FQ)
    (tmp_path / "x_R2.fq.gz").write_bytes(gzip.compress((FQ + "@r3\nA\n+\nI\n").encode()))
    a, b = fastq.read_fastq(spark, str(tmp_path / "x_R1.fq")), fastq.read_fastq(spark, str(tmp_path / "x_R2.fq.gz"))
    assert [(r.read_id, r.name, r.comment, r.seq, r.qual) for r in a.collect()] == [(0, "r1", "1:N:0:ACGT", "ACGT", "IIII"), (1, "r2", None, "NN", "##")]
    assert fastq.pair_reads(a, b).count() == 2
    assert [r.n for r in fastq.record_count(b).collect()] == [3]
    fastq.write_fastq(a.coalesce(1), str(tmp_path / "out"), compression="gzip")
    back = fastq.read_fastq(spark, str(tmp_path / "out" / "*.gz"))
    assert sorted((r.name, r.seq) for r in back.collect()) == [("r1", "ACGT"), ("r2", "NN")]
    assert [r.name for r in fastq.interleave(fastq.pair_reads(a, b)).collect()] == ["r1", "r1", "r2", "r2"]


def test_broken_fastq_names_the_record(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nA\n+\nI\nb\nA\n+\nI\n")
    with pytest.raises(Exception, match="no record at byte 9"):
        fastq.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_fastq_in_ranges_is_the_same_file(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(f"@{'@' * rng.randrange(3)}n{i} c\n{'ACGT' * n}{'A' * m}\n+{'@x' * (i % 2)}\n{''.join(rng.choice('@+I#') for _ in range(4 * n + m))}\n" for i in range(400) for n, m in [(rng.randrange(1, 6), rng.randrange(4))])
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "packed").write_bytes(gzip.compress(text[:9000].rsplit("\n@", 1)[0].encode() + b"\n") * 2)  # members of a gzip stream, no suffix
    whole = [tuple(r) for r in fastq.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("read_id").collect()]
    assert len(whole) == 400 and [r[1] for r in whole] == list(range(400))
    for split in (97, 1000, 4096):
        assert [tuple(r) for r in fastq.read_fastq(spark, str(tmp_path / "a.fq"), split=split).orderBy("read_id").collect()] == whole
    n = fastq.read_fastq(spark, str(tmp_path / "packed")).count()
    assert n > 100 and fastq.read_fastq(spark, str(tmp_path / "packed"), split=500).count() == n


def test_lanes_are_paired_apart(spark, tmp_path):
    rec = lambda n: "".join(f"@{n}{i}\nACGT\n+\nIIII\n" for i in range(3))
    for name in ("s_L1_R1_001.fastq", "s_L1_R2_001.fastq", "s_L2_R1_001.fastq", "s_L2_R2_001.fastq"):
        (tmp_path / name).write_text(rec(name[2:4]))
    r1, r2 = (fastq.read_fastq(spark, str(tmp_path / f"*_R{m}_001.fastq")) for m in (1, 2))
    p = fastq.pair_reads(r1, r2)
    assert sorted((r.lane, r.read_id) for r in p.collect()) == [(f"s_{x}", i) for x in ("L1", "L2") for i in range(3)]
    assert {r.read_id for r in fastq.as_mates(p)[0].collect()} == {f"s_{x}:{i}" for x in ("L1", "L2") for i in range(3)}


def test_marked_comments(spark):
    df = spark.createDataFrame([("~#!#~|FP=0|BS=RACGT|RV=1",), (None,)], "comment string")
    got = [tuple(r)[1:] for r in fastq.parse_marked(df).collect()]
    assert got[0] == (0, "R", "ACGT") and got[1] == (None, None, None)


def test_bed(spark, tmp_path):
    (tmp_path / "r.bed").write_text("# c\ntrack x\n\n1\t5\t9\tname\n2 7\n3\tx\t9\n4\t9\t5\n")
    good, bad = bed.read_bed(spark, str(tmp_path / "r.bed"))
    assert [tuple(r) for r in good.collect()] == [("1", 5, 9, "name"), ("2", 6, 7, None)]
    assert bad.count() == 2
    good, bad = bed.read_bed(spark, str(tmp_path / "r.bed"), named=True)
    assert [tuple(r) for r in good.collect()] == [("1", 5, 9, "name")] and bad.count() == 3


def test_sam_round_trip(spark, tmp_path):
    line = "q\t99\t1\t11\t60\t4M\t=\t31\t24\tACGT\tIIII\tFM:i:3\tPV:B:I,40,41,42,43\tNF:f:0.25\tXX:Z:a:b"
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:1\tLN:99\n" + line + "\nu\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    got = {r.qname: r for r in sam.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    q = got["q"]
    assert (q.pos, q.mate_contig, q.mate_pos, q.fm, q.pv, q.nf, q.aux) == (10, "1", 30, 3, [40, 41, 42, 43], 0.25, {"XX": "a:b"})
    assert got["u"].contig is None and got["u"].fm is None and got["u"].aux == {}
    assert sam.read_header(spark, str(tmp_path / "a.sam")).count() == 2
    head = sam.merged_header(spark, [str(tmp_path / "a.sam")], program="x")
    sam.write_sam(sam.read_sam(spark, str(tmp_path / "a.sam")), str(tmp_path / "o"), header=head)
    again = {r.qname: r for r in sam.read_sam(spark, str(tmp_path / "o")).collect()}
    assert again["q"] == q and again["u"] == got["u"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("[0p]*")))
    assert text.splitlines()[:3] == ["@HD\tVN:1.6", "@SQ\tSN:1\tLN:99", "@PG\tID:x\tPN:x"] and line in text
    (tmp_path / "b.sam").write_text("@SQ\tSN:1\tLN:98\nbroken\nq\tx\t1\t11\t60\t4M\t=\t31\t24\tACGT\tIIII\n" + line + "\tFM:i:many\n")
    assert [r.fm for r in sam.read_sam(spark, str(tmp_path / "b.sam")).collect()] == [None] and sam.bad_sam_lines(spark, str(tmp_path / "b.sam")).count() == 2
    with pytest.raises(ValueError, match="SQ 1"):
        sam.merged_header(spark, [str(tmp_path / "a.sam"), str(tmp_path / "b.sam")], program="x")


def packed_bam(records, contigs=("1", "2")):
    """BAM bytes of (name, flag, contig number, pos, mapq, cigar, mate, mate_pos, isize, seq, quals, tags) in several gzip members."""
    text = b"@HD\tVN:1.6\n@SQ\tSN:1\tLN:99\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for c in contigs:
        out += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 99)
    for name, flag, ref, pos, mapq, cigar, mate, mate_pos, size, seq, quals, tags in records:
        code = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), mate, mate_pos, size) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar) + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2])) + bytes(quals) + tags
        out += struct.pack("<i", len(body)) + body
    return b"".join(gzip.compress(out[i : i + 70]) for i in range(0, len(out), 70))


def test_bam_has_the_columns_of_sam(spark, tmp_path):
    tags = b"FMC\x03" + b"PVBI" + struct.pack("<i3I", 3, 40, 300, 3117) + b"NFf" + struct.pack("<f", 0.25) + b"XXZa b\0" + b"XYs" + struct.pack("<h", -5) + b"XAAq"
    recs = [("q1", 99, 0, 10, 60, [(1, "S"), (2, "M")], 0, 30, 24, "ACN", [40, 41, 2], tags), ("u", 4, -1, -1, 0, [], -1, -1, 0, "", [], b""), ("n", 0, 1, 5, 9, [(2, "M")], 1, 7, 0, "GT", [255, 255], b"")]
    (tmp_path / "a.bam").write_bytes(packed_bam(recs))
    got = {r.qname: r for r in bam.read_bam(spark, str(tmp_path / "a.bam")).collect()}
    q = got["q1"]
    assert (q.flag, q.contig, q.pos, q.mapq, q.cigar, q.mate_contig, q.mate_pos, q.isize, q.seq, q.qual) == (99, "1", 10, 60, "1S2M", "1", 30, 24, "ACN", "IJ#")
    assert (q.fm, q.pv, q.nf, q.aux) == (3, [40, 300, 3117], 0.25, {"XX": "a b", "XY": "-5", "XA": "q"})
    assert (got["u"].contig, got["u"].seq, got["u"].cigar, got["n"].qual, got["n"].contig) == (None, None, None, None, "2")
    assert bam.bam_header(f"file://{tmp_path}/a.bam")[1] == "@SQ\tSN:1\tLN:99"
    sam.write_sam(bam.read_bam(spark, str(tmp_path / "a.bam")), str(tmp_path / "s"))
    again = {r.qname: r for r in sam.read_sam(spark, str(tmp_path / "s")).collect()}
    assert again["q1"] == q and again["n"] == got["n"]
    (tmp_path / "x.bam").write_bytes(gzip.compress(b"no such thing"))
    with pytest.raises(Exception, match="is no BAM file"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).collect()


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n1\t5\trs\tA\tC,G\t9.5\tPASS\tDP=7;FLAG;OK=0,0,1\tGT\t0/1\n2\t1\t.\tT\t.\t.\t.\t.\n")
    v = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    a, b = sorted(v.collect(), key=lambda r: r.contig)
    assert (a.pos, a.alleles, a.qual, a.info["DP"], a.info["FLAG"]) == (4, ["A", "C", "G"], 9.5, "7", "") and b.alleles == ["T"]
    assert vcf.passing(v, "OK").count() == 1
    vcf.write_vcf(v, str(tmp_path / "o"))
    assert sorted(r.pos for r in vcf.read_vcf(spark, str(tmp_path / "o")).collect()) == [0, 4]


def test_calls_as_vcf(spark, tmp_path):
    rows = [("1", 4, "A", True, True, 5, 1, 0.625, "t"), ("1", 4, "C", False, False, 3, 0, 0.375, "t"), ("1", 4, "A", True, True, 7, 0, 1.0, "n"), ("1", 9, "G", False, True, 2, 0, 1.0, "n")]
    c = spark.createDataFrame(rows, "contig string, ref_pos int, base string, is_ref boolean, pass boolean, n_pass bigint, n_failed bigint, allele_fraction double, sample string")
    rec = vcf.variant_records(c, "sample", fields=("n_pass", "allele_fraction"))
    head = vcf.vcf_header(["pass", "n_pass", "allele_fraction"], ["n", "t"], contigs=[("1", 50)])
    vcf.write_vcf(rec, str(tmp_path / "o"), header=head)
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("[0p]*")))
    assert text.splitlines()[-3:] == ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tn\tt", "1\t5\t.\tA\tC\t.\t.\tPASS=1,0\tN_PASS:ALLELE_FRACTION\t7,0:1.000000,0\t5,3:0.625000,0.375000", "1\t10\t.\tN\tG\t.\t.\tPASS=0,1\tN_PASS:ALLELE_FRACTION\t0,2:0,1.000000\t0,0:0,0"]
    back = vcf.read_vcf(spark, str(tmp_path / "o"))
    assert {(r.pos, r.allele): r.value for r in vcf.allele_table(back, "N_PASS", sample=1).collect()} == {(4, "A"): 5.0, (4, "C"): 3.0, (9, "N"): 0.0, (9, "G"): 0.0}
    assert vcf.passing(back, "PASS").count() == 1


def test_region_scan_prunes(spark, tmp_path):
    a = spark.range(0, 4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS contig", "cast(id * 10 AS int) AS pos", "cast(id * 10 + 15 AS int) AS endpos")
    reports.write_alignments(a, str(tmp_path / "a"), program="p")
    r = spark.createDataFrame([("x", 100, 125), ("x", 30000, 30001)], "contig string, start_pos int, end_pos int")
    got = reports.read_regions(spark, str(tmp_path / "a"), r)
    assert sorted(x.id for x in got.collect()) == [10, 12, 3000]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(contig" in plan and "GreaterThan(endpos,100)" in plan


def test_fasta_and_rescaler(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 text\nacg\nT\n>c2\nNN\n")
    assert sorted(tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "r.fa")).collect()) == [("c1", "ACGT"), ("c2", "NN")]
    long = "".join(random.Random(1).choice("acgt") for _ in range(2 * fasta.PIECE + 77))
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress((">c9 x\n" + "\n".join(long[i : i + 60] for i in range(0, len(long), 60)) + "\n>c8\nAC\n").encode()))
    from readloom.operators.errors import reference_pieces

    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(fasta.read_fasta_pieces(spark, str(tmp_path / "g.fa.gz"))) == key(reference_pieces(fasta.read_fasta(spark, str(tmp_path / "g.fa.gz"))))
    (tmp_path / "s.txt").write_text("10.5,0,99,20:1,2,3,4|5,6,7,8:9,9,9,9\n3,3,3,3:3,3,3,3|4,4,4,4:4,4,4,4\n")
    got = {(r.mate, r.cycle, r.qual, r.base): r.new_qual for r in fasta.read_rescaler(spark, str(tmp_path / "s.txt")).collect()}
    assert got[1, 0, 2, "A"] == 11 and got[1, 0, 2, "C"] == 2 and got[1, 0, 2, "G"] == 93 and got[2, 0, 3, "T"] == 9 and got[2, 1, 2, "A"] == 4 and len(got) == 32
    fasta.write_rescaler(fasta.read_rescaler(spark, str(tmp_path / "s.txt")), str(tmp_path / "w"))
    back = {(r.mate, r.cycle, r.qual, r.base): r.new_qual for r in fasta.read_rescaler(spark, str(tmp_path / "w")).collect()}
    assert all(back[k] == v for k, v in got.items())
    beyond = spark.createDataFrame([(1, 0, 47, "A", 40)], "mate int, cycle int, qual int, base string, new_qual int")
    with pytest.raises(ValueError, match="no place"):
        fasta.write_rescaler(beyond, str(tmp_path / "w2"))
    with pytest.raises(Exception, match="quality 0 at cycle 0"):
        fasta.check_rescaler(beyond.withColumn("new_qual", beyond["new_qual"] * 0)).collect()


def test_the_rescaler_is_evaluated_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cube = spark.createDataFrame([(1, "A", 30, 0, 200, 2), (2, "C", 20, 1, 300, 3)], "mate int, base string, qual int, cycle int, obs bigint, err bigint")
    monkeypatch.setattr(catalog, "_error_cube", lambda spark, d: cube.mapInArrow(counted, cube.schema))
    got = {(r.mate, r.cycle, r.qual, r.base): r.new_qual for r in catalog.QUERIES["io_rescaler"](spark, "").collect()}
    assert len(got) == 720 and got[1, 0, 30, "A"] == 20 and got[1, 0, 30, "C"] == 30
    assert seen.value == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5), (1, None)], "k int, rate double")
    reports.write_tsv(df.coalesce(1), str(tmp_path / "t"), decimals=3, order=["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("*.csv")))
    assert "2\t0.500" in text and text.startswith("k\trate")
    reports.write_split(df, df["k"] > 1, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("passed=*")} == {"passed=true", "passed=false"}
