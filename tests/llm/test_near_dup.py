import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm.near_dup import near_duplicates
from readloom.llm import setjoin
from readloom.llm.setjoin import EditCheck, Sets, flat_letters, gram_parity, letter_grams, metric_join, near_pivots, rotated, within_edits

SCHEMA = "read_id bigint, lib int, mate int, barcode string, seq string, tile int, x int"


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def turn(s):
    return s[len(s) // 2 :] + s[: len(s) // 2]


def grams(s, k=6):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def brute(rows):
    seen = {}
    for r in rows:
        if None not in r[:5] and r[3].strip() and len(r[4]) >= 6:
            seen[r[0]] = (r[1], r[2], r[3].strip().upper(), r[4].upper())
    out = set()
    ids = sorted(seen)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = seen[i], seen[j]
            if a[:2] != b[:2]:
                continue
            x, y = grams(a[3]), grams(b[3])
            if 2 * len(x & y) < len(x | y):
                continue
            if min(lev(a[2], b[2]), lev(turn(a[2]), b[2]), lev(a[2], turn(b[2]))) <= 2:
                out.add((i, j))
    return out


def edit(rng, s, n, letters="ACGT"):
    s = list(s)
    for _ in range(n):
        k, i = rng.random(), rng.randrange(len(s)) if s else 0
        if k < 0.4 and s:
            s[i] = rng.choice(letters)
        elif k < 0.7 and s:
            del s[i]
        else:
            s.insert(i, rng.choice(letters))
    return "".join(s)


def sample(rng, n):
    rows, rid = [], 0
    word = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    while len(rows) < n:
        barcode, seq = rng.choice(["G" * 18, word(rng.choice([5, 12, 13, 14, 18, 20]))]), word(rng.choice([12, 40, 90]))
        lib, mate = rng.randrange(1, 3), rng.randrange(1, 3)
        for _ in range(rng.randrange(1, 9)):
            b = edit(rng, barcode, rng.randrange(0, 4), "ACGTN")
            if rng.random() < 0.2:
                b = turn(b)
            s = edit(rng, seq, rng.randrange(0, 5), "ACGTN")
            if rng.random() < 0.2:
                s = turn(s)
            rows.append((rid, lib if rng.random() < 0.95 else 3 - lib, mate, rng.choice([b, b.lower(), f" {b} "]), rng.choice([s, s.lower()]), 0, 0))
            rid += 1
    return rows


def pairs(df, **kw):
    got = near_duplicates(df, "read_id", ["lib", "mate"], F.upper(F.trim("barcode")), F.upper("seq"), **kw).collect()
    assert len(got) == len(set(got))
    return {(r.id_a, r.id_b) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = sample(rng, 350)
    rows += rows[:15]  # delivered twice
    want = brute(rows)
    assert len(want) > 100
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == want
    assert pairs(df, tile=20, leaf=8, key_tile=50) == want  # hot regions divided by pivots in stages, hot keys dealt to parts


def test_defined_cases(spark):
    s = "ACGTACGTTGCAAACC"
    rows = [(1, 1, 1, None, s, 0, 0), (2, None, 1, "AC", s, 0, 0), (3, 1, 1, " ", s, 0, 0), (4, 1, 1, "ACGT", "ACGTA", 0, 0), (5, 1, 1, "ACGT", None, 0, 0), (6, 1, 1, "ACGT", s, 0, 0), (7, 1, 1, "acgt ", s.lower(), 0, 0), (8, 1, 2, "ACGT", s, 0, 0), (9, 1, 1, "GTAC", s, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == brute(rows) == {(6, 7), (6, 9), (7, 9)}
    assert pairs(df.where("false")) == set()


def test_very_long_texts_and_other_letters(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ACGTé漢😀xyz") for _ in range(30_000))
    rows = [(1, 1, 1, "B" * 200, long, 0, 0), (2, 1, 1, "B" * 199 + "Z", long[:20_000], 0, 0), (3, 1, 1, "é漢" * 20, "é漢😀é漢😀漢", 0, 0), (4, 1, 1, "é漢" * 20, "é漢😀é漢😀漢", 0, 0)]
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == {(1, 2), (3, 4)}


def test_many_copies_of_one_read(spark):
    rows = [(i, 1, 1, "ACGTACGTACGT", "ACGTTGCAACGGATC", 0, 0) for i in range(120)]
    assert len(pairs(spark.createDataFrame(rows, SCHEMA), tile=32, leaf=16)) == 120 * 119 // 2


def similar(texts, i, j, least):
    a, b = grams(texts[i]), grams(texts[j])
    return bool(a and b) and len(a & b) >= least * len(a | b)


@pytest.mark.parametrize("dense", [1 << 28, 0])
@pytest.mark.parametrize("letters", ["ACGT", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_metric_join_is_exact_with_and_without_clusters(monkeypatch, dense, letters):
    monkeypatch.setattr(setjoin, "DENSE_BYTES", dense)  # bit sets and sorted runs
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    texts = [edit(rng, c, rng.randrange(0, 9), letters) for c in [word(90) for _ in range(12)] for _ in range(20)] + [word(90) for _ in range(90)] + ["", "ACG"]
    group = np.sort(np.array([rng.choice([0, 0, 0, 1, 2]) for _ in texts]))
    mask = np.array([rng.choice([0, 0, 1]) for _ in texts])
    sets = Sets(*flat_letters(texts), 6)
    for least, leaf in ((0.5, 16), (0.5, 1 << 20), (0.8, 16)):
        want = sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if group[i] == group[j] and not mask[i] & mask[j] and similar(texts, i, j, least))
        got = [(min(x, y), max(x, y)) for i, j in metric_join(sets, group, np.arange(len(texts)), mask, least, leaf=leaf) for x, y in zip(i.tolist(), j.tolist())]
        assert sorted(got) == want  # each pair once
    i, q, d = near_pivots(sets, np.arange(len(texts)), np.arange(0, len(texts), 7), 0.7)
    assert {(x, 7 * y) for x, y in zip(i.tolist(), q.tolist())} == {(x, y) for x in range(len(texts)) for y in range(0, len(texts), 7) if similar(texts, x, y, 0.3)}


@pytest.mark.parametrize("letters", ["ACGT", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_short_barcodes_and_many_letters(spark, letters):
    """Barcodes of up to 12 letters, most of one length, and more than 16 different letters."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    seqs = [word(60) for _ in range(25)]
    rows = []
    for n in (1, 2, 3, 4, 6, 9, 12, 12, 12, 15):
        for _ in range(4):
            b, s = word(n), rng.choice(seqs)
            for _ in range(7):
                x = edit(rng, b, rng.randrange(0, 3), letters)
                rows.append((len(rows), 1, 1, turn(x) if rng.random() < 0.2 else x, edit(rng, s, rng.randrange(0, 4), letters), 0, 0))
    want = brute(rows)
    assert len(want) > 100
    assert pairs(spark.createDataFrame(rows, SCHEMA)) == want


def test_one_barcode_of_half_the_rows(spark):
    """A hot barcode with molecules of very uneven size and unrelated reads goes through rounds of pivots, recursion and pairs of tiles."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    rows = []
    for n in (150, 60, 30, *[1] * 160):
        s = word(80)
        rows += [(len(rows) + i, 1, 1, "ACGTACGTACGTACGT", edit(rng, s, rng.randrange(0, 4)), 0, 0) for i in range(n)]
    rows += [(len(rows) + i, 1, 1, word(16), word(80), 0, 0) for i in range(400)]
    rows += [(len(rows) + i, 1, 1, edit(rng, "ACGTACGTACGTACGT", 1), edit(rng, rows[i][4], 2), 0, 0) for i in range(40)]
    want = brute(rows)
    assert len(want) > 10_000
    assert pairs(spark.createDataFrame(rows, SCHEMA), tile=160, leaf=32) == want


def test_edit_checks_and_sketches():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 15))) for _ in range(60)]
    texts += [edit(rng, t, rng.randrange(0, 4), "ACGTN") for t in texts] + ["A" * 64, "A" * 66, "A" * 65 + "C", ""]
    flat, off = flat_letters(texts)
    n = np.diff(off)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    want = np.array([lev(texts[a], texts[b]) <= 2 for a, b in zip(i, j)])
    assert (EditCheck(flat, off[:-1], n).within(i, j) == want).all()
    assert (within_edits(flat, off[:-1][i], n[i], flat, off[:-1][j], n[j]) == want).all()
    sk = gram_parity(flat, off)
    assert (np.bitwise_count(sk[i] ^ sk[j])[want] <= 12).all()
    assert "".join(map(chr, rotated(flat, off))) == "".join(map(turn, texts))
    g = letter_grams(flat_letters(["abcabc"])[0], 3)[0]
    assert g[0] == g[3] and len(set(g[:4])) == 3
