import math
import os
import random

import pytest
from pyspark.sql import functions as F

from readloom.llm.mixing import mix_sources
from readloom.llm.percentiles import combine, exact_percentiles, summarise
from readloom.llm.tokens import RANKS, TOKENIZERS, WordTrie, encode_corpus, token_counts

need_files = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/{RANKS}"), reason="needs the vocabulary files")
QS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def test_percentiles_are_exact(spark):
    rng = random.Random(1)
    data = {"a": [rng.randrange(0, 10**13) for _ in range(400)], "b": [5] * 70, "c": [rng.choice([0, 1, 8 * 10**12, -3]) for _ in range(200)], "one": [7]}
    rows = [(k, v, 1) for k, vs in data.items() for v in vs] + [("a", None, 1), ("nulls", None, 1), (None, 3, 1)]
    got = {(r.k, r.q): (r.n, r.value) for r in exact_percentiles(spark.createDataFrame(rows, "k string, x bigint, v int").drop("v"), ["k"], "x", QS).collect()}
    want = {(k, q): (len(vs), sorted(vs)[max(1, math.ceil(q * len(vs))) - 1]) for k, vs in data.items() for q in QS}
    assert got == want
    assert exact_percentiles(spark.createDataFrame([], "k string, x bigint"), ["k"], "x", QS).count() == 0


@pytest.mark.parametrize("kind", ["double", "float", "decimal(10,3)", "smallint"])
def test_percentiles_of_other_numbers(spark, kind):
    rng = random.Random(8)
    vs = [0.25, 0.5, 0.75] if kind != "smallint" else [1, 2, 3]
    df = spark.createDataFrame([("k", float(v)) for v in vs], "q string, v double").select("q", F.col("v").cast(kind).alias("v"))
    assert [r.value for r in exact_percentiles(df, ["q"], "v", [0.5]).collect()] == [vs[1]]
    if kind == "double":
        vs = [rng.gauss(0, 1) * 10 ** rng.randrange(-300, 300) for _ in range(300)] + [0.0, float("inf"), -float("inf"), 5e-324, -1e-310, 1e308, 2.0**52, 2.0**52 + 1, 0.1, 0.1]
    elif kind == "decimal(10,3)":
        vs = [rng.randrange(-(10**9), 10**9) / 1000 for _ in range(300)]
    else:
        vs = [float(rng.randrange(-300, 300)) for _ in range(300)]
    rows = [("k", v) for v in vs] + [("k", None), (None, 1.0)] + ([("k", float("nan"))] if kind == "double" else [])
    df = spark.createDataFrame(rows, "e string, c double").select("e", F.col("c").cast(kind).alias("c"))
    got = {r.q: (r.n, float(r.value)) for r in exact_percentiles(df, ["e"], "c", QS).collect()}
    assert got == {q: (len(vs), sorted(vs)[max(1, math.ceil(q * len(vs))) - 1]) for q in QS}
    days = summarise(df.withColumn("day", F.lit(1)).withColumnRenamed("c", "x"), ["e"], ["day"], "x")
    assert {r.q: (r.n, float(r.value)) for r in combine(days, ["e"], QS, value="x").collect()} == got


def test_days_combine_within_the_stated_error(spark):
    rng = random.Random(2)
    rows = [(d, rng.randrange(0, 1000) * (d + 1)) for d in range(5) for _ in range(60 + 50 * d)]
    df = spark.createDataFrame(rows, "day int, x bigint").withColumn("k", F.lit("k"))
    got = combine(summarise(df, ["k"], ["day"], "x"), ["k"], QS, value="x").collect()
    vals = sorted(v for _, v in rows)
    for r in got:
        lo, hi = sum(v < r.value for v in vals) + 1, sum(v <= r.value for v in vals)
        assert lo - r.rank_error <= r["rank"] <= hi + r.rank_error
        assert r.n == len(vals) and r.rank_error <= len(vals) / 20 + 6


def test_combined_days_are_exact_in_heavy_tails(spark):
    rng = random.Random(4)
    rows = [(d, int(rng.paretovariate(0.3)) % 2**40) for d in range(7) for _ in range(300)]
    df = spark.createDataFrame(rows, "day int, x bigint").withColumn("k", F.lit("k"))
    qs = [0.05, 0.5, 0.95, 0.99, 0.999]
    vals = sorted(v for _, v in rows)
    got = {r.q: (r.n, r.value, r.rank_error) for r in combine(summarise(df, ["k"], ["day"], "x"), ["k"], qs, value="x").collect()}
    assert got == {q: (len(vals), vals[math.ceil(q * len(vals)) - 1], 0) for q in qs}


def test_values_without_a_day_are_counted(spark):
    rows = [("k", 1, 5), ("k", None, 7), ("k", None, 9), ("k", 2, None), (None, 1, 3), ("only", None, 4)]
    df = spark.createDataFrame(rows, "k string, day int, x bigint")
    got = {(r.k, r.q): (r.n, r.value) for r in combine(summarise(df, ["k"], ["day"], "x"), ["k"], [0.5, 1.0], value="x").collect()}
    assert got == {(r.k, r.q): (r.n, r.value) for r in exact_percentiles(df, ["k"], "x", [0.5, 1.0]).collect()}
    assert got == {("k", 0.5): (3, 7), ("k", 1.0): (3, 9), ("only", 0.5): (1, 4), ("only", 1.0): (1, 4)}


@need_files
def test_trie_equals_the_library():
    import regex
    from tokenizers import Tokenizer

    from readloom.llm.tokens import SPLIT

    ref = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    words += ["internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é" * 30, "数字" * 9, "____________", "#" * 300, " hello", " " * 50, "\n\n\n"]
    words = [w for w in words if regex.findall(SPLIT, w) == [w]]
    got = WordTrie(f"{TOKENIZERS}/{RANKS}").encode_words([w.encode() for w in words])
    for w in words:
        assert got[w.encode()] == ref.encode(w, add_special_tokens=False).ids, w


@need_files
def test_corpus_encoding_of_odd_texts(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    texts = [None, "", " ", "<|endoftext|> plain", "naïve 👨‍👩‍👧 don't I'LL​\xa0x", "a" * 50_000, "word " * 9000, "\x00\x0b\r\n", "मस्ते 日本 \U0001f600", "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode(t, add_special_tokens=False).ids if t else [])
    n = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "text").collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.where("false"), "doc_id", "text").count() == 0


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, size bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    sel, rep = mix_sources(d, t, **kw)
    return [tuple(r) for r in sel.collect()], {r.source: r for r in rep.collect()}


def test_mix_reaches_the_shares(spark):
    rng = random.Random(5)
    docs = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 30)] + [(5000, "other", 10), (5001, None, 10), (5002, "big", 0), (5003, "big", None)]
    targets = [("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 3)]
    sel, rep = mixed(spark, docs, targets)
    assert {s for _, s, _, _ in sel} == {"big", "mid", "small"} and len({i for i, *_ in sel}) == len(sel)
    cap = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r <= cap[s] for _, s, _, r in sel)
    total = sum(n * r for _, _, n, r in sel)
    for s, w in (("big", 0.4), ("mid", 0.3), ("small", 0.2)):
        got = sum(n * r for _, x, n, r in sel if x == s)
        assert got == rep[s].taken and abs(got - w / 0.9 * total) <= 60 and abs(rep[s].reached_share - w / 0.9) < 0.02
    assert rep["absent"].taken == 0 and rep["absent"].reached_share == 0
    few, _ = mixed(spark, docs, targets, total=total / 2)  # nested
    have = {i: r for i, _, _, r in sel}
    assert all(have.get(i, 0) >= r for i, _, _, r in few)


def test_mix_shortfall_ties_and_empty(spark):
    sel, rep = mixed(spark, [(1, "a", 10), (1, "a", 10), (2, "b", 10)], [("a", 0.5, 1), ("b", 0.5, 1), ("b", 0.1, 9)], total=1000.0)
    assert rep["a"].taken == 20 and rep["b"].taken == 10 and len(sel) == 3
    assert mixed(spark, [], [("a", 1.0, 2)])[0] == []
    assert mixed(spark, [(1, "a", 3)], [])[0] == []
