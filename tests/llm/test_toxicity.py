import random

import numpy as np
from pyspark.sql import functions as F

from readloom.llm.restore import Restorer, letter_model, tidy
from readloom.llm.toxicity import fit_toxicity, score_toxicity

GOOD = ["the pump works fine after the repair", "please clean the filter before use", "I bought a new lamp at the market", "we measured the shelf twice", "thanks for the manual, it helped", "the asparagus in the garden is dead", "kill the process and restart", "what an idiot I was to trust my notes"]
BAD = ["you are a stupid idiot and everybody knows it", "shut up you miserable bastard", "get lost you worthless moron", "drop dead you filthy scumbag"]
DISGUISED = ["you are a stupid 1d10t and everybody knows it", "shut up you miserable b a s t a r d", "get lost you worthless mmmmoron", "drop dead you filthy scum​bag", "shut up you miserable b<b>ast</b>ard", "get lost you worthless m*ron"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        parts = [rng.choice(GOOD) for _ in range(rng.randrange(1, 4))]
        bad = rng.random() < 0.4
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(BAD))
        docs.append((i, ". ".join(parts)))
        labels += [(i, f"r{k}", int(bad if rng.random() < 0.95 else not bad)) for k in range(2)] + [(i, "r9", None)]
    return docs, labels


def test_held_out_accuracy_and_disguises(spark):
    docs, labels = corpus(300)
    base = len(docs)
    extra = [(base + i, f"{GOOD[i % 8]}. {t}.") for i, t in enumerate(DISGUISED)] + [(base + 50 + i, f"{t}. {GOOD[3]}") for i, t in enumerate(GOOD)] + [(900, None), (901, ""), (902, "   "), (903, "x" * 30_000 + ". " + BAD[1]), (904, BAD[0]), (904, BAD[0])]
    d = spark.createDataFrame(docs + extra, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels[:600] + labels[:9], "doc_id bigint, rater string, toxic int")
    model = fit_toxicity(d.select("doc_id", "text"), lab)
    rows = score_toxicity(d, model).collect()
    assert len(rows) == len(docs) + len(extra)
    s = {r.doc_id: r.score for r in rows}
    truth = {i: any(b in t for b in BAD) for i, t in docs}
    held = [i for i in truth if i >= 200]
    assert np.mean([(s[i] >= 0.35) == truth[i] for i in held]) > 0.95
    assert [s[base + i] >= 0.35 for i in range(len(DISGUISED))] == [True] * len(DISGUISED)
    assert all(s[base + 50 + i] < 0.35 for i in range(len(GOOD)))
    assert s[900] == s[901] == s[902] == 0 and s[903] >= 0.35


def test_no_labels_and_empty_corpus(spark):
    d = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, rater string, toxic int")
    m = fit_toxicity(d, lab)
    assert [r.score < 0.1 for r in score_toxicity(d, m).collect()] == [True]
    assert score_toxicity(d.where("false"), fit_toxicity(d.where("false"), lab)).count() == 0


def test_restoring(spark):
    words = "asshole bastard loser stupid idiot dipshit moron people trust parser freezer crappy weather rather " * 30
    r = Restorer(letter_model(spark.createDataFrame([(words,)], "text string"), "text"))
    for disguised, plain in (("4$$h0l3", "asshole"), ("b_a_s_t_a_r_d", "bastard"), ("lllloser", "loser"), ("st*pid", "stupid"), ("d1p$h1t", "dipshit"), ("mor0n,", "moron"), ("raaaather", "rather"), ("people", "people"), ("X", "X")):
        assert r(disguised) == plain
    assert tidy("b&shy;ad руѕѕу <b>xy</b> f u c k &amp; @user.name http://a.b/c").split() == ["bad", "pyssy", "xy", "fuck", "&", "@"]


def spelling(spark):
    words = "you are nothing but a parasite and an idiot with bad shit in the house it is not a stupid moron people clean bellows who told his part of that " * 1000
    return Restorer(letter_model(spark.createDataFrame([(words,)], "text string"), "text"))


def test_blanks_inside_words(spark):
    r = spelling(spark)
    for spaced, plain in (
        ("nothing but a p a r a s i t e", "nothing but a parasite"), ("an i d 1 0 t", "an idiot"), ("s h * t", "shit"), ("you id iot.", "you idiot."), ("a  s t u  p i d  moron", "a stupid moron"),
        ("you are not a clean house", "you are not a clean house"), ("it is part of that", "it is part of that"), ("3 4 5 and 1 x 2", "3 4 5 and 1 x 2"),
    ):
        assert r.respace(spaced) == plain


def test_long_tokens_are_decoded(spark):
    r = spelling(spark)
    assert r("idi" + "o" * 60 + "t") == "idiot" and r("stup" + "1" * 50 + "d") == "stupid"
    assert r("you_are_nothing_but_a_p4r4s1te/and_an_1d10t.with_b4d.people").split() == "you are nothing but a parasite and an idiot with bad people".split()
    assert r("1d10t_" * 5000 + "mor0n").split() == ["idiot"] * 5000 + ["moron"]
    assert r("id1ot" + "*" * 9000 + "m0ron").split() == ["idiot", "moron"]


def test_letters_with_marks_and_masked_first_letters(spark):
    words = "tu es un vrai cretin et un idiot stupid people bastard moron loser wichser " * 1000
    r = Restorer(letter_model(spark.createDataFrame([(words,)], "text string"), "text"))
    for disguised, plain in (("crét1n", "crétin"), ("wíchs3r", "wíchser"), ("ídi0t", "ídiot"), ("*diot", "idiot"), ("*tupid", "stupid"), ("*idiot*", "idiot"), ("**moron**", "moron"), ("дурак", "дурак"), ("m0ronд", "moronд")):
        assert r(disguised) == plain
    assert r.respace("vrai c r é t i n").split()[-1] in ("crétin", "cretin")


def test_arrays_of_contexts_decode_like_the_table(spark, monkeypatch):
    from readloom.llm import restore

    r = spelling(spark)
    rng = random.Random(7)
    for _ in range(25):
        word = rng.choice(["parasite", "idiot", "bastard", "stupid", "people"])
        w = "".join(rng.choice("*_.0") + c if rng.random() < 0.2 else "*" if rng.random() < 0.35 else c for c in word)
        opts = r._options("b" + w + "n")
        monkeypatch.setattr(restore, "MANY", 1 << 20)
        cost, text = r._best(opts)
        monkeypatch.setattr(restore, "MANY", 3)
        dense, other = r._best(opts)
        assert abs(cost - dense) < 1e-3 and (text == other or abs(cost - dense) < 1e-3)


def test_markup_of_any_length_goes():
    assert tidy('a<a href="' + "x" * 5000 + '">b</a> [url=' + "y" * 3000 + "]c[/url] 1 < 2 [quote=z" + "w" * 400 + "]d").split() == ["ab", "c", "1", "<", "2", "d"]
