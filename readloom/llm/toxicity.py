"""Scores of abusive, hateful or sexual content, learned from human judgements over restored text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.restore import LONG, Restorer, clean, letter_model
from readloom.llm.setjoin import distinct
from readloom.session import ship

#: Judged documents that the classifier is fitted on at most (by hash of the id).
MAX_LABELLED = 20_000
#: Letters of a judged document beyond which it isn't used to fit.
MAX_LETTERS = 20_000
BITS = 19
#: A passage is a sentence of at most WINDOW + 4 words, or one of the windows of WINDOW words, half overlapping, of a longer one; a document
#: is scored by its worst passage, so its length doesn't thin out what it says.
WINDOW = 8
ROUNDS, STEPS = 4, 30
#: Strength of the pull of weights to 0, and judged documents that must hold a feature for it to count.
RIDGE, MIN_DOCS = 0.03, 3
THRESHOLD = 0.35

_stop = re.compile(r"[.!?;:\n\r\x0b\x0c。！？]+(?=\s|$|[\"')\]])|\n|[。！？]")
_wide = re.compile(r"[぀-ヿ㐀-鿿가-힯]+")
_word = re.compile(r"[^\W_]+")

# Plain words of abuse; each counts as one common feature besides its own weight.
ABUSE = frozenset(
    """arse arsehole arseholes ass asshole assholes bastard bastards bellend bitch bitches cocksucker cretin cunt cunts dickhead dickheads dimwit
    dimwits dipshit douche douchebag douchebags dumbass dumbasses faggot fatso fuckface fucktard fuckwit halfwit idiot idiots imbecile imbeciles
    jackass jackasses jerk knobhead loser losers maggot maggots moron morons motherfucker nitwit numbskull parasite parasites pig prick pricks
    retard retards scum scumbag scumbags shithead shitheads skank slut sluts slag tosser trash tramp twat twats vermin wanker wankers whore whores
    worm subhuman cockroaches animals plague filth
    arschloch idiot vollidiot hurensohn wichser schlampe missgeburt fotze abschaum drecksau trottel depp
    connard connards salope abruti abrutis crétin pute enculé débile ordure
    gilipollas imbécil idiota cabrón puta zorra mierda basura pendejo
    debilu kretynie kurwa idioto szmata dziwko""".split()
)


def _key(w: str) -> int:
    return zlib.crc32(w.encode())


class Passages:
    """Passages of a text as hashed features: words, pairs and triples of neighbouring words, and the abuse list."""

    def __init__(self, model: np.ndarray):
        self.restore = Restorer(model)
        self.keys: dict[str, int] = {}
        self.chunks: dict[str, list[str]] = {}

    def words(self, sentence: str) -> list[str]:
        out, known = [], self.chunks
        for chunk in sentence.split():
            got = known.get(chunk)
            if got is None:
                got = self._chunk(chunk)
                if len(chunk) <= LONG:
                    if len(known) > 300_000:
                        known.clear()
                    known[chunk] = got
            out += got
        return out

    def _chunk(self, chunk: str) -> list[str]:
        out = []
        if chunk.startswith("@"):
            out.append("@")
            chunk = chunk[1:]
        if _wide.search(chunk):
            for run in _wide.findall(chunk):
                out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            chunk = _wide.sub(" ", chunk)
        if chunk:
            out += ["0" if w.isdigit() else w for w in _word.findall(self.restore(chunk))]
        return out

    def of(self, text: str) -> list[list[str]]:
        out = []
        for s in _stop.split(self.restore.respace(clean(text))):
            w = self.words(s) if s and not s.isspace() else []
            if len(w) <= WINDOW + 4:
                if w:
                    out.append(w)
            else:
                out += [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
        return out

    def features(self, passages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, passage) pairs, without repetition."""
        keys = self.keys
        if len(keys) > 500_000:
            keys.clear()
        n = np.fromiter(map(len, passages), np.int64, len(passages))
        flat = np.empty(int(n.sum()), np.int64)
        bad = np.zeros(len(flat), bool)
        i = 0
        for p in passages:
            for w in p:
                k = keys.get(w)
                if k is None:
                    k = keys[w] = _key(w) * 2 + (w in ABUSE)
                flat[i] = k
                i += 1
        bad, flat = (flat & 1).astype(bool), flat >> 1
        owner = np.repeat(np.arange(len(passages)), n)
        mask = (1 << BITS) - 1
        mix = lambda a, s: ((a * 2654435761 + s) >> 7) & mask
        f, o = [mix(flat, 1)], [owner]
        for gap, salt in ((1, 2), (2, 3)):
            near = owner[gap:] == owner[:-gap]
            f.append(mix((flat[:-gap] * 31 + flat[gap:])[near] & 0xFFFFFFFFFF, salt))
            o.append(owner[gap:][near])
        near = owner[2:] == owner[:-2]
        f.append(mix(((flat[:-2] * 31 + flat[1:-1]) * 31 + flat[2:])[near] & 0xFFFFFFFFFF, 5))
        o.append(owner[2:][near])
        f.append(np.zeros(int(bad.sum()), np.int64))
        o.append(owner[bad])
        pair = distinct(np.concatenate(o) << BITS | np.concatenate(f))
        return pair & mask, pair >> BITS


def _scale(o: np.ndarray, n: int) -> np.ndarray:
    return 1 / np.sqrt(np.bincount(o, minlength=n).clip(1))


def _fit(f: np.ndarray, o: np.ndarray, n: int, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Multiple-instance logistic regression: a document is as bad as its worst passage.

    The worst passages of bad documents are guessed at first by the log odds of their features among documents, later by
    the regression itself, which is fitted anew on the guess in every round. Passages of documents judged fine that
    score very high, and of documents judged bad that score nothing, count little: raters err.
    """
    size = 1 << BITS
    pos = y > 0.5
    pair = np.sort(doc[o] << BITS | f)
    pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
    of, bad = pair & (size - 1), pos[pair >> BITS]
    a, b = np.bincount(of[bad], minlength=size), np.bincount(of[~bad], minlength=size)
    odds = max(pos.sum(), 1) / max((~pos).sum(), 1)
    keep = a + b >= MIN_DOCS
    start = np.where(keep, np.clip(np.log((a + odds) / (b + 1) / odds), -4, 4), 0)
    f, o = f[keep[f]], o[keep[f]]
    scale = _scale(o, n)
    s = np.bincount(o, start[f] * scale[o], n)
    of_bad = pos[doc]
    w, bias = np.zeros(size), -1.0
    for r in range(ROUNDS):
        top = np.full(len(y), -1e9)
        np.maximum.at(top, doc, s)
        worst = of_bad & (s >= top[doc] - 0.5)
        target, weight = worst.astype(float), np.where(of_bad & ~worst, 0.15, 1.0)
        if r >= 2:
            p = 1 / (1 + np.exp(-s))
            weight = np.where(~of_bad & (p > 0.9), 0.0, np.where(worst & (p < 0.05), 0.1, weight))
        w, bias, gw, gb = np.zeros(size), -1.0, np.full(size, 1e-3), 1e-3
        for _ in range(STEPS):
            g = (1 / (1 + np.exp(-(bias + np.bincount(o, w[f] * scale[o], n)))) - target) * weight
            d = np.bincount(f, g[o] * scale[o], size) + RIDGE * w
            gw += d * d
            w -= 0.3 * d / np.sqrt(gw)
            gb += g.sum() ** 2
            bias -= 0.3 * g.sum() / np.sqrt(gb)
        s = bias + np.bincount(o, w[f] * scale[o], n)
    return np.where(keep, w, np.nan).astype(np.float32), float(bias)  # nan: a feature the judgements don't know


class ToxicityModel:
    """A letter model and a passage classifier, fitted by :func:`fit_toxicity`."""

    def __init__(self, letters: np.ndarray, weights: np.ndarray, bias: float):
        self.letters, self.weights, self.bias = letters, weights, bias

    def scores(self, make: Passages, texts: list[str | None]) -> np.ndarray:
        owner, passages = [], []
        for i, t in enumerate(texts):
            if t:
                p = make.of(t)
                passages += p
                owner += [i] * len(p)
        out = np.zeros(len(texts))
        if passages:
            f, o = make.features(passages)
            known = ~np.isnan(self.weights[f])
            f, o = f[known], o[known]
            z = self.bias + np.bincount(o, self.weights[f] * _scale(o, len(passages))[o], len(passages))
            np.maximum.at(out, np.array(owner), 1 / (1 + np.exp(-z)))
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_letters: int = MAX_LETTERS) -> ToxicityModel:
    """Fit on judged documents: ``docs`` (doc_id, text), ``labels`` (doc_id, rater, toxic 0/1/null, ...).

    The letter model counts all documents. Judgements: repeated rows count once, null judgements for nothing, a document's
    target is the mean of its raters. At most ``max_labelled`` judged documents (chosen by a hash of the id) of at most
    ``max_letters`` letters are used to fit; that bounds what the driver holds. All documents are scored, whole.
    """
    ship(docs.sparkSession)
    letters = letter_model(docs, "text")
    mean = labels.where("toxic is not null").groupBy("doc_id", "rater").agg(F.avg("toxic").alias("t")).groupBy("doc_id").agg(F.avg("t").alias("y"), F.count("*").alias("k"))
    some = mean.orderBy(F.xxhash64("doc_id")).limit(max_labelled)  # the documented bound of the sample
    short = docs.select("doc_id", "text").where(F.length("text") <= max_letters)
    rows = short.join(F.broadcast(some), "doc_id").orderBy("doc_id").select("text", "y", "k").collect()  # some: at most max_labelled rows
    make, doc, passages, y = Passages(letters), [], [], []
    for text, t, _ in rows:
        got = make.of(text) if text else []
        if got:
            doc += [len(y)] * len(got)
            passages += got
            y.append(t)
    if not passages:
        return ToxicityModel(letters, np.zeros(1 << BITS, np.float32), -9.0)
    fs, os_ = [], []
    for a in range(0, len(passages), 20_000):  # in parts and small numbers, since this runs on the driver
        f, o = make.features(passages[a : a + 20_000])
        fs.append(f.astype(np.int32))
        os_.append((o + a).astype(np.int32))
    n = len(passages)
    del passages, rows
    w, bias = _fit(np.concatenate(fs), np.concatenate(os_), n, np.array(doc), np.array(y))
    return ToxicityModel(letters, w, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score`` (0..1): the score of the worst passage of each document, over whole texts.

    Texts are freed of markup, hidden characters and look-alikes; disguised words (signs for letters, spacing, repeated
    letters, masked letters) are decoded by Viterbi over the lattice of their readings under the letter model, and
    the restored passages are scored. Null, empty and blank texts have the score 0; a row repeated is scored repeatedly;
    other columns are ignored; an empty table gives no row.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.letters, model.weights, model.bias))  # a fixed size: 27**4 + 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(*shared.value)
        make = Passages(own.letters)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.scores(make, b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
