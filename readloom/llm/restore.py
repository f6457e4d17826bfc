"""Restoring disguised spelling: character lattices decoded by Viterbi under a character language model."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and signs used in place of letters.
LOOKALIKES = dict(zip("аеорсхуіѕјһԁкмтвнгпԛԝɡıοαεινκρτυχ", "aeopcxyisjhdkmtbhrnqwgioaeivkptux"))
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
WILD = "*#%?•"
SKIP = "_.-~'`^·,:/\\"
HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x034F])

#: Signs that may also stand between words of one token.
GLUE = "_.-/\\,:·"
#: Wildcards in a row that are a line drawn between words, not letters; letters of a token that is not kept in memory.
RULE, LONG = 25, 200

LETTERS = "abcdefghijklmnopqrstuvwxyz"


class _Index(dict):
    """Number of a letter in the model, 1..26: letters with marks count as their base; 0 for letters of other alphabets."""

    def __missing__(self, c: str) -> int:
        base = unicodedata.normalize("NFD", c)[0]
        n = self[c] = ord(base) - 96 if "a" <= base <= "z" else 0
        return n


INDEX = _Index()
#: 0 is the border of a word, 1..26 the letters.
SIZE = 27
ORDER = 4
#: Letters of a token that may be a piece of a word; cost from which such a token is hardly a word itself; tokens looked at beside it.
PIECE, STRANGE, NEAR = 5, 11.5, 2
#: Prices of leaving out a blank between pieces and between single signs, and of a border where there is no blank.
JOIN, JOIN_ONE, BREAK = 4.0, 0.0, 8.0
#: Contexts beyond which a lattice is walked in arrays.
MANY = 700

_tag = re.compile(r"<[^<>\n]{0,3}>|</?[a-zA-Z!][^<>\n]*>|\[/?[a-zA-Z]{1,10}(?:=[^\]\n]*)?\]")
_hidden = re.compile("[" + "".join(map(chr, HIDDEN)) + "]")
_break = re.compile(r"<(?:br|/?blockquote|/?p|/?div|/?li)\s*/?>|\[/?quote[^\]\n]*\]", re.I)
_url = re.compile(r"(?:https?://|www\.)\S+")
_mention = re.compile(r"(?<!\w)@[\w][\w.\-]*")
_spaced = re.compile(r"(?<!\w)(?:[^\W\d_][ ]){2,}[^\W\d_](?!\w)")
#: Neighbouring short tokens of a line, between which blanks may be no borders of words.
_run = re.compile(r"(?<!\S)(?:\S{1,8}[ \t]{1,3})+\S{1,8}(?!\S)")
_parts = re.compile(r"(\W*?)((?:[^\W_]|[$@!|+€£(¡*#%?•])*)([.,:;'\")\]}>?!]*)")
_latin = re.compile(r"[^\W\d_]")
_foreign = re.compile(r"[^\W\d_]*[^\W\d_\x00-\x7f][^\W\d_]*")


def clean(text: str) -> str:
    """Lower-case text without markup, entities, hidden characters, look-alike letters, links and names of users."""
    t = html.unescape(text)
    if "&" in t:
        t = html.unescape(t)
    if "<" in t or "[" in t:
        t = _tag.sub("", _break.sub("\n", t))
    if not t.isascii():
        t = _hidden.sub("", t)
    t = unicodedata.normalize("NFKC", t).lower()
    t = _mention.sub("@", _url.sub(" ", t))
    if not t.isascii():
        # words that mix scripts, or consist of look-alikes alone
        t = _foreign.sub(lambda m: "".join(LOOKALIKES.get(c, c) for c in m.group(0)) if _latin.search(m.group(0)) or all(c in LOOKALIKES for c in m.group(0)) else m.group(0), t)
    return t


def tidy(text: str) -> str:
    """:func:`clean`, with words of single letters joined by rule; :meth:`Restorer.respace` joins them by the letter model instead."""
    return _spaced.sub(lambda m: m.group(0).replace(" ", ""), clean(text))


def letter_model(docs: DataFrame, text: str) -> np.ndarray:
    """Log probabilities [27, 27, 27, 27] of a letter after three others, counted over the words of all documents.

    Every task sums its counts in one table; at most 27**4 sums reach the driver, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**ORDER, np.int64)
        lookup = np.zeros(128, np.uint8)
        lookup[[ord(c) for c in LETTERS]] = np.arange(1, SIZE)
        for b in batches:
            t = "   ".join(x.lower() for x in b.column(0).to_pylist() if x)
            a = lookup[np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 127)].astype(np.int64)
            if not len(a):
                continue
            # a border is three symbols wide, so that no context reaches over it
            wide = np.concatenate(([0, 0, 0], np.repeat(a, np.where(a == 0, 3, 1)), [0, 0, 0]))
            code = ((wide[:-3] * SIZE + wide[1:-2]) * SIZE + wide[2:-1]) * SIZE + wide[3:]
            total += np.bincount(code, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    rows = docs.select(text).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    c = np.zeros(SIZE**ORDER)
    for code, n in rows:
        c[code] = n
    c = c.reshape((SIZE,) * 4)
    c[0, 0, 0, 0] = 0
    c3, c2, c1 = c.sum(0), c.sum((0, 1)), c.sum((0, 1, 2)) + 1
    p = c1 / c1.sum()
    p = (c2 + 20 * p) / (c2.sum(1, keepdims=True) + 20)
    p = (c3 + 10 * p) / (c3.sum(2, keepdims=True) + 10)
    p = (c + 5 * p) / (c.sum(3, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


class Restorer:
    """Most probable spelling of a disguised word, or of words glued by signs; tokens of any length."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.array = np.ascontiguousarray(model.reshape(SIZE**3, SIZE))
        self.known: dict[str, str] = {}
        self.pieces: dict[str, tuple[str, str, str, bool]] = {}
        self.runs: dict[str, str] = {}

    def __call__(self, chunk: str) -> str:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self._decode(chunk) if _odd.search(chunk) else chunk
            if len(chunk) <= LONG:
                self.known[chunk] = got
        return got

    def _piece(self, token: str) -> tuple[str, str, str, bool]:
        """What stands before, in ('' if it can't be a piece of a word) and after a token, and whether it is hardly a word itself."""
        got = self.pieces.get(token)
        if got is None:
            if len(self.pieces) > 300_000:
                self.pieces.clear()
            m = _parts.fullmatch(token)
            before, core, after = m.groups() if m else ("", "", "")
            if len(token) > 1:  # punctuation wins at the end of a token
                core, after = (x := core.rstrip("!?|")), core[len(x) :] + after
            if len(core) == 0 and len(token) == 1 and token in LEET | dict.fromkeys(WILD):
                before, core, after = "", token, ""
            if len(core) > PIECE or len(core) > 1 and 2 * sum(map(str.isalpha, core)) < len(core) or core and not self._plain(core):
                core = ""
            strange = bool(core) and (core not in "ai" if len(core) == 1 else self._best(self._plain(core))[0] > STRANGE)
            got = self.pieces[token] = (before, core, after, strange)
        return got

    def _plain(self, s: str) -> list[list[tuple[str, float]]]:
        """The options of a piece; one of plain letters stands for itself."""
        return self._options(s) if _odd.search(s) or not _latin.search(s) else [[(c, 0.0)] for c in s]

    def respace(self, text: str) -> str:
        """Text in which blanks inside words are left out and lost ones put back.

        Looked at are neighbouring tokens of up to ``PIECE`` letters or signs around one that is hardly a word itself, with
        one to three blanks between; their lattice has every blank as an option. Digits and signs that stand alone count as
        letters only in a run of at least three single signs, half of them letters (at least three if there are digits).
        """
        return _run.sub(lambda m: self._respace(m.group(0)), text)

    def _respace(self, run: str) -> str:
        tokens, pieces = run.split(), self.pieces
        for t in tokens:
            if (pieces.get(t) or self._piece(t))[3]:
                break
        else:
            return run
        p = [self._piece(t) for t in tokens]
        n = len(p)
        ok = [bool(x[1]) for x in p]
        i = 0
        while i < n:  # signs and digits that stand alone
            k = i
            while k < n and len(p[k][1]) == 1 and (k == i or not p[k - 1][2] and not p[k][0]):
                k += 1
            letters = sum(x[1].isalpha() for x in p[i:k])
            if k - i < 3 or 2 * letters < k - i or letters < 3 and any(x[1].isdigit() for x in p[i:k]):
                for j in range(i, k):
                    ok[j] = p[j][1].isalpha()
            i = max(k, i + 1)
        near = [False] * n
        for i in range(n):
            if ok[i] and p[i][3]:
                for step in (-1, 1):
                    j, left = i, NEAR
                    while ok[j]:
                        near[j] = True
                        k = j + step
                        if not 0 <= k < n or not left or (p[j][2] or p[k][0] if step > 0 else p[j][0] or p[k][2]):
                            break
                        j, left = k, left - 1
        out, i = [], 0
        while i < n:
            k = i
            while k < n and near[k] and (k == i or not p[k - 1][2] and not p[k][0]):
                k += 1
            if k - i < 2:
                out.append(tokens[i])
                i += 1
                continue
            plain = " ".join([x[1] for x in p[i:k]])
            got = self.runs.get(plain)
            if got is None:
                if len(self.runs) > 300_000:
                    self.runs.clear()
                got = self._joined([x[1] for x in p[i:k]])
                if len(plain) <= LONG:
                    self.runs[plain] = got
            same = got == plain
            out += tokens[i:k] if same else [p[i][0] + got.strip() + p[k - 1][2]]
            i = k
        return " ".join(out)

    def _joined(self, pieces: list[str]) -> str:
        """Pieces with every blank between them as an option."""
        lattice: list[list[tuple[str, float]]] = []
        for j, piece in enumerate(pieces):
            if j:
                lattice.append([(" ", 0.0), ("", JOIN_ONE if len(piece) == 1 and len(pieces[j - 1]) == 1 else JOIN)])
            for at, choice in enumerate(self._plain(piece)):
                if at:
                    lattice.append([("", 0.0), (" ", BREAK)])
                lattice.append(choice)
        return self._best(lattice)[1]

    def _options(self, s: str) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(s):
            c = s[i]
            r = i
            while r < len(s) and s[r] == c:
                r += 1
            n = r - i
            if c.isalpha():
                out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, 1.5)] if n == 2 else [(c, 0.0), (c * 2, 0.7)])
                i = r
                continue
            inner = 0 < i and r < len(s)
            if c in LEET:
                none = [("", 3.0)] if c in "!|+(" else []
                if n > 2:  # stretched, like a letter
                    out.append([(x, 1.0) for x in LEET[c]] + [(x * 2, 1.7) for x in LEET[c]] + none)
                else:
                    for _ in range(n):
                        out.append([(x, 1.0) for x in LEET[c]] + none)
            elif c in WILD and n >= RULE:
                out.append([(" ", 0.0)])
            elif c in WILD:
                for _ in range(n):
                    out.append([(x, 1.0) for x in LETTERS] + [("", 4.0)])
            elif c in SKIP and inner:
                out.append([("", 0.0), (" ", 0.0)] if c in GLUE else [("", 0.0)])
            else:
                return []
            i = r
        return out

    def _decode(self, chunk: str) -> str:
        core = chunk.lstrip(".,:;'\"()[]{}<>-_~`!?¡¿*#|/\\")
        lead = chunk[: len(chunk) - len(core)]
        lead = lead[len(lead.rstrip("*|!")) :]
        # a sign at the end may stand for a letter or be punctuation: punctuation wins unless it is a typical stand-in
        core, tail = core.rstrip(".,:;'\"()[]{}<>-_~`!?|/\\"), chunk[-1:]
        if not _latin.search(core) or not (_odd.search(core) or lead):
            return core
        opts = self._options(core)
        if not opts:
            return core
        if lead and len(lead) <= 2 and tail not in "*|!":  # a masked first letter, unless the word is framed by signs
            first = [[(x, 1.0) for x in (LETTERS if c == "*" else LEET[c])] + [("", 3.0)] for c in lead]
            opts = [*first, *opts]
        return self._best(opts)[1]

    def _best(self, opts: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The cheapest way through a lattice, and its cost; a blank is the border of a word.

        All contexts are kept: in a table while there are few, in an array of all 27 ** 3 where wildcards make many.
        """
        m, beam = self.model, {(0, 0, 0): (0.0, None)}  # a text is kept as its last piece and the text before, so that long tokens cost no more a letter
        for at, choice in enumerate(opts):
            nxt: dict = {}
            for (a, b, c), (cost, before) in beam.items():
                for piece, price in choice:
                    x, y, z, v = a, b, c, cost + price
                    for ch in piece:
                        k = 0 if ch == " " else INDEX[ch]
                        if not k:  # a border; a letter of another alphabet is one too
                            if z:  # one border, however many blanks
                                v -= m[x][y][z][0]
                            x = y = z = 0
                            continue
                        v -= m[x][y][z][k]
                        x, y, z = y, z, k
                    old = nxt.get((x, y, z))
                    if old is None or v < old[0]:
                        nxt[(x, y, z)] = (v, (before, piece))
            beam = nxt
            if len(beam) > MANY:
                return self._best_dense(beam, opts[at + 1 :])
        cost, last = min(((v - m[a][b][c][0] if c else v, last) for (a, b, c), (v, last) in beam.items()), key=lambda e: e[0])
        return cost, _spell(last)

    def _best_dense(self, beam: dict, opts: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """The rest of :meth:`_best` over arrays of all contexts."""
        inf, n = np.float32(np.inf), SIZE**3
        cost = np.full(n, inf, np.float32)
        for (a, b, c), (v, _) in beam.items():
            cost[(a * SIZE + b) * SIZE + c] = v
        m, every = self.array, np.arange(n)
        ends = np.where(every % SIZE > 0, -m[:, 0], 0).astype(np.float32)
        steps = []
        for choice in opts:
            new, back, used = np.full(n, inf, np.float32), np.zeros(n, np.int32), np.zeros(n, np.int16)
            for o, (piece, price) in enumerate(choice):
                got, came = cost + np.float32(price), every
                for ch in piece:
                    k = 0 if ch == " " else INDEX[ch]
                    if not k:
                        whole = got + ends
                        best = int(whole.argmin())
                        got, was = np.full(n, inf, np.float32), came
                        got[0], came = whole[best], np.full(n, was[best], np.int32)
                        continue
                    v = (got - m[:, k]).reshape(SIZE, SIZE * SIZE)
                    a = v.argmin(0)
                    to = np.arange(SIZE * SIZE) * SIZE + k
                    nxt, from_ = np.full(n, inf, np.float32), np.zeros(n, np.int32)
                    nxt[to], from_[to] = v[a, np.arange(SIZE * SIZE)], came[a * SIZE * SIZE + np.arange(SIZE * SIZE)]
                    got, came = nxt, from_
                better = got < new
                new, back, used = np.where(better, got, new), np.where(better, came, back), np.where(better, o, used)
            steps.append((back, used))
            cost = new
        total = cost + ends
        s = int(total.argmin())
        best, pieces = float(total[s]), []
        for choice, (back, used) in zip(reversed(opts), reversed(steps)):
            pieces.append(choice[used[s]][0])
            s = int(back[s])
        return best, _spell(beam[(s // (SIZE * SIZE), s // SIZE % SIZE, s % SIZE)][1]) + "".join(reversed(pieces))


def _spell(last) -> str:
    pieces = []
    while last:
        last, piece = last
        pieces.append(piece)
    return "".join(reversed(pieces))


#: What makes a word worth decoding: a sign or digit beside letters, or a letter three times in a row.
_odd = re.compile(r"[^\W\d_](?:[^\w\s]|[\d_])|(?:[^\w\s]|[\d_])[^\W\d_]|([^\W\d_])\1\1")
