"""Encoding of whole corpora with a public byte-level BPE, by traversal of a trie of the distinct words."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.session import ship

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: The published pattern that splits a text into words before the merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker keeps before it begins a new table; a bound of memory, without effect on results.
KEEP_WORDS = 400_000


class WordTrie:
    """Encodes words by one depth-first walk over the trie of their bytes.

    The state of a trie node is the last token of the encoding of the bytes from the root to it; the encoding of a word
    is read backwards along these states. A token t that ends at a node follows the state of the node where it begins
    exactly if the merges, applied to the two tokens' bytes together, leave these two tokens (no merge crosses their
    border earlier). One and only one of the tokens that end at a node does. So words with a common beginning share
    all the work for it.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.halves = self._halves()
        self.fits: dict[tuple[int, int], bool] = {}
        # tokens by their bytes read backwards, so that the tokens that end at a position are found in one walk
        self.ends: dict[int, list] = {}
        self.back: list[list] = [[-1, {}]]
        for tok, i in self.rank.items():
            node = self.back[0]
            for c in reversed(tok):
                nxt = node[1].get(c)
                if nxt is None:
                    nxt = node[1][c] = [-1, {}]
                node = nxt
            node[0] = i

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token: its encoding by the merges of lower rank."""
        out = {}
        for tok, i in self.rank.items():
            if len(tok) > 1:
                parts = self._merge(tok, i)
                if len(parts) == 2:
                    out[i] = (self.rank[parts[0]], self.rank[parts[1]])
        return out

    def _merge(self, word: bytes, below: int) -> list[bytes]:
        """Plain merging with ranks under ``below``; only used once a token, to recover the merge table."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Does the encoding of the two tokens' bytes consist of just these two tokens?"""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        # undo the later of the two merges at the border, step by step; a merge across it of lower rank would have come first
        limit = 1 << 60
        while True:
            joined = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                # the merge would have been made, unless that token isn't made of these two halves
                if self.halves.get(joined) == (left, right):
                    return False
            if left > right:
                limit = left
                if left not in self.halves:
                    return True
                left = self.halves[left][1]
                if left >= limit:
                    return True
            else:
                limit = right + 1
                if right not in self.halves:
                    return True
                right = self.halves[right][0]

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of each word; ``words`` needn't be sorted or distinct."""
        back, fit = self.back[0], self.fit
        out: dict[bytes, list[int]] = {}
        # sorted words visit the trie depth first: the states of the common beginning stay on the stack
        before, last = b"", [-1]
        starts = [0]
        for w in sorted(set(words)):
            common, most = 0, min(len(before), len(w))
            while common < most and before[common] == w[common]:
                common += 1
            del last[common + 1 :], starts[common + 1 :]
            for n in range(common + 1, len(w) + 1):
                node, at, found = back, n, -1
                while at:
                    node = node[1].get(w[at - 1])
                    if node is None:
                        break
                    at -= 1
                    t = node[0]
                    if t >= 0 and (at == 0 or fit(last[at], t)):
                        found, where = t, at
                        if at == 0:
                            break
                last.append(found)
                starts.append(where)
            ids, n = [], len(w)
            while n:
                ids.append(last[n])
                n = starts[n]
            ids.reverse()
            out[w] = ids
            before = w
        return out


def ship_file(spark: SparkSession, path: str) -> None:
    """Give a vocabulary file to all executors, which needn't have it at that place."""
    sc = spark.sparkContext
    done = getattr(sc, "_readloom_files", set())
    if path not in done:
        sc.addFile(path)
        sc._readloom_files = done | {path}


def _here(path: str) -> str:
    """The file, or the copy that :func:`ship_file` brought."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


_tries: dict[str, tuple[WordTrie, dict[str, list[int]]]] = {}


def _word_table(path: str) -> tuple[WordTrie, dict[str, list[int]]]:
    """The worker's trie of a vocabulary and the encodings it knows; made anew when it holds too many words."""
    got = _tries.get(path)
    if got is None:
        got = _tries[path] = (WordTrie(_here(path)), {})
    if len(got[1]) > KEEP_WORDS:
        got[1].clear()
        got[0].fits.clear()
    return got


def _encoder(path: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        import numpy as np
        import regex

        split = regex.compile(SPLIT).findall
        for batch in batches:
            trie, known = _word_table(path)
            words = [split(t) if t else [] for t in batch.column("text").to_pylist()]
            new = {w for ws in words for w in ws if w not in known}
            if new:
                got = trie.encode_words([w.encode() for w in new])
                for w in new:
                    known[w] = got[w.encode()]
            if lengths_only:
                size = {w: len(known[w]) for w in {w for ws in words for w in ws}}
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array([sum(map(size.__getitem__, ws)) for ws in words], pa.int64())], [*rest, "n_tokens"])
                continue
            ids = [list(itertools.chain.from_iterable(map(known.__getitem__, ws))) for ws in words]
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=off[1:])
            flat = pa.array(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(off[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(off), flat)], ["id", "ids"])

    return run


def encode_corpus(docs: DataFrame, doc_id: str, text: str, *, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """Token ids of every text: (``doc_id``, ``ids`` array<int>), without special tokens.

    Each task splits its texts into words by the published pattern and encodes the distinct new ones by a depth-first
    walk over their trie (:class:`WordTrie`); no row moves between tasks, so the cost is linear in the texts at any size.

    Null and empty texts have the empty list; strings that look like special tokens are plain text; whole texts are
    encoded, of any length; a row repeated is encoded repeatedly; empty tables give no row; other columns are ignored.
    """
    ship(docs.sparkSession)
    ship_file(docs.sparkSession, f"{tokenizers}/{ranks}")
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).mapInArrow(_encoder(f"{tokenizers}/{ranks}", False), f"id {kind}, ids array<int>").select(F.col("id").alias(doc_id), "ids")


def token_counts(docs: DataFrame, keep: list[str], text: str, *, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """Number of tokens of every text: the columns ``keep`` and ``n_tokens`` (bigint); 0 for null and empty texts."""
    ship(docs.sparkSession)
    ship_file(docs.sparkSession, f"{tokenizers}/{ranks}")
    src = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return src.mapInArrow(_encoder(f"{tokenizers}/{ranks}", True), f"{kinds}, n_tokens bigint").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
