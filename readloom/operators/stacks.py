"""Kernel of the rescue: stacks that lie together in a partition, their near names, and the letters of what is merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from readloom.functions.flags import REVERSE
from readloom.functions.phred import LOG_TINY, MASK_QUAL, MAX_PV, UNROLLED

#: Rows whose stacks are looked at together (at least a stack), rows of which blocks are made, and pairs of names compared at once.
BATCH_ROWS, BLOCK_ROWS, PAIRS = 20_000, 200_000, 1_000_000
_K = math.log(10) / 10


def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, block): the rows of a bucket among BLOCK_ROWS, column by column and compressed, which is a third of what they take row by row."""
    how = pa.ipc.IpcWriteOptions(compression="zstd")
    held, rows = [], 0

    def packed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        bucket = t.column("_bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        t = t.drop_columns(["_bucket"]).take(pa.array(order)).combine_chunks()
        ids, begin = np.unique(bucket[order], return_index=True)
        blocks = []
        for a, b in zip(begin.tolist(), [*begin.tolist()[1:], t.num_rows]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t.schema, options=how) as w:
                w.write_table(t.slice(a, b - a).combine_chunks())
            blocks.append(out.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], ["_bucket", "block"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield packed()
            held, rows = [], 0
    if rows:
        yield packed()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, whose blocks follow each other."""
    now, held = None, []
    for b in batches:
        for bucket, block in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != now and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            now = bucket
            held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
    if held:
        yield pa.concat_tables(held).combine_chunks()


def whole_stacks(batches: Iterator[pa.RecordBatch], sig: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole stacks from the blocks of :func:`pack_blocks` in the order of their buckets, with the number of each row's stack."""
    for t in _buckets(batches):
        stack = np.zeros(t.num_rows, np.int64)
        for c in sig:
            d = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            stack = np.unique(stack * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
        order = np.argsort(stack, kind="stable")
        stack = stack[order]
        ends = np.append(np.flatnonzero(np.diff(stack)) + 1, len(stack))
        a = 0
        while a < len(stack):
            b = int(ends[min(len(ends) - 1, np.searchsorted(ends, a + BATCH_ROWS))])
            yield t.take(pa.array(order[a:b])).combine_chunks(), stack[a:b]
            a = b


def _chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points one after the other, where each text begins, with the end); null is empty."""
    texts = pc.fill_null(texts, "")
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=off[1:])
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), off


def _inside(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): 0 .. n - 1 for every owner."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def roots(stack: np.ndarray, rank: np.ndarray, names: pa.Array, limit: int) -> np.ndarray:
    """For different (stack, rank of a name) in order: the place of the name that each ends up in.

    Every name is merged into the first greater one of its stack and length within ``limit`` letters. With t mismatches one of
    t + 1 pieces is equal, so only names that share a piece are compared; keys of pieces are hashes, and more than they find is
    tested letter by letter.
    """
    flat, off = _chars(names)
    start, size = off[:-1][rank], np.diff(off)[rank]
    n, up = len(rank), np.arange(len(rank))
    run = np.zeros(len(flat) + 1, np.uint64)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(flat), 0x9E3779B97F4A7C15, np.uint64))))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(flat), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))))
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=run[1:])
    whole = stack.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    parent = np.full(n, n)
    for i in range(limit + 1):
        a, b = start + size * i // (limit + 1), start + size * (i + 1) // (limit + 1)
        key = (run[b] - run[a]) * back[a] * np.uint64(0xE7037ED1A0B428DB) + whole
        order = np.argsort(key, kind="stable")  # ascending names inside a key
        k = key[order]
        end = np.searchsorted(k, k, side="right")
        more = end - up - 1  # those after it in its key
        done = 0
        total = np.cumsum(more)
        while done < n:
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, side="right")))
            x, y = _inside(more[done:stop])
            p, q = order[x + done], order[x + done + 1 + y]
            same = (stack[p] == stack[q]) & (size[p] == size[q])
            p, q = p[same], q[same]
            differ = np.zeros(len(p), np.int64)
            for j in range(int(size[p].max(initial=0))):
                at = np.minimum(j, size[p] - 1)
                differ += (j < size[p]) & (flat[start[p] + at] != flat[start[q] + at])
            near = differ <= limit
            np.minimum.at(parent, p[near], q[near])
            done = stop
    root = np.where(parent < n, parent, up)
    while True:
        further = root[root]
        if np.array_equal(further, root):
            return root
        root = further


def fisher(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``phred.fisher_pv`` in numbers."""
    x = total * _K
    with np.errstate(all="ignore"):
        few = np.ones(len(n))
        gamma = np.zeros(len(n))
        for k in range(min(UNROLLED, int(n.max(initial=1))) - 1, 0, -1):
            few = np.where(n > k, 1.0 + few * x / float(k), 1.0)
            gamma = np.where(n == k + 1, math.lgamma(k + 1), gamma)
        tail, fact = np.log(few) - x, gamma
        large = np.flatnonzero(n > UNROLLED)
        if len(large):
            m, y = n[large], x[large]
            h, g = np.ones(len(m)), np.zeros(len(m))
            for k in range(1, int(m.max())):
                h, g = np.where(k < m, 1.0 + h * k / y, h), np.where(k < m, g + math.log(k), g)
            fact[large], tail[large] = g, (m - 1) * np.log(y) - g - y + np.log(h)
        far = (x >= n) & (x >= 1.0) & (n * np.log(x) - x - fact < LOG_TINY)
        pv = np.clip(np.floor(-tail / _K + 0.5), 0, MAX_PV)
    return np.where((n < 1) | (total <= 0), 0, np.where(far, MAX_PV, pv)).astype(np.int64)


def _tag(x: pa.Array, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether there is one) of a list column at a place of a row."""
    size = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    v = x.flatten()
    there = at < size[row]
    i = np.where(there, (np.cumsum(size) - size)[row] + at, 0)
    if not len(v):
        return np.zeros(len(i), np.int64), there & False
    return pc.fill_null(v, 0).to_numpy(zero_copy_only=False).astype(np.int64)[i], there & v.is_valid().to_numpy(zero_copy_only=False)[i]


def _lists(v: np.ndarray, null: np.ndarray, off: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v.astype(np.int32), mask=null), mask=pa.array(none))


def merged_letters(t: pa.Table, group: np.ndarray, n_groups: int, back: np.ndarray, trust: bool) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(seq, qual, fa, pv of every group of rows, positions gained from N); ``back``: groups whose tags are read from the end."""
    seq, off = _chars(pc.utf8_upper(t.column("seq").combine_chunks()))
    size = np.diff(off)
    row, j = _inside(size)
    longest = np.zeros(n_groups, np.int64)
    np.maximum.at(longest, group, size)
    cells = np.concatenate(([0], np.cumsum(longest)))
    cell, total = cells[:-1][group[row]] + j, int(cells[-1])
    code = np.full(len(seq), 4)
    for c, letter in enumerate("ACGT"):
        code[seq == ord(letter)] = c
    rev = (t.column("flag").to_numpy() & REVERSE) != 0
    at = np.where(rev[row], size[row] - 1 - j, j)
    n = np.bincount(cell, minlength=total)
    clear = np.flatnonzero(code < 4)
    cell, code, row, j, at = cell[clear], code[clear], row[clear], j[clear], at[clear]
    k = np.bincount(cell, minlength=total)
    lo, hi = np.full(total, 4), np.full(total, -1)
    np.minimum.at(lo, cell, code)
    np.maximum.at(hi, cell, code)
    ok = (lo == hi) & ((k == n) | trust)
    sums = {}
    for c in ("fa", "pv"):
        v, there = _tag(t.column(c).combine_chunks(), row, at)
        sums[c] = np.bincount(cell[there], v[there], minlength=total).astype(np.int64), np.bincount(cell[there], minlength=total) == 0
    pv, no_pv = sums["pv"]
    many = np.flatnonzero(ok & (k > 1) & ~no_pv)
    pv = pv.copy()
    pv[many] = fisher(k[many], pv[many].astype(float))
    ok &= (pv > 2) & ~no_pv
    qual = t.column("qual").combine_chunks()
    signs, q_off = _chars(qual)
    has = qual.is_valid().to_numpy(zero_copy_only=False)[row]
    there = j < np.diff(q_off)[row]
    q = np.where(there, signs[np.where(there, q_off[:-1][row] + j, 0)].astype(np.int64) if len(signs) else 0, 0) - 33
    best = np.full(total, -99)
    np.maximum.at(best, cell[has], q[has])
    letters = np.where(ok, np.frombuffer(b"ACGTN", np.uint8)[np.where(ok, lo, 4)], ord("N")).astype(np.uint8)
    sign = np.where(ok, best, MASK_QUAL)
    fa, no_fa = sums["fa"]
    fa, no_fa, pv = np.where(ok, fa, 0), ok & no_fa, np.where(ok, pv, 0)
    g, i = _inside(longest)
    turn = np.where(back[g], cells[:-1][g] + longest[g] - 1 - i, np.arange(total))
    none = longest == 0
    off32 = cells.astype(np.int32)
    known = sign > -99
    kept = np.concatenate(([0], np.cumsum(known)))[cells]
    text = "".join(map(chr, (sign[known] + 33) % 256))  # the letter of a number as in Spark's char()
    new = {
        "seq": pa.array([None if z else s for z, s in zip(none, _split(letters.tobytes().decode(), cells))], pa.string()),
        "qual": pa.array([None if z else s for z, s in zip(none, _split(text, kept))], pa.string()),
        "fa": _lists(fa[turn], no_fa[turn], off32, none), "pv": _lists(pv[turn], np.zeros(total, bool), off32, none),
    }
    gained = np.bincount(g[ok & (k < n)], minlength=n_groups)
    return new, gained


def _split(text: str, off: np.ndarray) -> list[str]:
    o = off.tolist()
    return [text[a:b] for a, b in zip(o, o[1:])]


def merge_stacks(batches: Iterator[pa.RecordBatch], *, sig: list[str], name: str | None, read_id: str, limit: int, trust: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records of the stacks of a partition's blocks, merged by near names (all of a stack without ``name``), with root and n_merged.

    Of the columns fm, rv, np, nc and dr those that are there are summed (dr: the greatest).
    """
    for t, stack in whole_stacks(batches, sig):
        if name is None:
            rank, ordered = np.zeros(t.num_rows, np.int64), pa.array(["*"])
        else:
            d = t.column(name).combine_chunks().dictionary_encode()
            place = pc.sort_indices(d.dictionary).to_numpy()
            rank = np.argsort(place)[d.indices.to_numpy()]
            ordered = d.dictionary.take(pa.array(place))
        key, mine = np.unique(stack * len(ordered) + rank, return_inverse=True)
        own = key % len(ordered)
        root = np.arange(len(key)) if name is None else roots(key // len(ordered), own, ordered, limit)
        group = root[mine]
        count = np.bincount(group, minlength=len(key))
        alone, many = np.flatnonzero(count[group] == 1), np.flatnonzero(count[group] > 1)
        label = lambda rows: ordered.take(pa.array(own[group[rows]]))
        if len(alone):
            one = t.take(pa.array(alone))
            yield from _as(one, {}, label(alone), np.ones(len(alone), np.int64), schema)
        if not len(many):
            continue
        ids = np.argsort(pc.sort_indices(t.column(read_id).take(pa.array(many)), null_placement="at_start").to_numpy())
        many = many[np.lexsort((ids, rank[many], group[many]))]
        first, g = np.unique(group[many], return_inverse=True)
        lead = many[np.cumsum(count[first]) - 1]
        m = t.take(pa.array(many))
        flag = t.column("flag").take(pa.array(lead)).to_numpy()
        new, gained = merged_letters(m, g, len(first), (flag & REVERSE) != 0, trust)
        begin = np.cumsum(count[first]) - count[first]
        for c in ("fm", "rv", "np", "nc"):
            if c in m.column_names:
                new[c] = pa.array(np.add.reduceat(pc.fill_null(m.column(c), 0).to_numpy(), begin) + (gained if c == "nc" else 0))
        if "dr" in m.column_names:
            least = -(1 << 31)
            dr = np.maximum.reduceat(pc.fill_null(m.column("dr"), least).to_numpy(), begin)
            new["dr"] = pa.array(dr, pa.int32(), mask=dr == least)
        yield from _as(t.take(pa.array(lead)), new, label(lead), count[first], schema)


def _as(t: pa.Table, new: dict[str, pa.Array], root: pa.Array, n: np.ndarray, schema: pa.Schema) -> list[pa.RecordBatch]:
    new = {**new, "root": root, "n_merged": pa.array(n, pa.int64())}
    cols = [(new[f.name] if f.name in new else t.column(f.name)).cast(f.type) for f in schema]
    return pa.table(cols, schema=schema).combine_chunks().to_batches(10_000)
