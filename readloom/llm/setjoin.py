"""Vectorised set kernels for the near-duplicate join: k-letter sets, parity sketches, edit checks, metric regions.

Everything here is exact. A parity sketch of a set has bit h(x) flipped for every x; the bits in which two sketches
differ can't outnumber the symmetric difference of the sets, so a sketch may rule a pair out but never in.
"""

from __future__ import annotations

import numpy as np

#: Candidate pairs looked at in one numpy call.
CHUNK = 1 << 17
#: 64-bit words of a sketch: enough to tell unrelated sets of a hundred members from those at a distance of 3/4.
WORDS = 8
#: Bytes that the bit sets of a batch may take; beyond it sets are compared as sorted runs.
DENSE_BYTES = 1 << 28
#: Radius of the regions of the first level, levels of recursion (each halves the radius), comparisons of a region that isn't divided any more.
CAP, LEVELS, LEAF = 0.25, 4, 4096
#: Pivots of a group in one wave at most; waves double from one pivot on.
WAVE = 1024
SLACK = 1e-9


def flat_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of ``texts`` as code points, and the offsets of each text."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=off[1:])
    return flat, off


def arrow_letters(texts) -> tuple[np.ndarray, np.ndarray]:
    """:func:`flat_letters` of an Arrow string array; plain ASCII is read from its buffers."""
    size = texts.nbytes and np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count == 0 and len(texts):
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[size[0] : size[-1]] if size[-1] > size[0] else np.zeros(0, np.uint8)
        if not (raw & 128).any():
            return raw.astype(np.uint32), size - size[0]
    return flat_letters(texts.to_pylist())


def rotated(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The letters with the first floor(length / 2) of each text moved behind its rest."""
    n = np.diff(off)
    at = np.arange(len(flat)) - np.repeat(off[:-1], n) + np.repeat(n // 2, n)
    long = np.repeat(n, n)
    return flat[np.repeat(off[:-1], n) + np.where(at >= long, at - long, at)]


def _compact(code: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """The same numbers without holes, and how many there are."""
    if top <= 1 << 22:
        seen = np.zeros(top, bool)
        seen[code] = True
        return (np.cumsum(seen, dtype=np.int32) - 1)[code], int(seen.sum())
    u, out = np.unique(code, return_inverse=True)
    return out.astype(np.int64), len(u)


def letter_grams(flat: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """An exact number for the k letters that begin at each position (the last k - 1 are meaningless), and the bound of these numbers."""
    code, a = _compact(flat, int(flat.max()) + 1 if len(flat) else 1)
    a = max(a, 2)
    out, top = code, a
    for i in range(1, k):
        if top > (1 << 40) // a:
            out, top = _compact(out, top)
        top *= a
        out = out * a if top < 1 << 31 else out.astype(np.int64) * a
        out[: len(code) - i] += code[i:]
    return out, top


class Sets:
    """The sets of distinct k-letter substrings of texts (``flat`` letters, offsets ``off``), with parity sketches.

    Sets are rows of bits over the substrings of the batch; where these would take too much memory (long texts, many
    different substrings), sorted runs.
    """

    def __init__(self, flat: np.ndarray, off: np.ndarray, k: int):
        count = len(off) - 1
        n = np.maximum(np.diff(off) - k + 1, 0)
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(off[:-1], n)
        code, top = letter_grams(flat, k)
        gram, size = _compact(code[at], top) if len(at) else (np.zeros(0, np.int32), 1)
        words = -(-size // 64)
        words += -words % WORDS
        owner = np.repeat(np.arange(count), n)
        self.bits = self.gram = None
        if count * words * 8 <= DENSE_BYTES:
            self.bits = np.zeros((count, words), np.uint64)
            step = max(1, (1 << 24) // (64 * words))
            for a in range(0, count, step):
                b = min(count, a + step)
                cells = np.zeros((b - a, 64 * words), bool)
                lo, hi = (int(first[a]), int(first[b - 1] + n[b - 1]))
                cells[owner[lo:hi] - a, gram[lo:hi]] = True
                self.bits[a:b] = np.packbits(cells, axis=1).view(np.uint64)
            self.size = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
            self.sketch = np.ascontiguousarray(np.bitwise_xor.reduce(self.bits.reshape(count, -1, WORDS), axis=1))
            return
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, bool)
        owner, self.gram = owner[new], gram[new]
        self.size = np.bincount(owner, minlength=count)
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        self.sketch = np.zeros((count, WORDS), np.uint64)
        bit, word, some = np.uint64(1) << (self.gram & 63).astype(np.uint64), (self.gram >> 6) % WORDS, np.flatnonzero(self.size)
        for w in range(WORDS):
            if len(some):
                self.sketch[some, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), self.off[some])

    def bound(self, similarity: float) -> float:
        """Share of |A| + |B| that the symmetric difference may reach at a Jaccard similarity."""
        return (1 - similarity) / (1 + similarity)

    def may(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Pairs that their sketches don't rule out."""
        d = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(1, dtype=np.int64)
        return d <= self.bound(similarity) * (self.size[i] + self.size[j]) + 1e-6

    def may_block(self, x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of x times y (positions in both) that their sketches don't rule out."""
        d = np.zeros((len(x), len(y)), np.uint16)
        for w in range(WORDS):
            d += np.bitwise_count(self.sketch[x, w][:, None] ^ self.sketch[y, w][None, :])
        return np.nonzero(d <= (self.bound(similarity) * (self.size[x][:, None] + self.size[y][None, :]) + 1e-6).astype(np.uint16))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of pairs."""
        out = np.zeros(len(i), np.int64)
        if self.bits is not None:
            step = max(1, (1 << 20) // self.bits.shape[1])
            for a in range(0, len(i), step):
                out[a : a + step] = np.bitwise_count(self.bits[i[a : a + step]] & self.bits[j[a : a + step]]).sum(1, dtype=np.int64)
            return out
        for p, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            a, b = self.gram[self.off[x] : self.off[x + 1]], self.gram[self.off[y] : self.off[y + 1]]
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            out[p] = (b[np.minimum(at, len(b) - 1)] == a).sum() if len(b) else 0
        return out

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact Jaccard distances of pairs; two empty sets are at a distance of 1."""
        c = self.common(i, j)
        return 1 - c / np.maximum(self.size[i] + self.size[j] - c, 1)

    def similar(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Exact: is |A & B| / |A | B| at least ``similarity``?"""
        total = self.size[i] + self.size[j]
        return (total > 0) & (self.common(i, j) * (1 + similarity) >= similarity * total - SLACK)


def ranges(start: np.ndarray, count: np.ndarray, chunk: int = CHUNK):
    """Yield (row, partner) arrays for rows r and partners start[r] .. start[r] + count[r] - 1, about ``chunk`` at a time.

    A row with more partners than that is given in several parts.
    """
    some = np.flatnonzero(count > 0)
    total = np.concatenate(([0], np.cumsum(count[some])))
    a = 0
    while a < len(some):
        if count[some[a]] > chunk:
            r, n = some[a], int(count[some[a]])
            for at in range(0, n, chunk):
                m = min(chunk, n - at)
                yield np.full(m, r), start[r] + at + np.arange(m)
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(total, total[a] + chunk, "right")) - 1)
        c = count[some[a:b]]
        row = np.repeat(some[a:b], c)
        yield row, np.arange(len(row)) + np.repeat(start[some[a:b]] - (np.cumsum(c) - c), c)
        a = b


def close_pairs(sketch: np.ndarray, start: np.ndarray, count: np.ndarray, limit: int):
    """:func:`ranges`, but only the pairs whose sketches differ in at most ``limit`` bits.

    Rows with few partners are taken together, partner by partner, which needs no list of all pairs.
    """
    few = np.flatnonzero((count > 0) & (count <= 1024))
    few = few[np.argsort(-count[few], kind="stable")]
    upto = np.searchsorted(-count[few], -np.arange(1, int(count[few[0]]) + 1 if len(few) else 1), "right")
    for d, n in enumerate(upto.tolist()):
        i = few[:n]
        j = start[i] + d
        hit = np.flatnonzero(np.bitwise_count(sketch[i] ^ sketch[j]) <= limit)
        if len(hit):
            yield i[hit], j[hit]
    for i, j in ranges(start, np.where(count > 1024, count, 0)):
        hit = np.flatnonzero(np.bitwise_count(sketch[i] ^ sketch[j]) <= limit)
        yield i[hit], j[hit]


def near_pivots(sets: Sets, rows: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``rows``, position in ``pivots``, distance) of all within ``reach`` of each other."""
    out = []
    for a in range(0, len(rows), 8192):
        x = rows[a : a + 8192]
        for b in range(0, len(pivots), 64):
            y = pivots[b : b + 64]
            q, i = sets.may_block(y, x, 1 - reach)
            d = sets.distance(x[i], y[q])
            ok = d <= reach + SLACK
            out.append((i[ok] + a, q[ok] + b, d[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out))


def cross_pairs(sets: Sets, left: np.ndarray, right: np.ndarray, threshold: float):
    """Similar pairs of ``left`` times ``right``: every row of ``left`` is a pivot of radius 0, whose window is what is similar to it.

    For rows that no pivot of a greater radius could divide. A window of 1 - threshold is narrow enough for half a sketch.
    """
    half = WORDS // 2
    for a in range(0, len(left), 64):
        x = left[a : a + 64]
        for b in range(0, len(right), 4096):
            y = right[b : b + 4096]
            d = np.zeros((len(x), len(y)), np.uint16)
            for w in range(half):
                d += np.bitwise_count(sets.sketch[x, w][:, None] ^ sets.sketch[y, w][None, :])
            i, j = np.nonzero(d <= (sets.bound(threshold) * (sets.size[x][:, None] + sets.size[y][None, :]) + 1e-6).astype(np.uint16))
            i, j = x[i], y[j]
            ok = sets.may(i, j, threshold)
            i, j = i[ok], j[ok]
            ok = sets.similar(i, j, threshold)
            if ok.any():
                yield i[ok], j[ok]


def voronoi(row: np.ndarray, pivot: np.ndarray, dist: np.ndarray, n_rows: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its nearest pivot within ``cap`` (-1: none) and the distance to it; ties go to the earlier pivot."""
    home, near = np.full(n_rows, -1, np.int64), np.zeros(n_rows)
    close = np.flatnonzero(dist <= cap + SLACK)
    order = close[np.lexsort((pivot[close], dist[close], row[close]))]
    first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))] if len(order) else order
    home[row[first]], near[row[first]] = pivot[first], dist[first]
    return home, near


def metric_join(sets: Sets, group: np.ndarray, text: np.ndarray, mask: np.ndarray, threshold: float, *, leaf: int = LEAF, cap: float = CAP, seed: int = 7):
    """Pairs (x, y) of entries of one group with a Jaccard similarity of ``threshold`` or more and no common bit in ``mask``.

    ``group`` must be sorted; ``text`` is the set of each entry. All groups go through the same steps together:

    Waves of pivots are drawn from the entries of every group. An entry belongs to the Voronoi region of its nearest
    pivot if it lies within ``cap`` of it; by the triangle inequality each partner of a region's entry lies within r + t of
    the pivot (r the region's radius, t = 1 - threshold), so that window is replicated into the region. Pairs of two
    regions are met in the earlier one; what no pivot claims goes on to the next wave, with twice as many pivots, until
    nothing is left. A region of many comparisons is a group of the next level, with half the radius; in a
    small one the distances to the pivot decide pairs by the triangle inequality (sum at most t: similar; difference
    above t: not), and only the others are compared.
    """
    t, rng = 1 - threshold, np.random.default_rng(seed)
    entry = np.flatnonzero(sets.size[text] > 0)  # an empty set is similar to none, not even to itself
    group, mask = group[entry], mask[entry].astype(np.int64)
    for level in range(1, LEVELS + 2):
        if not len(entry):
            return
        bit = np.int64(1) << (40 + level)
        order = np.lexsort((rng.random(len(entry)), group))
        group, entry, mask = group[order], entry[order], mask[order]
        wave, base = 1, 0
        parts: list[tuple] = []  # region, home first, entry, mask, distance
        while len(entry):
            edge = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
            head = np.concatenate(([0], edge[:-1]))
            size = edge - head
            take = np.minimum(size, wave)
            of = np.repeat(np.arange(len(head)), size)
            found = []
            large = (size >= 512) & (take >= 8)
            for g in np.flatnonzero(large):
                at = np.arange(head[g], edge[g])
                i, q, d = near_pivots(sets, text[entry[at]], text[entry[at[: take[g]]]], min(cap + t, 1 - SLACK))
                found.append((i + head[g], q + head[g], d))
            many = np.where(large[of], 0, take[of])
            for i, q in ranges(head[of], many):
                x, y = text[entry[i]], text[entry[q]]
                ok = np.flatnonzero(sets.may(x, y, 1 - cap - t)) if cap + t < 1 else np.arange(len(i))
                i, q = i[ok], q[ok]
                d = sets.distance(text[entry[i]], text[entry[q]])
                ok = d <= cap + t + SLACK
                found.append((i[ok], q[ok], d[ok]))
            row, pivot, dist = (np.concatenate(z) for z in zip(*found))
            home, near = voronoi(row, pivot, dist, len(entry), cap)
            radius = np.zeros(len(entry))
            claimed = home >= 0
            np.maximum.at(radius, home[claimed], near[claimed])
            window = (home[row] != pivot) & ~(claimed[row] & (home[row] < pivot)) & (dist <= radius[pivot] + t + SLACK)
            mine = np.flatnonzero(claimed)
            beside = np.flatnonzero(window)
            parts.append((home[mine] + base, np.zeros(len(mine), np.int8), entry[mine], mask[mine], near[mine]))
            parts.append((pivot[beside] + base, np.ones(len(beside), np.int8), entry[row[beside]], mask[row[beside]] | bit, dist[beside]))
            base += len(entry)
            rest = ~claimed
            group, entry, mask = group[rest], entry[rest], mask[rest]
            wave = min(2 * wave, WAVE)
        region, guest, entry, mask, dist = (np.concatenate(z) for z in zip(*parts))
        order = np.lexsort((guest, region))
        region, guest, entry, mask, dist = region[order], guest[order], entry[order], mask[order], dist[order]
        edge = np.flatnonzero(np.concatenate((region[1:] != region[:-1], [True]))) + 1
        head = np.concatenate(([0], edge[:-1]))
        size = edge - head
        homes = size - np.add.reduceat(guest, head, dtype=np.int64)
        radius = np.maximum.reduceat(np.where(guest == 0, dist, 0), head)
        big = (homes * size > leaf) & (homes > 4) & (radius > 0) & (level <= LEVELS)
        of = np.repeat(np.arange(len(head)), size)
        at = np.arange(len(region))
        for i, j in ranges(at + 1, np.where((guest == 1) | big[of], 0, edge[of] - at - 1)):
            ok = (mask[i] & mask[j]) == 0
            i, j = i[ok], j[ok]
            sure = dist[i] + dist[j] <= t - SLACK
            ask = np.flatnonzero(~sure & (np.abs(dist[i] - dist[j]) <= t + SLACK))
            x, y = text[entry[i[ask]]], text[entry[j[ask]]]
            near = np.flatnonzero(sets.may(x, y, threshold))
            good = near[sets.similar(x[near], y[near], threshold)]
            sure[ask[good]] = True
            if sure.any():
                yield entry[i[sure]], entry[j[sure]]
        group, entry, mask = region[big[of]], entry[big[of]], mask[big[of]]
        cap /= 2


def within_edits(fx: np.ndarray, ox: np.ndarray, lx: np.ndarray, fy: np.ndarray, oy: np.ndarray, ly: np.ndarray, limit: int = 2) -> np.ndarray:
    """For pairs of texts (letters f, offset o, length l of each side): are they at most ``limit`` single-letter edits apart?

    Furthest-reaching diagonals: e edits reach, on each diagonal, the furthest row from which a run of equal letters goes on.
    """
    ok = np.zeros(len(ox), bool)
    width = np.maximum(lx, ly)
    order = np.argsort(width, kind="stable")
    a = 0
    while a < len(order):
        b = min(len(order), a + max(1, (1 << 17) // (int(width[order[min(len(order) - 1, a + 5000)]]) + 1)), a + 5001)
        p = order[a:b]
        a, wide, m = b, int(width[p[-1]]) + 2, len(p)
        rows, cols = np.arange(m), np.arange(wide)
        inx = cols < lx[p][:, None]
        x = np.where(inx, fx[np.minimum(ox[p][:, None] + cols, max(len(fx) - 1, 0))].astype(np.int32), -1)
        run = {}
        for d in range(-limit, limit + 1):
            j = cols + d
            iny = (j >= 0) & (j < ly[p][:, None])
            y = np.where(iny, fy[np.clip(oy[p][:, None] + j, 0, max(len(fy) - 1, 0))].astype(np.int32), -2)
            stop = np.where(x == y, wide, cols).astype(np.int32)
            run[d] = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
        far = {0: run[0][:, 0].astype(np.int64)}
        goal = (ly - lx)[p]
        done = (goal == 0) & (far[0] >= lx[p])
        for e in range(1, limit + 1):
            new = {}
            for d in range(-e, e + 1):
                at = np.full(m, -1, np.int64)
                if d in far:
                    at = np.maximum(at, np.where(far[d] >= 0, far[d] + 1, -1))
                if d - 1 in far:
                    at = np.maximum(at, far[d - 1])
                if d + 1 in far:
                    at = np.maximum(at, np.where(far[d + 1] >= 0, far[d + 1] + 1, -1))
                at = np.where((at >= 0) & (at + d >= 0), np.minimum(at, lx[p]), -1)
                at = np.where((at >= 0) & (at + d <= ly[p]), at, -1)
                new[d] = np.where(at >= 0, np.minimum(run[d][rows, np.maximum(at, 0)], lx[p]), -1)
                done |= (goal == d) & (new[d] >= lx[p])
            far = new
        ok[p] = done
    return ok


class EditCheck:
    """Edit distance of many pairs of texts. Texts of up to 64 letters from up to 16 different ones take the bit-parallel
    way (a column of the distance matrix is one machine word); the others take :func:`within_edits`.
    """

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.flat, self.start, self.length = flat, start, length
        present = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
        present[flat] = True
        self.letters = int(present.sum())
        self.code = (np.cumsum(present) - 1).astype(np.uint8)[flat] if self.letters <= 16 else None

    def within(self, x: np.ndarray, y: np.ndarray, limit: int = 2) -> np.ndarray:
        ok = np.zeros(len(x), bool)
        fast = (self.length[x] <= 64) & (self.length[x] > 0) if self.code is not None else np.zeros(len(x), bool)
        slow = np.flatnonzero(~fast)
        if len(slow):
            u, v = x[slow], y[slow]
            ok[slow] = within_edits(self.flat, self.start[u], self.length[u], self.flat, self.start[v], self.length[v], limit)
        fast = np.flatnonzero(fast)
        for a in range(0, len(fast), 1 << 14):
            p = fast[a : a + (1 << 14)]
            ok[p] = self._columns(x[p], y[p]) <= limit
        return ok

    def _columns(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        lx, ly = self.length[x], self.length[y]
        base, at = np.arange(len(x)) * self.letters, self.start[y]
        masks = np.zeros(len(x) * self.letters, np.uint64)
        least = int(lx.min())
        for j in range(int(lx.max())):
            own = slice(None) if j < least else np.flatnonzero(lx > j)
            masks[base[own] + self.code[self.start[x[own]] + j]] |= one << np.uint64(j)
        last = one << (lx - 1).astype(np.uint64)
        up, down = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
        score = lx.astype(np.int32)
        short = int(ly.min()) if len(ly) else 0
        for j in range(int(ly.max()) if len(ly) else 0):
            same = masks[base + self.code[np.minimum(at + j, len(self.code) - 1)]]
            vert = same | down
            horiz = (((same & up) + up) ^ up) | same
            more, less = down | ~(horiz | up), up & horiz
            step = ((more & last) != 0).astype(np.int32) - ((less & last) != 0)
            score += step if j < short else np.where(j < ly, step, 0)
            more, less = (more << one) | one, less << one
            up, down = less | ~(vert | more), more & vert
        return score


def gram_parity(flat: np.ndarray, off: np.ndarray, k: int = 3) -> np.ndarray:
    """A 64-bit parity sketch of each text's k-letter substrings (with repetition): one edit flips at most 2 k bits."""
    h = np.zeros(len(flat), np.uint32)
    for i in range(k):  # two bits a letter, which keep A, C, G and T apart
        h[: len(flat) - i] += ((flat[i:] >> np.uint32(1)) & np.uint32(3)) << np.uint32(2 * i)
    bit = np.uint64(1) << (h & np.uint32(63)).astype(np.uint64)
    for i in range(1, k):  # no substring begins at the last k - 1 letters
        bit[np.maximum(off[1:] - i, off[:-1])[off[1:] > off[:-1]]] = 0
    bit[off[:-1][(np.diff(off) > 0) & (np.diff(off) < k)]] = 0
    out = np.zeros(len(off) - 1, np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.bitwise_xor.reduceat(bit, off[some])
    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a
