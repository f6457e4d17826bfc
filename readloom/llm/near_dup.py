"""Near-duplicate records: a Jaccard metric-space join of sequences, inside the neighbourhoods of nearly equal barcodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.setjoin import CAP, LEAF, EditCheck, Sets, arrow_letters, close_pairs, cross_pairs, distinct, gram_parity, metric_join, near_pivots, rotated, voronoi
from readloom.session import cut, ship

#: Records of one region that a task joins; larger regions are divided by pivots in Spark stages first.
TILE = 16384
#: Barcodes of one key that a task compares; more are dealt to pairs of parts.
KEY_TILE = 65536
#: Pivots of a hot region in its first round; every round takes four times as many, up to half a tile. Rounds at most.
PIVOTS, ROUNDS = 512, 6
#: Halvings of the radius that a hot region may take; what is larger still lies within CAP / 2**DEPTH of one pivot.
DEPTH = 3
#: Bits of the two tiles of a pair; bit 0 is a guest by its barcode, those between are guests of windows.
LEFT, RIGHT = 1 << 60, 1 << 61
#: Rows that a partition is laid out for, and that Python looks at together.
PARTITION_ROWS, BATCH_ROWS = 60_000, 20_000


def _piece(n: np.ndarray) -> np.ndarray:
    """Letters of the first and the last piece of barcodes of n letters: about a third, the same for the lengths from 16 to 21 that most have."""
    return np.where((n >= 16) & (n <= 21), 6, np.maximum((n + 1) // 3, 1))


def _keys(scope: np.ndarray, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(barcode, key): the keys under which barcodes meet those within 2 edits, with the role in the last three bits.

    The shorter barcode of a pair (of m letters) is cut in three pieces, of which 2 edits leave one intact. If it is the
    first or the last, both barcodes share it at their very start or end; a barcode of n letters enters these for m = n,
    n - 1, n - 2. Else each end has an edit, so the middle piece is intact and moved by at most one: the shorter
    barcode names it, the longer looks for it at each place left. Pieces grow with the barcode, so no key is short
    where barcodes are long, and barcodes of a few letters, of which there are few, meet all together. Keys are hashes: one that
    stands for two pieces brings more candidates, never a wrong pair.
    role: 0/1 start or end piece (as it is / rotated), 4/5 middle piece, 6/7 look-up of another's middle piece.
    """
    u = np.uint64
    power = np.ones(len(flat) + 1, u)
    power[1:] = u(0x9E3779B97F4A7C15)
    inverse = np.ones(len(flat) + 1, u)
    inverse[1:] = u(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    start, end = off[:-1], off[1:]
    n, every = end - start, np.arange(len(start))
    p, less = _piece(n), _piece(np.maximum(n - 2, 1))  # of three neighbouring lengths at most two sizes of piece come out
    rows, keys = [], []
    for turn, letters in ((0, flat), (1, rotated(flat, off))):
        run = np.concatenate(([u(0)], np.cumsum((letters.astype(u) + u(1)) * power[:-1], dtype=u)))

        def add(role: int, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int, who: np.ndarray = every) -> None:
            h = (run[b] - run[a]) * inverse[a] + u(0xD6E8FEB86659FD93) * (np.asarray(salt).astype(u) + (b - a).astype(u) * u(1 << 20))
            h = (h ^ (h >> u(32))) * u(0xD6E8FEB86659FD93) + scope[who].view(u)
            h = (h ^ (h >> u(29))) * u(0xBF58476D1CE4E5B9)
            rows.append(who)
            keys.append(((h ^ (h >> u(32))) & ~u(7) | u(role + turn)).view(np.int64))  # noqa: B023

        add(0, start, start + p, 1)
        add(0, end - p, end, 2)
        other = np.flatnonzero((less != p) & (less <= n))
        add(0, start[other], (start + less)[other], 1, other)
        add(0, (end - less)[other], end[other], 2, other)
        for role, fewer, shift in ((4, 0, 0), (6, 0, -1), (6, 0, 0), (6, 0, 1), (6, 1, 0), (6, 1, 1), (6, 2, 1)):
            who = np.flatnonzero(n > fewer)
            m = n[who] - fewer
            q = _piece(m)
            long = np.maximum(m - 2 * q, 0)
            at = np.where(long > 0, start[who] + q + shift, start[who])
            add(role, at, at + long, 3 + 16 * m, who)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key of each barcode (w: hash of the scope): (key, uid, b, n)."""
    for batch in batches:
        if batch.num_rows:
            row, key = _keys(batch.column("w").to_numpy(), *arrow_letters(batch.column("b")))
            for a in range(0, len(row), 50_000):
                t = pa.array(row[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 50_000]), *[batch.column(c).take(t) for c in ("uid", "b", "n")]], ["key", "uid", "b", "n"])


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of :func:`_keyed` fall in each of 2**16 slots of keys."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_keys(batch.column("w").to_numpy(), *arrow_letters(batch.column("b")))[1] >> 3 & 0xFFFF, minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "c"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Barcode pairs within 2 edits among the rows of each key: (x, y, nx, ny), each pair once a partition."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    t = pa.Table.from_batches(some)
    del some
    key, uid = t["key"].to_numpy(), t["uid"].to_numpy()
    code, ids = pd.factorize(uid)
    first = np.empty(len(ids), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    count = t["n"].to_numpy()[first]
    fp, off = arrow_letters(t["b"].combine_chunks().take(pa.array(first)))
    fr = rotated(fp, off)
    del t, uid
    sk = np.concatenate((gram_parity(fp, off), gram_parity(fr, off)))
    flat, both = np.concatenate((fp, fr)), np.concatenate((off[:-1], off[:-1] + len(fp)))
    length = np.tile(np.diff(off), 2)
    edits = EditCheck(flat, both, length)
    order = np.argsort(key)
    key, role = key[order] & ~7, key[order] & 7
    node = code[order] + (role & 1).astype(np.int64) * len(ids)
    edge = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) + 1
    end = edge[np.searchsorted(edge, np.arange(len(key)), "right")]
    # start and end pieces meet all that follow in their key; middle pieces only the look-ups
    seek = np.cumsum(role >= 6)
    lookups = seek[end - 1] - seek
    start = np.where(role < 4, np.arange(len(key)) + 1, end - lookups)
    many = np.where(role < 4, end - np.arange(len(key)) - 1, np.where(role < 6, lookups, 0))
    own = sk[node]  # in the order of the rows: partners lie side by side, and few pairs get past their sketches
    found, waiting = [np.zeros(0, np.int64)], []

    def settle() -> None:
        pair = distinct(np.concatenate(waiting))
        waiting.clear()
        x, y = pair // (2 * len(ids)), pair % (2 * len(ids))
        ok = edits.within(x, y)
        x, y = x[ok] % len(ids), y[ok] % len(ids)
        found.append(distinct(np.minimum(x, y) * len(ids) + np.maximum(x, y)))

    many_wait = 0
    for i, j in close_pairs(own, start, many, 12):
        x, y = node[i], node[j]
        keep = ~((x >= len(ids)) & (y >= len(ids))) & (x % len(ids) != y % len(ids)) & (np.abs(length[x] - length[y]) <= 2)
        waiting.append(x[keep] * (2 * len(ids)) + y[keep])
        many_wait += len(waiting[-1])
        if many_wait > 1 << 20:  # what waits is bounded, however many partners a key has
            settle()
            many_wait = 0
    if waiting:
        settle()
    pair = distinct(np.concatenate(found))
    x, y = pair // len(ids), pair % len(ids)
    for a in range(0, len(x), 100_000):
        u, v = x[a : a + 100_000], y[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in (ids[u], ids[v], count[u], count[v])], ["x", "y", "nx", "ny"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """The rows of a partition sorted by ``grp``, whole groups, about BATCH_ROWS at a time: (group numbers, rows)."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    t = pa.Table.from_batches(some).combine_chunks()
    del some
    code = pc.dictionary_encode(t["grp"]).chunk(0).indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + BATCH_ROWS, "right")) - 1)
        yield code[cuts[a] : cuts[b]], t.take(pa.array(order[cuts[a] : cuts[b]])).combine_chunks()
        a = b


def _sets(t: pa.Table, k: int) -> Sets:
    return Sets(*arrow_letters(t["s"].chunk(0)), k)


def _region_join(k: int, threshold: float, leaf: int):
    """Similar pairs of each group, without those of a common bit in ``mask``.

    Groups go through pivots, regions and windows together; only in pairs of tiles of rows that no pivot could divide is
    every row of the one tile a pivot of its own.
    """

    def found(group: np.ndarray, mask: np.ndarray, sets: Sets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        paired = np.isin(group, group[(mask & (LEFT | RIGHT)) != 0])
        at = np.flatnonzero(~paired)
        for i, j in metric_join(sets, group[at], at, mask[at], threshold, leaf=leaf):
            yield at[i], at[j]
        for g in np.unique(group[paired]):
            own = np.flatnonzero(group == g)
            for i, j in cross_pairs(sets, own[(mask[own] & LEFT) != 0], own[(mask[own] & RIGHT) != 0], threshold):
                ok = (mask[i] & mask[j]) == 0
                yield i[ok], j[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in _whole_groups(batches):
            rid = t["id"].to_numpy()
            for i, j in found(group, t["mask"].to_numpy(), _sets(t, k)):
                x, y = rid[i], rid[j]
                keep = x != y  # a row delivered twice
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], ["a", "b"])

    return run


def _assign(k: int, threshold: float, cap: float, bit: int):
    """Divide the rows of tiles among the pivots that were sent to them: rows (pivot, mask, id, s), pivot null where none claims the row.

    A row goes home to its nearest pivot within ``cap``, and as a guest (with ``bit``) to every pivot within cap + 1 -
    threshold that isn't behind its home in order.
    """
    reach = cap + 1 - threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in _whole_groups(batches):
            sets, sent, rid, mask = _sets(t, k), t["pivot"].to_numpy().astype(bool), t["id"].to_numpy(), t["mask"].to_numpy()
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                piv, rows = at[sent[at]], at[~sent[at]]
                name, first = np.unique(rid[piv], return_index=True)  # one order of the pivots in all tiles
                piv = piv[first]
                i, q, d = near_pivots(sets, rows, piv, min(reach, 1 - 1e-9))
                home, _ = voronoi(i, q, d, len(rows), cap)
                guest = (home[i] != q) & ~((home[i] >= 0) & (home[i] < q))
                own = np.arange(len(rows))
                row = rows[np.concatenate((own, i[guest]))]
                to = np.concatenate((home, q[guest]))
                m = mask[row] | np.where(np.arange(len(row)) < len(rows), 0, bit)
                names = pa.array(name[np.maximum(to, 0)] if len(name) else np.zeros(len(to), np.int64), mask=to < 0)
                yield pa.RecordBatch.from_arrays([t["grp0"].chunk(0).take(pa.array(row)), names, pa.array(m), pa.array(rid[row]), t["s"].chunk(0).take(pa.array(row))], ["grp", "pivot", "mask", "id", "s"])

    return run


def _divide_hot(hot: DataFrame, k: int, threshold: float, tile: int, parts: int, *, cap: float = CAP, depth: int = 0) -> list[DataFrame]:
    """Groups of at most about ``tile`` rows (grp, mask, id, s) in which all wanted pairs of the hot groups (grp, mask, id, s, n) meet.

    Rounds of pivots: PIVOTS rows of each group, chosen by hash, are sent to all its tiles; the tiles assign their rows
    to regions and windows. Unclaimed rows go on with more pivots; regions that are hot themselves are divided again with
    half the radius. Where a round claims little besides its pivots (unrelated rows, all at a distance near 1), after
    ROUNDS, or where the radius is near 0 (copies, whose pairs are all in the result), tiles meet in pairs.
    """
    names = "grp string, pivot bigint, mask bigint, id bigint, s string"
    out, rounds, pivots = [], 0, min(PIVOTS, max(2, tile // 8))
    act = hot
    while True:
        spread = F.ceil(F.col("n") / tile).cast("int")
        chosen = F.pmod(F.xxhash64("id", F.lit(f"p{depth}.{rounds}")), F.col("n")) < pivots
        cell = F.concat_ws("/", "grp", F.col("_t").cast("string"))
        rows = act.withColumn("_t", F.pmod(F.xxhash64("id", F.lit("t")), spread).cast("int")).select(cell.alias("grp"), F.col("grp").alias("grp0"), F.lit(0).alias("pivot"), "mask", "id", "s")
        sent = act.where(chosen).withColumn("_t", F.explode(F.sequence(F.lit(0), spread - 1))).select(cell.alias("grp"), F.col("grp").alias("grp0"), F.lit(1).alias("pivot"), "mask", "id", "s")
        dealt = cut(rows.unionByName(sent).repartition(parts, "grp").mapInArrow(_assign(k, threshold, cap, 1 << (50 + 2 * depth)), names), "regions")
        claimed = dealt.where("pivot is not null").withColumn("grp", F.concat_ws("|", "grp", F.col("pivot").cast("string"))).drop("pivot")
        sizes = claimed.groupBy("grp").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > tile)
        if large.limit(1).count():
            out.append(claimed.join(large, "grp", "left_anti"))
            again = cut(claimed.join(large, "grp"), "hot")
            out += _divide_hot(again, k, threshold, tile, parts, cap=cap / 2, depth=depth + 1) if depth < DEPTH else [_tile_pairs(again, 2 * tile)]
        else:
            out.append(claimed)
        rest = dealt.where("pivot is null").drop("pivot")
        left = rest.groupBy("grp").agg(F.count("*").alias("n"))
        state = cut(left.join(act.groupBy("grp").agg(F.max("n").alias("was")), "grp"), "left")
        small, more = state.where(F.col("n") <= tile), state.where(F.col("n") > tile)
        out.append(rest.join(small.select("grp"), "grp", "left_semi"))
        stuck = (F.col("was") - F.col("n") < F.greatest(F.lit(1.05 * pivots), F.col("was") / 50)) | F.lit(rounds + 1 >= ROUNDS)
        barren, fruitful = more.where(stuck), more.where(~stuck)
        if barren.limit(1).count():
            out.append(_tile_pairs(rest.join(barren.select("grp", "n"), "grp"), 2 * tile))
        if not fruitful.limit(1).count():
            return out
        act = cut(rest.join(fruitful.select("grp", "n"), "grp"), "hot")
        rounds, pivots = rounds + 1, min(4 * pivots, tile // 2)


def _tile_pairs(rows: DataFrame, tile: int) -> DataFrame:
    """Rows (grp, mask, id, s, n) in groups of two tiles each, every pair of rows once."""
    t = F.ceil(F.col("n") / tile).cast("int")
    r = rows.withColumn("_t", F.pmod(F.xxhash64("id", F.lit("t")), t).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), t - 1)))
    pair = F.concat_ws("/", "grp", F.least("_t", "_o").cast("string"), F.greatest("_t", "_o").cast("string"))
    side = F.when(F.col("_t") < F.col("_o"), F.lit(LEFT)).when(F.col("_t") > F.col("_o"), F.lit(RIGHT)).otherwise(F.lit(0))
    return r.select(pair.alias("grp"), F.col("mask").bitwiseOR(side).alias("mask"), "id", "s")


def near_duplicates(
    records: DataFrame,
    record_id: str,
    scope: list[str],
    barcode: Column,
    sequence: Column,
    *,
    k: int = 6,
    threshold: float = 0.5,
    tile: int = TILE,
    key_tile: int = KEY_TILE,
    leaf: int = LEAF,
) -> DataFrame:
    """All pairs (``id_a`` < ``id_b``) of records of one scope with nearly equal barcodes and similar sequences.

    Barcodes: at most 2 single-letter edits apart, as they are or after one of the two had its first floor(length / 2)
    letters moved behind the rest. Sequences: the Jaccard similarity of their sets of distinct k-letter substrings is at
    least ``threshold``. The result is exact and holds every pair.

    The pair condition is a ball in two metrics. Edit distance: every different barcode is a centre whose records are its
    region (radius 0); partners lie within 2 edits, and that window is replicated into it - of two neighbouring
    regions the smaller moves. Which barcodes are neighbours is found by equal pieces. Jaccard distance: each such
    region is joined by pivots, Voronoi regions of small radius, triangle-inequality windows and recursion
    (:func:`readloom.llm.setjoin.metric_join`). A region of more than ``tile`` records is
    first divided by pivots in Spark stages (:func:`_divide_hot`), so no task holds an unbounded region; unrelated rows of one
    barcode, which no pivot divides, meet tile by tile.

    Defined cases: rows with a null scope, id, barcode or sequence, a blank barcode or a sequence of fewer than k letters
    are in no pair; a row delivered twice counts once; equal sequences are similar; empty inputs give no row; other
    columns are ignored.
    """
    spark = records.sparkSession
    ship(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sc = [f"_s{i}" for i in range(len(scope))]
    rows = (
        records.select(*[F.col(c).alias(a) for c, a in zip(scope, sc)], F.col(record_id).cast("bigint").alias("id"), barcode.alias("b"), sequence.alias("s"))
        .where((F.length("b") > 0) & (F.length("s") >= k) & F.col("id").isNotNull())
    )
    for c in sc:
        rows = rows.where(F.col(c).isNotNull())
    # a number for each different barcode of a scope: no hash, so two can't be taken for one
    counts = cut(rows.groupBy(*sc, "b").agg(F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id()), "barcodes")
    n_codes, n_rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    barcodes = counts.select("uid", "b", "n", (F.xxhash64(*sc) if sc else F.lit(0).cast("bigint")).alias("w"))
    keyed = barcodes.mapInArrow(_keyed, "key bigint, uid bigint, b string, n bigint")
    piece = F.shiftright("key", 3)
    # only where some slot of keys is that full, one of its keys may be
    crowd = barcodes.mapInArrow(_crowds, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).where(F.col("c") > key_tile)
    if n_codes * 30 > key_tile and crowd.limit(1).count():
        hot = cut(keyed.groupBy(piece.alias("_p")).agg(F.count("*").alias("c")).where(F.col("c") > key_tile), "keys")
        if hot.limit(1).count():  # such a key is dealt to pairs of parts
            t = F.ceil(F.coalesce("c", F.lit(1)) / key_tile).cast("int")
            keyed = keyed.join(hot, piece == F.col("_p"), "left").withColumn("_t", F.pmod(F.xxhash64("uid"), t).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), t - 1)))
            dealt = F.xxhash64(piece, F.least("_t", "_o"), F.greatest("_t", "_o")).bitwiseAND(F.lit(-8)).bitwiseOR(F.col("key").bitwiseAND(F.lit(7)))
            keyed = keyed.select(F.when(t > 1, dealt).otherwise(F.col("key")).alias("key"), "uid", "b", "n")
    links = keyed.repartition(max(4 * shuffles, n_codes // 10_000), piece).mapInArrow(_candidates, "x bigint, y bigint, nx bigint, ny bigint").distinct()
    # the smaller region's records move to the larger region
    less = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    moves = cut(links.select(F.when(less, F.col("x")).otherwise(F.col("y")).alias("src"), F.when(less, F.col("y")).otherwise(F.col("x")).alias("dst"), F.least("nx", "ny").alias("n")), "moves")
    guests = moves.groupBy("dst").agg(F.sum("n").alias("w"))
    homes = cut(counts.join(guests, counts["uid"] == guests["dst"], "left").select("uid", *sc, "b", (F.col("n") + F.coalesce("w", F.lit(0))).alias("total")).where("total > 1"), "regions")
    drop = [f"_d{i}" for i in range(len(sc))]
    to = homes.select(F.col("uid").alias("dst"), "total", *[F.col(c).alias(d) for c, d in zip(sc, drop)])
    of = counts.select(F.col("uid").alias("src"), *sc, "b")
    moved = moves.select("src", "dst").join(to, "dst").join(of, "src")
    for c, d in zip(sc, drop):  # keys are hashes, scopes are compared
        moved = moved.where(F.col(c) == F.col(d))
    plan = homes.select(*sc, "b", F.col("uid").alias("dst"), "total", F.lit(0).cast("bigint").alias("mask")).unionByName(moved.select(*sc, "b", "dst", "total", F.lit(1).cast("bigint").alias("mask")))
    placed = lambda p: rows.join(p, [*sc, "b"]).select(F.col("dst").cast("string").alias("grp"), "mask", "id", "s", F.col("total").alias("n"))
    parts = max(4 * shuffles, int(n_rows) // PARTITION_ROWS)
    groups = placed(plan.where(F.col("total") <= tile)).drop("n")
    if homes.where(F.col("total") > tile).limit(1).count():
        few = cut(plan.where(F.col("total") > tile), "plan")  # written, so that Spark knows its size
        for more in _divide_hot(cut(placed(few), "hot"), k, threshold, tile, parts):
            groups = groups.unionByName(more)
    pairs = groups.repartition(parts, "grp").mapInArrow(_region_join(k, threshold, leaf), "a bigint, b bigint")
    return pairs.distinct().select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
