"""Exact Jaccard join of word-shingle sets as a metric-space join.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric on finite sets, and so is the symmetric difference D = |x ^ y|.
The join partitions that space by pivots, level by level:

1. Singleton pivots. Every shingle s is a pivot {s}; a set is equally near to those of its own shingles, so one global order
   (rare before common, then hash) breaks the tie and the first shingle names the home region. A set y within the threshold of
   x keeps all but |x| - ceil(t |x|) shingles of x, so the smallest shared shingle is among the first |x| - ceil(t |x|) + 1 of
   x: that is the boundary window in which x is replicated. Shingles that only one set has make no region.
2. Origin pivot. D(x, {}) = |x|: regions are cut where neighbouring sizes differ by more than the threshold allows.
3. Hash-cell pivots. The counts of a set in 512 hash cells are its coordinates; the sum of their differences never exceeds D.
   Sets farther apart than D allows are separated, and equal regions met under several shingles are joined once.
4. Document pivots. Inside a region farthest-first pivots make Voronoi cells by exact distance; x is replicated to the cell of
   p_j when d(x, p_j) <= d(x, p_i) + 2 t, and cells are joined recursively. In a cell that pivots do not divide each pair is
   compared, those of one class too: every link is found, and each pair has one home region.

A region of more members than `REGION` is never gathered in a task: its members are banded by size (origin pivot), the bands
dealt to blocks of about `BLOCK` members, and each two blocks whose bands may hold a link meet in a task of their own.

n_links of a row is the number of other rows whose sets are within the threshold of its own; rows with equal sets count.

Defined results: no words or null text -> empty set, linked with nothing, not even another empty one; fewer words than a shingle has -> the whole sequence is
the one shingle; repeated rows and repeated ids are rows of their own; a null id is never a class id unless all its class has
none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bag, ensure_columns, kept, materialize, partitions, seeded, shingle_hashes, slabs, splitmix, utf8, whole_hash, word_hashes
from .components import connected_components

#: Members of a region that one task may gather; more are joined in distributed rounds.
REGION = 2048
#: Shingles of all its members that one task may gather.
WEIGHT = 6_000_000
#: Members of one block of a larger region; a task holds two blocks.
BLOCK, BLOCK_WEIGHT = 1000, 1_000_000
#: Common shingles that are put last in the order: a bounded list, it changes the work and never the result.
COMMON = 131_072
#: Cells of the coordinates of level 3.
CELLS = 512


def shingle_sets(column: pa.Array, k: int):
    """For each text its sorted distinct shingle hashes."""
    body, off = utf8(column)
    for lo, hi in slabs(off):
        _, _, words, at = word_hashes(body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        for i in range(hi - lo):
            w = words[at[i] : at[i + 1]]
            yield np.unique(shingle_hashes(w, k) if len(w) >= k else whole_hash(w)) if len(w) else w


def set_key(x: np.ndarray) -> bytes:
    """96 bits that name a set, whatever its order."""
    return np.array([(splitmix(x) + np.uint64(len(x))).sum(), splitmix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes()[:12] if len(x) else b""


def cell_counts(x: np.ndarray) -> bytes:
    return np.minimum(np.bincount((x >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()


def needed(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of the most frequent shingles, ascending by count: shingles of two sets of a batch, counted over all batches."""

    def count(batches):
        for b in batches:
            sets = {set_key(x): x for x in shingle_sets(b.column(0), k)}
            if len(sets) > 1:
                all_ = np.sort(np.concatenate(list(sets.values())))
                first = bag(all_, len(all_))
                n = np.diff(np.append(first, len(all_)))
                yield pa.record_batch([pa.array(all_[first[n > 1]].view(np.int64)), pa.array(n[n > 1])], names=["s", "c"])

    rows = docs.select("text").mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where("c >= 8").orderBy(F.desc("c"), "s").limit(COMMON).collect()
    return np.array([r.s for r in reversed(rows)], np.int64).view(np.uint64)


def documents_in_space(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(doc_id, h, k, n, window, cells) per row of docs, h the text's hash; window and cells only where a task meets the set first."""
    order = np.argsort(common)
    hashes, rank = common[order], order

    def window(x: np.ndarray) -> np.ndarray:
        most = len(x) - needed(len(x), num, den) + 1
        if not len(hashes):
            return x[:most]
        at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
        is_common = hashes[at] == x
        rare = x[~is_common]
        if len(rare) < most:
            late = x[is_common]
            rare = np.concatenate([rare, late[np.argsort(rank[at[is_common]])]])
        return rare[:most]

    def place(batches):
        met: set[bytes] = set()
        for b in batches:
            keys, sizes, windows, cells = [], [], [], []
            for x in shingle_sets(b.column(2), k):
                key = set_key(x)
                fresh = len(x) > 0 and key not in met
                if fresh and len(met) < 500_000:
                    met.add(key)
                keys.append(key)
                sizes.append(len(x))
                windows.append(window(x) if fresh else None)
                cells.append(cell_counts(x) if fresh else None)
            flat = np.concatenate([w for w in windows if w is not None] or [np.zeros(0, np.uint64)])
            ends = np.cumsum([0] + [0 if w is None else len(w) for w in windows]).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), pa.array(cells, pa.binary())], names=["doc_id", "h", "k", "n", "window", "cells"])

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    return hashed.mapInArrow(place, "doc_id long, h long, k binary, n int, window array<long>, cells binary")


def _region_name(members: list[bytes]) -> int:
    parts = np.frombuffer(b"".join(sorted(members)), np.uint32).astype(np.uint64)
    return int(splitmix(parts * seeded(len(parts), 3)).sum().view(np.int64))


def regions(space: DataFrame, num: int, den: int) -> DataFrame:
    """(region, k, n, large): levels 1 and 2. Rows arrive sorted by shingle, so a task holds `REGION` members at a time."""
    spark = space.sparkSession
    rows = space.where("n > 0").select(F.explode("window").alias("s"), "k", "n").repartition(partitions(spark), "s").sortWithinPartitions("s", "k")

    def cut(batches):
        named: set[int] = set()
        s_now, held, last, large = None, [], None, False
        out: list[tuple] = []

        def close():
            nonlocal held
            if large or len(held) < 2:
                held = []
                return
            held.sort(key=lambda m: m[1])
            group = [held[0]]
            for m in [*held[1:], (b"", 1 << 60)]:
                if group[-1][1] * den < num * m[1]:
                    if len(group) > 1:
                        name = _region_name([g[0] for g in group])
                        if name not in named:
                            if len(named) < 500_000:
                                named.add(name)
                            out.extend((name, g[0], g[1], False) for g in group)
                    group = []
                group.append(m)
            held = []

        for b in batches:
            s = np.asarray(b.column(0))
            if not len(s):
                continue
            run = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(run, len(s)))
            busy = np.repeat((size > 1) | (np.arange(len(run)) == 0) | (np.arange(len(run)) == len(run) - 1), size)
            at = np.flatnonzero(busy)  # a shingle of one set, not at an edge of the batch, makes no region
            for sh, key, n in zip(s[at].tolist(), b.column(1).take(pa.array(at)).to_pylist(), b.column(2).take(pa.array(at)).to_pylist(), strict=True):
                if sh != s_now:
                    close()
                    s_now, last, large = sh, None, False
                if key == last:
                    continue
                last = key
                if large:
                    out.append((sh, key, n, True))
                    continue
                held.append((key, n))
                if len(held) > REGION:
                    large = True
                    out.extend((sh, *m, True) for m in held)
                    held = []
            if len(out) > 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=["region", "k", "n", "large"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=["region", "k", "n", "large"])

    return rows.mapInArrow(cut, "region long, k binary, n int, large boolean")


def near_in_cells(sizes: np.ndarray, cells: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Level 3: the groups that remain when pairs farther apart than the threshold allows, by size or cell counts, are cut.

    A group grows from a seed: only members that no group has yet are compared with those that have just come in."""
    c, free, groups = cells.astype(np.int16), np.arange(len(sizes)), []
    while len(free):
        group, free = [free[0]], free[1:]
        at = 0
        while at < len(group) and len(free):
            n, m = sizes[group[at]], sizes[free]
            fits = np.minimum(n, m) * den >= num * np.maximum(n, m)
            some = np.flatnonzero(fits)
            apart = np.abs(c[free[some]] - c[group[at]]).sum(1, dtype=np.int64)
            both = (n + m[some] - apart) // 2  # most that the intersection can be
            take = some[den * both >= num * (n + m[some] - both)]
            group.extend(free[take])
            free = np.delete(free, take)
            at += 1
        if len(group) > 1:
            groups.append(np.array(group))
    return groups


def shared_counts(pivot: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one set with several, given end to end; no set is empty."""
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), starts)


def shared_matrix(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 2048, most: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one (with each left one if right is None).

    Shingles of many sets are multiplied as columns of a 0/1 matrix, those of few are counted pair by pair."""
    every = left if right is None else [*left, *right]
    nl, nr = len(left), len(left if right is None else right)
    flat = np.concatenate(every)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(every), dtype=np.int32), [len(x) for x in every])[order]
    flat = flat[order]
    del order
    col = np.cumsum(np.append(False, flat[1:] != flat[:-1]), dtype=np.int32)
    if right is None:
        a, ac, b, bc = owner, col, owner, col
    else:
        of_left = owner < nl
        a, ac, b, bc = owner[of_left], col[of_left], owner[~of_left] - nl, col[~of_left]
    n = int(col[-1]) + 1
    in_right = np.bincount(bc, minlength=n)
    pairs = np.bincount(ac, minlength=n) * in_right
    dense = pairs * 150 > nl * nr
    out = np.zeros((nl, nr), np.int32)

    which = np.flatnonzero(dense)
    rank = np.full(n, -1, np.int32)
    rank[which] = np.arange(len(which))
    sides = []
    for own, c in ((a, ac), (b, bc)):
        r = rank[c]
        sides.append((own[r >= 0], r[r >= 0]))
    for lo in range(0, len(which), width):
        part = []
        for (own, r), m in zip(sides, (nl, nr), strict=True):
            i, j = np.searchsorted(r, [lo, lo + width])
            x = np.zeros((m, min(width, len(which) - lo)), np.float32)
            x[own[i:j], r[i:j] - lo] = 1
            part.append(x)
        out += (part[0] @ part[1].T).astype(np.int32)

    e = np.flatnonzero(~dense[ac] & (pairs[ac] > 0))
    count = in_right[ac[e]]
    first = np.searchsorted(bc, ac[e])
    ends = np.cumsum(count)
    at, flat_out = 0, out.reshape(-1)
    while at < len(e):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        c = count[at:end]
        partner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:end], c)
        np.add.at(flat_out, np.repeat(a[e[at:end]].astype(np.int64), c) * nr + b[partner], 1)
        at = end
    return out


def near_matrix(sets: list[np.ndarray], num: int, den: int, most_pivots: int = 8, leaf: int = 24) -> np.ndarray:
    """Level 4: which members of a region are linked, each pair of them, as a symmetric matrix."""
    t = 1 - num / den + 1e-9
    sizes = np.array([len(x) for x in sets])
    near = np.zeros((len(sets), len(sets)), bool)
    stack = [np.arange(len(sets))]
    while stack:
        members = stack.pop()
        if len(members) > leaf:
            pivots, rows, nearest = [0], [], None
            while len(pivots) <= min(most_pivots, int(len(members) ** 0.5)):
                p = members[pivots[-1]]
                both = shared_with(sets[p], [sets[i] for i in members])
                rows.append(1 - both / (sizes[members] + sizes[p] - both))
                nearest = rows[-1] if nearest is None else np.minimum(nearest, rows[-1])
                if nearest.max() <= t:
                    break
                pivots.append(int(nearest.argmax()))
            d = np.array(rows)
            home = d.argmin(0)
            cells = [np.flatnonzero((home == j) | (d[j] <= d.min(0) + 2 * t)) for j in range(len(d))]
            # where windows overlap too much to divide by, what is left is compared as it is
            if sum(map(len, cells)) <= 1.5 * len(members) and max(map(len, cells)) < len(members):
                stack.extend(members[cell] for cell in cells if len(cell) > 1)
                continue
        both = shared_matrix([sets[i] for i in members]).astype(np.int64)
        own = sizes[members]
        near[np.ix_(members, members)] |= den * both >= num * (own[:, None] + own[None, :] - both)
    np.fill_diagonal(near, False)
    return near


def join_region(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """All links between the members of a region, each once."""
    return [(i, j) for i, j in np.argwhere(np.triu(near_matrix(sets, num, den), 1)).tolist()]


def first_of_class(near: np.ndarray) -> np.ndarray:
    """For each member the first one that it is linked with, directly or not; itself if it is the first."""
    label = np.full(len(near), -1)
    for s in range(len(near)):
        fresh = np.array([s]) if label[s] < 0 else np.zeros(0, np.int64)
        while len(fresh):
            label[fresh] = s
            fresh = np.flatnonzero(near[fresh].any(0) & (label < 0))
    return label


def shared_with(pivot: np.ndarray, sets: list[np.ndarray], most: int = 1 << 19) -> np.ndarray:
    """Sizes of the intersections of one set with several, some of them at a time."""
    out, at = [], 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (held == 0 or held + len(sets[end]) <= most):
            held += len(sets[end])
            end += 1
        starts = np.cumsum([0] + [len(x) for x in sets[at : end - 1]])
        out.append(shared_counts(pivot, np.concatenate(sets[at:end]), starts))
        at = end
    return np.concatenate(out)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column as views of its one buffer."""
    body, off = utf8(column)
    return [body[a:z].view(np.uint64) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


_LINKED = "a binary, b binary, links long"


def _arrow_classes(keys: list[bytes], near: np.ndarray, copies: np.ndarray) -> pa.Table:
    """(a, b, links): each member, the first of its class, and the rows that its links lead to."""
    first = first_of_class(near)
    links = np.array([copies[row].sum() for row in near], np.int64)
    return pa.table({"a": pa.array(keys, pa.binary()), "b": pa.array([keys[i] for i in first], pa.binary()), "links": pa.array(links)})


def _arrow_links(found: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


def _filter_bits(keys: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A Bloom filter of fixed size (1 MB) over 12-byte keys, merged piece by piece; it may pass too much, never too little."""
    piece = 1 << 16

    def mark(batches):
        seen = np.zeros(bits, bool)
        for b in batches:
            k = b.column(0).to_pylist()
            if k:
                seen[np.frombuffer(b"".join(k), np.uint32) % np.uint32(bits)] = True
        packed = np.packbits(seen)
        for i in range(0, len(packed), piece):
            if packed[i : i + piece].any():
                yield pa.record_batch([pa.array([i // piece]), pa.array([packed[i : i + piece].tobytes()])], names=["i", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        out = np.zeros(piece, np.uint8)
        for x in t.column("bits").to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"i": t.column("i")[:1], "bits": [out.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    marked = keys.coalesce(max(1, min(16, partitions(keys.sparkSession)))).mapInArrow(mark, "i long, bits binary")
    for r in marked.groupBy("i").applyInArrow(merge, "i long, bits binary").collect():
        out[r.i * piece : (r.i + 1) * piece] = np.frombuffer(r.bits, np.uint8)
    return out


def _may_hold(packed: np.ndarray, keys: list[bytes]) -> np.ndarray:
    at = (np.frombuffer(b"".join(keys), np.uint32).reshape(-1, 3) % np.uint32(len(packed) * 8)).astype(np.int64)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _sets_of(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """keys with x, the shingle set of each, made again from the texts so that it need not be stored for all."""
    packed = _filter_bits(keys.select("k"))

    def pick(batches):
        met: set[bytes] = set()
        for b in batches:
            out = [(key, x) for x in shingle_sets(b.column(0), k) if len(x) and (key := set_key(x)) not in met and _may_hold(packed, [key])[0]]
            fresh = dict(out)
            if len(met) < 500_000:
                met |= fresh.keys()
            for i in range(0, len(fresh), 200):
                part = list(fresh.items())[i : i + 200]
                yield pa.record_batch([pa.array([p[0] for p in part], pa.binary()), pa.array([p[1].tobytes() for p in part], pa.binary())], names=["k", "x"])

    # copies that several tasks met are reduced to one; the join and the group-by share one exchange
    found = docs.select("text").mapInArrow(pick, "k binary, x binary")
    return found.join(keys, "k").groupBy("k", *[c for c in keys.columns if c != "k"]).agg(F.min("x").alias("x"))


def _region_links(groups: DataFrame, num: int, den: int) -> DataFrame:
    def links(t: pa.Table) -> pa.Table:
        return _arrow_classes(t.column("k").to_pylist(), near_matrix(_sets(t.column("x")), num, den), t.column("copies").to_numpy())

    return groups.groupBy("region").applyInArrow(links, _LINKED)


def _large_links(groups: DataFrame, num: int, den: int) -> DataFrame:
    """The links of regions that no task may gather: blocks of members meet two by two, each two once."""
    # sets whose bands are not the same or neighbours differ in size by more than the threshold allows
    band = F.floor(F.log("n") / (float(np.log(den / num)) * (1 + 1e-9))) if num < den else F.col("n").cast("long")
    groups = groups.withColumn("band", band)
    shares = groups.groupBy("region", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WEIGHT)).alias("shares"))
    members = materialize(groups.join(shares, ["region", "band"]).withColumn("slot", F.pmod(F.xxhash64("k"), "shares")).select("region", F.struct("band", "slot").alias("block"), "k", "copies", "x"), "members")
    blocks = members.select("region", "block").distinct()
    meet = blocks.withColumnRenamed("block", "lo").join(blocks.withColumnRenamed("block", "hi"), "region").where("lo <= hi and hi.band - lo.band <= 1")
    meet = materialize(meet.withColumn("meeting", F.concat_ws(".", "region", "lo.band", "lo.slot", "hi.band", "hi.slot")), "meetings")
    meet = meet.withColumn("own", F.col("lo") == F.col("hi"))
    side = lambda which: members.join(meet.select("region", F.col(which).alias("block"), "meeting", "own"), ["region", "block"]).select("meeting", "own", "k", "copies", "x")

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, x = left.column("k").to_pylist(), _sets(left.column("x"))
        copies = left.column("copies").to_numpy()
        if left.column("own")[0].as_py():
            return _arrow_classes(keys, near_matrix(x, num, den), copies)
        y, n = _sets(right.column("y")), len(x)
        both = shared_matrix(x, y).astype(np.int64)
        near = np.zeros((n + len(y), n + len(y)), bool)
        near[:n, n:] = den * both >= num * (np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both)
        near |= near.T
        return _arrow_classes(keys + right.column("key").to_pylist(), near, np.concatenate([copies, right.column("rows").to_numpy()]))

    # new names keep the two sides, which come from the same tables, apart
    again = side("hi").select(F.col("meeting").alias("meets"), F.col("own").alias("same"), F.col("k").alias("key"), F.col("copies").alias("rows"), F.col("x").alias("y"))
    return side("lo").groupBy("meeting").cogroup(again.groupBy("meets")).applyInArrow(linked, _LINKED)


def _named_sets(documents: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, k, n, ...) per row; per distinct set that is not empty (k, c, least, copies), c naming its class; links of each set."""
    docs = ensure_columns(documents, doc_id="long", text="string")
    space = kept(documents_in_space(docs, k, num, den, common_shingles(docs, k)))
    # without repeats before they are written: few files of many rows, not one for each task of the sort
    found = materialize(regions(space, num, den).distinct(), "regions")
    small = found.where("not large").select("region", "k", "n")
    wanted = _filter_bits(small.select("k"))

    def only(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            if keys:
                yield b.filter(pa.array(_may_hold(wanted, keys)))

    cells = space.where("cells is not null").select("k", "cells").mapInArrow(only, "k binary, cells binary").groupBy("k").agg(F.min("cells").alias("cells"))

    def cut(t: pa.Table) -> pa.Table:
        keys, sizes = t.column("k").to_pylist(), t.column("n").to_numpy().astype(np.int64)
        c = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        return _arrow_links([(keys[g[0]], keys[i]) for g in near_in_cells(sizes, c, num, den) for i in g[1:]])

    near = small.join(cells, "k").groupBy("region").applyInArrow(cut, "a binary, b binary")
    large = found.where("large").select("region", "k")
    near = near.union(large.join(large.groupBy("region").agg(F.min("k").alias("a")), "region").select("a", F.col("k").alias("b")))
    # regions that share members are one region: each set is compared in one place
    joint = materialize(connected_components(near).select(F.col("component").alias("region"), F.col("node").alias("k")), "near")
    distinct = materialize(space.where("n > 0").groupBy("k", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    sizes = joint.join(distinct.select("k", "n", "copies"), "k")
    weights = sizes.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    sized = materialize(sizes.join(weights, "region"), "sized")
    fits = (F.col("members") <= REGION) & (F.col("weight") <= WEIGHT)
    links = _region_links(_sets_of(docs, sized.where(fits).select("k", "region", "copies"), k), num, den)
    many = sized.where(~fits)
    if not many.isEmpty():
        links = links.union(_large_links(_sets_of(docs, many.select("k", "region", "n", "copies"), k), num, den))
    links = materialize(links, "links")
    parts = connected_components(links).select(F.col("node").alias("k"), F.col("component").alias("c"))
    counts = links.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    return space, distinct.join(parts, "k", "left").withColumn("c", F.coalesce("c", "k")), counts


def jaccard_classes(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row: sets of k-word shingles link when den * |x & y| >= num * |x | y|."""
    space, classes, counts = _named_sets(documents, k, num, den)
    best = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1  # equal sets are in no list of links
    named = classes.join(best, "c").join(counts, "k", "left").select("k", "component_id", n_links.cast("long").alias("n_links"))
    full = space.where("n > 0").select("doc_id", "k", "n").join(named, "k").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    return full.union(space.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id"), F.lit(0).cast("long")))


def keep_one(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each class, with the columns of documents: that of the smallest doc_id, null last, and then of the smallest set and
    text hash. Rows without words are linked with nothing and all stay."""
    space, classes, _ = _named_sets(documents, k, num, den)
    rows = space.where("n > 0").select("doc_id", "k", "h").join(classes.select("k", "c"), "k")
    last = F.col("doc_id").isNull()
    chosen = rows.groupBy("c").agg(F.min(F.struct(last.alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "k", F.col("h").alias("_h"))).alias("r")).select("r._null", "r._id", "r._h").distinct()
    text = F.coalesce("text", F.lit(""))
    named = documents.withColumn("_null", last).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn("_h", F.xxhash64(text))
    with_words = text.rlike(WORD)
    one = named.where(with_words).join(chosen, ["_null", "_id", "_h"], "left_semi").dropDuplicates(["_null", "_id", "_h"])
    return one.unionByName(named.where(~with_words)).select(documents.columns)
