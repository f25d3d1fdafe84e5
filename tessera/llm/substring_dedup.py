"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes when a string of `length` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in its document.

1. Anchors. Each window of `length` bytes names its smallest `GRAM`-byte hash, rightmost among equals. Equal windows name the same place in
   themselves, so strings that repeat meet at a shared anchor; about one place in thirty is an anchor. Equal texts are one text.
2. Anchors that one place alone has are dropped from a sorted stream; for the rest the bytes around the anchor are fetched.
3. In each group of equal anchors the suffixes from the anchor on, and the reversed prefixes before it, are put in order by merge
   sort. Two suffixes are compared by the longest prefix that they share, which binary search finds from prefix polynomial hashes in
   log(length) steps. Neighbours' common lengths are then checked against the bytes themselves; a group in which a hash
   collided is sorted by its bytes instead. A window that begins o bytes before the anchor repeats another one exactly when their
   prefixes agree for o bytes and their suffixes for length - o, which the two orders tell for all o.
4. A group with more than `GROUP` contexts is never gathered: its windows are named by 128-bit hashes, and the first of each is
   found by a pre-aggregating group-by.

Defined results: null text is empty; texts shorter than `length` lose nothing; rows with the same id and text are one document and get the
same result; of different texts under one id the one with the smaller hash counts as earlier; a null id counts as
larger than all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, materialize, partitions, powers, seeded, splitmix, utf8

GRAM = 40
GROUP = 50_000
#: Bytes of text that the anchor kernel holds at a time; longer texts are read in overlapping pieces.
PIECE = 2 << 20
_BYTE = seeded(256, 101)
_RADIX = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_LAST = (1 << 63) - 1
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"], _tables["down"] = powers(n, _RADIX), powers(n, _INVERSE)
    return _tables["up"][:n], _tables["down"][:n]


def gram_hashes(body: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes from each place on, from prefix sums of a polynomial."""
    up, down = _power_tables(len(body))
    sums = np.empty(len(body) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[body] * up, out=sums[1:])
    return splitmix((sums[gram:] - sums[:-gram]) * down[: len(body) - gram + 1])


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in documents given end to end, and their hashes."""
    if len(body) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full, span = gram_hashes(body, gram), length - gram + 1
    low = np.uint64(0xFFFFFF)
    key = (full & ~low) | (low - np.arange(len(full), dtype=np.uint64))
    least, have = key, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    starts = np.arange(len(least))
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = (low - (least[starts + length <= room] & low)).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, full[at]


def pieces(offsets: np.ndarray, length: int):
    """(document, from, to) in order: whole documents, or overlapping pieces of a long one."""
    for i in range(len(offsets) - 1):
        a, z = int(offsets[i]), int(offsets[i + 1])
        while z - a > PIECE:
            yield i, a, a + PIECE
            a += PIECE - length + 1
        if z - a >= length:
            yield i, a, z


def _content(docs: DataFrame) -> DataFrame:
    """The text's bytes, and 96 bits that name it."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text")).withColumn("h2", F.shiftrightunsigned(F.xxhash64(F.lit("b"), "text"), 32))


def _all_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(g, h, at): at holds 32 bits of the content's name above 32 bits of the place."""

    def find(batches):
        met: set[tuple[int, int]] = set()
        for b in batches:
            body, off = utf8(b.column(0))
            names = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            group, held = [], 0

            def flush(group):
                if not group:
                    return
                ends = np.cumsum([0] + [z - a for _, a, z in group])
                joined = np.concatenate([body[a:z] for _, a, z in group]) if len(group) > 1 else body[group[0][1] : group[0][2]]  # noqa: B023
                at, g = anchors(joined, ends, length)
                which = np.searchsorted(ends, at, "right") - 1
                base = np.array([a - off[i] for i, a, _ in group])[which]  # noqa: B023
                h = np.array([names[i][0] for i, _, _ in group], np.int64)[which]  # noqa: B023
                h2 = np.array([names[i][1] for i, _, _ in group], np.int64)[which]  # noqa: B023
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(h), pa.array(h2 << 32 | (at - ends[which] + base))], names=["g", "h", "at"])

            fresh = -1
            for i, a, z in pieces(off, length):
                if i != fresh:
                    if names[i] in met:
                        continue
                    if len(met) < 500_000:
                        met.add(names[i])
                    fresh = i
                group.append((i, a, z))
                held += z - a
                if held >= PIECE:
                    yield from flush(group)
                    group, held = [], 0
            yield from flush(group)

    return docs.select("text", "h", "h2").mapInArrow(find, "g long, h long, at long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose g more than one place has, each place once; a stream over rows sorted by all three columns."""

    def keep(batches):
        held, repeated = None, False
        for b in batches:
            t = np.column_stack([np.asarray(c) for c in b.columns])
            if not len(t):
                continue
            if held is not None:
                t = np.concatenate([held, t])
            t = t[np.append(True, (t[1:] != t[:-1]).any(1))]
            same = t[1:, 0] == t[:-1, 0]
            before, after = np.append(repeated and held is not None, same), np.append(same, False)
            take = (before | after)[:-1]
            held, repeated = t[-1:], bool(before[-1])
            if take.any():
                yield pa.record_batch([pa.array(t[:-1][take, i]) for i in range(3)], names=["g", "h", "at"])
        if held is not None and repeated:
            yield pa.record_batch([pa.array(held[:, i]) for i in range(3)], names=["g", "h", "at"])

    dealt = rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "h", "at")
    return dealt.mapInArrow(keep, "g long, h long, at long")


# ------------------------------------------------------------------------------------------------ suffix sort


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, .. bytes of each row."""
    up, _ = _power_tables(rows.shape[1])
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum(_BYTE[rows] * up, axis=1, out=out[:, 1:])
    return out


def common_length(hashes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes that rows x and y share from the start, by binary search."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), hashes.shape[1] - 1)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = hashes[x, mid] == hashes[y, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def sort_rows(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows within their groups (which stand together), and each one's common length with the one before it, -1 at
    a group's first. Merge sort: all blocks of a level are merged at once, each row finding its rank in the neighbouring block."""
    n, width = rows.shape
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    size = np.diff(np.append(first, n))
    base, count = np.repeat(first, size), np.repeat(size, size)
    hashes = prefix_hashes(rows)
    padded = np.concatenate([rows, np.zeros((n, 1), np.uint8)], axis=1)
    order, local, level = np.arange(n), np.arange(n) - base, 1

    while level < size.max(initial=1):
        block = local // level
        lo = (block ^ 1) * level
        hi = np.minimum(lo + level, count)
        act = np.flatnonzero(lo < count)
        x, left = order[act], (block[act] & 1) == 0
        a, z = (base + lo)[act], (base + hi)[act]
        start = a.copy()
        while (open_ := a < z).any():
            o = np.flatnonzero(open_)
            mid = (a[o] + z[o]) >> 1
            y = order[mid]
            m = common_length(hashes, x[o], y)
            cx, cy = padded[x[o], m], padded[y, m]
            after = np.where(m < width, cy < cx, ~left[o])  # equal rows keep their blocks' order
            a[o], z[o] = np.where(after, mid + 1, a[o]), np.where(after, z[o], mid)
        place = np.arange(n)
        pair = base[act] + (block[act] & ~1) * level
        place[act] = pair + local[act] % level + (a - start)
        out = np.empty_like(order)
        out[place] = order
        order, level = out, level * 2
    shared = np.full(n, -1)
    inner = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    shared[inner] = common_length(hashes, order[inner - 1], order[inner])
    # verify: the bytes agree for that length, and then the earlier row has the smaller byte
    p, q, m = rows[order[inner - 1]], rows[order[inner]], shared[inner]
    true = np.where((p != q).any(1), (p != q).argmax(1), width)
    at = np.minimum(true, width - 1)
    rising = (true == width) | (p[np.arange(len(inner)), at] < q[np.arange(len(inner)), at])
    if ((true != m) | ~rising).any():
        order = np.lexsort([*rows.T[::-1], groups])
        p, q = rows[order[inner - 1]], rows[order[inner]]
        shared[inner] = np.where((p != q).any(1), (p != q).argmax(1), width)
    return order, shared


def repeated_windows(contexts: np.ndarray, left: np.ndarray, right: np.ndarray, groups: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """Bit o of the result: the window from o bytes before the anchor on repeats one of an earlier row of the group.

    Rows are contexts of length - gram bytes before the anchor and `length` from it on, of which left and right bytes exist, earliest first
    in each group."""
    n, back = len(contexts), length - gram
    out = np.zeros(n, np.uint64)

    def ranks(rows):
        order, shared = sort_rows(rows, groups)
        return order, shared

    ro, rs = ranks(contexts[:, back:])
    lo, ls = ranks(np.ascontiguousarray(contexts[:, :back][:, ::-1]))
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(back + 1):
        a[ro] = np.cumsum(rs < length - o)
        b[lo] = np.cumsum(ls < o)
        ok = np.flatnonzero((left >= o) & (right >= length - o))
        if len(ok) < 2:
            continue
        key = a[ok] * (n + 1) + b[ok]
        by = np.argsort(key, kind="stable")
        again = np.append(False, key[by][1:] == key[by][:-1])
        out[ok[by[again]]] |= np.uint64(1) << np.uint64(o)
    return out


_CONTEXT = "g long, first long, h long, h2 long, at int, ctx binary, back int"


def _contexts(touched: DataFrame, length: int) -> DataFrame:
    back = length - GRAM

    def fetch(batches):
        for b in batches:
            for i in range(b.num_rows):
                first, h, h2 = b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()
                text = b.column(0)[i].as_py().encode()
                at, g = np.asarray(b.column(4)[i].values), np.asarray(b.column(5)[i].values)
                for j in range(0, len(at), 20_000):
                    part = at[j : j + 20_000].tolist()
                    ctx = [text[max(0, p - back) : p + length] for p in part]
                    m = len(part)
                    yield pa.record_batch([pa.array(g[j : j + m]), pa.array([first] * m, pa.int64()), pa.array([h] * m, pa.int64()), pa.array([h2] * m, pa.int64()), pa.array(part, pa.int32()), pa.array(ctx, pa.binary()), pa.array([min(p, back) for p in part], pa.int32())], names=[c.split()[0] for c in _CONTEXT.split(", ")])

    return touched.select("text", "first", "h", "h2", "at", "g").mapInArrow(fetch, _CONTEXT)


def _marks(contexts: DataFrame, length: int) -> DataFrame:
    """(h, h2, at, mask, ctx, ...): ctx and what belongs to it only where the group was too large to gather."""
    back = length - GRAM
    schema = "h long, h2 long, at int, mask long, first long, ctx binary, back int"
    names = [c.split()[0] for c in schema.split(", ")]

    def solve(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        hot: int | None = None

        def answer(t: pa.Table):
            if not t.num_rows:
                return
            ctx, before = t.column("ctx").combine_chunks(), t.column("back").to_numpy()
            flat, off = utf8(ctx)
            size = np.diff(off)
            wide = np.zeros((t.num_rows, back + length), np.uint8)
            place = np.arange(len(flat)) - np.repeat(off[:-1], size) + np.repeat(back - before, size)
            wide[np.repeat(np.arange(t.num_rows), size), place] = flat
            mask = repeated_windows(wide, before, size - before, t.column("g").to_numpy(), length)
            some = np.flatnonzero(mask)
            if len(some):
                keep = t.take(pa.array(some))
                yield pa.record_batch([keep.column(c).combine_chunks() for c in ("h", "h2", "at")] + [pa.array(mask[some].view(np.int64)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int32())], names=names)

        def raw(t: pa.Table):
            for b in t.to_batches():
                yield pa.record_batch([b.column("h"), b.column("h2"), b.column("at"), pa.array(np.zeros(b.num_rows, np.int64)), b.column("first"), b.column("ctx"), b.column("back")], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            if hot is not None:  # the rest of a group that was too large
                n = int((g == hot).sum())
                yield from raw(t.slice(0, n))
                t, g = t.slice(n), g[n:]
                if not len(g):
                    held, rows = [], 0
                    continue
                hot = None
            cut = int(np.searchsorted(g, g[-1])) if (g[1:] >= g[:-1]).all() else int(np.flatnonzero(g != g[-1])[-1]) + 1
            yield from answer(t.slice(0, cut))
            t = t.slice(cut)
            if t.num_rows > GROUP:
                yield from raw(t)
                hot, t = int(g[-1]), t.slice(0, 0)
            held, rows = t.to_batches(), t.num_rows
        if held:
            t = pa.Table.from_batches(held)
            n = int((t.column("g").to_numpy() == hot).sum()) if hot is not None else 0
            yield from raw(t.slice(0, n))
            yield from answer(t.slice(n))

    dealt = contexts.repartition(partitions(contexts.sparkSession), "g").sortWithinPartitions("g", "first", "h", "at")
    return dealt.mapInArrow(solve, schema)


def _large_marks(rows: DataFrame, length: int) -> DataFrame:
    """(h, h2, at, mask) of contexts whose groups were too large.

    A pre-aggregating group-by of 128-bit window hashes finds the first place of each window; every other place repeats it. The
    first places come back as bits of 64 neighbouring starts of a text, so what is joined has a row per text and cell, and no window,
    however frequent, is a join key."""
    back = length - GRAM

    def windows(batches):
        for b in batches:
            for h, at, first, ctx, before in zip(*(b.column(c).to_pylist() for c in ("h", "at", "first", "ctx", "back")), strict=True):
                offs = [o for o in range(min(before, back) + 1) if len(ctx) - before >= length - o]
                if offs:
                    d = [hashlib.blake2b(ctx[before - o : before - o + length], digest_size=16).digest() for o in offs]
                    m = len(offs)
                    yield pa.record_batch([pa.array(d, pa.binary()), pa.array([first] * m, pa.int64()), pa.array([h] * m, pa.int64()), pa.array([at - o for o in offs], pa.int32())], names=["w", "first", "h", "start"])

    w = rows.select("h", "at", "first", "ctx", "back").mapInArrow(windows, "w binary, first long, h long, start int")
    least = w.groupBy("w").agg(F.min(F.struct("first", "h", "start")).alias("least")).select("least.h", "least.start")
    cell = lambda c: F.floor(c / 64).cast("int")
    firsts = least.groupBy("h", cell(F.col("start")).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, start % 64)")).alias("bits"))
    places = rows.select("h", "h2", "at", "back", F.octet_length("ctx").alias("n"), cell(F.col("at")).alias("cell"))
    below = firsts.select("h", (F.col("cell") + 1).alias("cell"), F.col("bits").alias("below"))
    both = places.join(firsts, ["h", "cell"], "left").join(below, ["h", "cell"], "left")
    is_first = "getbit(coalesce(if((at - o) div 64 = cell, bits, below), 0L), (at - o) % 64) = 1"
    mask = F.expr(f"aggregate(sequence(0, least(back, {back})), 0L, (m, o) -> if(n - back >= {length} - o and not ({is_first}), m | shiftleft(1L, o), m))")
    return both.select("h", "h2", "at", mask.alias("mask")).where("mask <> 0")


def repeated_spans(places: np.ndarray, masks: np.ndarray, n: int, length: int) -> np.ndarray:
    """Rows of (from, to): the maximal runs of bytes that the marked windows cover."""
    bits = (masks[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    which, o = np.nonzero(bits)
    starts = np.unique(places[which] - o)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.column_stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length])


def remove_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    docs = _content(ensure_columns(documents, doc_id="long", text="string"))
    rows = materialize(docs.select("doc_id", "h", "h2", F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "contents")
    firsts = materialize(rows.groupBy("h", "h2").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first")), "firsts")
    shared = materialize(_shared(_all_anchors(docs, length)), "anchors")
    wanted = shared.groupBy("h", F.shiftrightunsigned("at", 32).alias("h2")).agg(F.sort_array(F.collect_list(F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"), "g"))).alias("l"))
    wanted = wanted.join(firsts, ["h", "h2"]).select("h", "h2", "first", F.col("l.at").alias("at"), F.col("l.g").alias("g"))
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("first"), "h", "h2", "text")
    # repeated rows are one document: without this the anchors of one would repeat those of the other
    touched = materialize(texts.join(wanted, ["first", "h", "h2"]).dropDuplicates(["first", "h", "h2"]), "touched")
    marks = materialize(_marks(_contexts(touched, length), length), "marks")
    solved = marks.where("ctx is null").select("h", "h2", "at", "mask")
    if not marks.where("ctx is not null").isEmpty():
        solved = solved.union(_large_marks(marks.where("ctx is not null"), length))
    per_text = solved.groupBy("h", "h2").agg(F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("l")).select("h", "h2", F.col("l.at").alias("at"), F.col("l.mask").alias("mask"))

    def cut(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py().encode()
                spans = repeated_spans(np.asarray(b.column(3)[i].values, np.int64), np.asarray(b.column(4)[i].values, np.int64).view(np.uint64), len(text), length)
                kept, last = hashlib.sha256(), 0
                for a, z in spans.tolist():
                    kept.update(text[last:a])
                    last = z
                kept.update(text[last:])
                out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["h", "h2", "removed", "spans", "kept"])

    cuts = touched.select("h", "h2", "text").join(per_text, ["h", "h2"]).select("h", "h2", "text", "at", "mask").mapInArrow(cut, "h long, h2 long, removed long, spans long, kept string").dropDuplicates(["h", "h2"])
    all_ = rows.join(firsts, ["h", "h2"]).join(cuts, ["h", "h2"], "left")
    copy = (F.col("n") >= length) & (F.coalesce("doc_id", F.lit(_LAST)) > F.col("first"))
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    return all_.select("doc_id", F.col("n").alias("n_bytes"), pick(F.col("n"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(hashlib.sha256().hexdigest()), F.col("kept"), F.col("sha")).alias("kept_sha256"))
