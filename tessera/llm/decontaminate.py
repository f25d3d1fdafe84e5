"""Benchmark decontamination by greedy string tiling over shared-token seeds.

Texts are lower-cased words of letters and digits. A document meets a benchmark item when they share a seed, `MATCH` words in a row
(or the whole of a shorter item). On each such pair, running Karp-Rabin looks for the longest common run that no earlier tile
touches: windows are compared by rolling hashes and verified on the words, and the run is marked as a tile in both texts, until none
of `MATCH` words is left. The tiles' share of the item's words is its coverage,
whatever order the passages are in; a document is contaminated by an item from `COVERAGE` on.

The benchmark is a stated query set. It is sent to the executors in blocks of a proven size (`BLOCK` bytes of text at most, an item
longer than that alone), one scan of the documents a block, so the whole benchmark is met whatever its size.

Defined results: null or wordless documents and items match nothing; an item with fewer words than a seed matches as a whole; repeated
items and documents are rows of their own; the pair's coverage is the same for every copy; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ensure_columns, shingle_hashes, slabs, utf8, whole_hash

MATCH, COVERAGE, BLOCK = 5, 0.6, 8 << 20
_NO_WORD = np.zeros(256, bool)
_NO_WORD[[i for i in range(128) if not chr(i).isalnum()]] = True


def _words(column: pa.Array):
    """For each text the hashes of its words, punctuation apart."""
    body, off = utf8(pc.utf8_lower(column))
    for lo, hi in slabs(off):
        part = body[off[lo] : off[hi]]
        spaced = np.where(_NO_WORD[part], np.uint8(32), part)
        _, _, words, at = common.word_hashes(spaced, off[lo : hi + 1] - off[lo], lower=False)
        for i in range(hi - lo):
            yield words[at[i] : at[i + 1]]


def tiles(item: np.ndarray, text: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words) of greedy tiles, longest first, ties by place.

    Each turn finds the longest run that both have unmarked, by bisection over window lengths whose rolling hashes are compared, and
    marks all such runs in order: each place is passed once a turn, however often a word or a passage repeats."""
    match = min(match, len(item))
    if not match or len(text) < match:
        return []
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []

    def windows(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unmarked places in item and text whose windows the other has, and their hashes."""
        at, hashes = [], []
        for words, free in ((item, free_i), (text, free_t)):
            run = np.concatenate([[0], np.cumsum(free)])
            places = np.flatnonzero(run[size:] - run[:-size] == size)
            at.append(places)
            hashes.append(_rolling(words, size)[places] if len(places) else np.zeros(0, np.uint64))
        both = [np.isin(hashes[0], hashes[1]), np.isin(hashes[1], hashes[0])]
        return at[0][both[0]], hashes[0][both[0]], at[1][both[1]], hashes[1][both[1]]

    size, top = match, min(len(item), len(text))
    while len(windows(match)[0]):
        lo, hi = match, top
        while lo < hi:  # a common run of some length holds one of each shorter length
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(windows(mid)[0]) else (lo, mid - 1)
        size = top = lo
        at_i, of_i, at_t, of_t = windows(size)
        places: dict[int, list[int]] = {}
        for h, t in zip(of_t.tolist(), at_t.tolist(), strict=True):
            places.setdefault(h, []).append(t)
        passed, marked = dict.fromkeys(places, 0), False
        for i, h in zip(at_i.tolist(), of_i.tolist(), strict=True):
            if not (free_i[i] and free_i[i + size - 1]):  # tiles of this length cover an end of what they touch
                continue
            own = places[h]
            while passed[h] < len(own) and not (free_t[own[passed[h]]] and free_t[own[passed[h]] + size - 1]):
                passed[h] += 1
            if passed[h] < len(own) and (item[i : i + size] == text[own[passed[h]] : own[passed[h]] + size]).all():
                t = own[passed[h]]
                free_i[i : i + size] = free_t[t : t + size] = False
                out.append((i, t, size))
                marked = True
        if not marked:  # equal hashes of unequal words alone
            top = size - 1
            if top < match:
                break
    return out


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of size words."""
    up, down = common.powers(len(words)), common.powers(len(words), _INVERSE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return (sums[size:] - sums[:-size]) * down[: len(words) - size + 1]


_INVERSE = np.uint64(pow(int(common._RADIX), -1, 1 << 64))


class Seeds:
    """A block of items with the places of their seeds."""

    def __init__(self, ids: list[list[int | None]], texts: list[str | None], match: int):
        self.ids, self.match, self.items = ids, match, list(_words(pa.array(texts, pa.string())))
        h, item, at = [], [], []
        for n, w in enumerate(self.items):
            if len(w):
                s = shingle_hashes(w, match) if len(w) >= match else np.zeros(0, np.uint64)
                h.append(s)
                item.append(np.full(len(s), n))
                at.append(np.arange(len(s)))
        self.short = {len(w): [] for w in self.items if 0 < len(w) < match}
        for n, w in enumerate(self.items):
            if 0 < len(w) < match:
                self.short[len(w)].append((int(whole_hash(w)[0]), n))
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64))[order]

    def meet(self, words: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item, coverage, tiles, longest) of items that the words cover well enough."""
        s = shingle_hashes(words, self.match)
        items: set[int] = set()
        if len(s) and len(self.hash):
            lo = np.searchsorted(self.hash, s)
            hit = np.flatnonzero(self.hash[np.minimum(lo, len(self.hash) - 1)] == s)
            if len(hit):
                seen = np.unique(s[hit])
                lo, up = np.searchsorted(self.hash, seen), np.searchsorted(self.hash, seen, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, up, strict=True)])
                pairs = np.unique(self.item[at] << 32 | self.at[at])
                first = np.flatnonzero(np.append(True, np.diff(pairs >> 32) != 0))
                for a, b in zip(first, np.append(first[1:], len(pairs)), strict=True):
                    n = int(pairs[a] >> 32)
                    places = pairs[a:b] & 0xFFFFFFFF
                    most = int(np.minimum(np.diff(np.append(places, places[-1] + self.match)), self.match).sum())  # words that seeds can cover
                    if most >= coverage * len(self.items[n]):
                        items.add(n)
        for size, wanted in self.short.items():
            if len(words) >= size:
                windows = np.lib.stride_tricks.sliding_window_view(words, size)
                have = {int(whole_hash(w)[0]) for w in windows} if len(windows) < 64 else set(_whole_windows(words, size).tolist())
                items |= {n for h, n in wanted if h in have}
        out = []
        for n in sorted(items):
            got = tiles(self.items[n], words, self.match)
            share = sum(t[2] for t in got) / len(self.items[n])
            if share >= coverage:
                out.append((n, share, len(got), got[0][2]))
        return out


def _whole_windows(words: np.ndarray, size: int) -> np.ndarray:
    """whole_hash of every window of size words."""
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total += words[i : i + len(total)] * common._STEP[i]
    return common.splitmix(total + np.uint64(size))


def blocks_of(benchmark: DataFrame, match: int):
    """The whole benchmark in blocks that each are small enough to send along; equal items are one text with several ids."""
    items = ensure_columns(benchmark, item_id="long", text="string").where("text is not null")
    items = items.groupBy("text").agg(F.sort_array(F.collect_list("item_id")).alias("ids"), F.count_if(F.col("item_id").isNull()).alias("unnamed"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // (BLOCK // 2))
    for b in range(count):
        rows, size = [], 0
        for r in items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == b).orderBy("text").toLocalIterator():
            if rows and size + len(r.text) > BLOCK // 2:
                yield Seeds([[*x.ids, *[None] * x.unnamed] for x in rows], [x.text for x in rows], match)
                rows, size = [], 0
            rows.append(r)
            size += len(r.text)
        if rows:
            yield Seeds([[*x.ids, *[None] * x.unnamed] for x in rows], [x.text for x in rows], match)


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of the pairs that reach the coverage."""
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest long"
    docs = ensure_columns(documents, doc_id="long", text="string")
    out = documents.sparkSession.createDataFrame([], schema)
    for seeds in blocks_of(benchmark, match):

        def meet(batches, seeds=seeds):
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for i, words in enumerate(_words(b.column(1))):
                    rows += [(ids[i], item, share, count, longest) for n, share, count, longest in seeds.meet(words, coverage) for item in seeds.ids[n]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        out = out.union(docs.mapInArrow(meet, schema))
    return out


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows that no item contaminates, with the columns that documents has."""
    column, schema = documents.columns.index("text"), documents.schema
    for seeds in blocks_of(benchmark, match):

        def clean(batches, seeds=seeds):
            for b in batches:
                keep = [not seeds.meet(words, coverage) for words in _words(b.column(column))]
                if any(keep):
                    yield b.filter(pa.array(keep))

        documents = documents.mapInArrow(clean, schema)
    return documents
