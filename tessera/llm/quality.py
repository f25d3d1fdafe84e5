"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other, then judge together.

The text view is hashed word shares and statistics of form; the metadata view is source, language and declared length. Both
are logistic regressions. In each round each view names the unlabelled documents it is surest of, a fixed number for either class in
the proportion of the labels, and these join the other view's training set. Each view's log-odds are then calibrated on one half of
the labelled rows that no view learned from, and the calibrated log-odds are combined with weights learned on the other half.

Training uses bounded samples, drawn by smallest hash of the id (`LABELLED` labelled rows and `POOL` unlabelled ones, one row an id); their
views are made where the texts are, so that a fixed number of values a row reaches the driver. Every row of
the documents is scored, whole texts, in one pass.

Defined results: null text is empty; null source and lang are values of their own; null n_chars is 0; repeated rows score alike; labels
that are null are not learned from; without both classes every score is the good share of the labels, or 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, slabs, utf8, word_hashes
from .toxicity import held_out

LABELLED, POOL, ROUNDS, TAKEN = 3000, 3000, 5, 150
TEXT_BUCKETS, META_BUCKETS = 1024, 256


def text_view(texts: list[str | None]) -> np.ndarray:
    body, off = utf8(pa.array([t or "" for t in texts], pa.large_string()))
    out = np.zeros((len(texts), TEXT_BUCKETS + 9))
    for lo, hi in slabs(off):
        part = body[off[lo] : off[hi]]
        starts, ends, words, at = word_hashes(part, off[lo : hi + 1] - off[lo])
        for i in range(lo, hi):
            w, raw = words[at[i - lo] : at[i - lo + 1]], body[off[i] : off[i + 1]]
            if not len(w):
                continue
            np.add.at(out[i], (w >> np.uint64(20)).astype(np.int64) % TEXT_BUCKETS, 1.0)
            out[i, :TEXT_BUCKETS] = np.sqrt(out[i, :TEXT_BUCKETS] / len(w)) * 3
            size = (ends - starts)[at[i - lo] : at[i - lo + 1]]
            lines = (texts[i] or "").split("\n")
            out[i, TEXT_BUCKETS:] = [1, np.log1p(len(w)) / 5, size.mean() / 5, size.std() / 5, len(np.unique(w)) / len(w), ((raw >= 48) & (raw <= 57)).mean() * 10, np.isin(raw, np.frombuffer(b".,;:!?", np.uint8)).mean() * 10, len(set(lines)) / len(lines), ((raw < 128) & (raw > 32) & ~((raw >= 48) & (raw <= 57)) & ~(((raw | 32) >= 97) & ((raw | 32) <= 122))).mean() * 10]
    out[:, TEXT_BUCKETS] = 1
    return out


def meta_view(sources: list, langs: list, chars: list) -> np.ndarray:
    import zlib

    out = np.zeros((len(sources), META_BUCKETS + 3))
    for i, (s, l, n) in enumerate(zip(sources, langs, chars, strict=True)):
        for name in (f"s{s}", f"l{l}", f"{s}|{l}"):
            out[i, zlib.crc32(name.encode()) % META_BUCKETS] += 1
        size = np.log1p(max(0, n or 0))
        out[i, META_BUCKETS:] = [1, size / 8, (size / 8) ** 2]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 200) -> np.ndarray:
    """Weights of a ridge logistic regression, by accelerated gradient steps."""
    b, look, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4 / (np.linalg.norm(x, 2) ** 2 + 4 * ridge)
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        nxt = look - rate * (x.T @ (p - y) + ridge * look)
        look = nxt + i / (i + 3) * (nxt - b)
        b = nxt
    return b


def odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of the two views; slope and offset that calibrate each; weights of the calibrated log-odds and an offset."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray
    fuse: np.ndarray
    share: float

    def of_views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (x @ w * s[0] + s[1] for x, w, s in ((text, self.text, self.scale[0]), (meta, self.meta, self.scale[1])))
        return odds(a), odds(b), odds(np.column_stack([a, b, np.ones(len(a))]) @ self.fuse)

    def score(self, texts, sources, langs, chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.fuse):
            even = np.full(len(texts), self.share)
            return even, even, even
        return self.of_views(text_view(texts), meta_view(sources, langs, chars))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, share: float, rounds: int = ROUNDS, taken: int = TAKEN) -> Model:
    """Views and labels (0 or 1) of the labelled rows, views of the pool."""
    if len(y) < 20 or y.min() == y.max():
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), share)
    views = [(text, meta), (pool_text, pool_meta)]
    own = np.arange(len(y)) % 4 != 0  # the others calibrate and combine
    sets = [(list(np.flatnonzero(own)), [], []) for _ in range(2)]  # for each view: labelled rows, pool rows, their given labels
    free = np.ones(len(pool_text), bool)
    weights = [np.zeros(0), np.zeros(0)]

    def learn(v: int) -> None:
        rows, extra, given = sets[v]
        weights[v] = logistic(np.vstack([views[0][v][rows], views[1][v][extra]]), np.r_[y[rows], given])

    for turn in range(rounds + 1):
        learn(0)
        learn(1)
        if turn == rounds or not free.any():
            break
        for v in (0, 1):
            z = np.where(free, views[1][v] @ weights[v], np.nan)
            order = np.argsort(z)[: int(free.sum())]
            good, bad = round(taken * share), round(taken * (1 - share))
            for label, chosen in ((1.0, order[len(order) - good :] if good else []), (0.0, order[:bad])):
                for j in chosen:
                    if free[j] and (z[j] > 1 if label else z[j] < -1):  # sure enough
                        sets[1 - v][1].append(j)
                        sets[1 - v][2].append(label)
                        free[j] = False
    z = [views[0][v] @ weights[v] for v in (0, 1)]
    first, second = np.arange(len(y)) % 8 == 0, np.arange(len(y)) % 8 == 4
    scale = np.array([logistic(np.column_stack([z[v], np.ones(len(y))])[first], y[first], ridge=0.1, steps=400) for v in (0, 1)])
    even = [z[v] * scale[v][0] + scale[v][1] for v in (0, 1)]
    fuse = logistic(np.column_stack([*even, np.ones(len(y))])[second], y[second], ridge=0.1, steps=400)
    return Model(weights[0], weights[1], scale, fuse, share)


def _views(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text views, metadata views and labels of (text, source, lang, n_chars, quality), in the order of doc_id."""

    def make(batches):
        for b in batches:
            ids, texts, sources, langs, chars, labels = (c.to_pylist() for c in b.columns)
            if ids:
                t, m = text_view(texts).astype(np.float32), meta_view(sources, langs, chars).astype(np.float32)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(labels, pa.int32())], names=["doc_id", "t", "m", "quality"])

    got = rows.select("doc_id", "text", "source", "lang", "n_chars", "quality").mapInArrow(make, "doc_id long, t binary, m binary, quality int").orderBy("doc_id").collect()
    stack = lambda c, width: np.frombuffer(b"".join(bytes(r[c]) for r in got), np.float32).reshape(-1, width).astype(float)
    return stack("t", TEXT_BUCKETS + 9), stack("m", META_BUCKETS + 3), np.array([r.quality or 0 for r in got], float)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    docs = ensure_columns(documents, doc_id="long", text="string", source="string", lang="string", n_chars="long")
    known = ensure_columns(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.agg(F.count("*").alias("n"), F.avg("quality").alias("share")).first()
    order = (F.xxhash64("doc_id"), "doc_id")
    one = lambda rows: rows.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("r")).select("doc_id", "quality", "r.*")  # noqa: E731  an id's rows are one
    text, meta, y = _views(one(docs.join(F.broadcast(known.orderBy(*order).limit(LABELLED)), "doc_id")))
    # ids first: what is drawn is a bounded list before any text moves
    free = docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct().join(known, "doc_id", "left_anti").orderBy(*order).limit(POOL).withColumn("quality", F.lit(None).cast("int"))
    pool_text, pool_meta, _ = _views(one(docs.join(F.broadcast(free), "doc_id")))
    return co_train(text, meta, y, pool_text, pool_meta, n.share if n.n else 0.5)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, text_score, meta_score, score, predicted) per row."""

    def run(batches):
        for b in batches:
            given = [c.to_pylist() for c in b.columns[2:]]
            got = model.score(*given) if b.num_rows else (np.zeros(0),) * 3
            yield pa.record_batch([b.column(0), b.column(1), *map(pa.array, got)], names=["doc_id", "held_out", "text_score", "meta_score", "score"])

    rows = ensure_columns(documents, doc_id="long", text="string", source="string", lang="string", n_chars="long")
    return rows.select("doc_id", held_out().alias("held_out"), "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, held_out boolean, text_score double, meta_score double, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
