"""Toxicity by compression distance: how much better a dictionary of toxic text packs a window than one of ordinary text.

Two zstandard dictionaries are trained, each on its own class of a bounded labelled sample. Most of a toxic document is ordinary
prose, so the toxic trainer is given the places where the class differs: every occurrence, in the toxic documents, of a term that is
over-represented there (`Z_SCORE` standard errors and `RATIO` times); the ordinary trainer is given words of ordinary documents. Both
dictionaries are followed by one base dictionary trained on ordinary windows, so that ordinary text packs equally with either.
Every window of about `WINDOW` bytes of the whole text, cut at spaces, is packed with both, and the differences of the lengths - the
best ones, their mean and their number - are calibrated to a probability by a weighted logistic regression on documents that
the dictionaries did not see: `FOLDS` pairs of dictionaries are each trained without a part of the sample, which they then measure.
0.3 is the threshold of that probability.

Defined results: null text is empty and scored as such; repeated rows are scored alike; a document with several labels is toxic if one says so; null labels
and ids are not learned from; without examples of both classes every score is the toxic share that the labels have, or 0; an empty
table gives no rows; of other columns nothing is read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns

#: Bounds of the labelled sample: documents of the smallest hashes of the id, of which those of at most SAMPLE_BYTES are learned from.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 2000, 4000, 32_768
#: Bytes of a window, of a class's dictionary and of the base dictionary; the trainer's segment and match lengths.
WINDOW, DICTIONARY, BASE, SEGMENT, MATCH, LEVEL = 96, 4096, 112_640, 24, 6, 3
Z_SCORE, RATIO, FOLDS = 8.0, 5.0, 2
THRESHOLD = 0.3


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text, lower-cased, in pieces of at most size bytes that end at spaces where they can."""
    out, at = [], 0
    text = text.lower()
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.rfind(b" ", at + size // 2, end)
            end = space if space > 0 else end
        out.append(text[at:end])
        at = end
    return out or [b""]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    share: float

    def packers(self):
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        return out

    def score(self, text: bytes, packers) -> float:
        if not len(self.weights):
            return self.share
        return float(1 / (1 + np.exp(-np.clip(statistics(text, packers) @ self.weights, -40, 40))))


def statistics(text: bytes, packers) -> np.ndarray:
    ordinary, toxic = packers
    gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], float)
    best, many = np.sort(gain)[::-1], np.log1p(len(gain))
    return np.array([1, best[0], best[0] ** 2 / 10, best[:2].mean(), best[:4].mean(), gain.mean(), np.log1p((gain >= 3).sum()), np.log1p((gain >= 5).sum()), many / 5, many * best[0] / 5])


def _dictionary(samples: list[bytes], size: int, **how: int) -> bytes:
    """What zstandard's trainer picks; where the samples are too few or too uniform for it, the distinct samples themselves."""
    try:
        return zstandard.train_dictionary(size, [x.ljust(8) for x in samples], **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _terms(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words that more toxic documents have than their share of all documents explains."""
    counts = [Counter(), Counter()]
    for count, texts in zip(counts, (toxic, ordinary), strict=True):
        for t in texts:
            count.update(set(t.lower().split()))
    nt, no, out = len(toxic), len(ordinary), set()
    least = min(Z_SCORE, max(4.0, np.sqrt(nt) / 2.5))  # small samples can't reach more
    for w, n in counts[0].items():
        other = counts[1][w]
        share = (n + other) / (nt + no)
        spread = np.sqrt(nt * share * (1 - share) * no / (nt + no)) + 1e-9
        if n >= 3 and n / nt > RATIO * (other + 0.5) / no and (n - nt * share) / spread > least:
            out.add(w)
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, each its class's own behind filling up to equal length, before the shared base."""
    how = {"k": SEGMENT, "d": MATCH}
    terms = _terms(toxic, ordinary)  # each occurrence stands three times, so that the trainer's segments can hold a term whole
    own = _dictionary([b" %b %b %b " % (w, w, w) for t in toxic for w in t.lower().split() if w in terms], DICTIONARY, **how)
    words = [b" %b " % w for t in ordinary for w in t.lower().split()]
    other = _dictionary(words[:: max(1, len(words) // 20_000)], max(256, len(own)), **how)
    prose = [w for t in ordinary for cut in [windows(t, 256)] for w in cut[:: max(1, len(cut) // 40)]][:60_000]
    base, size = _dictionary(prose, BASE), max(len(own), len(other))
    return other.rjust(size, b"\x01") + base, own.rjust(size, b"\x01") + base


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), x.T @ (weight * (p - y)) + 0.1 * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    if len(toxic) < 2 * FOLDS or len(ordinary) < 2 * FOLDS:
        return Model(b"", b"", np.zeros(0), share)
    x, y = [], []
    for fold in range(FOLDS):
        part = lambda texts, own: [t for i, t in enumerate(texts) if (i % FOLDS == fold) == own]  # noqa: B023, E731
        packers = Model(*dictionaries(part(toxic, False), part(ordinary, False)), np.zeros(0), share).packers()
        for label, texts in ((1.0, toxic), (0.0, ordinary)):
            unseen = part(texts, True)
            x += [statistics(t, packers) for t in unseen]
            y += [label] * len(unseen)
    x, y = np.array(x), np.array(y)
    weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary)) * len(y)
    return Model(*dictionaries(toxic, ordinary), calibrate(x, y, weight), share)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from rows that are not held out; the texts of at most TOXIC_SAMPLE + ORDINARY_SAMPLE of them reach the driver."""
    docs = ensure_columns(documents, doc_id="long", text="string")
    known = ensure_columns(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids are drawn before any text is joined, so that the join is of a bounded list
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TOXIC_SAMPLE).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_SAMPLE))
    short = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    rows = short.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    texts = {k: [(r.text or "").encode() for r in rows if r.toxic == k] for k in (0, 1)}
    total = n.get(0, 0) + n.get(1, 0)
    return train(texts[1], texts[0], n.get(1, 0) / total if total else 0.0)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row, from the text alone."""

    def run(batches):
        packers = model.packers() if len(model.weights) else None
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([model.score((t or "").encode(), packers) for t in b.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = ensure_columns(documents, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is not predicted toxic, with the columns that documents has."""
    schema = documents.schema
    column = documents.columns.index("text")

    def run(batches):
        packers = model.packers() if len(model.weights) else None
        for b in batches:
            keep = [model.score((t or "").encode(), packers) < THRESHOLD for t in b.column(column).to_pylist()]
            if any(keep):
                yield b.filter(pa.array(keep))

    return documents.mapInArrow(run, schema)
