"""Language of web pages by Bayesian fusion of text, declared markup language, address suffix and host.

For each page and language l the log posterior is the sum of
  log P(text | l)      a naive Bayes of hashed character n-grams of the visible text, trained on a bounded sample of labelled documents;
                       long texts are tempered to `TEXT_WEIGHT` n-grams' worth, as neighbouring n-grams are not independent;
  log P(declared | l)  how often pages of l declare this lang attribute;
  log P(suffix | l)    the same for the address: a language folder, or else the host's last label;
  log P(l | host)      counts of the host's other pages, smoothed towards its suffix, which is smoothed towards all pages.
The three tables are soft counts: each page adds its text posterior, summed by grouped aggregation. A page's own share is taken out
of all three before it is judged. Rows of one value are dealt to `PARTS` tasks when its counts are joined to them. All languages that a document is labelled with, all declared values and all suffixes
have counts of their own; the tables are grouped and joined to the rows.

Defined results: null or wordless html has an even text likelihood; a null or hostless url is of the host ''; what is not declared is
its own value ''; repeated rows and ids are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, materialize, slabs, splitmix, utf8

#: Labelled documents a language that training takes, by smallest hash of id and text.
SAMPLE = 500
PARTS = 16
BUCKETS, TEXT_WEIGHT = 1 << 14, 60.0
HOST_PRIOR, SUFFIX_PRIOR, EVIDENCE_PRIOR = 4.0, 10.0, 1.0
_TAG = re.compile(r"<(?:(script|style)\b|!--|)", re.I)
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}


def visible(html: str) -> str:
    """The text outside tags, comments, scripts and styles; each end is searched for once, so that html without ends costs no more."""
    out, at, gone = [], 0, set()
    while (m := _TAG.search(html, at)) is not None:
        end = -1
        kind = m[1].lower() if m[1] else "--" if m[0] == "<!--" else ""
        if kind and kind not in gone:
            if kind == "--":
                end = html.find("-->", m.end())
                end = end + 3 if end >= 0 else -1
            else:
                close = _END[kind].search(html, m.end())
                end = close.end() if close else -1
            if end < 0:
                gone.add(kind)
        if end < 0:
            end = html.find(">", m.start()) + 1
            if end <= 0:
                break  # no tag ends any more
        out.append(html[at : m.start()])
        at = end
    out.append(html[at:])
    return " ".join(out)


def gram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the 1- to 3-byte-grams of letters in each text, with counts."""
    body, off = utf8(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in slabs(off):
        for i in range(lo, hi):
            x = body[off[i] : off[i + 1]].astype(np.uint64)
            x = np.where((x >= 65) & (x <= 90), x + np.uint64(32), x)
            letter = (x >= 97) & (x <= 122) | (x >= 128)
            x = np.where(letter, x, np.uint64(32))
            if not letter.any():
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]])
            x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
            grams = np.concatenate([x[:-1] << np.uint64(8) | x[1:], x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:] | np.uint64(1 << 24)])
            b, n = np.unique((splitmix(grams) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
            out.append((b, n.astype(float)))
    return out


class TextModel:
    """counts: a row a language of how often its documents have each bucket of n-grams."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    @classmethod
    def of_texts(cls, languages: list[str], texts: list[list[str]]) -> TextModel:
        counts = np.zeros((len(languages), BUCKETS))
        for i, own in enumerate(texts):
            for b, n in gram_counts(own):
                counts[i, b] += n
        return cls(languages, counts)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for i, (b, n) in enumerate(gram_counts(texts)):
            if len(b):
                out[i] = self.log[:, b] @ n * min(1.0, TEXT_WEIGHT / n.sum())
        return out - out.max(1, keepdims=True) if len(texts) else out


def fit(documents: DataFrame) -> TextModel:
    """Counts over at most SAMPLE documents a language. Documents are drawn by hash before any text moves, their n-grams are counted
    where they are, and only BUCKETS sums a language reach the driver."""
    docs = ensure_columns(documents, doc_id="long", lang="string", text="string").where("lang is not null and text is not null")
    docs = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    # about twice as many candidates as are taken: no language is sorted whole
    share = F.least(F.lit(1.0), (2.0 * SAMPLE + 100) / F.col("n"))
    near = docs.select("lang", "h").join(sizes, "lang").where((F.pmod("h", F.lit(1 << 40)) / float(1 << 40)) < share).groupBy("lang", "h").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    drawn = near.withColumn("place", place).where(F.col("place") <= SAMPLE).select("lang", "h")
    languages = sorted(r.lang for r in sizes.select("lang").collect())
    if not languages:
        return TextModel(["und"], np.zeros((1, BUCKETS)))
    texts = docs.join(drawn, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches):
        for b in batches:
            for lang, (buckets, n) in zip(b.column(0).to_pylist(), gram_counts(b.column(1).to_pylist()), strict=True):
                if len(buckets):
                    yield pa.record_batch([pa.array([lang] * len(buckets)), pa.array(buckets.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

    rows = texts.select("lang", "text").mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = rows.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    for r in packed.toLocalIterator():
        counts[languages.index(r.lang), r.b] = r.n
    return TextModel(languages, counts)


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, posterior) per row."""
    languages = model.languages
    rows = ensure_columns(pages, page_id="long", url="string", html="string")
    folder = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*?://[^/?#]*/([A-Za-z]{2})(?:[/?#.]|$)", 1))
    rows = rows.withColumn("host", _host()).withColumn("declared", F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))).withColumn("suffix", F.when(folder != "", F.concat(F.lit("/"), folder)).otherwise(F.regexp_extract("host", r"\.([a-z]{2,})$", 1)))

    def judge(batches):
        for b in batches:
            log = model.likelihoods([visible(t or "") for t in b.column(4).to_pylist()])
            yield pa.record_batch([*b.columns[:4], pa.array(log.tolist(), pa.list_(pa.float64()))], names=["page_id", "host", "declared", "suffix", "log"])

    judged = materialize(rows.select("page_id", "host", "declared", "suffix", "html").mapInArrow(judge, "page_id long, host string, declared string, suffix string, log array<double>"), "judged")
    weight = F.transform("log", lambda x: F.exp(x))
    soft = judged.withColumn("soft", F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, y: a + y)))
    sums = [F.sum(F.element_at("soft", i + 1)).alias(f"n{i}") for i in range(len(languages))]
    columns = [f"n{i}" for i in range(len(languages))]
    totals = np.array(soft.agg(*sums).first(), dtype=float) if not judged.isEmpty() else np.ones(len(languages))
    overall = (totals + 1) / (totals + 1).sum()

    numbers = lambda x: F.array(*[F.lit(float(v)) for v in x])

    rows_ = soft.withColumn("part", F.pmod(F.xxhash64("page_id", "host", "log"), F.lit(PARTS)))

    def counted(rows: DataFrame, value: str) -> DataFrame:
        """rows with the counts of their value, their own share taken out; the counts are repeated for each part."""
        counts = soft.groupBy(value).agg(*sums).select(value, F.array(*columns).alias("c")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        return rows.join(counts, [value, "part"]).withColumn(f"{value}_counts", F.zip_with("c", "soft", lambda a, b: F.greatest(F.lit(0.0), a - b))).drop("c")

    def evidence(value: str) -> F.Column:
        even = EVIDENCE_PRIOR / (judged.select(value).distinct().count() + 1)
        rest = F.zip_with(numbers(totals), "soft", lambda t, b: F.greatest(F.lit(0.0), t - b))
        return F.zip_with(f"{value}_counts", rest, lambda v, t: F.log((v + even) / (t + EVIDENCE_PRIOR)))

    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    fused = counted(counted(counted(rows_, "host"), "declared"), "suffix")
    fused = fused.withColumn("declared_log", evidence("declared")).withColumn("suffix_log", evidence("suffix"))
    fused = fused.withColumn("base", F.zip_with("suffix_counts", numbers(overall), lambda v, o: (v + SUFFIX_PRIOR * o) / (size("suffix_counts") + SUFFIX_PRIOR)))
    fused = fused.withColumn("host_log", F.zip_with("host_counts", "base", lambda v, o: F.log((v + HOST_PRIOR * o) / (size("host_counts") + HOST_PRIOR))))
    total = F.transform(F.arrays_zip("log", "declared_log", "suffix_log", "host_log"), lambda z: z["log"] + z["declared_log"] + z["suffix_log"] + z["host_log"])
    fused = fused.withColumn("total", total).withColumn("best", F.array_max("total"))
    names = F.array(*map(F.lit, languages))
    of = lambda scores, top: F.element_at(names, F.array_position(scores, top).cast("int"))
    return fused.select("page_id", "host", "declared", "suffix", of(F.col("log"), F.array_max("log")).alias("text_lang"), of(F.col("total"), F.col("best")).alias("lang"), (1 / F.aggregate(F.transform("total", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x)).alias("posterior"))
