"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Sizes are words. Every source (ordered by code point, null last) has a weight; all sizes together are shared out by weight, but
no source gets more than `most` times its own size: what is above is shared again by weight among the others.

The documents of a source stand in a random but fixed order on a line of words, which is repeated as often as the target asks,
and the line is cut into blocks. How many blocks of each source a shard gets is drawn down a binary tree over the shards: a
node hands its left half exactly its share of blocks, chosen uniformly from all it has, which is a multivariate hypergeometric
draw, one source after another from what is left. Each draw inverts the exact distribution, at any number of blocks. Each shard
then draws its quota from its source's blocks, permuted by a keyed Feistel network; the ranges are disjoint, and `rank` orders
what a shard got by hash: its local shuffle. Only counts travel through the tree, never documents; a row per source and shard.

Places on a source's line are running sums in three steps: within hash buckets of some hundred documents, over the buckets of a
thousand, and over those, so a source with a third of all rows is no single task's work. Pieces find their shards by a join on
cells of `CELL` block places, so no row carries a list that grows with the shards.

Defined results: null text has size 0; rows of size 0 take nothing; a null source is a source of its own; repeated rows and ids
are rows of their own; an empty table gives an empty result; other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ensure_columns, materialize, partitions

#: Documents of a hash bucket, on average, and buckets that one step of the running sums takes together.
BUCKET, TOGETHER = 256, 1024
#: Neighbouring block places whose shards are looked up together.
CELL = 64


def _uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 50)) + 0.5) / float(1 << 50)


def _let(value: Column, use) -> Column:
    """use(value), which evaluates value once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hypergeometric(total: Column, good: Column, drawn: Column, *seed: Column) -> Column:
    """How many of `good` among `total` are in a uniform choice of `drawn`: the distribution's inverse at a hashed number.

    Weights relative to the mode follow from the ratios of neighbours, upwards and downwards, as far as 12 standard deviations and 40
    more: what lies beyond has less than 1e-29 of the mass, far under the steps of the hashed number.
    """
    d = lambda c: c.cast("double")
    least, most = F.greatest(F.lit(0).cast("bigint"), drawn + good - total), F.least(good, drawn)
    middle = F.floor((d(drawn) + 1) * (d(good) + 1) / (d(total) + 2)).cast("bigint")
    reach = (F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), d(drawn) * d(good) / total * (1 - d(good) / total) * (d(total) - drawn) / F.greatest(d(total) - 1, F.lit(1.0))))) + 40).cast("bigint")
    rest = d(total) - good - drawn
    up = lambda x: (d(good) - x) * (d(drawn) - x) / ((x + 1.0) * (rest + x + 1))  # noqa: E731  weight of x + 1 over that of x
    down = lambda x: d(x) * (rest + x) / ((d(good) - x + 1) * (d(drawn) - x + 1))  # noqa: E731  weight of x - 1 over that of x
    none = F.array().cast("array<bigint>")

    def walk(steps: Column, ratio, goal: Column | None = None) -> Column:
        """(w, s, at): running weight and sum; at is the first place where the sum passes the goal."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("bigint").alias("at"))

        def step(acc: Column, x: Column) -> Column:
            return _let(acc["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s"), (acc["at"] if goal is None else F.coalesce(acc["at"], F.when(acc["s"] + w > goal, x))).alias("at")))

        return F.aggregate(steps, start, step)

    def draw(f: Column) -> Column:
        ups = F.when(f["z"] > f["m"], F.sequence(f["m"], f["z"] - 1)).otherwise(none)
        downs = F.when(f["a"] < f["m"], F.sequence(f["m"], f["a"] + 1, F.lit(-1).cast("bigint"))).otherwise(none)

        def invert(g: Column) -> Column:
            u = g["u"] * (1 + g["above"] + g["below"])
            over = F.coalesce(walk(ups, up, u - 1)["at"] + 1, f["z"])
            under = F.coalesce(walk(downs, down, u - 1 - g["above"])["at"] - 1, f["a"])
            return F.when(u <= 1, f["m"]).when(u <= 1 + g["above"], over).otherwise(under)

        return _let(F.struct(walk(ups, up)["s"].alias("above"), walk(downs, down)["s"].alias("below"), _uniform(*seed).alias("u")), invert)

    bounds = _let(F.least(F.greatest(middle, least), most), lambda m: F.struct(m.alias("m"), F.greatest(least, m - reach).alias("a"), F.least(most, m + reach).alias("z")))
    return F.when((good <= 0) | (drawn <= 0), F.lit(0)).otherwise(_let(bounds, draw)).cast("bigint")


def _permuted(place: Column, size: Column, *seed: Column) -> Column:
    """A keyed permutation of 0 .. size - 1: a Feistel network over the next power of two, walked along its cycle back into range."""
    bits = F.length(F.bin(F.greatest(size - 1, F.lit(1).cast("bigint")))) + 1  # two bits at least
    low = F.floor(bits / 2).cast("int")

    def network(v: Column, b: Column) -> Column:
        size_low, size_high = F.call_function("shiftleft", F.lit(1).cast("bigint"), b["low"]), F.call_function("shiftleft", F.lit(1).cast("bigint"), b["bits"] - b["low"])

        def turn(x: Column, i: Column) -> Column:
            lower = x["lo"].bitwiseXOR(F.pmod(F.xxhash64(*seed, i, F.lit(0), x["hi"]), size_low))
            return _let(lower, lambda lo: F.struct(x["hi"].bitwiseXOR(F.pmod(F.xxhash64(*seed, i, F.lit(1), lo), size_high)).alias("hi"), lo.alias("lo")))

        halves = F.struct(F.floor(v / size_low).cast("bigint").alias("hi"), F.pmod(v, size_low).alias("lo"))
        return F.aggregate(F.array(*map(F.lit, range(4))), halves, turn, lambda x: x["hi"] * size_low + x["lo"])

    def walk(b: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(1), F.lit(200)), network(place, b), lambda v, _: F.when(v < size, v).otherwise(network(v, b)))
        return _let(again, lambda v: F.when(v < size, v).otherwise(F.raise_error(F.lit("a block left the permutation's range"))))

    return _let(F.struct(bits.alias("bits"), low.alias("low")), walk)


def source_targets(sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, source_size) -> also weight and target."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_full = Window.partitionBy(F.lit(0)).orderBy("full_at", "at")
    ranked = ranked.withColumn("all", F.sum("source_size").over(everything)).withColumn("capped", F.coalesce(F.sum("cap").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in the order in which they fill up, that does not fill when all from it on share the rest
    level = (F.col("all") - F.col("capped")) / F.col("open")
    ranked = ranked.withColumn("level", F.min(F.when(level <= F.col("full_at"), F.struct("full_at", "at", level.alias("v")))).over(everything)["v"])
    return ranked.select("source", "source_size", "at", "weight", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(at, blocks) per source -> (at, shard, blocks): exact quotas, all drawn down the tree."""
    root = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "blocks"))).alias("b")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("b.at").alias("ats"), F.col("b.blocks").alias("blocks"), F.aggregate("b.blocks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("all"))
    level = root
    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        cut = lambda i: F.floor(F.col("all") * i / shards)  # noqa: E731  blocks of all shards before shard i
        state = F.struct(F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), (cut(F.col("mid")) - cut(F.col("lo"))).cast("bigint").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

        def draw(acc: Column, good: Column) -> Column:
            got = _hypergeometric(acc["total"], good, acc["drawn"], F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["out"]))
            out = F.concat(acc["out"], F.array(got))
            return F.struct((acc["total"] - good).alias("total"), (acc["drawn"] - F.element_at(out, -1)).alias("drawn"), out.alias("out"))

        level = level.withColumn("mid", mid).withColumn("left", F.when(F.col("hi") - F.col("lo") < 2, F.col("blocks")).otherwise(F.aggregate("blocks", state, draw, lambda acc: acc["out"])))
        halves = F.array(F.struct("lo", F.when(F.col("hi") - F.col("lo") < 2, F.col("hi")).otherwise(F.col("mid")).alias("hi"), F.col("left").alias("blocks")), F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("blocks", "left", lambda a, b: a - b).alias("blocks")))
        level = level.select("ats", "all", F.explode(halves).alias("h")).select("h.lo", "h.hi", "ats", "h.blocks", "all").where("lo < hi and (hi - lo > 1 or aggregate(blocks, 0L, (a, x) -> a + x) > 0)")
    return level.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("ats", "blocks")).alias("z")).select(F.col("z.ats").alias("at"), "shard", F.col("z.blocks").alias("blocks"))


def _running_sums(sized: DataFrame) -> DataFrame:
    """sized, with the words of its source before it on the line as start: sums within buckets, within groups of buckets, over groups."""
    upto = lambda *by: Window.partitionBy("s", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("words").over(w), F.lit(0))
    group = F.floor(F.col("bucket") / TOGETHER).cast("long")
    buckets = sized.groupBy("s", "bucket").agg(F.sum("size").alias("words")).withColumn("group", group)
    groups = buckets.groupBy("s", "group").agg(F.sum("words").alias("words")).withColumn("first", before(upto("group"))).drop("words")
    starts = buckets.withColumn("within", before(upto("group", "bucket"))).join(groups, ["s", "group"]).select("s", "bucket", (F.col("first") + F.col("within")).alias("before"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("run", F.sum("size").over(inside)).join(starts, ["s", "bucket"])
    return placed.withColumn("start", F.col("before") + F.col("run") - F.col("size")).drop("before", "run")


def mix(documents: DataFrame, weights: list[float] | None = None, most: float = 3.0, block: int = 1024, shard_words: int = 1 << 22, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, text_hash, pieces) per row; a piece is (shard, rank, repeat, from_word, words).

    taken is the number of words that the shards draw from the document, repeats counted: at most ceil(most) times its size. A shard
    reads its pieces in the order of their ranks.
    """
    docs = ensure_columns(documents, doc_id="long", source="string", text="string")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "source", F.concat(F.when(F.col("source").isNull(), "n").otherwise("v"), F.coalesce("source", F.lit(""))).alias("s"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = materialize(sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_hash")), "sizes")
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards, buckets = max(1, -(-words // shard_words)), max(1, -(-rows // BUCKET))
    sources = source_targets(sized.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")).select("source", "source_size"), weights or [5.0, 2.0, 1.0], most)
    sources = sources.withColumn("s", F.concat(F.when(F.col("source").isNull(), "n").otherwise("v"), F.coalesce("source", F.lit("")))).withColumn("quota", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("quota") / block).cast("long"))
    plan = materialize(sources.select("s", "at", "source_size", "target", "quota", "blocks"), "targets")
    quotas = materialize(split_quotas(plan.select("at", "blocks"), shards, seed).where("blocks > 0"), "quotas")
    ranges = quotas.withColumn("end", F.sum("blocks").over(Window.partitionBy("at").orderBy("shard")))
    # the shards of CELL neighbouring places: a range of each has one of them at least, so a list has CELL at most
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor((F.col("end") - F.col("blocks")) / CELL), F.floor((F.col("end") - 1) / CELL))))
    cells = ranges.groupBy("at", "cell").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))

    bucketed = sized.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    placed = materialize(_running_sums(bucketed).join(plan, "s"), "placed")

    # the repeats of the document on its source's line, cut at block borders
    stretch = F.transform(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)), lambda e: F.struct(e.alias("e"), (F.col("start") + e * F.col("source_size")).alias("a"), F.least("quota", F.col("start") + F.col("size") + e * F.col("source_size")).alias("z")))
    stretch = F.filter(stretch, lambda x: x["a"] < x["z"])

    def cut(x: Column) -> Column:
        return F.transform(
            F.sequence(F.floor(x["a"] / block), F.floor((x["z"] - 1) / block)),
            lambda b: F.struct(b.alias("b"), x["e"].alias("repeat"), (F.greatest(x["a"], b * block) - F.col("start") - x["e"] * F.col("source_size")).alias("from_word"), (F.least(x["z"], (b + 1) * block) - F.greatest(x["a"], b * block)).alias("words")),
        )

    # where a document stands on its source's line names it: no two with words stand at one place
    pieces = placed.where("size > 0").select("at", "start", "blocks", F.explode(F.flatten(F.transform(stretch, cut))).alias("p")).select("at", "start", "blocks", "p.*")
    pieces = pieces.withColumn("place", _permuted(F.col("b"), F.col("blocks"), F.lit(seed), F.col("at"))).withColumn("cell", F.floor(F.col("place") / CELL))
    pieces = pieces.join(cells, ["at", "cell"]).withColumn("shard", F.element_at(F.filter("ends", lambda e: e["end"] > F.col("place")), 1)["shard"])
    rank = F.xxhash64(F.lit(seed), "shard", "at", "start", "repeat", "from_word")
    drawn = pieces.groupBy("at", "start").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", rank.alias("rank"), "repeat", "from_word", "words"))).alias("pieces"))
    named = placed.withColumn("line", F.when(F.col("size") > 0, F.col("at")))  # rows without words join nothing
    out = named.join(drawn.withColumnsRenamed({"at": "line"}), ["line", "start"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "text_hash", F.coalesce("pieces", F.array().cast("array<struct<shard:int,rank:bigint,repeat:int,from_word:bigint,words:bigint>>")).alias("pieces"))


def shard_order(mixed: DataFrame) -> DataFrame:
    """(shard, rank, doc_id, repeat, from_word, words): the pieces dealt by shard, each shard's in its shuffled order."""
    rows = mixed.select("doc_id", F.explode("pieces").alias("p")).select("p.shard", "p.rank", "doc_id", "p.repeat", "p.from_word", "p.words")
    return rows.repartition(partitions(mixed.sparkSession), "shard").sortWithinPartitions("shard", "rank")


def mix_digest(documents: DataFrame, **parameters) -> DataFrame:
    """mix() without the lists: how many pieces and shards each document went to, and a digest of its pieces with their places."""
    mixed = mix(documents, **parameters)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("pieces").alias("n_pieces"), F.size(F.array_distinct("pieces.shard")).alias("n_shards"), F.xxhash64("pieces").alias("pieces_hash"))


def mixed_texts(documents: DataFrame, **parameters) -> DataFrame:
    """The documents that the mix draws from, with all their columns but those of the mix's names, size, source_size, target, taken,
    n_shards and pieces; equal rows are told apart by number."""
    documents = documents.drop("size", "source_size", "target", "taken", "n_shards", "pieces")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    again = lambda *order: F.row_number().over(Window.partitionBy("doc_id", "_h", "source").orderBy(*order))
    own = documents.withColumn("_h", h).withColumn("_n", again(F.lit(0)))
    drawn = mix(documents, **parameters).where("taken > 0").withColumnRenamed("text_hash", "_h").withColumn("_n", again("taken", F.xxhash64("pieces")))
    drawn = drawn.select(*[F.col(c).alias(f"_{c}") if c in ("doc_id", "source", "_h", "_n") else F.col(c) for c in ("doc_id", "source", "_h", "_n", "size", "source_size", "target", "taken", "pieces")])
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("__h")) & (F.col("_n") == F.col("__n"))
    out = own.join(drawn, on).drop("_doc_id", "_source", "_h", "__h", "_n", "__n")
    return out.withColumn("n_shards", F.size(F.array_distinct("pieces.shard")))
