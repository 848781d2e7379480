"""Mixing sources to target weights in fixed-length blocks, with DataFrame operations only.

The words of each source form one stream that is packed into blocks. Each output shard draws how
many of its slots go to each source: the whole part of the expectation is certain and the rest is
a multinomial draw. A source's slots, numbered through all shards, run through pseudorandom
permutations of its block numbers, one permutation for each pass, and slots meet blocks by a join
on (source, block). No slot goes beyond three passes, so no document is taken more than three times.

Edge cases: null or empty texts have size 0 and are never taken; a null source is a source of its
own, ordered last; repeated rows are documents each, also where the mix returns texts; texts of any length are cut at
their blocks; columns of the input may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, prepare, text_of, word_count

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
PASSES = 3
#: Rows of one source are numbered in chunks of about ``CHUNK_ROWS``, ``CHUNKS`` at least.
CHUNKS, CHUNK_ROWS = 256, 20_000
SALTS = 16
CELLS = 1024
SEED = 20240229


def uniform(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0 .. n-1 that ``key`` selects.

    A four-round Feistel network over pairs below a = floor(sqrt n) + 1, walked until the value is
    below n. There are at most 2 sqrt(n) + 1 values from n on. 48 steps are always enough up to
    n = 500, and beyond fail with a probability under 1e-45.
    """
    a = F.floor(F.sqrt(n.cast("double"))).cast("long") + 1

    def once(x: Column) -> Column:
        left, right = F.floor(x / a).cast("long"), x % a
        for k in range(4):
            left, right = right, (left + F.pmod(F.xxhash64(F.lit(SEED + k), *key, right), a)) % a
        return left * a + right

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(48)), once(index), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return walked


def targets(sizes: DataFrame) -> DataFrame:
    """source_no, source, weight, source_size and target of each source of (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3 in turn. A target is min(3 x size, level x
    weight); the level makes the targets sum to all sizes. Sources whose bound per weight is low
    stop first, so one running sum in that order gives the level. The tables here have one row
    for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    rows = rows.withColumn("weight", ((F.col("source_no") - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("bound", (PASSES * F.col("source_size")).cast("double")).withColumn("stop", F.col("bound") / F.col("weight"))
    order = Window.orderBy("stop", "source_no")
    before, onward, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    free = F.when(F.col("level") <= F.col("stop"), F.struct("stop", "source_no", "level"))
    rows = rows.withColumn("level", F.min(free).over(everything)["level"])
    return rows.select("source_no", "source", "weight", "source_size", F.least("bound", F.col("level") * F.col("weight")).alias("target"))


def sized(docs: DataFrame, doc_id: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Each document's place in its source's stream, and the sources with targets and block counts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("tag"))
    rows = cut(rows)
    chunks = max(CHUNKS, -(-rows.count() // CHUNK_ROWS))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(per_source).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"))
    sources = cut(sources)
    # One source may hold a third of the rows: its rows meet it in SALTS places.
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(chunks)))
    rows = rows.withColumn("salt", (F.col("chunk") % SALTS).cast("int"))
    rows = rows.alias("r").join(salted.alias("s"), F.expr("r.source <=> s.source and r.salt = s.salt"))
    rows = rows.select("doc_id", "r.source", "tag", "size", "chunk", "source_no", "source_size", "target", "blocks")
    in_chunk = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "tag").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.coalesce(F.sum("size").over(in_chunk), F.lit(0)))
    over = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    starts = starts.select("source_no", "chunk", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("chunk_start"))
    rows = rows.join(starts, ["source_no", "chunk"]).withColumn("start", F.col("place") + F.col("chunk_start"))
    return cut(rows.drop("place", "chunk_start", "chunk")), sources


def slots(sources: DataFrame) -> DataFrame:
    """(source_no, block, pass) of every slot of every output shard."""
    live = sources.where("source_size > 0").select("source_no", "blocks", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("wanted"))
    one = Window.orderBy("source_no")
    everything = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = live.withColumn("shards", F.greatest(F.lit(1), F.round(F.sum("wanted").over(everything) / SHARD_SLOTS)).cast("long"))
    live = live.withColumn("mean", F.col("wanted") / F.col("shards")).withColumn("sure", F.floor("mean").cast("long"))
    live = live.withColumn("rest", F.col("mean") - F.col("sure"))
    live = live.withColumn("high", F.sum("rest").over(one.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.col("high") - F.col("rest"))
    live = live.withColumn("draws", F.max("high").over(everything))
    live = cut(live)
    # The rest of each shard: so many multinomial draws as the rests sum to, on average.
    shard = live.agg(F.max("shards").alias("shards"), F.max("draws").alias("draws"))
    shard = shard.withColumn("shard", F.explode(F.when(F.col("shards") > 0, F.sequence(F.lit(0), F.col("shards") - 1))))
    count = (F.floor("draws") + (uniform(F.lit("n"), F.col("shard")) < F.col("draws") - F.floor("draws")).cast("long")).cast("long")
    draws = shard.withColumn("k", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    draws = draws.withColumn("at", uniform(F.lit("draw"), F.col("shard"), F.col("k")) * F.col("draws"))
    cell = lambda x: F.least(F.floor(x * CELLS / F.col("draws")), F.lit(CELLS - 1))
    cells = live.where("rest > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))).select("source_no", "low", "high", "cell")
    drawn = draws.withColumn("cell", cell(F.col("at"))).join(cells, "cell").where("low <= at and at < high")
    drawn = drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("extra"))
    table = live.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(drawn, ["source_no", "shard"], "left")
    table = table.withColumn("n", F.col("sure") + F.coalesce("extra", F.lit(0)))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    table = table.withColumn("n", F.least("n", PASSES * F.col("blocks") - F.col("first"))).where("n > 0")
    # The running count left all shards of a source in one task; its slots are dealt out again.
    table = table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "shard")
    table = table.select("source_no", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    table = table.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("source_no"), F.col("pass"))
    return table.select("source_no", "pass", block.alias("block"))


def pieces(rows: DataFrame) -> DataFrame:
    """The parts of each document by block: (source_no, start, block, from_word, words)."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    parts = rows.where("size > 0").select("source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return parts.select("source_no", "start", "block", (begin - F.col("start")).alias("from_word"), (end - begin).alias("words"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words with repeats) of every document."""
    prepare(docs.sparkSession)
    rows, sources = sized(docs, doc_id, source, text)
    times = slots(sources).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces(rows).join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    full = rows.where("size > 0").join(taken, ["source_no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    names = ["doc_id", "size", "source", "source_size", "target", "taken"]
    return full.select(*names).unionByName(empty.select(*names))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix: one for each document and pass that takes words of it.

    A document taken whole in a pass keeps its text. Of others the words taken are joined by a
    space, in order. All other columns stay; ``n_chars``, if there, is that of the new text.
    """
    prepare(docs.sparkSession)
    rows, sources = sized(docs, doc_id, source, text)
    taken = pieces(rows).join(slots(sources).hint("merge"), ["source_no", "block"]).groupBy("source_no", "start", "pass").agg(
        F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("ranges"), F.sum("words").alias("taken"))
    taken = rows.where("size > 0").join(taken, ["source_no", "start"])
    # Rows equal in id, source and text take the entries of one place each.
    key = fresh(docs, "doc_id", "source", "tag", "places", "copy", "part")
    entry = F.struct("pass", "ranges", (F.col("taken") == F.col("size")).alias("whole"))
    places = taken.groupBy("doc_id", "source", "tag", "start").agg(F.collect_list(entry).alias("entries"))
    places = places.groupBy("doc_id", "source", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "entries"))).alias("places"))
    places = places.withColumnsRenamed(dict(zip(["doc_id", "source", "tag", "places"], key, strict=False)))
    same = F.col(doc_id).eqNullSafe(F.col(key[0])) & F.col(source).eqNullSafe(F.col(key[1])) & (F.xxhash64(text) == F.col(key[2]))
    joined = docs.join(places, same)
    copy = F.row_number().over(Window.partitionBy(*key[:3]).orderBy(F.lit(0)))
    joined = joined.withColumn(key[4], copy).where(F.col(key[4]) <= F.size(key[3]))
    joined = joined.withColumn(key[5], F.explode(F.element_at(key[3], F.col(key[4]))["entries"]))
    words = F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform(F.col(key[5])["ranges"], lambda r: F.slice(words, (r["from_word"] + 1).cast("int"), r["words"].cast("int")))), " ")
    new = F.when(F.col(key[5])["whole"], F.col(text)).otherwise(part)
    columns = {text: new} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    for name, value in columns.items():
        joined = joined.withColumn(name, value)
    return joined.select(*docs.columns)
