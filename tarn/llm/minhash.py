"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document's set of word shingles is hashed by one function; its ``SKETCH`` smallest values
are retained. Documents with equal sets are one class at once. The classes then go through

1. inverted lists of the ``LISTED`` smallest retained values. A list of at most ``LIST`` classes
   generates the overlaps of its pairs; a pair needs ``OVERLAP`` values in common. Of classes at
   the threshold each retained value is shared with probability 0.8, so ``COLD`` values in short
   lists miss a pair with a probability of 5e-6.
2. Classes with fewer such values, because their values are very common, also go into lists of
   value tuples: the ``TUPLE`` smallest retained values of each of ``GROUPS`` residues. Long tuple
   lists are compared with one hub and in blocks; what stays apart there goes into lists of each set's rarest
   shingles, which sets at the threshold must share. Lists that are long even so are verified in full,
   block by block: a list is never cut and never expanded into pairs.
3. The union sketch estimates the similarity of a candidate pair; ``SLACK`` is four standard
   deviations of it. Pairs that pass are verified on the full shingle sets. Only links between
   what is not yet connected need it, so one likely link of
   each class is verified first, and then all pairs that still lie between components.

Edge cases: texts without words and null texts have an empty set and no links; with fewer words
than a shingle the whole sequence is the one shingle; a null id counts as the largest long; rows equal in id and
text are one document, repeated in the result, and rows that share an id, null ones too, with different texts are
documents each; texts of any length are read whole, and a group of blocks is bounded by the bytes of its sets; other
columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, one_of_each, prepare, semi, tasks_for
from .components import components

SKETCH = 64
LISTED = 16
LIST = 32
COLD = 12
OVERLAP = 3
GROUPS = 16
TUPLE = 3
SLACK = 0.2
BLOCK = 512
#: Shingles of the whole sets of a block, 8 bytes each; one larger set is a block of its own.
BLOCK_SHINGLES = 500_000
SLICE = 4096
CACHE_WORDS = 200_000
_MOST = 9223372036854775807


class WordHashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted 63-bit hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    take = min(width, len(words))
    value = np.full(n, take, np.uint64)
    for k in range(take):
        value = (value ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return np.unique((value >> np.uint64(1)).view(np.int64))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tag and text: the tag tells apart rows that share an id."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_MOST)).alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))


def sketches(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, tag, n (set size), d1 and d2 (digest of the whole set) and the retained values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, kept = [], [], [], []
            for t in batch.column(2):
                values = shingle_set(t.as_py(), width)
                digest = xxhash.xxh3_128_digest(values.tobytes())
                n.append(len(values))
                one.append(int.from_bytes(digest[:8], "little", signed=True))
                two.append(int.from_bytes(digest[8:], "little", signed=True))
                kept.append(values[:SKETCH].copy())
            flat = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64))
            at = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(at, flat)],
                names=["doc_id", "tag", "n", "d1", "d2", "kept"])

    return _keyed(docs, doc_id, text).mapInArrow(run, "doc_id bigint, tag bigint, n bigint, d1 bigint, d2 bigint, kept array<bigint>")


def of_classes(rows: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (doc_id, tag, ...) of the documents that stand for the classes in ``ids``, once each, with the class as id."""
    wanted = ids.join(classes.select("id", "doc_id", "tag"), "id")
    few = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if few else wanted, ["doc_id", "tag"]).drop("doc_id", "tag")


def full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(id, shingles) of the classes in ``ids`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [shingle_set(t.as_py(), width) for t in part.column(0)]
                at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.ListArray.from_arrays(at, pa.array(np.concatenate(found)))], names=["id", "shingles"])

    texts = of_classes(_keyed(docs, doc_id, text), classes, ids).select("text", "id")
    # Repeated rows of one document give one set.
    return texts.mapInArrow(run, "id bigint, shingles array<bigint>").dropDuplicates(["id"])


def _tuple(group: int) -> Column:
    """The key of the smallest retained values of one residue, and whether there are any."""
    values = F.slice(F.filter("kept", lambda v: F.pmod(v, F.lit(GROUPS)) == group), 1, TUPLE)
    return F.struct((F.size(values) > 0).alias("used"), F.xxhash64(F.lit(group), values).alias("key"))


def _ends(pairs: DataFrame, tasks: int) -> DataFrame:
    """The distinct ids in pairs (a, b)."""
    return cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), tasks)


def _list_pairs(lists: DataFrame, ratio: int, also: str = "true") -> DataFrame:
    """(a, b, overlap) of the classes that meet in short lists (key, id, n) and may be similar by size."""
    x, y = lists.alias("x"), lists.alias("y")
    near = f"100 * least(x.n, y.n) >= {ratio} * greatest(x.n, y.n) and {also}"
    pairs = x.join(y, F.expr(f"x.key = y.key and x.id < y.id and {near}"))
    return pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("overlap"))


def _estimate(x: Column, y: Column) -> Column:
    """Similarity by the smallest values of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, x), y)) / F.size(union)


def _estimates(one: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    """The same of one sketch against many."""
    lengths = np.array([len(r) for r in rest])
    flat, owner = np.concatenate(rest), np.repeat(np.arange(len(rest)), lengths)
    place = np.searchsorted(one, flat)
    shared = one[np.minimum(place, len(one) - 1)] == flat
    begin = np.cumsum(lengths) - lengths
    before = np.cumsum(shared) - shared
    rank = np.arange(len(flat)) - begin[owner] + place - (before - before[begin][owner])
    both = np.bincount(owner, weights=shared, minlength=len(rest))
    union = np.minimum(SKETCH, lengths + len(one) - both)
    return np.bincount(owner, weights=shared & (rank < SKETCH), minlength=len(rest)) / union


def _hub_links(floor: float):
    """Of a block of one list, with its hub: for every member a partner that the estimate lets pass, if it has any."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["is_hub", "id"], ascending=[False, True]).drop_duplicates("id")
        ids, kept = block["id"].to_numpy(), [np.asarray(k, np.int64) for k in block["kept"]]
        left, found = np.arange(len(ids)), []
        while len(left):
            pivot = left[0]
            score = _estimates(kept[pivot], kept)
            score[pivot] = 0
            linked = score >= floor
            inside = left[linked[left]]
            found += [(ids[pivot], ids[k], score[k]) for k in inside]
            outside = np.setdiff1d(np.flatnonzero(linked), left)
            if len(outside):
                best = outside[np.argmax(score[outside])]
                found.append((ids[pivot], ids[best], score[best]))
            left = np.setdiff1d(left[1:], inside)
        return pd.DataFrame({"a": [min(f[:2]) for f in found], "b": [max(f[:2]) for f in found], "est": [f[2] for f in found]}).astype({"a": "int64", "b": "int64", "est": "float64"})

    return run


def _shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of two lists of sorted sets, by slices of the values both lists hold."""
    values = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)))
    counts = np.zeros((len(one), len(two)))
    for begin in range(0, len(values), SLICE):
        part = values[begin : begin + SLICE]
        rows = []
        for sets in (one, two):
            table = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                inside = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, inside)
                table[k, at[part[np.minimum(at, len(part) - 1)] == inside]] = 1
            rows.append(table)
        counts += rows[0] @ rows[1].T
    return counts


def _cross_links(floor: float, percent: int):
    """Of the strays of a block against another block: each with the least id that verified links reach here.

    Estimates decide which strays need it; their links to other components are verified on the full
    sets, and the block returns at most one row for each document.
    """

    def run(seats: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        strays, block = seats[seats["stray"]], seats[~seats["stray"]]
        if not len(strays) or not len(block):
            return none
        kept = [np.asarray(s, np.int64)[:SKETCH] for s in block["shingles"]]
        comp = block["comp"].to_numpy()
        near = [((_estimates(np.asarray(s, np.int64)[:SKETCH], kept) >= floor) & (comp != c)).any() for s, c in zip(strays["shingles"], strays["comp"], strict=True)]
        strays = strays[near]
        if not len(strays):
            return none
        one, two = ([np.asarray(s, np.int64) for s in part["shingles"]] for part in (strays, block))
        both = _shared_counts(one, two)
        sizes = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None, :]
        i, j = np.nonzero((100 * both >= percent * (sizes - both)) & (strays["comp"].to_numpy()[:, None] != comp[None, :]))
        ids, place = np.unique(np.concatenate([strays["id"].to_numpy()[i], block["id"].to_numpy()[j]]), return_inverse=True)
        x, y, root = place[: len(i)], place[len(i) :], np.arange(len(ids))
        while len(i):
            least = root.copy()
            np.minimum.at(least, x, root[y])
            np.minimum.at(least, y, root[x])
            least = least[least]
            if (least == root).all():
                break
            root = least
        return pd.DataFrame({"a": ids[root], "b": ids}).astype("int64").query("a != b")

    return run


class _Links:
    """Verified links and the components they make."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, doc_id: str, text: str, tasks: int):
        self.classes, self.tasks = classes, tasks
        self.docs, self.width, self.percent, self.names = docs, width, percent, (doc_id, text)
        self.true: DataFrame | None = None
        self.comps: DataFrame | None = None

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        sets = semi(sets, _ends(pairs, self.tasks), "id")
        x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"{k}s")) for k in "ab")
        rows = pairs.select("a", "b").join(x, "a").join(y, "b")
        both = F.size(F.array_intersect("as", "bs"))
        return rows.where(100 * both >= self.percent * (F.size("as") + F.size("bs") - both)).select("a", "b").distinct()

    def _add(self, pairs: DataFrame, sets: DataFrame) -> None:
        new = cut(self._verify(pairs, sets), self.tasks)
        self.true = new if self.true is None else self.true.union(new)
        self.comps = components(self.true, python=True, tasks=self.tasks)

    def connect(self, pairs: DataFrame) -> None:
        """Takes pairs that verified links connect."""
        if not pairs.isEmpty():
            self.true = pairs if self.true is None else self.true.union(pairs)
            self.comps = components(self.true, python=True, tasks=self.tasks)

    def _across(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different components, with these as ca and cb."""
        if self.comps is None:
            return pairs.select("*", F.col("a").alias("ca"), F.col("b").alias("cb"))
        for k in "ab":
            c = self.comps.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
            pairs = pairs.join(c, k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
        return pairs.where("ca <> cb")

    def resolve(self, pairs: DataFrame) -> None:
        """Verifies so many of the candidates (a, b, est) that their true links' components are known."""
        pairs = cut(pairs, self.tasks)
        if pairs.isEmpty():
            return
        sets = cut(full_sets(self.docs, self.classes, _ends(pairs, self.tasks), self.width, *self.names), self.tasks)
        if self.comps is None:
            # Of each class the likely link with the smallest partner: groups then form stars.
            likely = (F.col("est") >= self.percent / 100).alias("likely")
            ends = pairs.select(F.col("b").alias("id"), "a", "b", likely).union(pairs.select("a", "a", "b", likely))
            best = ends.groupBy("id").agg(F.max(F.struct("likely", -F.col("a"), -F.col("b"))).alias("x"))
            best = cut(best.select((-F.col("x.col2")).alias("a"), (-F.col("x.col3")).alias("b")).distinct(), self.tasks)
            self._add(best, sets)
            pairs = pairs.join(best, ["a", "b"], "left_anti")
        left = cut(self._across(pairs).select("a", "b").distinct(), self.tasks)
        if not left.isEmpty():
            self._add(left, sets)


def _with_comps(rows: DataFrame, links: _Links) -> DataFrame:
    """``rows`` (id, ...) with the component of each id."""
    comps = links.comps.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _prefix_lists(sets: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """(key, id, n, size): the lists of each set's rarest shingles, so many that sets at the threshold must share one.

    Similar sets share ceil(percent * n / 100) of the n shingles of either, so in any order one of the first n - that + 1 of both. In order of
    frequency among these sets, what very many of them share comes last: passages that are common do not make lists.
    """
    common = sets.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    common = cut(common, tasks)
    if common.count() <= BROADCAST_ROWS:
        first = _rarest(sets, common, percent)
    else:
        entries = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("key")).join(common, "key", "left")
        ranked = entries.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("size", F.lit(1)), "key")))
        first = ranked.where(f"k <= n - (n * {percent} + 99) div 100 + 1 and size is not null").select("key", "id", "n")
    first = cut(first, tasks)
    sizes = first.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return cut(first.join(sizes, "key"), tasks)


def _rarest(sets: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """(key, id, n): those of each set's first shingles that other sets have too. ``common`` (key, size) has BROADCAST_ROWS rows at most."""
    rows = common.select(F.col("key").cast("long"), F.col("size").cast("long")).orderBy("key").collect()
    shared = sets.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = shared.value
        for batch in batches:
            ids, lengths, found = [], [], []
            for i, values in zip(batch.column("id").to_pylist(), batch.column("shingles"), strict=True):
                v = values.values.to_numpy()
                at = np.minimum(np.searchsorted(keys, v), max(len(keys) - 1, 0))
                size = np.where(keys[at] == v, sizes[at], 1) if len(keys) else np.ones(len(v), np.int64)
                first = np.lexsort((v, size))[: len(v) - -(-len(v) * percent // 100) + 1]
                first = first[size[first] > 1]
                ids += [i] * len(first)
                lengths += [len(v)] * len(first)
                found.append(v[first])
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "id", "n"])

    return sets.select("id", "shingles").mapInArrow(run, "key bigint, id bigint, n bigint")


def _compare_long(lists: DataFrame, sets: DataFrame, links: _Links, floor: float, percent: int) -> None:
    """Connects what is similar within long lists (key, id, n, size): those outside a list's largest component against all of it, in blocks."""
    sizes = lists.groupBy("key").agg(F.first("size").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    sizes = sizes.select("key", blocks.alias("blocks"))
    placed = _with_comps(lists.join(sizes, "key"), links)
    placed = cut(placed.select("key", "id", "comp", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).alias("block")), links.tasks)
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    split = cut(placed.join(main.select("key", F.col("m.comp").alias("main")), "key"), links.tasks)
    if split.isEmpty():
        return
    outside = split.where("comp <> main")
    whole, part = split.select("key", F.col("block").alias("y")).distinct(), outside.select("key", F.col("block").alias("x")).distinct()
    seats = outside.withColumnRenamed("block", "x").join(whole, "key").select("key", "x", "y", "id", "comp", F.lit(True).alias("stray"))
    seats = seats.union(split.withColumnRenamed("block", "y").join(part, "key").select("key", "x", "y", "id", "comp", F.lit(False)))
    met = seats.join(sets, "id").groupBy("key", "x", "y").applyInPandas(_cross_links(floor, percent), "a bigint, b bigint")
    links.connect(cut(met.distinct(), links.tasks))


def _groups(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, tag, n and first (smallest doc_id and tag of the component) of every row; first is null for empty sets."""
    prepare(docs.sparkSession)
    floor = percent / 100 - SLACK
    rows = cut(sketches(docs, width, doc_id, text))
    tasks = tasks_for(docs.sparkSession, rows.count())
    found = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "tag")).alias("p"))
    classes = cut(found.select("d1", "d2", "n", "p.doc_id", "p.tag", F.monotonically_increasing_id().alias("id")), tasks)
    kept = rows.select("doc_id", "tag", "n", "kept")
    links = _Links(docs, classes, width, percent, doc_id, text, tasks)

    reps = rows.where("n > 0").select("doc_id", "tag", F.slice("kept", 1, LISTED).alias("key")).dropDuplicates(["doc_id", "tag"])
    listed = reps.join(classes.select("doc_id", "tag", "id", "n"), ["doc_id", "tag"]).select("id", "n", F.explode("key").alias("key"))
    size = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(listed.join(size, "key").select("key", "id", "n", "size"), tasks)
    pairs = _list_pairs(shared.where(F.col("size") <= LIST), percent).where(F.col("overlap") >= OVERLAP).select("a", "b")

    hot = shared.where(F.col("size") > LIST).groupBy("id", "n").agg(F.count(F.lit(1)).alias("hot"))
    hot = cut(hot.where(F.least(F.col("n"), F.lit(LISTED)) - F.col("hot") < COLD).select("id"), tasks)
    members = cut(of_classes(kept, classes, hot).dropDuplicates(["id"]), tasks)
    keyed = members.select("id", "n", F.explode(F.array(*[_tuple(g) for g in range(GROUPS)])).alias("t"))
    keyed = keyed.where("t.used").select("t.key", "id", "n")
    size = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("id").alias("hub")).where("size > 1"), tasks)
    pairs = cut(pairs.union(_list_pairs(keyed.join(size.where(F.col("size") <= LIST), "key"), percent).select("a", "b")).distinct(), tasks)
    near = of_classes(kept, classes, _ends(pairs, tasks)).dropDuplicates(["id"])
    x, y = (near.select(F.col("id").alias(k), F.col("kept").alias(f"{k}k")) for k in "ab")
    scored = pairs.join(x, "a").join(y, "b").select("a", "b", _estimate(F.col("ak"), F.col("bk")).alias("est")).where(F.col("est") >= floor)

    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    large = size.where(F.col("size") > LIST).withColumn("blocks", blocks)
    any_large = not large.isEmpty()
    if any_large:
        block = F.pmod(F.xxhash64("id", "key"), F.col("blocks"))
        inside = cut(keyed.join(large, "key").select("key", "id", block.alias("block"), "hub"), tasks)
        hubs = large.select("key", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        seats = inside.select("key", "id", "block", (F.col("id") == F.col("hub")).alias("is_hub")).union(hubs.withColumn("is_hub", F.lit(True)))
        seats = seats.join(members.select("id", "kept"), "id")
        met = seats.groupBy("key", "block").applyInPandas(_hub_links(floor), "a bigint, b bigint, est double")
        scored = scored.union(met).distinct()
    links.resolve(scored)

    if any_large and links.comps is not None:
        # Lists whose members are not one component: their members are compared in full where they can still be similar.
        placed = _with_comps(inside.select("key", "id"), links)
        parts = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        apart = cut(placed.join(parts, "key").select("id").distinct(), tasks)
        if not apart.isEmpty():
            sets = cut(full_sets(docs, classes, apart, width, doc_id, text), tasks)
            lists = _prefix_lists(sets, percent, tasks)
            short = _with_comps(lists.where(F.col("size") <= LIST), links)
            pairs = _list_pairs(short, percent, "x.comp <> y.comp").select("a", "b")
            x, y = (members.select(F.col("id").alias(k), F.col("kept").alias(f"{k}k")) for k in "ab")
            links.resolve(pairs.join(x, "a").join(y, "b").select("a", "b", _estimate(F.col("ak"), F.col("bk")).alias("est")).where(F.col("est") >= floor))
            _compare_long(lists.where(F.col("size") > LIST), sets, links, floor, percent)

    if links.comps is not None:
        comps = links.comps.select(F.col("node").alias("id"), "component")
        classes = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        first = classes.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
        classes = classes.join(first, "component")
    else:
        classes = classes.withColumn("first", F.struct("doc_id", "tag"))
    return rows.select("doc_id", "tag", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "first"), ["d1", "d2", "n"], "left").select("doc_id", "tag", "n", "first")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Links join documents with 100 x intersection >= percent x union of their shingle sets.
    """
    component = F.coalesce("first.doc_id", "doc_id")
    return _groups(docs, width, percent, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group of near copies, that with the smallest id; of rows that repeat id and text any one.

    Rows without words are linked with nothing and all stay.
    """
    found = _groups(docs, width, percent, doc_id, text)
    n = F.when(F.max("first").isNull(), 1).otherwise(F.count(F.lit(1)))
    stay = found.where("first is null or first = struct(doc_id, tag)").groupBy(F.col("doc_id").alias("id"), "tag").agg(n.alias("n"))
    return one_of_each(docs, stay, doc_id, text)
