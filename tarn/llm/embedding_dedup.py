"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is normalised and turned by fixed random rotations; the signs are its code. With code
c and vector x, f = <c, Px> / sqrt(D) is stored with the code, and <c, Pq> / (f sqrt(D)) is an
unbiased estimate of <x, q> whose error is below EPSILON sqrt(1 - f^2) / (f sqrt(D - 1)) with
a probability of 1 - 6e-7. Bands of code bits, with the label, are the keys under which vectors
meet. At a cosine of 0.98 a band agrees with a probability of 0.2, so that ``BANDS`` bands miss
two pairs in 100,000, fewer above.

Equal unit vectors of one label are one class, whose members are counted and not compared. Classes of
one key are compared in blocks. In a block the bound decides which pairs need the
exact cosine, in double precision, and only those at or above the threshold are links. A pair
counts in the first band that both share, so no pair is emitted or counted twice, and a block
returns one row for each class whatever its number of links.

Edge cases: null, empty or zero vectors, vectors with null or non-finite components and null
labels link with nothing; vectors of different length never link. A null id counts as the largest long.
Rows that share an id, null ones too, are vectors each; of a component all rows with the smallest id are kept. Labels
may be of any type, other columns of any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .components import components

BAND_BITS = 24
BANDS = 48
BLOCK = 512
EPSILON = 5.0
SEED = 7
_MOST = 9223372036854775807
_rotations: dict[int, np.ndarray] = {}


def rotations(dim: int) -> np.ndarray:
    """So many random rotations of R^dim, side by side, that all bands have bits; the same in every process."""
    if dim not in _rotations:
        rng = np.random.default_rng([SEED, dim])
        count = -(-BANDS * BAND_BITS // dim)
        _rotations[dim] = np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])
    return _rotations[dim]


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the code of the first rotation as packed bits, its factor, and the band values."""
    turned = vectors @ rotations(vectors.shape[1])
    dim = vectors.shape[1]
    signs = turned > 0
    factor = np.abs(turned[:, :dim]).sum(axis=1) / np.sqrt(dim)
    bits = signs[:, : BANDS * BAND_BITS].reshape(len(vectors), BANDS, BAND_BITS)
    return np.packbits(signs[:, :dim], axis=1), factor, bits @ (1 << np.arange(BAND_BITS, dtype=np.int64))


def index(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, and dim, unit vector, code, factor and bands of every vector; these are null for those that cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            values = [None if v is None else np.array(v, dtype=float) for v in batch.column(2).to_pylist()]
            labels = batch.column(1).is_valid().to_pylist()
            for k, v in enumerate(values):
                usable = labels[k] and v is not None and len(v) and np.isfinite(v).all() and v.any()
                by.setdefault(len(v) if usable else 0, []).append(k)
            for dim, at in by.items():
                taken = batch.select([0, 1]).take(pa.array(at))
                n = len(at)
                made = [pa.nulls(n, kind) for kind in _KINDS]
                if dim:
                    x = unit(np.stack([values[k] for k in at]))
                    code, factor, bands = encode(x)
                    made = [pa.array([dim] * n, pa.int32()), pa.array(list(x), _KINDS[1]), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.array(list(bands.astype(np.int32)), _KINDS[4])]
                yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=["vec_id", "label", "dim", "unit", "code", "factor", "bands"])

    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(_MOST)).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id bigint, label {kind}, dim int, unit array<double>, code binary, factor double, bands array<int>")


_KINDS = (pa.int32(), pa.list_(pa.float64()), pa.binary(), pa.float64(), pa.list_(pa.int32()))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n by the links (a, b)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def block_links(threshold: float):
    """Of two blocks of one key (or one and itself): for each class its number of newly linked vectors and its group."""

    def run(seats: pd.DataFrame) -> pd.DataFrame:
        seats = seats.sort_values("class")
        band, same = int(seats["band"].iloc[0]), seats["x"].iloc[0] == seats["y"].iloc[0]
        ids, members = seats["class"].to_numpy(), seats["members"].to_numpy()
        x, bands = np.stack(seats["unit"].to_numpy()), np.stack(seats["bands"].to_numpy())
        dim = x.shape[1]
        first = np.arange(len(ids)) if same else np.flatnonzero(seats["mine"].to_numpy() == seats["x"].iloc[0])
        second = first if same else np.setdiff1d(np.arange(len(ids)), first)
        codes = np.unpackbits(np.frombuffer(b"".join(seats["code"].iloc[first]), np.uint8).reshape(len(first), -1), axis=1)[:, :dim] * 2.0 - 1
        factor = seats["factor"].to_numpy()[first]
        turned = x[second] @ rotations(dim)[:, :dim]
        estimate = (codes @ turned.T) / (factor * np.sqrt(dim))[:, None]
        error = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(max(1, dim - 1))
        likely = estimate + error[:, None] >= threshold
        if same:  # an estimate is of the first one's code, so a pair needs one direction only
            likely = np.triu(likely | likely.T, 1)
        i, j = np.nonzero(likely)
        i, j = first[i], second[j]
        keep = []
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            linked = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            linked[linked] = ~(bands[a[linked], :band] == bands[b[linked], :band]).any(axis=1)
            keep.append(linked)
        keep = np.concatenate(keep) if keep else np.empty(0, bool)
        i, j = i[keep], j[keep]
        links = np.bincount(i, members[j], len(ids)) + np.bincount(j, members[i], len(ids))
        root = _roots(len(ids), i, j)
        has = links > 0
        return pd.DataFrame({"class": ids[has], "links": links[has].astype("int64"), "root": ids[root[has]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; links join equal labels with cosine >= threshold."""
    prepare(vectors.sparkSession)
    rows = cut(index(vectors, vec_id, vector, label).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("same", F.when(F.col("dim").isNotNull(), F.md5(F.to_json(F.struct("label", "unit")))))
    # Classes of equal vectors, named by one of their rows; hash collisions apart, as in any digest.
    classes = cut(rows.where("same is not null").groupBy("same").agg(F.min("row").alias("class"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members")))
    kept = cut(rows.drop("vec_id", "same").join(classes.select(F.col("class").alias("row"), "members"), "row").withColumnRenamed("row", "class"))
    posted = kept.select("class", "label", "dim", F.posexplode("bands").alias("band", "value"))
    posted = posted.select("class", "band", F.xxhash64("label", "dim", "band", "value").alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = posted.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    met = met.withColumn("mine", F.pmod(F.xxhash64("class", "key"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", "band", "class", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    seats = met.join(kept.select("class", "members", "unit", "code", "factor", "bands"), "class")
    found = cut(seats.groupBy("key", "x", "y").applyInPandas(block_links(threshold), "class bigint, links bigint, root bigint"))
    counts = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    groups = components(found, "class", "root").withColumnRenamed("node", "class")
    grouped = classes.join(counts, "class", "left").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("n_links", F.lit(0)) + F.col("members") - 1
    of = grouped.join(least, "component").select("same", n_links.alias("n_links"), "component_id")
    out = rows.select("vec_id", "same").join(of, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
