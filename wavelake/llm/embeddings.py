"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors of unit length at cosine c lie sqrt(2 - 2c) apart.  Each table buckets them by quantised Gaussian projections
floor((a.x + b) / WIDTH).  Projections and tables grow with the number of vectors (``sizes``): so many projections that a vector
meets about one unrelated vector a table, and so many tables that a pair at the limit is missed by all with probability MISS
(far less above it).  Their product with the number of vectors grows with its power of about 1.25, where fixed numbers would make
a fixed share of all pairs candidates.  Vectors and projections are rounded to integers first, so a bucket does not depend on the
order of floating sums.  Pairs that meet are checked by exact cosine in double precision, in blocks of bounded size, and counted
in the first table they share: rows that link get their keys again from the vector, so no row carries them.

Edge cases: null, zero, empty or non-finite vectors and null labels link with nothing (n_links 0, own component); vectors of
different length never link; equal vectors are one class that counts its copies; a null vec_id keeps its row; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COSINE = 0.93
TABLES, PROJECTIONS, WIDTH = 28, 16, 3.0
MISS = 0.003
_UNIT, _STEP = 1 << 20, 1 << 10


def collision(distance: float) -> float:
    """Probability that one projection puts two points into one cell."""
    w = WIDTH / distance
    return math.erf(w / math.sqrt(2)) - math.sqrt(2 / math.pi) / w * (1 - math.exp(-w * w / 2))


def sizes(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Tables and projections for ``n`` vectors; unrelated ones are at right angles."""
    near, far = collision(math.sqrt(max(2 - 2 * cosine, 1e-6))), collision(math.sqrt(2))
    projections = max(8, math.ceil(math.log(max(n, 1)) / -math.log(far)))
    return math.ceil(math.log(MISS) / math.log1p(-min(near**projections, 0.999))), projections


@lru_cache(maxsize=8)
def _planes(dim: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([97, dim])
    a = np.rint(rng.standard_normal((dim, tables * projections)) * _STEP)
    b = rng.integers(0, int(WIDTH * _UNIT * _STEP), tables * projections)
    odd = rng.integers(0, 1 << 62, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, b, odd


def table_keys(x: np.ndarray, norm: np.ndarray, label: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS) -> np.ndarray:
    """(n, tables) bucket keys of the rows of ``x``; the label and the number of dimensions are part of a key."""
    dim = x.shape[1]
    a, b, odd = _planes(dim, tables, projections)
    # whole numbers below 2^53: the product is exact, whatever the order of its sums
    q = np.rint(x / norm[:, None] * _UNIT) @ a
    cell = (q.astype(np.int64) + b) // int(WIDTH * _UNIT * _STEP)
    with np.errstate(over="ignore"):
        mixed = (cell.astype(np.uint64).reshape(len(x), tables, projections) * odd).sum(axis=2, dtype=np.uint64)
        mixed += C.mix64(np.arange(1, tables + 1, dtype=np.uint64))[None, :]
        mixed ^= C.mix64(label.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(dim))[:, None]
    return C.mix64(mixed).view(np.int64)


def _matrix(column, dims: np.ndarray) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros to the longest."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(dims) and (dims == dims[0]).all():
        return flat.reshape(len(dims), -1)
    out = np.zeros((len(dims), int(dims.max(initial=0))))
    at = 0
    for i, d in enumerate(dims):
        out[i, :d] = flat[at : at + d]
        at += d
    return out


def _keys_of(x, norm, label, dims, tables: int, projections: int) -> np.ndarray:
    out = np.zeros((len(dims), tables), np.int64)
    for d in np.unique(dims):
        at = np.nonzero(dims == d)[0]
        out[at] = table_keys(x[at, :d], norm[at], label[at], tables, projections)
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component), one row per input row."""
    import pyarrow as pa

    x = F.col("x")
    # floats travel as they are; sums and cosines are of doubles
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    src = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(kind).alias("x"))
    src = src.withColumn("norm", F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    fine = F.col("label").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    src = src.withColumn("fine", F.coalesce(fine & (F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)))
    # 96 bits name the class of equal vectors with one label
    src = src.withColumn("k1", F.xxhash64("label", "x")).withColumn("k2", F.hash("x", "label"))
    base = C.stage(src.select("id", "fine", "k1", "k2"), "vec-rows")
    own = src.where("fine").groupBy("k1", "k2").agg(
        F.first("x").alias("x"), F.first("norm").alias("norm"), F.first("label").alias("label"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    reps = C.stage(own.withColumn("rid", F.monotonically_increasing_id()), "vec-classes")

    tables, projections = sizes(reps.count(), cosine)
    most = max(1, (1 << 22) // (tables * projections))

    def hashed(batches):
        for batch in C.sliced(batches, most):
            dims = np.diff(batch.column("x").offsets.to_numpy())
            m = _matrix(batch.column("x"), dims)
            norm, label = batch.column("norm").to_numpy(), batch.column("label").to_numpy()
            keys = _keys_of(m, norm, label, dims, tables, projections)
            at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables)
            yield pa.record_batch([batch.column("rid"), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=["rid", "keys"])

    def verify(batches):
        for table in C.whole_runs(batches, ("key", "blk_a", "blk_b")):
            n = table.num_rows
            col = table.column("x").combine_chunks()
            dims = np.diff(col.offsets.to_numpy())
            m = _matrix(col, dims)
            key, rid, norm, label, copies = (table.column(c).to_numpy() for c in ("key", "rid", "norm", "label", "copies"))
            links, found = np.zeros(n, np.int64), [np.zeros((2, 0), np.int64)]
            for i, j in C.run_pairs(table, "key"):
                same = (label[i] == label[j]) & (dims[i] == dims[j])
                i, j = i[same], j[same]
                near = np.einsum("ij,ij->i", m[i], m[j]) / (norm[i] * norm[j]) >= cosine
                i, j = i[near], j[near]
                if not i.size:
                    continue
                found.append(np.stack([i, j]))
            i, j = np.concatenate(found, axis=1)
            # rows that link get all their keys once more: a pair counts in the first table it shares
            some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            own = np.zeros((len(some), tables), np.int64)
            for at in range(0, len(some), most):
                part = some[at : at + most]
                own[at : at + most] = _keys_of(m[part], norm[part], label[part], dims[part], tables, projections)
            for at in range(0, len(i), most):
                a, b = i[at : at + most], j[at : at + most]
                ka, kb = own[place[at : at + len(a)]], own[place[len(i) + at : len(i) + at + len(b)]]
                here = ka[np.arange(len(a)), np.argmax(ka == kb, axis=1)] == key[a]
                np.add.at(links, a[here], copies[b[here]])
                np.add.at(links, b[here], copies[a[here]])
            root = C.local_roots(n, i, j)
            out = np.nonzero((links > 0) | (root != np.arange(n)))[0]
            yield pa.record_batch([pa.array(rid[out]), pa.array(links[out]), pa.array(rid[root[out]])], names=["rid", "links", "root"])

    marks = C.stage(reps.select("x", "norm", "label", "rid").mapInArrow(hashed, "rid long, keys array<long>"), "vec-keys")
    rows = marks.select("rid", F.explode("keys").alias("key"))
    payload = reps.select("rid", "x", "norm", "label", "copies")
    blocks = C.bucket_blocks(rows, "key", "rid", "vec", payload=payload)
    met = C.stage(blocks.mapInArrow(verify, "rid long, links long, root long"), "vec-links")
    counts = met.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = C.connected_components(met.select(F.col("rid").alias("a"), F.col("root").alias("b")), "vec")
    classes = reps.select("rid", "k1", "k2", "least", "copies").join(counts, "rid", "left")
    classes = classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = classes.groupBy("root").agg(F.min("least").alias("component"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    classes = C.stage(classes.join(named, "root").select("k1", "k2", n_links, "component"), "vec-named")
    linked = base.where("fine").join(classes, ["k1", "k2"]).select("id", "n_links", "component")
    alone = base.where(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).withColumnRenamed("id", id_col)


def op5_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(C.read_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
