"""Shared pieces of the training-data operators.

* ``stage`` cuts lineage with a parquet table in the folder that
  ``spark.checkpoint.dir`` names (shared by driver and executors).
* ``xxh64_slices`` hashes many byte slices of one buffer at once with numpy.
* ``bucket_blocks`` / ``run_pairs`` compare the rows of equal keys in blocks of
  bounded size, so that a hot key is spread over many tasks.
* ``connected_components`` labels an edge table with the smallest node.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task compares with each other; larger keys are cut into chunks.
BLOCK = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one only where none is named and Spark runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = sc._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        named = tempfile.mkdtemp(prefix="wavelake-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/wavelake-{sc.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps never recompute what stands above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_names(df: DataFrame) -> list:
    """Two 64-bit hashes of a whole row.  Spark's hash passes over nulls, so which columns are null goes in beside the values, and
    values made of parts go in as JSON that shows their nulls."""
    parts = []
    for f in df.schema.fields:
        made = f.dataType.typeName() in ("array", "map", "struct")
        parts += [F.col(f.name).isNull(), F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if made else F.col(f.name)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("again"), *reversed(parts))]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that are staged and done: it does so once their plans are garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# -- hashing ---------------------------------------------------------------------------------------------------------

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotl(x * _P2, 31) * _P1


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(40), np.uint8)


def xxh64_slices(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[s:s+n]`` for every slice; ``buf`` comes from ``padded``."""
    w64 = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    w32 = np.ndarray((len(buf) - 3,), "<u4", buffer=buf, strides=(1,))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed64 + _P5, np.uint64)
        big = np.nonzero(lens >= 32)[0]
        if big.size:
            v = [np.full(big.size, x, np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            pos, left, act = starts[big].copy(), lens[big] // 32, np.arange(big.size)
            while act.size:
                for k in range(4):
                    v[k][act] = _rotl(v[k][act] + w64[pos[act] + 8 * k] * _P2, 31) * _P1
                pos[act] += 32
                left[act] -= 1
                act = act[left[act] > 0]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _lane(x)) * _P1 + _P4
            h[big] = acc
        h += lens.astype(np.uint64)
        p, r = starts + (lens // 32) * 32, lens % 32
        while (i := np.nonzero(r >= 8)[0]).size:
            h[i] = _rotl(h[i] ^ _lane(w64[p[i]]), 27) * _P1 + _P4
            p[i] += 8
            r[i] -= 8
        if (i := np.nonzero(r >= 4)[0]).size:
            h[i] = _rotl(h[i] ^ (w32[p[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            p[i] += 4
            r[i] -= 4
        while (i := np.nonzero(r > 0)[0]).size:
            h[i] = _rotl(h[i] ^ (buf[p[i]].astype(np.uint64) * _P5), 11) * _P1
            p[i] += 1
            r[i] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over whole arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P3
        return x ^ (x >> np.uint64(32))


def word_spans(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer holding the words of several texts (none without a word), and the start and end of each word in it."""
    data = b"\n".join(b" ".join(w) for w in words)
    buf = padded(data)
    sep = np.nonzero((buf[: len(data)] == 32) | (buf[: len(data)] == 10))[0]
    return buf, np.concatenate([[0], sep + 1]), np.concatenate([sep, [len(data)]])


_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _joined_words(texts: list[bytes]):
    """One lower-case buffer of several texts, the start and end of each word in it, its line breaks and the start of each text."""
    data = b"\n".join(texts).lower()
    buf = padded(data)
    body = buf[: len(data)]
    gap = (body - np.uint8(9) < 5) | (body == 32)
    edge = np.nonzero(np.diff(gap, prepend=True, append=True))[0]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return buf, edge[::2], edge[1::2], np.nonzero(body == 10)[0], np.cumsum(size) - size


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (ASCII lower case, between white space) of the lines of several texts: one buffer, the start and end of each word,
    the number of words of each line, and the first line of each text."""
    buf, starts, ends, breaks, at = _joined_words(texts)
    return buf, starts, ends, np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(starts)), np.searchsorted(breaks, at)


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with the number of words of each text."""
    buf, starts, ends, _, at = _joined_words(texts)
    return buf, starts, ends, np.diff(np.searchsorted(starts, at), append=len(starts))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice: mixed eight bytes at a time up to 16, XXH64 beyond."""
    w64 = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    n = ends - starts
    with np.errstate(over="ignore"):
        h = mix64((w64[starts] & _HEADS[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _P1))
        more = np.nonzero((n > 8) & (n <= 16))[0]
        if more.size:
            h[more] = mix64(h[more] + (w64[starts[more] + 8] & _HEADS[n[more] - 8]) * _P3)
    far = np.nonzero(n > 16)[0]
    if far.size:
        h[far] = xxh64_slices(buf, starts[far], n[far])
    return h


def distinct_sets(h: np.ndarray, per: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of several runs of ``per`` values: their run (index) and value, in the order of rank (8 bits) and value."""
    run = np.repeat(np.arange(len(per), dtype=np.uint64), per)
    rank = np.zeros(len(h), np.uint64) if rank is None else rank.astype(np.uint64)
    # one key to sort by; where it is too short to tell values apart, the slower sort by all three
    key = (run << np.uint64(44)) | (rank << np.uint64(36)) | (h >> np.uint64(28))
    order = np.argsort(key)
    key, got = key[order], h[order]
    if len(per) >= 1 << 20 or ((key[1:] == key[:-1]) & (got[1:] != got[:-1])).any():
        order = np.lexsort((h, rank, run))
        got = h[order]
    run = run[order].astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (run[1:] != run[:-1]) | (got[1:] != got[:-1])
    return run[new], got[new]


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts make Arrow batches of Spark's default number of rows tens of MB large, for each task and outside of its heap; a
    session that has the default gets ``rows``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def sliced(batches, rows: int = 1024):
    """Arrow batches cut into slices, so that no more rows are Python objects at a time; what they took goes back at their end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def drained(batches):
    """Arrow batches as they come; what they took goes back at their end."""
    for batch in batches:
        yield batch
        del batch
    give_back()


def give_back() -> None:
    """Free memory of this worker to the system, so that it does not keep what an earlier task or stage took."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def groups_of_bytes(texts: list, most: int = 1 << 20):
    """Index ranges of ``texts`` that hold about ``most`` bytes each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


# -- rows of equal keys ----------------------------------------------------------------------------------------------


def bucket_blocks(rows: DataFrame, key: str, spread: str, name: str, block: int | None = None, payload: DataFrame | None = None) -> DataFrame:
    """Rows whose key occurs at least twice, dealt out in blocks of at most about ``2 * block`` rows.

    Adds ``blk_a``, ``blk_b`` (the two chunks that the block compares) and ``blk_side`` (true: the row is of chunk a).  A key
    of up to ``block`` rows is one block; a larger one is cut into chunks by the hash of ``spread``, and every two chunks
    meet in one block.  ``rows`` should be a staged table: it is read twice.  ``payload`` is joined by ``spread`` once the
    rows that meet no other are gone.
    """
    block = block or BLOCK
    counts = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("blk_n")).where("blk_n > 1"), f"{name}-counts")
    chunks = F.ceil(F.col("blk_n") / F.lit(block)).cast("int")
    out = rows.join(counts, key).withColumn("blk_m", chunks)
    out = out.withColumn("blk_c", F.when(F.col("blk_m") == 1, 0).otherwise(F.pmod(F.xxhash64(spread), F.col("blk_m")).cast("int")))
    out = out.withColumn("blk_o", F.explode(F.sequence(F.lit(0), F.col("blk_m") - 1)))
    out = out.withColumn("blk_a", F.least("blk_c", "blk_o")).withColumn("blk_b", F.greatest("blk_c", "blk_o"))
    out = out.withColumn("blk_side", F.col("blk_c") == F.col("blk_a")).drop("blk_m", "blk_c", "blk_o", "blk_n")
    if payload is not None:
        out = out.join(payload, spread)
    return out.repartition(F.col(key), F.col("blk_a"), F.col("blk_b")).sortWithinPartitions(key, "blk_a", "blk_b", spread)


def whole_runs(batches, keys: tuple[str, ...]):
    """Arrow batches, joined so that no block of equal ``keys`` is cut."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _run_starts(table, keys)[-1]
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        del held
    give_back()


def _run_starts(table, keys) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.nonzero(new)[0]


def run_pairs(table, key: str):
    """Index arrays (i, j), i < j, of the pairs that each block compares; one yield holds at most one pair for each row."""
    starts = _run_starts(table, (key, "blk_a", "blk_b"))
    ends = np.append(starts[1:], table.num_rows)
    left = np.repeat(ends, ends - starts) - np.arange(table.num_rows) - 1
    a, b = table.column("blk_a").to_numpy(), table.column("blk_b").to_numpy()
    side = table.column("blk_side").to_numpy(zero_copy_only=False)
    act, shift = np.nonzero(left >= 1)[0], 1
    while act.size:
        i, j = act, act + shift
        keep = (a[i] == b[i]) | (side[i] != side[j])
        yield i[keep], j[keep]
        shift += 1
        act = act[left[act] >= shift]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` nodes under the links (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        m = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


# -- components ------------------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node of each component of ``edges`` (a, b: long), for the nodes that have a link.

    Each round hooks a node to its smallest neighbour, jumps pointers until they stand still and contracts the edges; the
    number of nodes that still have a link at least halves a round.  Every round is staged, so its lineage is one scan.
    """
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, out = stage(tidy(edges), f"{name}-edges"), None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        par = stage(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), f"{name}-hook")
        while True:
            up = par.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            nxt = stage(par.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), f"{name}-jump")
            moved = not nxt.where("moved").isEmpty()
            par = nxt.select("u", "p")
            if not moved:
                break
        if out is None:
            out = par.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = par.select(F.col("u").alias("root"), F.col("p").alias("to"))
            out = stage(out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots")
        pa_, pb_ = par.select(F.col("u").alias("a"), F.col("p").alias("ra")), par.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        e = stage(tidy(e.join(pa_, "a").join(pb_, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), f"{name}-edges")
    if out is None:
        out = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out
