"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits.  Two fingerprints that differ in at most two bits agree
wholly in one segment (pigeonhole) and differ in at most two bits of the next.  That next segment, as a word of the perfect
[23,12,7] Golay code, is decoded to every codeword within distance four (six at most): two words at distance two have a word
at distance one from both, and the codeword nearest to it is within four of both.  So they share a key (segment number, exact
segment, codeword index); rows that share a key are joined in blocks and verified by their bits.

Edge cases: a null or blank text has fingerprint zero and is linked like any other; equal fingerprints are one node, so a
group of copies costs one row; a null doc_id keeps its row (it counts for a component only if no other member has an id, else
the smallest id names it); repeated rows keep their number; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEED = 42
WORDS = 3
BITS = 2
#: Shingles hashed at a time.
PART = 1 << 15
_SEGMENTS = ((0, 21), (21, 21), (42, 22))
# Fixed value: generator polynomial of the binary Golay code.
_GOLAY = 0b110001110101

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def _syndromes() -> np.ndarray:
    v = np.arange(1 << 12, dtype=np.int64)

    def mod(x):
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= ((x >> bit) & 1) * (_GOLAY << (bit - 11))
        return x

    return np.stack([mod(v), mod(v << 12 & (1 << 23) - 1)])


_SYNDROME = _syndromes()


def syndrome(v: np.ndarray) -> np.ndarray:
    return _SYNDROME[0][v & 4095] ^ _SYNDROME[1][v >> 12]


def _errors() -> np.ndarray:
    """For each syndrome the error patterns of weight four or less that give it, the last repeated up to six."""
    from itertools import combinations

    by: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        e = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for s, x in zip(syndrome(e), e, strict=True):
            by[s].append(int(x))
    return np.array([x + [x[-1]] * (6 - len(x)) for x in by], np.int64)


_ERRORS = _errors()


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance four of each 23-bit word; repeats fill up rows that have fewer."""
    return (words[:, None] ^ _ERRORS[syndrome(words)]) >> 11


def golay_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 18) keys of unsigned 64-bit fingerprints."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    return np.concatenate([(golay_indices(seg[(k + 1) % 3]) | (seg[k][:, None] << 12)) | (k << 34) for k in range(3)], axis=1)


def group_fingerprints(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of several texts."""
    split = [t.lower().split() for t in texts]
    out = np.zeros(len(texts), np.uint64)
    full = [i for i, w in enumerate(split) if w]
    if not full:
        return out
    buf, starts, ends = C.word_spans([split[i] for i in full])
    n = np.array([len(split[i]) for i in full])
    m = np.maximum(n - words + 1, 1)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(full)), m)
    begin = np.cumsum(m) - m
    at = np.arange(int(m.sum())) - begin[of] + first[of]
    last = at + np.minimum(words, n)[of] - 1
    s, length = starts[at], ends[last] - starts[at]
    ones = np.zeros((len(full), 64), np.int64)
    for k in range(0, len(s), PART):
        h = C.xxh64_slices(buf, s[k : k + PART], length[k : k + PART], seed)
        o = of[k : k + PART]
        # blocks of up to 255 shingles of one text, so that the byte-wide counters hold
        place = np.arange(k, k + len(o)) - np.maximum(begin[o], k)
        blocks = np.nonzero(place % 255 == 0)[0]
        part = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], blocks, axis=0)
        np.add.at(ones, o[blocks], part.view(np.uint8).reshape(-1, 64))
    bits = np.packbits(2 * ones > m[:, None], axis=1, bitorder="little")
    out[full] = bits.view("<u8")[:, 0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id_col, fp: long): the fingerprint of every row's whole text; shingles are hashed in parts of bounded size."""
    import pyarrow as pa

    def run(batches):
        for batch in C.sliced(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            fp = np.concatenate([np.zeros(0, np.uint64)] + [group_fingerprints(texts[a:b], words, seed) for a, b in C.groups_of_bytes(texts)])
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long").select(F.col("id").alias(id_col), "fp")


def link_fingerprints(fps: DataFrame, name: str = "simhash", bits: int = BITS) -> DataFrame:
    """(a, b) links that span the components of distinct fingerprints ``fp`` under ``bits`` (two at most) differing bits.

    Each block of a key yields a spanning forest of its verified links, never all its pairs.
    """
    import pyarrow as pa

    if bits > 2:
        raise ValueError("the keys cover up to two differing bits")

    def keys(batches):
        for batch in C.drained(batches):
            fp = batch.column(0).to_numpy()
            k = np.sort(golay_keys(fp.view(np.uint64)), axis=1)
            new = np.ones(k.shape, bool)
            new[:, 1:] = k[:, 1:] != k[:, :-1]
            row, _ = np.nonzero(new)
            yield pa.record_batch([pa.array(k[new]), pa.array(fp[row])], names=["key", "fp"])

    def verify(batches):
        for table in C.whole_runs(batches, ("key", "blk_a", "blk_b")):
            fp = table.column("fp").to_numpy().view(np.uint64)
            found = [np.zeros((2, 0), np.int64)]
            for i, j in C.run_pairs(table, "key"):
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= bits
                found.append(np.stack([i[ok], j[ok]]))
            i, j = np.concatenate(found, axis=1)
            root = C.local_roots(len(fp), i, j)
            own = np.nonzero(root != np.arange(len(fp)))[0]
            s = fp.view(np.int64)
            yield pa.record_batch([pa.array(s[own]), pa.array(s[root[own]])], names=["a", "b"])

    rows = C.stage(fps.select("fp").mapInArrow(keys, "key long, fp long"), f"{name}-keys")
    return C.bucket_blocks(rows, "key", "fp", name).mapInArrow(verify, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per input row: id_col, fp (long), component (smallest id reachable by links of ``bits`` or fewer bits)."""
    docs = C.stage(fingerprints(df, id_col, text_col, words), "simhash-docs")
    least = C.stage(docs.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-distinct")
    roots = C.connected_components(link_fingerprints(least, bits=bits), "simhash")
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("least_id").alias("component"))
    classes = C.stage(linked.join(named, "root").select("fp", "component"), "simhash-classes")
    return docs.join(classes, "fp").select(id_col, "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``df`` (all its columns) with one row of each component: that with the least id (null last).

    Rows are told apart by a number of their own, so repeated and null ids change nothing.
    """
    held = C.stage(df.withColumn("__wl_row", F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(held, "__wl_row", text_col, words, bits).select("__wl_row", "component")
    named = C.stage(found.join(held.select("__wl_row", F.col(id_col).alias("__wl_id")), "__wl_row"), "simhash-named")
    rank = F.struct(F.col("__wl_id").isNull(), F.col("__wl_id"), F.col("__wl_row").alias("row"))
    stays = named.groupBy("component").agg(F.min(rank).alias("stay"))
    gone = C.stage(named.join(stays, "component").where(F.col("__wl_row") != F.col("stay.row")).select("__wl_row"), "simhash-gone")
    return held.join(gone, "__wl_row", "left_anti").select(*df.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
