"""Near-duplicate documents by the Jaccard similarity of their word shingles, verified exactly.

A document is the set of its shingles of WORDS words.  Two documents are linked if their sets have a Jaccard similarity of
THRESHOLD or more; of each component of links one row stays.

1. Equal sets are one node, so a group of copies costs one row.
2. SimHash: the fingerprints of the nodes, over the same shingles, are linked by operator 2 (``simhash``: exact segments and Golay
   codewords, two bits at most); the fingerprints of one component are a first key of their nodes.
3. The rest: two sets at similarity 0.8 have fingerprints about ten bits apart, so nodes also get keys that reach so far.  ROWS minima
   of a set under seeded hash functions make one key, BANDS keys a node.  Sets at similarity s share one with probability
   1 - (1 - s**ROWS)**BANDS, which is over 0.9999 from 0.8 on.
4. Stars: the nodes of a key are checked against its least, then against its greatest node, each pair once for all keys.
5. Keys whose nodes are still of several components are compared in blocks of bounded size, pairs of different components alone.

No link goes by a key alone: every one is checked on the sets.

Edge cases: a text with fewer words is one shingle; null and blank texts are one node; rows are told apart by a number of their
own, so repeated and null ids leave one row a component too: that with the least id (null last); an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import group_fingerprints, link_fingerprints

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 20
SEED = 42
_FACTORS = C.mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and the distinct shingle hashes of each text, in order."""
    buf, starts, ends, n = C.text_words(texts)
    m = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    if not m.any():
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    word = C.word_hashes(buf, starts, ends)
    of = np.repeat(np.arange(len(texts)), m)
    first = np.arange(len(of)) - (np.cumsum(m) - m)[of] + (np.cumsum(n) - n)[of]
    h, size = np.full(len(of), SEED, np.uint64), np.minimum(words, n)[of]
    with np.errstate(over="ignore"):
        for k in range(words):
            inside = size > k
            nxt = C.mix64(h * _FACTORS[0] + word[np.minimum(first + k, len(word) - 1)])
            h = nxt if inside.all() else np.where(inside, nxt, h)
    of, h = C.distinct_sets(h, m)
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]), h


def nodes_and_keys(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The node of each set (0: empty), which sets are not empty, and the (n, BANDS) keys of those."""
    full = np.nonzero(np.diff(at))[0]
    node = np.zeros(len(at) - 1, np.uint64)
    if not full.size:
        return node, full, np.zeros((0, BANDS), np.uint64)
    first = at[full]
    keys = np.zeros((len(full), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        node[full] = C.mix64(np.add.reduceat(C.mix64(h), first) + np.diff(at)[full].astype(np.uint64)) | np.uint64(1)
        for k, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(h * factor, first)
            keys[:, k // ROWS] = C.mix64(keys[:, k // ROWS] * np.uint64(31) + least + np.uint64(k))
    return node, full, keys


def _comparer(values: np.ndarray, at: np.ndarray, threshold: float):
    """A function that tells which pairs of rows (x, y) have sets that reach the threshold."""
    n = np.diff(at).astype(np.int64)
    salt = C.mix64(np.arange(len(n), dtype=np.uint64) + np.uint64(1))
    member = np.sort(C.mix64(values[at[0] : at[-1]] ^ np.repeat(salt, n)))

    def check(x, y):
        need = np.ceil(threshold / (1 + threshold) * (n[x] + n[y]) - 1e-9)
        ok = np.minimum(n[x], n[y]) >= need
        p = np.nonzero(ok)[0]
        if p.size:
            size = n[x[p]]
            of = np.repeat(np.arange(len(p)), size)
            own = values[at[x[p]][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)]
            asked = C.mix64(own ^ salt[y[p]][of])
            found = np.minimum(np.searchsorted(member, asked), len(member) - 1)
            ok[p] = np.bincount(of[member[found] == asked], minlength=len(p)) >= need[p]
        return ok

    return lambda x, y: np.concatenate([np.zeros(0, bool), *(check(x[k : k + 256], y[k : k + 256]) for k in range(0, len(x), 256))])


def near_links(rows: DataFrame, sets_of, threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, root) of the nodes that have a link; ``rows`` (staged) has node and key, ``sets_of`` gives (node, set) of nodes."""
    import pyarrow as pa

    ends = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    met = C.stage(rows.join(C.stage(ends, "near-ends"), "key"), "near-met")
    if met.isEmpty():
        return None
    sets = C.stage(sets_of(met.select("node").distinct()), "near-sets")

    def star(batches):
        for batch in C.drained(batches):
            for part in C.sliced([batch], 256):
                k = part.num_rows
                both = pa.concat_arrays([part.column("set"), part.column("other_set")])
                ok = _comparer(both.values.to_numpy().view(np.uint64), both.offsets.to_numpy(), threshold)(np.arange(k), np.arange(k) + k)
                yield pa.record_batch([part.column("node").filter(pa.array(ok)), part.column("other").filter(pa.array(ok))], names=["a", "b"])

    other = sets.select(F.col("node").alias("other"), F.col("set").alias("other_set"))
    links, roots, still = None, None, met
    for end in ("lo", "hi"):
        pairs = C.stage(still.where(f"node <> {end}").select("node", F.col(end).alias("other")).distinct(), "near-pairs")
        new = C.stage(pairs.join(sets, "node").join(other, "other").mapInArrow(star, "a long, b long"), "near-star")
        links = new if links is None else links.union(new)
        roots = C.connected_components(links, "near")
        label = met.join(roots, "node", "left").select("node", "key", "lo", "hi", F.coalesce("root", "node").alias("label"))
        label = C.stage(label, "near-label")
        mixed = label.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
        still = C.stage(label.join(C.stage(mixed, "near-mixed"), "key", "left_semi"), "near-still")
        if still.isEmpty():
            return roots

    def verify(batches):
        for table in C.whole_runs(batches, ("key", "blk_a", "blk_b")):
            node = table.column("node").to_numpy()
            _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
            col = table.column("set").combine_chunks()
            same = _comparer(col.values.to_numpy().view(np.uint64), col.offsets.to_numpy(), threshold)
            for i, j in C.run_pairs(table, "key"):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                ok = same(i, j)
                i, j = i[ok], j[ok]
                if i.size:
                    yield pa.record_batch([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])
                    label = C.local_roots(int(label.max()) + 1, label[i], label[j])[label]

    more = C.bucket_blocks(still.select("key", "node", "label"), "key", "node", "near-blocks", payload=sets).mapInArrow(verify, "a long, b long")
    return C.connected_components(links.union(C.stage(more, "near-more")), "near")


def simhash_keys(nodes: DataFrame) -> DataFrame:
    """(node, key) of the nodes (node, fp; staged) whose fingerprints have a link, or are equal: a key for each component of fingerprints."""
    roots = C.connected_components(link_fingerprints(nodes.select("fp").distinct(), "near-simhash"), "near-simhash")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    return named.select("node", F.xxhash64(F.lit("simhash"), F.col("root")).alias("key"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` (all its columns) with one row of each component: that with the least id."""
    import pyarrow as pa

    C.text_batches(df.sparkSession)
    held = C.stage(df.withColumn("__wl_row", F.monotonically_increasing_id()), "near-rows")
    src = held.select(F.col("__wl_row").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def mark(batches):
        for batch in C.sliced(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in C.groups_of_bytes(texts):
                node, full, keys = nodes_and_keys(*shingle_sets(texts[a:b], words))
                at = np.concatenate([[0], np.cumsum(np.bincount(full, minlength=b - a) * BANDS)]).astype(np.int32)
                got = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1).view(np.int64)))
                fp = group_fingerprints(texts[a:b], words)
                ids = [batch.column(c).slice(a, b - a) for c in ("row", "id")]
                yield pa.record_batch([*ids, pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), got], names=["row", "id", "node", "fp", "keys"])

    def fetch(batches):
        for batch in C.sliced(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in C.groups_of_bytes(texts):
                at, h = shingle_sets(texts[a:b], words)
                yield pa.record_batch([batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "set"])

    marks = C.stage(src.mapInArrow(mark, "row long, id long, node long, fp long, keys array<long>"), "near-marks")
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"))
    least = C.stage(marks.groupBy("node").agg(F.min(rank).alias("best"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "near-nodes")
    full = least.where(F.size("keys") > 0)
    rows = C.stage(simhash_keys(full.select("node", "fp")).union(full.select("node", F.explode("keys").alias("key"))), "near-keys")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = C.stage(least.join(nodes, "node").select("node", F.col("best.r").alias("row")), "near-wanted")
        return src.join(wanted, "row").select("node", "text").mapInArrow(fetch, "node long, set array<long>")

    roots = near_links(rows, sets_of, threshold)
    if roots is None:
        named = least.select("node", F.col("node").alias("root"), "best")
    else:
        named = least.select("node", "best").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")
    stays = named.groupBy("root").agg(F.min("best").alias("stay"))
    classes = C.stage(named.join(stays, "root").select("node", F.col("stay.r").alias("stay")), "near-classes")
    gone = C.stage(marks.join(classes, "node").where("row <> stay").select(F.col("row").alias("__wl_row")), "near-gone")
    return held.join(gone, "__wl_row", "left_anti").select(*df.columns)
