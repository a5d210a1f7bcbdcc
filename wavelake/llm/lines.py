"""Line dedup by an exact set-similarity join.

A line is the set of its words.  A line goes if an earlier line, in the order of (id, text hash, line number), has a Jaccard
similarity of THRESHOLD or more; whether that earlier line itself goes does not matter, so the result is one whatever the plan.

1. Rarity: word counts over all documents in a table of SLOTS hashed counters (8 bits each, on a logarithmic scale), the only
   thing broadcast.  It orders the words of a line, rare ones first; any order gives the same result, a good one little work.
2. Lines with equal sets are one class, led by its first line; the others go.
3. Prefix filter: the leaders meet at the words of their prefix (words seen once in all documents meet nobody), in order of size,
   so that only sizes that can be similar are paired.  Pairs must pass the length, the positional and a parity filter (words set
   bits of a map by exclusive or: sets differ in at least as many words as their maps in bits); lines with such a partner stay in
   the race.  Words seen in fewer than HOT_BLOCKS blocks of places make small groups; those of more frequent words are cut into
   blocks of bounded size.
4. Verify: the word sets of these lines are read again.  Each is checked by exact Jaccard similarity against the earliest of its
   partners; those that this does not settle are checked against all their partners, in blocks.

Steps 2 and 3 are one chain of two shuffles.  Their rows travel as packed arrays, one for each batch and partition: a shuffle then
moves a few large rows instead of one for each word.  The number of partitions follows the number of words counted in step 1.

Edge cases: a null text stays null, with no lines; blank lines always stay, and with ``least_words`` (LEAST_WORDS unless named; the
query and the pipeline ask for 1) so do lines with fewer distinct words;
rows with one id and one text are one document and get one result; a null id comes after all others; a document may lose all
its lines and then has an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8
LEAST_WORDS = 5
SLOTS = 1 << 24
_RANGE = 1 << 16
#: Words for each partition of the packed shuffles.
PART_WORDS = 4_000_000
#: Words seen in so many blocks' worth of places have their lines dealt out in blocks.
HOT_BLOCKS = 8
_LINE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("did", "<i8"), ("th", "<i8"), ("line", "<i4"), ("n", "<i4"), ("b0", "<u8"), ("b1", "<u8"), ("heads", "<i4")])
_HEAD = np.dtype([("word", "<u4"), ("place", "<u2"), ("hot", "?")])
_ENTRY = np.dtype([("key", "<u4"), ("lid", "<i8"), ("did", "<i4"), ("n", "<i4"), ("place", "<u2"), ("b0", "<u8"), ("b1", "<u8")])
_GONE = np.dtype([("did", "<i8"), ("th", "<i8"), ("line", "<i4")])
_LAST = (1 << 63) - 1


def _classes(n: np.ndarray) -> np.ndarray:
    """8-bit classes that rise with counts: 0, 1, 2 and 3 stand for themselves, then eight an octave."""
    big = 4 + np.floor(8 * np.log2(np.maximum(n, 4) / 4)).astype(np.int64)
    return np.where(n < 4, n, np.minimum(big, 255)).astype(np.uint8)


def _emit_counts(acc: np.ndarray):
    """Packed (slot in its range, count) of the counters in use, one row for each range of slots."""
    import pyarrow as pa

    ranges, slots, counts = [], [], []
    for k in range(len(acc) // _RANGE):
        part = acc[k * _RANGE : (k + 1) * _RANGE]
        u = np.nonzero(part)[0]
        if u.size:
            ranges.append(k)
            slots.append(u.astype("<u2").tobytes())
            counts.append(part[u].astype("<u4").tobytes())
    return pa.record_batch([pa.array(ranges, pa.int32()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], names=["r", "slots", "counts"])


def _tally(slots: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots in order and the sums of their counts."""
    slot, n = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(slot, kind="stable")
    slot, n = slot[order], n[order]
    first = np.nonzero(np.diff(slot.astype(np.int64), prepend=-1))[0]
    return slot[first], np.add.reduceat(n, first) if len(n) else n


def _emit_tally(slot: np.ndarray, n: np.ndarray):
    """The same rows as ``_emit_counts``, from the distinct slots in use, in order, and their counts."""
    import pyarrow as pa

    cut = np.nonzero(np.diff((slot // _RANGE).astype(np.int64), prepend=-1))[0]
    ends = [*cut[1:], len(slot)]
    low, n = (slot % _RANGE).astype("<u2"), n.astype("<u4")
    rows = [[x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)] for x in (low, n)] if len(slot) else [[], []]
    return pa.record_batch([pa.array((slot[cut] // _RANGE).astype(np.int32)), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], names=["r", "slots", "counts"])


def slot_table(parts: DataFrame, slots: int) -> tuple[np.ndarray, int]:
    """Sums packed counters and brings the classes of all slots, one byte each, to the driver, and the sum of all counts."""
    import pyarrow as pa

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in C.drained(batches):
            for r, s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                acc = sums.setdefault(r, np.zeros(_RANGE, np.int64))
                acc[np.frombuffer(s, "<u2")] += np.frombuffer(c, "<u4")
        classes = [_classes(a).tobytes() for a in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary()), pa.array([int(a.sum()) for a in sums.values()], pa.int64())], names=["r", "classes", "n"])

    out, total = np.zeros(slots, np.uint8), 0
    for r in parts.repartition("r").mapInArrow(add, "r int, classes binary, n long").collect():  # one byte for each of SLOTS
        out[r.r * _RANGE : (r.r + 1) * _RANGE] = np.frombuffer(r.classes, np.uint8)
        total += r.n
    return out, total


def _split_lines(texts: list[bytes]):
    """Hashes of the words of several texts, and for each line that has words its text, its number and how many they are."""
    buf, starts, ends, per, first = C.line_words(texts)
    if not len(starts):
        return None
    full = np.nonzero(per)[0]
    text_of = np.searchsorted(first, full, "right") - 1
    return C.word_hashes(buf, starts, ends), text_of, full - first[text_of], per[full]


def _order32(x: np.ndarray) -> np.ndarray:
    """32-bit numbers that never fall where ``x`` rises."""
    i = x.astype("<f4").view("<i4")
    return i ^ ((i >> 31) & 0x7FFFFFFF)


def _line_ids(did: np.ndarray, th: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = C.mix64(did.astype(np.uint64) ^ C.mix64(th.view(np.uint64)))
        return C.mix64(x + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _texts(batch) -> list[bytes]:
    """Texts of a batch in UTF-8, as Arrow has them; a null is empty."""
    import pyarrow as pa

    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("did").to_numpy(), batch.column("th").to_numpy()


def _parity(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two words of 64 bits for each set: a bit is set if an odd number of its words fall on it."""
    bit, half = np.uint64(1) << ((h >> np.uint64(41)) & np.uint64(63)), (h >> np.uint64(40)) & np.uint64(1)
    return [np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), first) for k in (0, 1)]


def _need(n, m, t: float):
    """Common words that sets of n and m words need for similarity t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9)


def _places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the items of several runs: ``size`` of them from ``at`` on."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


# records are taken by ``take``, which moves them whole; an index moves them field by field, at some ten times the cost
def _packed(kind: int, part: np.ndarray, rows: np.ndarray, heads: np.ndarray | None = None, at: np.ndarray | None = None):
    """(kind, part, rows, more) with one binary row for each part; ``more`` has the heads of its rows, which stand from ``at`` on."""
    if not len(rows):
        return []
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows.take(order)
    cut = np.nonzero(np.diff(part, prepend=-1))[0]
    size = np.diff(cut, append=len(rows)) * rows.itemsize
    data, ends = memoryview(rows.view(np.uint8)), np.cumsum(size)
    if heads is None:
        return [(kind, int(k), data[e - n : e], b"") for k, n, e in zip(part[cut], size, ends, strict=True)]
    count = rows["heads"].astype(np.int64)
    more = memoryview(heads.take(_places(at[order], count)).view(np.uint8))
    sizes = np.add.reduceat(count, cut) * heads.itemsize
    return [(kind, int(k), data[e - n : e], more[f - m : f]) for k, n, e, m, f in zip(part[cut], size, ends, sizes, np.cumsum(sizes), strict=True)]


def _batch(rows: list):
    import pyarrow as pa

    k, p, r, m = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(r, pa.binary()), pa.array(m, pa.binary())], names=["kind", "part", "rows", "more"])


_PACKED = "kind int, part int, rows binary, more binary"


def _runs(keys: np.ndarray, n: np.ndarray, t: float):
    """Pairs (i, j), i < j, of equal keys whose sizes can reach similarity t, one shift at a time; rows are sorted by key and size."""
    most = np.floor((n + 1e-8) / t).astype(np.int64)
    left = np.searchsorted(keys << 31 | n, keys << 31 | most, "right") - np.arange(len(n)) - 1
    act, shift = np.nonzero(left >= 1)[0], 1
    while act.size:
        yield act, act + shift
        shift += 1
        act = act[left[act] >= shift]


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, slots: int = SLOTS) -> DataFrame:
    """(did, th, line) of the lines that go; ``docs`` has did (long), th (long: hash of the text), text."""
    import pyarrow as pa

    spark = docs.sparkSession
    C.text_batches(spark)
    mask = np.uint64(slots - 1)
    rare = int(_classes(np.array([HOT_BLOCKS * C.BLOCK]))[0])  # classes below stand for smaller counts

    def count(batches):
        # distinct slots of each MB of text, folded together now and then: an array of all slots takes 64 MB of every worker
        seen, sums, held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for batch in C.sliced(batches):
            texts = _texts(batch)
            for a, b in C.groups_of_bytes(texts):
                if (got := _split_lines(texts[a:b])) is not None:
                    slot, n = np.unique((got[0] & mask).astype(np.uint32), return_counts=True)
                    seen.append(slot)
                    sums.append(n)
                    held += len(slot)
            if held > max(1 << 19, 2 * len(seen[0])):
                slot, n = _tally(seen, sums)
                seen, sums, held = [slot], [n], len(slot)
        yield _emit_tally(*_tally(seen, sums))

    table, words = slot_table(docs.select("text").mapInArrow(count, "r int, slots binary, counts binary"), slots)
    rarity = spark.sparkContext.broadcast(table)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // PART_WORDS)

    def prefix(texts, did, th):
        """Rows of the lines of some texts, and the heads of each."""
        got = _split_lines(texts)
        if got is None:
            return np.zeros(0, _LINE), np.zeros(0, _HEAD)
        h, text_of, line_of, per = got
        of, h = C.distinct_sets(h, per, rarity.value[(h & mask).astype(np.int64)])
        n = np.bincount(of, minlength=len(per))
        first = np.cumsum(n) - n
        keep = n >= least_words
        # sets too small to be similar to one with a word more meet equal sets alone, which are one class
        meets = keep & (n + 1e-9 >= threshold * (n + 1))
        most = np.where(meets, np.minimum(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n), 0)
        head = _places(first, most)
        cls = rarity.value[(h[head] & mask).astype(np.int64)]
        head, cls = head[cls != 1], cls[cls != 1]
        rows = np.zeros(len(per), _LINE)
        rows["h1"], rows["h2"] = np.add.reduceat(C.mix64(h), first), np.add.reduceat(C.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        rows["b0"], rows["b1"] = _parity(h, first)
        rows["did"], rows["th"], rows["line"], rows["n"] = did[text_of], th[text_of], line_of, n
        rows["heads"] = np.bincount(of[head], minlength=len(per))
        heads = np.zeros(len(head), _HEAD)
        heads["word"], heads["place"], heads["hot"] = h[head].astype(np.uint32), np.minimum(head - first[of[head]], 65535), cls >= rare
        return rows.take(np.nonzero(keep)[0]), heads

    def leaders(rows):
        """Places of the first rows of each set, and of the rows that go for them: not those of a copy of the first one's document."""
        order = np.lexsort((rows["line"], rows["th"], rows["did"], rows["h2"], rows["h1"]))
        r = rows.take(order)
        new = np.ones(len(r), bool)
        new[1:] = (r["h1"][1:] != r["h1"][:-1]) | (r["h2"][1:] != r["h2"][:-1])
        lead = np.nonzero(new)[0][np.cumsum(new) - 1] if len(r) else order
        other = np.zeros(len(r), bool)
        for c in ("did", "th", "line"):
            x = np.ascontiguousarray(r[c])
            other |= x != x[lead]
        return order[new], order[other]

    def gone_rows(rows):
        out = np.zeros(len(rows), _GONE)
        for c in _GONE.names:
            out[c] = rows[c]
        return _packed(0, (rows["h1"] % np.uint64(parts)).astype(np.int64), out)

    def lines(batches):
        for batch in C.sliced(batches, 4096):
            texts = _texts(batch)
            did, th = _ids(batch)
            got = [prefix(texts[a:b], did[a:b], th[a:b]) for a, b in C.groups_of_bytes(texts)]
            if not got:
                continue
            rows, heads = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            at = np.cumsum(rows["heads"], dtype=np.int64) - rows["heads"]
            lead, gone = leaders(rows)
            led = rows.take(lead)
            yield _batch(_packed(1, (led["h1"] % np.uint64(parts)).astype(np.int64), led, heads, at[lead]) + gone_rows(rows.take(gone)))

    def classes(batches):
        held, more = [], []
        for batch in C.drained(batches):
            for kind, part, r, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    yield _batch([(0, part, r, b"")])
                else:
                    held.append(np.frombuffer(r, _LINE))
                    more.append(np.frombuffer(m, _HEAD))
        if not held:
            return
        rows, heads = np.concatenate(held), np.concatenate(more)
        del held, more, r, m
        at = np.cumsum(rows["heads"], dtype=np.int64) - rows["heads"]
        lead, gone = leaders(rows)
        yield _batch(gone_rows(rows.take(gone)))
        led = rows.take(lead)
        size = led["heads"].astype(np.int64)
        pick = heads.take(_places(at[lead], size))
        own = np.zeros(len(led), _ENTRY)
        own["lid"], own["did"] = _line_ids(led["did"], led["th"], led["line"]), _order32(led["did"])
        for c in ("n", "b0", "b1"):
            own[c] = led[c]
        entry = own.take(np.repeat(np.arange(len(led)), size))
        entry["key"], entry["place"] = pick["word"], pick["place"]
        to = (C.mix64(pick["word"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        hot, cool = np.nonzero(pick["hot"])[0], np.nonzero(~pick["hot"])[0]
        del rows, heads, led, own, pick
        yield _batch(_packed(2, to[cool], entry.take(cool)))
        yield _batch(_packed(3, (entry["lid"][hot].view(np.uint64) % np.uint64(parts)).astype(np.int64), entry.take(hot)))
        del entry, to, hot, cool
        C.give_back()

    def passing(n, bits, i, j):
        need = _need(n[i], n[j], threshold)
        apart = sum(np.bitwise_count(b[i] ^ b[j]) for b in bits)
        return (np.minimum(n[i], n[j]) >= need) & (n[i].astype(np.int64) + n[j] - 2 * need >= apart)

    def racing(n, bits, place, did, pairs):
        """Which rows have a partner, and the row of the partner with the least id among those not after it (-1: none)."""
        stays, best = np.zeros(len(n), bool), np.full(len(n), -1)
        for i, j in pairs:
            ok = passing(n, bits, i, j)
            i, j = i[ok], j[ok]
            ok = np.minimum(n[i] - place[i], n[j] - place[j]) >= _need(n[i], n[j], threshold)
            i, j = i[ok], j[ok]
            stays[i] = stays[j] = True
            # a row is in one pair of a shift at most on either side
            for x, y in ((i, j), (j, i)):
                better = (did[y] <= did[x]) & ((best[x] < 0) | (did[y] < did[best[x]]))
                best[x[better]] = y[better]
        return stays, best

    names = ["kind", "key", "lid", "n", "b0", "b1", "place", "partner", "did", "th", "line"]

    kept = ["key", "lid", "n", "b0", "b1", "partner", "did"]

    def out(kind, entry=None, gone=None, partner=None):
        """kind 0: a line that goes; 2: a line in the race, did that of its partner; 3: the head of a frequent word."""
        n = len(entry if entry is not None else gone)
        none = pa.nulls(n, pa.int64())
        e = [pa.array(entry[c].astype(np.int64)) for c in names[1:7]] if entry is not None else [none] * 6
        if partner is not None:
            rows, best = partner
            lid, did = (pa.array(np.where(best >= 0, rows[c][best].astype(np.int64), 0), mask=best < 0) for c in ("lid", "did"))
            return pa.record_batch([pa.array(np.full(n, kind, np.int64)), *e, lid, did, none, none], names=names)
        g = [pa.array(gone[c].astype(np.int64)) for c in ("did", "th", "line")] if gone is not None else [pa.array(entry["did"].astype(np.int64)), none, none]
        return pa.record_batch([pa.array(np.full(n, kind, np.int64)), *e, none, *g], names=names)

    def race(batches):
        held = []
        for batch in C.drained(batches):
            for kind, r in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind == 0:
                    yield out(0, gone=np.frombuffer(r, _GONE))
                elif kind == 3:
                    yield out(3, entry=np.frombuffer(r, _ENTRY))
                else:
                    held.append(np.frombuffer(r, _ENTRY))
        if held:
            e = np.concatenate(held)
            del held, r
            e = e.take(np.argsort(e["key"].astype(np.int64) << 31 | e["n"], kind="stable"))
            n, b0, b1, place, key, did = (np.ascontiguousarray(e[c]) for c in ("n", "b0", "b1", "place", "key", "did"))
            stays, best = racing(n, (b0, b1), place.astype(np.int64), did, _runs(key.astype(np.int64), n.astype(np.int64), threshold))
            yield out(2, entry=e.take(np.nonzero(stays)[0]), partner=(e, best[stays]))
            del e, n, b0, b1, place, key, did, stays, best
            C.give_back()

    def hot_race(batches):
        for t in C.whole_runs(batches, ("key", "blk_a", "blk_b")):
            n, b0, b1, place, did, lid = (t.column(c).to_numpy() for c in ("n", "b0", "b1", "place", "did", "lid"))
            stays, best = racing(n, (b0.view(np.uint64), b1.view(np.uint64)), place, did, C.run_pairs(t, "key"))
            at, best = np.nonzero(stays)[0], best[stays]
            cols = [t.column(c).combine_chunks().take(pa.array(at)) for c in kept[:-2]]
            more = [pa.array(np.where(best >= 0, x[best], 0), mask=best < 0) for x in (lid, did)]
            yield pa.record_batch([*cols, *more], names=kept)

    chain = docs.mapInArrow(lines, _PACKED).repartitionById(parts, F.col("part")).mapInArrow(classes, _PACKED).repartitionById(parts, F.col("part"))
    met = C.stage(chain.mapInArrow(race, ", ".join(f"{c} long" for c in names)), "line-race")
    copies = met.where("kind = 0").select("did", "th", F.col("line").cast("int").alias("line"))
    left = met.where("kind = 2").select(*kept)
    hot = met.where("kind = 3").select("key", "lid", "n", "b0", "b1", "place", "did")
    if not hot.isEmpty():
        more = C.bucket_blocks(hot, "key", "lid", "line-hot").mapInArrow(hot_race, ", ".join(f"{c} long" for c in kept))
        left = C.stage(left.union(more), "line-left")
    C.release(spark)

    def mark(batches):
        acc = np.zeros(slots, np.uint8)
        for batch in C.drained(batches):
            acc[(batch.column(0).to_numpy().view(np.uint64) & mask).astype(np.int64)] = 1
        yield _emit_counts(acc)

    def fetch(wanted, batches):
        held = wanted.value
        for batch in C.sliced(batches):
            texts = _texts(batch)
            did, th = _ids(batch)
            count = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
            of = np.repeat(np.arange(len(texts)), count)
            line = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            lid = _line_ids(did[of], th[of], line)
            slot = (lid.view(np.uint64) & mask).astype(np.int64)
            hit = np.nonzero(held[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)[0]
            cut = {i: texts[i].split(b"\n") for i in np.unique(of[hit])}
            found = [cut[i][k] for i, k in zip(of[hit], line[hit], strict=True)]
            for a, b in C.groups_of_bytes(found):
                if (got := _split_lines(found[a:b])) is None:
                    continue
                h, picked, _, per = got
                pick = hit[a:b][picked]
                s, h = C.distinct_sets(h, per)
                at = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(per)))]).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(lid[pick]), pa.array(did[of[pick]]), pa.array(th[of[pick]]), pa.array(line[pick].astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))],
                    names=["lid", "did", "th", "line", "set"],
                )

    def sets_of(lids: DataFrame) -> DataFrame:
        """Word sets of these lines, and of a few others that share their slots."""
        table = slot_table(lids.mapInArrow(mark, "r int, slots binary, counts binary"), slots)[0]
        wanted = spark.sparkContext.broadcast(np.packbits(table > 0))
        return docs.mapInArrow(lambda batches: fetch(wanted, batches), "lid long, did long, th long, line int, set array<long>")

    def comparer(words, at):
        """A function that tells which pairs of rows (x, y) have sets that reach the threshold."""
        salt = C.mix64(np.arange(len(at) - 1, dtype=np.uint64) + np.uint64(1))
        member = np.sort(C.mix64(words ^ np.repeat(salt, np.diff(at))))
        n = np.diff(at).astype(np.int64)

        def check(p, q):
            size = n[p]
            of = np.repeat(np.arange(len(p)), size)
            own = words[at[p][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)]
            asked = C.mix64(own ^ salt[q][of])
            found = np.minimum(np.searchsorted(member, asked), len(member) - 1)
            return np.bincount(of[member[found] == asked], minlength=len(p)) >= _need(n[p], n[q], threshold)

        return lambda x, y: np.concatenate([np.zeros(0, bool), *(check(x[k : k + 4096], y[k : k + 4096]) for k in range(0, len(x), 4096))])

    def after(did, th, line, x, y):
        """Whether rows x stand after rows y."""
        return np.where(did[x] != did[y], did[x] > did[y], np.where(th[x] != th[y], th[x] > th[y], line[x] > line[y]))

    def first_check(batches):
        # rows of one ``lead``: the lead itself and the lines whose partner it is
        for batch in C.drained(batches):
            if not batch.num_rows:
                continue
            did, th, line = (batch.column(c).to_numpy() for c in ("did", "th", "line"))
            own, other = batch.column("set"), batch.column("lead_set")
            both = pa.concat_arrays([own, other])
            k = batch.num_rows
            ok = comparer(both.values.to_numpy().view(np.uint64), both.offsets.to_numpy())(np.arange(k), np.arange(k) + k)
            lead = [batch.column(c).to_numpy() for c in ("lead_did", "lead_th", "lead_line")]
            d, t, n = (np.concatenate(c) for c in zip((did, th, line), lead, strict=True))
            gone = ok & after(d, t, n, np.arange(k), np.arange(k) + k)
            yield pa.record_batch([batch.column("lid"), batch.column("did"), batch.column("th"), batch.column("line"), pa.array(gone)], names=["lid", "did", "th", "line", "gone"])

    # first against the one partner that comes earliest: most lines that go, go here; a line whose partners all come later stays
    pairs = left.where("partner IS NOT NULL").groupBy("lid").agg(F.min_by("partner", F.struct("did", "partner")).alias("lead"))
    pairs = C.stage(pairs, "line-pairs")
    lids = pairs.select("lid").union(pairs.select("lead"))
    sets = C.stage(sets_of(lids), "line-sets")
    asked = sets.join(pairs, "lid")
    leads = sets.select(F.col("lid").alias("lead"), F.col("did").alias("lead_did"), F.col("th").alias("lead_th"), F.col("line").alias("lead_line"), F.col("set").alias("lead_set"))
    one = C.stage(asked.join(leads, "lead").mapInArrow(first_check, "lid long, did long, th long, line int, gone boolean"), "line-first")
    C.release(spark)
    met_first = one.where("gone").select("did", "th", "line")

    # the others against all lines of their groups
    open_ = one.where(~F.col("gone")).select("lid").distinct()
    keys = left.join(open_, "lid", "left_semi").select("key").distinct()
    rest = left.join(keys, "key", "left_semi").select("key", "lid", "n", "b0", "b1").distinct()
    rest = C.stage(rest.join(open_.withColumn("open", F.lit(True)), "lid", "left"), "line-rest")

    def verify(batches):
        for table in C.whole_runs(batches, ("key", "blk_a", "blk_b")):
            did, th, line, n = (table.column(c).to_numpy() for c in ("did", "th", "line", "n"))
            bits = tuple(table.column(c).to_numpy().view(np.uint64) for c in ("b0", "b1"))
            asks = table.column("open").fill_null(False).to_numpy()
            col = table.column("set").combine_chunks()
            at, words = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
            gone, same = np.zeros(len(n), bool), comparer(words, at)
            for i, j in C.run_pairs(table, "key"):
                later = after(did, th, line, i, j)
                x, y = np.where(later, i, j), np.where(later, j, i)
                ok = asks[x] & ~gone[x] & passing(n, bits, i, j) & after(did, th, line, x, y)
                x, y = x[ok], y[ok]
                if x.size:
                    gone[x[same(x, y)]] = True
            r = np.nonzero(gone)[0]
            yield pa.record_batch([pa.array(did[r]), pa.array(th[r]), pa.array(line[r])], names=["did", "th", "line"])

    gone = copies.union(met_first)
    if not rest.isEmpty():
        again = C.stage(sets_of(rest.select("lid")), "line-sets")
        more = C.bucket_blocks(rest, "key", "lid", "line-verify", payload=again).mapInArrow(verify, "did long, th long, line int")
        gone = gone.union(C.stage(more, "line-again"))
    return gone.distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` (all its columns) with the lines that go taken out of its text, and ``__wl_lines``, ``__wl_gone``: their numbers."""
    cols = df.columns
    tagged = df.withColumn("__wl_did", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn("__wl_th", F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)))
    docs = tagged.select(F.col("__wl_did").alias("did"), F.col("__wl_th").alias("th"), F.col(text_col).cast("string").alias("text"))
    gone = similar_lines(docs, **options).groupBy("did", "th").agg(F.collect_set("line").alias("__wl_gone"))
    gone = C.stage(gone.withColumnRenamed("did", "__wl_did").withColumnRenamed("th", "__wl_th"), "lines-gone")
    C.release(df.sparkSession)
    out = tagged.join(gone, ["__wl_did", "__wl_th"], "left")
    text = F.col(text_col).cast("string")
    lines = f"split(CAST(`{text_col}` AS STRING), '\\n', -1)"
    rest = F.expr(f"transform(array({lines}), l -> array_join(transform(array_except(sequence(0, size(l) - 1), __wl_gone), i -> l[i]), '\\n'))[0]")
    out = out.withColumn("__wl_lines", F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("__wl_gone").isNull(), text).otherwise(rest))
    return out.select(*cols, "__wl_lines", F.greatest(F.size("__wl_gone"), F.lit(0)).cast("long").alias("__wl_gone"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=1)
    return out.select("doc_id", F.col("__wl_lines").alias("n_lines"), F.col("__wl_gone").alias("n_removed"), "text")
