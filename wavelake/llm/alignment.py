"""Alignment of two tokenizers over a corpus: links of their tokens, counted by inverted bitmaps of each id pair.

Both tokenizers cut the same bytes (a blank and the text), so overlapping tokens are the segments between neighbouring ends of
either.  Each task numbers its documents in containers of up to SLOTS rows and inverts them: for each id pair the compressed bitmaps
of the documents that link it, plane j holding those whose number of links has bit j.  Bitmaps of the parts of a container are OR-ed
while it is filled; documents are counted as set bits of the OR of the planes, links as set bits of each plane times 2^j.  Counts
of a pair are sums over its containers.  Scores go back along the postings: each is joined with its pair's count, containers
gather theirs and add them up by slot.

Bitmaps: a byte for the kind, then gaps between slots in one or two bytes, or SLOTS bits where that is shorter.

Bounds: a container ends at SLOTS documents or MOST_LINKS distinct (pair, document)s; the best count of each B id is broadcast (one
row for each id of the vocabulary); a pair has one row for each container and plane, so a very common pair is spread.
A text is aligned as a whole, at about 100 bytes of memory for each of its bytes.

Edge cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens (zeros, empty
digest); special tokens' strings are plain text; repeated rows and null ids are rows like any other; an empty table gives an empty
result; columns of the same name as a result are replaced by it, others kept.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

#: Documents of a container (13 bits), and distinct links after which it ends.
SLOTS = 8192
SLOT_BITS = 13
MOST_LINKS = 6_000_000
#: Bytes of text that are aligned together.
TOGETHER = 1 << 21
B_BITS = 16
DIGITS = np.array([10**k for k in range(1, 10)], np.int64)


def _paths() -> tuple[str, str]:
    import public_tokenizers as T

    return T.path("byte_bpe_50k.json"), T.path("piece_bpe_32k.model")


class PieceModel:
    """Tokenizer B: sentence pieces of units, where a unit is a run of blanks with what follows up to the next blank.

    No piece reaches over the begin of a unit, so units are encoded one by one, each distinct one once.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece reaches over a blank: its texts cannot be cut into units")
        self.blank = names.index("▁")
        self.raw = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size = np.fromiter(map(len, self.raw), np.int64, len(names))

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces, the number of each unit's, and whether they give back its bytes."""
        ids = self.model.encode([u[1:].decode() for u in units], num_threads=1)  # the model puts the blank before it
        ids = [x or [self.blank] for x in ids]
        fine = np.fromiter((b"".join(map(self.raw.__getitem__, x)) == u for x, u in zip(ids, units, strict=True)), bool, len(units))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum())), counts, fine


@lru_cache(maxsize=2)
def _piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _slices(starts: np.ndarray, end: int) -> np.ndarray:
    return np.append(starts[1:], end)


class Aligned:
    """Tokens and links of some texts: arrays over all of them."""

    def __init__(self, texts: list[str], a: P.RankedMerges, b: PieceModel):
        self.texts = len(texts)
        used = [i for i, t in enumerate(texts) if t]
        while True:
            bad = self._cut([texts[i] for i in used], a, b)
            if not bad.size:
                break
            gone = set(bad.tolist())
            used = [i for k, i in enumerate(used) if k not in gone]
        self.used = np.array(used, np.int64)
        self._link(a, b)

    def _cut(self, texts: list[str], a: P.RankedMerges, b: PieceModel) -> np.ndarray:
        joined = "".join(" " + t for t in texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.cumsum(size) - size
        cps = P.code_points(joined)
        places = P.byte_places(cps)
        raw = joined.encode()
        buf, end = C.padded(raw), len(raw)
        self.begin, self.end = places[begins], end
        units = places[:-1][P.blank_starts(cps, begins)]
        unit_ends = _slices(units, end)
        if not len(units):
            self.a = self.b = np.zeros(0, np.int64)
            return np.zeros(0, np.int64)
        first, which = P.distinct(buf, units, unit_ends)
        flat, counts, fine = b.encode([raw[s:e] for s, e in zip(units[first].tolist(), unit_ends[first].tolist(), strict=True)])
        if not fine.all():
            return np.unique(np.searchsorted(self.begin, units[~fine[which]], "right") - 1)
        self.b = flat[P.spread(counts[which], (np.cumsum(counts) - counts)[which])]
        starts = places[:-1][P.piece_starts(cps, begins)]
        self.a = a.encode_all(buf, starts, _slices(starts, end))[0]
        return np.zeros(0, np.int64)

    def _link(self, a: P.RankedMerges, b: PieceModel) -> None:
        mark = np.zeros(self.end + 1, np.uint8)
        mark[np.cumsum(a.size[self.a])] |= 1
        mark[np.cumsum(b.size[self.b])] |= 2
        mark[0] = 0
        at = np.nonzero(mark)[0]
        kind = mark[at]
        self.kind = kind
        self.left = np.cumsum(kind & 1) - (kind & 1)
        self.right = np.cumsum(kind >> 1) - (kind >> 1)
        edges = np.append(self.begin, self.end)
        self.cut = np.searchsorted(at, edges, "right")  # segments end after a text's begin, at its end at last
        ends_before = lambda bit: np.concatenate([[0], np.cumsum(kind & bit > 0)])[self.cut]
        self.a_cut, self.b_cut, self.group_cut = ends_before(1), ends_before(2), np.concatenate([[0], np.cumsum(kind == 3)])[self.cut]

    def counts(self) -> dict[str, np.ndarray]:
        out = {}
        for name, cut in (("n_a", self.a_cut), ("n_b", self.b_cut), ("n_groups", self.group_cut), ("n_links", self.cut)):
            out[name] = np.zeros(self.texts, np.int64)
            out[name][self.used] = np.diff(cut)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each link: the id pair as one number, and the text."""
        text = np.repeat(self.used, np.diff(self.cut))
        return self.a[self.left] << B_BITS | self.b[self.right], text

    def group_digests(self) -> list[str]:
        """SHA-256 of the ids of each group, `a1,a2|b1;a3|b2,b3` in decimal; empty without tokens."""
        out = [""] * self.texts
        if not len(self.used):
            return out
        n_a, n_b, common = len(self.a), len(self.b), self.kind == 3
        a_end, b_end = (self.kind & 1) > 0, (self.kind & 2) > 0
        group = np.cumsum(common) - common  # of each segment
        a_group, b_group = group[a_end], group[b_end]
        b_before = np.searchsorted(b_group, a_group)  # B tokens of groups before
        a_before = np.searchsorted(a_group, b_group, "right")  # A tokens of groups up to this one
        a_at, b_at = np.arange(n_a) + b_before, np.arange(n_b) + a_before
        value, sep = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        value[a_at], value[b_at] = self.a, self.b
        sep[a_at[np.append(a_group[1:] != a_group[:-1], True)]] = ord("|")
        sep[b_at[np.append(b_group[1:] != b_group[:-1], True)]] = ord(";")
        digits = 1 + np.searchsorted(DIGITS, value, "right")
        ends = np.cumsum(digits + 1)
        text = np.empty(int(ends[-1]), np.uint8)
        text[ends - 1] = sep
        rest = value
        for k in range(int(digits.max())):
            some = np.nonzero(digits > k)[0]
            text[ends[some] - 2 - k] = 48 + rest[some] % 10
            rest = rest // 10
        raw = text.tobytes()
        cut = np.concatenate([[0], ends])[self.a_cut + self.b_cut].tolist()
        for i, s, e in zip(self.used.tolist(), cut, cut[1:], strict=False):
            out[i] = hashlib.sha256(raw[s : e - 1]).hexdigest()
        return out


# -- bitmaps -----------------------------------------------------------------------------------------------------------


def pack(slots: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of runs of ``per`` ascending slots: all bytes, and the end of each bitmap."""
    ends = np.cumsum(per)
    begins = ends - per
    gap = np.diff(slots, prepend=0) - 1
    gap[begins] = slots[begins]
    wide = 1 + (gap >= 128)
    total = np.concatenate([[0], np.cumsum(wide)])
    size = total[ends] - total[begins]
    dense = size > SLOTS // 8
    out_size = 1 + np.where(dense, SLOTS // 8, size)
    out_end = np.cumsum(out_size)
    out = np.zeros(int(out_end[-1]) if len(out_end) else 0, np.uint8)
    run = np.repeat(np.arange(len(per)), per)
    keep = ~dense[run]
    at = ((out_end - out_size + 1)[run] + total[:-1] - total[begins][run])[keep]
    g = gap[keep]
    out[at] = np.where(g >= 128, g & 127 | 128, g)
    two = g >= 128
    out[at[two] + 1] = g[two] >> 7
    for r in np.nonzero(dense)[0]:
        bits = np.zeros(SLOTS, np.uint8)
        bits[slots[begins[r] : ends[r]]] = 1
        out[out_end[r] - out_size[r]] = 1
        out[out_end[r] - SLOTS // 8 : out_end[r]] = np.packbits(bits)
    return out, out_end


def unpack(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each bitmap, one bitmap after another, and their numbers; ``ends`` begins with the start of the first."""
    begins = ends[:-1]
    dense = data[begins] == 1
    size = np.diff(ends) - 1
    counts = np.zeros(len(begins), np.int64)
    sparse = np.nonzero(~dense)[0]
    raw = data[P.spread(size[sparse], begins[sparse] + 1)].astype(np.int64)
    run = np.repeat(np.arange(len(sparse)), size[sparse])
    second = np.zeros(len(raw), bool)
    second[1:] = raw[:-1] >= 128
    lead = np.nonzero(~second)[0]
    value = raw[lead] & 127
    two = raw[lead] >= 128
    value[two] |= raw[lead[two] + 1] << 7
    run = run[lead]
    per = np.bincount(run, minlength=len(sparse))
    counts[sparse] = per
    summed = np.cumsum(value + 1)
    before = np.concatenate([[0], summed])[np.cumsum(per) - per]
    got = [(sparse, summed - 1 - before[run])]
    for r in np.nonzero(dense)[0]:
        slots = np.nonzero(np.unpackbits(data[begins[r] + 1 : ends[r + 1]]))[0]
        counts[r] = len(slots)
        got.append((np.array([r]), slots))
    base, flat = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
    for rows, slots in got:
        flat[P.spread(counts[rows], base[rows])] = slots
    return flat, counts


class Container:
    """The postings of up to SLOTS documents while they are gathered: sorted (pair, slot) keys with the number of links."""

    def __init__(self, number: int):
        self.number, self.slots, self.held, self.parts = number, 0, 0, []

    def add(self, pair: np.ndarray, slot: np.ndarray) -> None:
        key = np.sort(pair << SLOT_BITS | slot)
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        self.parts.append((key[first], np.diff(first, append=len(key))))
        self.held += len(first)

    def postings(self) -> dict[str, np.ndarray]:
        """Columns of the posting rows, one for each pair and plane; ``docs`` (set bits of the OR of the planes) is at a pair's first."""
        key = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        times = np.concatenate([n for _, n in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")  # parts are sorted runs of their own documents: this is their OR
        key, times = key[order], times[order]
        pair = key >> SLOT_BITS
        new = np.diff(pair, prepend=-1) != 0
        row_pair, docs = pair[new], np.diff(np.nonzero(new)[0], append=len(pair))
        of = np.cumsum(new) - 1
        picked, bit = [], 0
        while (some := np.nonzero(times >> bit)[0]).size:
            some = some[(times[some] >> bit & 1) == 1]
            picked.append((of[some] << 6 | bit, key[some] & (SLOTS - 1)))
            bit += 1
        rows = np.concatenate([r for r, _ in picked]) if picked else np.zeros(0, np.int64)
        slots = np.concatenate([s for _, s in picked]) if picked else np.zeros(0, np.int64)
        order = np.argsort(rows, kind="stable")
        rows, slots = rows[order], slots[order]
        begin = np.nonzero(np.diff(rows, prepend=-1))[0]
        per = np.diff(begin, append=len(rows))
        got, plane = rows[begin] >> 6, rows[begin] & 63
        data, ends = pack(slots, per)
        head = np.diff(got, prepend=-1) != 0
        return {"pair": row_pair[got], "plane": plane, "docs": np.where(head, docs[got], 0), "links": per << plane, "data": data, "ends": ends}


RESULT = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]
POSTING = [("container", "long"), ("slot", "int"), ("pair", "long"), ("plane", "int"), ("docs", "long"), ("links", "long"), ("bits", "binary")]
OWN = "__wl_"


def invert(
    df: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None, drop: tuple = (), slots: int = SLOTS, most_links: int = MOST_LINKS, together: int = TOGETHER
) -> DataFrame:
    """Rows of two kinds: documents (``__wl_pair`` null) with their counts, container and slot, and postings of id pairs.

    One pass without a shuffle; ``stage`` it, as containers are named after tasks.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.types import StructType, _parse_datatype_string

    a_path, b_path = paths or _paths()
    results = {n for n, _ in RESULT}
    held = [c for c in df.columns if c not in results and c not in drop]
    schema = StructType([*df.select(*held).schema.fields])
    for n, t in [*RESULT, *((OWN + n, t) for n, t in POSTING)]:
        schema = schema.add(n, _parse_datatype_string(t))
    for f in schema.fields:
        f.nullable = True

    def posting_batches(box, like):
        got = box.postings()
        n = len(got["pair"])
        ends = np.concatenate([[0], got["ends"]])
        for at in range(0, n, 1 << 16):
            to = min(n, at + (1 << 16))
            offsets = (ends[at : to + 1] - ends[at]).astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(got["data"][ends[at] : ends[to]].tobytes())])
            cols = [pa.nulls(to - at, t) for t in like] + [pa.nulls(to - at, pa.string() if t == "string" else pa.int64()) for _, t in RESULT]
            cols += [pa.array(np.full(to - at, box.number)), pa.nulls(to - at, pa.int32()), pa.array(got["pair"][at:to]), pa.array(got["plane"][at:to].astype(np.int32))]
            cols += [pa.array(got[c][at:to].astype(np.int64)) for c in ("docs", "links")]
            yield pa.record_batch([*cols, bits], names=schema.names)

    def op(batches):
        a, b = P.from_merges(a_path), _piece_model(b_path)
        number, like = TaskContext.get().partitionId() << 24, []
        box = Container(number)
        for part in C.sliced(batches, 512):
            texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            like = [c.type for c in part.columns[:-1]]
            for low, high in C.groups_of_bytes(texts, together):
                while low < high:
                    n = min(high - low, slots - box.slots)
                    got = Aligned(texts[low : low + n], a, b)
                    pair, text = got.pairs()
                    box.add(pair, text + box.slots)
                    counts, digests = got.counts(), got.group_digests()
                    cols = [c.slice(low, n) for c in part.columns[:-1]] + [pa.array(v) for v in counts.values()] + [pa.array(digests, pa.string())]
                    cols += [pa.array(np.full(n, box.number)), pa.array(np.arange(box.slots, box.slots + n, dtype=np.int32))]
                    cols += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                    yield pa.record_batch(cols, names=schema.names)
                    box.slots += n
                    low += n
                    if box.slots == slots or box.held >= most_links:
                        yield from posting_batches(box, like)
                        number += 1
                        box = Container(number)
        if box.slots:
            yield from posting_batches(box, like)

    return df.select(*held, F.col(text_col).cast("string").alias(OWN + "text")).mapInArrow(op, schema)


def pair_counts(inverted: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, n_links, best): one row for each id pair; ``best``: no pair with this B id has more links.

    Stages the counts: they are read for the best of each B id and for the result."""
    pair = F.col("pair")
    post = inverted.where(f"{OWN}pair IS NOT NULL").select(F.col(OWN + "pair").alias("pair"), F.col(OWN + "docs").alias("docs"), F.col(OWN + "links").alias("links"))
    counts = C.stage(post.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links")), "pair-counts")
    b = (pair.bitwiseAND((1 << B_BITS) - 1)).alias("b_id")
    most = counts.groupBy(b).agg(F.max("n_links").alias("most"))
    out = counts.select("pair", F.shiftright(pair, B_BITS).alias("a_id"), b, "n_docs", "n_links").join(F.broadcast(most), "b_id")  # one row for each id of B at most
    return out.select("pair", "a_id", "b_id", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def align(df: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None, drop: tuple = (), **sizes: int) -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum; ``sizes`` as ``invert`` takes them."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    df = df.drop("n_best", "count_sum")
    table = C.stage(invert(df, text_col, paths, drop, **sizes), "inverted")
    scores = pair_counts(table).select(F.col("pair").alias(OWN + "pair"), F.col("n_links").alias(OWN + "count"), F.col("best").alias(OWN + "best"))
    own = [OWN + c for c in ("container", "slot", "pair", "plane", "bits")]
    held = [c for c in table.columns if not c.startswith(OWN)]
    docs = table.where(f"{OWN}pair IS NULL").select(*held, *own)
    post = table.where(f"{OWN}pair IS NOT NULL").select(*own).join(scores, OWN + "pair")
    rows = docs.unionByName(post, allowMissingColumns=True)
    rows = rows.repartition(F.col(OWN + "container")).sortWithinPartitions(OWN + "container", F.col(OWN + "pair").asc_nulls_first())
    schema = StructType([*table.select(*held).schema.fields]).add("n_best", LongType()).add("count_sum", LongType())

    def told(texts, best, total):
        whole = pa.concat_tables([pa.Table.from_batches([t]) for t in texts]).combine_chunks()
        slot = whole.column(OWN + "slot").to_numpy()
        cols = [whole.column(c) for c in held]
        for batch in pa.table([*cols, pa.array(best[slot]), pa.array(total[slot])], names=schema.names).to_batches(max_chunksize=2048):
            yield batch

    def op(batches):
        now, texts, best, total = None, [], None, None
        for batch in batches:
            box = batch.column(OWN + "container").to_numpy()
            edges = [0, *(np.nonzero(box[1:] != box[:-1])[0] + 1).tolist(), len(box)]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if box[s] != now:
                    if texts:
                        yield from told(texts, best, total)
                    now, texts, best, total = box[s], [], np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
                part = batch.slice(s, e - s)
                n = part.column(OWN + "pair").null_count
                if n:
                    texts.append(part.slice(0, n))
                if n == part.num_rows:
                    continue
                part = part.slice(n)
                bits = part.column(OWN + "bits")
                raw = pa.concat_arrays([bits])  # offsets from the slice's own begin
                ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
                slots, per = unpack(np.frombuffer(raw.buffers()[2], np.uint8), ends)
                times = np.left_shift(np.int64(1), part.column(OWN + "plane").to_numpy().astype(np.int64))
                np.add.at(total, slots, np.repeat(times * part.column(OWN + "count").to_numpy(), per))
                is_best = part.column(OWN + "best").to_numpy(zero_copy_only=False)
                np.add.at(best, slots, np.repeat(times * is_best, per))
        if texts:
            yield from told(texts, best, total)

    return rows.mapInArrow(op, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = align(docs, drop=("text",))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
