"""Token ids as sorted-string-table shards, and their readers.

A shard is one file: blocks of prefix-compressed entries in ascending key order, a sparse index with one entry for each block, a
Bloom filter over the keys, and a fixed-size footer.  A lookup asks the filter, bisects the index and reads one block.

    block   zstandard frame of entries: shared (varint), suffix length (varint), value length (varint), suffix, value
    index   for each block: first key (17 bytes), offset, length, ids before it in the shard (3 x u64)
    filter  bit array; bits of a key come from two halves of its XXH64
    footer  index offset, index entries, filter offset, filter bytes, filter probes, documents, ids, bytes per id (8 x u64),
            CRC-32 of index, filter and these fields (u32), magic (8 bytes)

A key is a tag (0: null id, 1: id), the id as big-endian with its sign bit turned, and a running number that tells copies of one
id apart.  Ids are 16 bits wide if the vocabulary allows, else 32.

Edge cases: a null text is encoded as the empty one; null ids sort first; rows with one id follow each other and keep their
number; an id (or the lack of one) that holds a large share of the rows is spread over the shards whose bounds it fills, be the rows
alike or not; an empty table makes no shard.

Writers give each file a unique name and report it only when it is complete, so a task that is run again or twice leaves at most
a file that no manifest names.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"WLSST\x00\x00\x01"
_FOOTER = struct.Struct("<8QI8s")
_INDEX = struct.Struct("<17sQQQ")
_KEY = struct.Struct(">BQQ")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_PROBES = 10, 7
END_ID = 1
#: Rows of a shard, about; the number of shards is bounded so that the manifest stays small.
SHARD_ROWS = 20_000
MOST_SHARDS = 20_000
#: Pieces of text whose ids a Python worker keeps in each of two generations, and rows that it has as Python objects at a time.
CACHE = 200_000
#: Letters of the longest piece that is kept, so that kept pieces are bounded in bytes too.
KEPT_LENGTH = 64
SLICE = 256

MANIFEST = "path string, shard int, docs long, ids long"


# -- tokens ----------------------------------------------------------------------------------------------------------


class WordEncoder:
    """The library's ids of whole texts.

    The tokenizer lower-cases, drops white space and never joins over it, so a text is the sum of its pieces between white space;
    the ids of a piece come from the library's model once and are kept.  Texts with added tokens, or with letters whose case
    or normal form needs more than a look at one letter, go through the library whole.
    """

    # Fixed value: the pattern by which this vocabulary's tokenizer cuts a normalised text.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
    PLAIN = r"[\x00-\x1b\x20-\u012f\u0131-\u02ff\u0400-\u0481\u2010-\u2027\u20ac]*"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        from .bpe import byte_letters

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.cut, self.plain = regex.compile(self.CUT).findall, re.compile(self.PLAIN).fullmatch
        self.by_piece = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.loads(self.lib.to_str()).get("pre_tokenizer", {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.model = self.lib.model
        self.pieces: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        if piece.isalpha():
            words = (piece,)
        elif piece[:-1].isalpha() and not piece[-1].isalnum():  # a word and one mark: what the pattern makes of it
            words = (piece[:-1], piece[-1])
        else:
            words = self.cut(piece)
        for w in words:
            text = w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode()))
            ids += [t.id for t in self.model.tokenize(text)]
        return self._pack(ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if not (self.by_piece and self.plain(t)) or any(a in t for a in self.added):
                rest.append(i)
                continue
            pieces = t.lower().split()
            known = self.pieces
            new = set(pieces).difference(known)
            if new:
                if len(known) + len(new) > CACHE:  # the younger generation becomes the elder; pieces met again come back
                    self.elder, known = known, {}
                    self.pieces, new = known, set(pieces)
                elder = self.elder
                for p in new:
                    ids = elder.get(p)
                    known[p] = self._piece(p) if ids is None else ids
            out[i] = b"".join(map(known.__getitem__, pieces))
            for p in new:
                if len(p) > KEPT_LENGTH:
                    del known[p]
        for at in range(0, len(rest), 64):
            part = rest[at : at + 64]
            for i, e in zip(part, self.lib.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = self._pack(e.ids)
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWEST = -(1 << 63)


def shard_bounds(ids: DataFrame) -> np.ndarray:
    """Ids at which shards of the column ``key`` end, from approximate quantiles: one less than shards; null counts as the least."""
    n = ids.count()
    shards = max(1, min(MOST_SHARDS, n // SHARD_ROWS))
    steps = [k / shards for k in range(1, shards)]
    key = F.coalesce(F.col("key"), F.lit(_LOWEST))
    bounds = ids.agg(F.percentile_approx(key, steps, max(10_000, 4 * shards)).alias("b")).first().b if steps else None
    return np.array(bounds or [], np.int64)


def place(keys, ids: list[bytes], bounds: np.ndarray, at: int) -> np.ndarray:
    """Shard of each row, found by bisection.  A key that fills several bounds is dealt over their shards by its ids and its place in
    the task (``at``: that of the first row), null before any id."""
    none = keys.is_null().to_numpy(zero_copy_only=False)
    k = keys.fill_null(_LOWEST).to_numpy()
    low, high = np.searchsorted(bounds, k, "left"), np.searchsorted(bounds, k, "right")
    low = np.where((k == _LOWEST) & ~none, high, low)
    salt = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids)) + at + np.arange(len(ids))
    return (low + salt % (high - low + 1)).astype(np.int32)


def token_bytes(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, bounds: np.ndarray | None = None) -> DataFrame:
    """(key: long, ids: binary, little-endian, shard: int), the end id last."""
    import pyarrow as pa

    C.text_batches(df.sparkSession)
    bounds = np.zeros(0, np.int64) if bounds is None else bounds  # MOST_SHARDS at most

    def run(batches):
        enc = word_encoder(path)
        end, seen = b"" if end_id is None else enc._pack([end_id]), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [x + end for x in enc([t or "" for t in part.column(1).to_pylist()])]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(place(part.column(0), ids, bounds, seen))], names=["key", "ids", "shard"])
                seen += part.num_rows

    src = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "key long, ids binary, shard int")


# -- files -----------------------------------------------------------------------------------------------------------


def _fs(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def make_key(doc_id: int | None, copy: int = 0) -> bytes:
    return _KEY.pack(0, 0, copy) if doc_id is None else _KEY.pack(1, doc_id + (1 << 63), copy)


def key_id(key: bytes) -> int | None:
    tag, number, _ = _KEY.unpack(key)
    return number - (1 << 63) if tag else None


def _bloom_bits(key: bytes, bits: int, probes: int):
    import xxhash

    h = xxhash.xxh64_intdigest(key[:9], 7)  # copies of an id share their bits
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(probes)]


class ShardWriter:
    """Streams entries in key order to one file; holds one block, the index and the ids' hashes."""

    def __init__(self, path: str, width: int):
        import zstandard

        fs, local = _fs(path)
        fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
        self.out, self.width, self.zip = fs.open_output_stream(local), width, zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.ids = self.before = 0
        self.block, self.first, self.prev, self.index, self.keys = bytearray(), b"", b"", [], []

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.first, self.prev, self.before = key, b"", self.ids
        shared = 0
        while shared < len(self.prev) and self.prev[shared] == key[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.prev = key
        if not self.keys or self.keys[-1][:9] != key[:9]:
            self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(_INDEX.pack(self.first, self.at, len(data), self.before))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_bits(k, bits, BLOOM_PROBES)] = 1
        filt = np.packbits(bloom, bitorder="little").tobytes()
        fields = (self.at, len(self.index), self.at + len(index), len(filt), BLOOM_PROBES, self.docs, self.ids, self.width)
        crc = zlib.crc32(struct.pack("<8Q", *fields), zlib.crc32(filt, zlib.crc32(index)))
        foot = _FOOTER.pack(*fields, crc, MAGIC)
        self.out.write(index + filt + foot)
        self.out.close()


class ShardReader:
    def __init__(self, path: str):
        fs, local = _fs(path)
        self.file = fs.open_input_file(local)
        size = self.file.size()
        foot = self.file.read_at(_FOOTER.size, max(0, size - _FOOTER.size))
        if len(foot) < _FOOTER.size or foot[-8:] != MAGIC:
            raise ValueError(f"{path} is no shard")
        at, n, _, filter_n, self.probes, self.docs, self.ids, self.width, crc, _ = _FOOTER.unpack(foot)
        whole = at + n * _INDEX.size + filter_n + _FOOTER.size == size
        tail = self.file.read_at(n * _INDEX.size + filter_n, at) if whole else b""
        if not whole or zlib.crc32(foot[:64], zlib.crc32(tail)) != crc:
            raise ValueError(f"{path} is damaged")
        self.index = list(_INDEX.iter_unpack(tail[: n * _INDEX.size]))
        self.firsts = [x[0] for x in self.index]
        self.filter = tail[n * _INDEX.size :]

    def _block(self, k: int):
        """(key, ids before it in the shard, value) of each entry."""
        import zstandard

        _, at, n, before = self.index[k]
        buf = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, at))
        pos, prev = 0, b""
        while pos < len(buf):
            shared, pos = _read_varint(buf, pos)
            own, pos = _read_varint(buf, pos)
            size, pos = _read_varint(buf, pos)
            prev = prev[:shared] + buf[pos : pos + own]
            yield prev, before, buf[pos + own : pos + own + size]
            before += size // self.width
            pos += own + size

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with this id, found by filter, bisection and one or, for copies, more blocks."""
        low, high = make_key(doc_id), make_key(doc_id, (1 << 64) - 1)
        if not self._may_hold(low):
            return []
        found = []
        k = max(0, bisect.bisect_right(self.firsts, low) - 1)
        while k < len(self.index) and self.firsts[k] <= high:
            found += [np.frombuffer(v, f"<u{self.width}") for key, _, v in self._block(k) if low <= key <= high]
            k += 1
        return found

    def _may_hold(self, key: bytes) -> bool:
        return all(self.filter[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, len(self.filter) * 8, self.probes))


def write_shards(tokens: DataFrame, shards: int, folder: str, width: int) -> DataFrame:
    """Write (key, ids, shard) into shards in ascending key order; gives the staged manifest."""
    import pyarrow as pa

    dealt = tokens.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("key"), F.xxhash64("ids"))

    def write(batches):
        state: dict = {"shard": None, "writer": None, "path": None, "prev": None, "copy": 0}

        def done():
            w = state["writer"]
            if w is None:
                return
            w.close()
            yield pa.record_batch([pa.array([state["path"]]), pa.array([state["shard"]], pa.int32()), pa.array([w.docs]), pa.array([w.ids])], names=["path", "shard", "docs", "ids"])

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for key, value, shard in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                if shard != state["shard"]:
                    yield from done()
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    state = {"shard": shard, "writer": ShardWriter(path, width), "path": path, "prev": b"", "copy": 0}
                state["copy"] = state["copy"] + 1 if state["prev"] == key else 0
                state["prev"] = key
                state["writer"].add(make_key(key, state["copy"]), value)
        yield from done()

    return C.stage(dealt.mapInArrow(write, MANIFEST), "sst-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, value: binary, width) of every entry; ``start`` counts the ids of all entries before it.

    The manifest has one row for each shard (MOST_SHARDS at most); shards are read by as many tasks.
    """
    import pyarrow as pa

    starts, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        starts.append((r.path, at, r.shard))
        at += r.ids

    def scan(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, held, size = ShardReader(path), [], 0
                for key, before, value in reader:
                    held.append((key_id(key), base + before, value, reader.width))
                    size += len(value)
                    if size >= 1 << 20:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    def _rows(held):
        a, b, c, d = zip(*held, strict=True)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.int32())], names=["doc_id", "start", "value", "width"])

    files = spark.createDataFrame(starts, "path string, base long, shard int").repartitionById(max(1, len(starts)), F.col("shard"))
    return files.select("path", "base").mapInArrow(scan, "doc_id long, start long, value binary, width int")


def save(df: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them as shards under ``folder``; gives the manifest."""
    path = path or _tokenizer_path("word_bpe_49k.json")
    width = word_encoder(path).width
    bounds = shard_bounds(df.select(F.col(id_col).cast("long").alias("key")))  # from ids alone: texts are encoded once
    return write_shards(token_bytes(df, path, id_col, text_col, bounds=bounds), len(bounds) + 1, folder, width)


def entry_digests(entries: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            n, crc = [], []
            for value, width in zip(batch.column("value").to_pylist(), batch.column("width").to_pylist(), strict=True):
                ids = np.frombuffer(value, f"<u{width}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return entries.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = save(docs, f"{C.shared_dir(spark)}/sst-{uuid.uuid4().hex}")
    return entry_digests(read_shards(spark, manifest))
