"""Byte-level BPE of ranks over overlapping chunks of a text, and decoding.

A text longer than CHUNK code points is cut into chunks of CHUNK that reach OVERLAP into the next one; chunks are rows of a staged
table, so one very long text is many tasks.  Each chunk is pre-tokenised alone, as if it began a text.  Where a pre-token of the
chunk before and one of the chunk itself start at the same place, both scans stand in the same state and go on alike: that place
is the seam.  The piece of a chunk is what lies between its seam and that of the next chunk; its pre-tokens are merged by rank.  A
text with an overlap in which no starts meet (a blob that is one pre-token for OVERLAP code points or more) is cut by one scan over
its chunks in order, so the result never depends on CHUNK or OVERLAP.  Decoding joins the bytes of the tokens.

Memory: about 60 bytes for each byte of a chunk; a text that is one row comes back as one row of tokens.

Edge cases: a null text is encoded as the empty one (no tokens); special tokens' strings are plain text; repeated rows and null ids
are rows like any other; an empty table gives an empty result; other columns are kept, of any name (``ids`` replaces one of that name).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

#: Code points of a chunk, and of its reach into the next one.
CHUNK = 16_384
OVERLAP = 512
#: Starts so near the end of a chunk may depend on what follows it (contractions).
TAIL = 3
#: Bytes of text that are merged together.
TOGETHER = 1 << 21
OWN = "__wl_"


def _ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def starts_of(text: str) -> np.ndarray:
    """Code points at which the pre-tokens of a text start."""
    return np.nonzero(P.piece_starts(P.code_points(text), np.zeros(1, np.int64)))[0]


def starts_in_order(chunks: list[str]) -> np.ndarray:
    """The same for a text in chunks without overlap, by one scan that goes on from the last start that is sure."""
    out, at, rest, seen = [], 0, "", 0
    for k, chunk in enumerate(chunks):
        rest, last = rest + chunk, k + 1 == len(chunks)
        if not last and len(rest) < 2 * seen:
            continue  # within a very long pre-token the scan starts anew only when twice as much is there
        got = starts_of(rest)
        if last:
            out.append(got + at)
            break
        got = got[got < len(rest) - TAIL]
        keep = int(got[-1]) if len(got) else 0
        out.append(got[got < keep] + at)
        rest, at, seen = rest[keep:], at + keep, len(rest) - keep
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _encoded(bpe: P.RankedMerges, texts: list[str], starts: list[np.ndarray] | None = None, take: list[tuple[int, int]] | None = None) -> list[bytes]:
    """Tokens (little-endian 32-bit) of each text; with ``starts``, of its pre-tokens there; ``take``: only of those in [from, to)."""
    out: list[bytes] = []
    for low, high in C.groups_of_bytes(texts, TOGETHER):
        some = texts[low:high]
        size = np.fromiter(map(len, some), np.int64, len(some))
        begins = np.cumsum(size) - size
        joined = "".join(some)
        cps = P.code_points(joined)
        if starts is None:
            at = np.nonzero(P.piece_starts(cps, begins))[0]
            own = np.diff(np.searchsorted(at, np.append(begins, len(cps))))
        else:
            own = np.fromiter(map(len, starts[low:high]), np.int64, len(some))
            at = np.concatenate([s + b for s, b in zip(starts[low:high], begins, strict=True)]) if len(some) else np.zeros(0, np.int64)
        places = P.byte_places(cps)
        ends = np.append(at[1:], len(cps))
        if take is not None:  # the last pre-token of a piece ends at its seam
            low_to = np.array(take[low:high], np.int64).reshape(-1, 2) + begins[:, None]
            of = np.repeat(np.arange(len(some)), own)
            keep = (at >= low_to[of, 0]) & (at < low_to[of, 1])
            ends = np.minimum(ends, low_to[of, 1])
            at, ends, own = at[keep], ends[keep], np.bincount(of[keep], minlength=len(some))
        flat, counts = bpe.encode_all(C.padded(joined.encode()), places[at], places[ends])
        cut = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(own)])]
        flat = flat.astype("<i4")
        out += [flat[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    return out


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _cut_chunks(rows: DataFrame, text: str, held: list[str], chunk: int, overlap: int) -> DataFrame:
    """(key, no, n, text, row): the chunks of each text, with the other columns beside the first."""
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, LongType, StringType, StructType

    src = rows.select(F.monotonically_increasing_id().alias("key"), F.struct(*held).alias("row"), F.col(text).alias("text"))
    kind = src.schema["row"].dataType
    schema = StructType().add("key", LongType()).add("no", IntegerType()).add("n", IntegerType()).add("text", StringType()).add("row", kind)

    def op(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                t = one.column("text")[0].as_py()
                n = -(-len(t) // chunk)
                for at in range(0, n, 64):  # so many chunks are one Arrow batch at most
                    some = range(at, min(n, at + 64))
                    row = one.column("row") if at == 0 else pa.nulls(1, one.column("row").type)
                    row = pa.concat_arrays([row, pa.nulls(len(some) - 1, row.type)])
                    texts = pa.array([t[k * chunk : (k + 1) * chunk + overlap] for k in some], pa.string())
                    key = pa.array(np.repeat(one.column("key").to_numpy(), len(some)))
                    yield pa.record_batch([key, pa.array(some, pa.int32()), pa.array([n] * len(some), pa.int32()), texts, row], names=schema.names)

    return src.mapInArrow(op, schema)


def _pretokenised(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks with ``starts`` (places in the whole text), and those of them in the overlap before (``head``) and behind (``tail``)."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructType

    many = ArrayType(LongType())
    schema = StructType([*chunks.schema.fields]).add("starts", many).add("head", many).add("tail", many)

    def lists(parts):
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    def op(batches):
        for batch in batches:
            for part in C.sliced([batch], 64):
                starts, head, tail = [], [], []
                for t, k, n in zip(part.column("text").to_pylist(), part.column("no").to_pylist(), part.column("n").to_pylist(), strict=True):
                    got = starts_of(t)
                    if len(t) == chunk + overlap:  # the text goes on
                        got = got[got < len(t) - TAIL]
                    starts.append(got + k * chunk)
                    head.append(starts[-1][got < overlap] if k else got[:0])
                    tail.append(starts[-1][got >= chunk] if k + 1 < n else got[:0])
                yield pa.record_batch([*part.columns, lists(starts), lists(head), lists(tail)], names=schema.names)

    return chunks.mapInArrow(op, schema)


def seams(chunks: DataFrame) -> DataFrame:
    """(key, no, seam): the first place where pre-tokens of a chunk and of the one before start together; null if there is none.

    Joined by text and number, so the chunks of one long text are spread over tasks.
    """
    before = chunks.where("no + 1 < n").select("key", (F.col("no") + 1).alias("no"), "tail")
    return before.join(chunks.where("no > 0").select("key", "no", "head"), ["key", "no"]).select("key", "no", F.array_min(F.array_intersect("head", "tail")).alias("seam"))


def _encode_chunks(chunks: DataFrame, path: str, chunk: int) -> DataFrame:
    """(key, no, row, ids) of the staged, pre-tokenised chunks, each between its seam and the next."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructType

    found = C.stage(seams(chunks), "bpe-seams")
    broken = found.where("seam IS NULL").select("key").distinct()
    begin = found.select("key", "no", F.col("seam").alias("begin"))
    end = found.select("key", (F.col("no") - 1).alias("no"), F.col("seam").alias("end"))
    whole = chunks.join(broken, "key", "left_anti").join(begin, ["key", "no"], "left").join(end, ["key", "no"], "left")
    whole = whole.select("key", "no", "row", "text", "starts", F.coalesce("begin", F.lit(0)).alias("begin"), "end")
    schema = StructType([chunks.schema["key"], chunks.schema["no"], chunks.schema["row"]]).add("ids", BinaryType())

    def op(batches):
        bpe = P.from_ranks(path)
        for part in C.sliced(batches, 64):
            texts, base = part.column("text").to_pylist(), [k * chunk for k in part.column("no").to_pylist()]
            starts = [v.values.to_numpy() - b for v, b in zip(part.column("starts"), base, strict=True)]
            ends = [len(t) if e is None else e - b for t, e, b in zip(texts, part.column("end").to_pylist(), base, strict=True)]
            take = [(a - b, e) for a, b, e in zip(part.column("begin").to_pylist(), base, ends, strict=True)]
            yield pa.record_batch([*[part.column(c) for c in schema.names[:3]], pa.array(_encoded(bpe, texts, starts, take), pa.binary())], names=schema.names)

    def by_scan(batches):
        bpe = P.from_ranks(path)
        for table in C.whole_runs(batches, ("key",)):
            key = table.column("key").to_numpy()
            edges = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                one = table.slice(a, b - a).combine_chunks()
                chunked = [t[:chunk] for t in one.column("text").to_pylist()]
                text = "".join(chunked)
                ids = _encoded(bpe, [text], [starts_in_order(chunked)])
                head = one.slice(0, 1).to_batches()[0]
                yield pa.record_batch([*[head.column(c) for c in schema.names[:3]], pa.array(ids, pa.binary())], names=schema.names)

    one_scan = chunks.join(broken, "key", "left_semi").select("key", "no", "row", "text").repartition("key").sortWithinPartitions("key", "no")
    return whole.mapInArrow(op, schema).unionByName(one_scan.mapInArrow(by_scan, schema))


def _joined(parts: DataFrame) -> DataFrame:
    """The tokens of each text from those of its chunks, in order."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([parts.schema["row"]]).add("ids", BinaryType())

    def op(batches):
        for table in C.whole_runs(batches, ("key",)):
            key = table.column("key").to_numpy()
            edges = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            ids = table.column("ids")
            for a, b in zip(edges, edges[1:], strict=False):
                head = table.slice(a, 1).to_batches()[0].column("row")
                yield pa.record_batch([head, pa.array([b"".join(ids.slice(a, b - a).to_pylist())], pa.binary())], names=schema.names)

    return parts.repartition("key").sortWithinPartitions("key", "no").mapInArrow(op, schema)


def encode_bytes(df: DataFrame, text_col: str = "text", path: str | None = None, drop: tuple = (), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with ``ids``: the tokens of the whole text as little-endian unsigned 32-bit integers (binary)."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructType

    path = path or _ranks_path()
    held = [c for c in df.columns if c != "ids" and c not in drop]
    text = OWN + "text"
    rows = df.select(*held, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    schema = StructType([df.schema[c] for c in held]).add("ids", BinaryType())

    def op(batches):
        bpe = P.from_ranks(path)
        for part in C.sliced(batches, 512):
            yield pa.record_batch([*part.columns[:-1], pa.array(_encoded(bpe, _texts(part.column(part.num_columns - 1))), pa.binary())], names=schema.names)

    long = F.char_length(text) > chunk
    short = rows.where(~long).mapInArrow(op, schema)
    chunks = C.stage(_cut_chunks(rows.where(long), text, held, chunk, overlap), "bpe-chunks")
    if chunks.isEmpty():
        return short
    cut = C.stage(_pretokenised(chunks.repartition("key", "no"), chunk, overlap), "bpe-pretokens")
    made = _joined(_encode_chunks(cut, path, chunk))
    return short.unionByName(made.select(*[F.col("row").getField(c).alias(c) for c in held], "ids"))


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with ``ids`` (array of int)."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    made = encode_bytes(df, text_col, path, chunk=chunk, overlap=overlap)
    schema = StructType([f for f in made.schema.fields if f.name != "ids"]).add("ids", ArrayType(IntegerType()))

    def op(batches):
        for part in C.sliced(batches, 512):
            raw = part.column(part.num_columns - 1).to_pylist()
            ends = pa.array((np.cumsum([0, *map(len, raw)]) // 4).astype(np.int32))
            yield pa.record_batch([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), "<i4")))], names=schema.names)

    return made.mapInArrow(op, schema)


def decode_bytes(df: DataFrame, path: str | None = None, drop: tuple = ()) -> DataFrame:
    """``df`` with ``decoded``: the bytes of the tokens in ``ids`` (array of int or little-endian 32-bit binary), null for null."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructType

    path = path or _ranks_path()
    held = [c for c in df.columns if c != "decoded" and c not in drop]
    schema = StructType([df.schema[c] for c in held]).add("decoded", BinaryType())

    def op(batches):
        bytes_of = P.from_ranks(path).bytes_of.__getitem__
        for part in C.sliced(batches, 512):
            out = []
            for v in part.column(part.num_columns - 1):
                ids = None if not v.is_valid else np.frombuffer(v.as_buffer(), "<i4") if hasattr(v, "as_buffer") else v.values.to_numpy()
                out.append(None if ids is None else b"".join(map(bytes_of, ids.tolist())))
            yield pa.record_batch([*part.columns[:-1], pa.array(out, pa.binary())], names=schema.names)

    return df.select(*held, F.col("ids").alias(OWN + "ids")).mapInArrow(op, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = decode_bytes(encode_bytes(docs, drop=("text",)))
    return made.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
