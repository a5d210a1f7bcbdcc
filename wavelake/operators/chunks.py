"""Recordings of any length in chunks: recursive filters, quadrature and resampling over many tasks.

A channel's samples are numbered in order and stand in chunks of a fixed number.

* A recursive filter takes the state before a chunk to the state behind it by an affine map: a matrix that depends on the length alone,
  plus the chunk's own response from rest.  All chunks give their response at once; the states before each chunk follow from one short
  row a chunk, in order; then all chunks run from their states.  Once forward, once backward; the odd extension is a chunk at each end.
* Kernels of finite length see the samples of the chunks beside theirs (a halo), which travel with one shuffle.
* The quadrature kernel has no end; chunks further away come in as a few weights each, between which it is interpolated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from ..functions import kernels as K
from ..sources.scratch import staged
from .resampling import _joined, numbered

#: Samples of a chunk.
CHUNK = 65_536
#: Weights that stand for half of a chunk's samples far away (error about 1e-11), and the fewest chunks of a ring.
NODES, RING = 16, 8


def chunked(samples: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """(keys, n, chunk, idx, x): samples in order of sample_idx, their number in the key, and chunks of ``size`` of them (staged)."""
    rows = numbered(samples.select(*keys, "sample_idx", F.col("value").cast("double").alias("value")), keys, ["sample_idx"], "chunk-rows", "n")
    s = F.array_sort(F.collect_list(F.struct("pos", F.col("sample_idx").cast("long").alias("sample_idx"), F.coalesce("value", F.lit(float("nan"))).alias("value"))))
    got = rows.groupBy(*keys, "n", F.expr(f"pos div {size}").alias("chunk")).agg(s.alias("s"))
    return staged(got.select(*keys, "n", "chunk", F.col("s.sample_idx").alias("idx"), F.col("s.value").alias("x")), "chunks")


def samples_of(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample_idx, value) of chunks."""
    z = chunks.select(*keys, F.explode(F.arrays_zip("idx", "x")).alias("z"))
    return z.select(*keys, F.col("z.idx").alias("sample_idx"), F.col("z.x").alias("value"))


def _extended(chunks: DataFrame, keys: list[str], pad: int, size: int) -> DataFrame:
    """Chunks with the odd extension as one more at each end (``idx`` null)."""
    none = F.lit(None).cast("array<long>")
    head = chunks.where("chunk = 0").select(*keys, "n", F.lit(-1).cast("long").alias("chunk"), none.alias("idx"), F.expr(f"transform(reverse(slice(x, 2, {pad})), v -> 2 * x[0] - v)").alias("x"))
    last = chunks.where(f"chunk >= (n - 1) div {size} - 1")
    tails = last.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("chunk", F.expr(f"slice(x, greatest(size(x) - {pad}, 1), {pad + 1})").alias("x")))).alias("s"))
    tails = tails.withColumn("t", F.flatten("s.x")).withColumn("t", F.expr(f"slice(t, -{pad + 1}, {pad + 1})"))
    tail = tails.select(*keys, "n", F.expr(f"(n - 1) div {size} + 1").alias("chunk"), none.alias("idx"), F.expr(f"transform(reverse(slice(t, 1, {pad})), v -> 2 * t[{pad}] - v)").alias("x"))
    return chunks.select(*keys, "n", "chunk", "idx", "x").unionByName(head).unionByName(tail)


def _lists(values):
    import pyarrow as pa

    return pa.array(values, pa.list_(pa.float64()))


def _mapped(df: DataFrame, made: list[str], numbers: list[str], keep: list[str], f) -> DataFrame:
    """``keep`` and, for each row, arrays ``made`` and doubles ``numbers`` from ``f(row as numpy arrays)``."""
    import pyarrow as pa

    schema = StructType([df.schema[c] for c in keep])
    for c in made:
        schema = schema.add(c, ArrayType(DoubleType()))
    for c in numbers:
        schema = schema.add(c, DoubleType())
    others = [c for c in df.columns if c not in keep or c == "x"]

    def op(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8):  # a row may be a whole chunk
                part = batch.slice(at, 8)
                rows = [f({c: np.asarray(part.column(c)[i].values, float) if part.column(c)[i].is_valid and hasattr(part.column(c)[i], "values") else part.column(c)[i].as_py() for c in others}) for i in range(part.num_rows)]
                got = list(zip(*rows, strict=True))
                cols = [part.column(c) for c in keep] + [_lists(v) for v in got[: len(made)]] + [pa.array(v, pa.float64()) for v in got[len(made) :]]
                yield pa.record_batch(cols, names=schema.names)

    return df.mapInArrow(op, schema)


def _states(ends: DataFrame, keys: list[str], sos: np.ndarray, back: bool) -> DataFrame:
    """(keys, chunk, state): the states before each chunk, from one row (chunk, size, rest, edge) for each; ``back``: from the last on."""
    import pyarrow as pa

    schema = StructType([ends.schema[c] for c in keys]).add("chunk", LongType()).add("state", ArrayType(DoubleType()))

    def run(table):
        table = table.sort_by([("chunk", "descending" if back else "ascending")])
        state, out = K.steady_states(sos, table.column("edge")[0].as_py()), []
        for n, rest in zip(table.column("size").to_pylist(), table.column("rest"), strict=True):
            out.append(state)
            state = K.transition(sos, n) @ state + np.asarray(rest.values)
        return pa.table([*[table.column(c) for c in keys], table.column("chunk"), _lists(out)], names=schema.names)

    return ends.groupBy(*keys).applyInArrow(run, schema)


def zero_phase(chunks: DataFrame, keys: list[str], sos: np.ndarray, size: int = CHUNK) -> DataFrame:
    """Chunks filtered forward and backward (staged); channels must have more than ``kernels.extension(sos)`` samples, chunks too."""
    pad, zero = K.extension(sos), np.zeros(2 * len(sos))
    by = [*keys, "chunk"]
    ext = staged(_extended(chunks, keys, pad, size), "filter-chunks")
    kept = [*keys, "n", "chunk", "idx"]
    first = _mapped(ext.select(*by, "x"), ["rest"], ["edge"], by, lambda r: (K.run_sections(sos, r["x"], zero)[1], r["x"][0]))
    ends = _joined(first, ext.select(*by, F.size("x").alias("size")), by)

    def forward(r):
        y = K.run_sections(sos, r["x"], r["state"])[0]
        return y, K.run_sections(sos, y[::-1], zero)[1], y[-1]

    y = staged(_mapped(_joined(ext, _states(ends, keys, sos, False), by), ["y", "rest"], ["edge"], kept, forward), "filter-forward")
    back = _states(y.select(*by, F.size("y").alias("size"), "rest", "edge"), keys, sos, True)
    done = _joined(y.where("idx IS NOT NULL").select(*kept, "y"), back, by)
    return staged(_mapped(done, ["x"], [], kept, lambda r: (K.run_sections(sos, r["y"][::-1], r["state"])[0][::-1],)), "filtered")


def with_halo(chunks: DataFrame, keys: list[str], halo: int, size: int, ring: bool = False) -> DataFrame:
    """(keys, n, chunk, idx, first, x): x is the chunk with up to ``halo`` samples before and behind, and begins at place ``first``.

    ``ring``: the samples before the first are the last ones, and the other way round.
    """
    import pyarrow as pa

    kinds = [chunks.schema[c] for c in keys]
    sent = StructType([*kinds, chunks.schema["n"], chunks.schema["chunk"]]).add("at", LongType()).add("idx", ArrayType(LongType())).add("x", ArrayType(DoubleType()))

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, c = row.column("n")[0].as_py(), row.column("chunk")[0].as_py()
                x, begin, last = row.column("x")[0].values.to_numpy(), c * size, (n - 1) // size
                out = [(c, begin, x, True)]
                # a chunk of which part lies within the halo of target t, moved by a whole turn in a ring
                for turn in (-1, 0, 1) if ring else (0,):
                    at = begin + turn * n
                    near = range(max(0, (at - halo) // size - 1), min(last, (at + len(x) + halo) // size) + 1)
                    for t in near:
                        if t == c and not turn:
                            continue
                        low, high = t * size, min((t + 1) * size, n)
                        for a, b in ((low - halo, low), (high, high + halo)):
                            s, e = max(a, at), min(b, at + len(x))
                            if s < e:
                                out.append((t, s, x[s - at : e - at], False))
                rows = len(out)
                cols = [pa.concat_arrays([row.column(k)] * rows) for k in [*keys, "n"]]
                idx = [row.column("idx")[0].as_py() if own else None for *_, own in out]
                yield pa.record_batch([*cols, pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array(idx, pa.list_(pa.int64())), _lists([o[2] for o in out])], names=sent.names)

    made = StructType([*kinds, chunks.schema["n"], chunks.schema["chunk"]]).add("idx", ArrayType(LongType())).add("first", LongType()).add("x", ArrayType(DoubleType()))

    def put_together(table):
        table = table.sort_by("at")
        at = table.column("at").to_pylist()
        parts = [v.values.to_numpy() for v in table.column("x")]
        own = [i for i, v in enumerate(table.column("idx")) if v.is_valid][0]
        one = lambda c: table.column(c).slice(own, 1)
        return pa.table([*[one(c) for c in [*keys, "n", "chunk", "idx"]], pa.array([at[0]]), _lists([np.concatenate(parts)])], names=made.names)

    return chunks.select(*keys, "n", "chunk", "idx", "x").mapInArrow(send, sent).groupBy(*keys, "chunk").applyInArrow(put_together, made)


def _place(c: int, n: int, size: int) -> tuple[int, int, float, float]:
    """Begin, end, middle and half width of a chunk."""
    low, high = c * size, min((c + 1) * size, n)
    return low, high, (low + high - 1) / 2, max((high - low - 1) / 2, 0.5)


def _moments(x: np.ndarray, c: int, n: int, size: int) -> np.ndarray:
    """Weights at the chunk's nodes that act far away as its samples do: of even places, then of odd ones."""
    low, high, mid, half = _place(c, n, size)
    at = np.arange(low, high)
    w = K.interpolation((at - mid) / half, NODES)
    return np.concatenate([w[at % 2 == b].T @ x[at % 2 == b] for b in (0, 1)])


def _quadrature(r: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk and its quadrature part: chunks less than ``size`` away sample by sample, all others by their moments."""
    n, t, first, x = r["m"], r["c"], r["first"], r["x"].copy()
    low, high, mid, half = _place(t, n, size)
    chunks = np.arange(-(-n // size))
    begin, end = chunks * size, np.minimum((chunks + 1) * size, n)
    gap = np.minimum((begin - high) % n, (low - end) % n)  # round the ring
    far = np.nonzero((gap >= size) & (chunks != t))[0]
    window = (np.arange(first, first + len(x)) % n) // size
    own = x[low - first : high - first].copy()
    x[np.isin(window, far)] = 0.0
    im = K.near_quadrature(x, low - first, high - first, n)
    if far.size:
        q = r["moments"].reshape(len(chunks), 2, NODES)[far]
        centre = np.array([_place(c, n, size)[2:] for c in far])
        source = centre[:, :1] + centre[:, 1:] * K.nodes(NODES)
        d = (mid + half * K.nodes(NODES))[:, None, None] - source[None]
        field = np.array([sum(np.einsum("isj,sj->i", K.quadrature(d, n, a != b), q[:, b]) for b in (0, 1)) for a in (0, 1)])
        at = np.arange(low, high)
        im += (K.interpolation((at - mid) / half, NODES) * field[at % 2]).sum(axis=1)
    return own, im


def analytic(chunks: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """(keys, n, chunk, idx, re, im): the analytic signal of channels of at least RING chunks, equal to that of one transform of all samples.

    The quadrature part is a sum over all samples of the ring.  Chunks near by come as a halo; one further away acts through NODES
    weights for its even and its odd places, as the kernel is smooth there.  Each chunk gets the weights of all (a short array a chunk).
    """
    own = _mapped(chunks.withColumn("c", F.col("chunk")).withColumn("m", F.col("n")).select(*keys, "chunk", "c", "m", "x"), ["moments"], [], [*keys, "chunk"], lambda r: (_moments(r["x"], r["c"], r["m"], size),))
    every = own.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "moments"))), lambda s: s["moments"])).alias("moments"))
    wide = _joined(with_halo(chunks, keys, 2 * size, size, ring=True), every, keys)
    return _mapped(wide.withColumn("c", F.col("chunk")).withColumn("m", F.col("n")), ["re", "im"], [], [*keys, "n", "chunk", "idx"], lambda r: _quadrature(r, size))


def resampled(chunks: DataFrame, keys: list[str], fs: int, target: int, size: int = CHUNK) -> DataFrame:
    """(keys, sample_idx, value) at the target rate; ``size`` must be a multiple of the reduced input step."""
    import pyarrow as pa

    up, down, h = K.ratio_kernel(target, fs)
    if size % down:
        raise ValueError(f"chunks of {size} samples do not end at steps of {down}")
    wide = with_halo(chunks, keys, len(h) // 2 // up + 2, size)
    schema = StructType([chunks.schema[c] for c in keys]).add("sample_idx", LongType()).add("value", DoubleType())

    def op(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, c, first = (row.column(k)[0].as_py() for k in ("n", "chunk", "first"))
                low, high = c * size // down * up, -(-min((c + 1) * size, n) * up // down)
                y = K.resample_part(row.column("x")[0].values.to_numpy(), first, low, high, up, down, h)
                for at in range(0, len(y), 1 << 15):
                    some = y[at : at + (1 << 15)]
                    yield pa.record_batch([*[pa.concat_arrays([row.column(k)] * len(some)) for k in keys], pa.array(np.arange(low + at, low + at + len(some))), pa.array(some)], names=schema.names)

    return wide.mapInArrow(op, schema)
