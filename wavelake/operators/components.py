"""Independent components of recordings of any length by sums over blocks.

Samples of all channels stand in blocks of rows.  Means and products of channels are merged over blocks (each with its own mean, so
offsets don't cancel); eigenvectors of the small covariance give the whitening.  A round of the tanh fixed point is one pass: each task
adds up the products of its blocks under the present rotation, one small matrix for each recording and task is shuffled, and each
recording's rotation moves on in a row of its own.  The rotation starts from a kernel run over WARM samples spread over the recording,
so few passes are left; it is the fixed point over all samples that counts.  Nothing but matrices of channels squared meets in a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from ..functions import kernels as K
from ..sources.scratch import staged
from .resampling import _joined

#: Samples of a block, and samples of the run that gives the first rotation.
BLOCK, WARM = 16_384, 50_000
ROUNDS, TOL = 300, 1e-6


def _floats(values):
    import pyarrow as pa

    return pa.array([np.asarray(v, float).ravel() for v in values], pa.list_(pa.float64()))


def _key_fields(df: DataFrame, keys: list[str]) -> list:
    return [df.schema[c] for c in keys]


def blocks_of(samples: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """(keys, block, channels, idx, x): rows of samples by channels, flat (staged).  Samples that lack a channel or hold one that is
    no number are left out."""
    import pyarrow as pa

    v = F.col("value").cast("double")
    rows = samples.select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), F.col("channel_idx").cast("int").alias("channel_idx"), v.alias("value"))
    wanted = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("channel_idx")).alias("channels"))
    rows = _joined(rows.where("value IS NOT NULL AND NOT isnan(value)").withColumn("block", F.expr(f"sample_idx div {size}")), wanted, keys)
    schema = StructType([*_key_fields(samples, keys)]).add("block", LongType()).add("channels", ArrayType(IntegerType())).add("idx", ArrayType(LongType())).add("x", ArrayType(DoubleType()))

    def wide(table):
        channels = np.array(table.column("channels")[0].as_py())
        at, place = np.unique(table.column("sample_idx").to_numpy(), return_inverse=True)
        x = np.full((len(at), len(channels)), np.nan)
        x[place, np.searchsorted(channels, table.column("channel_idx").to_numpy())] = table.column("value").to_numpy()
        full = ~np.isnan(x).any(axis=1)
        one = [table.column(c).slice(0, 1) for c in [*keys, "block"]]
        return pa.table([*one, pa.array([channels], pa.list_(pa.int32())), pa.array([at[full]], pa.list_(pa.int64())), _floats([x[full]])], names=schema.names)

    return staged(rows.groupBy(*keys, "block").applyInArrow(wide, schema), "component-blocks")


def _task_sums(blocks: DataFrame, keys: list[str], columns: list[str], start, add, told) -> DataFrame:
    """One row for each key and task: ``told(held)`` arrays after ``held = add(held, row)`` for its blocks."""
    import pyarrow as pa

    schema = StructType([*_key_fields(blocks, keys)])
    for c in columns:
        schema = schema.add(c, ArrayType(DoubleType()))
    others = [c for c in blocks.columns if c not in keys]

    def op(batches):
        held: dict = {}
        first: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name = tuple(row.column(c)[0].as_py() for c in keys)
                first.setdefault(name, [pa.array([row.column(c)[0].as_py()], row.column(c).type) for c in keys])
                values = {c: np.asarray(row.column(c)[0].values) if hasattr(row.column(c)[0], "values") else row.column(c)[0].as_py() for c in others}
                held[name] = add(held.get(name, start), values)
        for name, h in held.items():
            yield pa.record_batch([*first[name], *[_floats([v]) for v in told(h)]], names=schema.names)

    return blocks.mapInArrow(op, schema)


def _per_key(rows: DataFrame, keys: list[str], columns: list[str], made) -> DataFrame:
    """One row for each key with arrays ``columns`` from ``made(list of arrays of each column)``."""
    import pyarrow as pa

    schema = StructType([*_key_fields(rows, keys)])
    for c in columns:
        schema = schema.add(c, ArrayType(DoubleType()))
    others = [c for c in rows.columns if c not in keys]

    def run(table):
        got = made({c: [np.asarray(v) for v in table.column(c).to_pylist()] for c in others})
        return pa.table([*[table.column(c).slice(0, 1) for c in keys], *[_floats([v]) for v in got]], names=schema.names)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def merged(a, b):
    """(n, mean, products about the mean) of two sets of rows as one."""
    if a is None or b is None:
        return b if a is None else a
    (na, ma, pa_), (nb, mb, pb) = a, b
    if not na or not nb:
        return a if na else b
    d, n = mb - ma, na + nb
    return n, ma + d * (nb / n), pa_ + pb + np.outer(d, d) * (na * nb / n)


def whitening(n: float, mean: np.ndarray, products: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(white, back): rows that make centred samples white, and the way back; directions without variance are left out."""
    value, vector = np.linalg.eigh(products / max(n, 1))
    order = np.argsort(-value, kind="stable")
    value, vector = value[order], vector[:, order]
    strength = np.sqrt(np.maximum(value * n, 0))
    k = min(most or len(value), int((strength > 1e-8 * max(strength[0], 1e-300)).sum()))
    root = np.sqrt(np.maximum(value[:k], 1e-300))
    return vector[:, :k].T / root[:, None], vector[:, :k].T * root[:, None]


def decompose_blocks(blocks: DataFrame, keys: list[str], n: int | None = None, rounds: int = ROUNDS, tol: float = TOL, warm: int = WARM) -> DataFrame:
    """(keys, component, sample_idx, source, loadings) of ``blocks_of``'s recordings."""
    import pyarrow as pa

    def add(held, r):
        c = len(r["channels"])
        x = r["x"].reshape(-1, c)
        mean = x.mean(axis=0) if len(x) else np.zeros(c)
        return merged(held, (float(len(x)), mean, (x - mean).T @ (x - mean)))

    parts = _task_sums(blocks.select(*keys, "channels", "x"), keys, ["n", "mean", "products"], None, add, lambda h: h)

    def basis(rows):
        held = None
        for size, mean, p in zip(rows["n"], rows["mean"], rows["products"], strict=True):
            held = merged(held, (float(size[0]), mean, p.reshape(len(mean), -1)))
        white, back = whitening(*held, n)
        return [[held[0]], held[1], white, back]

    basis_of = staged(_per_key(parts, keys, ["n", "mean", "white", "back"], basis), "component-basis")

    # the first rotation: a kernel run over rows spread evenly over each recording
    sized = _joined(blocks, basis_of.select(*keys, F.col("n")[0].alias("all")), keys)
    step = F.greatest(F.ceil(F.col("all") / F.lit(warm)), F.lit(1)).cast("int")
    some = F.expr("flatten(transform(filter(sequence(0, size(idx) - 1), i -> i % step = 0), i -> slice(x, i * size(channels) + 1, size(channels))))")
    spread = sized.where("size(idx) > 0").withColumn("step", step).select(*keys, "block", some.alias("x"))

    def first_turn(rows):
        white, mean = rows["white"][0], rows["mean"][0]
        k = len(white) // max(len(mean), 1)
        if not k:
            return [np.zeros(0), [0.0]]
        x = (np.concatenate(rows["x"]).reshape(-1, len(mean)) - mean) @ white.reshape(k, -1).T
        source, mixing = K.independent_components(x, k)
        # rows of unit length in white space, made into a rotation
        if mixing.shape != (k, k):
            return [np.eye(k), [1.0]]
        u, _, v = np.linalg.svd(mixing / np.linalg.norm(mixing, axis=1, keepdims=True))
        return [u @ v, [1.0]]

    turn = staged(_per_key(_joined(spread, basis_of, keys).select(*keys, "x", "white", "mean"), keys, ["turn", "moved"], first_turn), "component-turn")

    def round_sums(held, r):
        k, c = int(np.sqrt(len(r["turn"]))), len(r["mean"])
        if not k:
            return held
        white = (r["x"].reshape(-1, c) - r["mean"]) @ r["white"].reshape(k, c).T
        g = np.tanh(white @ r["turn"].reshape(k, k).T)
        got = [np.array([len(white)], float), g.T @ white, (1 - g**2).sum(axis=0)]
        return got if held is None else [a + b for a, b in zip(held, got, strict=True)]

    def next_turn(rows):
        now = rows["turn"][0]
        k = int(np.sqrt(len(now)))
        sums = [np.sum(rows[c], axis=0) for c in ("m", "gx", "slope")]
        now = now.reshape(k, k)
        step = sums[1].reshape(k, k) / sums[0] - (sums[2] / sums[0])[:, None] * now
        u, _, v = np.linalg.svd(step)
        new = u @ v
        return [new, [np.abs(np.abs((new * now).sum(axis=1)) - 1).max()]]

    for _ in range(rounds):
        going = turn.where(F.col("moved")[0] >= tol).select(*keys, "turn")
        if going.isEmpty():
            break
        fed = _joined(_joined(blocks, basis_of.select(*keys, "mean", "white"), keys), going, keys).select(*keys, "x", "mean", "white", "turn")
        sums = _task_sums(fed, keys, ["m", "gx", "slope"], None, round_sums, lambda h: h if h is not None else [np.zeros(0)] * 3)
        new = _per_key(_joined(sums.where("size(m) > 0"), going, keys), keys, ["turn", "moved"], next_turn)
        turn = staged(new.unionByName(turn.where(F.col("moved")[0] < tol)), "component-turn")

    def ordered(rows):
        """Unmixing rows and loadings, the component of most variance first, its largest loading positive."""
        k, c = int(np.sqrt(len(rows["turn"][0]))), len(rows["mean"][0])
        if not k:
            return [np.zeros(0), np.zeros(0), rows["mean"][0]]
        t, white, back = rows["turn"][0].reshape(k, k), rows["white"][0].reshape(k, c), rows["back"][0].reshape(k, c)
        mixing = t @ back
        first = np.argsort(-np.square(mixing).sum(axis=1), kind="stable")
        largest = np.take_along_axis(mixing, np.abs(mixing).argmax(axis=1)[:, None], axis=1)
        sign = np.where(largest < 0, -1.0, 1.0)
        return [((t @ white) * sign)[first], (mixing * sign)[first], rows["mean"][0]]

    final = staged(_per_key(_joined(turn, basis_of, keys).select(*keys, "turn", "mean", "white", "back"), keys, ["unmix", "mixing", "mean"], ordered), "component-final")
    schema = StructType([*_key_fields(blocks, keys)]).add("component", IntegerType()).add("sample_idx", LongType()).add("source", DoubleType()).add("loadings", ArrayType(DoubleType()))

    def out(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c: np.asarray(row.column(c)[0].values)  # noqa: E731, B023
                mean, idx = get("mean"), get("idx")
                unmix, mixing = get("unmix").reshape(-1, len(mean)), get("mixing").reshape(-1, len(mean))
                source = (get("x").reshape(-1, len(mean)) - mean) @ unmix.T
                for k in range(len(unmix)):
                    m = len(idx)
                    ends = pa.array(np.arange(m + 1, dtype=np.int32) * len(mean))
                    loads = pa.ListArray.from_arrays(ends, pa.array(np.tile(mixing[k], m)))
                    yield pa.record_batch([*[pa.concat_arrays([row.column(c)] * m) if m else row.column(c).slice(0, 0) for c in keys], pa.array(np.full(m, k), pa.int32()), pa.array(idx), pa.array(source[:, k]), loads], names=schema.names)

    return _joined(blocks.select(*keys, "idx", "x"), final, keys).mapInArrow(out, schema)
