"""Time-frequency operators.  Kernels run on one (epoch, channel) row at a time inside Arrow batches; everything after is relational."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from ..sources.scratch import staged
from . import chunks as C
from . import resampling as R
from . import series

#: Samples of the longest channel that one task filters or resamples as a whole.
WHOLE = 4 * C.CHUNK


def _arrays(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(at, "value"))), lambda p: p["value"])
    return rows.groupBy(*keys).agg(pairs.alias("x"))


def coefficients(rows: DataFrame, keys: list[str], at: str, fs: float, freqs=None, delayed: bool = False) -> DataFrame:
    """(keys, freq_idx, freq, time_idx, power, phase): wavelet coefficients of each series."""
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    freqs = K.log_grid() if freqs is None else np.asarray(freqs, float)
    arrays = _arrays(rows, keys, at)
    fields = [("freq_idx", "int"), ("freq", "double"), ("power", "array<double>"), ("phase", "array<double>")]
    schema = StructType([arrays.schema[c] for c in keys])
    for n, t in fields:
        schema = schema.add(n, _parse_datatype_string(t))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                w = K.wavelet_transform(one.column("x")[0].values.to_numpy(), fs, freqs, delayed=delayed)
                held = [pa.concat_arrays([one.column(c)] * len(freqs)) for c in keys]
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.record_batch([*held, pa.array(np.arange(len(freqs), dtype=np.int32)), pa.array(freqs), lists(np.abs(w) ** 2), lists(np.angle(w))], names=schema.names)

    got = arrays.mapInArrow(run, schema).withColumn("z", F.arrays_zip("power", "phase"))
    return got.select(*keys, "freq_idx", "freq", F.posexplode("z").alias("time_idx", "z")).select(*keys, "freq_idx", "freq", "time_idx", "z.power", "z.phase")


def epoch_power(coef: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, epoch_idx, freq_idx, freq, time_idx, power): mean over channels."""
    return coef.groupBy(*keys, "epoch_idx", "freq_idx", "freq", "time_idx").agg(F.avg("power").alias("power"))


def perturbation(power: DataFrame, keys: list[str], base: tuple[int, int], method: str = "median") -> DataFrame:
    """(keys, freq_idx, freq, time_idx, power, db): mean over epochs against its baseline (time_idx in [start, end])."""
    mean = power.groupBy(*keys, "freq_idx", "freq", "time_idx").agg(F.avg("power").alias("power"))
    held = F.when(F.col("time_idx").between(*base), F.col("power"))
    level = F.percentile(held, F.lit(0.5)) if method == "median" else F.avg(held)
    b = mean.groupBy(*keys, "freq_idx").agg(F.greatest(F.coalesce(level, F.lit(0.0)), F.lit(S.TINY)).alias("base"))
    out = mean.join(b, [*keys, "freq_idx"])
    return out.withColumn("db", 10 * F.log10(F.greatest("power", F.lit(S.TINY)) / F.col("base"))).drop("base")


def desynchronisation(db: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """(keys, erd_ratio, ers_ratio): shares of cells below and above the threshold."""
    t = abs(threshold)
    return db.groupBy(*keys).agg(F.avg((F.col("db") < -t).cast("double")).alias("erd_ratio"), F.avg((F.col("db") > t).cast("double")).alias("ers_ratio"))


def phase_locking(coef: DataFrame, keys: list[str], mean_angles: bool = False) -> DataFrame:
    """(keys, freq_idx, freq, time_idx, itpc): length of the mean unit vector over epochs.

    Channels of an epoch are joined by the mean of their unit vectors' direction, or by their mean angle if asked for.
    """
    angle = F.avg("phase") if mean_angles else F.atan2(F.sum(F.sin("phase")), F.sum(F.cos("phase")))
    one = coef.groupBy(*keys, "epoch_idx", "freq_idx", "freq", "time_idx").agg(angle.alias("phase"))
    c, s = F.sum(F.cos("phase")), F.sum(F.sin("phase"))
    return one.groupBy(*keys, "freq_idx", "freq", "time_idx").agg((F.sqrt(c * c + s * s) / F.count(F.lit(1))).alias("itpc"))


def _short_and_long(samples: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Channels that one task takes as a whole, and those of more than ``most`` samples (None if there are none)."""
    sizes = staged(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "channel-sizes")
    if sizes.where(F.col("_n") > most).isEmpty():
        return samples, None
    t = R._joined(samples, sizes, keys)
    return t.where(F.col("_n") <= most).drop("_n"), t.where(F.col("_n") > most).drop("_n")


def phase_and_amplitude(samples: DataFrame, keys: list[str], fs: float, slow=(4.0, 8.0), fast=(30.0, 45.0), size: int = C.CHUNK // 4) -> DataFrame:
    """(keys, sample_idx, phase, amplitude): phase of the slow band, amplitude of the fast band, of each channel.

    A channel of up to ``chunks.RING`` times ``size`` samples is one group; a longer one goes in chunks.
    """
    def run(pdf):
        pdf = pdf.sort_values("sample_idx")
        x = pdf["value"].to_numpy()
        pdf["phase"] = np.angle(K.analytic(K.filter_zero_phase(K.butter_sos(4, *slow, fs), x)))
        pdf["amplitude"] = np.abs(K.analytic(K.filter_zero_phase(K.butter_sos(4, *fast, fs), x)))
        return pdf[[*keys, "sample_idx", "phase", "amplitude"]]

    kind = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keys)
    short, long = _short_and_long(samples.select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), "value"), keys, C.RING * size)
    out = short.groupBy(*keys).applyInPandas(run, f"{kind}, sample_idx long, phase double, amplitude double")
    if long is None:
        return out
    chunks = C.chunked(long, keys, size)
    part = lambda band: C.analytic(C.zero_phase(chunks, keys, K.butter_sos(4, *band, fs), size), keys, size)
    both = R._joined(part(slow).select(*keys, "chunk", "idx", F.col("re").alias("a"), F.col("im").alias("b")), part(fast).select(*keys, "chunk", "re", "im"), [*keys, "chunk"])
    z = both.select(*keys, F.explode(F.arrays_zip("idx", "a", "b", "re", "im")).alias("z"))
    return out.unionByName(z.select(*keys, F.col("z.idx").alias("sample_idx"), F.atan2("z.b", "z.a").alias("phase"), F.hypot("z.re", "z.im").alias("amplitude")))


def coupling(rows: DataFrame, keys: list[str], bins: int = 18) -> DataFrame:
    """(keys, mi): divergence of the amplitude over phase bins from the uniform one, over ln(bins).  A phase of pi is in no bin."""
    pi = float(np.pi)
    b = F.floor((F.col("phase") + pi) / F.lit(2 * pi / bins)).cast("int")
    per = rows.select(*keys, b.alias("b"), "amplitude").where(F.col("b").between(0, bins - 1)).groupBy(*keys, "b").agg(F.avg("amplitude").alias("a"))
    p = F.col("a") / (F.sum("a").over(series.whole(keys)) + S.TINY)
    return per.select(*keys, p.alias("p")).groupBy(*keys).agg((F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") * bins)).otherwise(0.0)) / float(np.log(bins))).alias("mi"))


# -- grids: frequencies x times of an epoch, summed as arrays before they become rows ---------------------------------------


def epochs_of(rows: DataFrame, keys: list[str], at: str = "rel_idx") -> DataFrame:
    """(keys, epoch_idx, x, side): the channels of an epoch as arrays in order; ``side`` if the rows have one."""
    one = _arrays(rows, [*keys, "epoch_idx", "channel_idx", *(["side"] if "side" in rows.columns else [])], at)
    more = [F.first("side").alias("side")] if "side" in rows.columns else []
    return one.groupBy(*keys, "epoch_idx").agg(F.collect_list("x").alias("x"), *more)


def _grids(column, fs: float, freqs):
    """Mean power over channels and direction of the mean unit vector, (epochs, frequencies, times) each, of epochs of one length."""
    sizes = np.array([len(e) for e in column])
    lengths = np.array([len(e[0]) for e in column])
    for n in np.unique(lengths):
        some = np.nonzero(lengths == n)[0]
        coef = K.wavelet_transforms(np.array([c for i in some for c in column[i].as_py()], float), fs, freqs)
        first = np.cumsum(sizes[some]) - sizes[some]
        unit = np.add.reduceat(coef / np.maximum(np.abs(coef), 1e-300), first, axis=0)
        yield some, np.add.reduceat(np.abs(coef) ** 2, first, axis=0) / sizes[some][:, None, None], unit / np.maximum(np.abs(unit), 1e-300)


def _kinds(df: DataFrame, keys: list[str]) -> list:
    return [df.schema[c] for c in keys]


def mean_grids(epochs: DataFrame, keys: list[str], fs: float, freqs=None) -> DataFrame:
    """(keys, freq_idx, freq, time_idx, power, itpc): mean power over epochs, and the length of their mean unit vector.

    Every task adds up its epochs' grids; one array for each key and task is shuffled.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    freqs = K.log_grid() if freqs is None else np.asarray(freqs, float)
    many = ArrayType(DoubleType())
    schema = StructType(_kinds(epochs, keys)).add("n", LongType()).add("times", LongType())
    for c in ("power", "re", "im"):
        schema = schema.add(c, many)

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                names = list(zip(*[part.column(c).to_pylist() for c in keys], strict=True))
                for some, power, unit in _grids(part.column("x"), fs, freqs):
                    for name in set(names[i] for i in some):
                        pick = [k for k, i in enumerate(some) if names[i] == name]
                        got = [len(pick), power[pick].sum(axis=0), unit[pick].sum(axis=0)]
                        own = held.get((name, power.shape[2]))
                        held[name, power.shape[2]] = got if own is None else [a + b for a, b in zip(own, got, strict=True)]
            if len(held) > 500:
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held):
        for (name, times), (n, power, unit) in held.items():
            cols = [pa.array([v], t) for v, t in zip(name, key_types, strict=True)] + [pa.array([n]), pa.array([times])]
            yield pa.record_batch([*cols, *[pa.array([g.ravel()], pa.list_(pa.float64())) for g in (power, unit.real, unit.imag)]], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [to_arrow_type(f.dataType) for f in _kinds(epochs, keys)]

    def whole(table):
        total = [np.sum([np.asarray(v) for v in table.column(c).to_pylist()], axis=0) for c in ("power", "re", "im")]
        cols = [table.column(c).slice(0, 1) for c in [*keys]] + [pa.array([int(np.sum(table.column("n").to_numpy()))]), table.column("times").slice(0, 1)]
        return pa.table([*cols, *[pa.array([v], pa.list_(pa.float64())) for v in total]], names=schema.names)

    sums = epochs.select(*keys, "x").mapInArrow(partial, schema).groupBy(*keys, "times").applyInArrow(whole, schema)
    rows = sums.select(*keys, "n", "times", F.posexplode(F.arrays_zip("power", "re", "im")).alias("cell", "z"))
    grid = F.array(*[F.lit(float(f)) for f in freqs])
    k = F.expr("cell div times").cast("int")
    length = F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")) / F.col("n")
    return rows.select(*keys, k.alias("freq_idx"), F.get(grid, k).alias("freq"), (F.col("cell") % F.col("times")).cast("int").alias("time_idx"), (F.col("z.power") / F.col("n")).alias("power"), length.alias("itpc"))


#: Epochs of one block of a permutation test, and of those transformed at a time.
EPOCHS, AT_ONCE = 4096, 128


def permuted(epochs: DataFrame, keys: list[str], fs: float, freqs=None, n: int = 200, seed: int = 0, base: tuple[int, int] | None = None, block: int = EPOCHS) -> DataFrame:
    """(keys, freq_idx, time_idx, p_value) of power after against before the event (``base``: first and last time of before), or of
    two conditions (``side`` 0 and 1).

    Each draw splits the pooled epochs into groups of the sizes seen; all cells of a key use the same draws.  A block of epochs gives
    the product of its membership matrix (draws x epochs, from seeds) and its powers (epochs x cells); products are added over
    blocks, so a key of any number of epochs is many tasks and no epoch is shuffled for a draw.  Keys with one group alone have p 1.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

    from ..functions import draws as D

    freqs = K.log_grid() if freqs is None else np.asarray(freqs, float)
    side = F.lit(0) if base is not None else F.col("side").cast("int")
    rows = R.numbered(epochs.select(*keys, "epoch_idx", "x", side.alias("side")), keys, ["epoch_idx"], "permuted-epochs")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("side") == 0).alias("_na"))
    rows = R._joined(rows, sizes, keys).withColumn("_seed", F.xxhash64(F.lit(seed), *keys)).withColumn("_block", F.expr(f"pos div {block}"))
    schema = StructType(_kinds(rows, keys)).add("freq_idx", IntegerType()).add("times", IntegerType()).add("first", IntegerType())
    schema = schema.add("_n", LongType()).add("_na", LongType()).add("sums", ArrayType(DoubleType()))

    def products(table):
        table = table.sort_by("pos")
        total, n_a, at, key_seed = (table.column(c)[0].as_py() for c in ("_n", "_na", "_block", "_seed"))
        r, rng = table.num_rows, D.block_generator(key_seed, at)
        if base is None:
            need, _ = D.shares(key_seed, n, total, n_a, block, at, False)
            taken = D.members(rng, r, need).T
        else:  # each epoch stands twice in the pool: its power after, and its mean before
            need, _ = D.shares(key_seed, n, 2 * total, total, 2 * block, at, False)
            taken = D.members(rng, 2 * r, need).T
        in_a, sums, first, x = table.column("side").to_numpy() == 0, None, 0, table.column("x")
        for low in range(0, r, AT_ONCE):
            for some, power, _ in _grids(x.slice(low, AT_ONCE), fs, freqs):
                i = low + some
                if base is None:
                    pick = np.vstack([in_a[i], ~in_a[i], taken[:, i]]).astype(float)
                    got = np.tensordot(pick, power, 1)
                else:
                    first = base[1] + 1
                    ref, after = power[:, :, base[0] : base[1] + 1].mean(axis=2), power[:, :, first:]
                    got = np.tensordot(np.vstack([np.ones((1, len(i))), np.zeros((1, len(i))), taken[:, i]]), after, 1)
                    got += np.tensordot(np.vstack([np.zeros((1, len(i))), np.ones((1, len(i))), taken[:, r + i]]), ref, 1)[:, :, None]
                sums = got if sums is None else sums + got
        f = sums.shape[1]
        keep = [pa.chunked_array([pa.concat_arrays([table.column(c).slice(0, 1).combine_chunks()] * f)]) for c in keys]
        same = lambda v, t: pa.array([v] * f, t)
        cols = [pa.array(range(f), pa.int32()), same(sums.shape[2], pa.int32()), same(first, pa.int32()), same(total, pa.int64()), same(n_a, pa.int64())]
        return pa.table([*keep, *cols, pa.array([sums[:, k].ravel() for k in range(f)], pa.list_(pa.float64()))], names=schema.names)

    out = StructType(_kinds(rows, keys)).add("freq_idx", IntegerType()).add("time_idx", IntegerType()).add("p_value", DoubleType())

    def tested(table):
        total, n_a, times, first = (table.column(c)[0].as_py() for c in ("_n", "_na", "times", "first"))
        sums = np.sum([np.asarray(v) for v in table.column("sums").to_pylist()], axis=0).reshape(n + 2, times)
        n_b = total if base is not None else total - n_a
        if n_a and n_b:
            every = sums[0] + sums[1]
            diff = sums / n_a - (every - sums) / n_b
            near = 1e-12 * (np.abs(sums[0]) / n_a + np.abs(sums[1]) / n_b)
            p = ((np.abs(diff[2:]) >= np.abs(diff[0]) - near).sum(axis=0) + 1) / (n + 1)
        else:
            p = np.ones(times)
        keep = [pa.chunked_array([pa.concat_arrays([table.column(c).slice(0, 1).combine_chunks()] * times)]) for c in [*keys, "freq_idx"]]
        return pa.table([*keep, pa.array(np.arange(first, first + times), pa.int32()), pa.array(p)], names=out.names)

    blocks = rows.groupBy(*keys, "_block").applyInArrow(products, schema)
    return blocks.groupBy(*keys, "freq_idx").applyInArrow(tested, out)


def effect_threshold(diff: DataFrame, column: str = "diff", limit: float = 1.0) -> DataFrame:
    """Marks cells by the size of the difference alone; not a test."""
    return diff.withColumn("beyond_threshold", F.abs(column) > limit)


def cleaned(
    samples: DataFrame, keys: list[str], fs: float, lp: float | None = 45.0, hp: float | None = 1.0, notch: float | None = 50.0, strict: bool = False, most: int = WHOLE, size: int = C.CHUNK
) -> DataFrame:
    """(keys, sample_idx, value, error): zero-phase filters over each channel.

    A channel of up to ``most`` samples is one group, a longer one goes in chunks of ``size``.  A channel that can't be filtered
    gives its rows back with null values and the reason, and doesn't fail the job.
    """
    def run(pdf):
        pdf = pdf.sort_values("sample_idx")
        try:
            pdf["value"], pdf["error"] = K.clean_channel(pdf["value"].to_numpy(), fs, lp, hp, notch, strict), None
        except Exception as e:
            pdf["value"], pdf["error"] = np.nan, f"{type(e).__name__}: {e}"
            pdf["value"] = None
        return pdf[[*keys, "sample_idx", "value", "error"]]

    kind = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keys)
    short, long = _short_and_long(samples.select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), "value"), keys, most)
    out = short.groupBy(*keys).applyInPandas(run, f"{kind}, sample_idx long, value double, error string")
    if long is None:
        return out
    try:
        filters = K.cleaning(fs, lp, hp, notch, strict)
    except ValueError as e:
        none = F.lit(None).cast("double").alias("value")
        return out.unionByName(long.select(*keys, "sample_idx", none, F.lit(f"{type(e).__name__}: {e}").alias("error")))
    chunks = C.chunked(long, keys, size)
    for sos in filters:
        chunks = C.zero_phase(chunks, keys, sos, size)
    return out.unionByName(C.samples_of(chunks, keys).withColumn("error", F.lit(None).cast("string")))


def resampled(samples: DataFrame, keys: list[str], fs: int, target: int, fourier: bool = False, most: int = WHOLE, size: int = C.CHUNK) -> DataFrame:
    """(keys, sample_idx, value) at the target rate.

    Polyphase resampling takes channels of more than ``most`` samples in chunks of about ``size``; through the spectrum
    (``fourier``) each channel is one group.
    """
    if fs == target:
        return samples.select(*keys, "sample_idx", "value")

    def run(pdf):
        import pandas as pd

        x = pdf.sort_values("sample_idx")["value"].to_numpy()
        y = K.resample_fourier(x, int(len(x) * target / fs)) if fourier else K.resample_ratio(x, target, fs)
        out = pd.DataFrame({"sample_idx": np.arange(len(y)), "value": y})
        for c in reversed(keys):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kind = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keys)
    rows = samples.select(*keys, "sample_idx", "value")
    short, long = (rows, None) if fourier else _short_and_long(rows, keys, most)
    out = short.groupBy(*keys).applyInPandas(run, f"{kind}, sample_idx long, value double")
    if long is None:
        return out
    step = K.ratio_kernel(target, fs)[1]
    size = max(step, size // step * step)
    return out.unionByName(C.resampled(C.chunked(long, keys, size), keys, fs, target, size))
