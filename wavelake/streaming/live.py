"""Streams of frames: sliding band powers, flow state with hysteresis, package loss, recording.

Late rows beyond the watermark are dropped.  Each operator has a batch form in ``operators.series`` with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

STATE_MARKERS = {"idle": 0, "entered": 3, "exited": 4}
# Metric limits between which the state is held.
ENTER_RATIO, LEAVE_LOAD = 2.0, 0.7


def frames(rows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Long form (keys, ts, channel_idx, value) of rows with an array ``channels``."""
    return rows.select(*keys, F.col(ts).cast("timestamp").alias("ts"), F.posexplode("channels").alias("channel_idx", "value"))


def windowed(events: DataFrame, keys: list[str], value: str = "value", size: str = "20 seconds", every: str | None = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Count, mean and mean square of sliding (or, without ``every``, tumbling) windows."""
    w = F.window("ts", size, every) if every else F.window("ts", size)
    got = events.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("energy"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("total") / F.col("n")).alias("mean"), F.sqrt(F.col("energy") / F.col("n")).alias("rms"))


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 seconds") -> DataFrame:
    got = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def parsed(messages: DataFrame, column: str = "json") -> DataFrame:
    """Messages by type: frame (channels), metrics, phase or marker; unreadable ones have a null type."""
    kind = "type string, ts double, channels array<double>, theta_alpha_ratio double, cognitive_load_index double, phase string, label string"
    return messages.withColumn("m", F.from_json(column, kind)).select(*messages.columns, "m.*")


def flow_state(metrics: DataFrame, key: str, seq: str, enter: str = "enter", leave: str = "leave") -> DataFrame:
    """(key, seq, state) for each metric row in order of ``seq`` within a micro-batch; the state is held between batches."""
    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "idle"
        rows = pd.concat(list(batches)).sort_values(seq)
        made = []
        for s, e, x in zip(rows[seq], rows[enter], rows[leave], strict=True):
            now = "entered" if e else "exited" if x else now
            made.append((k[0], s, now))
        state.update((now,))
        yield pd.DataFrame(made, columns=[key, seq, "state"])

    k, s = metrics.schema[key].dataType.simpleString(), metrics.schema[seq].dataType.simpleString()
    return metrics.groupBy(key).applyInPandasWithState(step, f"`{key}` {k}, `{seq}` {s}, state string", "now string", "append", "NoTimeout")


def recorder_rows(states: DataFrame) -> DataFrame:
    """Adds the marker that the session file has for a state."""
    m = F.create_map(*[F.lit(x) for kv in STATE_MARKERS.items() for x in kv])
    return states.withColumn("marker", m[F.col("state")])


def latest(messages: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    return messages.groupBy(key).agg(F.max_by(F.struct(*payload), order).alias("m")).select(key, "m.*")


def record(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends tab separated rows with a header; files are complete or absent."""
    return stream.writeStream.format("csv").option("sep", "\t").option("header", True).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def metrics(frames_: DataFrame, key: str, fs: float, scorer=None, most: int = 40_000, every: float = 2.0, channels: int = 8) -> DataFrame:
    """(key, t, n_samples, focus, stability, one column for each band) from frames (key, t: seconds, channels: array) as they come.

    The state of a session is its buffer: the last ``most`` values over all channels, older ones are dropped; channels that a frame
    lacks count as zero, more than ``channels`` are left out; of fewer channels more samples are held.  Metrics are computed over the whole buffer when ``every`` seconds of
    frame time have passed since the last time; rows in between hold the last ones.  ``scorer`` takes a matrix of 4 s windows of the
    mean over channels; without one focus is 0.
    """
    import numpy as np

    from ..functions import kernels as K

    names = ["focus", "stability", *S.BANDS]

    def compute(x: np.ndarray) -> list[float]:
        out = [0.0, 0.0]
        size = int(4 * fs)
        if scorer is not None and len(x) >= size:
            score = np.asarray(scorer(x[: len(x) // size * size].mean(axis=1).reshape(-1, size)), float)
            out = [float(score.mean()), float(1 - score.std())]
        freq, power = K.welch(x[:, 0], fs, min(len(x), int(2 * fs)))
        for c in range(1, x.shape[1]):
            power = power + K.welch(x[:, c], fs, min(len(x), int(2 * fs)))[1]
        return out + [float(power[(freq >= lo) & (freq < hi)].sum() / (power.sum() + S.TINY)) for lo, hi in S.BANDS.values()]

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, width, last, now = state.get if state.exists else ([], 0, None, [0.0] * len(names))
        rows = pd.concat(list(batches)).sort_values("t")
        fresh = [list(v)[:channels] for v in rows["channels"]]
        wide = max([width, *map(len, fresh)])
        held = most // max(wide, 1)
        old = np.zeros((len(buffer) // width if width else 0, wide))
        old[:, :width] = np.reshape(buffer, (-1, width)) if width else 0
        x, at, made = np.zeros((len(fresh), wide)), 0, []
        for i, v in enumerate(fresh):
            x[i, : len(v)] = v
        x = np.concatenate([old, x])
        for i, t in enumerate(rows["t"]):
            at = len(old) + i + 1
            if last is None or t - last > every:
                last, now = float(t), compute(x[max(0, at - held) : at]) if wide else now
            made.append((k[0], float(t), min(at, held), *now))
        state.update((x[-held:].ravel().tolist(), wide, last, list(now)))
        yield pd.DataFrame(made, columns=[key, "t", "n_samples", *names])

    kind = frames_.schema[key].dataType.simpleString()
    cols = ", ".join(f"{c} double" for c in names)
    rows = frames_.select(key, F.col("t").cast("double").alias("t"), "channels")
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, t double, n_samples long, {cols}", "buffer array<double>, width int, last double, now array<double>", "append", "NoTimeout")


def heartbeats(messages: DataFrame, key: str, seq: str, idle_ms: int = 1000) -> DataFrame:
    """(key, seq, type): ``data`` for every message, and a ``ping`` (seq null) each time that nothing came for ``idle_ms``."""
    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            made = pd.DataFrame({key: [k[0]], seq: pd.array([None], dtype="Int64"), "type": ["ping"]})
            count = state.get[0] + 1
        else:
            rows = pd.concat(list(batches)).sort_values(seq)
            made = pd.DataFrame({key: rows[key].to_numpy(), seq: pd.array(rows[seq], dtype="Int64"), "type": "data"})
            count = 0
        state.update((count,))
        state.setTimeoutDuration(idle_ms)
        yield made

    kind = messages.schema[key].dataType.simpleString()
    return messages.select(key, F.col(seq).cast("long").alias(seq)).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{seq}` long, type string", "pings long", "append", "ProcessingTimeTimeout")


#: Commands that a session takes in each state, and the state they lead to; any other is refused and leaves the state.
SESSION = {("IDLE", "start"): "CONNECTING", ("CONNECTING", "connected"): "STREAMING", ("CONNECTING", "error"): "ERROR", ("CONNECTING", "stop"): "IDLE", ("STREAMING", "stop"): "IDLE", ("STREAMING", "error"): "ERROR", ("ERROR", "stop"): "IDLE"}


def session_states(commands: DataFrame, key: str, seq: str, command: str = "command") -> DataFrame:
    """(key, seq, command, state, accepted) after each command, in order of ``seq`` within a micro-batch; IDLE at first."""
    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "IDLE"
        made = []
        for s, c in pd.concat(list(batches)).sort_values(seq)[[seq, command]].itertuples(index=False):
            nxt = SESSION.get((now, c))
            now = nxt or now
            made.append((k[0], s, c, now, nxt is not None))
        state.update((now,))
        yield pd.DataFrame(made, columns=[key, seq, command, "state", "accepted"])

    k, s = commands.schema[key].dataType.simpleString(), commands.schema[seq].dataType.simpleString()
    return commands.select(key, seq, command).groupBy(key).applyInPandasWithState(step, f"`{key}` {k}, `{seq}` {s}, `{command}` string, state string, accepted boolean", "now string", "append", "NoTimeout")


def refresh(frames_: DataFrame, key: str, fs: float, handle, checkpoint: str, every: str = "2 seconds", **options):
    """Starts a query that calls ``handle`` on the metrics of the buffer (``metrics``) of each micro-batch."""
    return metrics(frames_, key, fs, **options).writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
