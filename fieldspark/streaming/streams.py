"""Streaming forms of the lookups, windows and detectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.geometry import nearest_index
from ..operators.knn import nearest
from ..operators.spatial import points_in_boxes, points_in_ellipsoids


def enrich_with_boxes(events: DataFrame, axes: list[str], boxes: DataFrame, lo: list[str], hi: list[str], width: list[float]) -> DataFrame:
    """Event-box pairs of a stream against static boxes: a stream-static join on the cell key (append mode)."""
    return points_in_boxes(events, axes, boxes, lo, hi, width=width)


def enrich_with_ellipsoids(events: DataFrame, axes: list[str], ellipsoids: DataFrame, mu: list[str], sigma: list[list[str]], tau: float) -> DataFrame:
    """Event-ellipsoid pairs of a stream against static ellipsoids: a stream-static join on the cell key (append mode)."""
    return points_in_ellipsoids(events, axes, ellipsoids, mu, sigma, tau)


def enrich_batches(events: DataFrame, enrich, path: str, checkpoint: str):
    """A query that writes enrich(micro-batch) to the folder path/batch=N; there a join sees a table, so copies among a
    batch's events are joined once and its tasks are spread. A batch that is run again replaces what it had written."""

    def step(batch: DataFrame, n: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def enrich_with_cells(events: DataFrame, axes: list[str], maps: DataFrame, width: list[float], tol: float = 0.0) -> DataFrame:
    """events with `cell_id`, the smallest mesh cell whose affine coordinates of the event are all >= -tol (append mode).

    maps: a static table (cell_id, lo, hi, a, b). Each grid cell of the given width lists the mesh cells whose boxes touch
    it, so every event meets one row and is reduced within it, without a stream aggregation. Events outside drop out.
    """
    n = range(len(axes))
    index = maps.select(F.struct("cell_id", "a", "b").alias("m"), "lo", "hi")
    for i in n:
        index = index.select("*", F.explode(F.sequence(F.floor(F.col("lo")[i] / width[i]), F.floor(F.col("hi")[i] / width[i]))).alias(f"_c{i}"))
    index = index.groupBy(*(f"_c{i}" for i in n)).agg(F.collect_list("m").alias("_cells"))
    near = events.withColumns({f"_c{i}": F.floor(F.col(a) / width[i]) for i, a in enumerate(axes)}).join(index, [f"_c{i}" for i in n])
    bary = lambda m: F.zip_with(m["a"], m["b"], lambda row, c: sum((row[i] * F.col(a) for i, a in enumerate(axes)), c))
    held = F.filter("_cells", lambda m: F.forall(bary(m), lambda x: x >= -tol))
    return near.withColumn("cell_id", F.array_min(F.transform(held, lambda m: m["cell_id"]))).where("cell_id is not null").select(*events.columns, "cell_id")


def session_boxes(events: DataFrame, axes: list[str], gap: str, late: str, key: str, ts: str = "ts") -> DataFrame:
    """Bounding box and count of the points of each session of a key: rows of the key less than `gap` apart. A session
    comes out once the watermark has passed its end; rows later than the watermark are dropped."""
    held = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return held.agg(F.count(F.lit(1)).alias("n"), *(F.min(a).alias("lo_" + a) for a in axes), *(F.max(a).alias("hi_" + a) for a in axes))


def windowed_boxes(events: DataFrame, axes: list[str], window: str, late: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Bounding box and count of the points of each time window; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide or window)
    return events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *(F.min(a).alias("lo_" + a) for a in axes), *(F.max(a).alias("hi_" + a) for a in axes))


def windowed_support(events: DataFrame, axes: list[str], value: str, atol: float, window: str, late: str, ts: str = "ts") -> DataFrame:
    """Box of the points with abs(value) > atol in each window."""
    return windowed_boxes(events.where(F.abs(value) > atol), axes, window, late, ts)


def windowed_heat(events: DataFrame, x: str, y: str, lo: tuple[float, float], h: tuple[float, float], window: str, late: str, ts: str = "ts") -> DataFrame:
    """Counts by time window and nearest gridpoint."""
    held = events.withWatermark(ts, late).withColumns({"i": nearest_index(F.col(x), lo[0], h[0]), "j": nearest_index(F.col(y), lo[1], h[1])})
    return held.groupBy(F.window(ts, window).alias("w"), "i", "j").agg(F.count(F.lit(1)).alias("n"))


class _Crossing(StatefulProcessor):
    """One flag a key: whether the series has been under the threshold already."""

    def __init__(self, threshold: float, y: str, k: str, key: str):
        self.threshold, self.y, self.k, self.key = threshold, y, k, key

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "k long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        if not self.done.exists():
            for pdf in rows:
                low = pdf.loc[pdf[self.y] < self.threshold, self.k]
                if len(low):
                    first = int(low.min()) if first is None else min(first, int(low.min()))
        if first is not None:
            self.done.update((first,))
            yield pd.DataFrame({self.key: [key[0]], "first": [first]})

    def close(self) -> None:
        pass


def first_crossings(series: DataFrame, threshold: float, key: str = "series_id", k: str = "k", y: str = "y") -> DataFrame:
    """(key, first) once for each series, in the batch in which it first falls under the threshold (append mode)."""
    kind = dict(series.dtypes)[key]
    return series.groupBy(key).transformWithStateInPandas(_Crossing(threshold, y, k, key), f"{key} {kind}, first long", "Append", "None")


class _Episodes(StatefulProcessor):
    """The open episodes of a group of keys: (key, start, end, first) in microseconds (first -1 without a crossing), as one
    Arrow table, with a timer for the one that closes next."""

    def __init__(self, threshold: float, gap: int, y: str, key: str):
        self.threshold, self.gap, self.y, self.key = threshold, gap, y, key

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held binary")

    def _ends(self, end):
        return (end + self.gap) // 1000

    def _merged(self, keys: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of a key less than the gap apart become one, with the earliest crossing of its parts."""
        code, _ = pd.factorize(keys)  # a group's keys are all null (one key) or none is
        order = np.lexsort((spans[:, 0], code))
        keys, spans, code = keys[order], spans[order], code[order]
        reach = pd.Series(spans[:, 1]).groupby(code).cummax().to_numpy()
        at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (spans[1:, 0] - reach[:-1] >= self.gap)])
        first = np.minimum.reduceat(np.where(spans[:, 2] < 0, np.iinfo(np.int64).max, spans[:, 2]), at)
        return keys[at], np.stack([spans[at, 0], np.maximum.reduceat(spans[:, 1], at), np.where(first == np.iinfo(np.int64).max, -1, first)], 1)

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        t = pa.ipc.open_stream(bytes(self.open.get()[0])).read_all()
        return t.column(0).to_numpy(), np.stack([t.column(1 + i).to_numpy() for i in range(3)], 1)

    def _keep(self, keys: np.ndarray, spans: np.ndarray) -> None:
        """Store what is open and wake up when the first of it closes."""
        if not len(keys):
            self.open.clear()
            return
        t = pa.table([pa.array(keys, from_pandas=True), *(pa.array(np.ascontiguousarray(spans[:, i])) for i in range(3))], names=["key", "start", "end", "first"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        self.open.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self._ends(spans[:, 1].min())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self._held() if self.open.exists() else None
        for pdf in rows:
            if not len(pdf):
                continue
            t = pdf["at_us"].to_numpy(np.int64)
            low = pdf[self.y].to_numpy(float) < self.threshold  # a null is not under the threshold
            keys, spans = self._merged(pdf[self.key].to_numpy(), np.stack([t, t, np.where(low, t, -1)], 1))
            held = (keys, spans) if held is None else self._merged(np.concatenate([held[0], keys]), np.concatenate([held[1], spans]))
        if held is not None:
            self._keep(*held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.open.exists():
            return
        keys, spans = self._held()
        done = self._ends(spans[:, 1]) <= timerValues.getCurrentWatermarkInMs()  # none, if the episode has grown since the timer was set
        self._keep(keys[~done], spans[~done])
        if done.any():
            first = pd.array(spans[done, 2], dtype="Int64")
            first[spans[done, 2] < 0] = pd.NA
            yield pd.DataFrame({self.key: keys[done], "start": spans[done, 0], "end": spans[done, 1], "first": first})

    def close(self) -> None:
        pass


#: Groups of keys; a group that gets rows or closes an episode costs one call of Python a micro-batch.
GROUPS = 1024


def crossing_episodes(series: DataFrame, threshold: float, gap_seconds: int, late: str, key: str = "series_id", ts: str = "ts", y: str = "y", groups: int = GROUPS) -> DataFrame:
    """(key, start, end, first): first time under the threshold in each episode of a series, null if there is none; times in
    microseconds since 1970.

    An episode is a run of rows less than the gap apart in event time. It comes out, once and whole, when an event-time
    timer finds the watermark past its end by the gap, and takes its state along: a quiet series keeps nothing. Rows in any
    order count, also those that join two open episodes; rows behind the watermark are dropped. Append mode; needs the
    RocksDB state store. Series are dealt into groups by a hash, which are changed at once, so calls and timers grow with
    the groups and not with the series; a group's open episodes are read and written whole, so take more groups than the
    default for very many series. The number of groups is part of the checkpoint.
    """
    kind = dict(series.dtypes)[key]
    group = F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(groups).cast("long")))
    held = series.withWatermark(ts, late).select(group.alias("_group"), key, ts, F.unix_micros(ts).alias("at_us"), F.col(y).cast("double").alias(y)).where(F.col(ts).isNotNull())
    return held.groupBy("_group").transformWithStateInPandas(_Episodes(threshold, gap_seconds * 1_000_000, y, key), f"{key} {kind}, start long, end long, first long", "Append", "EventTime")


def first_crossing_times(series: DataFrame, threshold: float, window: str, late: str, key: str = "series_id", ts: str = "ts", y: str = "y") -> DataFrame:
    """(w, key, first): earliest time under the threshold in each window."""
    held = series.withWatermark(ts, late).where(F.col(y) < threshold)
    return held.groupBy(F.window(ts, window).alias("w"), key).agg(F.min(ts).alias("first"))


def nearest_sites(events: DataFrame, sites: DataFrame, axes: list[str], k: int, path: str, checkpoint: str, key: str = "id"):
    """A query that writes each micro-batch's nearest sites to the folder path/batch=N; a batch that is run again after a
    failure replaces what it had written."""

    def step(batch: DataFrame, n: int) -> None:
        nearest(sites, batch, axes, k, key, key).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
