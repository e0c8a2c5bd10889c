"""Streams whose events need several values of state: region crossings, climbs and descents, in the order of time.

Fixes may arrive in any order. Each track keeps those that the watermark has not passed (list state); a timer at the
earliest one's time releases them, sorted, once none before them can come any more. Released fixes run through the same
rules as in a batch; the track's last fix and its open event are value state. So a stream gives the rows of the batch
operators, whatever the order of arrival within `late` and wherever it was stopped and started again.

State of a track: the fixes of the last `late` seconds, one fix, one event. Fixes later than that are dropped by Spark.
Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). A fix without a time is left out. The last
events of a stream appear when the watermark passes them. A fix's order among equal times is its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.operators.statistics import LEVELS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EARTH_M = 6_371_000.0


class InOrder(StatefulProcessor):
    """Holds fixes until the watermark has passed them; subclasses say what released ones give.

    fields: the columns of a fix beside data_time and id, with their types."""

    fields: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = ["data_time", "id", *self.fields]
        fix = "data_time long, id long" + "".join(f", {n} {t}" for n, t in self.fields.items())
        self.waiting = handle.getListState("waiting", fix)
        self.last = handle.getValueState("last", fix)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            own = frame[self.columns].astype(object).where(frame[self.columns].notna(), None)
            self.waiting.appendList([(int(r[0]), int(r[1]), *r[2:]) for r in own.itertuples(index=False, name=None)])
            first = int(frame["data_time"].min())
            earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self._wake(earliest * 1000)
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer a track, at its earliest waiting fix."""
        if self.due.exists():
            (known,) = self.due.get()
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda fix: fix[:2])
        ready = [fix for fix in held if fix[0] * 1000 <= passed]
        rest = held[len(ready) :]
        self.due.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0] * 1000)
        else:
            self.waiting.clear()
        before = tuple(self.last.get()) if self.last.exists() else None
        ready = [fix for fix in ready if before is None or tuple(fix[:2]) > before[:2]]
        if not ready:
            return
        frame = pd.DataFrame([before, *ready] if before else ready, columns=self.columns)
        self.last.update(tuple(ready[-1]))
        out = self.released(frame, before is not None)
        if len(out):
            out.insert(0, "track_id", [key[0]] * len(out))
            yield out

    def released(self, frame: pd.DataFrame, known: bool) -> pd.DataFrame:
        """Events of the frame's fixes in order; where `known`, its first row is the last fix released before."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Crossings(InOrder):
    """Steps from one region into another, as statistics.admin_crossings."""

    fields = {"lat": "double", "lon": "double", **dict.fromkeys(LEVELS, "string")}
    OUT = ["crossing_id", "crossing_time", "crossing_type", *(f"from_{c}" for c in LEVELS), *(f"to_{c}" for c in LEVELS), "distance_m"]

    def released(self, frame: pd.DataFrame, known: bool) -> pd.DataFrame:
        names = frame[list(LEVELS)].fillna("").to_numpy(dtype=object)
        changed, named = names[1:] != names[:-1], names[1:] != ""
        kind, above = np.full(len(frame) - 1, None, dtype=object), np.ones(len(frame) - 1, bool)
        for i, level in enumerate(LEVELS):
            kind[above & changed[:, i] & named[:, i]] = level.upper()
            above &= ~changed[:, i]
        hit = np.array([k is not None for k in kind], bool)
        y, x = (np.radians(frame[c].to_numpy(dtype=float)) for c in ("lat", "lon"))
        h = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[1:]) * np.cos(y[:-1]) * np.sin(np.diff(x) / 2) ** 2
        metres = 2 * _EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))
        after = frame.iloc[1:][hit]
        sides = {f"from_{c}": names[:-1][hit][:, i] for i, c in enumerate(LEVELS)} | {f"to_{c}": names[1:][hit][:, i] for i, c in enumerate(LEVELS)}
        found = {"crossing_id": after["id"].to_numpy(), "crossing_time": after["data_time"].to_numpy(), "crossing_type": kind[hit], **sides, "distance_m": metres[hit]}
        return pd.DataFrame(found)[self.OUT]


class AltitudeRuns(InOrder):
    """Climbs and descents, as spatial.altitude_events. The open run is state until a step of another kind ends it."""

    fields = {"altitude": "double", "distance": "double", "lat": "double", "lon": "double"}
    OUT = ["event_type", "start_time", "end_time", "duration_s", "start_lat", "start_lon", "start_altitude", "end_altitude", "altitude_change", "distance_m", "steps"]

    def __init__(self, plateau_m: float, min_m: float, min_s: int):
        self.plateau_m, self.min_m, self.min_s = plateau_m, min_m, min_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "kind string, start_time long, start_lat double, start_lon double, start_altitude double, distance double, steps long")

    def released(self, frame: pd.DataFrame, known: bool) -> pd.DataFrame:
        high, time = frame["altitude"].to_numpy(dtype=float), frame["data_time"].to_numpy(dtype=np.int64)
        hop = np.nan_to_num(frame["distance"].to_numpy(dtype=float))
        step = np.diff(high)
        kind = np.where(step > self.plateau_m, "CLIMB", np.where(step < -self.plateau_m, "DESCENT", "FLAT")).astype(object)
        lat, lon = (frame[c].astype(float).astype(object).where(frame[c].notna(), None).to_numpy() for c in ("lat", "lon"))

        def begun(kind: str, at: int) -> tuple:
            return kind, int(time[at]), lat[at], lon[at], float(high[at])

        current = tuple(self.open.get()) if self.open.exists() else (*begun("FLAT", 0), 0.0, 0)
        done = []
        cuts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else []
        for a, b in zip(cuts, [*cuts[1:], len(kind)]):
            # steps a..b-1 lead from fix a to fix b
            if kind[a] == current[0]:
                current = (*current[:5], current[5] + float(hop[a + 1 : b + 1].sum()), current[6] + int(b - a))
            else:
                done.append((current, int(time[a]), float(high[a])))
                skip = hop[a + 1] if current[0] == "FLAT" else 0.0
                current = (*begun(kind[a], a), float(hop[a + 1 : b + 1].sum() - skip), int(b - a))
        self.open.update(current)
        rows = [(k, s, t, t - s, y, x, a, z, z - a, d, n) for (k, s, y, x, a, d, n), t, z in done if k != "FLAT" and abs(z - a) >= self.min_m and t - s >= self.min_s]
        return pd.DataFrame(rows, columns=self.OUT)


def _run(points: DataFrame, processor: InOrder, late: str, out: str) -> DataFrame:
    kind = points.schema["track_id"].dataType.simpleString()
    timed = points.where("data_time is not null and id is not null").select("track_id", "id", "data_time", *processor.fields, F.timestamp_seconds("data_time").alias("at")).withWatermark("at", late)
    return timed.groupBy("track_id").transformWithStateInPandas(processor, f"track_id {kind}, {out}", "append", "EventTime")


def crossings(points: DataFrame, late: str = "1 day") -> DataFrame:
    """The rows of statistics.admin_crossings over a stream of points, whose fixes may come up to `late` behind."""
    sides = ", ".join(f"{side}_{c} string" for side in ("from", "to") for c in LEVELS)
    return _run(points.where("province is not null"), Crossings(), late, f"crossing_id long, crossing_time long, crossing_type string, {sides}, distance_m double")


def altitude_events(points: DataFrame, plateau_m: float = 10.0, min_m: float = 50.0, min_s: int = 300, late: str = "1 day") -> DataFrame:
    """The rows of spatial.altitude_events over a stream of points; a run appears once a step of another kind has ended it."""
    out = "event_type string, start_time long, end_time long, duration_s long, start_lat double, start_lon double, start_altitude double, end_altitude double, altitude_change double, distance_m double, steps long"
    found = _run(points.where("altitude > -500 and altitude < 9000"), AltitudeRuns(plateau_m, min_m, min_s), late, out)
    return found.withColumn("avg_grade", F.when(F.col("distance_m") > 0, F.try_divide("altitude_change", "distance_m") * 100).otherwise(0.0))
