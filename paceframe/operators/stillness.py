"""Stillness alarms over recorded sessions: the bounded twin of the streaming detector.

The rule keeps an anchor position per session. A sample more than 10 m away becomes the new
anchor; otherwise, once the index is 30 past the anchor and the heart rate is above the
limit, one alarm is raised for that anchor. Where the next anchor lies depends on the
current one, which no window frame expresses, so a NumPy scan carries the state over
Arrow batches of rows that Spark has partitioned and sorted by session.

An ordinary session lies whole in one partition. A hot session is cut into pieces that are
scanned at the same time, each first without an entry state. A piece is then known as a map from entry to
exit: an entry anchor within reach of all its positions, which their convex hull tells, passes through it unchanged;
any other ends at the first position out of reach, and the exit no longer depends on the entry but through that position.
A sweep over one small row per piece composes the maps in order and finds the pieces whose exit is not known for
their entry; these are scanned again, all at once, until none is left. A rest of any length passes
in one sweep, and anchors of a moving athlete soon fall on the same samples whatever they started from, so this takes a few
rounds. The result is the sequential one in every case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.config import EARTH_RADIUS_M, DetectorConfig
from paceframe.functions.text import alarm_text
from paceframe.operators.sessions import SESSION, unique_events
from paceframe.operators.skew import chunk_with_halo, dense_position, group_key, hot_keys, split_hot
from paceframe.runtime import send_by_value, written

send_by_value()

COLUMNS = ["sample_index", "latitude", "longitude", "heart_rate_bpm"]
ALERT_SCHEMA = (
    "athlete_id string, session_id bigint, sample_index bigint, still_for bigint, "
    "latitude double, longitude double, heart_rate_bpm double"
)
State = tuple[float, float, int, bool]
#: Samples after an anchor that are compared with it one by one.
FEW = 6


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Great-circle distance of two points in degrees; NaN when a coordinate is."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    s = math.sin((p2 - p1) / 2)
    t = math.sin(math.radians(lon2 - lon1) / 2)
    h = s * s + math.cos(p1) * math.cos(p2) * t * t
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h))) if h == h else math.nan


def metres_between(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """:func:`metres` of many pairs of points, or from one point to many."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def scan_arrays(
    index: np.ndarray, lat: np.ndarray, lon: np.ndarray, bpm: np.ndarray, state: State | None, cfg: DetectorConfig
) -> tuple[State | None, list[tuple]]:
    """Advance the state over samples in index order; returns it with the alarms raised.

    A sample without a position can neither move the anchor nor be judged still. A run of samples that are each too far
    from the one before moves the anchor to its end at once. From an anchor the next few samples are compared one by
    one and the rest in blocks that grow, so neither a walk nor a long rest costs a step per sample.
    """
    placed = ~(np.isnan(lat) | np.isnan(lon))
    if not placed.all():
        index, lat, lon, bpm = index[placed], lat[placed], lon[placed], bpm[placed]
    n, at, alerts = len(lat), 0, []
    if not n:
        return state, alerts
    near = np.append(metres_between(lat[:-1], lon[:-1], lat[1:], lon[1:]) <= cfg.move_m, True)
    # the last row of the run of far steps that begins at a row
    run_end = np.minimum.accumulate(np.where(near, np.arange(n), n)[::-1])[::-1].tolist()
    lats, lons = lat.tolist(), lon.tolist()

    def anchored(row: int) -> State:
        return lats[row], lons[row], index[row].item(), False

    if state is None:
        state, at = anchored(run_end[0]), run_end[0] + 1
    while at < n:
        moved = next((k for k in range(at, min(at + FEW, n)) if metres(state[0], state[1], lats[k], lons[k]) > cfg.move_m), None)
        begin, end, block = at, min(at + FEW, n) if moved is None else moved, 64
        while moved is None and end < n:
            some = slice(end, end + block)
            far = metres_between(state[0], state[1], lat[some], lon[some]) > cfg.move_m
            if far.any():
                moved = end = end + int(far.argmax())
            else:
                end, block = min(end + block, n), min(2 * block, 1 << 16)
        if not state[3]:
            still = index[begin:end] - state[2]
            raised = (still >= cfg.still_index) & (bpm[begin:end] > cfg.alarm_bpm)
            if raised.any():
                k = int(raised.argmax())
                alerts.append((index[begin + k].item(), still[k].item(), lats[begin + k], lons[begin + k], bpm[begin + k].item()))
                state = (*state[:3], True)
        if moved is None:
            break
        state, at = anchored(run_end[moved]), run_end[moved] + 1
    return state, alerts


def scan(rows: Iterator[tuple], state: State | None, cfg: DetectorConfig) -> tuple[State | None, list[tuple]]:
    """:func:`scan_arrays` of (index, latitude, longitude, heart rate) tuples."""
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return scan_arrays(np.array(columns[0]), *(np.array(c, np.float64) for c in columns[1:]), state, cfg)


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    """Index, latitude, longitude and heart rate; the index stays whole unless one is missing."""
    return [pdf[COLUMNS[0]].to_numpy(), *(pdf[c].to_numpy(np.float64) for c in COLUMNS[1:])]


def _scan_partition(cfg: DetectorConfig) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = ["athlete_id", "session_id", "sample_index", "still_for", *COLUMNS[1:]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            found = []
            # rows arrive sorted, so one session is one run of rows, perhaps over several batches
            breaks = (pdf["athlete_id"] != pdf["athlete_id"].shift()) | (pdf["session_id"] != pdf["session_id"].shift())
            starts = [*breaks.to_numpy().nonzero()[0].tolist(), len(pdf)]
            columns = _arrays(pdf)
            # a missing session is NaN, which equals nothing
            owners = [(a, None if s != s else s) for a, s in zip(pdf["athlete_id"].tolist(), pdf["session_id"].tolist(), strict=True)]
            for begin, end in zip(starts, starts[1:], strict=False):
                if owners[begin] != current:
                    current, state = owners[begin], None
                state, alerts = scan_arrays(*(c[begin:end] for c in columns), state, cfg)
                found.extend((*current, *a) for a in alerts)
            yield pd.DataFrame(found, columns=names)

    return run


#: Metres by which a hull must be nearer than the limit to be surely within it. Flat edges of at most FLAT metres at latitudes up to
#: POLAR are nearer than that to great circles; other hulls are not used. No two points are further apart than WORLD metres.
MARGIN, FLAT, POLAR, WORLD = 1e-3, 60.0, 85.0, math.pi * EARTH_RADIUS_M + 1


def hull(lat: np.ndarray, lon: np.ndarray, cfg: DetectorConfig) -> tuple[bool, list[float], list[float]]:
    """(wide, latitudes, longitudes): the corners of the positions' convex hull, or ``wide`` where no point is in reach of all of them.

    Corners are left out where a flat hull says nothing: over more than ``FLAT`` metres, near the poles, across the date line.
    """
    south, north, west, east = lat.min(), lat.max(), lon.min(), lon.max()
    steep = max(abs(south), abs(north))
    reach = 2 * cfg.move_m + MARGIN
    if metres(south, 0.0, north, 0.0) > reach or metres(steep, west, steep, east) > reach:
        return True, [], []
    mild = 0.0 if south <= 0.0 <= north else min(abs(south), abs(north))
    if steep > POLAR or east - west > 1.0 or metres(south, 0.0, north, 0.0) > FLAT or metres(mild, west, mild, east) > FLAT:
        return False, [], []
    points = np.unique(np.column_stack((lat, lon)), axis=0)
    row = np.append(True, points[1:, 0] != points[:-1, 0])
    points = points[row | np.append(row[1:], True)].tolist()  # the westmost and eastmost of each latitude
    corners: list[list[float]] = []
    for side in (points, points[::-1]):
        chain: list[list[float]] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        corners += chain
    return False, [c[0] for c in corners], [c[1] for c in corners]


ENTRY = ["known", "e_lat", "e_lon", "e_idx", "e_alarmed"]
EXIT = ["x_known", "x_lat", "x_lon", "x_idx", "x_alarmed"]
KEYS = "athlete_id string, session_id bigint, _chunk bigint"
ENTRY_SCHEMA = f"{KEYS}, known boolean, e_lat double, e_lon double, e_idx bigint, e_alarmed boolean"
EXIT_SCHEMA = f"{ENTRY_SCHEMA}, x_known boolean, x_lat double, x_lon double, x_idx bigint, x_alarmed boolean"
MAP_SCHEMA = f"{EXIT_SCHEMA}, placed boolean, wide boolean, lats array<double>, lons array<double>, pulse_idx bigint"
SWEPT_SCHEMA = f"{ENTRY_SCHEMA}, stale boolean"


def _stored(state: State | None) -> tuple:
    """A state as columns; a missing index is NULL."""
    return (False, None, None, None, None) if state is None else (True, *state[:2], None if state[2] != state[2] else int(state[2]), bool(state[3]))


def _loaded(values: tuple) -> State | None:
    known, lat, lon, index, alarmed = values
    return (lat, lon, math.nan if pd.isna(index) else int(index), bool(alarmed)) if known else None


def _piece(cfg: DetectorConfig, result: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Scan one piece from its entry: its ``alerts``, its ``exit``, or its whole ``map``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_index", na_position="first")
        entry = _loaded(tuple(pdf[c].iloc[0] for c in ENTRY))
        index, lat, lon, bpm = _arrays(pdf)
        state, alerts = scan_arrays(index, lat, lon, bpm, entry, cfg)
        if result == "alerts":
            rows = [(key[0], key[1], *a) for a in alerts]
            return pd.DataFrame(rows, columns=["athlete_id", "session_id", "sample_index", "still_for", *COLUMNS[1:]])
        row = [*key, *_stored(entry), *_stored(state)]
        names = [*SESSION, "_chunk", *ENTRY, *EXIT]
        if result == "map":
            at = ~(np.isnan(lat) | np.isnan(lon))
            pulse = index[at & (bpm > cfg.alarm_bpm) & ~pd.isna(index)]
            row += [bool(at.any()), *(hull(lat[at], lon[at], cfg) if at.any() else (False, [], [])), int(pulse.max()) if len(pulse) else None]
            names += ["placed", "wide", "lats", "lons", "pulse_idx"]
        return pd.DataFrame([row], columns=names)

    return run


def _sweep(cfg: DetectorConfig) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Entries of a session's pieces by their maps, in order; ``stale`` where the exit for that entry is only guessed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for m in pdf.sort_values("_chunk").to_dict("records"):
            entry, stale = state, False
            if m["placed"]:
                far = math.inf
                if entry is not None and cfg.move_m >= WORLD:
                    far = 0.0
                elif entry is not None and len(m["lats"]):
                    far = float(metres_between(entry[0], entry[1], m["lats"], m["lons"]).max())
                if far <= cfg.move_m - MARGIN:
                    raised = not pd.isna(m["pulse_idx"]) and m["pulse_idx"] - entry[2] >= cfg.still_index
                    state = (*entry[:3], entry[3] or raised)
                else:
                    stale = _stored(entry) != _stored(_loaded(tuple(m[c] for c in ENTRY)))
                    state = _loaded(tuple(m[c] for c in EXIT))
            out.append((m["athlete_id"], None if pd.isna(m["session_id"]) else m["session_id"], m["_chunk"], *_stored(entry), stale))
        return pd.DataFrame(out, columns=[*SESSION, "_chunk", *ENTRY, "stale"])

    return run


def _hot_alerts(big: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Alarms of hot sessions by rounds over their pieces. Starts jobs in each round. Missing keys are equal."""
    keys = [*SESSION, "_chunk"]

    def piece(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_g", group_key(keys))

    placed = dense_position(unique_events(big), SESSION, "sample_index")
    cut = written(chunk_with_halo(placed, cfg.hot.chunk_rows, 0).select(*keys, *COLUMNS), "stillness-pieces")

    def scanned(entries: DataFrame, result: str, schema: str) -> DataFrame:
        # one entry row per piece: bounded by hot rows / chunk_rows
        fed = piece(cut).join(F.broadcast(piece(entries).select("_g", *ENTRY)), "_g").drop("_g")
        return fed.groupBy(*keys).applyInPandas(_piece(cfg, result), schema)

    nothing = cut.select(*keys).distinct().select("*", F.lit(False).alias("known"), *[F.lit(None).cast(t).alias(c) for c, t in zip(ENTRY[1:], ("double", "double", "bigint", "boolean"), strict=True)])
    maps = written(scanned(nothing, "map", MAP_SCHEMA), "stillness-maps")
    while True:
        # a session's maps are one row per piece, so hot rows / chunk_rows of them
        swept = written(maps.groupBy(*SESSION).applyInPandas(_sweep(cfg), SWEPT_SCHEMA), "stillness-entries")
        stale = swept.where("stale").select(*keys, *ENTRY)
        if stale.isEmpty():
            return scanned(swept, "alerts", ALERT_SCHEMA)
        again = piece(scanned(stale, "exit", EXIT_SCHEMA)).select("_g", F.struct(*ENTRY, *EXIT).alias("_new"))
        shape = [c for c in maps.columns if c not in (*ENTRY, *EXIT)]
        newer = [F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in (*ENTRY, *EXIT)]
        maps = written(piece(maps).join(F.broadcast(again), "_g", "left").select(*shape, *newer), "stillness-maps")


def stillness_alerts(events: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """One row per alarm with its message.

    Starts a job to learn whether any session is hot (a count over the key columns).
    """
    slim = events.filter(F.col("event_type") == "sample").select(
        F.col("athlete_id").cast("string").alias("athlete_id"),
        F.col("session_id").cast("bigint").alias("session_id"),
        "timestamp",
        F.col("sample_index").cast("bigint").alias("sample_index"),
        *[F.col(c).cast("double").alias(c) for c in COLUMNS[1:]],
    )
    some_hot = not hot_keys(slim, SESSION, cfg.hot.max_rows).isEmpty()
    ordinary, big = split_hot(slim, SESSION, cfg.hot.max_rows) if some_hot else (slim, None)
    ordered = (
        unique_events(ordinary.repartition(*SESSION))
        .sortWithinPartitions(*SESSION, "sample_index")
        .select(*SESSION, *COLUMNS)
    )
    alerts = ordered.mapInPandas(_scan_partition(cfg), ALERT_SCHEMA)
    if big is not None:
        alerts = alerts.unionByName(_hot_alerts(big, cfg))
    message = alarm_text(*[F.col(c) for c in ("athlete_id", "still_for", "latitude", "longitude", "heart_rate_bpm")])
    return alerts.withColumn("message", message)
