"""Real-time detector: stillness alarms and session summaries from one keyed state.

A micro-batch brings few samples per session, so sessions are dealt into buckets by hash and a bucket's sessions are advanced
together: repeats are dropped, distances, speeds and sums computed in NumPy over all of them, and only the anchor is
moved session by session. A bucket's state goes to its task with the data: one record per open session, and the events that
the watermark has not passed, for two uses. A sample delivered again is known by them, and with ``in_order`` they wait
there, so that samples count in event order whatever the order of the batches that brought them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paceframe.config import DetectorConfig
from paceframe.functions.text import alarm_text
from paceframe.operators.stillness import metres_between, scan_arrays

OUTPUT = (
    "kind string, athlete_id string, session_id bigint, sample_index bigint, still_for bigint, latitude double, "
    "longitude double, heart_rate_bpm double, velocita_media double, velocita_max double, "
    "frequenza_cardiaca_media double, frequenza_cardiaca_max double, cadenza_media double, distanza_totale double, "
    "campioni bigint, durata_s double, end_reason string"
)
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
STATE = "sessions binary, held binary"
#: What an open session is known by: sums so far, its last placed sample and its anchor. NaN and the flags mark what is missing.
TOTALS = np.dtype([
    ("n", "i8"), ("sum_hr", "f8"), ("max_hr", "f8"), ("n_cad", "i8"), ("sum_cad", "f8"), ("n_speed", "i8"), ("sum_speed", "f8"), ("max_speed", "f8"),
    ("distance", "f8"), ("last_ms", "i8"), ("begun", "?"), ("last_idx", "i8"), ("last_lat", "f8"), ("last_lon", "f8"),
    ("anchored", "?"), ("anchor_lat", "f8"), ("anchor_lon", "f8"), ("anchor_idx", "i8"), ("alarmed", "?"),
])
#: A sample or end marker; a missing index is NO_INDEX, a missing number NaN. ``owner`` is its session's place in the bucket.
EVENT = np.dtype([("owner", "i8"), ("ms", "i8"), ("index", "i8"), ("end", "?"), ("lat", "f8"), ("lon", "f8"), ("bpm", "f8"), ("cadence", "f8")])
NO_INDEX = -(1 << 62)


def fresh(n: int) -> np.ndarray:
    """Sessions before their first sample."""
    out = np.zeros(n, TOTALS)
    for name in ("max_hr", "max_speed", "last_lat", "last_lon"):
        out[name] = np.nan
    return out


def _events(frame: pd.DataFrame) -> np.ndarray:
    """A frame of the stream as :data:`EVENT` records, their owners unknown."""
    out = np.empty(len(frame), EVENT)
    out["ms"], out["end"] = frame["event_ms"].to_numpy(), frame["is_end"].to_numpy(bool)
    out["index"] = frame["sample_index"].fillna(NO_INDEX).to_numpy(np.int64)
    for name, column in (("lat", "latitude"), ("lon", "longitude"), ("bpm", "heart_rate_bpm"), ("cadence", "cadence_spm")):
        out[name] = frame[column].to_numpy(np.float64, na_value=np.nan)
    return out


def _ordered(events: np.ndarray) -> np.ndarray:
    """Places of the events by session, time, index and kind; stable."""
    return np.lexsort((events["end"], events["index"], events["ms"], events["owner"]))


def without_known(events: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Events in order, the first of each session, time, index and kind, without those in ``known``."""
    rows = np.concatenate((known, events))
    order = _ordered(rows)  # stable, so what is known comes first
    rows = rows[order]
    first = np.ones(len(rows), bool)
    if len(rows) > 1:
        first[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("owner", "ms", "index", "end")], axis=0)
    return rows[first & (order >= len(known))]


def absorb(totals: np.ndarray, rows: np.ndarray, cfg: DetectorConfig) -> list[tuple]:
    """Count samples, sorted by ``owner`` (their place in ``totals``) and in the order in which they come; returns the alarms as
    (owner, index, still_for, latitude, longitude, heart rate).

    A sample not newer than those before (late, or a repeated index) counts towards heart rate and cadence but has no
    speed and does not touch the anchor.
    """
    if not len(rows):
        return []
    own, size = rows["owner"], len(totals)
    totals["n"] += np.bincount(own, minlength=size)
    totals["sum_hr"] += np.bincount(own, rows["bpm"], size)
    np.fmax.at(totals["max_hr"], own, rows["bpm"])
    paced = ~np.isnan(rows["cadence"])
    totals["n_cad"] += np.bincount(own[paced], minlength=size)
    totals["sum_cad"] += np.bincount(own[paced], rows["cadence"][paced], size)
    np.maximum.at(totals["last_ms"], own, rows["ms"])
    # newer than all before in its session: ranks of the indexes, shifted per session, have a running maximum over all rows
    ranks = np.unique(np.concatenate((rows["index"], totals["last_idx"][own])), return_inverse=True)[1]
    rank, last = ranks[: len(rows)], np.where(totals["begun"][own], ranks[len(rows) :], -1)
    begins = np.append(True, own[1:] != own[:-1])
    width = int(ranks.max()) + 2
    top = np.maximum.accumulate(own * width + np.maximum(rank, last))
    before = np.where(begins, last, np.append(-1, top[:-1] - own[:-1] * width))
    rows = rows[rank > before]
    if not len(rows):
        return []
    own = rows["owner"]
    begins = np.append(True, own[1:] != own[:-1])
    held = totals[own]
    lat, lon, index = (np.where(begins, held[f"last_{f}"], np.append(0, rows[g][:-1])) for f, g in (("lat", "lat"), ("lon", "lon"), ("idx", "index")))
    step = metres_between(lat, lon, rows["lat"], rows["lon"])
    moved = ~np.isnan(step)
    to, step = own[moved], step[moved]
    speed = step / ((rows["index"][moved] - index[moved]) * cfg.seconds_per_index)
    totals["distance"] += np.bincount(to, step, size)
    totals["n_speed"] += np.bincount(to, minlength=size)
    totals["sum_speed"] += np.bincount(to, speed, size)
    np.fmax.at(totals["max_speed"], to, speed)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(rows))
    final = rows[ends - 1]
    placed = ~(np.isnan(final["lat"]) | np.isnan(final["lon"]))
    at = final["owner"]
    totals["begun"][at], totals["last_idx"][at] = True, final["index"]
    totals["last_lat"][at], totals["last_lon"][at] = np.where(placed, final["lat"], np.nan), np.where(placed, final["lon"], np.nan)
    alarms = []
    for owner, begin, end in zip(at.tolist(), starts.tolist(), ends.tolist(), strict=True):
        t, some = totals[owner], rows[begin:end]
        anchor = (float(t["anchor_lat"]), float(t["anchor_lon"]), int(t["anchor_idx"]), bool(t["alarmed"])) if t["anchored"] else None
        anchor, raised = scan_arrays(some["index"], some["lat"], some["lon"], some["bpm"], anchor, cfg)
        alarms += [(owner, *alarm) for alarm in raised]
        if anchor is not None:
            t["anchored"], t["anchor_lat"], t["anchor_lon"], t["anchor_idx"], t["alarmed"] = True, *anchor
    return alarms


def _alerts(keys: pd.DataFrame, alarms: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(alarms, columns=["owner", "sample_index", "still_for", "latitude", "longitude", "heart_rate_bpm"])
    return pd.concat([keys.iloc[found.pop("owner")].reset_index(drop=True), found], axis=1).assign(kind="alert").reindex(columns=NAMES)


def summaries(keys: pd.DataFrame, totals: np.ndarray, reason: str, cfg: DetectorConfig) -> pd.DataFrame:
    """Means, maxima and totals of closed sessions; means are NULL without samples."""

    def mean(total: str, n: str) -> np.ndarray:
        return np.divide(totals[total], totals[n], out=np.full(len(totals), np.nan), where=totals[n] > 0)

    values = {
        "velocita_media": mean("sum_speed", "n_speed"), "velocita_max": totals["max_speed"], "frequenza_cardiaca_media": mean("sum_hr", "n"),
        "frequenza_cardiaca_max": totals["max_hr"], "cadenza_media": mean("sum_cad", "n_cad"), "distanza_totale": totals["distance"],
        "campioni": totals["n"], "durata_s": totals["n"] * cfg.sample_period_s,
    }
    return keys.reset_index(drop=True).assign(kind="summary", end_reason=reason, **values).reindex(columns=NAMES)


def advance(
    keys: pd.DataFrame, totals: np.ndarray, rows: np.ndarray, cfg: DetectorConfig, idle_ms: int | None = None
) -> tuple[np.ndarray, list[pd.DataFrame]]:
    """The sessions after these events, sorted by session and in the order in which they count, and the output.

    An end marker closes its session, which may begin again, and so does a gap of ``idle_ms``: what lies between is a part of its
    own, and all parts are counted at once.
    """
    if not len(rows):
        return totals, []
    idle_ms = idle_ms or 1 << 62
    same = rows["owner"][1:] == rows["owner"][:-1]
    late = same & ~rows["end"][:-1] & (np.diff(rows["ms"]) >= idle_ms)
    begins = np.append(True, ~same | rows["end"][:-1] | late)
    starts = np.flatnonzero(begins)
    part = np.cumsum(begins) - 1
    owner = rows["owner"][starts]
    first = np.append(True, owner[1:] != owner[:-1])
    parts = fresh(len(starts))
    parts[first] = totals[owner[first]]
    out = []
    lapsed = (parts["n"] > 0) & (rows["ms"][starts] - parts["last_ms"] >= idle_ms)
    if lapsed.any():
        out.append(summaries(keys.iloc[owner[lapsed]], parts[lapsed], "timeout", cfg))
        parts[lapsed] = fresh(int(lapsed.sum()))
    closed, over = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    closed[part[rows["end"]]] = True
    over[part[:-1][late]] = True
    samples = rows[~rows["end"]].copy()
    samples["owner"] = part[~rows["end"]]
    alarms = absorb(parts, samples, cfg)
    if alarms:
        out.append(_alerts(keys, [(int(owner[a[0]]), *a[1:]) for a in alarms]))
    for which, reason in ((closed, "session_end"), (over, "timeout")):
        if which.any():
            out.append(summaries(keys.iloc[owner[which]], parts[which], reason, cfg))
    final = np.append(owner[1:] != owner[:-1], True)
    totals = totals.copy()
    totals[owner[final]] = np.where(closed[final], fresh(int(final.sum())), parts[final])
    return totals, out


def _packed(keys: pd.DataFrame, totals: np.ndarray) -> bytes:
    """Sessions as one Arrow record batch."""
    table = pa.table({"athlete_id": pa.array(keys["athlete_id"], pa.string()), "session_id": pa.array(keys["session_id"], pa.int64()), "totals": pa.array([t.tobytes() for t in totals], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> tuple[pd.DataFrame, np.ndarray]:
    table = pa.ipc.open_stream(raw).read_all()
    keys = pd.DataFrame({"athlete_id": table.column("athlete_id").to_pandas(), "session_id": table.column("session_id").to_pandas().astype("Int64")})
    return keys, np.frombuffer(b"".join(table.column("totals").to_pylist()), TOTALS)


def _bucket(cfg: DetectorConfig, in_order: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    idle_ms = int(pd.Timedelta(cfg.idle_timeout).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        keys, totals, known = pd.DataFrame({"athlete_id": [], "session_id": []}), fresh(0), np.empty(0, EVENT)
        if state.exists:
            (keys, totals), known = _unpacked(bytes(state.get[0])), np.frombuffer(bytes(state.get[1]), EVENT)
        arrived = list(frames)
        new = np.concatenate([np.empty(0, EVENT), *map(_events, arrived)])
        if len(new):
            names = pd.concat([keys, *(f[["athlete_id", "session_id"]] for f in arrived)], ignore_index=True)
            names["session_id"] = names["session_id"].astype("Int64")
            place = names.groupby(["athlete_id", "session_id"], sort=False, dropna=False).ngroup().to_numpy()
            new["owner"] = place[len(keys) :]
            old, keys = len(keys), names.loc[~pd.Series(place).duplicated()].reset_index(drop=True)
            totals = np.concatenate((totals, fresh(len(keys) - old)))
            new = without_known(new, known)
        held = np.concatenate((known, new))
        due = held["ms"] < mark
        ready = held[due][_ordered(held[due])] if in_order else new
        totals, out = advance(keys, totals, ready, cfg, idle_ms if in_order else None)
        held = held[~due]
        waiting = np.bincount(held["owner"], minlength=len(keys)) > 0
        idle = (totals["n"] > 0) & (totals["last_ms"] + idle_ms <= mark)
        if idle.any():
            out.append(summaries(keys[idle], totals[idle], "timeout", cfg))
            totals = totals.copy()
            totals[idle] = fresh(int(idle.sum()))
        stay = (totals["n"] > 0) | waiting
        if stay.any():
            held = held.copy()
            held["owner"] = (np.cumsum(stay) - 1)[held["owner"]]
            keys, totals = keys[stay], totals[stay]
            waits = (totals["last_ms"] + idle_ms)[totals["n"] > 0].tolist()
            if len(held):
                waits.append(int(held["ms"].min() if in_order else held["ms"].max()) + 1)
            state.update((_packed(keys, totals), held.tobytes()))
            state.setTimeoutTimestamp(max(min(waits), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    return run


def detect(events: DataFrame, cfg: DetectorConfig = DetectorConfig(), late_by: str = "10 minutes", in_order: bool = False) -> DataFrame:
    """Tagged rows (``kind`` alert or summary) from a stream of canonical events with ``event_time``.

    Keyed by athlete and session, so the result does not depend on the broker's message key. A sample delivered again
    within the lateness bound is dropped first, as in the batch summary. The end marker emits the summary and clears the state; a
    session without one is closed once the watermark passes its last sample by the idle timeout. ``cfg.buckets`` is part of the
    checkpoint: it may not change while a query lives.

    Events of one micro-batch are put in event order. By default an event takes effect in the batch that brings it: alarms are prompt,
    and a sample overtaken by a later batch has no speed and no distance. With ``in_order`` events wait in the state until the
    watermark passes them, so any order within the lateness bound gives the rows of the batch operators; alarms and summaries
    then come later by that bound, and every gap of the idle timeout closes a session.
    """
    owner = F.pmod(F.xxhash64("athlete_id", "session_id"), F.lit(cfg.buckets)).cast("int")
    slim = events.withWatermark("event_time", late_by).select(
        owner.alias("bucket"), "athlete_id", F.col("session_id").cast("bigint").alias("session_id"), "event_time", F.unix_millis("event_time").alias("event_ms"),
        (F.col("event_type") == "session_end").alias("is_end"), "sample_index", "latitude", "longitude",
        "heart_rate_bpm", "cadence_spm",
    )
    tagged = slim.groupBy("bucket").applyInPandasWithState(_bucket(cfg, in_order), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    message = alarm_text(*[F.col(c) for c in ("athlete_id", "still_for", "latitude", "longitude", "heart_rate_bpm")])
    return tagged.withColumn("message", F.when(F.col("kind") == "alert", message))
