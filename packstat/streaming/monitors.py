"""Online monitors of running simulations, as streaming queries over arriving steps.

Monitors keep what they must remember of a run in Spark's keyed state: a few numbers, the last steps, and steps that came before
their turn. A step waits until all steps before it have come, in whatever triggers, or until the watermark has passed its own
time; then a gap before it is given up. State and results of a trigger are committed together by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packstat.operators.rules import distribution_problems
from packstat.operators.telemetry import LEGAL_MARGIN, STAGNATION_PERCENT, STAGNATION_STEPS
from packstat.sources.corpus import headers_from, parse_lines, phases_from

STATE = "taken bigint, tail binary, held binary, facts binary"


@dataclass(frozen=True)
class Monitor:
    """What a monitor reads of a step, how many earlier steps it looks back on, what it starts from, and its judgment.

    ``judge(steps, values, new, facts)`` gets the steps in order, the looked-back ones first and ``new`` the place of the first
    new one, ``values`` with a row per column. It gives arrays of ``fields`` for the new steps, and the facts to go on with.
    """

    columns: Sequence[str]
    back: int
    start: Sequence[int]
    fields: str
    judge: Callable[[np.ndarray, np.ndarray, int, list[int]], tuple[dict[str, np.ndarray], list[int]]]


def _as_rows(batch: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Step, time in milliseconds, values: a row of doubles per step."""
    return np.column_stack([batch[c].to_numpy(float) for c in ("step", "_at", *columns)])


def _events(**found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps and names of the events, name by name."""
    return np.concatenate(list(found.values())), np.repeat(np.array(list(found), object), [len(x) for x in found.values()])


def monitored(steps: DataFrame, monitor: Monitor, late: str) -> DataFrame:
    """Events of a stream of steps (``sample_id, step, ts`` and the monitor's columns), each run in the order of its steps.

    Steps count from 0; one that is sent again is taken once; one that comes after its place was given up is dropped, as are
    rows older than the watermark and rows without step or time. A run is one key of Spark's state: its rows of one trigger meet in one task, and the source's
    limit per trigger bounds them.
    """
    key_type, width = steps.schema["sample_id"].dataType.simpleString(), 2 + len(monitor.columns)
    unpack = lambda raw: np.frombuffer(bytes(raw), float).reshape(-1, width)
    fields = ["sample_id", *[f.strip().split()[0] for f in monitor.fields.split(",")]]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken, tail, held, facts = -1, np.zeros((0, width)), np.zeros((0, width)), list(monitor.start)
        if state.exists:
            taken, tail, held, facts = state.get
            tail, held, facts = unpack(tail), unpack(held), np.frombuffer(bytes(facts), "int64").tolist()
        rows = np.concatenate([held, *[_as_rows(batch, monitor.columns) for batch in batches]])
        rows = rows[rows[:, 0] > taken]
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.diff(rows[:, 0], prepend=-1) > 0]
        passed = state.getCurrentWatermarkMs()
        waits = (np.diff(rows[:, 0], prepend=taken) != 1) & (rows[:, 1] > passed)
        ready = int(np.argmax(waits)) if waits.any() else len(rows)
        now, held = rows[:ready], rows[ready:]
        found = None
        if len(now):
            seen = np.concatenate([tail, now])
            found, facts = monitor.judge(seen[:, 0].astype("int64"), seen[:, 2:].T, len(tail), facts)
            taken, tail = int(now[-1, 0]), seen[len(seen) - min(monitor.back, len(seen)):]
        state.update((taken, tail.tobytes(), held.tobytes(), np.array(facts, "int64").tobytes()))
        if len(held):
            state.setTimeoutTimestamp(int(max(held[0, 1], passed)) + 1)
        if found is not None and len(found["step"]):
            yield pd.DataFrame({"sample_id": key[0], **found})[fields]

    timed = steps.where("step IS NOT NULL AND ts IS NOT NULL").select(
        "sample_id", "step", "ts", F.unix_millis("ts").alias("_at"), *monitor.columns)
    return (timed.withWatermark("ts", late).groupBy("sample_id")
            .applyInPandasWithState(advance, f"sample_id {key_type}, {monitor.fields}", STATE, "append", GroupStateTimeout.EventTimeTimeout))


def run_monitor(max_residue: float, max_steps_to_relax: int, n: int = STAGNATION_STEPS,
                percent: float = STAGNATION_PERCENT) -> Monitor:
    """``finished`` when the legal streak passes its limit, ``failed`` when n steps stood still.

    Facts: the last illegal step, the last step that moved.
    """
    def judge(steps: np.ndarray, values: np.ndarray, new: int, facts: list[int]) -> tuple[dict[str, np.ndarray], list[int]]:
        overlap = values[0]
        before = np.concatenate([[np.nan], overlap[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.where(before == 0, np.inf, np.abs(overlap - before) / np.abs(before) * 100)
        steps, bad, still = steps[new:], overlap[new:] > max_residue + LEGAL_MARGIN, change[new:] < percent
        last_bad = np.maximum.accumulate(np.where(bad, steps, facts[0]))
        last_moved = np.maximum.accumulate(np.where(still, facts[1], steps))
        legal, quiet = steps - last_bad, steps - last_moved
        done, failed = legal > max_steps_to_relax, (steps > n) & (quiet >= n)
        at, event = _events(finished=steps[done], failed=steps[failed])
        return {"step": at, "event": event, "streak": np.concatenate([legal[done], quiet[failed]])}, [int(last_bad[-1]), int(last_moved[-1])]

    return Monitor(["total_overlap"], 1, [-1, -1], "step bigint, event string, streak bigint", judge)


def equilibrium_monitor(window: int, k: int = 2, m: int | None = None) -> Monitor:
    """Rises over the overlap ``window`` steps ago (``rolling``), every k-th crossing of one by the ratio (``ratio``) and, where
    ``m`` is given, the criterion whose wait lengthens itself (``original``).

    Facts: crossings so far; the wait, the step it lasts to and the last rise of the third criterion.
    """
    def judge(steps: np.ndarray, values: np.ndarray, new: int, facts: list[int]) -> tuple[dict[str, np.ndarray], list[int]]:
        overlap, ratio = values
        crossed, wait, due, last = facts
        ago = np.concatenate([np.full(window, np.nan), overlap])[:len(overlap)]
        crossing = ((ratio - 1) * (np.concatenate([[np.nan], ratio[:-1]]) - 1) <= 0)[new:]
        rises = (overlap > np.concatenate([[np.nan], overlap[:-1]]))[new:]
        steps, rolling = steps[new:], (overlap > ago)[new:]
        counts = crossed + np.cumsum(crossing)
        risen, events = np.maximum.accumulate(np.where(rises, steps, last)), []
        if m is not None:
            up = np.flatnonzero(rises)
            at = int(np.searchsorted(steps, due + 1))
            while at < len(steps):
                if risen[at] < 0 or risen[at] <= steps[at] - (wait + 1) // 2:
                    later = int(np.searchsorted(up, at))
                    if later == len(up):
                        break
                    at = int(up[later])
                events.append(int(steps[at]))
                wait += events[-1] - due - 1
                due = events[-1] + wait
                at = int(np.searchsorted(steps, due + 1))
        at, event = _events(rolling=steps[rolling], ratio=steps[crossing & (counts % k == 0)], original=np.array(events, "int64"))
        return {"step": at, "event": event}, [int(counts[-1]), wait, due, int(risen[-1])]

    return Monitor(["total_overlap", "ratio"], max(window, 1), [0, m or 0, m or 0, -1], "step bigint, event string", judge)


def windowed_telemetry(steps: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Event-time windows of overlap per run; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = (steps.withWatermark("ts", late).groupBy(window.alias("_w"), "sample_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("total_overlap").alias("overlap"),
                F.max("total_overlap").alias("largest")))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "sample_id", "n", "overlap", "largest")


def session_activity(steps: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Stretches of activity of a run: one silent for longer than the gap is over."""
    out = (steps.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("_w"), "sample_id")
           .agg(F.count(F.lit(1)).alias("n")))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "sample_id", "n")


def dedup_steps(steps: DataFrame, late: str = "1 hour") -> DataFrame:
    """Steps sent again after a restart, once."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sample_id", "step"])


def stream_quality(lines: DataFrame) -> DataFrame:
    """Problems of distributions in arriving documents; stateless, line by line (``sample_id, value``)."""
    return distribution_problems(phases_from(parse_lines(lines))[1])


def header_quality(lines: DataFrame) -> DataFrame:
    """Headers of the documents of one micro-batch, for use inside ``foreachBatch``."""
    return headers_from(parse_lines(lines))


def closing_event(events: DataFrame, after: str = "30 days") -> DataFrame:
    """One row of nulls, timed ``after`` the last event: sent last, it lets every open window and session come out.

    ``after`` must be longer than a window or gap and the watermark together. The mark's own
    window never closes; where it could, it is known by its null ``sample_id``.
    """
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).cast(events.schema["ts"].dataType).alias("ts"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
    return last.where("ts IS NOT NULL").select("ts", *rest).select(*events.columns)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drive a stream over everything there is, into Parquet."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
