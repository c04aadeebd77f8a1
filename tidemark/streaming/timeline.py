"""Structured streaming forms of timeline operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import fsm

#: The store that state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of gap sessions; rows later than the watermark are dropped. The
    session window of Spark joins rows at exactly the gap, and ends at the last row plus the gap."""
    rows = stream.withWatermark(ts, late)
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.select(key, "start", "end", "n")


def tumbling(stream: DataFrame, key: str, ts: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts of tumbling (or sliding) windows."""
    rows = stream.withWatermark(ts, late)
    at = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(key, at.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class TimedEvidence(fsm.Evidence):
    """The current machine by the clock: a pending start or end that no row settles by its limit
    is settled at its limit, and later rows meet the state that this leaves."""

    def deadline(self) -> float | None:
        """When the pending state ends by itself."""
        if self.state == fsm.OPENING:
            return self.pend["t"] + self.lim.opening_sec
        if self.state == fsm.CLOSING:
            return self.pend["t"] + min(self.lim.close_sec, self.lim.fresh_sec)
        return None

    def expire(self) -> None:
        """Settles the pending state at its deadline."""
        if self.state == fsm.OPENING:
            self.state = self.review(self.pend["t"], self.deadline(), "not confirmed in time")
        else:
            self.last_hard, self.span_from, self.span_rows = None, None, 0
            self.state = self.close(self.pend["why"], "high" if self.pend["why"] == "end support" else "medium")

    def step(self, i: int, row, after=None) -> None:
        if (until := self.deadline()) is not None and row.t > until:
            self.expire()
        super().step(i, row, after)


_COUNTED = ", ".join(f"n_{c} long" for c in fsm.COUNTS)
#: A machine between rows: where it is, what it waits on, and the interval it builds.
STATE = (
    "state string, i long, seen double, hard_at double, span_from double, span_rows int, pend_t double, pend_i long, pend_seen double, pend_why string, pend_cues long, "
    f"start double, reason string, confidence string, last double, n long, {_COUNTED}, opening_only boolean, fuzzy_only boolean, audio_only boolean, scene_only boolean, weak_from double, weak_span double, last_hard double, kinds int"
)
_FIELDS = [p.split()[0] for p in STATE.split(", ")]
_OUT = [p.split()[0] for p in fsm.SCHEMA.split(", ")]


def _kept(m: fsm.Evidence, i: int, seen: float) -> tuple:
    """The machine as a row of STATE."""
    o, p = m.now, m.pend
    out = dict.fromkeys(_FIELDS) | {"state": m.state, "i": i, "seen": seen, "hard_at": m.last_hard, "span_from": m.span_from, "span_rows": m.span_rows}
    if p:
        out |= {"pend_t": p["t"], "pend_i": p["i"], "pend_seen": p["row"].t, "pend_why": p["why"], "pend_cues": sum(1 << k for k, c in enumerate(fsm.CUES) if getattr(p["row"], c))}
    if o:
        out |= {"start": o.start, "reason": o.reason, "confidence": o.confidence, "last": o.end, "n": o.n, "weak_from": o.weak_from, "weak_span": o.weak_span, "last_hard": o.last_hard, "kinds": int(o.kinds)}
        out |= {f"n_{c}": int(n) for c, n in o.counts.items()} | o.any_ | o.all_
    return tuple(out[f] for f in _FIELDS)


def _revived(m: fsm.Evidence, held: tuple) -> fsm.Evidence:
    """The machine of a row of STATE."""
    s = dict(zip(_FIELDS, held, strict=True))
    m.state, m.last_hard, m.span_from, m.span_rows = s["state"], s["hard_at"], s["span_from"], s["span_rows"]
    if s["pend_t"] is not None:
        m.wait(s["pend_i"], fsm.row_of(s["pend_seen"], s["pend_cues"]), s["pend_why"], at=s["pend_t"])
    if s["start"] is not None:
        m.now = fsm.Open(s["start"], s["reason"], s["confidence"], s["last"], s["n"], {c: s[f"n_{c}"] for c in fsm.COUNTS}, {c: s[c] for c in ("opening_only", "fuzzy_only")}, {c: s[c] for c in ("audio_only", "scene_only")}, s["weak_from"], s["weak_span"], s["last_hard"], s["kinds"])
    return m


class Walker(StatefulProcessor):
    """A machine a key, kept as one row of typed state. One timer a key stands at whatever comes
    first: the deadline of a pending state, if the machine goes by the clock, or the idle time."""

    def __init__(self, key: str, limits: fsm.Limits, timed: bool, idle: float) -> None:
        self.key, self.limits, self.timed, self.idle = key, limits, timed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("machine", STATE)

    def _machine(self) -> tuple[fsm.Evidence, int, float]:
        m = (TimedEvidence if self.timed else fsm.Evidence)(self.limits, 0.0)
        if not self.held.exists():
            return m, 0, -math.inf
        held = tuple(self.held.get())
        return _revived(m, held), held[1], held[2]

    def _emitted(self, key: Any, m: fsm.Evidence) -> Iterator[Row]:
        for made in m.out:
            values = [int(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in made]
            yield Row(**dict(zip([self.key, *_OUT], [key, *values], strict=True)))

    def _wait(self, m: fsm.Evidence, i: int, seen: float) -> None:
        """Keeps the machine and sets the timer a millisecond after the time it is for."""
        self.held.update(_kept(m, i, seen))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        until = m.deadline() if self.timed else None
        at = seen + self.idle if until is None else min(until, seen + self.idle)
        self.handle.registerTimer(math.floor(at * 1000) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        m, i, seen = self._machine()
        for r in sorted(rows, key=lambda r: (r["t"], r["tie"])):  # a key's rows of one micro-batch
            m.step(i, fsm.row_of(r["t"], r["cues"]))
            i, seen = i + 1, max(seen, r["t"])
        self._wait(m, i, seen)
        yield from self._emitted(key[0], m)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.held.exists():
            return
        m, i, seen = self._machine()
        if self.timed and m.deadline() is not None and m.deadline() <= seen + self.idle:
            m.expire()
            self._wait(m, i, seen)
        else:
            m.finish(fsm.row_of(seen, 0))
            self.held.clear()
        yield from self._emitted(key[0], m)


def intervals(stream: DataFrame, key: str, ts: str, tie: str, limits: fsm.Limits | None = None, late: str = "1 hour", idle: str = "30 days", timed: bool = False) -> DataFrame:
    """Intervals of the current machine as its rows arrive: what closes or goes to review is
    emitted once. Rows of a micro-batch walk in order of time and tie; a row later than the
    watermark is dropped by Spark. A key without rows for idle time emits what is open and is
    forgotten. With timed, pending states end by the clock (TimedEvidence), by rows or by timers
    alike, so results do not depend on how rows fall into micro-batches."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.withWatermark(ts, late).select(F.col(key).alias("key"), ts, (F.unix_micros(ts) / 1e6).alias("t"), F.col(tie).alias("tie"), fsm.cue_mask(stream).alias("cues"))
    kind = dict(rows.dtypes)["key"]
    walker = Walker(key, limits or fsm.Limits(), timed, pd.Timedelta(idle).total_seconds())
    return rows.groupBy("key").transformWithState(walker, f"`{key}` {kind}, {fsm.SCHEMA}", "Append", "EventTime")
