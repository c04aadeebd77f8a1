"""Interval state machines over a key's rows in time order.

Six machines share one frame: rows carry boolean cues, a machine walks them through the states
outside, opening, inside, closing, and every interval that closes, is left open, or goes to
review becomes one output row with its counted evidence. Rows are narrow (a time and a mask of
cues) and sorted by key and time by Spark, which spills; a task walks them as they stream by and
holds one machine and one Arrow batch, so a key may have any number of rows. Scores, filters and
details are joins and projections on the output (tidemark.operators.scoring).
"""

from __future__ import annotations

import functools
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTSIDE, OPENING, INSIDE, CLOSING = "outside", "opening", "inside", "closing"

#: Cues that a row may carry; one that is absent is false.
CUES = (
    "hard", "start_support", "continuity", "end_support", "weak", "opening_only", "fuzzy_only", "audio_only", "scene_only", "audio", "ocr_hard",
    "recent_hard", "strong", "support", "known_low", "conflict", "start_high", "start_medium", "audio_start", "unreliable", "text", "product", "rise", "confirm", "kind_product", "kind_call",
)
#: A row as machines see it; it pickles, so that a stream can keep the one it waits on.
Row = namedtuple("Row", ["t", *CUES])
COUNTS = ("hard", "start_support", "continuity", "end_support", "weak", "ocr_hard", "recent_hard", "audio")
SCHEMA = "kind string, start double, end double, start_reason string, end_reason string, confidence string, n_rows long, " + ", ".join(f"n_{c} long" for c in COUNTS) + ", weak_span double, opening_only boolean, fuzzy_only boolean, audio_only boolean, scene_only boolean, kinds long"


@dataclass
class Limits:
    """Limits of all machines, in seconds and rows."""

    opening_sec: float = 12.0
    opening_rows: int = 2
    fresh_sec: float = 30.0
    support_sec: float = 12.0
    support_rows: int = 2
    close_sec: float = 20.0
    closing_rows: int = 3
    shortest: float = 20.0
    early_sec: float = 30.0
    long_sec: float = 120.0
    long_ratio: float = 0.3
    unresolved_sec: float = 180.0
    rejected_sec: float = 300.0
    rejected_density: float = 0.2
    recent_rows: int = 5
    recent_sec: float = 60.0
    text_rows: int = 3
    text_sec: float = 40.0
    bridge_sec: float = 10.0
    bridge_both_sec: float = 20.0


@dataclass
class Open:
    """An interval being built and the evidence it has taken in."""

    start: float
    reason: str
    confidence: str
    end: float = 0.0
    n: int = 0
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    any_: dict[str, bool] = field(default_factory=lambda: {"opening_only": False, "fuzzy_only": False})
    all_: dict[str, bool] = field(default_factory=lambda: {"audio_only": True, "scene_only": True})
    weak_from: float | None = None
    weak_span: float = 0.0
    last_hard: float | None = None
    kinds: int = 0

    def take(self, row) -> Open:
        self.end = row.t
        self.n += 1
        for c in COUNTS:
            self.counts[c] += getattr(row, c)
        for c in self.any_:
            self.any_[c] |= getattr(row, c)
        for c in self.all_:
            self.all_[c] &= getattr(row, c)
        self.kinds = max(self.kinds, row.kind_product + row.kind_call)
        # From the first weak row of a run to its last; a run that the interval ends with counts too.
        if row.weak:
            self.weak_from = row.t if self.weak_from is None else self.weak_from
            self.weak_span = max(self.weak_span, row.t - self.weak_from)
        else:
            self.weak_from = None
        if row.hard:
            self.last_hard = row.t
        return self


class Machine:
    """Common walk: subclasses answer one row in each state and return the next state."""

    def __init__(self, limits: Limits, duration: float) -> None:
        self.lim, self.duration = limits, duration
        self.state, self.now, self.pend, self.after = OUTSIDE, None, None, None
        self.out: list[tuple] = []
        self.trace: list[tuple] = []

    def emit(self, kind: str, start: float, end: float, why: str, made: Open | None = None, confidence: str = "") -> None:
        o = made or Open(start, "", "")
        self.out.append((kind, start, end, o.reason, why, confidence or o.confidence, o.n, *(o.counts[c] for c in COUNTS), o.weak_span, o.any_["opening_only"], o.any_["fuzzy_only"], bool(o.n) and o.all_["audio_only"], bool(o.n) and o.all_["scene_only"], o.kinds))

    def review(self, start: float, end: float, why: str) -> str:
        self.emit("review", start, end, why)
        self.pend = None
        return OUTSIDE

    def wait(self, i: int, row, why: str, at: float | None = None) -> None:
        self.pend = {"t": row.t if at is None else at, "i": i, "seen": row.t, "why": why, "row": row, "low": int(row.known_low), "conflict": int(row.conflict)}

    def close(self, why: str, confidence: str, later_only: bool = False) -> str:
        at = self.pend["t"]
        if not later_only or at > self.now.start:
            self.emit("closed", self.now.start, at, why, self.now, confidence)
        self.now = self.pend = None
        return OUTSIDE

    def resume(self) -> str:
        self.pend = None
        return INSIDE

    def walk(self, rows: list) -> Machine:
        """Walks all rows of a key and ends."""
        for i, row in enumerate(rows):
            self.step(i, row, rows[i + 1] if i + 1 < len(rows) else None)
        if rows:
            self.finish(rows[-1])
        return self

    def step(self, i: int, row, after=None) -> None:
        """Walks row number i; after is the row that follows, if there is one."""
        before, seen = self.state, len(self.out)
        self.before(row)
        if self.state != OUTSIDE or before == OUTSIDE:
            self.after = after
            self.state = getattr(self, self.state)(i, row)
        self.trace.append((row.t, before, self.state, self.out[-1][4] if len(self.out) > seen else (self.pend or {}).get("why", "")))

    def finish(self, last) -> None:
        """Ends after the last row."""
        if self.now is not None:
            self.left_open(last)

    def before(self, row) -> None:
        """Happens before every row, whatever the state."""

    def left_open(self, last) -> None:
        self.emit("open", self.now.start, last.t, "end of rows", self.now)


class Evidence(Machine):
    """Hard evidence opens; support alone waits for it; freshness and support caps close."""

    def __init__(self, limits: Limits, duration: float) -> None:
        super().__init__(limits, duration)
        self.last_hard = self.span_from = None
        self.span_rows = 0

    def before(self, row) -> None:
        if row.hard:
            self.last_hard, self.span_from, self.span_rows = row.t, None, 0
        elif row.start_support or row.continuity:
            self.span_from = row.t if self.span_from is None else self.span_from
            self.span_rows += 1

    def outside(self, i: int, row) -> str:
        if row.opening_only:
            return self.review(row.t, row.t, "opening notice")
        if row.hard:
            self.now = Open(row.t, "hard evidence", "high").take(row)
            return INSIDE
        if row.start_support and not row.audio_only and not row.scene_only:
            self.wait(i, row, "start support")
            return OPENING
        return OUTSIDE

    def opening(self, i: int, row) -> str:
        p = self.pend
        if row.hard:
            self.now = Open(p["t"], "support confirmed by hard evidence", "medium")
            self.now.take(p["row"]).take(row)
            self.pend = None
            return INSIDE
        if row.end_support:
            return self.review(p["t"], row.t, "cancelled by end support")
        if row.t - p["t"] > self.lim.opening_sec or i - p["i"] + 1 > self.lim.opening_rows:
            return self.review(p["t"], row.t, "not confirmed in time")
        return OPENING

    def inside(self, i: int, row) -> str:
        self.now.take(row)
        stale = row.t - (self.now.start if self.last_hard is None else self.last_hard) > self.lim.fresh_sec
        capped = self.span_from is not None and row.t - self.span_from > self.lim.support_sec and self.span_rows > self.lim.support_rows
        if (row.end_support and not row.hard) or stale or capped:
            self.wait(i, row, "end support" if row.end_support else "freshness" if stale else "support cap")
            return CLOSING
        return INSIDE

    def closing(self, i: int, row) -> str:
        if row.hard or (row.continuity and not row.end_support):
            self.now.take(row)
            return self.resume()
        if row.end_support or row.t - self.pend["t"] >= min(self.lim.close_sec, self.lim.fresh_sec):
            self.last_hard, self.span_from, self.span_rows = None, None, 0
            return self.close(self.pend["why"], "high" if self.pend["why"] == "end support" else "medium")
        return CLOSING


class StrictEvidence(Machine):
    """The earlier form. A start waits for hard evidence within a time and a number of rows, and
    end support does not cancel it; weak, sound or scene rows alone go to review. Freshness, the
    support cap or end support, on a hard row too, make an end wait, and only hard evidence
    resumes. What is left open is reported open, and when long as unresolved besides. Weak spans
    count from the first weak row, though it came before the interval."""

    def __init__(self, limits: Limits, duration: float) -> None:
        super().__init__(limits, duration)
        self.last_hard = self.span_from = self.weak_since = None
        self.span_rows = 0

    def before(self, row) -> None:
        if row.hard:
            self.last_hard, self.span_from, self.span_rows = row.t, None, 0
        elif row.start_support or row.continuity:
            self.span_from = row.t if self.span_from is None else self.span_from
            self.span_rows += 1
        if not row.weak:
            self.weak_since = None
        elif self.weak_since is None:
            self.weak_since = row.t

    def outside(self, i: int, row) -> str:
        if row.opening_only:
            return self.review(row.t, row.t, "opening notice")
        if row.hard:
            self.now = Open(row.t, "hard evidence", "high").take(row)
            return INSIDE
        if row.start_support or row.continuity:
            self.wait(i, row, "support")
            return OPENING
        if row.fuzzy_only or row.audio_start or not row.weak:
            return self.review(row.t, row.t, "weak, sound or scene alone")
        return OUTSIDE

    def opening(self, i: int, row) -> str:
        p = self.pend
        late = row.t - p["t"] > self.lim.opening_sec or i - p["i"] > self.lim.opening_rows
        if late:
            return self.review(p["t"], row.t, "not confirmed in time")
        if row.hard:
            self.now = Open(p["t"], "support confirmed by hard evidence", "medium").take(row)
            self.now.n += 1
            self.now.counts["start_support"] += 1
            self.pend = None
            return INSIDE
        return OPENING

    def inside(self, i: int, row) -> str:
        span = self.now.weak_span
        self.now.take(row)
        self.now.weak_span = max(span, 0.0 if self.weak_since is None else row.t - self.weak_since)
        stale = row.t - (self.now.start if self.last_hard is None else self.last_hard) > self.lim.fresh_sec
        capped = self.span_from is not None and row.t - self.span_from > self.lim.support_sec and self.span_rows >= self.lim.support_rows
        if stale or capped or row.end_support:
            self.wait(i, row, "freshness or low flow")
            return CLOSING
        return INSIDE

    def closing(self, i: int, row) -> str:
        if row.hard:
            return self.resume()
        timed = row.t - self.pend["t"] >= self.lim.close_sec
        if timed or row.end_support:
            self.last_hard, self.span_from, self.span_rows = None, None, 0
            return self.close("no hard evidence in time" if timed else "low flow", "medium" if timed else "high")
        return CLOSING

    def left_open(self, last) -> None:
        super().left_open(last)
        if last.t - self.now.start > self.lim.unresolved_sec:
            self.emit("unresolved", self.now.start, last.t, "long, left open", self.now)


def _level_start(machine: Machine, i: int, row, guarded: bool) -> str:
    """Text levels and sound open: shared by the three machines that start so."""
    if row.conflict:
        return OUTSIDE
    if row.start_high or row.start_medium or (row.unreliable and row.audio_start):
        if guarded and row.start_high and row.t <= machine.lim.early_sec and not (row.product or row.rise):
            return machine.review(row.t, row.t, "early notice")
        machine.wait(i, row, "text high" if row.start_high else "text medium" if row.start_medium else "sound alone")
        return OPENING
    return OUTSIDE


class Support(Machine):
    """Starts need a named pattern; hard evidence keeps an interval, support only for a while,
    weak context never. What is left open splits into open, unresolved and rejected."""

    def __init__(self, limits: Limits, duration: float) -> None:
        super().__init__(limits, duration)
        self.span_from, self.span_rows = None, 0

    def _support(self, row) -> None:
        self.span_from, self.span_rows = (row.t, 1) if row.support and not row.hard else (None, 0)

    def outside(self, i: int, row) -> str:
        return _level_start(self, i, row, guarded=True)

    def opening(self, i: int, row) -> str:
        p = self.pend
        if i - p["i"] > self.lim.opening_rows or row.t - p["t"] > self.lim.opening_sec or not row.confirm:
            return self.review(p["t"], row.t, "no pattern confirmed it")
        self.now = Open(p["t"], "pattern", "high" if row.hard else "medium").take(row)
        self._support(row)
        self.pend = None
        return INSIDE

    def inside(self, i: int, row) -> str:
        self.now.take(row)
        last = self.now.start if self.now.last_hard is None else self.now.last_hard
        if row.known_low and row.t - self.now.start >= self.lim.shortest:
            self.wait(i, row, "low flow")
            return CLOSING
        if row.hard:
            self._support(row)
            return INSIDE
        if row.t - last > self.lim.fresh_sec:
            self.wait(i, row, "stale")
            return CLOSING
        if row.support:
            self.span_from = row.t if self.span_from is None else self.span_from
            self.span_rows += 1
            if self.span_rows <= self.lim.support_rows and row.t - self.span_from <= self.lim.support_sec:
                return INSIDE
            self.wait(i, row, "support expired", at=self.span_from)
            return CLOSING
        self.wait(i, row, "no evidence")
        return CLOSING

    def closing(self, i: int, row) -> str:
        self.now.take(row)
        if row.hard:
            self._support(row)
            return self.resume()
        if row.known_low:
            self.span_from, self.span_rows = None, 0
            return self.close("low flow", "high")
        if i - self.pend["i"] > self.lim.closing_rows or row.t - self.pend["t"] > self.lim.close_sec:
            self.span_from, self.span_rows = None, 0
            return self.close(f"{self.pend['why']}, timed out", "medium")
        return CLOSING

    def left_open(self, last) -> None:
        n, length = self.now, last.t - self.now.start
        fresh = n.last_hard is not None and last.t - n.last_hard <= self.lim.recent_sec
        dense = n.counts["hard"] / max(length / 60.0, 1e-9)
        if length >= self.lim.rejected_sec and not fresh and dense < self.lim.rejected_density:
            self.emit("rejected", n.start, last.t, "long, thin evidence", n)
        elif length >= self.lim.unresolved_sec and not fresh:
            self.emit("unresolved", n.start, last.t, "long, no recent evidence", n)
        else:
            self.emit("open", n.start, last.t, "end of rows", n)


class Strong(Machine):
    """Strong rows keep an interval; text alone and weak context run against caps that date the
    end back to where they began. Before every row, a long interval without a strong row of late
    (the last rows and the last seconds together) is given up as unresolved."""

    def __init__(self, limits: Limits, duration: float) -> None:
        super().__init__(limits, duration)
        self.recent: list[tuple[float, bool]] = []
        self.conflicts = 0
        self._reset()

    def _reset(self) -> None:
        self.weak_from = self.text_from = None
        self.weak_rows = self.text_rows = 0

    def _long(self, t: float) -> bool:
        length = t - self.now.start
        near = set(self.recent[-self.lim.recent_rows :]) | {r for r in self.recent if t - r[0] <= self.lim.recent_sec}
        return (length >= self.lim.unresolved_sec or (self.duration > 0 and length / self.duration >= self.lim.long_ratio)) and not any(s for _, s in near)

    def before(self, row) -> None:
        self.conflicts = self.conflicts + 1 if row.conflict else 0
        self.recent = [*self.recent[-49:], (round(row.t, 3), row.strong)]
        if self.state in (INSIDE, CLOSING) and self._long(row.t):
            self.emit("unresolved", self.now.start, row.t, "long, no recent strong row", self.now)
            self.state, self.now, self.pend = OUTSIDE, None, None
            self._reset()

    def outside(self, i: int, row) -> str:
        return _level_start(self, i, row, guarded=True)

    def opening(self, i: int, row) -> str:
        p = self.pend
        if i - p["i"] > self.lim.opening_rows or row.t - p["t"] > self.lim.opening_sec or not row.confirm:
            return self.review(p["t"], row.t, "no strong evidence")
        self.now = Open(p["t"], "pattern", "medium").take(row)
        self.pend = None
        self._reset()
        return INSIDE

    def inside(self, i: int, row) -> str:
        self.now.take(row)
        if row.strong:
            self._reset()
            return INSIDE
        self.weak_rows += 1
        self.weak_from = row.t if self.weak_from is None else self.weak_from
        if row.text:
            self.text_rows += 1
            self.text_from = row.t if self.text_from is None else self.text_from
        if row.known_low or row.end_support or self.conflicts >= 2:
            if row.t - self.now.start < self.lim.shortest:
                return INSIDE
            self.wait(i, row, "end support" if row.known_low or row.end_support else "repeated conflict")
            return CLOSING
        if self.text_rows >= self.lim.text_rows or (self.text_from is not None and row.t - self.text_from >= self.lim.text_sec):
            self.wait(i, row, "text alone too long", at=row.t if self.text_from is None else self.text_from)
            return CLOSING
        if self.weak_rows >= self.lim.support_rows + 2 or row.t - self.weak_from >= self.lim.fresh_sec:
            self.wait(i, row, "weak too long", at=self.weak_from)
            return CLOSING
        return INSIDE

    def closing(self, i: int, row) -> str:
        if row.strong:
            self.now.take(row)
            self._reset()
            return self.resume()
        timed = i - self.pend["i"] >= self.lim.closing_rows or row.t - self.pend["t"] > self.lim.close_sec
        if row.known_low or timed:
            self._reset()
            return self.close("low flow" if row.known_low else f"{self.pend['why']}, timed out", "high" if row.known_low else "medium", later_only=True)
        return CLOSING


class Levels(Machine):
    """The first form: high text opens at once, medium text or sound alone waits one step, and
    an interval lasts while context, product or sound goes on. A low row is bridged when its next
    row is near and has context; a waiting end that times out counts only for long intervals with
    repeated low or conflicting rows."""

    guarded = False

    def __init__(self, limits: Limits, duration: float) -> None:
        super().__init__(limits, duration)
        self.conflicts = 0

    def before(self, row) -> None:
        self.conflicts = self.conflicts + 1 if row.conflict else 0

    def outside(self, i: int, row) -> str:
        if row.start_high and not row.conflict:
            self.now = Open(row.t, "text high", "high").take(row)
            return INSIDE
        return _level_start(self, i, row, guarded=False)

    def opening(self, i: int, row) -> str:
        p = self.pend
        confirmed = row.text or row.audio
        if self.guarded and p["why"] == "sound alone":
            confirmed = not row.unreliable and (row.text or row.start_medium or row.start_high)
        if i - p["i"] > self.lim.opening_rows or row.t - p["t"] > self.lim.opening_sec or not confirmed:
            return self.review(p["t"], row.t, "sound alone, no text" if p["why"] == "sound alone" else "not confirmed")
        self.now = Open(p["t"], f"{p['why']}, confirmed", "medium").take(row)
        self.pend = None
        return INSIDE

    def _bridged(self, row) -> bool:
        after = self.after
        if not row.known_low or after is None:
            return False
        gap = after.t - row.t
        return (0 <= gap <= self.lim.bridge_sec and (after.text or after.audio)) or (self.lim.bridge_sec < gap <= self.lim.bridge_both_sec and after.text and after.audio and not after.conflict)

    def inside(self, i: int, row) -> str:
        self.now.take(row)
        if row.text or row.product or (row.audio and row.unreliable) or self._bridged(row):
            return INSIDE
        if row.end_support or row.known_low or self.conflicts >= 2:
            twice_low = row.known_low and self.after is not None and self.after.known_low
            if row.t - self.now.start < self.lim.shortest and not twice_low:
                return INSIDE
            self.wait(i, row, "end support" if row.end_support or row.known_low else "repeated conflict")
            return CLOSING
        return INSIDE

    def _timeout(self) -> str:
        p = self.pend
        if p["t"] - self.now.start >= self.lim.long_sec:
            if p["low"] >= 2 or p["conflict"] >= 2:
                return self.close(f"{p['why']}, long, timed out", "medium", later_only=True)
            if self.guarded:
                self.emit("review", self.now.start, p["t"], "long interval goes on")
        return self.resume()

    def closing(self, i: int, row) -> str:
        p = self.pend
        rows_on, elapsed = i - p["i"], row.t - p["t"]
        if rows_on > self.lim.closing_rows or elapsed > self.lim.close_sec:
            return self._timeout()
        p["low"] += row.known_low
        p["conflict"] += row.conflict
        if row.text or row.product:
            self.now.take(row)
            return self.resume()
        if row.known_low and not row.unreliable:
            return self.close("low flow", "high", later_only=True)
        return self._timeout() if rows_on >= self.lim.closing_rows else CLOSING


class GuardedLevels(Levels):
    """Levels, where sound alone must be confirmed by reliable text, and long intervals whose
    end was not confirmed are reported for review."""

    guarded = True


MACHINES = {"evidence": Evidence, "strict": StrictEvidence, "support": Support, "strong": Strong, "guarded": GuardedLevels, "levels": Levels}


def cue_mask(rows: DataFrame) -> Column:
    """The cues of a row as the bits of one number: one narrow column to move, not one a cue."""
    bits = [F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(CUES) if c in rows.columns]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), [b.cast("long") for b in bits], F.lit(0).cast("long"))


@functools.lru_cache(maxsize=1 << 16)
def _cues_of(mask: int) -> tuple[bool, ...]:
    return tuple(bool(mask >> k & 1) for k in range(len(CUES)))


def row_of(t: float, mask: int) -> Row:
    """A row from its time and its mask of cues."""
    return Row(t, *_cues_of(mask))


def _prepared(rows: DataFrame, key: str, t: str, tie: str, duration: str | None) -> DataFrame:
    length = F.coalesce(F.col(duration).cast("double"), F.lit(0.0)) if duration else F.lit(0.0)
    ready = rows.where(F.col(t).isNotNull()).select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col(tie).alias("tie"), length.alias("duration"), cue_mask(rows).alias("cues"))
    return ready.repartition("key").sortWithinPartitions("key", "t", "tie").select("key", "t", "duration", "cues")


class _Tape:
    """One key's machine after the other's, as sorted rows stream by. One row is held back, as a
    machine may look at the row that follows."""

    def __init__(self, name: str, limits: Limits, wanted: str) -> None:
        self.name, self.limits, self.wanted = name, limits, wanted
        self.machine, self.key, self.held, self.i = None, None, None, 0
        self.keys: list = []
        self.made: list[tuple] = []

    def feed(self, key, row: Row, duration: float) -> None:
        if self.machine is not None and key == self.key:
            self.machine.step(self.i, self.held, row)
            self.i += 1
        else:
            self.end()
            self.machine, self.key, self.i = MACHINES[self.name](self.limits, duration), key, 0
        self.held = row

    def end(self) -> None:
        """The held row is its key's last."""
        if self.machine is not None:
            self.machine.step(self.i, self.held)
            self.machine.finish(self.held)
            self._take()
            self.machine = None

    def _take(self) -> None:
        made = getattr(self.machine, self.wanted)
        self.keys += [self.key] * len(made)
        self.made += made
        self.machine.out, self.machine.trace = [], []

    def drained(self) -> tuple[list, list[tuple]]:
        """Keys and rows made since the last call."""
        if self.machine is not None:
            self._take()
        out = self.keys, self.made
        self.keys, self.made = [], []
        return out


def _run(rows: DataFrame, key: str, t: str, tie: str, machine: str, limits: Limits | None, duration: str | None, wanted: str, schema: str) -> DataFrame:
    ready, lim = _prepared(rows, key, t, tie, duration), limits or Limits()
    whole = f"`{key}` {dict(ready.dtypes)['key']}, {schema}"
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    columns = [p.split() for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tape, kind = _Tape(machine, lim, wanted), pa.int64()

        def made() -> pa.RecordBatch:
            keys, out = tape.drained()
            parts = [pa.array([r[j] for r in out], kinds[k]) for j, (_, k) in enumerate(columns)]
            return pa.record_batch([pa.array(keys, kind), *parts], names=[key, *(n for n, _ in columns)])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, at, length, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tape.feed(k, row_of(at, mask), length)
            yield made()
        tape.end()
        yield made()

    return ready.mapInArrow(run, whole)


def intervals(rows: DataFrame, key: str, t: str, tie: str, machine: str = "evidence", limits: Limits | None = None, duration: str | None = None) -> DataFrame:
    """(key, kind, start, end, ...) of a machine; kind is closed, review, open, unresolved or
    rejected. Rows without a time are left out; equal times follow the tie column; rows of no key
    are one key's."""
    return _run(rows, key, t, tie, machine, limits, duration, "out", SCHEMA)


def trace(rows: DataFrame, key: str, t: str, tie: str, machine: str = "evidence", limits: Limits | None = None, duration: str | None = None) -> DataFrame:
    """(key, t, state_before, state_after, reason), one row an input row."""
    return _run(rows, key, t, tie, machine, limits, duration, "trace", "t double, state_before string, state_after string, reason string")
