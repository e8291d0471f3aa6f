"""Session operators with several state variables and timers: half-duplex turns, fillers on timeout, early results.

Each runs live with timers of processing time, or over a recorded stream with
timers of event time, where its result depends on the rows alone.  Rows of a key
that come in one batch are taken in the order of their time and sequence number;
a row before what its key has seen is late and is told as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LISTENING, THINKING, SPEAKING = "listening", "thinking", "speaking"
#: (phase, kind) -> the next phase; a kind that has no row leaves the phase as it is.
TURNS = {
    (LISTENING, "utterance"): THINKING, (LISTENING, "silence"): LISTENING, (THINKING, "reply"): SPEAKING, (THINKING, "done"): LISTENING, (SPEAKING, "done"): LISTENING,
    (THINKING, "error"): LISTENING, (SPEAKING, "error"): LISTENING, (THINKING, "stop"): LISTENING, (SPEAKING, "stop"): LISTENING,
}

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Hands the rows of a key to ``row`` in order, and expired timers to ``due``; both give output rows."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "seen long")
        self.open()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, seen = [], self.clock.get()[0] if self.clock.exists() else -1
        for seq, at, kind in pd.concat(list(rows)).sort_values("seq", kind="stable")[["seq", "at_ms", "kind"]].itertuples(index=False):
            if seq <= seen:
                out.append(self.late(key, int(seq), kind))
                continue
            seen = int(seq)
            # what falls due before this row comes first, however rows were dealt into batches
            out += self.before(key, int(at))
            out += self.row(key, seen, int(at), kind)
        self.clock.update((seen,))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.frame(self.due(key, expiredTimerInfo.getExpiryTimeInMs()))

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def open(self) -> None: ...

    def before(self, key, at: int) -> list[tuple]:
        return []

    def due(self, key, at: int) -> list[tuple]:
        return []

    def close(self) -> None: ...


class Sessions(_Ordered):
    """Turns of a session: a phase, the turn's number, and counts of what was taken and dropped in it.

    ``audio`` is taken while the session listens and dropped otherwise.  A turn
    that goes back to listening is told with its counts; a session without rows
    for ``idle_ms`` is told as ``expired`` and its state goes.
    """

    COLUMNS = ["session", "seq", "event", "turn", "phase", "taken", "dropped"]
    SCHEMA = "session long, seq long, event string, turn long, phase string, taken long, dropped long"

    def __init__(self, transitions=TURNS, audio: str = "audio", idle_ms: int = 3_600_000):
        super().__init__(self.COLUMNS)
        self.transitions, self.audio, self.idle_ms = transitions, audio, idle_ms

    def open(self) -> None:
        self.phase = self.handle.getValueState("phase", "phase string, turn long")
        self.counts = self.handle.getMapState("counts", "kind string", "n long")
        self.expiry = self.handle.getValueState("expiry", "at long")

    def _told(self, key, seq, event):
        phase, turn = self.phase.get() if self.phase.exists() else (LISTENING, 0)
        n = [self.counts.getValue((k,))[0] if self.counts.containsKey((k,)) else 0 for k in ("taken", "dropped")]
        return (key[0], seq, event, turn, phase, *n)

    def late(self, key, seq, kind):
        return self._told(key, seq, "late")

    def row(self, key, seq, at, kind) -> list[tuple]:
        phase, turn = self.phase.get() if self.phase.exists() else (LISTENING, 0)
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        self.expiry.update((at + self.idle_ms,))
        self.handle.registerTimer(at + self.idle_ms)
        if kind == self.audio:
            name = "taken" if phase == LISTENING else "dropped"
            n = self.counts.getValue((name,))[0] if self.counts.containsKey((name,)) else 0
            self.counts.updateValue((name,), (n + 1,))
            return []
        new = self.transitions.get((phase, kind))
        if new is None or new == phase:
            return []
        self.phase.update((new, turn + (phase == LISTENING)))
        out = [self._told(key, seq, kind)]
        if new == LISTENING:
            self.counts.clear()
        return out

    def before(self, key, at) -> list[tuple]:
        return self._expire(key, self.expiry.get()[0]) if self.expiry.exists() and self.expiry.get()[0] < at else []

    def due(self, key, at) -> list[tuple]:
        return self._expire(key, at) if self.expiry.exists() and self.expiry.get()[0] == at else []

    def _expire(self, key, at) -> list[tuple]:
        out = [self._told(key, -1, "expired")]
        self.handle.deleteTimer(at)
        for state in (self.phase, self.counts, self.expiry):
            state.clear()
        return out


class Fillers(_Ordered):
    """Requests that wait for their first chunk: a filler after ``filler_ms``, a timeout after ``limit_ms``, one retry ``retry_ms`` after an exhausted resource.

    Kinds: ``request``, ``chunk``, ``exhausted``, ``error``.  A request ends with
    its first chunk (``first``, with the time it took), its timeout, an error, or
    a second exhaustion (``busy``); a new request takes the place of an open one.
    """

    COLUMNS = ["session", "seq", "event", "waited_ms"]
    SCHEMA = "session long, seq long, event string, waited_ms long"

    def __init__(self, filler_ms: int = 1_000, limit_ms: int = 20_000, retry_ms: int = 750):
        super().__init__(self.COLUMNS)
        self.steps = {"filler": filler_ms, "timeout": limit_ms}
        self.retry_ms = retry_ms

    def open(self) -> None:
        self.request = self.handle.getValueState("request", "seq long, at long, retried boolean")
        self.timers = self.handle.getMapState("timers", "event string", "at long")

    def late(self, key, seq, kind):
        return (key[0], seq, "late", -1)

    def _arm(self, event: str, at: int) -> None:
        self.timers.updateValue((event,), (at,))
        self.handle.registerTimer(at)

    def _end(self) -> None:
        for _, (at,) in list(self.timers.iterator()):
            self.handle.deleteTimer(at)
        self.timers.clear()
        self.request.clear()

    def row(self, key, seq, at, kind) -> list[tuple]:
        if kind == "request":
            self._end()
            self.request.update((seq, at, False))
            for event, after in self.steps.items():
                self._arm(event, at + after)
            return []
        if not self.request.exists():
            return []
        asked, began, retried = self.request.get()
        if kind == "exhausted" and not retried:
            self.request.update((asked, began, True))
            self._arm("retry", at + self.retry_ms)
            return []
        told = {"chunk": "first", "exhausted": "busy", "error": "error"}.get(kind)
        if told is None:
            return []
        self._end()
        return [(key[0], asked, told, at - began)]

    def _fire(self, key, until: int) -> list[tuple]:
        """The timers up to a time, in order."""
        out = []
        while self.request.exists():
            ready = sorted((at, event) for (event,), (at,) in self.timers.iterator() if at <= until)
            if not ready:
                break
            at, event = ready[0]
            asked, began, _ = self.request.get()
            self.timers.removeKey((event,))
            self.handle.deleteTimer(at)
            out.append((key[0], asked, event, at - began))
            if event == "timeout":
                self._end()
        return out

    def before(self, key, at) -> list[tuple]:
        return self._fire(key, at - 1)

    def due(self, key, at) -> list[tuple]:
        return self._fire(key, at)


class EarlyResults(_Ordered):
    """Results begun at a pause: void when speech resumes, used when the utterance ends with nothing but silence since.

    Kinds: ``speech``, ``silence``, ``end``.  After ``pause`` silent rows a result
    is begun on what was heard; ``end`` uses it if it is current (``used``), else
    a result is made then (``made``).  ``heard`` is the number of rows it is of.
    """

    COLUMNS = ["session", "seq", "event", "heard"]
    SCHEMA = "session long, seq long, event string, heard long"

    def __init__(self, pause: int = 2):
        super().__init__(self.COLUMNS)
        self.pause = pause

    def open(self) -> None:
        self.heard = self.handle.getValueState("heard", "rows long, silent long")
        self.early = self.handle.getValueState("early", "rows long")

    def late(self, key, seq, kind):
        return (key[0], seq, "late", -1)

    def row(self, key, seq, at, kind) -> list[tuple]:
        rows, silent = self.heard.get() if self.heard.exists() else (0, 0)
        current = self.early.get()[0] if self.early.exists() else None
        if kind == "end":
            self.heard.clear(), self.early.clear()
            if not rows:
                return []
            return [(key[0], seq, "used" if current is not None else "made", current if current is not None else rows)]
        if kind == "speech":
            self.heard.update((rows + 1, 0))
            if current is not None:
                self.early.clear()
                return [(key[0], seq, "void", current)]
            return []
        if kind != "silence" or not rows:
            return []
        self.heard.update((rows + 1, silent + 1))
        if silent + 1 == self.pause:
            self.early.update((rows + 1,))
            return [(key[0], seq, "begun", rows + 1)]
        return []


def run_sessions(rows: DataFrame, processor: _Ordered, live: bool = False, delay: str = "0 seconds") -> DataFrame:
    """The processor over a stream of (session, seq, at timestamp, kind).

    ``live`` takes timers of processing time; else event time rules, rows up to
    ``delay`` behind the latest are waited for, and rows later than that are
    dropped by the watermark.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = rows.select("session", "seq", "at", "kind").withWatermark("at", delay).selectExpr("session", "seq", "at", "unix_millis(at) as at_ms", "kind")
    return rows.groupBy("session").transformWithStateInPandas(processor, processor.SCHEMA, "append", "ProcessingTime" if live else "EventTime")
