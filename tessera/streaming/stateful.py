"""Stateful stream operators.  Rows of a key must arrive in the order of their ``seq`` column across batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.segments import Rules, Segmenter

#: A piece and the marks that end it.
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]+")
#: The same, or a piece without an end.
OPEN = re.compile(r"[^.!?\n]+[.!?\n]*")


def sentence_stream(deltas: DataFrame, key: str, seq: str, delta: str, last: str) -> DataFrame:
    """(key, segment_no, segment) of sentences from text deltas.

    A sentence whose end is the end of the buffer waits for the next delta,
    because more end marks may follow.  The delta flagged ``last`` flushes what is
    left, complete or not, and the key's state goes.
    """

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        out, ended = [], False
        for text, ended in zip(rows[delta], rows[last]):
            held += text or ""
            at = 0
            for m in (OPEN if ended else SENTENCE).finditer(held):
                if m.end() == len(held) and not ended:
                    break
                piece, at = m.group().strip(), m.end()
                if piece:
                    out.append((k[0], n, piece))
                    n += 1
            held = "" if ended else held[at:]
        if ended:
            state.remove()
        else:
            state.update((held, n))
        yield pd.DataFrame(out, columns=[key, "segment_no", "segment"]).astype({key: "int64", "segment_no": "int64"})

    return deltas.select(key, seq, delta, last).groupBy(key).applyInPandasWithState(run, f"{key} long, segment_no long, segment string", "held string, n long", "append", GroupStateTimeout.NoTimeout)


def utterance_stream(frames: DataFrame, key: str, seq: str, voiced: str, last: str, start_frames: int = 1, end_frames: int = 3, least: int = 1, most: int = 1 << 40, lead_in: int = 0) -> DataFrame:
    """(key, first, last, frames, voiced_frames) of utterances.

    An utterance starts with ``start_frames`` voiced frames in a row, has up to
    ``lead_in`` frames before them (those included), and ends with ``end_frames``
    silent ones.  With fewer than ``least`` voiced frames, or when it reaches
    ``most`` frames, it is dropped.  The frame flagged ``last`` ends what is open,
    and the key's state goes.
    """

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, active, first, at_last, n, on, silent = state.get if state.exists else ([], False, -1, -1, 0, 0, 0)
        before, out, ended = list(before), [], False

        def close():
            if on >= least:
                out.append((k[0], first, at_last, n, on))

        for at, speech, ended in pd.concat(list(batches)).sort_values(seq, kind="stable")[[seq, voiced, last]].itertuples(index=False):
            if not active:
                before = [*before, int(at)][-max(lead_in, start_frames) :]
                on = on + 1 if speech else 0
                if on >= start_frames:
                    active, first, n, silent, at_last = True, before[0], len(before), 0, int(at)
            else:
                n, on, silent = n + 1, on + bool(speech), 0 if speech else silent + 1
                at_last = int(at) if speech else at_last
            if active and (n >= most or silent >= end_frames or ended):
                if n < most:
                    close()
                before, active, first, at_last, n, on, silent = [], False, -1, -1, 0, 0, 0
        if ended:
            state.remove()
        else:
            state.update((before, bool(active), int(first), int(at_last), int(n), int(on), int(silent)))
        yield pd.DataFrame(out, columns=[key, "first", "last", "frames", "voiced_frames"]).astype("int64")

    held = "before array<long>, active boolean, first long, at_last long, n long, on long, silent long"
    return frames.select(key, seq, voiced, last).groupBy(key).applyInPandasWithState(run, f"{key} long, first long, last long, frames long, voiced_frames long", held, "append", GroupStateTimeout.NoTimeout)


def segment_stream(deltas: DataFrame, key: str, seq: str, delta: str, last: str, failed: str, rules: Rules = Rules()) -> DataFrame:
    """(key, segment_no, segment) of speakable segments; the last delta flushes, a failed stream only what is a complete sentence.

    The state of a key is its open text and whether its first segment is out (for
    ``rules.opening``).
    """

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, opened = state.get if state.exists else ("", 0, False)
        work, out, ended = Segmenter(rules, held, opened), [], False
        for _, text, ended, bad in pd.concat(list(batches)).sort_values(seq, kind="stable")[[seq, delta, last, failed]].itertuples(index=False):
            out += work.push(text or "")
            if ended:
                out += work.flush(complete_only=bool(bad))
        if ended:
            state.remove()
        else:
            state.update((work.held, n + len(out), work.opened))
        rows = [(k[0], n + i, x) for i, x in enumerate(out)]
        yield pd.DataFrame(rows, columns=[key, "segment_no", "segment"]).astype({key: "int64", "segment_no": "int64"})

    return deltas.select(key, seq, delta, last, failed).groupBy(key).applyInPandasWithState(run, f"{key} long, segment_no long, segment string", "held string, n long, opened boolean", "append", GroupStateTimeout.NoTimeout)


def frame_stream(payloads: DataFrame, key: str, seq: str, payload: str, size: int) -> DataFrame:
    """(key, frame_no, frame): a byte stream cut into frames of ``size`` bytes; the remainder waits for more."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else (b"", 0)
        held = bytes(held) + b"".join(bytes(x) for x in pd.concat(list(batches)).sort_values(seq, kind="stable")[payload])
        whole = len(held) // size
        rows = [(k[0], n + i, held[i * size : (i + 1) * size]) for i in range(whole)]
        state.update((held[whole * size :], n + whole))
        yield pd.DataFrame(rows, columns=[key, "frame_no", "frame"]).astype({key: "int64", "frame_no": "int64"})

    return payloads.select(key, seq, payload).groupBy(key).applyInPandasWithState(run, f"{key} long, frame_no long, frame binary", "held binary, n long", "append", GroupStateTimeout.NoTimeout)
