"""Speakable segments of text that comes in pieces: one scanner over character classes, driven by a table.

The scanner knows where the open segment starts and reads on from there, so what
comes out does not depend on how the text was cut into pieces.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rules(NamedTuple):
    """What ends a segment, what it may be cut after, and limits in characters."""

    ends: str = "。！？!?\n."
    breaks: str = "、，,;； "
    closers: str = "」』）】)\"'”’"
    #: From so many characters on a segment is cut after its last break; at ``hard`` it is cut anyway.
    soft: int = 40
    hard: int = 80
    #: Characters up to a break, at least.
    least: int = 8
    #: Letters and digits after which the first segment of a reply may be cut at its first break; 0: never.
    opening: int = 0
    #: Keep the white space that follows a segment, so that segments joined are the text.
    spaces: bool = False


# classes of characters
END, DOT, BREAK, COMMA, SPACE, CLOSER, DIGIT, LETTER, OTHER = range(9)
# states: nothing known; after a letter; after a digit; a full stop that may end; one that may stand inside a word;
# dots in a row; a comma that may stand inside a number; an end, with what belongs to it
OPEN, WORD, NUMBER, STOP, INNER, DOTS, INNER_COMMA, ENDED = range(8)
# actions: break after this character; break before it; cut before it
AFTER, BEFORE, CUT = 1, 2, 4

_OPEN = {END: (ENDED, 0), DOT: (STOP, 0), BREAK: (OPEN, AFTER), COMMA: (OPEN, AFTER), SPACE: (OPEN, AFTER), CLOSER: (OPEN, 0), DIGIT: (NUMBER, 0), LETTER: (WORD, 0), OTHER: (OPEN, 0)}
_STOP = {c: (state, action | CUT) for c, (state, action) in _OPEN.items()} | {END: (ENDED, 0), SPACE: (ENDED, 0), CLOSER: (ENDED, 0), DOT: (DOTS, 0)}
STEPS = {
    OPEN: _OPEN,
    WORD: _OPEN | {DOT: (INNER, 0)},
    NUMBER: _OPEN | {DOT: (INNER, 0), COMMA: (INNER_COMMA, 0)},
    STOP: _STOP,
    INNER: _STOP | {DIGIT: (NUMBER, 0), LETTER: (WORD, 0)},
    DOTS: _OPEN | {DOT: (DOTS, 0)},
    INNER_COMMA: {c: (state, action | BEFORE) for c, (state, action) in _OPEN.items()} | {DIGIT: (NUMBER, 0)},
    ENDED: _STOP | {DOT: (ENDED, 0)},
}


class Segmenter:
    """``push`` gives the segments that a piece completes, ``flush`` what is left.  State: ``held`` and ``opened``."""

    def __init__(self, rules: Rules = Rules(), held: str = "", opened: bool = False):
        self.rules, self.held, self.opened = rules, held, opened
        self._class = {c: BREAK for c in rules.breaks} | {c: CLOSER for c in rules.closers} | {c: END for c in rules.ends}
        self._class |= {c: COMMA for c in ",，" if c in rules.breaks} | ({".": DOT} if "." in rules.ends else {})

    def _of(self, c: str) -> int:
        known = self._class.get(c)
        if known is not None:
            return SPACE if c == " " else known
        return DIGIT if c.isdigit() else LETTER if c.isascii() and c.isalnum() else SPACE if c == " " else OTHER

    def _cut(self) -> int | None:
        """Where the open segment ends, if the text tells."""
        rules, text = self.rules, self.held
        state, last, spoken = OPEN, 0, 0
        for at, c in enumerate(text):
            state, action = STEPS[state][self._of(c)]
            if action & CUT:
                return at
            if action & BEFORE and at >= rules.least:
                last = at
            if rules.opening and not self.opened and action & (BEFORE | AFTER) and c != " " and spoken >= rules.opening:
                return at + 1 if action & AFTER else at
            # an end that is due decides before any limit
            if state not in (STOP, INNER, ENDED):
                if at >= rules.soft and last:
                    return last
                if at >= rules.hard:
                    return rules.hard
            if action & AFTER and at + 1 >= rules.least and (c != " " or " " in rules.breaks):
                last = at + 1
            spoken += c.isalnum()
        return None

    def _shown(self, segment: str) -> str | None:
        if not any(c.isalnum() for c in segment):
            return None
        return segment if self.rules.spaces else segment.strip()

    def push(self, piece: str) -> list[str]:
        self.held += piece
        out = []
        while (end := self._cut()) is not None:
            segment, self.held = self.held[:end], self.held[end:]
            if not self.rules.spaces:
                self.held = self.held.lstrip()
            if (shown := self._shown(segment)) is not None:
                self.opened = True
                out.append(shown)
        return out

    def flush(self, complete_only: bool = False) -> list[str]:
        """What is left; after a failure only if it is a complete sentence."""
        segment, self.held = self.held, ""
        whole = segment.rstrip().rstrip(self.rules.closers)[-1:]
        shown = self._shown(segment)
        return [shown] if shown is not None and (not complete_only or (whole and whole in self.rules.ends)) else []


#: Sentences without a full stop among their ends, cut at a comma from 60 characters on, the first clause of a reply as soon as it has four letters.
REPLY = Rules(ends="。！？!?\n", breaks="、，,", closers="」』）)】\"'", soft=60, hard=60, least=1, opening=4)  # fixed values


def segments_of(rules: Rules):
    """Array of the segments of whole texts, as a pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            s = Segmenter(rules)
            return s.push(text or "") + s.flush()

        return texts.map(one)

    return run
