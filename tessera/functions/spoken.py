"""How numbers with what follows them are spoken in Japanese: readings, sound changes at their end, templates over matches.

A sound change depends on the last word of the number and the first sound of what
follows, so one function joins the two for all counters; tables say how a counter
is read and which numbers it reads in a way of its own.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tessera.functions.readings import DIGITS, GROUPS, HUNDREDS, ONES, SHORTENED, SHORTENED_HUNDREDS, TENS, THOUSANDS
from tessera.rules import spoken as R


def _shortened(reading: str, endings) -> str:
    for ending, short in endings:
        if reading.endswith(ending):
            return reading[: -len(ending)] + short
    return reading


def whole(digits: str, before_unit: bool = False) -> str:
    """A whole number; with a leading zero, or beyond the largest unit, its digits one by one.  Before a large unit a thousand is one thousand."""
    digits = digits.replace(",", "")
    if len(digits) > 4 * len(GROUPS) or (len(digits) > 1 and digits[0] == "0"):
        return "".join(DIGITS[int(c)] for c in digits)
    if not digits.strip("0"):
        return DIGITS[0]
    padded, parts = digits.zfill(4 * len(GROUPS)), []
    for i in range(len(GROUPS)):
        power = len(GROUPS) - 1 - i
        a, b, c, d = map(int, padded[4 * i : 4 * i + 4])
        read = THOUSANDS[a] + HUNDREDS[b] + TENS[c] + ONES[d]
        if not read:
            continue
        if (power or before_unit) and read.startswith(THOUSANDS[1]):
            read = "いっ" + read
        if power >= 3:
            read = _shortened(read, SHORTENED + (SHORTENED_HUNDREDS if power == 4 else ()))
        parts.append(read + GROUPS[power])
    return "".join(parts)


def each_digit(digits: str) -> str:
    return "".join(DIGITS[int(c)] for c in digits if c.isdigit())


def point(number: str) -> str:
    """A number with or without a decimal point; several points are those of a version."""
    head, *tail = number.replace(",", "").split(".")
    parts = [R.NOUGHT if len(tail) == 1 and head == "0" else whole(head), *map(each_digit, tail)]
    return "てん".join([*(_shortened(p, SHORTENED) for p in parts[:-1]), parts[-1]])


#: Rows of sounds that change the end of a number before them.
_ROW = {c: row for row, chars in (("k", "かきくけこカキクケコ"), ("s", "さしすせそたちつてとサシスセソタチツテト"), ("h", "はひふへほハヒフヘホ"), ("p", "ぱぴぷぺぽパピプペポ")) for c in chars}
_HALF = dict(zip("はひふへほ", "ぱぴぷぺぽ"))
_SOFT = dict(zip("はひふへほ", "ばびぶべぼ"))
_SIX = (("ろく", "ろっ"),)


def joined(reading: str, following: str, third: str = "") -> str:
    """A number's reading and what follows, with the sound changes between them.

    Before k and h sounds one, six, eight, ten and a hundred are shortened, before
    s and t sounds one, eight and ten; a shortened number turns h into p, and a
    final n turns it into ``third`` (b where that is empty), but not after four.
    """
    row = _ROW.get(following[:1])
    endings = SHORTENED if row == "s" else SHORTENED + SHORTENED_HUNDREDS + _SIX if row in ("k", "h") else ()
    short = _shortened(reading, endings)
    if row == "h":
        first, rest = following[0], following[1:]
        if short != reading:
            return short + _HALF[first] + rest
        if reading.endswith("ん") and not reading.endswith("よん"):
            return reading + (third or _SOFT[first]) + rest
    return short + following


def ten_joined(reading: str, following: str) -> str:
    """Loan words change a ten only."""
    return _shortened(reading, (("じゅう", "じゅっ"),)) + following if _ROW.get(following[:1]) else reading + following


def year(digits: str) -> str:
    return re.sub("よん$", "よ", whole(digits))


def month(digits: str) -> str:
    return R.MONTHS[int(digits) - 1] if 1 <= int(digits) <= 12 else whole(str(int(digits))) + "がつ"


def day(digits: str) -> str:
    """A day of a month."""
    n = int(digits.replace(",", ""))
    return R.DAYS.get(n) or whole(str(n)) + "にち"


def days(digits: str) -> str:
    """A number of days."""
    return R.ONE_DAY if digits.strip("0,") == "1" and digits[-1] == "1" else day(digits)


def month_day(m: str, d: str) -> str:
    read = day(d)
    # a space keeps two equal sounds apart
    return f"{month(m)} {read}" if read.startswith("つ") else month(m) + read


def hour(digits: str, endings=R.HOUR_ENDINGS) -> str:
    n = int(digits.replace(",", ""))
    return (_shortened(whole(str(n)), endings) if n else R.NOUGHT) + "じ"


def counter(digits: str, written: str) -> str:
    """A number with a counter word."""
    found = R.COUNTERS[R.SAME_COUNTER.get(written[0], written[0]) + written[1:]]
    if found.zero_padded:
        digits = str(int(digits.replace(",", "")))
    n = int(digits.replace(",", ""))
    if n in found.own:
        return found.own[n]
    if written == "時":
        return hour(digits)
    if written == "時間":
        return hour(digits, R.HOUR_ENDINGS[:1] + R.HOUR_ENDINGS[2:]) + "かん"
    reading = whole(digits)
    for ending, read in found.endings:
        if reading.endswith(ending):
            return reading[: -len(ending)] + read
    return reading + found.reading if found.plain or not n else joined(reading, found.reading, found.third)


def clock(h: str, m: str, s: str | None = None) -> str:
    return hour(h) + (counter(m, "分") if int(m) else "") + (counter(s, "秒") if s and int(s) else "")


def weekdays(found: str) -> str:
    return "、".join("祝日" if c == "祝" else f"{c}曜日" for c in found if c not in "・･、")


def quantity(number: str, large: str | None, reading: str) -> str:
    """A number and a unit's reading, with a large unit between them or not."""
    if large:
        return (point(number) if "." in number else whole(number, True)) + R.LARGE[large] + reading
    return point(number) + reading if "." in number else ten_joined(whole(number), reading)


def data_unit(prefix: str, kind: str, rate: str | None) -> str:
    bits = kind == "b" and (rate == "ps" or prefix.isupper())
    return R.PREFIXES[prefix.lower()] + ("ビット" if bits else "バイト") + ("毎秒" if rate else "")


def date(y: str | None, m: str, d: str) -> str | None:
    """None for what is no date."""
    if not (1 <= int(m) <= 12 and 1 <= int(d) <= 31):
        return None
    return (year(y) + "ねん" if y else "") + month_day(m, d)


#: What templates may call, with the groups of a match.
READERS = {
    "whole": whole, "digits": each_digit, "point": point, "year": year, "month": month, "day": day, "days": days, "date": date, "monthday": month_day, "hour": hour,
    "counter": counter, "clock": clock, "weekdays": weekdays, "unit": lambda n, large, u: quantity(n, large, R.UNITS.get(u) or R.UNITS_ANY_CASE[u.lower()]), "data": lambda n, large, p, k, r: quantity(n, large, data_unit(p, k, r)),
    "percent": lambda n: quantity(n, None, R.PERCENT), "large": lambda n: whole(n, True), "larger": lambda n, u: _shortened(whole(n, True), SHORTENED + (SHORTENED_HUNDREDS if u == "京" else ())) + R.LARGER[u],
    "ten": lambda n: _shortened(whole(n), (("じゅう", "じゅっ"),)), "blocks": lambda *g: "の".join(whole(x) for x in g if x), "numbers": lambda *g: "の".join(each_digit(x) for x in g if x),
}


class Rewriter(NamedTuple):
    """Stages of ordered rules.  In a stage the first rule that fits at a place rewrites it, once; the next stage sees the result.

    A rule is a pattern and a template: text with ``{reader:groups}`` calls, the
    numbers of groups, and ``{n}`` for a group as it stands.  A reader that gives
    None leaves the match as it is.
    """

    stages: tuple

    @classmethod
    def of(cls, stages) -> Rewriter:
        out = []
        for stage in stages:
            rules, whole_pattern, at = [], [], 1
            for pattern, template in stage:
                groups = re.compile(pattern).groups
                rules.append((at, groups, [p for p in re.split(r"\{([^}]*)\}", template)]))
                # groups of a rule are counted from its own place in the alternation
                whole_pattern.append("(" + pattern + ")")
                at += groups + 1
            out.append((re.compile("|".join(whole_pattern)), rules))
        return cls(tuple(out))

    def __call__(self, text: str) -> str:
        for pattern, rules in self.stages:
            text = pattern.sub(lambda m, rules=rules: self._read(m, rules), text)
        return text

    @staticmethod
    def _read(m: re.Match, rules) -> str:
        at, _, template = next(r for r in rules if m.group(r[0]) is not None)
        out = []
        for i, piece in enumerate(template):
            if i % 2 == 0:
                out.append(piece)
            elif piece.isdigit():
                out.append(m.group(at + int(piece)) or "")
            else:
                name, _, groups = piece.partition(":")
                read = READERS[name](*(m.group(at + int(g)) for g in groups.split(",")))
                if read is None:
                    return m.group()
                out.append(read)
        return "".join(out)
