"""Query text: compatibility forms and numerals in words, as Arrow-batched functions over small helpers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: digits and units of numerals
DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
UNITS = {"十": 10, "百": 100, "千": 1000}
_NUMERAL = re.compile(f"[{''.join(DIGITS)}{''.join(UNITS)}]+(?=年|$|[^一-龥])")


def numeral(word: str) -> int:
    """Value of a numeral: digit by digit, or with units, where a unit alone counts once."""
    if not set(word) & set(UNITS):
        return int("".join(str(DIGITS[c]) for c in word))
    total = 0
    for digit, unit in re.findall(f"([{''.join(DIGITS)}]?)([{''.join(UNITS)}]?)", word):
        total += (DIGITS[digit] if digit else 1 if unit else 0) * UNITS.get(unit, 1)
    return total


def years_in_digits(text: str) -> str:
    """Numerals from 1900 to 2199 in digits; others stay."""
    return _NUMERAL.sub(lambda m: str(n) if 1900 <= (n := numeral(m.group())) <= 2199 else m.group(), text)


@F.pandas_udf(T.StringType())
def normalized_query(texts: pd.Series) -> pd.Series:
    """NFKC, years in digits, line ends and white space folded, stripped; null is empty."""
    fold = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", t))).strip()
    return texts.fillna("").map(lambda t: fold(years_in_digits(unicodedata.normalize("NFKC", t))))
