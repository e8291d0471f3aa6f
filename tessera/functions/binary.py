"""Waveform files and page bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _little(c: Column, size: int) -> Column:
    """A whole number as hex digits of little-endian bytes."""
    digits = F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * (size - 1 - i) + 1, 2) for i in range(size)))


def wav(pcm: Column, rate: int, channels: int = 1) -> Column:
    """16-bit samples as a WAV file: the 44-byte header and the samples."""
    n = F.length(pcm)
    head = F.concat(
        F.lit("52494646"), _little(n + 36, 4), F.lit("57415645666D742010000000" + "0100"), _little(F.lit(channels), 2), _little(F.lit(rate), 4), _little(F.lit(rate * channels * 2), 4),
        _little(F.lit(channels * 2), 2), F.lit("1000" + "64617461"), _little(n, 4),
    )
    return F.concat(F.unhex(head), pcm)


def wav_samples(data: Column) -> Column:
    """The sample bytes of such a file; null for anything else."""
    sound = (F.hex(F.substring(data, 1, 4)) == "52494646") & (F.hex(F.substring(data, 37, 4)) == "64617461")
    return F.when(sound, F.substring(data, F.lit(45), F.length(data)))


@F.pandas_udf(T.StringType())
def decode_page(payload: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes of a page as text: the charset of the header, then UTF-8, cp932, Shift-JIS, then UTF-8 with replacement."""

    def one(data, header):
        if data is None:
            return None
        named = re.search(r"charset=[\"']?([\w-]+)", header or "", re.I)
        for charset in ([named.group(1)] if named else []) + ["utf-8", "cp932", "shift_jis"]:
            try:
                return bytes(data).decode(charset)
            except (UnicodeDecodeError, LookupError):
                continue
        return bytes(data).decode("utf-8", "replace")

    return pd.Series([one(d, h) for d, h in zip(payload, content_type)])
