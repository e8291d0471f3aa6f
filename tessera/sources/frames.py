"""Binary frames with a fixed 32-byte big-endian header, in Column expressions.

Fixed values of the format: magic ``ACE1``, version 1, kind, codec 1, channels 1,
sample rate and payload size as 32 bits, 16 bytes of stream id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = "41434531"


def _hex(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), digits, "0")


def pack(kind: Column, rate: Column, stream: Column, payload: Column) -> Column:
    head = F.concat(F.lit(MAGIC + "01"), _hex(kind, 2), F.lit("0101"), _hex(rate, 8), _hex(F.length(payload), 8), _hex(stream, 32))
    return F.concat(F.unhex(head), payload)


def unpack(frame: Column) -> Column:
    """struct(kind, rate, size, stream, payload), or null for what is no whole frame of version 1."""
    part = lambda at, n: F.hex(F.substring(frame, at, n))
    number = lambda at, n: F.conv(part(at, n), 16, 10).cast("long")
    payload = F.substring(frame, F.lit(33), F.length(frame))
    sound = (F.length(frame) >= 32) & (part(1, 4) == MAGIC) & (number(5, 1) == 1) & (number(13, 4) == F.length(frame) - 32)
    return F.when(sound, F.struct(number(6, 1).alias("kind"), number(9, 4).cast("int").alias("rate"), number(13, 4).alias("size"), part(17, 16).alias("stream"), payload.alias("payload")))
