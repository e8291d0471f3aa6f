"""Server-sent event lines to text deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "choices array<struct<delta: struct<content: string>, message: struct<content: string>, finish_reason: string>>, content string"


def deltas(lines: DataFrame, stream: list[str], order: str) -> DataFrame:
    """Adds ``delta`` to the ``data:`` lines that carry text, up to each stream's end mark; blank and faulty lines go.

    A chunk's text is its delta, else its message, else its own content.
    """
    done = F.max((F.trim("line") == "data: [DONE]").cast("int")).over(Window.partitionBy(*stream).orderBy(order))
    lines = lines.withColumn("done", done).filter("done = 0").drop("done")
    raw = F.regexp_extract("line", r"^data:\s*(\{.*\})\s*$", 1)
    got = lines.withColumn("chunk", F.from_json(F.when(raw != "", raw), CHUNK))
    first = F.try_element_at("chunk.choices", F.lit(1))
    return got.withColumn("delta", F.coalesce(first["delta"]["content"], first["message"]["content"], F.col("chunk.content"))).filter("delta is not null and delta <> ''").drop("chunk", "line")
