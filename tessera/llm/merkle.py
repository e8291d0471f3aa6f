"""Merkle manifest of a dataset: a tree of SHA-256 over each source and one over the sources.

Parents keep a copy of their hash state before each child's slot.  A changed
child is folded by resuming the state before it with the replacement and the
siblings to its right, so nothing to its left is hashed again.

Rows are placed in their tree by range partitions and prefix counts.  A task
builds the two levels above each ``BLOCK`` consecutive nodes; what remains, a
256th, is the next round's input.  On the way down each block gets the children
of the parents above it once, and all its leaves are folded and proved there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, crc32_text, written

FAN = 16
#: Consecutive nodes that a task takes together: two levels.
BLOCK = FAN * FAN
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<slot:int,children:string>>"
_ABOVE = f"tree string, pos long, path {_PATH}, subroot string, root string"


class Parent:
    """A node over its children's digests (hex, as bytes), with the state before each slot."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: bytes):
        state, self.children, self.states = hashlib.sha256(), children, []
        for at in range(0, len(children), HEX):
            self.states.append(state.copy())
            state.update(children[at : at + HEX])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with ``child`` in ``slot``."""
        state = self.states[slot].copy()
        state.update(child + self.children[(slot + 1) * HEX :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.children[: slot * HEX] + self.children[(slot + 1) * HEX :]


def levels_above(digests: list[bytes], n: int) -> tuple[list[list[Parent]], bytes]:
    """The parents above a block of consecutive nodes, at most two levels, and what they end in.  ``n``: nodes of the whole tree at this level."""
    levels = []
    while n > 1 and len(levels) < 2:
        levels.append([Parent(b"".join(digests[at : at + FAN])) for at in range(0, len(digests), FAN)])
        digests, n = [p.digest for p in levels[-1]], -(-n // FAN)
    return levels, digests[0]


def steps(levels: list[list[Parent]], at: int) -> Iterator[tuple[int, Parent]]:
    """Slot and parent of node ``at`` of a block, level by level."""
    for parents in levels:
        yield at % FAN, parents[at // FAN]
        at //= FAN


def leaf_of(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(columns[f].cast("string")) for f in FIELDS)).cast("binary"), 256)


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in its tree by ``order`` (from 0), and ``n``, the nodes of the tree; no tree is sorted in one task."""
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = written(ranged.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "merkle-placed")
    counts = rows.groupBy("tree", "part").agg(F.min("nth").alias("low"), F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("tree").orderBy("part")) - F.col("held")
    total = F.sum("held").over(Window.partitionBy("tree"))
    starts = counts.select("tree", "part", (before - F.col("low")).alias("shift"), total.alias("n"))
    return rows.join(starts, ["tree", "part"]).withColumn("pos", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def _blocks(batches, key: tuple[int, int] = (0, 1)) -> Iterator[list[tuple]]:
    """The rows of each block, from batches sorted by tree and block."""
    rows = (r for b in batches for part in (b.slice(at, 1024) for at in range(0, b.num_rows, 1024)) for r in zip(*(c.to_pylist() for c in part.columns)))
    for _, found in groupby(rows, lambda r: (r[key[0]], r[key[1]])):
        yield list(found)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_NODE = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("slot", pa.int32()), ("children", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _up_batches(batches):
    def run():
        for rows in _blocks(batches):
            tree, block, _, n, _ = rows[0]
            yield tree, block, -(-n // BLOCK), levels_above([r[4].encode() for r in rows], n)[1].decode()

    return _batches(run(), _NODE)


def _up(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) two levels above ``nodes``."""
    rows = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest")
    return written(_dealt(rows).mapInArrow(_up_batches, "tree string, pos long, n long, digest string"), "merkle-level")


def _with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The rows of each block behind the row of what lies above it (``pos`` -1)."""
    own = nodes.withColumns({"block": F.expr(f"pos div {BLOCK}"), "path": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
    head = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    both = own.unionByName(head, allowMissingColumns=True)
    return _dealt(both.select("tree", "block", "pos", "n", "digest", "path", "subroot", "root", *(c for c in ("doc_id", "altered") if c in both.columns)))


def _down_batches(batches):
    def run():
        for head, *rows in _blocks(batches):
            levels, _ = levels_above([r[4].encode() for r in rows], rows[0][3])
            for at, r in enumerate(rows):
                own = [{"slot": slot, "children": parent.children.decode()} for slot, parent in steps(levels, at)]
                yield r[0], r[2], own + head[5], head[6], head[7]

    return _batches(run(), _PATHS)


def _proof_batches(batches):
    def run():
        for head, *rows in _blocks(batches):
            levels, _ = levels_above([r[4].encode() for r in rows], rows[0][3])
            above = [(x["slot"], Parent(x["children"].encode())) for x in head[5]]
            beside = b"".join(parent.siblings(slot) for slot, parent in above)
            root = head[7].encode()
            for at, r in enumerate(rows):
                proof, value = hashlib.sha256(), (r[9] or r[4]).encode()
                for slot, parent in steps(levels, at):
                    proof.update(parent.siblings(slot))
                    value = parent.fold(slot, value)
                for slot, parent in above:
                    value = parent.fold(slot, value)
                proof.update(beside)
                yield r[8], r[4], head[6], head[7], proof.hexdigest(), value.decode(), value == root

    return _batches(run(), _PROOF)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and what is above them, two levels at a time, down to one node a tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [nodes]
    while len(levels) == 1 or most > 1:
        levels.append(_up(levels[-1]))
        most = -(-most // BLOCK)
    return levels


def _above_blocks(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """What lies above each block of ``levels[0]``; ``above`` has it for the last level."""
    for nodes in levels[-2:0:-1]:
        above = written(_with_above(nodes, above).mapInArrow(_down_batches, _ABOVE), "merkle-paths")
    return above


def manifest(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Within a source leaves ascend by ``doc_id``, null ids first; rows that repeat
    an id ascend by their leaf, so repeated rows are leaves of their own.  A null
    source is a source, before all others.  ``altered_text`` replaces the text of
    a row for ``folded_root`` (null: the row is not altered); ``verified`` tells
    whether that equals the root.  Null fields and empty texts are told apart.
    Other columns, whatever their names, play no part; an empty table gives an
    empty result.
    """
    columns = {f: F.col(f) for f in FIELDS}
    other = F.lit(None).cast("string") if altered_text is None else F.when(altered_text.isNotNull(), leaf_of(columns | {"text": altered_text}))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    leaves = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_of(columns).alias("digest"), other.alias("altered")), "merkle-leaves")
    levels = _levels(_placed(leaves, ["doc_id", "digest"]))
    ends = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    tops = written(_placed(ends, ["source_tree"]), "merkle-sources")
    top_levels = _levels(tops.select("tree", "pos", "n", "digest"))
    nothing = F.array().cast(_PATH)
    top = top_levels[-1].select("tree", F.lit(0).cast("long").alias("pos"), nothing.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    paths = _with_above(top_levels[0], _above_blocks(top_levels, top)).mapInArrow(_down_batches, _ABOVE)
    own = tops.select("pos", F.col("source_tree").alias("tree"), "digest").join(paths.select("pos", "path", "root"), "pos")
    above = own.select("tree", F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_above(levels[0], _above_blocks(levels, above)).mapInArrow(_proof_batches, schema)


def lower_cased_fifth() -> Column:
    """The text with A-Z lower-cased where 5 divides the CRC-32 of the id; else null."""
    return F.when(crc32_text(F.col("doc_id")) % 5 == 0, ascii_lower(F.col("text")))
