"""SimHash near-duplicate detection with Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits have, by the pigeonhole principle,
a segment without errors; in each other segment they differ in at most two
bits.  A segment, padded to 23 bits, is decoded with the perfect binary Golay
code [23, 12, 7] together with all its neighbours at distance one: the vector
half way between two segments at distance two is a neighbour of both, so both
decode to a common codeword.  Keys join the exact bits of one segment with each
codeword index of the next (one to six of them), candidates meet on a key and
are verified by counting differing bits.

Keys that more than ``max_bucket`` distinct fingerprints share are not joined
pair by pair: their members meet on the points at distance at most one instead
(at most 65 fingerprints lie around a point, all of them within two bits of one
another), so the work stays linear and no link is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, written

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Offset and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011


def fingerprint(text: bytes | None, seed: int = SEED, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles of a UTF-8 text, as an unsigned integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)))]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for whole in batches:
        for batch in pieces(whole):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


@lru_cache(1)
def golay_index() -> np.ndarray:
    """For each of the 2^23 vectors, the index of the only codeword within three bits."""
    message = np.arange(4096, dtype=np.int64)
    code = message << 11
    rest = code.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    code |= rest
    one = 1 << np.arange(23)
    pairs = [a ^ b for i, a in enumerate(one) for b in one[:i]]
    triples = [one[i] ^ one[j] ^ one[k] for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array([0, *one, *pairs, *triples], np.int64)
    index = np.empty(1 << 23, np.uint16)
    index[code[:, None] ^ errors[None, :]] = message[:, None].astype(np.uint16)
    return index


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of unsigned fingerprints; a row has 3 to 18 keys."""
    index, rows, keys = golay_index(), [], []
    segment = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for i in range(3):
        j = (i + 1) % 3
        near = np.concatenate([[0], 1 << np.arange(SEGMENTS[j][1])])
        found = np.sort(index[segment[j][:, None] ^ near[None, :]], axis=1).astype(np.int64)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        at = np.nonzero(new)
        rows.append(at[0])
        keys.append((i << 34) + (segment[i][at[0]] << 12) + found[at])
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = golay_keys(prints.view(np.uint64))
        for at in range(0, len(rows), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(prints[rows[part]]), pa.array(keys[part])], ["fp", "key"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint 0."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def links(prints: DataFrame, max_bucket: int = 256) -> DataFrame:
    """Edges (a > b) that connect all distinct ``fp`` at most two bits apart.

    Each linked pair of a key with at most ``max_bucket`` members is an edge;
    in larger ones each point's members are linked to the smallest of them.
    """
    keyed = prints.mapInArrow(_key_batches, "fp long, key long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = written(keyed.join(sizes, "key"), "simhash-keys")
    small = met.filter(F.col("members") <= max_bucket).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    direct = pairs.filter((F.col("a") > F.col("b")) & near).select("a", "b")
    crowd = met.filter(F.col("members") > max_bucket).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    centre = around.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("members")).filter("members > 1")
    stars = around.join(centre, "point").filter("fp > b").select(F.col("fp").alias("a"), "b")
    return direct.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): each node of ``edges`` (a > b) with the smallest node it reaches.

    Alternates large and small stars, each a grouped minimum and a join, until
    the edges no longer change; each round is checkpointed.
    """
    edges = edges.checkpoint()
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = small.distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Nulls and empty texts have fingerprint zero, which links like any other.
    Rows with a null id are returned with a null ``doc_id``; they connect others
    but never name a component, which is null if only such rows are in it.
    Repeated rows are each returned.  Other columns, whatever their names, play
    no part.  An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash-prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-groups")
    rooted = _rooted(groups, max_bucket)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(groups: DataFrame, max_bucket: int = 256) -> DataFrame:
    """``groups`` (a row for each fp) with the ``root`` of each one's component."""
    roots = components(links(groups.select("fp"), max_bucket)).withColumnRenamed("node", "fp")
    return groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
