"""Near copies by similarity: wide SimHash fingerprints with Golay-code keys.

Where ``simhash`` links fingerprints at two bits of 64, this links texts whose
sets of word shingles have an estimated Jaccard similarity of ``similarity`` or
more.  A fingerprint has 512 bits over the distinct shingles of a text; two
texts of similarity J differ in about arccos(2 J / (1 + J)) / pi of them, so the
bound on differing bits follows from the similarity (77 bits for 0.8, where the
estimate is within 0.04 of the similarity for two texts in three).

Candidates: 128 of the bits are cut into six segments.  Each is decoded with the
Golay code to the codeword indices of itself and its neighbours at distance one
(about seven indices).  By the pigeonhole principle some segment has few errors,
and there the two texts share an index.  An index alone has 12 bits, so unrelated
texts would meet on it in numbers that grow with the square of the input.  A key
is therefore a segment's index together with the text's smallest shingle hash
under that segment's own mixing: texts of similarity J have the same smallest
hash with probability J, others hardly ever.  Texts that share a key are verified
by counting differing bits, first of one word, then of all, in the join in which
they meet.

Keys that more than ``max_bucket`` texts share: each text is compared with the
first one of one of its buckets.  Then, a few times over, those of a bucket that are not in
its largest component are compared with one text of that component, and in the
end with all of the bucket that are still in other components; pairs within a
component need no comparison.  So no link that a bucket holds is lost, and a
group of copies of one another costs work in proportion to its size.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, written
from tessera.llm.simhash import components, golay_index

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint; the first tells texts apart, the next two make the keys.
WORDS = 8
SEED = 7
MAX_BUCKET = 64
#: Offset and width of the segments of words 1 and 2 taken together.
SEGMENTS = ((0, 21), (21, 21), (42, 22), (64, 21), (85, 21), (106, 22))
#: Comparisons of a crowded bucket with one text of its largest component, before the rest is compared.
ROUNDS = 2
#: Differing bits of the first word that a candidate may have: the mean at 0.8 is 9.7, three deviations more are 18.
FIRST_BITS = 18
_STEPS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
PRINT = [f"f{i}" for i in range(WORDS)]
#: Smallest mixed shingle hash for each segment.
LEAST = [f"m{i}" for i in range(len(SEGMENTS))]


def differing_bits(similarity: float, bits: int = 64 * WORDS) -> int:
    """Bits in which fingerprints of texts of this similarity differ, on average."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, A-Z in lower case; of fewer words the whole sequence is one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((digest(b" ".join(x), SEED) for x in grams), np.uint64, max(1, len(words) - shingle + 1)))


def wide_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """WORDS unsigned words; a bit is set that is set in over half of the mixed hashes.  All zero without words."""
    return fingerprint_and_least(text, shingle)[0]


def fingerprint_and_least(text: bytes | None, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint, and the smallest hash under each of the WORDS mixings (the largest number without words)."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64 * WORDS, np.int64)
    least = np.full(WORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        mixed = hashes[at : at + 8192, None] + _STEPS
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, mixed.min(0))
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8"), least


def _print_batches(shingle: int):
    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                words = np.stack([np.concatenate([w, m[: len(LEAST)]]) for w, m in (fingerprint_and_least(t, shingle) for t in texts)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(words[:, i]) for i in range(words.shape[1]))], ["doc_id", "hash", *PRINT, *LEAST])

    return run


def segment_keys(one: np.ndarray, two: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the 128 bits in two arrays of unsigned words, with a row's smallest hashes in ``least``.

    A key has the lower 49 bits of the smallest hash, three of the segment's
    number and twelve of the codeword index.
    """
    index, rows, keys = golay_index(), [], []
    for i, (at, width) in enumerate(SEGMENTS):
        word = one if at < 64 else two
        part = (word >> np.uint64(at % 64) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.concatenate([[0], 1 << np.arange(width)])
        found = np.sort(index[part[:, None] ^ flips[None, :]], axis=1).astype(np.uint64)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        row = np.nonzero(first)[0]
        rows.append(row)
        keys.append((least[row, i] << np.uint64(15)) + np.uint64(i << 12) + found[first])
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _key_batches(batches):
    for whole in batches:
        for batch in pieces(whole, 4096):
            node, one, two, *least = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3 + len(LEAST)))
            rows, keys = segment_keys(one, two, np.stack(least, axis=1))
            for at in range(0, len(rows), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(node[rows[part]].view(np.int64))], ["key", "f0"])


def _apart(a: str, b: str, words: list[str]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in words))


def links(groups: DataFrame, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(edges, roots) of ``groups`` (a row for each f0, with f0 to f7 and m0 to m5).

    Edges (a > b) are verified links; roots (node, root) has the component of each node.
    """
    most = differing_bits(similarity)
    keyed = groups.select("f0", "f1", "f2", *LEAST).mapInArrow(_key_batches, "key long, f0 long")
    shared = written(keyed.groupBy("key").agg(F.min("f0").alias("lead"), F.max("f0").alias("last"), F.count("*").alias("members")).filter("members > 1"), "near-keys")
    # a row for each text with the keys that it shares with two texts or more, of which it has 23 a segment at most
    crowds = keyed.join(shared.filter("members > 2").select("key", "lead", "members"), "key")
    few = F.col("members") <= max_bucket
    keys = crowds.groupBy("f0").agg(F.collect_list(F.when(few, F.col("key"))).alias("small"), F.collect_list(F.when(~few, F.col("key"))).alias("large"), F.min(F.when(~few, F.col("lead"))).alias("lead"))
    texts = written(keys.join(groups.select(*PRINT), "f0"), "near-crowds")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= FIRST_BITS

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter((F.col("a") > F.col("b")) & near).distinct()
        for side in "ab":
            pairs = pairs.join(groups.select(F.col("f0").alias(side), *(F.col(w).alias(f"{side}{w}") for w in PRINT[1:])), side)
        return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + _apart("a", "b", PRINT[1:]) <= most).select("a", "b")

    def alike(a: str, b: str) -> Column:
        return (_apart(a, b, PRINT[:1]) <= FIRST_BITS) & (_apart(a, b, PRINT) <= most)

    # pairs of a key are compared where they meet, so that only links leave the join
    first, second = (texts.select(F.explode("small").alias("key"), *(F.col(w).alias(f"{side}{w}") for w in PRINT)) for side in "ab")
    within = first.join(second, (first["key"] == second["key"]) & (F.col("af0") > F.col("bf0")) & alike("a", "b")).select(F.col("af0").alias("a"), F.col("bf0").alias("b"))
    direct = shared.filter("members = 2").select(F.col("last").alias("a"), F.col("lead").alias("b"))
    # one star a text: the smallest first text of its crowded keys; the rounds below see to the rest
    stars = texts.filter("lead IS NOT NULL").select(F.col("f0").alias("a"), F.col("lead").alias("b"))
    edges = written(verified(direct.unionByName(stars)).unionByName(within).distinct(), "near-links")
    # copies of one another have many links: first the outermost of each text, then what these leave apart
    outer = edges.groupBy("a").agg(F.min("b").alias("b"))
    found = components(outer).withColumnRenamed("node", "f0")
    roots = written(groups.select("f0").join(found, "f0", "left").select("f0", F.coalesce("root", "f0").alias("root")), "near-roots")

    def merged(more: DataFrame) -> DataFrame:
        """``roots`` with the components joined that ``more`` links: only components are nodes of that graph."""
        for side in "ab":
            more = more.join(roots.select(F.col("f0").alias(side), F.col("root").alias(f"{side}_root")), side)
        between = more.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).filter("a > b").distinct()
        new = components(between).select(F.col("node").alias("root"), F.col("root").alias("new"))
        return roots.join(new, "root", "left").select("f0", F.coalesce("new", "root").alias("root"))

    roots = written(merged(edges), "near-roots")

    # crowded buckets whose members lie in several components
    crowd, main = texts.filter(F.size("large") > 0), None
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        placed = crowd.join(roots, "f0").select("root", *(PRINT if last else PRINT[:1]), F.explode("large").alias("key"))
        if main is not None:
            placed = placed.join(main.select("key"), "key", "left_semi")  # the other buckets are in one piece
        placed = written(placed, "near-placed")
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("f0", F.xxhash64("f0", F.lit(turn))).alias("one"))
        main = parts.groupBy("key").agg(F.max_by(F.struct("root", "one"), F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main.*")
        main = written(main.withColumnRenamed("root", "main"), "near-main")
        if main.isEmpty():
            break
        others = placed.join(main, "key").filter("root <> main")
        if not last:
            more = verified(others.select(F.col("f0").alias("a"), F.col("one").alias("b")))
        else:
            left, right = (x.select("key", F.col("root").alias(f"{side}_root"), *(F.col(w).alias(f"{side}{w}") for w in PRINT)) for x, side in ((others, "a"), (placed, "b")))
            apart = F.col("a_root") != F.col("b_root")
            more = left.join(right, (left["key"] == right["key"]) & apart & alike("a", "b")).select(F.greatest("af0", "bf0").alias("a"), F.least("af0", "bf0").alias("b")).distinct()
        more = written(more, "near-links")
        if not more.isEmpty():
            edges = edges.unionByName(more).distinct()
            roots = written(merged(more), "near-roots")
    return edges, roots.withColumnRenamed("f0", "node")


def prints_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return written(narrow.mapInArrow(_print_batches(shingle), "doc_id long, hash long, " + ", ".join(f"{w} long" for w in [*PRINT, *LEAST])), "near-prints")


def grouped(prints: DataFrame, *more: Column) -> DataFrame:
    """A row for each f0: the fingerprint of one text that has it (equal first words leave no doubt of similarity), and ``more`` aggregates."""
    words = F.min(F.struct(*PRINT[1:], *LEAST))
    return prints.groupBy("f0").agg(words.alias("w"), *more).select("f0", "w.*", *(c for c in ("first", "n")[: len(more)]))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest id that it reaches over links.

    Null and empty texts are copies of each other.  Rows with a null id are
    returned with a null ``doc_id``; a component without any id has a null
    component.  Repeated rows are each returned; columns besides the two play no
    part, whatever their names; an empty table gives an empty result.
    """
    prints = prints_of(docs, id_col, text_col, shingle)
    groups = written(grouped(prints, F.min("doc_id").alias("first")), "near-groups")
    rooted = _rooted(groups, similarity, max_bucket)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "f0").join(rooted.select("f0", "root"), "f0").join(named, "root").select("doc_id", "component_id")


def _rooted(groups: DataFrame, similarity: float, max_bucket: int) -> DataFrame:
    _, roots = links(groups, similarity, max_bucket)
    return groups.join(roots.withColumnRenamed("node", "f0"), "f0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row of each component of near copies in ``docs``, with the columns of ``docs``.

    It is the one with the smallest id (rows without an id come last) and, of
    those with the same id, the smallest text hash; of rows that repeat both,
    any.  Components are told apart by fingerprint, so rows with null or
    repeated ids are lost only to their own copies.  Null and empty texts are
    one component.  Columns of ``docs`` may have any names.
    """
    d = F.col("doc_id")
    prints = prints_of(docs, id_col, text_col, shingle)
    groups = written(grouped(prints, F.min(F.struct(d.isNull().alias("none"), d, "hash")).alias("first")), "near-groups")
    first = _rooted(groups, similarity, max_bucket).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    # docs go on as one struct, so that no column of theirs can clash
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    kept = marked.join(first.select(F.col("doc_id").alias("one"), F.col("hash").alias("one_hash")), d.eqNullSafe(F.col("one")) & (F.col("hash") == F.col("one_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "hash"]).select("row.*")
