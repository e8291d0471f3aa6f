"""Best-fit packing of token sequences with a grouping genetic algorithm.

Texts are tokenized whole, once; only lengths travel on.  Pieces of a full
sequence's length stand alone, the others are dealt by a row number into shards
of a bounded size.  On each shard several islands evolve populations of
packings, which start from pieces in random order: crossover injects whole
well-filled bins of one parent into the other, bins that hold a duplicate are
removed and their displaced pieces placed by best fit, largest first.  Between
epochs each island's elite migrates to the next island; at the end the best
packing of each shard is taken.
"""

from __future__ import annotations

import struct
import zlib
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, written

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = np.zeros(1, "<u4").tobytes()
#: Marks that end a word; with no apostrophe, which may belong to a contraction.
MARKS = b".,;:!?%&$#*|()[]\"-"
#: How byte-level vocabularies show bytes that are no printable character: by characters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Pieces of a shard, about.
SHARD = 32768
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 5
POPULATION = 4
SEED = 29
#: Tasks of a stage that evolves islands, at most; beyond it a task takes several.
MAX_TASKS = 100_000
#: Words whose ids a worker keeps, none longer than WORD_BYTES; as many that it met before stay at hand.
CACHE = 100_000
WORD_BYTES = 32
#: Bytes of text that are worked on at a time (or one text).
CHUNK = 4 << 20
_CACHES: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary drops white space and joins nothing across it, so a text's
    ids are those of its words one after the other.  Words are kept in lower
    case (the vocabulary's own first step) with their ids; unknown ones are
    encoded together, a chunk at a time.  Texts that may hold a special token's
    string, which is told apart by case, are encoded as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.coded = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.cache, self.old = _CACHES.setdefault(path, ({}, {}))

    def _whole(self, text: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of a word of lower-case letters only: the vocabulary's first steps leave it as it is, so its model is asked at once."""
        text = word.decode("utf-8", "replace")
        if not text.isalpha():
            return None
        if not word.isascii():
            if text != text.lower() or not is_normalized("NFC", text):
                return None
            text = word.decode("latin-1").translate(BYTE_LETTERS)
        coded = self.coded
        return b"".join([coded[t.id] for t in self.model.tokenize(text)])

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of ``words``, which the cache does not hold.

        Marks after a letter are encoded apart, as the vocabulary does, so a
        word is encoded once whatever follows it.  What is no plain word is
        encoded with others in one text.
        """
        cache, old = self.cache, self.old
        if len(cache) > CACHE:
            old.clear()
            old.update(cache)
            cache.clear()
        ends, new, asked, found = {}, [], [], {}
        for w in words:
            ids = old.get(w)
            if ids is not None:
                found[w] = ids
                continue
            bare = w.rstrip(MARKS)
            if len(bare) < len(w) and bare[-1:].isalpha():
                ends[w] = (bare, w[len(bare) :])
                asked += ends[w]
            else:
                asked.append(w)
        for w in dict.fromkeys(asked):
            if w not in found:
                ids = cache.get(w)
                ids = self._plain(w) if ids is None else ids
                if ids is None:
                    new.append(w)
                else:
                    found[w] = ids
        if new:
            texts = [w.decode("utf-8", "replace") for w in sorted(new)]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.asarray(got.ids, "<u4").tobytes()
            begin = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids) // 4)
            starts = np.cumsum([0] + [len(x) + 1 for x in texts])
            cuts = (4 * np.searchsorted(begin, starts)).tolist()
            for w, a, b in zip(sorted(new), cuts, cuts[1:]):
                found[w] = ids[a:b]
        for w, (bare, tail) in ends.items():
            found[w] = found[bare] + found[tail]
        cache.update((w, ids) for w, ids in found.items() if len(w) <= WORD_BYTES)
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text and a final 0.

        Each different word of the texts is looked up once; ids are then laid
        out by its number.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.find_substring(texts, "<|").to_numpy(zero_copy_only=False) >= 0
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.cache.get, words))
        lacking = [w for w, ids in zip(words, found) if ids is None]
        if lacking:
            learnt = self._learn(lacking)
            found = [learnt[w] if ids is None else ids for w, ids in zip(words, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        known = np.frombuffer(b"".join(found) + END, "<u4")
        sizes = np.append(sizes, 1)  # the last stands for the end of a text
        starts = np.cumsum(sizes) - sizes
        bounds = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        which = np.insert(numbered.indices.to_numpy(zero_copy_only=False), bounds[1:], len(words))
        n = sizes[which]
        upto = np.cumsum(n)
        ids = known[np.repeat(starts[which] - (upto - n), n) + np.arange(upto[-1])]
        ends = upto[bounds[1:] + np.arange(len(texts))]
        out = np.split(ids, ends[:-1])
        for i in np.flatnonzero(special):
            out[i] = np.frombuffer(self._whole(texts[i].as_py().encode()) + END, "<u4")
        return out


def _piece_batches(path: str, capacity: int):
    def run(batches):
        tokenizer = WordTokenizer(path)
        for whole in batches:
            for batch in by_bytes(whole, 1, CHUNK):
                out: list[tuple] = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1))):
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        out.append((doc_id, piece, at, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and a final 0, cut only beyond ``capacity``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_piece_batches(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], order: list[int], bins: list[list[int]], capacity: int) -> None:
    """Puts the items of ``order`` each into the fullest of ``bins`` that still takes it, or a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, items in enumerate(bins):
        free = capacity - sum(lengths[i] for i in items)
        room[free].append(b)
        mask |= 1 << free
    for i in order:
        n = lengths[i]
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            stack = room[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        free -= n
        room[free].append(b)
        mask |= 1 << free


def fitness(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    fill = np.bincount(placed(bins, len(lengths)), lengths, len(bins)) / capacity
    return -len(bins), float((fill**2).mean()) if len(bins) else 0.0


def placed(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of each item."""
    where = np.empty(n, np.int64)
    where[np.fromiter((i for x in bins for i in x), np.int64, n)] = np.repeat(np.arange(len(bins)), [len(x) for x in bins])
    return where


def crossover(lengths: np.ndarray, a: list[list[int]], b: list[list[int]], rng: np.random.Generator, capacity: int) -> list[list[int]]:
    """``a`` with a third of ``b``'s well-filled bins, those of the fewest items, injected whole, and the emptiest of its other bins, from two fifths to all of them, dissolved."""
    n = len(lengths)
    in_a, in_b = placed(a, n), placed(b, n)
    fill = np.bincount(in_b, lengths, len(b))
    good = np.nonzero(fill >= 0.98 * capacity)[0]
    if not len(good):
        good = np.argsort(-fill, kind="stable")[: max(1, len(b) // 4)]
    # bins of few large items first: small ones still fill gaps elsewhere
    items = np.bincount(in_b, minlength=len(b))[good] + rng.random(len(good))
    taken = np.sort(good[np.argsort(items)[: max(1, len(good) // 3)]])
    have = np.isin(in_b, taken)
    free = capacity - np.bincount(in_a, lengths, len(a))
    free[in_a[have]] = -1  # they hold a duplicate
    gone = free < 0
    gone[np.argsort(-free, kind="stable")[: max(1, int((~gone).sum() * rng.uniform(0.4, 1)))]] = True
    loose = np.flatnonzero(gone[in_a] & ~have)
    child = [list(b[i]) for i in taken] + [list(a[i]) for i in np.flatnonzero(~gone)]
    best_fit(lengths.tolist(), loose[np.argsort(-lengths[loose], kind="stable")].tolist(), child, capacity)
    return child


def first_packing(lengths: np.ndarray, rng: np.random.Generator, capacity: int) -> list[list[int]]:
    """Best fit of the items in random order."""
    bins: list[list[int]] = []
    best_fit(lengths.tolist(), rng.permutation(len(lengths)).tolist(), bins, capacity)
    return bins


def evolve(lengths: np.ndarray, population: list[list[list[int]]], rng: np.random.Generator, capacity: int, size: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[list[list[int]]], int]:
    """Steady-state evolution: the packings, the best first, and the generations that it took.

    Stops at the lower bound on bins, or after three generations without fewer.
    """
    bound = -(-int(lengths.sum()) // capacity)
    rated = [(fitness(lengths, x, capacity), x) for x in population]
    while len(rated) < size:
        x = first_packing(lengths, rng, capacity)
        rated.append((fitness(lengths, x, capacity), x))
    done, counts = 0, []
    while True:
        rated.sort(key=lambda r: r[0], reverse=True)
        del rated[size:]
        counts.append(-rated[0][0][0])
        if done == generations or counts[-1] <= bound or (done > 3 and counts[-1] == counts[-4]):
            return [x for _, x in rated], done
        done += 1
        for _ in range(size // 2):
            i, j = rng.permutation(len(rated))[:2] if len(rated) > 1 else (0, 0)
            x = crossover(lengths, rated[i][1], rated[j][1], rng, capacity)
            rated.append((fitness(lengths, x, capacity), x))


def _coded(bins: list[list[int]], n: int) -> bytes:
    return placed(bins, n).astype(np.int32).tobytes()


def _decoded(code: bytes) -> list[list[int]]:
    where = np.frombuffer(code, np.int32)
    order = np.argsort(where, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(where))[:-1])]


#: ``first_bins`` is the best of the random packings that an island began with, ``generations`` what it has evolved since.
ISLAND = "shard int, island int, lengths binary, packing binary, bins int, fill double, first_bins int, generations int"


def _island_epoch(capacity: int, epoch: int, seed: int, generations: int):
    """Evolves an island from its own elite and its immigrant; yields the new elite."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        code = rows["lengths"].iloc[0]
        lengths = np.frombuffer(code, np.int32).astype(np.int64)
        rng = np.random.default_rng([seed, shard, island, epoch])
        found = [_decoded(p) for p in sorted(p for p in rows["packing"] if p is not None)]
        if found:
            first, before = int(rows["first_bins"].min()), int(rows["generations"].max())
        else:
            found = [first_packing(lengths, rng, capacity) for _ in range(POPULATION)]
            first, before = min(map(len, found)), 0
        best, done = evolve(lengths, found, rng, capacity, generations=generations)
        bins, fill = fitness(lengths, best[0], capacity)
        row = {"shard": shard, "island": island, "lengths": code, "packing": _coded(best[0], len(lengths)), "bins": -bins, "fill": fill, "first_bins": first, "generations": before + done}
        return pd.DataFrame([row])

    return run


def _unpack(capacity: int, dealt: int):
    """Gives each piece of a shard its place in the best packing."""

    def run(key: tuple, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], kind="stable").reset_index(drop=True)
        full = (rows["length"] == capacity).to_numpy()
        bins = np.arange(len(rows), dtype=np.int64)
        if len(best):
            where = np.frombuffer(best.sort_values(["bins", "fill", "island"], ascending=[True, False, True])["packing"].iloc[0], np.int32)
            bins[~full] = where
            bins[full] = int(where.max()) + 1 + np.arange(full.sum())
        rows["sequence_id"] = bins * dealt + int(key[0])
        rows = rows.sort_values(["sequence_id", "row"], kind="stable")
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def _gather(capacity: int):
    """The lengths below ``capacity`` of a shard, in the order that ``_unpack`` sorts them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(rows["length"].to_numpy())
        return pd.DataFrame({"shard": [int(key[0])], "lengths": [lengths[lengths < capacity].astype(np.int32).tobytes()]})

    return run


def evolved(gathered: DataFrame, dealt: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED, generations: int = GENERATIONS) -> DataFrame:
    """The elite of each island (``ISLAND``) after all epochs, for ``gathered`` (shard, lengths)."""
    # a row of an island stands for much work, so numbers of tasks are given: rows this small would be merged into one
    spread = lambda df, n, *keys: df.repartition(min(n, MAX_TASKS), *keys)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("packing", "binary"), ("first_bins", "int"), ("generations", "int"))]
    met = gathered.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", *nothing)
    elite = None
    for epoch in range(epochs):
        if elite is not None:
            migrants = elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            met = (elite.unionByName(migrants) if islands > 1 else elite).select(*met.columns)
        elite = written(spread(met, dealt * islands, "shard", "island").groupBy("shard", "island").applyInPandas(_island_epoch(capacity, epoch, seed, generations), ISLAND), "packing-elite")
    return elite


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (doc_id, piece, start, length, ids_crc32; lengths 1 to ``capacity``).

    Rows that repeat a piece are packed as pieces of their own and dealt like
    others.  Equal lengths are told apart by the number of their row.
    """
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    dealt = max(1, round(parts.count() / shard))
    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(dealt)).cast("int"))
    gathered = sharded.select("shard", "length").groupBy("shard").applyInPandas(_gather(capacity), "shard int, lengths binary").filter(F.length("lengths") > 0)
    elite = evolved(gathered, dealt, capacity, islands, epochs, seed).drop("lengths")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return sharded.groupBy("shard").cogroup(elite.groupBy("shard")).applyInPandas(_unpack(capacity, dealt), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: where it lies in which sequence.

    A null or empty text is the single id 0; texts of any length are cut only
    into pieces of ``capacity``.  Null ids are packed like others; repeated rows
    are each packed; ties are told apart by row.  Columns besides doc_id and
    text, whatever their names, play no part.  An empty table gives an empty
    result.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, capacity), capacity)
