"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with ordered thresholds theta and one
weight vector w shared by all of them.  Features are the presence of words and
of four-character word beginnings; those that speak for or against toxicity are
selected by a grouped count over the labelled texts.  The model is fitted on the
driver on at most ``MAX_ROWS`` labelled rows, half of each class, and has at most
``MAX_FEATURES`` features, so what is fetched and broadcast is bounded; every
text is scored whole.

Where labels only tell toxic from clean, grades of the toxic rows come from
cross-fitting: a model with one threshold is fitted on each half of the rows,
and a toxic row of the other half is graded 2 if that model, which has not seen
it, puts it at or above the median of the toxic rows there, else 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, written

#: Labelled rows used for fitting, at most (half of them toxic).
MAX_ROWS = 4096
MAX_FEATURES = 1024
#: Features must differ between the classes by so many standard errors, either way.
MIN_Z = 4.0
PREFIX = 4
#: Documents of at least this probability of a grade above 0 are toxic.
THRESHOLD = 0.5
#: Words that a task keeps the features of, none longer than WORD_BYTES.
CACHE = 60_000
WORD_BYTES = 32
PUNCTUATION = b".,;:!?\"'()[]{}<>|%&$#*-_/\\"


def word_features(word: bytes) -> tuple[int, ...]:
    """Feature hashes of a lower-cased word: the bare word and its beginning."""
    bare = word.strip(PUNCTUATION)
    if not bare:
        return ()
    whole = xxhash.xxh64_intdigest(bare, 1) >> 1
    start = bare.decode("utf-8", "ignore")[: PREFIX + 1]
    return (whole,) if len(start) <= PREFIX else (whole, xxhash.xxh64_intdigest(start[:PREFIX].encode(), 2) >> 1)


def text_features(text: bytes | None) -> set[int]:
    return {f for w in set((text or b"").lower().split()) for f in word_features(w)}


def _feature_batches(batches):
    for whole in batches:
        for batch in pieces(whole):
            found = [sorted(text_features(t)) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "grade", "features"])


class OrdinalModel:
    """Selected feature hashes, their shared weights and the ordered thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def probabilities(self, activation: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; rows as ``activation``."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - activation[:, None], -60, 60)))


def fit(grades: np.ndarray, offsets: np.ndarray, values: np.ndarray, steps: int = 800, ridge: float = 1e-4) -> OrdinalModel:
    """Fits by Adam on the mean log-likelihood, classes weighing alike; ``values[offsets[i]:offsets[i+1]]`` are row i's features.

    Without rows, or with rows of one grade only, no feature is used and the
    thresholds give the grade that there is (grade 0 if none).
    """
    top = int(grades.max()) if len(grades) else 0
    if len(grades) == 0 or top == 0 or int(grades.min()) > 0:
        sure = 20.0 if top == 0 else -20.0
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(max(top, 1), sure))
    known, column = np.unique(values, return_inverse=True)
    chosen = np.arange(len(known))
    x = np.zeros((len(grades), len(known)), np.float32)
    x[np.repeat(np.arange(len(grades)), np.diff(offsets)), column] = 1
    toxic = grades > 0
    n1, n0 = toxic.sum(), (~toxic).sum()
    cuts = np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / len(grades)
    start = np.log(cuts / np.maximum(1 - cuts, 1e-6))
    # thresholds: the first, then the logs of the gaps, so that they stay ordered
    p = np.concatenate([np.zeros(len(chosen)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    balance = np.where(toxic, 0.5 / n1, 0.5 / n0)
    for step in range(1, steps + 1):
        w, gaps = p[: len(chosen)], np.exp(p[len(chosen) + 1 :])
        theta = p[len(chosen)] + np.concatenate([[0], np.cumsum(gaps)])
        a = x @ w.astype(np.float32)
        upper = np.concatenate([theta, [np.inf]])[grades] - a
        lower = np.concatenate([[-np.inf], theta])[grades] - a
        su, sl = 1 / (1 + np.exp(-np.clip(upper, -60, 60))), 1 / (1 + np.exp(-np.clip(lower, -60, 60)))
        mass = np.maximum(su - sl, 1e-9)
        gu, gl = su * (1 - su) / mass * balance, -sl * (1 - sl) / mass * balance
        at = np.zeros(top)
        np.add.at(at, grades[grades < top], gu[grades < top])
        np.add.at(at, grades[grades > 0] - 1, gl[grades > 0])
        tail = np.cumsum(at[::-1])[::-1]
        grad = -np.concatenate([-(x.T @ (gu + gl).astype(np.float32)), [tail[0]], tail[1:] * gaps])
        grad[: len(chosen)] += ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = p[len(chosen)] + np.concatenate([[0], np.cumsum(np.exp(p[len(chosen) + 1 :]))])
    return OrdinalModel(known[chosen], p[: len(chosen)], theta)


def sample_labels(labels: DataFrame, grade: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, grade): at most ``max_rows`` labelled ids, half of grade 0, the first by a hash of the id.

    Rows with a null id or grade are left out; of several grades of one id the
    highest counts.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
    part = lambda c: clean.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
    return part("grade > 0").unionByName(part("grade <= 0"))


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grades, offsets and values of fetched rows, in the order of their ids."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("grade").to_pylist(), table.column("features").to_pylist()))
    grades = np.array([max(r[1], 0) for r in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int64)
    return grades, offsets, np.array([f for r in rows for f in r[2]], np.int64)


def _part(rows: np.ndarray, grades: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the rows, in the same form."""
    found = [values[offsets[i] : offsets[i + 1]] for i in rows]
    return grades[rows], np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)


def cross_grades(grades: np.ndarray, offsets: np.ndarray, values: np.ndarray, steps: int = 200) -> np.ndarray:
    """Grades 0, 1 and 2 for rows of grades 0 and 1: see the module's text."""
    out = grades.copy()
    half = np.arange(len(grades)) % 2 == 0
    for part in (half, ~half):
        seen = np.flatnonzero(~part)
        model = fit(*_part(seen, grades, offsets, values), steps=steps)
        toxic = np.flatnonzero(part & (grades > 0))
        if not len(toxic):
            continue
        place = {int(f): w for f, w in zip(model.features, model.weights)}
        act = np.array([sum(place.get(int(f), 0.0) for f in values[offsets[i] : offsets[i + 1]]) for i in toxic])
        out[toxic] = 1 + (act >= np.median(act))
    return out


def selected(rows: DataFrame, n1: int, n0: int, min_z: float = MIN_Z, most: int = MAX_FEATURES) -> list[int]:
    """The features of ``rows`` (grade, features) whose shares in toxic and clean rows differ most, by a grouped count."""
    counts = rows.select((F.col("grade") > 0).cast("int").alias("toxic"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("has"), F.count("*").alias("total"))
    share = F.col("total") / F.lit(n0 + n1)
    z = (F.col("has") / F.lit(max(n1, 1)) - (F.col("total") - F.col("has")) / F.lit(max(n0, 1))) / F.sqrt(share * (1 - share) * F.lit(1 / max(n0, 1) + 1 / max(n1, 1)) + 1e-12)
    return [r.f for r in counts.withColumn("z", F.abs(z)).filter(F.col("z") >= min_z).orderBy(F.col("z").desc(), "f").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, grade: str = "grade", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fits on the labelled documents; ``grade`` of ``labels`` is 0 for clean texts.

    Of documents that share a labelled id the text with the smallest hash
    counts.  If no labelled row has a grade above 1, grades come from
    ``cross_grades``.  Without labels, or documents that have them, every text is
    clean.
    """
    chosen = sample_labels(labels, grade, max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(one.alias("text"))
    rows = written(found.mapInArrow(_feature_batches, "doc_id long, grade int, features array<long>"), "toxicity-rows")
    sizes = rows.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") <= 0)).first()
    features = selected(rows, sizes[0], sizes[1]) if sizes[0] and sizes[1] else []
    known = F.array(*map(F.lit, features)) if features else F.array().cast("array<long>")
    grades, offsets, values = _rows(rows.select("doc_id", "grade", F.array_intersect("features", known).alias("features")).toArrow())
    if grades.size and grades.max() == 1 and grades.min() == 0:
        grades = cross_grades(grades, offsets, values)
    return fit(grades, offsets, values)


class _Scorer:
    """Activation of texts, with the weights of words kept between texts."""

    def __init__(self, model: OrdinalModel):
        self.place = {int(f): i for i, f in enumerate(model.features)}
        self.model, self.cache = model, {}

    def activation(self, text: bytes | None) -> float:
        cache, place, found = self.cache, self.place, set()
        for w in set((text or b"").lower().split()):
            hit = cache.get(w)
            if hit is None:
                hit = tuple(place[f] for f in word_features(w) if f in place)
                if len(w) <= WORD_BYTES:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = hit
            if hit:
                found.update(hit)
        return float(self.model.weights[sorted(found)].sum()) if found else 0.0

    def chances(self, texts: list[bytes | None]) -> np.ndarray:
        return self.model.probabilities(np.array([self.activation(t) for t in texts]))


def score(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest by thresholds), toxic (0 or 1) of every row.

    Null and empty texts have no feature; long ones are read whole.  Repeated
    rows and null ids are returned as they are; a chance that equals a threshold
    reaches it.  Other columns, whatever their names, play no part.  An empty
    table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(held.value)
        for whole in batches:
            for batch in pieces(whole):
                p = scorer.chances(batch.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array((p[:, 0] >= threshold).astype(np.int32))],
                    ["doc_id", "severity", "grade", "toxic"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, severity double, grade int, toxic int")


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns kept, without a shuffle.

    Each row is judged by its own text: null ids, repeated rows and columns of
    any name stay as they are; null and empty texts are not toxic by themselves.
    """
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(held.value)
        for whole in batches:
            for batch in pieces(whole):
                p = scorer.chances(batch.column(at).cast(pa.binary()).to_pylist())
                yield batch.filter(pa.array(p[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)
