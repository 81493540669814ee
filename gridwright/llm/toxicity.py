"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import held_out_column

#: Confirmed toxic texts and unlabelled texts that the model is fitted on at most, unless ``train`` is told otherwise.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 8_000
#: Features kept at most, toxic texts that a feature must be in, log ratio to the unlabelled at least, prefixes that are features, in bytes.
VOCABULARY, LEAST_TEXTS, LEAST_CONTRAST, PREFIXES = 4_000, 4, 0.7, (4, 5, 6)
#: Steps, step size, weight decay, and the slack and strength of the correction of a negative risk.
STEPS, RATE, DECAY, SLACK, STRENGTH = 300, 0.05, 1e-4, 0.0, 1.0

_TO_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    """Distinct words of a UTF-8 text: A-Z in lower case, ASCII signs as spaces."""
    return set(text.lower().translate(_TO_SPACE).split()) if text else set()


def features_of(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words marked by a star."""
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + b"*" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    index: dict[bytes, int]
    weight: np.ndarray
    bias: float

    def score(self, words: set[bytes]) -> float:
        """The words and beginnings that are known add up; a beginning counts once however many words have it."""
        index = self.index
        hit = {k for w in words if (k := index.get(w)) is not None}
        for n in PREFIXES:
            starts = {w[:n] for w in words if len(w) > n}
            hit.update(k for w in starts if (k := index.get(w + b"*")) is not None)
        z = self.bias + sum(self.weight[k] for k in hit)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(index: dict[bytes, int], positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimise prior * R+_P + max(0, R-_U - prior * R-_P) of the logistic loss over presence of features.

    Texts are the numbers of their features. Where the second part, the risk on negatives, falls below its slack, the
    step goes against it instead, as non-negative learning does. The result is the mean of the second half of the
    steps, as single ones go to and fro. Without positives the score is near 0 everywhere.
    """
    weight, bias = np.zeros(len(index)), float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    if not positive or not unlabelled or not index:
        return Model(index, weight, bias - 4 * (not positive))
    texts = [*positive, *unlabelled]
    at, row = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    p = len(positive)
    m, v, mb, vb = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    mean, mean_bias, averaged = np.zeros_like(weight), 0.0, 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, weights=weight[at], minlength=len(texts))
        s = sigmoid(z)
        negative = np.logaddexp(0, z)
        risk = negative[p:].mean() - prior * negative[:p].mean()
        if risk >= -SLACK:
            g = np.concatenate([(prior * (s[:p] - 1) - prior * s[:p]) / p, s[p:] / (len(texts) - p)])
        else:
            g = STRENGTH * np.concatenate([prior * s[:p] / p, -s[p:] / (len(texts) - p)])
        gw, gb = np.bincount(at, weights=g[row], minlength=len(weight)) + DECAY * weight, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        rate = RATE * np.sqrt(1 - step / (STEPS + 1))
        weight = weight - rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
        if 2 * step > STEPS:
            mean, mean_bias, averaged = mean + weight, mean_bias + bias, averaged + 1
    return Model(index, mean / averaged, float(mean_bias / averaged))


def train(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Fit on a bounded sample, taken in the order of a hash; labels only from rows whose crc32(doc_id) mod 5 is not 0.

    At most ``positive_rows`` confirmed and ``unlabelled_rows`` other texts are fitted on, further ones are left out; of their
    features the ``vocabulary`` most telling ones are kept. Scoring reads every text whole.

    Positives are rows of ``labels`` with toxic 1. Unlabelled texts come from all documents outside the held-out
    fold, whatever their label. The class prior is the share of toxic rows among the labelled. Labels that are
    neither 0 nor 1 are left out; of rows that repeat a doc_id one counts.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 0)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    n, toxic = usable.agg(F.count("*"), F.sum("toxic")).first()
    prior = float((toxic or 0) + 1) / (n + 2)
    ids = docs.where(F.col("doc_id").isNotNull() & (fold != 0)).select("doc_id")
    by = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    confirmed = usable.where("toxic = 1").select("doc_id").orderBy(*by).limit(positive_rows).select("doc_id", F.lit(1).alias("y"))
    others = ids.orderBy(*by).limit(unlabelled_rows).select("doc_id", F.lit(0).alias("y"))
    wanted = F.broadcast(confirmed.union(others))  # at most positive_rows + unlabelled_rows

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([b"\n".join(words_of(t.as_py())) for t in b.column(1).cast(pa.binary())], pa.binary())], names=["y", "words"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[y].update(features_of(set(text.as_py().split(b"\n")) - {b""}))
            every = list(seen[0] | seen[1])
            yield pa.record_batch([pa.array(every, pa.binary()), *(pa.array([seen[y][f] for f in every], pa.int64()) for y in (1, 0))], names=["feature", "p", "u"])

    sample = materialize(docs.select("doc_id", "text").join(wanted, "doc_id").select("y", "text").mapInArrow(words, "y int, words binary"))
    n_p, n_u = (sample.where(f"y = {y}").count() for y in (1, 0))
    tally = sample.mapInArrow(counts, "feature binary, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST_TEXTS)
    contrast = F.log((F.col("p") + 1) / (n_p + 2)) - F.log((F.col("u") + 1) / (n_u + 2))
    index = {bytes(r[0]): k for k, r in enumerate(tally.where(contrast >= LEAST_CONTRAST).orderBy((contrast * F.col("p")).desc(), "feature").select("feature").limit(vocabulary).collect())}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(index[f] for f in features_of(set(t.as_py().split(b"\n"))) if f in index) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([np.array(x, "<u4").tobytes() for x in found], pa.binary())], names=["y", "x"])

    got = sample.mapInArrow(numbers, "y int, x binary").toPandas().sort_values(["y", "x"])
    texts = [[np.frombuffer(x, "<u4") for x in got["x"][got["y"] == y]] for y in (1, 0)]
    return fit(index, texts[0], texts[1], prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    score estimates how likely ``labels.toxic`` is 1 from the words of the whole text alone; null counts as empty.
    An empty table gives no rows; without confirmed toxic texts all scores are near 0. Other columns are not read.
    """
    model = train(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.score(words_of(t.as_py())) for t in b.column(1).cast(pa.binary())], pa.float64())], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out_column(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored as toxic, columns as they are."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([model.score(words_of(t.as_py())) < 0.5 for t in column.cast(pa.binary())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
