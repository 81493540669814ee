"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most, taken in the order of a hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Trees, their depth, bins of a feature, shrinkage, regularisation of a leaf and rows of a leaf at least.
TREES, DEPTH, BINS, RATE, LAMBDA, LEAF_ROWS = 60, 4, 64, 0.15, 1.0, 8

FEATURES = ("log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_neighbours", "commonest_word", "log_lines", "distinct_lines", "line_bytes", "upper", "digits", "spaces", "bars", "symbols", "stops", "other_ascii", "beyond_ascii", "largest_byte")

#: Class of each byte: upper case, digit, white space, bar, symbol, stop, other printable, control, lower case, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = 0 if 65 <= _c <= 90 else 1 if 48 <= _c <= 57 else 2 if _c in b" \t\n\r\x0b\x0c" else 3 if _c == 124 else 4 if _c in b"#$%&*+=@^_~<>/\\{}[]" else 5 if _c in b".,;:!?" else 7 if _c < 32 or _c == 127 else 8 if 97 <= _c <= 122 else 9 if _c > 127 else 6


def statistics(text: bytes | None) -> list[float]:
    """The features of one UTF-8 text; null counts as empty."""
    text = text or b""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=10) / n
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    return [np.log1p(len(text)), np.log1p(len(words)), len(text) / m, len(tally) / m, neighbours / m, max(tally.values(), default=0) / m, np.log1p(len(lines)), len(set(lines)) / len(lines), len(text) / len(lines), share[0], share[1], share[2], share[3], share[4], share[5], share[6] + share[7], share[9], counts.max() / n]


@dataclass
class Forest:
    """Trees flattened into arrays: node k of a tree has the children 2k+1 and 2k+2, its leaves follow its inner nodes."""

    feature: np.ndarray  # trees x (2^depth - 1)
    limit: np.ndarray  # go left at or below it
    value: np.ndarray  # trees x 2^depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += value[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting of the logistic loss over binned features. Without rows the score is 0.5; with one class it is near that class."""
    nodes = 2**DEPTH - 1
    prior = (y.sum() + 1) / (len(y) + 2)
    out = Forest(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), float(np.log(prior / (1 - prior))))
    if len(y) == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw = np.full(len(y), out.base)
    features, limits, values = [], [], []
    n_features = x.shape[1]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, limit, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * n_features + np.arange(n_features)) * BINS + bins
            shape = (width, n_features, BINS)
            sums = [np.bincount(cell.ravel(), weights=np.repeat(w, n_features), minlength=width * n_features * BINS).reshape(shape).cumsum(axis=2) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + LAMBDA) + (ga - gl) ** 2 / (ha - hl + LAMBDA) - ga**2 / (ha + LAMBDA)
            gain[(nl < LEAF_ROWS) | (na - nl < LEAF_ROWS)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], limit[first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = at - nodes
        value = -RATE * np.bincount(leaf, weights=g, minlength=nodes + 1) / (np.bincount(leaf, weights=h, minlength=nodes + 1) + LAMBDA)
        raw += value[leaf]
        features.append(feature), limits.append(limit), values.append(value)
    return Forest(np.array(features), np.array(limits), np.array(values), out.base)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(y, text) of at most ``rows`` labelled documents outside the held-out fold, in the order of a hash."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold != held_out)).select("doc_id", F.col(label).cast("int").alias("y")).dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").dropDuplicates(["doc_id"]).select("y", "text")


def held_out_column(modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest for ``labels.quality``, fitted on at most ``sample_rows`` labelled rows; further ones are left out, in the order of a hash.

    Statistics are taken on the executors; the driver sees ``sample_rows`` x FEATURES numbers at most.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(statistics(t), np.float64).tobytes() for t in _texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], names=["y", "x"])

    got = labelled_sample(docs, labels, "quality", 4, 2, sample_rows).mapInArrow(features, "y int, x binary").toPandas().sort_values(["y", "x"])
    x = np.stack([np.frombuffer(v) for v in got["x"]]) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    score estimates how likely ``labels.quality`` is 1, from statistics of the whole text alone; null counts as empty.
    Learns from rows whose crc32(doc_id) mod 4 is not 2; labels that are neither 0 nor 1 and all but one row of a doc_id
    are left out. Without labels every score is 0.5, with labels of one class all are that class's share. Very long texts are
    read whole, one at a time; equal texts have equal scores; other columns are not read.
    """
    forest = train(docs, labels, sample_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in _texts(b.column(1))]).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([b.column(0), pa.array(forest.score(x))], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out_column(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
