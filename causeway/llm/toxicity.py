"""Toxicity as a severity grade: cumulative-link (proportional odds) ordinal regression on sparse text features.

P(grade <= j | x) = sigmoid(theta_j - w x) for ordered thresholds theta_0 < theta_1 < ..., with one weight vector w for
all of them. The output is the expected severity, the sum of P(grade > j).

Features are hashed lower-case words of a document, each with 1 + log of how often it comes up; an L1 penalty leaves
weight on few of them. Labels know only toxic or not, so toxic training rows are graded by how sure another model is of
them: the training rows are dealt into two halves by a hash, and a toxic row's evidence is the sum of the log odds that
its words have in the other half. Grades 1, 2 and 3 are the thirds of that evidence. No row grades itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.textbatch import WORDLIKE, blocks, word_hashes, word_spans
from causeway.runtime import lean, ship

BITS = 18
#: Labelled rows in the training sample, and the longest text (bytes) that enters it.
SAMPLE_ROWS, SAMPLE_LONGEST = 8_000, 16_384
#: A word is evidence with at least these log odds and in at least so many toxic rows of the other half.
LEAST_ODDS, LEAST_DOCS = 2.5, 3
GRADES = 3
L1, STEPS, RATE = 5e-4, 400, 0.2
#: A grade is passed with at least this probability.
THRESHOLD = 0.4


@dataclass
class Ordinal:
    """Weights by word bucket, and the ordered thresholds."""

    weights: np.ndarray
    theta: np.ndarray

    def severity(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j, from the linear part."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - x[:, None], -40, 40)))


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each word."""
    starts, ends = word_spans(data, offsets, WORDLIKE)
    h = word_hashes(data, starts, ends)
    return np.searchsorted(offsets, starts, "right") - 1, (h >> np.uint64(64 - BITS)).astype(np.int64)


def _pairs(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket), and the feature's value there."""
    code, count = np.unique(doc << BITS | bucket, return_counts=True)
    return code >> BITS, code & ((1 << BITS) - 1), 1 + np.log(count)


def evidence(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, half: np.ndarray) -> np.ndarray:
    """For each row, the sum of the log odds of its words in the other half of the rows; doc and bucket are distinct pairs."""
    size, out = 1 << BITS, np.zeros(len(toxic))
    for own in (False, True):
        other = half != own
        n1, n0 = int(toxic[other].sum()), int((1 - toxic)[other].sum())
        in1, in0 = (np.bincount(bucket, (x * other)[doc], size) for x in (toxic, 1 - toxic))
        odds = np.log((in1 + 0.1) / (n1 + 0.2)) - np.log((in0 + 0.1) / (n0 + 0.2))
        odds[(odds < LEAST_ODDS) | (in1 < LEAST_DOCS)] = 0
        out += np.bincount(doc, odds[bucket], len(toxic)) * ~other
    return out


def loss(w: np.ndarray, theta: np.ndarray, rows: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray) -> float:
    """Mean log loss of the grades plus the L1 penalty."""
    x = np.bincount(rows, w[column] * value, len(grade))
    below = np.concatenate([np.zeros((len(x), 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - x[:, None], -40, 40))), np.ones((len(x), 1))], 1)
    own = np.diff(below, axis=1)[np.arange(len(x)), grade]
    return float(-np.log(np.maximum(own, 1e-9)).mean() + L1 * np.abs(w).sum())


def descend(rows: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by proximal gradient descent, steps scaled by past gradients."""
    n, used, top = len(grade), int(column.max(initial=-1)) + 1, int(grade.max())
    w, edge, every = np.zeros(used), np.zeros((n, 1)), np.arange(n)
    share = np.array([(grade > j).mean() for j in range(top)])
    theta = np.log((1 - share) / share)
    seen_w, seen_t = np.full(used, 1e-8), np.full(top, 1e-8)
    for _ in range(steps):
        x = np.bincount(rows, w[column] * value, n)
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - x[:, None], -40, 40)))
        slope = below * (1 - below)
        own = np.maximum(np.diff(np.concatenate([edge, below, edge + 1], 1), axis=1)[every, grade], 1e-9)
        steep = np.concatenate([edge, slope, edge], 1)
        by_x = (steep[every, grade + 1] - steep[every, grade]) / own / n
        by_w = np.bincount(column, by_x[rows] * value, used)
        by_theta = np.array([((grade == j + 1) * slope[:, j] / own - (grade == j) * slope[:, j] / own).mean() for j in range(top)])
        seen_w, seen_t = seen_w + by_w**2, seen_t + by_theta**2
        rate = RATE / np.sqrt(seen_w)
        w = w - rate * by_w
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        theta = np.maximum.accumulate(theta - RATE / np.sqrt(seen_t) * by_theta + 1e-9 * np.arange(top))
    return w, theta


def fit_texts(texts: list[bytes], toxic: np.ndarray) -> Ordinal:
    """The regression on labelled texts; if all have one label, nothing is learned and nothing is toxic."""
    size = 1 << BITS
    if not len(texts) or toxic.min() == toxic.max():
        return Ordinal(np.zeros(size), np.array([30.0, 31.0, 32.0]))
    offsets = np.cumsum([0, *map(len, texts)])
    doc, bucket, value = _pairs(*_buckets(np.frombuffer(b"".join(texts), np.uint8), offsets))
    half = np.array([bool(crc32(t) & 1) for t in texts])
    found = evidence(doc, bucket, toxic, half)
    thirds = np.quantile(found[toxic > 0], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic > 0, 1 + np.searchsorted(np.unique(thirds), found), 0)
    used, column = np.unique(bucket, return_inverse=True)
    w, theta = descend(doc, column, value, grade)
    weights = np.zeros(size)
    weights[used] = w
    return Ordinal(weights, theta)


def learnable() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_LONGEST) -> Ordinal:
    """From at most `rows` labelled whole texts, half of them toxic where there are so many, of at most `longest` bytes, never held-out ones.

    The sample is the rows with the smallest hashes of doc_id, so it doesn't depend on partitioning; the driver gets
    2 * rows texts at most. A doc_id that is labelled both ways gives a row of either kind. No labels: nothing is toxic.
    """
    known = labels.where(learnable() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return fit_texts([], np.zeros(0, np.int64))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, 0.6 * rows / c))) for k, c in counts.items()])
    some = known.where(at < share).orderBy(at, "doc_id").limit(2 * rows)
    read = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where((F.octet_length("text") <= longest) & (F.octet_length("text") > 0))
    got = read.orderBy(at, "doc_id", F.xxhash64("text")).limit(2 * rows).collect()
    taken = [r for kind in (0, 1) for r in [x for x in got if x["toxic"] == kind][: rows // 2]]
    return fit_texts([r["text"].encode() for r in taken], np.array([r["toxic"] for r in taken], np.int64))


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, severity (expected grade), p_toxic (of grade 1 or more), grade (passed with THRESHOLD), toxic (grade 1 or more).

    Null and empty texts have severity 0 and aren't toxic. Whole texts are read. Repeated rows, doc_ids and missing ones
    give a row each. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        active = m.weights != 0
        for part, data, offsets in blocks(batches):
            doc, bucket = _buckets(data, offsets)
            some = active[bucket]
            d, b, value = _pairs(doc[some], bucket[some])
            p = m.severity(np.bincount(d, m.weights[b] * value, len(offsets) - 1))
            p[np.diff(offsets) == 0] = 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= THRESHOLD).sum(1).astype(np.int32)), pa.array(p[:, 0] >= THRESHOLD)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
