"""Document quality by Bradley-Terry pairwise ranking.

Every pair of a training document marked good and one marked bad says that the first is preferred. The probability of
that preference is the sigmoid of the difference of their scores, scores are linear in the features, and the weights
minimise the mean logistic loss on feature differences. Features are surface ones (what the bytes are, how words repeat)
and lexical ones (the share of words in each of LEXICAL buckets of word hashes). The decision is a quantile of the scores: the share of the
training documents that are marked bad lies below it.

Training takes every labelled row and every pair. Pairs aren't formed: the loss and its derivatives depend on two scores
through functions of their difference that are analytic, so POINTS values in each panel of scores give them to rounding,
and what rows contribute to those points is added up by passes over the rows. The loss with its penalties is strictly
convex, so where the steps begin changes their number but not where they end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.textbatch import NOT_BLANK, blocks, byte_counts, word_hashes, word_spans
from causeway.runtime import discard, lean, ship, staged

#: Penalties on surface and lexical weights, most Newton steps, and buckets of word hashes.
L2, L2_LEXICAL, ROUNDS, LEXICAL = 1e-3, 3e-2, 40, 256
#: Width of a panel of scores and points in it. The sigmoid's poles are pi away, so the error is about (pi + sqrt(pi^2 + 1))^-18.
PANEL, POINTS = 2.0, 18
#: Tasks that add up what the passes over the training rows give, and rows whose own minimum is where the steps begin.
MERGERS, START_ROWS = 4, 6_000
#: A score of this is at the decision quantile.
CUT = 0.3

_CLASSES = np.zeros((256, 7), np.float32)
_CLASSES[[*range(97, 123)], 0] = 1  # lower-case ASCII
_CLASSES[[*range(65, 91)], 1] = 1  # upper-case ASCII
_CLASSES[[*range(48, 58)], 2] = 1  # digits
_CLASSES[[ord(c) for c in ".,;:?'\"()-"], 3] = 1  # punctuation of prose
_CLASSES[[ord(c) for c in "#$%&*@^~+=<>[]{}\\/_`"], 4] = 1  # symbols
_CLASSES[ord("|"), 5] = 1
_CLASSES[ord("!"), 6] = 1
FEATURES = ("lower", "upper", "digit", "prose_marks", "symbols", "bars", "shouts", "repeat", "distinct", "word_length", "longest_run", "no_period", "log_words")


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of each document and how many of its words are in each bucket, taken from the text alone."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)[:, None]
    seen = byte_counts(data, offsets)
    share = seen @ _CLASSES / size
    starts, ends = word_spans(data, offsets, NOT_BLANK)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    h = word_hashes(data, starts, ends)
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    repeat = np.bincount(doc, again, n) / words
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, n) / np.sqrt(words)
    length = np.bincount(doc, ends - starts, n) / words
    longest = np.zeros(n)
    np.maximum.at(longest, doc, (ends - starts).astype(float))
    stops = seen[:, 46]
    lexical = np.bincount(doc * LEXICAL + (h >> np.uint64(32)).astype(np.int64) % LEXICAL, minlength=n * LEXICAL).reshape(n, LEXICAL)
    ratio = np.log1p(100 * share)
    return np.column_stack([ratio, np.log1p(100 * repeat), np.log1p(distinct), np.log1p(length), np.log1p(longest), np.log1p(words / (1 + stops)), np.log(words)]), lexical


def joined(surface: np.ndarray, lexical: np.ndarray) -> np.ndarray:
    """All features from measures()."""
    return np.column_stack([surface, np.sqrt(lexical / np.maximum(lexical.sum(1), 1)[:, None])])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES and the lexical ones of each document, all bounded and taken from the text alone."""
    return joined(*measures(data, offsets))


def _design(z: np.ndarray) -> np.ndarray:
    """Standardised features, and the squares of the surface ones."""
    z = np.clip(z, -8, 8)
    return np.column_stack([z, z[:, : len(FEATURES)] ** 2])


@dataclass
class Ranker:
    """Standardisation, weights and the decision point."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores, each added up in the same order whatever rows stand beside it."""
        return (_design((x - self.mean) / self.scale) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, rising with the Bradley-Terry score, and CUT at the decision quantile."""
        at = np.log(CUT / (1 - CUT)) + (self.raw(x) - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


_PACKED = np.dtype([("surface", "<f8", len(FEATURES)), ("lexical", "<u4", LEXICAL)])
_ANGLES = (np.arange(POINTS) + 0.5) * np.pi / POINTS
_TO_POINTS = np.cos(np.outer(np.arange(POINTS), _ANGLES)) * 2 / POINTS
_TO_POINTS[0] /= 2

#: Arrays by (kind, panel), and what adds up a function's ones over blocks of rows.
Sums = dict[tuple[int, int], np.ndarray]
Total = Callable[[Callable[[np.ndarray, np.ndarray], Sums]], Sums]


def _points(panel: int) -> np.ndarray:
    """The scores at the points of a panel."""
    return (panel + 0.5 + 0.5 * np.cos(_ANGLES)) * PANEL


def _shares(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The panel of each score, and the weights with which values at its points give a smooth function's value at the score."""
    panel = np.floor(raw / PANEL).astype(np.int64)
    return panel, np.cos(np.outer(np.arccos(np.clip(2 * (raw / PANEL - panel) - 1, -1, 1)), np.arange(POINTS))) @ _TO_POINTS


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of training rows."""
    rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), _PACKED)
    return joined(rows["surface"], rows["lexical"]), batch.column(0).to_numpy()


def _sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
    """What `of` gives for blocks of the training rows, added up over all of them; partitions are added in their order."""
    schema = "kind int, panel long, line int, part int, amount binary"

    def table(found: dict, part: int) -> pa.RecordBatch:
        kind, panel, line = zip(*found, strict=True) if found else ((), (), ())
        amounts = [x.tobytes() for x in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(panel, pa.int64()), pa.array(line, pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array(amounts, pa.binary())], ["kind", "panel", "line", "part", "amount"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            for key, x in of(*_unpacked(batch)).items():
                total[key] = total[key] + x if key in total else x
        yield table({(*key, i): line for key, x in total.items() for i, line in enumerate(x)}, TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for kind, panel, line, amount in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                x, key = np.frombuffer(amount), (kind, panel, line)
                total[key] = total[key] + x if key in total else x
        yield table(total, 0)

    keys = ["kind", "panel", "line"]
    parts = rows.select("good", "x").mapInArrow(lean(add), schema).repartition(MERGERS, *keys).sortWithinPartitions(*keys, "part")
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in sorted(parts.mapInArrow(lean(merge), schema).collect(), key=lambda r: (r["kind"], r["panel"], r["line"])):
        out.setdefault((r["kind"], r["panel"]), []).append(np.frombuffer(r["amount"]))
    return {key: np.array(lines) for key, lines in out.items()}


def _by_panel(good: np.ndarray, panel: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The rows of each kind and panel."""
    for kind in (0, 1):
        for p in np.unique(panel[good == kind]):
            yield (kind, int(p)), np.flatnonzero((good == kind) & (panel == p))


def _other(at: Sums, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Differences good - bad of scores between the points of a panel and those of all panels of the other kind, and what is there."""
    panels = [p for kind, p in at if kind != key[0]]
    points = np.concatenate([_points(p) for p in panels])
    return (2 * key[0] - 1) * (_points(key[1])[:, None] - points), np.concatenate([at[1 - key[0], p] for p in panels])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _newton(total: Total, mean: np.ndarray, scale: np.ndarray, pairs: float, w: np.ndarray) -> np.ndarray:
    """The weights that minimise the mean logistic loss over all pairs, plus the penalties, by Newton steps from w that are halved while they raise it."""
    width = len(FEATURES) + LEXICAL
    penalty = np.full(width + len(FEATURES), L2)
    penalty[len(FEATURES) : width] = L2_LEXICAL

    def weighed(w: np.ndarray) -> tuple[float, Sums]:
        """The loss, and how many rows each point stands for."""
        model = Ranker(mean, scale, w, 0.0, 1.0)

        def of(x: np.ndarray, good: np.ndarray) -> Sums:
            panel, share = _shares(model.raw(x))
            return {key: share[some].sum(0)[:, None] for key, some in _by_panel(good, panel)}

        mass = total(of)
        loss = 0.0
        for key in mass:
            if key[0]:
                difference, there = _other(mass, key)
                loss += float(mass[key][:, 0] @ np.logaddexp(0, -difference) @ there[:, 0])
        return loss / pairs + float(penalty @ w**2) / 2, mass

    loss, mass = weighed(w)
    for _ in range(ROUNDS):
        pull, curve = {}, {}
        for key in mass:
            difference, there = _other(mass, key)
            p = _sigmoid(difference)
            pull[key], curve[key] = (1 - p) @ there[:, 0] / pairs, (p * (1 - p)) @ there[:, 0] / pairs
        model = Ranker(mean, scale, w, 0.0, 1.0)

        def of(x: np.ndarray, good: np.ndarray, model: Ranker = model, curve: Sums = curve) -> Sums:
            z = _design((x - model.mean) / model.scale)
            panel, share = _shares(model.raw(x))
            out, own = {}, np.empty(len(z))
            for key, some in _by_panel(good, panel):
                out[key] = share[some].T @ z[some]
                own[some] = share[some] @ curve[key]
            return out | {(2, 0): (z * own[:, None]).T @ z}

        at = total(of)
        hessian = at.pop((2, 0)) + np.diag(penalty)
        gradient = penalty * w
        for key, x in at.items():
            gradient = gradient + (1 - 2 * key[0]) * (pull[key] @ x)
            if key[0]:
                difference, there = _other(at, key)
                p = _sigmoid(difference)
                across = x.T @ ((p * (1 - p)) @ there) / pairs
                hessian -= across + across.T
        step = np.linalg.solve(hessian, gradient)
        if np.abs(step).max() < 1e-7:  # the next one would be about its square
            return w - step
        while True:
            new_loss, new_mass = weighed(w - step)
            if new_loss <= loss + 1e-12:
                break
            step = step / 2
        w, loss, mass = w - step, new_loss, new_mass
    return w


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, given the bits; its own inverse."""
    return x ^ ((x >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _quantile(scores: DataFrame, share: float, n: int) -> float:
    """The exact quantile of n scores (column at: _sortable), linear between two; found 16 bits at a time by counts."""
    rank, part = divmod(share * (n - 1), 1)
    below, left, found, many = 0, scores, 0, 0
    for shift in (48, 32, 16, 0):
        here = F.shiftright("at", shift)
        for found, many in sorted((r["b"], r["n"]) for r in left.groupBy(here.alias("b")).agg(F.count("*").alias("n")).collect()):
            if below + many > rank:
                break
            below += many
        left = left.where(here == found)
    after = found if below + many > rank + 1 else scores.where(F.col("at") > found).agg(F.min("at")).first()[0]
    low, high = _sortable(np.array([found, found if after is None else after], np.int64)).view(np.float64)
    return float(low + part * (high - low))


def fit_rows(rows: DataFrame) -> Ranker:
    """From all rows of rows(good, x), where x is what training_rows() packs. Rounded, so that the order of sums doesn't show."""
    width = len(FEATURES) + LEXICAL
    first = _sums(rows, lambda x, good: {(0, 0): np.concatenate([[(good == 0).sum(), (good > 0).sum()], x.sum(0)])[None]})
    bad, good, *total = first[0, 0][0] if first else np.zeros(2 + width)
    n = bad + good
    mean = np.round(np.array(total) / max(n, 1), 10)
    if not bad or not good:
        return Ranker(mean, np.ones(width), np.zeros(width + len(FEATURES)), 0.0 if good else 1.0, 1.0)
    variance = _sums(rows, lambda x, good: {(0, 0): ((x - mean) ** 2).sum(0)[None]})[0, 0][0] / n
    scale = np.round(np.maximum(np.sqrt(variance), 1e-6), 10)
    weights = np.zeros(width + len(FEATURES))
    some = rows.select("good", "x").orderBy(F.xxhash64("x"), "good").limit(START_ROWS).toArrow().combine_chunks().to_batches()
    x, kind = _unpacked(some[0])
    if 0 < kind.sum() < len(kind):
        weights = _newton(lambda of: of(x, kind), mean, scale, float(kind.sum() * (1 - kind).sum()), weights)
    model = Ranker(mean, scale, np.round(_newton(partial(_sums, rows), mean, scale, bad * good, weights), 8), 0.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_unpacked(batch)[0]) + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(_sortable(raw.view(np.int64)))], ["raw", "at"])

    scores = staged(rows.select("good", "x").mapInArrow(lean(run), "raw double, at long"), "quality-scores")
    try:
        model.spread = max(round(scores.agg(F.stddev_pop("raw")).first()[0], 10), 1e-6) / 2
        model.cut = _quantile(scores, bad / n, int(n))
    finally:
        discard(scores)
    return model


def learnable() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, x) of every labelled row that isn't held out, x its measures(). Texts aren't shuffled, only what is measured of them."""
    known = labels.where(learnable() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("good")).distinct()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches):
            rows = np.zeros(len(offsets) - 1, _PACKED)
            rows["surface"], rows["lexical"] = measures(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "x"])

    return docs.where(learnable()).select("doc_id", "text").mapInArrow(lean(run), "doc_id long, x binary").join(known, "doc_id").select("good", "x")


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    """From every labelled whole text, of any length, empty and null ones too, never held-out ones.

    The driver gets sums only. A doc_id that is labelled both ways gives a row of either kind. Without labels of both
    kinds all scores are equal: good if there are good ones, bad otherwise.
    """
    rows = staged(training_rows(docs, labels), "quality-rows")
    try:
        return fit_rows(rows)
    finally:
        discard(rows)


def rank(docs: DataFrame, model: Ranker) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, score (0 to 1, higher is better), predicted (1 if score >= 0.3).

    Null texts are scored as empty ones. Whole texts are read, and nothing but the text, so equal texts have equal
    scores; a score that ties with the decision quantile counts as good. Without both kinds of labels all scores are
    equal. Repeated rows, doc_ids and missing ones give a row each. Other columns are ignored; an empty table gives no
    rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches):
            s = shared.value.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")
