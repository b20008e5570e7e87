"""Language identification by prediction by partial matching with frozen statistics.

For each language a byte context tree of depth DEPTH counts what follows every context in a bounded sample of labelled
documents. In context c, with N bytes seen of q kinds, a byte seen n times has probability n / (N + q) and an escape to
the next shorter context has q / (N + q); below the empty context lies 1 / 256. Statistics are frozen before scoring, so
each (context, byte) has one exact code length, and the length of a document under a language is the sum over all its
bytes. The union of all languages' contexts is one table that a whole Arrow batch is looked up in at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.textbatch import blocks, per_document
from causeway.runtime import lean, ship

DEPTH = 3
#: Whole documents of each language in the training sample, and about how many bytes of them.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 4 << 20
#: A context is kept if some language saw it this often.
LEAST_SEEN = 4

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SCORE_BLOCK = 1 << 18


class Trees:
    """Code lengths in bits: cost[node, symbol, language], and child tables from newest to oldest context byte.

    Every context that some language saw LEAST_SEEN times is a node, so the sample bounds the tables. `most_nodes`, if
    given, keeps only so many of the most frequent ones, of each language, for those who need smaller tables.
    """

    def __init__(self, samples: dict[str, list[bytes]], most_nodes: int | None = None):
        self.langs = sorted(samples)
        used = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                used[np.frombuffer(t, np.uint8)] = True
        n = int(used.sum())
        self.symbol = np.full(256, n, np.int32)  # n: a byte never seen in training
        self.symbol[used] = np.arange(n)
        self.none = n + 1  # before a document's first byte
        counts = [self._counts(samples[x], n + 2) for x in self.langs]
        L = len(self.langs)
        cost = [np.full((n + 1, L), 8.0)]
        for i, by_depth in enumerate(counts):
            self._row(cost[0][:, i], by_depth[0].get((), {}))
        self.child: list[np.ndarray] = []
        level = {(): 0}
        for depth in range(1, DEPTH + 1):
            seen: dict[tuple, int] = {}
            for by_depth in counts:
                for context, followers in by_depth[depth].items():
                    seen[context] = max(seen.get(context, 0), sum(followers.values()))
            room = None if most_nodes is None else max(0, most_nodes * L - len(cost))
            wanted = sorted((c for c, m in seen.items() if m >= LEAST_SEEN and c[1:] in level), key=lambda c: (-seen[c], c))[:room]
            table = np.repeat(np.arange(len(cost), dtype=np.int32)[:, None], n + 2, 1)
            new: dict[tuple, int] = {}
            for context in wanted:
                parent = level[context[1:]]
                row = cost[parent].copy()
                for i, by_depth in enumerate(counts):
                    if followers := by_depth[depth].get(context):
                        self._row(row[:, i], followers)
                new[context] = len(cost)
                table[parent, context[0]] = len(cost)
                cost.append(row)
            self.child.append(table)
            level = new
        self.cost = np.stack(cost).astype(np.float32) if L else np.zeros((1, n + 1, 0), np.float32)

    @staticmethod
    def _row(row: np.ndarray, followers: dict[int, int]) -> None:
        total, kinds = sum(followers.values()), len(followers)
        if total:
            row += np.log2((total + kinds) / kinds)
            for s, m in followers.items():
                row[s] = np.log2((total + kinds) / m)

    def _counts(self, texts: list[bytes], base: int) -> list[dict[tuple, dict[int, int]]]:
        out: list[dict[tuple, dict[int, int]]] = []
        for depth in range(DEPTH + 1):
            codes = []
            for t in texts:
                s = self.symbol[np.frombuffer(t, np.uint8)].astype(np.int64)
                if len(s) > depth:
                    code = np.zeros(len(s) - depth, np.int64)
                    for j in range(depth + 1):
                        code = code * base + s[j : len(s) - depth + j]
                    codes.append(code)
            u, c = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), [])
            table: dict[tuple, dict[int, int]] = {}
            for x, m in zip(u.tolist(), list(map(int, c)), strict=True):
                x, s = divmod(x, base)
                context = []
                for _ in range(depth):
                    x, y = divmod(x, base)
                    context.append(y)
                table.setdefault(tuple(reversed(context)), {})[s] = m
            out.append(table)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each document (row) under each language (column), over all its bytes."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for first in range(0, len(data), SCORE_BLOCK):
            last = min(first + SCORE_BLOCK, len(data))
            s = self.symbol[data[max(0, first - DEPTH) : last]]
            back = first - max(0, first - DEPTH)
            own = s[back:]
            doc = slice(int(np.searchsorted(offsets, first, "right")) - 1, int(np.searchsorted(offsets, last, "left")))
            starts = offsets[doc.start : doc.stop]
            since = np.arange(first, last) - np.repeat(np.maximum(starts, 0), np.diff(np.clip(offsets[doc.start : doc.stop + 1], first, last)))
            node = np.zeros(last - first, np.int32)
            for d in range(1, DEPTH + 1):
                before = np.full(last - first, self.none, np.int32)
                lag = s[max(0, back - d) : len(s) - d] if len(s) > d else s[:0]
                before[len(before) - len(lag) :] = lag
                before[since < d] = self.none
                node = self.child[d - 1][node, before]
            local = np.clip(offsets[doc.start : doc.stop + 1], first, last) - first
            out[doc] += per_document(self.cost[node, own], local)
        return out


def learnable() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, most_nodes: int | None = None) -> Trees:
    """Trees from whole texts of each non-null lang, those with the smallest hashes of doc_id: at most sample_docs, and about sample_bytes in all.

    The share taken of each language comes from counts over all rows. A language always gives one text at least, however
    long its texts are; null and empty texts teach nothing.
    """
    rows = docs.where(learnable() & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("at"))
    counts = {r["lang"]: (r["n"], r["size"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if not counts:
        return Trees({})
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.3 * sample_docs / n, 1.3 * sample_bytes / size))) for k, (n, size) in counts.items()])
    got: dict[str, list[bytes]] = {k: [] for k in counts}
    room = dict.fromkeys(counts, sample_bytes)
    for r in rows.where(F.col("at") < share).orderBy("at", "doc_id", F.xxhash64("text")).limit(2 * sample_docs * len(counts)).collect():
        text, own = r["text"].encode(), got[r["lang"]]
        if len(own) < sample_docs and (room[r["lang"]] > 0 or not own):
            own.append(text)
            room[r["lang"]] -= len(text)
    if none := [k for k, own in got.items() if not own]:
        for r in rows.where(F.col("lang").isin(none)).groupBy("lang").agg(F.min_by("text", F.struct(F.octet_length("text"), "at")).alias("text")).collect():
            got[r["lang"]].append(r["text"].encode())
    return Trees(got, most_nodes)


#: A text that takes more bits a byte than this under every language, and SLACK_BITS more, is in none of them: plain bytes
#: are as short, and the slack lets pass short texts with a few rare characters.
MOST_BITS, SLACK_BITS = 8.0, 64


def _judged(model: Trees, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and bits_per_byte of each document."""
    bits = model.bits(data, offsets)
    lettered = per_document(LETTER[data], offsets, np.int64) > 0
    n = np.diff(offsets)
    for i in np.flatnonzero(~lettered & (n > 0)):
        lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    if not model.langs:
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n))
    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    langs = [model.langs[b] if ok else "und" for b, ok in zip(bits.argmin(1), lettered, strict=True)]
    return langs, np.where(lettered, score, 0.0), bits.min(1) / np.maximum(n, 1)


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, lang_pred, score, bits_per_byte.

    lang_pred has the shortest code; score is its probability given equal priors; bits_per_byte its code length. A text
    that is null or has no letter is `und` with score 0, as is every text if nothing could be learned. Ties go to the
    first language by name. Repeated rows, doc_ids and missing ones give a row each. Other columns are ignored; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches):
            langs, score, bits = _judged(shared.value, part.column(1), data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, bits_per_byte double")


def in_a_language(docs: DataFrame, trees: Trees, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not `und` and takes under most_bits bits a byte, and SLACK_BITS, in its language.

    Without anything to learn from, only texts without a letter go.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches):
            langs, _, bits = _judged(shared.value, part.column(at), data, offsets)
            keep = (np.array(langs) != "und") & (bits * np.diff(offsets) < most_bits * np.diff(offsets) + SLACK_BITS) if shared.value.langs else np.array([any(c.isalpha() for c in t or "") for t in part.column(at).to_pylist()], bool)
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
