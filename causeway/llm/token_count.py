"""Token counts by overlap resynchronisation: huge documents are encoded in overlapping chunks and spliced.

A document of more than CHUNK bytes is cut into chunks that overlap, and each chunk goes through the library as a whole.
The lengths of its tokens give where each of them starts. Neighbours are spliced at a boundary that is proven stable (a
space between two characters that aren't white space: there the pre-tokeniser begins a new piece whatever stands before
or after) and at which both encodings are seen to start a token. If the overlap holds none, it is widened; if the whole
next chunk holds none, the two become one longer chunk.

Of shorter documents, which need no splice, only distinct segments between stable boundaries go through the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.llm.textbatch import blocks, gathered, seams, segments
from causeway.runtime import lean, ship

#: Bytes of a chunk and of the first overlap tried; text bytes of one block; distinct segments in one generation of a worker's cache.
CHUNK, OVERLAP, BLOCK, CACHE = 1 << 15, 1 << 8, 2 << 20, 80_000
#: Segments and chunks given to the library at a time.
BATCH, CHUNKS = 10_000, 16


class Counter:
    """Counts for a plain byte-level vocabulary file of the tokenizers library, whose pieces begin at a space."""

    def __init__(self, file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{file}: not a plain byte-level vocabulary")
        if any(" " in t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"{file}: added tokens with spaces")
        special = {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, "<u2")
        for token, i in vocabulary.items():
            self.size[i] = special.get(i, len(token))  # one letter stands for each byte
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _sizes(self, distinct: list[bytes]) -> list[bytes]:
        """The lengths of the tokens of each segment, two bytes each."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for x in distinct:
            if x not in known:
                if (y := older.get(x)) is None:
                    new.append(x)
                else:
                    known[x] = y
        for first in range(0, len(new), BATCH):
            some = new[first : first + BATCH]
            row = [x for x in some if x[0] == 32 and x[1:2].isalnum() and x[-1:].isalnum()]  # between any two of them a new piece begins
            alone = list(set(some).difference(row))
            made = self.tokenizer.encode_batch_fast([b"".join(row).decode(), *(x.decode() for x in alone)], add_special_tokens=False)
            sizes = self.size[made[0].ids]
            ends = np.searchsorted(np.cumsum(sizes, dtype=np.int64), np.cumsum([len(x) for x in row])) + 1 if row else np.zeros(0, np.int64)
            flat, ends = sizes.tobytes(), [0, *(2 * ends).tolist()]
            known.update(zip(row, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
            for x, e in zip(alone, made[1:], strict=True):
                known[x] = self.size[e.ids].tobytes()
        return [known[x] for x in distinct]

    def starts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Where each token of each text starts, in bytes, as the library encodes the whole of it."""
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False), strict=True):
            ends = np.cumsum(self.size[e.ids], dtype=np.int64)
            if (int(ends[-1]) if len(ends) else 0) != len(text):
                raise ValueError("tokens and text differ in length")
            out.append(ends - self.size[e.ids])
        return out

    def boundary(self, stable: np.ndarray, now: np.ndarray, following: np.ndarray, begin: int, end: int) -> int | None:
        """A stable place between begin and end at which both encodings start a token, the middle one of all."""
        common = stable[np.searchsorted(stable, begin + 1) : np.searchsorted(stable, end - 1)]
        common = common[np.isin(common, now) & np.isin(common, following)]
        return int(common[len(common) // 2]) if len(common) else None

    def long(self, data: np.ndarray, stable: np.ndarray | None = None) -> int:
        """Tokens of a text of more than one chunk, given as its bytes; `stable` are the places at which splices are proven."""
        stable, size = seams(data) if stable is None else stable, len(data)

        def at_character(x: int) -> int:
            while 0 < x < size and data[x] & 0xC0 == 0x80:
                x -= 1
            return x

        begins = sorted({at_character(x) for x in range(0, size, self.chunk)})
        ends = [min(size, x + self.overlap) for x in begins[1:]] + [size]
        spans = [(a, at_character(b)) for a, b in zip(begins, ends, strict=True)]
        total, at, end, now = 0, 0, 0, np.zeros(0, np.int64)  # the text up to `at` is counted; `at` is 0 or a boundary
        for group in range(0, len(spans), CHUNKS):
            some = [x for x in spans[group : group + CHUNKS] if x[1] > end]
            for (begin, stop), following in zip(some, self.starts([data[a:b].tobytes() for a, b in some]), strict=True):
                following = following + begin
                if not begin:
                    now, end = following, stop
                if stop <= end:
                    continue
                cut, wide = self.boundary(stable, now, following, max(at, begin), end), self.overlap
                while cut is None and end < stop:
                    self.widened += 1
                    wide *= 4
                    # beyond the next chunk, what isn't counted yet becomes one chunk of twice the length
                    end = at_character(max(begin + wide, end + 1)) if begin + wide < stop else at_character(min(size, max(stop, 2 * end - at)))
                    now = self.starts([data[at:end].tobytes()])[0] + at
                    cut = self.boundary(stable, now, following, max(at, begin), min(end, stop))
                if cut is not None and end < stop:
                    total += int(np.searchsorted(now, cut))
                    now, at, end = following[np.searchsorted(following, cut) :], cut, stop
        return total + len(now)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document of a block."""
        sizes = np.diff(offsets)
        huge = sizes > self.chunk
        out = np.zeros(len(sizes), np.int64)
        if not huge.all():
            kept = data[np.repeat(~huge, sizes)] if huge.any() else data
            begin, which, distinct = segments(kept, np.concatenate([[0], np.cumsum(sizes[~huge])]))
            n = np.fromiter(map(len, self._sizes(distinct)), np.int64, len(distinct)) // 2
            out[~huge] = np.diff(np.concatenate([[0], np.cumsum(n[which])])[begin])
        for i in np.flatnonzero(huge):
            out[i] = self.long(data[offsets[i] : offsets[i + 1]])
        return out


_counters: dict[tuple, Counter] = {}


def count_tokens(docs: DataFrame, file: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library for the whole text, without added special tokens; special strings inside a text are
    what the library makes of them. Null and empty texts have no bytes and no tokens. Repeated rows, doc_ids and missing
    ones give a row each. Other columns are ignored; an empty table gives no rows. A text of any length is encoded in
    chunks; only one without any space between two other characters goes through the library at once.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counters.get((file, chunk, overlap)) or Counter(file, chunk, overlap)
        _counters[file, chunk, overlap] = counter
        for part, data, offsets in blocks(batches, most=BLOCK):
            n = counter.count(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
