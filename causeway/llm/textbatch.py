"""Whole Arrow text columns as byte arrays: words, word hashes and shingle hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Bytes, words or shingles worked on at a time, so that temporary arrays don't grow with a text.
STRIDE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, STRIDE + 1), _powers(_P_INV, STRIDE + 1)

#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Not space, tab, line feed, vertical tab, form feed or carriage return.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False
#: Letters and digits of ASCII and every byte of a longer character.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Controls and the space, which are or may be taken for white space.
_CONTROL = np.arange(256) < 33
#: First and last bytes of the longer white space characters (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000), and what stands second or last but one.
_FIRST, _LAST, _SECOND, _BEFORE_LAST = (np.isin(np.arange(256), x) for x in ([0xC2, 0xE1, 0xE2, 0xE3], [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0x80, 0x81, 0x85, 0x9A, 0xA0], [0xC2, 0x9A, 0x80, 0x81]))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about `most` text bytes (one longer document stands alone), so that temporary arrays stay small."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each maximal run of `inside` bytes; no run crosses a document's end."""
    n = len(data)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, STRIDE):
        b = min(a + STRIDE, n)
        m = inside[data[a:b]]
        before, after = np.empty_like(m), np.empty_like(m)
        before[1:], before[0] = m[:-1], a > 0 and inside[data[a - 1]]
        after[:-1], after[-1] = m[1:], b < n and inside[data[b]]
        edge = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        before[edge[edge < b - a]] = False
        after[edge[edge > 0] - 1] = False
        starts.append(np.flatnonzero(m & ~before) + a)
        ends.append(np.flatnonzero(m & ~after) + a + 1)
    return np.concatenate(starts), np.concatenate(ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """A 64-bit hash of each span's folded bytes: a polynomial in a fixed odd base, from differences of one running sum."""
    low, high = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    carry, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for a in range(0, len(data), STRIDE):
        part = data[a : a + STRIDE]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((fold[part].astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        sums *= scale
        sums += carry
        i, j = np.searchsorted(starts, [a, a + len(part)])
        low[i:j] = sums[starts[i:j] - a]
        i, j = np.searchsorted(ends, [a + 1, a + len(part) + 1])
        high[i:j] = sums[ends[i:j] - a]
        carry, scale = sums[-1:], scale * _UP[STRIDE]
    back = _DOWN[starts % STRIDE] * _powers(_DOWN[STRIDE], len(data) // STRIDE + 1)[starts // STRIDE]
    return mix((high - low) * back + (ends - starts).astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and the first shingle of each document (n_docs + 1 offsets).

    A document of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    n = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(n)])
    offsets = np.concatenate([[0], np.cumsum(np.where(n >= k, n - k + 1, n > 0))])
    out = np.empty(offsets[-1], np.uint64)
    many = len(words) - k + 1
    for a in range(0, many, STRIDE):
        b = min(a + STRIDE, many)
        h = np.repeat(np.array([k], np.uint64) * _STEP, b - a)
        for j in range(k):
            h = mix(h + words[a + j : b + j] * _P)
        whole = np.flatnonzero(doc[a:b] == doc[a + k - 1 : b + k - 1])
        d = doc[a + whole]
        out[offsets[d] + a + whole - begin[d]] = h[whole]
    for size in range(1, k):
        d = np.flatnonzero(n == size)
        h = np.repeat(np.array([size], np.uint64) * _STEP, len(d))
        for j in range(size):
            h = mix(h + words[begin[d] + j] * _P)
        out[offsets[d]] = h
    return out, offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, inside: np.ndarray = NOT_BLANK) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    starts, ends = word_spans(data, offsets, inside)
    doc = np.searchsorted(offsets, starts, "right") - 1
    h, at = shingle_hashes(word_hashes(data, starts, ends), doc, len(offsets) - 1, k)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def seams(data: np.ndarray) -> np.ndarray:
    """Where a single space stands between two characters that aren't white space; a few of these may be left out.

    A byte-level pre-tokeniser with the usual pattern begins a piece there, whatever stands before or after.
    """
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[at - 1], data[at + 1]
    blank = _CONTROL[before] | _CONTROL[after]
    blank |= _LAST[before] & _BEFORE_LAST[data[np.maximum(at - 2, 0)]]
    blank |= _FIRST[after] & _SECOND[data[np.minimum(at + 2, len(data) - 1)]]
    return at[~blank]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Documents cut at seams: for each document its first segment (n + 1 offsets), each segment's number, and the distinct ones."""
    cut = np.sort(np.concatenate([seams(data), offsets]), kind="stable").astype(np.int64)
    cut = cut[np.diff(cut, prepend=-1) > 0]
    if len(cut) < 2:
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), []
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(data))])
    known = held.dictionary_encode()
    return np.searchsorted(cut, offsets), known.indices.to_numpy().astype(np.int64), known.dictionary.to_pylist()


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The runs flat[first[i] : first[i] + size[i]] for each i of `which`, one behind the other; `step` of them at a time."""
    out = [flat[:0]]
    for a in range(0, len(which), step):
        some = which[a : a + step]
        n = size[some]
        ends = np.cumsum(n)
        out.append(flat[np.repeat(first[some] - ends + n, n) + np.arange(ends[-1])])
    return np.concatenate(out)


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each document has each byte value (n rows of 256)."""
    out = np.zeros((len(offsets) - 1, 256), np.int64)
    for a in range(0, len(data), STRIDE):
        b = min(a + STRIDE, len(data))
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        of = np.repeat(np.arange(j - i), np.diff(np.clip(offsets[i : j + 1], a, b)))
        out[i:j] += np.bincount(of * 256 + data[a:b], minlength=(j - i) * 256).reshape(j - i, 256)
    return out


def per_document(values: np.ndarray, offsets: np.ndarray, dtype: type = np.float64) -> np.ndarray:
    """Sums of values over each document's bytes; 0 for an empty one."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=dtype)
    return out
