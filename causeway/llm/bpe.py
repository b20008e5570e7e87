"""Byte-level BPE encoding and decoding by traversal of a prefix-sharing trie of distinct words.

The encoding of a prefix is a prefix of encodings: if t is the last token of the encoding of w[:i], then the rest of it
is the encoding of w[:i - len(t)]. So a word's encoding is known from the last token of each of its prefixes. The last
token at i is the one vocabulary item that ends there and that stays apart from the last token at its own start when the
two are merged by the rules. Distinct words of a block are put into a trie; a depth-first walk computes the last token
at each node once, whatever number of words goes through it. Words are visited in sorted order, which is that walk:
the states of the path to the current node are a stack, cut back to the prefix shared with the next word. Texts are cut
at single spaces between other characters, where a piece always begins, and the words walked are those of the distinct
segments that the cache lacks.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from causeway.llm.textbatch import blocks, buffers, gathered, segments
from causeway.runtime import lean, ship

#: The pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes of one block, distinct segments in one generation of a worker's cache, and pairs of tokens whose merging is remembered.
BLOCK, CACHE, PAIRS = 2 << 20, 250_000, 400_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary file in the tokenizers library's JSON format, without normaliser or prefix space."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{file}: not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        self.id = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.id.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(self.bytes, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (self.id[bytes(letters[c] for c in x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = self.id[self.bytes[a] + self.bytes[b]]
            if made in self.parts:
                raise ValueError(f"{file}: two merges make one token")
            self.merged[a, b], self.rank[made], self.parts[made] = made, rank, (a, b)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{file}: added tokens that take in their surroundings")
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self._at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._piece = regex.compile(PATTERN)
        self._lengths: dict[bytes, list[int]] = {}
        by_end: dict[bytes, set[int]] = {}
        for b in self.id:
            if len(b) > 2:
                by_end.setdefault(b[-3:], set()).add(len(b))
        self._lengths = {k: sorted(v, reverse=True) for k, v in by_end.items()}
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._cache: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        held = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self._flat = np.frombuffer(b"".join(held), np.uint8)
        self._size = np.array([len(x) for x in held], np.int64)
        self._first = np.cumsum(self._size) - self._size

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, each the encoding of its own bytes, stay as they are when their bytes stand side by side.

        Merging is run backwards from (a, b): whichever was completed last is taken apart again. At each moment the two
        parts that touch the seam must have no merge that would have come before that completion.
        """
        known = self._apart.get((a, b))
        if known is None:
            x, y, before = a, b, NEVER
            while True:
                made = self.merged.get((x, y))
                if made is not None and self.rank[made] < before:
                    known = False
                    break
                left, right = self.rank[x], self.rank[y]
                if left < 0 and right < 0:
                    known = True
                    break
                if left > right:
                    x, before = self.parts[x][1], left
                else:  # equal merges go from left to right, so one across the seam came before this one
                    y, before = self.parts[y][0], right + 1
            if len(self._apart) >= PAIRS:
                self._apart.clear()  # encode_words holds its get method, so the same dict goes on
            self._apart[a, b] = known
        return known

    def whole(self, t: int) -> bool:
        """Whether the encoding of t's bytes is t itself."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = t not in self.parts or self.plain(self.bytes[t]) == [t]
        return known

    def plain(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first."""
        ids = [self.id[bytes([b])] for b in word]
        while len(ids) > 1:
            rank, at = min((self.rank[m], i) if (m := self.merged.get((a, b))) is not None else (NEVER, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == NEVER:
                break
            ids[at : at + 2] = [self.merged[ids[at], ids[at + 1]]]
        return ids

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words, by the depth-first walk of their trie."""
        out: dict[bytes, tuple[int, ...]] = {}
        last, begin, before = [-1], [0], b""  # of each prefix: its last token, and where that token begins
        find, lengths, seen_apart, seen_whole = self.id.get, self._lengths.get, self._apart.get, self._whole.get
        for word in sorted(words):
            n = len(word)
            i = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                i += 1
            del last[i + 1 :], begin[i + 1 :]
            while i < n:
                i += 1
                for size in (*lengths(word[i - 3 : i], ()), 2) if i > 2 else (2,):
                    if size > i:
                        continue
                    t = find(word[i - size : i])
                    if t is None or not ((ok := seen_whole(t)) or (ok is None and self.whole(t))):
                        continue
                    if size == i:
                        break
                    p = last[i - size]
                    if (ok := seen_apart((p, t))) or (ok is None and self.apart(p, t)):
                        break
                else:
                    t, size = self.id[word[i - 1 : i]], 1
                last.append(t)
                begin.append(i - size)
            back, i = [], n
            while i:
                back.append(last[i])
                i = begin[i]
            out[word] = tuple(reversed(back))
            before = word
        return out

    def _pieces(self, run: str) -> list[str | int]:
        if self._at_special is None:
            return self._piece.findall(run)
        out: list[str | int] = []
        for i, x in enumerate(self._at_special.split(run)):
            out += [self.special[x]] if i % 2 else self._piece.findall(x)
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Puts the ids of distinct segments into the cache."""
        plain = [x for x in new if x[1:].isalpha() and (x[0] == 32 or x[:1].isalpha())]  # one piece of ASCII letters
        mixed = {x: self._pieces(x.decode()) for x in set(new).difference(plain)}
        made = self.encode_words({*plain, *(p.encode() for ps in mixed.values() for p in ps if isinstance(p, str))})
        for x in plain:
            self._cache[x] = array("I", made[x]).tobytes()
        for x, ps in mixed.items():
            self._cache[x] = array("I", [i for p in ps for i in (made[p.encode()] if isinstance(p, str) else (p,))]).tobytes()

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and where each one's begin (n + 1 offsets); special tokens written in a text become their ids."""
        begin, which, distinct = segments(data, offsets)
        if len(self._cache) > CACHE:
            self._cache, self._older = {}, self._cache
        cache, older, new = self._cache, self._older, []
        for x in distinct:
            if x not in cache:
                if (ids := older.get(x)) is None:
                    new.append(x)
                else:
                    cache[x] = ids
        self._learn(new)
        runs = [cache[x] for x in distinct]
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        ids = gathered(np.frombuffer(b"".join(runs), np.uint32), np.cumsum(size) - size, size, which)
        return ids, np.concatenate([[0], np.cumsum(size[which])])[begin]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        ids, at = self.encode_block(*buffers(pa.array(texts, pa.large_string())))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gathered(self._flat, self._first, self._size, ids).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(file: str) -> Bpe:
    if file not in _loaded:
        _loaded[file] = Bpe(file)
    return _loaded[file]


def encode_decode(docs: DataFrame, file: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) if with_ids.

    Null and empty texts have no tokens and decode to the empty text. Ids are hashed as little-endian unsigned 32-bit
    integers. Whole texts are encoded, in blocks of about BLOCK bytes; a worker keeps two generations of CACHE segments
    from block to block. Repeated rows, doc_ids and missing ones give a row each. Other columns are ignored; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        for part, data, offsets in blocks(batches, most=BLOCK):
            ids, at = bpe.encode_block(data, offsets)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            id_hashes = [sha256(ids[a:b].astype("<u4")).hexdigest() for a, b in spans]
            text_hashes = [sha256(bpe.decode(ids[a:b]).encode()).hexdigest() for a, b in spans]
            columns = [part.column(0), pa.array(np.diff(at)), pa.array(id_hashes), pa.array(text_hashes)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    more = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
