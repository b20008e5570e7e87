"""Token ids as length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

A file is a row of records, each

    length of the body     unsigned 64-bit
    checksum of the length unsigned 32-bit, masked
    body                   doc_id (signed 64-bit; the lowest value stands for null), then ids (unsigned 32-bit, or 16-bit)
    checksum of the body   unsigned 32-bit, masked
    0x0A

all little-endian. A checksum is crc32, rotated right by 15 bits plus a constant, so that a checksum over data that
itself holds checksums stays sound. Spark's own writer writes the files, so retried tasks leave no torn or double files
and any store that Spark reaches will do: a record goes out as a text row of raw bytes, whose line end is the 0x0A.

The index holds for each record the file, offset, body length, doc_id, number of ids, start (ids of all documents
before it) and crc32 of the ids; a reader that wants records in any order needs the index and ranged reads only.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.textbatch import blocks, gathered
from causeway.runtime import lean, shared_folder, ship

#: Text bytes of one file, the id that ends a document, text bytes encoded at a time, pieces given to the library at a time.
FILE_BYTES, END_ID, BLOCK, BATCH = 32 << 20, 2, 2 << 20, 10_000
#: Line feed, tab and carriage return as spaces.
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[[9, 10, 13]] = 32
#: What a byte is to the pre-tokeniser: space, letter, digit, other mark, or something that only the library should judge
#: (controls, the apostrophe of contractions, the bracket of special tokens and word ends, longer characters).
SPACE, LETTER, DIGIT, MARK, UNSURE = range(5)
KIND = np.full(256, UNSURE, np.uint8)
KIND[33:127] = MARK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58], KIND[32] = DIGIT, SPACE
KIND[[39, 60]] = UNSURE
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32


def _latin() -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Lead byte, which second bytes make a letter, and that letter's lower case: U+00C0 to U+012F, where it is one to one."""
    out = []
    for lead in (0xC3, 0xC4):
        letters, small = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        for second in range(0x80, 0xC0):
            c = bytes([lead, second]).decode()
            letters[second] = c.isalpha() and ord(c) < 0x130
            if letters[second]:
                small[second] = c.lower().encode()[1]
        out.append((lead, letters, small))
    return out


LATIN = _latin()
NO_ID = -(1 << 63)
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its last byte."""
    body = struct.pack("<q", NO_ID if doc_id is None else doc_id) + ids.tobytes()
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(size)), body, struct.pack("<I", masked(body))))


def frames(content: bytes) -> Iterator[tuple[int, int | None, memoryview]]:
    """Offset, doc_id and id bytes of each record of a file; a damaged file raises ValueError."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + 12 > len(view):
            raise ValueError(f"a record is cut off at byte {at}")
        size, check = struct.unpack_from("<QI", view, at)
        end = at + 12 + size
        if masked(view[at : at + 8]) != check or end + 5 > len(view) or size < 8:
            raise ValueError(f"the length at byte {at} is damaged")
        body = view[at + 12 : end]
        if masked(body) != struct.unpack_from("<I", view, end)[0] or view[end + 4] != 10:
            raise ValueError(f"the record at byte {at} is damaged")
        doc = struct.unpack_from("<q", body)[0]
        yield at, None if doc == NO_ID else doc, body[8:]
        at = end + 5


class PieceEncoder:
    """The library's ids of whole texts, for a vocabulary whose pre-tokeniser drops white space.

    Space, line feed, tab and carriage return separate pieces for certain, so a text is the row of its runs between them.
    Where the vocabulary lower-cases and marks the ends of words, a run of printable ASCII and plain Latin letters is cut where the
    pre-tokeniser cuts it for certain: between letters, digits and marks, and around each digit. The distinct pieces of a block are
    found by a dictionary encoding and go through the library once: those of one kind in one row without normaliser, in
    which the ends of words separate them again, and runs with anything else in them each as a text. Nothing is kept
    from block to block, so memory is that of a block.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = id_type(file)
        self.usual = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.cuts = bool(suffix) and "Lowercase" in str(self.usual[0]) and "ByteLevel" in str(self.usual[1])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        found = [e.ids for a in range(0, len(texts), BATCH) for e in self.tokenizer.encode_batch_fast(texts[a : a + BATCH], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.width), np.array([*map(len, found)], np.int64)

    def _in_a_row(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-case pieces that need neither normaliser nor pre-tokeniser."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, self.bytes
        try:
            rows = [e.ids for a in range(0, len(pieces), BATCH) for e in self.tokenizer.encode_batch_fast([pieces[a : a + BATCH]], is_pretokenized=True, add_special_tokens=False)]
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.usual
        ids = np.concatenate([np.zeros(0, self.width), *[np.array(r, self.width) for r in rows]])
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(pieces):
            raise ValueError("the vocabulary doesn't mark the end of every piece")
        return ids, sizes

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, lower-cased where they are plain; where each begins; and which are plain."""
        kind, low = KIND[data], LOW[data]
        for lead, letters, small in LATIN:
            at = np.flatnonzero(data[:-1] == lead)
            at = at[letters[data[at + 1]]]
            kind[at] = kind[at + 1] = LETTER
            low[at + 1] = small[data[at + 1]]
        full = kind != SPACE
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        run = np.ones(len(data), bool)  # whether a run without spaces begins
        run[1:] = (kind[:-1] == SPACE) | edge[1:-1]
        run &= full
        number = np.cumsum(run, dtype=np.int32) - 1
        sure = np.ones(int(number[-1]) + 1 if len(data) else 0, bool)
        sure[number[full & (kind == UNSURE)]] = False
        plain = sure[number] if self.cuts and len(sure) else np.zeros(len(data), bool)
        begins = run.copy()
        begins[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        begins &= full
        return np.where(plain, low, data)[full], np.flatnonzero(begins), plain

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, given as UTF-8 bytes and n + 1 offsets, all in a row, and the n + 1 offsets of each text's ids."""
        data = BLANKS[data]
        kept, begins, plain = self._pieces(data, offsets)
        if not len(begins):
            return np.zeros(0, self.width), np.zeros(len(offsets), np.int64)
        place = np.cumsum(data != 32, dtype=np.int64)[begins] - 1
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(place, len(kept))), pa.py_buffer(kept)])
        known = held.dictionary_encode()
        which = known.indices.to_numpy().astype(np.int64)
        alone = np.zeros(len(known.dictionary), bool)
        alone[which[~plain[begins]]] = True  # equal bytes in a run of another kind: the library then judges both alike
        distinct = known.dictionary.to_pylist()
        texts, order = [], []
        for chosen in (np.flatnonzero(alone), np.flatnonzero(~alone)):
            order.append(chosen)
            texts.append([distinct[i].decode() for i in chosen.tolist()])
        (a, n_a), (b, n_b) = self._alone(texts[0]), self._in_a_row(texts[1])
        size = np.empty(len(distinct), np.int64)
        size[np.concatenate(order)] = sizes = np.concatenate([n_a, n_b])
        first = np.empty(len(distinct), np.int64)
        first[np.concatenate(order)] = np.cumsum(sizes) - sizes
        ids = gathered(np.concatenate([a, b]), first, size, which)
        return ids, np.concatenate([[0], np.cumsum(size[which])])[np.searchsorted(begins, offsets)]


def id_type(file: str) -> np.dtype:
    """The narrowest of 16 and 32 bits that holds every id of a vocabulary file."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]]])
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


_encoders: dict[str, PieceEncoder] = {}


def write(docs: DataFrame, folder: str, file: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Encode docs(doc_id, text) and write the records in ascending order of doc_id (null first) over files of about file_bytes of text."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the digest lets rows that repeat a doc_id be dealt over several files
    key = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    ordered = keyed.repartitionByRange(int(total // file_bytes) + 1, *key).sortWithinPartitions(*key, F.col("text").asc_nulls_first()).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(file) or PieceEncoder(file)
        _encoders[file] = encoder
        end = np.array([end_id], encoder.width)
        for part, data, offsets in blocks(batches, most=BLOCK):
            ids, at = encoder.encode(data, offsets)
            framed = [frame(d, np.concatenate([ids[a:b], end])) for d, a, b in zip(part.column(0).to_pylist(), at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["frame"])

    ordered.mapInArrow(lean(run), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def read(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """Index rows read back from the files: file, offset, doc_id, n_tokens, before (ids earlier in the file), ids_crc32 (of 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, before = [], 0
                for at, doc, ids in frames(content.as_py()):
                    n = len(ids) // width
                    rows.append((path.as_py(), at, len(ids) + 8, doc, n, before, crc32(np.frombuffer(ids, f"<u{width}").astype("<u4"))))
                    before += n
                if rows:
                    kinds = (pa.string(), *[pa.int64()] * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"])

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(lean(run), "file string, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long")


def write_records(docs: DataFrame, file: str, folder: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs as records and their index, and return the index: doc_id, start, n_tokens, ids_crc32, file, offset, length.

    n_tokens counts the end id too. A null text is an empty one: its record holds the end id only. Rows that repeat a
    doc_id follow each other in the order of a hash of their texts and have a record each; rows without a doc_id come
    first. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "records")
    width = id_type(file).itemsize
    write(docs, f"{folder}/records", file, end_id, file_bytes)
    read(spark, f"{folder}/records", width).write.parquet(f"{folder}/parts")
    rows = spark.read.parquet(f"{folder}/parts")
    # one row a file: which file comes first is told by the ids in it, and by its name where a doc_id is repeated over two
    order = Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("most"))
    base = files.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0))).select("file", "base")
    rows.join(base, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")
