"""Token-id files with fixed-width bit packing.

A file holds the ids of some documents back to back. Every id takes the fewest bits that the vocabulary needs. Ids are
packed in blocks that each begin on a byte, so block offsets alone lead to any id; numpy unpacks a block at a stroke.

Layout, little-endian: magic, bits (u4), ids per block (u4) | blocks | block offsets (u8 each) | first id of each
document (u8, one more than documents) | document ids (i8) | null marks (u1) | numbers of blocks, documents and ids
(u8), footer offset (u8).
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import scratch

MAGIC = b"LSIDS001"
BLOCK = 1 << 16
#: Between chunks that are encoded in one call: a special token, never part of what a chunk encodes to.
SEPARATOR = "<|startoftext|>"
#: The letter that byte-level tokenizers put for each byte: printable ones stay, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = [chr(b) if b in _PLAIN else chr(256 + sum(x not in _PLAIN for x in range(b))) for b in range(256)]
#: Finds letters outside the Latin blocks or special tokens; stops and commas that may belong to a longer run of symbols.
_UNEVEN = re.compile(r"[^\x00-\u024f]|<\|").search
_CLUSTERED = re.compile(r"[\W_][.,][ \n]").search
#: A letter whose lower case ends in a mark, which joins the symbols behind it.
DOTTED = "\u0130"
#: Longer chunks are not remembered, so the cache is bounded in bytes.
LONGEST = 64
#: The normalizer and the pre-tokenizer that chunks and letters may be taken apart for: white space parts words, words are
#: lower-cased runs of letters, and their bytes go to the merges.
KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as u4."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1).astype("<u4")


class Writer:
    """Writes one file; holds one block and the document index."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at = self._put(MAGIC + np.array([bits, block], "<u4").tobytes())
        self.offsets: list[int] = []
        self.starts, self.docs, self.nulls = [0], [], []
        self.pending: list[np.ndarray] = []
        self.held = 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def _flush(self, all_of_it: bool = False) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        while len(ids) >= self.block or all_of_it and len(ids):
            self.offsets.append(self.at)
            self.at += self._put(pack(ids[: self.block], self.bits))
            ids = ids[self.block :]
        self.pending, self.held = [ids], len(ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Append one document."""
        self.pending.append(ids)
        self.held += len(ids)
        self.starts.append(self.starts[-1] + len(ids))
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        if self.held >= self.block:
            self._flush()

    def close(self) -> None:
        self._flush(all_of_it=True)
        footer = self.at
        for values, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.docs, "<i8"), (self.nulls, "u1")):
            self.at += self._put(np.array(values, kind).tobytes())
        self._put(np.array([len(self.offsets), len(self.docs), self.starts[-1], footer], "<u8").tobytes())


class Reader:
    """Random access to one file by a seekable handle."""

    def __init__(self, handle, size: int):
        self.handle = handle
        head = self._range(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.bits, self.block = map(int, np.frombuffer(head, "<u4", offset=8))
        n_blocks, n_docs, self.n_ids, footer = map(int, np.frombuffer(self._range(size - 32, 32), "<u8"))
        rest = self._range(footer, size - 32 - footer)
        at = 0
        self.offsets = np.frombuffer(rest, "<u8", n_blocks, at).astype(np.int64)
        self.starts = np.frombuffer(rest, "<u8", n_docs + 1, at := at + 8 * n_blocks).astype(np.int64)
        self.docs = np.frombuffer(rest, "<i8", n_docs, at := at + 8 * (n_docs + 1))
        self.nulls = np.frombuffer(rest, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.last = (-1, np.zeros(0, "<u4"))

    def _range(self, start: int, length: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(length)

    def _block(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            n = min(self.block, self.n_ids - k * self.block)
            self.last = (k, unpack(self._range(int(self.offsets[k]), (n * self.bits + 7) // 8), self.bits, n))
        return self.last[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1 of the file."""
        parts = [
            self._block(k)[max(0, start - k * self.block) : end - k * self.block]
            for k in range(start // self.block, (max(start, end - 1)) // self.block + 1)
            if start < end
        ]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Texts to ids with the tokenizers library, through a bounded cache of their chunks between blanks and newlines.

    White space only parts words for these tokenizers (it is dropped before the merges), so a text's ids are those of
    its chunks in turn. Unseen chunks go to the library together, parted by a special token. A tokenizer of another kind,
    and a text with a letter whose lower case ends in a mark, go to the library whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.cut = self.tokenizer.token_to_id(SEPARATOR)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.apart = (spec.get("normalizer"), steps[0]) == KNOWN and len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        self.known.update((c, self.before[c]) for c in chunks if c in self.before)
        chunks = [c for c in chunks if c not in self.before]
        whole = lambda c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4")
        rest = []
        for c in chunks:
            if c.isalpha() and not _UNEVEN(c):  # one word of letters: the merges alone
                ids = [t.id for t in self.model.tokenize("".join(map(_VISIBLE.__getitem__, c.lower().encode())))]
                self.known[c] = array("I", ids).tobytes()
            else:
                rest.append(c)
        chunks = rest
        odd = [c for c in chunks if self.cut is None or "<|" in c]
        plain = chunks if not odd else [c for c in chunks if c not in set(odd)]
        for c in odd:
            self.known[c] = whole(c).tobytes()
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        encoded = self.tokenizer.encode_batch_fast([SEPARATOR.join(g) for g in groups], add_special_tokens=False)
        for some, one in zip(groups, encoded, strict=True):
            ids = np.array(one.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.cut), len(ids)]
            if len(ends) != len(some):
                raise ValueError("the separator's id came from a chunk")
            start = 0
            for c, end in zip(some, ends, strict=True):
                self.known[c] = ids[start:end].tobytes()
                start = end + 1

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian u4."""
        if not self.apart or DOTTED in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > self.most:  # chunks that come again are fetched from the generation before
            self.before, self.known = self.known, {}
        if not _CLUSTERED(text):  # a lone comma or stop behind a word is a word of its own to these tokenizers
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        if not _UNEVEN(text):  # the tokenizers lower the case, as Python does for these letters
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self.known[c] for c in chunks])
        except KeyError:
            new = {c for c in chunks if c not in self.known}
            self._learn(list(new))
            found = b"".join([self.known[c] for c in chunks])
            for c in new:
                if len(c) > LONGEST:
                    del self.known[c]
            return found


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_files(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them to packed files under folder, in ascending order of id (null first).

    Returns the manifest, one row per file: part, path, first id of the file in the whole, and counts. Each task writes
    a file under a name of its own, so a task that runs twice leaves a file that no manifest row names. Needs a folder
    that pyarrow.fs can open (file, hdfs, s3, gs).
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path, part = _encoder(tokenizer_path), None, "", 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part_no, doc_id, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if writer is None:
                    part, path = part_no.as_py(), f"{folder}/ids-{part_no.as_py():06d}-{uuid.uuid4().hex[:8]}.bin"
                    fs, local = FileSystem.from_uri(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                    writer = Writer(out, bits)
                writer.add(doc_id.as_py(), np.frombuffer(encoder.encode(text.as_py() or "") + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, path, len(writer.docs), writer.starts[-1])], ["part", "path", "n_docs", "n_ids"])

    # the texts behind a sampled range partition move once; ties in id are put in the order of their texts
    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = ordered.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, "part bigint, path string, n_docs bigint, n_ids bigint")
    files = scratch.materialize(files, "id-files")
    # one row a file: a running sum over some thousand rows
    first, rows = 0, []
    for r in sorted(files.toLocalIterator(), key=lambda r: r.part):
        rows.append((r.part, r.path, first, r.n_docs, r.n_ids))
        first += r.n_ids
    return spark.createDataFrame(rows, "part bigint, path string, first bigint, n_docs bigint, n_ids bigint")


def read_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: id, start in the whole, number of ids, CRC-32 of the ids as u4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                fs, local = FileSystem.from_uri(path)
                with fs.open_input_file(local) as handle:
                    reader = Reader(handle, handle.size())
                    crc = [zlib.crc32(reader.document(k).tobytes()) for k in range(len(reader.docs))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.docs, pa.int64(), mask=reader.nulls), pa.array(reader.starts[:-1] + first), pa.array(np.diff(reader.starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents to packed id files and describe each from what the files hold.

    Null and empty texts give the end id alone. Null doc_ids come first; repeated ids follow each other in the order of
    their texts. Extra columns are ignored; an empty table writes no file and gives no row.
    """
    spark: SparkSession = docs.sparkSession
    return read_files(write_files(docs, tokenizer_path, vocabulary, end_id, folder or scratch.new_path(spark, "packed-ids")))


def roundtrip(ids: list[int], bits: int, block: int = BLOCK) -> list[int]:
    """Write and read one document in memory, for tests."""
    out = io.BytesIO()
    writer = Writer(out, bits, block)
    writer.add(1, np.array(ids, "<u4"))
    writer.close()
    return Reader(out, len(out.getvalue())).document(0).tolist()
