"""Byte-level BPE by monoid tree reduction.

Token sequences form a monoid under "join and repair": a piece is cut in halves down to short leaves, the leaves are
merged directly, and two encoded neighbours are joined by re-encoding a window around their boundary that grows until
the tokens on either side of it are provably stable. A sequence is the encoding of its bytes exactly when each adjacent
pair of its tokens is the encoding of that pair's bytes, so a boundary is stable once the pairs at both edges of the
window pass that test. Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Ids decoded at a stroke, and characters of the longest chunk that is remembered: the cache is bounded in bytes by it.
RUN, LONGEST = 4096, 64
#: Bytes up to which a piece is merged directly. Short leaves recur in many words, so their merges are remembered.
LEAF = 8
#: Remembered leaves, windows and pairs, of each kind.
MEMORY = 200_000
#: Remembered chunks of each generation.
CHUNKS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class TreeEncoder:
    """Encodes bytes by the ranks of a byte-level BPE vocabulary and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.ranks, self.memory = ranks, memory
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.merged: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: the lowest-ranked adjacent pair, leftmost first, merges until none can."""
        ranks = self.ranks
        if (known := self.merged.get(data)) is not None:
            return known
        if len(data) > 4 * LEAF:
            return self._merge_long(data)
        get, none = ranks.get, len(ranks) + 1
        at = list(range(len(data) + 1))  # where the parts begin, and the end
        pairs = [get(data[i : i + 2], none) for i in at[:-2]]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            del pairs[i], at[i + 1]
            if i < len(pairs):
                pairs[i] = get(data[at[i] : at[i + 2]], none)
            if i:
                pairs[i - 1] = get(data[at[i - 1] : at[i + 1]], none)
        if len(self.merged) > self.memory:
            self.merged.clear()
        found = self.merged[data] = [ranks[data[i:j]] for i, j in pairwise(at)]
        return found

    def _merge_long(self, data: bytes) -> list[int]:
        """The same merges with a heap over a linked list, n log n in the length."""
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, length = heapq.heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != length:
                continue
            part[i], part[j] = left + part[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n:
                    both = part[k] + part[m]
                    if (r := ranks.get(both)) is not None:
                        heapq.heappush(heap, (r, k, len(both)))
        return [ranks[p] for p in part if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbours stay as they are: together they encode to themselves."""
        key = (a, b)
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) > self.memory:
                self.stable_pairs.clear()
            known = self.stable_pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both sides."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(self.decode(left[-i:] + right[:j]))
            left_holds = i == len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            if not left_holds:
                i = min(2 * i, len(left))
            if not right_holds:
                j = min(2 * j, len(right))

    def encode_piece(self, data: bytes) -> list[int]:
        """One match of the pattern: halves are encoded recursively and joined."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.encode_piece(data[:mid]), self.encode_piece(data[mid:]))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; each match of the pattern is encoded separately."""
        return [t for piece in self.pieces(text) for t in self.encode_piece(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids) -> bytes:
        """Bytes of ids, concatenated up the tree: halves are decoded and joined, short runs at a stroke."""
        if len(ids) <= RUN:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class ChunkCache:
    """Ids of texts through a bounded cache of their chunks.

    A lone blank or newline between two characters that are not white space is never matched together with what stands
    before it, and a newline not with what follows either. So texts whose white space is of that kind are cut there and
    their chunks encoded independently of each other; other texts go through the pattern whole.
    """

    def __init__(self, encoder: TreeEncoder, most: int = CHUNKS):
        self.encoder, self.most = encoder, most
        self.known: dict[str, list[int]] = {}
        self.names = {i: str(i) for i in encoder.tokens}
        self.newline = self._entry("\n")
        self.first, self.later = _Chunks(self._entry, ""), _Chunks(self._entry, " ")

    def _entry(self, text: str) -> tuple:
        """Decimal ids joined by blanks, and the ids."""
        pieces, encode, found = self.known, self.encoder.encode_piece, []
        for piece in self.encoder.pieces(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = encode(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    pieces[piece] = ids
            found += ids
        names = self.names
        return " ".join([names[i] for i in found]), tuple(found)

    def _line(self, line: str) -> list[tuple]:
        chunks = line.split(" ")
        return [self.first[chunks[0]], *map(self.later.__getitem__, chunks[1:])]

    def encode(self, text: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by blanks, their number, and the bytes that all ids of the text decode to."""
        if not text:
            return "", 0, b""
        if len(self.later) > self.most:
            self.later = self.later.next()
        for held in (self.first, self.known):
            if len(held) > self.most:
                held.clear()
        try:
            lines = text.split("\n")
            parts = self._line(lines[0])
            for line in lines[1:]:
                parts.append(self.newline)
                parts += self._line(line)
        except _Together:
            parts = [self._entry(text)]
        ids = list(chain.from_iterable([p[1] for p in parts]))
        return " ".join([p[0] for p in parts]), len(ids), self.encoder.decode(ids)


class _Chunks(dict):
    """Entries of chunks that stand behind `lead`. Only a chunk that isn't there is looked at; a line's others cost a look-up each."""

    def __init__(self, entry: Callable[[str], tuple], lead: str, before: dict[str, tuple] | None = None):
        self.entry, self.lead, self.before = entry, lead, before or {}

    def __missing__(self, chunk: str) -> tuple:
        found = self.before.get(chunk)
        if found is None:
            if not chunk or len(chunk) > LONGEST or chunk[0].isspace() or chunk[-1].isspace():
                raise _Together
            found = self.entry(self.lead + chunk)
        self[chunk] = found
        return found

    def next(self) -> _Chunks:
        """A new generation; chunks that come again are fetched from this one."""
        self.before = {}
        return _Chunks(self.entry, self.lead, self)


class _Together(Exception):
    """White space in this text may belong to a longer match, or a chunk is too long to be remembered."""


_RANKS: dict[str, dict[bytes, int]] = {}


def _encoder(ranks_path: str, pattern: str, memory: int = MEMORY) -> TreeEncoder:
    """An encoder that remembers nothing yet. Workers outlive their tasks and stages, so only the ranks stay with them."""
    if ranks_path not in _RANKS:
        _RANKS[ranks_path] = load_ranks(ranks_path)
    return TreeEncoder(_RANKS[ranks_path], pattern, memory)


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; null and empty texts give an empty array. Extra columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNKS) -> DataFrame:
    """One row per document: n_tokens, SHA-256 of its decimal ids joined by one blank, SHA-256 of the decoded bytes.

    A null text counts as empty: no ids, digests of the empty string. Repeated rows each give their row. A null id is
    kept. Columns other than the two named are ignored, and an empty table gives an empty result. One task holds one
    batch of texts and a cache of at most `most` chunks of each kind, which ends with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(_encoder(ranks_path, pattern, min(most, MEMORY)), most)
        sha = hashlib.sha256
        for batch in batches:
            counts, ids, texts = [], [], []
            for t in batch.column(1):
                joined, n, decoded = cache.encode(t.as_py() or "")
                counts.append(n)
                ids.append(sha(joined.encode()).hexdigest())
                texts.append(sha(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
