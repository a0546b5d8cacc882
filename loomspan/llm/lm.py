"""Language-model scores by online logistic context mixing, with a unigram base.

A text is scored as the bytes of its lower-cased tokens, a blank behind each and one end. Each byte is a path of binary
decisions in the Huffman tree of the training bytes that follow the byte before it. Three predictors give the log odds
of each decision: the tree itself, and two that hold how often either bit came in training, keyed by a hash of the tree
node and of the last three bytes, or of all bytes of the token so far. Each predictor is gated by how much the longer
ones have seen, and the gated log odds are summed with weights that are refined after every decision by the gradient of
its cost. The costs add up to the bits of a text. Refinement starts anew every SPAN decisions of a text, so that many
stretches are scored in step.

Contexts of three bytes are few in any corpus and share 2 ** SLOTS slots. Contexts within tokens grow with the corpus:
they are counted from the distinct tokens of all training documents, by 48 bits of hash, in pieces that are neither
broadcast nor collected. What a token's contexts predict depends on the token alone, so it is a column of the table of
tokens; spans of documents hold that of the FREQUENT most frequent tokens in memory and get the rest by a join. Beyond
DEPTH bytes of a token its contexts say nothing.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.hashing import mix

#: Bytes that the short contexts look back, bits of their slots, and bytes of a token that have contexts of their own.
ORDER, SLOTS, DEPTH = 3, 22, 24
#: Decisions after which the weights start anew, their starting values (the tree, short contexts, tokens), and the rate of refinement.
SPAN, START, RATE = 2000, (1.0, 1.0, 1.0), 0.03
#: Decisions of all lanes that are looked at together.
STEPS = 40
#: Added to the counts of either bit before their log odds are taken.
SMALL = 0.3
#: Counts at which a predictor's confidence steps up, and by its confidence what the next shorter one still weighs.
SEEN, GATES = (1, 4, 32), (1.0, 0.7, 0.5, 0.3)
#: Tokens whose predictions are broadcast and the longest of them in bytes; distinct tokens of a span of tokens and for each piece of contexts.
FREQUENT, LONGEST, WORDS, PIECE = 262_144, 64, 1 << 15, 1 << 17
#: Bytes of a span of documents, of texts mixed together, coded together, and of texts whose tokens are counted together.
WHOLE, BATCH, RUN, COUNTED = 1 << 22, 1 << 21, 1 << 14, 1 << 24
PAD = b" " * ORDER
#: What a context predicts is a byte: two bits of confidence and six of log odds, in steps of a quarter.
_STEP = 0.25
_ODDS = np.tile(np.arange(-32, 32) * _STEP, 4).astype(np.float32)
_GATE = np.repeat(GATES, 64).astype(np.float32)
#: By the confidence of a token's and of a short context: a step of the latter's log odds and the tree's, as they weigh. Both in one
#: word of 64 bits, as gathering is what scoring takes most time for.
_WEIGHS = np.stack([np.repeat(_GATE[::64], 4) * np.float32(_STEP), np.repeat(_GATE[::64], 4) * np.tile(_GATE[::64], 4)], 1).view(np.int64).ravel()
#: A context that never came predicts nothing.
NOTHING = 32


_COUNT = np.arange(1 << 17)


def held_out(doc_id: int | None) -> bool:
    """Documents that the model doesn't learn from; a null id counts as the empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Trees:
    """A Huffman tree for the byte after each byte: the nodes on a byte's path and the bits taken there."""

    def __init__(self, counts: np.ndarray):
        trees = [self._tree(row) for row in counts.reshape(256, 256).tolist()]
        self.length = np.array([len(p) for paths, _ in trees for p in paths])
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([256 * k + at for k, (paths, _) in enumerate(trees) for p in paths for at, _ in p], np.int64)
        self.bit = np.array([bit for paths, _ in trees for p in paths for _, bit in p], np.uint8)
        ones = np.array([p for _, p in trees])
        self.odds = np.log(ones / (1 - ones)).astype(np.float32).ravel()
        # what scoring needs of each decision, in one word: the node's salt, 1 or -1 by the bit, and the tree's log odds against the bit
        against = 1 - 2 * self.bit.astype(np.int64)
        self.record = np.empty((len(self.node), 2), np.uint32)
        self.record[:, 0] = _salt(self.node) | (against & 255) << 24
        self.record[:, 1] = (self.odds[self.node] * against.astype(np.float32)).view(np.uint32)
        self.record = self.record.view("<i8").ravel()

    @staticmethod
    def _tree(counts: list[int]) -> tuple[list[list[tuple[int, int]]], list[float]]:
        """Paths of (node, bit) for all bytes, and each node's share of ones; unseen bytes count a tenth."""
        heap = [(c + 0.1, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        share, node = [0.5] * 256, 256
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y], share[node - 256] = (node, 0), (node, 1), b / (a + b)
            heapq.heappush(heap, (a + b, node))
            node += 1
        paths = []
        for b in range(256):
            path, at = [], b
            while at in up:
                path.append((up[at][0] - 256, up[at][1]))
                at = up[at][0]
            paths.append(path[::-1])
        return paths, share

    def decisions(self, data: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For bytes and those before them: the byte that each decision belongs to, its node and its bit."""
        pair = before.astype(np.int64) << 8 | data
        length = self.length[pair]
        end = np.cumsum(length)
        of = np.repeat(np.arange(len(data)), length)
        flat = np.take(self.first[pair] - end + length, of)
        flat += _COUNT[: len(of)] if len(of) <= len(_COUNT) else np.arange(len(of))
        return of, np.take(self.node, flat), np.take(self.bit, flat)


def _salt(node: np.ndarray) -> np.ndarray:
    """What a node adds to the slots of its decisions."""
    return node * 0x9E3779B1 & (1 << SLOTS) - 1


def _places(grams: np.ndarray) -> np.ndarray:
    """What the ORDER bytes before a place give to the slots of its decisions."""
    return (mix(grams.astype(np.uint64) + np.uint64(1)) >> np.uint64(24)).astype(np.int64) & (1 << SLOTS) - 1


def _short(grams: np.ndarray, of: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slots of decisions: `grams` holds the ORDER bytes before each place."""
    slot = np.take(_places(grams), of)
    slot += _salt(node)
    slot &= (1 << SLOTS) - 1
    return slot


def _grams(data: np.ndarray) -> np.ndarray:
    """For each place behind the first padding, the ORDER bytes before it and its own byte, in 32 bits."""
    gram = np.zeros(len(data) - ORDER, np.uint32)
    for k in range(ORDER + 1):
        gram = gram << np.uint32(8) | data[k : k + len(gram)]
    return gram


def piece_of(word: bytes) -> bytes:
    """The bytes of a token that have contexts of their own: its first, with the blank behind it; the end is one newline."""
    return (word + b" ")[:DEPTH] if word else b"\n"


def _prefixes(words: list[bytes], trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the decisions of tokens: the token each belongs to, 48 bits for its context, its bit; and places where tokens begin among them."""
    pieces = [piece_of(w) for w in words]
    length = np.array([len(x) for x in pieces], np.int64)
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(pieces), np.uint8)
    before = np.empty_like(data)
    before[1:] = data[:-1]
    before[start] = 32
    h, state, at = np.empty(len(data), np.uint64), np.ones(len(words), np.uint64), start
    for depth in range(DEPTH):
        left = length > depth
        at, state, length = at[left], state[left], length[left]
        h[at + depth] = state
        state = mix(state * np.uint64(0x100000001B3) + data[at + depth].astype(np.uint64) + np.uint64(1))
    of, node, bit = trees.decisions(data, before)
    context = np.take(h, of)
    context += node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    size = np.add.reduceat(np.take(trees.length, before.astype(np.intp) << 8 | data), start) if len(start) else start
    return np.repeat(np.arange(len(words)), size), mix(context) >> np.uint64(16), bit, np.cumsum(size) - size


def _distinct(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts in order, and for each context its place among them.

    Contexts of 48 bits are sorted together with their places, in words of 64 bits, as far as they fit: sorting numbers takes an
    eighth of the time of sorting places by them. Contexts that differ only in the bits cut off may come in any order; then the
    places are sorted.
    """
    wide = len(contexts).bit_length()
    word = contexts >> np.uint64(max(0, wide - 16)) << np.uint64(wide)
    word |= np.arange(len(contexts), dtype=np.uint64)
    word.sort()
    word &= np.uint64((1 << wide) - 1)
    perm = word.view(np.int64)
    ordered = np.take(contexts, perm)
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(contexts, return_inverse=True)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    where = np.empty(len(ordered), np.int64)
    where[perm] = np.cumsum(new) - 1
    return ordered[new], where


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased tokens of a text; the end is not among them."""
    return tokens_of(text.encode("utf-8", "surrogatepass")) if text else []


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def token_lists(texts: pa.Array) -> pa.Array:
    """The tokens of each text as tokens() gives them, as Arrow lists; a text without any has an empty one instead."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))))


def streams_of(lists: pa.Array) -> list[bytes]:
    """The bytes that are scored for the tokens of each text."""
    return [s + b" \n" if s else b"\n" for s in pc.binary_join(lists, " ").cast(pa.large_binary()).to_pylist()]


def stream_of(found: list[bytes]) -> bytes:
    """The bytes that are scored for a text's tokens."""
    return b" ".join([*found, b"\n"])


def pairs_of(words: pa.Array, times: np.ndarray) -> np.ndarray:
    """How often each byte follows each other, in tokens that come so many times with a blank on either side."""
    data = np.frombuffer(b" ".join([b"", *words.cast(pa.large_binary()).to_pylist(), b""]), np.uint8)
    if not len(words):
        return np.zeros(65_536, np.int64)
    weights = np.repeat(times, pc.binary_length(words).to_numpy() + 1)
    return np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], weights, 65_536).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(kind, word, n): kind w for tokens of all documents ('' is the end), b for pairs of bytes; n counts training documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ends, learnt, others, size = np.zeros(65_536, np.int64), 0, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            for lists, trained in ((learnt, True), (others, False)):
                if not lists:
                    continue
                found = pa.chunked_array([x.flatten() for x in lists]).value_counts()
                word, n = found.field("values"), found.field("counts").to_numpy()
                real = pc.not_equal(word, "")  # of texts without tokens
                word, n = word.filter(real), n[real.to_numpy(zero_copy_only=False)]
                if trained:
                    pairs += pairs_of(word, n)
                for at in range(0, len(word), 1 << 16):
                    part = word.slice(at, 1 << 16).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(["w"] * len(part), pa.string()), part, pa.array(n[at : at + (1 << 16)] * trained)], ["kind", "word", "n"])

        for batch in batches:
            lists = token_lists(batch.column(1))
            held = np.array([held_out(i) for i in batch.column(0).to_pylist()], bool)
            ends += int(np.count_nonzero(~held))
            others.append(lists.filter(pa.array(held)))
            learnt.append(lists.filter(pa.array(~held)))
            size += batch.column(1).nbytes
            if size > COUNTED:
                yield from out()
                learnt, others, size = [], [], 0
        yield from out()
        pairs[32 << 8 | 10] += ends  # the end comes behind a blank
        used = np.flatnonzero(pairs)
        kind, word = ["w"] + ["b"] * len(used), ["", *map(str, used.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(word, pa.string()), pa.array([ends, *pairs[used].tolist()], pa.int64())], ["kind", "word", "n"])

    return docs.mapInArrow(_freed(run), "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The rows of (word, n) whose n is at or above a threshold that at most `most` words reach.

    The threshold comes from the numbers of words in steps of n of an eighth of an octave, so no words are sorted and a
    task hands on no more rows than belong to the result.
    """
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 512 rows at most
        held += r["count"]
        if held > most:
            break
        least = r.step
    return words.where(F.lit(False) if least is None else step >= least)


def _runs(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Streams in runs of about RUN bytes, each behind padding of its own, and where each stream begins and the run ends.

    Places count from behind the first padding.
    """
    at = 0
    while at < len(streams):
        size, end = 0, at
        while end < len(streams) and (size < RUN or end == at):
            size += len(streams[end]) + len(PAD)
            end += 1
        starts = np.cumsum([0, *(len(s) + len(PAD) for s in streams[at:end])])
        yield np.frombuffer(PAD + PAD.join(streams[at:end]), np.uint8), starts
        at = end


def _real(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of a run without its padding."""
    real = np.ones(len(data) - len(PAD), bool)
    real[(starts[1:-1, None] - np.arange(1, len(PAD) + 1)).ravel()] = False
    return np.flatnonzero(real)


def packed(counts: np.ndarray) -> np.ndarray:
    """A byte for each slot from the counts of its two bits."""
    zero, one = counts[0::2], counts[1::2]
    odds = np.log((one + SMALL) / (zero + SMALL)) / _STEP
    level = np.searchsorted(SEEN, zero + one, "right")
    return (level * 64 + (np.rint(odds).clip(-32, 31) + 32).astype(np.int64)).astype(np.uint8)


def count_short(streams: list[bytes], trees: Trees, table: np.ndarray) -> None:
    """Add the bits of streams to the counts of both bits of all slots. Equal bytes in equal contexts are added at once."""
    each = [_grams(data)[_real(data, starts)] for data, starts in _runs(streams)]
    if not each:
        return
    grams = np.sort(np.concatenate(each))
    first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
    times, grams = np.diff(first, append=len(grams)).astype(table.dtype), grams[first]
    of, node, bit = trees.decisions((grams & np.uint32(255)).astype(np.uint8), grams >> np.uint32(8) & np.uint32(255))
    np.add.at(table, 2 * _short(grams >> np.uint32(8), of, node) + bit, np.take(times, of))


def _short_table(docs: DataFrame, trees: Broadcast) -> np.ndarray:
    """What each slot of the short contexts predicts, from all training documents: a byte each, 2 ** SLOTS in all."""
    part = 1 << 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, streams, size = np.zeros(2 << SLOTS, np.int64), [], 0
        for batch in batches:
            learnt = pa.array([not held_out(i) for i in batch.column(0).to_pylist()], pa.bool_())
            for stream in streams_of(token_lists(batch.column(1).filter(learnt))):
                streams.append(stream)
                size += len(stream)
                if size > BATCH:
                    count_short(streams, trees.value, table)
                    streams, size = [], 0
        count_short(streams, trees.value, table)
        for p, counts in enumerate(table.reshape(-1, part)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([_small(counts)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _plain(data).astype(np.int64)
                held[p] = held[p] + counts if p in held else counts
        for p, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([packed(counts).tobytes()], pa.binary())], ["part", "seen"])

    table = np.full((2 << SLOTS) // part * (part // 2), NOTHING, np.uint8).reshape(-1, part // 2)
    summed = docs.mapInArrow(_freed(run), "part bigint, counts binary").repartition("part").mapInArrow(add, "part bigint, seen binary")
    for row in summed.toLocalIterator():  # a byte a slot, 4 MB at any size of the corpus
        table[row.part] = np.frombuffer(row.seen, np.uint8)
    return table.ravel()


def _piece(contexts: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of each context; it grows with the context."""
    return (contexts >> np.uint64(16)).astype(np.int64) * pieces >> 32


def _zipped(data: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _small(numbers: np.ndarray) -> bytes:
    """Numbers as their bytes of equal worth one after the other, as many as the largest number has, compressed."""
    numbers = numbers.astype(np.uint64)
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + _zipped(numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def _plain(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzipped(data[1:]), np.uint8).reshape(data[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, : data[0]] = planes.T
    return numbers.view(np.uint64).ravel()


def _word_spans(words: DataFrame, distinct: int) -> DataFrame:
    """(span, words, times): the distinct tokens in order, in spans of up to WORDS tokens, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held, times, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([span]), pa.array([b" ".join(held)], pa.binary()), pa.array([_small(np.array(times, np.int64))], pa.binary())], ["span", "words", "times"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(word.encode())
                times.append(n)
                size += len(held[-1])
                if len(held) == WORDS or size > WHOLE:
                    yield out()
                    span, held, times, size = span + 1, [], [], 0
        if held:
            yield out()

    ordered = words.repartitionByRange(1 + distinct // WORDS, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "span bigint, words binary, times binary")


def _word_predictions(spans: DataFrame, trees: Broadcast, pieces: int) -> DataFrame:
    """(word, n, seen): what the contexts of all training tokens predict at each decision of a token, a byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            of, context, bit, _ = _prefixes(row["words"].split(b" "), trees.value)
            contexts, where = _distinct(context)
            counts = np.zeros(2 * len(contexts), np.int64)
            np.add.at(counts, 2 * where + bit, np.take(_plain(row["times"]).astype(np.int64), of))
            piece = _piece(contexts, pieces)
            cuts = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), len(piece)]
            parts = [(_small(np.diff(contexts[i:j], prepend=np.uint64(0))), _small(counts[2 * i : 2 * j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece[cuts[:-1]], pa.int64()), pa.array([row["span"]] * len(parts), pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*parts, strict=True))], ["piece", "span", "contexts", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_of(batches, "piece"):
            each = [np.cumsum(_plain(r["contexts"]), dtype=np.uint64) for r in rows]
            contexts, where = _distinct(np.concatenate(each))
            counts, added = np.zeros(2 * len(contexts), np.int64), [_plain(r["counts"]).astype(np.int64) for r in rows]
            for k in (0, 1):
                np.add.at(counts, 2 * where + k, np.concatenate([x[k::2] for x in added]))
            seen, end = packed(counts)[where], np.cumsum([len(x) for x in each])
            for r, x, j in zip(rows, each, end.tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([r["span"]]), pa.array([r["piece"]]), pa.array([_zipped(seen[j - len(x) : j].tobytes())], pa.binary())], ["span", "piece", "seen"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            words = row["words"].split(b" ")
            _, context, _, begin = _prefixes(words, trees.value)
            seen = np.frombuffer(b"".join(_unzipped(r["seen"]) for r in row["parts"]), np.uint8)
            flat, end = seen[_distinct(context)[1]].tobytes(), [*begin[1:].tolist(), len(context)]
            own = [flat[i:j] + _silent(w, trees.value) for w, i, j in zip(words, begin.tolist(), end, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(_plain(row["times"]).astype(np.int64)), pa.array(own, pa.binary())], ["word", "n", "seen"])

    counted = spans.mapInArrow(count, "piece bigint, span bigint, contexts binary, counts binary")
    summed = counted.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "span bigint, piece bigint, seen binary")
    parts = summed.groupBy("span").agg(F.sort_array(F.collect_list(F.struct("piece", "seen"))).alias("parts"))  # one span's, 8 MB at most
    return spans.join(parts, "span").select("words", "times", "parts").mapInArrow(back, "word string, n bigint, seen binary")


def _silent(word: bytes, trees: Trees) -> bytes:
    """The predictions at a token's decisions behind its first DEPTH bytes: none."""
    if len(word) < DEPTH:
        return b""
    data = np.frombuffer(word + b" ", np.uint8)[DEPTH - 1 :].astype(np.int64)
    return bytes([NOTHING]) * int(trees.length[data[:-1] << 8 | data[1:]].sum())


def _rows_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of batches that are sorted by key, those of one key at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _deflated(ids: list, texts: list[bytes]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return _zipped(sink.getvalue().to_pybytes())


def _inflated(data: bytes) -> tuple[list, list[bytes]]:
    batch = pa.ipc.open_stream(_unzipped(data)).read_next_batch()
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def _freed(run: Callable) -> Callable:
    """A task's function that hands Arrow's unused memory back at the task's end: workers outlive tasks and stages."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return freed


def _spans(docs: DataFrame, top: Broadcast) -> DataFrame:
    """(span, docs, word): documents in spans of about WHOLE bytes, and for each span its distinct tokens that aren't in `top`.

    A span's documents are one row: their ids and texts as a compressed Arrow stream; a null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []

        def out() -> Iterator[pa.RecordBatch]:
            words = pa.concat_arrays([token_lists(pa.array(texts, pa.large_binary())).flatten(), pa.array([""])]).unique()
            words = words.filter(pc.invert(pc.is_in(words, top.value[0])))
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array([span]), pa.array([_deflated(ids, texts)], pa.binary()), pa.nulls(1, pa.string())], ["span", "docs", "word"])
            yield pa.RecordBatch.from_arrays([pa.array([span] * n, pa.int64()), pa.nulls(n, pa.binary()), words], ["span", "docs", "word"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if size >= WHOLE:
                    yield from out()
                    span, size, ids, texts = span + 1, 0, [], []
                text = text or b""
                ids.append(doc_id)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield from out()

    return docs.mapInArrow(_freed(run), "span bigint, docs binary, word string")


class Model:
    """The trees and the table of short contexts; scores streams, given what their tokens' contexts predict."""

    def __init__(self, trees: Trees, table: np.ndarray):
        self.trees, self.table = trees, table

    def bits_of(self, streams: list[bytes], seen: list[bytes]) -> np.ndarray:
        """Bits of each stream; `seen` holds what the tokens' contexts predict at each of its decisions."""
        cuts, size = [0], 0
        for end in range(1, len(streams) + 1):
            size += len(streams[end - 1])
            if size >= BATCH or end == len(streams):
                cuts.append(end)
                size = 0
        parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        lanes = max((sum(-(-len(x) // SPAN) for x in seen[p]) for p in parts), default=0)
        # all batches write into the same memory: lanes' next STEPS lie side by side, as they are read together
        x = np.empty((SPAN // STEPS, len(START), lanes, STEPS), np.float32).transpose(1, 2, 0, 3)
        return np.concatenate([np.zeros(0), *(self._cost(streams[p], seen[p], x) for p in parts)])

    def _looked(self, streams: list[bytes], seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of streams: where their decisions end, and all predictors' log odds against the bits that came."""
        trees, at = self.trees, 0
        for data, starts in _runs(streams):
            real = _real(data, starts)
            gram = _grams(data)[real]
            pair = (gram & np.uint32(0xFFFF)).astype(np.intp)
            length = np.take(trees.length, pair)
            end = np.cumsum(length)
            # a decision's place in the trees' records, and above it what its short context gives to its slot
            key = _places(gram >> np.uint32(8)) << 32
            key += np.take(trees.first, pair)
            key -= end
            key += length
            key = np.repeat(key, length)
            key += _COUNT[: len(key)] if len(key) <= len(_COUNT) else np.arange(len(key))
            record = np.take(trees.record, key & 0xFFFFFFFF)
            against = record.view(np.int8)[3::8]
            key >>= 32
            key += record
            key &= (1 << SLOTS) - 1
            short, token = np.take(self.table, key), seen[at : at + len(key)]
            if len(token) < len(key):
                raise ValueError(f"{len(seen)} predictions for more decisions")
            weighs = np.take(_WEIGHS, token >> 6 << 2 | short >> 6).view(np.float32)
            x = np.empty((len(START), len(key)), np.float32)
            np.multiply(((token & 63).view(np.int8) - np.int8(32)) * against, np.float32(_STEP), out=x[2])
            np.multiply(((short & 63).view(np.int8) - np.int8(32)) * against, weighs[0::2], out=x[1])
            np.multiply(record.view(np.float32)[1::2], weighs[1::2], out=x[0])
            at += len(key)
            sizes = np.diff(starts) - len(PAD)
            yield end[np.cumsum(sizes) - 1], x

    def _cost(self, streams: list[bytes], seen: list[bytes], x: np.ndarray) -> np.ndarray:
        """Bits of each stream of a batch; x is memory for the log odds of its lanes."""
        counts = np.array(list(map(len, seen)))
        # each stream's decisions fill whole lanes of SPAN; lanes that are not full come last, the longest of them first
        full, left = counts // SPAN, counts % SPAN
        order = np.argsort(-left, kind="stable")
        first, partial = np.cumsum(full) - full, np.empty_like(counts)
        partial[order] = full.sum() + np.arange(len(counts))
        lanes = zip(counts.tolist(), first.tolist(), full.tolist(), left.tolist(), partial.tolist(), strict=True)
        for ends, found in self._looked(streams, np.frombuffer(b"".join(seen), np.uint8)):
            begin = 0
            for end, (count, at, n, rest, row) in zip(ends.tolist(), lanes, strict=False):
                if end - begin != count:
                    raise ValueError(f"{count} predictions for {end - begin} decisions")
                one, begin = found[:, begin:end], end
                if n:
                    x[:, at : at + n] = one[:, : n * SPAN].reshape(len(x), n, -1, STEPS)
                if rest:
                    steps, rest = divmod(rest, STEPS)
                    x[:, row, :steps] = one[:, n * SPAN : count - rest].reshape(len(x), steps, STEPS)
                    if rest:
                        x[:, row, steps, :rest] = one[:, count - rest :]
                        x[:, row, steps, rest:] = 0
        length = np.concatenate([np.full(full.sum(), SPAN), left[order]])
        cost = self._mix(x, length[: np.count_nonzero(length)])
        own = np.concatenate([[0], np.cumsum(cost)])
        some = np.flatnonzero(left)
        total = own[first + full] - own[first]
        total[some] += cost[partial[some]]
        return total / np.log(2) - -left % STEPS

    @staticmethod
    def _mix(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Cost (nats) of every lane: log odds are weighted sums, and all lanes' weights follow their cost's gradient.

        x holds the predictors' log odds against the bit that came, each (lanes, SPAN), or cut into (lanes, SPAN / STEPS, STEPS).
        Lanes come by falling length; what is left of a lane's last STEPS must be 0 and adds log 2 a decision.
        """
        x, n = x.reshape(len(x), x.shape[1], -1, STEPS), len(length)
        w = np.repeat(np.array(START, np.float32)[:, None], n, axis=1)
        more, held = (np.zeros(s, np.float32) for s in (n, w.shape))
        values, odds = (np.empty((STEPS, *s), np.float32) for s in (w.shape, (n,)))
        rate, cost = np.float32(RATE), np.zeros(n)
        for t in range(0, SPAN, STEPS):
            n = int(np.count_nonzero(length > t))
            w, more, held, values, odds = w[:, :n], more[:n], held[:, :n], values[:, :, :n], odds[:, :n]
            for k, log_odds in enumerate(x[:, :n, t // STEPS]):
                for at in range(0, n, 512):  # lanes that fit a fast cache are turned together
                    values[:, k, at : at + 512] = log_odds[at : at + 512].T
            for v, e in zip(values, odds, strict=True):
                np.multiply(w, v, out=held)
                np.add.reduce(held, axis=0, out=e)
                np.exp(e, out=e)
                e += 1
                np.divide(rate, e, out=more)
                more -= rate
                v *= more
                w += v
            cost[:n] += np.add.reduce(np.log(odds, out=odds), axis=0, dtype=np.float64)
        return cost


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) per row of docs.

    score is the model's log10 probability of the token stream, base_score that of the add-one unigram model of the
    training tokens. A null text is empty: one end. A null doc_id is trained on. Repeated rows are counted and scored
    each. Extra columns are ignored. Without training documents all tokens are unknown.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = scratch.materialize(count_tokens(docs), "token-counts")
    words = counts.where("kind = 'w'").select("word", "n")
    n, v, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.count(F.lit(1))).first()
    pairs = np.zeros(65_536, np.int64)
    for r in counts.where("kind = 'b'").collect():  # 65,536 rows at most
        pairs[int(r.word)] = r.n
    sc, rest = spark.sparkContext, float(np.log10(n + v + 1))
    trees = sc.broadcast(Trees(pairs))
    model = sc.broadcast(Model(trees.value, _short_table(docs, trees)))
    word_spans = scratch.materialize(_word_spans(words, distinct), "word-spans")
    words = scratch.materialize(_word_predictions(word_spans, trees, 1 + distinct // PIECE), "word-predictions")

    def known(n: pa.ChunkedArray) -> np.ndarray:
        return np.array([math.log10(k + 1) - rest for k in n.to_pylist()])

    word_type = pa.schema([("word", pa.string()), ("n", pa.int64()), ("seen", pa.binary())])
    short = words.where((F.col("n") > 0) & (F.octet_length("word") <= LONGEST))
    frequent = frequent_words(short, FREQUENT).select("word", "n", "seen").toArrow().cast(word_type).combine_chunks()  # FREQUENT rows at most
    top = sc.broadcast((pa.concat_arrays(frequent["word"].chunks or [pa.array([], pa.string())]), known(frequent["n"]), pa.concat_arrays(frequent["seen"].chunks or [pa.array([], pa.binary())])))
    spans = scratch.materialize(_spans(docs, top), "spans")
    rare = spans.where("word IS NOT NULL").select("span", "word").join(words, "word")
    both = spans.where("word IS NULL").unionByName(rare, allowMissingColumns=True)
    columns = ["docs", "word", "n", "seen"]

    def scored_span(ids: list, texts: list[bytes], rare: pa.Table) -> pa.RecordBatch:
        lists, (words, odds, predicted) = token_lists(pa.array(texts, pa.large_binary())), top.value
        flat, size, n = lists.flatten(), np.diff(lists.offsets.to_numpy()), rare.num_rows
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # not those of texts without tokens
        size = size - np.add.reduceat(~real, np.cumsum(size) - size, dtype=np.int64)
        # tokens are numbered: those of the join first, which are distinct, and the end behind all texts
        numbered = pa.concat_arrays([*rare["word"].chunks, flat.filter(pa.array(real)), pa.array([""])]).dictionary_encode()
        number = numbered.indices.to_numpy()
        found = pc.index_in(numbered.dictionary[n:], words)
        if found.null_count or (number[:n] != np.arange(n)).any():
            raise ValueError("tokens without predictions, or with more than one")
        base = np.concatenate([known(rare["n"]), odds[found.to_numpy()]])
        seen = pa.concat_arrays([*rare["seen"].chunks, predicted.take(found)]).cast(pa.large_binary())
        stop = np.cumsum(size + 1)
        at = np.full(stop[-1], number[-1])
        at[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = number[n:-1]
        each, seen = base[at], seen.take(pa.array(at))
        begin = stop - size - 1
        spans = [*zip(begin.tolist(), stop.tolist(), strict=True)]
        streams = streams_of(lists)
        places, data = np.frombuffer(seen.buffers()[1], np.int64).tolist(), memoryview(seen.buffers()[2])
        bits = model.value.bits_of(streams, [data[places[i] : places[j]] for i, j in spans])
        columns = {
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids], pa.bool_()), "n_tokens": pa.array(size + 1, pa.int64()),
            "n_known": pa.array(np.add.reduceat((each != -rest).astype(np.int64), begin)), "base_score": pa.array([math.fsum(each[i:j].tolist()) for i, j in spans], pa.float64()),
            "n_bytes": pa.array([*map(len, streams)], pa.int64()), "bits": pa.array(bits),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.RecordBatch.from_pylist([], word_type)]
        for batch in batches:
            at, table = 0, batch.select(columns[1:]).cast(word_type)
            for end in np.flatnonzero(batch.column("word").is_null().to_numpy(zero_copy_only=False)).tolist():
                yield scored_span(*_inflated(batch.column("docs")[end].as_py()), pa.Table.from_batches([*parts, table.slice(at, end - at)]))
                parts, at = parts[:1], end + 1
            parts.append(table.slice(at))

    # a span's tokens come first, its documents last
    held = both.select("span", *columns).repartition("span").sortWithinPartitions("span", F.col("word").isNull())
    scored = held.mapInArrow(_freed(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, n_bytes bigint, bits double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score",
        (-F.col("bits") * float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
