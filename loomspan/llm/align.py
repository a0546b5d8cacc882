"""Alignment of two tokenizers by a dictionary of groups.

Tokenizer A reads blank + text, tokenizer B reads the text and puts that blank itself. Byte offsets where tokens of both
end cut the two sequences into groups. Few groups are distinct, so a task interns them by number, the corpus counts each
once, links are expanded once per distinct group and weighted by its frequency, and the numbers of a document are sums
over its distinct groups, joined back by group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan import scratch

#: Chunks and groups that a task remembers, and characters of the longest chunk remembered.
MEMORY, LONGEST = 400_000, 64
#: Groups whose sums are broadcast (at most; a row holds a group's ids and four numbers). The rest are joined.
FREQUENT = 65_536
#: Texts whose chunks are encoded together.
TOGETHER = 256
#: A chunk starts at a lone blank or newline and ends before the next one. Neither vocabulary has a token across such a place.
CHUNKS = re.compile(r"[ \n]?\S*(?:\s\s+\S*|[^\S \n]\S*|\s\Z)*").findall
#: The letters that byte-level vocabularies put for bytes: printable ones stay, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; entries with other letters are taken as UTF-8."""
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()
    return out


def piece_tokens(pieces: list[str]) -> list[bytes]:
    """Bytes of each piece: U+2581 is a blank, <0xHH> a byte."""
    return [bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in pieces]


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt the work out already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = byte_level_tokens(self.a.get_vocab())
        self.b_bytes = piece_tokens([self.b.id_to_piece(i) for i in range(self.b.get_piece_size())])
        self.a_len, self.b_len = ([len(x) for x in held] for held in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = np.array(self.a_len), np.array(self.b_len)
        self.blank = self.b.piece_to_id("▁")

    def whole(self, text: str) -> list[tuple] | None:
        """Groups of a text, or None where the joined bytes of either side are not those of blank + text."""
        return self._groups(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1))

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of A and of B, ends of their groups, and the number of groups up to each chunk's end, of all chunks in a row.

        None where the bytes of a chunk are not those of its tokens.
        """
        a = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        a = list(chain.from_iterable([x.ids for x in a]))
        b = list(chain.from_iterable([y if c[0] == " " else y[1:] if y[:1] == [self.blank] else [] for c, y in zip(chunks, b, strict=True)]))
        data = "".join(chunks).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        of_chunk = np.searchsorted(both, ends) + 1
        if not np.array_equal(both[of_chunk - 1], ends):
            return None
        return a, b, np.searchsorted(a_end, both) + 1, np.searchsorted(b_end, both) + 1, of_chunk

    def _groups(self, text: str, a: list[int], b: list[int]) -> list[tuple] | None:
        data = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        a_len, b_len, out, i, j, a_at, b_at, a_end, b_end = self.a_len, self.b_len, [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if a_end <= b_end and i < len(a):
                a_end += a_len[a[i]]
                i += 1
            else:
                b_end += b_len[b[j]]
                j += 1
            if a_end == b_end:
                out.append((tuple(a[a_at:i]), tuple(b[b_at:j])))
                a_at, b_at = i, j
        return out

    def links(self, group: str) -> Counter:
        """How often each pair of ids is linked in one occurrence of a group: their byte ranges overlap."""
        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
        found, i, j, a_end, b_end = Counter(), 0, 0, self.a_len[a[0]], self.b_len[b[0]]
        while True:
            found[a[i], b[j]] += 1
            step_a, step_b = a_end <= b_end, b_end <= a_end
            if step_a:
                i += 1
            if step_b:
                j += 1
            if i >= len(a) or j >= len(b):
                return found
            a_end += self.a_len[a[i]] if step_a else 0
            b_end += self.b_len[b[j]] if step_b else 0


def _name(group: tuple) -> str:
    return ",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1]))


class Interner:
    """Numbers for groups, and the groups' numbers of the chunks met so far. Both are bounded and start anew when full."""

    def __init__(self, pair: Pair, most: int = MEMORY):
        self.pair, self.most = pair, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.odd: set[str] = set()
        self.number: dict[tuple, int] = {}
        self.names: list[str] = []
        self.sizes: list[tuple[int, int]] = []

    def _numbers(self, groups: list[tuple]) -> tuple[int, ...]:
        out = []
        for g in groups:
            if (n := self.number.get(g)) is None:
                n = self.number[g] = len(self.names)
                self.names.append(_name(g))
                self.sizes.append((len(g[0]), len(g[1])))
            out.append(n)
        return tuple(out)

    def _learn(self, chunks: list[str]) -> None:
        """Put down the groups' numbers of new chunks; those that stand for other bytes than their own are odd."""
        found = self.pair.chunks(chunks)
        if found is None:  # some chunk is odd: halve down to it
            if len(chunks) == 1:
                self.odd.add(chunks[0])
            else:
                self._learn(chunks[: len(chunks) // 2])
                self._learn(chunks[len(chunks) // 2 :])
            return
        a, b, a_cut, b_cut, ends = found
        a_start, b_start = (np.concatenate([[0], cut[:-1]]) for cut in (a_cut, b_cut))
        numbers = np.zeros(len(a_cut), np.int64)
        plain = (a_cut - a_start == 1) & (b_cut - b_start == 1)  # most groups: one token on either side
        key, places = np.unique(a[a_start[plain]] << 32 | b[b_start[plain]], return_inverse=True)
        numbers[plain] = np.array(self._numbers([((k >> 32,), (k & 0xFFFFFFFF,)) for k in key.tolist()]), np.int64)[places]
        rest = np.flatnonzero(~plain)
        a, b = a.tolist(), b.tolist()
        cuts = zip(*(x[rest].tolist() for x in (a_start, a_cut, b_start, b_cut)), strict=True)
        numbers[rest] = self._numbers([(tuple(a[i:j]), tuple(b[k:m])) for i, j, k, m in cuts])
        numbers, start = numbers.tolist(), 0
        for c, end in zip(chunks, ends.tolist(), strict=True):
            self.known[c] = tuple(numbers[start:end])
            start = end

    def texts(self, texts: list[str]) -> list[list[int] | None]:
        """The groups' numbers of each text in order; None for a text without tokens. They hold until the next call."""
        if len(self.known) + len(self.odd) > self.most or len(self.names) > self.most:
            self._clear()
        cut = [[c for c in CHUNKS(" " + t) if c] if t and not t[0].isspace() else [] for t in texts]
        new = list(dict.fromkeys(c for cs in cut for c in cs if c not in self.known and c not in self.odd))
        if new:
            self._learn(new)
        out: list[list[int] | None] = []
        for text, chunks in zip(texts, cut, strict=True):
            if chunks and (not self.odd or self.odd.isdisjoint(chunks)):
                out.append(list(chain.from_iterable(map(self.known.__getitem__, chunks))))
            else:  # white space in front, or a chunk that stands for other bytes: the text as it is
                groups = self.pair.whole(text) if text else None
                out.append(None if groups is None else list(self._numbers(groups)))
        for c in new:
            if len(c) > LONGEST:
                self.known.pop(c, None)
                self.odd.discard(c)
        return out


_PAIRS: dict[tuple[str, str], Interner] = {}


def _interner(a_path: str, b_path: str) -> Interner:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Interner(Pair(a_path, b_path))
    return _PAIRS[a_path, b_path]


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: row (a number of its own), its id, n_a, n_b, n_groups, groups_sha256, its distinct groups and how often each is there."""
    kind = docs.schema[id_col].dataType
    schema = f"row bigint, id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups array<string>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interner = _interner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                counts, digests, held, offsets = [], [], [], [0]
                for numbers in interner.texts([t or "" for t in part.column(2).to_pylist()]):
                    if not numbers:
                        counts.append((0, 0, 0))
                        digests.append("")
                    else:
                        distinct, times = np.unique(np.array(numbers), return_counts=True)
                        held.append((distinct, times))
                        sizes = [interner.sizes[i] for i in distinct.tolist()]
                        counts.append((*(int(sum(s[k] * t for s, t in zip(sizes, times.tolist(), strict=True))) for k in (0, 1)), len(numbers)))
                        digests.append(hashlib.sha256(";".join(map(interner.names.__getitem__, numbers)).encode()).hexdigest())
                    offsets.append(offsets[-1] + (len(held[-1][0]) if numbers else 0))
                found, times = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
                used, places = np.unique(found, return_inverse=True)
                names = pa.array([interner.names[i] for i in used.tolist()], pa.string()).take(pa.array(places, pa.int64()))
                ends = pa.array(offsets, pa.int32())
                columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                columns += [pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scratch.materialize(texts.mapInArrow(run, schema), "groups")


def dictionary(grouped: DataFrame) -> DataFrame:
    """(group, freq): each distinct group of the corpus and how often it occurs."""
    each = grouped.select(F.explode(F.arrays_zip("groups", "times")).alias("g")).select(F.col("g.groups").alias("group"), F.col("g.times").alias("times"))
    return scratch.materialize(each.groupBy("group").agg(F.sum("times").alias("freq")), "group-dictionary")


def links(words: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(group, freq, a, b, mult): the id pairs linked in each group of a dictionary, expanded once per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _interner(a_path, b_path).pair
        for batch in batches:
            out = [(g, f, a, b, m) for g, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for (a, b), m in pair.links(g).items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group", "freq", "a", "b", "mult"])

    return scratch.materialize(words.select("group", "freq").mapInArrow(run, "group string, freq bigint, a int, b int, mult bigint"), "group-links")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in the whole corpus, and whether no other A id has more with its B id."""
    counts = linked.groupBy("a", "b").agg(F.sum(F.col("freq") * F.col("mult")).alias("count"))
    # the window of a B id holds at most one row for each A id
    best = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))
    return scratch.materialize(best, "pair-counts")


def group_sums(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group, freq, links, best, counted): links of one occurrence of a group, those that are best, and the sum of their counts."""
    both = linked.join(pairs, ["a", "b"])
    sums = both.groupBy("group").agg(
        F.first("freq").alias("freq"), F.sum("mult").alias("links"), F.sum(F.when(F.col("best"), F.col("mult")).otherwise(0)).alias("best"), F.sum(F.col("mult") * F.col("count")).alias("counted")
    )
    return scratch.materialize(sums, "group-sums")


def _frequent_from(sums: DataFrame, most: int) -> int:
    """A frequency that at most `most` groups reach, from a histogram in quarters of octaves."""
    step = F.floor(F.log2("freq") * 4)
    held, least = 0, 1 << 62
    for r in sums.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("freq").alias("low")).orderBy(F.desc("step")).collect():
        held += r["n"]
        if held > most:
            break
        least = r["low"]
    return least


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_links counts overlapping pairs of token occurrences; a pair of ids counts as often as it is linked in the corpus;
    n_best are the links whose count is the highest of their B id, ties included; count_sum adds the counts over all links.
    groups_sha256 is the digest of `a1,a2|b1;a3|b2,b3`. Null and empty texts, and texts whose joined token bytes on
    either side are not blank + text, have no tokens: zeros and an empty groups_sha256. Repeated rows each count and each
    give their row, a null id is kept, other columns are ignored, and an empty table gives an empty result. A text is read
    whole. Sums of the `frequent` most frequent groups at most are broadcast; all others are joined by group.
    """
    grouped = groups(docs, a_path, b_path, id_col, text_col)
    linked = links(dictionary(grouped), a_path, b_path)
    sums = group_sums(linked, pair_counts(linked))
    least = _frequent_from(sums, frequent)
    each = grouped.select("row", F.explode(F.arrays_zip("groups", "times")).alias("g")).select("row", F.col("g.groups").alias("group"), F.col("g.times").alias("times"))
    top = F.broadcast(sums.where(F.col("freq") >= least).drop("freq"))
    totals = [F.sum(F.col("times") * F.coalesce(c, F.lit(0))).alias(c) for c in ("links", "best", "counted")]
    # frequent groups are summed here, so that one row a document is left of them; of the others, their number
    seen = each.join(top, "group", "left").withColumn("rare", F.when(F.col("links").isNull(), F.col("group")))
    seen = scratch.materialize(seen.groupBy("row", "rare").agg(*totals, F.sum("times").alias("times")), "group-uses")
    rest = sums.where(F.col("freq") < least).select(F.col("group").alias("rare"), "links", "best", "counted")
    rare = seen.where("rare is not null").select("row", "rare", "times").join(rest, "rare")
    rare = rare.select("row", *[(F.col("times") * F.col(c)).alias(c) for c in ("links", "best", "counted")])
    both = seen.where("rare is null").select("row", "links", "best", "counted").union(rare)
    of_row = both.groupBy("row").agg(F.sum("links").alias("n_links"), F.sum("best").alias("n_best"), F.sum("counted").alias("count_sum"))
    kept = grouped.select("row", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "groups_sha256").join(of_row, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return kept.select(id_col, "n_a", "n_b", "n_groups", *zero, "groups_sha256")
