"""Repair of conversation structure by A* on an edit lattice.

A node of the lattice is a number of rows read and a state of the grammar `(s?(ua)+)?`. Edges keep, rerole or delete the
next row, or insert a row. The search takes open nodes by (cost so far plus heuristic, audit), where the heuristic is a
suffix sum of the deletions that are required and of the least that each truncated row costs. No audit of a node is the
beginning of another one of the same cost (only insertions make audits of a node differ in length, and they cost), so the
first audit to reach a node by that order is its cheapest and, of these, the ASCII-least.

A conversation is read as a stream of its rows in order, of which only one letter a row is held for the search; texts are
read again, as a stream, once the edits are known.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan import scratch

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows searched at a stroke: beyond, the nodes behind each such piece are settled, and what their audits share is put down.
PIECE = 512
#: Any state can stand in for any other at this cost (two insertions and a deletion), so open ends that cost more than it beyond the cheapest are let go.
APART = 2 * INSERT + DELETE
#: Searches that a task remembers.
REMEMBERED = 50_000
_WORD = r"[^\x20\x09-\x0D]"
#: From a state, the state behind a row of this initial. 0: nothing yet, 1: behind s, 2: behind u, 3: behind a.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_ENDS = (0, 3)
_FULL = {"u": "user", "a": "assistant"}


def _steps(state: int, code: str) -> Iterator[tuple[str, int, int]]:
    """(audit letter, cost, state behind) of the edits that read a row. code: d for a row that must go, else the initial; upper case if truncated."""
    yield "D", DELETE, state
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        for role, after in _NEXT[state].items():
            if role == code.lower():
                yield "K", KEEP + more, after
            elif role != "s":
                yield "R", REROLE + more, after


def search(codes: str, piece: int = PIECE) -> tuple[int, str]:
    """The least cost of edits of a conversation, and the ASCII-least audit at that cost. codes: one letter a row, as in _steps."""
    settled, sources, start = [], [(0, "", 0)], 0
    while True:
        end = min(len(codes), start + piece)
        part = codes[start:end]
        left = [0] * (len(part) + 1)
        for i in range(len(part) - 1, -1, -1):
            left[i] = left[i + 1] + (DELETE if part[i] == "d" else min(DELETE, TRUNCATED) if part[i].isupper() else 0)
        heap, closed, last = [(cost + left[0], audit, 0, state) for cost, audit, state in sources], set(), end == len(codes)
        heapq.heapify(heap)
        sources = []
        while heap:
            f, audit, i, state = heapq.heappop(heap)
            if (i, state) in closed:
                continue
            closed.add((i, state))
            cost = f - left[i]
            if i == len(part):
                if last and state in _ENDS:
                    return cost, "".join(settled) + audit
                if not last:
                    sources.append((cost, audit, state))
                    if len(sources) == len(_NEXT):
                        break
            else:
                for letter, paid, after in _steps(state, part[i]):
                    if (i + 1, after) not in closed:
                        heapq.heappush(heap, (cost + paid + left[i + 1], audit + letter, i + 1, after))
            for role, after in _NEXT[state].items():
                if role != "s" and (i, after) not in closed:
                    heapq.heappush(heap, (cost + INSERT + left[i], audit + "I", i, after))
        # what all open ends share is settled, so that audits stay short
        cheapest = min(cost for cost, _, _ in sources)
        sources = [x for x in sources if x[0] <= cheapest + APART]
        audits = [a for _, a, _ in sources]
        n = next((k for k, letters in enumerate(zip(*audits, strict=False)) if len(set(letters)) > 1), min(map(len, audits)))
        settled.append(audits[0][:n])
        sources, start = [(cost, a[n:], state) for cost, a, state in sources], end


@lru_cache(REMEMBERED)
def _remembered(codes: str, piece: int) -> tuple[int, str]:
    return search(codes, piece)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with planted faults, nulls as one blank, and `gone` for rows that are dropped.

    The fault is crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties the text, 2 takes its stops, 3 repeats the
    row, 4 makes it a user's; a null id or turn counts as one blank there.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    out = out.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation together and in order: by turn (nulls first), then role, then digest of role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "mark")


def _marked(rows: DataFrame) -> DataFrame:
    """rows with mark, a digest of role and text, which tells repeated rows and orders those of one turn."""
    return rows.withColumn("mark", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))


def plans(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, gone): gaps, blank, duplicate, truncated, illegal, cost, audit.

    Only role initials and marks of the texts are shuffled.
    """
    word = F.col("text").rlike(_WORD)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = _marked(rows).select("conv_id", "turn", "role", "mark", "gone", F.when(~word, "b").when(cut, "t").otherwise("").alias("state"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conversations = [], itertools.groupby(
            (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0]
        )
        for conv, members in conversations:
            turns, low, high, seen, codes, counts, illegal, before = 0, None, None, set(), [], {"b": 0, "d": 0, "t": 0}, 0, None
            for _, turn, role, mark, gone, state in members:
                if gone:
                    continue
                if turn is not None:
                    turns += turn != high  # they come in order
                    low, high = turn if low is None else low, turn
                fault = "b" if state == "b" else "d" if mark in seen else state
                seen.add(mark)
                initial = role[:1]
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                if fault:
                    counts[fault] += 1
                code = initial if initial in ("s", "u", "a") else "x"
                codes.append("d" if fault in ("b", "d") else code.upper() if fault == "t" else code)
            codes = "".join(codes)
            cost, audit = _remembered(codes, piece) if len(codes) <= 64 else search(codes, piece)
            out.append((conv, high - low + 1 - turns if turns else 0, counts["b"], counts["d"], counts["t"], illegal, cost, audit))
            if len(out) == 1024:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [to_arrow, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    to_arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return _ordered(slim).select("conv_id", "turn", "role", "mark", "gone", "state").mapInArrow(run, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def apply(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), a conversation's rows together and in order.

    Each conversation's plan is sorted in front of its rows, which then pass through. A conversation without rows left has
    one row with a null place.
    """
    plan = planned.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("mark"), "audit")
    kept = _marked(rows.where(~F.col("gone"))).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "mark", F.lit(None).cast("string").alias("audit"))
    both = _ordered(plan.union(kept).withColumn("rest", F.col("audit").isNull()), "rest").select("conv_id", "role", "text", "audit")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def repaired(read: Iterator[tuple]) -> Iterator[tuple]:
        conv, audit, at, place, state = None, "", 0, 0, 0
        for conv_id, role, text, plan in read:
            if plan is not None:
                conv, audit, at, place, state = conv_id, plan, 0, 0, 0
                if not audit.strip("D"):
                    yield conv, None, None, None, None
            else:
                letter, at = audit[at], at + 1
                if letter != "D":
                    initial = role[:1] if letter == "K" else "a" if state == 2 else "u"
                    yield conv, place, letter, role if letter == "K" else _FULL[initial], text
                    place, state = place + 1, _NEXT[state][initial]
            while audit[at : at + 1] == "I":
                initial, at = "a" if state == 2 else "u", at + 1
                yield conv, place, "I", _FULL[initial], ""
                place, state = place + 1, _NEXT[state][initial]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
        held, size = [], 0
        for row in repaired(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            size += len(row[4] or "") + 64
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "place", "edit", "role", "text"]
    to_arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return both.mapInArrow(run, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what apply() returns, whose rows it takes in the order they have there."""
    kind = fixed.schema["conv_id"].dataType.simpleString()
    to_arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests = [], []
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv, members in itertools.groupby(rows, key=lambda r: r[0]):
            sha = hashlib.sha256()
            for _, place, role, text in members:
                if place is not None:
                    sha.update((("\n" if place else "") + f"{role}:{text}").encode())
            ids.append(conv)
            digests.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])

    return fixed.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of rows (conv_id, turn, role, text); `gone`, if there, marks rows that only name their conversation.

    Nulls in role and text count as one blank. Rows go by turn, nulls first; those of one turn by role, then by digest of
    role and text. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (the last
    character that is no white space is none of .!?). gaps counts turns missing between the least and the greatest.
    A null conv_id is a conversation like any other, a role outside the grammar (the empty one too) has to go or to be changed, repeated rows
    are duplicates, extra columns are ignored, and an empty table gives empty results. A task holds one letter and one digest a
    row of the conversation that it reads, and no texts but a batch's.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    planned = scratch.materialize(plans(plain), "repair-plans")
    return planned, apply(plain, planned)


def repair_report(rows: DataFrame) -> DataFrame:
    """Plans of the damaged rows with repaired_sha256, the digest of the repaired `role:text` lines; one row per conv_id."""
    planned, fixed = repair(damaged(rows))
    digests = _digests(fixed).withColumnRenamed("conv_id", "id")
    return planned.join(digests, planned["conv_id"].eqNullSafe(digests["id"])).drop("id")


def _sql() -> str:
    """DuckDB SQL of repair_report over a view named conversations: the lattice row by row, cheapest audit of each state."""

    def add(x: str, cost: str, letter: str) -> str:
        return f"printf('%012d', CAST({x}[1:12] AS BIGINT) + {cost}) || {x}[13:] || '{letter}'"

    def read(x: str, role: str) -> str:
        return f"CASE WHEN k = 'd' THEN NULL WHEN lower(k) = '{role}' THEN {add(x, f'{KEEP} + more', 'K')} ELSE {add(x, f'{REROLE} + more', 'R')} END"

    gone = [add(f"s{i}", str(DELETE), "D") for i in range(4)]
    behind = [
        gone[0],
        f"least({gone[1]}, CASE WHEN lower(k) = 's' THEN {add('s0', f'{KEEP} + more', 'K')} END)",
        f"least({gone[2]}, {read('s0', 'u')}, {read('s1', 'u')}, {read('s3', 'u')})",
        f"least({gone[3]}, {read('s2', 'a')})",
    ]
    inserted = f"least(n2, {', '.join(add(f'n{i}', str(INSERT), 'I') for i in (0, 1, 3))})"
    empty = "printf('%012d', 0)"
    return rf"""
        WITH RECURSIVE
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        f AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
                     lambda h, b: list_reduce(list_prepend(xor(h, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS fault FROM c),
        d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                     CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM f, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS i FROM d),
        t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
                     lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair FROM o),
        r AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'd' WHEN role[1:1] IN ('s', 'u', 'a') THEN CASE WHEN fault = 't' THEN upper(role[1:1]) ELSE role[1:1] END
                     WHEN fault = 't' THEN 'X' ELSE 'x' END AS k, CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END AS more FROM t),
        p(conv_id, i, s0, s1, s2, s3) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {empty}, CAST(NULL AS VARCHAR), printf('%012d', {INSERT}) || 'I', printf('%012d', {2 * INSERT}) || 'II' FROM conversations
            UNION ALL
            SELECT conv_id, i, n0, n1, m2, least(n3, {add('m2', str(INSERT), 'I')}) FROM (
                SELECT conv_id, i, n0, n1, n3, {inserted} AS m2 FROM (
                    SELECT p.conv_id, r.i, {', '.join(f'{x} AS n{i}' for i, x in enumerate(behind))}
                    FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
        e AS (SELECT conv_id, least(s0, s3) AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        a AS (SELECT conv_id, CAST(best[1:12] AS BIGINT) AS cost, best[13:] AS audit FROM e),
        l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS nth FROM a WHERE audit <> ''),
        m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER u AS i, count(*) FILTER (letter <> 'D') OVER u AS place FROM l
              WINDOW u AS (PARTITION BY conv_id ORDER BY nth)),
        g AS (SELECT m.conv_id, m.letter, m.place, r.role, r.text, max(CASE WHEN m.place = 1 AND m.letter = 'K' AND r.role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS off
              FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i WHERE m.letter <> 'D'),
        h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END,
                     chr(10) ORDER BY place) AS lines FROM g GROUP BY conv_id),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                     count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id"""


SQL = _sql()
