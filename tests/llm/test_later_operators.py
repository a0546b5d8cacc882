"""Group alignment, grid order join and conversation repair against brute force, with nulls, ties, repeats and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import align, gridjoin, queries, repair

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


# ---- group alignment

TEXTS = [
    "Plain words, and plain words again.\nNext line's end", "la éauxvition ñandú; la la", "", None, "one", " leading blank", "two  blanks and\ttab", "\n\nnew lines\n", "a\n b \nc",
    "▁ is no blank", "null \x00 byte", "漢字かな交じり文 🎉🎉 emoji", "ends with blank ", "x" * 3000, "<|endoftext|> <s></s> <0x41> [INST]", "ﬁ ligature ｆｕｌｌ", " thin space　wide", "é combining",
    "tab\tand\rreturn\x0bvt\x0cff\x1cfs\x85nel", "it's we'll 's 12345 3.14 ... !!! -- ==", "very " * 2500 + "long",
]


def brute_align(texts):
    a_of, b_of = Tokenizer.from_file(queries.BYTE_BPE_JSON), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    a_of.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    of_a = lambda i: bytes(byte[c] for c in a_of.id_to_token(i))

    def of_b(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for t in texts:
        a = a_of.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = b_of.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            rows.append(([], [], [], []))
            continue
        ends = lambda ids, of: list(itertools.accumulate(len(of(i)) for i in ids))
        ea, eb = ends(a, of_a), ends(b, of_b)
        both, groups = sorted(set(ea) & set(eb)), []
        for low, high in zip([0, *both], both, strict=False):
            groups.append(([i for i, e in zip(a, ea, strict=True) if low < e <= high], [j for j, e in zip(b, eb, strict=True) if low < e <= high]))
        links, k = [], 0
        for i, e in zip(a, ea, strict=True):
            s = e - len(of_a(i))
            while k and eb[k - 1] > s:
                k -= 1
            while k < len(b) and eb[k] <= s:
                k += 1
            while k < len(b) and eb[k] - len(of_b(b[k])) < e:
                links.append((i, b[k]))
                k += 1
        counts.update(links)
        rows.append((a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [1 << 16, 5, 0])
def test_alignment_equals_brute_force(spark, frequent):
    rnd = random.Random(3)
    texts = [*TEXTS, TEXTS[0], TEXTS[0], *(" ".join(rnd.choice(["la", "éaux", "tion", "the", "Über", "x,"]) for _ in range(40)) for _ in range(20))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "one", "clash", 2), (3, "one", "clash", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, groups int").repartition(3)
    got = Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in align.align(docs, queries.BYTE_BPE_JSON, queries.PIECE_BPE, frequent=frequent).collect())
    want = Counter((r[0], *x) for r, x in zip(rows, brute_align([r[1] for r in rows]), strict=True))
    assert got == want


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.align(docs, queries.BYTE_BPE_JSON, queries.PIECE_BPE).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {tuple(r[f] for f in FIELDS) for r in align.align(docs, queries.BYTE_BPE_JSON, queries.PIECE_BPE).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_query_equals_brute_force(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op11_group_alignment"](spark, str(SF)).collect()}
    assert got == {d[0]: x for d, x in zip(docs, brute_align([d[1] for d in docs]), strict=True)}


def test_interner_starts_anew_when_full():
    pair = align.Pair(queries.BYTE_BPE_JSON, queries.PIECE_BPE)
    small, large = align.Interner(pair, most=3), align.Interner(pair)
    for t in TEXTS:
        one, other = small.texts([t or ""])[0], large.texts([t or ""])[0]
        assert (one is None) == (other is None)
        if one is not None:
            assert [small.names[i] for i in one] == [large.names[i] for i in other]


# ---- grid order join


def brute_vectors(rows, least=0.98):
    n = len(rows)
    ok = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links, root = defaultdict(set), list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i].add(j)
                links[j].add(i)
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        root[i] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return Counter((r[0], len(links[i]), root[i], r[0] is not None and r[0] == root[i]) for i, r in enumerate(rows))


def vectors(seed, n, dim=16, labels=3, spread=0.02):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(max(2, n // 12), dim))
    rows = []
    for i in range(n):
        x = centres[rnd.integers(len(centres))] * (1 + rnd.integers(3)) + (rnd.normal(size=dim) * spread * rnd.integers(1, 8))
        rows.append((i, [float(np.float32(v)) for v in x], int(rnd.integers(labels))))
    return rows


@pytest.mark.parametrize("block, leaf", [(1024, 128), (7, 3), (1, 1)])
def test_grid_join_equals_brute_force(spark, block, leaf):
    rows = vectors(1, 150)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(9)] + [(7, rows[8][1], rows[8][2]), (7, rows[8][1], rows[8][2])]  # copies, a repeated id
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [None] + [1.0] * 15, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, rows[3][1], None), (2005, [], 1)]
    rows += [(None, rows[5][1], rows[5][2]), (2006, rows[5][1][:3], rows[5][2]), (2007, rows[5][1][:3], rows[5][2]), (2008, [float("inf")] * 16, 1), (2009, [1.0], 2), (2010, [2.0], 2), (2011, [-2.0], 2)]
    rows += [(2012, [0.0, -0.0, 5.0] + [0.0] * 13, 1), (2013, [-0.0, 0.0, 5.0] + [0.0] * 13, 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, first string, n int").repartition(4)
    got = gridjoin.near_vectors(df, block=block, leaf=leaf)
    assert Counter(map(tuple, got.collect())) == brute_vectors(rows)


def test_grid_join_of_few_and_of_huge_components(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label string")
    assert gridjoin.near_vectors(none).count() == 0
    rows = [(1, [1e200, 1e200], "a"), (2, [1e-200, 1e-200], "a"), (3, [1e200, -1e200], "a"), (4, None, "b")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    assert sorted(map(tuple, gridjoin.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_block_pairs_skip_only_what_is_far(spark):
    """Every pair of vectors within eps lies in a pair of blocks that is kept, and some pairs of blocks are skipped."""
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.integers(2, size=8) * 2.0 - 1 + rnd.normal(size=8) * 0.01).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>, label int").select(F.col("vec_id").alias("first"), "v", F.col("label").cast("string").cast("binary").alias("label"))
    nodes = df.select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.lit(1).cast("bigint").alias("weight"), F.size("v").alias("dim"))
    dim, basis = gridjoin.principal(nodes, 8)
    assert dim == 8 and np.allclose(basis @ basis.T, np.eye(8))
    blocks = gridjoin._blocks(gridjoin._projected(nodes, dim, basis, 0.2), 4, "<f8")
    pairs = {tuple(r) for r in gridjoin.block_pairs(blocks, 0.2, len(basis)).collect()}
    held = {r.n: r for r in blocks.collect()}
    assert 0 < len(pairs) < len(held) * (len(held) + 1) / 4 and all(x <= y for x, y in pairs)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    home = {e["first"]: n for n, r in held.items() for e in r.nodes}
    for i, j in itertools.combinations(unit, 2):
        if np.linalg.norm(unit[i] - unit[j]) <= 0.2:
            assert tuple(sorted((home[i], home[j]))) in pairs


def test_grid_join_query_equals_sql(spark, duck):
    got = queries.QUERIES["op12_grid_order_join"](spark, str(SF))
    want = duck.execute(gridjoin.SQL).fetchall()
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(want)


# ---- conversation repair


def brute_repair(rows):
    """rows (conv_id, turn, role, text); every audit by relaxation over the whole lattice."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, out = " " if role is None else role, " " if text is None else text, groups[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        out += [] if fault == 0 else [row, row] if fault == 3 else [row]
    mark = lambda role, text: hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r[1], r[2])))
        turns = {r[0] for r in found} - {None}
        counts, seen, faults = Counter(), set(), []
        for _, role, text in found:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            faults.append(fault)
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(found))
        grammar = re.compile("(s?(ua)+)?")
        best = {"": (0, "", ())}  # initials so far, cut to what the grammar needs: cost, audit, rows

        def state(made):
            initials = "".join(r[:1] for r, _ in made)
            return initials if len(initials) <= 1 else initials[-1] if initials[-1] != "s" else None

        def legal(made):
            initials = "".join(r[:1] for r, _ in made)
            return any(grammar.fullmatch(initials + rest) for rest in ("", "a", "ua"))

        def offer(table, cost, audit, made):
            if legal(made):
                key = state(made)
                key = "a" if key == "ua" else key
                if key not in table or (cost, audit) < table[key][:2]:
                    table[key] = (cost, audit, made)
                    return True
            return False

        def insertions(table):
            while any([offer(table, c + 5, a + "I", (*m, (role, ""))) for c, a, m in list(table.values()) for role in ("user", "assistant")]):
                pass
            return table

        insertions(best)
        for (_, role, text), fault in zip(found, faults, strict=True):
            after = {}
            for cost, audit, made in best.values():
                offer(after, cost + 2, audit + "D", made)
                if fault not in ("b", "d"):
                    more = 5 * (fault == "t")
                    if role:
                        offer(after, cost + more, audit + "K", (*made, (role, text)))
                    for other in ("user", "assistant"):
                        offer(after, cost + 1 + more, audit + "R", (*made, (other, text)))
            best = insertions(after)
        cost, audit, made = min((x for x in best.values() if grammar.fullmatch("".join(r[:1] for r, _ in x[2]))), key=lambda x: x[:2])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations():
    rnd, rows = random.Random(9), []
    for conv in range(120):
        for turn in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if rnd.random() < 0.4 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn * rnd.choice([1, 1, 1, 2]), role, rnd.choice(["Fine.", "Cut off", " \t\n", "", None, "Why?  \n", "Same.", "Same.", f"{turn} ok!", "a:b\nuser:c."])))
    rows += [(None, 0, "user", "q."), (None, None, "assistant", "r."), (500, None, "user", "x."), (500, None, None, "y"), (501, -3, "user", "x."), (501, 4, "assistant", "z."), (501, 4, "assistant", "z."), (501, 4, "assistant", "A."), (501, 4, "user", "A.")]
    return rows + [(600, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(700)]


def test_repair_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "conv_id bigint, turn bigint, role string, text string, mark string, place int, gone boolean").repartition(3)
    got = repair.repair_report(df)
    assert got.columns == REPORT
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_repair(rows), key=repr)


def test_repaired_rows_follow_the_grammar(spark):
    df = spark.createDataFrame([r for r in conversations() if r[0] is not None], "conv_id bigint, turn bigint, role string, text string")
    _, fixed = repair.repair(df)
    made = defaultdict(list)
    for r in fixed.collect():
        made[r.conv_id] += [] if r.place is None else [(r.place, r.edit, r.role)]
    assert len(made) == len({r[0] for r in conversations()} - {None})
    for rows in made.values():
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[2][:1] for r in rows))
        assert all(r[2] in ("user", "assistant") for r in rows if r[1] in "RI")


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair_report(df).count() == 0
    df = spark.createDataFrame([(c, t, "user", "x.") for c in range(400) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0], "conv_id bigint, turn bigint, role string, text string")
    got = repair.repair_report(df).collect()
    assert got and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def relaxed(codes):
    """(cost, audit) by relaxation, row by row."""
    paths = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}

    def insertions(best):
        while True:
            new = [(role, (c + 5, a + "I")) for at, (c, a) in best.items() for role in paths[at] if role != "s" and (role not in best or (c + 5, a + "I") < best[role])]
            if not new:
                return best
            for role, x in new:
                best[role] = min(x, best.get(role, x))

    best = insertions({"": (0, "")})
    for code in codes:
        options = [(at, (c + 2, a + "D")) for at, (c, a) in best.items()]
        if code != "d":
            more = 5 * code.isupper()
            options += [(role, (c + more + (role != code.lower()), a + ("K" if role == code.lower() else "R"))) for at, (c, a) in best.items() for role in paths[at] if role == code.lower() or role != "s"]
        best = {}
        for role, x in options:
            best[role] = min(x, best.get(role, x))
        insertions(best)
    return min(best[at] for at in ("", "a") if at in best)


@pytest.mark.parametrize("piece", [1, 3, 512])
def test_search_finds_the_least_audit(piece):
    rnd = random.Random(piece)
    tried = [list(c) for n in range(5) for c in itertools.product("suaXd", repeat=n)]
    tried += [[rnd.choice(rnd.choice(["suaxSUAXd", "ddX", "ua", "UA", "s"])) for _ in range(rnd.randrange(40))] for _ in range(200)]
    for codes in tried:
        assert repair.search("".join(codes), piece) == relaxed(codes)


def test_repair_query_equals_sql(spark, duck):
    got = queries.QUERIES["op13_edit_lattice"](spark, str(SF)).select(*REPORT)
    want = duck.execute(f"SELECT {', '.join(REPORT)} FROM ({repair.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
