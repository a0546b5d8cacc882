"""The corpus pipeline, stage by stage, against brute force on a small corpus."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from loomspan import scratch
from loomspan.llm import bpe
from loomspan.llm.queries import BYTE_BPE
from test_numbered_operators import WORDS, linked, prose, quality_counts, removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    rnd = random.Random(8)
    texts = [prose(rnd, rnd.randrange(60, 160)) for _ in range(24)]
    passage = prose(rnd, 80)
    texts += [texts[0], texts[1] + " more", passage + " " + texts[5][:200], prose(rnd, 60) + " " + passage, "too short", None, "a b c " * 40]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, ""), name)
        seen.append((name, docs))
    return seen


def rows_of(stages, k):
    return [tuple(r) for r in stages[k][1].collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "byte_bpe"]
    assert all(d.columns == COLUMNS for _, d in stages[:-1])


def test_quality_rules(stages):
    good = [r for r in rows_of(stages, 0) if (c := quality_counts(r[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert sorted(rows_of(stages, 1)) == sorted(good) and len(good) < len(rows_of(stages, 0))


def test_near_dedup(stages):
    kept = {i for i, _, _, keep in linked(rows_of(stages, 1), 5) if keep}
    assert sorted(rows_of(stages, 2)) == sorted(r for r in rows_of(stages, 1) if r[0] in kept) and len(kept) < len(rows_of(stages, 1))


def test_substring_dedup(stages):
    want = {i: [x.decode() for x, gone in zip(w, out, strict=True) if not gone] for i, w, out in removed(rows_of(stages, 2))}
    got = {r[0]: r for r in rows_of(stages, 3)}
    assert {i: WORDS.findall(r[1]) for i, r in got.items()} == want and all(r[4] == len(r[1]) for r in got.values())
    assert sum(map(len, want.values())) < sum(len(WORDS.findall(r[1])) for r in rows_of(stages, 2))


def test_mix_sources(stages):
    before, after = Counter(rows_of(stages, 3)), Counter(rows_of(stages, 4))
    assert set(after) <= set(before) and max(after.values()) <= 3
    words = lambda c, s: sum(n * len(WORDS.findall(r[1])) for r, n in c.items() if r[3] == s)
    total = words(before, "s0") + words(before, "s1")
    largest = max(len(WORDS.findall(r[1])) for r in before)
    assert abs(words(after, "s0") - min(total * 5 / 7, 3 * words(before, "s0"))) <= largest
    assert abs(words(after, "s0") + words(after, "s1") - total) <= 2 * largest


def test_byte_bpe(stages):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_BPE), special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r[0], len(ids := ref.encode_ordinary(r[1])), sha(" ".join(map(str, ids))), sha(r[1])) for r in rows_of(stages, 4))
    assert Counter(rows_of(stages, 5)) == want


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
