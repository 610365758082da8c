import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import borda, bpe, splitting

SCORES = "query_id bigint, chunk_id string, base_score double, score double, reranker_score double, points double, n int"


def brute(data):
    """Points by counting, per query."""
    by = {}
    for q, c, *s in data:
        old = by.setdefault(q, {}).setdefault(c, [None] * 3)
        for i, v in enumerate(s):
            if v is not None and v == v and (old[i] is None or v > old[i]):
                old[i] = v
    out = []
    for q, cs in by.items():
        for c in cs:
            total = 0.0
            for i in range(3):
                v = cs[c][i]
                if v is not None:
                    others = [x[i] for x in cs.values() if x[i] is not None]
                    total += (sum(x < v for x in others) - sum(x > v for x in others)) / 2
            out.append((q, c, total))
    return out


def test_borda_against_counting(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2]), f"c{rng.randint(0, 14)}", *[rng.choice([None, float("nan"), rng.randint(0, 5) * 10.0**k]) for k in range(3)]) for _ in range(80)]
    points = borda.borda_points(spark.createDataFrame([(*d, 1.0, 1) for d in data], SCORES), "query_id", "chunk_id")
    want = brute(data)
    assert rows(points) == sorted(((q, c, float(p)) for q, c, p in want), key=str)
    ranking = {(r[0], r[1]): r[3] for r in rows(borda.borda_ranking(points, "query_id", "chunk_id"))}
    for q in (1, 2):
        order = sorted((x for x in want if x[0] == q), key=lambda x: (-x[2], x[1]))
        assert [ranking[(q, c)] for _, c, _ in order] == list(range(1, len(order) + 1))
        top = sorted(r[1] for r in rows(borda.borda_top(points, "query_id", "chunk_id", 5)) if r[0] == q)
        assert top == sorted(c for _, c, _ in order[:5])


def test_borda_empty_and_all_missing(spark, rows):
    assert rows(borda.borda_points(spark.createDataFrame([], SCORES), "query_id", "chunk_id")) == []
    df = spark.createDataFrame([(1, "b", None, None, None, 0.0, 1), (1, "a", None, None, None, 0.0, 1), (None, "x", 1.0, 1.0, 1.0, 0.0, 1)], SCORES)
    points = borda.borda_points(df, "query_id", "chunk_id")
    assert [r[1] for r in rows(borda.borda_ranking(points, "query_id", "chunk_id"))] == ["a", "b"]


def pieces_of(text, most, overlap):
    return list(zip(*splitting.cuts(np.frombuffer(text.encode("utf-8"), np.uint8), most, overlap), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r\té中🙂", min_size=1, max_size=120), st.integers(4, 40), st.integers(0, 12))
def test_pieces_cover_within_limit(text, most, overlap):
    raw = text.encode("utf-8")
    out = pieces_of(text, most, overlap)
    assert out[0][0] == 0 and out[-1][1] == len(raw)
    for a, b in out:
        raw[a:b].decode("utf-8")
        assert 0 < b - a <= max(4, most)
    for (_, b), (c, d) in zip(out, out[1:], strict=False):
        assert c <= b < d
        assert b - c <= overlap + 3


def greedy(text, most, overlap):
    nodes, begin, step = splitting.successors(np.frombuffer(text.encode("utf-8"), np.uint8), most, overlap)
    out, i = [], 0
    while i < len(nodes) - 1:
        out.append((int(begin[i]), int(nodes[step[i]])))
        i = step[i]
    return out


def test_doubling_equals_one_step_at_a_time():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", "\n", "\n\n", "ä", "x" * 9]) for _ in range(rng.randint(1, 90)))
        assert pieces_of(text, rng_limit := rng.randint(8, 40), 5) == greedy(text, rng_limit, 5)


def test_cuts_stand_at_line_ends():
    text = "".join(f"line {i}\n" for i in range(60))
    out = pieces_of(text, 50, 10)
    assert all(text[b - 1] == "\n" for _, b in out)


LIMITS = "language string, max_bytes int, overlap_bytes int"
ITEMS = "pending_id bigint, language string, start_line int, start_byte bigint, text string, id int, max_bytes int"


def test_split_items(spark, rows):
    limits = spark.createDataFrame([("Python", 20, 4), ("default", 30, 0)], LIMITS)
    long = "aaaa\nbbbb\ncccc\ndddd\neeee\n"
    items = spark.createDataFrame([(1, "PYTHON", 10, 100, long, 0, 0), (1, "PYTHON", 10, 100, long, 0, 0), (2, "go", 1, 0, long, 0, 0), (3, None, 1, None, "x" * 31, 0, 0), (4, "python", 1, 0, None, 0, 0), (5, "python", 1, 0, "", 0, 0), (None, "go", 1, 1, "y" * 99, 0, 0)], ITEMS)
    got = rows(splitting.split_items(items, limits, "pending_id"))
    assert [r[:8] for r in got if r[0] == 1] == [(1, 0, 0, 20, 100, 120, 10, 13), (1, 1, 16, 25, 116, 125, 13, 14)]
    assert [r[8] for r in got if r[0] == 1] == [long[:20], long[16:]]
    assert sorted({r[0] for r in got}) == [1, 3]
    assert rows(splitting.oversized_ids(items, limits, "pending_id")) == [(1,), (3,)]


def test_split_nothing(spark, rows):
    limits = spark.createDataFrame([("default", 30, 0)], LIMITS)
    assert rows(splitting.split_items(spark.createDataFrame([], ITEMS), limits, "pending_id")) == []


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    e = bpe.Encoder()
    return e, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_another_encoder(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ours, other = reference
    assert ours.encode(text) == other.encode_ordinary(text)


def test_long_runs_and_markers(reference):
    ours, other = reference
    for text in ("a" * 5000, "<|endoftext|>" * 3, " " * 700 + "x", "ab" * 2000, "日本語" * 300, "\r\n\t" * 50):
        assert ours.encode(text) == other.encode_ordinary(text)


def test_token_ids(spark, rows):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id bigint, text string, ids string")
    got = rows(bpe.token_ids(df))
    assert got[0][0] == 1 and len(got[0][1]) == 2 and got[1:] == [(2, []), (3, []), (3, [])]
    assert rows(bpe.token_counts(df, ["doc_id"]))[0] == (1, 2)
    assert rows(bpe.token_ids(df.limit(0))) == []
