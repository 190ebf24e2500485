"""Exact nearest codes beside brute force."""

import random

import pytest

from ledgerlife.llm import hamming_search as H

SCHEMA = "id bigint, vector array<float>, label int, bound string, code string"


def plain(codes, queries, k):
    dist = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    out = []
    for q, code in queries:
        near = sorted((dist(code, c), i) for i, c in codes)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("dims, k, n, segment", [(64, 10, 400, 16), (40, 3, 300, 11), (7, 5, 60, 16), (1, 4, 9, 16)])
def test_top_k_equals_brute_force(spark, dims, k, n, segment):
    rnd = random.Random(dims)
    rows = []
    for i in range(n):
        v = [rnd.uniform(-1, 1) for _ in range(dims)]
        if i % 3 == 0 and rows:  # a third of one vector, and near ones
            v = list(rows[0][1])
            if i % 2:
                v[rnd.randrange(dims)] *= -1
        rows.append((i, v))
    rows += [(n + 1, None), (None, [1.0] * dims), (n + 2, [float("nan"), None] + [0.5] * max(0, dims - 2)), (n + 3, []), (5, rows[5][1]), (n + 4, [1.0] * (dims // 2))]
    df = spark.createDataFrame([(i, v, 1, "b", "c") for i, v in rows], SCHEMA)
    coded = H.sign_codes(df, "vector", dims=dims)
    assert coded.count() == len(rows)
    codes = []
    for i, v in rows:
        if i is not None and v is not None:
            bits = [1 if j < len(v) and v[j] is not None and v[j] > 0 else 0 for j in range(dims)]
            codes.append((i, [sum(b << s for s, b in enumerate(bits[a : a + 32])) for a in range(0, dims, 32)]))
    queries = [(i, c) for i, c in codes if i % 10 == 0 or i > n]
    ids = {i for i, _ in queries}
    found = H.top_k(coded, coded.filter(coded.id.isin(sorted(ids))), dims, k, segment)
    assert sorted(map(tuple, found.collect())) == plain(codes, queries, k)


def test_fewer_rows_than_k_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [5]), (2, [4])], "id bigint, code array<bigint>")
    assert sorted(map(tuple, H.top_k(rows, rows.filter("id = 1"), 8, 10).collect())) == [(1, 1, 1, 0), (1, 2, 2, 1)]
    none = rows.limit(0)
    assert H.top_k(none, rows, 8, 10).count() == 0 and H.top_k(rows, none, 8, 10).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert H.sign_codes(empty, "vector").count() == 0


def test_segments_cover_all_bits_once():
    for bits in (1, 31, 32, 33, 64, 100):
        for most in (1, 5, 10, 16, 20):
            cuts = H.cuts_for(bits, most)
            held = [b for start, n in cuts for b in range(start, start + n)]
            assert held == list(range(bits)) and all(start // 32 == (start + n - 1) // 32 for start, n in cuts)
