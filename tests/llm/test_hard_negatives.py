"""Hard negatives beside brute force, boxes beside their rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlife.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<bigint>, label int, anchor_id string, row int, score string, lo int"


def plain(rows, every=10):
    """Rows as (place, id, vector, label); anchors have ids divisible by ``every``."""
    held = [(i, v, x, l) for i, (v, x, l) in enumerate(rows) if l is not None and x is not None and None not in x]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, v, x, l in held:
        if v is None or v % every:
            continue
        near = sorted(((dot(x, y), w) for j, w, y, m in held if j != i and m == l), key=key)[:5]
        for p, pid in near:
            far = sorted(((s, w) for j, w, y, m in held if m != l for s in [dot(x, y)] if 80 * p <= 100 * s <= 100 * p), key=key)[:5]
            out += [(v, pid, r + 1, w, p, s) for r, (s, w) in enumerate(far)]
    return sorted(out, key=str)


def found(spark, rows, every=10):
    df = spark.createDataFrame([(v, x, l, "x", 1, "s", 2) for v, x, l in rows], SCHEMA)
    out = H.hard_negatives(df, F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(seed, n, dims, hot=0.4):
    rnd = random.Random(seed)
    centres = [[rnd.randint(-60, 60) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rnd.randrange(5)
        x = [v + rnd.randint(-4, 4) for v in centres[c]] if rnd.random() < 0.7 else [rnd.randint(-60, 60) for _ in range(dims)]
        if rows and rnd.random() < 0.1:  # ties
            x = list(rows[rnd.randrange(len(rows))][1])
        rows.append((i, x, 0 if rnd.random() < hot else rnd.choice([c, 9, -3])))
    return rows


@pytest.mark.parametrize("leaf, page, fan, block", [(8, 32, 4, 8), (H.LEAF, H.PAGE, H.FAN, H.BLOCK)])
def test_equals_brute_force(spark, monkeypatch, leaf, page, fan, block):
    """With small pages the tree has several inner levels; with the sizes in use the result is the same."""
    for name, value in (("LEAF", leaf), ("PAGE", page), ("FAN", fan), ("BLOCK", block)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(leaf, 600, 6)
    rows += [rows[20], rows[20], (20, rows[30][1], 0), (None, rows[10][1], 1), (None, rows[10][1], 0), (1000, None, 1), (1010, [1, None, 2, 3, 4, 5], 1), (1020, rows[1][1], None), (1030, [], 9), (1040, [50], 9), (1050, [0] * 6, 0)]
    want = plain([(v, x and x + [0] * (6 - len(x)) if x is not None else None, l) for v, x, l in rows])
    assert found(spark, rows) == want and want


def test_far_components_stay_exact(spark):
    big = 1 << 26
    rows = [(i, [big + i, -big + 3 * i, 7 * i], i % 2) for i in range(40)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(10, [1, 2], 1)], [(10, [1], 1), (11, [1], 1)], [(10, None, 1), (None, [1], None)], [(10, [], 1), (11, [], 1), (12, [], 2)], [(10, [-1], 1), (11, [1], 1), (12, [1], 2)]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_bounds_hold_and_tiles_cover():
    rnd = np.random.default_rng(2)
    x, a = rnd.integers(-200, 200, (500, 7)), rnd.integers(-200, 200, (40, 7))
    parts = H.tiles(x, np.array([3, 1, 0]), 16)
    assert sorted(np.concatenate(parts)) == list(range(500)) and max(map(len, parts)) <= 16
    lower, upper = H.bounds(a, np.stack([x[p].min(0) for p in parts]), np.stack([x[p].max(0) for p in parts]))
    for t, p in enumerate(parts):
        scores = a @ x[p].T
        assert (scores >= lower[:, [t]]).all() and (scores <= upper[:, [t]]).all()


def test_pages_out_of_reach_are_pruned(spark, monkeypatch):
    """Apart clusters: the second descent takes an anchor to few pages only."""
    for name, value in (("LEAF", 8), ("PAGE", 16), ("FAN", 4)):
        monkeypatch.setattr(H, name, value)
    rnd = random.Random(1)
    rows = [(i, [1000 * (i % 8 == d) + rnd.randint(0, 3) for d in range(8)], i % 8) for i in range(800)]
    pairs = []
    whole = H.descend
    monkeypatch.setattr(H, "descend", lambda anchors, tree, best=False: pairs.append((best, whole(anchors, tree, best), tree)) or pairs[-1][1])
    assert found(spark, rows, 80) == plain(rows, 80)
    best, frontier, tree = pairs[1]
    assert not best and len(tree.levels) > 1
    assert frontier.count() < 0.3 * tree.pages.count() * 10
