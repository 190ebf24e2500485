"""Nodes of the prefix trie beside brute force."""

import hashlib
import random
import zlib

import pytest

from ledgerlife.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, name int, token string, chars int, pos int"


def plain_rebuilt(rows):
    """Sequences by conversation; equal turns in the operator's order, by token."""
    token = lambda r, t: hashlib.md5(f"{len(r.encode())}:".encode() + r.encode() + t.encode()).digest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, token(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(held)] for c, held in own.items()}
    out = {}
    for c, held in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = donor[:h] + held[h:]
    return out


def plain_nodes(rows):
    members, ends = {}, {}
    for c, held in plain_rebuilt(rows).items():
        for d in range(len(held) + 1):
            members.setdefault(tuple(held[:d]), []).append(c)
        ends.setdefault(tuple(held), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children.get(path, [])]
        leaves, saved = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        sums[path] = leaves, saved
        joined = ",".join(map(str, sorted(ends.get(path, []))))
        above = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), above, len(members[path]), len(children.get(path, [])), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "d", 1, "t", 2, 3) for r in rows], SCHEMA)
    out = P.prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def made(seed):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", None, ""], ["a", "bé", "", None, "ccc", "a"]
    rows = []
    for c in rnd.sample(range(-250, 700), 90) + [0, 100, 200, 300]:
        base = random.Random(c // 150)
        n = rnd.choice([1, 1, 2, 3, 5, 7, 8, 9, 16, 17, 33])
        same = rnd.random() < 0.7
        for t in range(n):
            pick = base if same else rnd
            rows.append((c, rnd.choice([t, t, t, None]) if rnd.random() < 0.2 else t, pick.choice(roles), pick.choice(texts)))
    rows += [r for r in rows if r[0] == 200] + [(None, 1, "user", "x"), (None, None, None, None), (650, None, None, None), (10**15, 5, "u", "é" * 3000), (-7, 2**40, "u", "z"), (-7, -(2**40), "u", "y")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_brute_force(spark, seed):
    rows = made(seed)
    assert found(spark, rows) == plain_nodes(rows)


def test_many_copies_and_one_long_conversation(spark, monkeypatch):
    """Equal conversations end in one node, whose members are hashed in chunks; one holds most of the turns."""
    monkeypatch.setattr(P, "CHUNK", 40)
    rows = [(c, t, "user", f"t{t}") for c in range(1, 260) for t in range(3)] + [(5000, t, "user", f"t{t % 7}") for t in range(300)] + [(5001, t, "user", f"t{t % 7}") for t in range(290)]
    assert found(spark, rows) == plain_nodes(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(7, 1, "a", "b")], [(5, None, None, None)], [(100, 1, "a", "b"), (100, 1, "a", "b")]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == plain_nodes(rows)
