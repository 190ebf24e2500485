"""Fingerprints and classes beside a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerlife.llm import simhash
from ledgerlife.llm.components import components

SCHEMA = "doc_id bigint, text string, fingerprint string, _hash int"


def plain_fingerprint(text):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def plain_classes(prints):
    """Smallest key per row, by union of all pairs within two bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i][1] ^ prints[j][1]) & ((1 << 64) - 1)).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(prints))]


def flip(fp, *bits):
    for b in bits:
        fp ^= 1 << b
    fp &= (1 << 64) - 1
    return fp - (1 << 64) if fp >= 1 << 63 else fp


def test_fingerprint_equals_plain_version():
    rnd = random.Random(1)
    rows = ["", None, " \n", "One", "One two", "A b C", "É x y z", "w " * 70_000, "x\x1cy z q"]
    rows += [" ".join(rnd.choice(["the", "The", "of", "é", "x\t", " "]) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    for text in rows:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text and text[:50]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1, 3])
def test_classes_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(crowd)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = [(i, flip(b)) for i, b in enumerate(base)]
    for b in base[:12]:  # chains and clouds
        at = b
        for _ in range(rnd.randint(1, 8)):
            at = flip(at, *rnd.sample(range(64), rnd.randint(0, 3)))
            prints.append((100 + len(prints), at))
    prints += [(None, flip(base[0], 5)), (None, rnd.getrandbits(62)), (7, flip(base[3], 1, 2)), (7, flip(base[3], 1, 2)), (500, 0), (501, flip(0, 3, 63)), (502, -1)]
    df = spark.createDataFrame(prints, "doc_id bigint, fingerprint bigint")
    found = {r["fingerprint"]: r["component_id"] for r in simhash.classes(df).collect()}
    for (_, fp), want in zip(prints, plain_classes(prints)):
        assert found[fp] == want


def test_no_pair_within_two_bits_is_missed(spark):
    """Every pair of flips, within a segment or over two."""
    base = 0x0F3C_55AA_1234_8001
    prints = [flip(base)] + [flip(base, a, b) for a in range(0, 64, 5) for b in range(a)]
    found = simhash.links(spark.createDataFrame([(p,) for p in set(prints)], "fp bigint"))
    linked = {r["node"]: r["root"] for r in components(found).collect()}
    assert len({linked[p] for p in prints}) == 1


def test_near_duplicates_and_deduplicate(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, long, "x", 1), (2, long + " extra", "y", 2), (9, long, "z", 3), (9, long, "z", 3), (None, long, "n", 4), (3, "", "e", 5), (4, None, "e", 6), (8, "quite another text", "k", 7), (None, "alone without key", "k", 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    want = plain_classes([(k, plain_fingerprint(t)) for k, t, *_ in rows])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or -1) for r in found) == sorted((k is None, k or 0, c or -1) for (k, *_), c in zip(rows, want))
    kept = simhash.deduplicate(df).collect()
    assert df.columns == list(kept[0].asDict())
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in kept) == [(-1, "k"), (2, "y"), (3, "e"), (8, "k")]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (5000, 4999), (4999, 5000)]
    rnd = random.Random(2)
    rnd.shuffle(chain)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert len({found[i] for i in range(301)}) == 1 and len({found[1000 + i] for i in range(400)}) == 1
    assert len(set(found.values())) == 3
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_joins_over_exploded_rows_are_never_broadcast(spark, monkeypatch):
    """Spark sizes exploded rows as those before them, so a table far over the threshold would go through the driver."""
    plans, whole = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, label))
    monkeypatch.setattr(simhash, "CROWD", 3)
    prints = {flip(0x0F3C_55AA_1234_8001, a, b) for a in range(0, 64, 5) for b in range(a)}
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    found.collect()  # the plan that ran: joins may change as sizes become known
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in plans)
