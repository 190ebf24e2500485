"""Line quality, secrets and mixing beside brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlife.llm import line_quality, mixing, secret_scan

SCHEMA = "doc_id bigint, text string, source string, lines string, taken int, _size int, secrets int"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def corpus(seed=4, n=160):
    rnd = random.Random(seed)
    shared = ["Copyright 2019 by us", "read MORE  here", "one two three four five six seven"]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 6))]
        lines += rnd.sample(shared, rnd.randint(0, 3))
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), rnd.choice(["s1", "s1", "s1", "s2", None, ""])))
    rows += [(200, None, "s1"), (201, "", None), (None, "no key " * 12, "s2"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (300, " \n\t\n", "s2"), (301, "long word " * 30_000, "s9"), (302, "$#<>|&%* é", "s2")]
    return [(*r, "x", 1, 2, 3) for r in rows]


def plain_quality(rows, limit):
    norm = lambda line: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")
    own, seen = [], Counter()
    for _, text, source, *_ in rows:
        lines = list(dict.fromkeys(x for x in map(norm, (text or "").split("\n")) if x))
        own.append(lines)
        seen.update((source, x) for x in lines)
    out = []
    for (key, text, source, *_), lines in zip(rows, own):
        text, w = text or "", words(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(windows)
        hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)}
        worded = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        total, gone = sum(len(x.split(" ")) for x in lines), sum(len(x.split(" ")) for x in lines if seen[source, x] > limit)
        kept = not failed and (gone == 0 or total - gone >= 10 and total - gone >= 0.2 * total)
        out.append((key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(hit), failed, total, gone, kept))
    return out


def ordered(rows):
    return sorted((tuple((x is None, x if x is not None else 0) for x in r) for r in rows))


@pytest.mark.parametrize("limit", [5, 20])
def test_line_quality_equals_plain_version(spark, limit):
    rows = corpus()
    found = line_quality.judge(spark.createDataFrame(rows, SCHEMA), max_docs=limit)
    want = plain_quality(rows, limit)
    assert any(w[8] for w in want) and any(not w[6] and not w[9] for w in want)
    assert ordered(map(tuple, found.collect())) == ordered(want)
    assert line_quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        part = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * sizes[s]}
        if not over:
            return target | part
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("span", [mixing.RANGE, 7])
def test_mixing_equals_plain_version(spark, monkeypatch, span):
    monkeypatch.setattr(mixing, "RANGE", span)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.plan(df).collect()
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(words(text))
    goal = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    by = defaultdict(list)
    for key, text, source, *_ in rows:
        by[source].append((hashlib.md5(f"mix{'null' if key is None else key}".encode()).hexdigest(), key, len(words(text))))
    for source, own in by.items():
        budget = int(goal[source] + 0.5)
        epochs, want = (budget // sizes[source] if sizes[source] else 0), []
        rest = budget - epochs * sizes[source]
        for _, key, size in sorted(own, key=lambda x: (x[0], x[1] or 0)):
            want.append((key or -1, epochs * size + min(size, rest)))
            rest -= min(size, rest)
        assert sorted((r["key"] or -1, r["taken"]) for r in found if r["source"] == source) == sorted(want)
    again = mixing.plan(df.repartition(5)).collect()
    assert ordered((r["key"], r["source"], r["taken"]) for r in again) == ordered((r["key"], r["source"], r["taken"]) for r in found)


def test_mix_gives_the_planned_words(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    planned, mixed = Counter(), Counter()
    for r in mixing.plan(df).collect():
        planned[r["key"], r["source"]] += r["taken"]
    out = mixing.mix(df).collect()
    assert list(out[0].asDict()) == df.columns
    texts = {(k, s): t for k, t, s, *_ in rows}
    for r in out:
        whole, own = words(texts[r["doc_id"], r["source"]]), words(r["text"])
        assert own and own == whole[: len(own)] and (len(own) < len(whole) or r["text"] == texts[r["doc_id"], r["source"]])
        mixed[r["doc_id"], r["source"]] += len(own)
    assert mixed == +planned
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0 and mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, "", "a", "", 1, 1, 1), (2, None, None, "", 1, 1, 1)], SCHEMA)
    assert [r["taken"] for r in mixing.plan(blank).collect()] == [0, 0] and mixing.mix(blank).count() == 0


def plain_base(text):
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_plain_secrets_equal_the_patterns():
    rnd = random.Random(6)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdef", "0123456789", "AKIA", "ABCDEFGHIJ", "é", "\n", "Z", "-", "/", "😀", "deadbeef"]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert secret_scan.plain_spans(text) == plain_base(text), text


@pytest.mark.parametrize(
    "text, literal",
    [
        ('db_pw = "hunter2x"\nDB_PASSWORD_FILE = x\nprivate_key = "Zx81kQpL0vB7tR2m"', "Zx81kQpL0vB7tR2m"),
        ("k = 'qW3eR5tY7uI9oP1a'\nclient.access_key = k", "qW3eR5tY7uI9oP1a"),
        ("A='qW3eR5tY7uI9oP1a'\nexport SESSION_PASS=${A}", "qW3eR5tY7uI9oP1a"),
        ('{"userPassword2": "qW3eR5tY!7uI9oP1a"}', "qW3eR5tY!7uI9oP1a"),
        ("credentials: qW3eR5tY7uI9oP1a@x", "qW3eR5tY7uI9oP1a@x"),
    ],
)
def test_lexer_finds_assigned_literals(text, literal):
    held = [text[a:b] for a, k, b in secret_scan.spans(text) if secret_scan.KINDS[k] == "lexed"]
    assert literal in held


@pytest.mark.parametrize("text", ["", None, "time: 10:30, ratio = 3", 'password = "changeme"', "the token: see below", "key: value", "title = 'A long title about secrets'", "a = b\nb = a\npassword = a"])
def test_lexer_leaves_prose_alone(text):
    assert secret_scan.spans(text) == []


def test_scan_and_redact_on_spark(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é token = "{secret}" end', "s"), (2, None, "s"), (3, "", None), (4, "clean text", "s"), (4, "clean text", "s"), (5, "k = 'qW3eR5tY7uI9oP1a'\npassword = k " + "word " * 50_000 + secret, "s")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    found = {r["doc_id"]: r["secrets"] for r in secret_scan.scan(df).collect()}
    assert [(s["kind"], s["start"]) for s in found[1]] == [("assign", 2), ("hex", 11)] and not found[2] and not found[3] and not found[4]
    assert [s["kind"] for s in found[5]] == ["lexed", "hex"]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert clean[1] == 'é [SECRET]" end' and clean[2] is None and clean[3] == "" and clean[4] == "clean text"
    assert secret not in clean[5] and clean[5].startswith("k = '[SECRET]'\npassword = k word")
    assert secret_scan.redact(df).columns == df.columns and secret_scan.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(secret_scan.WEAK))
def test_weak_names_find_random_literals_of_each_kind(name):
    for value in ("x9k2m4q7v1z8n3b6", "X9K2M4Q7V1Z8N3B6", "xKqMvZnBrTwYpLdG", "x9K2m4Q7v1Z8n3B6", "x9-k2/m4_q7+v1.z8", "x9K2-m4Q7/v1Z8+n3B6"):
        text = f'{name} = "{value}"'
        assert any(text[a:b] == value for a, _, b in secret_scan.spans(text)), text
    for value in ("background-color", "backgroundColorPicker", "primary_content_wrapper", "changeme", "session", "2024-01-01 10:00"):
        assert secret_scan.spans(f'{name} = "{value}"') == []


def test_pass_beside_a_user_or_service_is_strong():
    for text in ("SMTP_PASS=kq8v2n5x1m4z7p3w", "dbPass: kq8v2n5x1m", "auth = 'x9k2m4q7v1z8n3b6'"):
        assert len(secret_scan.spans(text)) == 1, text
    assert secret_scan.sensitivity("boarding_pass") == 0.5 and secret_scan.sensitivity("USER_PASS") == 1.0


@pytest.mark.parametrize("limit", [5, 20])
def test_cleaned_texts_lack_the_lines_that_are_counted(spark, limit):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    norm = lambda line: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")
    seen = Counter((r[2], x) for r in rows for x in set(map(norm, (r[1] or "").split("\n"))) if x)
    want = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if seen[r[2], norm(x)] <= limit), *r[2:]) for r in rows]
    found = line_quality.cleaned(df, max_docs=limit)
    assert found.columns == df.columns and ordered(map(tuple, found.collect())) == ordered(want)
    assert any(a[1] != b[1] for a, b in zip(rows, want))
