"""Byte-level BPE and the token store beside the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlife.llm import byte_bpe, token_store, vocab_memo
from ledgerlife.llm.common import new_path

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, lang string"
BITS = ["ab", "a", "aa", "the", " the", "é", "日本", "\U000323e7", "\U00010ee7", " ", "  ", "\n", "1", "23", "'s", "'ll", "ß", "😀", "\x1c", " ", " ", "x" * 5, "==", "İ", "́", "Σ", "\t", "<|endoftext|>"]


def texts(n=3000, seed=3):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return [*made, "", None, "a" * 50_000, "".join(rnd.choice("abcd") for _ in range(20_000)), "same text", "same text"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library):
    rows = texts()
    for own, text in zip(byte_bpe.encode_block(rows, RANKS, P.PATTERN), rows):
        assert np.frombuffer(own, "<u4").tolist() == library.encode_ordinary(text or ""), text[:80]


def test_classes_of_every_letter_and_number(library):
    import unicodedata

    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNC"][::7]
    rows = [f"a{c}a {c}1" for c in odd]
    for own, text in zip(byte_bpe.encode_block(rows, RANKS, P.PATTERN), rows):
        assert np.frombuffer(own, "<u4").tolist() == library.encode_ordinary(text), ascii(text)


def test_lower_rank_born_of_a_merge_goes_first(tmp_path):
    """Ranks where a merge makes a pair of lower rank than its own."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cab", b"abab", b"ca"]
    order = [256, 258, 257, 261, 259, 260]  # abc comes before ab and bc
    ranks = {t: i for i, t in enumerate(tokens[:256])} | {tokens[o]: 256 + i for i, o in enumerate(order)}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    theirs = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    rows = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    for own, text in zip(byte_bpe.encode_block(rows, str(path), P.PATTERN), rows):
        assert np.frombuffer(own, "<u4").tolist() == theirs.encode_ordinary(text), text


def test_a_merge_looks_up_only_its_neighbours():
    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    vocab, rnd = byte_bpe.Vocabulary(RANKS, P.PATTERN), random.Random(7)
    vocab.known = Counted()
    pieces = list({bytes(rnd.choice(b"abcdeinorst") for _ in range(rnd.randint(2, 12))) for _ in range(500)})
    ids, sizes = byte_bpe.replay(pieces, vocab)
    split = [(p, n) for p, n in zip(pieces, sizes.tolist()) if p not in vocab.ranks]
    merges = sum(len(p) - n for p, n in split)
    looked_up, known = vocab.known.asked, len(vocab.known)
    assert merges > 500 and looked_up - known <= 2 * merges - len(split)
    assert b"".join(vocab.token[i] for i in ids) == b"".join(pieces)


def test_round_trip_on_spark(spark):
    rows = [(i, t, "old", None) for i, t in enumerate(texts(200))] + [(None, "no key", "old", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(found) == len(rows) and "lang" in found[0].asDict()
    for r in found:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert hashlib.sha256(r["ids"]).hexdigest() == hashlib.sha256(byte_bpe.encode_block([r["text"]], RANKS, P.PATTERN)[0]).hexdigest()
    again = byte_bpe.encode(df, RANKS, P.PATTERN, decoded="lang").collect()
    assert all(bytes(r["lang"]) == (r["text"] or "").encode() for r in again)
    assert byte_bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    library, rows = Tokenizer.from_file(WORDS), texts()
    for own, theirs in zip(token_store.word_encoder(WORDS, 2)(rows), library.encode_batch([t or "" for t in rows], add_special_tokens=False)):
        assert own.tolist() == theirs.ids + [2]


def test_word_encoder_equals_the_library_on_odd_segments():
    library, rnd = Tokenizer.from_file(WORDS), random.Random(9)
    marks = ["<|endoftext|>", "'S", "can't", "WE'LL", "'", "÷", "×", "ÿŸ", "İı", "ΑΣ", "ﬁ", "¼½", "ª", "\x1c", "\t", "\x85", "e\u0301", "É", "ß", "12", "a_b", "<", "😀", "\u00ad"]
    letters = "abcXYZéÈüÖñ0159.,;'-"
    rows = ["".join(rnd.choice([*marks, *letters, " ", "\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    for text, own in zip(rows, token_store.word_encoder(WORDS)(rows)):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_simple_segments_are_cut_as_the_library_cuts_them():
    library, rnd = Tokenizer.from_file(WORDS), random.Random(4)
    marks = ["'s", "'T", "'re", "'VE", "'m", "'ll", "'d", "'r", "'l", "'", "''", "É", "ÿ", "ß", "ÀÖ", "12", "a_b", "\"'s"]
    rows = ["".join(rnd.choice([*marks, *"abstmdrevlXYZ0159.,;-"]) for _ in range(rnd.randint(1, 14))) for _ in range(5_000)]
    numbers, distinct, segment = token_store.cut_simple(rows)
    cut = [[] for _ in rows]
    for n, s in zip(numbers.tolist(), segment.tolist()):
        cut[s].append("".join(token_store.BYTES.get(ord(c), c) for c in distinct[n]))
    assert len(set(distinct)) == len(distinct)
    for text, own in zip(rows, cut):
        assert own == [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))], text
    assert [len(a) for a in token_store.cut_simple([])[::2]] == [0, 0]


def test_words_of_a_block_reach_the_model_together(monkeypatch):
    """Pieces go to the library in batches, never one by one."""
    token_store._memo.cache_clear()
    rows = [f"word{i} w{i % 7}x, Q{i}" for i in range(2_000)]
    calls, profile = [], lambda frame, event, arg: event == "c_call" and calls.append(arg.__name__)
    encode = token_store.word_encoder(WORDS)
    encode(["warm"])
    import sys

    sys.setprofile(profile)
    try:
        made = encode(rows)
    finally:
        sys.setprofile(None)
    assert "tokenize" not in calls and calls.count("encode_batch_fast") < 5
    assert made[5].tolist() == Tokenizer.from_file(WORDS).encode(rows[5], add_special_tokens=False).ids


def test_ids_that_need_more_bytes_are_refused():
    with pytest.raises(ValueError, match="70000"):
        token_store.segment(0, 0, 0, [1], [np.array([5, 70_000], dtype=np.uint32)], 2)
    assert token_store.segment(0, 0, 0, [1], [np.array([5, 70_000], dtype=np.uint32)], 4)["n_ids"] == 2


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_perfect_hash_fills_every_slot_once(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    if n:
        _, slots = token_store.perfect_hash(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_store_returns_every_document_in_key_order(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 2000)
    rows = [(i * 3, t, "", None) for i, t in enumerate(texts(300))] + [(None, "no key", "", ""), (None, None, "", ""), (9, "again", "", ""), (9, "again", "", "")]
    encode, path = token_store.word_encoder(WORDS, 2), new_path(spark, "test")
    token_store.write(spark.createDataFrame(rows, SCHEMA).repartition(5), path, encode, partitions=4)
    found = token_store.read(spark, path).orderBy("start").collect()
    assert len(found) == len(rows)
    keys = [r["key"] for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found]])[:-1].tolist()
    want = sorted((k, encode([t])[0].tolist()) for k, t, *_ in rows if k is not None)
    assert sorted((r["key"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found if r["key"] is not None) == want
    picked = token_store.get(spark, path, [0, 9, 10, 33, -5, 10**12]).collect()
    assert sorted((r["key"], np.frombuffer(r["ids"], "<u4").tolist()) for r in picked) == [w for w in want if w[0] in (0, 9, 33)]


def test_store_of_no_documents(spark):
    path = new_path(spark, "test")
    token_store.write(spark.createDataFrame([], SCHEMA), path, token_store.word_encoder(WORDS, 2))
    assert token_store.read(spark, path).count() == 0 and token_store.get(spark, path, [1]).count() == 0
    assert token_store.get(spark, path, []).count() == 0


ODD_TEXTS = [None, "", " ", "  ", " a", "a ", "a b a b a b", "two  gaps  here", "line\nends \n b", "née Ünï a b", "日本 語 a", "\x00 a\x00b", "a b " * 300]


@pytest.mark.parametrize("texts", [ODD_TEXTS, [None], ["  "], ["", "  x"], ODD_TEXTS[::-1]])
def test_blocks_of_odd_texts_are_encoded_as_single_texts(texts):
    path, pattern = RANKS, P.PATTERN
    vocab = byte_bpe.vocabulary(path, pattern)
    alone = [byte_bpe.replay([p.encode() for p in vocab.split(t)], vocab)[0].astype("<u4").tobytes() if t else b"" for t in texts]
    assert byte_bpe.encode_block(texts, path, pattern) == alone
    words = token_store.word_encoder(WORDS, 2)
    assert [i.tolist() for i in words(texts)] == [words([t])[0].tolist() for t in texts]


def test_a_block_looks_each_distinct_segment_up_once(monkeypatch):
    asked = []
    plain = vocab_memo.Memo.numbered
    monkeypatch.setattr(vocab_memo.Memo, "numbered", lambda self, segments: asked.extend(segments) or plain(self, segments))
    token_store.word_encoder(WORDS)(["a b c " * 1_000, "c b a"])
    byte_bpe.encode_block(["a b c " * 1_000, "c b a"], RANKS, P.PATTERN)
    assert len(asked) < 20
