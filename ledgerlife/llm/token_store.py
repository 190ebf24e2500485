"""Token-id files with constant-time access by document key.

A store is a folder of Parquet files that Spark writes and reads, so it works
on any store and survives lost executors. Documents lie in ascending key order
over shards (the range partitions); a shard is a run of segments of bounded
size, one row each:

- ``payload``: the raw ids of its documents, one after another, little-endian
  unsigned integers of ``width`` bytes (2 if every id fits, else 4);
- a minimal perfect hash over its keys: ``seeds`` (one number for each bucket
  of keys: at least 0 is the seed of the bucket's keys, below 0 is slot
  ``-1 - seed`` of a lone key), and by slot ``prints`` (32-bit fingerprints of
  keys), ``entries`` (number of the key's first document in the segment) and
  ``runs`` (its number of documents);
- ``offsets``: the first id of each document in the payload, and their end;
- ``shard``, ``part``, ``first_key``, ``last_key``, ``ids_before`` (ids of the
  shard before the segment).

A key's documents are found by two hashes, whatever the size of the segment;
a key that the segment lacks is turned away by its fingerprint (one in four
billion passes). Rows without a key come first and share one key of their own;
rows that repeat a key stand together, ordered by a hash of their text.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlife.llm.common import arrow_type, parts, stored
from ledgerlife.llm.vocab_memo import Memo, gathered, parted, texts_of

#: Bytes of payload at which a segment ends.
SEGMENT = 4_000_000
BLOCK = 8_000_000

SCHEMA = (
    "shard int, part int, first_key bigint, last_key bigint, ids_before bigint, n_ids bigint, width int, payload binary, "
    "seeds binary, prints binary, entries binary, runs binary, offsets binary, keys binary, keyless int"
)


# Keys and their hashes -------------------------------------------------------------------------

def mixed(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit keys (finaliser with full avalanche)."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + (np.asarray(seed, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each key) of a minimal perfect hash over distinct keys.

    Buckets of about four keys are placed from the fullest on: each takes the
    first seed that sends all its keys to free slots. Lone keys take the slots
    that are left.
    """
    n = len(keys)
    buckets = max(1, (n + 3) // 4)
    seeds, slots, free = np.zeros(buckets, dtype=np.int32), np.empty(n, dtype=np.int64), np.ones(n, dtype=bool)
    bucket = (mixed(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        members, base = order[ends[b] - sizes[b] : ends[b]], 0
        while True:
            at = (mixed(keys[members][None, :], (tries + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[at].all(axis=1)
            s = np.sort(at, axis=1)
            good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                i = int(good.argmax())
                seeds[b], slots[members] = base + i + 1, at[i]
                free[at[i]] = False
                break
            base += len(tries)
    left = iter(np.flatnonzero(free))
    for b in np.flatnonzero(sizes == 1):
        slot = int(next(left))
        slots[order[ends[b] - 1]], seeds[b] = slot, -1 - slot
    return seeds, slots


class Index:
    """The minimal perfect hash of one segment, as stored."""

    def __init__(self, row: dict) -> None:
        self.seeds = np.frombuffer(row["seeds"], dtype="<i4")
        self.prints = np.frombuffer(row["prints"], dtype="<u4")
        self.entries = np.frombuffer(row["entries"], dtype="<i4")
        self.runs = np.frombuffer(row["runs"], dtype="<i4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; no documents for a key whose fingerprint differs."""
        n = len(self.prints)
        if not n:
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        seed = self.seeds[(mixed(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)].astype(np.int64)
        slot = np.where(seed < 0, -1 - seed, (mixed(keys, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64))
        known = self.prints[slot] == (mixed(keys, 0xF1A6) >> np.uint64(32)).astype(np.uint32)
        return self.entries[slot].astype(np.int64), np.where(known, self.runs[slot], 0).astype(np.int64)


# Writing ---------------------------------------------------------------------------------------

def segment(shard: int, part: int, before: int, keys: list, ids: list[np.ndarray], width: int) -> dict:
    """One row of the store. Keys are sorted, None first."""
    keyless = sum(k is None for k in keys)
    real = np.array(keys[keyless:], dtype=np.int64)
    distinct, first, runs = np.unique(real, return_index=True, return_counts=True)
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    seeds, slots = perfect_hash(distinct) if len(distinct) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    table = np.zeros((3, len(distinct)), dtype=np.int64)
    table[:, slots] = (mixed(distinct, 0xF1A6) >> np.uint64(32)).astype(np.int64), first + keyless, runs
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"id {int(flat.max())} doesn't fit in {width} bytes")
    return {
        "shard": shard, "part": part, "first_key": int(real[0]) if len(real) else None, "last_key": int(real[-1]) if len(real) else None,
        "ids_before": before, "n_ids": len(flat), "width": width, "payload": flat.astype(f"<u{width}").tobytes(),
        "seeds": seeds.astype("<i4").tobytes(), "prints": table[0].astype("<u4").tobytes(), "entries": table[1].astype("<i4").tobytes(),
        "runs": table[2].astype("<i4").tobytes(), "offsets": np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes(),
        "keys": real.astype("<i8").tobytes(), "keyless": keyless,
    }


def write(
    df: DataFrame, path: str, encode: Callable[[list], list[np.ndarray]], key: str = "doc_id", text_col: str = "text",
    width: int = 2, partitions: int | None = None,
) -> None:
    """Encode every text and write the store.

    ``encode`` turns a list of texts (None for null) into id arrays. Only key
    and text are shuffled, once, into ranges of the key; a key that many rows
    share is spread by a hash of the text.
    """
    schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in df.sparkSession.createDataFrame([], SCHEMA).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        for whole in batches:
            for batch in parts(whole, 1, BLOCK):
                for k, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    if keys and (held + len(own)) * width > SEGMENT:
                        yield _row(segment(shard, part, before, keys, ids, width), schema)
                        part, before, keys, ids, held = part + 1, before + held, [], [], 0
                    keys.append(k)
                    ids.append(own)
                    held += len(own)
        if keys:
            yield _row(segment(shard, part, before, keys, ids, width), schema)

    slim = df.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    ranged = slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("key", "text").mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def _row(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=schema)


# Reading ---------------------------------------------------------------------------------------

def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: key, ``start`` (ids of all documents before it), n_tokens, ids (binary, 4 bytes each).

    Each document is looked up by its key through the segment's hash index.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each shard, that is for each range partition of the writer; stored, so that Spark knows its size before the join.
    base = stored(totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")), "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                keys = np.frombuffer(row["keys"], dtype="<i8")
                distinct, copy = np.unique(keys, return_index=True)
                first, runs = Index(row).find(distinct)
                if (runs == 0).any() or runs.sum() != len(keys):
                    raise ValueError("the key index does not fit its segment")
                entry = np.concatenate((np.arange(row["keyless"]), np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(len(keys))))
                offsets = np.frombuffer(row["offsets"], dtype="<i8")
                flat = np.frombuffer(row["payload"], dtype=f"<u{row['width']}").astype("<u4")
                begin, end = offsets[entry], offsets[entry + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * row["keyless"] + keys.tolist(), pa.int64()), pa.array([row["shard"]] * len(entry), pa.int32()),
                        pa.array(row["ids_before"] + begin), pa.array(end - begin),
                        pa.array([flat[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
                    ],
                    names=["key", "shard", "start", "n_tokens", "ids"],
                )

    found = rows.mapInArrow(run, "key bigint, shard int, start bigint, n_tokens bigint, ids binary")
    return found.join(base, "shard").select("key", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def get(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Documents of the given keys (key, ids): reads the segments whose key range holds one, then looks each key up.

    The list is a request, small enough to be sent with each task; keys that the store lacks give no row.
    """
    wanted = np.unique(np.array(keys, dtype=np.int64))
    near = F.lit(False)
    for a in np.array_split(wanted, min(len(wanted), 64)) if len(wanted) else []:
        near = near | ((F.col("first_key") <= int(a[-1])) & (F.col("last_key") >= int(a[0])))
    rows = spark.read.schema(SCHEMA).parquet(path).filter(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                first, runs = Index(row).find(wanted)
                offsets = np.frombuffer(row["offsets"], dtype="<i8")
                flat = np.frombuffer(row["payload"], dtype=f"<u{row['width']}").astype("<u4")
                hits = [(int(k), flat[offsets[e] : offsets[e + 1]].tobytes()) for k, f, n in zip(wanted, first, runs) for e in range(f, f + n)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.binary())], names=["key", "ids"])

    return rows.mapInArrow(run, "key bigint, ids binary")


# The encoder ----------------------------------------------------------------------

#: Segments of text that a worker remembers.
SEGMENTS = 700_000
# Segments of printable ASCII and the Latin letters of one more byte are lowered and cut here, as the tokenizer's own steps
# do, at a small part of their cost; the library's model then encodes each distinct piece. All others go through the library
# as they are.
SIMPLE = re.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Classes of the bytes of lowered simple segments, joined by line ends; letters of two bytes are letters in both.
MARK, LETTER, DIGIT, END = range(4)
CLASSES = np.full(256, MARK, dtype=np.uint8)
CLASSES[ord("a") : ord("z") + 1] = CLASSES[128:] = LETTER
CLASSES[ord("0") : ord("9") + 1] = DIGIT
CLASSES[ord("\n")] = END
#: Distinct pieces that go through the library's model at once.
PIECES = 20_000
#: Those letters as the byte-level alphabet spells them: printable bytes stand for themselves, the others follow from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SPELLED = {b: chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256)}
BYTES = {c: "".join(_SPELLED[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
#: The steps for which that holds.
_STEPS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def _is_plain(tokenizer) -> bool:
    """Whether a tokenizer normalises and cuts as ``_STEPS`` do."""
    held = json.loads(tokenizer.to_str())
    cut = (held["pre_tokenizer"] or {}).get("pretokenizers", [])
    added = [t["content"] for t in held["added_tokens"]]
    return (
        (held["normalizer"] or {}).get("normalizers") == _STEPS[0] and len(cut) == 2 and cut[0].get("pattern") == {"Regex": _STEPS[1]} and cut[0].get("behavior") == "Removed"
        and cut[1].get("type") == "ByteLevel" and not cut[1].get("add_prefix_space") and held["model"]["type"] == "BPE" and not held["model"].get("dropout")
        and all("<" in t for t in added)
    )


def cut_simple(segments: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Simple segments lowered and cut to pieces ('s, 't, 're, 've, 'm, 'll, 'd, letters, one digit, or a run of marks).

    Returns the number of each piece's text, the distinct texts by number, and the segment of each piece.
    """
    raw = np.frombuffer("\n".join(segments).lower().encode() + b"\n", dtype=np.uint8)
    kind = CLASSES[raw]
    begins = np.zeros(len(raw) + 3, dtype=bool)
    begins[0] = True
    begins[1 : len(raw)] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # A contraction starts where a run of marks does, and the rest of its letters start anew.
    at = np.flatnonzero(begins[: len(raw)] & (raw == ord("'")))
    one, two = (raw[np.minimum(at + k, len(raw) - 1)] for k in (1, 2))
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    long = (np.isin(one, np.frombuffer(b"rv", dtype=np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = begins[at[long] + 3] = True
    starts = np.flatnonzero(begins[: len(raw)])
    bounds = np.append(starts, len(raw))
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
    kept = kind[starts] != END
    # Each line end is a piece of its own unless line ends stand together, which they can't: simple segments aren't empty.
    return pieces.indices.to_numpy()[kept], texts_of(pieces.dictionary), np.cumsum(~kept)[kept]


def _model_ids(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder of pieces by the model of a tokenizer alone: their ids one after another, and the number of ids of each."""
    from tokenizers import Tokenizer

    bare = Tokenizer(tokenizer.model)

    def encode(fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelled = [p if p.isascii() else p.translate(BYTES) for p in fresh]
        ids: list[list[int]] = []
        for i in range(0, len(spelled), PIECES):
            ids += [e.ids for e in bare.encode_batch_fast(spelled[i : i + PIECES], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    return encode


@functools.lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = _is_plain(tokenizer)
    pieces = Memo(_model_ids(tokenizer), SEGMENTS // 2)

    def encode(fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        simple = np.fromiter((plain and SIMPLE(s) is not None for s in fresh), dtype=bool, count=len(fresh))
        pieces.begin()
        numbers, distinct, segment = cut_simple(list(itertools.compress(fresh, simple)))
        order = pieces.numbered(distinct)[numbers]
        ids = pieces.found([order])
        other = [e.ids for e in tokenizer.encode_batch_fast(list(itertools.compress(fresh, ~simple)), add_special_tokens=False)]
        ids.append(np.fromiter(itertools.chain.from_iterable(other), dtype=np.uint32))
        sizes = np.concatenate(
            (np.bincount(segment, pieces.sizes[order], int(simple.sum())).astype(np.int64), np.fromiter(map(len, other), dtype=np.int64, count=len(other)))
        )
        place = np.empty(len(fresh), dtype=np.int64)
        place[np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))] = np.arange(len(fresh))
        return gathered(place, np.concatenate(ids), sizes, np.cumsum(sizes) - sizes), sizes[place]

    return Memo(encode, SEGMENTS)


def word_encoder(path: str, end_id: int | None = None) -> Callable[[list], list[np.ndarray]]:
    """Encoder by a tokenizers file whose model drops white space, such as the word BPE.

    Texts are cut at spaces and line ends, where no token of such a model
    reaches over, and each distinct segment goes through the library once per
    worker. ``end_id`` is appended to every document.
    """

    def encode(texts: list) -> list[np.ndarray]:
        memo = _memo(path)
        memo.begin()
        parts, bounds, distinct = parted([(t or "").replace("\n", " ") for t in texts])
        order = memo.numbered(distinct)[parts]
        made = memo.found([order[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        return made if end_id is None else [np.append(ids, np.uint32(end_id)) for ids in made]

    return encode

