"""Hard negatives from an R-tree packed by sort-tile-recursive.

Rows are sorted by (label, widest coordinate) over all tasks and cut to slabs,
each slab is sorted by (label, second coordinate) and cut to pages, and each page
is tiled by further coordinates down to leaves of one label. Every leaf, page and
inner node has its minimum bounding box. With an anchor a, a box gives an interval
for each product a_i * x_i, and their sums bound the inner product of a with any row
inside from both sides.

A search asks for the best rows within score windows. It descends from at most
``FAN`` top boxes, level by level, and takes an anchor to a child only where some
window can still hold a better row: the box reaches the window and its upper bound
isn't strictly below the k-th score found so far. A first descent follows the best
bound of each level alone and ends in one page for each anchor, which gives the k-th
scores that prune the second one, which leaves nothing out. Within a page, leaves come
from a queue in the order of their bounds.

Anchors and pages meet in blocks: one row holds a page and up to about ``BLOCK`` anchors
that reach it, scored by one matrix product. Only the top boxes, a fixed number, pass
through the driver. Scores are integers and exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import give_back, stored

#: Rows of a leaf and of a page, children of an inner node, anchors of a block.
LEAF, PAGE, FAN, BLOCK = 128, 2048, 256, 512
#: Components are held within these limits, so that scores of up to 512 dimensions fit a long.
LIMIT, DIMS = 1 << 27, 512
NONE = -(1 << 63)

_I4, _I8 = np.dtype("<i4"), np.dtype("<i8")


def _schema(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items()])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a binary column of 32-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_I4).reshape(-1, dims)


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where all sums of their products are exact in doubles, else as 64-bit integers."""
    top = lambda x: int(np.abs(x.astype(np.int64)).max(initial=0))
    kind = np.float64 if top(a) * top(b) * a.shape[1] < 1 << 52 else np.int64
    return a.astype(kind), b.astype(kind)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of each row of a with any point of each box."""
    both, (n, dims) = np.concatenate([lo, hi]), lo.shape
    a, both = exact(a, both) if n else (a.astype(np.float64), both.astype(np.float64))
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    lo, hi = both[:n].T, both[n:].T
    return plus @ lo + minus @ hi, plus @ hi + minus @ lo


def tiles(x: np.ndarray, order: np.ndarray, size: int) -> list[np.ndarray]:
    """Sort-tile-recursive: row numbers of x in tiles of at most ``size`` rows, by the coordinates in ``order``."""
    done, open_ = [], [(np.arange(len(x)), 0)]
    while open_:
        rows, at = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        left = max(1, min(3, len(order)) - at % max(1, min(3, len(order))))
        pages = math.ceil(len(rows) / size)
        slabs = max(2, math.ceil(pages ** (1 / left)))
        rows = rows[np.argsort(x[rows, order[at % len(order)]], kind="stable")] if len(order) else rows
        each = size * math.ceil(pages / slabs)
        open_ += [(rows[i : i + each], at + 1) for i in range(0, len(rows), each)]
    return done


_PAGE = dict(
    node="long", lo="binary", hi="binary", least="int", most="int", rows="binary", ids="binary", known="binary", vectors="binary", leaf_ends="binary",
    leaf_labels="binary", leaf_lo="binary", leaf_hi="binary",
)


def packed(rows: DataFrame, dims: int, order: list[int]) -> DataFrame:
    """Pages of rows (row, id, label, vector): their box, the labels they span, and their leaves."""
    n = rows.count()
    first, second = (F.get("vector", F.lit(order[i])) if len(order) > i else F.lit(0) for i in (0, 1))
    slabs = max(1, math.ceil(math.sqrt(n / PAGE)))
    slabbed = rows.repartitionByRange(slabs, "label", F.coalesce(first, F.lit(0)), "row").withColumn("slab", F.spark_partition_id())
    keys = ["slab", "label", F.coalesce(second, F.lit(0)), "row"]
    tiled = stored(slabbed, "slabs").repartitionByRange(max(1, math.ceil(n / (4 * PAGE))), *keys).sortWithinPartitions(*keys)
    inner = np.array(order[1:] or order, dtype=int)

    def page(held: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(held)
        label = table.column("label").to_numpy().astype(_I4)
        x = _vectors(table.column("vector").combine_chunks(), dims)
        leaves = []
        for value in np.unique(label):
            own = np.flatnonzero(label == value)
            leaves += [own[t] for t in tiles(x[own], inner, LEAF)]
        at = np.concatenate(leaves)
        ids = table.column("id").combine_chunks()
        return {
            "lo": x.min(0).tobytes(), "hi": x.max(0).tobytes(), "least": int(label.min()), "most": int(label.max()),
            "rows": table.column("row").to_numpy()[at].astype(_I8).tobytes(), "ids": ids.fill_null(0).to_numpy(zero_copy_only=False)[at].astype(_I8).tobytes(),
            "known": ids.is_valid().to_numpy(zero_copy_only=False)[at].astype(np.uint8).tobytes(), "vectors": x[at].tobytes(),
            "leaf_ends": np.cumsum([len(t) for t in leaves]).astype(_I4).tobytes(), "leaf_labels": np.array([label[t[0]] for t in leaves], dtype=_I4).tobytes(),
            "leaf_lo": np.stack([x[t].min(0) for t in leaves]).tobytes(), "leaf_hi": np.stack([x[t].max(0) for t in leaves]).tobytes(),
        }

    schema = {k: v for k, v in _PAGE.items() if k != "node"}
    kind = pa.schema([(k, {"int": pa.int32(), "binary": pa.binary()}[v]) for k, v in schema.items()])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, PAGE - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == PAGE:
                    yield pa.RecordBatch.from_pylist([page(held)], schema=kind)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([page(held)], schema=kind)
        give_back()

    made = tiled.select("row", "id", "label", "vector").mapInArrow(build, _schema(**schema))
    return stored(made.select(F.monotonically_increasing_id().alias("node"), "*"), "pages")


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of 32-bit integers, shorter ones with zeros at the end."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(_I4)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=_I4)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


_INNER = dict(node="long", lo="binary", hi="binary", least="int", most="int", children="binary", child_least="binary", child_most="binary", child_lo="binary", child_hi="binary")


def inner_level(boxes: DataFrame, dims: int) -> DataFrame:
    """Inner nodes over boxes (node, lo, hi, least, most), ``FAN`` neighbours in the order of their numbers in each."""
    schema = {k: v for k, v in _INNER.items() if k != "node"}
    kind = pa.schema([(k, {"int": pa.int32(), "binary": pa.binary()}[v]) for k, v in schema.items()])

    def node(held: list[dict]) -> dict:
        lo, hi = (np.stack([np.frombuffer(h[side], dtype=_I4) for h in held]) for side in ("lo", "hi"))
        least, most = (np.array([h[side] for h in held], dtype=_I4) for side in ("least", "most"))
        return {
            "lo": lo.min(0).tobytes(), "hi": hi.max(0).tobytes(), "least": int(least.min()), "most": int(most.max()), "children": np.array([h["node"] for h in held], dtype=_I8).tobytes(),
            "child_least": least.tobytes(), "child_most": most.tobytes(), "child_lo": lo.tobytes(), "child_hi": hi.tobytes(),
        }

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == FAN:
                    yield pa.RecordBatch.from_pylist([node(held)], schema=kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([node(held)], schema=kind)

    n = boxes.count()
    ordered = boxes.repartitionByRange(max(1, math.ceil(n / (4 * FAN))), "node").sortWithinPartitions("node")
    return stored(ordered.mapInArrow(build, _schema(**schema)).select(F.monotonically_increasing_id().alias("node"), "*"), "inner")


class Tree:
    """Pages, the inner levels above them, and the top boxes, ``FAN`` at most."""

    def __init__(self, rows: DataFrame, dims: int, order: list[int]):
        self.dims, self.pages, self.levels = dims, packed(rows, dims, order), []
        boxes = self.pages
        while boxes.count() > FAN:
            boxes = inner_level(boxes.select("node", "lo", "hi", "least", "most"), dims)
            self.levels.append(boxes)
        self.top = [tuple(r) for r in boxes.select("node", "lo", "hi", "least", "most").collect()]


# A searching anchor: its row, label and vector, and for each window lowest and highest score and the k-th found so far.
_ANCHOR = dict(a="long", label="int", vector="binary", same="boolean", lo="array<bigint>", hi="array<bigint>", kth="array<bigint>")


class _Anchors:
    """Anchors of a batch or a block as arrays; windows are padded by empty ones."""

    def __init__(self, rows: list[dict], dims: int):
        self.rows = rows
        self.a = np.array([r["a"] for r in rows], dtype=np.int64)
        self.label = np.array([r["label"] for r in rows], dtype=np.int64)
        self.same = np.array([r["same"] for r in rows], dtype=bool)
        self.x = np.frombuffer(b"".join(r["vector"] for r in rows), dtype=_I4).reshape(len(rows), dims)
        wide = max((len(r["lo"]) for r in rows), default=0)
        side = lambda name, pad: np.array([list(r[name]) + [pad] * (wide - len(r[name])) for r in rows], dtype=np.int64).reshape(len(rows), wide)
        self.lo, self.hi, self.kth = side("lo", 1), side("hi", 0), side("kth", NONE)

    def reach(self, lower: np.ndarray, upper: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which anchors (rows) still need which boxes (columns)."""
        own = self.label[:, None]
        fit = np.where(self.same[:, None], (least <= own) & (own <= most), (least != own) | (most != own))
        open_ = np.zeros(fit.shape, dtype=bool)
        for j in range(self.lo.shape[1]):
            lo, hi = np.maximum(self.lo[:, j], self.kth[:, j])[:, None], self.hi[:, j][:, None]
            open_ |= (self.lo[:, j] <= self.hi[:, j])[:, None] & (upper >= lo) & (lower <= hi)
        return fit & open_


def _children(anchors: _Anchors, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray, best: bool) -> list[dict]:
    """Anchors with the children that they go to: all that can matter, or the one of the highest bound."""
    lower, upper = bounds(anchors.x, lo, hi)
    need = anchors.reach(lower, upper, least, most)
    if best:
        first = np.where(need, upper, -np.inf).argmax(1)
        pairs = [(i, first[i]) for i in np.flatnonzero(need.any(1))]
        return [{**anchors.rows[i], "node": int(nodes[c]), "bound": float(upper[i, c])} for i, c in pairs]
    return [{**anchors.rows[i], "node": int(nodes[c]), "bound": 0.0} for i, c in zip(*np.nonzero(need))]


_FRONTIER = {**_ANCHOR, "node": "long", "bound": "double"}


def _arrow(kinds: dict[str, str]) -> pa.Schema:
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(k, plain[v]) for k, v in kinds.items()])


def _emit(rows: list[dict], kinds: dict[str, str], most: int = 8192) -> Iterator[pa.RecordBatch]:
    schema = _arrow(kinds)
    for i in range(0, len(rows), most):
        yield pa.RecordBatch.from_pylist(rows[i : i + most], schema=schema)


def _met(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each node and block of the anchors that reach it."""
    sizes = frontier.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    salted = frontier.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))
    anchors = salted.groupBy("node", "block").agg(F.collect_list(F.struct(*_ANCHOR)).alias("anchors"))
    return anchors.drop("block").join(nodes, "node")


def descend(anchors: DataFrame, tree: Tree, best: bool = False) -> DataFrame:
    """Pairs of anchors and pages: all that the bounds leave, or one page for each anchor."""
    dims, top = tree.dims, tree.top
    nodes = np.array([t[0] for t in top], dtype=np.int64)
    lo, hi = (np.frombuffer(b"".join(t[i] for t in top), dtype=_I4).reshape(-1, dims) for i in (1, 2))
    least, most = (np.array([t[i] for t in top], dtype=np.int64) for i in (3, 4))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held = _Anchors(batch.slice(at, BLOCK).to_pylist(), dims)
                yield from _emit(_children(held, nodes, lo, hi, least, most, best), _FRONTIER)
        give_back()

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                children = np.frombuffer(row["children"], dtype=_I8)
                box = [np.frombuffer(row[c], dtype=_I4).reshape(-1, dims) for c in ("child_lo", "child_hi")]
                span = [np.frombuffer(row[c], dtype=_I4).astype(np.int64) for c in ("child_least", "child_most")]
                yield from _emit(_children(_Anchors(row["anchors"], dims), children, *box, *span, best), _FRONTIER)
        give_back()

    frontier = anchors.mapInArrow(start, _schema(**_FRONTIER))
    for level in reversed(tree.levels):
        met = _met(stored(frontier, "frontier"), level.select("node", "children", "child_lo", "child_hi", "child_least", "child_most"))
        frontier = met.mapInArrow(deeper, _schema(**_FRONTIER))
    return stored(frontier, "frontier")


def search_page(anchors: _Anchors, page: dict, k: int) -> list[dict]:
    """The k best rows of a page for each anchor and window, leaves in the order of their highest bound."""
    dims = anchors.x.shape[1]
    rows, ids = (np.frombuffer(page[c], dtype=_I8) for c in ("rows", "ids"))
    known = np.frombuffer(page["known"], dtype=np.uint8)
    x, lo, hi = (np.frombuffer(page[c], dtype=_I4).reshape(-1, dims) for c in ("vectors", "leaf_lo", "leaf_hi"))
    ends, labels = np.frombuffer(page["leaf_ends"], dtype=_I4), np.frombuffer(page["leaf_labels"], dtype=_I4).astype(np.int64)
    lower, upper = bounds(anchors.x, lo, hi)
    left, right = exact(anchors.x, x)
    kth = anchors.kth = anchors.kth.copy()
    found: dict[tuple[int, int], list[tuple]] = {}
    queue = [(-float(upper[:, leaf].max()), leaf) for leaf in range(len(ends))]
    heapq.heapify(queue)
    while queue:
        leaf = heapq.heappop(queue)[1]
        need = np.flatnonzero(anchors.reach(lower[:, [leaf]], upper[:, [leaf]], labels[[leaf]], labels[[leaf]])[:, 0])
        if not len(need):
            continue
        start, end = (ends[leaf - 1] if leaf else 0), ends[leaf]
        scores = left[need] @ right[start:end].T
        own = rows[start:end] == anchors.a[need][:, None]
        for j in range(kth.shape[1]):
            within = (scores >= np.maximum(anchors.lo[need, j], kth[need, j])[:, None]) & (scores <= anchors.hi[need, j][:, None]) & ~own
            if end - start > k:
                # No more than the k best of the leaf, and those that tie with them.
                nth = np.partition(np.where(within, scores, -np.inf if scores.dtype.kind == "f" else NONE), end - start - k, axis=1)[:, [end - start - k]]
                within &= scores >= nth
            for i in np.flatnonzero(within.any(1)):
                at = np.flatnonzero(within[i])
                near = [(-int(s), 1 - int(known[start + c]), int(ids[start + c])) for s, c in zip(scores[i, at], at)]
                best = found[need[i], j] = sorted(found.get((need[i], j), []) + near)[:k]
                if len(best) == k:
                    kth[need[i], j] = max(kth[need[i], j], -best[-1][0])
    return [
        {"a": int(anchors.a[i]), "window": j, "score": -s, "id": None if unknown else at}
        for (i, j), best in found.items() for s, unknown, at in best
    ]


def search(anchors: DataFrame, tree: Tree, k: int) -> DataFrame:
    """(a, window, rank, score, id): the k best rows of each window, by score, then the smaller id, null ids last."""
    dims, kinds = tree.dims, dict(a="long", window="int", score="long", id="long")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield from _emit(search_page(_Anchors(row["anchors"], dims), row, k), kinds)
        give_back()

    def wave(open_: DataFrame, best: bool) -> DataFrame:
        met = _met(descend(open_, tree, best), tree.pages.drop("lo", "hi", "least", "most"))
        met = met.mapInArrow(evaluate, _schema(**kinds))
        place = F.row_number().over(Window.partitionBy("a", "window").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        return met.withColumn("rank", place).filter(F.col("rank") <= k)

    seeds = wave(anchors, True).filter(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("seen"))
    windows = F.transform("lo", lambda _, j: F.coalesce(F.try_element_at("seen", j), F.lit(NONE)))
    open_ = stored(anchors.join(seeds, "a", "left").select(*(windows.alias("kth") if c == "kth" else c for c in _ANCHOR)), "anchors")
    return wave(open_, False)


def spread(rows: DataFrame, dims: int) -> list[int]:
    """Coordinates by falling variance; only sums for each coordinate are collected."""
    kinds = dict(at="int", n="long", s="double", q="double")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * PAGE):
                x = _vectors(batch.column(0).slice(at, 4 * PAGE), dims).astype(np.float64)
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield from _emit([{"at": i, "n": n, "s": float(s[i]), "q": float(q[i])} for i in range(dims)] if n else [], kinds)

    sums = rows.select("vector").mapInArrow(partial, _schema(**kinds)).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    return [r["at"] for r in sorted(sums, key=lambda r: (-(r["q"] - r["s"] ** 2 / r["n"]), r["at"]))]


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, base: int = 100,
) -> DataFrame:
    """Hard negatives of every row for which ``anchors`` holds.

    ``vector_col`` holds integer arrays; the score of two rows is their inner
    product. An anchor's positives are the ``positives`` other rows of its label
    with the highest scores. For each, the ``negatives`` rows of other labels with
    the highest score among low * p <= base * score <= high * p (0 <= low < high, p the positive's
    score) are returned, ties by the smaller id, null ids last: (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label, a null vector or a null component take no part.
    Repeated rows are rows of their own: positives of each other, and anchors
    each. Shorter vectors end in zeros; components beyond ``LIMIT`` count as
    ``LIMIT``; more than ``DIMS`` dimensions are refused. A positive below 0 has no window.
    Further columns are left out; an empty table gives no row.
    """
    held = df.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(F.coalesce(F.col(vector_col), F.array()), lambda x: x.isNull()))
    inside = F.transform(vector_col, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x)).cast("int"))
    rows = held.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), inside.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor")
    )
    rows = stored(rows, "rows")
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if dims is None:
        return rows.select(*(F.lit(None).cast("int" if n == "rank" else "long").alias(n) for n in names)).limit(0)
    if dims > DIMS:
        raise ValueError(f"vectors of {dims} dimensions, at most {DIMS} are supported")
    # Vectors of no component are taken as one zero, so that boxes have a side.
    dims = max(1, dims)
    tree = Tree(rows.select("row", "id", "label", "vector"), dims, spread(rows, dims))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(3), dims)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v.tobytes() for v in x], pa.binary())], names=["a", "id", "label", "vector"])

    asked = rows.filter("anchor").select("row", "id", "label", "vector").mapInArrow(coded, _schema(a="long", id="long", label="int", vector="binary"))
    asked = stored(asked, "asked")
    whole = [F.array(F.lit(v)).cast("array<bigint>").alias(n) for n, v in (("lo", -(1 << 62)), ("hi", 1 << 62), ("kth", NONE))]
    near = search(asked.select("a", "label", "vector", F.lit(True).alias("same"), *whole), tree, positives)
    near = stored(near.select("a", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    floor = F.expr(f"({low} * positive_score + {base - 1}) div {base}").alias("lo")
    window = F.sort_array(F.collect_list(F.struct("rank", floor, F.expr(f"({high} * positive_score) div {base}").alias("hi"))))
    windows = near.filter("positive_score >= 0").groupBy("a").agg(window.alias("w"))
    sides = [F.transform("w", lambda w: w["lo"]).alias("lo"), F.transform("w", lambda w: w["hi"]).alias("hi"), F.transform("w", lambda w: F.lit(NONE)).alias("kth")]
    open_ = asked.join(windows, "a").select("a", "label", "vector", F.lit(False).alias("same"), *sides)
    # Positives below 0 come last, so windows are numbered as ranks, from 0.
    found = search(stored(open_, "anchors"), tree, negatives).select("a", (F.col("window") + 1).alias("at"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.withColumnRenamed("rank", "at").join(asked.select("a", F.col("id").alias("anchor_id")), "a")
    return found.join(near, ["a", "at"]).select(*names)
