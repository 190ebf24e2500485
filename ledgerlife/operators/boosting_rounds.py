"""Rounds of boosting on rows that stay in the memory of their tasks.

The rows are dealt over as many tasks as run at once (one where they are few). Each keeps bins and scores of its rows
through many rounds; of a level of all trees of a round, tasks exchange only the sums of (class, node, feature, bin) over
Spark's barrier, and each finds the same best splits from them. Only the trees reach the driver.

Gradients are rounded to whole multiples of a power of two, small enough that sums of all rows are exact in 53 bits. So
sums, and with them the trees, don't depend on how rows are dealt, and equal gains are equal.
"""

from __future__ import annotations

import base64
import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Cells of a histogram's rows that are summed at a time.
BLOCK = 1_000_000
TREES = "turn int, k int, node binary, feature binary, bin binary, value binary"

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def xxhash(ids: np.ndarray, *numbers: int) -> np.ndarray:
    """Spark's ``xxhash64`` of a long column and literals, as signed longs."""
    found = np.full(len(ids), 42, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in (ids.astype(np.int64).view(np.uint64), *numbers):
            if isinstance(part, int) and -(2**31) <= part < 2**31:
                found = (found + _P5 + np.uint64(4)) ^ (np.uint64(part & 0xFFFFFFFF) * _P1)
                found = _mixed(_turned(found, 23) * _P2 + _P3)
            else:
                part = np.uint64(part & 0xFFFFFFFFFFFFFFFF) if isinstance(part, int) else part
                found = (found + _P5 + np.uint64(8)) ^ (_turned(np.atleast_1d(part) * _P2, 31) * _P1)
                found = _mixed(_turned(found, 27) * _P1 + _P4)
    return found.view(np.int64)


def drawn_columns(s, d: int, turn: int) -> list[int]:
    """The features that the trees of a round may use."""
    draw = random.Random(s.seed * 1_000_003 + turn)
    return sorted(draw.sample(range(d), max(1, round(s.column_share * d)))) if s.column_share < 1 else list(range(d))


def drawn_rows(s, ids: np.ndarray, turn: int) -> np.ndarray:
    """Which rows the trees of a round are grown from."""
    if s.row_share >= 1:
        return np.ones(len(ids), dtype=bool)
    return np.mod(xxhash(ids, s.seed, turn), 1_000_000) < int(s.row_share * 1_000_000)


def gradients(scores: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, a row for each score: a logistic one for two classes, else softmax.

    Second derivatives of the softmax are scaled by classes / (classes - 1).
    """
    if classes == 2:
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-scores))
        return p - y, p * (1.0 - p)
    p = np.exp(scores - scores.max(axis=0))
    p /= p.sum(axis=0)
    h = classes / (classes - 1) * p * (1.0 - p)
    for k in range(classes):
        p[k] -= y == k
    return p, h


def _strength(g, h, s):
    """Twice the loss that the best value of a leaf takes away."""
    shrunk = np.maximum(np.abs(g) - s.lambda_l1, 0.0) if s.lambda_l1 else g
    under = h + s.lambda_l2
    return np.divide(shrunk * shrunk, under, out=np.zeros_like(under), where=under != 0)


class Rows:
    """Rows of one task: bins by feature, the cells beside a feature's usual bin, and scores."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, bins: np.ndarray, sizes: Sequence[int], usual: Sequence[int], start: Sequence[float]):
        self.ids, self.y, self.bins = ids, y, bins
        self.sizes, self.usual = list(sizes), list(usual)
        self.scores = np.repeat(np.array(start, dtype=float)[:, None], len(ids), axis=1)
        self.cells = []
        for f, column in enumerate(bins):
            rows = np.flatnonzero(column != usual[f])
            self.cells.append((rows.astype(np.int32), column[rows]))

    def stand(self, features: np.ndarray, cuts: np.ndarray, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes of rows one level on, for rows ``at`` at nodes that are split."""
        f = features[node]
        return 2 * node + 1 + (self.bins[f, at] > cuts[node])

    def add(self, k: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> None:
        """Add a whole tree to the scores."""
        node = np.zeros(len(self.ids), dtype=np.int64)
        for _ in range(depth):
            at = np.flatnonzero(feature[node] >= 0)
            if not len(at):
                break
            node[at] = self.stand(feature, cut, node[at], at)
        self.scores[k] += value[node]


def grown_round(rows: Rows, s, classes: int, turn: int, scale: float, shared: Callable[[np.ndarray], np.ndarray], prune: Callable) -> list:
    """One tree for each score; scores of all rows are moved on by them. ``shared`` sums arrays of whole numbers over tasks."""
    outputs, d = len(rows.scores), len(rows.sizes)
    columns = drawn_columns(s, d, turn)
    chosen = drawn_rows(s, rows.ids, turn)
    g, h = (np.rint(part * scale) for part in gradients(rows.scores, rows.y, classes))
    sizes = np.array([rows.sizes[f] for f in columns])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    width = int(sizes.sum())
    usual = firsts + [rows.usual[f] for f in columns]
    owner = np.repeat(np.arange(len(columns)), sizes)
    cells = []
    for i, f in enumerate(columns):
        at, own = rows.cells[f]
        kept = chosen[at]
        cells.append((at[kept], own[kept].astype(np.int32) + np.int32(firsts[i])))
    cell_rows, cell_codes = (np.concatenate(part) for part in zip(*cells))
    size = 2 ** (s.max_depth + 1) - 1
    feature, cut = np.full((outputs, size), -1), np.zeros((outputs, size), dtype=np.int64)
    node = np.zeros((outputs, len(rows.ids)), dtype=np.int16 if size < 2**15 else np.int32)
    splits: list[dict[int, tuple]] = [{} for _ in range(outputs)]
    roots = shared(np.array([part for k in range(outputs) for part in (g[k][chosen].sum(), h[k][chosen].sum(), chosen.sum())]))
    totals = {(k, 0): tuple(roots[3 * k : 3 * k + 3]) for k in range(outputs)}
    counted, parents, places = [(k, 0) for k in range(outputs)], None, {}
    for level in range(s.max_depth + 1):
        for (k, n), (tg, th, tn) in totals.items():
            splits[k][n] = (float(tg) / scale, float(th) / scale, int(tn), None, None, None)
        # Nodes too small for two children aren't searched; nor are siblings counted where neither is.
        least = (2 * max(1, s.min_child_samples), 2 * s.min_child_weight * scale)
        wanted = [kn for kn, (_, th, tn) in totals.items() if tn >= least[0] and th >= least[1]]
        open_ = {(k, (n - 1) // 2) for k, n in wanted}
        counted = [(k, n) for k, n in counted if (k, (n - 1) // 2) in open_]
        if level == s.max_depth or not wanted:
            break
        sums = np.zeros((len(counted), 3, width))
        for k in range(outputs):
            own = [(i, n) for i, (of, n) in enumerate(counted) if of == k]
            if not own:
                continue
            slot = np.full(size, -1, dtype=np.int64)
            low = own[0][0]
            slot[[n for _, n in own]] = np.arange(len(own))
            of_row = slot[node[k]]
            for begin in range(0, len(cell_rows), BLOCK):
                at = cell_rows[begin : begin + BLOCK]
                place = of_row[at]
                inside = np.flatnonzero(place >= 0)
                at, code = at[inside], place[inside] * width + cell_codes[begin : begin + BLOCK][inside]
                for i, weights in enumerate((g[k][at], h[k][at], None)):
                    sums[low : low + len(own), i] += np.bincount(code, weights, minlength=len(own) * width).reshape(len(own), width)
        sums = shared(sums).astype(np.int64)
        # Siblings of the counted nodes are their parents less them.
        found = np.empty((len(wanted), 3, width), dtype=np.int64)
        at_count = {kn: i for i, kn in enumerate(counted)}
        for i, (k, n) in enumerate(wanted):
            j = at_count.get((k, n))
            found[i] = sums[j] if j is not None else parents[places[k, (n - 1) // 2]] - sums[at_count[k, n + 1 if n % 2 else n - 1]]
        parents, places = found, {kn: i for i, kn in enumerate(wanted)}
        total = np.array([totals[kn] for kn in wanted], dtype=np.int64)
        whole = found.copy()
        whole[:, :, usual] = total[:, :, None] - np.add.reduceat(found, firsts, axis=2)
        run = np.cumsum(whole, axis=2)
        left = run - (run - whole)[:, :, firsts][:, :, owner]
        nl, nr = left[:, 2], total[:, 2, None] - left[:, 2]
        gl, hl = left[:, 0] / scale, left[:, 1] / scale
        gr, hr = (total[:, 0, None] - left[:, 0]) / scale, (total[:, 1, None] - left[:, 1]) / scale
        gain = _strength(gl, hl, s) + _strength(gr, hr, s) - _strength(total[:, 0] / scale, total[:, 1] / scale, s)[:, None]
        gain[(np.minimum(nl, nr) < max(1, s.min_child_samples)) | (np.minimum(hl, hr) < s.min_child_weight)] = -1.0
        best = gain.argmax(axis=1)
        counted, above, totals = [], totals, {}
        for i, (k, n) in enumerate(wanted):
            b = int(best[i])
            if not gain[i, b] > max(0.0, s.min_gain):
                continue
            own, own_cut = columns[owner[b]], b - int(firsts[owner[b]])
            splits[k][n] = (*splits[k][n][:3], own, own_cut, float(gain[i, b]))
            feature[k, n], cut[k, n] = own, own_cut
            part = tuple(int(v) for v in left[i, :, b])
            totals[k, 2 * n + 1] = part
            totals[k, 2 * n + 2] = tuple(int(v) - w for v, w in zip(above[k, n], part))
            counted.append((k, 2 * n + 1 + int(2 * part[2] > above[k, n][2])))
        counted.sort()
        for k in range(outputs):
            now = node[k].astype(np.int64)
            at = np.flatnonzero((now >= 2**level - 1) & (feature[k][now] >= 0))
            if len(at):
                node[k][at] = rows.stand(feature[k], cut[k], now[at], at)
    trees = [prune(own, s) for own in splits]
    for k, tree in enumerate(trees):
        end = np.arange(size)
        for n in range(1, size):  # rows below a leaf stand at it
            if tree.feature[(n - 1) // 2] < 0 or end[(n - 1) // 2] != (n - 1) // 2:
                end[n] = end[(n - 1) // 2]
        rows.scores[k] += np.array(tree.value)[end[node[k]]]
    return trees


def read(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], usual: Sequence[int], start: Sequence[float]) -> Rows:
    """Rows of a task from batches of (id, y, bins)."""
    d, kind = len(sizes), np.uint16 if max(sizes, default=0) <= 2**16 else np.int32
    ids, y, bins = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)], [np.empty((d, 0), dtype=kind)]
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        y.append(batch.column(1).to_numpy(zero_copy_only=False))
        bins.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind).T)
    return Rows(np.concatenate(ids), np.concatenate(y), np.concatenate(bins, axis=1), sizes, usual, start)


def summed_over_tasks(values: np.ndarray) -> np.ndarray:
    """Arrays of whole numbers added up over the tasks of a barrier stage; only places that aren't zero are sent."""
    from pyspark import BarrierTaskContext

    flat = values.ravel()
    at = np.flatnonzero(flat)
    told = base64.b64encode(np.int64(len(at)).tobytes() + at.tobytes() + flat[at].tobytes()).decode()
    out = np.zeros(len(flat))
    for message in BarrierTaskContext.get().allGather(told):
        held = base64.b64decode(message)
        n = int(np.frombuffer(held, dtype=np.int64, count=1)[0])
        out[np.frombuffer(held, dtype=np.int64, count=n, offset=8)] += np.frombuffer(held, dtype=float, count=n, offset=8 + 8 * n)
    return out.reshape(values.shape)


def packed(tree) -> tuple[bytes, bytes, bytes, bytes]:
    """The nodes of a tree that aren't blank: places, features, bins, values."""
    feature, value = np.array(tree.feature, dtype=np.int32), np.array(tree.value)
    at = np.flatnonzero((feature >= 0) | (value != 0)).astype(np.int32)
    return at.tobytes(), feature[at].tobytes(), np.array(tree.bin, dtype=np.int32)[at].tobytes(), value[at].tobytes()


def unpacked(node: bytes, feature: bytes, cut: bytes, value: bytes, size: int) -> tuple[list, list, list]:
    """Features, bins and values of all nodes from ``packed``."""
    out = [-1] * size, [0] * size, [0.0] * size
    for n, f, b, v in zip(*(np.frombuffer(part, dtype=kind).tolist() for part, kind in ((node, np.int32), (feature, np.int32), (cut, np.int32), (value, float)))):
        out[0][n], out[1][n], out[2][n] = f, b, v
    return out


def scale_for(rows: int) -> float:
    """The power of two that gradients are rounded to: sums of all rows stay below 2 ** 53."""
    return 2.0 ** (52 - max(1, math.ceil(math.log2(max(2, rows)))))


def played(s, classes: int, sizes: Sequence[int], usual: Sequence[int], start: Sequence[float], n: int, done: Sequence[tuple], turns: range, tasks: int, prune: Callable):
    """A function over the batches of a task: it adds the trees ``done`` to the scores, plays ``turns`` rounds, and gives their trees.

    Trees are those of all tasks; the first task gives them. It ends early at a round without a split, unless draws differ by round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = read(batches, sizes, usual, start)
        depth, size, scale = s.max_depth, 2 ** (s.max_depth + 1) - 1, scale_for(n)
        for _, k, *parts in done:
            feature, cut, value = unpacked(*parts, size)
            rows.add(k, np.array(feature), np.array(cut), np.array(value), depth)
        first = True
        shared = lambda values: values
        if tasks > 1:
            from pyspark import BarrierTaskContext

            first, shared = BarrierTaskContext.get().partitionId() == 0, summed_over_tasks
        for turn in turns:
            trees = grown_round(rows, s, classes, turn, scale, shared, prune)
            if first:
                told = [(turn, k, *packed(tree)) for k, tree in enumerate(trees)]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*told), kinds)], names=["turn", "k", "node", "feature", "bin", "value"])
            if s.row_share == 1 and s.column_share == 1 and all(tree.feature[0] < 0 for tree in trees):
                return

    return run
