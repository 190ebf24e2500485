"""Ids of repeated text segments, worked out once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gathered(order: np.ndarray, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the segments numbered in ``order``, one after another."""
    n = sizes[order]
    shift = np.repeat(starts[order] - (np.cumsum(n) - n), n)
    return ids[shift + np.arange(len(shift))]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def texts_of(values: pa.Array) -> list[str]:
    """The texts of an Arrow array without nulls; to_pylist() takes ten times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


def parted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at spaces: the number of each part, where each text's parts begin (and the end), and the distinct parts by number."""
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    parts = cut.values.dictionary_encode()
    return parts.indices.to_numpy(), cut.offsets.to_numpy(), texts_of(parts.dictionary)


class Memo:
    """Ids by segment. Segments that a block is the first to bring are encoded together.

    It forgets everything before a block once it holds ``limit`` segments, so its
    size is bounded by that and the segments of one block.
    """

    LIMIT = 100_000

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int | None = None) -> None:
        self.encode, self.limit = encode, self.LIMIT if limit is None else limit
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.ids = np.zeros(0, dtype=np.uint32)
        self.sizes = np.zeros(0, dtype=np.int64)

    def block(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """Ids of each text, given as a list of segments."""
        self.begin()
        return self.found([self.numbered(segments) for segments in texts])

    def begin(self) -> None:
        """Begin a block; numbers given before may be forgotten."""
        if len(self.numbers) > self.limit:
            self.clear()

    def numbered(self, segments: list[str]) -> np.ndarray:
        """The numbers of segments, new ones included."""
        return np.fromiter(map(self.numbers.__getitem__, segments), dtype=np.int64, count=len(segments))

    def found(self, orders: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of each text of a block, given as the numbers of its segments."""
        known = len(self.sizes)
        if len(self.numbers) > known:
            fresh = list(self.numbers)[known:]
            ids, sizes = self.encode(fresh)
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        starts = np.cumsum(self.sizes) - self.sizes
        return [gathered(order, self.ids, self.sizes, starts) for order in orders]
