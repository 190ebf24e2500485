"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A worker takes its documents in blocks. The distinct pieces that a block is
the first to bring are laid out one after another.
An inverted index leads from a merge rank (the rank of the token pair's joined
bytes) to the positions where such a pair stands. Ranks are taken in ascending
order; each is applied at all its positions, for every piece of the block, and
only the two neighbours of a merged pair get new index entries. Blocks have a
fixed number of bytes (BLOCK), so nothing is shuffled, memory is bounded, and
a lost task repeats its own blocks only.

Null and empty texts give no ids; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlife.llm.common import mapped
from ledgerlife.llm.vocab_memo import Memo, Numbers, gathered, parted

# Letters and numbers that Unicode assigned after version 16, whose classes the
# rank files' library knows. They are neither letter nor number there.
LATER = (
    r"[՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)


#: Bytes of text in a block.
BLOCK = 4_000_000
#: Segments of text that a worker remembers.
SEGMENTS = 400_000


class Vocabulary:
    """Ranks of a rank file, the pattern that cuts texts into pieces, and pair ranks looked up so far."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        first = [[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.first = np.array(first, dtype=np.int64).ravel()
        self.known: dict[int, int] = {}
        self.pieces = regex.compile(pattern).findall
        self.later = regex.compile(LATER).search
        older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}--{LATER}][\p{{N}}--{LATER}]]")
        older = regex.sub(r"(?<!\[)\\p\{([LN])\}(?=\+)", lambda m: rf"[\p{{{m[1]}}}--{LATER}]", older)
        self.older_pieces = regex.compile("(?V1)" + older).findall

    def split(self, text: str) -> list[str]:
        return (self.pieces if text.isascii() or not self.later(text) else self.older_pieces)(text)

    def pair(self, a: int, b: int) -> int:
        """Rank of the joined bytes of two tokens, -1 if they make no token."""
        key = a << 20 | b
        rank = self.known.get(key)
        if rank is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            rank = self.known[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def replay(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after another, and the number of ids of each piece."""
    # A piece that is a token itself stays whole, as the library has it.
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
    starts = ends - np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    size = len(raw)
    token = vocab.single[raw]
    following = np.arange(1, size + 1)
    following[ends - 1] = -1
    before = np.arange(-1, size - 1)
    before[starts] = -1
    whole = np.fromiter((vocab.ranks.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
    done = np.repeat(whole >= 0, ends - starts)

    # The index at the start: rank -> positions, from a stable sort of all byte pairs that have a rank.
    rank = np.full(size, -1, dtype=np.int64)
    rank[:-1] = vocab.first[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    rank[(following < 0) | done] = -1
    held = np.flatnonzero(rank >= 0)
    held = held[np.argsort(rank[held], kind="stable")]
    bounds = np.flatnonzero(np.diff(rank[held], prepend=-1))
    index = {int(rank[part[0]]): part.tolist() for part in np.split(held, bounds[1:])} if len(held) else {}

    # Of each live position: its token, the next and the previous position, and the rank of the pair that stands there (-1: none).
    tok, nxt, prv, now = (array("q", a.tobytes()) for a in (token, following, before, rank))
    del raw, token, following, before, rank
    pair, known = vocab.pair, vocab.known
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        positions = index.pop(r, None)
        if positions is None:
            continue
        positions.sort()
        closed = -1  # positions before it wait, as their piece has got a pair to be merged first
        for p in positions:
            if now[p] != r:
                continue
            if p < closed:
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(p)
                continue
            q = nxt[p]
            tok[p], tok[q], now[q] = r, -1, -1
            n = nxt[p] = nxt[q]
            least = up = -1
            if n >= 0:
                prv[n] = p
                c = tok[n]
                up = known.get(r << 20 | c)
                if up is None:
                    up = pair(r, c)
                if up >= 0:
                    least = up
                    if up in index:
                        index[up].append(p)
                    else:
                        index[up] = [p]
                        heapq.heappush(heap, up)
            now[p] = up
            l = prv[p]
            if l >= 0:
                c = tok[l]
                up = known.get(c << 20 | r)
                if up is None:
                    up = pair(c, r)
                now[l] = up
                if up >= 0:
                    if least < 0 or up < least:
                        least = up
                    if up in index:
                        index[up].append(l)
                    else:
                        index[up] = [l]
                        heapq.heappush(heap, up)
            if 0 <= least <= r:
                closed = int(ends[np.searchsorted(ends, p, side="right")])
    out = np.array(tok, dtype=np.int64) if size else np.zeros(0, dtype=np.int64)
    live = (out >= 0) & ~done
    first = starts[whole >= 0]
    out[first], live[first] = whole[whole >= 0], True
    running = np.concatenate(([0], np.cumsum(live)))
    return out[live].astype(np.uint32), running[ends] - running[starts]


def encode_segments(fresh: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments one after another, and the number of ids of each, from one replay over their distinct pieces."""
    pieces = Numbers()
    orders = [[pieces[p] for p in vocab.split(s)] for s in fresh]
    if not pieces:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(fresh), dtype=np.int64)
    ids, sizes = replay([p.encode("utf-8") for p in pieces], vocab)
    flat = np.array([n for order in orders for n in order], dtype=np.int64)
    of = np.repeat(np.arange(len(fresh)), [len(order) for order in orders])
    return gathered(flat, ids, sizes, np.cumsum(sizes) - sizes), np.bincount(of, sizes[flat], len(fresh)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def memo(path: str, pattern: str) -> Memo:
    return Memo(lambda fresh: encode_segments(fresh, vocabulary(path, pattern)), SEGMENTS)


def encode_block(texts: Iterable[str | None], path: str, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    A text is cut before each space: pieces never reach over such a cut where no two spaces stand together.
    """
    split, held = vocabulary(path, pattern).split, memo(path, pattern)
    held.begin()
    texts = [t or "" for t in texts]
    plain = [i for i, t in enumerate(texts) if "  " not in t]
    parts, bounds, distinct = parted([texts[i] for i in plain])
    # Every part but a text's first follows a space, which belongs to it.
    first = np.zeros(len(parts), dtype=bool)
    first[bounds[:-1]] = True
    order = np.empty(len(parts), dtype=np.int64)
    for own, space in ((first, ""), (~first, " ")):
        number = np.full(len(distinct), -1, dtype=np.int64)
        number[parts[own]] = 0
        used = np.flatnonzero(number == 0)
        number[used] = held.numbered([space + distinct[n] for n in used.tolist()])
        order[own] = number[parts[own]]
    orders: list = [None] * len(texts)
    for i, a, b in zip(plain, bounds[:-1], bounds[1:]):
        orders[i] = order[a:b]
    orders = [held.numbered(split(t)) if o is None else o for t, o in zip(texts, orders)]
    return [ids.astype("<u4").tobytes() for ids in held.found(orders)]


def decode_ids(ids: bytes | None, token: list[bytes]) -> bytes:
    """The bytes that little-endian unsigned 32-bit ids stand for."""
    return b"".join(map(token.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Add the ids of each whole text as a binary column of little-endian unsigned 32-bit integers.

    ``path`` is a rank file that every executor can read and ``pattern`` cuts
    texts into pieces, which are encoded separately, without special tokens.
    With ``decoded`` the ids are decoded again in the same pass into a column of
    that name, as by decode(). A null or empty text has empty ids. Columns of
    the names that are added are replaced.
    """

    def make(texts: list) -> list:
        ids = encode_block(texts, path, pattern)
        return [ids] if decoded is None else [ids, [decode_ids(i, vocabulary(path, pattern).token) for i in ids]]

    return mapped(df, text_col, [T.StructField(n, T.BinaryType()) for n in (into, decoded) if n is not None], make, most=BLOCK)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of a binary column stand for; null ids give empty bytes."""

    def make(rows: list) -> list:
        token = vocabulary(path, pattern).token
        return [[decode_ids(ids, token) for ids in rows]]

    return mapped(df, ids_col, [T.StructField(into, T.BinaryType())], make)
