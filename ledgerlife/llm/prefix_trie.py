"""Prefix trie of conversations by van Emde Boas recursion.

A sequence is cut at half its depth. The cut prefixes are named, the distinct
ones stand as sequences of the upper trie, and what follows them makes the lower
forests, one under each name. Upper trie and forests are cut again, all of one
size in the same Spark job, until no depth is left between two cuts: as many
jobs as the depth has binary digits, however many sequences there are. Totals
of the lower forests are then grafted on the cut nodes above them, the largest
cuts first.

A job at level k works on parts of 2^(k+1) depths that start at a multiple of
that. ``blocks`` names every aligned run of 2^k turns from its two halves, so a
cut prefix is named by two names: that of the part's root and that of the block
behind it. Names are 128-bit digests. A prefix that many sequences share goes on
upwards as one sequence, that of the smallest member, so a hot prefix costs one
row a depth; every other row is keyed by (conversation, depth), which no hot
value can crowd.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import give_back, stored

ROOT = b"root"
#: Bytes of joined ids that are handed on as one row when ends are hashed.
CHUNK = 1 << 16


def digest(*parts: Column) -> Column:
    """128 bits that name a sequence of byte strings."""
    return F.unhex(F.md5(F.concat(*parts)))


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, token, chars) with ``pos``, their place in the conversation from 0.

    Order is by turn, null first, then token; rows that agree in both are
    alike. Rows are sorted over all tasks, a conversation as long as the table
    too: places are counted within each task, and the counts of the tasks
    before it are added.
    """
    # The number of the row within its file decides between equal rows, so that no key is too large for a range.
    kept = stored(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "token", "row"]
    ordered = kept.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.select("conv_id", "token", "chars", F.monotonically_increasing_id().alias("at")), "ordered").withColumn("part", F.shiftright("at", 33))
    pieces = ordered.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return stored(ordered.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "token", "chars"), "numbered")


def conversation_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, token, chars) of each row of conversations.

    Null role or text is the empty text; rows without conv_id belong to no
    conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    return df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), token.alias("token"), F.char_length(text).cast("long").alias("chars")
    )


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one.

    A conversation c takes the first h turns of conversation c - c % ``every``
    (as many as there are), h = crc32(decimal c) % ``most``, and goes on with its
    own turns after its first h. ``turns`` come from ``numbered``. Returns
    (conv_id, length) of every conversation, and (conv_id, pos, token, chars).
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = lengths.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor"))
    donors = lengths.select(F.col("conv_id").alias("donor"), F.col("n").alias("held"))
    convs = convs.join(donors, "donor", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    convs = stored(convs.select("conv_id", "donor", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "token", "chars")
    given = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "donor")
    given = given.join(convs.filter("taken > 0").select("conv_id", "donor", "taken"), "donor").filter("pos < taken")
    given = given.select("conv_id", "pos", "token", "chars")
    return convs.select("conv_id", "length"), stored(own.unionByName(given), "rebuilt")


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k the complete aligned runs of 2^k turns: (conv_id, block, name, chars, tail).

    ``chars`` is the sum over the run, ``tail`` that of its last turn.
    """
    made = [turns.select("conv_id", F.col("pos").alias("block"), F.col("token").alias("name"), "chars", F.col("chars").alias("tail"))]
    for k in range(1, levels):
        right = F.col("block") % 2 == 1
        halves = made[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~right, F.col("name"))).alias("a"), F.max(F.when(right, F.col("name"))).alias("b"), F.sum("chars").alias("chars"), F.max(F.when(right, F.col("tail"))).alias("tail")
        )
        halves = halves.filter("b is not null").select("conv_id", "block", digest(F.col("a"), F.col("b")).alias("name"), "chars", "tail")
        made.append(stored(halves, f"blocks{k}"))
    return made


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations: the nodes of their trie.

    ``convs`` has (conv_id, length), every conversation once, of any length;
    ``turns`` has (conv_id, pos, token, chars) for each pos below the length. Rows: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. No conversations, no node.
    """
    deepest = convs.agg(F.max("length")).first()[0]
    if deepest is None:
        return _none(convs)
    levels = max(1, int(deepest).bit_length())
    made = blocks(turns, levels)

    # A sequence: its conversation, where it starts, the last depth that is still to be named, and its root's name.
    # ``whole`` tells a conversation's own end from a cut prefix that goes on as the smallest member's sequence.
    first = convs.select("conv_id", F.lit(0).cast("long").alias("start"), F.col("length").alias("last"), F.lit(True).alias("whole"), F.lit(ROOT).alias("root"), F.lit(0).cast("long").alias("before"))
    open_, cuts = [first], {}
    for k in range(levels - 1, -1, -1):
        size = 1 << k
        rest = F.col("last") - F.col("start")
        due = _union([s.filter((rest >= size) & (rest < 2 * size)) for s in open_])
        at = made[k].withColumnRenamed("block", "at")
        named = due.withColumn("at", F.shiftright("start", k)).join(at, ["conv_id", "at"])
        named = named.select(
            "conv_id", (F.col("start") + size).alias("depth"), "last", "whole", "before", digest(F.col("root"), F.col("name")).alias("name"),
            F.col("root").alias("above"), (F.col("before") + F.col("chars")).alias("chars"), "tail",
        )
        named = stored(named, f"named{k}")
        # All but the smallest member agree within a name.
        nodes = named.groupBy("name").agg(F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in ("depth", "above", "before", "chars", "tail")))
        nodes = stored(nodes, f"nodes{k}")
        cuts[k] = (named, nodes)
        lower = named.select("conv_id", F.col("depth").alias("start"), "last", "whole", F.col("name").alias("root"), F.col("chars").alias("before"))
        upper = nodes.select("conv_id", (F.col("depth") - size).alias("start"), (F.col("depth") - 1).alias("last"), F.lit(False).alias("whole"), F.col("above").alias("root"), "before")
        open_ += [lower, upper]

    closed = _union([s.filter("last = start") for s in open_])
    ends = stored(closed.filter("whole").select("conv_id", F.col("root").alias("name"), F.col("before").alias("path")), "ends")
    links = stored(closed.filter("not whole").select("conv_id", (F.col("start") + 1).alias("depth"), F.col("root").alias("parent")), "links")
    top = convs.agg(F.min("conv_id").alias("conv_id")).select(F.lit(ROOT).alias("name"), "conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "tail")))
    nodes = _union([top] + [n.select("name", "conv_id", "depth", "chars", "tail") for _, n in cuts.values()])
    facts = ends.select("name", F.lit(1).alias("e"), "path", F.lit(0).alias("c"), F.col("conv_id").alias("lone"))
    facts = facts.unionByName(links.select(F.col("parent").alias("name"), F.lit(0).alias("e"), F.lit(0).cast("long").alias("path"), F.lit(1).alias("c"), F.lit(None).cast("long").alias("lone")))
    facts = facts.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("e", "path", "c")), F.min("lone").alias("lone"))
    nodes = nodes.join(facts, "name", "left").na.fill(0, ["e", "path", "c"]).withColumn("leaf", (F.col("c") == 0).cast("long"))
    nodes = stored(nodes, "trie")

    sums = grafted(nodes, {k: named for k, (named, _) in cuts.items()})
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hashes = end_hashes(ends.join(nodes.filter("e > 1").select("name"), "name", "left_semi"))
    out = sums.join(nodes.select("name", "chars", "tail", "c", "e", "lone"), "name").join(hashes, "name", "left")
    out = out.join(links.join(parents, "parent").select("conv_id", "depth", "parent_conv_id"), ["conv_id", "depth"], "left")
    alone = F.sha2(F.when(F.col("e") == 0, F.lit("")).otherwise(F.col("lone").cast("string")).cast("binary"), 256)
    # Over a subtree: chars of all members behind the node's own start, less those of one copy.
    saved = F.col("path_sum") - F.col("n") * (F.col("chars") - F.col("tail")) - F.col("tail_sum")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("c").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("sha", alone).alias("ends_sha256"),
    )


def grafted(nodes: DataFrame, named: dict[int, DataFrame]) -> DataFrame:
    """Sums over each node's subtree: (name, conv_id, depth, n, path_sum, leaves, tail_sum).

    The nodes of a lower forest, and the totals of the cuts that end it, go to the cut
    node above them: at level k those whose depth - 1 has the bit k. They are summed
    for each conversation first, which needs no more than its own rows, then for each name.
    """
    values = ["n", "path_sum", "leaves", "tail_sum"]
    own = nodes.select("name", "conv_id", "depth", F.col("e").alias("n"), F.col("path").alias("path_sum"), F.col("leaf").alias("leaves"), F.col("tail").alias("tail_sum"))
    totals = {}
    for k in sorted(named, reverse=True):
        size = 1 << k
        within = F.col("depth") % (2 * size)
        inner = own.filter(within > size)
        given = _union([inner] + [t for t in totals.values()]).select("conv_id", (F.shiftleft(F.shiftright(F.col("depth") - 1, k + 1), k + 1) + size).alias("depth"), *values)
        given = given.groupBy("conv_id", "depth").agg(*(F.sum(v).alias(v) for v in values))
        given = given.join(named[k].select("conv_id", "depth", "name"), ["conv_id", "depth"])
        given = given.select("name", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), *values)
        both = own.filter(within == size).unionByName(given)
        totals[k] = stored(both.groupBy("name").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(v).alias(v) for v in values)), f"totals{k}")
    root = own.agg(F.min("conv_id").alias("conv_id"), *(F.sum(v).alias(v) for v in values))
    return _union([root.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), *values), *totals.values()])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(name, sha): SHA-256 of the conv_ids of each name, ascending, joined by commas.

    Rows are sorted over all tasks and joined there to chunks; only chunks come together by name,
    where they stream through the hash, as its next state depends on the one before.
    """
    chunks = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("data", T.BinaryType())])
    hashed = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("sha", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, held, size = None, None, [], 0

        def out():
            return pa.RecordBatch.from_pylist([{"name": name, "first": first, "data": ",".join(held).encode()}], schema=pa.schema([("name", pa.binary()), ("first", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (at != name or size >= CHUNK):
                    yield out()
                    held, size = [], 0
                if not held:
                    name, first = at, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield out()
        give_back()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        schema = pa.schema([("name", pa.binary()), ("sha", pa.string())])
        for batch in batches:
            done = []
            for at, data in zip(batch.column(0), batch.column(2)):
                at = at.as_py()
                if at != name:
                    if state is not None:
                        done.append({"name": name, "sha": state.hexdigest()})
                    name, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(data.as_buffer())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"name": name, "sha": state.hexdigest()}], schema=schema)
        give_back()

    ordered = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    joined = stored(ordered.mapInArrow(join, chunks), "chunks")
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInArrow(finish, hashed)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _none(convs: DataFrame) -> DataFrame:
    kinds = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
    return convs.limit(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))


def prefix_trie(df: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, from rows (conv_id, turn, role, text).

    Order is by turn, null first; rows of one turn are ordered by the digest of
    (role, text), so that reruns agree. Repeated rows are turns of their own.
    Null roles and texts are empty texts, rows without conv_id take no part,
    further columns are left out. An empty table has no node, not even a root.
    """
    return trie(*rebuilt(numbered(conversation_turns(df))))
