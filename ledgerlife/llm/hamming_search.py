"""Exact nearest binary codes by incremental multi-index hashing.

Codes are cut into segments of 16 bits or less, and each distinct code is
indexed under every (segment, value). A query asks for all values within a
radius of its own in every segment; the radius grows by one a round. With m
segments and radius s every code within m * (s + 1) - 1 bits has been met
(otherwise each segment would differ in s + 1 bits), so a query ends as soon as
its k-th verified distance is no more than that. Later rounds only keep codes
that are no further than the k-th so far, as nothing else can matter.

Rows of one code are folded first: the index holds the code once with its k
smallest ids, and queries of one code are answered together. Values of a
segment that many codes share make large buckets, which are joined, not
gathered, so Spark splits them. The result is exact: ties in distance go to
the smaller id, and no candidate is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.llm.common import stored

WORD = 32


def sign_codes(df: DataFrame, vector: str, into: str = "code", dims: int | None = None) -> DataFrame:
    """Add the sign bits of a vector, WORD of them in each element of an array<bigint>; null for a null vector.

    A bit is 1 where the value is above 0; null and NaN give 0, and shorter
    vectors end in zeros. ``dims`` defaults to the longest vector.
    """
    if dims is None:
        dims = df.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    words = []
    for a in range(0, max(dims, 1), WORD):
        bits = [F.when(F.coalesce(F.get(vector, F.lit(i)) > 0, F.lit(False)) & ~F.isnan(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0))), F.lit(1 << (i - a))).otherwise(0) for i in range(a, min(a + WORD, max(dims, 1)))]
        words.append(sum((b.cast("long") for b in bits), F.lit(0).cast("long")))
    return df.withColumn(into, F.when(F.col(vector).isNotNull(), F.array(*words)))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _segments(code: Column, cuts: list[tuple[int, int]]) -> list[Column]:
    """Values of the bit ranges (start, length); none crosses a word."""
    return [F.shiftright(F.get(code, F.lit(start // WORD)), start % WORD).bitwiseAND(F.lit((1 << n) - 1)) for start, n in cuts]


def cuts_for(bits: int, most: int = 16) -> list[tuple[int, int]]:
    """Segments of nearly equal length within each word, of ``most`` bits at most."""
    out = []
    for a in range(0, bits, WORD):
        n = min(WORD, bits - a)
        pieces = max(1, math.ceil(n / most))
        edges = [a + n * i // pieces for i in range(pieces + 1)]
        out += [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    return out


def top_k(rows: DataFrame, queries: DataFrame, bits: int, k: int = 10, segment_bits: int = 16) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest rows of each query, itself included if it is a row.

    Both inputs have (id, code); codes have ``bits`` bits in words of WORD.
    Segments of ``segment_bits``, best near log2 of the number of distinct
    codes, change the work and not the result.
    Rows and queries without id or code take no part. Repeated rows are
    neighbours of their own, in the order of their ids. Where fewer than k
    rows exist, all are returned.
    """
    rows, queries = (t.select("id", "code").filter("id is not null and code is not null") for t in (rows, queries))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = rows.withColumn("n", nth).filter(F.col("n") <= k)
    index = stored(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")  # k ids at most each
    asked = stored(queries.select("code").distinct(), "asked")
    enough = min(k, index.agg(F.sum(F.size("ids"))).first()[0] or 0)
    cuts = cuts_for(bits, segment_bits)
    m = len(cuts)

    def entries(table: DataFrame, code: str) -> DataFrame:
        values = [F.struct(F.lit(i).alias("segment"), v.alias("value"), F.lit(n).alias("length")) for i, (v, (_, n)) in enumerate(zip(_segments(F.col(code), cuts), cuts))]
        return table.select("*", F.explode(F.array(*values)).alias("_e")).select("*", "_e.*").drop("_e")

    inverted = entries(index.select(F.col("code").alias("found"), F.size("ids").alias("n_ids")), "found").drop("length")
    open_ = asked.select("code", F.lit(bits).alias("bound"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, best = [], None
    for s in range(max(n for _, n in cuts) + 1):
        if open_.isEmpty():
            break
        lengths = sorted({n for _, n in cuts})
        masks = F.coalesce(*(F.when(F.col("length") == n, F.expr(f"filter(sequence(0L, {(1 << n) - 1}L), x -> bit_count(x) = {s})")) for n in lengths)) if s else F.array(F.lit(0).cast("long"))
        spread = open_.repartition(parts, "code")
        probes = entries(spread, "code").select("code", "bound", "segment", "value", F.explode(masks).alias("mask"))
        probes = probes.select("code", "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        far = distance(F.col("code"), F.col("found"))
        on = (probes["segment"] == inverted["segment"]) & (probes["value"] == inverted["value"]) & (far <= F.col("bound"))
        # Spark can't foresee how many probes a query has, so it is told not to broadcast them.
        met = probes.hint("merge").join(inverted, on).select("code", "found", "n_ids", far.alias("distance"))
        if best is not None:
            met = met.unionByName(best.join(open_.select("code"), "code", "left_semi").select("code", "found", "n_ids", "distance"))
        met = met.dropDuplicates(["code", "found"])
        # Codes in order of distance, with the ids that come before those of their distance.
        by = Window.partitionBy("code").orderBy("distance")
        ahead = F.coalesce(F.sum("n_ids").over(by.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        best = stored(met.withColumn("ahead", ahead).filter(F.col("ahead") < enough).drop("ahead"), "nearest")
        # The bound of a query: the distance at which it has enough ids, or all bits.
        reach = best.groupBy("code").agg(F.sum("n_ids").alias("n"), F.max("distance").alias("kth"))
        reach = open_.select("code").join(reach, "code", "left")
        bound = F.when(F.coalesce("n", F.lit(0)) >= enough, F.col("kth")).otherwise(bits)
        reach = stored(reach.select("code", bound.alias("bound")), "open")
        covered = m * (s + 1) - 1
        done.append(best.join(reach.filter(F.col("bound") <= covered), "code", "left_semi"))
        open_ = reach.filter(F.col("bound") > covered)
    if best is not None:
        done.append(best.join(open_.select("code"), "code", "left_semi"))
    if not done:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance")).limit(0)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # At most k ids of each code at each distance can count; codes are read once more for them.
    pairs = found.select("code", "found", "distance").join(index.select(F.col("code").alias("found"), "ids"), "found").select("code", "distance", F.explode("ids").alias("neighbour_id"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbour_id"))
    ranked = pairs.withColumn("rank", place).filter(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query_id"), "code").join(ranked, "code").select("query_id", "rank", "neighbour_id", "distance")
