"""Mixing sources to target weights.

Every document gets a hash-random key. Rows are ordered by it within their
source, in ranges of the key that hold about RANGE documents each: sizes are
summed by range, the sums are accumulated over the ranges of a source, and
only then within a range. So no task sees more than a range, whatever share of
the rows a source has. A source that must give more than it has is taken whole
as often as its budget allows, and its last epoch is cut at the exact word.

All on DataFrame functions; only keys and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlife.llm.common import free, stored, word_count, words

#: Documents of a range on average.
RANGE = 4096
SEED = "mix"


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(source, source_size, target) for a table of (source, source_size), one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn. They
    share ``share`` times all sizes by weight; a target stops at ``most`` times
    its source's size and the excess is shared again until none is above.
    That is the water level: sources in order of size to weight are full up to
    the first that the rest of the total does not fill.
    """
    n = len(weights)
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit([float(w) for w in weights]), ((F.row_number().over(turn) - 1) % n + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    later = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    table = table.withColumn("level", (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    table = table.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level of the first source that isn't full holds for all after it.
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)
    return table.select("source", "source_size", target.alias("target"))


def sized(df: DataFrame, key: str, source: str, text_col: str) -> DataFrame:
    """Key, source, size, rank key and tie-break of each row."""
    rank = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    return df.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text_col)).alias("size"),
        rank.alias("rank"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
    )


def plan(df: DataFrame, key: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """(key, source, tie, size, source_size, target, taken) of every row.

    ``taken`` counts the words that the mix takes of the row, repeats included.
    Empty and null texts have size 0 and give none; sources without words have
    target 0. Rows that repeat a key and text are separate rows of the mix;
    which of them the cut falls in makes no difference. Reruns agree.
    """
    rows = stored(sized(df, key, source, text_col), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(sums.select("source", "source_size")).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = goals.select(F.col("source").alias("s"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE)).alias("ranges"))
    placed = rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    number = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("range", F.floor(number * F.col("ranges") / F.lit(float(1 << 32))).cast("long"))

    spans = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "range").orderBy("rank", "key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))

    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("before") - F.col("ahead")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select("key", "source", "tie", "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, space-joined."""
    return F.array_join(F.slice(words(text), 1, n.cast("int")), " ")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows: each as often as its epochs, then its cut part, with the columns of ``df``.

    Whole copies are unchanged; the one document of a source in which the cut
    falls ends after the last word taken. Rows of which no word is taken go.
    """
    size, words_taken, part, *on = free(df.columns, "_size", "_taken", "_part", "_key", "_nokey", "_tie", "_source", "_nosource")

    def identity(k: str, s: str, tie: Column) -> list[Column]:
        columns = [F.coalesce(F.col(k), F.lit(0)), F.col(k).isNull(), tie, F.coalesce(F.col(s), F.lit("")), F.col(s).isNull()]
        return [c.alias(n) for c, n in zip(columns, on)]

    # Rows that repeat a key and text are alike, so their takes are added up and dealt out as copies.
    told = plan(df, key, source, text_col).filter("taken > 0").groupBy(*identity("key", "source", F.col("tie")))
    told = told.agg(F.sum("taken").alias(words_taken), F.max("size").alias(size))
    lone = df.select("*", *identity(key, source, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))).dropDuplicates(on)
    joined = lone.join(told, on)
    n = F.ceil(F.col(words_taken) / F.col(size)).cast("int")
    copies = F.transform(F.sequence(F.lit(1), n), lambda i: F.least(F.col(size), F.col(words_taken) - (i - 1) * F.col(size)))
    out = joined.withColumn(part, F.explode(copies))
    text = F.when(F.col(part) == F.col(size), F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(part)))
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in df.columns))
