"""Quality rules: counts within a text, and lines that too many documents of a host repeat.

Lines are normalised (lower case, digits as 0, white space in a line as one
space, trimmed) and hashed. A line counts once for each document that has it;
a line found in more than ``max_docs`` documents of a host is above the limit
and removed (``cleaned``). A document is depleted if what its lines have left, each counted
once, is fewer than ``min_words`` words or less than ``min_left`` of them.

All on DataFrame functions. To judge, texts are read once and never shuffled:
what moves is a hash and a word count for each distinct line of a document. Counts are
added up before the shuffle, so a line that a third of all documents share is
a row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlife.llm.common import GAP, free, stored, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def normalised_lines(text: Column) -> Column:
    """Distinct normalised lines of a text that have a word."""
    return F.array_distinct(F.filter(_normalised(text), lambda x: x != ""))


def _normalised(text: Column) -> Column:
    """The normalised form of each line of a text."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def repeated_words(df: DataFrame, words_col: str, into: str) -> DataFrame:
    """Add the number of words in windows of WINDOW words that a text has twice or more, the first included.

    Windows are compared by 64-bit hashes. Only texts in which some window
    repeats are sorted; every step is linear or a sort within one text.
    """
    n = F.size(words_col)
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(words_col), i + k) for k in range(WINDOW))))
    df = df.withColumn("_w", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    several = F.size(F.array_distinct("_w")) < F.size("_w")
    placed = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_w", F.when(several, placed))
    held = F.transform(
        "_w", lambda x, i: F.when((x["h"] == F.get("_w", i - 1)["h"]) | (x["h"] == F.get("_w", i + 1)["h"]), x["i"])
    )
    df = df.withColumn("_w", F.sort_array(F.array_compact(held)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_w", start, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"]
    )
    return df.withColumn(into, F.coalesce(covered, F.lit(0)).cast("long")).drop("_w")


def measured(df: DataFrame, key: str = "doc_id", text_col: str = "text", host: str = "source") -> DataFrame:
    """key, host, tie, the counts of each text, and ``lines``: (hash, words) of its distinct normalised lines.

    Null and empty texts count 0 throughout and have no lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.col(key).alias("key"), F.col(host).alias("host"), text.alias("text")).withColumn("words", words(F.col("text")))
    worded = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, GAP, "") != "")
    df = df.withColumn("worded", worded)
    df = repeated_words(df, "words", "n_repeat_words")
    return df.select(
        "key", "host", F.xxhash64("text").alias("tie"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(normalised_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
    )


def above_limit(rows: DataFrame, max_docs: int) -> DataFrame:
    """(key2, host2, tie2, gone) of the texts among ``measured`` rows that have lines above the limit: the (hash, words) of these lines."""
    lines = rows.select("key", "host", "tie", F.explode("lines").alias("line")).select("key", "host", "tie", "line.h", "line.n")
    common = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs)
    common = common.select(F.col("host").alias("host2"), F.col("h").alias("h2"))
    hits = lines.join(common, lines["host"].eqNullSafe(F.col("host2")) & (lines["h"] == F.col("h2")))
    # A set, as rows that repeat key and text bring each line once each.
    return hits.groupBy(F.col("key").alias("key2"), F.col("host").alias("host2"), F.col("tie").alias("tie2")).agg(F.collect_set(F.struct("h", "n")).alias("gone"))


def cleaned(df: DataFrame, key: str = "doc_id", text_col: str = "text", host: str = "source", max_docs: int = 20) -> DataFrame:
    """Every row with its text without the lines above the limit, which are those that judge() counts as removed.

    Other lines stay as they are. Hashes of lines are joined to the texts by
    (key, host, hash of the text), broadcast only where Spark finds them small.
    """
    gone = above_limit(stored(measured(df, key, text_col, host), "lines"), max_docs)
    names = free(df.columns, "_key2", "_host2", "_tie2", "_gone")
    gone = gone.select("key2", "host2", "tie2", F.transform("gone", lambda x: x["h"]).alias("gone")).toDF(*names)
    same = F.col(key).eqNullSafe(F.col(names[0])) & F.col(host).eqNullSafe(F.col(names[1])) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(names[2]))
    pairs = F.arrays_zip(F.split(text_col, "\n").alias("line"), _normalised(F.col(text_col)).alias("plain"))
    left = F.filter(pairs, lambda x: (x["plain"] == "") | ~F.array_contains(F.col(names[3]), F.xxhash64(x["plain"])))
    text = F.when(F.col(names[3]).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    return df.join(gone, same, "left").select(*(text.alias(c) if c == text_col else F.col(c) for c in df.columns))


def judge(
    df: DataFrame, key: str = "doc_id", text_col: str = "text", host: str = "source",
    max_docs: int = 20, min_words: int = 10, min_left: float = 0.2,
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, removed_words, kept) of every row.

    A null host is a host of its own. Each row counts as a document, so repeated
    rows raise the counts of their lines and are judged alike. ``base_failed``:
    fewer than 10 words, or more than a fifth of them in repeated windows.
    """
    rows = stored(measured(df, key, text_col, host), "lines")
    removed = above_limit(rows, max_docs)
    same = rows["key"].eqNullSafe(F.col("key2")) & rows["host"].eqNullSafe(F.col("host2")) & (rows["tie"] == F.col("tie2"))
    removed = removed.withColumn("removed", F.aggregate("gone", F.lit(0), lambda a, x: a + x["n"]).cast("long")).drop("gone")
    line_words = F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]).cast("long")
    slim = rows.withColumn("line_words", line_words).drop("lines")
    out = slim.join(removed, same, "left").withColumn("removed_words", F.coalesce("removed", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("line_words") - F.col("removed_words")
    whole = (left >= min_words) & (left >= min_left * F.col("line_words"))
    kept = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # A text without removed lines isn't depleted, however short its distinct lines are.
    return out.select(*kept, failed.alias("base_failed"), "line_words", "removed_words", (~failed & (whole | (F.col("removed_words") == 0))).alias("kept"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT row, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT row, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs)),
windows AS (
  SELECT row, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o || chr(10) || lead(word, 4) OVER o AS five
  FROM worded WINDOW o AS (PARTITION BY row ORDER BY i)),
repeated AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS times FROM windows WHERE five IS NOT NULL) WHERE times > 1),
covered AS (
  SELECT row, CAST(sum(least(5, following - i)) AS BIGINT) AS n
  FROM (SELECT row, i, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i), i + 5) AS following FROM repeated) GROUP BY row),
lines AS (
  SELECT DISTINCT row, source, line FROM (
    SELECT row, source, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS line FROM docs)
  WHERE line <> ''),
sized AS (SELECT *, len(string_split(line, ' ')) AS n, count(*) OVER (PARTITION BY source, line) AS docs FROM lines),
left_over AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS line_words, CAST(sum(CASE WHEN docs > 20 THEN n ELSE 0 END) AS BIGINT) AS removed_words FROM sized GROUP BY row),
plain AS (
  SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM docs),
counted AS (
  SELECT d.row, d.doc_id,
    CAST((SELECT count(*) FROM worded w WHERE w.row = d.row) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(p.l) - len(list_distinct(p.l)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(o.line_words, 0) AS line_words, coalesce(o.removed_words, 0) AS removed_words
  FROM docs d JOIN plain p USING (row) LEFT JOIN covered c USING (row) LEFT JOIN left_over o USING (row)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, removed_words,
  NOT base_failed AND (removed_words = 0 OR (line_words - removed_words >= 10 AND line_words - removed_words >= 0.2 * line_words)) AS kept
FROM failed"""
