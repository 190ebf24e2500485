"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 16 segments of 4 bits and becomes the vector
of their bit counts. The Manhattan distance of two such vectors is a lower
bound of the Hamming distance of the fingerprints, so all pairs within two bits
are found by a range join of radius 2 on the grid of vectors: each fingerprint
is entered at its own cell and at the cells one step away, where any two
vectors at distance 2 or less meet. Pairs that meet are verified on the exact bits.

Fingerprints that many documents share are folded to one row first. Where more
than CROWD fingerprints meet in a cell, pairing them would grow with the
square: those are linked instead through every fingerprint one bit flip away
(two fingerprints within two bits share one), where each joins the smallest
of its meeting point. That is exact as well and costs 65 rows a fingerprint.

Spark sizes exploded rows as the rows before them, 33 and 65 times too low, so
joins over them are merges by hint: none is broadcast through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import free, mapped, stored
from ledgerlife.llm.components import components

SEGMENTS, BITS = 16, 4
#: Fingerprints of a cell that are paired with each other at most.
CROWD = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    if not words:
        return 0
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    for i in range(0, n, 65_536):
        shingles = map(b" ".join, zip(*(words[i + k : i + k + 65_536] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")[: n - i]
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each whole text (A-Z in lower case, words between ASCII white space) as a long.

    Texts of fewer than three words hash as one sequence; null, empty and blank texts get 0.
    """
    return mapped(df, text_col, [T.StructField(into, T.LongType())], lambda texts: [[fingerprint(t) for t in texts]])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) over distinct longs (``fp``) that connect all pairs within two differing bits, and no others."""
    codes = [F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))) for i in range(SEGMENTS)]
    own = sum((c.cast("long") * (1 << 3 * i) for i, c in enumerate(codes)), F.lit(0).cast("long"))
    digit = lambda i: F.shiftright("own", 3 * i).bitwiseAND(F.lit(7))
    steps = [F.col("own")]
    for i in range(SEGMENTS):
        steps.append(F.when(digit(i) < BITS, F.col("own") + F.lit(1 << 3 * i)))
        steps.append(F.when(digit(i) > 0, F.col("own") - F.lit(1 << 3 * i)))
    entered = prints.select("fp", own.alias("own")).select("fp", F.explode(F.array(*steps)).alias("cell")).filter("cell is not null")
    met = entered.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    entered = stored(entered.join(met.hint("merge"), "cell"), "cells")

    few = entered.filter(F.col("n") <= CROWD).select("cell", "fp")
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    near = a.join(b.hint("merge"), (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")

    crowded = entered.filter(F.col("n") > CROWD).select("fp").distinct()
    flipped = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("via"))
    first = flipped.groupBy("via").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = flipped.join(first.hint("merge"), "via").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(stars).distinct()


def classes(df: DataFrame, key: str = "doc_id", fp: str = "fingerprint") -> DataFrame:
    """(fingerprint, component_id) for every fingerprint: smallest key of all rows reachable over links.

    Null keys are linked but never name a class; a class of none but null keys has id null.
    """
    prints = df.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least_key"))
    roots = stored(components(links(prints.select("fp"))).select(F.col("node").alias("fp"), "root"), "roots")
    named = roots.join(prints, "fp")
    named = named.join(named.groupBy("root").agg(F.min("least_key").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select(F.col("fp").alias(fp), F.coalesce("component_id", "least_key").alias("component_id"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, fingerprint (long) and component_id of every row; repeated rows are in one class."""
    slim = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    slim = stored(fingerprints(slim).drop("text"), "fingerprints")
    # Stored, so that the join shuffles both sides itself and Spark can split a fingerprint that many rows share.
    return slim.join(stored(classes(slim, "key"), "classes"), "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, whole and unchanged: the one of the smallest key, then text hash.

    Rows without a key come after all others. Of rows that repeat key and text one stays.
    """
    names = free(df.columns, "_null", "_key", "_hash")
    mark = [F.col(key).isNull(), F.coalesce(F.col(key), F.lit(0)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    mark = [c.alias(n) for c, n in zip(mark, names)]
    slim = stored(fingerprints(df.select(*mark, F.col(text_col).alias("text"))).drop("text"), "fingerprints")
    prints = slim.groupBy("fingerprint").agg(F.min(F.struct(*names)).alias("best"))
    roots = components(links(prints.select(F.col("fingerprint").alias("fp")))).select(F.col("node").alias("fingerprint"), "root")
    grouped = prints.join(roots, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("best").alias("best"))
    kept = grouped.select("best.*").distinct()
    return df.select("*", *mark).join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
