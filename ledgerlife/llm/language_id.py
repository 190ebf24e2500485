"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined per document, each as log probabilities of
every language:

- the text, by byte trigrams (letters only, lower case) under a multinomial
  model. A text counts as EVIDENCE trigrams at most, since neighbouring
  trigrams are far from independent;
- the language that the markup declares, by how often a text of each language
  carries that declaration;
- the suffix of the address, likewise;
- the host, whose prior is smoothed towards that of its site, then its
  suffix, then the whole corpus.

The last three come from grouped aggregates over all documents, counting the
languages that the texts alone point to. Only the trigram model is fitted on
labelled rows, ``fit_rows`` of them at most, and it alone reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import free, mapped, stored

#: Trigram classes, and languages that a model holds at most (the most frequent ones).
CLASSES, LANGUAGES = 1 << 14, 64
EVIDENCE = 60.0
#: Weight of the wider level in the priors, in documents.
KAPPA = 20.0
#: A text with fewer letters says nothing.
LETTERS = 3

_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str | None) -> tuple[np.ndarray, int]:
    """Trigram classes of a text and its number of letter bytes."""
    words = text.lower().encode("utf-8").translate(_KEEP).split() if text else []
    letters = sum(map(len, words))
    if not letters:
        return np.zeros(0, dtype=np.int64), 0
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    mixed = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return (mixed >> np.uint32(18)).astype(np.int64), letters


class Model:
    """Log probabilities of trigram classes by language."""

    def __init__(self, languages: list[str], logs: np.ndarray) -> None:
        self.languages, self.logs = languages, logs.astype(np.float32)

    def text_scores(self, text: str | None) -> tuple[list[float], int]:
        found, letters = trigrams(text)
        if not self.languages:
            return [], letters
        if letters < LETTERS:
            return [0.0] * len(self.languages), letters
        if len(found) > CLASSES:
            total = np.bincount(found, minlength=CLASSES).astype(np.float32) @ self.logs
        else:
            total = self.logs[found].sum(axis=0)
        return (total.astype(float) * min(1.0, EVIDENCE / len(found))).tolist(), letters


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", key: str = "doc_id", fit_rows: int = 4000) -> Model:
    """Fit the trigram model on about ``fit_rows`` labelled rows, drawn evenly by a hash of the key.

    Rows with a null label or text are not used. Without labelled rows the model has no language.
    """
    labelled = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("key"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    n = labelled.count()
    share = max(1, -(-n // fit_rows))
    drawn = labelled.filter(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(share)) == 0) if share > 1 else labelled

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(trigrams(text)[0], minlength=CLASSES)
                sums[label] = sums.get(label, 0) + found
            for label, total in sums.items():
                held = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["label", "class", "n"])

    counts = drawn.select("label", "text").mapInArrow(count, "label string, class int, n bigint").groupBy("label", "class").agg(F.sum("n").alias("n"))
    counts = stored(counts, "trigrams")
    top = [r["label"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LANGUAGES).collect()]
    languages = sorted(top)
    if not languages:
        return Model([], np.zeros((CLASSES, 0)))
    table = np.full((CLASSES, len(languages)), 0.5)
    for r in counts.filter(F.col("label").isin(languages)).collect():  # CLASSES x LANGUAGES rows at most
        table[r["class"], languages.index(r["label"])] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=0)))


def evidence(df: DataFrame, model: Model, text_col: str, into: str) -> DataFrame:
    """Add a column of log scores by language, letters, and the number of the best language (null without letters)."""

    def make(texts: list) -> list:
        made = [model.text_scores(t) for t in texts]
        return [[{"logs": logs, "letters": n, "guess": int(np.argmax(logs)) if logs and n >= LETTERS else None} for logs, n in made]]

    return mapped(df, text_col, [T.StructField(into, EVIDENCE_TYPE)], make)


EVIDENCE_TYPE = T.StructType(
    [T.StructField("logs", T.ArrayType(T.DoubleType())), T.StructField("letters", T.LongType()), T.StructField("guess", T.IntegerType())]
)


def levels(host_col: str | None = None, url_col: str | None = None, declared_col: str | None = None) -> dict[str, Column]:
    """Keys of the evidence beside the text, null where a row has none."""
    keys = {}
    if url_col is not None:
        host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        keys = {"_host": host, "_site": F.substring_index(host, ".", -2), "_suffix": F.substring_index(host, ".", -1)}
    elif host_col is not None:
        keys = {"_host": F.col(host_col).cast("string"), "_site": F.lit("")}
    if declared_col is not None:
        keys["_declared"] = F.lower(F.regexp_extract(F.col(declared_col), r"^\s*([A-Za-z]{2,3})", 1))
    return {name: F.when(c != "", c) for name, c in keys.items()}


def _smooth(n: Column, wider: Column) -> Column:
    """Counts of a level, smoothed by the probabilities of the wider level."""
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) + KAPPA
    return F.zip_with(n, wider, lambda x, p: (x + p * KAPPA) / total)


def priors(keyed: DataFrame, model: Model) -> dict[str, DataFrame]:
    """Log evidence by key, for each key column of ``keyed`` (with column ``guess``), from counts over all its rows."""
    k = len(model.languages)
    known = keyed.filter("guess is not null")
    by = [c for c in keyed.columns if c != "guess"]
    counts = F.array(*(F.sum(F.when(F.col("guess") == i, 1.0).otherwise(0.0)) for i in range(k)))
    counted = stored(known.groupBy(*by).agg(counts.alias("n")), "languages")  # one row for each combination of keys
    total = F.array(*(F.coalesce(F.sum(F.col("n")[i]), F.lit(0.0)) for i in range(k)))
    overall = counted.agg(total.alias("n")).first()["n"]
    everywhere = F.lit([(x + 1.0) / (sum(overall) + k) for x in overall])
    logs = lambda c: F.transform(c, lambda x: F.log(x))
    out = {}
    if "_host" in by:
        site = counted.filter("_site is not null").groupBy("_site").agg(total.alias("n")).select("_site", _smooth(F.col("n"), everywhere).alias("wider"))
        host = counted.filter("_host is not null").groupBy("_host", "_site").agg(total.alias("n")).join(site, "_site", "left")
        out["_host"] = host.select("_host", logs(_smooth(F.col("n"), F.coalesce("wider", everywhere))).alias("log"))
    for name in ("_suffix", "_declared"):
        if name in by:
            seen = counted.filter(F.col(name).isNotNull()).groupBy(name).agg(total.alias("n"))
            # P(key | language), every key having one more row spread over the languages
            likely = F.zip_with(F.col("n"), everywhere, lambda x, p: F.log((x + p) / (p * (sum(overall) + 1.0))))
            out[name] = seen.select(name, likely.alias("log"))
    return {name: stored(rows, "priors") for name, rows in out.items()} | {"": keyed.sparkSession.createDataFrame([([float(np.log((x + 1.0) / (sum(overall) + k))) for x in overall],)], "log array<double>")}


def fuse(scored: DataFrame, proof: str, tables: dict[str, DataFrame], keys: dict[str, str], model: Model, least: float) -> DataFrame:
    """Combine the evidence column ``proof`` with that of the key columns; all of these are dropped.

    Tables of keys are joined, broadcast only where Spark finds them small.
    """
    own = [c for c in scored.columns if c != proof and c not in keys.values()]
    names = F.lit(model.languages)
    base = [float(x) for x in tables[""].first()["log"]]
    letters, logs_name, *log_names = free(scored.columns, "_letters", "_logs", "_log_host", "_log_suffix", "_log_declared")
    out, logs = scored, F.col(f"{proof}.logs")
    for name, log in zip(("_host", "_suffix", "_declared"), log_names):
        if name in tables:
            out = out.join(tables[name].select(F.col(name).alias(keys[name]), F.col("log").alias(log)), keys[name], "left")
            missing = F.lit(base) if name == "_host" else F.lit([0.0] * len(base))
            logs = F.zip_with(logs, F.coalesce(log, missing), lambda a, b: a + b)
    if "_host" not in tables:
        logs = F.zip_with(logs, F.lit(base), lambda a, b: a + b)
    out = out.select(*own, F.col(f"{proof}.letters").alias(letters), logs.alias(logs_name))
    top = F.array_max(logs_name)
    whole = F.aggregate(F.transform(logs_name, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(names, F.array_position(logs_name, top).cast("int"))
    out = out.select(*own, letters, best.alias("language"), (F.lit(1.0) / whole).alias("probability"))
    return out.select(*own, "language", "probability", ((F.col(letters) >= LETTERS) & (F.col("probability") >= least)).alias("recognised"))


def identify(
    df: DataFrame, model: Model, text_col: str = "text", host_col: str | None = None, url_col: str | None = None,
    declared_col: str | None = None, least: float = 0.5, keep_text: bool = True,
) -> DataFrame:
    """Add ``language``, ``probability`` and ``recognised`` to every row; columns of these names are replaced.

    ``host_col`` names the host; with ``url_col`` host, site and suffix are cut
    from the address. A document is recognised if its text has at least
    LETTERS letter bytes and the posterior of its best language is ``least``
    or more. A text without letters (null, empty, digits) gets the best guess
    of the other evidence but is not recognised. A missing host, address or
    declaration adds no evidence. Ties go to the first language by name. A
    model without languages recognises nothing.

    With ``keep_text`` texts are scored twice, once for the priors and once for
    the rows, which spares writing them; without it the text column is left
    out and texts are scored once.
    """
    columns = levels(host_col, url_col, declared_col)
    own = [c for c in df.columns if c.lower() not in ("language", "probability", "recognised") and (keep_text or c != text_col)]
    if not model.languages:
        return df.select(*own, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("recognised"))
    proof, *free_names = free(df.columns, "_evidence", *columns)
    keys = dict(zip(columns, free_names))
    scored = evidence(df, model, text_col, proof).select(*own, proof, *(c.alias(keys[n]) for n, c in columns.items()))
    if not keep_text:
        scored = stored(scored, "evidence")
        counted = scored.select(*(F.col(keys[n]).alias(n) for n in columns), F.col(f"{proof}.guess").alias("guess"))
    else:
        used = {c for c in (text_col, host_col, url_col, declared_col) if c is not None}
        counted = evidence(df.select(*used), model, text_col, proof).select(*(c.alias(n) for n, c in columns.items()), F.col(f"{proof}.guess").alias("guess"))
    return fuse(scored, proof, priors(counted, model), keys, model, least)
