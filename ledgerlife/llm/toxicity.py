"""Toxicity by boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon (words
and word beginnings that toxic rows have far more often), how many of their
hits stand near a second person, capitals, punctuation, and rates of
obfuscation (signs or digits inside words, stretched letters, lexicon words
after undoing such signs). Words are looked up once per worker; a text is then
sums over its word numbers.

The labelled rows are split by hash: one half gives the lexicon, a third the
trees, the rest the calibration, so no part is judged by rows it has seen.
``fit_rows`` bounds the labelled rows that are used.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import free, mapped, stored

#: A small fixed lexicon of insults in four languages.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool loser losers clown clowns pathetic worthless scum trash garbage "
    "disgusting filth filthy vermin bitch bastard asshole shit fuck fucking cunt whore slut retard retarded jerk imbecile scumbag pig "
    "idiota idiotas imbécil estúpido estúpida tonto tonta basura puta puto mierda asqueroso cabrón gilipollas inútil "
    "imbécile stupide crétin connard connasse salope merde ordure abruti débile putain enculé "
    "dumm dummkopf trottel arschloch scheiße hurensohn schlampe abschaum wertlos blödmann vollidiot miststück".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros du dich dir dein deine deinen deiner ihr euch euer sie".split()
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_SIGNS = string.punctuation + "¡¿«»„“”‚‘’…–—"
NEAR = 5
#: Lengths of the word beginnings that the learned lexicon may hold, and its entries at most.
STEMS, TERMS = (4, 5, 6), 20_000
#: Words that a worker keeps.
KEPT = 300_000

FEATURES = (
    "log_words", "fixed_density", "fixed_hits", "learned_weight", "learned_density", "learned_most", "learned_distinct", "second_density",
    "near_second", "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "undone_hits", "stretched",
)


def terms(word: str) -> list[str]:
    """Lexicon keys of a word in lower case: itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Words(dict):
    """Number of each distinct word, with a row of word features for it."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.rows = lexicon, []
        self.table = np.zeros((0, 12))

    def __missing__(self, raw: str) -> int:
        core = raw.strip(_SIGNS)
        low = core.lower()
        letters = sum(map(str.isalpha, raw))
        undone = low.translate(_LEET)
        plain = "".join(filter(str.isalpha, undone))
        odd = bool(letters) and not core.isalpha() and any(not c.isalpha() and c not in "'’-" for c in core)
        stretched = any(a == b == c and a.isalpha() for a, b, c in zip(low, low[1:], low[2:]))
        self.rows.append(
            (
                low in INSULTS, max(self.lexicon.get(t, 0.0) for t in terms(low)), low in SECOND_PERSON, letters, sum(map(str.isupper, raw)),
                letters > 1 and raw.upper() == raw and raw.lower() != raw, raw.count("!"), raw.count("?"), len(raw) - len(raw.strip(_SIGNS)),
                odd, low not in INSULTS and (undone in INSULTS or plain in INSULTS), stretched,
            )
        )
        self[raw] = n = len(self)
        return n

    def features(self, texts: list[str | None]) -> list[list[float]]:
        if len(self) > KEPT:
            self.clear()
            self.rows, self.table = [], np.zeros((0, 12))
        orders = [np.fromiter(map(self.__getitem__, w), dtype=np.int64, count=len(w)) for w in ((t or "").split() for t in texts)]
        if len(self.table) < len(self.rows):
            self.table = np.concatenate((self.table, np.array(self.rows[len(self.table):], dtype=float)))
        return [self._row(order) for order in orders]

    def _row(self, order: np.ndarray) -> list[float]:
        n = len(order)
        if not n:
            return [0.0] * len(FEATURES)
        own = self.table[order]
        total = own.sum(axis=0)
        weights = own[:, 1]
        hits = np.flatnonzero((own[:, 0] > 0) | (weights > 0) | (own[:, 10] > 0))
        second = np.flatnonzero(own[:, 2])
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            after = second[np.minimum(at, len(second) - 1)] - hits
            before = hits - second[np.maximum(at - 1, 0)]
            near = int(((np.abs(after) <= NEAR) | (np.abs(before) <= NEAR)).sum())
        letters = max(1.0, total[3])
        return [
            math.log1p(n), 100 * total[0] / n, math.log1p(total[0]), math.log1p(total[1]), 100 * np.count_nonzero(weights) / n, float(weights.max()),
            math.log1p(len(np.unique(order[weights > 0]))), total[2] / n, near / max(1, len(hits)), total[4] / letters, total[5] / n, total[6] / n,
            total[7] / n, total[8] / n, total[9] / n, math.log1p(total[10]), total[11] / n,
        ]


_words: dict[int, Words] = {}


def _table(lexicon: dict[str, float]) -> Words:
    """The word table of this worker for a lexicon."""
    mark = hash(frozenset(lexicon.items()))
    if mark not in _words:
        _words.clear()
        _words[mark] = Words(lexicon)
    return _words[mark]


def with_features(df: DataFrame, lexicon: dict[str, float], text_col: str = "text", into: str = "features") -> DataFrame:
    """Add the features of each whole text as an array of doubles; null and empty texts have zeros."""
    return mapped(df, text_col, [T.StructField(into, T.ArrayType(T.DoubleType()))], lambda texts: [_table(lexicon).features(texts)])


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms of (text, label) rows that stand out in label 1: log odds ratio of their document counts.

    A term needs a likelihood ratio statistic of 30 or more and four times the share.
    """

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            sums: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.strip(_SIGNS).lower() for w in set((text or "").split())}
                sums[label].update({t for w in words if w for t in terms(w)})
            keys = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in (sums[1], sums[0]))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "pos", "neg"])

    totals = labelled.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    p, n = float(totals["p"] or 0), float((totals["n"] or 0) - (totals["p"] or 0))
    if not p or not n:
        return {}
    found = labelled.select("text", "label").mapInArrow(count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / (p + n)
    part = lambda seen, of: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (share * of))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    strong = found.filter((F.col("pos") >= 3)).withColumns({"g": 2 * (part("pos", p) + part("neg", n)), "odds": odds}).filter((F.col("g") >= 30) & (F.col("odds") >= math.log(4)))
    return {r["term"]: r["odds"] for r in strong.orderBy(F.desc("g"), "term").limit(TERMS).collect()}


@dataclass
class Model:
    """Lexicon, trees and calibration; without both labels in the data only a constant."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    levels: IsotonicRegressionModel | None = None
    constant: float = 0.0


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 24_000, rounds: int = 20) -> Model:
    """Fit on about ``fit_rows`` rows of ``labels`` (key, label 0 or 1), drawn evenly by a hash of the key.

    A key with several labels takes the largest; rows with a null key or label are left out.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    share = max(1, -(-known.count() // fit_rows))
    drawn = known.filter(F.pmod(F.xxhash64("key", F.lit("rows")), F.lit(share)) == 0).withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(20)))
    # At most about fit_rows rows of three numbers are broadcast.
    rows = documents.select(F.col(key).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "key")
    rows = stored(rows, "labelled")
    lexicon = learn_lexicon(rows.filter("part < 10"))
    table = stored(with_features(rows.filter("part >= 10"), lexicon).select("label", "part", "features"), "features")
    table = table.select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("features")).coalesce(6)
    train, rest = table.filter("part < 17").drop("part").persist(), table.filter("part >= 17")
    try:
        seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        total = sum(seen.values())
        if len(seen) < 2:
            return Model(lexicon, constant=(seen.get(1.0, 0) + 0.5) / (total + 1) if total else 0.0)
        trees = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.3, seed=7, maxBins=64).fit(train)
        told = trees.transform(rest.select("label", "features")).select("label", vector_to_array("rawPrediction")[1].alias("raw"))
        levels = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(told) if not told.isEmpty() else None
        return Model(lexicon, trees, levels)
    finally:
        train.unpersist()


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Replace the text by ``score``, 0 to 1, higher where toxicity is likelier; every row keeps its other columns.

    Null and empty texts are scored by their zero features. A column named ``score`` is replaced.
    """
    own = [c for c in df.columns if c != text_col and c.lower() != "score"]
    if model.trees is None:
        return df.select(*own, F.lit(model.constant).alias("score"))
    features, kind, chances, margin, raw, level = free(df.columns, "_features", "_class", "_chances", "_margin", "_raw", "_level")
    found = with_features(df, model.lexicon, text_col, features).select(*own, array_to_vector(features).alias(features))
    trees = model.trees.copy().setFeaturesCol(features).setPredictionCol(kind).setProbabilityCol(chances).setRawPredictionCol(margin)
    found = trees.transform(found).select(*own, vector_to_array(margin)[1].alias(raw))
    fine = 1 / (1 + F.exp(-2 * F.col(raw)))
    if model.levels is None:
        return found.select(*own, fine.alias("score"))
    # Calibrated levels are steps; a thousandth of the uncalibrated chance keeps the order within a step.
    found = model.levels.copy().setFeaturesCol(raw).setPredictionCol(level).transform(found)
    return found.select(*own, (0.999 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(level))) + 0.001 * fine).alias("score"))
