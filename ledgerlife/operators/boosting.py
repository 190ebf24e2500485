"""Gradient-boosted trees on histograms, one softmax over all classes.

Features are cut to bins once. A round grows one tree for each class (one in all
for two classes) from the gradients of the same scores. Each level of all these
trees is one sum by (class, node, feature, bin): rows give only the bins that differ
from a feature's most frequent one, whose sum is what is missing to the node's total, and
only the smaller child of a split is counted, as the other is its parent less it. Rows stay in
the tasks that hold them through many rounds (``boosting_rounds``); only the trees reach the driver.

Levels are grown to ``max_depth``; then splits are taken in order of their gain, as far as
``num_leaves`` allows. A node's best split doesn't depend on other nodes, so that is the tree that leaf-wise growth makes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlife.functions.columns import constants
from ledgerlife.operators.boosting_rounds import TREES, played, unpacked
from ledgerlife.session import release, reused

#: Rounds of one Spark job; bins of rows that a task holds before they are dealt over more.
ROUNDS_A_JOB, CELLS = 200, 5_000_000


@dataclass(frozen=True)
class Boosting:
    """Settings. ``row_share`` and ``column_share`` are drawn anew for each round; a share of 1 takes all."""

    rounds: int = 20
    learning_rate: float = 0.1
    max_depth: int = 6
    num_leaves: int = 31
    max_bin: int = 255
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    path_smooth: float = 0.0
    min_gain: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 0


@dataclass
class Tree:
    """Nodes in heap order: children of n are 2n + 1 and 2n + 2; a feature of -1 marks a leaf."""

    depth: int
    feature: list[int]
    bin: list[int]
    value: list[float]


@dataclass
class BoostedTrees:
    features: list[str]
    edges: list[list[float]]
    classes: int
    start: list[float]
    settings: Boosting
    rounds: list[list[Tree]] = field(default_factory=list)


def bin_edges(df: DataFrame, features: Sequence[str], max_bin: int) -> list[list[float]]:
    """Ascending edges for each column, ``max_bin`` - 1 at most: its distinct values above the smallest, or quantiles.

    A value's bin is the number of edges that it reaches. One aggregation for all columns.
    """
    shares = [i / max_bin for i in range(1, max_bin)]
    each = []
    for name in features:
        value = F.col(name).cast("double")
        each += [F.percentile_approx(value, shares, 20 * max_bin).alias(f"q_{len(each)}"), F.min(value).alias(f"m_{len(each)}")]
    row = df.agg(*each).first()
    out = []
    for i in range(0, len(row), 2):
        low = row[i + 1]
        out.append(sorted({float(v) + 0.0 for v in row[i] or [] if v is not None and v > low}) if low is not None else [])
    return out


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], into: str = "bins") -> DataFrame:
    """Add the bins of all features as an array; null goes to the first bin, not-a-number to the last."""
    far = float("inf")
    open_ = [i for i, e in enumerate(edges) if e]
    # Adding zero makes one of the two zeros, which the cut would tell apart.
    values = {f"_v{i}": F.coalesce(F.col(features[i]).cast("double"), F.lit(-far)) + 0.0 for i in open_}
    marked = df.withColumns({c: F.when(F.isnan(v), F.lit(far)).otherwise(v) for c, v in values.items()}) if open_ else df
    if open_:
        cut = Bucketizer(splitsArray=[[-far, *edges[i], far] for i in open_], inputCols=[f"_v{i}" for i in open_], outputCols=[f"_b{i}" for i in open_])
        marked = cut.transform(marked)
    bins = F.array(*[F.col(f"_b{i}").cast("int") if i in set(open_) else F.lit(0) for i in range(len(edges))])
    return marked.withColumn(into, bins).drop(*[f"_{side}{i}" for side in "vb" for i in open_])


def node_of(feature: str, bin_: str, depth: int, bins: str = "bins", offset: str = "0") -> str:
    """Where a row stands after ``depth`` steps from the root; SQL over constant arrays, in which the tree starts at ``offset``."""
    if not depth:
        return "0"
    f, b = f"get({feature}, n + {offset})", f"get({bin_}, n + {offset})"
    return f"aggregate(sequence(1, {depth}), 0, (n, _) -> CASE WHEN {f} < 0 THEN n WHEN get({bins}, {f}) <= {b} THEN 2 * n + 1 ELSE 2 * n + 2 END)"


def gradients(classes: int) -> list[tuple[str, str]]:
    """First and second derivative of the log loss for each score: a logistic one for two classes, else softmax.

    Second derivatives of the softmax are scaled by classes / (classes - 1). SQL over ``scores`` and ``y``.
    """
    if classes == 2:
        p = "(1 / (1 + exp(-get(scores, 0))))"
        return [(f"{p} - y", f"{p} * (1 - {p})")]
    out = []
    for k in range(classes):
        p = f"get(shares, {k})"
        out.append((f"{p} - CAST(y = {k} AS DOUBLE)", f"{classes / (classes - 1)!r}D * {p} * (1 - {p})"))
    return out


def softmax(scores: Column, classes: int) -> list[Column]:
    top = F.array_max(scores)
    powers = [F.exp(F.get(scores, F.lit(k)) - top) for k in range(classes)]
    total = powers[0]
    for power in powers[1:]:
        total = total + power
    return [power / total for power in powers]


def _strength(g: str, h: str, s: Boosting) -> str:
    """Twice the loss that the best value of a leaf takes away."""
    shrunk = f"greatest(abs({g}) - {s.lambda_l1!r}D, 0D)" if s.lambda_l1 else f"({g})"
    return f"coalesce(try_divide({shrunk} * {shrunk}, {h} + {s.lambda_l2!r}D), 0D)"


def _gain(s: Boosting, gl: str, hl: str, nl: str, g: str = "tg", h: str = "th", n: str = "tn") -> str:
    """What a split gains; -1 where a side is too small."""
    gr, hr, nr = f"({g} - ({gl}))", f"({h} - ({hl}))", f"({n} - ({nl}))"
    fit = f"least({nl}, {nr}) >= {max(1, s.min_child_samples)} AND least({hl}, {hr}) >= {s.min_child_weight!r}D"
    return f"CASE WHEN {fit} THEN {_strength(gl, hl, s)} + {_strength(gr, hr, s)} - {_strength(g, h, s)} ELSE -1D END"


def _bins_by_feature(hist: DataFrame, usual: str, totals: dict[tuple[int, int], tuple]) -> DataFrame:
    """(k, node, f, tg, th, tn, cells): the bins of each feature in order, the usual one as what is missing to the total."""
    size = max((node for _, node in totals), default=0) + 1
    classes = max((k for k, _ in totals), default=0) + 1
    parts = {}
    for i, (name, kind) in enumerate((("tg", "double"), ("th", "double"), ("tn", "bigint"))):
        parts[name] = F.expr(f"get({constants([totals.get((k, node), (0.0, 0.0, 0))[i] for k in range(classes) for node in range(size)], kind)}, k * {size} + node)")
    cells = hist.groupBy("k", "node", "f").agg(F.expr("collect_list(struct(b, g, h, n)) AS cells"), *(F.sum(c).alias(f"s{c}") for c in "ghn")).withColumns(parts)
    rest = f"named_struct('b', get({usual}, f), 'g', tg - sg, 'h', th - sh, 'n', tn - sn)"
    return cells.select("k", "node", "f", "tg", "th", "tn", F.expr(f"sort_array(concat(cells, filter(array({rest}), c -> c.n > 0)))").alias("cells"))


def candidates(hist: DataFrame, usual: str, totals: dict[tuple[int, int], tuple], s: Boosting) -> DataFrame:
    """Every split of every node that leaves enough on both sides: (k, node, f, b, gain, nl); rows with bins up to b go left.

    ``hist`` has (k, node, f, b, g, h, n) for bins other than the usual one of a feature.
    """
    zero = "named_struct('b', 0, 'g', 0D, 'h', 0D, 'n', 0L)"
    last = "element_at(done, -1)"
    add = f"(done, c) -> concat(done, array(named_struct('b', c.b, 'g', {last}.g + c.g, 'h', {last}.h + c.h, 'n', {last}.n + c.n)))"
    sums = f"slice(aggregate(cells, array({zero}), {add}), 2, size(cells))"
    rows = _bins_by_feature(hist, usual, totals).select("k", "node", "f", "tg", "th", "tn", F.expr(f"explode({sums})").alias("l"))
    return rows.select("k", "node", "f", F.col("l.b").alias("b"), F.expr(_gain(s, "l.g", "l.h", "l.n")).alias("gain"), F.col("l.n").alias("nl")).filter("gain >= 0")


def with_gradients(rows: DataFrame, classes: int) -> DataFrame:
    """Rows with ``shares`` of the classes where there are more than two."""
    return rows if classes == 2 else rows.withColumn("shares", F.array(*softmax(F.col("scores"), classes)))


def root_totals(rows: DataFrame, classes: int) -> dict[tuple[int, int], tuple]:
    """Sums of gradients of all rows for each tree."""
    parts = [F.expr(f"coalesce(sum({part}), 0D)").alias(f"{name}{k}") for k, pair in enumerate(gradients(classes)) for name, part in zip("gh", pair)]
    row = with_gradients(rows, classes).agg(F.count("*").alias("n"), *parts).first()
    return {(k, 0): (row[f"g{k}"], row[f"h{k}"], row["n"]) for k in range(len(gradients(classes)))}


def histogram(rows: DataFrame, trees: list[Tree], level: int, counted: list[set[int]], columns: Sequence[int], d: int, classes: int) -> DataFrame:
    """Sums of gradients of the ``counted`` nodes of each tree at a level: (k, node, f, b, g, h, n), without usual bins."""
    parts = []
    for k, (g, h) in enumerate(gradients(classes)):
        node = node_of(constants(trees[k].feature, "int"), constants(trees[k].bin, "int"), level)
        parts.append(f"named_struct('k', {k}, 'node', {node}, 'g', {g}, 'h', {h})")
    size = max((max(c, default=0) for c in counted), default=0) + 1
    wanted = constants([int(n in c) for c in counted for n in range(size)], "int")
    split = with_gradients(rows, classes).select(F.expr(f"explode(array({', '.join(parts)}))").alias("p"), "cells")
    split = split.filter(f"p.node < {size} AND get({wanted}, p.k * {size} + p.node) = 1")
    cells = "cells"
    if len(columns) < d:
        cells = f"filter(cells, c -> get({constants([int(i in set(columns)) for i in range(d)], 'int')}, c.f) = 1)"
    split = split.select("p.*", F.expr(f"explode({cells})").alias("c"))
    return split.groupBy("k", "node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def _value(g: float, h: float, n: int, above: float, s: Boosting) -> float:
    """Value of a leaf before the learning rate; few rows are drawn towards the parent's value."""
    shrunk = math.copysign(max(abs(g) - s.lambda_l1, 0.0), g)
    value = -shrunk / (h + s.lambda_l2) if h + s.lambda_l2 > 0 else 0.0
    if s.path_smooth > 0 and n:
        weight = n / s.path_smooth
        value = (value * weight + above) / (weight + 1)
    return value


def _grown(splits: dict[int, tuple], s: Boosting) -> Tree:
    """The tree of the best ``num_leaves`` - 1 splits, each below another that is taken. Node: (g, h, n, f, b, gain)."""
    depth = s.max_depth
    size = 2 ** (depth + 1) - 1
    tree = Tree(depth, [-1] * size, [0] * size, [0.0] * size)
    taken, queue = set(), [(-splits[0][5], 0)] if 0 in splits and splits[0][3] is not None else []
    while queue and len(taken) < s.num_leaves - 1:
        _, node = heapq.heappop(queue)
        taken.add(node)
        for child in (2 * node + 1, 2 * node + 2):
            if child in splits and splits[child][3] is not None:
                heapq.heappush(queue, (-splits[child][5], child))
    values = {-1: 0.0}
    for node in sorted(splits):
        if node == 0 or (node - 1) // 2 in taken:
            g, h, n, f, b, _ = splits[node]
            values[node] = _value(g, h, n, values[(node - 1) // 2] if node else 0.0, s)
            if node in taken:
                tree.feature[node], tree.bin[node] = f, b
            else:
                tree.value[node] = s.learning_rate * values[node]
    return tree


def _binned_rows(df: DataFrame, label: str, model: BoostedTrees) -> tuple[DataFrame, list[int]]:
    """Rows (id, y, bins), stored, and the usual bin of each feature."""
    rows = binned(df.filter(F.col(label).isNotNull()), model.features, model.edges).select(F.monotonically_increasing_id().alias("id"), F.col(label).cast("int").alias("y"), "bins")
    rows = reused(rows)
    counts = rows.select(F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.count("*").alias("n"))
    modes = dict(counts.groupBy("f").agg(F.max_by("b", F.struct("n", -F.col("b")))).collect())
    return rows, [modes.get(i, 0) for i in range(len(model.features))]


def boosting_rows(df: DataFrame, label: str, model: BoostedTrees) -> tuple[DataFrame, str]:
    """Rows as ``histogram`` takes them, and the usual bin of each feature."""
    rows, modes = _binned_rows(df, label, model)
    usual = constants(modes, "int")
    cells = F.expr(f"filter(transform(bins, (b, i) -> named_struct('f', i, 'b', b)), c -> c.b <> get({usual}, c.f))")
    start = F.array(*[F.lit(v) for v in model.start])
    return rows.select("*", cells.alias("cells"), start.alias("scores")), usual


def prepared(df: DataFrame, label: str, features: Sequence[str], classes: int, settings: Boosting) -> BoostedTrees:
    """A model without trees: bins, and scores that give the shares of the classes."""
    counts = {r["y"]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    share = lambda k: min(max(counts.get(k, 0) / total, 1e-15), 1 - 1e-15)
    start = [math.log(share(1) / (1 - share(1)))] if classes == 2 else [math.log(share(k)) for k in range(classes)]
    return BoostedTrees(list(features), bin_edges(df, features, settings.max_bin), classes, start, settings)


def _tasks(spark: SparkSession, cells: int) -> int:
    """How many tasks hold the rows: a barrier runs all of them at once, which Spark refuses where executors come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    slots = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    return max(1, min(slots, math.ceil(cells / CELLS)))


def fit_boosted(df: DataFrame, label: str, features: Sequence[str], classes: int, settings: Boosting = Boosting()) -> BoostedTrees:
    """Boost ``settings.rounds`` rounds, or until no tree of a round has a split.

    ``label`` counts from 0; rows without one take no part. ``ROUNDS_A_JOB`` rounds are one Spark job, which first adds up
    the trees before it: a lost executor costs the rounds of one job. Trees don't depend on how many tasks hold the rows.
    """
    model = prepared(df, label, features, classes, settings)
    spark, d = df.sparkSession, len(model.features)
    rows, usual = _binned_rows(df, label, model)
    n, sizes, size = rows.count(), [len(e) + 1 for e in model.edges], 2 ** (settings.max_depth + 1) - 1
    tasks = _tasks(spark, n * d)
    done: list[tuple] = []
    whole = settings.row_share == 1 and settings.column_share == 1
    while n and len(model.rounds) < settings.rounds:
        turns = range(len(model.rounds), min(settings.rounds, len(model.rounds) + ROUNDS_A_JOB))
        play = played(settings, classes, sizes, usual, model.start, n, done, turns, tasks, _grown)
        told = sorted(rows.repartition(tasks, "id").mapInArrow(play, TREES, barrier=tasks > 1).collect(), key=lambda r: (r["turn"], r["k"]))
        done += [(r["turn"], r["k"], *map(bytes, r[2:])) for r in told]
        outputs = len(model.start)
        each = [[Tree(settings.max_depth, *unpacked(*map(bytes, r[2:]), size)) for r in told[i : i + outputs]] for i in range(0, len(told), outputs)]
        if whole and all(t.feature[0] < 0 for t in each[-1]):
            model.rounds += each[:-1]
            break
        model.rounds += each
    release(rows)
    return model


def _walk(trees: Sequence[Tree]) -> tuple[str, str]:
    """SQL of the place where tree ``t`` takes the bins ``b``, and of the values of all places.

    The nodes in use of all trees follow one another; a tree is walked as many steps as it is deep.
    """
    roots, steps, feature, bin_, left, value = [], [], [], [], [], []
    for tree in trees:
        roots.append(len(feature))
        used, deep = [0], 0
        for n in used:  # grows meanwhile: children are next to each other
            inner = tree.feature[n] >= 0
            left.append(roots[-1] + len(used) if inner else -1)
            feature.append(tree.feature[n])
            bin_.append(tree.bin[n])
            value.append(tree.value[n])
            if inner:
                used += [2 * n + 1, 2 * n + 2]
                deep = max(deep, (n + 1).bit_length())
        steps.append(deep)
    roots, steps, feature, bin_, left = (constants(held or [0], "int") for held in (roots, steps, feature, bin_, left))
    longest = max((tree.depth for tree in trees), default=0)
    f = f"get({feature}, n)"
    step = f"CASE WHEN {f} < 0 THEN n WHEN get(b, {f}) <= get({bin_}, n) THEN get({left}, n) ELSE get({left}, n) + 1 END"
    walk = f"aggregate(slice({constants(range(longest) or [0], 'int')}, 1, get({steps}, t)), get({roots}, t), (n, _) -> {step})"
    return walk, constants(value or [0.0], "double")


def boosted_scores(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` and ``probability_class_<i>``; all trees are walked in one expression for each class."""
    columns = binned(df, model.features, model.edges, "_bins")
    margins = []
    for k, start in enumerate(model.start):
        walk, value = _walk([r[k] for r in model.rounds])
        turns = f"sequence(0, {len(model.rounds) - 1})" if model.rounds else "CAST(array() AS array<int>)"
        margins.append(f"aggregate({turns}, {float(start)!r}D, (s, t) -> s + get({value}, {walk}))")
    # As a lambda's argument a row's bins are found once; Spark may put the expression of a column used once into each step of the walk.
    columns = columns.withColumn("_scores", F.expr(f"get(transform(array(_bins), b -> array({', '.join(margins)})), 0)"))
    if model.classes == 2:
        p = 1.0 / (1.0 + F.exp(-F.get("_scores", F.lit(0))))
        shares = [1.0 - p, p]
    else:
        shares = softmax(F.col("_scores"), model.classes)
    columns = columns.withColumns({f"probability_class_{i}": p for i, p in enumerate(shares)})
    best = F.greatest(*[F.col(f"probability_class_{i}") for i in range(model.classes)])
    first = F.coalesce(*[F.when(F.col(f"probability_class_{i}") == best, F.lit(float(i))) for i in range(model.classes)])
    return columns.withColumn("prediction", first).select(*df.columns, "prediction", *[f"probability_class_{i}" for i in range(model.classes)])


def tree_nodes(df: DataFrame, model: BoostedTrees) -> DataFrame:
    """The nodes of all trees: (round, class, node, feature, edge, value); leaves have no feature, inner nodes no value."""
    rows = []
    for turn, trees in enumerate(model.rounds):
        for k, tree in enumerate(trees):
            open_ = [0]
            while open_:
                node = open_.pop()
                f = tree.feature[node]
                if f < 0:
                    rows.append((turn, k, node, None, None, float(tree.value[node])))
                else:
                    # Rows below the edge go left.
                    rows.append((turn, k, node, model.features[f], float(model.edges[f][tree.bin[node]]), None))
                    open_ += [2 * node + 1, 2 * node + 2]
    return df.sparkSession.createDataFrame(rows, "round int, class int, node int, feature string, edge double, value double")
