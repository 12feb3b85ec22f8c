"""Best-first trees, fold trees and hashed forests against plain-Python versions."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.models import leafwise
from kindling.models.specs import ModelSpec, fit_model, load_model, save_model
from kindling.operators.split import contiguous_fold_column, split_cut

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        a, b, c = rng.uniform(0, 1), rng.randint(0, 6), float(rng.randint(0, 2))
        rows.append((i, a, b, c, round(40 * math.sin(6 * a) + 5 * b * (c == 1) + rng.gauss(0, 3), 3)))
    return spark.createDataFrame(rows, "id long, a double, b int, c double, y double").repartition(3)


def _plain_tree(x, q, y, w, max_leaf_nodes=None, max_depth=None, min_split=2, min_leaf=1):
    """Splits in best-first order as (feature, bin, left count, right count), by trying every threshold of every node."""
    def best(at):
        n, s = int(w[at].sum()), int((w * q)[at].sum())
        found = None
        for f in range(x.shape[1]):
            for b in sorted(set(x[at, f].tolist())):
                left = at[x[at, f] <= b]
                wl, sl = int(w[left].sum()), int((w * q)[left].sum())
                if wl >= min_leaf and n - wl >= max(min_leaf, 1):
                    apart = float(sl) / wl - float(s - sl) / (n - wl)
                    gain = float(wl) * float(n - wl) / n * apart * apart
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, f, b)
        return found

    out, heap, tick = [], [], 0

    def offer(at, depth):
        nonlocal tick
        if w[at].sum() >= min_split and (max_depth is None or depth < max_depth):
            found = best(at)
            if found:
                tick += 1
                heapq.heappush(heap, (-found[0], tick, at, depth, found))

    offer(np.flatnonzero(w > 0), 0)
    while heap and (max_leaf_nodes is None or len(out) < max_leaf_nodes - 1):
        _, _, at, depth, (gain, f, b) = heapq.heappop(heap)
        left, right = at[x[at, f] <= b], at[x[at, f] > b]
        out.append((f, b, int(w[left].sum()), int(w[right].sum())))
        offer(left, depth + 1)
        offer(right, depth + 1)
    return out


def _arrays(df, bins, *keep):
    rows = leafwise.binned(df, bins, "y", [F.col(c) for c in keep]).toPandas().sort_values(list(keep) or ["y"])
    return rows, rows[[f"b{i}" for i in range(len(FEATS))]].to_numpy(), rows["q"].to_numpy(), rows["y"].to_numpy()


def _splits(g, tree=0):
    at = sorted((o, v) for v, o in enumerate(g.order) if o >= 0 and g.tree[v] == tree)
    return [(g.feature[v], g.bin[v], g.n[g.left[v]], g.n[g.left[v] + 1]) for _, v in at]


def _one_tree(rows):
    return rows.withColumn("tree", F.lit(0)).withColumn("w", F.lit(1).cast("long"))


@pytest.mark.parametrize("small", [0, 200, 1 << 16])
@pytest.mark.parametrize("limits", [{"max_leaf_nodes": 2}, {"max_leaf_nodes": 17}, {"max_leaf_nodes": 120}, {"max_depth": 4}, {"max_leaf_nodes": 30, "max_depth": 5},
                                    {"max_leaf_nodes": 40, "min_samples_split": 60, "min_samples_leaf": 9}])
def test_best_first_equals_plain_tree(spark, table, small, limits):
    """Whether nodes are split by histogram passes or in one task, the splits and their order are the same."""
    if small == 0 and limits.get("max_leaf_nodes") == 120:
        pytest.skip("as many levels, one by one")
    bins = leafwise.find_bins(table, FEATS, "y", 16)
    g = leafwise.grow(_one_tree(leafwise.binned(table, bins, "y")), bins, 1, small_node=small, **limits)
    _, x, q, y = _arrays(table, bins)
    plain = {"max_leaf_nodes": limits.get("max_leaf_nodes"), "max_depth": limits.get("max_depth"), "min_split": limits.get("min_samples_split", 2), "min_leaf": limits.get("min_samples_leaf", 1)}
    assert _splits(g) == _plain_tree(x, q, y, np.ones(len(y), np.int64), **plain)
    model = leafwise.TreeModel.of(g, bins)
    if "max_leaf_nodes" in limits and "max_depth" not in limits and "min_samples_leaf" not in limits:
        assert model.num_leaves == [limits["max_leaf_nodes"]]
    # leaf values are means of the leaf's labels, and thresholds divide the raw values as the bins do
    got = model.transform(table).groupBy("prediction").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r.prediction - r.m) < 1e-9 for r in got) and len(got) == model.num_leaves[0]


def test_truncation_answers_every_smaller_limit(spark, table):
    bins = leafwise.find_bins(table, FEATS, "y", 16)
    rows = _one_tree(leafwise.binned(table, bins, "y"))
    large = leafwise.TreeModel.of(leafwise.grow(rows, bins, 1, 60), bins)
    for limit in (2, 9, 33):
        own = leafwise.TreeModel.of(leafwise.grow(rows, bins, 1, limit), bins)
        same = table.select(F.abs(large.predicted(max_leaf_nodes=limit) - own.predicted()).alias("d")).agg(F.max("d")).first()[0]
        assert same < 1e-12


def test_fold_trees_equal_plain_cross_validation(spark, table):
    folded = contiguous_fold_column(table, "id", 5, 1)
    grid = [2, 7, 20, 45]
    got = leafwise.cv_leaf_limits(folded, FEATS, "y", "fold", 5, grid, 16)
    bins = leafwise.find_bins(folded, FEATS, "y", 16)
    rows, x, q, y = _arrays(folded, bins, "fold", "id")
    fold = rows["fold"].to_numpy()
    for limit, mae in zip(grid, got, strict=True):
        per_fold = []
        for k in range(5):
            w = (fold != k).astype(np.int64)
            per_fold.append(_held_out_error(x, q, y, w, limit))
        assert abs(mae - np.mean(per_fold)) < 1e-9
    assert len(set(got)) == 4


def test_fold_trees_stay_out_of_plans(spark, table, monkeypatch):
    """Held-out rows meet the trees in the tasks: as constants of a plan, one copy per limit and column, they fill the driver."""
    sizes, constant = [], leafwise._constant
    monkeypatch.setattr(leafwise, "_constant", lambda values, kind: sizes.append(len(values)) or constant(values, kind))
    folded = contiguous_fold_column(table, "id", 5, 1)
    errors = leafwise.cv_leaf_limits(folded, FEATS, "y", "fold", 5, [300, 20, 300], 64)
    assert max(sizes) <= 5 and errors[0] == errors[2] != errors[1]  # five roots, not five trees of 599 nodes
    assert abs(errors[1] - leafwise.cv_leaf_limits(folded, FEATS, "y", "fold", 5, [20], 64)[0]) < 1e-9


def _held_out_error(x, q, y, w, limit):
    """Best-first tree on the rows of weight 1, mean absolute error on the others."""
    nodes, heap, tick = [np.arange(len(y))], [], 0

    def best(at):
        inside = at[w[at] > 0]
        n, s, found = len(inside), int(q[inside].sum()), None
        for f in range(x.shape[1]):
            for b in sorted(set(x[inside, f].tolist())):
                left = inside[x[inside, f] <= b]
                if 0 < len(left) < n:
                    apart = float(int(q[left].sum())) / len(left) - float(s - int(q[left].sum())) / (n - len(left))
                    gain = float(len(left)) * float(n - len(left)) / n * apart * apart
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, f, b)
        return found

    def offer(at):
        nonlocal tick
        found = best(at)
        if found:
            tick += 1
            heapq.heappush(heap, (-found[0], tick, at, found))

    offer(nodes[0])
    leaves = {id(nodes[0]): nodes[0]}
    for _ in range(limit - 1):
        if not heap:
            break
        _, _, at, (_, f, b) = heapq.heappop(heap)
        del leaves[id(at)]
        for part in (at[x[at, f] <= b], at[x[at, f] > b]):
            leaves[id(part)] = part
            nodes.append(part)
            offer(part)
    errors = [abs(y[i] - y[at[w[at] > 0]].mean()) for at in leaves.values() for i in at if not w[i]]
    return float(np.mean(errors))


def test_forest_does_not_follow_partitions(spark, table):
    models = [leafwise.fit_hashed_forest(table.repartition(n, "b") if n > 1 else table.coalesce(1), FEATS, "y", ["id"], 4, 5, random_state=7, max_bins=16) for n in (1, 4, 8)]
    for m in models[1:]:
        assert (m.feature, m.threshold, m.left, m.n, m.roots) == (models[0].feature, models[0].threshold, models[0].left, models[0].n, models[0].roots)
        assert np.allclose(m.value, models[0].value, rtol=1e-12)
    other = leafwise.fit_hashed_forest(table, FEATS, "y", ["id"], 4, 5, random_state=8, max_bins=16)
    assert other.n != models[0].n
    roots = [models[0].n[r] for r in models[0].roots]
    assert len(set(roots)) > 1 and all(abs(n - 1500) < 200 for n in roots)  # Poisson resamples of 1,500 rows


def test_forest_trees_equal_plain_trees_on_their_weights(spark, table):
    bins = leafwise.find_bins(table, FEATS, "y", 16)
    names = ["id"]
    weighed = leafwise.binned(table, bins, "y", [F.col("id"), leafwise._weight(leafwise.split_hash("3:1", *names)).alias("w")])
    pdf = weighed.toPandas().sort_values("id")
    model = leafwise.fit_hashed_forest(table, FEATS, "y", ["id"], 2, 3, random_state=3, max_bins=16)
    want = _plain_tree(pdf[["b0", "b1", "b2"]].to_numpy(), pdf["q"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy(), max_depth=3)
    a = model.roots[1]
    inner = [(model.feature[v], model.n[model.left[v]], model.n[model.left[v] + 1]) for v in range(a, len(model.left)) if model.left[v] >= 0]
    assert sorted(inner) == sorted((f, wl, wr) for f, _, wl, wr in want)
    assert set(pdf["w"]) >= {0, 1, 2, 3} and abs(pdf["w"].mean() - 1) < 0.1


def test_bins(spark):
    df = spark.createDataFrame([(float(v), v % 3, 1.0 * v) for v in range(1000)] + [(5.0, 1, 2.0)] * 500, "a double, b int, y double")
    bins = leafwise.find_bins(df, ["a", "b"], "y", 8)
    assert bins.edges[1] == [0.5, 1.5] and len(bins.edges[0]) <= 7
    assert df.count() == bins.rows
    flat = leafwise.find_bins(df.withColumn("y", F.lit(3.0)), ["a"], "y")
    m = leafwise.fit_leafwise(df.withColumn("y", F.lit(3.0)), ["a"], "y", 10)
    assert flat.label_scale == 1.0 and m.num_leaves == [1] and m.value == [3.0]
    assert {r.prediction for r in m.transform(df).collect()} == {3.0}
    for bad in ("null", "nan"):
        odd = df.withColumn("a", F.when(F.col("a") == 7, F.lit(None) if bad == "null" else F.lit(float("nan"))).otherwise(F.col("a")))
        with pytest.raises(ValueError):
            leafwise.find_bins(odd, ["a", "b"], "y")
        with pytest.raises(Exception, match="NULL or NaN"):
            leafwise.fit_leafwise(df, ["a"], "y", 3).transform(odd).collect()
    with pytest.raises(ValueError):
        leafwise.find_bins(df.limit(0), ["a"], "y")
    with pytest.raises(ValueError):
        leafwise.fit_leafwise(df, ["a"], "y", 1)


def test_infinite_and_repeated_values(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), 0.0), (0.0, 0.5), (-0.0, 0.5), (1e308, 1.0), (-1e308, 0.0)] * 20, "a double, y double")
    m = leafwise.fit_leafwise(df, ["a"], "y", 8)
    assert all(abs(r.prediction - r.y) < 1e-12 for r in m.transform(df).collect())


def test_saved_trees_load(spark, table, tmp_path):
    spec = ModelSpec("t", "DecisionTreeRegressor", {"max_leaf_nodes": 12, "min_samples_split": 5, "random_state": 1})
    m = fit_model(table, spec, FEATS, "y")
    again = load_model(save_model(m, str(tmp_path / "m")))
    assert again == m
    a = m.transform(table.select("id", "c", "b", "a")).orderBy("id").collect()
    assert [r.prediction for r in a] == [r.prediction for r in m.transform(table).orderBy("id").collect()]


def test_contiguous_folds(spark, table):
    for folds in (2, 5, 7):
        got = contiguous_fold_column(table, "id", folds, 3).select("id", "fold", leafwise.split_hash(3, "id").alias("h")).orderBy("h", "id").collect()
        want = [len(p) * [k] for k, p in enumerate(np.array_split(np.arange(1500), folds))]
        assert [r.fold for r in got] == [k for part in want for k in part]
    with pytest.raises(ValueError):
        contiguous_fold_column(table.limit(3), "id", 5)
    n, n_test, cut = split_cut(table, ["id"], 0.2, 3)
    fold0 = contiguous_fold_column(table, "id", 5, 3).where("fold = 0")
    assert n_test == 300 and fold0.where(leafwise.split_hash(3, "id") > cut[0]).isEmpty()
