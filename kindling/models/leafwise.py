"""Regression trees grown best-first on Spark: leaf limits, depth limits, forests and fold trees.

Rows are binned once.  Each pass over them evaluates one level of every tree at once: a grouped
histogram of (tree, node, feature, bin) with map-side combination, a running sum over each
feature's bins, and the best split per node, which is all that reaches the driver (bounded by
the models' sizes).  Best-first order needs no pass per leaf: a node is split among the first
``L - 1`` exactly when fewer than ``L - 1`` nodes have a greater least gain along their path, so a
level drops every node beyond that and the rest is expanded together.  Nodes of at most
``SMALL_NODE`` rows wait until only such are left; one grouped pass then grows each one's subtree
whole, by the same sums and the same order.  The driver at last pops nodes from a heap of gains;
the pop order answers every smaller leaf limit by truncation.

Labels are summed as whole numbers (scaled by a power of two), so counts, gains and splits don't depend on
how rows are partitioned; equal gains go to the first feature, then the lowest threshold.
"""

from __future__ import annotations

import heapq
import json
import math
from array import array
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindling.functions.columns import split_hash
from kindling.plans.materialize import materialize

MAX_BINS = 64
#: Thresholds of a feature with more distinct values than bins come from so many rows (in the mean), chosen by a hash.
BIN_SAMPLE = 50_000
#: Levels between two written copies of the rows' nodes.
WRITE_EVERY = 4
LABEL_BITS = 31
#: A node of so many rows at most is grown to its end by one task.
SMALL_NODE = 1 << 16
#: Poisson(1): a hash below the k-th bound (of 2^52) gives weight k.
POISSON = [int(2**52 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]


@dataclass
class Bins:
    """Thresholds per feature (a value falls left of a threshold it doesn't exceed) and the label's scale."""

    features: list[str]
    edges: list[list[float]]
    rows: int
    label_low: float
    label_scale: float


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def _edges(values: list[float], counts: list[int], max_bins: int) -> list[float]:
    """Midpoints between neighbouring values: all of them, or those nearest to equal counts."""
    if len(values) <= max_bins:
        cuts = range(len(values) - 1)
    else:
        upto, total = np.cumsum(counts), sum(counts)
        at = np.searchsorted(upto, [total * k / max_bins for k in range(1, max_bins)])
        cuts = sorted({int(i) for i in at if i < len(values) - 1})
    out = []
    for i in cuts:
        a, b = values[i], values[i + 1]
        mid = a + (b - a) / 2
        out.append(mid if a <= mid < b else a)
    return out


def find_bins(df: DataFrame, features: Sequence[str], label: str, max_bins: int = MAX_BINS, seed: int = 1) -> Bins:
    """Two passes: counts and ranges, then the distinct values of few-valued features and a hashed sample of the others.

    The sample depends on the rows' contents only; equal values are combined before they are collected.
    A NULL or NaN feature or label raises.
    """
    if not 2 <= max_bins <= 32_000:
        raise ValueError("max_bins must be from 2 to 32,000")
    cols = [*features, label]
    bad = [F.count_if(_double(c).isNull() | F.isnan(_double(c))).alias(f"bad{i}") for i, c in enumerate(cols)]
    kinds = [F.approx_count_distinct(_double(c)).alias(f"d{i}") for i, c in enumerate(features)]
    got = df.agg(F.count(F.lit(1)).alias("n"), F.min(_double(label)).alias("lo"), F.max(_double(label)).alias("hi"), *bad, *kinds).first()
    wrong = [c for i, c in enumerate(cols) if got[f"bad{i}"]]
    if wrong:
        raise ValueError(f"NULL or NaN in {wrong}: clean before fitting")
    if not got["n"]:
        raise ValueError("no rows to fit on")
    few = [got[f"d{i}"] <= 1.3 * max_bins + 5 for i in range(len(features))]
    chosen = F.pmod(F.xxhash64(F.lit(seed), *[_double(c) for c in cols]), F.lit(int(got["n"]))) < BIN_SAMPLE
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), (_double(c) + F.lit(0.0)).alias("v"), (F.lit(few[i]) | chosen).alias("use")) for i, c in enumerate(features)])
    seen: list[dict[float, int]] = [{} for _ in features]
    for r in df.select(F.inline(pairs)).where("use").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")).collect():
        seen[r["f"]][r["v"]] = r["n"]
    edges = []
    for s in seen:
        values = sorted(s)
        edges.append(_edges(values, [s[v] for v in values], max_bins))
    span = got["hi"] - got["lo"]
    bits = min(LABEL_BITS, 58 - int(got["n"]).bit_length())
    scale = 2.0 ** math.floor(bits - math.log2(span)) if span > 0 else 1.0
    return Bins(list(features), edges, int(got["n"]), float(got["lo"]), scale)


def binned(df: DataFrame, bins: Bins, label: str, keep: Sequence[Column] = ()) -> DataFrame:
    """(*keep, y, q, b0, b1, ...): the label, the label in whole steps, and each feature's bin."""
    k = range(len(bins.features))
    raw = df.select(*keep, _double(label).alias("y"), *[_double(c).alias(f"x{i}") for i, c in enumerate(bins.features)])
    # Bucketizer's ranges are closed on the left; a value equal to a threshold belongs to its left
    splits = [[-math.inf, *[math.nextafter(e, math.inf) for e in es], math.inf] for es in bins.edges]
    splits = [s if len(s) > 2 else [-math.inf, math.inf, math.inf] for s in splits]
    use = [i for i in k if bins.edges[i]]
    out = raw
    if use:
        out = Bucketizer(inputCols=[f"x{i}" for i in use], outputCols=[f"c{i}" for i in use], splitsArray=[splits[i] for i in use]).transform(raw)
    q = F.round((F.col("y") - bins.label_low) * bins.label_scale).cast("long")
    kept = [c for c in out.columns if c not in {f"x{i}" for i in k} | {f"c{i}" for i in k} | {"y"}]
    return out.select(*kept, "y", q.alias("q"), *[(F.col(f"c{i}") if i in use else F.lit(0)).cast("short").alias(f"b{i}") for i in k])


def _constant(values: Sequence, kind: str) -> Column:
    """An array as one literal, parsed once when the plan is folded."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Grown:
    """Nodes of all trees in one numbering: tree ``i`` has root ``i``; a node's right child follows its left one, -1 at a leaf.

    Columns are typed arrays: large limits give hundreds of thousands of nodes, which as Python objects fill the driver."""

    def __init__(self, trees: int):
        self.tree = array("i", range(trees))
        self.parent, self.feature, self.bin, self.left, self.order = (array("i", [-1] * trees) for _ in range(5))
        self.n, self.total, self.gain = array("q", [0] * trees), array("d", [0.0] * trees), array("d", [0.0] * trees)

    def split(self, v: int, counts: tuple, totals: tuple) -> list[int]:
        self.left[v] = len(self.left)
        for n, total in zip(counts, totals, strict=True):
            for column, value in ((self.tree, self.tree[v]), (self.parent, v), (self.feature, -1), (self.bin, -1), (self.left, -1), (self.order, -1),
                                  (self.n, n), (self.total, total), (self.gain, 0.0)):
                column.append(value)
        return [self.left[v], self.left[v] + 1]

    def pop(self, max_leaf_nodes: int | None) -> None:
        """Give nodes their places in best-first order, tree by tree; those beyond the leaf limit become leaves."""
        for root in (v for v, p in enumerate(self.parent) if p < 0):
            heap, place = [(-self.gain[root], root)] if self.left[root] >= 0 else [], 0
            while heap and (max_leaf_nodes is None or place < max_leaf_nodes - 1):
                _, v = heapq.heappop(heap)
                self.order[v], place = place, place + 1
                for c in (self.left[v], self.left[v] + 1):
                    if self.left[c] >= 0:
                        heapq.heappush(heap, (-self.gain[c], c))
        for v, o in enumerate(self.order):
            if o < 0:
                self.feature[v], self.left[v] = -1, -1


def _best_splits(rows: DataFrame, k: int, min_leaf: int) -> DataFrame:
    """(node, best) with best = (gain, -feature, -bin, and left and whole counts and sums); gain -1 where no split is valid."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").cast("int").alias("b")) for i in range(k)])
    hist = rows.select("node", "w", (F.col("w") * F.col("q")).alias("s"), (F.col("w") * F.col("y")).alias("t"), F.inline(pairs))
    hist = hist.groupBy("node", "f", "b").agg(*[F.sum(c).alias(c) for c in ("w", "s", "t")])
    of = Window.partitionBy("node", "f")
    upto = of.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.select("node", "f", "b", *[F.sum(c).over(upto).alias(f"{c}l") for c in ("w", "s", "t")], *[F.sum(c).over(of).alias(c) for c in ("w", "s", "t")])
    wl, wr = F.col("wl").cast("double"), (F.col("w") - F.col("wl")).cast("double")
    apart = F.col("sl") / wl - (F.col("s") - F.col("sl")) / wr
    gain = F.when((wl >= min_leaf) & (wr >= max(min_leaf, 1)), wl * wr / F.col("w") * apart * apart).otherwise(F.lit(-1.0))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "wl", "tl", "w", "t"))
    return run.groupBy("node").agg(best.alias("best"))


def _subtrees(rows: DataFrame, k: int, max_splits: int, min_split: int, min_leaf: int) -> DataFrame:
    """Splits of the subtrees below small nodes, each node's best-first: (node, id, gain, least, f, b, wl, tl, w, t).

    ``rows``: (node, room, least, w, y, q, b0, ...) with the levels that depth leaves and the least gain above.
    Ids number a subtree's nodes from its root, 0; the children of the j-th split are 2j + 1 and 2j + 2.
    Equal to what the histogram passes find: the same whole sums, the same formula, the same ties.
    """
    bins = [f"b{i}" for i in range(k)]

    def subtree(df):
        import heapq

        import numpy as np
        import pandas as pd

        x, w, q, y = df[bins].to_numpy().astype(np.int64), df["w"].to_numpy(), df["q"].to_numpy(), df["y"].to_numpy()
        width, wq, wy = int(x.max()) + 1 if k else 1, (w * q).astype(np.float64), w * y
        w = w.astype(np.float64)

        def best(at):
            found, n, s = None, w[at].sum(), wq[at].sum()
            for f in range(k):
                here = x[at, f]
                wl, sl = np.bincount(here, w[at], width).cumsum(), np.bincount(here, wq[at], width).cumsum()
                wr = n - wl
                can = (wl >= max(min_leaf, 1)) & (wr >= max(min_leaf, 1))
                if not can.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    apart = sl / wl - (s - sl) / wr
                    gain = np.where(can, wl * wr / n * apart * apart, -1.0)
                b = int(gain.argmax())
                if gain[b] > 0 and (found is None or gain[b] > found[0]):
                    found = (float(gain[b]), f, b)
            return found

        heap, out, room = [], [], int(df["room"].iloc[0])

        def offer(ident, at, depth, least):
            if depth < room and w[at].sum() >= min_split:
                found = best(at)
                if found:
                    heapq.heappush(heap, (-found[0], ident, at, depth, min(found[0], least), found))

        offer(0, np.arange(len(df)), 0, float(df["least"].iloc[0]))
        while heap and len(out) < max_splits:
            _, ident, at, depth, least, (gain, f, b) = heapq.heappop(heap)
            left = x[at, f] <= b
            out.append((int(df["node"].iloc[0]), ident, gain, least, f, b, int(w[at[left]].sum()), float(wy[at[left]].sum()), int(w[at].sum()), float(wy[at].sum())))
            j = len(out) - 1
            offer(2 * j + 1, at[left], depth + 1, least)
            offer(2 * j + 2, at[~left], depth + 1, least)
        got = pd.DataFrame(out, columns=["node", "id", "gain", "least", "f", "b", "wl", "tl", "w", "t"])
        return got.assign(j=range(len(got)))

    schema = "node int, j int, id int, gain double, least double, f int, b int, wl long, tl double, w long, t double"
    return rows.groupBy("node").applyInPandas(lambda df: subtree(df)[["node", "j", "id", "gain", "least", "f", "b", "wl", "tl", "w", "t"]], schema)


def grow(rows: DataFrame, bins: Bins, trees: int, max_leaf_nodes: int | None = None, max_depth: int | None = None,
         min_samples_split: int = 2, min_samples_leaf: int = 1, small_node: int = SMALL_NODE) -> Grown:
    """Grow ``trees`` trees on ``rows`` of (tree, w, y, q, b0, ...); a row counts ``w`` times in its tree.

    Rows keep the node that they had when they were last written; a pass leads them on from there by
    the splits made since, held as constant arrays (as large as the models, not the data).
    """
    if max_leaf_nodes is not None and max_leaf_nodes < 2:
        raise ValueError("max_leaf_nodes must be >= 2")
    k, g, level, limit = len(bins.features), Grown(trees), 0, math.inf if max_leaf_nodes is None else max_leaf_nodes - 1
    least: list[dict[int, float]] = [{} for _ in range(trees)]  # least gain along the path of every node that can be split
    depth = [0] * trees
    cols = ["w", "y", "q", *[f"b{i}" for i in range(k)]]
    written, since = rows.where("w > 0").select(F.col("tree").cast("int").alias("node"), *cols), 0
    now, waiting = [v for v in range(trees) if bins.rows > small_node], [v for v in range(trees) if bins.rows <= small_node]

    def led_on(nodes: list[int], *more: Column) -> DataFrame:
        """The rows that are in one of ``nodes`` now."""
        wanted = set(nodes)
        feature, cut, left = (_constant(v, "int") for v in (g.feature, g.bin, g.left))
        own = F.array(F.array(*[F.col(f"b{i}").cast("int") for i in range(k)]))
        down = lambda x: lambda v, _: F.when(F.get(left, v) >= 0, F.get(left, v) + (F.get(x, F.get(feature, v)) > F.get(cut, v)).cast("int")).otherwise(v)
        node = F.get(F.transform(own, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(since)), F.col("node"), down(x))), F.lit(0)) if since else F.col("node")
        asked = _constant([int(v in wanted) for v in range(len(g.left))], "int")
        return written.select(node.alias("node"), *cols).where(F.get(asked, F.col("node")) == 1).select("*", *more)

    def bounds() -> list[float]:
        """Per tree the gain that a path must reach; below it no node is among the first that are split."""
        return [heapq.nlargest(int(limit), own.values())[-1] if len(own) >= limit else -math.inf for own in least]

    while now:
        ready: list[tuple[int, tuple]] = []
        for r in _best_splits(led_on(now), k, min_samples_leaf).collect():
            v, best = r["node"], r["best"]
            g.n[v], g.total[v] = best["w"], best["t"]
            if best["gain"] > 0 and best["w"] >= min_samples_split:
                g.gain[v], g.feature[v], g.bin[v] = best["gain"], -best["f"], -best["b"]
                own = least[g.tree[v]]
                own[v] = min(best["gain"], own.get(g.parent[v], math.inf))
                ready.append((v, best))
        bound, made = bounds(), []
        for v, best in sorted(ready):
            if least[g.tree[v]][v] >= bound[g.tree[v]]:
                made += g.split(v, (best["wl"], best["w"] - best["wl"]), (best["tl"], best["t"] - best["tl"]))
                depth += [level + 1] * 2
        level += 1
        if level == max_depth:
            break
        now = [v for v in made if g.n[v] > small_node]
        waiting += [v for v in made if g.n[v] <= small_node]
        since += 1
        if since == WRITE_EVERY and now:
            written, since = materialize(led_on(now + waiting), "nodes"), 0

    bound = bounds()
    above = lambda v: least[g.tree[v]].get(g.parent[v], math.inf)
    waiting = [v for v in waiting if above(v) >= bound[g.tree[v]] and (max_depth is None or depth[v] < max_depth)]
    if waiting:
        room = _constant([(1 << 30 if max_depth is None else max_depth) - d for d in depth], "int")
        over = _constant([above(v) if above(v) < math.inf else 1.7e308 for v in range(len(g.left))], "double")
        found = _subtrees(led_on(waiting, F.get(room, F.col("node")).alias("room"), F.get(over, F.col("node")).alias("least")), k,
                          1 << 30 if max_leaf_nodes is None else max_leaf_nodes - 1, min_samples_split, min_samples_leaf)
        if max_leaf_nodes is not None:  # of all trees' subtrees only what can be among the first comes to the driver
            found = materialize(found.withColumn("tree", F.get(_constant(g.tree, "int"), F.col("node"))), "subtrees")
            top = [found.where(F.col("tree") == t).orderBy(F.col("least").desc()).select("least").limit(max_leaf_nodes - 1).agg(F.min("least").alias("m")).first()["m"] for t in range(trees)]
            floor = _constant([max(b if b > -math.inf else -1.0, -1.0 if m is None else m) for b, m in zip(bound, top, strict=True)], "double")
            found = found.where(F.col("least") >= F.get(floor, F.col("tree")))
        got = found.select("node", "id", "j", "gain", "f", "b", "wl", "tl", "w", "t").toArrow()
        got = {c: got.column(c).to_numpy() for c in got.column_names}  # columns, not an object for each split
        by_root = np.lexsort((got["id"], got["node"]))
        starts = np.flatnonzero(np.diff(got["node"][by_root], prepend=-1))
        for at in np.split(by_root, starts)[1:]:
            own = dict(zip(got["id"][at].tolist(), at.tolist(), strict=True))
            todo = deque([(int(got["node"][at[0]]), 0)])
            while todo:
                v, ident = todo.popleft()
                i = own.get(ident)
                if i is not None:
                    n, total, nl, left, j = (got[c][i].item() for c in ("w", "t", "wl", "tl", "j"))
                    g.n[v], g.total[v], g.gain[v], g.feature[v], g.bin[v] = n, total, got["gain"][i], got["f"][i], got["b"][i]
                    a, b = g.split(v, (nl, n - nl), (left, total - left))
                    todo += [(a, 2 * j + 1), (b, 2 * j + 2)]
    if any(not n for n in g.n[:trees]):  # a root that can't be split has no counts yet
        for r in rows.where("w > 0").groupBy("tree").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("t")).collect():
            if not g.n[r["tree"]]:
                g.n[r["tree"]], g.total[r["tree"]] = r["n"], r["t"]
    g.pop(max_leaf_nodes)
    return g


class _Column(array):
    """A typed array that equals any sequence of the same values."""

    __hash__ = None

    def __eq__(self, other):
        return len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))


@dataclass
class TreeModel:
    """One or several trees as parallel arrays; ``transform`` adds the mean of their predictions."""

    features: list[str]
    roots: list[int]
    feature: Sequence[int]
    threshold: Sequence[float]
    left: Sequence[int]
    value: Sequence[float]
    n: Sequence[int]
    gain: Sequence[float]
    order: Sequence[int]
    depth: int

    def __post_init__(self):
        for name, kind in (("feature", "i"), ("threshold", "d"), ("left", "i"), ("value", "d"), ("n", "q"), ("gain", "d"), ("order", "i")):
            setattr(self, name, _Column(kind, getattr(self, name)))

    @classmethod
    def of(cls, g: Grown, bins: Bins, trees: int = 1) -> TreeModel:
        """The nodes that truncation has left, tree by tree, children side by side."""
        reach, new, depth = array("i"), array("i", [-1]) * len(g.left), array("i", [0]) * len(g.left)
        for root in range(trees):
            at = len(reach)
            reach.append(root)
            new[root] = at
            while at < len(reach):
                v, at = reach[at], at + 1
                if g.left[v] >= 0:
                    for c in (g.left[v], g.left[v] + 1):
                        new[c], depth[c] = len(reach), depth[v] + 1
                        reach.append(c)
        inner = lambda v: g.left[v] >= 0
        return cls(list(bins.features), [new[r] for r in range(trees)], (g.feature[v] for v in reach),
                   (bins.edges[g.feature[v]][g.bin[v]] if inner(v) else 0.0 for v in reach), (new[g.left[v]] if inner(v) else -1 for v in reach),
                   (g.total[v] / g.n[v] if g.n[v] else 0.0 for v in reach), (g.n[v] for v in reach),
                   (g.gain[v] if inner(v) else 0.0 for v in reach), (g.order[v] for v in reach), max(depth))

    @property
    def num_leaves(self) -> list[int]:
        ends = [*self.roots[1:], len(self.left)]
        return [sum(x < 0 for x in self.left[a:b]) for a, b in zip(self.roots, ends, strict=True)]

    def importances(self) -> list[float]:
        """Mean over trees of each feature's share of the tree's gains."""
        ends, sums = [*self.roots[1:], len(self.left)], np.zeros(len(self.features))
        for a, b in zip(self.roots, ends, strict=True):
            own = np.zeros(len(self.features))
            for f, g in zip(self.feature[a:b], self.gain[a:b], strict=True):
                if f >= 0:
                    own[f] += g
            sums += own / own.sum() if own.sum() else own
        return (sums / sums.sum() if sums.sum() else sums).tolist()

    def node_of(self, roots: Column, max_leaf_nodes: int | None = None) -> Column:
        """The leaf's number for each of the ``roots`` (an array), in JVM expressions over constant arrays.

        ``max_leaf_nodes`` stops at nodes split later than that limit allows.
        """
        feature, left, threshold = _constant(self.feature, "int"), _constant(self.left, "int"), _constant(self.threshold, "double")
        inner = lambda v: F.get(left, v) >= 0
        if max_leaf_nodes is not None:
            order = _constant(self.order, "int")
            inner = lambda v: (F.get(left, v) >= 0) & (F.get(order, v) < max_leaf_nodes - 1)
        steps = F.sequence(F.lit(1), F.lit(max(self.depth, 1)))
        row = F.array(F.array(*[_double(c) for c in self.features]))
        down = lambda x: lambda v, _: F.when(inner(v), F.get(left, v) + (F.get(x, F.get(feature, v)) > F.get(threshold, v)).cast("int")).otherwise(v)
        return F.get(F.transform(row, lambda x: F.transform(roots, lambda r: F.aggregate(steps, r, down(x)))), F.lit(0))

    def predicted(self, roots: Column | None = None, max_leaf_nodes: int | None = None) -> Column:
        at = self.node_of(F.array(*[F.lit(r) for r in self.roots]) if roots is None else roots, max_leaf_nodes)
        value = _constant(self.value, "double")
        return F.aggregate(F.transform(at, lambda v: F.get(value, v)), F.lit(0.0), lambda a, b: a + b) / F.size(at)

    def transform(self, df: DataFrame) -> DataFrame:
        missing = F.lit(False)
        for c in self.features:
            missing = missing | _double(c).isNull() | F.isnan(_double(c))
        prediction = F.when(missing, F.raise_error(F.lit("a feature is NULL or NaN")).cast("double")).otherwise(self.predicted())
        return df.withColumn("prediction", prediction)

    def save(self, spark: SparkSession, path: str) -> None:
        head = {"kind": "leafwise trees", "features": self.features, "roots": self.roots, "depth": self.depth}
        nodes = list(enumerate(zip(self.feature, self.threshold, self.left, self.value, self.n, self.gain, self.order, strict=True)))
        schema = "node int, feature int, threshold double, `left` int, value double, n long, gain double, place int"
        spark.createDataFrame([(i, *row) for i, row in nodes], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        head = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        rows = spark.read.parquet(f"{path}/nodes").orderBy("node").collect()
        cols = [[r[c] for r in rows] for c in ("feature", "threshold", "left", "value", "n", "gain", "place")]
        return cls(head["features"], head["roots"], *cols, head["depth"])


def _weight(h: Column) -> Column:
    """Poisson(1) weight from a 32-digit hash."""
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("long")
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[k], F.lit(k)).otherwise(out)
    return out.cast("long")


def fit_leafwise(train: DataFrame, features: Sequence[str], label: str, max_leaf_nodes: int | None = None, max_depth: int | None = None,
                 min_samples_split: int = 2, min_samples_leaf: int = 1, max_bins: int = MAX_BINS) -> TreeModel:
    """M4: the best-first tree of at most ``max_leaf_nodes`` leaves."""
    bins = find_bins(train, features, label, max_bins)
    rows = materialize(binned(train, bins, label, [F.lit(0).alias("tree"), F.lit(1).cast("long").alias("w")]), "binned")
    return TreeModel.of(grow(rows, bins, 1, max_leaf_nodes, max_depth, min_samples_split, min_samples_leaf), bins)


def fit_hashed_forest(train: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str] = (), n_estimators: int = 100, max_depth: int | None = None,
                      random_state: int = 1, bootstrap: bool = True, max_leaf_nodes: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
                      max_bins: int = MAX_BINS) -> TreeModel:
    """M5: trees on Poisson(1) resamples.  A row's weight in a tree is a function of seed, tree and key
    (of its features and label where no key is given: then equal rows weigh alike), so the forest
    doesn't depend on partitions, cores or retries.  All trees grow in the same passes."""
    bins = find_bins(train, features, label, max_bins)
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols or [*features, label])]
    rows = binned(train, bins, label, key)
    names = [f"k{i}" for i in range(len(key))]
    weights = [F.struct(F.lit(t).alias("tree"), (_weight(split_hash(f"{random_state}:{t}", *names)) if bootstrap else F.lit(1).cast("long")).alias("w")) for t in range(n_estimators)]
    rows = rows.select("*", F.inline(F.array(*weights))).where("w > 0").drop(*names)
    return TreeModel.of(grow(materialize(rows, "resampled"), bins, n_estimators, max_leaf_nodes, max_depth, min_samples_split, min_samples_leaf), bins, n_estimators)


def cv_leaf_limits(train: DataFrame, features: Sequence[str], label: str, fold_col: str, folds: int, leaf_grid: Sequence[int], max_bins: int = MAX_BINS) -> list[float]:
    """M7: mean over folds of the held-out MAE for each leaf limit, from one tree per fold grown to the largest limit."""
    bins = find_bins(train, features, label, max_bins)
    fold = F.col(fold_col).cast("int")
    rows = binned(train, bins, label, [fold.alias("fold")])
    rows = rows.select("*", F.explode(F.array(*[F.lit(k) for k in range(folds)])).alias("tree")).where("tree <> fold")
    rows = rows.drop("fold").withColumn("w", F.lit(1).cast("long"))
    model = TreeModel.of(grow(materialize(rows, "fold-rows"), bins, folds, max(leaf_grid)), bins, folds)
    held = _limit_errors(train.where(fold.between(0, folds - 1)), model, fold, label, leaf_grid)
    got = held.agg(*[F.avg(f"e{i}") for i in range(len(leaf_grid))]).first()
    return [float(x) for x in got]


def _limit_errors(held: DataFrame, model: TreeModel, fold: Column, label: str, leaf_grid: Sequence[int]) -> DataFrame:
    """(held, e0, e1, ...): of each fold the mean absolute error of its rows by its own tree, for each leaf limit.

    The trees go to the tasks as arrays, once, and one way down answers all limits: the node that a
    limit stops at lies on the way to that of the next larger one.
    """
    by_size = sorted(range(len(leaf_grid)), key=lambda i: leaf_grid[i])
    limits = [leaf_grid[i] for i in by_size]
    columns = [np.asarray(c) for c in (model.roots, model.feature, model.threshold, model.left, model.value, model.order)]
    sent = held.sparkSession.sparkContext.broadcast(columns)

    def errors(batches):
        import numpy as np
        import pyarrow as pa

        roots, feature, threshold, left, value, order = sent.value
        for b in batches:
            of, y, *xs = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(of):
                continue
            x, at = np.stack(xs, axis=1), roots[of]
            sums, n = {}, np.bincount(of)
            for limit, i in zip(limits, by_size, strict=True):
                go = np.arange(len(of))
                while len(go):
                    here = at[go]
                    on = (left[here] >= 0) & (order[here] < limit - 1)
                    go, here = go[on], here[on]
                    at[go] = left[here] + (x[go, feature[here]] > threshold[here])
                sums[i] = np.bincount(of, np.abs(y - value[at]))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64()), *[pa.array(sums[i][seen], pa.float64()) for i in range(len(sums))]],
                                             names=["held", "n", *[f"e{i}" for i in range(len(sums))]])

    names = [f"e{i}" for i in range(len(leaf_grid))]
    rows = held.select(fold.alias("held"), _double(label).alias("y"), *[_double(c).alias(f"x{i}") for i, c in enumerate(model.features)])
    parts = rows.mapInArrow(errors, "held int, n long, " + ", ".join(f"{e} double" for e in names))
    return parts.groupBy("held").agg(*[(F.sum(e) / F.sum("n")).alias(e) for e in names])
