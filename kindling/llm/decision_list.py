"""Quality rules as learned decision lists (3), in Spark expressions throughout.

Sequential covering, in the manner of RIPPER (Cohen, 1995): each rule is a conjunction of
thresholds on text statistics, grown condition by condition by FOIL's gain on two thirds of the
labelled rows, then cut back to the prefix that does best on the last third; rows that it covers
are set aside, and rules follow until none is precise enough.  Conditions are first sought at each
class's quantiles over all labelled rows.  If that gives no precise rule, the rows that are left and
that the rule covers so far are binned anew for every condition, with the classes' tails and ends as
edges too, and the chosen threshold's bins again within themselves; if that gives none either, only
precise conditions are grown.  Every step is one grouped count, so only counts by (statistic, bin) come
to the driver.  The list becomes an ordered CASE WHEN.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, mix, table
from kindling.llm.text_stats import with_text_stats

BINS, MAX_CONDITIONS, MAX_RULES = 24, 4, 12
#: Quantiles near the ends that are edges as well, and how often the chosen threshold's bins are binned again.
TAILS, REFINEMENTS = (0.001, 0.003, 0.01, 0.02), 2
#: A rule stays if this share of the pruning rows that it covers is to be rejected, and it covers so many.
MIN_PRECISION, MIN_COVERED = 0.98, 5
#: The base rule: fewer words, or a larger share (per cent) of words in repeated runs, fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def ratios() -> dict[str, Column]:
    """The statistics that conditions are on; 0 where a text has no words."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbols_per_char": per("n_symbols", "word_chars"), "upper_per_char": per("n_upper", "word_chars"),
            "repeated_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct", "n_words"),
            "chars_per_word": per("word_chars", "n_words"), "dup_lines_per_word": per("n_dup_lines", "n_words"),
            "words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = ratios()[self.name]
        return c > self.threshold if self.above else c <= self.threshold


@dataclass
class DecisionList:
    rules: list[list[Condition]]

    def column(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            out = F.when(_all(self.rules[k - 1]), k).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(f"{c.name} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r)
                         for k, r in enumerate(self.rules, 1))


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame) -> DecisionList:
    """A list from rows of text statistics with ``reject`` (0 or 1) and ``grow`` (boolean).

    Empty tables, and labels of one kind only, give the empty list.
    """
    if labelled.select("reject").distinct().count() < 2:
        return DecisionList([])
    scratch = Scratch(labelled.sparkSession, "rules")
    rows = scratch.write(labelled, "labelled")
    coarse = _edges(rows, ratios(), False)
    listed = DecisionList([])
    while len(listed.rules) < MAX_RULES:
        left = rows.where(listed.column().isNull()) if listed.rules else rows
        tries = (_prune(left.where("not grow"), _grow(left.where("grow"), *how)) for how in ((coarse, 0.0), (None, 0.0), (None, MIN_PRECISION)))
        rule = next(filter(None, tries), [])
        if not rule:
            break
        listed.rules.append(rule)
    scratch.drop(rows)
    return listed


def _edges_below(edges: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))


def _edges(rows: DataFrame, values: dict[str, Column], fine: bool) -> dict[str, list[float]]:
    """Each class's quantiles; if ``fine`` its tails, least and greatest value too."""
    at = [k / BINS for k in range(1, BINS)]
    quantiles = lambda c: F.percentile_approx(c, at, 2000)
    if fine:
        at = sorted({*at, *TAILS, *(1 - t for t in TAILS)})
        quantiles = lambda c: F.array_union(F.percentile_approx(c, at, 10_000), F.array(F.min(c), F.max(c)))
    got = rows.groupBy("reject").agg(*[quantiles(c).alias(n) for n, c in values.items()]).collect()
    return {n: sorted({v for r in got for v in r[n]}) for n in values}


def _counts(rows: DataFrame, values: dict[str, Column], edges: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(to reject, to keep) by bin; a value's bin: how many edges are below it."""
    bins = F.array(*[_edges_below(edges[n], c) for n, c in values.items()])
    got = (rows.select("reject", F.posexplode(bins).alias("stat", "bin")).groupBy("stat", "bin")
           .agg(F.sum("reject").alias("p"), F.sum(1 - F.col("reject")).alias("n")).collect())
    of = [[(0, 0)] * (len(edges[n]) + 1) for n in values]
    for r in got:
        of[r.stat][r.bin] = (r.p, r.n)
    return dict(zip(values, of, strict=True))


def _cuts(edges: list[float], by_bin: list[tuple[int, int]], below: tuple[int, int], total: tuple[int, int],
          precise: float) -> Iterator[tuple[float, int, bool, tuple[int, int]]]:
    """(gain, edge's number, above, counts up to the edge before it) of the conditions that cover enough
    and of which ``precise`` is to be rejected; ``below`` lie under all edges' bins."""
    (p, q), (p0, n0) = below, total
    for k, (dp, dn) in enumerate(by_bin[:len(edges)]):  # values up to this edge
        before, p, q = (p, q), p + dp, q + dn
        for above, x, y in ((False, p, q), (True, p0 - p, n0 - q)):
            if x >= MIN_COVERED and x >= precise * (x + y):
                yield _gain(p0, n0, x, y), k, above, before


def _grow(rows: DataFrame, fixed: dict[str, list[float]] | None, precise: float) -> list[Condition]:
    """A rule of conditions at ``fixed`` edges, else at edges of the rows it covers, refined."""
    last = 0 if fixed else REFINEMENTS
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        held, values = rows.where(_all(rule)), ratios()
        edges = fixed or _edges(held, values, True)
        if not all(edges.values()):
            break
        counts = _counts(held, values, edges)
        total = tuple(sum(x[k] for x in counts["words"]) for k in (0, 1))
        if not all(total):
            break
        best, name = max(((c, n) for n in values for c in _cuts(edges[n], counts[n], (0, 0), total, precise)),
                         key=lambda x: x[0][0], default=(None, ""))
        if best is None or best[0] <= 1e-9:
            break
        value, at, low = values[name], edges[name], -math.inf
        for refinement in range(last + 1):
            gain, k, above, before = best
            threshold, low, high = at[k], at[k - 1] if k else low, at[k + 1] if k + 1 < len(at) else at[k]
            if refinement == last:
                break
            inside = held.where((value > low) & (value <= high))
            at = _edges(inside, {name: value}, True)[name]
            finer = _cuts(at, _counts(inside, {name: value}, {name: at})[name], before, total, precise)
            best = max((c for c in finer if c[2] == above), key=lambda c: c[0], default=None)
            if best is None or best[0] <= gain:
                break
        gap = held.agg(F.max(F.when(value <= threshold, value)).alias("low"), F.min(F.when(value > threshold, value)).alias("high")).first()
        middle = threshold if gap.low is None or gap.high is None else (gap.low + gap.high) / 2  # as far from either side as can be
        rule.append(Condition(name, above, middle))
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix of the rule that is best by (p - n) / (p + n); nothing if it isn't precise enough."""
    if not rule:
        return []
    held = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
    got = rows.agg(*[F.coalesce(F.sum(F.when(h, y)), F.lit(0)).alias(f"{what}{k}") for k, h in enumerate(held)
                     for what, y in (("p", F.col("reject")), ("n", 1 - F.col("reject")))]).first()
    counts = [(got[f"p{k}"], got[f"n{k}"]) for k in range(len(held))]
    worth, k = max(((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(counts))
    p, n = counts[-k]
    return rule[:1 - k] if p >= MIN_COVERED and p >= MIN_PRECISION * (p + n) else []


def labelled_stats(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics of the labelled documents with ``reject`` and the part for growing."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min(label)).cast("int").alias("reject"))
    return stats.join(known, "doc_id").withColumn("grow", F.pmod(mix("doc_id", F.lit(3)), F.lit(3)) > 0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, rule (the first that rejects, or null) and kept."""
    d = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def document_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return with_text_stats(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def op3_decision_list(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and blank texts have 0 of everything and fail the base; repeated rows are judged each."""
    scratch = Scratch(spark, "quality-rules")
    stats = scratch.write(document_stats(table(spark, sf_dir, "documents")), "stats")
    rules = learn(labelled_stats(stats, table(spark, sf_dir, "labels")))
    return apply_rules(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                            "base_failed", "kept", "rule")
