"""Quality classifier from weak labels (9).

Heuristic labellers vote bad or nothing on every text, and overlap.  Expectation-maximisation over the
counts of vote patterns estimates how often each labeller votes what, given a text's true quality
(Dawid and Skene, 1979), with no labels by hand; a pattern's posterior is the label of its texts.
On a bounded sample of these, a linear scorer over hashed words and the texts' statistics is
trained (Spark ML), which then scores all texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, documents_of, mix, table
from kindling.llm.text_stats import with_text_stats, words_of

#: Texts that the scorer is trained on, about; hashed features; steps of either estimation.
MAX_TRAIN, FEATURES, EM_STEPS, FIT_STEPS = 6_000, 1 << 13, 100, 25
#: Texts of a lower score are rejected.
KEEP_SCORE = 0.5
#: Labellers are written to be specific: of the good texts they vote against this share at most.  Without
#: the bound, faults that come together would be taken for the only ones.
MOST_WRONG = 0.002
_EPS = 0.0005


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def labellers() -> dict[str, Column]:
    """Votes (-1 bad, 0 none) from a text's statistics.  Each knows one fault and is silent
    otherwise, so that texts of one fault aren't outvoted by the rest."""
    symbols, upper = _share("n_symbols", "n_words"), _share("n_upper", "word_chars")
    repeated, distinct, size = _share("n_repeat_words", "n_words"), _share("n_distinct", "n_words"), _share("word_chars", "n_words")
    enough = F.col("n_words") >= 20
    bad = {"symbols": symbols > 0.2, "upper": (upper > 0.4) & enough, "repeated": repeated > 0.4, "distinct": (distinct < 0.25) & enough,
           "word_size": ((size > 12) | (size < 2)) & enough, "empty": F.col("n_words") == 0}
    return {k: F.when(v, -1).otherwise(0) for k, v in bad.items()}


def dense() -> list[Column]:
    """The statistics that the scorer sees, each from 0 to 1."""
    one = lambda c: F.least(c, F.lit(1.0))
    return [one(_share("n_symbols", "n_words")).alias("f0"), one(_share("n_upper", "word_chars")).alias("f1"),
            one(_share("n_repeat_words", "n_words")).alias("f2"), _share("n_distinct", "n_words").alias("f3"),
            one(_share("word_chars", "n_words") / 20).alias("f4"), one(_share("n_dup_lines", "n_words") * 5).alias("f5"),
            (F.col("n_words") == 0).cast("double").alias("f6")]


@dataclass
class LabelModel:
    """Share of good texts, and of each labeller the probabilities of its votes given bad and good."""

    good: float
    votes: list[dict[int, tuple[float, float]]]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """The probability of good."""
        z = math.log(self.good) - math.log(1 - self.good)
        for v, table_ in zip(pattern, self.votes, strict=True):
            bad, good = table_[v]
            z += math.log(good) - math.log(bad)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def estimate(patterns: dict[tuple[int, ...], int], steps: int = EM_STEPS) -> LabelModel:
    """Expectation-maximisation from the number of texts of each vote pattern.

    It starts from the votes: bad where one labeller says so, else good.  Estimates stay above
    0.0005, so no vote decides alone.
    """
    m = len(next(iter(patterns), ()))
    belief = {p: 0.1 if min(p) < 0 else 0.95 for p in patterns}
    model = LabelModel(0.5, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(m)])
    for _ in range(steps if patterns else 0):
        total = sum(patterns.values())
        good = sum(n * belief[p] for p, n in patterns.items())
        votes = []
        for k in range(m):
            of = {}
            for v in (-1, 0, 1):
                g = sum(n * belief[p] for p, n in patterns.items() if p[k] == v)
                b = sum(n * (1 - belief[p]) for p, n in patterns.items() if p[k] == v)
                g = min(g, MOST_WRONG * good) if v < 0 else g
                of[v] = (_EPS + (1 - 3 * _EPS) * (b + 1 / 3) / (total - good + 1), _EPS + (1 - 3 * _EPS) * (g + 0.01) / (good + 1))
            votes.append(of)
        model = LabelModel(min(0.98, max(0.02, good / total)), votes)
        belief = {p: model.posterior(p) for p in patterns}
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: PipelineModel | None


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as ``row``, with doc_id, words, statistics and votes; null texts are empty."""
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))
    stats = with_text_stats(docs.withColumn("words", words_of(F.lower("text"))))
    return stats.withColumn("votes", F.array(*labellers().values())).select("row", "doc_id", "words", "votes", *dense())


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> QualityModel:
    """Label model and scorer from documents alone; all of them vote, about ``most`` train the scorer.

    An empty table gives a model that scores by votes.
    """
    docs = documents_of(df, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "quality")
    voted = scratch.write(featured(docs).select("doc_id", "votes"), "votes")
    patterns = {tuple(r.votes): r.n for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels, n = estimate(patterns), sum(patterns.values())
    if not n:
        return QualityModel(labels, None)
    # both kinds in the sample: patterns held for bad are rarer and get up to half of it
    good = {p: labels.posterior(p) for p in patterns}
    bad = sum(patterns[p] for p in patterns if good[p] < 0.5)
    parts = []
    for held_bad, rows in ((True, bad), (False, n - bad)):
        chosen = [p for p in patterns if (good[p] < 0.5) == held_bad]
        share = min(1.0, (most / 2) / max(1, rows))
        parts += [(list(p), float(good[p]), share) for p in chosen]
    spark = docs.sparkSession
    known = spark.createDataFrame(parts, "votes array<int>, p double, share double")  # at most 3 ** labellers rows
    sample = voted.join(F.broadcast(known), "votes").where(F.pmod(mix("doc_id", F.lit(9)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    sample = sample.groupBy("doc_id").agg(F.first("p").alias("p"))
    rows = featured(docs.join(F.broadcast(sample), "doc_id"))  # about ``most`` rows of 16 bytes
    train = rows.join(F.broadcast(sample), "doc_id")
    train = scratch.write(train.select("words", *[f"f{k}" for k in range(7)], F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y")).select("*", "y.*").drop("y"), "train")
    stages = [HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES), Normalizer(inputCol="counts", outputCol="hashed"),
              VectorAssembler(inputCols=["hashed", *[f"f{k}" for k in range(7)]], outputCol="features"),
              LogisticRegression(weightCol="weight", maxIter=FIT_STEPS, regParam=0.01)]
    scorer = Pipeline(stages=stages).fit(train)
    scratch.drop(voted, train)
    return QualityModel(labels, scorer)


def scored_rows(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, score, kept) of every row: the scorer's probability of good quality."""
    rows = featured(df, id_col, text_col)
    if model.scorer is None:
        return rows.select("row", "doc_id", F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    p = vector_to_array("probability")[1]
    return model.scorer.transform(rows).select("row", "doc_id", p.alias("score"), (p >= KEEP_SCORE).alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts are scored by their statistics alone; repeated rows are scored each."""
    docs = table(spark, sf_dir, "documents")
    return scored_rows(docs, fit(docs)).drop("row")
