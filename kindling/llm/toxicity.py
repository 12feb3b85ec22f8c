"""Toxicity by maximum-scoring segment search (7).

Units are words and prefixes of words (insults are inflected and compounded).  From labelled rows,
each unit gets its log-odds of toxic against other texts under a Dirichlet prior in proportion to
its overall frequency (Monroe, Colaresi and Quinn, 2008); those that stand out positively form the
lexicon, all other words score a small negative drift.  A linear scan (Ruzzo and Tompa, 1999) finds
every maximal scoring segment of a text.  By extreme-value theory (Karlin and Altschul, 1990) chance
segments of score S in n words are K n exp(-lambda S) in number; passages that beat this are toxic,
and a text's evidence, aggregated over its passages on that scale, becomes a probability by a
logistic curve fitted on the labelled rows.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, checked_broadcast, documents_of, mix, table, text_chunks, tidied
from kindling.llm.text_stats import words_of

#: Labelled rows that the lexicon and the curve are fitted on, about (a share of all by their ids' hash).
MAX_LABELLED = 20_000
#: Pseudo-count of documents in the prior; least z of a lexicon unit, and its most units; drift of other words.
PRIOR, Z_MIN, MAX_UNITS, DRIFT = 20.0, 2.5, 50_000, 0.05
#: A passage counts where so many or fewer like it are expected by chance.
E_MAX = 0.05
PREFIXES = (4, 5, 6)
_FOLD, _WORDS = 5, 200_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def units(word: str) -> list[str]:
    """A lower-case word without what isn't a letter at its ends, then its longer prefixes, marked with a star."""
    core = _EDGE.sub("", word)
    return [core] * bool(core) + [core[:n] + "*" for n in reversed(PREFIXES) if len(core) > n]


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, last, score) of every maximal scoring segment, where ``hits`` are the positions of
    positive scores in order and every other position scores ``-drift``.  Linear in the hits."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum to its end
    total, after = 0.0, 0
    for at, score in hits:
        total -= drift * (at - after)
        first, before, total, after = at, total, total + score, at + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            first, before = found[k][0], found[k][2]
            del found[k:]
        found.append((first, at, before, total))
    return [(a, b, y - x) for a, b, x, y in found]


@dataclass
class ToxicModel:
    """The lexicon (unit -> score), the chance law's lambda and log K, and the curve."""

    lexicon: dict[str, float]
    lam: float
    log_k: float
    slope: float
    offset: float
    without: float  # probability of a text without hits

    def probability(self, evidence: float | None) -> float:
        if evidence is None:
            return self.without
        z = self.slope * evidence + self.offset
        return max(self.without, 1 / (1 + math.exp(-z)) if z > -700 else 0.0)


def _text_units(text: bytes, cache: dict[str, list[str]]) -> set[str]:
    out: set[str] = set()
    for w in set(text.decode("utf-8", "replace").lower().split()):
        if w not in cache:
            if len(cache) > _WORDS:
                cache.clear()
            cache[w] = units(w)
        out.update(cache[w])
    return out


def _unit_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, documents of label 1, of label 0) of the task's rows; the empty unit counts the
    documents, the unit " " the words."""
    counts, cache = (Counter(), Counter()), {}

    def out() -> pa.RecordBatch:
        keys = list(counts[1].keys() | counts[0].keys())
        got = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[y][k] for k in keys], pa.int64()) for y in (1, 0))],
                                         names=["unit", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return got

    for b in batches:
        labels = b.column(2).to_pylist()
        at = 0
        for ids, texts in text_chunks([b]):
            for k, t in enumerate(texts):
                c = counts[1 if labels[at + k] else 0]
                c.update(_text_units(t, cache))
                c[""] += 1
                c[" "] += len(t.split())
            at += len(ids)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
    yield out()


def _evidence(text: bytes, model: ToxicModel, cache: dict[str, float]) -> tuple[float | None, list[tuple[int, int, float]]]:
    """(-log of the number of such texts expected by chance, the passages); none without hits."""
    words = text.decode("utf-8", "replace").lower().split()
    hits = []
    for i, w in enumerate(words):
        s = cache.get(w)
        if s is None:
            if len(cache) > _WORDS:
                cache.clear()
            s = cache[w] = max((model.lexicon.get(u, 0.0) for u in units(w)), default=0.0)
        if s:
            hits.append((i, s))
    if not hits:
        return None, []
    passages = maximal_segments(hits)
    chance = model.log_k + math.log(len(words))
    top = max(p[2] for p in passages)
    total = model.lam * top + math.log(sum(math.exp(model.lam * (p[2] - top)) for p in passages))
    return total - chance, [p for p in passages if chance - model.lam * p[2] <= math.log(E_MAX)]


def _scored(batches: Iterable[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    gc.set_threshold(200_000, 50, 100)  # nothing here makes cycles
    cache: dict[str, float] = {}
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
    for ids, texts in text_chunks(batches):
        got = [_evidence(t, model, cache) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([model.probability(e) for e, _ in got], pa.float64()), pa.array([e for e, _ in got], pa.float64()),
             pa.array([[dict(zip(("first", "last", "score"), p, strict=True)) for p in ps] for _, ps in got], kind)],
            names=["doc_id", "score", "evidence", "passages"])


def held_out(doc_id: Column | str) -> Column:
    """Rows that are never learned from; a null id counts as none of them."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % _FOLD == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, label) of about ``most`` labelled rows outside the held-out fold, one of near copies."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(mix("doc_id", F.lit(7)), F.lit(1_000_000)) < int(most / n * 1_000_000))
    bound = min(n, most + 5 * int(most ** 0.5))
    rows = _sketched(docs.join(checked_broadcast(known, bound, 32), "doc_id"))
    for key in ("k0", "k1"):  # of texts that share a minimal run of words one stays, or a copied text's words would stand out
        rows = rows.groupBy(key, "label").agg(F.min_by(F.struct("doc_id", "k1"), "doc_id").alias("r")).select("label", "r.*")
    return docs.join(checked_broadcast(rows.select("doc_id", "label"), bound, 32), "doc_id")


def _sketched(rows: DataFrame) -> DataFrame:
    """(doc_id, label, k0, k1): two minimal hashes of the text's runs of three words; near copies share most of these."""
    hashed = rows.select("doc_id", "label", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0)))
    w = F.col("w")

    def least(seed: int) -> Column:
        return F.array_min(F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.lit(seed))))

    return hashed.select("doc_id", "label", least(0).alias("k0"), least(1).alias("k1"))


def _chance_scale(scores: list[tuple[float, float]], drift: float) -> float:
    """lambda > 0 with the mean of exp(lambda s) equal to 1, for scores s and their probabilities."""
    rest = max(1e-9, 1 - sum(p for _, p in scores))

    def excess(lam: float) -> float:
        return sum(p * math.exp(min(700.0, lam * s)) for s, p in scores) + rest * math.exp(-lam * drift) - 1

    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, offset) of label 1 against evidence, from (evidence, label, rows); slightly ridged."""
    a, b = 0.5, 0.0
    for _ in range(50):
        g0 = g1 = 0.0
        h00, h01, h11 = 1e-3, 0.0, 1e-3
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, a * x + b))))
            w = n * p * (1 - p)
            g0 += n * (y - p)
            g1 += n * (y - p) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1 = g0 - 1e-3 * b, g1 - 1e-3 * a
        det = h00 * h11 - h01 * h01
        db, da = (g0 * h11 - g1 * h01) / det, (g1 * h00 - g0 * h01) / det
        size = max(1.0, abs(da), abs(db))
        a, b = max(0.01, a + da / size), b + db / size
    return a, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> ToxicModel:
    """A model from documents (doc_id, text) and labels (doc_id, ``label`` 0 or 1).

    The lexicon that comes to the driver has MAX_UNITS units at most, those of largest z: beyond
    that bound a unit has the drift's score.  Without labelled rows there is no lexicon, and every
    text has the same small probability.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = training_rows(docs, labels, label, most)
    counts = scratch.write(rows.select("doc_id", "text", "label").mapInArrow(
        lambda batches: tidied(_unit_counts(batches)), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "units")
    totals = {r.unit: r for r in counts.where(F.col("unit").isin("", " ")).collect()}
    if "" not in totals or not totals[""].toxic or not totals[""].clean:
        return ToxicModel({}, 1.0, 0.0, 1.0, 0.0, 0.02)
    n1, n0, words = totals[""].toxic, totals[""].clean, max(1, totals[" "].clean)
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / (n1 + n0)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (n1 + PRIOR - t + 1)) - F.log(c / (n0 + PRIOR - c + 1))
    lexicon = (counts.where(~F.col("unit").isin("", " ")).withColumn("score", odds)
               .withColumn("z", F.col("score") / F.sqrt(1 / t + 1 / c))
               .where((F.col("z") >= Z_MIN) & (F.col("score") >= 1)).orderBy(F.desc("z"), "unit").limit(MAX_UNITS)
               .select("unit", "score", "clean").collect())
    scratch.drop(counts)
    scores = [(r.score, (r.clean + 0.5) / words) for r in lexicon]
    model = ToxicModel({r.unit: r.score for r in lexicon}, _chance_scale(scores, DRIFT), 0.0, 1.0, 0.0, 0.0)
    scored = score_texts(rows, model).join(rows.select("doc_id", "label"), "doc_id")
    points = scored.groupBy(F.round(F.col("evidence") * 4).alias("x"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    model.slope, model.offset = _logistic([(r.x / 4, r.label, r.n) for r in points if r.x is not None])
    no = Counter({r.label: r.n for r in points if r.x is None})
    model.without = (no[1] + 0.5) / (no[0] + no[1] + 25)
    return model


def score_texts(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence, passages) of every whole text; passages are (first, last, score),
    positions counted in words.  Null, empty and blank texts have no passages, null evidence and the
    probability of texts without hits.  Repeated rows are scored each."""
    return documents_of(df, id_col, text_col).mapInArrow(
        lambda batches: tidied(_scored(batches, model)),
        "doc_id long, score double, evidence double, passages array<struct<first:long,last:long,score:double>>")


def without_toxic(df: DataFrame, model: ToxicModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, as they are, whose text scores less than ``least``."""
    at = df.columns.index(text_col)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(at).cast(pa.string())], names=["doc_id", "text"])
            scores = [x for got in _scored([pair], model) for x in got.column(1).to_pylist()]
            yield b.filter(pa.array([x < least for x in scores], pa.bool_()))

    return df.mapInArrow(lambda batches: tidied(clean(batches)), df.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents_of(table(spark, sf_dir, "documents"))
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "passages")
