"""Statistics of whole texts as Spark expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
_RUN = 8


def words_of(text: Column) -> Column:
    """The words of a text; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _covered(starts: Column) -> Column:
    """Words in the union of the runs that begin at ``starts``, in rising order."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, zero,
        lambda acc, i: F.struct((i + _RUN).alias("end"), (acc["n"] + i + _RUN - F.greatest(i, acc["end"])).cast("long").alias("n")),
        lambda acc: acc["n"])


def with_text_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the text and with: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_upper (A-Z) and n_distinct (distinct words), all long.

    Words in runs of 8 that occur twice in a text are found by the runs' hashes: sorted with their
    places, equal neighbours mark the runs; only texts that have any pay for the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    others = [c for c in df.columns if c != text_col]
    d = df.select(*others, words_of(F.col(text_col)).alias("_w"), left(r"[^#*$%&|<>]+").alias("n_symbols"),
                  left("[^A-Z]+").alias("n_upper"), lines.alias("_lines"))
    d = d.select(*others, F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"), "n_symbols", "n_upper", F.size("_w").cast("long").alias("n_words"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    d = d.withColumn("_runs", F.col("_h"))
    for k in (1, 2, 4):  # hashes of 2, 4 and 8 words, each of two neighbouring ones of half as many
        d = d.withColumn("_runs", F.zip_with("_runs", F.slice("_runs", k + 1, F.size("_runs")), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("_runs", F.slice("_runs", 1, F.greatest(F.size("_runs") - (_RUN - 1), F.lit(0))))
    d = d.withColumn("_again", F.size(F.array_distinct("_runs")) < F.size("_runs")).withColumn(
        "n_distinct", F.size(F.array_distinct("_h")).cast("long")).drop("_h")
    placed = F.when(F.col("_again"), F.sort_array(F.transform("_runs", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("_sorted", placed).drop("_runs", "_again")
    same = lambda e, k: (F.get(F.col("_sorted"), k - 1)["x"] == e["x"]) | (F.get(F.col("_sorted"), k + 1)["x"] == e["x"])
    marked = F.filter("_sorted", lambda e, k: F.coalesce(same(e, k), F.lit(False)))
    d = d.withColumn("_starts", F.sort_array(F.transform(marked, lambda e: e["i"]))).drop("_sorted")
    return d.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long")).drop("_starts")
