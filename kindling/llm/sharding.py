"""Sharding by balanced label propagation (4), in DataFrame operations throughout.

Copies of a text are linked with each other.  A linked set larger than half a shard is cut into
units of that size; all others are a unit.  What is propagated is the number of a unit's documents
on each shard: in every round a unit's documents move towards the shard that has most of them, by
shares that keep every shard within its quota (found from the 40 x 40 table of wished moves, as in
Ugander and Backstrom, 2013).  Documents without links then fill the shards to sizes that differ by
one at most, which cuts no edge; where a shard got too many by chance, the surplus goes with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindling.llm.common import Scratch, mix, ranked, table

SHARDS, ROUNDS, PARTS = 40, 8, 256


def accepted_shares(load: list[int], wished: dict[tuple[int, int], int], quota: int) -> dict[tuple[int, int], float]:
    """Of the wished moves (from, to) the shares after which no shard is beyond the quota, or
    further beyond it than before."""
    share = dict.fromkeys(wished, 1.0)
    for _ in range(200):
        over = False
        for j in range(len(load)):
            into = sum(n * share[m] for m, n in wished.items() if m[1] == j)
            out = sum(n * share[m] for m, n in wished.items() if m[0] == j)
            room = max(0.0, quota - load[j] + out)
            if into > room * (1 + 1e-9):
                over = True
                for m in wished:
                    if m[1] == j:
                        share[m] *= room / into
        if not over:
            break
    return share


def _pick(values: dict[tuple[int, int], float], shards: int) -> Column:
    """``values`` by the columns shard and target; a literal of at most shards x shards numbers."""
    flat = [0.0] * (shards * shards)
    for (a, b), v in values.items():
        flat[a * shards + b] = v
    return F.get(F.array(*map(F.lit, flat)), F.col("shard") * shards + F.col("target"))


def propagate(units: DataFrame, quota: int, scratch: Scratch, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(unit, shard, n) after the moves, from (unit, shard, n)."""
    state, weight = units, [1.0] * shards  # a shard that more wish for than it can take loses weight
    for k in range(rounds):
        pull = F.col("n") * F.get(F.array(*map(F.lit, weight)), F.col("shard"))
        best = state.groupBy("unit").agg(F.max_by("shard", F.struct(pull, mix("unit", "shard"))).alias("target"))
        aimed = scratch.write(state.join(best, "unit"), f"aimed-{k}")
        flows = aimed.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()  # shards x shards rows at most
        wished = {(r.shard, r.target): r.n for r in flows if r.shard != r.target}
        if not wished:
            break
        load = [sum(r.n for r in flows if r.shard == j) for j in range(shards)]
        accepted = accepted_shares(load, wished, quota)
        for j in range(shards):
            into = sum(n for m, n in wished.items() if m[1] == j)
            weight[j] *= sum(n * accepted[m] for m, n in wished.items() if m[1] == j) / into if into else 1.0
            weight[j] = max(0.01, min(1.0, weight[j] if into else 1.5 * weight[j]))
        share = _pick(accepted, shards)
        draw = F.pmod(mix("unit", "shard", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
        moved = aimed.withColumn("shard", F.when((F.col("shard") != F.col("target")) & (draw < share), F.col("target")).otherwise(F.col("shard")))
        new = scratch.write(moved.groupBy("unit", "shard").agg(F.sum("n").alias("n")), f"state-{k}")
        scratch.drop(aimed, state)
        state = new
    return state


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, unit) of every row, by the law ``rows``.

    A null text counts as no bytes, and as equal to other null texts.  Repeated rows are rows of
    their own.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scratch = Scratch(df.sparkSession, "sharding")
    nodes = scratch.write(df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text_col).isNull(), text).alias("group")), "nodes")
    rows = nodes.count()
    quota = [rows // shards + (j < rows % shards) for j in range(shards)]
    most = max(1, math.ceil(rows / shards) // 2)  # documents of a unit
    groups = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    split = scratch.write(nodes.join(groups, "group", "left"), "split")
    linked = split.where("copies is not null")
    large = ranked(linked.where(F.col("copies") > most), ["group"], ["doc_id"], "at", rows)
    units = linked.where(F.col("copies") <= most).withColumn("unit", F.col("group")).unionByName(
        large.withColumn("unit", mix("group", F.floor(F.col("at") / most))).drop("at"))
    placed = scratch.write(ranked(units.drop("group", "copies"), ["unit"], ["doc_id", "size"], "at", rows), "units")
    start = F.pmod(mix("doc_id", F.lit(4)), F.lit(shards)).cast("int")
    state = scratch.write(placed.groupBy("unit", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "state")
    state = propagate(state, max(quota), scratch, shards)
    # a unit's documents, in order, go to its shards
    before = Window.partitionBy("unit").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = state.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    homes = placed.join(spans, "unit").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n"))).drop("at", "first", "n")
    homes = scratch.write(ranked(homes, ["shard"], ["unit", "doc_id"], "slot", rows), "homes")
    had = {r.shard: r.n for r in homes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = [min(quota[j], had.get(j, 0)) for j in range(shards)]
    allowed = F.get(F.array(*map(F.lit, quota)), F.col("shard"))
    stay = homes.where(F.col("slot") < allowed)
    surplus = homes.where(F.col("slot") >= allowed).drop("shard", "slot")
    # all others take the places that are left, in the order of their rank
    others = split.where("copies is null").drop("group", "copies").withColumn("unit", F.lit(None).cast("long")).unionByName(surplus)
    others = scratch.write(ranked(others.withColumn("part", F.pmod(mix("doc_id", F.lit(5)), F.lit(PARTS)).cast("int")), ["part"],
                                  ["doc_id", "size"], "at", max(1, rows // PARTS)), "others")
    sizes = {r.part: r.n for r in others.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # PARTS rows at most
    offset = [sum(sizes.get(q, 0) for q in range(p)) for p in range(PARTS)]
    place = others.withColumn("place", F.get(F.array(*[F.lit(x).cast("long") for x in offset]), F.col("part")) + F.col("at"))
    free = [quota[j] - held[j] for j in range(shards)]
    first = [sum(free[:j]) for j in range(shards + 1)]
    ends = F.array(*[F.lit(x).cast("long") for x in first[1:]])
    place = place.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("place"))))
    taken = F.array(*[F.lit(held[j] - first[j]).cast("long") for j in range(shards)])
    filled = place.withColumn("slot", F.get(taken, F.col("shard")) + F.col("place"))
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
               F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "unit"]
    return stay.select(*columns).unionByName(filled.select(*columns))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
