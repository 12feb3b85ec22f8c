"""Operator 12: trie of conversation prefixes, summed over subtrees by an Euler tour.

A prefix of d turns is known by d and the xor of its turns' hashes (128 bits of SHA-256, mixed
with each turn's place), which running values in true order give without a group in one task.
Nodes come from one aggregation; each has an enter and an exit arc, linked into one list: parent's
enter arc, the children's subtrees from the least member on, parent's exit arc.  The list is ranked
by contraction: in each round arcs whose hash is below both neighbours' are spliced out (a third of
them; no two neighbours), their weights go to the arc before, and a list of at most ``LIST_MAX``
arcs is ranked in one task; then the spliced arcs return, round by round.  Differences of the
prefix sums at a node's two arcs are its subtree's leaves and savings.

Defined cases: rows without a conversation id belong to none and are left out; null roles and
texts are empty; turns come null first, equal turns by a digest of role and text (so repeated
rows stand side by side, each a turn of its own); an empty table gives no node, not even a root; texts
of any length travel only to their hash.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, table
from kindling.llm.ordered import running

#: Conversations of a block share the first turns of the block's first, as many as crc32(id) % HEAD_MOD says.
BLOCK, HEAD_MOD = 5, 9
#: A contracted list of at most so many arcs (about 1 MB) is ranked in one task.
LIST_MAX = 1 << 15


def _turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, bytes): 128 bits of a digest of role and text, and the text's size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), half(1).alias("k1"), half(17).alias("k2"),
        F.octet_length(text).cast("long").alias("bytes"))


def rebuilt_turns(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((conv_id, d, k1, k2, bytes) of all rebuilt conversations, (conv_id, depth) of each).

    The first ``h`` turns come from the block's first conversation, the others are its own.
    """
    own = scratch.write(running(_turns(df), "conv_id", ["turn", "k1", "k2"], scratch, "turns"), "ranked")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_MOD
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    convs = own.groupBy("conv_id").agg(F.max("rank").alias("n")).withColumn("h", head).withColumn("base", base)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "n", "h", shared.cast("long").alias("shared"))
    convs = scratch.write(convs.withColumn("depth", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    rest = own.join(convs.select("conv_id", "h", "shared"), "conv_id").where("rank > h").select(
        "conv_id", (F.col("rank") - F.col("h") + F.col("shared")).alias("d"), "k1", "k2", "bytes")
    heads = own.where(F.col("rank") < HEAD_MOD).select(F.col("conv_id").alias("base"), F.col("rank").alias("d"), "k1", "k2", "bytes")
    lent = convs.select("conv_id", "base", "shared").join(heads, "base").where("d <= shared").select("conv_id", "d", "k1", "k2", "bytes")
    return rest.unionByName(lent), convs.select("conv_id", "depth")


def _ends(at: DataFrame) -> DataFrame:
    """(d, x1, x2, ends_sha256) from (d, x1, x2, conv_id): ids are streamed in order through one SHA-256
    per node, which is sequential by nature; only its state is held."""

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, names = None, None, ["d", "x1", "x2", "ends_sha256"]
        for batch in batches:
            out = []
            for *key, c in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(str(c).encode())
                else:
                    sha.update(b",%d" % c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if i == 3 else pa.int64()) for i, v in enumerate(zip(*out, strict=True))], names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, sha.hexdigest())], names)

    by = ["d", "x1", "x2"]
    return at.select(*by, "conv_id").repartition(*by).sortWithinPartitions(*by, "conv_id").mapInArrow(stream, "d long, x1 long, x2 long, ends_sha256 string")


def _spliced(round_no: int) -> Column:
    h = lambda c: F.xxhash64(F.lit(round_no), F.col(c))
    return F.col("prev").isNotNull() & F.col("next").isNotNull() & (h("arc") < h("prev")) & (h("arc") < h("next"))


def rank_list(arcs: DataFrame, scratch: Scratch, list_max: int = LIST_MAX, weights: tuple[str, ...] = ("one", "leaves", "saved")) -> DataFrame:
    """(arc, and per weight the sum over all arcs before it) from (arc, prev, next, weights): one linked list."""
    arcs, rounds = scratch.write(arcs.select("arc", "prev", "next", *weights), "arcs"), []
    while arcs.count() > list_max:
        out = _spliced(len(rounds))
        gone = arcs.where(out)
        # a kept arc hears from the spliced arc on either side: new neighbours, and the weight it takes over
        none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        heard = arcs.where(~F.coalesce(out, F.lit(False))).select("arc", "prev", "next", none.alias("to_prev"), none.alias("to_next"), *weights)
        ahead = gone.select(F.col("prev").alias("arc"), none.alias("prev"), none.alias("next"), none.alias("to_prev"), F.col("next").alias("to_next"), *weights)
        behind = gone.select(F.col("next").alias("arc"), none.alias("prev"), none.alias("next"), F.col("prev").alias("to_prev"), none.alias("to_next"),
                             *[zero.alias(w) for w in weights])
        merged = heard.unionByName(ahead).unionByName(behind).groupBy("arc").agg(
            F.coalesce(F.max("to_prev"), F.max("prev")).alias("prev"), F.coalesce(F.max("to_next"), F.max("next")).alias("next"),
            *[F.sum(w).alias(w) for w in weights])
        rounds.append(gone.select("arc", "next", *weights))
        arcs = scratch.write(merged, "contracted")

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), arrow)
        if not len(t):
            return
        ids, nxt = t["arc"].to_numpy(), t["next"].fill_null(-1).to_numpy()
        place = {a: i for i, a in enumerate(ids.tolist())}
        order, at = [], int(np.flatnonzero(t["prev"].is_null().to_numpy())[0])
        while at is not None:
            order.append(at)
            at = place.get(int(nxt[at]))
        sums = []
        for w in weights:
            v = t[w].to_numpy()[order]
            sums.append(pa.array(np.cumsum(v) - v, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[order], pa.int64()), *sums], ["arc", *weights])

    arrow = pa.schema([(c, pa.int64()) for c in ("arc", "prev", "next", *weights)])
    places = arcs.repartition(1).mapInArrow(rank, "arc long, " + ", ".join(f"{w} long" for w in weights))
    places = scratch.write(places, "places")
    for gone in reversed(rounds):
        after = places.select(F.col("arc").alias("next"), *[F.col(w).alias(f"{w}_after") for w in weights])
        back = gone.join(after, "next").select("arc", *[(F.col(f"{w}_after") - F.col(w)).alias(w) for w in weights])
        places = scratch.write(places.unionByName(back), "places")
    return places


def prefix_trie(df: DataFrame, list_max: int = LIST_MAX) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(df.sparkSession, "prefix-trie")
    turns, convs = rebuilt_turns(df, scratch)
    place = [F.xxhash64(F.lit(s), "d", "k1", "k2").alias(f"i{s}") for s in (1, 2)]
    turns = running(turns.select("conv_id", "d", "bytes", *place), "conv_id", ["d"], scratch, "prefixes", xors=["i1", "i2"])
    turns = turns.select("conv_id", "d", "bytes", F.col("x_i1").alias("x1"), F.col("x_i2").alias("x2"),
                         F.col("x_i1").bitwiseXOR(F.col("i1")).alias("p1"), F.col("x_i2").bitwiseXOR(F.col("i2")).alias("p2"))
    zero = F.lit(0).cast("long")
    nodes = turns.groupBy("d", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
                                               F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("d"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"))
    nodes = scratch.write(nodes.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    ends = turns.join(convs.withColumnRenamed("depth", "d"), ["conv_id", "d"]).select("d", "x1", "x2", "conv_id")
    ends = ends.unionByName(convs.where("depth = 0").select(zero.alias("d"), zero.alias("x1"), zero.alias("x2"), "conv_id"))

    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                           F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("d > 0").join(parents, ["d", "p1", "p2"]).select("node", "parent", "conv_id", "parent_conv_id")
    children = scratch.write(running(children, "parent", ["conv_id"], scratch, "siblings", previous="node"), "children")
    kids = children.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max_by("node", "rank").alias("last"))
    tree = nodes.join(children.select("node", "parent", "parent_conv_id", "before"), "node", "left").join(
        kids.withColumnRenamed("parent", "node"), "node", "left")
    tree = scratch.write(tree.select("node", "d", "x1", "x2", "conv_id", "n_convs", "parent", "parent_conv_id", "before", "last",
                                     F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves")), "tree")

    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    first = F.coalesce(leave("before"), enter("parent"))  # the arc before a node's enter arc; the root has none
    into = F.struct(enter("node").alias("arc"), first.alias("prev"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("saves").alias("saved"))
    out = F.struct(leave("node").alias("arc"), F.coalesce(leave("last"), enter("node")).alias("prev"), zero.alias("leaves"), zero.alias("saved"))
    arcs = tree.select(F.inline(F.array(into, out)))
    none = F.lit(None).cast("long")
    told = arcs.select("arc", "prev", none.alias("next"), F.lit(1).cast("long").alias("one"), "leaves", "saved").unionByName(
        arcs.where("prev is not null").select(F.col("prev").alias("arc"), none.alias("prev"), F.col("arc").alias("next"), zero.alias("one"), zero.alias("leaves"), zero.alias("saved")))
    linked = told.groupBy("arc").agg(F.max("prev").alias("prev"), F.max("next").alias("next"), *[F.sum(w).alias(w) for w in ("one", "leaves", "saved")])
    places = rank_list(linked, scratch, list_max)

    is_in = F.col("arc") % 2 == 0
    sums = places.groupBy(F.shiftright("arc", 1).alias("node")).agg(
        *[(F.max(F.when(~is_in, F.col(w))) - F.max(F.when(is_in, F.col(w)))).alias(w) for w in ("leaves", "saved")])
    nothing = hashlib.sha256().hexdigest()
    return tree.join(sums, "node").join(_ends(ends), ["d", "x1", "x2"], "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Unsigned CRC-32 of an ASCII text in DuckDB: the 256-entry table by its rule, then a fold over the signs.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(b)))"""


def crc_sql(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
            "lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::INT])), 4294967295)")


OP12_SQL = f"""
WITH {CRC_TABLE},
own AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn_of,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
        FROM conversations WHERE conv_id IS NOT NULL),
listed AS (SELECT conv_id, list(turn_of ORDER BY k) AS l FROM own GROUP BY conv_id),
h AS (SELECT conv_id, l, ({crc_sql('conv_id::VARCHAR')}) % 9 AS h FROM listed, crc),
full_ AS (SELECT h.conv_id, CASE WHEN b.l IS NULL THEN h.l[h.h + 1:] ELSE list_concat(b.l[:h.h], h.l[h.h + 1:]) END AS s
          FROM h LEFT JOIN listed b ON b.conv_id = h.conv_id - h.conv_id % 5),
pre AS (SELECT conv_id, d, s[:d] AS p, d = len(s) AS ends FROM full_, lateral (SELECT unnest(range(0, len(s) + 1)) AS d)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(p[d].t), 0) AS saves,
                sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
         FROM pre GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
tree AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, up.conv_id AS parent_conv_id
         FROM node LEFT JOIN kids USING (p, d) LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[:node.d - 1]),
above AS (SELECT p[:a] AS p, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saves) AS saved
          FROM tree, lateral (SELECT unnest(range(0, d + 1)) AS a) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM tree JOIN above USING (p, d)
"""
