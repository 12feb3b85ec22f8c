"""MinHash near-dedup by chosen-path similarity join (2).

Documents are sets of word shingles; equal sets form a class with one representative.  Each set
has a signature of minwise tokens.  A tree deals the representatives to nodes by the value of one
chosen coordinate of the signature; nodes of more than LEAF documents branch again on coordinates
chosen by the node's path (now and then on two, so that similar pairs stay together with a
probability that falls slowly with depth; Christiani, Pagh and Sivertsen, 2018).  Small nodes are
compared exhaustively, first on sketches, then on full sets.  Independent trees are repeated, in two
rounds: those of the second compare only documents that the first hasn't linked.  Confirmed links
are joined to components by iterated joins.

Before a large node branches, its documents are compared in blocks that share some anchors.  If
all but half a leaf's documents are then of one component, the node is settled at once: every other
document is compared with all of the component's, in blocks, and those of one component needn't be
compared with each other.  So heaps of near copies, of which branching would make ever more rows,
end as soon as they are linked, and all other nodes branch in full.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, WordHashes, checked_broadcast, documents_of, most_tasks, table, text_chunks, tidied

SHINGLE, PERCENT = 3, 85
#: Coordinates of a signature, trees of each round at 85 per cent, documents of a node compared at once, deepest level.
COORDINATES, ROUNDS, LEAF, DEPTH = 64, (4, 8), 2000, 40
#: Shingles that more sets of a cluster have are counted by matrix products.
_RARE = 12
#: Documents of a large node that are in all of its blocks, on average.
ANCHORS = 16
#: A graph of at most so many links between components (16 MB) is solved in one task; larger ones by joins.
LINKS_AT_ONCE = 1 << 20
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct k-word shingles; of all its words where it has fewer."""
    words = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i:len(h) - k + 1 + i]) * _K[0]
        s ^= s >> np.uint64(32)
        s = s * _K[1] + _K[2]
    return np.unique(s ^ (s >> np.uint64(29)))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least product of the set's members with each coordinate's multiplier."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        np.minimum(out, (s[i:i + 8192, None] * _MULTIPLIERS).min(axis=0), out=out)
    return out


def _sketches(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes(200_000)
    for ids, texts in text_chunks(batches):
        sets = [shingle_set(t, k, hashes) for t in texts]
        least = [minwise(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()),
             pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
             pa.array([(x >> np.uint64(32)).astype("<u4").tobytes() for x in least], pa.binary()),
             pa.array([((x * _K[0]) >> np.uint64(56)).astype(np.uint8).tobytes() for x in least], pa.binary())],
            names=["doc_id", "n_shingles", "set_id", "signature", "sketch"])


def _sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes(200_000)
    for ids, texts in text_chunks(batches):
        sets = [shingle_set(t, k, hashes).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                                         names=["doc_id", "set_id", "set"])


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows of the same first column, across batches."""
    rows = itertools.chain.from_iterable(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches)
    for key, group in itertools.groupby(rows, lambda r: r[0]):
        yield key, list(group)


def _clusters(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[list[int]]:
    """The connected parts of 0 to n - 1; ``near(i, others)`` marks those of ``others`` linked with i.
    Whatever has been reached once isn't compared again."""
    out, left = [], np.arange(n)
    while len(left):
        part, at, left = [int(left[0])], 0, left[1:]
        while at < len(part) and len(left):
            hit = near(part[at], left)
            part += left[hit].tolist()
            left = left[~hit]
            at += 1
        out.append(sorted(part))
    return out


def _alike(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(cluster, rep): of each node the groups connected by ``least`` equal sketch bytes between
    documents that aren't linked yet.  Rows: node, rep, component, sketch."""
    out: list[tuple[int, int]] = []
    for _, rows in _groups(batches):
        if len(rows) < 2:
            continue
        rows.sort(key=lambda r: r[1])
        sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        part = np.array([r[2] for r in rows])

        def near(i: int, others: np.ndarray, sketch: np.ndarray = sketch, part: np.ndarray = part) -> np.ndarray:
            return ((sketch[others] == sketch[i]).sum(axis=1) >= least) & (part[others] != part[i])

        for members in _clusters(len(rows), near):
            if len(members) > 1:
                reps = [rows[i][1] for i in members]
                cluster = xxhash.xxh64_intdigest(np.array(reps, np.int64).tobytes()) >> 1
                out += [(cluster, r) for r in reps]
        if len(out) > 20_000:
            yield _pairs(out, "cluster", "rep")
            out = []
    yield _pairs(out, "cluster", "rep")


def _pairs(rows: list[tuple[int, int]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=list(names))


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs' intersection is ``percent`` of their union or more."""
    n, size = len(sets), np.array([len(s) for s in sets])
    shared = np.zeros((n, n), np.int64)
    if n <= 6:
        for i, j in itertools.combinations(range(n), 2):
            shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(column, kind="stable")
        row, first = np.repeat(np.arange(n), size)[order], np.cumsum(counts) - counts
        for k in range(2, _RARE + 1):  # shingles of few sets: their pairs
            members = row[first[counts == k][:, None] + np.arange(k)]
            for i, j in itertools.combinations(range(k), 2):
                np.add.at(shared, (members[:, i], members[:, j]), 1)
        often = np.flatnonzero(counts > _RARE)  # the others: columns of a matrix of zeros and ones
        for start in range(0, len(often), 4096):
            x = np.zeros((n, min(4096, len(often) - start)), np.float32)  # sums of whole numbers up to 2 ** 24 are exact
            for k, c in enumerate(often[start:start + 4096]):
                x[row[first[c]:first[c] + counts[c]], k] = 1
            got = (x @ x.T).astype(np.int64)
            shared += np.triu(got, 1)
        shared += shared.T
    return 100 * shared >= percent * (size[:, None] + size - shared)


def _confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): each confirmed member of a cluster with the smallest that it is connected with."""
    out: list[tuple[int, int]] = []
    for _, rows in _groups(batches):
        rows.sort(key=lambda r: r[1])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        linked = similar(sets, percent)
        for members in _clusters(len(rows), lambda i, others, linked=linked: linked[i, others]):
            out += [(rows[members[0]][1], rows[i][1]) for i in members[1:]]
        if len(out) > 20_000:
            yield _pairs(out, "a", "b")
            out = []
    yield _pairs(out, "a", "b")


def _sorted_map(df: DataFrame, key: str, f: Callable, schema: str, tasks: int = 0) -> DataFrame:
    """``f`` of rows sorted by ``key``, in ``tasks`` tasks at most, if given; a key's rows stay together where a task has several partitions."""
    parts = df.repartition(F.col(key)).sortWithinPartitions(key)
    return (parts.coalesce(tasks) if tasks else parts).mapInArrow(lambda b: tidied(f(b)), schema)


class _Links:
    """The components (rep, component) of the links confirmed so far, if any."""

    def __init__(self, docs: DataFrame, reps: DataFrame, shingle: int, percent: int, scratch: Scratch):
        self.docs, self.reps, self.shingle, self.percent, self.scratch = docs, reps, shingle, percent, scratch
        expected, spread = COORDINATES * percent / 100, (COORDINATES * percent / 100 * (1 - percent / 100)) ** 0.5
        self.least = int(expected - 4.5 * spread)
        self.labels: DataFrame | None = None
        self.named, self.tasks = 0, most_tasks(docs.sparkSession)

    def marked(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with the component of each rep, as ``part``."""
        if self.labels is None:
            return nodes.withColumn("part", F.col("rep"))
        labels = checked_broadcast(self.labels, self.named, 16)
        return nodes.join(labels, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")

    def compare(self, nodes: DataFrame) -> None:
        """Compares the documents of each of ``nodes`` (node, rep) that aren't linked yet."""
        scratch, least, shingle, percent = self.scratch, self.least, self.shingle, self.percent
        rows = self.marked(nodes).join(self.reps.select("rep", "sketch"), "rep").select("node", "rep", "part", "sketch")
        alike = _sorted_map(rows, "node", lambda b: _alike(b, least), "cluster long, rep long", self.tasks).distinct()
        alike = scratch.write(alike.coalesce(self.tasks), "alike")
        n = alike.count()
        if not n:
            return
        named = self.reps.select("rep", "doc_id", "set_id").join(checked_broadcast(alike, n, 16), "rep")
        texts = self.docs.join(checked_broadcast(named.select("doc_id"), n, 8), "doc_id", "left_semi")
        # an id may have several texts, and a text several rows
        full = texts.mapInArrow(lambda b: tidied(_sets(b, shingle)), "doc_id long, set_id binary, set binary").dropDuplicates(["doc_id", "set_id"])
        rows = named.join(full, ["doc_id", "set_id"]).select("cluster", "rep", "set")
        self.add(scratch.write(_sorted_map(rows, "cluster", lambda b: _confirmed(b, percent), "a long, b long", self.tasks), "links"))

    def add(self, links: DataFrame) -> None:
        """Joins components by ``links`` (a, b): only what is new between components is worked on."""
        old, scratch = self.labels, self.scratch
        if old is None:
            edges, n = links, links.count()
        else:
            edges = links
            for end in ("a", "b"):
                label = checked_broadcast(old.select(F.col("rep").alias(end), F.col("component").alias("to")), self.named, 16)
                edges = edges.join(label, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            edges = scratch.write(edges.where("a <> b"), "edges")
            n = edges.count()
        if not n:
            return
        solved = scratch.write(_joined_at_once(edges), "solved") if n <= LINKS_AT_ONCE else components(edges, scratch)
        if old is None:
            self.labels = solved
        else:
            to = checked_broadcast(solved.select(F.col("rep").alias("component"), F.col("component").alias("to")), 2 * n, 16)
            moved = old.join(to, "component", "left").select("rep", F.coalesce("to", "component").alias("component"))
            new = solved.join(checked_broadcast(old.select("rep"), self.named, 8), "rep", "left_anti")
            self.labels = scratch.write(moved.unionByName(new), "labels")
        self.named = self.labels.count()

    def settle(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(leaves that settle nodes of ``large`` (node, rep, size), the rows of the other nodes)."""
        half = max(1, LEAF // 2)
        rows = self.scratch.write(self.marked(large), "parts")
        parts = rows.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"))
        tops = parts.groupBy("node").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"))
        tops = tops.select("node", F.col("top.n").alias("n"), F.col("top.part").alias("top"), (F.col("all") - F.col("top.n")).alias("others"))
        tops = self.scratch.write(tops.coalesce(self.tasks), "tops")
        rows = rows.join(checked_broadcast(tops, tops.count(), 48), "node")
        blocks = F.ceil(F.col("n") / half).cast("int")
        to = F.when(F.col("part") == F.col("top"), F.array(F.pmod(F.xxhash64("node", "rep", F.lit(1)), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        leaves = rows.where((F.col("others") > 0) & (F.col("others") <= half)).select("node", "rep", F.explode(to).alias("block"))
        leaves = leaves.select(F.xxhash64("node", "block").alias("node"), "rep")
        return leaves, rows.where(F.col("others") > half).select("node", "rep", "size")


def second_branch(percent: int) -> float:
    """How often of 1000 a node branches twice: pairs of ``percent`` then share one child on average."""
    return 1000 * (100 / max(percent, 1) - 1)


def rounds(percent: int) -> tuple[int, ...]:
    """Trees of each round; below 85 per cent so many more that as few pairs share none of their first nodes."""
    trees = sum(ROUNDS)
    if 0 < percent < 85:
        trees = math.ceil(trees * math.log(0.15) / math.log(1 - percent / 100))
    return *ROUNDS[:-1], trees - sum(ROUNDS[:-1])


def _blocks(large: DataFrame, members: int, shared: int) -> DataFrame:
    """(node, rep) of blocks of about ``members`` documents of each of ``large``'s nodes and
    ``shared`` more that all of the node's blocks have; others in each node."""
    anchors = F.pmod(F.xxhash64("rep", "node"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * shared / F.col("size")
    blocks = F.ceil(F.col("size") / members).cast("int")
    to = F.when(anchors, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "rep", F.lit(1)), blocks).cast("int")))
    return large.select("rep", "node", F.explode(to).alias("block")).select(F.xxhash64("node", "block").alias("node"), "rep")


def _leaves(reps: DataFrame, trees: range, links: _Links, scratch: Scratch) -> DataFrame:
    """(node, rep) of what is left to compare of all ``trees``, in nodes of about LEAF representatives at most."""
    coordinate = lambda c: F.substr("signature", 4 * c + 1, F.lit(4))
    of_tree = [F.xxhash64(F.lit(t), coordinate(F.lit((t * 37 + 11) % COORDINATES))) for t in trees]
    level = reps.select("rep", F.explode(F.array(*of_tree)).alias("node"))
    leaves = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = scratch.write(level.join(sizes, "node"), f"level-{depth}")
        leaves.append(sized.where(F.col("size") <= LEAF).select("node", "rep"))
        large = sized.where(F.col("size") > LEAF)
        for again in (False, True):  # by the links known, then by those in the blocks
            if large.isEmpty():
                return _union(leaves)
            if again:
                links.compare(_blocks(large, max(2, LEAF // 8), min(ANCHORS, max(1, LEAF // 8))))
            if links.labels is not None:
                settled, large = links.settle(large)
                leaves.append(settled)
        if large.isEmpty():
            return _union(leaves)
        # the node's path chooses its coordinates
        first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(COORDINATES)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(COORDINATES - 1)).cast("int"), F.lit(COORDINATES))
        twice = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < second_branch(links.percent)
        chosen = F.when(twice, F.array(first, second)).otherwise(F.array(first))
        level = large.select("node", "rep", chosen.alias("chosen")).join(reps.select("rep", "signature"), "rep").select(
            "rep", "node", "signature", F.explode("chosen").alias("c"))
        level = level.select("rep", F.xxhash64("node", "c", coordinate(F.col("c"))).alias("node"))
    # documents that agree in so many coordinates and aren't linked: blocks that share a quarter of a leaf's documents, others in each tree
    leaves.append(_blocks(large, max(1, LEAF // 4), LEAF / 4))
    return _union(leaves)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _joined_at_once(links: DataFrame) -> DataFrame:
    """``components`` of at most LINKS_AT_ONCE links, in one task."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[:len(a)], ends[len(a):]
        label = np.arange(len(names))
        while True:  # least label of the neighbours, then that label's label
            before = label.copy()
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], least)
            np.minimum.at(label, label[y], least)
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["rep", "component"])

    return links.coalesce(1).mapInArrow(solve, "rep long, component long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, component) of all that ``links`` (a, b) name: the smallest that each is connected with.

    Every step takes the least label of a node's neighbours and then that label's label, so paths
    shorten by half or more; it ends when no label changes.
    """
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.col("rep")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("near"))
        step = labels.join(near, "rep").select("rep", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("rep").alias("mid"), F.col("component").alias("far"))
        new = scratch.write(step.join(jump, "mid", "left").select("rep", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        changed = not new.where("old != component").isEmpty()
        scratch.drop(labels)
        labels = new.drop("old")
        labels._kindling_path = new._kindling_path
        if not changed:
            scratch.drop(both)
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Texts without words, and null ones, have no shingles and are linked with nothing.  Rows without
    an id are linked with nothing either; their component is null and they are kept.  Repeated rows
    have the same component, and so have the texts of one id; extra columns don't matter; an empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    docs = documents_of(df, id_col, text_col)
    sketched = docs.mapInArrow(lambda b: tidied(_sketches(b, shingle)), "doc_id long, n_shingles long, set_id binary, signature binary, sketch binary")
    sketched = scratch.write(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = sketched.where("doc_id is not null and set_id is not null")
    # a class of equal sets goes by the number of one of its rows, since an id may have several texts
    one = F.min_by(F.struct("doc_id", "signature", "sketch"), "row").alias("one")
    reps = known.groupBy("set_id").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_doc"), one)
    reps = scratch.write(reps.select("rep", "set_id", "one.doc_id", "one.signature", "one.sketch", "least_doc"), "classes")
    links, start = _Links(docs, reps, shingle, percent, scratch), 0
    several = known.groupBy("doc_id").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last")).where("first <> last").select("doc_id", "first")
    several = scratch.write(several.coalesce(most_tasks(df.sparkSession)), "several")
    if not several.isEmpty():
        pairs = known.select("doc_id", "set_id").join(several, "doc_id").where("set_id <> first").select("set_id", "first").distinct()
        of = reps.select("set_id", "rep")
        links.add(scratch.write(pairs.join(of, "set_id").withColumnRenamed("rep", "b").drop("set_id").join(
            of.withColumnRenamed("set_id", "first"), "first").select(F.col("rep").alias("a"), "b"), "links"))
    for trees in rounds(percent):
        links.compare(_leaves(reps, range(start, start + trees), links, scratch))
        start += trees
    found = links.marked(reps.select("rep", "set_id", "least_doc"))
    least = found.groupBy("part").agg(F.min("least_doc").alias("component_id"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("part", "component_id")
    found = found.join(least, "part", "left").select("set_id", F.coalesce("component_id", "least_doc").alias("component_id"))
    rows = sketched.select("doc_id", "n_shingles", "set_id")
    # rows without words share no key: they take no part in the join
    out = rows.where("set_id is not null").join(found, "set_id", "left").unionByName(rows.where("set_id is null").withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
