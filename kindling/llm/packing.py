"""Packing by Karmarkar-Karp multiway differencing (8).

A document's ids (with the closing id) are cut into full windows, which are sequences by
themselves, and a tail in parts of an eighth of a window at most (small parts balance better).  Parts are dealt at random to buckets of bounded size; in each, multiway
differencing spreads them over ceil(tokens / window) windows: of two partial partitions, the
fullest windows of one go together with the emptiest of the other, always for the two partitions
of largest imbalance, until one is left.  Where its fullest window is over capacity, the bucket
starts again with one window more.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.bpe import default_path, loaded
from kindling.llm.common import CHUNK_BYTES, Scratch, documents_of, give_back, mix, table, text_chunks, tidied

WINDOW, CLOSING_ID, PARTS_PER_BUCKET = 4096, 2, 1024


def _all_ways(sums: Any, nodes: Any, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of all ways' sums and nodes, from those or from lists of the ways that aren't empty."""
    if not isinstance(nodes, list):
        return sums, nodes
    empty = ways - len(nodes)
    return -np.array(sums + [0] * empty, np.int64), np.array(nodes + [-1] * empty, np.int64)


def difference_partition(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The way (0 to ways - 1) of each size, by multiway differencing; sums come out nearly equal."""
    n = len(sizes)
    if ways <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # a partial partition: sums in falling order less the least, and the node of each way's members;
    # nodes below n are items, the others join two nodes.  While some ways are empty, only the others
    # are listed, and the sums are lists of negatives
    joined: list[tuple[int, int]] = []
    heap: list[tuple[int, int, Any, Any]] = [(-s, i, [-s], [i]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(x) + len(y) < ways:  # no way has members in both
            if len(y) == 1:
                at = bisect_right(a, b[0])
                a.insert(at, b[0])
                x.insert(at, y[0])
            else:
                both = sorted(zip(a + b[::-1], x + y[::-1], strict=True), key=itemgetter(0))
                a, x = (list(v) for v in zip(*both, strict=True))
            heapq.heappush(heap, (a[0], tie, a, x))
            tie += 1
            continue
        (a, x), (b, y) = _all_ways(a, x, ways), _all_ways(b, y, ways)
        sums, y = a + b[::-1], y[::-1]
        nodes = np.maximum(x, y)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        nodes[both] = n + len(joined) + np.arange(len(both))
        joined += zip(x[both].tolist(), y[both].tolist(), strict=True)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order] - sums.min(), nodes[order]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, nodes))
        tie += 1
    way = [-1] * (n + len(joined))
    for w, node in enumerate(heap[0][3]):
        if node >= 0:
            way[node] = w
    for k in range(len(joined) - 1, -1, -1):
        a, b = joined[k]
        way[a] = way[b] = way[n + k]
    return np.array(way[:n], np.int64)


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; no window holds more than ``capacity`` (nor does any size)."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        way = difference_partition(sizes, ways)
        if len(way) == 0 or np.bincount(way, sizes).max() <= capacity:
            return way
        ways += 1


def _pieces(batches: Iterable[pa.RecordBatch], path: str, window: int, closing: int) -> Iterator[pa.RecordBatch]:
    bpe, end, row = loaded(path), int(closing).to_bytes(4, "little"), 0
    for k, (ids, texts) in enumerate(text_chunks(batches, CHUNK_BYTES // 4, keep="bpe")):
        if k % 4 == 0:
            give_back()  # what earlier chunks used; it takes a millisecond
        coded_ids, counts = bpe.encode_texts(texts)
        packed, stops, out = coded_ids.astype("<u4").tobytes(), np.cumsum(counts).tolist(), []
        for doc_id, count, stop_at in zip(ids.to_pylist(), counts.tolist(), stops, strict=True):
            coded = packed[4 * (stop_at - count):4 * stop_at] + end
            n = count + 1
            full = n // window * window
            for start in (*range(0, full, window), *range(full, n, max(1, window // 8))):
                stop = start + window if start < full else min(n, start + max(1, window // 8))
                out.append((doc_id, row, start, stop - start, coded[4 * start:4 * stop], n))
            row += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
            names=["doc_id", "row", "start", "length", "ids", "doc_tokens"])


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 window: int = WINDOW, closing: int = CLOSING_ID) -> DataFrame:
    """(doc_id, row, start, length, ids, doc_tokens): every document's ids and the closing id, cut
    into windows; ids are little-endian unsigned 32-bit; ``row`` numbers a task's documents."""
    path = path or default_path()
    return documents_of(df, id_col, text_col).mapInArrow(
        lambda batches: tidied(_pieces(batches, path, window, closing)),
        "doc_id long, row long, start long, length long, ids binary, doc_tokens long")


def pack(pieces: DataFrame, pieces_count: int, window: int = WINDOW, per_bucket: int = PARTS_PER_BUCKET) -> DataFrame:
    """``pieces`` (doc_id, row, start, length, piece and any columns more) with sequence_id and offset.

    Each piece lies whole in one sequence of at most ``window`` tokens.  A full piece is one by
    itself (id -1 - ``piece``, which numbers the rows) and isn't shuffled.  Parts are spread over ``pieces_count /
    per_bucket`` buckets by document and row, so repeated rows and null ids spread too, and a very
    long text sends its bucket no more than its tail; their sequences' ids have the bucket in the upper 32 bits.  No pieces, no rows.
    """
    full = pieces.where(F.col("length") >= window).withColumn("sequence_id", -1 - F.col("piece")).withColumn("offset", F.lit(0).cast("long"))
    pieces = pieces.where(F.col("length") < window)
    buckets = max(1, pieces_count // per_bucket)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        rows = rows.drop(columns="_bucket").sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True],
                                                        ignore_index=True)
        rows["sequence_id"] = (bucket << 32) + pack_sizes(rows["length"].to_numpy(), window).astype(np.int64)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows

    bucketed = pieces.withColumn("_bucket", F.pmod(mix("doc_id", "row"), F.lit(buckets)))
    return full.unionByName(bucketed.groupBy("_bucket").applyInPandas(packed, schema))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   window: int = WINDOW, closing: int = CLOSING_ID) -> DataFrame:
    """All documents in sequences of at most ``window`` tokens: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    A null or empty text has the closing id alone.  Repeated rows are packed each.  Ids of the
    pieces stay in the tasks; only what describes the pieces is shuffled.
    """
    pieces = token_pieces(df, id_col, text_col, path, window, closing)
    pieces = pieces.select("doc_id", "row", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    described = Scratch(df.sparkSession, "packing").write(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return pack(described, described.where(F.col("length") < window).count(), window).drop("row", "piece")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
