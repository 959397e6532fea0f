"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers.  The index holds, for a block of up to
BLOCK_ROWS vectors of one length, a bitmap for each bit of each attribute (taken
relative to the block's least value).  A query adds the slices with bitmap
arithmetic: attribute slices shifted by the set bits of the query's weight, slices
complemented where the weight is negative, columns of equal significance summed by
carry-save adders.  The sum's slices are then walked from the most significant
downward to select the top rows: those sure to be in, and those at the boundary,
which are resolved exactly by their scores and ids.

Queries come in blocks too, and go to the index: each index block is built once, in
one task, and the query blocks stream past it.  What a pair returns is at most k
rows for each query; the merge keeps k rows for each query.  Only where the table
has fewer blocks than the cluster has cores, a block is built in a few tasks, each
for a share of the query blocks.

Defined cases: vectors that are null, empty or hold a null or non-finite component
take no part; a query meets only vectors of its own length; rows with equal ids
are candidates each, but never for a query with that id; quantised components are
expected below 2**31 in size and scores below 2**62; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 64
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 256
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, size and items: floor(scale * x) of each component, of all usable vectors."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast("double") * scale).alias("x"))
    good = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(good).select("vec_id", F.size("x").alias("size"), F.transform("x", lambda x: F.floor(x)).alias("items"))


class Index:
    """Bit slices of a block of vectors: slices[d][b] is the bitmap of bit b of attribute d, relative to `low`."""

    def __init__(self, ids: np.ndarray, items: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.items = ids[order], items[order]
        n, d = items.shape
        self.low = int(items.min())
        self.bits = max(1, int(items.max() - self.low).bit_length())
        words = -(-n // 64)
        shifted = (self.items - self.low).astype(np.uint64)
        self.slices = np.zeros((d, self.bits, words), np.uint64)
        for b in range(self.bits):
            on = ((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(on, axis=0, bitorder="little")
            whole = np.zeros((words * 8, d), np.uint8)
            whole[: len(packed)] = packed
            self.slices[:, b] = np.ascontiguousarray(whole.T).view(np.uint64)
        self.flipped = ~self.slices
        self.all = np.zeros(words, np.uint64)
        self.all[: n // 64] = ~np.uint64(0)
        if n % 64:
            self.all[n // 64] = np.uint64((1 << (n % 64)) - 1)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the rows' scores less a constant of the query."""
        columns: list[list[np.ndarray]] = []
        for d, w in enumerate(query.tolist()):
            source, w, shift = (self.slices[d], w, 0) if w >= 0 else (self.flipped[d], -w, 0)
            while w:
                if w & 1:
                    while len(columns) < shift + self.bits:
                        columns.append([])
                    for b in range(self.bits):
                        columns[shift + b].append(source[b])
                w, shift = w >> 1, shift + 1
        out, k = [], 0
        while k < len(columns):
            column = columns[k]
            if len(column) > 2 and k + 1 == len(columns):
                columns.append([])
            while len(column) > 2:  # three bitmaps of one weight become one of it and one of twice it
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[k + 1].append((a & b) | (half & c))
            if len(column) == 2:
                if k + 1 == len(columns):
                    columns.append([])
                a, b = column
                column = [a ^ b]
                columns[k + 1].append(a & b)
            out.append(column[0] if column else np.zeros_like(self.all))
            k += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best rows, its own left out; ties to the smaller id."""
        sure, edge = np.zeros_like(self.all), self.all.copy()
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1])
        for row in range(a, b):
            edge[row // 64] &= ~np.uint64(1 << (row % 64))
        for s in reversed(self.sums(query)):
            both = sure | (edge & s)
            n = int(np.bitwise_count(both).sum())
            if n >= k:
                edge = edge & s
                if n == k:
                    break
            else:
                sure, edge = both, edge & ~s
        rows = np.flatnonzero(np.unpackbits((sure | edge).view(np.uint8), bitorder="little"))
        scores = self.items[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _packed(rows: DataFrame, block: F.Column, names: list[str]) -> DataFrame:
    """One row for each block: its ids and items as bytes."""
    schema = "block long, size int, ids binary, items binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, items = None, [], []
        for batch in batches:
            keys = list(zip(batch["size"].to_pylist(), batch["block"].to_pylist(), strict=True))
            own = np.asarray(batch["vec_id"])
            flat, at = np.asarray(batch["items"].flatten()), np.concatenate([[0], np.cumsum(np.asarray(batch["size"]))])
            edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for p, q in zip(edges[:-1], edges[1:], strict=True):
                if q > p:
                    if keys[p] != now and ids:
                        yield done(now, ids, items)
                        ids, items = [], []
                    now = keys[p]
                    ids.append(own[p:q])
                    items.append(flat[at[p] : at[q]])
        if ids:
            yield done(now, ids, items)

    def done(key: tuple, ids: list, items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[1]]), pa.array([key[0]], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(items).astype("<i8").tobytes()])], ["block", "size", "ids", "items"])

    keyed = rows.withColumn("block", block).repartition("size", "block").sortWithinPartitions("size", "block", "vec_id")
    return keyed.mapInArrow(run, schema).toDF(*names)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs as `quantised` gives them, every row of `queries` against every other row of `vectors`."""
    n, m = vectors.count(), queries.count()
    parts, asked = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    shares = min(asked, max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // parts)))  # 1 on a large table
    spread = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    index = _packed(vectors, spread(parts), ["block", "size", "ids", "items"]).select("size", "block", every(shares).alias("share"), F.lit(-1).cast("long").alias("q_block"), "ids", "items")
    blocks = _packed(queries, spread(asked), ["q_block", "size", "ids", "items"]).select("size", every(parts).alias("block"), F.pmod("q_block", F.lit(shares)).alias("share"), "q_block", "ids", "items")
    # an index block, and then the stated queries against it, block by block
    keys = ["size", "block", "share"]
    rows = index.unionByName(blocks).repartition(parts * shares, *keys).sortWithinPartitions(*keys, "q_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                size, part, share, q_block, ids, items = (batch.column(c)[r] for c in range(6))
                size, key = size.as_py(), (size.as_py(), part.as_py(), share.as_py())
                ids, items = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(items.as_buffer(), "<i8").reshape(-1, size)
                if q_block.as_py() < 0:
                    now, block = key, Index(ids, items)
                elif key == now:  # else no vector of this size is in the block
                    found = [(q, *block.top(int(q), w, k)) for q, w in zip(ids, items, strict=True)]
                    who = np.repeat(ids, [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    best = rows.mapInArrow(run, RESULT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
