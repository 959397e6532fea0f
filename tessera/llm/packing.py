"""Packing: shortest-pack-first over the length histogram.

`pieces` tokenizes each text, appends the end id and cuts the ids into pieces of
at most `capacity`: full ones, and one shorter rest.  `plan` packs the histogram
of the lengths, at most `capacity` numbers however large the corpus: lengths are
placed longest first, each count at once, into the packs that are shortest so
far and still have room, splitting a group of equal packs where the count is
smaller than the group; what fits nowhere opens new packs.  `place` then joins
the packing patterns back to the pieces by their rank among the pieces of their
length.

Ranks are made without a global sort and without gathering a length in one task:
the pieces of a length are spread over hash buckets, as many as its count asks for,
ranked inside (length, bucket), and shifted by the buckets before.  Size of what the driver handles: the histogram and the
groups, of which there are at most two for each length (placing a count makes at
most one split group and one new one), each with at most 90 distinct lengths.

Defined cases: a null text is empty; an empty text is a piece of the end id
alone; equal rows get pieces of their own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._session import cut
from tessera.llm.tokens import spread, unit_table

CAPACITY = 4096
#: Pieces that a bucket of a length holds on average.
BUCKET = 1_000
#: Bytes of text whose words are looked up at a time; bounds the worker's memory.
STEP = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def solid_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: this tokenizer drops white space, and no pre-token or normalisation crosses it."""
    return T.words(data, offsets)


def ids_of(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids with the end id) of every text."""
    data, offsets = T.utf8(column)
    table = unit_table(path, solid_units)
    for a, b in T.steps(data, offsets, STEP):
        d, o = T.sub(data, offsets, a, b)
        starts, ends, of = solid_units(d, o)
        begin, sizes = table.look_up(d, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = table.ids[spread(begin, sizes)] if len(starts) else np.zeros(0, np.uint32)
        total = np.concatenate([[0], np.cumsum(sizes)])
        for row in range(a, b):
            yield row, np.append(flat[total[of[row - a]] : total[of[row - a + 1]]], np.uint32(end_id)).astype("<u4")


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each text: where it begins, its length, and the CRC of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            names = batch["doc_id"].to_pylist()
            for row, ids in ids_of(batch["text"], path, end_id):
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    out.append((names[row], at, len(part), zlib.crc32(part), len(ids)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


@dataclass
class Group:
    """`count` equal packs; each holds, for every (length, number), so many pieces of that length."""

    count: int
    parts: tuple[tuple[int, int], ...]
    used: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Shortest-pack-first packing of the histogram."""
    done: list[Group] = []
    open_by_used: dict[int, list[Group]] = {}
    heap: list[int] = []  # the lengths of open packs, each once

    def put(g: Group) -> None:
        if g.used == capacity:
            done.append(g)
            return
        if g.used not in open_by_used:
            open_by_used[g.used] = []
            heapq.heappush(heap, g.used)
        open_by_used[g.used].append(g)

    def more(g: Group, count: int, length: int, times: int) -> Group:
        parts = (*g.parts[:-1], (length, g.parts[-1][1] + times)) if g.parts and g.parts[-1][0] == length else (*g.parts, (length, times))
        return Group(count, parts, g.used + length * times)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        made: list[Group] = []
        while left and heap and heap[0] + length <= capacity:
            group = open_by_used[heap[0]].pop()
            if not open_by_used[heap[0]]:
                del open_by_used[heapq.heappop(heap)]
            take = min(left, group.count)
            if take < group.count:
                put(Group(group.count - take, group.parts, group.used))
            left -= take
            # put back at once: a pack that took one may be the shortest again only after the others
            made = [more(group, take, length, 1)]
            put(made[0])
        fit = capacity // length
        if left >= fit:
            put(more(Group(0, (), 0), left // fit, length, fit))
            left %= fit
        if left:
            put(more(Group(0, (), 0), 1, length, left))
    for groups in open_by_used.values():
        done += groups
    return done


@dataclass(frozen=True)
class Slots:
    """For each run of ranks of a length: which packs they go to, and where in them.  Sorted by key = length * 2**40 + rank."""

    key: np.ndarray
    base: np.ndarray
    times: np.ndarray
    offset: np.ndarray


def slots(groups: list[Group]) -> Slots:
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for g in groups:
        offset = 0
        for length, times in g.parts:
            rank = ranks.get(length, 0)
            rows.append(((length << 40) + rank, first, times, offset))
            ranks[length] = rank + g.count * times
            offset += length * times
        first += g.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*table.T)


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """rows with a rank from 0 among the rows of their length; histogram: how many those are."""
    spread_over = rows.sparkSession.createDataFrame([(k, -(-n // BUCKET)) for k, n in histogram.items()], "length long, buckets int")  # a row for each length
    rows = rows.join(F.broadcast(spread_over), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets")).cast("int")).drop("buckets")
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    return rows.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def place(rows: DataFrame, where: Slots) -> DataFrame:
    """rows (with rank) and the sequence and offset of each."""
    shared = rows.sparkSession.sparkContext.broadcast(where)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            key = (length << 40) + rank
            at = np.searchsorted(s.key, key, "right") - 1
            past = key - s.key[at]
            pack, nth = past // s.times[at], past % s.times[at]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s.base[at] + pack), pa.array(s.offset[at] + nth * length)], [*names, "sequence_id", "offset"])

    return rows.select(*names, "rank").mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces of all texts, with the sequence each lies in and its offset there."""
    rows = cut(pieces(docs, path, end_id, capacity, doc_id, text))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(ranked(rows, histogram), slots(plan(histogram, capacity)))
