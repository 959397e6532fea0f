"""Exact substring dedup over bytes by sorted suffixes of shards.

Pieces: a window of WINDOW bytes belongs to its anchor, the least hash among its
runs of ANCHOR bytes (see `repeats`); the windows with one anchor at one place are
a piece of at most 2 * WINDOW - ANCHOR bytes.  Equal windows have equal anchors, so
all that is asked of a window is settled among the pieces of its anchor.

First the pieces go by their anchor's hash and their content's, without bytes.
Where an anchor has one content only, its first piece by (doc_id, start) stays and
all others hold windows that start earlier.  Only where it has several, one piece of
each content is sent with its bytes, to the shard of the anchor: what is sent grows
with the different surroundings of repeats and not with the copies.

An anchor with more pieces than a shard's fair share of all (a line that very many
texts share, in different surroundings), and with more than HOT, is no shard's work:
its pieces' windows go one by one, by their own hash, and are settled as pieces are;
each window then has its own place in the deal.

Each shard sorts its suffixes with common prefixes by external induced sorting
(`suffix`): in the order of the suffixes, runs whose common prefix reaches WINDOW
are equal windows; the first by (doc_id, start) stays, the others' bytes go.

Memory of a task: a shard's bytes, its suffixes and their queues are in files of
the task beyond `memory` bytes; four numbers for each piece are in memory.  Shards
are as many as the session's shuffle partitions.  Contents, and windows of anchors with
many pieces, are told apart by 64-bit hashes of at most 168 bytes, other windows by
their bytes.

Defined cases: a null text is empty; rows without a doc_id keep all bytes; rows
with one doc_id and different texts count as one document, equal starts as not
earlier; equal rows have equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm import repeats as R
from tessera.llm._session import cut
from tessera.llm.suffix import MEMORY, Shard
from tessera.llm.tokens import spread

WINDOW, ANCHOR = 100, 32
#: Pieces that a task gathers before it tells the equal ones among them apart.
BUFFER = 300_000
#: Pieces of an anchor, after equal ones of a buffer are taken as one, up to which they go to one shard whatever its share.
HOT = 1_000
_PLACED = "key long, content long, doc_id long, th int, place long"  # place: start, further starts, and whether it is known to be later
_SHIPPED = "key long, doc_id long, th int, lo int, piece binary"
_SPANS = "doc_id long, th int, lo int, hi int"


def placed(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Anchor, content and place of every piece; of the equal ones in a buffer one stands for all, and the others go as known ranges."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Columns]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            docs, ths = np.asarray(batch["doc_id"]), np.asarray(batch["th"])
            for a, b in T.steps(data, offsets):
                body, of = T.sub(data, offsets, a, b)
                key, text, lo, hi = R.segments(T.BYTE_TABLE[body], of, window, k)
                content = T.hash_ranges(body, of[text] + lo, of[text] + hi + window)
                yield key, content, docs[a:b][text], ths[a:b][text], lo.astype(np.int32), (hi - lo).astype(np.int32)

    return rows.mapInArrow(lambda batches: _fresh(found(batches)), _PLACED)


def _fresh(found: Iterator[R.Columns]) -> Iterator[pa.RecordBatch]:
    for key, content, doc, th, lo, more in R.buffered(found, BUFFER):
        order = np.lexsort((lo, doc, content))
        key, content, doc, th, lo, more = (x[order] for x in (key, content, doc, th, lo, more))
        fresh = np.append(True, content[1:] != content[:-1])[: len(content)]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(content)), 0))
        later = (doc > doc[first]) | (lo > lo[first])
        who, start, end = R.merged(doc[later], th[later], lo[later], lo[later] + more[later])
        spread_key = T.as_long(R.spread_key(who[0], start))
        wide = start.astype(np.int64) << 33 | (end - start).astype(np.int64) << 2
        own = lo[~later].astype(np.int64) << 33 | more[~later].astype(np.int64) << 2
        columns = np.append(T.as_long(key[~later]), spread_key), np.append(T.as_long(content[~later]), spread_key), np.append(doc[~later], who[0]), np.append(th[~later], who[1]), np.append(own, wide | 1)
        yield from R.batches(columns, _PLACED)


def windows(joined: DataFrame, window: int) -> DataFrame:
    """Every window of the given ranges as a piece of its own: its hash is its anchor and its content."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Columns]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            row, lo, hi = R.ranges_of(batch["ranges"])
            docs, ths = np.asarray(batch["doc_id"]), np.asarray(batch["th"])
            for a, b in T.steps(data, offsets):
                p, q = np.searchsorted(row, [a, b])
                n = hi[p:q] - lo[p:q] + 1
                at, text = spread(lo[p:q], n), np.repeat(row[p:q], n)
                key = T.hash_windows(T.BYTE_TABLE[data[offsets[a] : offsets[b]]], window)[offsets[text] - offsets[a] + at] if len(at) else np.zeros(0, np.uint64)
                yield key, key, docs[text], ths[text], at.astype(np.int32), np.zeros(len(at), np.int32)

    return joined.mapInArrow(lambda batches: _fresh(found(batches)), _PLACED)


def settled(found: DataFrame) -> DataFrame:
    """doc_id, th, lo, hi and `ship` of pieces known to be later (0), and of those whose anchor has other contents too (the anchor's number of pieces).

    A spread key may equal an anchor's by chance; that only ships a piece too many.
    """
    lo, more = F.expr("cast(shiftrightunsigned(place, 33) as int)"), F.expr("cast(shiftrightunsigned(place, 2) & 2147483647 as int)")
    known = F.expr("place & 1 = 1")
    same = W.partitionBy("key")
    several = found.withColumn("n", F.count("*").over(same)).withColumn("a", F.min("content").over(same)).withColumn("b", F.max("content").over(same)).where(known | F.expr("n > 1"))
    first = F.min(F.when(~known, F.struct("doc_id", "place"))).over(W.partitionBy("key", "content"))
    later = known | F.expr("doc_id > first.doc_id or shiftrightunsigned(place, 33) > shiftrightunsigned(first.place, 33)")
    return several.withColumn("first", first).select("doc_id", "th", lo.alias("lo"), (lo + more).alias("hi"), F.when(later, F.lit(0)).otherwise(F.col("n")).alias("ship"), "a", "b").where("ship = 0 or a <> b").drop("a", "b")


def pieces(joined: DataFrame, window: int, k: int) -> DataFrame:
    """The bytes of every piece whose windows start in the given ranges, with its anchor's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            row, lo, hi = R.ranges_of(batch["ranges"])
            for a, b in T.steps(data, offsets):
                p, q = np.searchsorted(row, [a, b])
                n = hi[p:q] - lo[p:q] + window
                part = data[spread(offsets[row[p:q]] + lo[p:q], n)]
                of = np.concatenate([[0], np.cumsum(n)])
                key, stretch, first, last = R.segments(T.BYTE_TABLE[part], of, window, k)
                size = last - first + window
                ends = np.concatenate([[0], np.cumsum(size)])
                body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(part[spread(of[stretch] + first, size)])])
                who = pa.array(row[p:q][stretch])
                yield pa.RecordBatch.from_arrays([pa.array(T.as_long(key)), batch["doc_id"].take(who), batch["th"].take(who), pa.array((lo[p:q][stretch] + first).astype(np.int32)), body.cast(pa.binary())], R.names(_SHIPPED))

    return joined.mapInArrow(run, _SHIPPED)


def shards(shipped: DataFrame, window: int, memory: int = MEMORY) -> DataFrame:
    """Ranges of window starts whose bytes also start earlier, among the pieces of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Shard(window, memory) as shard:
            held = []
            for batch in batches:
                raw, of = T.utf8_like(batch["piece"])
                shard.add(raw)
                held.append((*(np.asarray(batch[c]) for c in ("doc_id", "th", "lo")), np.diff(of).astype(np.int32)))
            if not held:
                return
            doc, th, lo, size = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.cumsum(size, dtype=np.int64)
            for position, common in shard.runs():
                of = np.searchsorted(ends, position, "right")
                inner = position - (ends[of] - size[of])
                good = inner <= size[of] - window
                of, inner, run = of[good], inner[good], np.cumsum(common < window)[good]
                at = lo[of] + inner
                order = np.lexsort((at, doc[of], run))
                of, at, run = of[order], at[order], run[order]
                fresh = np.append(True, run[1:] != run[:-1])[: len(run)]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
                later = (doc[of] > doc[of[first]]) | (at > at[first])
                if later.any():
                    who, a, b = R.merged(doc[of[later]], th[of[later]], at[later], at[later])
                    yield from R.batches((*who, a, b), _SPANS)

    return shipped.repartition("key").mapInArrow(run, _SPANS)


def remove(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """doc_id, the kept bytes, the numbers of bytes before and removed, and of removed runs."""
    rows = R.identified(docs, doc_id, text)
    known, others = rows.where("doc_id is not null"), rows.where("doc_id is null")
    found = cut(settled(placed(known, window, k)))
    share = found.where("ship > 0").count() // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_of, hot = F.struct("lo", "hi"), F.col("ship") > max(HOT, share)
    ship = cut(found.where("ship > 0").groupBy("doc_id", "th").agg(F.collect_list(range_of).alias("ranges"), F.collect_list(F.when(~hot, range_of)).alias("whole"), F.collect_list(F.when(hot, range_of)).alias("single")))
    small = R.few(ship)
    joined = R.with_ranges(known, ship.drop("ranges"), "inner", small)
    to = lambda c: joined.select("doc_id", "th", "text", F.col(c).alias("ranges"))
    later = found.where("ship = 0").drop("ship").unionByName(shards(pieces(to("whole"), window, k), window, memory))
    if not ship.where("size(single) > 0").isEmpty():
        later = later.unionByName(settled(windows(to("single"), window)).drop("ship"))  # one content each: none is left to ship
    spans = R.gathered(later)
    if small:
        spans = cut(spans)
        small = R.few(spans)
    # else the texts' exchange is the one that brought them to their pieces
    return _without(R.with_ranges(known, spans, "left", small), window).unionByName(_without(others.withColumn("ranges", F.lit(None).cast("array<struct<lo:int,hi:int>>")), window))


def _without(rows: DataFrame, window: int) -> DataFrame:
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            row, lo, hi = R.ranges_of(batch["ranges"])
            row, lo, hi = R.merge(row, lo, hi + window - 1)  # byte ranges
            n = np.diff(offsets)
            keep = np.ones(len(data) + 1, np.int8)
            edge = np.zeros(len(data) + 1, np.int8)
            np.add.at(edge, offsets[row] + lo, 1)
            np.subtract.at(edge, offsets[row] + hi + 1, 1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            removed = np.bincount(row, hi - lo + 1, len(n)).astype(np.int64)
            body = data[keep]
            ends = np.concatenate([[0], np.cumsum(n - removed)])
            binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], binary, pa.array(n), pa.array(removed), pa.array(np.bincount(row, minlength=len(n)).astype(np.int64))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.select("doc_id", "text", "ranges").mapInArrow(run, schema)


def digest(kept: DataFrame) -> DataFrame:
    """The result of `remove` with the kept bytes' hash in their place."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def reference(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """By definition, for tests."""
    import hashlib

    texts = {i: (t or "").encode() for i, t in rows}
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        b = texts[i]
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            piece = b[k : k + window]
            if piece in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(piece)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out
