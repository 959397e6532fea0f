"""Substring dedup over words with fixed-block anchors.

Every text's non-overlapping blocks of BLOCK words make up the index; every rolling
run of BLOCK words probes it.  A block is hit if its words also stand elsewhere, at
any place of any text.  A window of WINDOW >= 2 * BLOCK - 1 words holds a whole block
of its own text, and if the window repeats, each block inside it is hit: by the run
at the same place of the other occurrence.  So hits are extended: a chain of hit
blocks reaches left and right to just before the next block that isn't hit, the
windows inside are keyed by their content, and where that also starts earlier
(smaller doc_id, or same document and earlier start) all its words go.  Runs of such
windows make up the maximal repeats.

The index and the probes are dealt by their hash over the session's shuffle
partitions: 32 more bits of the hash for each distinct run of a buffer of texts, as
packed arrays, and the place only for the blocks.  Two hashes that agree by chance
cost a comparison and nothing else, as windows are compared by all 64 bits.  Hits
are told by counting, never as pairs: a block that a third of all texts hold is sent
once for each buffer, and so is a window.  A task holds one part of the deal, 4 bytes
a word and 24 a window of the chains.  The texts cross one exchange, to meet their
hits and then to lose their words; where the hits are few, they are broadcast.

Defined cases: a null text has no words; rows without a doc_id keep all words;
rows with one doc_id and different texts are windows of "the same document" with
equal starts counting as not earlier; equal rows have equal results; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm import repeats as R
from tessera.llm._session import cut
from tessera.llm.tokens import spread

WINDOW, BLOCK = 20, 10
#: Runs or windows that a task gathers before it tells the equal ones among them apart.
BUFFER = 1_000_000
_DEALT = "part int, seen binary, blocks binary, docs binary, ths binary, lo binary, hi binary"
_HITS = "doc_id long, th int, lo int, hi int"


def _runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[R.Columns]:
    """For every rolling run of `block` words its hash, doc_id and th, and the number of the block it is, or -1."""
    for batch in batches:
        data, offsets = T.utf8(batch["text"])
        docs, ths = np.asarray(batch["doc_id"]), np.asarray(batch["th"])
        for a, b in T.steps(data, offsets):
            values, of = R.word_items(*T.sub(data, offsets, a, b))
            start, row = T.window_rows(of, block)
            at = start - of[row]
            no = np.where(at % block == 0, at // block, -1).astype(np.int32)
            yield T.hash_windows(values, block)[start], docs[a:b][row], ths[a:b][row], no


def _by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by part, the cuts between the parts, and the other 32 bits of the keys in that order."""
    part = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1)), key[order].astype(np.uint32)


def deal(rows: DataFrame, block: int, parts: int) -> DataFrame:
    """The index's blocks with their places, and the other runs, dealt by hash; blocks known to be hit in their buffer go as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, th, no in R.buffered(_runs(batches, block), BUFFER):
            order = np.argsort(key, kind="stable")
            key, doc, th, no = key[order], doc[order], th[order], no[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(head, len(key)))
            asks = (times == 1) & (no[head] >= 0)  # a block that its buffer has nowhere else
            ask, told = head[asks], np.flatnonzero((no >= 0) & np.repeat(times > 1, times))
            _, seen_cuts, seen = _by_part(key[head[~asks]], parts)
            order, cuts, blocks = _by_part(key[ask], parts)
            ask = ask[order]
            out = []
            for p in range(parts):
                x, y, u, v = *cuts[p : p + 2], *seen_cuts[p : p + 2]
                if x < y or u < v:
                    who = ask[x:y]
                    out.append((p, seen[u:v].tobytes(), blocks[x:y].tobytes(), doc[who].tobytes(), th[who].tobytes() if th[who].any() else b"", no[who].tobytes(), None))
            yield _told(out, (doc[told], th[told], no[told], no[told]), parts)

    return rows.mapInArrow(run, _DEALT)


def _told(out: list[tuple], known: R.Columns, parts: int) -> pa.RecordBatch:
    """Rows to deal, and ranges of texts that need no dealing, in a row of their own."""
    if len(known[0]):
        who, lo, hi = R.merged(*known)
        out.append((int(R.spread_key(who[0][:1], lo[:1])[0] % np.uint64(parts)), None, None, who[0].tobytes(), who[1].tobytes(), lo.tobytes(), hi.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary() if k else pa.int32()) for k in range(7)], R.names(_DEALT))


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | pa.StructArray]:
    """The ranges among dealt rows as batches, and the other rows as they are."""
    for batch in batches:
        told = batch.filter(batch["hi"].is_valid()).to_struct_array()
        if len(told):
            yield from R.batches(tuple(_arrays(told, ("docs", np.int64), ("ths", np.int32), ("lo", np.int32), ("hi", np.int32))), _HITS)
        yield batch.filter(batch["hi"].is_null()).to_struct_array()


def _arrays(rows: pa.StructArray, *columns: tuple[str, type]) -> Iterator[np.ndarray]:
    """The packed columns of all rows one after another; an empty th is 0 throughout."""
    docs = [len(x) // 8 for x in rows.field("docs").to_pylist()]
    for name, kind in columns:
        raw = rows.field(name).to_pylist()
        yield np.frombuffer(b"".join(x or (bytes(4 * n) if name == "ths" else b"") for x, n in zip(raw, docs, strict=True)), kind)


def hits(dealt: DataFrame, parts: int) -> DataFrame:
    """doc_id, th and ranges of the numbers of blocks whose words also stand elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for rest in _known(batches):
            if isinstance(rest, pa.RecordBatch):
                yield rest
            else:
                held.append(tuple(_arrays(rest, ("seen", np.uint32), ("blocks", np.uint32), ("docs", np.int64), ("ths", np.int32), ("lo", np.int32))))
        if held:
            seen, mine, doc, th, no = (np.concatenate(x) for x in zip(*held, strict=True))
            every = np.sort(np.concatenate([seen, mine]))
            hit = np.searchsorted(every, mine, "right") - np.searchsorted(every, mine, "left") > 1
            who, lo, hi = R.merged(doc[hit], th[hit], no[hit], no[hit])
            yield from R.batches((*who, lo, hi), _HITS)

    return R.gathered(dealt.repartitionById(parts, "part").mapInArrow(run, _HITS))


def chains(hit: DataFrame, rows: DataFrame, window: int, block: int, parts: int, small: bool) -> DataFrame:
    """Every window whose blocks are all hit, dealt by hash; repeats inside a buffer go as ranges.  small: hit may be broadcast."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Columns]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            row, first, last = R.ranges_of(batch["ranges"])
            docs, ths = np.asarray(batch["doc_id"]), np.asarray(batch["th"])
            for a, b in T.steps(data, offsets):
                values, of = R.word_items(*T.sub(data, offsets, a, b))
                p, q = np.searchsorted(row, [a, b])
                own = row[p:q] - a
                # from behind the start of the block before the chain to the last start that ends before the end of the block behind it
                lo = np.maximum(block * (first[p:q] - 1) + 1, 0)
                hi = np.minimum(block * (last[p:q] + 2) - window - 1, np.diff(of)[own] - window)
                n = np.maximum(hi - lo + 1, 0)
                at, text = spread(lo, n), np.repeat(own, n)
                yield T.hash_windows(values, window)[of[text] + at], docs[a:b][text], ths[a:b][text], at.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in R.buffered(found(batches), BUFFER):
            (key, doc, th, at), later = _in_order(*columns)
            known = doc[later], th[later], at[later], at[later]
            order = np.lexsort((at[~later], doc[~later]))  # so that equal ids stand together
            key, doc, th, at = (x[~later][order] for x in (key, doc, th, at))
            part = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                who = order[cuts[p] : cuts[p + 1]]
                out.append((p, None, key[who].tobytes(), doc[who].tobytes(), th[who].tobytes() if th[who].any() else b"", at[who].tobytes(), None))
            yield _told(out, known, parts)

    return R.with_ranges(rows, hit, "inner", small).mapInArrow(run, _DEALT)


def _in_order(key: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray) -> tuple[R.Columns, np.ndarray]:
    """The windows by key, doc_id and start, and which of them also start earlier."""
    order = np.lexsort((at, doc, key))
    key, doc, th, at = key[order], doc[order], th[order], at[order]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    return (key, doc, th, at), (doc > doc[first]) | (at > at[first])


def repeated(dealt: DataFrame, parts: int) -> DataFrame:
    """doc_id, th and ranges [lo, hi] of the starts of all windows that also start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for rest in _known(batches):
            if isinstance(rest, pa.RecordBatch):
                yield rest
            else:
                held.append(tuple(_arrays(rest, ("blocks", np.uint64), ("docs", np.int64), ("ths", np.int32), ("lo", np.int32))))
        if held:
            (_, doc, th, at), later = _in_order(*(np.concatenate(x) for x in zip(*held, strict=True)))
            who, lo, hi = R.merged(doc[later], th[later], at[later], at[later])
            yield from R.batches((*who, lo, hi), _HITS)

    return R.gathered(dealt.repartitionById(parts, "part").mapInArrow(run, _HITS))


def remove(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the kept words joined by one space, and the numbers of words before and removed."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    rows = R.identified(docs, doc_id, text)
    known, others = rows.where("doc_id is not null"), rows.where("doc_id is null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hit = cut(hits(deal(known, block, parts), parts))
    small = R.few(hit)
    spans = repeated(chains(hit, known, window, block, parts, small), parts)
    if small:
        spans = cut(spans)
        small = R.few(spans)
    # else the texts' exchange is the one that brought them to their hits
    return _without(R.with_ranges(known, spans, "left", small), window).unionByName(_without(others.withColumn("ranges", F.lit(None).cast("array<struct<lo:int,hi:int>>")), window))


def _without(rows: DataFrame, window: int) -> DataFrame:
    schema = "doc_id long, kept string, n_words long, n_removed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            row, lo, hi = R.ranges_of(batch["ranges"])
            for a, b in T.steps(data, offsets):
                d, o = T.sub(data, offsets, a, b)
                starts, ends, of = T.words(d, o)
                p, q = np.searchsorted(row, [a, b])
                edge = np.zeros(len(starts) + 1, np.int64)
                base = of[row[p:q] - a]
                np.add.at(edge, base + lo[p:q], 1)
                np.subtract.at(edge, base + hi[p:q] + window, 1)
                keep = np.cumsum(edge[:-1]) == 0
                total = np.concatenate([[0], np.cumsum(keep)])
                kept = total[of[1:]] - total[of[:-1]]
                # each kept word with one space behind it; the last one's is cut off
                s, n = starts[keep], ends[keep] - starts[keep]
                buffer = np.full(int(n.sum()) + len(n), 32, np.uint8)
                buffer[spread(np.cumsum(n + 1) - n - 1, n)] = d[spread(s, n)]
                at = np.concatenate([[0], np.cumsum(n + 1)])[total[of]]
                raw = buffer.tobytes()
                texts = [raw[x : max(x, y - 1)].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(texts, pa.string()), pa.array(np.diff(of)), pa.array(np.diff(of) - kept)], R.names(schema))

    return rows.select("doc_id", "text", "ranges").mapInArrow(run, schema)


def digest(kept: DataFrame) -> DataFrame:
    """The result of `remove` with the kept text's hash in its place."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def reference(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """By definition, for tests: n_words, n_removed and the kept words' hash of each document."""
    import re

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen: set[tuple[str, ...]] = set()
    out = {}
    for i in sorted(words):
        w, gone = words[i], set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out
