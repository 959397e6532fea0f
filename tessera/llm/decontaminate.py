"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits (any byte beyond ASCII counts as one),
A-Z lower-cased.  Seeds are windows of MIN_MATCH tokens.  Every document window
is looked up among the benchmark's seeds; for a document and an item that share
some, running Karp-Rabin finds the longest common token runs, which are marked
as tiles, longest first and never overlapping, again and again down to MIN_MATCH
tokens.  The share of the item's tokens under tiles is its coverage in the
document, whatever order its parts come in; THRESHOLD or more is a leak.

The benchmark is measured first and worked through in blocks of at most
BLOCK_BYTES of text (by a hash of the item's id), so what is broadcast at a time
is bounded; each block is a streaming pass over the documents without an
exchange.  Only runs of hit windows enter the tiling: every match of MIN_MATCH
tokens or more lies in such a run.

For a text, its distinct hit seeds are laid against the items' first, so what is in
memory is bounded by the block's seeds, however often a text or many items repeat
one; only an item whose seeds cover enough of it is tiled.

Defined cases: a null or empty text, or item, matches nothing; an item of fewer than
MIN_MATCH tokens has no seed, and leaks into a text of exactly its tokens; repeated
rows each get their own result; a null id stays null; an empty benchmark leaves every
document clean; other columns are passed on or not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16_000_000
HITS = "doc_id long, item_id long, item_tokens int, covered_tokens int, n_tiles int, longest_tile int, coverage double"

_GAP = np.ones(256, bool)
_GAP[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = False
_GAP[128:] = False
_FILTER_BITS = 22
_PRIME, _RADIX = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each token, and the n+1 offsets of the texts into them."""
    starts, ends, of = T.words(data, offsets, _GAP)
    return T.hash_ranges(data, starts, ends, T.LOWER_TABLE), of


def tiles(a: list[int], b: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (start in a, start in b, length) of each tile."""
    free_a, free_b = [True] * len(a), [True] * len(b)
    out: list[tuple[int, int, int]] = []

    def rolled(x: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """(start, hash) of each run of s free tokens."""
        top, h, run = pow(_RADIX, s, _PRIME), 0, 0
        for i, v in enumerate(x):
            if not free[i]:
                h = run = 0
                continue
            h = (h * _RADIX + v) % _PRIME
            run += 1
            if run > s:
                h = (h - x[i - s] * top) % _PRIME
            if run >= s:
                yield i - s + 1, h

    s = max(least, min(len(a), len(b)))
    while True:
        where: dict[int, list[int]] = {}
        for j, h in rolled(b, free_b, s):
            where.setdefault(h, []).append(j)
        found, longest = [], 0
        if where:
            for i, h in rolled(a, free_a, s):
                for j in where.get(h, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    if n >= s:
                        found.append((n, i, j))
                        longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = free_b[j : j + n] = [False] * n
                out.append((i, j, n))
            elif free_a[i] or free_a[i + n - 1]:
                again = True  # what another tile left of it may still be long enough
        if again and longest > s:
            continue
        if s == least:
            return out
        s = max(least, s // 2)


@dataclass(frozen=True)
class Index:
    """A block of items: their tokens, and their seeds in the order of the hashes."""

    ids: list[int | None]
    tokens: np.ndarray
    offsets: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    position: np.ndarray
    filter: np.ndarray
    short: dict[tuple[int, ...], list[int]]

    @staticmethod
    def build(ids: list[int | None], texts: list[str | None]) -> Index:
        values, of = tokens(*T.utf8(pa.array(texts, pa.string())))
        start, item = T.window_rows(of, MIN_MATCH)
        seeds = T.hash_windows(values, MIN_MATCH)[start]
        order = np.argsort(seeds, kind="stable")
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        short: dict[tuple[int, ...], list[int]] = {}
        for k in np.flatnonzero((np.diff(of) > 0) & (np.diff(of) < MIN_MATCH)).tolist():
            short.setdefault(tuple(values[of[k] : of[k + 1]].tolist()), []).append(k)
        return Index(ids, values, of, seeds[order], item[order], (start - of[item])[order], bits, short)


def leaks(column: pa.Array, index: Index, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, item's tokens, covered ones, tiles, longest tile) for each leak into a text."""
    data, offsets = T.utf8(column)
    for a, b in T.steps(data, offsets):
        values, of = tokens(*T.sub(data, offsets, a, b))
        for k in np.flatnonzero((np.diff(of) > 0) & (np.diff(of) < MIN_MATCH)).tolist() if index.short else ():
            n = int(of[k + 1] - of[k])
            for item in index.short.get(tuple(values[of[k] : of[k + 1]].tolist()), ()):
                yield a + k, item, n, n, 1, n
        if not len(index.seeds):
            continue
        start, text = T.window_rows(of, MIN_MATCH)
        hashes = T.hash_windows(values, MIN_MATCH)[start]
        maybe = np.flatnonzero(index.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(index.seeds, hashes[maybe])
        hit = index.seeds[np.minimum(low, len(index.seeds) - 1)] == hashes[maybe]
        maybe = maybe[hit]
        edges = np.flatnonzero(np.diff(text[maybe], prepend=-1, append=-1))
        for p, q in zip(edges[:-1], edges[1:], strict=True):  # one text's hits
            own, places = hashes[maybe[p:q]], start[maybe[p:q]]
            distinct = np.unique(own)
            low, high = np.searchsorted(index.seeds, distinct), np.searchsorted(index.seeds, distinct, "right")
            n = high - low
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            entry = entry[np.argsort(index.item[entry], kind="stable")]
            parts = np.flatnonzero(np.diff(index.item[entry], prepend=-1, append=-1))
            for u, v in zip(parts[:-1], parts[1:], strict=True):
                item = int(index.item[entry[u]])
                b_tokens = index.tokens[index.offsets[item] : index.offsets[item + 1]]
                seen = np.zeros(len(b_tokens) + 1, np.int64)
                where = index.position[entry[u:v]]
                seen[where] += 1
                np.subtract.at(seen, where + MIN_MATCH, 1)
                if (np.cumsum(seen[:-1]) > 0).sum() < threshold * len(b_tokens):
                    continue
                spots = places[np.isin(own, index.seeds[entry[u:v]])]
                run = np.flatnonzero(np.diff(spots, prepend=-MIN_MATCH - 1) > MIN_MATCH)
                a_tokens: list[int] = []
                for k, f in enumerate(run):
                    g = run[k + 1] - 1 if k + 1 < len(run) else len(spots) - 1
                    a_tokens += [*values[spots[f] : spots[g] + MIN_MATCH].tolist(), -1 - k]  # a separator that no token equals
                found = tiles(a_tokens, b_tokens.tolist())
                covered = sum(x[2] for x in found)
                if covered >= threshold * len(b_tokens):
                    yield a + int(text[maybe[p]]), item, len(b_tokens), covered, len(found), max(x[2] for x in found)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark's index, block by block; each block's text is bounded."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index.build([r["item_id"] for r in part], [r["text"] for r in part])


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that leaks into it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark, out = docs.sparkSession, None
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(batch["doc_id"][r].as_py(), shared.value.ids[i], n, c, t, m, c / n) for r, i, n, c, t, m in leaks(batch["text"], shared.value, threshold)]
                columns = list(zip(*got, strict=True)) if got else [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in HITS.split(", ")])

        part = rows.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], HITS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, into whose text no item leaks."""
    at = docs.columns.index(text)
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[r for r, *_ in leaks(batch.column(at), shared.value, threshold)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
