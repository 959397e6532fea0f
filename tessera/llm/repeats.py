"""What the two removals of repeated windows share.

A window is `width` consecutive items (words or bytes) of one text.  Its anchor is
the least hash among its runs of `k` items, the leftmost of equals, so equal windows
have equal anchors, and a text gives about two anchors for each width - k + 1 items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T

Columns = tuple[np.ndarray, ...]
#: Rows and ranges in all (some dozens of bytes each) up to which a side is broadcast; more are joined by an exchange.
BROADCAST_ROWS = 200_000


def word_items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, of = T.words(data, offsets)
    return T.hash_ranges(data, starts, ends), of


def segments(values: np.ndarray, of: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, the text, and the first and last window's start in the text."""
    runs = T.hash_windows(values, k)
    start, text = T.window_rows(of, width)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    anchor = T.sliding_min(runs, width - k + 1)[start]
    edge = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(edge[1:], len(start)) - 1
    base = of[text[edge]]
    return runs[anchor[edge]], text[edge], start[edge] - base, start[last] - base


def merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in the order of (row, lo), with those that touch or overlap made one."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    shift = row.astype(np.int64) * (int(hi.max()) + 3)  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(hi + shift)
    fresh = np.ones(len(row), bool)
    fresh[1:] = lo[1:] + shift[1:] > reach[:-1] + 1
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    return row[first], lo[first], reach[last] - shift[first]


def spread_key(row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return T.mix(row.astype(np.uint64) * np.uint64(T.BASE) + lo.astype(np.uint64))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th and text: th tells texts of one doc_id apart, and is 0 throughout where ids are unique."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unique = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rows.select("doc_id", (F.lit(0) if unique else F.hash("text")).alias("th"), "text")


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def buffered(found: Iterator[Columns], size: int) -> Iterator[Columns]:
    """Columns of `size` entries and more, made of those found one after the other; none is empty."""
    held: list[Columns] = []
    for columns in found:
        held.append(columns)
        if sum(len(x[0]) for x in held) >= size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if any(len(x[0]) for x in held):
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def batches(columns: Columns, schema: str, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + rows]) for x in columns], names(schema))


def merged(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(doc_id, th), lo and hi of ranges of texts, with those that touch or overlap made one."""
    order = np.lexsort((th, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1])
    row, lo, hi = merge(np.cumsum(fresh) - 1, lo[order].astype(np.int64), hi[order].astype(np.int64))
    who = order[fresh][row]
    return (doc[who], th[who]), lo.astype(np.int32), hi.astype(np.int32)


def gathered(found: DataFrame) -> DataFrame:
    """doc_id, th and all `ranges` of each text, from rows of doc_id, th, lo and hi."""
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def few(ranges: DataFrame) -> bool:
    """Whether texts' ranges may be broadcast."""
    return (ranges.agg(F.sum(F.size("ranges") + 1)).first()[0] or 0) <= BROADCAST_ROWS


def with_ranges(rows: DataFrame, ranges: DataFrame, how: str, small: bool) -> DataFrame:
    """rows joined to per-text ranges, which are broadcast if small."""
    return rows.join(F.broadcast(ranges) if small else ranges, ["doc_id", "th"], how)


def ranges_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo and hi of all ranges of an array<struct<lo, hi>> column, merged; a null is no range."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    flat = column.flatten()
    return merge(np.repeat(np.arange(len(column)), sizes), np.asarray(flat.field("lo")).astype(np.int64), np.asarray(flat.field("hi")).astype(np.int64))
