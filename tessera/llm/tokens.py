"""Token counts and ids under a public tokenizer file.

Two devices make exact counts cheap and huge texts parallel.

Units: a byte-level pre-tokenizer never joins a solid character with white space
that follows it, so the tokens of a text are those of its units (white space and
the word behind it), one after another.  Each batch encodes its distinct units
once, with the library, and adds up; a bounded table keeps known units between
batches.

Overlap resynchronisation: texts over `chunk` characters are cut into chunks that
overlap.  Each is encoded with offsets on whatever executor takes it.  Neighbours
are spliced at a pre-token boundary both have in the overlap, and which lies far
enough before the left chunk's end that nothing beyond can move it: from a
boundary on, pre-tokens depend on the following text alone, so both chunks agree
from there.  Where the overlap holds no such boundary, it is doubled for that
text and the text is encoded anew, up to one chunk for the whole text.

Defined cases: a null text is empty and has no tokens; repeated rows each get
their own result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._session import cut

#: Characters of a chunk of a huge text, and of its overlap with the next one.
CHUNK, OVERLAP = 65_536, 2_048
#: No boundary closer to a chunk's cut end counts: a special token or a look-ahead may reach beyond the cut.
MARGIN = 64
#: Units that a worker keeps between batches, and their ids for each on average.
TABLE, IDS_EACH = 1_000_000, 8
#: Units that are encoded at a time; the library's encoding of one is some hundred bytes.
SLICE = 4_096


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _after_wide_space(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII ends just before each position."""
    one, two, three = (d[np.maximum(at - k, 0)] for k in (1, 2, 3))
    pair = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    return pair | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units, and the n+1 offsets of the texts into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = T.SPACE[data]
    edge = space.copy()
    edge[0] = False
    edge[1:] &= (data[:-1] >= 0x21) & (data[:-1] != 0x7F)
    at = np.flatnonzero(edge)
    wide = data[at - 1] >= 0x80
    at = at[~(wide & _after_wide_space(data, at))] if wide.any() else at
    starts = np.union1d(at, offsets[:-1][np.diff(offsets) > 0])
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class UnitTable:
    """Token ids of units by their hash: sorted keys with the number of each one's entry, and the entries' ids one after another, as they came."""

    def __init__(self, path: str, split=units, keep: int = TABLE):
        self.tokenizer, self.split, self.keep = tokenizer(path), split, keep
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit where its ids begin in self.ids, and their number."""
        hashes = T.hash_ranges(data, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            new = first[~known]
            if len(self.keys) + len(new) > self.keep or len(self.ids) > IDS_EACH * self.keep:  # start anew with what this batch needs
                self._only(at[known])
            self._add(distinct[~known], data, starts[new], ends[new])
            at = np.searchsorted(self.keys, distinct)
        entry = self.entry[at]
        begin = self.ends[entry]
        return begin[back], (self.ends[entry + 1] - begin)[back]

    def _only(self, at: np.ndarray) -> None:
        """Forget all keys but those at `at`."""
        begin = self.ends[self.entry[at]]
        sizes = self.ends[self.entry[at] + 1] - begin
        self.keys, self.entry = self.keys[at], np.arange(len(at), dtype=np.int32)
        self.ends, self.ids = np.concatenate([[0], np.cumsum(sizes)]), self.ids[spread(begin, sizes)]

    def _add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Entries for new keys, in order; the library's encodings of a slice are in memory at a time, the table is never gathered anew."""
        raw, ids, sizes = data.tobytes(), [self.ids], []
        for a in range(0, len(keys), SLICE):
            found = self.tokenizer.encode_batch_fast([raw[x:y].decode() for x, y in zip(starts[a : a + SLICE].tolist(), ends[a : a + SLICE].tolist(), strict=True)], add_special_tokens=False)
            lists = [x.ids for x in found]
            sizes += map(len, lists)
            ids.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32))
        at = np.searchsorted(self.keys, keys)
        self.entry = np.insert(self.entry, at, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))
        self.ids = np.concatenate(ids)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], .., starts[0] + sizes[0] - 1, starts[1], .."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


_tables: dict[tuple, UnitTable] = {}


def unit_table(path: str, split=units) -> UnitTable:
    """The worker's table for this tokenizer file."""
    key = (path, split.__name__)
    if key not in _tables:
        _tables[key] = UnitTable(path, split)
    return _tables[key]


def count_column(path: str, column: pa.Array) -> np.ndarray:
    """The number of tokens of each text."""
    data, offsets = T.utf8(column)
    table = unit_table(path)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in T.steps(data, offsets):
        d, o = T.sub(data, offsets, a, b)
        starts, ends, of = units(d, o)
        if len(starts):
            _, sizes = table.look_up(d, starts, ends)
            total = np.concatenate([[0], np.cumsum(sizes)])
            out[a:b] = total[of[1:]] - total[of[:-1]]
    return out


def boundaries(encoding, start: int) -> tuple[list[int], list[int]]:
    """Positions at which pre-tokens begin, and the number of tokens before each; the end is the last."""
    positions, tokens, last = [], [], None
    for k, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            positions.append(start + a)
            tokens.append(k)
        last = word
    return positions, tokens


_CHUNKS = "doc_id long, row_no long, chunk_no int, begin long, finish long, last boolean, n_tokens long, head_at array<long>, head_tokens array<long>, tail_at array<long>, tail_tokens array<long>"


def encode_chunks(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Token number and the boundaries in both overlaps of every chunk (doc_id, row_no, chunk_no, begin, last, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name.split()[0]: [] for name in _CHUNKS.split(", ")}
            for doc_id, row_no, chunk_no, begin, last, piece in zip(*(batch[c].to_pylist() for c in ("doc_id", "row_no", "chunk_no", "begin", "last", "piece")), strict=True):
                e = tokenizer(path).encode(piece, add_special_tokens=False)
                finish = begin + len(piece)
                at, tokens = boundaries(e, begin)
                if last:
                    at, tokens = [*at, finish], [*tokens, len(e.ids)]
                head = [(a, t) for a, t in zip(at, tokens, strict=True) if a < begin + overlap]
                tail = [(a, t) for a, t in zip(at, tokens, strict=True) if finish - overlap <= a <= finish - MARGIN]
                row = (doc_id, row_no, chunk_no, begin, finish, last, len(e.ids), [a for a, _ in head], [t for _, t in head], [a for a, _ in tail], [t for _, t in tail])
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
            lists, longs = pa.list_(pa.int64()), pa.int64()
            kinds = (longs, longs, pa.int32(), longs, longs, pa.bool_(), longs, lists, lists, lists, lists)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return chunks.mapInArrow(run, _CHUNKS)


def cut_up(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk rows of texts (doc_id, row_no, text): each begins `chunk` after the one before, and is `overlap` longer.  A text is read once."""
    schema = "doc_id long, row_no long, chunk_no int, begin long, last boolean, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_id, row_no, text = (batch[c][r].as_py() for c in ("doc_id", "row_no", "text"))
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                for a in range(0, last + 1, 16):  # chunks that are in memory beside the text
                    no = range(a, min(a + 16, last + 1))
                    pieces = [text[k * chunk :] if k == last else text[k * chunk : (k + 1) * chunk + overlap] for k in no]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(no), pa.int64()), pa.array([row_no] * len(no), pa.int64()), pa.array(no, pa.int32()), pa.array([k * chunk for k in no], pa.int64()), pa.array([k == last for k in no]), pa.array(pieces, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return texts.select("doc_id", "row_no", "text").mapInArrow(run, schema)


def splice(encoded: DataFrame) -> DataFrame:
    """Token number of each text, null where two neighbours have no common stable boundary."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id", "row_no").orderBy("chunk_no")
    common = F.array_max(F.array_intersect("tail_at", "next_at"))
    rows = encoded.withColumn("next_at", F.lead("head_at").over(w)).withColumn("next_tokens", F.lead("head_tokens").over(w)).withColumn("cut", common)
    left = F.when(F.col("last"), F.col("n_tokens")).otherwise(F.element_at("tail_tokens", F.array_position("tail_at", F.col("cut")).cast("int")))
    skipped = F.when(F.col("last"), F.lit(0)).otherwise(F.element_at("next_tokens", F.array_position("next_at", F.col("cut")).cast("int")))
    ok = F.col("last") | F.col("cut").isNotNull()
    return rows.withColumn("part", F.when(ok, left - skipped)).groupBy("doc_id", "row_no").agg(F.when(F.bool_and(ok), F.sum("part")).alias("n_tokens"))


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token numbers of huge texts (doc_id, row_no, text), by overlapping chunks."""
    longest = texts.agg(F.max(F.length("text"))).first()[0] or 0
    done = None
    while True:
        rows = cut_up(texts, chunk, overlap)
        got = cut(splice(encode_chunks(rows.repartition("doc_id", "row_no", "chunk_no"), path, overlap)))
        found = got.where("n_tokens is not null")
        done = found if done is None else done.unionByName(found)
        if overlap > longest or got.where("n_tokens is null").isEmpty():
            return done
        again = got.where("n_tokens is null").select(F.col("doc_id").alias("again_id"), F.col("row_no").alias("again_no"))
        texts = texts.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("row_no") == F.col("again_no")), "left_semi")
        overlap, chunk = overlap * 2, max(chunk, overlap * 4)


def count(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_huge = F.length("text") > chunk + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], size, pa.array(count_column(path, batch["text"]))], ["doc_id", "n_bytes", "n_tokens"])

    small = rows.where(~is_huge).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    # a huge row is known by its id and its text's hash: equal rows have equal counts
    huge = rows.where(is_huge).withColumn("row_no", F.xxhash64("text"))
    counts = count_huge(huge.dropDuplicates(["doc_id", "row_no"]), path, chunk, overlap)
    sizes = huge.select("doc_id", "row_no", F.octet_length("text").cast("long").alias("n_bytes"))
    joined = sizes.join(counts, sizes["doc_id"].eqNullSafe(counts["doc_id"]) & (sizes["row_no"] == counts["row_no"])).select(sizes["doc_id"], "n_bytes", "n_tokens")
    return small.unionByName(joined)


