"""Near-duplicate documents: MinHash with tensored banding, every link verified.

A document's set holds its distinct 5-word shingles.  Documents with equal sets
are one class, represented by the least doc_id; only representatives go on.

Tensored banding: two small collections of M keys, each key of WIDTH minhashes,
are computed (2 * M * WIDTH minhashes); a table key is a pair of one key of each
collection, which gives M * M tables of 2 * WIDTH minhashes, as many as need
M * M * 2 * WIDTH minhashes when banded plainly.  A pair at similarity 0.75 is
missed with probability 2 * (1 - 0.75**WIDTH)**M, below 0.0006.  A table can hold
two documents only where each half key occurs twice, so rare halves are dropped
before pairs are formed, by counting alone.

Verification without all pairs: in each table bucket every member is compared
with the bucket's leader on full sets, and links are merged into components.
Buckets that then are one component are done.  Elsewhere, members outside the
leader's component first meet a few other members of it, chosen by hash, which
settles groups of near copies.  What buckets still hold several components is
finished exactly: of their members, all pairs of different components that share
one of the rarest items of both sets (the prefix filter for this similarity, which
loses no pair) are compared.  Documents that only share a frequent passage don't
meet there, however many they are.

Hot groups: equal copies collapse by partial aggregation; leaders with very many
members meet only in joins that are split when skewed; no bucket is gathered.

Defined cases: a text of one to four words has its whole sequence as the only
shingle; a null or empty text has an empty set and is linked with nothing; a row
with a null doc_id is not linked and has a null component; rows with one doc_id are
one vertex, which has the links of all its texts, and each row its own n_shingles;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import _text as T
from tessera.llm._session import cut
from tessera.llm.components import connected

SHINGLE, PERCENT = 5, 75
#: Outsiders of a bucket meet another member of the leader's component in so many of their buckets, so many times.
MEETINGS, TURNS = 4, 1
#: Keys in each of the two collections, and minhashes in each key.
M, WIDTH = 10, 2
_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _rng.integers(1, 2**63, 2 * M * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, 2 * M * WIDTH, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted inside it, and the n+1 offsets into them."""
    starts, ends, of = T.words(data, offsets)
    values = T.hash_ranges(data, starts, ends, T.LOWER_TABLE)
    start, text = T.window_rows(of, SHINGLE)
    hashes = T.hash_windows(values, SHINGLE)[start]
    m = np.diff(of)
    few = np.flatnonzero((m > 0) & (m < SHINGLE))
    if len(few):
        short = np.array([T.hash_windows(values[of[k] : of[k + 1]], int(m[k]))[0] for k in few], np.uint64)
        hashes, text = np.concatenate([hashes, short]), np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def minhash_keys(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """2 * M keys for each text with a shingle: first the left collection's, then the right one's."""
    first = of[:-1][np.diff(of) > 0]
    out = np.zeros((len(first), 2 * M), np.uint64)
    for k in range(2 * M):
        key = np.full(len(first), k + 1, np.uint64)
        for w in range(WIDTH):
            f = k * WIDTH + w
            low = np.minimum.reduceat((hashes ^ _FLIP[f]) * _MULTIPLY[f], first) if len(first) else np.zeros(0, np.uint64)
            key = T.mix(key * np.uint64(T.BASE) + low)
        out[:, k] = key
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (set size), a 128-bit digest of the set, and its keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            for a, b in T.steps(data, offsets):
                hashes, of = shingles(*T.sub(data, offsets, a, b))
                n = np.diff(of)
                digests = []
                for salt in (0x51ED270B, 0x2545F491):
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(T.mix(hashes * np.uint64(2 * salt + 1)), out=total[1:])
                    digests.append(pa.array(T.as_long(total[of[1:]] - total[of[:-1]])))
                keys = pa.array(T.as_long(minhash_keys(hashes, of)).ravel())
                at = np.concatenate([[0], np.cumsum(n > 0)]) * 2 * M
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), keys)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(n), *digests, lists], ["doc_id", "n", "d1", "d2", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>")


def full_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the set's digest and the set itself of every row that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            for a, b in T.steps(data, offsets):
                hashes, of = shingles(*T.sub(data, offsets, a, b))
                lists = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(T.as_long(hashes)))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), lists], ["id", "items"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, items array<long>")


def table_members(classes: DataFrame) -> DataFrame:
    """(table_key, rep, n) of all tensored table keys that may hold two classes."""
    half = classes.select("rep", "n", F.posexplode("keys").alias("at", "half"))
    twice = half.groupBy("half").agg(F.count("*").alias("times")).where("times > 1").select("half")
    alive = half.join(twice, "half", "left_semi").groupBy("rep", "n").agg(F.collect_list(F.struct("at", "half")).alias("halves"))  # 2 * M at most
    side = lambda test: F.transform(F.filter("halves", lambda x: test(x["at"])), lambda x: x["half"])
    pairs = alive.select("rep", "n", side(lambda at: at < M).alias("left"), side(lambda at: at >= M).alias("right")).where("size(left) > 0 and size(right) > 0")
    return pairs.select("rep", "n", "right", F.explode("left").alias("l")).select("rep", "n", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("table_key"), "rep", "n")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) with the size of the sets' intersection, common."""
    one, two = sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), sets.select(F.col("id").alias("b"), F.col("items").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))


def _linked() -> F.Column:
    return 100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))


_SIZES = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"


def linked(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(vertex, component) of all representatives with a link: the components of all pairs that share a table and are similar enough."""
    lead = members.groupBy("table_key").agg(F.min(F.struct("rep", "n")).alias("lead"))
    bucket = cut(members.join(lead, "table_key").select("table_key", "rep", "n", F.col("lead.rep").alias("leader"), F.col("lead.n").alias("ln")))
    if bucket.isEmpty():
        return None
    pairs = bucket.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"), F.col("ln").alias("na"), F.col("n").alias("nb")).distinct()
    known, found, component = _measured(pairs, sets, None, None, None)
    # only buckets that hold two components go on; outsiders first meet some other members of the leader's component
    placed = bucket
    for turn in range(TURNS + 1):
        placed = cut(_mixed(placed, component))
        if placed.isEmpty():
            return component
        if turn < TURNS:
            salt = F.xxhash64("rep", "table_key", F.lit(turn))
            second = placed.where("c = cl").groupBy("table_key").agg(F.min_by(F.struct("rep", "n"), salt).alias("second"))
            few = placed.where("c <> cl").withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.xxhash64("table_key", F.lit(turn))))).where(F.col("r") <= MEETINGS)
            met = few.join(second, "table_key").select(F.least("rep", "second.rep").alias("a"), F.greatest("rep", "second.rep").alias("b"), F.when(F.col("rep") < F.col("second.rep"), F.col("n")).otherwise(F.col("second.n")).alias("na"), F.when(F.col("rep") < F.col("second.rep"), F.col("second.n")).otherwise(F.col("n")).alias("nb"))
            known, found, component = _measured(met.distinct(), sets, known, found, component)
    rest = cut(placed.select("rep", "n", "c").distinct())
    return _measured(rare_pairs(rest, sets), sets, known, found, component)[2]


def rare_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb): all pairs of rows (rep, n, c) of different c that can be similar enough.

    Two sets of similarity t share one of the first n - ceil(t * n) + 1 items of
    each, in any one order; with the rarest first, sets that have only frequent
    items in common don't meet.  Items that one c alone has are dropped before the
    join.
    """
    items = cut(rows.join(sets, rows["rep"] == sets["id"]).select("rep", "n", "c", F.explode("items").alias("item")))
    often = items.groupBy("item").agg(F.count("*").alias("often")).where("often > 1")
    held = items.join(often, "item")
    # items that one set alone has come first in its order, and meet nobody
    alone = F.col("n") - F.count("*").over(W.partitionBy("rep"))
    place = alone + F.row_number().over(W.partitionBy("rep").orderBy("often", "item"))
    prefix = held.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT) / F.lit(100)) + 1).select("item", "rep", "n", "c", "place")
    shared = prefix.groupBy("item").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("item")
    prefix = cut(prefix.join(shared, "item", "left_semi"))
    # at the first common item, what follows in both sets must still suffice for t / (1 + t) of their sizes' sum
    enough = f"{100 + PERCENT} * (1 + least(x.n - x.place, y.n - y.place)) >= {PERCENT} * (x.n + y.n)"
    pairs = prefix.alias("x").join(prefix.alias("y"), "item").where(f"x.rep < y.rep and x.c <> y.c and {enough}").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    return pairs.where(_SIZES).distinct()


def _mixed(bucket: DataFrame, component: DataFrame) -> DataFrame:
    """Members of buckets that hold two components, placed."""
    placed = _placed(bucket, component)
    mixed = placed.groupBy("table_key").agg(F.count_if(F.expr("c <> cl")).alias("outside")).where("outside > 0").select("table_key")
    return placed.join(mixed, "table_key", "left_semi")


def _measured(pairs: DataFrame, sets: DataFrame, known: DataFrame | None, found: DataFrame | None, component: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verifies the pairs that are new: all measured pairs, all links, and the links' components.

    Pairs of too unlike sizes can't be links and are not fetched; their common is null.
    """
    if known is not None:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    pairs = cut(pairs)
    if known is None or not pairs.isEmpty():
        new = cut(verify(pairs.where(_SIZES), sets).unionByName(pairs.where(f"not ({_SIZES})").withColumn("common", F.lit(None).cast("long"))))
        good = new.where("common is not null").where(_linked()).select("a", "b")
        known = new if known is None else known.unionByName(new)
        if component is None or not good.isEmpty():
            found = good if found is None else found.unionByName(good)
            component = cut(connected(found))
    return known, found, component


def _placed(bucket: DataFrame, component: DataFrame) -> DataFrame:
    """bucket with the components of member and leader, c and cl."""
    one = component.select(F.col("vertex").alias("rep"), F.col("component").alias("c1"))
    two = component.select(F.col("vertex").alias("leader"), F.col("component").alias("c2"))
    rows = bucket.join(one, "rep", "left").join(two, "leader", "left")
    return rows.select("table_key", "rep", "n", "leader", "ln", F.coalesce("c1", "rep").alias("c"), F.coalesce("c2", "leader").alias("cl"))


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each distinct set of `signatures`: its least doc_id as rep, and its keys."""
    least = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("least"))
    return least.select("d1", "d2", "n", F.col("least.doc_id").alias("rep"), F.col("least.keys").alias("keys"))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = cut(signatures(docs, doc_id, text))
    classes = cut(classes_of(rows))
    members = table_members(classes)
    # tables with the same members are one: a pair of near copies shares dozens
    marks = members.groupBy("table_key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("size > 1")
    shared = marks.groupBy("size", "x", "y").agg(F.min("table_key").alias("table_key")).select("table_key")
    members = cut(members.join(shared, "table_key", "left_semi"))
    reps = members.select("rep").distinct()
    # rows of one id and several texts are told apart by the digest
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = cut(full_sets(chosen).dropDuplicates(["id", "items"]))
    linked_to = linked(members, sets)
    if linked_to is None:
        component = classes.select("d1", "d2", "n", F.col("rep").alias("component_id"))
    else:
        component = classes.join(linked_to.withColumnRenamed("vertex", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("keys").join(component, ["d1", "d2", "n"], "left")
    whose = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whose.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are the first of their component; rows without an id stay."""
    gone = cluster(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")
