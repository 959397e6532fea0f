"""Exact Jaccard similarities of two tables of sets, by blocks of either side.

No pair is written: a cell of the grid holds one block of each side, its task counts
shared features by matrix products (frequent features) and postings (the others), and
keeps only what is asked for.  A cell's memory is that of its two blocks and of one
chunk of counts; what is shuffled is each side once for every block of the other.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a cell: no fewer than the first (but for small tables), about the second at most.
LEAST, MOST = 20_000_000, 4_000_000_000


def sets(rows: DataFrame, features: str, *columns) -> DataFrame:
    """columns and f: the distinct features in order; rows without any are left out, as they share nothing."""
    return rows.select(*columns, F.sort_array(F.array_distinct(F.array_compact(features))).alias("f")).where(F.size("f") > 0)


def _kernel(keep: str, at_least: float, columns: list[str]):
    """The function of a cell; nested, so that executors need no module of ours."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        chunk, part, dense, room = 512, 2048, 256, 4_000_000

        def flat(column):
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            return pc.list_flatten(column), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)

        (lv, na), (rv, nb) = flat(left["f"]), flat(right["f"])
        names = pc.unique(rv)
        lc = pc.fill_null(pc.index_in(lv, value_set=names), -1).to_numpy(zero_copy_only=False)
        rc = pc.index_in(rv, value_set=names).to_numpy(zero_copy_only=False)
        l_at, r_at = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])

        parts = []
        for low in range(0, len(nb), part):
            high = min(low + part, len(nb))
            codes, owner = rc[r_at[low] : r_at[high]], np.repeat(np.arange(high - low), nb[low:high])
            found, n = np.unique(codes, return_counts=True)
            often = n * 64 >= high - low
            top = np.sort(found[often][np.argsort(-n[often], kind="stable")[:dense]])
            at = np.minimum(np.searchsorted(top, codes), max(len(top) - 1, 0))
            is_top = top[at] == codes if len(top) else np.zeros(len(codes), bool)
            table = np.zeros((high - low, len(top)), np.float32)
            table[owner[is_top], at[is_top]] = 1
            order = np.argsort(codes[~is_top], kind="stable")
            parts.append((low, high, top, table, codes[~is_top][order], owner[~is_top][order]))

        def counts(codes, owner, rows, low, high, top, table, rest, rest_owner):
            at = np.minimum(np.searchsorted(top, codes), max(len(top) - 1, 0))
            is_top = top[at] == codes if len(top) else np.zeros(len(codes), bool)
            own = np.zeros((rows, len(top)), np.float32)
            own[owner[is_top], at[is_top]] = 1
            common = own @ table.T
            if len(rest):
                first = np.searchsorted(rest, codes)
                n = np.searchsorted(rest, codes, "right") - first
                hit = np.flatnonzero(n)
                ends = np.cumsum(n[hit])
                for some in np.split(hit, np.searchsorted(ends, np.arange(room, ends[-1], room))) if len(hit) else []:
                    k = n[some]
                    ids = np.arange(k.sum()) + np.repeat(first[some] - (np.cumsum(k) - k), k)
                    common += np.bincount(np.repeat(owner[some], k) * (high - low) + rest_owner[ids], minlength=common.size).reshape(common.shape).astype(np.float32)
            return common

        if keep == "best":
            kinds = right["x"].combine_chunks().dictionary_encode("encode")
            kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
            kind, n_kinds = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(kinds.dictionary), 1)
        if keep == "sums":
            weight = right["x"].to_numpy().astype(float)
        found_a, found_b, found_s = [], [], []
        for start in range(0, len(na), chunk):
            stop = min(start + chunk, len(na))
            codes, owner = lc[l_at[start] : l_at[stop]], np.repeat(np.arange(stop - start), na[start:stop])
            codes, owner = codes[codes >= 0], owner[codes >= 0]
            best, ties, total = np.zeros(stop - start), np.zeros(0, np.int64), np.zeros(stop - start)
            for low, high, top, table, rest, rest_owner in parts:
                common = counts(codes, owner, stop - start, low, high, top, table, rest, rest_owner)
                if keep in ("pairs", "any"):
                    # at first with a margin for the rounding of short floats, then exactly
                    share = np.float32(at_least / (1 + at_least) * (1 - 1e-5))
                    x, y = np.nonzero(common >= (na[start:stop] * share - np.float32(1e-3)).astype(np.float32)[:, None] + (nb[low:high] * share).astype(np.float32)[None])
                    c = common[x, y].astype(float)
                    exact = (c > 0) & (c / (na[start + x] + nb[low + y] - c) >= at_least)
                    x, y = x[exact], y[exact]
                    if keep == "pairs":
                        found_a.append(x + start), found_b.append(y + low)
                    else:
                        total[x] = 1
                    continue
                similarity = np.add.outer(na[start:stop].astype(float), nb[low:high].astype(float))
                similarity -= common
                np.divide(common, similarity, out=similarity)
                if keep == "sums":
                    total += similarity @ weight[low:high]
                    continue
                most = similarity.max(1)
                ties = ties[most[ties // n_kinds] <= best[ties // n_kinds]]
                up = np.flatnonzero((most >= best) & (most > 0))
                best[up] = most[up]
                x, y = np.nonzero(similarity[up] == most[up, None])
                ties = np.unique(np.concatenate([ties, up[x] * n_kinds + kind[y + low]]))
            if keep == "best":
                found_a.append(ties // n_kinds + start), found_b.append(ties % n_kinds), found_s.append(best[ties // n_kinds])
            elif keep == "any":
                found_a.append(np.flatnonzero(total) + start)
            elif keep == "sums":
                found_a.append(np.arange(start, stop)), found_s.append(total)
        join = lambda x, kind=np.int64: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        out = {"a": left["a"].take(pa.array(join(found_a)))}
        if pa.types.is_list(out["a"].type):
            out["a"] = out["a"].cast(pa.list_(pa.field("element", out["a"].type.value_type, nullable=True)))
        if "b" in columns:
            out["b"] = right["b"].take(pa.array(join(found_b)))
        if "x" in columns:
            out["x"] = kinds.dictionary.take(pa.array(join(found_b)))
        if "s" in columns:
            out["s"] = pa.array(join(found_s, float))
        return pa.table(out).select(columns)

    return run


def compared(one: DataFrame, two: DataFrame, keep: str, at_least: float = 0.0, by: str | None = None) -> DataFrame:
    """What is kept of the similarities of one (a, f) to two (f and what is asked for), by cells; both are read several times.

    best: a, x and s, the largest similarity above 0 in each block and every x that has it;
    any: a, where some similarity is at_least; pairs: a and b of those pairs; sums: a and s,
    the sum of the similarities times x.  A row of `one` may come once for each block, but for
    pairs.  With `by`, a column of both, only rows with the same value meet.
    """
    spark, types = one.sparkSession, {**{c.name: c.dataType.simpleString() for c in two.schema}, **{c.name: c.dataType.simpleString() for c in one.schema}, "s": "double"}
    if keep == "best":
        types["x"] = two.schema["x"].dataType.simpleString()
    columns = {"best": ["a", "x", "s"], "any": ["a"], "pairs": ["a", "b"], "sums": ["a", "s"]}[keep]
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    tasks = 3 * spark.sparkContext.defaultParallelism
    hashed = lambda n: F.pmod(F.xxhash64("f"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if by is None:
        n, m = one.count(), two.count()
        if not n * m:
            return spark.createDataFrame([], schema)
        cells = max(min(n * m / LEAST, tasks), n * m / MOST, 1)
        p = max(1, min(n, ceil(sqrt(cells * n / m))))
        q = max(1, min(m, ceil(cells / p)))
        left = one.withColumns({"i": hashed(F.lit(p)).cast("int"), "j": each(F.lit(q))})
        right = two.withColumns({"j": hashed(F.lit(q)).cast("int"), "i": each(F.lit(p))})
        keys, cells = ["i", "j"], p * q
    else:
        sizes = one.groupBy(by).agg(F.count("*").alias("n")).join(two.groupBy(by).agg(F.count("*").alias("m")), by)
        pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
        if not pairs:
            return spark.createDataFrame([], schema)
        side = max(1, int(sqrt(pairs / max(min(pairs / LEAST, tasks), pairs / MOST, 1))))
        sizes = sizes.select(by, F.ceil(F.col("n") / side).cast("int").alias("p"), F.ceil(F.col("m") / side).cast("int").alias("q"))
        left = one.join(sizes, by).withColumns({"i": hashed(F.col("p")).cast("int"), "j": each(F.col("q"))}).drop("p", "q")
        right = two.join(sizes, by).withColumns({"j": hashed(F.col("q")).cast("int"), "i": each(F.col("p"))}).drop("p", "q")
        keys, cells = [by, "i", "j"], tasks + int(pairs / MOST)
    # blocks are small in bytes and long in work, so their tasks are not to be put together
    left, right = left.repartition(cells, *keys), right.select(*(F.col(c).alias(c) for c in right.columns)).repartition(cells, *keys)  # renamed, as both may be of one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_kernel(keep, at_least, columns), schema)
