"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform turn each unit vector; its hash is the signed axis it
lies nearest to. A bucket of a table is named by one or more hashes, so that buckets stay small however many rows there are:
see plan(). How many of its nearest buckets a query looks in is measured: a bounded sample of the queries is searched in full, and the place
of the true neighbours' buckets in the queries' lists tells what finds enough of them, see measured(). Every row is in one bucket of each table, a query looks in its nearest `probes` buckets of each
table, and all candidates there are ranked by the exact cosine. What travels together is a cell, the rows of one first
hash of a table; inside it a query meets only the rows of the buckets it looks in. Cells of many rows or queries are split in
blocks that meet pairwise, so no task holds an unbounded cell. Queries that find fewer than k rows are searched
against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import bound_batches, cut, drawn

#: By the number of hashes that name a bucket together: tables, and buckets that a query looks in of each table.
PLANS = {1: (10, 7), 2: (24, 64), 3: (48, 512)}
#: Queries that are searched in full to measure a plan: about this many, twice as many at most; the share of their neighbours it must find.
SAMPLE_QUERIES, RECALL = 200, 0.96
#: Buckets of a table that a query looks in at most, where more than one hash names them; with one hash all may be looked in.
MOST_PROBES = 2048
#: Rows of a bucket, on average, above which one more hash is used.
BUCKET_ROWS = 4096
#: Rows and queries of one block of a cell.
BLOCK = 4096
#: Rows of one group that holds small buckets, on average.
BIN_ROWS = 30_000
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table: signs and transform, three times."""
    width = 1 << max(0, (x.shape[1] - 1)).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng((SEED, table))
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), size=width))
    return x


def nearest_axes(x: np.ndarray, table: int, count: int, hashes: int = 1) -> np.ndarray:
    """rows x count bucket numbers of one table, nearest first; an axis is 2 * place, plus 1 if negative."""
    per = []
    for h in range(hashes):
        turned = rotate(x, table * hashes + h)
        both = np.concatenate([turned, -turned], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, : min(count, both.shape[1])]
        axis = top % turned.shape[1] * 2 + (top >= turned.shape[1])
        per.append((axis, np.take_along_axis(both, top, axis=1), both.shape[1]))
    axis, value, wide = per[0]
    for more, gain, _ in per[1:]:  # the count best sums of one axis of each hash; place i with j is behind (i + 1) * (j + 1) - 1 others
        i, j = np.nonzero(np.outer(np.arange(1, axis.shape[1] + 1), np.arange(1, more.shape[1] + 1)) <= count)
        total, code = value[:, i] + gain[:, j], axis[:, i] * wide + more[:, j]
        top = np.argsort(-total, axis=1, kind="stable")[:, :count]
        axis, value = np.take_along_axis(code, top, axis=1), np.take_along_axis(total, top, axis=1)
    return axis


def plan(rows: int, dims: int) -> tuple[int, int, int]:
    """Hashes, tables and probes for so many rows: one more hash for every factor of the number of axes."""
    axes, hashes = 2 << max(0, dims - 1).bit_length(), 1
    while rows > BUCKET_ROWS * axes**hashes and hashes < max(PLANS):
        hashes += 1
    return hashes, *PLANS[hashes]


def measured(base: DataFrame, count: int, dims: int, k: int) -> tuple[int, int, int]:
    """Hashes, tables and probes that find RECALL of the neighbours of a sample of queries, reading as few rows as can be.

    base: id, v, asks. About SAMPLE_QUERIES queries are searched against every row, in one pass that leaves k rows a query for each
    task. A neighbour is found if its bucket is among the first `probes` of the query's list in some table, so the place of that bucket in
    the best table is the number of probes that it needs, and no plan has to be tried out. From plan()'s number of hashes down to one, those plans
    count whose probes are enough; one hash always is, as a query may look in all its buckets.
    """
    asking = base.where("asks").select("id", "v")
    got = sorted(drawn(asking, F.col("id"), SAMPLE_QUERIES, asking.count()).collect())
    if not got:
        return plan(count, dims)
    ids, x = np.array([r["id"] for r in got], np.int64), vectors.matrix(pd.Series([r["v"] for r in got]))
    x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "v": []})
        for batch in batches:
            there = vectors.matrix(batch["v"])
            near = best(ids, x, batch["id"].to_numpy(np.int64), np.pad(there, ((0, 0), (0, dims - there.shape[1]))), k)
            near = near.merge(batch.drop_duplicates("id").rename(columns={"id": "vec_id"}), on="vec_id")
            kept = pd.concat([kept, near]) if len(kept) else near
            kept = kept.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable").drop_duplicates(["query_id", "vec_id"])
            kept = kept[kept.groupby("query_id").cumcount() < k]
        if len(kept):
            yield kept[["query_id", "vec_id", "score", "v"]]

    bound_batches()
    found = base.select("id", "v").mapInPandas(search, f"query_id long, vec_id long, score double, v {base.schema['v'].dataType.simpleString()}")
    found = found.groupBy("query_id", "vec_id").agg(F.max_by(F.struct("score", "v"), "score").alias("f"))
    order = Window.partitionBy("query_id").orderBy(F.desc("f.score"), "vec_id")
    pairs = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "f.v").collect()
    if not pairs:
        return plan(count, dims)
    of = np.searchsorted(ids, [r["query_id"] for r in pairs])
    near = vectors.matrix(pd.Series([r["v"] for r in pairs]))
    return cheapest(vectors.unit(x), vectors.unit(np.pad(near, ((0, 0), (0, dims - near.shape[1])))), of, plan(count, dims)[0])


def cheapest(queries: np.ndarray, near: np.ndarray, of: np.ndarray, hashes: int) -> tuple[int, int, int]:
    """Of one to `hashes` hashes the plan that reads the smallest share of the rows; near[i] is a neighbour of queries[of[i]]."""
    axes, plans = 2 << max(0, queries.shape[1] - 1).bit_length(), []
    for h in range(hashes, 0, -1):
        tables, most = PLANS[h][0], axes if h == 1 else min(MOST_PROBES, axes**h)
        need = np.full(len(of), most)
        for t in range(tables):
            own = nearest_axes(near, t, 1, h)[:, 0]
            for at in range(0, len(queries), 64):  # lists of probes are long
                these = np.flatnonzero((of >= at) & (of < at + 64))
                same = nearest_axes(queries[at : at + 64], t, most, h)[of[these] - at] == own[these, None]
                need[these] = np.minimum(need[these], np.where(same.any(axis=1), same.argmax(axis=1), most))
        probes = int(np.sort(need)[int(np.ceil(RECALL * len(need))) - 1]) + 1
        if probes <= most:
            plans.append((tables * probes / axes**h, h, tables, probes))
    return min(plans)[1:]


def _code_bits(dims: int, hashes: int) -> int:
    """Bits of a bucket's number that follow those of its cell."""
    return (hashes - 1) * (1 + max(0, dims - 1).bit_length())


def buckets(vector: Column, dims: int, tables: int, hashes: int) -> Column:
    """array<bigint>: the bucket of each table, the table's number in the bits from 40 on."""

    def batches(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lists:
            x = vectors.matrix(batch)
            if len(x):
                x = vectors.unit(np.pad(x, ((0, 0), (0, dims - x.shape[1]))))
                found = np.stack([nearest_axes(x, t, 1, hashes)[:, 0] + (t << 40) for t in range(tables)], axis=1)
            yield pd.Series(list(found.astype(np.int64)) if len(x) else [], dtype=object)

    bound_batches()
    return F.pandas_udf(batches, "array<bigint>")(vector)


def looked_in(vector: Column, dims: int, tables: int, probes: int, hashes: int) -> Column:
    """array<struct<cell long, codes array<int>>>: the buckets that a query looks in, by cells."""
    bits = _code_bits(dims, hashes)

    def batches(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lists:
            x = vectors.matrix(batch)
            if not len(x):
                yield pd.Series([], dtype=object)
                continue
            x = vectors.unit(np.pad(x, ((0, 0), (0, dims - x.shape[1]))))
            out: list[list[dict]] = [[] for _ in x]
            for t in range(tables):
                for row, found in zip(out, nearest_axes(x, t, probes, hashes) + (t << 40), strict=True):
                    cells, codes = found >> bits, (found & ((1 << bits) - 1)).astype(np.int32)
                    row.extend({"cell": c, "codes": codes[cells == c]} for c in dict.fromkeys(cells.tolist()))
            yield pd.Series(out, dtype=object)

    bound_batches()
    return F.pandas_udf(batches, "array<struct<cell:bigint,codes:array<int>>>")(vector)


def _search(k: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(["cell", "i", "j"], sort=False):
            asks = part[part["asks"]]
            rows = part[~part["asks"]]
            if len(asks) and len(rows):
                codes = np.array([c[0] for c in rows["codes"]])
                out.append(best(asks["id"].to_numpy(np.int64), vectors.matrix(asks["v"]), rows["id"].to_numpy(np.int64), vectors.matrix(rows["v"]), k, list(asks["codes"]), codes))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return search


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, looks: list[np.ndarray] | None = None, codes: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest rows of each query among those whose code it looks in (without codes: all), ties to the smaller id.

    A row with the query's own id is left out. Rows that repeat an id count once, with the nearest of their vectors.
    """
    if codes is None:
        codes, looks = np.zeros(len(ids), int), [np.zeros(1, int)] * len(queries)
    unit_rows, unit_queries = vectors.unit(rows), vectors.unit(queries)
    order = np.argsort(codes, kind="stable")
    asked: dict[int, list[int]] = {}
    for q, some in enumerate(looks):
        for c in some.tolist():
            asked.setdefault(c, []).append(q)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    edges = np.flatnonzero(np.diff(codes[order])) + 1
    for part in np.split(order, edges):
        wide = np.unique(ids[part], return_counts=True)[1].max() * k  # enough for k different ids
        asking = np.array(asked.get(int(codes[part[0]]), []), int)
        for at in range(0, len(asking), 512):
            some = asking[at : at + 512]
            near = unit_queries[some] @ unit_rows[part].T
            near[query_ids[some, None] == ids[None, part]] = -np.inf
            m = min(wide, near.shape[1])
            least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
            q, r = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
            pairs.append((some[q], part[r]))
    if not pairs:
        return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    q, r = (np.concatenate(x) for x in zip(*pairs, strict=True))
    found = pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": vectors.cosine(queries[q], rows[r])})
    if len(np.unique(ids)) < len(ids) or len(np.unique(query_ids)) < len(query_ids):
        found = found.groupby(["query_id", "vec_id"], as_index=False)["score"].max()
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("query_id").cumcount() < k]


def nearest(
    rows: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    hashes: int | None = None, tables: int | None = None, probes: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k nearest other rows found.

    Null, zero and non-finite vectors and null ids take no part, as query or candidate. A row whose id equals
    the query's is not a candidate. Rows that repeat an id are one candidate, and one query, with the nearest of their
    vectors. Fewer than k rows: all of them. Ids are whole numbers; other columns may have any name. Without hashes, tables and probes
    they are measured on these rows; with some of them given, the others are those of PLANS.
    """
    good = rows.where(vectors.usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    base = cut(good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct())
    count, dims = base.count(), max(vectors.dimension(base, "v"), 1)
    if hashes or tables or probes:
        hashes = hashes or plan(count, dims)[0]
        tables, probes = tables or PLANS[hashes][0], probes or PLANS[hashes][1]
    else:
        hashes, tables, probes = measured(base, count, dims, k)
    bits = _code_bits(dims, hashes)
    code = F.col("b").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    index = base.select("id", "v", F.explode(buckets(F.col("v"), dims, tables, hashes)).alias("b"))
    index = index.select("id", "v", F.shiftright("b", bits).alias("cell"), F.array(code).alias("codes"))
    asked = base.where("asks").select("id", "v", F.explode(looked_in(F.col("v"), dims, tables, probes, hashes)).alias("b")).select("id", "v", "b.*")
    sizes = index.groupBy("cell").agg(F.count("*").alias("n_rows")).join(asked.groupBy("cell").agg(F.count("*").alias("n_asks")), "cell")
    sizes = cut(sizes.select("cell", F.ceil(F.col("n_rows") / block).alias("n_i"), F.ceil(F.col("n_asks") / block).alias("n_j"), "n_rows"))
    total = sizes.agg(F.sum(F.col("n_rows") * F.col("n_j")).alias("n")).first()["n"] or 0
    found = cut(_meet(index, asked, sizes, max(64, -(-total // BIN_ROWS)), k))
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = cut(base.where("asks").select("id", "v").join(enough, F.col("id") == F.col("query_id"), "left_anti"))
    n_short = short.count()
    if n_short:
        n_i = max(1, -(-count // block))
        every = base.sparkSession.range(1).select(F.lit(-1).cast("long").alias("cell"), F.lit(n_i).alias("n_i"), F.lit(-(-n_short // block)).alias("n_j"))
        lone = [F.lit(-1).cast("long").alias("cell"), F.array(F.lit(0)).alias("codes")]
        more = _meet(base.select("id", "v", *lone), short.select("id", "v", *lone), every, max(64, n_i), k)
        found = found.unionByName(more)
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(index: DataFrame, asked: DataFrame, sizes: DataFrame, bins: int, k: int) -> DataFrame:
    """Bring row block i and query block j of every cell together."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    a = index.join(sizes, "cell").withColumn("i", deal("n_i")).withColumn("j", every("n_j")).withColumn("asks", F.lit(False))
    b = asked.join(sizes, "cell").withColumn("j", deal("n_j")).withColumn("i", every("n_i")).withColumn("asks", F.lit(True))
    names = ["id", "v", "codes", "cell", "i", "j", "asks"]
    both = a.select(names).unionByName(b.select(names))
    both = both.withColumn("bin", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(bins)))
    return both.groupBy("bin").applyInPandas(_search(k), "query_id long, vec_id long, score double")
