"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample (SAMPLE_ROWS rows
with the smallest hashes); every row is indexed: its nearest centroid's list, the codes of
its residual and its vector. How many lists a query visits, and how many candidates it
reranks, is measured on the sample: as many lists as hold TARGET of the nearest neighbours of
TRIALS sample rows (vectors without clusters need many lists, clustered ones few), and as many
candidates by asymmetric distance as hold KEPT of them. A query takes all rows of the lists it
visits in order of their asymmetric distance (table look-ups of the query's residual), and
only the best of these, over all its lists together, are compared exactly.

Distribution. Equal vectors are one row of the index, with the smallest ids that can be
asked for, so copies make no list hot. Lists are split into blocks of at most about BLOCK_ROWS
rows by a hash. Visits are grouped by block: a task holds one block and the queries that
visit it. The first pass gives each visit's smallest asymmetric distances (four times an even
share of what is reranked), from which the JVM takes each query's bound; the second pass compares
exactly what lies within it. So the index is never copied, and what is shuffled are visits.

Measure: Euclidean distance in double precision between vectors of one length; rows of
other lengths are no candidates, each length is searched by itself.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without an id, which no result could name; every other row does: rows that repeat an id
are candidates of their own, and queries of their own with results each; a query leaves out its
own row only. With fewer candidates than k all are returned; ties go to the smaller id. Very
long vectors cost memory per block in proportion. Extra columns aren't read; empty tables
give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS, ITERATIONS = 20_000, 10
BLOCK_ROWS, MAX_LISTS = 16_384, 4096
#: Share of true neighbours whose lists have to be visited, sample rows that measure it, and share of true neighbours to rerank.
TARGET, TRIALS, KEPT = 0.96, 400, 0.98
#: Candidates to rerank at least, in terms of k, and asymmetric distances and exact comparisons that are held at once.
RERANK, DISTANCES, PAIRS = 4, 1 << 21, 1 << 16
CODES, SUBSPACE = 256, 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v holds floats as doubles."""
    v = F.col("v")
    fine = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(v.isNotNull() & F.col("id").isNotNull()).where(fine)


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(h, v, ids): each vector once, with its k + 1 smallest ids, in order. No group is collected
    whole: the rank limits every partition to k + 1 rows a vector before the shuffle."""
    keyed = rows.withColumn("h", F.xxhash64("v"))
    by = Window.partitionBy("h", "v").orderBy("id")
    few = keyed.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def kmeans(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    pick = np.random.default_rng(seed)
    centres = points[np.sort(pick.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(ITERATIONS):
        near = nearest(points, centres)
        size = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(near[order]) > 0)))
        total = np.zeros_like(centres)
        total[near[order][first]] = np.add.reduceat(points[order], first, axis=0)
        full = size > 0
        centres[full] = total[full] / size[full, None]
        if not full.all():
            centres[~full] = points[pick.choice(len(points), int((~full).sum()))]
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)]) if len(points) else np.empty(0, np.int64)


class Quantiser:
    """Coarse centroids and a codebook per subspace of the residuals, for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists, 1)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = list(range(0, sample.shape[1], SUBSPACE))
        self.books = [kmeans(rest[:8192, c : c + SUBSPACE], CODES, 2 + c) for c in self.cuts]

    def plan(self, sample: np.ndarray, k: int) -> tuple[int, int, float]:
        """How many lists hold TARGET of the neighbours within the sample, which are farther off than
        those among all rows, so it errs on the side of more lists; how many of the candidates in
        order of asymmetric distance hold KEPT of them; the share of the sample that was visited."""
        if len(sample) < 2:
            return 1, k, 1.0
        trials = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(np.int64)
        far = squared(sample[trials], sample)
        far[np.arange(len(trials)), trials] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        order = np.argsort(squared(sample[trials], self.centres), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        cells, codes = self.encode(sample)
        ranks = np.take_along_axis(place, cells[near], axis=1)
        probes = int(np.quantile(ranks, TARGET, method="higher")) + 1
        found = np.full(far.shape, np.inf, np.float32)
        for cell in range(len(self.centres)):
            own, asked = np.flatnonzero(cells == cell), np.flatnonzero(place[:, cell] < probes)
            found[asked[:, None], own[None, :]] = self.distances(sample[trials[asked]], cell, codes[own])
        found[np.arange(len(trials)), trials] = np.inf
        there = np.take_along_axis(found, near, axis=1)
        spots = np.stack([np.searchsorted(np.sort(f), t) for f, t in zip(found, there, strict=True)])
        spots = spots[np.isfinite(there)]
        rerank = int(np.quantile(spots, KEPT, method="higher")) + 1 if len(spots) else k
        return probes, rerank, float(np.isfinite(found).mean())

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = nearest(points, self.centres)
        rest = points - self.centres[cells]
        codes = np.stack([nearest(rest[:, c : c + SUBSPACE], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        return cells, codes.astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of each query's residual to each code, by subspace."""
        rest = queries - self.centres[cell]
        out = np.full((len(queries), len(self.books), CODES), np.inf)
        for at, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, at, : len(book)] = squared(rest[:, c : c + SUBSPACE], book)
        return out

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (squared) of queries to the rows of a list."""
        tables = self.tables(queries, cell)
        total = np.zeros((len(queries), len(codes)), np.float32)
        for at in range(len(self.books)):
            total += tables[:, at, codes[:, at]]
        return total


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), size)


def _frame(parts: list[pd.DataFrame], **kinds: type) -> pd.DataFrame:
    return pd.concat(parts) if parts else pd.DataFrame({c: np.empty(0, t) for c, t in kinds.items()})


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_every: int = 100, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, the
    k nearest other rows found, by Euclidean distance."""
    from searchlake.llm.common import Scratch

    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    taken = usable(vectors, id_col, vector_col)
    rows = scratch.write(distinct(taken, k), "rows")
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(SAMPLE_ROWS).collect()}
    sample: dict[int, list] = {}
    for r in rows.orderBy("h", "v").limit(SAMPLE_ROWS).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    out = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out)
    models, plans = {}, {}
    for size, own in sample.items():
        points = np.array(own)
        models[size] = Quantiser(points, int(min(MAX_LISTS, max(1, round(lengths.get(size, 1) ** 0.5)), len(own))))
        found = models[size].plan(points, k)
        # among more rows than the sample's more come before a true neighbour
        denser = max(1.0, lengths.get(size, 1) / len(own)) ** 0.5
        plans[size] = (probes or found[0], rerank or max(math.ceil(found[1] * denser), RERANK * k))
    sample.clear()
    rare = max(1, math.ceil(4 * sum(lengths.values()) / SAMPLE_ROWS / BLOCK_ROWS))

    # a length outside the sample has few rows, in one list of its own that is compared whole

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, own in f.groupby(f["v"].map(len)):
                points = np.stack(own["v"].to_numpy())
                cells, codes = models[size].encode(points) if size in models else (np.zeros(len(own), np.int64), np.zeros((len(own), 1), np.uint8))
                yield pd.DataFrame({"size": size, "cell": cells, "h": own["h"], "ids": own["ids"], "codes": [c.tobytes() for c in codes], "v": [p.tobytes() for p in points]})

    index = scratch.write(rows.select("h", "v", "ids").mapInPandas(encode, "size int, cell int, h long, ids array<long>, codes binary, v binary"), "index")
    known = index.groupBy("size", "cell").count().where(F.col("size").isin(sorted(models))).collect()  # at most MAX_LISTS a length, lists are of the sample
    counts = {size: np.zeros(len(m.centres), np.int64) for size, m in models.items()}
    for r in known:
        counts[r["size"]][r["cell"]] = r["count"]
    blocks = index.where(F.col("size").isin(sorted(models))).groupBy("size", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    blocks = F.broadcast(scratch.write(blocks.where("parts > 1"), "blocks"))  # no more rows than the sample has
    parts = F.coalesce("parts", F.when(F.col("size").isin(sorted(models)), F.lit(1)).otherwise(rare))
    placed = index.join(blocks, ["size", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("h"), parts).cast("int")).drop("parts")

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, own in f.groupby(f["v"].map(len) // 8):
                if size not in models:
                    yield pd.DataFrame({"h": own["h"], "size": size, "cell": 0, "v": own["v"]})
                    continue
                order = np.argsort(squared(_matrix(own["v"], size), models[size].centres), axis=1, kind="stable")
                # more lists where those hold too few rows
                enough = (np.cumsum(counts[size][order], axis=1) < k + 1).sum(1) + 1
                for at, n in enumerate(np.maximum(plans[size][0], enough).tolist()):
                    cells = order[at, :n]
                    cells = cells[counts[size][cells] > 0]
                    yield pd.DataFrame({"h": own["h"].iloc[at], "size": size, "cell": cells, "v": own["v"].iloc[at]})

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(v=[np.asarray(v, np.float64).tobytes() for v in f["v"]])

    asking = taken.where(F.pmod("id", F.lit(query_every)) == 0).groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("h", F.xxhash64("v"))
    asking = scratch.write(asking.mapInPandas(packed, "id long, v binary, times long, h long"), "asking")
    queries = asking.select("h", "v").distinct()
    visits = queries.mapInPandas(visit, "h long, size int, cell int, v binary")
    visits = scratch.write(visits.join(blocks, ["size", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"), "visits")
    by = ("size", "cell", "part")

    def prepared(own: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        """The queries of a block in runs, their vectors, their asymmetric distances, and the block's vectors."""
        size, cell = int(own["size"].iloc[0]), int(own["cell"].iloc[0])
        codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1)
        points = _matrix(own["v"], size)
        step = max(1, DISTANCES // max(len(own), 1))
        for begin in range(0, len(asked), step):
            some = asked.iloc[begin : begin + step]
            raw = _matrix(some["v"], size)
            near = models[size].distances(raw, cell, codes) if size in models else np.zeros((len(some), len(own)), np.float32)
            yield some, raw, near, points

    def smallest(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(asked):
            most = plans.get(int(own["size"].iloc[0]), (1, RERANK * k))[1]
            # a share of what is reranked: the bound can only rise by what is left out here
            own_share = min(most, max(4 * RERANK, 4 * most // plans.get(int(own["size"].iloc[0]), (1, 0))[0]))
            for some, _, near, _ in prepared(own, asked):
                best = np.partition(near, own_share - 1, axis=1)[:, :own_share] if near.shape[1] > own_share else near
                rows.append(pd.DataFrame({"h": some["h"].to_numpy(), "v": some["v"].to_numpy(), "size": int(own["size"].iloc[0]), "near": list(best)}))
        return _frame(rows, h=np.int64, v=object, size=np.int32, near=object)

    first = placed.select(*by, "codes", "v").groupBy(*by).cogroup(visits.groupBy(*by)).applyInPandas(smallest, "h long, v binary, size int, near array<float>")
    most = F.coalesce(F.create_map(*[F.lit(x) for size, p in plans.items() for x in (size, p[1])])[F.col("size")], F.lit(RERANK * k))
    all_near = F.array_sort(F.flatten(F.collect_list("near")))  # at most lists visited x reranked
    bound = F.element_at("near", F.least(F.size("near"), most)) * F.lit(1.00001).cast("float")  # the second pass may round another way
    bounds = first.groupBy("h", "v", "size").agg(all_near.alias("near")).select("h", "v", bound.alias("bound"))
    asked = visits.join(scratch.write(bounds, "bounds"), ["h", "v"])

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            for some, raw, near, points in prepared(own, asked):
                row, other = np.nonzero(near <= some["bound"].to_numpy(np.float32)[:, None])
                exact = np.concatenate([np.sqrt(((points[other[i : i + PAIRS]] - raw[row[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), PAIRS)] or [np.empty(0)])
                order = np.lexsort((exact, row))
                row, other, exact = row[order], other[order], exact[order]
                # the k + 1 nearest of a query within the block, and ties with the last of them
                start = np.searchsorted(row, row, "left")
                last = np.minimum(start + k, np.searchsorted(row, row, "right") - 1)
                take = exact <= exact[last]
                found.append(pd.DataFrame({"h": some["h"].to_numpy()[row[take]], "v": some["v"].to_numpy()[row[take]], "ids": own["ids"].to_numpy()[other[take]], "score": exact[take]}))
        return _frame(found, h=np.int64, v=object, ids=object, score=np.float64)

    met = placed.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(best, "h long, v binary, ids array<long>, score double")
    met = met.select("h", "v", "score", F.explode("ids").alias("vec_id"))
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    # the rows that ask: each leaves out itself once, and copies of a row have results each
    joined = ranked.join(asking, ["h", "v"])
    itself = (F.col("score") == 0) & (F.col("vec_id") == F.col("id"))
    seen = joined.withColumn("n", F.row_number().over(Window.partitionBy("id", "h", "v", itself).orderBy("score", "vec_id")))
    kept = seen.where(~itself | (F.col("n") > 1))
    rank = kept.withColumn("rank", F.row_number().over(Window.partitionBy("id", "h", "v").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return rank.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
