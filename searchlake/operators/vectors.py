"""Nearest neighbours by exact distance, and rank fusion with text hits."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlake.functions import vectors
from searchlake.sources.index import Index

MAX_K = 10_000


def knn(index: Index, clauses: list[dict[str, Any]], *, eligible: list[DataFrame | None] | None = None, operator: str = "or") -> DataFrame:
    """(doc_id, clause, s): the k best documents of each clause {field, vector, k, boost}.

    Clauses without a filter are scored in one scan of the vectors, the others in one each.
    Where no document has several vectors the best k rows of each partition are all that is
    shuffled; else a document counts by its best vector. eligible: documents that a clause may
    return.
    """
    if operator not in ("or", "and"):
        raise ValueError("the operator is or, or and")
    norm = 1 / math.sqrt(sum(float(c.get("boost") or 1.0) ** 2 for c in clauses)) if clauses else 1.0
    vector_rows = index.values.where((F.col("kind") == "vector") & F.col("field").isin(sorted({c["field"] for c in clauses})))
    several = bool(vector_rows.where((F.size("ap") > 0) | (F.col("doc_id") != F.col("root_id"))).limit(1).count())
    scored, sizes = [], []
    for i, c in enumerate(clauses):
        k = int(c["k"])
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k is 1 to {MAX_K}")
        query = c.get("vector") or vectors.decode_base64(c["vector_base64"])
        metric = F.lit(None).cast("double")
        for name in (vectors.L2, vectors.DOT, vectors.COSINE):
            metric = F.when(F.col("s") == name, vectors.similarity(F.col("vec"), query, name)).otherwise(metric)
        boost = float(c.get("boost") or 1.0) * norm if len(clauses) > 1 or c.get("boost") else 1.0
        own = F.when((F.col("field") == c["field"]) & (F.size("vec") == len(query)), metric)
        scored.append(F.struct(F.lit(i).alias("clause"), own.cast("double").alias("raw"), F.lit(boost).alias("boost"), F.lit(k).alias("k")))
        sizes.append(k)
    filtered = [i for i in range(len(clauses)) if eligible and eligible[i] is not None]
    free = [i for i in range(len(clauses)) if i not in filtered]
    sources = [(vector_rows, free)] if free else []
    sources += [(vector_rows.join(eligible[i].select("doc_id"), "doc_id", "left_semi"), [i]) for i in filtered]
    parts = []
    for rows, own in sources:
        each = rows.select(F.col("root_id").alias("doc_id"), F.explode(F.array(*[scored[i] for i in own])).alias("c")).select("doc_id", "c.*").where("raw is not null")
        if several:
            each = each.groupBy("clause", "doc_id", "boost", "k").agg(F.max("raw").alias("raw"))
        best = Window.partitionBy("clause").orderBy(F.desc("raw"), "doc_id")
        top = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(sizes[i] for i in own)).where(F.col("r") <= F.col("k"))
        parts.append(top.select("doc_id", "clause", (F.col("raw") * F.col("boost")).alias("s")))
    found = reduce(DataFrame.unionAll, parts)
    if operator == "and":
        every = found.groupBy("doc_id").agg(F.count_distinct("clause").alias("n")).where(F.col("n") == len(clauses))
        found = found.join(every.select("doc_id"), "doc_id", "left_semi")
    return found


def additive(text: DataFrame | None, near: DataFrame) -> DataFrame:
    """Scores added up over the union of text hits (doc_id, score) and neighbours."""
    own = near.select("doc_id", F.col("s").alias("score"))
    return (own if text is None else text.select("doc_id", "score").unionByName(own)).groupBy("doc_id").agg(F.sum("score").alias("score"))


def _window(df: DataFrame, by: str, window: int, *tie: str) -> DataFrame:
    """The best rows of a source with their ranks; the limit keeps the ranking small."""
    best = df.orderBy(F.desc(by), *tie).limit(window)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), *tie)))


def _sources(text: DataFrame | None, near: DataFrame, clauses: list[dict], boost: float, window: int):
    if text is not None:
        yield boost, _window(text.where("score > 0").select("doc_id", F.col("score").alias("s")), "s", window, "doc_id")
    for i, c in enumerate(clauses):
        yield float(c.get("boost") or 1.0), _window(near.where(F.col("clause") == i).select("doc_id", "s"), "s", window, "doc_id")


def reciprocal_rank_fusion(text: DataFrame | None, near: DataFrame, clauses: list[dict], *, window: int, constant: int = 60, boost: float = 1.0) -> DataFrame:
    """Sum of weight / (constant + rank) over the sources that rank a document."""
    parts = [df.select("doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("score")) for w, df in _sources(text, near, clauses, boost, window)]
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))


def relative_score_fusion(text: DataFrame | None, near: DataFrame, clauses: list[dict], *, window: int, boost: float = 1.0) -> DataFrame:
    """Sum of weighted scores, each scaled to 0..1 within its source's window."""
    parts = []
    for w, df in _sources(text, near, clauses, boost, window):
        edge = Window.partitionBy()
        low, high = F.min("s").over(edge), F.max("s").over(edge)
        scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("s") - low) / F.nullif(high - low, F.lit(0.0)))
        parts.append(df.select("doc_id", (scaled * w).alias("score")))
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))


def centroids(index: Index, field: str, lists: int, seed: int = 1) -> DataFrame:
    """(cell, n): sizes of the cells of k-means centroids over a field's vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.values.where((F.col("field") == field) & (F.col("kind") == "vector")).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("cell")).agg(F.count("*").alias("n"))
