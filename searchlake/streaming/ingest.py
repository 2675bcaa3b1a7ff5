"""Streaming ingest: every micro-batch becomes a version of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from searchlake.sources.index import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, *, available_now: bool = False, done: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """stream: doc_id, source (null deletes) and optionally seq. A batch that is run again after
    a failure is recognised by its number, so each takes effect once. done gets (batch, version)."""

    def upsert(batch: DataFrame, number: int) -> None:
        if number <= int(store.internal().get("last_batch", -1)):
            return
        version = store.batch(batch)
        store.set_internal("last_batch", str(number))
        if done:
            done(number, version)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def percolate(stream: DataFrame, queries: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """Standing queries on a stream: rows that hold all words of a query, with the query's name.

    Words are compared as lower-cased runs of letters; the queries are a small static table."""
    spark = stream.sparkSession
    table = spark.createDataFrame(sorted((n, sorted({w.lower() for w in ws})) for n, ws in queries.items()), "query string, words array<string>")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}+"), F.lit(0)), F.lower))
    joined = stream.withColumn("__words", words).join(F.broadcast(table), F.size(F.array_except("words", "__words")) == 0)
    return joined.drop("__words", "words")
