"""Index tables: field values, postings and what is counted from them.

An index is a mapping and three DataFrames. ``docs``: one row per document (and per nested
child). ``values``: one row per field value. ``postings``: one row per field, term and
document, with frequency, field length and locations. Dictionaries and statistics are
groupings of the postings; stored indexes keep them as tables of their own, and every file of
postings is sorted by field, term and document, so a query reads the row groups of its
terms only.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlake.functions.analysis import TOKENS, Analyzer
from searchlake.sources.mapping import ROW, DocumentMapping, FieldMapping, IndexMapping, Walker, analyzers

ALL = "_all"
POSTINGS = ["field", "term", "doc_id", "freq", "len", "locs"]


#: Field rows that a worker holds as Python objects.
BATCH_ROWS = 5_000


def walked(frames: Iterator[pd.DataFrame], mapping: IndexMapping) -> Iterator[pd.DataFrame]:
    """Field rows of documents, in frames of about BATCH_ROWS."""
    walker = Walker(mapping)
    names = [c.split()[0] for c in ROW.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"d": "Float64", "ts_ns": "Int64", "b": "boolean", "lon": "Float64", "lat": "Float64"})

    rows: list[tuple] = []
    for f in frames:
        for i, n, s in zip(f["doc_id"], f["seq"], f["source"], strict=True):
            rows += walker.rows(i, n, json.loads(s) if s else None)
            if len(rows) >= BATCH_ROWS:
                yield frame(rows)
                rows = []
    if rows:
        yield frame(rows)


def field_rows(docs: DataFrame, mapping: IndexMapping) -> DataFrame:
    """docs (doc_id string, seq long, source JSON string) -> field rows."""
    return docs.select("doc_id", "seq", "source").mapInPandas(lambda frames: walked(frames, mapping), ROW)


#: Terms that a value of another kind adds to the length of the combined field.
OTHER_LENGTHS = {"number": 16, "datetime": 16, "boolean": 1, "geopoint": 8, "IP": 1}


def postings_of(texts: DataFrame, by_name: dict[str, Analyzer], with_all: bool = True, others: DataFrame | None = None) -> DataFrame:
    """Text rows (doc_id, field, ap, s, analyzer, in_all) -> postings.

    others: rows of other kinds, which count for the length of the combined field.

    Texts are shuffled once, by document and before they are analysed; lengths, frequencies and
    lists are grouped under that partitioning. Each analyzer in use reads the rows that name it.
    """
    rows = texts.select("doc_id", "field", "ap", "in_all", "s", "analyzer", F.lit(0).alias("more"))
    if len(by_name) > 1:
        rows = rows.where(F.col("analyzer").isin(sorted(by_name)))
    else:
        rows = rows.withColumn("analyzer", F.lit(next(iter(by_name))))
    if with_all and others is not None:
        size = F.coalesce(F.create_map(*[x for k, n in OTHER_LENGTHS.items() for x in (F.lit(k), F.lit(n))])[F.col("kind")], F.lit(0))
        rows = rows.unionAll(others.where("in_all and indexed").select("doc_id", "field", "ap", "in_all", F.lit(None).cast("string"), F.lit(None).cast("string"), size))
    tokens = F.array().cast(TOKENS)
    for name, own in sorted(by_name.items()):
        mine = F.col("analyzer") == name
        tokens = F.when(mine, own.column(F.when(mine, F.col("s")))).otherwise(tokens)
    fields = F.array("field")
    if with_all:
        fields = F.when(F.col("analyzer").isNull(), F.array(F.lit(ALL))).when(F.col("in_all"), F.array("field", F.lit(ALL))).otherwise(fields)
    at = F.struct(F.col("field").alias("src"), "ap").alias("at")
    analysed = rows.repartition("doc_id").select("doc_id", "field", "ap", "in_all", "analyzer", "more", tokens.alias("tokens"))
    values = analysed.select("doc_id", F.explode(fields).alias("to"), at, "tokens", (F.size("tokens") + F.col("more")).alias("size"))
    grouped = values.groupBy("doc_id", "to").agg(F.collect_list(F.struct("at", "tokens")).alias("all"), F.sum("size").cast("int").alias("len"))
    each = grouped.select("doc_id", F.col("to").alias("field"), "len", F.explode("all").alias("v")).select("doc_id", "field", "len", "v.at", F.explode("v.tokens").alias("t"))
    loc = F.struct(F.col("at.src").alias("src"), F.col("at.ap").alias("ap"), F.col("t.pos").alias("pos"))
    return each.groupBy("doc_id", "field", F.col("t.term").alias("term")).agg(F.count("*").cast("int").alias("freq"), F.first("len").alias("len"), F.collect_list(loc).alias("locs")).select(*POSTINGS)


@dataclass
class Index:
    mapping: IndexMapping
    docs: DataFrame  # doc_id, root_id, ancestors, seq, source
    values: DataFrame
    postings: DataFrame
    synonyms: DataFrame | None = None  # collection, lhs, rhs
    term_stats: DataFrame | None = None  # field, term, df
    name: str = ""
    by_field: bool = False  # values come field by field, each partition has one

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @staticmethod
    def from_json(docs: DataFrame, mapping: IndexMapping | dict | None = None, *, synonyms: DataFrame | None = None) -> Index:
        """docs: doc_id, source (JSON string) and optionally seq (ingest order)."""
        mapping = mapping if isinstance(mapping, IndexMapping) else IndexMapping.of(mapping or {})
        if "seq" not in docs.columns:
            docs = docs.withColumn("seq", F.lit(0).cast("long"))
        own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "source")
        rows = field_rows(own, mapping)
        roots = own.select("doc_id", F.col("doc_id").alias("root_id"), F.array("doc_id").alias("ancestors"), "seq", "source")
        children = rows.where("kind = 'nested'").select("doc_id", "root_id", "ancestors", "seq", F.lit(None).cast("string").alias("source"))
        texts = rows.where("kind = 'text' and indexed")
        tables = roots.unionAll(children) if mapping.nested_paths() else roots
        return Index(mapping, tables, rows.where("kind <> 'nested'"), postings_of(texts, analyzers(mapping), others=rows.where("kind not in ('text', 'nested')")), synonyms)

    @staticmethod
    def from_columns(df: DataFrame, id_col: str, fields: dict[str, FieldMapping], *, mapping: IndexMapping | None = None, with_all: bool = False) -> Index:
        """Typed columns as fields, without a Python walk over the rows."""
        mapping = mapping or IndexMapping()
        mapping = replace(mapping, default_mapping=DocumentMapping(dynamic=False, properties={n: DocumentMapping(fields=[f]) for n, f in fields.items()}))
        base = df.select(F.col(id_col).cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("seq"), *[F.col(f"`{n}`") for n in fields])
        each = []
        for name, f in fields.items():
            c = F.col(f"`{name}`")
            values: dict[str, Column] = {"kind": F.lit(f.type), "field": F.lit(name), "ap": F.array().cast("array<bigint>")}
            if f.type == "text":
                values |= {"s": c.cast("string"), "analyzer": F.lit(f.analyzer or mapping.default_analyzer)}
            elif f.type == "number":
                values |= {"d": c.cast("double")}
            elif f.type == "datetime":
                values |= {"ts_ns": F.unix_micros(c.cast("timestamp")) * 1000}
            elif f.type == "boolean":
                values |= {"b": c.cast("boolean")}
            elif f.type == "geopoint":
                values |= {"lon": c["lon"], "lat": c["lat"]}
            elif f.type == "IP":
                values |= {"ip": c}
            else:
                values |= {"vec": c.cast("array<float>"), "s": F.lit(f.similarity)}
            values |= {"in_all": F.lit(f.include_in_all), "indexed": F.lit(f.index), "stored": F.lit(f.store), "doc_values": F.lit(f.doc_values)}
            columns = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in (p.split(" ", 1) for p in ROW.split(", ")) if n not in ("doc_id", "root_id", "ancestors", "seq")]
            each.append(base.where(c.isNotNull()).select("doc_id", F.col("doc_id").alias("root_id"), F.array("doc_id").alias("ancestors"), "seq", *columns))
        rows = each[0]
        for e in each[1:]:
            rows = rows.unionAll(e)
        docs = base.select("doc_id", F.col("doc_id").alias("root_id"), F.array("doc_id").alias("ancestors"), "seq", F.lit(None).cast("string").alias("source"))
        texts = [e for e, f in zip(each, fields.values(), strict=True) if f.type == "text" and f.index]
        own = analyzers(mapping)
        used = {f.analyzer or mapping.default_analyzer for f in fields.values() if f.type == "text"}
        if texts:
            joined = texts[0]
            for t in texts[1:]:
                joined = joined.unionAll(t)
            postings = postings_of(joined, {n: own[n] for n in used}, with_all)
        else:
            postings = postings_of(rows.where("false"), {mapping.default_analyzer: own[mapping.default_analyzer]}, False)
        return Index(mapping, docs, rows, postings, by_field=True)

    # --- dictionaries and statistics ---

    @cached_property
    def dictionary(self) -> DataFrame:
        """field, term, df."""
        return self.term_stats if self.term_stats is not None else self.postings.groupBy("field", "term").agg(F.count("*").alias("df"))

    @cached_property
    def count(self) -> int:
        return self.docs.count()

    def analyzer(self, field: str, name: str | None = None) -> Analyzer:
        own = self.mapping.registry()
        return own.analyzer(name or (self.mapping.default_analyzer if field == ALL else self.mapping.analyzer_name(field)))

    def average_length(self, field: str, mean: bool = False) -> float:
        """The length BM25 compares with: distinct terms over documents, rounded up; or the mean length."""
        if mean:
            got = self.postings.where(F.col("field") == field).select("doc_id", "len").distinct().agg(F.avg("len")).first()[0]
            return float(got or 0.0)
        return float(math.ceil(self.dictionary.where(F.col("field") == field).count() / max(1, self.count)))

    def fields(self) -> DataFrame:
        return self.values.select("field").distinct().orderBy("field")

    def field_dict(self, field: str, *, start: str | None = None, end: str | None = None, prefix: str | None = None) -> DataFrame:
        """Terms of a field with document counts, in order; a range includes both ends."""
        terms = self.dictionary.where(F.col("field") == field)
        if start is not None:
            terms = terms.where(F.col("term") >= start)
        if end is not None:
            terms = terms.where(F.col("term") <= end)
        if prefix is not None:
            terms = terms.where(F.col("term").startswith(prefix))
        return terms.select("term", "df").orderBy("term")

    def term_frequencies(self, field: str, limit: int = 10, descending: bool = True) -> DataFrame:
        terms = self.dictionary.where(F.col("field") == field).select("term", "df")
        return terms.orderBy(F.desc("df") if descending else F.asc("df"), "term").limit(limit)

    def field_stats(self) -> DataFrame:
        per = self.postings.groupBy("field", "doc_id").agg(F.first("len").alias("len"), F.count("*").alias("n"))
        return per.groupBy("field").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"), F.avg("len").alias("mean_length"))

    def document(self, doc_id: str) -> DataFrame:
        """The stored values of a document."""
        return self.values.where((F.col("doc_id") == doc_id) & F.col("stored"))


def alias(*members: Index, names: list[str] | None = None) -> Index:
    """Several indexes as one; scores come from statistics over all of them."""
    names = names or [m.name or str(i) for i, m in enumerate(members)]

    def both(pick) -> DataFrame:
        out = pick(members[0])
        for m in members[1:]:
            out = out.unionByName(pick(m))
        return out

    named = []
    for m, n in zip(members, names, strict=True):
        named.append(replace(m, docs=m.docs.withColumn("index", F.lit(n))))
    docs = named[0].docs
    for m in named[1:]:
        docs = docs.unionByName(m.docs)
    synonyms = [m.synonyms for m in members if m.synonyms is not None]
    joined = synonyms[0] if synonyms else None
    for s in synonyms[1:]:
        joined = joined.unionByName(s)
    return Index(members[0].mapping, docs, both(lambda m: m.values), both(lambda m: m.postings), joined)


class Alias:
    """A name for several indexes, which may come and go: a search sees those that are members when it starts."""

    def __init__(self, **members: Index):
        self.members: dict[str, Index] = dict(members)

    def add(self, **members: Index) -> None:
        self.members |= members

    def remove(self, *names: str) -> None:
        for n in names:
            self.members.pop(n, None)

    def swap(self, add: dict[str, Index], remove: Iterable[str]) -> None:
        """Both at once: no search sees one without the other."""
        gone = set(remove)
        self.members = {n: m for n, m in self.members.items() if n not in gone} | add

    def index(self) -> Index:
        """The members as one index, with scores from statistics over all of them."""
        own = self.members
        if not own:
            raise ValueError("the alias has no members")
        return alias(*own.values(), names=list(own))

    def status(self) -> tuple[Index | None, dict[str, Any]]:
        """The members that can be read as one index, and a status: total, failed, successful, errors by member."""
        fine, errors = {}, {}
        for n, m in self.members.items():
            try:
                m.docs.limit(1).count()
                fine[n] = m
            except Exception as e:  # whatever keeps a member from being read
                errors[n] = str(e).split("\n", 1)[0]
        found = alias(*fine.values(), names=list(fine)) if fine else None
        return found, {"total": len(self.members), "failed": len(errors), "successful": len(fine), "errors": errors}


def synonym_table(spark: SparkSession, collection: str, definitions: list[dict[str, list[str]]]) -> DataFrame:
    """Definitions with synonyms alone make them equivalent; with input, each input gets the synonyms."""
    pairs = set()
    for d in definitions:
        if not d.get("synonyms"):
            raise ValueError("a synonym definition needs synonyms")
        for a in d.get("input") or d["synonyms"]:
            pairs.update((collection, a, b) for b in d["synonyms"] if a != b)
    return spark.createDataFrame(sorted(pairs), "collection string, lhs string, rhs string")


TABLES = ("docs", "values", "postings", "terms")
#: While tables are written. Partitions follow the bytes shuffled, so what a task sorts or groups is
#: bounded (rows of a few bytes when compressed are many times that in memory), and an aggregation
#: into lists keeps so many groups in a hash table before it sorts.
_WRITING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write_tables(index: Index, at: str) -> None:
    """The one layout of stored indexes: values clustered by field (range-clustered by field and document,
    unless partitions have one field each); postings in files of some documents each, every file sorted by field, term and document, so that a query reads the row
    groups and pages of its fields and terms. Postings are never shuffled, the texts are."""
    spark = index.spark
    with writing(spark):
        index.docs.write.mode("overwrite").parquet(f"{at}/docs")
        values = index.values if index.by_field else index.values.repartitionByRange("field", "doc_id").sortWithinPartitions("field", "doc_id")
        values.write.mode("overwrite").parquet(f"{at}/values")
        index.postings.sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{at}/postings")
        terms = spark.read.schema(index.postings.schema).parquet(f"{at}/postings").groupBy("field", "term").agg(F.count("*").alias("df"))
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{at}/terms")


def read_tables(spark: SparkSession, at: str, index: Index) -> Index:
    """The stored tables of an index in its place."""
    read = spark.read.parquet
    return replace(index, docs=read(f"{at}/docs"), values=read(f"{at}/values"), postings=read(f"{at}/postings"), term_stats=read(f"{at}/terms"), by_field=False)


class Store:
    """An index on disk: segments, and versions that list them.

    A batch writes one segment of its own documents and a table of what it replaces or
    deletes in earlier ones; nothing else is read or analysed again. A version is a small
    file with the segments that count, and a pointer names the current one, so readers keep the
    version they opened. Readers leave out replaced documents and subtract them from the
    dictionary. When a version would have more than MERGE segments, the smaller ones are merged
    into one (what they hold live is analysed again): each merge takes the newest run of segments
    in which none has more rows than all newer ones together, so a row is merged about as often
    as the index doubles. Of several rows for a document in a batch the last one (by seq) wins.
    Old versions stay for rollback until they are pruned.
    """

    MERGE = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(spark: SparkSession, path: str, mapping: IndexMapping | dict | None = None) -> Store:
        own = Store(spark, path)
        mapping = mapping if isinstance(mapping, IndexMapping) else IndexMapping.of(mapping or {})
        own._commit([], mapping, None)
        return own

    # small files through the Hadoop file system, so any storage works

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(path).collect())

    def _names(self, path: str, prefix: str) -> list[int]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        return self._names(self.path, "v=")

    def current(self) -> int:
        return int(self._get(f"{self.path}/CURRENT"))

    def mapping(self, version: int | None = None) -> IndexMapping:
        return IndexMapping.of(self._get(f"{self.path}/v={version or self.current()}/mapping.json"))

    def segments(self, version: int | None = None) -> list[dict[str, int]]:
        """The segments of a version, oldest first: number and rows."""
        return json.loads(self._get(f"{self.path}/v={version or self.current()}/segments.json"))["segments"]

    def _commit(self, segments: list[dict[str, int]], mapping: IndexMapping, base: int | None, synonyms: DataFrame | None = None) -> int:
        """A new version; synonyms are kept with a version, and those of the base go along."""
        version = max([0, *self.versions()]) + 1
        at, own = f"{self.path}/v={version}", None if base is None else self._synonyms(base)
        if synonyms is not None:
            own = synonyms if own is None else own.unionByName(synonyms).distinct()
        if own is not None:
            own.write.mode("overwrite").parquet(f"{at}/synonyms")
        self._put(f"{at}/segments.json", json.dumps({"segments": segments}))
        self._put(f"{at}/mapping.json", mapping.to_json())
        self._put(f"{self.path}/CURRENT", str(version))
        return version

    def _synonyms(self, version: int) -> DataFrame | None:
        at = f"{self.path}/v={version}/synonyms"
        fs, p = self._fs(at)
        return self.spark.read.parquet(at) if fs.exists(p) else None

    def _at(self, segment: dict[str, int]) -> str:
        return f"{self.path}/segments/s={segment['n']}"

    def _segment(self, docs: DataFrame, mapping: IndexMapping, dead: DataFrame | None) -> dict[str, int]:
        """A segment of documents (doc_id, seq, source); dead: ids that it replaces in earlier segments."""
        n = max([0, *self._names(f"{self.path}/segments", "s=")]) + 1
        at = self._at({"n": n})
        docs.write.mode("overwrite").parquet(f"{at}/source")
        source = self.spark.read.schema(docs.schema).parquet(f"{at}/source")
        write_tables(Index.from_json(source, mapping), at)
        if dead is not None:
            dead.select("doc_id").distinct().write.mode("overwrite").parquet(f"{at}/dead")
        return {"n": n, "rows": source.count(), "dead": int(dead is not None)}

    def _dead(self, segments: list[dict[str, int]]) -> DataFrame | None:
        """What later segments replace."""
        parts = [self.spark.read.parquet(f"{self._at(s)}/dead") for s in segments if s["dead"]]
        return reduce(DataFrame.unionAll, parts) if parts else None

    def _live(self, segments: list[dict[str, int]], name: str, key: str = "doc_id") -> DataFrame:
        parts = []
        for i, s in enumerate(segments):
            own, dead = self.spark.read.parquet(f"{self._at(s)}/{name}"), self._dead(segments[i + 1 :])
            parts.append(own if dead is None else own.join(dead, own[key] == dead["doc_id"], "left_anti"))
        return reduce(DataFrame.unionAll, parts)

    def _dictionary(self, segments: list[dict[str, int]]) -> DataFrame:
        """Stored counts, less the postings of replaced documents."""
        parts = []
        for i, s in enumerate(segments):
            parts.append(self.spark.read.parquet(f"{self._at(s)}/terms"))
            dead = self._dead(segments[i + 1 :])
            if dead is not None:
                gone = self.spark.read.parquet(f"{self._at(s)}/postings").join(dead, "doc_id", "left_semi")
                parts.append(gone.groupBy("field", "term").agg((-F.count("*")).alias("df")))
        every = reduce(DataFrame.unionAll, parts)
        return every if len(parts) == 1 else every.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def open(self, version: int | None = None) -> Index:
        version = version or self.current()
        segments, mapping, name = self.segments(version), self.mapping(version), self.path.rsplit("/", 1)[-1]
        synonyms = self._synonyms(version)
        if not segments:
            empty = self.spark.createDataFrame([], "doc_id string, seq long, source string")
            return replace(Index.from_json(empty, mapping, synonyms=synonyms), name=name)
        return Index(mapping, *(self._live(segments, t) for t in TABLES[:3]), synonyms=synonyms, term_stats=self._dictionary(segments), name=name)

    def source(self, version: int | None = None) -> DataFrame:
        segments = self.segments(version)
        return self._live(segments, "source") if segments else self.spark.createDataFrame([], "doc_id string, seq long, source string")

    def batch(self, changes: DataFrame) -> int:
        """changes: doc_id, source (null deletes), optionally seq. Returns the new version."""
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(time.time_ns()))
        own = changes.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "source")
        last = Window.partitionBy("doc_id").orderBy(F.desc("seq"), F.desc_nulls_last("source"))
        latest = own.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
        base = self.current()
        mapping, segments = self.mapping(base), self.segments(base)
        dead = latest.select("doc_id")
        if segments and mapping.nested_paths():  # children have ids of their own
            roots = self._live(segments, "docs").select("doc_id", "root_id")
            dead = roots.join(dead.withColumnRenamed("doc_id", "root_id"), "root_id", "left_semi").select("doc_id")
        segments = [*segments, self._segment(latest.where("source is not null"), mapping, dead if segments else None)]
        if len(segments) > self.MERGE:
            segments = self._merged(segments, mapping)
        return self._commit(segments, mapping, base)

    def _merged(self, segments: list[dict[str, int]], mapping: IndexMapping) -> list[dict[str, int]]:
        """The newest segments as one: as many as have no more rows than all newer ones, two at least."""
        first, newer = len(segments) - 2, segments[-1]["rows"] + segments[-2]["rows"]
        while first and segments[first - 1]["rows"] <= max(newer, 1):
            first -= 1
            newer += segments[first]["rows"]
        kept, joined = segments[:first], segments[first:]
        dead = self._dead(joined) if kept else None
        return [*kept, self._segment(self._live(joined, "source"), mapping, dead)]

    def delete(self, *ids: str) -> int:
        return self.batch(self.spark.createDataFrame([(i, None) for i in ids], "doc_id string, source string"))

    def update_mapping(self, mapping: IndexMapping | dict) -> int:
        """A new version with another mapping; fields that it drops are gone from then on."""
        mapping = mapping if isinstance(mapping, IndexMapping) else IndexMapping.of(mapping)
        base = self.current()
        return self._commit([self._segment(self.source(base), mapping, None)] if self.segments(base) else [], mapping, base)

    def add_synonyms(self, collection: str, definitions: list[dict[str, list[str]]]) -> int:
        """Definitions of a collection, in a new version."""
        base = self.current()
        return self._commit(self.segments(base), self.mapping(base), base, synonym_table(self.spark, collection, definitions))

    def rollback(self, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self._put(f"{self.path}/CURRENT", str(version))

    def prune(self, keep: int = 2) -> None:
        """Drop all but the newest versions (and the current one), and segments that none of them lists."""
        own, current = self.versions(), self.current()
        gone = [v for v in own[:-keep] if v != current]
        used = {s["n"] for v in own if v not in gone for s in self.segments(v)}
        doomed = [f"{self.path}/v={v}" for v in gone] + [f"{self.path}/segments/s={n}" for n in self._names(f"{self.path}/segments", "s=") if n not in used]
        for at in doomed:
            fs, p = self._fs(at)
            fs.delete(p, True)

    def copy_to(self, path: str) -> Store:
        """A copy of the current version: its files, as they are."""
        other, jvm, version = Store(self.spark, path), self.spark.sparkContext._jvm, self.current()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        names = [f"segments/s={s['n']}" for s in self.segments(version)] + [f"v={version}"]
        for name in names:
            (fs, a), (to, b) = self._fs(f"{self.path}/{name}"), other._fs(f"{other.path}/{name}")
            to.mkdirs(b.getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, conf)
        other._put(f"{other.path}/CURRENT", str(version))
        return other

    def set_internal(self, key: str, value: str | None) -> None:
        own = self.internal()
        if value is None:
            own.pop(key, None)
        else:
            own[key] = value
        self._put(f"{self.path}/internal.json", json.dumps(own))

    def internal(self) -> dict[str, Any]:
        fs, p = self._fs(f"{self.path}/internal.json")
        return json.loads(self._get(f"{self.path}/internal.json")) if fs.exists(p) else {}
