"""Facets: term counts and numeric or date ranges over all hits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.functions import dates
from searchlake.sources.index import Index


def validate(facets: dict[str, dict]) -> None:
    for name, f in facets.items():
        kinds = [k for k in ("numeric_ranges", "date_ranges") if f.get(k)]
        if len(kinds) > 1:
            raise ValueError(f"facet {name} can't have numeric and date ranges")
        for kind, (low, high) in (("numeric_ranges", ("min", "max")), ("date_ranges", ("start", "end"))):
            own = f.get(kind) or []
            if len({r["name"] for r in own}) < len(own):
                raise ValueError(f"facet {name} has ranges of one name")
            if any(r.get(low) is None and r.get(high) is None for r in own):
                raise ValueError(f"facet {name} has a range without bounds")


def terms(index: Index, hits: DataFrame, field: str, *, prefix: str = "", pattern: str = "") -> DataFrame:
    """(term, n) for every accepted term; counted once per document and term."""
    own = index.postings.where(F.col("field") == field).select("doc_id", "term").join(hits.select("doc_id"), "doc_id", "left_semi")
    return own.where(_accepted(prefix, pattern)).groupBy("term").agg(F.count("*").alias("n"))


def _accepted(prefix: str, pattern: str):
    ok = F.lit(True)
    if prefix:
        ok = ok & F.col("term").startswith(prefix)
    if pattern:
        ok = ok & F.col("term").rlike(pattern)
    return ok


def term_facet(index: Index, hits: DataFrame, field: str, size: int = 10, *, prefix: str = "", pattern: str = "") -> dict[str, Any]:
    """total counts rejected terms too; missing: hits without an accepted term; other: what isn't shown."""
    own = index.postings.where(F.col("field") == field).select("doc_id", "term").join(hits.select("doc_id"), "doc_id", "left_semi").withColumn("ok", _accepted(prefix, pattern))
    total, having, count = (own.agg(F.count("*"), F.count_distinct(F.when(F.col("ok"), F.col("doc_id")))).first()[:] + (hits.count(),))
    shown = own.where("ok").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size).collect()
    return {"field": field, "total": total, "missing": count - having, "other": total - sum(r["n"] for r in shown), "terms": [{"term": r["term"], "count": r["n"]} for r in shown]}


def range_counts(index: Index, hits: DataFrame, field: str, ranges: list[dict], *, kind: str = "number", parser: dates.Parser | None = None) -> DataFrame:
    """(name, n) of the ranges that hold something: one pass, one conditional count per range."""
    column, (low, high) = ("d", ("min", "max")) if kind == "number" else ("ts_ns", ("start", "end"))
    own = index.values.where((F.col("field") == field) & (F.col("kind") == kind)).select("doc_id", F.col(column).alias("x")).join(hits.select("doc_id"), "doc_id", "left_semi")
    per = []
    for i, r in enumerate(ranges):
        inside = F.col("x").isNotNull()
        for edge, test in ((low, lambda v: F.col("x") >= v), (high, lambda v: F.col("x") < v)):
            if r.get(edge) is not None:
                value = float(r[edge]) if kind == "number" else (parser or dates.optional)(r[edge])
                inside = inside & test(F.lit(value))
        per.append(F.sum(inside.cast("long")).alias(f"r{i}"))
    names = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("n")) for i, r in enumerate(ranges)])
    return own.agg(*per).select(F.explode(names).alias("r")).select("r.name", "r.n").where("n > 0")


def range_facet(index: Index, hits: DataFrame, field: str, ranges: list[dict], size: int = 10, *, kind: str = "number", parser: dates.Parser | None = None) -> dict[str, Any]:
    counts = {r["name"]: r["n"] for r in range_counts(index, hits, field, ranges, kind=kind, parser=parser).collect()}
    having = index.values.where((F.col("field") == field) & (F.col("kind") == kind)).select("doc_id").join(hits.select("doc_id"), "doc_id", "left_semi").distinct().count()
    order = sorted((r for r in ranges if r["name"] in counts), key=lambda r: (-counts[r["name"]], r["name"]))
    total = sum(counts.values())
    shown = [dict(r) | {"count": counts[r["name"]]} for r in order[:size]]
    return {"field": field, "total": total, "missing": hits.count() - having, "other": total - sum(r["count"] for r in shown), ("numeric_ranges" if kind == "number" else "date_ranges"): shown}


def facet(index: Index, hits: DataFrame, spec: dict) -> dict[str, Any]:
    field, size = spec["field"], int(spec.get("size", 10))
    if spec.get("numeric_ranges"):
        return range_facet(index, hits, field, spec["numeric_ranges"], size)
    if spec.get("date_ranges"):
        parser = index.mapping.date_parser(next((r["datetime_parser"] for r in spec["date_ranges"] if r.get("datetime_parser")), None))
        return range_facet(index, hits, field, spec["date_ranges"], size, kind="datetime", parser=parser)
    return term_facet(index, hits, field, size, prefix=spec.get("term_prefix", ""), pattern=spec.get("term_pattern", ""))
