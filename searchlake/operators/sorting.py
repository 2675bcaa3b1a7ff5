"""Sort orders, pages and keyset paging over hits."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.functions import geo
from searchlake.sources.index import Index


@dataclass
class SortKey:
    """by: score, id, field or geo_distance. type: auto, string, number or date. mode: default (the first value), min or max."""

    by: str
    desc: bool = False
    field: str | None = None
    type: str = "auto"
    mode: str = "default"
    missing: str = "last"
    location: Any = None
    unit: str = "m"

    @staticmethod
    def of(spec: str | dict) -> SortKey:
        if isinstance(spec, str):
            desc, name = spec.startswith("-"), spec.lstrip("+-")
            return SortKey({"_id": "id", "_score": "score"}.get(name, "field"), desc, name)
        by = spec.get("by")
        if by not in ("id", "score", "field", "geo_distance"):
            raise ValueError(f"unknown sort {by}")
        own = SortKey(by, bool(spec.get("desc", False)), spec.get("field"), spec.get("type", "auto"), spec.get("mode", "default"), spec.get("missing", "last"), spec.get("location"), spec.get("unit", "m") or "m")
        if own.by in ("field", "geo_distance") and not own.field:
            raise ValueError("a sort by field needs the field's name")
        if own.type not in ("auto", "string", "number", "date") or own.mode not in ("default", "min", "max") or own.missing not in ("first", "last"):
            raise ValueError(f"unknown sort settings: {spec}")
        return own


def parse_order(specs: list | None) -> list[SortKey]:
    """The default order is by falling score."""
    return [SortKey.of(s) for s in specs or ["-_score"]]


def with_keys(index: Index, hits: DataFrame, order: list[SortKey]) -> DataFrame:
    """hits (doc_id, score) with one column k0, k1 ... per sort key and seq, the order of ingest.

    Only fields that a key names are read, in one grouping for all of them.
    """
    fields = sorted({k.field for k in order if k.by in ("field", "geo_distance")})
    if fields:
        rows = index.values.where(F.col("field").isin(fields) & F.col("doc_values")).join(hits.select("doc_id"), "doc_id", "left_semi")
        item = F.struct("ap", "s", "d", "ts_ns", "b", "lon", "lat", "kind")
        per = [F.sort_array(F.collect_list(F.when(F.col("field") == f, item))).alias(f"v{i}") for i, f in enumerate(fields)]
        hits = hits.join(rows.groupBy("doc_id").agg(*per), "doc_id", "left")
    hits = hits.join(index.docs.select("doc_id", "seq"), "doc_id")
    for at, k in enumerate(order):
        if k.by == "score":
            c: Column = F.col("score")
        elif k.by == "id":
            c = F.col("doc_id")
        else:
            v = F.col(f"v{fields.index(k.field)}")
            c = _distance(v, k) if k.by == "geo_distance" else _value(v, k)
        hits = hits.withColumn(f"k{at}", c)
    return hits.select("doc_id", "score", "seq", *[f"k{i}" for i in range(len(order))])


def _value(v: Column, k: SortKey) -> Column:
    """A struct of (number, text) so that one order holds for any kind of value."""
    number = lambda x: F.coalesce(x["d"], x["ts_ns"].cast("double"))
    text = lambda x: F.when(x["kind"].isin("text", "IP"), x["s"]).otherwise(F.when(x["b"].isNotNull(), F.when(x["b"], F.lit("T")).otherwise(F.lit("F"))))
    if k.type == "string":
        fits = F.filter(v, lambda x: text(x).isNotNull())
    elif k.type == "number":
        fits = F.filter(v, lambda x: x["d"].isNotNull())
    elif k.type == "date":
        fits = F.filter(v, lambda x: x["ts_ns"].isNotNull())
    else:
        fits = F.filter(v, lambda x: number(x).isNotNull() | text(x).isNotNull())
    pairs = F.transform(fits, lambda x: F.struct(number(x).alias("d"), text(x).alias("s")))
    return F.array_min(pairs) if k.mode == "min" else F.array_max(pairs) if k.mode == "max" else F.get(pairs, 0)


def _distance(v: Column, k: SortKey) -> Column:
    point = geo.parse_point(k.location)
    if point is None:
        raise ValueError("a sort by distance needs a location")
    first = F.get(F.filter(v, lambda x: x["lon"].isNotNull()), 0)
    km = geo.haversine_km(first["lon"], first["lat"], F.lit(point[0]), F.lit(point[1]))
    return km * 1000 / geo.UNITS[k.unit]


def ordering(order: list[SortKey], reverse: bool = False) -> list[Column]:
    """Columns to order by; documents without a value stay last (or first) in either direction."""
    out = []
    for at, k in enumerate(order):
        c, desc, last = F.col(f"k{at}"), k.desc != reverse, (k.missing == "last") != reverse
        out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if desc else (c.asc_nulls_last() if last else c.asc_nulls_first()))
    return [*out, *((F.desc("seq"), F.desc("doc_id")) if reverse else (F.asc("seq"), F.asc("doc_id")))]


def after(hits: DataFrame, order: list[SortKey], keys: list[Any], reverse: bool = False) -> DataFrame:
    """Hits strictly after (before, if reversed) the given keys: one literal per sort key."""
    if len(keys) != len(order):
        raise ValueError("search_after needs a value for each sort key")
    tests, equal = [], F.lit(True)
    for at, (k, raw) in enumerate(zip(order, keys, strict=True)):
        c = F.col(f"k{at}")
        if k.by == "field":
            number = isinstance(raw, (int, float)) or k.type == "number"
            value: Column = F.struct((F.lit(float(raw)) if number else F.lit(None).cast("double")).alias("d"), (F.lit(None).cast("string") if number else F.lit(str(raw))).alias("s"))
        else:
            value = F.lit(float(raw)) if k.by in ("score", "geo_distance") else F.lit(str(raw))
        if raw is None:
            # beyond the missing ones lie the values, unless missing ones are last
            further, same = c.isNotNull() & F.lit((k.missing == "last") == reverse), c.isNull()
        else:
            further = (c < value if k.desc != reverse else c > value) | (c.isNull() & F.lit((k.missing == "last") != reverse))
            same = c == value
        tests.append(equal & F.coalesce(further, F.lit(False)))
        equal = equal & F.coalesce(same, F.lit(False))
    return hits.where(reduce(Column.__or__, tests))


def page(hits: DataFrame, order: list[SortKey], size: int = 10, start: int = 0, search_after: list | None = None, search_before: list | None = None) -> DataFrame:
    """One page, in order. Ties keep the order of ingest."""
    if search_after is not None and search_before is not None:
        raise ValueError("only one of search_after and search_before")
    if (search_after is not None or search_before is not None) and start:
        raise ValueError("keyset paging has no offset")
    if search_before is not None:
        own = after(hits, order, search_before, reverse=True).orderBy(*ordering(order, True)).limit(size)
        return own.orderBy(*ordering(order))
    if search_after is not None:
        hits = after(hits, order, search_after)
    own = hits.orderBy(*ordering(order))
    return (own.offset(start) if start else own).limit(size)


def shown(value: Any) -> str | None:
    """A sort key for people."""
    if value is None:
        return None
    own = value.asDict() if hasattr(value, "asDict") else value
    if isinstance(own, dict):
        return own["s"] if own["s"] is not None else json.dumps(own["d"])
    return str(own)
