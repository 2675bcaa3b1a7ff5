"""Query trees and their JSON form."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any

COMPOUND = ("conjunction", "disjunction", "boolean")


@dataclass
class Query:
    """A node: its kind, the field it is about, its settings and its children."""

    kind: str
    field: str | None = None
    boost: float | None = None
    args: dict[str, Any] = dataclasses.field(default_factory=dict)
    children: list[Query] = dataclasses.field(default_factory=list)

    def __getitem__(self, name: str) -> Any:
        return self.args.get(name)

    @property
    def weight(self) -> float:
        return 1.0 if self.boost is None else float(self.boost)

    def fields(self) -> set[str]:
        """All fields a tree names; leaves without one use the default field."""
        own = {self.field} if self.field else set()
        return own.union(*[c.fields() for c in self.sections()])

    def sections(self) -> list[Query]:
        return [*self.children, *[c for k in ("must", "should", "must_not", "filter", "query") if isinstance(c := self.args.get(k), Query)]]


def term(text: str, fld: str | None = None, boost: float | None = None) -> Query:
    return Query("term", fld, boost, {"term": text})


def match(text: str, fld: str | None = None, boost: float | None = None, **args: Any) -> Query:
    return Query("match", fld, boost, {"match": text, **args})


def conjunction(*children: Query, boost: float | None = None) -> Query:
    return Query("conjunction", boost=boost, children=list(children))


def disjunction(*children: Query, min: float = 0, boost: float | None = None) -> Query:
    return Query("disjunction", boost=boost, args={"min": min}, children=list(children))


def boolean(must: Query | None = None, should: Query | None = None, must_not: Query | None = None, filter: Query | None = None, boost: float | None = None) -> Query:
    return Query("boolean", boost=boost, args={"must": must, "should": should, "must_not": must_not, "filter": filter})


# leaves by the settings of their JSON form


def _leaf(kind: str, *names: str):
    def make(*values: Any, fld: str | None = None, boost: float | None = None, **more: Any) -> Query:
        given = dict(zip(names, values, strict=False)) | more
        return validate(Query(kind, fld, boost, {k: v for k, v in given.items() if v is not None}))

    make.__name__ = kind
    make.__doc__ = f"A {kind} query: {', '.join(names) or 'no settings'}, fld, boost and further settings by name."
    return make


match_all, match_none = _leaf("match_all"), _leaf("match_none")
match_phrase, phrase, multi_phrase = _leaf("match_phrase", "match_phrase"), _leaf("phrase", "terms"), _leaf("multi_phrase", "terms")
prefix, regexp, wildcard, fuzzy = _leaf("prefix", "prefix"), _leaf("regexp", "regexp"), _leaf("wildcard", "wildcard"), _leaf("fuzzy", "term", "fuzziness", "prefix_length")
term_range, numeric_range = (_leaf(k, "min", "max", "inclusive_min", "inclusive_max") for k in ("term_range", "numeric_range"))
date_range = _leaf("date_range", "start", "end", "inclusive_start", "inclusive_end", "datetime_parser")
bool_field, ip_range, doc_ids, query_string = _leaf("bool_field", "bool"), _leaf("ip_range", "cidr"), _leaf("doc_id", "ids"), _leaf("query_string", "query")
geo_box, geo_distance, geo_polygon, geo_shape = _leaf("geo_box", "top_left", "bottom_right"), _leaf("geo_distance", "location", "distance"), _leaf("geo_polygon", "polygon_points"), _leaf("geo_shape", "geometry")
custom_filter, custom_score = (_leaf(k, "query", "fields", "name", "params", "callback") for k in ("custom_filter", "custom_score"))


class QueryError(ValueError):
    pass


def _number(d: dict, *keys: str) -> bool:
    given = [d[k] for k in keys if d.get(k) is not None]
    return bool(given) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in given)


def parse(source: str | dict | None) -> Query:
    """A query of its JSON form; the first key that is known decides the kind."""
    d = json.loads(source) if isinstance(source, (str, bytes)) and source else source or {}
    if not isinstance(d, dict):
        raise QueryError("a query is a JSON object")
    if not d:
        return Query("match_none")
    fld, boost = d.get("field"), d.get("boost")
    args = {k: v for k, v in d.items() if k not in ("field", "boost")}

    def own(kind: str) -> Query:
        return validate(Query(kind, fld, boost, args))

    if "fuzziness" in d and not {"match", "match_phrase", "terms"} & d.keys():
        if "term" not in d:
            raise QueryError("a fuzzy query needs a term")
        return own("fuzzy")
    if "match" in d:
        return own("match")
    if "match_phrase" in d:
        return own("match_phrase")
    if "terms" in d:
        return own("multi_phrase" if any(isinstance(t, list) for t in d["terms"]) else "phrase")
    if "term" in d:
        return own("term")
    if {"must", "should", "must_not", "filter"} & d.keys():
        sections = {k: parse(d[k]) for k in ("must", "should", "must_not", "filter") if d.get(k) is not None}
        if "must" in sections and sections["must"].kind != "conjunction":
            raise QueryError("must has to be a conjunction")
        for k in ("should", "must_not"):
            if k in sections and sections[k].kind != "disjunction":
                raise QueryError(f"{k} has to be a disjunction")
        return validate(Query("boolean", boost=boost, args=sections))
    if "conjuncts" in d:
        return validate(Query("conjunction", boost=boost, children=[parse(c) for c in d["conjuncts"]]))
    if "disjuncts" in d:
        return validate(Query("disjunction", boost=boost, args={"min": d.get("min", 0)}, children=[parse(c) for c in d["disjuncts"]]))
    if "query" in d and isinstance(d["query"], str):
        return own("query_string")
    if _number(d, "min", "max"):
        return own("numeric_range")
    if isinstance(d.get("min"), str) or isinstance(d.get("max"), str):
        return own("term_range")
    if "start" in d or "end" in d:
        return own("date_range")
    for key, kind in (("prefix", "prefix"), ("regexp", "regexp"), ("wildcard", "wildcard"), ("match_all", "match_all"), ("match_none", "match_none")):
        if key in d:
            return own(kind)
    for key in ("custom_filter", "custom_score"):
        if key in d:
            inner = dict(d[key])
            return validate(Query(key, boost=boost, args={k: v for k, v in inner.items() if k != "query"} | {"query": parse(inner.get("query"))}))
    for key, kind in (("ids", "doc_id"), ("bool", "bool_field"), ("top_left", "geo_box"), ("distance", "geo_distance"), ("polygon_points", "geo_polygon"), ("geometry", "geo_shape"), ("cidr", "ip_range")):
        if key in d:
            return own(kind)
    raise QueryError(f"unknown query: {sorted(d)}")


def validate(q: Query) -> Query:
    """Checks of a single node that don't need an index."""
    if q.kind in ("numeric_range", "term_range") and q["min"] is None and q["max"] is None:
        raise QueryError("a range needs a bound")
    if q.kind == "date_range" and q["start"] is None and q["end"] is None:
        raise QueryError("a date range needs a start or an end")
    if q.kind in ("phrase", "multi_phrase") and not q["terms"]:
        raise QueryError("a phrase needs terms")
    if q.kind == "boolean":
        if not any(q[k] for k in ("must", "should", "must_not", "filter")):
            raise QueryError("a boolean query needs a section")
    if q.kind == "disjunction" and float(q["min"] or 0) > len(q.children):
        raise QueryError("a disjunction can't need more clauses than it has")
    if q.kind == "match" and q["operator"] not in (None, "or", "and", 0, 1):
        raise QueryError("a match operator is or, or and")
    fuzz = q["fuzziness"]
    if fuzz is not None and fuzz != "auto" and not 0 <= int(fuzz) <= 2:
        raise QueryError("fuzziness is 0, 1, 2 or auto")
    if q.kind == "geo_polygon" and len(q["polygon_points"]) < 3:
        raise QueryError("a polygon needs three points")
    if q.kind == "geo_shape" and q["geometry"].get("relation") not in ("intersects", "contains", "within"):
        raise QueryError("a shape relation is intersects, contains or within")
    return q


def dump(q: Query) -> str:
    def plain(x: Any) -> Any:
        if isinstance(x, Query):
            return {k: v for k, v in {"kind": x.kind, "field": x.field, "boost": x.boost, **{a: plain(b) for a, b in x.args.items()}, "children": [plain(c) for c in x.children]}.items() if v not in (None, [], {})}
        return x

    return json.dumps(plain(q), default=str, sort_keys=True)
