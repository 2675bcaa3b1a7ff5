"""Search requests: hits, order and page, facets, stored fields, highlights, vectors and fusion."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.operators import facets as facet_ops
from searchlake.operators import highlight, sorting, vectors
from searchlake.plans.compiler import Compiler, small_frame
from searchlake.plans.query import Query, parse
from searchlake.sources.index import ALL, Index


@dataclass
class SearchRequest:
    query: Query
    size: int = 10
    start: int = 0
    sort: list | None = None
    facets: dict[str, dict] = field(default_factory=dict)
    fields: list[str] = field(default_factory=list)
    highlight: dict | None = None
    locations: bool = False
    explain: bool = False
    score: str = ""
    search_after: list | None = None
    search_before: list | None = None
    knn: list[dict] = field(default_factory=list)
    knn_operator: str = "or"
    params: dict = field(default_factory=dict)

    @staticmethod
    def of(source: str | dict) -> SearchRequest:
        d = json.loads(source) if isinstance(source, str) else source
        own = SearchRequest(
            parse(d.get("query")), int(d.get("size", 10)), int(d.get("from", 0)), d.get("sort"), d.get("facets") or {}, list(d.get("fields") or []),
            d.get("highlight"), bool(d.get("includeLocations", False)), bool(d.get("explain", False)), d.get("score", ""),
            d.get("search_after"), d.get("search_before"), list(d.get("knn") or []), d.get("knn_operator", "or"), dict(d.get("params") or {}),
        )
        own.validate()
        return own

    def validate(self) -> None:
        if self.size < 0 or self.start < 0:
            raise ValueError("size and from can't be negative")
        facet_ops.validate(self.facets)
        order = sorting.parse_order(self.sort)
        for name in ("search_after", "search_before"):
            keys = getattr(self, name)
            if keys is not None and (len(keys) != len(order) or self.start):
                raise ValueError(f"{name} needs a value for each sort key and no offset")
        if self.search_after is not None and self.search_before is not None:
            raise ValueError("only one of search_after and search_before")
        if self.score in ("rrf", "rsf") and (self.search_after or self.search_before or self.sort not in (None, ["-_score"])):
            raise ValueError("fusion orders by score and has no keyset paging")


@dataclass
class SearchResult:
    total: int
    max_score: float
    hits: list[dict[str, Any]]
    facets: dict[str, dict]


class Searcher:
    """Runs requests on an index."""

    def __init__(self, index: Index, *, callbacks: dict[str, Callable] | None = None, mean_length: bool = False):
        self.index, self.callbacks, self.mean_length = index, callbacks, mean_length

    def hits(self, request: SearchRequest) -> DataFrame:
        """(doc_id, score) of all matches, lazily: text, vectors, or both."""
        score = request.score != "none"
        text = Compiler(self.index, score=score, mean_length=self.mean_length, callbacks=self.callbacks).hits(request.query)
        if not request.knn:
            return text
        eligible = [Compiler(self.index, score=False, callbacks=self.callbacks).hits(parse(c["filter"])) if c.get("filter") else None for c in request.knn]
        near = vectors.knn(self.index, request.knn, eligible=eligible, operator=request.knn_operator)
        own = None if request.query.kind == "match_none" else text
        window = int(request.params.get("score_window_size") or max(1, request.start + request.size))
        if request.score == "rrf":
            return vectors.reciprocal_rank_fusion(own, near, request.knn, window=window, constant=int(request.params.get("score_rank_constant") or 60), boost=request.query.weight)
        if request.score == "rsf":
            return vectors.relative_score_fusion(own, near, request.knn, window=window, boost=request.query.weight)
        return vectors.additive(own, near)

    def page(self, request: SearchRequest, hits: DataFrame | None = None) -> DataFrame:
        """The rows of the page, in order: doc_id, score, sort keys."""
        hits = self.hits(request) if hits is None else hits
        order = sorting.parse_order(request.sort)
        return sorting.page(sorting.with_keys(self.index, hits, order), order, request.size, request.start, request.search_after, request.search_before)

    def search(self, request: SearchRequest | str | dict) -> SearchResult:
        if not isinstance(request, SearchRequest):
            request = SearchRequest.of(request)
        hits = self.hits(request).persist() if request.facets else self.hits(request)
        total, top = hits.agg(F.count("*"), F.max("score")).first()
        rows = self.page(request, hits).collect() if request.size else []
        keys = [c for c in rows[0].asDict() if c.startswith("k")] if rows else []
        found = [{"id": r["doc_id"], "score": r["score"], "sort": [sorting.shown(r[k]) for k in keys]} for r in rows]
        if request.fields or request.highlight is not None or request.locations:
            self._load(request, found)
        own = {name: facet_ops.facet(self.index, hits, spec) for name, spec in request.facets.items()}
        if request.facets:
            hits.unpersist()
        return SearchResult(total, top or 0.0, found, own)

    # --- what only the page needs ---

    def _load(self, request: SearchRequest, found: list[dict]) -> None:
        ids = [h["id"] for h in found]
        rows = self.index.values.where(F.col("doc_id").isin(ids) & F.col("stored")).select("doc_id", "field", "ap", "kind", "s", "d", "ts_ns", "b", "lon", "lat", "analyzer").collect()
        by: dict[str, dict[str, list]] = {}
        for r in sorted(rows, key=lambda r: r["ap"]):
            by.setdefault(r["doc_id"], {}).setdefault(r["field"], []).append(r)
        marked = request.highlight is not None or request.locations
        terms = self.query_terms(request.query, self._page_terms(rows)) if marked else {}
        for h in found:
            own = by.get(h["id"], {})
            if request.fields:
                picked = own if "*" in request.fields else {f: own[f] for f in request.fields if f in own}
                h["fields"] = {f: _plain(rs[0]) if len(rs) == 1 else [_plain(r) for r in rs] for f, rs in picked.items()}
            if marked:
                self._mark(request, h, own, terms)

    def _mark(self, request: SearchRequest, h: dict, own: dict[str, list], terms: dict[str, set[str]]) -> None:
        asked = (request.highlight or {}).get("fields")
        style = (request.highlight or {}).get("style") or "html"
        h["fragments"], h["locations"] = {}, {}
        registry = self.index.mapping.registry()
        for f, rows in own.items():
            wanted = terms.get(f, set()) | terms.get(ALL, set())
            texts = [(r["s"], registry.analyzer(r["analyzer"])) for r in rows if r["kind"] == "text"]
            if not texts:
                continue
            matched = False
            for r in rows:
                for t in registry.analyzer(r["analyzer"]).tokens(r["s"]) if r["kind"] == "text" else ():
                    if t.term in wanted:
                        matched = True
                        h["locations"].setdefault(f, {}).setdefault(t.term, []).append({"pos": t.pos, "start": t.start, "end": t.end, "array_positions": list(r["ap"]) or None})
            if request.highlight is not None and (f in asked if asked else matched):
                h["fragments"][f] = highlight.best(texts, wanted, style=style)

    def _page_terms(self, rows: list) -> dict[str, set[str]]:
        """The terms of the page's stored texts, by field."""
        registry = self.index.mapping.registry()
        out: dict[str, set[str]] = {ALL: set()}
        for r in rows:
            if r["kind"] == "text":
                own = {t.term for t in registry.analyzer(r["analyzer"]).tokens(r["s"])}
                out.setdefault(r["field"], set()).update(own)
                out[ALL] |= own
        return out

    def query_terms(self, q: Query, within: dict[str, set[str]] | None = None) -> dict[str, set[str]]:
        """The index terms a query looks for, by field; expansions are read from the dictionary, only terms in within if it is given."""
        compiler = Compiler(self.index, score=False, callbacks=self.callbacks)
        compiler.bind(q)
        out: dict[str, set[str]] = {}
        for x in compiler.leaves:
            own = {t for t, _ in x.terms} | {t for _, alts in x.slots for t, _ in alts}
            if x.kind == "expanded":
                found = x.frame.select("term")
                if within is not None:
                    asked = small_frame(self.index.spark, [(t,) for t in sorted(within.get(x.fld, ()))], "term string")
                    found = found.join(asked, "term", "left_semi")
                own |= {r["term"] for r in found.collect()}
            if own:
                out.setdefault(x.fld, set()).update(own)
        return out

    def explain(self, q: Query, doc_id: str) -> dict[str, Any]:
        """How a document's score comes about, leaf by leaf."""
        compiler = Compiler(self.index, mean_length=self.mean_length, callbacks=self.callbacks)
        root = compiler.bind(q)
        compiler._gather()
        lone = root.kind in ("constant", "rows") or (root.kind == "terms" and q.kind == "term" and len(root.terms) == 1)
        norm = compiler.norm(root, lone)
        rows = {r["leaf"]: r for r in compiler._rows(norm).where(F.col("doc_id") == doc_id).groupBy("leaf").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
        score = compiler._grouped(compiler._rows(norm).where(F.col("doc_id") == doc_id), root).first()

        asked = {(x.fld, t) for x in compiler.leaves for t, _ in x.terms}
        wanted = [(f, t) for f, t in sorted(asked)]
        found = self.index.postings.where((F.col("doc_id") == doc_id) & F.col("field").isin(sorted({f for f, _ in wanted})) & F.col("term").isin(sorted({t for _, t in wanted}))) if wanted else None
        postings = {(r["field"], r["term"]): r for r in found.select("field", "term", "freq", "len").collect()} if found is not None else {}

        def term_tree(x, term: str, boost: float) -> dict:
            """The parts of a term's score: its weight in the query, and its weight in the field."""
            df, row = compiler.df.get((x.fld, term), 0), postings.get((x.fld, term))
            idf = compiler._idf_value(df)
            parts = [{"message": f"idf(df={df}, docs={self.index.count})", "value": idf}]
            if norm is not None:
                parts = [{"message": f"query weight({term})", "value": boost * idf * norm, "children": [{"message": "boost", "value": boost}, *parts, {"message": "query norm", "value": norm}]}]
            if row is not None:
                tf, length = math.sqrt(row["freq"]), row["len"]
                weighed = {"message": f"tf(freq={row['freq']})", "value": tf}, {"message": f"norm(length={length})", "value": 1 / math.sqrt(length)}, {"message": "idf", "value": idf}
                parts.append({"message": f"field weight({x.fld}:{term})", "value": tf * idf / math.sqrt(length) if compiler.scoring != "bm25" else None, "children": list(weighed)})
            return {"term": term, "boost": boost, "df": df, "idf": idf, "matched": row is not None, "children": parts}

        def tree(x) -> dict:
            own = {"message": x.kind + (f" in {x.fld}" if x.fld else ""), "children": [tree(c) for c in [*x.children, *x.sections.values()]]}
            if x.leaf >= 0:
                own["value"] = rows[x.leaf]["s"] if x.leaf in rows else 0.0
                own["terms"] = [term_tree(x, t, b) for t, b in x.terms]
            return own

        return {"value": score["score"] if score else 0.0, "query_norm": norm, "tree": tree(root)}


def _plain(r) -> Any:
    if r["kind"] == "number":
        return r["d"]
    if r["kind"] == "boolean":
        return r["b"]
    if r["kind"] == "geopoint":
        return [r["lon"], r["lat"]]
    return r["s"]


def search(index: Index, request: str | dict, **options: Any) -> SearchResult:
    return Searcher(index, **options).search(request)
