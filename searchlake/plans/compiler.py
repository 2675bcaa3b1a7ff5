"""From query trees to DataFrame plans.

Every leaf becomes rows (doc_id, leaf, s, n): a score and a count of matched terms. The
rows of all leaves are united, grouped by document once, and the tree of the query is
evaluated as one expression over each group: sections that are required, optional or
forbidden are boolean columns, scores are sums. So a query of any shape costs one shuffle
by document, besides what phrases need for their positions. Term leaves share one scan of
the postings, joined with the small table of query terms; the terms are pushed down to it.

Scores follow the vector-space model (tf-idf) or BM25. Document frequencies of the query's
terms are read first, in one small job, and become literals: weights, the query norm of
the outermost compound and coordination factors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions import geo, numeric
from searchlake.plans.query import Query, QueryError
from searchlake.plans.query_string import parse_query_string
from searchlake.sources.index import Index

K1, B = 1.2, 0.75
#: Expanded dictionaries up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Alternatives of a fuzzy phrase slot that are read by the driver.
MAX_SLOT_TERMS = 10_000
_LEAF = "doc_id string, leaf int, s double, n int"


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows made in the JVM; long lists go the usual way."""
    if not rows or len(rows) > 500:
        return spark.createDataFrame(rows, schema)
    columns = [c.split() for c in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


@dataclass
class Node:
    """A bound query: kind is terms, expanded, constant, phrase, rows, all_of, any_of, sections or none."""

    kind: str
    children: list[Node] = field(default_factory=list)
    fld: str = ""
    terms: list[tuple[str, float]] = field(default_factory=list)  # (term, boost)
    need: int = 1  # terms, or children, that have to match
    coord: bool = True
    boost: float = 1.0
    slots: list[tuple[int, list[tuple[str, float]]]] = field(default_factory=list)
    frame: DataFrame | None = None  # (doc_id) for constants, (doc_id, s) for rows, (term, b) for expansions
    sections: dict[str, Node] = field(default_factory=dict)
    leaf: int = -1
    total: int = 1
    squares: float = 0.0
    size: int = 0
    depth: int | None = None  # level of the ancestor at which a nested conjunction meets
    missing: bool = False  # a leaf over documents without positions in the index


class Compiler:
    def __init__(self, index: Index, *, scoring: str | None = None, score: bool = True, mean_length: bool = False, callbacks: dict[str, Callable] | None = None):
        self.index, self.score = index, score
        self.scoring = scoring or index.mapping.scoring_model
        self.mean_length = mean_length
        self.callbacks = callbacks or {}
        self.leaves: list[Node] = []
        self.df: dict[tuple[str, str], int] = {}
        self.lengths: dict[str, float] = {}
        self._synonyms: dict[tuple[str, str], list[str]] | None = None

    # --- binding ---

    def bind(self, q: Query, lenient: bool = False) -> Node:
        """lenient: inside a query string, clauses that can't match anything are left out."""
        return getattr(self, f"_bind_{q.kind}")(q, lenient)

    def _field(self, q: Query) -> str:
        return q.field or self.index.mapping.default_field

    def _leaf(self, node: Node) -> Node:
        node.leaf = len(self.leaves)
        self.leaves.append(node)
        return node

    def _none(self) -> Node:
        return Node("none")

    def _bind_match_none(self, q: Query, lenient: bool) -> Node:
        return self._none()

    def _bind_match_all(self, q: Query, lenient: bool) -> Node:
        return self._leaf(Node("constant", boost=q.weight, frame=self.index.docs.select("doc_id")))

    def _bind_doc_id(self, q: Query, lenient: bool) -> Node:
        ids = [str(i) for i in q["ids"]]
        return self._leaf(Node("constant", boost=q.weight, frame=self.index.docs.where(F.col("doc_id").isin(ids)).select("doc_id")))

    def synonyms_of(self, fld: str, term: str) -> list[str]:
        collection = self.index.mapping.synonym_collection(fld)
        if self.index.synonyms is None or collection is None:
            return []
        found = self.index.synonyms.where((F.col("collection") == collection) & (F.col("lhs") == term)).select("rhs").distinct().orderBy("rhs").collect()
        return [r[0] for r in found]

    def _bind_term(self, q: Query, lenient: bool) -> Node:
        fld, t = self._field(q), q["term"]
        others = self.synonyms_of(fld, t)
        return self._leaf(Node("terms", fld=fld, terms=[(t, q.weight), *[(o, q.weight / 2) for o in others]]))

    def _single(self, fld: str, t: str, boost: float, fuzziness: Any, prefix: int) -> Node:
        if fuzziness not in (None, 0):
            return self._bind_fuzzy(Query("fuzzy", fld, boost, {"term": t, "fuzziness": fuzziness, "prefix_length": prefix}), False)
        return self._bind_term(Query("term", fld, boost, {"term": t}), False)

    def _bind_match(self, q: Query, lenient: bool) -> Node:
        fld = self._field(q)
        tokens = [t.term for t in self.index.analyzer(fld, q["analyzer"]).tokens(q["match"])]
        if not tokens:
            return self._none()
        both = q["operator"] in ("and", 1)
        if q["fuzziness"] in (None, 0) and self.index.synonyms is None:
            return self._leaf(Node("terms", fld=fld, terms=[(t, q.weight) for t in tokens], need=len(tokens) if both else 1, coord=not both))
        parts = [self._single(fld, t, q.weight, q["fuzziness"], int(q["prefix_length"] or 0)) for t in tokens]
        return Node("all_of", parts) if both else Node("any_of", parts, need=1)

    def _bind_match_phrase(self, q: Query, lenient: bool) -> Node:
        fld = self._field(q)
        tokens = self.index.analyzer(fld, q["analyzer"]).tokens(q["match_phrase"])
        if not tokens:
            return self._none()
        first = tokens[0].pos
        slots: dict[int, list[str]] = {}
        for t in tokens:
            slots.setdefault(t.pos - first, []).append(t.term)
        return self._phrase(fld, slots, q.weight, q["fuzziness"])

    def _bind_phrase(self, q: Query, lenient: bool) -> Node:
        return self._phrase(q.field or "", {i: [t] for i, t in enumerate(q["terms"]) if t}, q.weight, q["fuzziness"])

    def _bind_multi_phrase(self, q: Query, lenient: bool) -> Node:
        slots = {i: [x for x in (t if isinstance(t, list) else [t]) if x] for i, t in enumerate(q["terms"])}
        return self._phrase(q.field or "", {i: s for i, s in slots.items() if s}, q.weight, q["fuzziness"])

    def _phrase(self, fld: str, slots: dict[int, list[str]], boost: float, fuzziness: Any) -> Node:
        if not slots:
            return self._none()
        own = []
        for at, terms in sorted(slots.items()):
            wanted = [(t, boost) for t in terms]
            for t in terms:
                wanted += [(o, boost / 2) for o in self.synonyms_of(fld, t)]
                if fuzziness not in (None, 0):
                    near = self._near(fld, t, fuzziness, 0).where(F.col("term") != t).limit(MAX_SLOT_TERMS + 1).collect()
                    if len(near) > MAX_SLOT_TERMS:
                        raise QueryError(f"too many terms near {t}")
                    wanted += [(r["term"], boost * r["b"]) for r in near]
            own.append((at, wanted))
        return self._leaf(Node("phrase", fld=fld, slots=own, boost=boost))

    def _terms(self, fld: str) -> DataFrame:
        return self.index.dictionary.where(F.col("field") == fld)

    def _expanded(self, fld: str, terms: DataFrame, boost: float) -> Node:
        return self._leaf(Node("expanded", fld=fld, frame=terms, boost=boost))

    def _bind_prefix(self, q: Query, lenient: bool) -> Node:
        fld = self._field(q)
        return self._expanded(fld, self._terms(fld).where(F.col("term").startswith(q["prefix"])).withColumn("b", F.lit(1.0)), q.weight)

    def _bind_regexp(self, q: Query, lenient: bool) -> Node:
        fld, pattern = self._field(q), q["regexp"].removeprefix("^")
        if re.search(r"\\[1-9]|\(\?[=!<]", pattern):
            raise QueryError("regular expressions can't look around or refer back")
        re.compile(pattern)
        literal = re.match(r"[A-Za-z0-9_]*(?![*?{+A-Za-z0-9_])", pattern)
        terms = self._terms(fld)
        if literal and literal[0] and "|" not in pattern:
            terms = terms.where(F.col("term").startswith(literal[0]))
        return self._expanded(fld, terms.where(F.col("term").rlike(f"^(?:{pattern})$")).withColumn("b", F.lit(1.0)), q.weight)

    def _bind_wildcard(self, q: Query, lenient: bool) -> Node:
        text, fld = q["wildcard"], self._field(q)
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text)
        start = re.split(r"[*?]", text, maxsplit=1)[0]
        terms = self._terms(fld)
        if start:
            terms = terms.where(F.col("term").startswith(start))
        return self._expanded(fld, terms.where(F.col("term").rlike(f"(?s)^{pattern}$")).withColumn("b", F.lit(1.0)), q.weight)

    def _near(self, fld: str, t: str, fuzziness: Any, prefix: int) -> DataFrame:
        """Terms within so many edits, with one over (edits + 1)."""
        size = len(t.encode())
        most = (2 if size > 5 else 1 if size > 2 else 0) if fuzziness == "auto" else int(fuzziness)
        if not 0 <= most <= 2:
            raise QueryError("fuzziness is at most 2")
        terms = self._terms(fld).where(F.length("term").between(len(t) - most, len(t) + most))
        if prefix:
            terms = terms.where(F.col("term").startswith(t[:prefix]))
        edits = F.levenshtein(F.col("term"), F.lit(t), most)
        return terms.withColumn("edits", edits).where("edits >= 0").withColumn("b", 1.0 / (F.col("edits") + 1))

    def _bind_fuzzy(self, q: Query, lenient: bool) -> Node:
        fld = self._field(q)
        return self._expanded(fld, self._near(fld, q["term"], q["fuzziness"], int(q["prefix_length"] or 0)), q.weight)

    def _bind_term_range(self, q: Query, lenient: bool) -> Node:
        fld = self._field(q)
        terms = self._terms(fld)
        terms = self._bounded(terms, F.col("term"), q["min"], q["max"], q["inclusive_min"], q["inclusive_max"])
        return self._expanded(fld, terms.withColumn("b", F.lit(1.0)), q.weight)

    @staticmethod
    def _bounded(df: DataFrame, c: Column, low: Any, high: Any, with_low: bool | None, with_high: bool | None) -> DataFrame:
        if low is not None and low != "":
            df = df.where(c >= F.lit(low) if with_low is not False else c > F.lit(low))
        if high is not None and high != "":
            df = df.where(c <= F.lit(high) if with_high else c < F.lit(high))
        return df

    def _values(self, fld: str, kind: str) -> DataFrame:
        return self.index.values.where((F.col("field") == fld) & (F.col("kind") == kind) & F.col("indexed"))

    def _constant(self, df: DataFrame, boost: float) -> Node:
        # a document with several values comes several times; its group counts it once
        return self._leaf(Node("constant", boost=boost, frame=df.select("doc_id")))

    def _bind_numeric_range(self, q: Query, lenient: bool) -> Node:
        low, high = (None if q[k] is None else float(q[k]) for k in ("min", "max"))
        return self._constant(self._bounded(self._values(self._field(q), "number"), F.col("d"), low, high, q["inclusive_min"], q["inclusive_max"]), q.weight)

    def _bind_date_range(self, q: Query, lenient: bool) -> Node:
        parse = self.index.mapping.date_parser(q["datetime_parser"])
        bounds = []
        for edge in ("start", "end"):
            text = q[edge]
            at = parse(text) if isinstance(text, str) and text else text if isinstance(text, int) else None
            if text and at is None:
                raise QueryError(f"no date: {text}")
            bounds.append(at)
        return self._constant(self._bounded(self._values(self._field(q), "datetime"), F.col("ts_ns"), *bounds, q["inclusive_start"], q["inclusive_end"]), q.weight)

    def _bind_bool_field(self, q: Query, lenient: bool) -> Node:
        return self._constant(self._values(self._field(q), "boolean").where(F.col("b") == F.lit(bool(q["bool"]))), q.weight)

    def _bind_ip_range(self, q: Query, lenient: bool) -> Node:
        low, high = numeric.ip_range(q["cidr"])
        return self._constant(self._values(self._field(q), "IP").where(F.col("ip").between(F.lit(low), F.lit(high))), q.weight)

    def _bind_geo_box(self, q: Query, lenient: bool) -> Node:
        a, b = geo.parse_point(q["top_left"]), geo.parse_point(q["bottom_right"])
        if a is None or b is None:
            raise QueryError("a box needs two points")
        inside = geo.in_box(F.col("lon"), F.col("lat"), a[0], a[1], b[0], b[1])
        return self._constant(self._values(self._field(q), "geopoint").where(inside), q.weight)

    def _bind_geo_distance(self, q: Query, lenient: bool) -> Node:
        point = geo.parse_point(q["location"])
        if point is None:
            raise QueryError("a distance needs a location")
        metres = geo.distance_metres(q["distance"])
        first = self._values(self._field(q), "geopoint").where(geo.in_box(F.col("lon"), F.col("lat"), *geo.box_around(*point, metres)))
        near = geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(point[0]), F.lit(point[1])) <= metres / 1000
        return self._constant(first.where(near), q.weight)

    def _bind_geo_polygon(self, q: Query, lenient: bool) -> Node:
        points = [geo.parse_point(p) for p in q["polygon_points"]]
        if any(p is None for p in points):
            raise QueryError("a polygon needs points")
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        lon, lat, t = F.col("lon"), F.col("lat"), geo.TOLERANCE
        boxed = self._values(self._field(q), "geopoint").where(lon.between(min(xs) - t, max(xs) + t) & lat.between(min(ys) - t, max(ys) + t))
        return self._constant(boxed.where(geo.in_polygon(lon, lat, points)), q.weight)

    def _bind_geo_shape(self, q: Query, lenient: bool) -> Node:
        shape, relation = q["geometry"]["shape"], q["geometry"]["relation"]

        def test(texts):
            import json

            return texts.map(lambda s: geo.relate(json.loads(s), shape, relation))

        point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
        shapes = self._values(self._field(q), "geoshape").select("doc_id", "s").unionAll(self._values(self._field(q), "geopoint").select("doc_id", point))
        return self._constant(shapes.where(F.pandas_udf(test, "boolean")("s")), q.weight)

    def _bind_query_string(self, q: Query, lenient: bool) -> Node:
        own = parse_query_string(q["query"])
        return self.bind(own, True)

    def _bind_conjunction(self, q: Query, lenient: bool) -> Node:
        parts = [self.bind(c, lenient) for c in q.children]
        if lenient:
            parts = [p for p in parts if p.kind != "none"]
        if not parts:
            return self._none()
        node = Node("all_of", parts)
        paths = self.index.mapping.nested_paths()
        if paths:
            node.depth = self._common_depth(q, paths)
        return node

    def _common_depth(self, q: Query, paths: list[str]) -> int:
        """How many nested levels all fields of a conjunction share."""
        used = [f or self.index.mapping.default_field for f in q.fields()] or [self.index.mapping.default_field]
        chains = []
        for f in used:
            chains.append([] if f in ("_all", "_id") else [p for p in paths if f == p or f.startswith(f"{p}.")])
        depth = 0
        while all(len(c) > depth and c[depth] == chains[0][depth] for c in chains):
            depth += 1
        return depth

    def _bind_disjunction(self, q: Query, lenient: bool) -> Node:
        parts = [self.bind(c, lenient) for c in q.children]
        if lenient:
            parts = [p for p in parts if p.kind != "none"]
        if not parts:
            return self._none()
        return Node("any_of", parts, need=max(1, math.ceil(float(q["min"] or 0))), total=len(parts), coord=True, missing=float(q["min"] or 0) == 0)

    def _bind_boolean(self, q: Query, lenient: bool) -> Node:
        lenient = lenient or bool(q["query_string"])
        own = {}
        for name in ("must", "should", "must_not", "filter"):
            if isinstance(q[name], Query):
                node = self.bind(q[name], lenient)
                if node.kind != "none" or (name == "filter"):
                    own[name] = node
        if not own:
            return self._none()
        if "filter" in own and own["filter"].kind == "none":
            return self._none()
        if list(own) == ["must"] or list(own) == ["should"]:
            return next(iter(own.values()))
        if "must" not in own and "should" not in own:
            own["must"] = self._bind_match_all(Query("match_all"), False)
        return Node("sections", sections=own)

    def _bind_custom_filter(self, q: Query, lenient: bool) -> Node:
        return self._custom(q, True)

    def _bind_custom_score(self, q: Query, lenient: bool) -> Node:
        return self._custom(q, False)

    def _custom(self, q: Query, keep: bool) -> Node:
        """A callback over hits (doc_id, score) and the values of the fields it asks for: a function
        of the hits' DataFrame columns that gives a boolean (filter) or the new score."""
        call = q["callback"] if callable(q["callback"]) else self.callbacks.get(q["name"] or q["source"] or "")
        if call is None:
            raise QueryError("a custom query needs a callback")
        inner = Compiler(self.index, scoring=self.scoring, score=self.score, mean_length=self.mean_length, callbacks=self.callbacks)
        hits = inner.hits(q["query"])
        for name in q["fields"] or []:
            one = F.coalesce(F.col("s"), F.col("d").cast("string"), F.col("b").cast("string"), F.col("ts_ns").cast("string"))
            own = self.index.values.where((F.col("field") == name) & F.col("doc_values")).groupBy("doc_id").agg(F.collect_list(one).alias(name))
            hits = hits.join(own, "doc_id", "left")
        params = q["params"] or {}
        changed = hits.where(call(hits, **params)) if keep else hits.withColumn("score", call(hits, **params))
        return self._leaf(Node("rows", frame=changed.select("doc_id", F.col("score").cast("double").alias("s"))))

    # --- statistics ---

    def _idf_value(self, df: int) -> float:
        n = self.index.count
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) if self.scoring == "bm25" else 1 + math.log(n / (df + 1))

    def _idf(self, df: Column) -> Column:
        n = float(self.index.count)
        return F.log(1 + (n - df + 0.5) / (df + 0.5)) if self.scoring == "bm25" else 1 + F.log(n / (df + 1))

    def _gather(self) -> None:
        """Document frequencies of all terms, and sums over expansions: one job each."""
        pairs = {(x.fld, t) for x in self.leaves for t, _ in x.terms} | {(x.fld, t) for x in self.leaves for _, alts in x.slots for t, _ in alts}
        if not self.score:
            return
        if pairs:
            fields, terms = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
            found = self.index.dictionary.where(F.col("field").isin(fields) & F.col("term").isin(terms)).collect()
            self.df = {(r["field"], r["term"]): r["df"] for r in found}
        for x in self.leaves:
            if x.kind == "expanded":
                idf = self._idf(F.col("df"))
                got = x.frame.agg(F.count("*"), F.sum((x.boost * F.col("b") * idf) ** 2)).first()
                x.size, x.squares = got[0], got[1] or 0.0
        if self.scoring == "bm25":
            for f in {x.fld for x in self.leaves if x.kind in ("terms", "expanded", "phrase")}:
                self.lengths[f] = max(self.index.average_length(f, self.mean_length), 1e-9)

    def weight(self, x: Node) -> float:
        """Sum of squared weights."""
        if x.kind == "terms":
            return sum((b * self._idf_value(self.df.get((x.fld, t), 0))) ** 2 for t, b in x.terms)
        if x.kind == "phrase":
            return sum((b * self._idf_value(self.df.get((x.fld, t), 0))) ** 2 for _, alts in x.slots for t, b in alts)
        if x.kind == "expanded":
            return x.squares
        if x.kind in ("constant", "rows"):
            return x.boost**2
        if x.kind == "sections":
            return sum(self.weight(x.sections[s]) for s in ("must", "should") if s in x.sections)
        return sum(self.weight(c) for c in x.children)

    def norm(self, root: Node, lone: bool) -> float | None:
        """1/sqrt of the weights of the outermost compound; None for a lone leaf, which isn't weighted."""
        if lone:
            return None
        w = self.weight(root)
        return 1 / math.sqrt(w) if w > 0 else 1.0

    # --- plans ---

    def _term_score(self, idf: Column, fld: str) -> Column:
        tf = F.sqrt(F.col("freq").cast("double"))
        if self.scoring == "bm25":
            return idf * tf * K1 / (tf + K1 * (1 - B + B * F.col("len") / self.lengths[fld]))
        return tf * (1 / F.sqrt(F.col("len").cast("double"))).cast("float").cast("double") * idf

    def _rows(self, norm: float | None) -> DataFrame:
        """(doc_id, leaf, s, n) of all leaves."""
        spark, parts = self.index.spark, []
        wanted = []
        for x in self.leaves:
            for t, b in x.terms:
                idf = self._idf_value(self.df.get((x.fld, t), 0)) if self.score else 0.0
                wanted.append((x.fld, t, x.leaf, idf, 1.0 if norm is None else b * idf * norm))
        for fld in sorted({w[0] for w in wanted}):
            own = [w[1:] for w in wanted if w[0] == fld]
            asked = small_frame(spark, own, "term string, leaf int, idf double, qw double")
            hits = self.index.postings.where((F.col("field") == fld) & F.col("term").isin(sorted({w[0] for w in own}))).select("term", "doc_id", "freq", "len").join(F.broadcast(asked), "term")
            s = self._term_score(F.col("idf"), fld) * F.col("qw") if self.score else F.lit(0.0)
            parts.append(hits.select("doc_id", "leaf", s.alias("s"), F.lit(1).alias("n")))
        for x in self.leaves:
            if x.kind == "expanded":
                terms = x.frame.select("term", "b", *(["df"] if self.score else []))
                hits = self.index.postings.where(F.col("field") == x.fld).select("term", "doc_id", "freq", "len")
                hits = hits.join(F.broadcast(terms) if self.score and x.size <= BROADCAST_TERMS else terms, "term")
                if self.score:
                    idf = self._idf(F.col("df"))
                    s = self._term_score(idf, x.fld) * (F.lit(1.0) if norm is None else x.boost * F.col("b") * idf * norm)
                else:
                    s = F.lit(0.0)
                parts.append(hits.select("doc_id", F.lit(x.leaf).alias("leaf"), s.alias("s"), F.lit(1).alias("n")))
            elif x.kind == "constant":
                s = (1.0 if norm is None else x.boost * norm) if self.score else 0.0
                parts.append(x.frame.select("doc_id", F.lit(x.leaf).alias("leaf"), F.lit(s).alias("s"), F.lit(1).alias("n")))
            elif x.kind == "rows":
                parts.append(x.frame.select("doc_id", F.lit(x.leaf).alias("leaf"), F.col("s"), F.lit(1).alias("n")))
            elif x.kind == "phrase":
                parts.append(self._phrase_rows(x, norm))
        if not parts:
            return spark.createDataFrame([], _LEAF)
        return reduce(DataFrame.unionAll, parts)

    def _phrase_rows(self, x: Node, norm: float | None) -> DataFrame:
        """Documents where all slots stand in their places: positions minus slots meet at an anchor.
        One grouping by document; an anchor is a short text, as lists of structs take many times its memory."""
        wanted = []
        for at, alts in x.slots:
            for t, b in alts:
                idf = self._idf_value(self.df.get((x.fld, t), 0)) if self.score else 0.0
                wanted.append((t, at, idf, b * idf * norm if norm is not None else b * idf))
        asked = small_frame(self.index.spark, wanted, "term string, slot int, idf double, qw double")
        rows = self.index.postings.where((F.col("field") == x.fld) & F.col("term").isin(sorted({w[0] for w in wanted}))).join(F.broadcast(asked), "term")
        s = self._term_score(F.col("idf"), x.fld) * F.col("qw") if self.score else F.lit(0.0)

        def anchor(loc: Column) -> Column:
            place = F.concat(F.lit("|"), F.coalesce(F.array_join(loc["ap"].cast("array<string>"), ","), F.lit("")), F.lit("|"), loc["src"])
            return F.concat((loc["pos"] - F.col("slot")).cast("string"), F.when((loc["src"] == x.fld) & (F.size(loc["ap"]) == 0), "").otherwise(place))

        rows = rows.select("doc_id", "slot", s.alias("s"), F.transform("locs", anchor).alias("anchors")).repartition("doc_id")
        docs = rows.groupBy("doc_id").agg(F.collect_list(F.struct("slot", "s", "anchors")).alias("all"))
        slot_is = lambda at: lambda r: r["slot"] == at
        met, score = None, F.lit(0.0)
        for at, alts in x.slots:
            own = F.filter("all", slot_is(at))
            here = F.flatten(F.transform(own, lambda r: r["anchors"]))
            met = here if met is None else F.array_intersect(met, here)
            score = score + F.aggregate(own, F.lit(0.0), lambda total, r: total + r["s"]) * F.size(own) / len(alts)
        return docs.where(F.size(met) > 0).select("doc_id", F.lit(x.leaf).alias("leaf"), score.alias("s"), F.lit(1).alias("n"))

    def _evaluate(self, x: Node) -> tuple[Column, Column]:
        """(matched, score) over a document's group."""
        if x.kind == "none":
            return F.lit(False), F.lit(0.0)
        if x.leaf >= 0:
            n, s = F.coalesce(F.col(f"n{x.leaf}"), F.lit(0)), F.coalesce(F.col(f"s{x.leaf}"), F.lit(0.0))
            if x.kind == "terms":
                return n >= x.need, s * n / len(x.terms) if x.coord else s
            if x.kind == "expanded":
                return n >= 1, s * n / max(1, x.size)
            return n >= 1, s
        if x.kind == "all_of":
            parts = [self._evaluate(c) for c in x.children]
            return reduce(Column.__and__, [m for m, _ in parts]), reduce(Column.__add__, [s for _, s in parts])
        if x.kind == "any_of":
            parts = [self._evaluate(c) for c in x.children]
            n = reduce(Column.__add__, [m.cast("int") for m, _ in parts])
            s = reduce(Column.__add__, [F.when(m, s).otherwise(0.0) for m, s in parts])
            return n >= x.need, s * n / len(parts)
        own = {name: self._evaluate(node) for name, node in x.sections.items()}
        matched, score = F.lit(True), F.lit(0.0)
        if "must" in own:
            matched, score = own["must"]
        if "should" in own:
            m, s = own["should"]
            optional = "must" in own and x.sections["should"].missing
            matched = matched if optional else matched & m
            score = score + F.when(m, s).otherwise(0.0)
        if "must_not" in own:
            matched = matched & ~own["must_not"][0]
        if "filter" in own:
            matched = matched & own["filter"][0]
        return matched, score

    def hits(self, q: Query) -> DataFrame:
        """(doc_id, score) of every match; children of nested documents are folded into their roots."""
        root = self.bind(q)
        if root.kind == "none":
            return self.index.spark.createDataFrame([], "doc_id string, score double")
        self._gather()
        # a leaf that stands for several terms is a compound too
        lone = root.leaf >= 0 and (root.kind in ("constant", "rows") or (root.kind == "terms" and q.kind == "term" and len(root.terms) == 1))
        norm = self.norm(root, lone) if self.score else None
        nested = bool(self.index.mapping.nested_paths())
        rows = self._rows(norm)
        if nested:
            return self._fold(root, rows)
        return self._grouped(rows, root)

    def _grouped(self, rows: DataFrame, root: Node, key: str = "doc_id") -> DataFrame:
        if root.leaf >= 0 and root.kind in ("constant", "rows", "phrase"):
            # one leaf: nothing to group but a constant's repeated documents
            own = rows.select("doc_id", F.col("s").alias("score"))
            return own.distinct() if root.kind == "constant" else own
        leaves = self._leaves(root)
        matched, score = self._evaluate(root)
        return rows.groupBy(key).agg(*self._sums(leaves)).where(matched).select(key, (score if self.score else F.lit(0.0)).alias("score"))

    @staticmethod
    def _sums(leaves: list[Node]) -> list[Column]:
        """Score and matches of each leaf in a document's group."""
        out = []
        for x in leaves:
            fold = F.max if x.kind == "constant" else F.sum
            out += [fold(F.when(F.col("leaf") == x.leaf, F.col(c))).cast(kind).alias(f"{c}{x.leaf}") for c, kind in (("s", "double"), ("n", "int"))]
        return out

    def _leaves(self, x: Node) -> list[Node]:
        own = [x] if x.leaf >= 0 else []
        for c in [*x.children, *x.sections.values()]:
            own += self._leaves(c)
        return own

    # --- nested documents ---

    def _fold(self, root: Node, rows: DataFrame) -> DataFrame:
        tree = self.index.docs.select("doc_id", "root_id", "ancestors")
        found = self._nested_hits(root, rows.join(tree, "doc_id"))
        return found.groupBy("root_id").agg(F.sum("score").alias("score")).select(F.col("root_id").alias("doc_id"), "score")

    def _nested_hits(self, x: Node, rows: DataFrame) -> DataFrame:
        """(doc_id, root_id, ancestors, score); a conjunction meets at the ancestor its fields share."""
        keep = ["doc_id", "root_id", "ancestors"]
        if x.kind == "all_of" and x.depth is not None:
            parts = [self._nested_hits(c, rows).select(*keep, "score", F.lit(i).alias("part")) for i, c in enumerate(x.children)]
            own = reduce(DataFrame.unionAll, parts).withColumn("meet", F.get("ancestors", F.least(F.lit(x.depth), F.size("ancestors") - 1)))
            full = own.groupBy("meet").agg(F.count_distinct("part").alias("k")).where(F.col("k") == len(parts)).select("meet")
            met = own.join(full, "meet", "left_semi")
            return met.groupBy("doc_id").agg(F.first("root_id").alias("root_id"), F.first("ancestors").alias("ancestors"), F.sum("score").alias("score"))
        if x.kind in ("any_of", "sections") and any(c.depth is not None for c in self._compounds(x)):
            children = x.children if x.kind == "any_of" else [x.sections[k] for k in ("must", "should") if k in x.sections]
            parts = [self._nested_hits(c, rows).select("root_id", "score", F.lit(i).alias("part")) for i, c in enumerate(children)]
            per_part = reduce(DataFrame.unionAll, parts).groupBy("root_id", "part").agg(F.sum("score").alias("score"))
            own = per_part.groupBy("root_id").agg(F.sum("score").alias("score"), F.count("*").alias("k"), F.max((F.col("part") == 0).cast("int")).alias("first"))
            if x.kind == "any_of":
                own = own.where(F.col("k") >= x.need).withColumn("score", F.col("score") * F.col("k") / len(parts))
            else:
                need_should = "should" in x.sections and not ("must" in x.sections and x.sections["should"].missing)
                own = own.where((F.col("k") == len(parts)) if need_should else (F.col("first") == 1))
                for name, how in (("must_not", "left_anti"), ("filter", "left_semi")):
                    if name in x.sections:
                        own = own.join(self._nested_hits(x.sections[name], rows).select("root_id").distinct(), "root_id", how)
            return own.select(F.col("root_id").alias("doc_id"), "root_id", F.array("root_id").alias("ancestors"), "score")
        leaves = self._leaves(x)
        own = rows.where(F.col("leaf").isin([y.leaf for y in leaves]))
        matched, score = self._evaluate(x)
        return own.groupBy("doc_id").agg(F.first("root_id").alias("root_id"), F.first("ancestors").alias("ancestors"), *self._sums(leaves)).where(matched).select(*keep, score.alias("score"))

    def _compounds(self, x: Node) -> list[Node]:
        own = []
        for c in [*x.children, *x.sections.values()]:
            own += [c, *self._compounds(c)]
        return own


def search_hits(index: Index, q: Query, **options: Any) -> DataFrame:
    return Compiler(index, **options).hits(q)


def member_hits(members: list[Index], q: Query, **options: Any) -> DataFrame:
    """Hits of several indexes, each scored by its own statistics."""
    return reduce(DataFrame.unionAll, [Compiler(m, **options).hits(q).select("doc_id", "score") for m in members])
