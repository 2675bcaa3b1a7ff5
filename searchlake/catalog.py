"""Registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlake import samples
from searchlake.functions import analysis, dates, geo, vectors
from searchlake.operators import facets as facet_ops
from searchlake.operators import sorting
from searchlake.operators import vectors as vector_ops
from searchlake.plans.compiler import Compiler
from searchlake.plans.query import parse
from searchlake.sources.index import Index, Store, alias, postings_of, read_tables, synonym_table, write_tables
from searchlake.sources.mapping import DocumentMapping, FieldMapping, IndexMapping

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- indexes over the tables, built once per session and stored -----------------------------

_BUILT: dict[tuple[str, str, str, str], Index] = {}
WORDS = "[A-Za-z0-9]+"


def _words_mapping() -> IndexMapping:
    """ASCII words, lower-cased: an analyzer that any SQL engine can repeat."""
    return IndexMapping(analysis={"tokenizers": {"words": {"type": "regexp", "regexp": WORDS}}, "analyzers": {"words": {"tokenizer": "words", "token_filters": ["to_lower"], "native": analysis.native_regexp(WORDS)}}}, default_analyzer="words")


def _shared(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="searchlake-index-")
    return shared


def _state(spark: SparkSession, sf_dir: str) -> str:
    """What tells a folder's tables from others that take their place: their times of change."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getModificationTime()}:{f.getLen()}" for f in files))


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Index]) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _BUILT:
        built = build()
        root = f"{_shared(spark)}/index-{name}-{uuid.uuid4().hex}"
        write_tables(built, root)
        _BUILT[key] = read_tables(spark, root, built)
        atexit.register(_remove, spark, root)
    return _BUILT[key]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone
        pass


def documents(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        fields = {"text": FieldMapping(analyzer="words", include_in_all=False), "lang": FieldMapping(analyzer="keyword"), "source": FieldMapping(analyzer="keyword"), "n_chars": FieldMapping("number")}
        return Index.from_columns(table(spark, sf_dir, "documents"), "doc_id", fields, mapping=_words_mapping())

    return _stored(spark, sf_dir, "documents", build)


def events(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        rows = table(spark, sf_dir, "events").select(
            "event_id", "event_type", "value", "ts", (F.col("value") > 50).alias("large"),
            F.struct((F.col("event_id") * 37 % 36000 / 100.0 - 180).alias("lon"), (F.col("event_id") * 17 % 18000 / 100.0 - 90).alias("lat")).alias("place"),
            F.unhex(F.concat(F.lit("00000000000000000000ffff0a"), F.lpad(F.hex(F.col("event_id") % (1 << 24)), 6, "0"))).alias("ip"),
        )
        fields = {"event_type": FieldMapping(analyzer="keyword"), "value": FieldMapping("number"), "ts": FieldMapping("datetime"), "large": FieldMapping("boolean"), "place": FieldMapping("geopoint"), "ip": FieldMapping("IP")}
        return Index.from_columns(rows, "event_id", fields, mapping=_words_mapping())

    return _stored(spark, sf_dir, "events", build)


def embeddings(spark: SparkSession, sf_dir: str) -> Index:
    """The vectors three times, for the three measures, and their label as a keyword."""

    def build() -> Index:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("l2"), F.col("embedding").alias("dot"), F.col("embedding").alias("cos"))
        dims = len(rows.select("l2").first()[0])
        fields = {"label": FieldMapping(analyzer="keyword")} | {n: FieldMapping("vector", dims=dims, similarity=s) for n, s in (("l2", vectors.L2), ("dot", vectors.DOT), ("cos", vectors.COSINE))}
        return Index.from_columns(rows, "vec_id", fields, mapping=_words_mapping())

    return _stored(spark, sf_dir, "embeddings", build)


def found(index: Index, query: dict, *, digits: int = 5, id_name: str = "doc_id", **options: Any) -> DataFrame:
    hits = Compiler(index, **options).hits(parse(query))
    return hits.select(F.col("doc_id").cast("long").alias(id_name), F.round("score", digits).alias("score"))


# --- SQL parts ----------------------------------------------------------------------------

TOK = f"""tok AS (SELECT doc_id, lower(t.w) AS term, t.p AS pos FROM
  (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '{WORDS}'), range(1, len(regexp_extract_all(text, '{WORDS}')) + 1))) AS z FROM documents),
  LATERAL (SELECT z[1] AS w, z[2] AS p) t),
post AS (SELECT term, doc_id, count(*) AS freq FROM tok GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
leaf AS (SELECT post.term, post.doc_id, 1 + ln(n.n / (df.df + 1)) AS idf,
         sqrt(freq) * CAST(CAST(1 / sqrt(len.len) AS FLOAT) AS DOUBLE) * (1 + ln(n.n / (df.df + 1))) AS w
         FROM post JOIN len USING (doc_id) JOIN df USING (term), n)"""


def group_sql(terms: str, *, need: int = 1, coord: bool = True) -> str:
    """Hits of (term, b) rows as one group of term clauses."""
    score = "sum(w * b * idf * q.norm)" + (" * count(*) / max(q.m)" if coord else "")
    return f"""WITH {TOK}, want AS ({terms}),
    idfs AS (SELECT term, b, 1 + ln(n.n / (coalesce(df, 0) + 1)) AS i FROM want LEFT JOIN df USING (term), n),
    q AS (SELECT 1 / sqrt(sum((b * i) * (b * i))) AS norm, count(*) AS m FROM idfs)
    SELECT doc_id, round({score}, 5) AS score FROM leaf JOIN want USING (term), q
    GROUP BY doc_id HAVING count(*) >= {need}"""


# --- query nodes --------------------------------------------------------------------------


@register("q_term", f"WITH {TOK} SELECT doc_id, round(w, 5) AS score FROM leaf WHERE term = 'was'")
def q_term(spark, d):
    return found(documents(spark, d), {"term": "was", "field": "text", "boost": 3})


@register("q_match_or", group_sql("SELECT unnest(['the', 'and', 'was']) AS term, 2.0 AS b"))
def q_match_or(spark, d):
    return found(documents(spark, d), {"match": "The and WAS", "field": "text", "boost": 2})


@register("q_match_and", group_sql("SELECT unnest(['the', 'and', 'was']) AS term, 1.0 AS b", need=3, coord=False))
def q_match_and(spark, d):
    return found(documents(spark, d), {"match": "the and was", "field": "text", "operator": "and"})


@register("q_prefix", group_sql("SELECT term, 1.0 AS b FROM df WHERE starts_with(term, 'thera')"))
def q_prefix(spark, d):
    return found(documents(spark, d), {"prefix": "thera", "field": "text"})


@register("q_regexp", group_sql("SELECT term, 1.0 AS b FROM df WHERE regexp_full_match(term, 'th[aeiou]r.?')"))
def q_regexp(spark, d):
    return found(documents(spark, d), {"regexp": "^th[aeiou]r.?", "field": "text"})


@register("q_wildcard", group_sql("SELECT term, 1.0 AS b FROM df WHERE regexp_full_match(term, 't.er.*on')"))
def q_wildcard(spark, d):
    return found(documents(spark, d), {"wildcard": "t?er*on", "field": "text"})


@register("q_fuzzy", group_sql("SELECT term, 1.0 / (levenshtein(term, 'there') + 1) AS b FROM df WHERE levenshtein(term, 'there') <= 1"))
def q_fuzzy(spark, d):
    return found(documents(spark, d), {"term": "there", "fuzziness": 1, "field": "text"})


@register("q_fuzzy_prefix_auto", group_sql("SELECT term, 1.0 / (levenshtein(term, 'anding') + 1) AS b FROM df WHERE levenshtein(term, 'anding') <= 2 AND starts_with(term, 'an')"))
def q_fuzzy_prefix_auto(spark, d):
    return found(documents(spark, d), {"term": "anding", "fuzziness": "auto", "prefix_length": 2, "field": "text"})


@register("q_term_range", group_sql("SELECT term, 1.0 AS b FROM df WHERE term >= 'thea' AND term < 'theb'"))
def q_term_range(spark, d):
    return found(documents(spark, d), {"min": "thea", "max": "theb", "field": "text"})


@register("q_numeric_range", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 500 AND n_chars < 2000")
def q_numeric_range(spark, d):
    return found(documents(spark, d), {"min": 500, "max": 2000, "field": "n_chars"})


@register("q_date_range", "SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
def q_date_range(spark, d):
    return found(events(spark, d), {"start": "2024-01-10", "end": "2024-01-20T12:00:00Z", "field": "ts"}, id_name="event_id")


@register("q_bool_field", "SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE value > 50")
def q_bool_field(spark, d):
    return found(events(spark, d), {"bool": True, "field": "large"}, id_name="event_id")


@register("q_ip_range", "SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE event_id % 16777216 BETWEEN 256 AND 511")
def q_ip_range(spark, d):
    return found(events(spark, d), {"cidr": "10.0.1.0/24", "field": "ip"}, id_name="event_id")


@register("q_doc_ids", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id IN (1, 3, 5, 700)")
def q_doc_ids(spark, d):
    return found(documents(spark, d), {"ids": ["1", "3", "5", "700"]})


@register("q_match_all", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
def q_match_all(spark, d):
    return found(documents(spark, d), {"match_all": {}})


@register("q_match_none", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE false")
def q_match_none(spark, d):
    return found(documents(spark, d), {"match_none": {}})


def compound_sql(clauses: dict[str, float], score: str, having: str, extra: str = "") -> str:
    """Term clauses as columns per document: m_<term> and s_<term>, scaled by the norm of the scoring ones."""
    cols = ", ".join(f"max(CASE WHEN term = '{t}' THEN w * {b} * idf END) AS s_{t}" for t, b in clauses.items())
    squares = " + ".join(f"coalesce((SELECT ({b} * (1 + ln(n.n / (df + 1)))) ** 2 FROM df, n WHERE term = '{t}'), ({b} * (SELECT 1 + ln(n.n / 1.0) FROM n)) ** 2)" for t, b in clauses.items() if b)
    terms = ", ".join(f"'{t}'" for t in clauses)
    return f"WITH {TOK}, g AS (SELECT doc_id, {cols} FROM leaf WHERE term IN ({terms}) GROUP BY doc_id), q AS (SELECT 1 / sqrt({squares}) AS norm) SELECT doc_id, round({score}, 5) AS score FROM g JOIN documents USING (doc_id), q WHERE {having} {extra}"


def _s(t: str) -> str:
    return f"coalesce(s_{t}, 0) * q.norm"


def _m(t: str) -> str:
    return f"(s_{t} IS NOT NULL)"


def _t(t: str, **more: Any) -> dict:
    return {"term": t, "field": "text", **more}


@register("q_conjunction", compound_sql({"the": 1.0, "was": 2.0}, f"{_s('the')} + {_s('was')}", f"{_m('the')} AND {_m('was')}"))
def q_conjunction(spark, d):
    return found(documents(spark, d), {"conjuncts": [_t("the"), _t("was", boost=2)]})


@register("q_disjunction_min", compound_sql({"was": 1.0, "with": 1.0, "of": 1.0}, f"({_s('was')} + {_s('with')} + {_s('of')}) * ({_m('was')}::int + {_m('with')}::int + {_m('of')}::int) / 3", f"{_m('was')}::int + {_m('with')}::int + {_m('of')}::int >= 2"))
def q_disjunction_min(spark, d):
    return found(documents(spark, d), {"disjuncts": [_t("was"), _t("with"), _t("of")], "min": 2})


@register("q_boolean", compound_sql({"the": 1.0, "of": 1.0, "was": 1.0, "und": 0.0}, f"{_s('the')} + ({_s('of')} + {_s('was')}) * ({_m('of')}::int + {_m('was')}::int) / 2", f"{_m('the')} AND NOT {_m('und')} AND n_chars >= 400"))
def q_boolean(spark, d):
    return found(documents(spark, d), {"must": {"conjuncts": [_t("the")]}, "should": {"disjuncts": [_t("of"), _t("was")], "min": 0}, "must_not": {"disjuncts": [_t("und")]}, "filter": {"min": 400, "field": "n_chars"}})


@register("q_must_not_only", f"WITH {TOK} SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'the')")
def q_must_not_only(spark, d):
    return found(documents(spark, d), {"must_not": {"disjuncts": [_t("the")]}})


@register("q_filter_only", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang = 'de'")
def q_filter_only(spark, d):
    return found(documents(spark, d), {"filter": {"term": "de", "field": "lang"}})


@register("q_query_string", compound_sql({"the": 1.0, "of": 2.0, "und": 0.0}, f"{_s('the')} + {_s('of')}", f"{_m('the')} AND NOT {_m('und')}"))
def q_query_string(spark, d):
    return found(documents(spark, d), {"query": "+text:the -text:und text:of^2"})


PHRASE = """SELECT doc_id, round(sum(w * idf) / (SELECT sqrt(sum(i * i)) FROM (SELECT 1 + ln(n.n / (df + 1)) AS i FROM df, n WHERE term IN ({0}))), 5) AS score
FROM leaf WHERE term IN ({0}) AND doc_id IN ({1}) GROUP BY doc_id"""


@register("q_phrase", f"WITH {TOK} " + PHRASE.format("'of', 'the'", "SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"))
def q_phrase(spark, d):
    return found(documents(spark, d), {"match_phrase": "of THE", "field": "text"})


@register("q_phrase_gap", f"WITH {TOK} " + PHRASE.format("'the', 'and'", "SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'the' AND b.term = 'and'"))
def q_phrase_gap(spark, d):
    return found(documents(spark, d), {"terms": ["the", "", "and"], "field": "text"})


@register("q_multi_phrase", f"WITH {TOK} SELECT DISTINCT a.doc_id, 0.0::DOUBLE AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term IN ('of', 'in') AND b.term IN ('the', 'that')")
def q_multi_phrase(spark, d):
    return found(documents(spark, d), {"terms": [["of", "in"], ["the", "that"]], "field": "text"}, score=False)


BM25 = """SELECT doc_id, round(sum(i * sqrt(freq) * 1.2 / (sqrt(freq) + 1.2 * (0.25 + 0.75 * len / {avg})) * i * q.norm) * count(*) / max(q.m), 5) AS score
FROM post JOIN len USING (doc_id) JOIN idfs USING (term), q GROUP BY doc_id"""


def bm25_sql(avg: str) -> str:
    return f"WITH {TOK}, idfs AS (SELECT term, ln(1 + (n.n - df + 0.5) / (df + 0.5)) AS i FROM df, n WHERE term IN ('the', 'was')), q AS (SELECT 1 / sqrt(sum(i * i)) AS norm, count(*) AS m FROM idfs) " + BM25.format(avg=avg)


@register("q_bm25", bm25_sql("(SELECT ceil(count(*) / (SELECT n FROM n)) FROM df)"))
def q_bm25(spark, d):
    return found(documents(spark, d), {"match": "the was", "field": "text"}, scoring="bm25")


@register("q_bm25_mean_length", bm25_sql("(SELECT avg(len) FROM len)"))
def q_bm25_mean_length(spark, d):
    return found(documents(spark, d), {"match": "the was", "field": "text"}, scoring="bm25", mean_length=True)


LON, LAT = "(event_id * 37 % 36000 / 100.0 - 180)", "(event_id * 17 % 18000 / 100.0 - 90)"


@register("q_geo_box", f"SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE {LAT} BETWEEN -10.000001 AND 20.000001 AND ({LON} >= 169.999999 OR {LON} <= -149.999999)")
def q_geo_box(spark, d):
    return found(events(spark, d), {"top_left": [170, 20], "bottom_right": [-150, -10], "field": "place"}, id_name="event_id")


def haversine_sql(lon: float, lat: float) -> str:
    h = f"(1 - cos(radians({LAT} - {lat})) + cos(radians({LAT})) * cos(radians({lat})) * (1 - cos(radians({LON} - {lon})))) / 2"
    m = f"radians(abs(({LAT} + {lat}) / 2))"
    a, b = f"{geo._AXIS}::DOUBLE", f"{geo._POLE}::DOUBLE"
    top = f"({a} * {a} * cos({m})) ** 2 + ({b} * {b} * sin({m})) ** 2"
    return f"2 * sqrt(({top}) / (({a} * cos({m})) ** 2 + ({b} * sin({m})) ** 2)) * asin(least(1.0, sqrt({h})))"


@register("q_geo_distance", f"SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE {haversine_sql(10.0, 50.0)} <= 1500")
def q_geo_distance(spark, d):
    return found(events(spark, d), {"location": [10, 50], "distance": "1500km", "field": "place"}, id_name="event_id")


@register("q_geo_polygon", f"SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE {LAT} > 0 AND {LAT} <= 40 AND {LON} > -20.0 + {LAT} / 2.0 AND {LON} < 60.0 - {LAT} / 2.0")
def q_geo_polygon(spark, d):
    # places are whole hundredths: the edges run between them, around those of the SQL
    points = [[-19.995, 0.005], [59.995, 0.005], [39.995, 40.005], [0.005, 40.005]]
    return found(events(spark, d), {"polygon_points": points, "field": "place"}, id_name="event_id")


@register("q_geo_shape", f"SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE {LAT} BETWEEN 10 AND 30 AND {LON} BETWEEN 20 AND 60")
def q_geo_shape(spark, d):
    shape = {"type": "envelope", "coordinates": [[20, 30], [60, 10]]}
    return found(events(spark, d), {"geometry": {"shape": shape, "relation": "within"}, "field": "place"}, id_name="event_id")


@register("sort_geo_distance", f"SELECT event_id, round({haversine_sql(10.0, 50.0)}, 3) AS km FROM events ORDER BY {haversine_sql(10.0, 50.0)}, event_id LIMIT 20")
def sort_geo_distance(spark, d):
    index = events(spark, d)
    order = sorting.parse_order([{"by": "geo_distance", "field": "place", "location": [10, 50], "unit": "km"}])
    keyed = sorting.with_keys(index, Compiler(index).hits(parse({"match_all": {}})), order)
    top = keyed.orderBy(F.asc_nulls_last("k0"), F.col("doc_id").cast("long")).limit(20)
    return top.select(F.col("doc_id").cast("long").alias("event_id"), F.round("k0", 3).alias("km"))


# --- collectors ---------------------------------------------------------------------------


@register("top_scores", f"WITH hits AS ({group_sql(chr(39).join(['SELECT unnest([', 'the', ', ', 'was', ']) AS term, 1.0 AS b']))}) SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 25")
def top_scores(spark, d):
    return found(documents(spark, d), {"match": "the was", "field": "text"}).orderBy(F.desc("score"), "doc_id").limit(25)


@register("sort_field_page", "SELECT doc_id, n_chars::double AS n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id::varchar LIMIT 10 OFFSET 10")
def sort_field_page(spark, d):
    index = documents(spark, d)
    order = sorting.parse_order(["-n_chars", "_id"])
    hits = Compiler(index).hits(parse({"term": "en", "field": "lang"}))
    return sorting.page(sorting.with_keys(index, hits, order), order, 10, 10).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k0.d").alias("n_chars"))


@register("search_after", "SELECT doc_id, n_chars::double AS n_chars FROM documents WHERE n_chars > 700 OR (n_chars = 700 AND doc_id::varchar > '5') ORDER BY n_chars, doc_id::varchar LIMIT 10")
def search_after(spark, d):
    index = documents(spark, d)
    order = sorting.parse_order(["n_chars", "_id"])
    keyed = sorting.with_keys(index, Compiler(index).hits(parse({"match_all": {}})), order)
    return sorting.page(keyed, order, 10, search_after=[700, "5"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k0.d").alias("n_chars"))


# documents have no missing values: every third is taken to have none
MISSING = "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN n_chars::double END AS n_chars FROM documents"


def _with_missing(spark: SparkSession, d: str, missing: str, **edge: list) -> DataFrame:
    index = documents(spark, d)
    own = replace(index, values=index.values.where("field = 'n_chars' and cast(doc_id as long) % 3 > 0"))
    order = sorting.parse_order([{"by": "field", "field": "n_chars", "missing": missing}, "_id"])
    keyed = sorting.with_keys(own, Compiler(index).hits(parse({"match_all": {}})), order)
    return sorting.page(keyed, order, 12, **edge).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("k0.d", F.lit(-1.0)).alias("n_chars"))


@register("search_before_missing", f"SELECT doc_id, coalesce(n_chars, -1) AS n_chars FROM ({MISSING}) WHERE n_chars IS NOT NULL OR doc_id::varchar < '12' ORDER BY nullif(n_chars, -1) DESC NULLS FIRST, doc_id::varchar DESC LIMIT 12")
def search_before_missing(spark, d):
    return _with_missing(spark, d, "last", search_before=[None, "12"])


@register("search_after_missing", f"SELECT doc_id, coalesce(n_chars, -1) AS n_chars FROM ({MISSING}) WHERE n_chars IS NOT NULL OR doc_id::varchar > '993' ORDER BY nullif(n_chars, -1) NULLS FIRST, doc_id::varchar LIMIT 12")
def search_after_missing(spark, d):
    return _with_missing(spark, d, "first", search_after=[None, "993"])


@register("search_before", "SELECT * FROM (SELECT doc_id, n_chars::double AS n_chars FROM documents WHERE n_chars < 700 ORDER BY n_chars DESC, doc_id::varchar DESC LIMIT 10)")
def search_before(spark, d):
    index = documents(spark, d)
    order = sorting.parse_order(["n_chars", "_id"])
    keyed = sorting.with_keys(index, Compiler(index).hits(parse({"match_all": {}})), order)
    return sorting.page(keyed, order, 10, search_before=[700, ""]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k0.d").alias("n_chars"))


@register("total_and_max", f"WITH {TOK} SELECT count(*) AS total, round(max(w), 5) AS max_score FROM leaf WHERE term = 'was'")
def total_and_max(spark, d):
    return found(documents(spark, d), {"term": "was", "field": "text"}).agg(F.count("*").alias("total"), F.max("score").alias("max_score"))


@register("facet_terms", f"WITH {TOK} SELECT source AS term, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM post WHERE term = 'the') GROUP BY ALL")
def facet_terms(spark, d):
    index = documents(spark, d)
    return facet_ops.terms(index, Compiler(index, score=False).hits(parse(_t("the"))), "source")


@register("facet_terms_filtered", f"WITH {TOK} SELECT post.term, count(*) AS n FROM post WHERE starts_with(post.term, 'th') AND regexp_matches(post.term, 'er$') GROUP BY ALL")
def facet_terms_filtered(spark, d):
    index = documents(spark, d)
    return facet_ops.terms(index, index.docs, "text", prefix="th", pattern="er$")


@register("facet_numeric", "SELECT name, count(*) AS n FROM events, (VALUES ('low', NULL, 20.0), ('mid', 10.0, 60.0), ('high', 60.0, NULL), ('never', 1e9, NULL)) r(name, lo, hi) WHERE (lo IS NULL OR value >= lo) AND (hi IS NULL OR value < hi) GROUP BY ALL")
def facet_numeric(spark, d):
    index = events(spark, d)
    return facet_ops.range_counts(index, index.docs, "value", [{"name": "low", "max": 20}, {"name": "mid", "min": 10, "max": 60}, {"name": "high", "min": 60}, {"name": "never", "min": 1e9}])


@register("facet_dates", "SELECT name, count(*) AS n FROM events, (VALUES ('old', NULL, TIMESTAMP '2024-01-15'), ('new', TIMESTAMP '2024-01-15', NULL)) r(name, lo, hi) WHERE (lo IS NULL OR ts >= lo) AND (hi IS NULL OR ts < hi) GROUP BY ALL")
def facet_dates(spark, d):
    index = events(spark, d)
    return facet_ops.range_counts(index, index.docs, "ts", [{"name": "old", "end": "2024-01-15"}, {"name": "new", "start": "2024-01-15"}], kind="datetime")


@register("field_dictionary", f"WITH {TOK} SELECT term, df FROM df WHERE term BETWEEN 'then' AND 'thez'")
def field_dictionary(spark, d):
    return documents(spark, d).field_dict("text", start="then", end="thez")


@register("term_frequencies", f"WITH {TOK} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 20")
def term_frequencies(spark, d):
    return documents(spark, d).term_frequencies("text", 20)


@register("field_stats", f"WITH {TOK} SELECT 'text' AS field, count(*) AS docs, sum(len)::bigint AS tokens, round(avg(len), 4) AS mean_length FROM len")
def field_stats(spark, d):
    return documents(spark, d).field_stats().where("field = 'text'").select("field", "docs", "tokens", F.round("mean_length", 4).alias("mean_length"))


@register("doc_count", "SELECT count(*) AS n FROM documents")
def doc_count(spark, d):
    return documents(spark, d).docs.agg(F.count("*").alias("n"))


# --- vectors ------------------------------------------------------------------------------


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def _near(spark, d, clauses, **options) -> DataFrame:
    index = embeddings(spark, d)
    return vector_ops.knn(index, [{"field": f, "vector": _vector(spark, d, v), "k": k} for f, v, k in clauses], **options)


EMB = "SELECT e.vec_id, e.label, e.embedding AS v, (SELECT embedding FROM embeddings WHERE vec_id = {0}) AS q FROM embeddings e"
L2S = "CASE WHEN list_distance(v::double[], q::double[]) = 0 THEN 3.4028234663852886e38 ELSE 1 / (list_distance(v::double[], q::double[]) ** 2) END"


@register("knn_l2", f"SELECT vec_id, round({L2S}, 4) AS s FROM ({EMB.format(7)}) WHERE vec_id <> 7 ORDER BY {L2S} DESC, vec_id LIMIT 9")
def knn_l2(spark, d):
    return _near(spark, d, [("l2", 7, 10)]).where("doc_id <> '7'").select(F.col("doc_id").cast("long").alias("vec_id"), F.round("s", 4).alias("s"))


@register("knn_cosine", f"SELECT vec_id, round(list_cosine_similarity(v::double[], q::double[]), 5) AS s FROM ({EMB.format(7)}) ORDER BY list_cosine_similarity(v::double[], q::double[]) DESC LIMIT 10")
def knn_cosine(spark, d):
    return _near(spark, d, [("cos", 7, 10)]).select(F.col("doc_id").cast("long").alias("vec_id"), F.round("s", 5).alias("s"))


@register("knn_dot", f"SELECT vec_id, round(list_inner_product(v::double[], q::double[]), 5) AS s FROM ({EMB.format(3)}) ORDER BY list_inner_product(v::double[], q::double[]) DESC LIMIT 10")
def knn_dot(spark, d):
    return _near(spark, d, [("dot", 3, 10)]).select(F.col("doc_id").cast("long").alias("vec_id"), F.round("s", 5).alias("s"))


@register("knn_filtered", f"SELECT vec_id, round(list_cosine_similarity(v::double[], q::double[]), 5) AS s FROM ({EMB.format(7)}) WHERE label = 3 ORDER BY list_cosine_similarity(v::double[], q::double[]) DESC LIMIT 10")
def knn_filtered(spark, d):
    index = embeddings(spark, d)
    eligible = Compiler(index, score=False).hits(parse({"term": "3", "field": "label"}))
    return _near(spark, d, [("cos", 7, 10)], eligible=[eligible]).select(F.col("doc_id").cast("long").alias("vec_id"), F.round("s", 5).alias("s"))


def _cos(v: int, k: int) -> str:
    return f"(SELECT vec_id, list_cosine_similarity(v::double[], q::double[]) AS s FROM ({EMB.format(v)}) ORDER BY 2 DESC, vec_id::varchar LIMIT {k})"


@register("knn_multi_or", f"SELECT vec_id, round(sum(s) / sqrt(2), 5) AS score FROM (SELECT * FROM {_cos(7, 30)} UNION ALL SELECT * FROM {_cos(8, 30)}) GROUP BY ALL")
def knn_multi_or(spark, d):
    own = vector_ops.additive(None, _near(spark, d, [("cos", 7, 30), ("cos", 8, 30)]))
    return own.select(F.col("doc_id").cast("long").alias("vec_id"), F.round("score", 5).alias("score"))


@register("knn_multi_and", f"SELECT vec_id, round(sum(s) / sqrt(2), 5) AS score FROM (SELECT * FROM {_cos(7, 100)} UNION ALL SELECT * FROM {_cos(8, 100)}) GROUP BY vec_id HAVING count(*) = 2")
def knn_multi_and(spark, d):
    own = vector_ops.additive(None, _near(spark, d, [("cos", 7, 100), ("cos", 8, 100)], operator="and"))
    return own.select(F.col("doc_id").cast("long").alias("vec_id"), F.round("score", 5).alias("score"))


def _text_and_vectors(spark, d):
    index = embeddings(spark, d)
    text = Compiler(index).hits(parse({"disjuncts": [{"term": "3", "field": "label"}, {"term": "4", "field": "label", "boost": 2}]}))
    clauses = [{"field": "cos", "vector": _vector(spark, d, 7), "k": 40}, {"field": "cos", "vector": _vector(spark, d, 8), "k": 40, "boost": 0.5}]
    return text, vector_ops.knn(index, clauses), clauses


# ranks depend on order within ties of the text score, so both sides order ties by the id as text
RANKED = """WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT label, 1 + ln(n.n / (count(*) + 1)) AS i FROM embeddings, n WHERE label IN (3, 4) GROUP BY label, n.n),
q AS (SELECT 1 / sqrt(sum((CASE WHEN label = 4 THEN 2 ELSE 1 END * i) ** 2)) AS norm FROM d),
text AS (SELECT vec_id, i * (CASE WHEN label = 4 THEN 2 ELSE 1 END) * i * norm / 2 AS s FROM embeddings JOIN d USING (label), q),
src AS (SELECT 1.0 AS weight, 0 AS src, * FROM (SELECT vec_id, s FROM text ORDER BY round(s, 9) DESC, vec_id::varchar LIMIT 50)
  UNION ALL SELECT 1.0, 1, * FROM {a} UNION ALL SELECT 0.5, 2, * FROM {b}),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, vec_id::varchar) AS rank FROM src)"""


@register("fusion_rrf", RANKED.format(a=_cos(7, 40), b=_cos(8, 40)) + " SELECT vec_id, round(sum(weight / (60 + rank)), 6) AS score FROM r GROUP BY vec_id")
def fusion_rrf(spark, d):
    text, near, clauses = _text_and_vectors(spark, d)
    own = vector_ops.reciprocal_rank_fusion(text.withColumn("score", F.round("score", 9)), near, clauses, window=50)
    return own.select(F.col("doc_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@register("fusion_rsf", RANKED.format(a=_cos(7, 40), b=_cos(8, 40)) + ", e AS (SELECT src, min(s) AS lo, max(s) AS hi FROM r GROUP BY src) SELECT vec_id, round(sum(weight * CASE WHEN abs(hi - lo) < 1e-12 THEN 1 ELSE (s - lo) / (hi - lo) END), 5) AS score FROM r JOIN e USING (src) GROUP BY vec_id")
def fusion_rsf(spark, d):
    text, near, clauses = _text_and_vectors(spark, d)
    own = vector_ops.relative_score_fusion(text.withColumn("score", F.round("score", 9)), near, clauses, window=50)
    return own.select(F.col("doc_id").cast("long").alias("vec_id"), F.round("score", 5).alias("score"))


# --- structure: nested, synonyms, alias, upserts, mappings ----------------------------------


def conversations(spark: SparkSession, sf_dir: str) -> Index:
    """A document per conversation with its turns as nested documents."""

    def build() -> Index:
        turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        docs = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.to_json(F.struct("turns")).alias("source"))
        base = _words_mapping()
        nested = DocumentMapping(nested=True, properties={"role": DocumentMapping(fields=[FieldMapping(analyzer="keyword")]), "text": DocumentMapping(fields=[FieldMapping(analyzer="words", include_in_all=False)])})
        return Index.from_json(docs, replace(base, default_mapping=DocumentMapping(properties={"turns": nested})))

    return _stored(spark, sf_dir, "conversations", build)


@register("nested_conjunction", "SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '(^|[^A-Za-z0-9])[wW][aA][sS]([^A-Za-z0-9]|$)')")
def nested_conjunction(spark, d):
    query = {"conjuncts": [{"term": "assistant", "field": "turns.role"}, {"term": "was", "field": "turns.text"}]}
    hits = Compiler(conversations(spark, d), score=False).hits(parse(query))
    return hits.select(F.col("doc_id").cast("long").alias("conv_id"))


@register("synonym_match", group_sql("SELECT 'the' AS term, 1.0 AS b UNION ALL SELECT 'that', 0.5 UNION ALL SELECT 'this', 0.5"))
def synonym_match(spark, d):
    """A field expands by the collection of its own source; another collection's pairs don't count."""
    own = documents(spark, d)
    table_ = synonym_table(spark, "articles", [{"synonyms": ["the", "that", "this"]}]).unionAll(synonym_table(spark, "others", [{"input": ["the"], "synonyms": ["was"]}]))
    mapping = replace(own.mapping, analysis=own.mapping.analysis | {"synonym_sources": {"words": {"collection": "articles"}}}, default_synonym_source="words")
    return found(replace(own, mapping=mapping, synonyms=table_), {"term": "the", "field": "text"})


@register("store_batches", "SELECT doc_id, round(n_chars, 0)::double AS n_chars FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0) WHERE n_chars >= 500")
def store_batches(spark, d):
    """A stored index after a batch of upserts and one of deletes, each a segment of its own."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "n_chars")
    store = Store.create(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")
    atexit.register(_remove, spark, store.path)
    store.batch(docs.select("doc_id", F.to_json(F.struct("n_chars")).alias("source")))
    first = store.current()
    store.batch(docs.where("doc_id % 3 = 0").select("doc_id", F.to_json(F.struct((F.col("n_chars") + 1).alias("n_chars"))).alias("source")))
    last = store.batch(docs.where("doc_id % 5 = 0").select("doc_id", F.lit(None).cast("string").alias("source")))
    store.rollback(first)
    store.rollback(last)
    hits = found(store.open(), {"min": 500, "field": "n_chars"}, score=False)
    values = store.open().values.where("field = 'n_chars'").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("d").alias("n_chars"))
    return hits.select("doc_id").join(values, "doc_id")


@register("alias_union", f"WITH {TOK} SELECT doc_id, round(w, 5) AS score FROM leaf WHERE term = 'was'")
def alias_union(spark, d):
    own = documents(spark, d)
    parts = []
    for odd in (0, 1):
        mine = F.col("doc_id").cast("long") % 2 == odd
        parts.append(replace(own, docs=own.docs.where(mine), values=own.values.where(mine), postings=own.postings.where(mine), term_stats=None))
    return found(alias(*parts, names=["even", "odd"]), {"term": "was", "field": "text"})


@register("upsert_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    """Last write wins, as batches apply it."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(last)).where("r = 1").select("user_id", "event_id", "value")


@register("dynamic_json_range", "SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 20 AND CAST(json_extract(props, '$.k') AS DOUBLE) < 50")
def dynamic_json_range(spark, d):
    docs = table(spark, d, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("props").alias("source"))
    return found(Index.from_json(docs), {"min": 20, "max": 50, "field": "k"}, id_name="event_id", score=False).withColumn("score", F.lit(1.0))


@register("custom_filter", f"WITH {TOK} SELECT doc_id, round(w, 5) AS score FROM leaf JOIN documents USING (doc_id) WHERE term = 'was' AND n_chars % 2 = 0")
def custom_filter(spark, d):
    even = lambda hits: F.get(F.col("n_chars"), 0).cast("double") % 2 == 0
    return found(documents(spark, d), {"custom_filter": {"query": _t("was"), "fields": ["n_chars"], "name": "even"}}, callbacks={"even": even})


@register("custom_score", f"WITH {TOK} SELECT doc_id, round(w * n_chars, 3) AS score FROM leaf JOIN documents USING (doc_id) WHERE term = 'was'")
def custom_score(spark, d):
    times = lambda hits: F.col("score") * F.get(F.col("n_chars"), 0).cast("double")
    return found(documents(spark, d), {"custom_score": {"query": _t("was"), "fields": ["n_chars"], "name": "times"}}, digits=3, callbacks={"times": times})


# --- analysis -----------------------------------------------------------------------------


def _counted(df: DataFrame, analyzer: analysis.Analyzer, column: str) -> DataFrame:
    return df.select(F.explode(analyzer.column(F.col(column))).alias("t")).groupBy("t.term").agg(F.count("*").alias("n"))


def _custom(tokenizer: str, *filters: analysis.TokenFilter) -> analysis.Analyzer:
    return analysis.Analyzer("custom", analysis.Registry().tokenizers[tokenizer], (analysis.to_lower, *filters))


@register("analyze_whitespace", "SELECT w AS term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(p_name), '\\s+')) AS w FROM part) WHERE w <> '' GROUP BY ALL")
def analyze_whitespace(spark, d):
    return _counted(table(spark, d, "part"), _custom("whitespace"), "p_name")


@register("analyze_edge_ngram", "SELECT substr(lower(n_name), 1, k) AS term, count(*) AS n FROM nation, range(2, 5) r(k) WHERE length(n_name) >= k GROUP BY ALL")
def analyze_edge_ngram(spark, d):
    return _counted(table(spark, d, "nation"), _custom("single", analysis.edge_ngram_filter(2, 4)), "n_name")


@register("analyze_ngram", "SELECT substr(lower(n_name), i, k) AS term, count(*) AS n FROM nation, range(2, 4) r(k), range(1, 60) s(i) WHERE i + k - 1 <= length(n_name) GROUP BY ALL")
def analyze_ngram(spark, d):
    return _counted(table(spark, d, "nation"), _custom("single", analysis.ngram_filter(2, 3)), "n_name")


@register("analyze_shingle", "WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) SELECT w[i] || ' ' || w[i + 1] AS term, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL")
def analyze_shingle(spark, d):
    own = analysis.Analyzer("shingles", analysis.regexp_tokenizer(WORDS), (analysis.to_lower, analysis.shingle_filter(2, 2)))
    return _counted(table(spark, d, "benchmark"), own, "text")


@register("analyze_length_stop", f"SELECT w AS term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '{WORDS}'))) AS w FROM documents) WHERE length(w) BETWEEN 3 AND 5 AND w NOT IN ('the', 'and', 'that') GROUP BY ALL")
def analyze_length_stop(spark, d):
    column = analysis.native_regexp(WORDS, stop=("the", "and", "that"), low=3, high=5)
    return table(spark, d, "documents").select(F.explode(column(F.col("text"))).alias("t")).groupBy("t.term").agg(F.count("*").alias("n"))


@register("analyze_path_hierarchy", "SELECT array_to_string(list_slice(p, 1, i), '/') AS term, count(*) AS n FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(lower(url), '/') AS p FROM pages)) WHERE i <= 10 GROUP BY ALL")
def analyze_path_hierarchy(spark, d):
    return _counted(table(spark, d, "pages"), _custom("single", analysis.hierarchy_filter("/")), "url")


@register("analyze_html", r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(html, '<[/!]?[A-Za-z][^>]*>', ' ', 'g')), '\p{L}+')) AS term FROM pages) GROUP BY term")
def analyze_html(spark, d):
    own = analysis.Analyzer("html", analysis.letter_tokenizer, (analysis.to_lower,), (analysis.html_filter,))
    return _counted(table(spark, d, "pages"), own, "html")


STANDARD = r"(?:[\p{L}\p{M}](?:['’.:·][\p{L}\p{M}])+|\p{N}(?:['’.,;]\p{N})+|[\p{L}\p{M}\p{N}_])+"


def _standard_sql() -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(samples._stop_lists()["en"]))
    pattern = STANDARD.replace("'", "''")
    return f"SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '{pattern}'))) AS term FROM documents) WHERE term NOT IN ({stops}) GROUP BY term"


@register("analyze_standard", _standard_sql())
def analyze_standard(spark, d):
    return _counted(table(spark, d, "documents"), analysis.analyzer("standard"), "text")


@register("analyze_languages", None)
def analyze_languages(spark, d):
    """Each document by the analyzer of its language."""
    rows = table(spark, d, "documents").where(F.col("lang").isin("en", "de", "fr", "es")).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("text").alias("field"), F.array().cast("array<bigint>").alias("ap"), F.col("text").alias("s"), F.col("lang").alias("analyzer"), F.lit(False).alias("in_all"))
    own = postings_of(rows, {n: analysis.analyzer(n) for n in ("en", "de", "fr", "es")}, False)
    return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("n"))


@register("parse_dates", "SELECT event_id, epoch_us(ts) AS us FROM events")
def parse_dates(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, d, "events").select("event_id", F.unix_micros(dates.optional_column(text)).alias("us"))


for _name, (_query, _sql) in samples.QUERIES.items():
    register(_name, _sql)(_query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches for a few words, by tf-idf."""
    return found(documents(spark, sf_dir), {"match": "the and was", "field": "text"}).orderBy(F.desc("score"), "doc_id").limit(10)
