"""Indexes, requests and collectors on small fixtures."""

import json

import pytest

from searchlake.operators.search import Searcher, SearchRequest, search
from searchlake.operators.sorting import page, parse_order, with_keys
from searchlake.plans.compiler import Compiler, member_hits
from searchlake.plans.query import QueryError, parse
from searchlake.sources.index import Alias, Index, Store, alias, synonym_table
from searchlake.sources.mapping import IndexMapping
from searchlake.streaming.ingest import ingest, percolate

PEOPLE = {
    "a": {"name": "Ada Lovelace", "age": 36, "born": "1815-12-10", "tags": ["math", "poetry"], "ok": True, "home": {"lon": -0.1, "lat": 51.5}, "ip": "10.0.0.7"},
    "b": {"name": "Alan Turing", "age": 41, "born": "1912-06-23", "tags": ["math"], "home": "51.9,-0.7", "ip": "10.0.1.9"},
    "c": {"name": "Grace Hopper wrote the first compiler", "age": 85, "tags": [], "ok": False},
    "d": {"name": "Edsger Dijkstra walked the shortest path", "born": "1930-05-11T08:00:00Z", "tags": ["paths", "math"], "home": [4.9, 52.4], "ip": "::1"},
    "e": {"name": None, "age": 41.5},
}
MAPPING = {"default_mapping": {"properties": {"name": {"fields": [{"type": "text", "analyzer": "en"}]}, "home": {"fields": [{"type": "geopoint"}]}, "ip": {"fields": [{"type": "IP"}]}}}}


def frame(spark, docs):
    return spark.createDataFrame([(i, n, json.dumps(d)) for n, (i, d) in enumerate(docs.items())], "doc_id string, seq long, source string")


@pytest.fixture(scope="module")
def people(spark):
    own = Index.from_json(frame(spark, PEOPLE), MAPPING)
    own.docs, own.values, own.postings = own.docs.cache(), own.values.cache(), own.postings.cache()
    return own


def ids(index, query, **request):
    return [h["id"] for h in search(index, {"query": query, "sort": ["_id"], "size": 20} | request).hits]


CASES = [
    ({"term": "hopper", "field": "name"}, "c"),
    ({"match": "walking compilers", "field": "name"}, "cd"),
    ({"match": "alan lovelace", "field": "name", "operator": "and"}, ""),
    ({"match": "the of", "field": "name"}, ""),
    ({"match_phrase": "wrote the first", "field": "name"}, "c"),
    ({"match_phrase": "first wrote", "field": "name"}, ""),
    ({"terms": ["edsger", "", "walk"], "field": "name"}, "d"),
    ({"terms": [["ada", "alan"], ["ture", "lovelac"]], "field": "name"}, "ab"),
    ({"prefix": "al", "field": "name"}, "b"),
    ({"regexp": "a(da|lan)", "field": "name"}, "ab"),
    ({"wildcard": "?opp*", "field": "name"}, "c"),
    ({"term": "hoper", "fuzziness": 1, "field": "name"}, "c"),
    ({"match": "turring", "fuzziness": "auto", "field": "name"}, "b"),
    ({"min": "ada", "max": "alan", "inclusive_max": True, "field": "name"}, "ab"),
    ({"min": 41, "field": "age"}, "bce"),
    ({"min": 41, "inclusive_min": False, "max": 85, "field": "age"}, "e"),
    ({"start": "1900-01-01", "end": "1930-05-11T08:00:00Z", "field": "born"}, "b"),
    ({"start": "1900-01-01", "end": "1930-05-11T08:00:00Z", "inclusive_end": True, "field": "born"}, "bd"),
    ({"bool": True, "field": "ok"}, "a"),
    ({"cidr": "10.0.0.0/23", "field": "ip"}, "ab"),
    ({"cidr": "::1", "field": "ip"}, "d"),
    ({"ids": ["a", "z", "e"]}, "ae"),
    ({"match_all": {}}, "abcde"),
    ({"match_none": {}}, ""),
    ({}, ""),
    ({"conjuncts": [{"match": "math"}, {"min": 40, "field": "age"}]}, "b"),
    ({"conjuncts": [{"match": "math"}, {"match_none": {}}]}, ""),
    ({"disjuncts": [{"match": "math"}, {"min": 41, "field": "age"}, {"prefix": "al", "field": "name"}], "min": 2}, "b"),
    ({"must": {"conjuncts": [{"match": "math"}]}, "must_not": {"disjuncts": [{"prefix": "al", "field": "name"}]}}, "ad"),
    ({"must": {"conjuncts": [{"match": "math"}]}, "should": {"disjuncts": [{"prefix": "al", "field": "name"}], "min": 1}}, "b"),
    ({"must_not": {"disjuncts": [{"match": "math"}]}}, "ce"),
    ({"filter": {"match": "math"}}, "abd"),
    ({"should": {"disjuncts": [{"match": "math"}]}, "filter": {"bool": True, "field": "ok"}}, "a"),
    ({"query": "+tags:math -name:alan"}, "ad"),
    ({"query": "age:>=41 age:<50"}, "abce"),
    ({"query": "+age:>=41 +age:<50"}, "be"),
    ({"query": 'name:"first compiler"'}, "c"),
    ({"query": "name:/ho.*/ name:edsg*"}, "cd"),
    ({"query": "+the +hopper"}, "c"),
    ({"query": "41"}, ""),
    ({"query": "age:41"}, "b"),
    ({"query": ""}, ""),
    ({"top_left": [-1, 53], "bottom_right": [1, 51], "field": "home"}, "ab"),
    ({"location": {"lon": 4.9, "lat": 52.0}, "distance": "100km", "field": "home"}, "d"),
    ({"polygon_points": [[-1, 51], [-1, 53], [1, 51]], "field": "home"}, "ab"),
    ({"geometry": {"shape": {"type": "circle", "coordinates": [-0.1, 51.5], "radius": "10km"}, "relation": "within"}, "field": "home"}, "a"),
]


@pytest.mark.parametrize(("query", "want"), CASES, ids=[json.dumps(q)[:60] for q, _ in CASES])
def test_query(people, query, want):
    assert "".join(ids(people, query)) == want


BAD = [{"min": None, "field": "x", "max": None}, {"nonsense": 1}, {"must": {"disjuncts": []}}, {"term": "x", "fuzziness": 3}, {"disjuncts": [{"match": "a"}], "min": 2}, {"geometry": {"shape": {}, "relation": "near"}}, {"fuzziness": 1}, {"polygon_points": [[1, 2]]}]


@pytest.mark.parametrize("query", BAD, ids=str)
def test_bad_queries(query):
    with pytest.raises(QueryError):
        parse(query)


def test_bad_query_strings(people):
    for text in ('"open', "name:", "+", "age:>x", "a^x"):
        with pytest.raises(QueryError):
            ids(people, {"query": text})


def test_sorting_and_missing(people):
    every = {"match_all": {}}
    assert ids(people, every, sort=["age", "_id"]) == list("abecd")
    assert ids(people, every, sort=["-age", "_id"]) == list("cebad")
    assert ids(people, every, sort=[{"by": "field", "field": "age", "desc": True, "missing": "first"}, "_id"]) == list("dceba")
    assert ids(people, every, sort=["born", "_id"]) == list("abdce")
    assert ids(people, every, sort=[{"by": "field", "field": "tags", "mode": "max", "desc": True}, "_id"]) == list("adbce")
    assert ids(people, every, sort=[{"by": "geo_distance", "field": "home", "location": [4.9, 52.4], "unit": "km"}, "_id"]) == list("dabce")
    assert ids(people, every) == ids(people, every, sort=["_id"])


def test_pages(people):
    every, order = {"match_all": {}}, ["age", "_id"]
    assert ids(people, every, sort=order, size=2) == list("ab")
    assert [h["id"] for h in search(people, {"query": every, "sort": order, "size": 2, "from": 2}).hits] == list("ec")
    assert ids(people, every, sort=order, size=2, search_after=[41, "b"]) == list("ec")
    assert ids(people, every, sort=order, size=2, search_before=[41.5, "e"]) == list("ab")
    assert ids(people, every, sort=order, size=5, search_after=[85, "c"]) == list("d")
    with pytest.raises(ValueError):
        SearchRequest.of({"query": every, "sort": order, "search_after": [1]})


def test_scores(people):
    one = search(people, {"query": {"term": "math", "field": "tags", "boost": 9}})
    assert one.total == 3 and one.hits[0]["score"] == search(people, {"query": {"term": "math", "field": "tags"}}).hits[0]["score"]
    boosted = search(people, {"query": {"disjuncts": [{"term": "poetry", "field": "tags"}, {"prefix": "tur", "field": "name", "boost": 5}]}})
    assert [h["id"] for h in boosted.hits] == ["b", "a"]
    assert all(h["score"] == 0 for h in search(people, {"query": {"match": "math"}, "score": "none"}).hits)
    told = Searcher(people).explain(parse({"match": "math"}), "a")
    parts = told["tree"]["terms"][0]["children"]
    assert parts[0]["value"] * parts[1]["value"] == pytest.approx(told["value"], rel=1e-6) and [c["message"].split("(")[0] for c in parts[1]["children"]] == ["tf", "norm", "idf"]
    assert told["value"] == pytest.approx(next(h["score"] for h in search(people, {"query": {"match": "math"}}).hits if h["id"] == "a"))


def test_facets(people):
    got = search(people, {"query": {"match_all": {}}, "size": 0, "facets": {"t": {"field": "tags", "size": 1}, "p": {"field": "tags", "term_prefix": "p"}, "n": {"field": "age", "numeric_ranges": [{"name": "old", "min": 41}, {"name": "young", "max": 42}, {"name": "none", "min": 900}]}, "d": {"field": "born", "date_ranges": [{"name": "late", "start": "1900-01-01"}]}}}).facets
    assert got["t"] == {"field": "tags", "total": 5, "missing": 2, "other": 2, "terms": [{"term": "math", "count": 3}]}
    assert got["p"]["total"] == 5 and got["p"]["missing"] == 3 and got["p"]["terms"] == [{"term": "paths", "count": 1}, {"term": "poetry", "count": 1}]
    assert [(r["name"], r["count"]) for r in got["n"]["numeric_ranges"]] == [("old", 3), ("young", 3)] and got["n"]["total"] == 6 and got["n"]["missing"] == 1
    assert [(r["name"], r["count"]) for r in got["d"]["date_ranges"]] == [("late", 2)] and got["d"]["missing"] == 2
    with pytest.raises(ValueError):
        SearchRequest.of({"query": {}, "facets": {"x": {"field": "a", "numeric_ranges": [{"name": "q"}]}}})


def test_fields_and_highlight(people):
    hit = search(people, {"query": {"match": "walks path", "field": "name"}, "fields": ["tags", "name"], "highlight": {}, "includeLocations": True}).hits[0]
    assert hit["fields"] == {"tags": ["paths", "math"], "name": "Edsger Dijkstra walked the shortest path"}
    assert hit["fragments"] == {"name": ["Edsger Dijkstra <mark>walked</mark> the shortest <mark>path</mark>"]}
    assert hit["locations"]["name"]["path"] == [{"pos": 6, "start": 36, "end": 40, "array_positions": None}]


def test_locations_of_large_expansions(spark):
    words = [f"t{i:04}" for i in range(1500)]
    index = Index.from_json(frame(spark, {"a": {"x": " ".join(words)}, "b": {"x": "other t0007", "y": "t9"}}))
    index.docs, index.values, index.postings = index.docs.cache(), index.values.cache(), index.postings.cache()
    for query in ({"prefix": "t", "field": "x"}, {"wildcard": "t*"}):
        a, b = search(index, {"query": query, "sort": ["_id"], "includeLocations": True, "highlight": {}}).hits
        assert sorted(a["locations"]["x"]) == words and list(b["locations"]["x"]) == ["t0007"]
        assert ("y" in b["locations"]) == ("field" not in query)
        assert b["fragments"]["x"] == ["other <mark>t0007</mark>"]


def test_dictionary(people):
    assert [(r.term, r.df) for r in people.field_dict("tags").collect()] == [("math", 3), ("paths", 1), ("poetry", 1)]
    assert [r.term for r in people.field_dict("tags", prefix="p").collect()] == ["paths", "poetry"]
    assert [r.term for r in people.term_frequencies("tags", 1).collect()] == ["math"]
    assert people.count == 5


def test_synonyms(spark, people):
    from dataclasses import replace

    table = synonym_table(spark, "x", [{"input": ["numbers"], "synonyms": ["math"]}])
    own = replace(people, synonyms=table, mapping=replace(people.mapping, default_synonym_source="x"))
    # a field without a source, or with another one, isn't expanded
    assert ids(replace(people, synonyms=table), {"match": "numbers", "field": "tags"}) == []
    assert ids(replace(own, mapping=replace(people.mapping, default_synonym_source="y")), {"match": "numbers", "field": "tags"}) == []
    assert ids(own, {"match": "numbers", "field": "tags"}) == list("abd")
    assert ids(own, {"match": "math", "field": "tags"}) == list("abd")
    assert ids(people, {"match": "numbers", "field": "tags"}) == []


def test_constructors_equal_json():
    from searchlake.plans import query as q

    cases = [
        (q.match_all(), {"match_all": {}}), (q.match_phrase("a b", fld="t"), {"match_phrase": "a b", "field": "t"}), (q.phrase(["a", "b"], fld="t"), {"terms": ["a", "b"], "field": "t"}),
        (q.prefix("a", fld="t", boost=2), {"prefix": "a", "field": "t", "boost": 2}), (q.regexp("a.", fld="t"), {"regexp": "a.", "field": "t"}), (q.wildcard("a*"), {"wildcard": "a*"}),
        (q.fuzzy("abc", 1, fld="t"), {"term": "abc", "fuzziness": 1, "field": "t"}), (q.term_range("a", "b"), {"min": "a", "max": "b"}), (q.numeric_range(1, None, fld="n"), {"min": 1, "field": "n"}),
        (q.date_range("2020-01-01"), {"start": "2020-01-01"}), (q.bool_field(True, fld="b"), {"bool": True, "field": "b"}), (q.ip_range("10.0.0.0/8"), {"cidr": "10.0.0.0/8"}), (q.doc_ids(["a"]), {"ids": ["a"]}),
        (q.query_string("+a"), {"query": "+a"}), (q.geo_distance([1, 2], "3km"), {"location": [1, 2], "distance": "3km"}), (q.geo_box([0, 1], [1, 0]), {"top_left": [0, 1], "bottom_right": [1, 0]}),
    ]
    for built, source in cases:
        read = parse(source)
        assert (built.kind, built.field, built.boost, {k: v for k, v in built.args.items() if k != "match_all"}) == (read.kind, read.field, read.boost, {k: v for k, v in read.args.items() if k != "match_all"}), source
    with pytest.raises(QueryError):
        q.numeric_range(None, None)


def test_alias_members(spark):
    one, two = Index.from_json(frame(spark, {"a": {"t": "x"}})), Index.from_json(frame(spark, {"b": {"t": "x"}}))
    own = Alias(one=one)
    assert ids(own.index(), {"match": "x"}) == ["a"]
    own.swap({"two": two}, ["one"])
    assert ids(own.index(), {"match": "x"}) == ["b"]
    own.add(one=one)
    assert ids(own.index(), {"match": "x"}) == ["a", "b"] and own.status()[1] == {"total": 2, "failed": 0, "successful": 2, "errors": {}}
    own.remove("one", "two")
    with pytest.raises(ValueError, match="members"):
        own.index()


def test_many_synonyms(spark):
    from types import SimpleNamespace

    table = synonym_table(spark, "x", [{"input": ["numbers"], "synonyms": [*[f"a{i:05}" for i in range(10_000)], "math"]}])
    found = Compiler(SimpleNamespace(synonyms=table, mapping=SimpleNamespace(scoring_model="tfidf", synonym_collection=lambda f: "x"))).synonyms_of("tags", "numbers")
    assert len(found) == 10_001 and found[-1] == "math"


def test_alias(spark):
    one = Index.from_json(frame(spark, {"a": {"t": "x y"}}))
    two = Index.from_json(frame(spark, {"b": {"t": "x"}, "c": {"t": "y"}}))
    both = alias(one, two, names=["one", "two"])
    assert ids(both, {"match": "x"}) == ["a", "b"] and both.count == 3
    assert {r["index"] for r in both.docs.collect()} == {"one", "two"}
    own = {r.doc_id: r.score for r in member_hits([one, two], parse({"match": "x"})).collect()}
    shared = {r.doc_id: r.score for r in Compiler(both).hits(parse({"match": "x"})).collect()}
    assert own.keys() == shared.keys() == {"a", "b"} and own["a"] != pytest.approx(shared["a"])


COMPANY = {"default_mapping": {"properties": {"teams": {"nested": True, "properties": {"people": {"nested": True}}}}}}
COMPANIES = {
    "x": {"name": "acme", "teams": [{"name": "build", "budget": 5, "people": [{"name": "ann", "role": "lead"}, {"name": "bob", "role": "dev"}]}, {"name": "sell", "budget": 9, "people": [{"name": "cat", "role": "dev"}]}]},
    "y": {"name": "blue", "teams": [{"name": "build", "budget": 9, "people": [{"name": "ann", "role": "dev"}]}]},
}


@pytest.fixture(scope="module")
def companies(spark):
    return Index.from_json(frame(spark, COMPANIES), COMPANY)


NESTED = [
    ([("teams.name", "build"), ("teams.budget", 9)], "y"),
    ([("teams.people.name", "ann"), ("teams.people.role", "dev")], "y"),
    ([("teams.name", "build"), ("teams.people.role", "lead")], "x"),
    ([("teams.name", "sell"), ("teams.people.name", "ann")], ""),
    ([("name", "acme"), ("teams.budget", 9)], "x"),
    ([("name", "acme"), ("teams.people.name", "cat")], "x"),
]


@pytest.mark.parametrize(("clauses", "want"), NESTED, ids=str)
def test_nested(companies, clauses, want):
    parts = [{"min": v, "max": v, "inclusive_max": True, "field": f} if isinstance(v, int) else {"match": v, "field": f} for f, v in clauses]
    got = sorted(r.doc_id for r in Compiler(companies).hits(parse({"conjuncts": parts})).collect())
    assert "".join(got) == want


def test_custom_queries(people):
    from pyspark.sql import functions as F

    calls = {"odd": lambda h, least=0: F.get(F.col("age"), 0).cast("double") > least, "ten": lambda h: F.col("score") * 0 + 10}
    hits = Compiler(people, callbacks=calls).hits(parse({"custom_filter": {"query": {"match_all": {}}, "fields": ["age"], "name": "odd", "params": {"least": 41}}}))
    assert sorted(r.doc_id for r in hits.collect()) == ["c", "e"]
    assert {r.score for r in Compiler(people, callbacks=calls).hits(parse({"custom_score": {"query": {"match": "math"}, "name": "ten"}})).collect()} == {10.0}
    with pytest.raises(QueryError):
        Compiler(people).hits(parse({"custom_score": {"query": {"match_all": {}}, "name": "unknown"}}))


VECTORS = {"default_mapping": {"properties": {"v": {"fields": [{"type": "vector", "dims": 2}]}, "w": {"fields": [{"type": "vector_base64", "dims": 2, "similarity": "cosine"}]}}}}


def test_knn_and_fusion(spark):
    own = Index.from_json(frame(spark, {"a": {"v": [0, 0], "t": "x", "w": "AACAPwAAAAA="}, "b": {"v": [[3, 4], [1, 0]], "t": "x y"}, "c": {"v": [0, 2], "t": "y", "w": "AAAAAAAAgD8="}, "d": {"v": [1, 2, 3]}}), VECTORS)
    near = search(own, {"query": {"match_none": {}}, "knn": [{"field": "v", "vector": [0, 0], "k": 2}]})
    assert [h["id"] for h in near.hits] == ["a", "b"] and near.hits[1]["score"] == pytest.approx(1.0)
    filtered = search(own, {"query": {"match_none": {}}, "knn": [{"field": "v", "vector": [0, 0], "k": 2, "filter": {"match": "y"}}]})
    assert [h["id"] for h in filtered.hits] == ["b", "c"]
    assert [h["id"] for h in search(own, {"query": {"match_none": {}}, "knn": [{"field": "w", "vector": [0, 1], "k": 1}]}).hits] == ["c"]
    for how in ("rrf", "rsf", ""):
        got = search(own, {"query": {"match": "y"}, "knn": [{"field": "v", "vector": [0, 2], "k": 3}], "score": how, "params": {"score_window_size": 10}})
        assert got.total == 3 and got.hits[0]["id"] == "c"
    both = search(own, {"query": {"match_none": {}}, "knn": [{"field": "v", "vector": [0, 0], "k": 1}, {"field": "v", "vector": [0, 2], "k": 2}], "knn_operator": "and"})
    assert [h["id"] for h in both.hits] == ["a"]


def test_store_versions(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "ix"), IndexMapping())
    rows = lambda docs: spark.createDataFrame([(i, json.dumps(d) if d else None) for i, d in docs], "doc_id string, source string")
    first = store.batch(rows([("a", {"t": "red"}), ("b", {"t": "blue"})]))
    assert ids(store.open(), {"match": "red"}) == ["a"]
    store.batch(rows([("a", {"t": "green"}), ("b", None), ("c", {"t": "red"})]))
    assert ids(store.open(), {"match": "red"}) == ["c"] and ids(store.open(), {"match_all": {}}) == ["a", "c"]
    assert ids(store.open(first), {"match_all": {}}) == ["a", "b"]
    store.delete("c")
    assert ids(store.open(), {"match_all": {}}) == ["a"]
    assert store.open().document("a").select("s").collect()[0][0] == "green"
    store.rollback(first)
    assert ids(store.open(), {"match_all": {}}) == ["a", "b"]
    store.set_internal("k", "v")
    assert store.internal() == {"k": "v"}
    assert ids(store.copy_to(str(tmp_path / "copy")).open(), {"match": "blue"}) == ["b"]
    store.update_mapping({"default_mapping": {"properties": {"t": {"enabled": False}}}})
    assert ids(store.open(), {"match": "blue"}) == []
    store.prune(1)
    assert len(store.versions()) == 1


def test_store_merges_segments(spark, tmp_path, monkeypatch):
    """Many batches give the index that one batch gives, and few segments."""
    monkeypatch.setattr(Store, "MERGE", 2)
    store = Store.create(spark, str(tmp_path / "ix"), IndexMapping())
    store.add_synonyms("c", [{"synonyms": ["red", "crimson"]}])
    now = {}
    for n, batch in enumerate([{"a": "red", "b": "blue"}, {"b": "green"}, {"c": "red"}, {"a": None, "d": "red blue"}]):
        now = {k: v for k, v in {**now, **batch}.items() if v}
        store.batch(spark.createDataFrame([(i, json.dumps({"t": t}) if t else None, n) for i, t in batch.items()], "doc_id string, source string, seq long"))
        assert len(store.segments()) <= 2
    whole = Index.from_json(frame(spark, {i: {"t": t} for i, t in now.items()}))
    own = store.open()
    for pick in (lambda x: x.dictionary.where("df > 0"), lambda x: x.postings.select("field", "term", "doc_id", "freq", "len"), lambda x: x.docs.select("doc_id")):
        assert sorted(map(tuple, pick(own).collect())) == sorted(map(tuple, pick(whole).collect()))
    assert own.synonyms.count() == 2


def test_paging_from_missing_keys(spark):
    index = Index.from_json(frame(spark, {"a": {"n": 1}, "b": {"n": 2}, "c": {"t": "x"}, "d": {"t": "x"}}))
    pages = {}
    for missing in ("last", "first"):
        order = parse_order([{"by": "field", "field": "n", "missing": missing}, "_id"])
        keyed = with_keys(index, Compiler(index).hits(parse({"match_all": {}})), order)
        for edge in ("search_after", "search_before"):
            for keys in ([None, "c"], [None, "d"], [1, "a"], [2, "b"]):
                pages[missing, edge, keys[1]] = "".join(r.doc_id for r in page(keyed, order, 10, **{edge: keys}).collect())
    full = {"last": "abcd", "first": "cdab"}
    for (missing, edge, key), got in pages.items():
        before, behind = full[missing].split(key)
        assert got == (behind if edge == "search_after" else before), (missing, edge, key)


def test_streaming_ingest(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "ix"), IndexMapping())
    (tmp_path / "in").mkdir()
    for n, docs in enumerate([[("a", {"t": "red"})], [("a", {"t": "blue"}), ("b", {"t": "red"})]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"doc_id": i, "source": json.dumps(d)}) for i, d in docs))
        stream = spark.readStream.schema("doc_id string, source string").json(str(tmp_path / "in"))
        ingest(stream, store, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert ids(store.open(), {"match": "red"}) == ["b"] and store.internal()["last_batch"] == "1"


def test_percolate(spark):
    rows = spark.createDataFrame([(1, "Red and blue"), (2, "green")], "id long, text string")
    got = percolate(rows, {"both": ["blue", "red"], "g": ["green"]}).select("id", "query").collect()
    assert sorted(tuple(r) for r in got) == [(1, "both"), (2, "g")]
