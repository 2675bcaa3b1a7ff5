"""Tables of analysis: text to terms, offsets and positions."""

import json

import pytest
from pyspark.sql import functions as F

from searchlake.functions import analysis as a
from searchlake.functions import dates, geo, lang, numeric, vectors
from searchlake.plans.query import Query
from searchlake.plans.query_string import parse_query_string
from searchlake.sources.mapping import IndexMapping, Walker

REGISTRY = a.Registry()

ANALYZERS = [
    ("standard", "The Quick-Fox's can't 3.14", [("quick", 4, 9, 2), ("fox's", 10, 15, 3), ("3.14", 22, 26, 5)]),
    ("simple", "Ab1Çd", [("ab", 0, 2, 1), ("çd", 3, 6, 2)]),
    ("keyword", "As it Is", [("As it Is", 0, 8, 1)]),
    ("web", "at me@x.com #tag @you", [("me@x.com", 3, 11, 2), ("#tag", 12, 16, 3), ("@you", 17, 21, 4)]),
    ("en", "the walking cats", [("walk", 4, 11, 2), ("cat", 12, 16, 3)]),
    ("de", "schönes Haus", [("schon", 0, 8, 1), ("haus", 9, 13, 2)]),
    ("fr", "l'avion", [("avion", 0, 7, 1)]),
    ("cjk", "日本語 a", [("日本", 0, 6, 1), ("本語", 3, 9, 2), ("a", 10, 11, 3)]),
]


@pytest.mark.parametrize(("name", "text", "want"), ANALYZERS, ids=[x[0] for x in ANALYZERS])
def test_analyzers(name, text, want):
    assert [(t.term, t.start, t.end, t.pos) for t in REGISTRY.analyzer(name).tokens(text)] == want


def terms(f, text, tokenizer=a.whitespace_tokenizer):
    return [t.term for t in f(tokenizer(text))]


FILTERS = [
    (a.length_filter(2, 3), "a ab abc abcd", ["ab", "abc"]),
    (a.truncate_filter(2), "abc é", ["ab", "é"]),
    (a.unique_filter, "a b a", ["a", "b"]),
    (a.reverse_filter, "abc e\u0301x", ["cba", "xe\u0301"]),
    (a.apostrophe_filter, "ali'nin plain", ["ali", "plain"]),
    (a.elision_filter(["l"]), "l'ami d'ami L’eau", ["ami", "d'ami", "eau"]),
    (a.camel_case_filter, "camelCase HTMLParser v2", ["camel", "Case", "HTML", "Parser", "v", "2"]),
    (a.dict_compound_filter(["soft", "ball"]), "softball", ["softball", "soft", "ball"]),
    (a.ngram_filter(1, 2), "ab", ["a", "ab", "b"]),
    (a.edge_ngram_filter(1, 2), "abc", ["a", "ab"]),
    (a.edge_ngram_filter(1, 2, True), "abc", ["c", "bc"]),
    (a.shingle_filter(2, 3), "a b c", ["a b", "b c", "a b c"]),
    (a.hierarchy_filter("."), "a.b.c", ["a", "a.b", "a.b.c"]),
    (a.normalize_filter("nfkc"), "ﬁ", ["fi"]),
    (a.stop_filter(["b"]), "a b c", ["a", "c"]),
    (a.to_lower, "ABC É", ["abc", "é"]),
]


@pytest.mark.parametrize(("f", "text", "want"), FILTERS, ids=[str(x[1]) for x in FILTERS])
def test_filters(f, text, want):
    assert terms(f, text) == want


def test_positions_keep_gaps():
    stopped = a.stop_filter(["b"])(a.whitespace_tokenizer("a b c"))
    assert [(t.term, t.pos) for t in stopped] == [("a", 1), ("c", 3)]
    assert [t.term for t in a.shingle_filter(2, 2)(stopped)] == ["a _", "_ c"]
    kept = a.stemmer_filter(lang.porter)(a.keyword_marker(["walking"])(a.whitespace_tokenizer("walking talking")))
    assert [t.term for t in kept] == ["walking", "talk"]


def test_char_filters():
    assert a.html_filter("<b>x</b> y") == "   x     y"
    assert a.ascii_folding("Ünïcødé ﬁ œuvre ß") == "Unicode fi oeuvre ss"
    assert a.regexp_filter(r"(\d+)-(\d+)", "$2/$1")("1-2") == "2/1"
    assert a.zero_width_filter("a\u200cb") == "a b"


def test_exception_tokenizer():
    own = a.exception_tokenizer([r"[hH][tT]{2}[pP]://\S*"], a.unicode_tokenizer)
    assert [(t.term, t.pos) for t in own("see http://a.b now")] == [("see", 1), ("http://a.b", 2), ("now", 3)]


STEMS = [
    (lang.porter, "caresses ponies cats feed agreed plastered motoring conflated hopping falling relational conditional digitizer triplicate formative adjustment bowdlerize controlling", "caress poni cat feed agre plaster motor conflat hop fall relat condit digit triplic form adjust bowdler control"),
    (lang.english, "skies dying consistently generously happily running", "sky die consist generous happili run"),
    (lang.english_plural, "boxes ponies glass cats shoes", "box pony glass cat shoe"),
    (lang.german, "häuser aufeinander kategorischen", "haus aufeinand kategor"),
    (lang.dutch, "lichaamszwakheden opgravingen vorige lezen bomen", "lichaamszwak opgrav vorig lez bom"),
    (lang.spanish_light, "chicana chicanos veces", "chican chican vez"),
    (lang.italian_light, "ragazzo ragazzi", "ragazz ragazz"),
    (lang.french_light, "chevaux nationale faible", "cheval national faibl"),
    (lang.french_minimal, "chevaux hiboux baronnes", "cheval hibou baron"),
    (lang.portuguese_light, "doutores boas", "doutor boa"),
    (lang.swedish, "jaktens friskt", "jakt frisk"),
    (lang.russian, "важность книги", "важност книг"),
    (lang.arabic, "الكتاب", "كتاب"),
]


@pytest.mark.parametrize(("stem", "words", "want"), STEMS, ids=[x[0].__name__ for x in STEMS])
def test_stemmers(stem, words, want):
    assert " ".join(map(stem, words.split())) == want


def test_column_forms_agree(spark):
    rows = spark.createDataFrame([("The Quick brown",), (None,), ("",), ("Ünï cødé 1a",)], "s string")
    for name in ("simple", "keyword", "standard", "en"):
        own = a.analyzer(name)
        for r in rows.select("s", own.column(F.col("s")).alias("t")).collect():
            assert [(t.term, t.pos) for t in r.t] == [(t.term, t.pos) for t in own.tokens(r.s)]


def test_custom_components():
    m = IndexMapping.of({"analysis": {"token_maps": {"sw": {"type": "custom", "tokens": ["x"]}}, "token_filters": {"s": {"type": "stop_tokens", "stop_token_map": "sw"}}, "tokenizers": {"t": {"type": "regexp", "regexp": "[a-z]+"}}, "char_filters": {"c": {"type": "regexp", "regexp": "q", "replace": "x"}}, "analyzers": {"mine": {"type": "custom", "char_filters": ["c"], "tokenizer": "t", "token_filters": ["to_lower", "s"]}}}})
    assert [t.term for t in m.registry().analyzer("mine").tokens("a q b1")] == ["a", "b"]
    with pytest.raises(ValueError):
        IndexMapping.of({"analysis": {"analyzers": {"bad": {"tokenizer": "nowhere"}}}})


DATES = [
    (dates.optional, "2001-09-09T01:46:40Z", 10**18), (dates.optional, "2001-09-09 03:46:40.5+02:00", 10**18 + 5 * 10**8), (dates.optional, "2001-09-09", 999993600 * 10**9), (dates.optional, "2001-13-01", None),
    (dates.percent_style("%d/%m/%Y %I:%M%p"), "09/09/2001 1:46AM", 999999960 * 10**9), (dates.iso_style("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "2001-09-09T01:46:40.000Z", 10**18),
    (dates.unix(1000), "1000000000000", 10**18), (dates.unix(1), "x", None), (dates._layout("02 Jan 2006 15:04:05"), "09 Sep 2001 01:46:40", 10**18),
]


@pytest.mark.parametrize(("parse", "text", "want"), DATES, ids=[x[1] for x in DATES])
def test_dates(parse, text, want):
    assert parse(text) == want


def test_numbers():
    for x in (0.0, -0.5, 1.25, -1e300, 1e300):
        assert numeric.unsortable(numeric.sortable(x)) == x
    assert sorted([3.0, -2.0, 0.5], key=numeric.sortable) == [-2.0, 0.5, 3.0]
    for v in (0, -1, 12345, -(1 << 63), (1 << 63) - 1):
        assert numeric.decode_prefix(numeric.prefix_code(v)) == (v, 0)
        assert numeric.decode_prefix(numeric.prefix_code(v, 8)) == (v >> 8 << 8, 8)
    assert numeric.deinterleave(numeric.interleave(5, 9)) == 5
    assert numeric.ip_range("10.0.0.0/30")[1][-1] == 3 and numeric.ip_bytes("x") is None


def test_geo():
    assert geo.decode_geohash("u4pruydqqvj") == pytest.approx((10.40744, 57.64911), abs=1e-4)
    assert geo.encode_geohash(10.40744, 57.64911, 8) == "u4pruydq"
    lon, lat = geo.unmorton(geo.morton(-122.1, 37.4))
    assert (lon, lat) == pytest.approx((-122.1, 37.4), abs=1e-6)
    assert geo.haversine_km(-0.1278, 51.5074, 2.3522, 48.8566) == pytest.approx(343.5, abs=1)
    assert geo.distance_metres("2km") == 2000 and geo.parse_point("51.5,-0.1") == (-0.1, 51.5)
    square = {"type": "polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}
    point = lambda x, y: {"type": "point", "coordinates": [x, y]}
    assert geo.relate(point(3, 3), square, "within") and not geo.relate(point(1.5, 1.5), square, "within")
    assert geo.relate(square, point(3, 3), "contains") and geo.relate({"type": "linestring", "coordinates": [[-1, 3], [5, 3]]}, square, "intersects")
    assert not geo.relate({"type": "linestring", "coordinates": [[-1, 3], [5, 3]]}, square, "within")


def test_vectors():
    assert vectors.decode_base64("AACAPwAAAEA=") == [1.0, 2.0]
    with pytest.raises(ValueError):
        vectors.decode_base64("AACA")


STRINGS = [
    ("a", [("should", "match", None)]),
    ("+a -b c", [("must", "match", None), ("must_not", "match", None), ("should", "match", None)]),
    ('f:"a b"', [("should", "match_phrase", "f")]),
    ("f:/x+/", [("should", "regexp", "f")]),
    ("w*ld", [("should", "wildcard", None)]),
    ("a~2", [("should", "match", None)]),
    ("n:>=3", [("should", "numeric_range", "n")]),
    ('d:<"2020-01-01"', [("should", "date_range", "d")]),
    ("5", [("should", "disjunction", None)]),
    (r"a\:b", [("should", "match", None)]),
]


@pytest.mark.parametrize(("text", "want"), STRINGS, ids=[x[0] for x in STRINGS])
def test_query_strings(text, want):
    q = parse_query_string(text)
    got = [(s, c.kind, c.field) for s in ("must", "must_not", "should") if isinstance(q[s], Query) for c in q[s].children]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_string_details():
    one = lambda text: parse_query_string(text)["should"].children[0]
    assert one("a^2.5").boost == 2.5 and one("a~")["fuzziness"] == 1 and one("a~2")["fuzziness"] == 2
    assert one(r"a\:b")["match"] == "a:b" and one("f:-5").children[1]["min"] == -5
    assert one("n:<7").args == {"max": 7.0, "inclusive_max": False}


def test_walk():
    m = IndexMapping.of({"default_mapping": {"dynamic": False, "properties": {"a": {"dynamic": True}, "b": {"fields": [{"type": "text", "name": "c", "index": False}, {"type": "number"}]}, "off": {"enabled": False}}}})
    doc = {"a": {"x": [1, "two", True, None, {"y": "2020-01-01"}]}, "b": "text", "off": {"z": 1}, "unknown": 1}
    rows = [(r[4], r[5], r[6]) for r in Walker(m).rows("i", 0, doc)]
    assert rows == [("a.x", [0], "number"), ("a.x", [1], "text"), ("a.x", [2], "boolean"), ("a.x.y", [4], "datetime"), ("c", [], "text")]
    assert json.loads(m.to_json())["default_mapping"]["properties"]["b"]["fields"][0]["name"] == "c"
    assert IndexMapping.of(m.to_json()).to_json() == m.to_json()
