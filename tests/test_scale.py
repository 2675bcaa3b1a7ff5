"""What an index and its queries hold or move at once stays in bounds."""

import pandas as pd
from pyspark.sql import functions as F

from searchlake import catalog
from searchlake.functions import analysis
from searchlake.plans.compiler import Compiler
from searchlake.plans.query import parse
from searchlake.sources import index as ix
from searchlake.sources.mapping import FieldMapping, IndexMapping

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _columns(spark, rows):
    fields = {"a": FieldMapping(analyzer="words"), "b": FieldMapping(analyzer="keyword"), "n": FieldMapping("number")}
    return ix.Index.from_columns(spark.createDataFrame(rows, "id long, a string, b string, n double"), "id", fields, mapping=catalog._words_mapping(), with_all=True)


def test_texts_are_shuffled_not_tokens(spark):
    """The only shuffle stands below everything that makes tokens."""
    plan = _plan(_columns(spark, [(1, "x y", "z", 1.0)]).postings)
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") > plan.rindex("Generate explode")


def test_postings_of_repeated_ids_and_fields(spark):
    rows = _columns(spark, [(1, "x y x", "x", 1.0), (1, "y", None, 2.0), (2, None, "x", None)]).postings.collect()
    assert {(r["doc_id"], r["field"], r["term"]): (r["freq"], r["len"]) for r in rows} == {("1", "a", "x"): (2, 4), ("1", "a", "y"): (2, 4), ("1", "b", "x"): (1, 1), ("2", "b", "x"): (1, 1), ("1", "_all", "x"): (3, 5), ("1", "_all", "y"): (2, 5), ("2", "_all", "x"): (1, 1)}


def test_values_of_columns_are_written_as_they_come(spark, tmp_path):
    own = _columns(spark, [(i, f"w{i}", "k", float(i)) for i in range(50)])
    ix.write_tables(own, str(tmp_path))
    back = ix.read_tables(spark, str(tmp_path), own)
    per_file = back.values.groupBy(F.input_file_name()).agg(F.count_distinct("field").alias("k")).collect()
    assert {r["k"] for r in per_file} == {1} and back.values.count() == 150
    assert not (tmp_path / "unsorted").exists()


def test_partitions_follow_bytes_while_writing(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    with ix.writing(spark):
        assert spark.conf.get(key) == "4m"
    assert spark.conf.get(key) == before


def test_a_phrase_groups_once(spark):
    plan = _plan(catalog.q_phrase(spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_phrases_keep_to_one_value(spark):
    docs = spark.createDataFrame([("1", '{"t": ["a b", "c d"]}'), ("2", '{"t": ["b c"]}'), ("3", '{"t": ["c", "b c"], "u": "b"}')], "doc_id string, source string")
    own = ix.Index.from_json(docs, IndexMapping(default_analyzer="simple"))
    ids = lambda f: {r[0] for r in Compiler(own).hits(parse({"terms": ["b", "c"], "field": f})).collect()}
    assert ids("t") == {"2", "3"} and ids("_all") == {"2", "3"}


def test_field_rows_come_in_bounded_frames():
    docs = pd.DataFrame({"doc_id": [str(i) for i in range(7000)], "seq": 0, "source": ['{"a": "x", "b": 2}'] * 7000})
    sizes = [len(f) for f in ix.walked(iter([docs]), IndexMapping())]
    assert sum(sizes) == 14000 and max(sizes) <= ix.BATCH_ROWS + 1


def test_terms_by_word_equal_terms_by_text():
    texts = [None, "", "It's O'Neil's 3.14 a_b __ x.y.z 1,000.5; don’t l’été ÀÉÎ×2 Straße", "naïve — “Größe” 10·2", "漢字かな カナ 한글 e\u0301t\u0301 a\u00adb 1٣", "the THE The"]
    for name in ("standard", "en", "de", "fr", "es", "simple"):
        own = analysis.analyzer(name)
        pairs = own._pairs()
        assert pairs.__name__ == "fast"
        for text in texts * 2:
            terms, places = [], []
            pairs(text, terms, places)
            assert list(zip(terms, places, strict=True)) == [(t.term, t.pos) for t in own.tokens(text)]


def test_batches_of_terms_are_closed(spark, monkeypatch):
    monkeypatch.setattr(analysis, "BATCH_TERMS", 3)
    df = spark.createDataFrame([(i, "a b c d" if i % 2 else None) for i in range(9)], "i long, s string")
    own = analysis.Analyzer("own", analysis.letter_tokenizer, (analysis.to_lower,), (analysis.html_filter,))
    got = df.select("i", F.expr("s"), own.column(F.col("s")).alias("t")).collect()
    assert all([t["term"] for t in r["t"]] == (list("abcd") if r["i"] % 2 else []) for r in got)
