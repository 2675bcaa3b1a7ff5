"""Command line: python -m searchlake.cli COMMAND PATH ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from searchlake.functions.analysis import Registry
from searchlake.operators.search import search
from searchlake.sources.index import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="searchlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {
        "create": ["--mapping"], "index": ["files*"], "bulk": ["files*", "--id"], "query": ["text", "--size", "--sort"], "request": ["file"], "count": [], "fields": [],
        "dictionary": ["field", "--prefix"], "mapping": [], "dump": ["--id"], "check": [], "versions": [], "rollback": ["version"], "delete": ["ids*"], "registry": [],
        "dump-fields": ["--id"], "segments": [], "deleted": ["segment"], "segment": ["segment"], "terms": ["segment", "--field"],
    }.items():
        own = sub.add_parser(name)
        if name != "registry":
            own.add_argument("path")
        for a in more:
            own.add_argument(a.rstrip("*"), **({"nargs": "+"} if a.endswith("*") else {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "registry":
        own = Registry()
        print(json.dumps({"analyzers": sorted(own.chains), "tokenizers": sorted(own.tokenizers), "char_filters": sorted(own.char_filters), "token_filters": sorted(own.token_filters), "token_maps": sorted(own.token_maps)}, indent=1))
        return 0
    spark = spark or SparkSession.builder.appName("searchlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.path)
    if a.command == "create":
        Store.create(spark, a.path, json.load(open(a.mapping)) if a.mapping else {})
    elif a.command == "index":  # one JSON document per file, named by the file
        files = spark.read.option("wholetext", True).text(list(a.files)).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("doc_id"), F.col("value").alias("source"))
        print(store.batch(files))
    elif a.command == "bulk":  # one JSON document per line
        lines = spark.read.text(list(a.files)).where("value <> ''")
        key = F.get_json_object("value", f"$.{a.id}") if a.id else F.sha2("value", 256)
        print(store.batch(lines.select(key.alias("doc_id"), F.col("value").alias("source"))))
    elif a.command in ("query", "request"):
        request = {"query": {"query": a.text}, "size": int(a.size or 10), "sort": json.loads(a.sort) if a.sort else None} if a.command == "query" else json.load(open(a.file))
        got = search(store.open(), request)
        print(json.dumps({"total": got.total, "max_score": got.max_score, "hits": got.hits, "facets": got.facets}, indent=1, default=str))
    elif a.command == "count":
        print(store.open().count)
    elif a.command == "fields":
        print("\n".join(r[0] for r in store.open().fields().collect()))
    elif a.command == "dictionary":
        for r in store.open().field_dict(a.field, prefix=a.prefix).toLocalIterator():
            print(r["term"], r["df"])
    elif a.command == "mapping":
        print(store.mapping().to_json())
    elif a.command == "dump":
        rows = store.open().values
        for r in (rows.where(F.col("doc_id") == a.id) if a.id else rows).toLocalIterator():
            print(json.dumps({k: v for k, v in r.asDict().items() if v is not None}, default=str))
    elif a.command == "check":  # every posting belongs to a document, and counts agree with the dictionary
        own = store.open()
        lost = own.postings.join(own.docs, "doc_id", "left_anti").count()
        counted = own.postings.groupBy("field", "term").agg(F.count("*").alias("n"))
        wrong = counted.join(own.dictionary, ["field", "term"], "full").where("not (n <=> df)").count()
        print(f"postings without a document: {lost}; wrong counts: {wrong}")
        return int(bool(lost or wrong))
    elif a.command == "dump-fields":  # the terms of each field, by document
        rows = store.open().postings
        for r in (rows.where(F.col("doc_id") == a.id) if a.id else rows).groupBy("doc_id", "field").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("doc_id", "field").toLocalIterator():
            print(r["doc_id"], r["field"], " ".join(r["terms"]))
    elif a.command == "segments":
        for x in store.segments():
            print(json.dumps(x))
    elif a.command in ("deleted", "segment", "terms"):
        every = store.segments()
        at = next(i for i, x in enumerate(every) if x["n"] == int(a.segment))
        read = lambda name: spark.read.parquet(f"{store._at(every[at])}/{name}")
        if a.command == "deleted":  # documents of the segment that later ones replace
            dead = store._dead(every[at + 1 :])
            for r in read("docs").join(dead, "doc_id", "left_semi").orderBy("doc_id").toLocalIterator() if dead is not None else ():
                print(r["doc_id"])
        elif a.command == "segment":
            print(json.dumps({t: read(t).count() for t in ("docs", "values", "postings", "terms")}))
        else:
            rows = read("terms")
            for r in (rows.where(F.col("field") == a.field) if a.field else rows).orderBy("field", "term").toLocalIterator():
                print(r["field"], r["term"], r["df"])
    elif a.command == "versions":
        print(*store.versions())
    elif a.command == "rollback":
        store.rollback(int(a.version))
    elif a.command == "delete":
        print(store.delete(*a.ids))
    return 0


if __name__ == "__main__":
    sys.exit(main())
