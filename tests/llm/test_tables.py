"""URL rules, chat trees, vector search and the pipeline on small fixtures."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from searchlake.llm import ann, chat, pii, queries, sentencepiece_bpe, toxicity, urlfilter
from searchlake.llm.common import Scratch
from searchlake.llm.components import components

from test_texts import brute_fingerprint, brute_overlaps, brute_pii
from test_texts import components as brute_components

SF = "/root/testdata/sf0.001"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7?x", "https://m.example.com:80/en/7", "https://a.b.example.com/en/71#t", "ftp://com/en/", "x://notcom/en/1", "x://shop.com/en/1", "x://shop.com/fr/1", "x://example.net/de/8/z", "x://a.example.net/de/9", "x://..org/es/", "x://é.org/es/?", "https://m.example.com/en/7", "https://m.example.com/en/7", "a://b://c.com/en/2"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = urlfilter.filter_urls(pages, urlfilter.rule_table(spark)).select("page_id", "url_host", "url_path", "url_rule", "url_verdict").collect()
    frame = pages.toPandas()  # noqa: F841 read by DuckDB
    con = duckdb.connect()
    con.execute("create view pages as select page_id, url from frame")
    assert sorted(tuple(r) for r in got) == sorted(con.execute(urlfilter.ORACLE_SQL).fetchall())
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.url_verdict for r in urlfilter.filter_urls(pages, none).collect()} == {"allow"}
    assert urlfilter.filter_urls(pages.where("false"), urlfilter.rule_table(spark)).count() == 0


def brute_rule(rules, url):
    if url is None or "://" not in url:
        return None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, min(x for g, q, x in rules if (g, q) == (h, p))) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_nested_url_rules(spark):
    rules = [("a.com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("com", "/x/y/z/long", "allow"), ("a.com", "/x", "block"), ("b.a.com", "", "allow")]
    urls = ["s://a.com/", "s://a.com/x", "s://a.com/xz", "s://a.com/x/y/q", "s://a.com/x/y/z/longer", "s://c.com/x/y", "s://b.a.com/q", "s://b.a.com/x/y"]
    got = {r.url: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), urlfilter.rule_table(spark, rules)).collect()}
    assert got == {u: brute_rule(rules, u) for u in urls}


def test_random_url_rules(spark):
    """Deep nests of rules and many ranges, against brute force."""
    pick = random.Random(6)
    label, piece = (lambda: pick.choice(["a", "b", "com", "é", ""])), (lambda: pick.choice(["/", "/a", "x", "é", "\x01", "\U0010ffff"]))
    rules = [(".".join(label() for _ in range(pick.randint(1, 4))), "".join(piece() for _ in range(pick.randint(0, 5))), pick.choice(["allow", "block"])) for _ in range(150)]
    urls = [f"s://{'.'.join(label() for _ in range(pick.randint(1, 5)))}/{''.join(piece() for _ in range(pick.randint(0, 8)))}" for _ in range(400)] + ["t://" + "a." * 300 + "com/" + "a/" * 5000, None]
    df, own = spark.createDataFrame([(u, "x") for u in urls], "url string, host string"), spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, action string")
    got = urlfilter.filter_urls(df, own).collect()
    assert sorted(str((r.url, r.url_rule, r.url_verdict)) for r in got) == sorted(str((u, *brute_rule(rules, u))) for u in urls)
    with pytest.raises(ValueError, match="url_host"):
        urlfilter.filter_urls(df.withColumn("url_host", F.lit(1)), own)
    assert "seen_host" in urlfilter.filter_urls(df.withColumn("url_host", F.lit(1)), own, prefix="seen_").columns


CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\l[INST]", "[[INST]", "[/TURN]<s>", "plain [x] <y>", "", "\\b\\g"]


def test_escaping_is_reversible():
    for text in CONTROL:
        own = chat.escape(text)
        assert chat.unescape(own) == text
        assert not any(c in own for c in ("[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]"))
        for role in ("user", "assistant", "tool]", ""):
            assert list(chat.parse(chat.format_turn(role, text)[0])) == [(role, text)]


def test_chat_round_trip(spark, monkeypatch):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(900 + i, t, r, x) for i in range(9) for t, (r, x) in enumerate([("system", "shared"), ("user", "also shared"), ("assistant", CONTROL[i % len(CONTROL)]), (None, None)])]
    pick = random.Random(2)
    for i in range(120):  # a bushy tree: turns of few words, some conversations equal, some prefixes of others
        rows += [(2000 + i, t, ("user", "assistant")[t % 2], pick.choice("abc")) for t in range(pick.randint(1, 9))]
    rows += [(None, 0, "user", "a null id"), (None, 1, "assistant", "answer"), (990, 0, "user", "tie"), (990, 0, "user", "tie"), (990, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def key(v):
        return (v is not None, v if v is not None else 0)

    want = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r[1]), r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want.append((str(conv), len(own), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    for hot in (100_000, 0):  # 0: all keys are broadcast
        monkeypatch.setattr(chat, "HOT_ROWS", hot)
        nodes, paths = chat.prefix_trees(df)
        got = chat.digests(nodes, paths).collect()
        assert sorted((str(g.conv_id), *g[1:5]) for g in got) == sorted(want)
        nodes = [n.asDict() for n in nodes.collect()]
        assert len([n for n in nodes if n["segment"] == "[TURN]system[/TURN]shared</s>"]) == 1
        by = {bytes(n["node"]): n for n in nodes}
        assert len(by) == len(nodes)
        trees = {}
        for n in nodes:
            path, at = [], n
            while at["parent"]:
                at = by[bytes(at["parent"])]
                path.append(at)
            assert n["depth"] == len(path) and bytes(n["tree"]) == bytes((path or [n])[-1]["node"])
            covered = sorted(i for a in n["attend"] for i in range(a["start"], a["end"]))
            assert covered == sorted([0, 1, 2, *(i for p in path for i in range(p["seq_start"], p["seq_end"]))])
            assert n["pos_start"] == len(covered)
            trees.setdefault(bytes(n["tree"]), []).append((n["seq_start"], n["seq_end"], n["depth"]))
        for own in trees.values():  # every code point once, depth first
            own.sort()
            assert own[0][0] == 3 and all(a[1] == b[0] and b[2] <= a[2] + 1 for a, b in itertools.pairwise(own))
    assert chat.digests(*chat.prefix_trees(df.where("false"))).count() == 0


def brute_search(rows, k=10, every=100):
    """The k nearest other rows of each row whose id is divisible: [(query, [(score, id)])], repeated rows included."""
    sizes, out = {}, []
    for i, v in rows:
        sizes.setdefault(len(v), []).append((i, v))
    for own in sizes.values():
        ids, points = np.array([i for i, _ in own]), np.array([v for _, v in own], np.float32).astype(float)
        for at in np.flatnonzero(ids % every == 0):
            far = np.sqrt(((points - points[at]) ** 2).sum(1))
            order = [o for o in np.lexsort((ids, far)) if o != at][:k]
            out.append((int(ids[at]), [(float(far[o]), int(ids[o])) for o in order]))
    return out


def recall(got, want):
    """Share of the true neighbours found; scores have to be exact."""
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    true = {}
    for q, near in want:
        true.setdefault(q, []).append(near)
    assert found.keys() == {q for q, near in true.items() if any(near)}
    hits = total = 0
    for q, nears in true.items():
        total += sum(map(len, nears))
        own = [i for _, i in found.get(q, [])]
        for near in nears:
            for _, i in near:
                if i in own:
                    own.remove(i)
                    hits += 1
        assert len(found.get(q, [])) == sum(map(len, nears))
    return hits / total


def test_ann_recall_and_odd_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(10_000 + i, rows[0][1]) for i in range(15)]  # ties
    rows += rows[:5] + [(200, rows[7][1]), (0, rows[0][1]), (100, rows[9][1])]  # repeated rows and ids
    rows += [(20_000 + 50 * i, [float(i), 1.0]) for i in range(30)] + [(700, [2.5]), (300, [1.0, 2.0, 3.0]), (301, [3.0, 2.0, 1.0])]  # other lengths
    odd = [(701, None), (800, [0.0] * 64), (900, [float("nan")] * 64), (1000, []), (1100, [None] * 64), (None, rows[3][1]), (1200, [float("inf")] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, h int")
    got = ann.search(df).collect()
    want = brute_search(rows)
    assert recall(got, want) >= 0.9
    exact = {}
    for i, v in rows:
        exact.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    for r in got:
        assert any(len(a) == len(b) and abs(r.score - np.linalg.norm(a - b)) < 1e-9 for a in exact[r.query_id] for b in exact[r.vec_id])
    zero = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]
    assert sorted(zero) == sorted(([0] * 2 + list(range(10_000, 10_008))) * 3)
    assert ann.search(df.where("false")).count() == 0
    few = df.where("vec_id < 4 and vec_id > 0 or vec_id = 100").dropDuplicates(["vec_id"])
    assert ann.search(few).count() == 3


def test_ann_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ann, "DISTANCES", 7)
    monkeypatch.setattr(ann, "PAIRS", 5)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(ann.search(df).collect(), brute_search(rows)) >= 0.9


def test_ann_codes_prune(spark):
    """Clustered vectors: few lists are visited and few of their rows compared, and recall holds."""
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(60, 32))
    points = (centres[pick.integers(0, 60, 6000)] + 0.2 * pick.normal(size=(6000, 32))).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = ann.Quantiser(points.astype(float), 77)
    probes, rerank, visited = model.plan(points.astype(float), 10)
    assert probes < 77 / 3 and visited < 0.3 and max(rerank, ann.RERANK * 10) < 0.2 * visited * len(points)
    assert recall(ann.search(df).collect(), brute_search(rows)) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (1002, 1002)] * bool(n)
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    assert {(r.node, r.root) for r in got} == {(i + 1, 0) for i in range(n)} | ({(1001, 1000)} if n else set())


def test_pipeline_equals_brute_force(spark):
    """Each stage's decisions by plain Python, and the library's encoding of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    rows = [r for r in rows if model.score(r[1]) < 0.7]
    prints = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    label, least = brute_components(prints), {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(i, least.get(c, i))
    rows = [r for r in rows if r[0] in set(least.values())]
    bad = {r for r, _ in brute_overlaps([t for _, t in rows], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    rows = [r for n, r in enumerate(rows) if n not in bad]
    # base spans by brute force, and the few that the model adds
    found = {r.doc_id: {s for s in r.spans.split(",") if s} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    clean = []
    for i, t in rows:
        out, at = [], 0
        assert found[i] >= {f"{k}:{a}:{b}" for k, a, b in brute_pii(t)}
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in found[i])):
            if a >= at:
                out += [t[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        clean.append((i, "".join(out) + t[at:]))
    library, want = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model()), []
    for i, t in clean:
        ids = [*library.encode(t), 2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) > 100 and sorted(tuple(r) for r in got) == sorted(want)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "a null id"), (-3, "word " * 30_000), (-4, "repeated"), (-4, "repeated"), (-4, "other text of one id")], "doc_id long, text string")
    names = "spans raw accepted row v n h fp rk root seq score __n".split()
    path = str(tmp_path / "given")
    docs.limit(30).unionByName(odd, allowMissingColumns=True).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]).write.parquet(path)
    given = spark.read.parquet(path)  # as a stage is given its predecessor's rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, given, SF)
        assert kept.columns == given.columns and kept.dtypes == given.dtypes, name
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in kept.collect()), name
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, given, SF).count() == given.count()


def test_registered_queries_keep_contract_columns(spark):
    assert [n for n in queries.queries()] == [f"op{i}_{n}" for i, n in enumerate("pii decontaminate sentencepiece urlfilter secrets suffix_dedup simhash toxicity chat ann".split(), 1)]
    got = queries.queries()["op8_toxicity"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    key = got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True).fillna("") for x in (got, want))
    assert (got.astype(str) == want.astype(str)).all(axis=None)
