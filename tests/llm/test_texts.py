"""Text operators against brute force, on small fixtures with nulls, ties and odd texts."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from searchlake.llm import decontaminate, pii, secrets, sentencepiece_bpe, simhash, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (-1, None),
    (-2, ""),
    (-3, " "),
    (-4, "x"),
    (-5, "▁ tabs\tand\nlines  \x00 é漢😀"),
    (-6, "a" * 3000),
    (-7, "the same words " * 400),
    (-8, "the same words " * 400),
    (-8, "the same words " * 400),
    (None, "a null id with a@b.example.com in it"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows + ODD], "doc_id long, text string, spans string, rk int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_sentencepiece_equals_library(docs, empty):
    path = sentencepiece_bpe.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = docs.select("doc_id", "text").collect()
    got = sentencepiece_bpe.encode_documents(docs, path, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), [*library.encode(r.text or ""), 2]) for r in rows)
    assert sorted((str(g.doc_id), g.ids) for g in got) == want
    for g in got:
        assert g.n_tokens == len(g.ids) and g.decoded == library.decode(g.ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, g.ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(g.decoded.encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(empty, path).count() == 0


def test_sentencepiece_random_strings():
    path = sentencepiece_bpe.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.PieceModel(path)
    pick = random.Random(5)
    for _ in range(800):
        text = "".join(pick.choice("ab the\n\t▁ é漢字😀<s>0x41>\x00İ...---") for _ in range(pick.randint(0, 50)))
        ids = own.encode(text)
        assert ids == [*library.encode(text), 2]
        assert own.decode(ids) == library.decode(ids)


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        twice = [2 * x - 9 * (x > 4) for x in d[-2::-2]]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PERSONAL = [
    "a@b.com_x@y.org a@b", "1.2.3.4.5 999.1.1.1 01.002.3.255 1.2.3 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 25,
    "call +44 20 7946 0958 now +1 2 +123", "tel (017) 555-7713 card 5555 5555 5555 4440", "é😀é x@y.zz ü 5555555555554444",
    "joe (at) mail (dot) com", "+1(2)3-4567890-", "a" * 500 + "@" + "b.c" * 300, "1 " * 400, "..@..", "x@y.z" * 50,
]


def test_pii_base_spans(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(PERSONAL)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(g.doc_id), g.base_sha256) for g in got) == want
    texts = dict(rows)
    for g in got:
        spans = [s for s in g.spans.split(",") if s]
        base = [f"{k}:{a}:{b}" for k, a, b in brute_pii(texts[g.doc_id] or "")]
        assert set(base) <= set(spans) and len(spans) == len(base) + g.n_added
        assert g.n_email + g.n_ip + g.n_card + g.n_phone == len(base)
    assert pii.find_pii(empty).count() == 0


def test_pii_classifier_learns_from_votes():
    patterns = [("card", (1, 1, 1, 1), 50), ("card", (0, 1, 1, 1), 20), ("card", (0, 0, 0, 0), 60), ("card", (-1, -1, -1, 0), 5)]
    belief = pii.reliabilities(patterns)
    assert belief["card", (1, 1, 1, 1)] > 0.9 > 0.1 > belief["card", (0, 0, 0, 0)]
    model = pii.classifier([(k, v, [i % 7]) for k, v, n in patterns for i in range(n)], belief)
    assert pii.probability(model, "card", (1, 1, 1, 1), [3]) > 0.5 > pii.probability(model, "card", (0, 0, 0, 0), [3])


def planted_pii(seed=1):
    """Texts with personal data that no base pattern finds, and look-alikes that aren't personal data."""
    pick = random.Random(seed)
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    word = lambda: "".join(pick.choices("abcdefghijklmnoprstuvw", k=pick.randint(3, 8)))
    good, bad = [], []
    for i in range(60):
        good.append((f"{word()} {word()}. please call ", f"({digits(3)}) {digits(3)}-{digits(4)}", f" {word()}", "phone"))
        good.append((f"{word()} my phone ", f"{digits(3)}-{digits(3)}-{digits(4)}", f", {word()}", "phone"))
        good.append((f"{word()} contact ", f"{word()} (at) {word()} (dot) com", f" {word()}", "email"))
        good.append((f"{word()} email: ", f"{word()}.{word()}[at]{word()}.org", f" {word()}", "email"))
        bad.append((f"{word()} {word()} order no ", f"{digits(3)}-{digits(3)}-{digits(4)}", f" {word()}", "phone"))
        bad.append((f"{word()} invoice ", "9" + digits(12) + "x", f"{word()}", "card"))
        bad.append((f"{word()} isbn ", "978" + digits(10), f" {word()}", "card"))
    return good, bad


def test_pii_added_spans(spark):
    """What the votes and the classifier add, against planted truth."""
    good, bad = planted_pii()
    base = [f"mail to {w}@{w}.com or call +1 202 555 01{i:02d} from 81.2.69.{i}, card 4111 1111 1111 1111" for i, w in enumerate(["ana", "bob", "cleo"] * 30)]
    rows = [(i, b + m + a) for i, (b, m, a, _) in enumerate(good + bad)] + [(1000 + i, t) for i, t in enumerate(base)]
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: f"{k}:{len(b)}:{len(b) + len(m)}" for i, (b, m, _, k) in enumerate(good)}
    brute = {i: {f"{k}:{a}:{b}" for k, a, b in brute_pii(t)} for i, t in rows}
    hit = sum(s in got[i] for i, s in want.items())
    wrong = sum(len(got[i] - brute[i] - {want.get(i)}) for i, _ in rows)
    print("recall", hit / len(want), "precision", hit / (hit + wrong))
    assert hit >= 0.9 * len(want) and wrong <= 0.05 * hit


def test_pii_many_matches(spark):
    """20,000 matches in one text take seconds, and their offsets and what redaction leaves are right."""
    text = " ".join(f"u{i}@ex{i % 7}.com" + (" (017) 555-7713 é😀" if i % 50 == 0 else "") for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "short a@b.cd")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert time.time() - began < 60
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(text)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    want, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[1].spans.split(","))), key=lambda s: s[1:]):
        want += [text[at:a], f"<{kind.upper()}>"]
        at = b
    assert clean == {1: "".join(want) + text[at:], 2: "short <EMAIL>"}


def test_pii_redaction(spark):
    rows = [(1, "mail é x@y.com now", "s1", 1), (2, None, None, 2), (3, "nothing", "s3", None), (3, "nothing", "s3", None), (4, "", "s", 0), (5, "+1 202 555 0100@b.com, x", "t", 5)]
    df = spark.createDataFrame([r + r[2:] for r in rows], "doc_id long, text string, spans string, raw int, accepted string, row int")
    got = pii.redact(df)
    assert got.dtypes == df.dtypes
    clean = {"mail é x@y.com now": "mail é <EMAIL> now", "+1 202 555 0100@b.com, x": "<PHONE>, x"}
    want = sorted(str((r[0], clean.get(r[1], r[1]), *r[2:], *r[2:])) for r in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert pii.redact(df.where("false")).count() == 0


def test_secrets_base_spans(docs, empty):
    got = secrets.find_secrets(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)

    def brute(text):
        out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return ",".join(s for _, _, s in sorted(out))

    want = sorted((str(r.doc_id), hashlib.sha256(brute(r.text or "").encode()).hexdigest()) for r in texts)
    assert sorted((str(g.doc_id), g.base_sha256) for g in got) == want
    assert secrets.find_secrets(empty).count() == 0


def planted_secrets(seed=4):
    """Texts with keys that no base pattern finds, and long names that aren't secrets."""
    pick = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, of=letters: "".join(pick.choices(of, k=n))
    shapes = [lambda: key(40), lambda: "ghp_" + key(36), lambda: "sk_live_" + key(24), lambda: "AIza" + key(35, letters + "-_"), lambda: key(32, "abcdefghijklmnopqrstuvwxyz0123456789"), lambda: key(44, letters + "+/") + "=="]
    names = ["getDatabaseConnectionPoolSize", "number_of_retry_attempts", "org/apache/commons/logging/impl", "Content-Disposition-Filename", "internationalization", "user-account-settings-page", "MAXIMUM_HEADER_LENGTH", "2024-01-15T10-22-33", "0000000000000000", "----------------"]
    good = [f"the value {s()} was there" for s in shapes for _ in range(30)]
    bad = [f"the value {n} was there" for n in names for _ in range(3)] + ["http://example.com/articles/archive/category/introduction"]
    return good, bad


def test_secrets_added_spans(spark):
    """What the models add, against planted truth; models are trained on texts of their own."""
    good, bad = planted_secrets()
    rows = [(i, t) for i, t in enumerate(good + bad)]
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model=secrets.fit()).collect()}
    hit = sum(found[i].spans == f"random:10:{len(t) - 10}" for i, t in enumerate(good))
    wrong = sum(found[len(good) + i].n_random for i in range(len(bad)))
    print("recall", hit / len(good), "precision", hit / (hit + wrong))
    assert hit >= 0.9 * len(good) and wrong <= 0.02 * hit


def test_secret_model_separates():
    model = secrets.fit()
    held = secrets.random_strings(300, seed=99)
    assert sum(model.secret(t) for t in held if not t.isdigit()) > 0.9 * len(held)
    names = ["getDatabaseConnectionPool", "number_of_open_files_limit", "org/apache/commons/logging", "thentionerheonandstre"]
    assert not any(model.secret(t) for t in names)
    text = 'x TOKEN: "abc" apikey=abcdef AKIA' + "Z" * 16 + " zR8kQ2vX9pL4mT7wB3nY6c"
    assert [k for _, _, k in secrets.base_spans(text)] == ["assign", "access"]


def test_suffix_dedup_equals_brute_force(spark, docs, empty):
    pick = random.Random(3)
    passage = "".join(pick.choice("abcdefgh ") for _ in range(350))
    extra = [(2000 + i, "".join(pick.choice("xyz ") for _ in range(pick.randint(0, 300))) + passage[pick.randint(0, 60) : pick.randint(250, 350)] + str(i)) for i in range(12)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = {}
    for _, t in raw:
        for p in range(len(t) - 199):
            counts[t[p : p + 200]] = counts.get(t[p : p + 200], 0) + 1
    want = []
    for i, t in raw:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if counts[t[p : p + 200]] > 1:
                cover[p] += 1
                cover[p + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((str(i), len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    assert sorted((str(g.doc_id), *g[1:]) for g in got) == sorted(want)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    pick = random.Random(4)
    a = "".join(pick.choice("abcdefgh ") for _ in range(1500))
    data = np.frombuffer(a.encode(), np.uint8)
    x, lo, hi, _ = suffix_dedup.anchors(data)
    assert lo[0] == 0 and hi[-1] == len(a) - 200 and (lo[1:] == hi[:-1] + 1).all() and (x >= hi).all() and (x <= lo + 168).all()


def test_suffix_dedup_long_texts(spark):
    cut, pick = suffix_dedup.PIECE, random.Random(5)
    unique = "".join(pick.choices("abcdefghijklmnop", k=2 * cut + 5000))
    passage = "".join(pick.choices("abcdefghijklmnop", k=700))
    crossed = unique[5000 : cut + 4700][::-1] + passage + unique[:3000][::-1]  # the passage lies over a cut
    rows = [(1, unique), (2, crossed), (3, "before " + passage + " after"), (4, crossed[-900:] + "z")]
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = {}
    for _, t in rows:
        for p in range(len(t) - 199):
            w = hash(t[p : p + 200])
            counts[w] = counts.get(w, 0) + 1
    for i, t in rows:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if counts[hash(t[p : p + 200])] > 1:
                cover[p] += 1
                cover[p + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        rest = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (gone.sum(), hashlib.sha256(rest.encode()).hexdigest())
    assert got[1].n_removed == 0 and got[3].n_removed == 700


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    label = np.arange(len(prints))
    while True:
        new = np.array([label[apart[i] <= 4].min() for i in range(len(prints))])
        if (new == label).all():
            return label
        label = new


def test_simhash_components(docs, empty):
    rows = docs.collect()
    got = simhash.near_duplicates(docs.where("doc_id is not null")).collect()

    rows = [r for r in rows if r.doc_id is not None]
    prints = np.array([brute_fingerprint(r.text or "") for r in rows], np.uint64)
    label = components(prints)
    least = {c: min(r.doc_id for r, k in zip(rows, label, strict=True) if k == c) for c in set(label)}
    want = sorted((r.doc_id, f"{int(p):016x}", least[c]) for r, p, c in zip(rows, prints, label, strict=True))
    assert sorted(tuple(g) for g in got) == want
    kept = simhash.drop_near_duplicates(docs.where("doc_id is not null")).collect()
    assert sorted(k.doc_id for k in kept) == sorted(least.values())
    assert kept[0].asDict().keys() == rows[0].asDict().keys()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_links_random_balls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", 1 << 14)
    monkeypatch.setattr(simhash, "MAX_VARIANTS", 1 << 13)
    pick = np.random.default_rng(0)
    values = set()
    for centre in pick.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(5):
            v = int(centre)
            for b in pick.choice(64, pick.integers(0, 7), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    prints = np.array(sorted(values), np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long"), len(prints)).collect()
    at = {int(v): i for i, v in enumerate(prints.view(np.int64))}
    found = simhash._roots(len(prints), np.array([at[e.u] for e in edges], int), np.array([at[e.v] for e in edges], int))
    assert (found == components(prints)).all()


def brute_overlaps(docs, items):
    """(row of docs, item) where a window of the item is in the document, by comparing all of them."""
    ids = {}

    def numbers(text):
        return np.array([ids.setdefault(w, len(ids)) for w in decontaminate.tokens(text or "")], int)

    texts, out = [numbers(t) for t in docs], []
    for n, item in enumerate(map(numbers, items)):
        w = min(12, len(item))
        for row, doc in enumerate(texts):
            if w and len(doc) >= w:
                same = doc[:, None] == item[None, :]
                total = sum(same[k : len(doc) - w + 1 + k, k : len(item) - w + 1 + k].astype(int) for k in range(w))
                if (5 * total >= 4 * w).any():
                    out.append((row, n))
    return out


def test_decontamination_equals_brute_force(spark, docs, empty):
    given = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    texts = {r.item_id: r.text for r in given.collect()}
    words = next(t for t in texts.values() if len(t.split()) >= 30).split()
    changed = " ".join("zzz" if i % 9 == 4 else w for i, w in enumerate(words))
    few = [(900, "What is the capital"), (901, "uncommonword"), (None, "an item without id"), (900, "What is the capital"), (902, None), (903, "!"), (900, "of another text")]
    items = given.unionByName(spark.createDataFrame(few, "item_id long, text string")).withColumn("start_token", F.lit(1))
    planted = [
        (500, "some other words before " + " ".join(words) + "&&& after"), (501, "filler " * 30 + changed), (502, None), (503, " ".join(words[:8]) + " then unrelated text follows"),
        (1, "one of two equal rows: what is the CAPITAL?"), (1, "one of two equal rows: what is the CAPITAL?"), (None, "uncommonword"), (None, "an item without id, uncommonword"), (None, "an item with id"),
        (504, "what is not the capital"), (505, "uncommonword " * 3000), (506, " ".join(words) + " w" * 3000 + " " + changed),
    ]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string")).withColumn("seq", F.lit("x"))
    rows, kinds = every.collect(), {(r.item_id, r.text) for r in items.collect()}
    kinds = sorted(kinds, key=str)
    brute = brute_overlaps([r.text for r in rows], [t for _, t in kinds])
    want = sorted(str((rows[r].doc_id, kinds[i][0])) for r, i in brute)
    assert len(want) >= 11
    got = [decontaminate.contaminated(every, items, broadcast_seeds=bound).collect() for bound in (decontaminate.BROADCAST_SEEDS, 0)]
    assert sorted(str(tuple(r)) for r in got[0]) == sorted(str(tuple(r)) for r in got[1])
    assert sorted(str((r.doc_id, r.item_id)) for r in got[0]) == want
    bad = {r for r, _ in brute}
    clean = sorted(str((r.doc_id, r.text)) for n, r in enumerate(rows) if n not in bad)
    for bound in (decontaminate.BROADCAST_SEEDS, 0):
        kept = decontaminate.drop_contaminated(every, items, broadcast_seeds=bound)
        assert kept.columns == every.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == clean
    assert decontaminate.contaminated(empty, items).count() == 0
    for bound in (decontaminate.BROADCAST_SEEDS, 0):
        assert decontaminate.contaminated(docs, items.where("false"), broadcast_seeds=bound).count() == 0


@pytest.mark.parametrize("width", range(1, 13))
def test_masks_are_complete(width):
    """Whichever tokens of a window are substituted within the bound, a mask selects none of them."""
    most = width - decontaminate.needed(width)
    assert most == width // 5
    fixed = [decontaminate.ALL_MASKS[m] for m in decontaminate.masks_for(width)]
    for gone in itertools.combinations(range(width), most):
        assert any(not set(gone) & {o + at for o in mask} for mask in fixed for at in range(width - mask[-1])), gone
        assert any(not set(gone) & set(mask) for mask in decontaminate.window_masks(width)), gone


def test_decontamination_of_five_tokens(spark):
    words = "alpha beta gamma delta epsilon".split()
    items = spark.createDataFrame([(7, " ".join(words)), (8, "one two three four five six seven eight")], "item_id long, text string")
    rows = [(i, "before it " + " ".join("zzz" if n == i else w for n, w in enumerate(words)) + " after it") for i in range(6)]
    rows.append((9, "before it alpha zzz gamma yyy epsilon after it"))
    found = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (decontaminate.BROADCAST_SEEDS, 0):
        got = sorted(tuple(r) for r in decontaminate.contaminated(found, items, broadcast_seeds=bound).collect())
        assert got == [(i, 7, 5, 5 if i == 5 else 4, 2, 7) for i in range(6)]
        assert [r.doc_id for r in decontaminate.drop_contaminated(found, items, broadcast_seeds=bound).collect()] == [9]


def test_toxicity_held_out(spark, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    held = toxicity.score(docs.join(labels.where(toxicity.held_out("doc_id")).select("doc_id"), "doc_id"), model).join(labels, "doc_id").collect()
    good, bad = [r.score for r in held if not r.toxic], [r.score for r in held if r.toxic]
    assert np.mean([g < b for g in good for b in bad]) > 0.95
    assert np.mean([g >= toxicity.THRESHOLD for g in good]) < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 10000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs.where("false"), labels)
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0} or all(r.score < 0.01 for r in toxicity.score(odd, none).collect())


def test_toxicity_equals_brute_force(spark, docs):
    """Counts, chosen features, the minimum of the loss and scores, by plain loops."""
    own = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(1, "repeated id"), (1, "repeated id"), (None, "no id"), (2, None)], "doc_id long, text string"), allowMissingColumns=True).withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").unionByName(spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.train(own, labels)

    def grams(text):
        points = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
        out = set()
        for order in (3, 4, 5):
            for at in range(len(points) - order + 1):
                h = points[at] * 0x9E3779B1 % 2**32
                for p in points[at + 1 : at + order]:
                    h = ((h ^ h >> 15) * 0x85EBCA6B + p * 0x9E3779B1) % 2**32
                out.add((h ^ h >> 16) * 0xC2B2AE35 % 2**32 >> 12)
        return out

    truth = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None:
            truth[r.doc_id] = max(truth.get(r.doc_id, 0), r.toxic)
    rows = sorted({(r.doc_id, r.text or "") for r in own.collect() if r.doc_id in truth})
    y, sets = np.array([truth[i] > 0 for i, _ in rows]), [grams(t) for _, t in rows]
    counts = {}
    for toxic, own_grams in zip(y, sets, strict=True):
        for g in own_grams:
            counts.setdefault(g, [0, 0])[int(toxic)] += 1
    ratio = {}
    for g, (n0, n1) in counts.items():
        if n0 + n1 >= toxicity.MIN_ROWS:
            r = np.log((n1 + 1) / (y.sum() + 2)) - np.log((n0 + 1) / ((~y).sum() + 2))
            if abs(r) / np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1)) >= toxicity.MIN_Z:
                ratio[g] = r
    assert len(ratio) <= toxicity.FEATURES and set(ratio) == set(model.ids.tolist())
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    scores = [1 / (1 + np.exp(-(model.bias + sum(weight[g] for g in s if g in weight)))) for s in sets]
    # at the minimum of the penalised loss its slope is zero
    for g, r in ratio.items():
        slope = sum((p - t) * r for p, t, s in zip(scores, y, sets, strict=True) if g in s) + weight[g] / r
        assert abs(slope) < 0.05, slope
    assert abs(sum(p - t for p, t in zip(scores, y, strict=True))) < 0.05
    got = toxicity.score(own, model).collect()
    assert len(got) == own.count()
    for (i, _), p in zip(rows, scores, strict=True):
        assert any(abs(r.score - p) < 1e-9 for r in got if r.doc_id == i)
    kept = toxicity.drop_toxic(own, model)
    assert kept.columns == own.columns and kept.count() == sum(r.score < toxicity.THRESHOLD for r in got)
