"""Benchmark decontamination by spaced seeds.

Texts are sequences of lower-cased word tokens (letters and digits; marks attached to
words don't count). A window of WINDOW tokens of an item (the whole item if that is shorter)
is in a document if at least SIMILARITY of its tokens agree, place by place: items of fewer
than five tokens have to be there word for word. A seed is a mask over the positions of a
window with some of them selected; the hash of the selected tokens is blind to the others,
so a substituted word spoils only the seeds that select it. The masks are complete: whichever
tokens of a window are substituted within the bound, one mask selects none of them. Seeds of
documents that equal a benchmark seed of the same mask are hits. A hit fixes an alignment (a
diagonal) of document and item; the windows around the hit are compared, and where one holds
the pair is verified. The result has the longest verified stretch of each pair.

Distribution. If the benchmark's seeds are at most BROADCAST_SEEDS (they are counted), the
table is sent to the executors and every document is searched where it is read: nothing is
shuffled. Beyond that, seeds of both sides are joined by hash; those seeds select eight of
twelve positions, so what they join hardly ever fails the check, and documents send only
seeds that pass a filter of FILTER_BITS bits made of the benchmark's. Seeds that occur in
very many documents are salted. Both ways give the same rows.

Cases: null text counts as empty, and texts without tokens match nothing; the result has one
row for each row of the documents (repeated rows and null ids included) and each distinct
(item_id, text) that overlaps it, null item_ids included; very long texts are searched whole,
in memory of a few numbers per token; extra columns aren't read; empty tables give an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, cycle
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from searchlake.llm.common import Scratch

#: Selected positions of each mask of the broadcast search.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 4, 6))
#: Further masks for items of five tokens, whose second or fourth may be substituted, and those of items of 1 to 3 tokens.
SHORT_MASKS, TINY_MASKS = ((0, 2, 3, 4), (0, 1, 2, 4)), ((0,), (0, 1), (0, 1, 2))
ALL_MASKS = MASKS + SHORT_MASKS + TINY_MASKS
WINDOW, SIMILARITY = 12, 0.8
BROADCAST_SEEDS, FILTER_BITS = 2_000_000, 27
#: Hits that are compared at once; seeds of one hash that stay unsalted.
HITS, SALT_ROWS = 1 << 17, 100_000
_WORD = re.compile(r"[^\W_]+")
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def token_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words], np.uint64)


def seeds(hashes: np.ndarray, offsets: tuple[int, ...], salt: int, width: int = 0) -> np.ndarray:
    """Hashes of the selected tokens at every position where a window of so many tokens (the mask, if 0) fits; masks are salted."""
    n = len(hashes) - (width or offsets[-1] + 1) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, salt, np.uint64)
    for f, o in zip(cycle(_FACTORS), offsets):  # noqa: B905 the factors repeat
        h = (h ^ (h >> np.uint64(29))) * f + hashes[o : o + n]
    return (h ^ (h >> np.uint64(32))) * _FACTORS[0]


def masks_for(size: int) -> range | list[int]:
    """The masks of the broadcast search for an item of so many tokens."""
    if size < 4:
        return [len(MASKS) + len(SHORT_MASKS) + size - 1] if size else []
    return range(1) if size == 4 else range(len(MASKS) + len(SHORT_MASKS) * (size == 5))


def needed(width: int) -> int:
    """Tokens that have to agree in a window of so many."""
    return math.ceil(SIMILARITY * width - 1e-9)


def window_masks(width: int) -> list[tuple[int, ...]]:
    """The masks of the joined search: the window in up to six runs, as many left out as may be substituted."""
    runs = np.array_split(np.arange(width), min(6, width))
    drop = width - needed(width)
    return [tuple(int(p) for i, r in enumerate(runs) if i not in out for p in r) for out in combinations(range(len(runs)), drop)]


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(tokens that agree, start, end in the document) of the longest verified stretch on a diagonal."""
    a, b = max(0, diagonal), min(len(doc), len(item) + diagonal)
    width = min(WINDOW, len(item))
    if b - a < width or not width:
        return 0, 0, 0
    same = (doc[a:b] == item[a - diagonal : b - diagonal]).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(total[width:] - total[:-width] >= needed(width))
    if not len(good):
        return 0, 0, 0
    cut = np.flatnonzero(np.diff(good) > width)
    starts, ends = good[np.concatenate(([0], cut + 1))], good[np.concatenate((cut, [len(good) - 1]))] + width
    agree = total[ends] - total[starts]
    best = int(agree.argmax())
    return int(agree[best]), a + int(starts[best]), a + int(ends[best])


def longest(doc: np.ndarray, item: np.ndarray, diagonals: Iterable[int]) -> tuple[int, int, int]:
    """The longest verified stretch on several diagonals; among equals the first in the document."""
    return min((overlap(doc, item, d) for d in diagonals), key=lambda o: (-o[0], o[1], o[2]), default=(0, 0, 0))


class Benchmark:
    """Items' tokens and the sorted table of their seeds."""

    def __init__(self, items: list[tuple[Any, str]]):
        own = [(i, w) for i, w in ((i, tokens(t)) for i, t in items) if w]
        words = sorted({w for _, ws in own for w in ws})
        self.vocabulary = {w: n + 1 for n, w in enumerate(words)}
        self.names = [i for i, _ in own]
        self.items = [np.array([self.vocabulary[w] for w in ws], np.uint64) for _, ws in own]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if own else np.empty(0, np.int64)
        # all items one after another, with margins that agree with nothing
        margin = np.zeros(WINDOW, np.uint64)
        self.flat = np.concatenate([margin, *self.items, margin])
        self.masks = sorted({m for n in set(self.sizes.tolist()) for m in masks_for(n)})
        hashes, owner, place = [], [], []
        for n, item in enumerate(self.items):
            for mask in masks_for(len(item)):
                h = seeds(item, ALL_MASKS[mask], mask + 1)
                hashes.append(h)
                owner.append(np.full(len(h), n))
                place.append(np.arange(len(h)))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int64)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def _verified(self, padded: np.ndarray, at: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """(item, diagonal) of the hits around which a window holds; padded is the document with margins."""
        owner, place = self.owner[seed], self.place[seed]
        size = self.sizes[owner]
        around = np.arange(1 - WINDOW, WINDOW)
        other = place[:, None] + around
        same = padded[at[:, None] + around + WINDOW] == self.flat[self.starts[owner][:, None] + other + WINDOW]
        same &= (other >= 0) & (other < size[:, None])
        total = np.concatenate((np.zeros((len(at), 1), np.int64), np.cumsum(same, 1)), 1)
        good = np.zeros(len(at), bool)
        for width in np.unique(np.minimum(size, WINDOW)).tolist():
            own = np.minimum(size, WINDOW) == width
            good[own] = (total[own, width:] - total[own, :-width] >= needed(width)).any(1)
        return np.unique(np.stack((owner[good], at[good] - place[good]), 1), axis=0)

    def find(self, text: str) -> list[tuple[Any, int, int, int, int]]:
        """(item id, item tokens, agreeing tokens, start, end) of each item that overlaps the text."""
        get = self.vocabulary.get
        doc = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        found: list[np.ndarray] = []
        padded = None
        for mask in self.masks:
            h = seeds(doc, ALL_MASKS[mask], mask + 1)
            near = np.flatnonzero(self.marks[(h >> np.uint64(44)).astype(np.int64)])
            near = near[doc[near] > 0]  # the first position is selected by every mask
            low, high = np.searchsorted(self.hashes, h[near], "left"), np.searchsorted(self.hashes, h[near], "right")
            hit = low < high
            if not hit.any():
                continue
            if padded is None:
                margin = np.full(WINDOW, 1 << 63, np.uint64)
                padded = np.concatenate((margin, np.where(doc == 0, np.uint64(1 << 63), doc), margin))
            near, low, n = near[hit], low[hit], (high - low)[hit]
            ends = np.cumsum(n)
            for begin in range(0, int(ends[-1]), HITS):
                row = np.arange(begin, min(begin + HITS, int(ends[-1])))
                own = np.searchsorted(ends, row, "right")
                found.append(self._verified(padded, near[own], low[own] + row - (ends[own] - n[own])))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        out = []
        for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else []:
            item = int(part[0, 0])
            out.append((self.names[item], len(self.items[item]), *longest(padded[WINDOW:-WINDOW], self.items[item], part[:, 1].tolist())))
        return out


_COLUMNS = ["item_tokens", "matched_tokens", "start_token", "end_token"]


def _schema(doc_type: str, item_type: str) -> str:
    return f"doc_id {doc_type}, item_id {item_type}, " + ", ".join(f"{c} long" for c in _COLUMNS)


def _broadcast_search(docs: DataFrame, rows: list[tuple[Any, str]], doc_type: str, item_type: str) -> DataFrame:
    bench = Benchmark(rows)
    item_arrow = to_arrow_type(_parse_datatype_string(item_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in bench.find(text.as_py())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [batch.schema.field(0).type, item_arrow, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", *_COLUMNS])

    return docs.mapInArrow(run, _schema(doc_type, item_type))


def _joined_search(docs: DataFrame, items: DataFrame, doc_type: str, item_type: str) -> DataFrame:
    """Seeds of both sides as rows, joined by hash; a pair's token sequences then meet once."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    keys = [F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id").alias("k2")]

    def sequences(keep: Callable[[np.ndarray], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [token_hashes(tokens(t.as_py())) for t in batch.column(3)]
                chosen = pa.array([i for i, h in enumerate(own) if len(h) and keep(h)], pa.int64())
                raw = pa.array([own[i].tobytes() for i in chosen.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(chosen) for c in (0, 1, 2)], raw], names=["k1", "k2", "id", "seq"])

        return run

    def emitted(widths: Callable[[int], list[int]], bits: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k1, k2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    own = np.frombuffer(raw.as_py(), np.uint64)
                    for h, place in all_seeds(own, widths(len(own)), bits):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k1)), pa.array(np.full(len(h), k2)), pa.array(h.view(np.int64)), pa.array(place)], names=["k1", "k2", "seed", "place"])

        return run

    test = scratch.write(items.select(F.col("item_id").alias("id"), "text").select(*keys, "id", "text").mapInArrow(sequences(lambda h: True), f"k1 long, k2 long, id {item_type}, seq binary"), "items")
    widths = sorted(r[0] for r in test.select(F.least(F.octet_length("seq") / 8, F.lit(WINDOW)).cast("int")).distinct().collect())  # at most WINDOW
    seed_schema = "k1 long, k2 long, seed long, place long"
    test_seeds = scratch.write(test.select("k1", "k2", "seq").mapInArrow(emitted(lambda n: [min(n, WINDOW)], None), seed_schema), "item-seeds")
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = test_seeds.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("b")).toPandas()  # at most 2**(FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()

    rows = docs.select(F.col("doc_id").alias("id"), "text").select(*keys, "id", "text")
    train = scratch.write(rows.mapInArrow(sequences(lambda h: any(True for _ in all_seeds(h, widths, bits))), f"k1 long, k2 long, id {doc_type}, seq binary"), "docs")
    copies = train.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    train = train.dropDuplicates(["k1", "k2"])
    train_seeds = scratch.write(train.select("k1", "k2", "seq").mapInArrow(emitted(lambda n: widths, bits), seed_schema), "doc-seeds")
    total = train_seeds.count()
    bound = max(SALT_ROWS, total // 1000)  # so at most 1000 seeds are salted
    hot = scratch.write(train_seeds.groupBy("seed").count().where(F.col("count") > bound).select("seed", F.ceil(F.col("count") / bound).cast("int").alias("salts")), "hot")
    salts = F.coalesce("salts", F.lit(1))
    left = train_seeds.join(F.broadcast(hot), "seed", "left").withColumn("salt", F.expr("pmod(xxhash64(k1, place), coalesce(salts, 1))").cast("int"))
    right = test_seeds.join(F.broadcast(hot), "seed", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    met = left.alias("d").join(right.alias("i"), ["seed", "salt"]).select("d.k1", "d.k2", F.col("i.k1").alias("i1"), F.col("i.k2").alias("i2"), (F.col("d.place") - F.col("i.place")).alias("diagonal"))
    pairs = met.groupBy("k1", "k2", "i1", "i2").agg(F.collect_set("diagonal").alias("diagonals"))
    own = test.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("id").alias("item_id"), F.col("seq").alias("iseq"))
    both = pairs.join(own, ["i1", "i2"]).join(train.withColumnRenamed("id", "doc_id"), ["k1", "k2"]).join(copies, ["k1", "k2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], []
            for d, i, g in zip(batch.column(3), batch.column(4), batch.column(5).to_pylist(), strict=True):
                item = np.frombuffer(i.as_py(), np.uint64)
                found.append(longest(np.frombuffer(d.as_py(), np.uint64), item, g))
                size.append(len(item))
            columns = [size, *([f[c] for f in found] for c in range(3))]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in (0, 1, 2)], *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "item_id", "n", *_COLUMNS])
            yield out.filter(pa.array([f[0] > 0 for f in found], pa.bool_()))

    schema = f"doc_id {doc_type}, item_id {item_type}, n long, " + ", ".join(f"{c} long" for c in _COLUMNS)
    verified = both.select("doc_id", "item_id", "n", "seq", "iseq", "diagonals").mapInArrow(verify, schema)
    return verified.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def all_seeds(own: np.ndarray, widths: list[int], bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(seeds, places) of the joined search for each mask of each width, those that pass the filter."""
    for width in widths:
        for n, mask in enumerate(window_masks(width)):
            h = seeds(own, mask, width * 100 + n, width)
            place = np.arange(len(h))
            if bits is not None and len(h):
                at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                place = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
                h = h[place]
            if len(h):
                yield h, place


def _items(benchmark: DataFrame, broadcast_seeds: int) -> tuple[DataFrame, list[tuple[Any, str]] | None]:
    """The distinct items, and their rows if their seeds are within the bound."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    # a text of n bytes has at most (n + 1) / 2 tokens
    bound = items.agg(F.sum((F.octet_length("text") + 1) / 2 * len(MASKS))).first()[0] or 0
    return items, [tuple(r) for r in items.orderBy("item_id", "text").collect()] if bound <= broadcast_seeds else None


def contaminated(docs: DataFrame, benchmark: DataFrame, *, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched_tokens, start_token, end_token): a row for each
    row of docs and item whose texts overlap; clean documents have none."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items, rows = _items(benchmark, broadcast_seeds)
    doc_type, item_type = dict(own.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    return _broadcast_search(own, rows, doc_type, item_type) if rows is not None else _joined_search(own, items, doc_type, item_type)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of docs that overlap no item."""
    items, rows = _items(benchmark, broadcast_seeds)
    if rows is None:
        # by text alone: whether a text overlaps doesn't depend on its id
        key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
        texts = docs.select(key.alias("doc_id"), "text").distinct()
        bad = contaminated(texts, benchmark, broadcast_seeds=broadcast_seeds).select(F.col("doc_id").alias("__bad")).distinct()
        return docs.join(bad, key == F.col("__bad"), "left_anti")
    bench = Benchmark(rows)

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not bench.find(t) for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(clean, "boolean")(F.coalesce("text", F.lit(""))))
