"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if a LENGTH-byte string (a window) that covers it also starts elsewhere.
Bucket-pointer refinement sorts suffixes into buckets of equal q-grams and refines each
bucket by the bucket identifiers at later offsets, reusing what is refined already, and
leaves buckets of one alone. Only equality up to LENGTH bytes matters here, so buckets need
no order, and their identifiers are 64-bit hashes that all executors compute alike:

1. Bucket identifiers of 1, 2, 4 ... GRAM bytes: the identifier of 2k bytes is made of the
   identifiers of k bytes here and k bytes on.
2. Every window is represented by its anchor, the smallest of its GRAM-byte buckets (the
   leftmost among equals). Equal windows have the same anchor at the same offset, so only
   anchors (about one in 85 positions) are shuffled. Anchors in buckets of one are done:
   nothing that they stand for repeats.
3. An anchor's context is all bytes of its windows. A bucket is refined by context; equal
   contexts repeat as a whole.
4. Contexts of one in buckets of several are refined by runs of STEP offsets: if the bytes
   common to a run's windows are alone in the bucket, none of them repeats; if all its
   bytes aren't alone, all do.
5. Windows of the runs that are left are refined to LENGTH bytes, one by one, together with one
   run of each kind settled before that has the same common bytes.

No step sorts or collects a bucket: all are groupings with partial aggregation and joins
on hashes, so buckets of any size are fine. A repeat is decided on two 64-bit hashes.

Cases: null texts count as empty; texts shorter than LENGTH lose nothing; equal rows repeat
each other; offsets are bytes of UTF-8; a text is handled in pieces of PIECE windows, so
very long ones need bounded memory beyond their own bytes; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch, text_bytes

LENGTH, GRAM, STEP, PIECE = 200, 32, 22, 1 << 19
_POSITION = np.uint64((1 << 20) - 1)
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def refine(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers of twice the bytes from those here and later on."""
    h = (here ^ (here >> np.uint64(29))) * _A + later
    return (h ^ (h >> np.uint64(32))) * _B


def buckets(data: np.ndarray) -> np.ndarray:
    h, k = _BYTES[data], 1
    while k < GRAM:
        h, k = refine(h[:-k], h[k:]), 2 * k
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of its windows, and bucket, for one piece of a text."""
    h = buckets(data)
    per, n = LENGTH - GRAM + 1, len(h)
    keys = np.full(n + -n % per, ~np.uint64(0))
    keys[:n] = (h & ~_POSITION) | np.arange(n, dtype=np.uint64)
    keys = keys.reshape(-1, per)
    before = np.minimum.accumulate(keys, 1).ravel()
    after = np.minimum.accumulate(keys[:, ::-1], 1)[:, ::-1].ravel()
    least = (np.minimum(after[: n - per + 1], before[per - 1 : n]) & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((first[1:], [len(least)])) - 1
    return least[first], first, last, h[least[first]]


_digest = xxhash.xxh3_64_intdigest


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py()
            starts = range(0, len(text) - LENGTH + 1, PIECE)
            if not starts:
                continue
            parts = [(at, *anchors(np.frombuffer(text[at : at + PIECE + LENGTH - 1], np.uint8))) for at in starts]
            x, lo, hi = (np.concatenate([p[i] + p[0] for p in parts]) for i in (1, 2, 3))
            h = np.concatenate([p[4] for p in parts])
            # windows on both sides of a cut may have the same anchor: that is one row, not a repeat
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            x, lo, hi, h = x[first], lo[first], hi[np.append(first[1:], len(x)) - 1], h[first]
            c = [_digest(text[a : b + LENGTH], seed=y - a) for y, a, b in zip(x.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            for column, part in zip(out, (np.full(len(x), key), lo, hi, x, h.view(np.int64), np.array(c, np.uint64).view(np.int64)), strict=True):
                column.append(part)
        if out[0]:
            columns = [np.concatenate(c) for c in out]
            for i in (1, 2, 3):
                columns[i] = columns[i].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rk", "lo", "hi", "x", "h", "c"])


#: Rows that a task holds before it hands them on.
ROWS = 50_000


def _lists(column: pa.ListArray) -> Iterator[dict[str, list[int]]]:
    """The structs of each row's list, field by field, one row in Python at a time."""
    offsets, values = column.offsets.to_numpy(), column.values
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield {name: v[a:b].tolist() for name, v in fields.items()}


def _out(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """A batch of integer columns; unsigned hashes become signed."""
    arrays = []
    for values, kind in zip(columns, kinds, strict=True):
        if kind == pa.int64():
            values = [v if v is None or v < 1 << 63 else v - (1 << 64) for v in values]
        arrays.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=names)


_RUN_NAMES = ["h", "run", "core", "span", "rk", "lo", "hi", "n", "from", "to"]
_RUN_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of offsets of the contexts of a text: bucket, run, hashes of the common and of all bytes."""
    rows: list[tuple] = []
    for batch in batches:
        for key, value, q in zip(batch.column(0).to_pylist(), batch.column(1), _lists(batch.column(2)), strict=True):
            text = value.as_py()
            for h, n, lo, hi, x in zip(q["h"], q["n"], q["lo"], q["hi"], q["x"], strict=True):
                for run in range((x - hi) // STEP, (x - lo) // STEP + 1):
                    near, far = run * STEP, min(run * STEP + STEP - 1, LENGTH - GRAM)
                    a, b = x - far, x - near + LENGTH
                    inside = a >= 0 and b <= len(text)
                    rows.append((h, run, _digest(text[x - near : a + LENGTH]), _digest(text[a:b]) if inside else None, key, max(lo, a), min(hi, x - near), n, a, x - near))
            if len(rows) >= ROWS:
                yield _out(list(zip(*rows, strict=True)), _RUN_KINDS, _RUN_NAMES)
                rows = []
    if rows:
        yield _out(list(zip(*rows, strict=True)), _RUN_KINDS, _RUN_NAMES)


_WINDOW_NAMES, _WINDOW_KINDS = ["h", "w", "rk", "lo", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for key, value, q in zip(batch.column(0).to_pylist(), batch.column(1), _lists(batch.column(2)), strict=True):
            text = value.as_py()
            for h, n, lo, hi, x in zip(q["h"], q["n"], q["lo"], q["hi"], q["x"], strict=True):
                rows += [(h, _digest(text[p : p + LENGTH], seed=x - p), key, p, n) for p in range(lo, hi + 1)]
            if len(rows) >= ROWS:
                yield _out(list(zip(*rows, strict=True)), _WINDOW_KINDS, _WINDOW_NAMES)
                rows = []
    if rows:
        yield _out(list(zip(*rows, strict=True)), _WINDOW_KINDS, _WINDOW_NAMES)


def removed_intervals(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """keyed: (rk, bytes). (rk, cuts): sorted byte intervals (lo, end) to remove, overlapping ones not merged.

    Each step is a written table, and what no later step reads is deleted at once.
    """
    rows = scratch.write(keyed.select("rk", "bytes").mapInArrow(_anchor_rows, "rk long, lo int, hi int, x int, h long, c long"), "anchors")
    repeated = rows.groupBy("h").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1").select("h", "mixed")
    kept = scratch.write(rows.join(repeated, "h"), "repeated")
    scratch.drop("anchors")
    mixed = kept.where("mixed")
    contexts = scratch.write(mixed.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("rk", "lo", "hi", "x")).alias("r")), "contexts")
    several = contexts.where("n > 1").select("h", "c")
    copies = mixed.join(several, ["h", "c"], "left_semi").unionByName(kept.where("not mixed"))
    whole = scratch.write(copies.select("rk", "lo", (F.col("hi") + LENGTH).alias("end")), "whole")
    scratch.drop("repeated")

    own = contexts.select(F.col("r.rk").alias("rk"), F.struct("h", "n", "r.lo", "r.hi", "r.x").alias("q")).groupBy("rk").agg(F.collect_list("q").alias("qs"))
    runs = scratch.write(keyed.select("rk", "bytes").join(own, "rk").mapInArrow(_runs, "h long, run int, core long, span long, rk long, lo int, hi int, n long, from int, to int"), "runs")
    scratch.drop("contexts")
    cores = runs.groupBy("h", "run", "core").agg(F.sum("n").alias("k")).where("k > 1").drop("k")
    open_ = scratch.write(runs.join(cores, ["h", "run", "core"], "left_semi"), "open")
    scratch.drop("runs")
    spans = open_.where("span is not null").groupBy("h", "run", "span").agg(F.sum("n").alias("k")).where("k > 1")
    settled = scratch.write(open_.join(spans, ["h", "run", "span"], "left"), "settled")
    scratch.drop("open")

    # a settled run is unlike an open one of the same core as a whole, but may share windows with it:
    # one run of each kind stands for all of them
    unsettled = settled.where("k is null")
    kinds = settled.where("k is not null").groupBy("h", "run", "core", "span").agg(F.min(F.struct("rk", "from", "to")).alias("r"))
    stand = kinds.join(unsettled.select("h", "run", "core").distinct(), ["h", "run", "core"], "left_semi")
    anchor = (F.col("to") + F.col("run") * STEP).alias("x")
    asked = unsettled.select("rk", F.struct("h", "n", "lo", "hi", anchor).alias("q"))
    stand = stand.select("r.rk", F.struct("h", F.lit(2).cast("long").alias("n"), F.col("r.from").alias("lo"), F.col("r.to").alias("hi"), (F.col("r.to") + F.col("run") * STEP).alias("x")).alias("q"))
    left = asked.unionAll(stand).groupBy("rk").agg(F.collect_list("q").alias("qs"))
    windows = scratch.write(keyed.select("rk", "bytes").join(left, "rk").mapInArrow(_windows, "h long, w long, rk long, lo int, n long"), "windows")
    twice = windows.groupBy("h", "w").agg(F.sum("n").alias("k")).where("k > 1").drop("k")
    single = windows.where("n = 1").join(twice, ["h", "w"], "left_semi").select("rk", "lo", (F.col("lo") + LENGTH).alias("end"))
    spanned = settled.where("k is not null and n = 1").select("rk", "lo", (F.col("hi") + LENGTH).alias("end"))
    every = whole.unionAll(spanned).unionAll(single).distinct()
    cuts = scratch.write(every.groupBy("rk").agg(F.sort_array(F.collect_list(F.struct("lo", "end"))).alias("cuts")), "cuts")
    scratch.drop("whole", "settled", "windows")
    return cuts


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Rows are known by a hash of what they hold: equal rows get equal intervals. Where different rows
    share one (by chance, n * n / 2 ** 65 pairs among n rows), another hash takes its place."""
    key, other = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.col(text_col), F.col(id_col), F.lit(1))
    shared = docs.select(key.alias("k"), other.alias("o")).groupBy("k").agg((F.min("o") != F.max("o")).alias("two")).where("two")
    clashes = [r["k"] for r in shared.collect()]  # as many as chance gives
    return F.when(key.isin(clashes), other).otherwise(key) if clashes else key


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; with_kept adds the remaining bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    keyed = docs.select(_row_key(docs, id_col, text_col).alias("rk"), F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"))
    intervals = removed_intervals(keyed, scratch)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, cuts in zip(batch.column(1), _lists(batch.column(2)), strict=True):
                text = value.as_py()
                kept, at, removed, spans = [], 0, 0, 0
                end = None
                for lo, hi in zip(cuts["lo"], cuts["end"], strict=True):
                    if end is None or lo > end:
                        if end is not None:
                            at = end
                        kept.append(text[at:lo])
                        spans += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                kept.append(text[end or 0 :])
                rest = b"".join(kept)
                rows.append((len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            arrays = [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            keep = 6 if with_kept else 5
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return keyed.join(intervals, "rk", "left").select("id", "bytes", "cuts").mapInArrow(run, schema)
