"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of
both. Every distinct fingerprint emits all its variants within r = 2 bits (2081 of them),
fingerprints that share a variant are linked. All members of such a group are pairwise
within 2r bits, so a star from its smallest member keeps every link's effect on
components without emitting all pairs.

Shuffle. Variants are shuffled by their leading k bits: a fingerprint is sent to the
1 + k + k(k-1)/2 buckets within two flips of its own leading bits, and the bucket's task
generates those of its variants that fall into the bucket, sorts them and verifies the
colliding pairs. This is the same exchange as one row per variant, but the rows that
travel are 29 to 211 a fingerprint instead of 2081. The bits that lead are those set
nearest to half of the time, so buckets are even; k follows from the number of
fingerprints, and a task splits a bucket further until its variants fit its memory.

Cases: null text counts as empty; texts without words have fingerprint zero and link like
others; fewer words than a shingle make one shingle; repeated rows share a fingerprint
and component, and of repeated ids that one row stays whose text and columns have the least
hashes. A null doc_id keeps its row; a component of null ids only has a null id. Very long
texts are read whole, their shingles in runs of 65,536. Extra columns aren't read for the
query and stay as they are in drop_near_duplicates; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch, free_names, text_bytes
from searchlake.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Variants a task holds at once, and the aim for a bucket's variants.
MAX_VARIANTS, BUCKET_VARIANTS = 1 << 22, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text's word shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 65536):
        block = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + 65536)].tolist(), ends[at : at + 65536].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, rk, fp): fp as a signed long, rk a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=[id_col, "rk", "fp"])

    inputs = docs.select(F.col(id_col), F.xxhash64(text_col).alias("rk"), text_bytes(text_col).alias("__text"))
    return inputs.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, rk long, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    """All words of so many bits with at most radius of them set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(values: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share a variant of their low bits within the flips left to each."""
    if len(values) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    per = [1, 1 + bits, 1 + bits + bits * (bits - 1) // 2]
    if sum(per[r] * int((left == r).sum()) for r in range(3)) > MAX_VARIANTS and bits > 1:
        found = []
        top = (values >> np.uint64(bits - 1)) & np.uint64(1)
        for bit in (0, 1):
            rest = left - (top != bit)
            inside = np.flatnonzero(rest >= 0)
            a, b = _stars(values[inside] & np.uint64((1 << (bits - 1)) - 1), rest[inside], bits - 1)
            found.append((inside[a], inside[b]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    variants, owners = [], []
    for r in range(3):
        own = np.flatnonzero(left == r)
        masks = _masks(bits, r)
        variants.append((values[own][:, None] ^ masks[None, :]).ravel())
        owners.append((own, len(masks)))
    all_ = np.concatenate(variants)
    ordered = np.sort(all_)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marks = np.zeros(1 << 20, bool)
    marks[((twice * _MIX) >> np.uint64(44)).astype(np.int64)] = True
    near = np.flatnonzero(marks[((all_ * _MIX) >> np.uint64(44)).astype(np.int64)])
    value = all_[near]
    place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    hit = twice[place] == value
    near, place = near[hit], place[hit]
    owner = np.concatenate([np.repeat(own, n) for own, n in owners])[near]
    order = np.lexsort((owner, place))
    owner, place = owner[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    centre = np.repeat(owner[first], np.diff(np.concatenate((first, [len(owner)]))))
    apart = centre != owner
    return centre[apart], owner[apart]


def _permuted(order: list[int]) -> Column:
    """The fingerprint with its bits rearranged: order lists bit numbers from the leading one on."""
    terms = [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), 63 - at) for at, b in enumerate(order)]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def links(fps: DataFrame, n: int) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) within RADIUS bits; n is their number."""
    half = RADIUS // 2
    k = min(40, max(0, math.ceil(math.log2(max(1, 2081 * n) / BUCKET_VARIANTS))))
    ones = fps.agg(*[F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]).first()
    order = sorted(range(64), key=lambda b: (abs(2 * (ones[b] or 0) - n), b))
    low = 64 - k
    masks = [int(m) for m in _masks(k, half)]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(frame["q"].to_numpy().view(np.uint64))
        bucket = np.uint64(key[0])
        top = (values >> np.uint64(low)) ^ bucket if k else np.zeros(len(values), np.uint64)
        left = half - np.bitwise_count(top).astype(np.int64)
        a, b = _stars(values & np.uint64((1 << low) - 1), left, low)
        near = np.bitwise_count(values[a] ^ values[b]) <= RADIUS
        roots = _roots(len(values), a[near], b[near])
        moved = np.flatnonzero(roots != np.arange(len(values)))
        return pd.DataFrame({"u": values[moved].view(np.int64), "v": values[roots[moved]].view(np.int64)})

    lead = F.shiftrightunsigned("q", low) if k else F.lit(0).cast("long")
    sent = fps.select(_permuted(order).alias("q")).select("q", F.explode(F.array(*[lead.bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("bucket"))
    found = sent.groupBy("bucket").applyInPandas(run, "u long, v long").distinct()
    back = [0] * 64
    for at, b in enumerate(order):
        back[63 - b] = 63 - at  # bit b of the fingerprint sits at bit 63 - at of q
    return found.select(*[_permuted_of(c, back).alias(c) for c in ("u", "v")])


def _permuted_of(column: str, order: list[int]) -> Column:
    terms = [F.shiftleft(F.shiftrightunsigned(column, b).bitwiseAND(F.lit(1).cast("long")), 63 - at) for at, b in enumerate(order)]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def clusters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rk, fp, root, component_id) per row; root is the component's smallest fingerprint."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = components(scratch.write(links(distinct.select("fp"), distinct.count()), "links"), scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(owner, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    found = clusters(docs, id_col=id_col, text_col=text_col)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: one with its smallest id."""
    found = clusters(docs, id_col=id_col, text_col=text_col)
    i, r, g, n = free_names(docs, "id", "rk", "root", "place")
    kept = Scratch(docs.sparkSession, "simhash-kept").write(
        found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(i), F.col("rk").alias(r), F.col("root").alias(g)), "kept"
    )
    repeated = kept.groupBy(g).count().where("count > 1").limit(1).count()
    keys = kept.groupBy(g).agg(F.min(F.struct(i, r)).alias("m")).select(g, "m.*") if repeated else kept
    out = docs.join(keys, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(r)))
    if repeated:  # rows with one id and text: the first by the other columns
        plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        out = out.withColumn(n, F.row_number().over(Window.partitionBy(g).orderBy(F.xxhash64(*plain), *plain))).where(F.col(n) == 1)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
