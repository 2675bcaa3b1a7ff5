"""Vector functions as columns."""

from __future__ import annotations

import base64
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

L2, DOT, COSINE = "l2_norm", "dot_product", "cosine"
MAX_SCORE = 3.4028234663852886e38


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(vector: Column, query: list[float], metric: str) -> Column:
    """Higher is nearer: one over the squared distance, or the (normalised) product."""
    q = literal(query)
    if metric == L2:
        d = squared_l2(vector, q)
        return F.when(d == 0, F.lit(MAX_SCORE)).otherwise(1 / F.nullif(d, F.lit(0.0)))
    if metric == DOT:
        return dot(vector, q)
    size = math.sqrt(sum(x * x for x in query))
    return dot(vector, q) / F.nullif(F.sqrt(dot(vector, vector)) * size, F.lit(0.0))


def decode_base64(text: str) -> list[float]:
    """Little-endian 32-bit floats."""
    raw = base64.b64decode(text, validate=True)
    if not raw or len(raw) % 4:
        raise ValueError("not a vector of 32-bit floats")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))
