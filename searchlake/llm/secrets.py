"""Secret scan: patterns for known forms, character Markov models for the rest.

Base spans come from three patterns (assignments, access keys, hex runs). Beyond them, a
token of at least MIN_TOKEN characters is a secret if its characters are likelier under a
first-order Markov model of random strings than under one of ordinary identifiers: the
log-likelihood ratio of the two, in all and per character, has to pass bounds. Both models
are trained from labelled samples: random strings and values that the base patterns found
in a bounded sample of documents against all other tokens of that sample.

Cases: null or empty texts have no spans; offsets are code points, end exclusive; spans of
one kind never overlap; random spans never overlap base spans; repeated rows are judged
alike; without any sample (empty table) the built-in samples alone train the models. Equal
scores can't tie, as every token is judged by itself. Very long texts are scanned whole, in
memory of their spans. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import sample_rows

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_TOKEN = 16
#: Rows in the labelled sample; bounds on the log-likelihood ratio in all and per character.
SAMPLE_ROWS, MIN_TOTAL, MIN_MEAN = 2000, 12.0, 0.6
WORDS = (
    "get set user account by email configuration property maximum connection count java lang string builder application "
    "context initializer handle request authentication number of partitions local share content disposition attachment "
    "transaction manager factory default checkpoint directory is deterministic international abstract proxy incremental "
    "statistics release candidate final service implementation shuffle coalescing responsibility ordinary name image "
    "preview thumbnail large order line item total index document query search result filter sort page size offset time "
    "stamp date year month file path stream reader writer buffer cache memory thread pool queue message event listener "
    "callback error exception status code response server client host port network protocol session token parser lexer "
    "table column row key value map list array object class method function parameter argument return type value test"
).split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def _outside(text: str, spans: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if not any(a < m.end() for a, _, _ in spans[at : at + 3]):
            yield m


def _codes(token: str) -> np.ndarray:
    return np.frombuffer(token.encode("ascii"), np.uint8)


def count(tokens: Iterable[str]) -> np.ndarray:
    """Counts of character pairs; row 0 is the start of a token."""
    counts = np.zeros((128, 128))
    for token in tokens:
        c = _codes(token)
        np.add.at(counts, (np.concatenate(([0], c[:-1])), c), 1)
    return counts


def _log_probabilities(counts: np.ndarray, smoothing: float = 0.3) -> np.ndarray:
    counts = counts.copy()
    counts[:, _codes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] += smoothing
    with np.errstate(divide="ignore"):
        return np.log(counts / counts.sum(1, keepdims=True))


def random_strings(n: int, seed: int = 7) -> list[str]:
    pick = random.Random(seed)
    kinds = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return ["".join(pick.choices(kinds[i % len(kinds)], k=pick.randint(16, 48))) for i in range(n)]


def identifiers(n: int, seed: int = 8) -> list[str]:
    """Names made of words, in the usual styles."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        words = pick.choices(WORDS, k=pick.randint(2, 5))
        join = ("_", "-", "/", "")[i % 4]
        out.append(join.join(words) if join else words[0] + "".join(w.capitalize() for w in words[1:]))
        if i % 7 == 0:
            out[-1] += str(pick.randint(0, 2030))
    return out


class RatioModel:
    """Log-likelihood ratio of a random string against an ordinary identifier."""

    def __init__(self, secrets: np.ndarray, ordinary: np.ndarray):
        with np.errstate(invalid="ignore"):
            ratio = _log_probabilities(secrets) - _log_probabilities(ordinary)
        self.ratio = np.nan_to_num(ratio, nan=0.0, posinf=0.0, neginf=0.0)

    def score(self, token: str) -> float:
        c = _codes(token)
        return float(self.ratio[np.concatenate(([0], c[:-1])), c].sum())

    def secret(self, token: str) -> bool:
        if token.isdigit() or len(set(token)) < 5:
            return False
        score = self.score(token)
        return score >= MIN_TOTAL and score >= MIN_MEAN * len(token)


def sample_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character pairs of the labelled tokens of a text: values of base spans, and other words."""
    spans = base_spans(text)
    ordinary = [m[0] for m in _outside(text, spans)] + re.findall(r"[A-Za-z0-9_-]{5,15}", text)
    return count(m for a, b, _ in spans for m in TOKEN.findall(text[a:b])), count(ordinary)


def fit(docs: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> RatioModel:
    """Train on the built-in samples and the distinct rows (id and text) with the smallest hashes.

    Pairs of characters are counted on the executors; the driver gets at most 2 x 128 x 128 sums.
    """
    counts = np.stack((count(random_strings(3000)), count(identifiers(3000))))
    if docs is not None:
        own = sample_rows(docs, id_col, text_col, rows).select("__text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((2, 128, 128))
            for batch in batches:
                for text in batch.column(0):
                    found += np.stack(sample_counts(text.as_py()))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()[at])], names=["at", "n"])

        for at, n in own.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n")).collect():
            counts.ravel()[at] += n
    return RatioModel(*counts)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: RatioModel | None = None) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans (base and random ones), n_random."""
    if model is None:
        model = fit(docs, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                joined = ",".join([f"{k}:{a}:{b}" for a, b, k in base])
                more = [(m.start(), m.end(), "random") for m in _outside(text, base) if model.secret(m[0])]
                every = ",".join([f"{k}:{a}:{b}" for a, b, k in sorted(base + more, key=lambda s: s[0])]) if more else joined
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined.encode()).hexdigest(), every, len(more)))
            n = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(n, kinds, strict=True)]], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)
