"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns, strict ones (whose checked matches are base spans) and
loose ones (card-like numbers that fail the checksum, phone numbers without a country
code, spelt-out e-mail addresses). Labelers vote on every candidate, or abstain:

- regex: the strict pattern with its check;
- gazetteer: known top-level domains, card issuers, country codes, reserved networks;
- context: cue words of the kind, or words that speak against it, shortly before the span;
- border: speaks against spans that stick to other letters and digits.

Votes are counted by pattern over all candidates of all documents (a grouping; at most
KINDS x 3^4 patterns reach the driver). Expectation-maximisation on these counts estimates
each labeler's reliability and every pattern's probability of being personal data. These
probabilities are the soft labels of the final span classifier, a logistic regression that
sees the kind and the votes, but also the characters: pairs of the span's shape (digits,
capitals, small letters) and words and character triples right before it, hashed to BUCKETS
features. It is fitted on TRAIN_SPANS candidates of each sort, base and loose ones with the
smallest hashes; its weights become a column expression. Base spans always stay; loose ones
are added if the classifier says so and they don't overlap a base span.

Cases: null text counts as empty; offsets are code points, end exclusive; matches that fail
their check are dropped without retries; repeated rows are judged alike; without any
candidates nothing is trained and nothing added; extra columns stay as they are, whatever
their names, and never meet the operator's own. Very long texts: patterns are written with
possessive quantifiers and start only where a run starts; running sums over n matches are
folded in runs of sqrt(n), so 20,000 matches in one text take about a second.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: name: (kind, pattern, cheap test that a text may hold a match)
PATTERNS = {
    "email": ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0"),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike r'[0-9]\.[0-9]++\.[0-9]'"),
    "card": ("card", r"[0-9](?:[ -]?[0-9]){12,}+", "text rlike r'[0-9](?:[ -]?[0-9]){12}'"),
    "phone": ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "instr(text, '+') > 0"),
    "loose_phone": ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", r"text rlike r'[0-9]{3}[ .-][0-9]{4}'"),
    "loose_email": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(](?:at|AT)[\])] ?| (?:at|AT) (?=[A-Za-z0-9-]++ (?:dot|DOT) ))[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]|(?<= )(?:dot|DOT)(?= )) ?[A-Za-z0-9-]++)++", "lower(text) rlike r'[\\[(]at[\\])]| dot '"),
    "loose_ip": ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "text rlike r'(?:[0-9A-Fa-f]{1,4}:){7}'"),
}
CHECKS = {
    "email": "true",
    "ip": rf"v rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
    "card": "length(digits) between 13 and 19 and luhn_check(digits)",
    "phone": "length(digits) between 9 and 15",
}
#: loose candidates: a strict pattern's failed matches that are still worth a vote, and the loose patterns' own
LOOSE = {"card": "length(digits) between 13 and 19", "loose_phone": "true", "loose_email": "true", "loose_ip": "true"}
_TLD = "com|org|net|edu|gov|io|info|biz|co|uk|de|fr|es|it|nl|eu|us|ca|au|jp|cn|in|br|ru|ch|at|se|no|pl|example"
GAZETTEER = {
    "email": rf"CASE WHEN lower(v) rlike r'(?:\.|dot[\])]? ?)(?:{_TLD})$' THEN 1 ELSE 0 END",
    "ip": r"CASE WHEN v rlike r'^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.' THEN 0 ELSE 1 END",
    "card": "CASE WHEN digits rlike r'^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))' THEN 1 ELSE 0 END",
    "phone": r"CASE WHEN v rlike r'^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' THEN 1 WHEN v rlike r'^\+' THEN 0 ELSE -1 END",
}
_AGAINST = r"\b(?:version|build|order|invoice|isbn|sku|part|serial|rev|section|chapter|figure|ref|id|no)\b[^a-z]*$"
CUES = {
    "email": r"\b(?:e-?mail|contact|write|reach|correo|kontakt|courriel)\b",
    "ip": r"\b(?:ip|host|server|address|addr|login|client|peer)\b",
    "card": r"\b(?:card|credit|visa|mastercard|amex|payment|tarjeta|karte|carte)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|cell|telefon|telefono|appel)\b",
}
LABELERS = ("regex", "gazetteer", "context", "border")
ITERATIONS, ACCEPT = 30, 0.5
#: Hashed features of a span's and its context's characters; candidates of each sort that fit the classifier.
BUCKETS, TRAIN_SPANS = 512, 4000
#: Code points of the blocks in which a text is cut for redaction.
BLOCK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _case(by_kind: dict[str, str]) -> str:
    return "CASE s.kind " + " ".join(f"WHEN '{k}' THEN ({e})" for k, e in by_kind.items()) + " END"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(values: str, zero: str, step: str) -> str:
    """SQL: what a fold over an array of ints holds before each element. step has {a} and {x}.

    Appending to an array copies it, so runs of sqrt(n) elements are folded by themselves.
    """
    none, grow = "cast(array() as array<int>)", step.format(a="w.at", x="x")
    fold = f"(w, x) -> named_struct('at', {grow}, 'out', array_append(w.out, w.at))"
    runs = "transform(sequence(0, (size(vs) - 1) div wide), i -> slice(vs, i * wide + 1, wide))"
    totals = f"transform(runs, r -> aggregate(r, {zero}, (w, x) -> {step.format(a='w', x='x')}))"
    heads = f"aggregate({totals}, named_struct('at', {zero}, 'out', {none}), {fold}).out"
    each = f"flatten(zip_with(runs, {heads}, (r, h) -> aggregate(r, named_struct('at', h, 'out', {none}), {fold}).out))"
    full = _let("wide", "cast(ceil(sqrt(size(vs))) as int)", _let("runs", runs, each))
    return _let("vs", values, f"CASE WHEN size(vs) = 0 THEN {none} ELSE {full} END")


def _placed(name: str, kind: str, pattern: str, test: str) -> str:
    """SQL: the matches of a pattern in the column text, with offsets and what stands around.

    A split at a pattern gives what stands between its matches, so the matches' offsets
    are sums of lengths.
    """
    literal = "r'" + pattern + "'"
    near = "zip_with(zip_with(found, slice(gaps, 1, size(found)), (v, g) -> named_struct('v', v, 'gap', length(g), 'before', lower(right(g, 40)), 'last', right(g, 1))), slice(gaps, 2, size(found)), (s, g) -> named_struct('v', s.v, 'gap', s.gap, 'before', s.before, 'edge', concat(s.last, '|', left(g, 1))))"
    starts = _scan("transform(near, s -> s.gap + length(s.v))", "0", "{a} + {x}")
    each = f"zip_with(near, {starts}, (s, at) -> named_struct('name', '{name}', 'kind', '{kind}', 'start', at + s.gap, 'end', at + s.gap + length(s.v), 'v', s.v, 'digits', regexp_replace(s.v, '[^0-9]', ''), 'before', s.before, 'edge', s.edge))"
    none = "cast(array() as array<struct<name:string,kind:string,start:int,end:int,v:string,digits:string,before:string,edge:string>>)"
    own = _let("found", f"regexp_extract_all(text, {literal}, 0)", f"CASE WHEN size(found) = 0 THEN {none} ELSE {_let('gaps', f'split(text, {literal}, -1)', _let('near', near, each))} END")
    return f"CASE WHEN {test} THEN {own} ELSE {none} END"


def _features_sql() -> str:
    """SQL: hashed features of the characters of a span s and of those before it."""
    shape = f"left(translate(s.v, '{_UPPER}{_LOWER}0123456789', '{'A' * 26}{'a' * 26}{'9' * 10}'), 24)"
    pairs = _let("h", f"concat('^', {shape}, '$')", "transform(sequence(1, length(h) - 1), i -> concat('s', substring(h, i, 2)))")
    words = "array(concat('w', regexp_extract(s.before, '([a-z]+)[^a-z]*$', 1)), concat('v', regexp_extract(s.before, '([a-z]+)[^a-z]+[a-z]+[^a-z]*$', 1)))"
    triples = _let("h", "concat('^^', right(s.before, 12))", "transform(sequence(1, length(h) - 2), i -> concat('c', substring(h, i, 3)))")
    return f"transform(array_distinct(concat({pairs}, {words}, {triples})), f -> cast(pmod(xxhash64(s.kind, f), {BUCKETS}) as int))"


def candidates(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to keep) and spans: array of (at, start, end, kind, base,
    votes, features), by kind, then start."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    df = docs.select(kept.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    raw = ", ".join(_placed(name, *of) for name, of in PATTERNS.items())

    def on(sql: str) -> str:
        return re.sub(r"(?<![\w.'])(v|digits|before|edge)\b(?=[ ,)])", r"s.\1", sql)

    base = "CASE s.name " + " ".join(f"WHEN '{k}' THEN ({on(e)})" for k, e in CHECKS.items()) + " END"
    loose = "CASE s.name " + " ".join(f"WHEN '{k}' THEN ({on(e)})" for k, e in LOOSE.items()) + " ELSE false END"
    context = f"CASE WHEN s.before rlike r'{_AGAINST}' THEN 0 WHEN {_case({k: f"s.before rlike r'{c}'" for k, c in CUES.items()})} THEN 1 ELSE -1 END"
    votes = f"array(CASE WHEN coalesce({base}, false) THEN 1 WHEN s.name like 'loose%' THEN -1 ELSE 0 END, {_case({k: on(e) for k, e in GAZETTEER.items()})}, {context}, CASE WHEN s.edge rlike r'[A-Za-z0-9]' THEN 0 ELSE -1 END)"
    judged = f"filter(transform(concat({raw}), s -> named_struct('start', s.start, 'end', s.end, 'base', coalesce({base}, false), 'loose', coalesce({loose}, false), 'kind', s.kind, 'at', array_position(array({', '.join(repr(k) for k in KINDS)}), s.kind), 'votes', {votes}, 'features', {_features_sql()})), s -> s.base or s.loose)"
    # by start: a loose span is free if no base span before it ends, and none after it starts, within it
    before = _scan("transform(spans, s -> CASE WHEN s.base THEN s.end ELSE 0 END)", "0", "greatest({a}, {x})")
    after = f"reverse({_scan('reverse(transform(spans, s -> CASE WHEN s.base THEN s.start ELSE 2147483647 END))', '2147483647', 'least({a}, {x})')})"
    marked = f"zip_with(zip_with(spans, {before}, (s, b) -> named_struct('s', s, 'b', b)), {after}, (s, a) -> named_struct('s', s.s, 'free', s.s.base or (s.b <= s.s.start and a >= s.s.end)))"
    free = f"transform(filter({marked}, m -> m.free), m -> m.s)"
    apart = _let("spans", f"array_sort({judged})", f"CASE WHEN exists(spans, s -> not s.base) THEN {free} ELSE spans END")
    ordered = f"array_sort(transform({apart}, s -> named_struct('at', s.at, 'start', s.start, 'end', s.end, 'kind', s.kind, 'base', s.base, 'votes', s.votes, 'features', s.features)))"
    return df.select("row", "text", F.expr(ordered).alias("spans"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (kind, votes) pattern, by expectation-maximisation on its counts.

    Each labeler has a probability of each vote (for, against, abstention) given the truth,
    shared by all kinds; each kind has its own share of true spans.
    """
    belief = {}
    for kind, votes, _ in patterns:
        said = [v for v in votes if v >= 0]
        belief[kind, votes] = (sum(said) + 0.5) / (len(said) + 1)
    for _ in range(ITERATIONS):
        share: dict[str, list[float]] = {}
        table = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in LABELERS]  # by labeler, truth, vote; smoothed
        for kind, votes, n in patterns:
            p = belief[kind, votes]
            own = share.setdefault(kind, [1.0, 1.0])
            own[0] += n * (1 - p)
            own[1] += n * p
            for labeler, vote in enumerate(votes):
                table[labeler][0][vote + 1] += n * (1 - p)
                table[labeler][1][vote + 1] += n * p
        for kind, votes, _ in patterns:
            odds = math.log(share[kind][1] / share[kind][0])
            for labeler, vote in enumerate(votes):
                false, true = table[labeler]
                odds += math.log(true[vote + 1] / sum(true)) - math.log(false[vote + 1] / sum(false))
            belief[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def _votes_of(kind: str, votes: tuple[int, ...]) -> list[int]:
    """Features of kind and votes, beside those of the characters."""
    k = KINDS.index(kind)
    own = [k, *[4 + 3 * at + v + 1 for at, v in enumerate(votes)]]
    return own + [16 + 12 * at + 3 * k + votes[at] + 1 for at in (0, 1)]


VOTE_FEATURES = 40


def classifier(rows: list[tuple[str, tuple[int, ...], list[int]]], belief: dict[tuple[str, tuple[int, ...]], float], steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights (of votes, then of characters) and bias of a logistic regression on soft labels."""
    size = VOTE_FEATURES + BUCKETS
    if not rows:
        return np.zeros(size), -1.0
    own = [[*_votes_of(k, v), *[VOTE_FEATURES + f for f in sorted(set(fs))]] for k, v, fs in rows]
    y = np.array([belief[k, v] for k, v, _ in rows])
    owner, at = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own).astype(np.int64)
    # a span has few votes and many characters: they share their say evenly
    value = np.where(at < VOTE_FEATURES, 1.0, 0.25)
    w, b = np.zeros(size), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[at], minlength=len(own)) + b, -30, 30)))
        error = (p - y) / len(own)
        w -= 1.0 * (np.bincount(at, value * error[owner], minlength=size) + 1e-4 * w)
        b -= 1.0 * error.sum()
    return np.where(np.arange(size) < VOTE_FEATURES, w, 0.25 * w), b


def probability(model: tuple[np.ndarray, float], kind: str, votes: tuple[int, ...], features: list[int]) -> float:
    w, b = model
    return float(1 / (1 + np.exp(-(b + w[_votes_of(kind, votes)].sum() + w[VOTE_FEATURES:][features].sum()))))


def _score(model: tuple[np.ndarray, float]) -> str:
    """The classifier as SQL on a span s."""
    w, b = model
    of_votes, of_characters = (f"array({', '.join(repr(float(x)) + 'D' for x in part)})" for part in (w[:VOTE_FEATURES], w[VOTE_FEATURES:]))
    k = "cast(s.at as int) - 1"
    places = [k, *[f"{5 + 3 * at} + s.votes[{at}]" for at in range(4)], *[f"{17 + 12 * at} + 3 * ({k}) + s.votes[{at}]" for at in (0, 1)]]
    votes = " + ".join(f"{of_votes}[{p}]" for p in places)
    return f"{float(b)!r}D + {votes} + aggregate(array_distinct(s.features), 0D, (w, f) -> w + {of_characters}[f])"


def train(spans: DataFrame) -> tuple[np.ndarray, float]:
    """The span classifier, from all candidates (column spans of candidates())."""
    each = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features", "s.base", F.xxhash64("s.start", "s.kind", "s.features").alias("h"))
    counted = each.groupBy("kind", F.array_join(F.col("votes").cast("array<string>"), " ").alias("votes")).count().collect()
    belief = reliabilities(sorted((r["kind"], tuple(map(int, r["votes"].split())), r["count"]) for r in counted))
    rows = []
    for sort in ("base", "not base"):
        rows += [(r["kind"], tuple(r["votes"]), list(r["features"])) for r in each.where(sort).orderBy("h", "kind", "votes", "features").limit(TRAIN_SPANS).collect()]
    return classifier(sorted(rows), belief)


def _accepted(model: tuple[np.ndarray, float]) -> str:
    bound = math.log(ACCEPT / (1 - ACCEPT))
    return f"filter(spans, s -> s.base or {_score(model)} > {bound!r}D)"


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(candidates(docs, text_col=text_col, keep=[id_col]).drop("text"), "candidates")
    model = train(found)
    base = "filter(spans, s -> s.base)"
    out = found.withColumn("accepted", F.expr(_accepted(model)))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("row")[id_col].alias(id_col), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("accepted").alias("spans"), F.expr("cast(size(accepted) - size(filter(spans, s -> s.base)) as long)").alias("n_added"))


def _cut(a: str, b: str) -> str:
    """SQL: code points a to b of a text in blocks."""
    first, last = f"(({a}) div {BLOCK})", f"((({b}) - 1) div {BLOCK})"
    across = f"concat(substring(blocks[{first}], ({a}) % {BLOCK} + 1), array_join(slice(blocks, cast({first} as int) + 2, cast({last} - {first} as int) - 1), ''), substring(blocks[{last}], 1, (({b}) - 1) % {BLOCK} + 1))"
    return f"CASE WHEN ({b}) <= ({a}) THEN '' WHEN {first} = {last} THEN substring(blocks[{first}], ({a}) % {BLOCK} + 1, ({b}) - ({a})) ELSE {across} END"


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every accepted span replaced by its kind, as in <EMAIL>; other columns stay."""
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "pii-redact")
    model = train(scratch.write(candidates(docs, text_col=text_col).drop("text"), "candidates"))
    scratch.drop("candidates")
    own = candidates(docs, text_col=text_col, keep=names)
    order = f"array_sort(transform({_accepted(model)}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    ends = "transform(own, s -> s.end)"
    pieces = f"zip_with(own, {_scan(ends, '0', 'greatest({a}, {x})')}, (s, p) -> CASE WHEN s.start < p THEN '' ELSE concat({_cut('p', 's.start')}, '<', upper(s.kind), '>') END)"
    clean = f"concat(array_join({pieces}, ''), {_cut(f'array_max({ends})', 'length(text)')})"
    blocks = f"regexp_extract_all(text, r'(?s).{{1,{BLOCK}}}+', 0)"
    redacted = _let("own", order, f"CASE WHEN size(own) = 0 THEN cast(null as string) ELSE {_let('blocks', blocks, clean)} END")
    out = own.select("row", F.expr(redacted).alias("clean"))
    return out.select(*[F.coalesce("clean", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
