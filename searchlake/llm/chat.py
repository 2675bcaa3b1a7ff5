"""Chat formatting as prefix trees.

A conversation's turns (by turn, then role and text for ties) are a path; conversations
that share initial turns share the nodes of those turns, and a node's formatted text is
emitted once in its tree. Nodes are laid out depth first: offsets in a tree's sequence,
position ids (counted along the path, so a branch continues its parent's positions) and
the intervals of the sequence that a node attends to besides itself (its ancestors,
adjacent ones merged).

Template. A user turn is "[INST] text [/INST]", an assistant turn "text</s>", any other
role "[TURN]role[/TURN]text</s>"; a tree's root stands after "<s>". In texts and roles a
backslash, and a bracket that would begin a control string, are replaced by a backslash
and a letter, so no control string is left in them and nothing is lost. The loss mask
covers assistant texts, without their end mark.

Method. A node is known by a chained hash of its turns. Every conversation has a random rank;
the least rank that passes through a node owns it, so a conversation owns the end of its path
from where it leaves lower ranks: its segment. Children are laid out with the owner's first, so
a segment lies in one piece, and the segments that branch off it follow, the deepest branch
first. A segment's place in its tree is the path of (branch depth, rank) pairs from the root;
ranks being random, that path is about as long as the logarithm of the number of
conversations, whatever the depth of the tree. Sorting by these paths is the depth-first order,
and running sums of segment lengths over it are the offsets. Ancestors of a node are one
interval for each segment on its path.

Distribution. Conversations are read as sorted streams, in memory bounded by one turn; all
else is groupings with partial aggregation, joins and a range sort in the JVM. A tree of any
size is emitted once, in as many tasks as the sort gives: running sums are taken per range,
and what lies in earlier ranges of a tree is added. Nodes on very many paths (over a
thousandth of all turns, so under a thousand nodes) are broadcast in joins, others shuffled.

Cases: null text and null role count as empty; null turns sort first, ties of turns by role and
text; a null conv_id is a conversation; repeated rows are turns of their own; equal
conversations share all nodes; very long texts are held one at a time; extra columns aren't
read; an empty table gives no trees.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch

#: Rows of one key that a join shuffles; keys of more are broadcast, at most a thousand of them.
HOT_ROWS = 100_000
#: Code points of the mark that a tree starts with.
START = 3
_ESCAPE = re.compile(r"\\|\[(?=/?(?:INST|TURN)\])|<(?=/?s>)")
_TO, _FROM = {"\\": "\\b", "[": "\\l", "<": "\\g"}, {"\\b": "\\", "\\l": "[", "\\g": "<"}
_BACK = re.compile(r"\\[blg]")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _FROM[m[0]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and start and end of its loss mask."""
    own = escape(text)
    if role == "user":
        return f"[INST] {own} [/INST]", 0, 0
    if role == "assistant":
        return f"{own}</s>", 0, len(own)
    return f"[TURN]{escape(role)}[/TURN]{own}</s>", 0, 0


_TURN = re.compile(r"(?s)\[INST\] (?P<user>.*?) \[/INST\]|\[TURN\](?P<role>.*?)\[/TURN\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, without its start mark."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            yield "user", unescape(m["user"])
        elif m["role"] is not None:
            yield unescape(m["role"]), unescape(m["other"])
        else:
            yield "assistant", unescape(m["assistant"])
        at = m.end()


_LINKS = "conv_id {id}, rank long, depth int, tree binary, node binary, parent binary, pos_start long, segment string, mask_start int, mask_end int"


def links(conversations: DataFrame) -> DataFrame:
    """One row per turn: its conversation and the rank of that, depth, tree (root node), node
    (chained hash) and formatted segment. Ranks are distinct: a number scattered by a bijection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depth, parent, root, position = object(), 0, None, b"", START
        number = TaskContext.get().partitionId() << 40
        rank = 0
        for batch in batches:
            rows = []
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for conv, role, text in zip(ids, roles, texts, strict=True):
                segment, a, b = format_turn(role, text)
                if depth == 0 or conv != now:
                    now, depth, parent, position = conv, 0, None, START
                    number += 1
                    rank = (number * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)
                node = hashlib.blake2b((parent or b"") + segment.encode("utf-8", "replace"), digest_size=16).digest()
                if depth == 0:
                    root = node
                rows.append((conv, rank, depth, root, node, parent, position, segment, a, b))
                depth, parent, position = depth + 1, node, position + len(segment)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _LINKS.split(", ")])

    turns = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, _LINKS.format(id=dict(conversations.dtypes)["conv_id"]))


def _lookup(rows: DataFrame, key: str, found: DataFrame, bound: int) -> DataFrame:
    """Inner join with a table that has each key once and, in the column n, no fewer than the rows that ask
    for it. Keys of more than bound rows are broadcast: there are at most (all rows / bound) of them."""
    hot = found.where(F.col("n") > bound).drop("n").withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    mine = [c for c in rows.columns if c != key]
    rest = met.where("__hot is null").select(key, *mine).join(found.where(F.col("n") <= bound).drop("n"), key)
    return met.where("__hot").drop("__hot").unionByName(rest)


def prefix_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths). nodes: tree, node, parent, owner, conv_id (of the owner), depth, segment,
    seq_start, seq_end, pos_start, mask_start, mask_end (loss, in the sequence), attend (array of
    intervals), n (conversations through it). paths: one row per turn of a conversation with its
    rank, conv_id, depth, node and the node's owner."""
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = scratch.write(links(conversations), "links")
    bound = max(HOT_ROWS, turns.count() // 1000)
    owners = scratch.write(turns.groupBy("node").agg(F.min("rank").alias("owner"), F.count("*").alias("n")), "owners")
    light = turns.select("conv_id", "rank", "depth", "tree", "node", "parent", "pos_start", F.length("segment").cast("long").alias("size"))
    paths = scratch.write(_lookup(light, "node", owners.withColumn("through", F.col("n")), bound), "paths")
    first = F.min(F.struct("depth", "pos_start", "tree", "parent"))
    own = paths.where("rank = owner").groupBy("rank").agg(first.alias("f"), F.sum("size").alias("size"), F.count("*").alias("owned"), F.max("through").alias("n"))
    segments = scratch.write(own.select("rank", "f.*", "size", "n", (F.col("f.depth") + F.col("owned")).alias("turns")), "segments")

    # level by level: what branches off segments that have a place gets its own
    step = "struct<seg:long,from:long,to:long>"
    placed = scratch.write(segments.where("depth = 0").select("rank", "tree", "depth", "pos_start", "size", "n", "turns", F.array().cast("array<struct<up:int,rank:long>>").alias("place"), F.array().cast(f"array<{step}>").alias("hops")), "level-0")
    levels = [placed]
    upper = owners.select(F.col("node").alias("parent"), F.col("owner").alias("above"), "n")
    open_ = scratch.write(_lookup(segments.where("depth > 0"), "parent", upper, bound), "branches")
    left = open_.count()
    while left:
        over = levels[-1].select(F.col("rank").alias("above"), F.col("place").alias("p"), F.col("hops").alias("h"), F.col("pos_start").alias("q"), "n")
        met = _lookup(open_, "above", over, bound)
        place = F.concat("p", F.array(F.struct((-F.col("depth")).alias("up"), F.col("rank").alias("rank"))))
        hops = F.concat("h", F.array(F.struct(F.col("above").alias("seg"), F.col("q").alias("from"), F.col("pos_start").alias("to"))))
        levels.append(scratch.write(met.select("rank", "tree", "depth", "pos_start", "size", "n", "turns", place.alias("place"), hops.alias("hops")), f"level-{len(levels)}"))
        left -= levels[-1].count()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)

    ordered = every.repartitionByRange("tree", "place").sortWithinPartitions("tree", "place").withColumn("part", F.spark_partition_id())
    ordered = scratch.write(ordered, "ordered")
    before = Window.partitionBy("part", "tree").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("tree", "part").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("tree", "part", F.sum("size").over(earlier).alias("carried")).where("carried > 0")  # fewer rows than ranges
    seated = ordered.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(F.broadcast(carried), ["tree", "part"], "left")
    seats = scratch.write(seated.select("rank", "depth", "pos_start", "n", "turns", "hops", (START + F.col("before") + F.coalesce("carried", F.lit(0))).alias("seq")), "seats")

    asked = seats.where(F.size("hops") > 0).select("rank", F.posexplode("hops").alias("i", "hop")).select("rank", "i", "hop.*")
    starts = _lookup(asked, "seg", seats.select(F.col("rank").alias("seg"), "seq", "n"), bound)
    interval = F.struct(F.when(F.col("seq") > START, F.col("seq")).otherwise(0).cast("long").alias("start"), (F.col("seq") + F.col("to") - F.col("from")).alias("end"))
    above = starts.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("i", interval.alias("v")))).alias("above"))
    full = seats.join(above, "rank", "left").select("rank", F.col("depth").alias("from"), F.col("pos_start").alias("origin"), "seq", F.col("turns").alias("n"), F.coalesce(F.col("above.v"), F.array().cast("array<struct<start:long,end:long>>")).alias("above"))
    mine = _lookup(turns, "rank", scratch.write(full, "full"), bound).where(F.col("depth") >= F.col("from"))
    start = F.col("seq") + F.col("pos_start") - F.col("origin")
    root = F.when(F.col("seq") > START, F.col("seq")).otherwise(0).cast("long")
    attend = F.when(start > root, F.concat("above", F.array(F.struct(root.alias("start"), start.alias("end"))))).otherwise(F.col("above"))
    laid = mine.select("tree", "node", "parent", F.col("rank").alias("owner"), "conv_id", "depth", "segment", start.alias("seq_start"), (start + F.length("segment")).alias("seq_end"), "pos_start", (start + F.col("mask_start")).alias("mask_start"), (start + F.col("mask_end")).alias("mask_end"), attend.alias("attend"))
    nodes = scratch.write(_lookup(laid, "node", owners.select("node", F.col("n").alias("through"), F.lit(1).cast("long").alias("n")), bound).withColumnRenamed("through", "n"), "nodes")
    return nodes, paths.select("rank", "conv_id", "depth", "node", "owner")


def digests(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per conversation, read back from the trees: n_turns, digests and sizes."""
    said = ["segment", (F.col("mask_start") - F.col("seq_start")).alias("a"), (F.col("mask_end") - F.col("seq_start")).alias("b")]
    own = nodes.select(F.col("owner").alias("rank"), "conv_id", "depth", *said)
    shared = _lookup(paths.where("rank <> owner").drop("owner"), "node", nodes.where("n > 1").select("node", *said, "n"), max(HOT_ROWS, paths.count() // 1000))
    text = own.unionByName(shared.drop("node"))
    kind = dict(paths.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return (now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted)

        now, n, turns, loss, loss_chars, formatted = None, 0, None, None, 0, 0
        id_type, names = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            id_type = batch.schema.field(0).type
            for conv, depth, segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if depth == 0:
                    if turns is not None:
                        rows.append(row())
                    now, n, turns, loss, loss_chars, formatted = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 3
                for role, said in parse(segment):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    n += 1
                masked = unescape(segment[a:b])
                loss.update(masked.encode("utf-8", "replace"))
                loss_chars += len(masked)
                formatted += len(segment)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [id_type, *kinds], strict=True)], names=names)
        if turns is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), [id_type, *kinds], strict=True)], names=names)

    ordered = text.repartition("rank").sortWithinPartitions("rank", "depth").select("conv_id", "depth", "segment", "a", "b")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The laid-out nodes of all trees."""
    return prefix_trees(conversations)[0]


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[/?(?:INST|TURN)\]|</?s>')) AS n,
         length(role) + len(regexp_extract_all(role, '\\|\[/?(?:INST|TURN)\]|</?s>')) AS r
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 4 ELSE n + r + 17 END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
