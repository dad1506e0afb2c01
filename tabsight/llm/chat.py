"""Chat formatting as a prefix tree.

Conversations that share their initial turns share those turns' nodes. The tree is laid out depth
first and each node's text is emitted once, in *runs*: the part of a conversation that no earlier one
(in the order of the paths) has emitted. A token here is a code point of the formatted text.

* A node is named by hashing its path; its owner is the first conversation through it, found as a
  pre-aggregated minimum, so a first turn shared by a third of all conversations is no hot group.
* Conversations are ordered by their paths (the turns' hashes, concatenated), which is a depth-first
  order of the tree; run offsets are prefix sums of partition totals, as in sharding.
* Position ids count along the path: a run's tokens are at ``position``, ``position + 1``, ...
* Attention: a run's tokens attend, besides causally to their own run, to ``ancestors``, the
  intervals of the packed tree that hold its path; adjacent ones are merged.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside roles and texts a backslash is
doubled and every control string (of this template, and of others in use) gets a backslash after its
first character, so that no control string is left; dropping one backslash of each escape undoes it.

Defined results: turns are ordered by turn number (nulls first), then role and text, so ties and
repeated rows are turns of their own; a null text or role is an empty one; conversations with a
null id form one conversation. A conversation is put together in one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabsight.llm.common import ship, stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of chat templates, none of which may stand in a formatted text by itself.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
           "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its (escaped) text starts and ends in it."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


_PATHS = ("conv long, path binary, nodes array<binary>, lengths array<int>, at array<long>, pieces array<string>, "
          "loss array<struct<start:int,end:int>>")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: its path, and per turn the node's name, length, place, formatted text and loss span."""
    for batch in batches:
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            path, nodes, lengths, at, pieces, loss, above, upto = [], [], [], [], [], [], b"", 0
            for turn in turns:
                role, text = turn["role"].as_py() or "", turn["text"].as_py() or ""
                piece, start, end = format_turn(role, text)
                own = hashlib.blake2b(piece.encode(), digest_size=16).digest()
                above = hashlib.blake2b(above + own, digest_size=16).digest()
                path.append(own)
                nodes.append(above)
                pieces.append(piece)
                lengths.append(len(piece))
                at.append(upto)
                upto += len(piece)
                loss.append({"start": start, "end": end} if role == LOSS_ROLE else {"start": 0, "end": 0})
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([b"".join(path)], pa.binary()), pa.array([nodes], pa.list_(pa.binary())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([at], pa.list_(pa.int64())), pa.array([pieces], pa.list_(pa.string())),
                 pa.array([loss], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["conv", "path", "nodes", "lengths", "at", "pieces", "loss"])


def pack(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, members) of a table with conv_id, turn, role and text.

    *runs*: one row per conversation that adds nodes: ``run``, ``tree``, ``start`` and ``end`` in the
    packed tree, ``position`` of its first token, ``text``, ``loss`` (spans of the run's text whose
    tokens count in the loss) and ``ancestors`` (intervals of the tree to attend to).
    *members*: per conversation and interval of its path, in order: ``conv_id``, ``nth``, ``tree``, the ``run``
    that holds it, and ``start`` and ``end`` in the tree.
    """
    ship(conversations.sparkSession)
    turns = F.sort_array(F.collect_list(F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv")).agg(turns.alias("turns"))
    paths = whole.select("conv", "turns").mapInArrow(_paths, _PATHS)
    n_parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in depth-first order; the id that follows rises with it, and is kept by writing the rows
    ordered = stored(paths.repartitionByRange(n_parts, "path", "conv").sortWithinPartitions("path", "conv")
                     .withColumn("rank", F.monotonically_increasing_id()), "paths")

    # every node of every path, with the tokens before it on the path
    steps = (ordered.select("rank", F.col("nodes")[0].alias("tree"), F.arrays_zip(
        F.col("nodes").alias("node"), F.col("lengths").alias("length"), "at").alias("steps"))
        .select("rank", "tree", F.posexplode("steps").alias("depth", "step"))
        .select("rank", "tree", "depth", "step.node", "step.length", "step.at"))
    owners = steps.groupBy("node").agg(F.min("rank").alias("owner"))
    owned = (steps.select("rank", "tree", "depth", "node", "length", "at").join(owners, "node")
             .groupBy("rank", "tree", "owner")
             .agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("length")).alias("to"), F.min("depth").alias("depth")))
    owned = stored(owned, "owned")

    # run offsets: totals by partition of the order, then running sums inside each
    runs = (owned.where("rank = owner").select("rank", "tree", "depth", F.col("from").alias("position"),
                                               (F.col("to") - F.col("from")).alias("size"))
            .withColumn("part", F.shiftright("rank", 33)))
    totals = runs.groupBy("part").agg(F.sum("size").alias("all"))
    offsets = totals.select("part", F.coalesce(F.sum("all").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = runs.withColumn("upto", upto).join(F.broadcast(offsets), "part").select(
        "rank", "tree", "depth", "position", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("global"))
    roots = runs.where("depth = 0").select("tree", F.col("global").alias("root"))
    runs = stored(runs.join(roots, "tree").select(
        "rank", "tree", "depth", "position", "size", (F.col("global") - F.col("root")).alias("start")), "runs")

    # the intervals of each path: a run's tokens sit at start + (place on the path - position)
    places = runs.select(F.col("rank").alias("owner"), (F.col("start") - F.col("position")).alias("shift"))
    spans = stored(owned.join(places, "owner").select(
        "rank", "tree", "owner", "from", (F.col("shift") + F.col("from")).alias("start"),
        (F.col("shift") + F.col("to")).alias("end")), "spans")
    above = (spans.where("rank <> owner").groupBy("rank").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
        CASE WHEN size(a) > 0 AND get(a, size(a) - 1).end = s.start
             THEN concat(slice(a, 1, size(a) - 1), array(struct(get(a, size(a) - 1).start AS start, s.end AS end)))
             ELSE concat(a, array(struct(s.start AS start, s.end AS end))) END)""")
    above = above.select("rank", merged.alias("ancestors"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pieces = ordered.select("rank", "pieces", "at", "loss")
    texts = runs.join(pieces, "rank").join(above, "rank", "left").select(
        F.col("rank").alias("run"), "tree", "start", (F.col("start") + F.col("size")).alias("end"), "position",
        F.expr("array_join(slice(pieces, depth + 1, size(pieces)), '')").alias("text"),
        F.expr("""filter(transform(sequence(depth, size(at) - 1), i -> struct(
            at[i] - at[depth] + loss[i].start AS start,
            at[i] - at[depth] + loss[i].end AS end)),
            s -> s.end > s.start)""").alias("loss"),
        F.coalesce("ancestors", none).alias("ancestors"))
    convs = ordered.select("rank", F.col("conv").alias("conv_id"))
    members = spans.join(convs, "rank").select(
        "conv_id", F.col("from").alias("nth"), "tree", F.col("owner").alias("run"), "start", "end")
    return stored(texts, "texts"), stored(members, "members")


def read_back(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation from the packed trees: ``conv_id``, ``formatted`` and ``loss`` (the escaped
    texts under the loss mask, in order)."""
    held = runs.select("run", F.col("start").alias("run_start"), "text", "loss")
    parts = members.join(held, "run").select(
        "conv_id", "nth", F.expr("substr(text, int(start - run_start) + 1, int(end - start))").alias("part"),
        F.expr("""transform(filter(loss, s -> s.start >= start - run_start AND s.end <= end - run_start),
                  s -> substr(text, int(s.start) + 1, int(s.end - s.start)))""").alias("under"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "part", "under"))).alias("p"))
    return whole.select("conv_id", F.expr("array_join(transform(p, x -> x.part), '')").alias("formatted"),
                        F.expr("flatten(transform(p, x -> x.under))").alias("loss"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation of :func:`read_back`: turns, loss text and lengths as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, formatted, loss in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                turns = parse(formatted)
                learnt = "".join(unescape(x) for x in loss)
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt),
                            hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[
                    "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ship(read.sparkSession)
    return read.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
