"""Conversations as a packed forest: shared first turns are emitted once.

Each turn becomes a formatted segment. Conversations that begin with the same segments share the
nodes of a prefix tree; a node is known by its depth and the sums of the digests of the (place,
segment) pairs that lead to it. Sums along conversations and among siblings give the nodes their
places, depth first. All sums are made range by range of a sort, so neither a conversation nor the
children of a shared first turn are gathered for them.
A node says at which position its first token stands in its conversation, and which intervals of
the sequence it may attend to besides its own earlier tokens: those of its ancestors.

A token is a code point of the formatted text, so the operator fits any tokenizer.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.sources.scratch import Workspace, stage


@dataclass(frozen=True)
class Template:
    """A turn is `open` role `says` text `close`. Inside role and text a backslash is doubled, and
    another one follows a bracket that begins like a control string; so none is left in them."""

    open: str = "<s>"
    says: str = "[INST]"
    close: str = "[/INST]</s>"
    learned: str = "assistant"


_BEGINS = r"([<\[])(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _BEGINS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segment(role: Column, text: Column, template: Template) -> Column:
    return F.concat(
        F.lit(template.open), escape(role), F.lit(template.says), escape(text), F.lit(template.close)
    )


def _dealt(rows: DataFrame, by: list, order: list[str], work: Workspace, name: str) -> DataFrame:
    """`rows` in the order of `order`, with `part`, the range of it that a row is in, and `number`.
    Rows that agree on `by`, which is coarser, are in one part."""
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*order)
    numbered = rows.withColumns(
        {"part": F.spark_partition_id(), "number": F.monotonically_increasing_id()}
    )
    return work.stage(numbered, name)


def _sums(rows: DataFrame, group: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """`rows` with the sums of `values` over the rows before in its group. A group is summed part by
    part, so a large one is spread like the others."""
    rows = rows.withColumns(values)
    before = lambda c, over: F.coalesce(
        F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    inside = Window.partitionBy("part", group).orderBy(*order)
    along = Window.partitionBy("_group").orderBy("_part")
    parts = rows.groupBy(F.col("part").alias("_part"), F.col(group).alias("_group")).agg(
        *[F.sum(v).alias(f"_{v}") for v in values]
    )
    parts = parts.select(
        "_part",
        "_group",
        *[before(f"_{v}", along).alias(f"_{v}") for v in values],
        F.row_number().over(along).alias("_nth"),
    )
    # A part begins with at most one group that goes on from the part before.
    parts = F.broadcast(parts.where("_nth > 1").drop("_nth"))
    summed = rows.withColumns({v: before(v, inside) for v in values})
    same = (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))
    found = summed.join(parts, same, "left")
    found = found.withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values})
    return found.drop("_part", "_group", *[f"_{v}" for v in values])


_LANES = [f"h{i}" for i in range(4)]


def _turns(turns: DataFrame, conv, turn, role, text, template: Template, work) -> tuple[DataFrame, DataFrame]:
    """(conv, c, number, part, depth, position, size, node, parent) and (number, role, segment) per
    turn; `c` is the number of the conversation's first turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        blank(role).alias("role"),
        blank(text).alias("text"),
    )
    rows = rows.withColumn("segment", segment(F.col("role"), F.col("text"), template)).drop("text")
    rows = rows.withColumn("size", F.char_length("segment").cast("long"))
    # Ranges are made from the beginnings of role and segment, as samples of them are collected.
    long_role = F.char_length("role") > 64
    by = ["conv", "turn", F.substring("role", 1, 64), long_role]
    by.append(F.when(~long_role, F.substring("segment", 1, 300)))
    order = ["conv", "turn", "role", "segment"]
    rows = _dealt(rows, by, order, work, "dealt")
    rows = _sums(rows, "conv", ["number"], {"depth": F.lit(1).cast("long"), "position": F.col("size")})
    digest = F.md5(F.concat_ws(" ", "depth", "segment"))
    rows = rows.withColumn("digest", digest)
    for i, lane in enumerate(_LANES):
        part = F.substring("digest", 8 * i + 1, 8)
        rows = rows.withColumn(f"own_{lane}", F.conv(part, 16, 10).cast("long"))
    rows = work.stage(rows.drop("turn", "digest"), "turns")
    first = F.when(F.col("depth") == 0, F.col("number")).otherwise(0)
    summed = _sums(
        rows.drop("role", "segment"),
        "conv",
        ["depth"],
        {**{h: F.col(f"own_{h}") for h in _LANES}, "c": first},
    )
    name = lambda depth, sums: F.md5(
        F.concat_ws(" ", depth, *[s.bitwiseAND(F.lit((1 << 32) - 1)) for s in sums]).cast("binary")
    )
    summed = summed.select(
        "conv",
        "number",
        "part",
        "depth",
        "position",
        "size",
        F.when(F.col("depth") == 0, F.col("number")).otherwise(F.col("c")).alias("c"),
        name(F.col("depth"), [F.col(h) + F.col(f"own_{h}") for h in _LANES]).alias("node"),
        F.when(F.col("depth") == 0, "")
        .otherwise(name(F.col("depth") - 1, [F.col(h) for h in _LANES]))
        .alias("parent"),
    )
    steps = work.stage(summed, "steps")
    return steps, rows.select("number", "role", "segment")


def pack(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sequence, members).

    `sequence`: one row per node: start and end (tokens of the one packed sequence), position (of
    the first token in its conversation), depth from 0, role, segment, loss_start and loss_end (the
    tokens to learn from: the text of a `learned` turn, else null), attends: [start, end) of each
    ancestor, root first. `members`: conv, the start of its last node, and of all its nodes.

    Turns are ordered by `turn`, ties by role and text, so repeated rows are turns of their own; a
    null turn comes first. Null role and text are empty. A null conv is a conversation. No rows
    give two empty tables. The places of a conversation's ancestors are gathered in one row, as they
    are in `attends`. Other columns are not read.
    """
    template = template or Template()
    spark = turns.sparkSession
    with Workspace(spark) as work:
        steps, said = _turns(turns, conv, turn, role, text, template, work)
        # All turns of a node are alike but for the conversation; the first one stands for them.
        nodes = steps.groupBy("node").agg(
            F.min(F.struct("c", "number", "parent", "depth", "position", "size")).alias("_")
        )
        nodes = work.stage(nodes.select("node", "_.*"), "nodes")
        # The nodes that a conversation stands for are the last ones of its path.
        own = nodes.groupBy("c").agg(F.sum("size").alias("own"), F.min("position").alias("from"))
        own = work.stage(own, "own")
        below = steps.select("node", "c").join(own, "c").groupBy("node").agg(F.sum("own").alias("below"))
        # Below a node are the own nodes of all its conversations but, of the one that stands for
        # it, those before.
        trees = nodes.join(own.select("c", "from"), "c").join(below, "node")
        trees = trees.select(
            "node", "parent", (F.col("below") - F.col("position") + F.col("from")).alias("tree")
        )
        by = ["parent", "node"]
        earlier = _sums(_dealt(trees, by, by, work, "trees"), "parent", ["node"], {"earlier": F.col("tree")})
        earlier = work.stage(earlier.select("node", "earlier"), "earlier")
        along = work.stage(steps.drop("parent").join(earlier, "node"), "along")
        along = _sums(along, "conv", ["depth"], {"shift": F.col("earlier")})
        start = F.col("position") + F.col("shift") + F.col("earlier")
        along = along.select("conv", "c", "number", start.alias("start"), "size")
        along = work.stage(along.withColumn("end", F.col("start") + F.col("size")), "placed")
        spans = along.groupBy("c").agg(
            F.first("conv").alias("conv"),
            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        )
        spans = stage(spans, "chat-spans")
        placed = nodes.join(along.select("number", "start", "end"), "number").join(said, "number")
        learned = F.col("role") == template.learned
        opening = F.char_length(escape(F.col("role"))) + len(template.open) + len(template.says)
        sequence = placed.select(
            "c",
            "start",
            "end",
            "position",
            F.col("depth").cast("int").alias("depth"),
            "role",
            "segment",
            F.when(learned, F.col("start") + opening).alias("loss_start"),
            F.when(learned, F.col("end") - len(template.close)).alias("loss_end"),
        )
        sequence = stage(sequence, "chat-sequence")
    # Written for each node, the places of its ancestors would take the square of a path's length.
    attends = F.slice("spans", F.lit(1), F.col("depth")).alias("attends")
    sequence = sequence.join(spans.select("c", "spans"), "c").select(
        *[c for c in sequence.columns if c != "c"], attends
    )
    members = spans.select(
        F.col("conv").alias(conv),
        F.element_at("spans", -1)["start"].alias("last"),
        F.col("spans")["start"].alias("path"),
    )
    return sequence, members


def read_back(sequence: DataFrame, members: DataFrame, conv: str = "conv_id", template: Template | None = None) -> DataFrame:
    """(conv, turns): each conversation's array of (role, text, learned_text, tokens), from the
    packed tables alone. `learned_text` is the text under the loss mask, null where nothing is
    learned."""
    template = template or Template()
    numbered = members.select(F.col(conv).alias("conv"), "path")
    numbered = numbered.withColumn("c", F.monotonically_increasing_id())
    starts = numbered.select("conv", "c", F.explode("path").alias("start"))
    body = F.substr(
        F.col("segment"),
        F.lit(len(template.open) + 1),
        F.char_length("segment") - len(template.open) - len(template.close),
    )
    at = F.instr(body, template.says)
    masked = F.substr(
        F.col("segment"),
        (F.col("loss_start") - F.col("start") + 1).cast("int"),
        (F.col("loss_end") - F.col("loss_start")).cast("int"),
    )
    read = sequence.select(
        "start",
        "position",
        unescape(F.substr(body, F.lit(1), at - 1)).alias("role"),
        unescape(F.substr(body, at + len(template.says))).alias("text"),
        unescape(masked).alias("learned_text"),
        (F.col("end") - F.col("start")).alias("tokens"),
    )
    turn = F.struct("position", "role", "text", "learned_text", "tokens")
    back = starts.join(read, "start").groupBy("c").agg(
        F.first("conv").alias(conv), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    return back.select(conv, "turns")
