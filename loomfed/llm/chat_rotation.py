"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue the dialogue is rendered once, with that
speaker as ``assistant`` and the others as named users, and with the spans of
text that a loss may be taken on.  System turns are context: they are rendered
in every view under their own role and no one speaks as ``system``.

A turn is one segment ``<|im_start|>role name=speaker\\n text <|im_end|>\\n``.
Marks of the template in names and texts are written without their bars, and
line ends in names as spaces, so nobody's words can be taken for a turn.

A dialogue is rendered whole, in one row a participant; its turns are shuffled
once.  Only where dialogues may be too long for a row, ``max_turns`` cuts them
into windows of as many consecutive turn numbers (``part`` counts them, 0 for
whole dialogues), whose turns meet in different tasks.  Every participant of
the dialogue then has a view of each of its windows, those without a turn of
theirs included, and the system turns of earlier windows lead each later one.

Defined results: null roles speak as ``unknown`` and null texts are empty; ties
on the turn order by role, then by text; repeated rows are rendered each; rows
with a null dialogue or turn have no place in an order and are left out; a
dialogue of system turns only has no participant and no row; an empty table
gives an empty one; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text in which the template's own marks cannot be taken for marks."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))


def _name(who: Column) -> Column:
    return F.translate(_plain(who), "\r\n", "  ")


def _windows(rows: DataFrame) -> DataFrame:
    """``conv_id, part, speaker, turns`` of each window and participant."""
    # the two narrow tables are distinct by part first, so a long dialogue is grouped in many tasks
    roles = rows.select("conv_id", "part", F.col("t.who").alias("speaker")).distinct()
    speakers = roles.filter("speaker <> 'system'").select("conv_id", "speaker").distinct()
    windows = roles.select("conv_id", "part").distinct()
    early = rows.filter("t.who = 'system'").withColumnRenamed("part", "_from")
    carried = early.join(windows, "conv_id").filter(F.col("_from") < F.col("part")).select("conv_id", "part", "t")
    dialogue = rows.unionByName(carried).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return dialogue.join(speakers, "conv_id")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", max_turns: int | None = None) -> DataFrame:
    """One row per dialogue, part and participant.

    ``conv_id, part, speaker, n_turns, n_own_turns, rendered, mask``: ``mask``
    lists ``{start, end}`` in characters of ``rendered``, the end not included:
    the speaker's own words and the mark that ends them.
    """
    conv, turn, who, said = (F.col(f"`{c}`") for c in (conv_col, turn_col, speaker_col, text_col))
    part = F.floor(turn / max_turns).cast("long") if max_turns else F.lit(0).cast("long")
    rows = turns.filter(conv.isNotNull() & turn.isNotNull()).select(
        conv.alias("conv_id"),
        part.alias("part"),
        F.struct(turn.cast("long").alias("turn"), F.coalesce(who, F.lit("unknown")).alias("who"), _plain(F.coalesce(said, F.lit(""))).alias("said")).alias("t"),
    )
    if max_turns:
        views = _windows(rows)
    else:
        dialogue = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
        speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["who"]), lambda w: w != "system"))
        views = dialogue.withColumn("speaker", F.explode(speakers))

    def head(t: Column) -> Column:
        own = F.concat(F.lit(OPEN + "assistant\n"))
        system = F.lit(OPEN + "system\n")
        other = F.concat(F.lit(OPEN + "user name="), _name(t["who"]), F.lit("\n"))
        return F.when(t["who"] == F.col("speaker"), own).when(t["who"] == "system", system).otherwise(other)

    segments = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"), (t["who"] == F.col("speaker")).alias("own")))
    cut = views.withColumn("s", segments)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        spans = F.when(s["own"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return cut.select(
        "conv_id",
        "part",
        "speaker",
        F.size("s").alias("n_turns"),
        F.size(F.filter("s", lambda x: x["own"])).alias("n_own_turns"),
        F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("s", zero, walk, lambda acc: acc["spans"]).alias("mask"),
    )
