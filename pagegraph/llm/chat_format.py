"""Multi-party perspective rotation of chats, in DataFrame operations only.

Every distinct speaker but `system` is a participant. For each participant the
whole dialogue is rendered with that speaker as assistant, other speakers as
named users, system turns as they are:

    <|assistant|>\\ntext<|end|>\\n    <|user name=NAME|>\\ntext<|end|>\\n    <|system|>\\ntext<|end|>\\n

A row is one turn under one perspective: its segment, where it starts in the
rendered dialogue (code points) and, for the assistant's turns, the masked-in
span [loss_start, loss_end) of text and end mark. Segments of a perspective in
order of seg_start are the dialogue; it is never gathered, so a conversation of
any length fits. Starts are prefix sums over a tree of fixed blocks of turns:
no window holds more than a block's rows, whatever a conversation's share.

Defined results: turns sort by turn (null first), then md5 of speaker and text;
equal rows follow each other; a null or empty role is the speaker `unknown`; a
null text is empty; a null conversation is one of its own; a conversation with
system turns alone has the perspective null and no loss; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; b's keys go."""
    right = b.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(right, cond, how).drop(*[f"_{k}" for k in keys])


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fan: int = 64) -> DataFrame:
    """One row per turn, copy and perspective; see the module."""
    spoken = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.nullif(F.col(role_col), F.lit("")), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    spoken = spoken.withColumn("tie", F.md5(F.concat("speaker", F.lit("\n"), "text").cast("binary")))
    people = spoken.where("speaker <> 'system'").select("conv", F.col("speaker").alias("perspective")).distinct()
    rows = _same(spoken, people, ["conv"], "left")
    mine = F.col("speaker").eqNullSafe(F.col("perspective"))
    header = F.when(F.col("speaker") == "system", "system").when(mine, "assistant").otherwise(F.concat(F.lit("user name="), "speaker"))
    rows = rows.withColumn("chat_role", F.when(F.col("speaker") == "system", "system").when(mine, "assistant").otherwise("user"))
    rows = rows.withColumn("head", F.concat(F.lit("<|"), header, F.lit("|>\n"))).withColumn("size", F.length("head") + F.length("text") + F.lit(len(END)))
    rows = rows.withColumn("tie_block", F.substring("tie", 1, 2)).withColumn("b1", F.expr(f"turn div {fan}")).withColumn("b2", F.expr(f"turn div {fan**3}"))
    whole = F.sum(F.col("size") * F.col("copies")).alias("total")
    who = ["conv", "perspective"]

    def before(keys: list[str], order: list[str], size: str, as_name: str):
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(w), F.lit(0)).alias(as_name)

    cells = rows.groupBy(*who, "b2", "b1", "turn", "tie_block").agg(whole)
    low = cells.groupBy(*who, "b2", "b1").agg(F.sum("total").alias("total"))
    top = low.groupBy(*who, "b2").agg(F.sum("total").alias("total"))
    top = top.select(*who, "b2", before(who, ["b2"], "total", "s2"))
    low = low.select(*who, "b2", "b1", before([*who, "b2"], ["b1"], "total", "s1"))
    cells = cells.select(*who, "b2", "b1", "turn", "tie_block", before([*who, "b2", "b1"], ["turn", "tie_block"], "total", "s0"))
    starts = _same(_same(cells, low, [*who, "b2", "b1"]), top, [*who, "b2"]).select(*who, "turn", "tie_block", (F.col("s0") + F.col("s1") + F.col("s2")).alias("cell_start"))
    rows = rows.withColumn("span", F.col("size") * F.col("copies"))
    rows = rows.select("*", before([*who, "turn", "tie_block"], ["tie", "speaker", "text"], "span", "inside"))
    placed = _same(rows, starts, [*who, "turn", "tie_block"])
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    placed = placed.withColumn("seg_start", F.col("cell_start") + F.col("inside") + F.col("copy") * F.col("size"))
    loss = F.col("chat_role") == "assistant"
    return placed.select(
        F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "speaker", "chat_role", F.concat("head", "text", F.lit(END)).alias("segment"), "seg_start",
        F.when(loss, F.col("seg_start") + F.length("head")).alias("loss_start"), F.when(loss, F.col("seg_start") + F.col("size") - 1).alias("loss_end"), loss.cast("int").alias("loss_mask"),
    )
