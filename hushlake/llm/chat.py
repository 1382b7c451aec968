"""Chat formatting: a multi-party dialogue from the view of each who takes part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose lengths are summed up in one task.
RUN = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


#: What can't stand in a name, and how it is written there; no two speakers are written alike.
ESCAPES = {"%": "%25", "<": "%3C", " ": "%20", "\n": "%0A", "\r": "%0D"}


def _shown(speaker: str) -> Column:
    c = F.col(speaker)
    for x, y in ESCAPES.items():
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def rotate(turns: DataFrame) -> DataFrame:
    """Each dialogue (conv_id, turn, role, text) once for every speaker in it but "system", that speaker as the assistant.

    One row per perspective and turn: conv_id, perspective, turn, speaker, piece (the turn as
    rendered), start (its place in the dialogue, in code points), and mask_start and mask_end, the span
    that is learned: what the assistant says, with its end mark; null in the turns of others. Other
    speakers are users with their names (``ESCAPES`` for what can't stand there), system turns stay what they are. Pieces in the order of start
    make up the dialogue. Turns go by number (null first), role and text; equal rows stay each. A null
    role is the speaker "unknown", a null text is empty. Marks in a text are broken up by a space. A
    dialogue of system turns alone has no perspective. Rows of a null conv_id are one dialogue.

    A dialogue of very many turns is no group: lengths are summed in runs of RUN turn numbers and
    carried on by the runs' sums.
    """
    name = F.coalesce("role", F.lit("unknown"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), name.alias("speaker"), text.alias("said"), (F.coalesce("role", F.lit("")) == "system").alias("rule"))
    views = t.where(~F.col("rule")).select(F.col("conv_id").alias("own"), F.col("speaker").alias("perspective")).distinct()
    t = t.join(views, t["conv_id"].eqNullSafe(views["own"])).drop("own")
    mine = ~F.col("rule") & (F.col("speaker") == F.col("perspective"))
    head = F.when(F.col("rule"), F.lit(f"{OPEN}system\n")).when(mine, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), _shown("speaker"), F.lit("\n")))
    t = t.withColumn("trained", mine).withColumn("head", head).withColumn("piece", F.concat("head", "said", F.lit(CLOSE)))
    t = t.withColumn("n", F.length("piece").cast("long")).withColumn("run", F.floor(F.coalesce("turn", F.lit(-1 << 63)) / RUN).cast("long"))
    keys = ["conv_id", "perspective"]
    runs = t.groupBy(*keys, "run").agg(F.sum("n").alias("chars"))
    past = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("run").alias("r"), F.coalesce(F.sum("chars").over(past), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "piece").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    t = t.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("run") == F.col("r")))
    start = F.col("before") + F.col("within")
    mask = start + F.length("head")
    return t.select(
        *["conv_id", "perspective", "turn", "speaker", "piece"],
        start.alias("start"),
        F.when(F.col("trained"), mask).alias("mask_start"),
        F.when(F.col("trained"), start + F.col("n")).alias("mask_end"),
    )


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker,
         replace(coalesce(text, ''), '<|', '< |') as said, coalesce(role, '') = 'system' as rule
  from conversations),
v as (select distinct conv_id as own, speaker as perspective from t where not rule),
j as (
  select t.*, v.perspective, (not rule and speaker = perspective) as trained,
         case when rule then '<|im_start|>system' || chr(10)
              when speaker = perspective then '<|im_start|>assistant' || chr(10)
              else '<|im_start|>user name=' || replace(replace(replace(replace(replace(speaker, '%', '%25'), '<', '%3C'), ' ', '%20'), chr(10), '%0A'), chr(13), '%0D') || chr(10) end as head
  from t join v on t.conv_id is not distinct from v.own),
p as (select *, head || said || '<|im_end|>' || chr(10) as piece from j),
s as (
  select *, coalesce(sum(length(piece)) over (partition by conv_id, perspective order by turn nulls first, speaker, piece rows between unbounded preceding and 1 preceding), 0) as start
  from p)
select conv_id, perspective, turn, speaker, piece, cast(start as bigint) as start,
       case when trained then cast(start + length(head) as bigint) end as mask_start,
       case when trained then cast(start + length(piece) as bigint) end as mask_end
from s
"""
