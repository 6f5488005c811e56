"""Chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of the whole dialogue in which they are the
assistant and all others are named users; loss masks mark the assistant's own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adapterlens.llm.common import table

#: Turns that share one output row. Longer dialogues continue in further rows.
TURNS_A_ROW = 256


def rotate(turns: DataFrame, turns_a_row: int = TURNS_A_ROW) -> DataFrame:
    """Render turns(conv_id, turn, role, text) once per participant.

    Returns conv_id, perspective, chunk, start, text, masks. A turn reads
    `<|assistant|>\\n{text}<|end|>\\n` if the perspective's speaker says it, else
    `<|user name={role}|>\\n{text}<|end|>\\n`. Concatenated by chunk, the texts of one
    (conv_id, perspective) are its rendering; start is where a chunk begins in it. masks lists
    start:end (end exclusive, code points in the whole rendering), comma-joined, for the
    assistant's text with its end mark; all else carries no loss.

    Turns go by turn, role, text; nulls first. A null role is the participant `unknown`, a null
    text is empty, a null conv_id is a dialogue of its own. Repeated rows are spoken twice.
    Further columns are ignored. An empty table gives none.

    A chunk holds the turns of one block of `turns_a_row` turn numbers, null ones in chunk -1, and is
    gathered once; offsets are sums over blocks and participants, numbers only, and texts are
    rendered last, so no participant's copy of a text is shuffled.
    """
    said = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / turns_a_row), F.lit(-1)).cast("long").alias("chunk"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("said"),
    )
    head = lambda role, own: F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    body = lambda text: F.concat(text, F.lit("<|end|>"))

    # Lengths of a block as its participants and the others see it: all as user turns, and what is
    # shorter where the speaker is the perspective.
    as_user = F.length(head(F.col("role"), F.lit(False))) + F.length(body(F.col("said"))) + 1
    saved = F.length(head(F.col("role"), F.lit(False))) - F.length(head(F.col("role"), F.lit(True)))
    by_role = said.groupBy("conv_id", "chunk", "role").agg(F.sum(as_user).alias("n"), F.sum(saved).alias("saved"))
    blocks = by_role.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("role", "saved"))).alias("saved"))
    speakers = by_role.select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    lengths = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", "chunk", "perspective", (F.col("n") - F.coalesce(F.try_element_at("saved", F.col("perspective")), F.lit(0))).alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    views = starts.groupBy(F.col("conv_id").alias("conv"), F.col("chunk").alias("block")).agg(F.collect_list(F.struct("perspective", "start")).alias("views"))

    gathered = said.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "said"))).alias("turns"))
    rows = gathered.join(views, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("chunk") == F.col("block")))
    rows = rows.select("conv_id", "chunk", "turns", F.inline("views"))
    own = lambda t: t["role"] == F.col("perspective")
    zero = F.struct(F.col("start").alias("at"), F.expr("cast(array() as array<string>)").alias("masks"))

    def step(acc, t):
        begin = acc["at"] + F.length(head(t["role"], own(t)))
        end = begin + F.length(body(t["said"]))
        mask = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(own(t), F.array_append(acc["masks"], mask)).otherwise(acc["masks"]).alias("masks"))

    return rows.select(
        "conv_id",
        "perspective",
        "chunk",
        "start",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t["role"], own(t)), body(t["said"]), F.lit("\n"))), "").alias("text"),
        F.array_join(F.aggregate("turns", zero, step, lambda acc: acc["masks"]), ",").alias("masks"),
    )


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue as each of its participants sees it. Nulls, ties, repeats: as `rotate` says."""
    return rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = f"""
with said as (
  select conv_id, coalesce(cast(floor(turn / {TURNS_A_ROW}) as bigint), -1) as chunk, turn,
    coalesce(role, 'unknown') as role, coalesce(text, '') as said from conversations),
speakers as (select distinct conv_id, role as perspective from said),
pieces as (
  select s.conv_id, p.perspective, s.chunk, s.turn, s.role, s.said, s.role = p.perspective as own,
    case when s.role = p.perspective then '<|assistant|>' else '<|user name=' || s.role || '|>' end || chr(10) as head,
    s.said || '<|end|>' as body
  from said s join speakers p on s.conv_id is not distinct from p.conv_id),
placed as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (
    partition by conv_id, perspective order by chunk, turn nulls first, role, said
    rows between unbounded preceding and 1 preceding), 0) as pos from pieces)
select conv_id, perspective, chunk, cast(min(pos) as bigint) as "start",
  string_agg(head || body || chr(10), '' order by turn nulls first, role, said) as text,
  coalesce(string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)), ',' order by pos) filter (own), '') as masks
from placed group by conv_id, perspective, chunk
"""
