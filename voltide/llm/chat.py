"""Chat formatting: a dialogue rendered once from the perspective of each of its participants.

Only DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that one row renders; longer dialogues have several rows, whose offsets go on.
TURNS_PER_PART = 64


def _head(role: Column, speaker: Column, shared: Sequence[str]) -> Column:
    """What stands before a message: the speaker is the assistant, others are named users, shared roles keep theirs."""
    return (
        F.when(role.isin(list(shared)), F.concat(F.lit("<|im_start|>"), role, F.lit("\n")))
        .when(role == speaker, F.lit("<|im_start|>assistant\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), role, F.lit("\n")))
    )


def perspectives(conversations: DataFrame, shared: Sequence[str] = ("system",), turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row for each conversation, participant and part of ``turns_per_part`` turn numbers.

    (conv_id, speaker, part, n_messages, text, spans, text_start): ``text`` is the part's rendering, ``spans`` the mask: half-open
    character ranges in it that the speaker's messages (with their end mark) take; all other characters are masked out.
    ``text_start`` is where the part starts in the whole dialogue, whose text is that of its parts one after another.

    Participants are a conversation's roles but for those in ``shared``. A dialogue of shared roles alone has no rows. A null role
    reads ``unknown``, a null text as an empty one; a null turn comes first, as turn 0's part. Rows equal in conv_id, turn, role and
    text are one message; otherwise equal turns are put in the order of role and text. Rows without a conv_id are one dialogue.
    """
    c = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    part = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / turns_per_part).cast("long").alias("part")
    messages = c.distinct()
    parts = messages.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    # Nulls sort last in array_sort, first is asked for.
    parts = parts.withColumn("m", F.concat(F.filter("m", lambda m: m["turn"].isNull()), F.filter("m", lambda m: m["turn"].isNotNull())))
    speakers = c.where(~F.col("role").isin(list(shared))).groupBy(F.col("conv_id").alias("s_conv"), F.col("role").alias("speaker")).agg(F.lit(1).alias("one"))
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("s_conv"))).drop("s_conv", "one")
    tail = F.lit("<|im_end|>\n")
    pieces = both.withColumn(
        "p",
        F.transform("m", lambda m: F.struct(F.concat(_head(m["role"], F.col("speaker"), shared), m["text"], tail).alias("s"), F.char_length(_head(m["role"], F.col("speaker"), shared)).alias("h"), (m["role"] == F.col("speaker")).alias("own"))),
    )
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        to = acc["at"] + F.char_length(p["s"])
        own = F.array(F.struct((acc["at"] + p["h"]).alias("start"), (to - 1).alias("end")))
        return F.struct(to.alias("at"), F.when(p["own"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    done = pieces.select("conv_id", "speaker", "part", F.size("m").alias("n_messages"), F.array_join(F.transform("p", lambda p: p["s"]), "").alias("text"), F.aggregate("p", start, step).alias("acc"))
    done = done.select("conv_id", "speaker", "part", F.col("n_messages").cast("long").alias("n_messages"), "text", F.col("acc.spans").alias("spans"), F.col("acc.at").cast("long").alias("n_chars"))
    return done.select("conv_id", "speaker", "part", "n_messages", "n_chars", _start(), "text", "spans")


def _start() -> Column:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n_chars").over(w), F.lit(0)).cast("long").alias("text_start")


def digest(rendered: DataFrame) -> DataFrame:
    """The rendering with its spans as text and its number of unmasked characters, to compare and count by."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    kept = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return rendered.select("conv_id", "speaker", "part", "n_messages", "n_chars", "text_start", "text", spans.alias("spans"), kept.alias("n_unmasked"))


#: The same in DuckDB.
SQL = f"""
with c as (
  select distinct conv_id, cast(turn as bigint) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
), s as (select distinct conv_id, role as speaker from c where role not in ('system')),
m as (
  select c.conv_id, s.speaker, cast(floor(coalesce(c.turn, 0) / {TURNS_PER_PART}.0) as bigint) as part, c.turn, c.role, c.text, c.role = s.speaker as own,
    case when c.role in ('system') then '<|im_start|>' || c.role || chr(10) when c.role = s.speaker then '<|im_start|>assistant' || chr(10)
      else '<|im_start|>user name=' || c.role || chr(10) end as head
  from c join s on c.conv_id is not distinct from s.conv_id
), o as (
  select *, length(head || text || '<|im_end|>' || chr(10)) as n,
    sum(length(head || text || '<|im_end|>' || chr(10))) over (partition by conv_id, speaker, part order by turn nulls first, role, text rows unbounded preceding) as upto
  from m
), g as (
  select conv_id, speaker, part, count(*) as n_messages, cast(sum(n) as bigint) as n_chars,
    string_agg(head || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) as text,
    coalesce(string_agg(cast(upto - n + length(head) as varchar) || '-' || cast(upto - 1 as varchar), ',' order by turn nulls first, role, text) filter (where own), '') as spans,
    cast(coalesce(sum(n - length(head) - 1) filter (where own), 0) as bigint) as n_unmasked
  from o group by 1, 2, 3
)
select conv_id, speaker, part, n_messages, n_chars,
  cast(coalesce(sum(n_chars) over (partition by conv_id, speaker order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as text_start,
  text, spans, n_unmasked
from g
"""
