"""Chat formatting of preference pairs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def _safe(x: Column) -> Column:
    """Text whose own ``<|`` cannot be taken for a marker: a backslash follows ``<`` before ``|`` or a backslash, which undoes uniquely."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"<([|\\])", r"<\\$1")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(turn["role"]), F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(END + "\n"))), "")


def _mask(turns: Column, role: str) -> Column:
    """Lengths of the completion's parts, in order, and whether each is learned: the ``role``'s text with its end marker."""

    def parts(t: Column) -> Column:
        text = F.length(_safe(t["text"])) + len(END)
        own = F.coalesce(t["role"] == role, F.lit(False))
        part = lambda n, learned: F.struct(n.cast("int").alias("length"), learned.alias("learned"))
        return F.array(part(F.length(_head(t)), F.lit(False)), part(text, own), part(F.lit(1), F.lit(False)))

    return F.flatten(F.transform(turns, parts))


def in_order(turns: Column) -> Column:
    """Turns in the order of (turn, role, text), nulls first."""
    return F.sort_array(turns)


def formatted(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """``pairs(pair_id, chosen_id, rejected_id, c, r)``, c and r arrays of struct(turn, role, text) -> what
    :func:`preference_pairs` returns. An empty or null array is a missing conversation. No shuffle."""
    there = lambda c, x: F.when(F.size(c) > 0, x)
    pairs = pairs.withColumns({x: F.coalesce(F.col(x), F.array().cast("array<struct<turn:bigint,role:string,text:string>>")) for x in ("c", "r")})
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differ = F.array_position(F.col("same"), F.lit(False))
    n = F.when(differ > 0, differ - 1).otherwise(F.size("same")).cast("int")
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    cut = pairs.withColumn("same", same).withColumn("n", n).select("*", F.slice("c", F.lit(1), F.col("n")).alias("both"), rest("c").alias("cc"), rest("r").alias("rr"))
    return cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").alias("common_turns"),
        _rendered(F.col("both")).alias("prompt"),
        there("c", _rendered(F.col("cc"))).alias("chosen"),
        there("r", _rendered(F.col("rr"))).alias("rejected"),
        there("c", _mask(F.col("cc"), role)).alias("chosen_mask"),
        there("r", _mask(F.col("rr"), role)).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """``turns(pair_id, chosen, conv_id, turn, role, text)`` -> one row per pair: pair_id, chosen_id, rejected_id,
    common_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    A turn is rendered as ``<|role|>`` line, text, ``<|end|>`` line. The longest common prefix of turns (equal role and
    text; nulls equal each other) is the prompt, rendered once; what follows in each conversation is its completion. A
    mask lists the completion's parts as (length, learned); learned are the ``role``'s texts with their end marker. The
    lengths of a mask add up to its completion.

    Turns are put in the order of (turn, role, text), nulls first, so ties and repeated rows have one result; repeated
    rows stay. Equal conversations have empty completions. Where one conversation of a pair is missing, the prompt is
    empty, and the missing completion and mask are null. Turns without pair_id or side belong to no pair. Null role or
    text is rendered as empty. Other columns take no part. One shuffle by pair, of the turns themselves.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    side = lambda own: in_order(F.collect_list(F.when(own, turn)))
    who = lambda own: F.min(F.when(own, F.col("conv_id")))
    yes = F.col("chosen")
    pairs = turns.where("pair_id is not null and chosen is not null").groupBy("pair_id")
    return formatted(pairs.agg(side(yes).alias("c"), side(~yes).alias("r"), who(yes).alias("chosen_id"), who(~yes).alias("rejected_id")), role)


def swapped_replies(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> pairs for :func:`formatted`, one per conversation that has a turn of ``role``:
    chosen is the conversation up to its last such turn, rejected the same with that turn's text replaced by the last
    one of its neighbour. Conversations 2k and 2k + 1 are neighbours. Where the neighbour has none, there is no rejected
    one. Turns without conv_id belong to no conversation. One shuffle, by k."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    side = lambda own: in_order(F.collect_list(F.when(own, turn)))
    two = turns.where("conv_id is not null").groupBy(F.shiftright("conv_id", 1).alias("k")).agg(side(~odd).alias("even"), side(odd).alias("odd"))
    last = lambda c: F.size(c) - F.array_position(F.reverse(F.transform(c, lambda t: F.coalesce(t["role"] == role, F.lit(False)))), F.lit(True)) + 1
    two = two.withColumns({"at0": last(F.col("even")).cast("int"), "at1": last(F.col("odd")).cast("int")})
    has = lambda c, at: F.col(at) <= F.size(c)
    reply = lambda c, at: F.when(has(c, at), F.get(F.col(c), F.col(at) - 1))

    def pair(own: str, at: str, other: str, at_other: str, bit: int) -> Column:
        chosen = F.slice(F.col(own), F.lit(1), F.col(at))
        mine, told = reply(own, at), reply(other, at_other)
        instead = F.struct(mine["turn"].alias("turn"), mine["role"].alias("role"), told["text"].alias("text"))
        rejected = F.when(told.isNotNull(), F.concat(F.slice(F.col(own), F.lit(1), F.col(at) - 1), F.array(instead)))
        conv = F.shiftleft("k", 1) + bit
        return F.when(has(own, at), F.struct(conv.alias("pair_id"), conv.alias("chosen_id"), F.when(told.isNotNull(), conv + (1 - 2 * bit)).alias("rejected_id"), chosen.alias("c"), rejected.alias("r")))

    each = two.select(F.explode(F.array(pair("even", "at0", "odd", "at1", 0), pair("odd", "at1", "even", "at0", 1))).alias("p"))
    return each.where("p is not null").select("p.*")


def op4_preference_chat(spark, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its last reply taken from its neighbour. Masks are written as ``length:learned``."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["length"].cast("string"), F.lit(":"), x["learned"].cast("int").cast("string"))), ",")
    return formatted(swapped_replies(turns)).withColumns({c: written(c) for c in ("chosen_mask", "rejected_mask")})


SQL = r"""
with own as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from conversations where conv_id is not null
), last as (
  select conv_id, max(k) as k from own where role = 'assistant' group by conv_id
), reply as (
  select conv_id, text from own join last using (conv_id, k)
), sides as (
  select o.conv_id as pair_id, true as chosen, o.k, o.role, o.text from own o join last l on l.conv_id = o.conv_id and o.k <= l.k
  union all
  select o.conv_id, false, o.k, o.role, case when o.k = l.k then r.text else o.text end
  from own o join last l on l.conv_id = o.conv_id and o.k <= l.k join reply r on r.conv_id = case when o.conv_id & 1 = 1 then o.conv_id - 1 else o.conv_id + 1 end
), t as (
  select pair_id, chosen, k, role as raw_role, text as raw_text, '<|' || regexp_replace(coalesce(role, ''), '<([|\\])', '<\\\1', 'g') || '|>' || chr(10) as head,
    regexp_replace(coalesce(text, ''), '<([|\\])', '<\\\1', 'g') as tt, case when role = 'assistant' then 1 else 0 end as learned
  from sides
), met as (
  select c.pair_id, c.k from t c join t r on c.pair_id = r.pair_id and c.k = r.k and c.chosen and not r.chosen
  where c.raw_role is not distinct from r.raw_role and c.raw_text is not distinct from r.raw_text
), prefix as (
  select pair_id, count(*) as n from (select pair_id, k, row_number() over (partition by pair_id order by k) as j from met) where k = j group by pair_id
), done as (
  select t.pair_id, chosen, any_value(coalesce(n, 0)) as n,
    coalesce(string_agg(head || tt || '<|end|>' || chr(10), '' order by k) filter (k <= coalesce(n, 0)), '') as prompt,
    coalesce(string_agg(head || tt || '<|end|>' || chr(10), '' order by k) filter (k > coalesce(n, 0)), '') as body,
    coalesce(string_agg(length(head) || ':0,' || (length(tt) + 7) || ':' || learned || ',1:0', ',' order by k) filter (k > coalesce(n, 0)), '') as mask
  from t left join prefix using (pair_id) group by t.pair_id, chosen
)
select c.pair_id, c.pair_id as chosen_id, case when r.pair_id is not null then case when c.pair_id & 1 = 1 then c.pair_id - 1 else c.pair_id + 1 end end as rejected_id,
  cast(c.n as int) as common_turns, c.prompt, c.body as chosen, r.body as rejected, c.mask as chosen_mask, r.mask as rejected_mask
from done c left join done r on r.pair_id = c.pair_id and not r.chosen where c.chosen
"""
