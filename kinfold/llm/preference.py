"""Chat formatting for preference data. DataFrame functions only.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (same role and text, place by place) is the prompt and
is rendered once; what follows on each side is its completion. A turn is rendered as ``<|role|>\\n text <|end|>\\n``; the loss mask of a
completion covers text and end mark of its assistant turns, nothing of the prompt. ``<|`` inside a text is written ``< |``, so no text can pose as a mark.

The result has one row a turn and part (prompt, chosen, rejected) with its offset in the part, so a conversation of any length is never gathered in one
task: places and offsets are running sums in two levels over spans of ``span`` turn numbers. Concatenating the segments of a part in order
of ``seq`` gives its text (``render``, for conversations that fit a row).

Defined cases: a null role is ``user``, a null text empty. Turns are ordered by (turn, role, text), null turns first; equal turns stay both. A side without turns
leaves the other whole as completion. Equal conversations give a prompt and no completion. A null pair id or side is dropped. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import shared

#: The template's marks.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def format_pairs(turns: DataFrame, span: int = 256) -> DataFrame:
    """``turns``: pair_id, side (chosen or rejected), turn, role, text. Per turn and part: pair_id, part, seq, role, segment, start, mask_start, mask_end (-1: no loss).

    Whole turns cross the network twice: once to be ordered within spans of turn numbers, once to meet one small row a span, which says where the span begins and where the
    two sides part. What lies between works on hashes and lengths.
    """
    tmp = shared.Scratch(turns.sparkSession, "preference")
    keys = ["pair_id", "side", "span"]
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |"))
    t = turns.select("pair_id", "side", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
    t = t.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    t = t.withColumn("span", F.coalesce(F.floor(F.col("turn") / span), F.lit(-1 << 62)))  # null turns come first
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(CLOSE))
    t = t.withColumn("segment", F.concat(head, F.col("text"), F.lit(END))).withColumn("size", F.length("segment"))
    order = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    t = t.withColumn("inner", F.row_number().over(order) - 1).withColumn("inner_size", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    t = tmp.write(t.select(*keys, "inner", "inner_size", "role", "segment", "size", F.length(head).alias("head")))

    spans = t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    ahead = Window.partitionBy("pair_id", "side").orderBy("span")
    spans = tmp.write(spans.select(*keys, (F.sum("n").over(ahead) - F.col("n")).alias("before"), (F.sum("s").over(ahead) - F.col("s")).alias("before_size")))
    # both sides of a place meet on (pair, place), as a hash of 128 bits: never a whole conversation
    slim = t.select(*keys, "inner", "inner_size", F.xxhash64("role", "segment").alias("h"), F.xxhash64(F.lit("second"), "segment", "role").alias("g")).join(spans, keys)
    place = slim.groupBy("pair_id", (F.col("before") + F.col("inner")).alias("at")).agg(F.count("*").alias("sides"), F.min(F.col("before_size") + F.col("inner_size")).alias("start"), *[f(c).alias(f"{n}_{c}") for c in "hg" for n, f in (("lo", F.min), ("hi", F.max))])
    apart = (F.col("sides") < 2) | (F.col("lo_h") != F.col("hi_h")) | (F.col("lo_g") != F.col("hi_g"))
    cut = place.groupBy("pair_id").agg(F.min(F.when(apart, F.struct("at", "start"))).alias("x"), F.max("at").alias("most"))
    cut = cut.select("pair_id", F.coalesce("x.at", F.col("most") + 1).alias("first"), F.coalesce("x.start", F.lit(0)).alias("base"))
    marks = tmp.write(spans.join(cut, "pair_id"))

    t = t.join(marks, keys).withColumn("at", F.col("before") + F.col("inner")).withColumn("prompt", F.col("at") < F.col("first"))
    t = t.filter(~F.col("prompt") | (F.col("side") == "chosen"))
    here = lambda c, base: F.when(F.col("prompt"), c).otherwise(c - base).cast("long")
    t = t.withColumn("seq", here(F.col("at"), F.col("first"))).withColumn("start", here(F.col("before_size") + F.col("inner_size"), F.col("base")))
    loss = ~F.col("prompt") & (F.col("role") == "assistant")
    begin = F.when(loss, F.col("start") + F.col("head")).otherwise(-1).cast("long")
    end = F.when(loss, F.col("start") + F.col("size") - 1).otherwise(-1).cast("long")
    return t.select("pair_id", F.when(F.col("prompt"), "prompt").otherwise(F.col("side")).alias("part"), "seq", "role", "segment", "start", begin.alias("mask_start"), end.alias("mask_end"))


def render(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected as whole texts and the loss spans of both completions; for conversations that fit a row."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "")
    spans = F.array_sort(F.collect_list(F.when(F.col("mask_start") >= 0, F.struct("mask_start", "mask_end"))))
    parts = segments.groupBy("pair_id", "part").agg(one.alias("text"), spans.alias("spans"))
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    return parts.groupBy("pair_id").agg(*[F.coalesce(pick(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")], pick("chosen", "spans").alias("chosen_spans"), pick("rejected", "spans").alias("rejected_spans"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs made of a table without any: chosen is a conversation up to its last assistant turn; rejected is the same with that answer replaced by the
    last answer of the conversation whose id differs in the lowest bit. Without an answer or a neighbour with one, only chosen has turns. A turn without a number is no answer; it
    belongs to both sides."""
    c = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter("pair_id is not null")
    answers = c.filter("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("a"))
    answers = shared.Scratch(conversations.sparkSession, "answers").write(answers.select("pair_id", F.col("a.turn").alias("last"), F.col("a.text").alias("answer")))
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("answer").alias("wrong"))
    both = answers.join(other, "pair_id").select("pair_id", "last", "wrong")
    early = F.col("turn").isNull() | (F.col("turn") < F.col("last"))
    sides = F.when(F.col("last").isNull() | (F.col("turn") == F.col("last")), F.array(F.lit("chosen"))).when(early, F.array(F.lit("chosen"), F.lit("rejected")))
    kept = c.join(both.select("pair_id", "last"), "pair_id", "left").select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")
    swap = both.select("pair_id", F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("wrong").alias("text"))
    return kept.unionByName(swap)


#: The query over ``conversations`` in DuckDB's SQL, with one plain window a conversation.
SQL = """
WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, role AS raw_role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
answers AS (SELECT pair_id, max(turn) AS fin FROM c WHERE raw_role = 'assistant' GROUP BY pair_id),
answer AS (SELECT a.pair_id, a.fin, max(c.text) AS answer FROM answers a JOIN c ON c.pair_id = a.pair_id AND c.turn = a.fin AND c.raw_role = 'assistant' GROUP BY ALL),
both_sides AS (SELECT a.pair_id, a.fin, b.answer AS wrong FROM answer a JOIN answer b ON b.pair_id = xor(a.pair_id, 1)),
t AS (
  SELECT c.pair_id, 'chosen' AS side, turn, role, text FROM c LEFT JOIN both_sides b ON b.pair_id = c.pair_id WHERE b.fin IS NULL OR turn IS NULL OR turn <= b.fin
  UNION ALL SELECT c.pair_id, 'rejected', turn, role, text FROM c JOIN both_sides b ON b.pair_id = c.pair_id WHERE turn IS NULL OR turn < b.fin
  UNION ALL SELECT pair_id, 'rejected', fin, 'assistant', wrong FROM both_sides),
r AS (SELECT pair_id, side, turn, role, replace(text, '<|', '< |') AS text FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM r),
place AS (SELECT pair_id, pos, count(*) AS sides, count(DISTINCT (role, text)) AS kinds FROM o GROUP BY ALL),
f AS (SELECT pair_id, coalesce(min(CASE WHEN sides < 2 OR kinds > 1 THEN pos END), max(pos) + 1) AS cut FROM place GROUP BY pair_id),
p AS (SELECT o.pair_id, CASE WHEN pos < cut THEN 'prompt' ELSE side END AS part, CASE WHEN pos < cut THEN pos ELSE pos - cut END AS seq, role, '<|' || role || '|>' || chr(10) AS head, text
  FROM o JOIN f USING (pair_id) WHERE pos >= cut OR side = 'chosen'),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM p),
w AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT pair_id, part, seq::BIGINT AS seq, role, segment, start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) ELSE -1 END::BIGINT AS mask_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(segment) - 1 ELSE -1 END::BIGINT AS mask_end
FROM w"""
