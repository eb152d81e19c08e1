"""Preference formatting: a shared prompt and two masked completions for a pair of conversations.

The longest common turn prefix of both conversations is rendered once as prompt; the
turns after it are the completions. The first differing turn of a pair is a minimum over
turn digests (aggregated before the shuffle), and each turn finds its part by comparing
its number with it. A record holds up to ``CHUNK`` turns of each part; a longer pair goes on
in further records, so a conversation of any length needs no task to hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

#: Marks around a rendered turn.
HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
#: Turns of one part in a record, and different rows of one turn that stay together.
CHUNK = 256


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations (conv_id, turn, role, text): pair_id, side, turn, role, text.

    Both sides of a pair are the turns of one conversation up to its last assistant turn;
    the rejected side has the last answer of its neighbour (the id with the lowest bit
    flipped) in place of its own, or none if the neighbour never answers. Of several rows
    with the last turn's number the greatest text is the answer; a conversation without answer is whole
    on both sides; null ids are one conversation without neighbour, a null turn number counts as -1.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    answered = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    answers = materialise(answered.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("answer")), "answers")
    own = answers.select(F.col("conv_id").alias("own"), "last_turn", "answer")
    other = answers.select(F.expr("conv_id ^ 1").alias("other"), F.col("answer").alias("instead"))
    joined = turns.join(own, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(other, F.col("conv_id") == F.col("other"), "left").filter("last_turn IS NULL OR turn <= last_turn")
    is_last = F.coalesce((F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant") & (F.col("text") == F.col("answer")), F.lit(False))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text")), F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.col("instead")).otherwise(F.col("text")).alias("text"))))
    return joined.select("conv_id", "turn", "role", sides.alias("s")).filter("s.text IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "s.side", "turn", "role", "s.text")


def digest(side: str) -> Column:
    """Order-free digest of one side's rows of a turn: their number and sums of two hashes."""
    one = F.col("side") == side
    h = [F.when(one, F.xxhash64("role", "text", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return F.struct(F.count_if(one).alias("n"), *(F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")).alias(f"h{i}") for i, x in enumerate(h)))


def format_preferences(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One record a pair (or more, see chunk): pair_id, chunk, shard, prompt, chosen, rejected, chosen_loss, rejected_loss.

    ``turns``: pair_id, side (chosen or rejected), turn, role, text. Turns are aligned by
    their number; several rows of one number form one turn, in the order of role and
    text, and equal ones count once. The prompt is rendered once, from the chosen side. The losses
    list the character ranges "first-end" of a completion that are learnt, joined by
    commas: text and end mark of its assistant turns. Null role or text render as empty, a
    null turn number counts as -1, equal conversations are all prompt, a side without
    partner has no prompt, a part without turns is empty, and null pair ids are one pair.
    Turns further than ``chunk`` numbers from their part's first go to records with a chunk
    of 1 and more; a turn of more than ``chunk`` rows is dealt over records with a shard of 1 and more.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = turns.select(
        F.col("pair_id").cast("bigint").alias("pair_id"), "side", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = materialise(rows.distinct(), "turns")
    by_turn = rows.groupBy("pair_id", "turn").agg(digest("chosen").alias("c"), digest("rejected").alias("r"))
    splits = by_turn.groupBy(F.col("pair_id").alias("of")).agg(F.min("turn").alias("first"), F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("split"), F.max(F.greatest("c.n", "r.n")).alias("most"))
    header = F.concat(F.lit(HEAD), "role", F.lit("\n"))
    joined = rows.join(materialise(splits, "splits"), F.col("pair_id").eqNullSafe(F.col("of"))).withColumn("is_prompt", F.col("split").isNull() | (F.col("turn") < F.col("split")))
    away = F.col("turn").cast("double") - F.when(F.col("is_prompt"), F.col("first")).otherwise(F.col("split")).cast("double")
    shards = F.ceil(F.col("most") / F.lit(chunk))
    placed = joined.filter(~F.col("is_prompt") | (F.col("side") == "chosen")).select(
        "pair_id",
        F.floor(away / chunk).cast("bigint").alias("chunk"),
        F.pmod(F.conv(F.substring(F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")), 1, 8), 16, 10).cast("bigint"), shards).cast("bigint").alias("shard"),
        F.when(F.col("is_prompt"), "prompt").otherwise(F.col("side")).alias("part"),
        F.struct("turn", "role", "text", F.concat(header, "text", F.lit(TAIL)).alias("rendered"), F.char_length(header).alias("head")).alias("t"),
    )
    parts = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("t")))).alias(p) for p in ("prompt", "chosen", "rejected")]

    def rendered(part: str) -> Column:
        return F.array_join(F.transform(part, lambda t: t["rendered"]), "")

    def loss(part: str) -> Column:
        def step(a: Column, t: Column) -> Column:
            end = a["at"] + F.char_length(t["rendered"])
            learnt = F.concat(a["spans"], F.array(F.concat_ws("-", a["at"] + t["head"], end)))
            return F.struct(end.alias("at"), F.when(t["role"] == "assistant", learnt).otherwise(a["spans"]).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
        return F.array_join(F.aggregate(part, start, step)["spans"], ",")

    return placed.groupBy("pair_id", "chunk", "shard").agg(*parts).select(
        "pair_id", "chunk", "shard", *(rendered(p).alias(p) for p in ("prompt", "chosen", "rejected")), *(loss(p).alias(f"{p}_loss") for p in ("chosen", "rejected"))
    )
