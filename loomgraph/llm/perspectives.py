r"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every speaker of a conversation the dialogue is rendered with that speaker as assistant and the others as named users. Context roles (system)
stay what they are in every perspective and are nobody's. A message is `<|im_start|>role[ name=speaker]\ncontent<|im_end|>\n`; the mask holds the spans (code
points of the rendered text, end exclusive) of content and end mark of the assistant's messages, the only ones to train on.

A dialogue is rendered in parts, to be concatenated in order. One law holds at every size: a message weighs its bytes and MESSAGE_WEIGHT, and its part is the weight of the messages before it in the conversation over PART_WEIGHT, rounded
down; so a part holds some 1,024 messages or 16 MiB, beside the last one, and a usual conversation is one part. Weights are summed by conversation, block of turns, turn and leading digits of the hash that orders a turn's messages, so no
conversation is ordered in one task, however hot; those of one part need no sums but their total. Texts are shuffled once, to their part: the pairs of part and speaker come from keys alone, salted, and meet the texts where these are.

Messages are ordered by turn, MD5 of the text, and speaker (null first). Defined cases: a null text is empty; a null speaker is a participant of its own, rendered
without a name; a null turn comes before all others; a null conv_id is a conversation; repeated rows (same conversation, turn, speaker and text) are one message, and counted in
n_rows; a conversation that has context alone has no participants and so no rows; texts are kept
as they are, even where they hold the marks <|im_start|> or <|im_end|>, and the mask is counted from lengths, so it is right then too (neutralise them before tokenizing, if the tokenizer reads them as marks); the result has a
row for each participant and part, and so grows with messages times participants, which is what is asked for; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_WEIGHT, MESSAGE_WEIGHT = 16 << 20, 16 << 10
#: Turns whose weights are summed together first.
BLOCK_TURNS = 4096
SALTS = 16
CONTEXT = ("system",)
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _before(sums: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """sums with the weight of what stands before each row within its group."""
    return sums.withColumn(name, F.sum("w").over(Window.partitionBy(*within).orderBy(*order)) - F.col("w"))


def _parts(messages: DataFrame) -> DataFrame:
    """Distinct messages (ck, turn, h, role, mk, weight) to (ck, mk, part)."""
    m = messages.select("ck", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"), "turn", F.substring("h", 1, 3).alias("lead"), "h", "role", "mk", F.col("weight").alias("w"))
    # Null turns have keys of their own for the joins.
    m = m.withColumns({"bk": F.coalesce(F.col("block").cast("string"), F.lit("none")), "tk": F.coalesce(F.col("turn").cast("string"), F.lit("none"))})
    by_lead = m.groupBy("ck", "bk", "block", "tk", "turn", "lead").agg(F.sum("w").alias("w"))
    by_turn = by_lead.groupBy("ck", "bk", "block", "tk", "turn").agg(F.sum("w").alias("w"))
    by_block = by_turn.groupBy("ck", "bk", "block").agg(F.sum("w").alias("w"))
    at = _before(m, ["ck", "tk", "lead"], ["h", "role"], "a")
    at = at.join(_before(by_lead, ["ck", "tk"], ["lead"], "b").select("ck", "tk", "lead", "b"), ["ck", "tk", "lead"])
    at = at.join(_before(by_turn, ["ck", "bk"], ["turn"], "c").select("ck", "tk", "c"), ["ck", "tk"])
    at = at.join(_before(by_block, ["ck"], ["block"], "d").select("ck", "bk", "d"), ["ck", "bk"])
    return at.select("ck", "mk", F.floor((F.col("a") + F.col("b") + F.col("c") + F.col("d")) / PART_WEIGHT).alias("part"))


def _placed(conversations: DataFrame) -> DataFrame:
    """One row per message, or copy of it: conv_id, ck (the conversation, never null), turn, h, role, text, copies, part."""
    turn, text = F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    ck = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    rows = conversations.select("conv_id", ck.alias("ck"), turn.alias("turn"), F.md5(text.cast("binary")).alias("h"), "role", text.alias("text"), (F.octet_length(text).cast("long") + MESSAGE_WEIGHT).alias("weight"), F.lit(1).cast("long").alias("copies"))
    large = rows.groupBy("ck").agg(F.sum("weight").alias("w")).where(F.col("w") > PART_WEIGHT).select("ck")
    first = F.lit(0).cast("long").alias("part")
    columns = ["conv_id", "ck", "turn", "h", "role", "text", "copies"]
    if large.isEmpty():
        return rows.select(*columns, first)
    # Repeated rows are counted before any of them is shuffled to a part.
    message = ["conv_id", "ck", "turn", "h", "role", "text", "weight"]
    inside = rows.join(large, "ck", "left_semi").groupBy(*message).agg(F.sum("copies").alias("copies"))
    mk = F.md5(F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("none")), "h", F.coalesce(F.concat(F.lit("v"), "role"), F.lit("n"))).cast("binary"))
    inside = inside.withColumn("mk", mk)
    placed = inside.join(_parts(inside.select("ck", "turn", "h", "role", "mk", "weight")), ["ck", "mk"])
    return rows.join(large, "ck", "left_anti").select(*columns, first).unionByName(placed.select(*columns, "part"))


def perspectives(conversations: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """conv_id, perspective (the speaker), part, n_rows, messages (array of role, name, content, train), text, mask (array of start, end)."""
    placed = _placed(conversations)
    key = F.concat_ws("|", F.col("part").cast("string"), "ck")
    own_words = ~F.coalesce(F.col("role").isin(*context), F.lit(False))
    # Part and speaker, from keys alone.
    salt = F.pmod(F.hash("part"), F.lit(SALTS))
    cells = placed.select(key.alias("cell"), "ck", salt.alias("salt")).distinct()
    speakers = placed.where(own_words).select("ck", F.col("role").alias("perspective")).distinct()
    speakers = speakers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    views = cells.join(speakers, ["ck", "salt"]).select("cell", "perspective")
    # The texts, shuffled to their part.
    message = F.struct("turn", "h", "role", "text")
    parts = placed.withColumn("cell", key).groupBy("cell").agg(F.first("conv_id").alias("conv_id"), F.first("part").alias("part"), F.sum("copies").alias("n_rows"), F.array_sort(F.collect_set(message)).alias("m"))

    def turned(m):
        aside = F.coalesce(m["role"].isin(*context), F.lit(False))
        own = ~aside & m["role"].eqNullSafe(F.col("perspective"))
        role = F.when(aside, m["role"]).when(own, "assistant").otherwise("user")
        name = F.when(~aside & ~own, F.regexp_replace(m["role"], r"[\x00-\x1F\x7F]", " "))
        return F.struct(role.alias("role"), name.alias("name"), m["text"].alias("content"), own.alias("train"))

    def head(x):
        return F.concat(F.lit(BEGIN), x["role"], F.coalesce(F.concat(F.lit(" name="), x["name"]), F.lit("")), F.lit("\n"))

    seen = parts.join(views, "cell").select("conv_id", "perspective", "part", "n_rows", F.transform("m", turned).alias("messages"))
    text = F.array_join(F.transform("messages", lambda x: F.concat(head(x), x["content"], F.lit(END + "\n"))), "")
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(s, x):
        start = s["at"] + F.length(head(x))
        end = start + F.length(x["content"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["train"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    mask = F.aggregate("messages", F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans")), step, lambda s: s["spans"])
    return seen.select("*", text.alias("text"), mask.alias("mask"))
