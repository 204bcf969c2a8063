"""Quotation linking: conversations in reply order, without their quotes. DataFrame functions only.

The lines of a message are split into runs of one quote level and, at blank lines, into passages. Passages and their
lines are normalised and hashed; a quoted one is joined to the first message of its thread that has it as text of its
own. A message replies to the latest message that it quotes at the lowest level. Roots and depths come from pointer
doubling over the reply links, in about log2 of the deepest reply rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

MARKS = r"^(?:[ \t]*>)+[ \t]?"
ATTRIBUTION = r"(?i)^\s*(?:(?:on|am|le|el)\b.*\b)?(?:wrote|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """messages: thread, seq, text. One row per line with thread, seq, line, level, body, passage (a number within the message)."""
    lines = messages.select("thread", "seq", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "raw"))
    level = F.length(F.regexp_replace(F.regexp_extract("raw", MARKS, 0), "[^>]", ""))
    lined = lines.withColumn("level", level).withColumn("body", F.regexp_replace("raw", MARKS, ""))
    order = Window.partitionBy("thread", "seq").orderBy("line")
    before, after = F.lag("level").over(order), F.lead("level").over(order)
    intro = (F.col("level") == 0) & (F.coalesce(after, F.lit(0)) > 0) & F.col("body").rlike(ATTRIBUTION)
    marked = lined.withColumn("starts", (F.coalesce(before, F.lit(-1)) != F.col("level")) | (F.trim("body") == "")).withColumn("intro", intro)
    return marked.withColumn("passage", F.sum(F.col("starts").cast("int")).over(order)).filter("not intro").drop("starts", "intro", "raw")


def reply_order(messages: DataFrame, thread_col: str = "conv_id", seq_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per message (thread and seq): thread, seq, parent_seq, root_seq, depth, n_quotes, n_linked, clean_text.

    Ordering by thread, root_seq, depth, seq reads each conversation in reply order. A message that quotes nothing known
    is a root. A quoted passage goes to the earliest message that has all of it; one that no message has whole goes by its
    lines, each to the earliest message that has it, and of these the latest counts. Quotes of later messages are not linked.
    Rows that repeat a thread and seq are one message, the one with the smallest text. A null text has no lines; a very
    long one has all its lines. Null threads or seqs are left out. Extra columns are not read; an empty table gives no rows.
    """
    store = Scratch(messages.sparkSession)
    keyed = messages.select(F.col(thread_col).cast("long").alias("thread"), F.col(seq_col).cast("long").alias("seq"), F.col(text_col).alias("text"))
    once = keyed.filter("thread is not null and seq is not null").groupBy("thread", "seq").agg(F.min("text").alias("text"))
    lines = store.keep(passages(once))
    parts = lines.groupBy("thread", "seq", "passage").agg(
        F.min("level").alias("level"),
        F.array_sort(F.collect_list(F.struct("line", "body"))).alias("parts"),
    )
    texts = F.transform("parts", lambda x: x["body"])
    hashed = parts.select("thread", "seq", "passage", "level", F.concat(F.array(F.concat_ws("\n", texts)), texts).alias("bodies"))
    units = hashed.select("thread", "seq", "passage", "level", F.posexplode("bodies").alias("rank", "body"))
    units = units.withColumn("body", normalised(F.col("body"))).filter("body <> ''")
    units = units.withColumn("rank", F.least("rank", F.lit(1))).withColumn("hash", F.md5("body")).drop("body")
    source = units.filter("level = 0").groupBy("thread", "hash").agg(F.min("seq").alias("source"))
    quoted = units.filter("level > 0")
    found = quoted.join(source, ["thread", "hash"], "left").withColumn("source", F.when(F.col("source") < F.col("seq"), F.col("source")))
    whole, lines_of = (F.when(F.col("rank") == i, F.col("source")) for i in (0, 1))
    best = found.groupBy("thread", "seq", "passage", "level").agg(F.coalesce(F.min(whole), F.max(lines_of)).alias("best"))
    replies = best.groupBy("thread", "seq").agg(
        F.count("*").alias("n_quotes"),
        F.count("best").alias("n_linked"),
        F.max(F.when(F.col("best").isNotNull(), F.struct(-F.col("level"), F.col("best").alias("source"))))["source"].alias("parent_seq"),
    )
    body = lines.filter("level = 0").groupBy("thread", "seq").agg(F.array_sort(F.collect_list(F.struct("line", "body"))).alias("parts"))
    clean = body.select("thread", "seq", F.regexp_replace(F.concat_ws("\n", F.transform("parts", lambda x: x["body"])), r"^\n+|\n+\z", "").alias("clean_text"))
    joined = store.keep(once.select("thread", "seq").join(replies, ["thread", "seq"], "left").join(clean, ["thread", "seq"], "left"))
    zero = F.lit(0).cast("long")
    place = [F.col("thread"), F.col("seq")]
    ended = joined.filter("parent_seq is null").select(*place, F.col("seq").alias("root"), zero.alias("depth"))
    open_ = joined.filter("parent_seq is not null").select(*place, F.col("parent_seq").alias("root"), (zero + 1).alias("depth"))
    while True:  # only messages whose root is not known yet take part in a round
        known = ended.withColumn("done", F.lit(True)).union(open_.withColumn("done", F.lit(False)))
        above = known.select("thread", F.col("seq").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), "done")
        moved = store.keep(open_.join(above, ["thread", "root"]).select(*place, F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "done"))
        ended = ended.union(moved.filter("done").drop("done"))
        open_ = moved.filter("not done").drop("done")
        if open_.isEmpty():
            break
    state = ended
    return joined.join(state, ["thread", "seq"]).select(
        "thread",
        "seq",
        "parent_seq",
        F.col("root").alias("root_seq"),
        "depth",
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.coalesce("clean_text", F.lit("")).alias("clean_text"),
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """conversations as mail: each turn quotes the turn before it, and that one's predecessor a level deeper.

    Rows that repeat a conv_id and turn are one turn, the one with the smallest text (null only if all are) and its smallest
    role. Null conv_ids and turns are left out; a turn whose predecessor is missing or null quotes nothing. A very long turn
    is quoted whole. Every turn is sent to itself and the two turns after it, where one aggregation picks what is quoted:
    one shuffle, which splits a long conversation by turn.
    """
    said = conversations.filter("conv_id is not null and turn is not null").select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    sent = said.withColumn("back", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("turn", F.col("turn") + F.col("back"))
    first = F.struct(F.col("text").isNull().alias("unsaid"), "text", "role")
    near = sent.groupBy("conv_id", "turn").agg(*[F.min(F.when(F.col("back") == i, first)).alias(f"at{i}") for i in range(3)]).filter("at0 is not null")

    def quoted(text: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.replace(F.col(text), F.lit("\n"), F.lit(f"\n{mark}")))

    last, older = quoted("at1.text", "> "), quoted("at2.text", "> > ")
    intro = F.concat(F.lit("On an earlier turn the "), F.col("at1.role"), F.lit(" wrote:"))
    head = F.concat_ws("\n", intro, older, last, F.lit(""), F.col("at0.text"))
    return near.select("conv_id", "turn", F.when(F.col("at1.text").isNotNull(), head).otherwise(F.col("at0.text")).alias("text"))
