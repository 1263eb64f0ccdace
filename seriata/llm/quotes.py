"""Quotation linking of conversations, with DataFrame operations only.

A line's quote level is the number of ">" in its leading marks. Runs of lines at one level
are passages. Each quoted passage, normalised (lower case, white space collapsed), is
hashed and looked up among the hashes of what earlier messages of its conversation say
themselves: the whole body, each unquoted passage, each unquoted line, and each run of as
many unquoted lines as some quoted passage of the conversation has, so an excerpt of any
lines in a row links. The linked passage of the lowest level, the first in the text, decides
which message a message replies to. Threads are named by their first message, found by
pointer doubling; ordered by thread and turn, every reply stands after its original, and
bodies are free of quotes and attribution lines.

The hashes of runs are a row a line and distinct passage length of the conversation: with Q
quoted lines there are at most sqrt(2 Q) lengths. No pairs of lines are formed. A
conversation with a third of all messages is joined by `join_hot`; one message's lines meet
in one task, no more.

Null text counts as empty; empty passages and blank lines link with nothing; a text said
twice (a tie) links to its first message; a passage first said in the same or a later turn
does not link. Texts and lines of any length are read whole. Repeated rows are all kept. Null
conv_id: null conversations are not linked; null turns neither. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm.common import join_hot, materialize, text_or_empty

MARKS = r"^[ \t>]*>"
ATTRIBUTION = r"(?i)^[ \t]*(on|am|le|el)\b.*(wrote|schrieb|a écrit|escribió):[ \t]*$"


def normalised(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def hash_of(text: Column) -> Column:
    """Null for text without content."""
    return F.when(text != "", F.md5(text))


def split_messages(messages: DataFrame) -> DataFrame:
    """Rows (mid, conv_id, turn, role, text): a row per passage: mid, conv_id, turn, passage, level, first, content, lines (normalised, without blank ones)."""
    lines = messages.select("mid", "conv_id", "turn", F.posexplode(F.split(text_or_empty(), "\r?\n")).alias("at", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))
    lines = lines.withColumn("level", level).withColumn("content", F.regexp_replace("line", MARKS + r"[ \t]?", "")).drop("line")
    by = Window.partitionBy("mid").orderBy("at")
    starts = F.when(F.col("level") != F.lag("level").over(by), 1).otherwise(0)
    lines = lines.withColumn("starts", starts).withColumn("next_level", F.lead("level").over(by)).withColumn("passage", F.sum("starts").over(by))
    lines = lines.where(~((F.col("level") == 0) & (F.coalesce("next_level", F.lit(0)) > 0) & F.col("content").rlike(ATTRIBUTION)))
    parts = lines.groupBy("mid", "conv_id", "turn", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("l"))
    clean = F.filter(F.transform("l.content", normalised), lambda t: t != "")
    return parts.select("mid", "conv_id", "turn", "passage", "level", F.col("l")[0]["at"].alias("first"), F.array_join("l.content", "\n").alias("content"), clean.alias("lines"))


def runs(messages: DataFrame, lengths: DataFrame) -> DataFrame:
    """messages (conv_id, turn, lines) and lengths (conv_id, k array<int>, n: the conversation's messages): conv_id, turn, hash of every run of k lines, for all k of the conversation."""
    total = messages.count()
    m = join_hot(messages.withColumn("size", F.size("lines")), lengths, ["conv_id"], "n", total)
    m = m.select("conv_id", "turn", "lines", "size", F.explode("k").alias("k")).where("k <= size")
    return m.select("conv_id", "turn", "lines", "k", F.explode(F.expr("sequence(1, size - k + 1)")).alias("i")).select("conv_id", "turn", hash_of(F.array_join(F.expr("slice(lines, i, k)"), " ")).alias("hash"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, quoted_passages, linked_passages, deepest_quote, reply_to (turn), thread (turn of its first message), depth; sorted as conversations."""
    rows = materialize(messages.select(F.monotonically_increasing_id().alias("mid"), "conv_id", "turn", "role", "text"), "quotes-messages")
    parts = materialize(split_messages(rows), "quotes-passages")
    own, quotes = parts.where("level = 0"), parts.where("level > 0")
    together = own.groupBy("mid", "conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("passage", "content", "lines"))).alias("p"))
    together = materialize(together.select("mid", "conv_id", "turn", F.trim(F.array_join("p.content", "\n")).alias("body"), F.flatten("p.lines").alias("lines")), "quotes-bodies")
    bodies = together.select("mid", "body")
    joined = lambda lines: hash_of(F.array_join(lines, " "))
    quoted = materialize(quotes.where("size(lines) > 0").groupBy("conv_id", joined("lines").alias("hash"), F.size("lines").alias("k")).agg(F.count("*").alias("n")), "quotes-quoted")
    lengths = quoted.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set("k")).alias("k"))
    talking = together.groupBy("conv_id").agg(F.count("*").alias("n"))
    said = [together.select("conv_id", "turn", joined("lines").alias("hash")), own.select("conv_id", "turn", joined("lines").alias("hash")), own.select("conv_id", "turn", F.explode("lines").alias("t")).select("conv_id", "turn", F.md5("t").alias("hash"))]
    said.append(runs(together.select("conv_id", "turn", "lines"), lengths.join(talking, "conv_id")))
    all_said = said[0].unionByName(said[1]).unionByName(said[2]).unionByName(said[3])
    first_said = all_said.where("hash is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    # what is asked for, once a conversation and hash
    answers = materialize(quoted.groupBy("conv_id", "hash").agg(F.sum("n").alias("n")).join(first_said, ["conv_id", "hash"]), "quotes-answers")
    asked = quotes.select("mid", "conv_id", "turn", "level", "first", joined("lines").alias("hash"))
    whole = F.col("conv_id").isNotNull() & F.col("hash").isNotNull()
    found = join_hot(asked.where(whole), answers, ["conv_id", "hash"], "n", asked.count(), "left")
    found = found.unionByName(asked.where(~whole), allowMissingColumns=True).withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    links = found.groupBy("mid").agg(F.count("*").alias("quoted_passages"), F.count("origin").alias("linked_passages"), F.max("level").alias("deepest_quote"), F.min_by("origin", F.when(F.col("origin").isNotNull(), F.struct("level", "first"))).alias("reply_to"))
    links = materialize(links, "quotes-links")
    replies = rows.join(links.where("reply_to is not null"), "mid").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    threads = thread_roots(replies)
    out = rows.join(bodies, "mid", "left").join(links, "mid", "left").join(threads, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("conv_id", "turn", "role", F.coalesce("body", F.lit("")).alias("body"), zero("quoted_passages"), zero("linked_passages"), zero("deepest_quote"), "reply_to", F.coalesce("root", "turn").alias("thread"), zero("depth"))
    return out.orderBy("conv_id", "thread", "turn")


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, up) -> conv_id, turn, root, depth by pointer doubling: as many rounds as the logarithm of the longest chain."""
    at = materialize(replies.select("conv_id", "turn", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "quotes-threads")
    while True:
        above = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        if not at.join(above, ["conv_id", "root"], "left_semi").limit(1).count():
            return at
        step = at.join(above, ["conv_id", "root"], "left")
        at = materialize(step.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quotes-threads", instead_of=at)
