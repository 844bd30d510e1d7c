"""Chat formatting by quotation linking.

Messages are parsed into lines of quote levels, and lines of one level that follow each other into
passages. A normalised quoted passage, or else a sentence or a line of it, is hashed and linked to
the latest earlier message of the conversation that said it as its own. The links give threads, and
conversations are built from them in reply order, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import c, stored

#: Marks before a quoted line, with blanks between them.
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: The blanks between two sentences.
_SENTENCE = r"(?<=[.!?;:…])[\s]+"
#: A line that introduces a quotation: it ends so and a quoted line follows.
_INTRODUCES = r"(?i)(wrote|writes|said|a écrit|schrieb|escribió)\s*:\s*$"


def parse(text: Column) -> Column:
    """array of struct(level, line): the quote level of each line and the line without its marks."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line")))


def own_text(parsed: Column) -> Column:
    """The lines of level 0 but those that introduce a quotation, without blank lines at the ends."""
    kept = F.filter(parsed, lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(_INTRODUCES) & (F.coalesce(F.get(parsed, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def passage(line: Column) -> Column:
    """A line in lower case without punctuation and runs of blanks: what quoting and wrapping may change."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\p{Punct}\s]+", " "))


def units(parsed: Column) -> Column:
    """array of struct(level, kind, said, n): passages (kind 2), their sentences (1) and single lines (0), hashed, n characters long when normalised.

    A passage ends at a blank line. Its lines are joined by blanks, so it does not matter where they were wrapped.
    """
    bare = F.transform(parsed, lambda x: F.struct(x["level"].alias("level"), F.translate(x["line"], "\x01\x02", "  ").alias("line")))
    blank = lambda x: passage(x["line"]) == ""
    goes_on = lambda x, i: (i > 0) & (F.get(bare, i - 1)["level"] == x["level"]) & ~blank(x) & ~blank(F.get(bare, i - 1))
    joined = F.array_join(F.transform(bare, lambda x, i: F.concat(F.when(F.coalesce(goes_on(x, i), F.lit(False)), F.lit(" ")).otherwise(F.concat(F.lit("\x02"), x["level"].cast("string"), F.lit("\x01"))), x["line"])), "")
    whole = F.transform(F.filter(F.split(joined, "\x02"), lambda b: b != ""), lambda b: F.struct(F.substring_index(b, "\x01", 1).cast("int").alias("level"), F.substring_index(b, "\x01", -1).alias("line")))
    parts = F.flatten(F.transform(whole, lambda b: F.transform(F.split(b["line"], _SENTENCE), lambda t: F.struct(b["level"].alias("level"), t.alias("line")))))
    named = lambda x, kind: F.transform(x, lambda b: F.struct(b["level"].cast("int").alias("level"), F.lit(kind).alias("kind"), F.xxhash64(passage(b["line"])).alias("said"), F.length(passage(b["line"])).alias("n")))
    return F.filter(F.concat(named(whole, 2), named(parts, 1), named(bare, 0)), lambda x: x["n"] > 0)


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, text, reply_to, thread, quotes, deepest) of each message.

    text is the message without quotes. reply_to is the turn of the message it quotes; null if
    none. Of what some earlier message said as its own, the least quote level decides, then a whole
    passage before a sentence and a sentence before a line, then the longest, then the latest turn.
    thread is the turn at the end of the reply_to links, or for a message that replies to none the
    conversation's first turn. quotes counts its quoted lines, deepest is their deepest level.
    Each passage, sentence and line is linked to the latest earlier turn that said it; blank ones to none.

    Null texts are empty; whole texts are parsed, however long. Of equal claims the latest turn wins.
    Other columns are left aside, so clashing names do no harm. Messages with a null conversation or turn have a row and no links.
    Repeated turns are messages of their own that share a turn. Hot conversations are joined by
    their passages, sentences and lines, not gathered.
    """
    rows = messages.select(c(conversation).alias("conv"), c(turn).alias("turn"), c(role).alias("role"), c(text).alias("text"))
    rows = stored(rows.withColumn("mark", F.xxhash64("text", "role")).withColumn("parsed", parse(F.col("text"))))
    said = rows.filter("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", "mark", F.explode(units(F.col("parsed"))).alias("x")).select("conv", "turn", "mark", "x.*")
    said = stored(said)
    quoted = said.filter("level > 0").distinct()
    # only conversations with quotations need their own words; a turn's questions come before what it says
    asked = quoted.select("conv", "kind", "said").distinct()
    own = said.filter("level = 0").join(asked, ["conv", "kind", "said"], "left_semi").select("conv", "kind", "said", "turn").distinct()
    both = quoted.withColumn("says", F.lit(False)).unionByName(own.withColumn("says", F.lit(True)), allowMissingColumns=True)
    latest = F.last(F.when(F.col("says"), F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv", "kind", "said").orderBy("turn", "says").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("origin", latest).filter("NOT says AND origin IS NOT NULL").groupBy("conv", "turn", "mark").agg(F.max(F.struct(-F.col("level"), "kind", "n", "origin"))["origin"].alias("reply_to"))
    found = stored(found)
    starts = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.min("turn").alias("start"))
    return _threads(rows, found, starts).select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), own_text(F.col("parsed")).alias(text), "reply_to", "thread", F.size(F.filter("parsed", lambda x: x["level"] > 0)).alias("quotes"), F.array_max(F.transform("parsed", lambda x: x["level"])).alias("deepest"))


def _threads(rows: DataFrame, found: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with reply_to and thread; links are followed by doubling, so a chain takes as many rounds as the logarithm of its length."""
    # messages of one turn share its links: the latest
    up = stored(found.groupBy("conv", "turn").agg(F.max("reply_to").alias("top")))
    while not up.isEmpty():
        further = up.select("conv", F.col("turn").alias("top"), F.col("top").alias("over"))
        longer = stored(up.join(further, ["conv", "top"], "left").select("conv", "turn", F.coalesce("over", "top").alias("top"), F.col("over").isNotNull().alias("more")))
        on = not longer.filter("more").isEmpty()
        up = longer.drop("more")
        if not on:
            break
    replies = rows.alias("r").join(found.alias("f"), F.expr("r.conv = f.conv AND r.turn = f.turn AND r.mark = f.mark"), "left").select("r.*", "reply_to")
    threads = replies.alias("r").join(up.alias("u"), F.expr("r.conv = u.conv AND r.reply_to = u.turn"), "left").select("r.*", F.coalesce("u.top", "r.reply_to").alias("above"))
    return threads.alias("t").join(starts.alias("s"), F.expr("t.conv = s.conv"), "left").select("t.*", F.coalesce("above", "s.start").alias("thread"))


def formatted(linked: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """linked with message, the turn in chat markup; a null role is `user`, a mark inside a text is broken by a blank."""
    body = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return linked.withColumn("message", F.concat(F.lit("<|im_start|>"), F.coalesce(c(role), F.lit("user")), F.lit("\n"), body, F.lit("<|im_end|>")))


def _numbered(x: DataFrame, most: int) -> DataFrame:
    """x with number: the place of a message m in its thread, from 0, by turn, then mark.

    Messages are numbered within leaves, stretches of most turns, and leaves are added up; where a
    stretch holds many messages of few turns its leaves are single turns and ranges of marks. So
    a task orders a leaf of messages or the leaves of a thread, and only equal messages are never told apart.
    """
    keys = ["conv", "thread", "stretch"]
    x = x.withColumn("stretch", F.floor(F.col("m.turn") / most))
    crowded = x.groupBy(*keys).count().filter(F.col("count") > 4 * most).select(*(F.col(k).alias(f"c_{k}") for k in keys), F.lit(True).alias("crowded"))
    x = x.join(crowded, F.expr(" AND ".join(f"{k} <=> c_{k}" for k in keys)), "left").drop(*(f"c_{k}" for k in keys))
    x = x.withColumn("leaf", F.struct("stretch", F.when(F.col("crowded"), F.struct(F.col("m.turn"), F.shiftright("m.mark", 48)))))
    leaves = x.groupBy("conv", "thread", "leaf").agg(F.count("*").alias("in_leaf"))
    earlier = Window.partitionBy("conv", "thread").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.select(*(F.col(k).alias(f"l_{k}") for k in ("conv", "thread", "leaf")), F.coalesce(F.sum("in_leaf").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv", "thread", "leaf").orderBy("m.turn", "m.mark"))
    joined = x.withColumn("own", own).join(leaves, F.expr("conv <=> l_conv AND thread <=> l_thread AND leaf <=> l_leaf"))
    return joined.select("conv", "thread", "m", (F.col("before") + F.col("own") - 1).alias("number"))


def conversations(linked: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = 256) -> DataFrame:
    """(conversation, thread, part, messages, chat): the messages of each thread in reply order, without quotes, and their markup.

    messages is an array of struct(turn, role, reply_to, text); a message follows the one it
    replies to. A thread of more than most messages goes on in further parts, each of most
    messages but the last, in order of part: no array grows with a hot conversation. Null turns
    come first. Messages of a null conversation have a null thread, which goes on in parts too.
    """
    body = F.struct(c(turn).alias("turn"), F.xxhash64(c(text), c(role)).alias("mark"), c(role).alias("role"), "reply_to", c(text).alias("text"), "message")
    # read more than once, and linked is dear
    x = stored(formatted(linked, role, text).select(c(conversation).alias("conv"), "thread", body.alias("m")))
    x = _numbered(x, most).groupBy("conv", "thread", F.floor(F.col("number") / most).alias("part")).agg(F.array_sort(F.collect_list("m")).alias("all"))
    told = F.transform("all", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["reply_to"].alias("reply_to"), m["text"].alias("text")))
    return x.select(F.col("conv").alias(conversation), "thread", "part", told.alias("messages"), F.array_join(F.transform("all", lambda m: m["message"]), "\n").alias("chat"))


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation as threads of messages without quotes, in reply order."""
    found = conversations(link(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.select("conv_id", "thread", "part", F.size("messages").alias("n_messages"), F.col("messages.turn").alias("turns"), F.col("messages.role").alias("roles"), F.col("messages.reply_to").alias("reply_to"), "chat")
