"""Operator 7, chat formatting by quotation linking.

Lines that begin with ``>`` quote: their level is the number of marks.  Each run
of lines of one level is a passage; its words are lower-cased and stripped of
marks.  A passage is looked for in what the other messages of its conversation
write themselves: its first words are an anchor, whose hash is joined with those
of all runs of as many words; where they meet, the whole passage is compared word
by word.  So a quote may begin and end anywhere, and leave words out.  That gives
every message the one it replies to, and conversations are sorted by thread,
depth and turn.  Everything is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.text import bound
from riskweave.llm.storage import cleared, kept, materialize

QUOTE_MARK = r"^[ \t]*>"
#: Words of an anchor; shorter quotes are their own.
ANCHOR = 4
#: What a quote leaves out.
OMITTED = r"\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)"
#: A line above a quote that only says whose it is: it ends with a colon and holds a number or an address, or at most three words, or one of these verbs.
ATTRIBUTION = r"(?i)(?:[0-9]|\S@\S|\b(?:wrote|writes|said|schrieb|geschrieben|schreibt|a écrit|écrit|escribió|escribe)\b).*:\s*$|^\s*(?:\S+\s+){0,2}\S+:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """Lines as (level, text, attributes): the quote marks at the beginning, spaces between them allowed, are the level; attributes marks a line of one's own that says whose the quote below it is."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    marks = lambda x: F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1)
    levels = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "").alias("text")))

    def marked(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after, beyond = F.get(all_, i + 1), F.get(all_, i + 2)
            quotes = (after["level"] > x["level"]) | ((F.trim(after["text"]) == "") & (after["level"] == 0) & (beyond["level"] > x["level"]))
            return F.struct(x["level"].alias("level"), x["text"].alias("text"), F.coalesce(quotes & x["text"].rlike(ATTRIBUTION), F.lit(False)).alias("attributes"))

        return F.transform(all_, one)

    return bound(levels, marked)


def passages_of(lines: Column) -> Column:
    """Runs of neighbouring lines of one level, blank lines and attributions dividing, as (level, text)."""
    none = F.array().cast("array<struct<level:int,text:string>>")
    start = F.struct(none.alias("done"), F.lit(-1).alias("level"), F.lit("").alias("text"))
    closed = lambda a: F.when(F.trim(a["text"]) != "", F.concat(a["done"], F.array(F.struct(a["level"].alias("level"), a["text"].alias("text"))))).otherwise(a["done"])
    step = lambda a, x: (
        F.when((x["level"] == a["level"]) & (F.trim(x["text"]) != ""), F.struct(a["done"].alias("done"), a["level"].alias("level"), F.concat(a["text"], F.lit("\n"), x["text"]).alias("text")))
        .otherwise(F.struct(closed(a).alias("done"), F.when(F.trim(x["text"]) == "", F.lit(-1)).otherwise(x["level"]).alias("level"), x["text"].alias("text")))
    )
    blank = F.struct(F.lit(0).alias("level"), F.lit("").alias("text"))
    return F.aggregate(F.transform(lines, lambda x: F.when(x["attributes"], blank).otherwise(F.struct(x["level"].alias("level"), x["text"].alias("text")))), start, step, closed)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_normal(text), " "), "")


def _origins(written: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv_id, passage, origin): the turns whose own words hold all fragments of each distinct passage.

    ``written`` has conv_id, turn and words, ``passages`` conv_id, passage (a
    hash) and fragments (their words).  Words of a message become rows only where
    its conversation quotes; runs that start no fragment are dropped before they
    move.
    """
    fragments = materialize(
        passages.select("conv_id", "passage", F.explode("fragments").alias("fragment"))
        .withColumn("n", F.least(F.size("fragment"), F.lit(ANCHOR)))
        .withColumn("anchor", F.xxhash64(F.array_join(F.slice("fragment", F.lit(1), F.col("n")), " ")))
    )
    sizes = fragments.groupBy("conv_id").agg(F.sort_array(F.collect_set("n")).alias("sizes"))  # at most ANCHOR numbers
    run = lambda at, n: F.struct(n.alias("n"), at.alias("at"), F.xxhash64(F.array_join(F.slice("words", at + 1, n), " ")).alias("anchor"))
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda at: run(at, n))))
    there = written.join(sizes, "conv_id").withColumn("sizes", F.filter("sizes", lambda n: n <= F.size("words"))).where(F.size("sizes") > 0)
    starts = there.select("conv_id", "turn", F.explode(runs).alias("run")).select("conv_id", "turn", "run.*").join(fragments.select("conv_id", "n", "anchor").distinct(), ["conv_id", "n", "anchor"], "left_semi")
    met = materialize(starts).join(fragments, ["conv_id", "n", "anchor"])
    # Only those longer than their anchor are left to compare.
    short = met.where(F.size("fragment") <= ANCHOR).select("conv_id", "turn", "passage", "fragment")
    long = met.where(F.size("fragment") > ANCHOR).join(written.select("conv_id", "turn", "words"), ["conv_id", "turn"])
    long = long.where(F.slice("words", F.col("at") + 1, F.size("fragment")) == F.col("fragment")).select("conv_id", "turn", "passage", "fragment")
    held = short.unionByName(long).select("conv_id", "turn", "passage", F.xxhash64(F.array_join("fragment", " ")).alias("fragment")).distinct()
    parts = passages.select("conv_id", "passage", F.size(F.array_distinct("fragments")).alias("parts"))
    whole = held.groupBy("conv_id", "passage", "turn").agg(F.count(F.lit(1)).alias("found")).join(parts, ["conv_id", "passage"])
    return whole.where(F.col("found") == F.col("parts")).select("conv_id", "passage", F.col("turn").alias("origin"))


def link_quotes(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations in reply order without their quotes.

    Returns one row for each message: conv_id, turn, role, body (the text
    without quotes and their attribution lines, trimmed), quotes (quoted
    passages), linked (those found), reply_to (turn of the message whose words it
    quotes at the lowest level; the latest earlier turn that wrote them),
    root_turn and depth (of its reply chain; a message that quotes none is a
    root), sorted by conv_id, root_turn, depth and turn.

    A quote links if an earlier message of the conversation wrote its words in a
    row; one that leaves words out (``[...]``) if it wrote all that is left, in any
    order.  A quote without a word links nothing.  Null texts have an empty body.  A null conv_id or turn is kept and
    neither quotes nor is quoted.  Rows with equal conv_id and turn are one
    message to their quoters and stay separate rows.  Without any quote every
    message is a root, in turn order.  An empty table gives an empty result.
    Other columns are ignored.
    """
    rows = messages.select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    # Only texts with a mark are taken to pieces.
    quoting = F.col("text").rlike(r"(?m)" + QUOTE_MARK)
    lines = lines_of(F.col("text"))
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["attributes"])
    body = F.when(quoting, F.array_join(F.transform(own, lambda x: x["text"]), "\n")).otherwise(F.col("text"))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    with cleared():
        up = kept(_linked(rows, quoting, lines, body))
    return (
        rows.select("conv_id", "turn", "role", body.alias("body"))
        .join(up, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "body", F.coalesce("quotes", F.lit(0)).cast("long").alias("quotes"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "reply_to",
            F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
        .orderBy("conv_id", "root_turn", "depth", "turn")
    )


def _linked(rows: DataFrame, quoting: Column, lines: Column, body: Column) -> DataFrame:
    """conv_id, turn, quotes, linked, reply_to, root_turn and depth of the messages that quote."""
    there = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    fragments = F.filter(F.transform(F.split(F.col("p.text"), OMITTED), _words), lambda x: F.size(x) > 0)
    quoted = there.where(quoting).select("conv_id", "turn", F.explode(passages_of(lines)).alias("p")).where("p.level > 0").select("conv_id", "turn", "p.level", fragments.alias("fragments"))
    quoted = materialize(quoted.withColumn("passage", F.xxhash64(F.to_json("fragments"))).distinct())
    passages = quoted.where(F.size("fragments") > 0).select("conv_id", "passage", "fragments").dropDuplicates(["conv_id", "passage"])
    written = there.join(passages.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", _words(body).alias("words")).where(F.size("words") > 0)
    origins = _origins(materialize(written), passages)
    # The latest earlier turn that wrote a passage: origins and quotes of a passage in one order, not each with each.
    wrote = origins.select("conv_id", "passage", F.col("origin").alias("turn"), F.lit(None).cast("int").alias("level"), F.col("origin").alias("wrote"))
    events = quoted.select("conv_id", "passage", "turn", "level", F.lit(None).cast("long").alias("wrote")).unionByName(wrote)
    earlier = Window.partitionBy("conv_id", "passage").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("origin", F.max("wrote").over(earlier)).where("level IS NOT NULL")
    links = materialize(found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("quotes"), F.count("origin").alias("linked"), F.min_by("origin", F.when(F.col("origin").isNotNull(), F.struct("level", -F.col("origin")))).alias("reply_to")))

    # Chains by doubling: each round looks twice as far up, so a chain of n replies takes log2(n) rounds.
    chain = links.where("reply_to IS NOT NULL").select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = chain.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_root"), F.col("depth").alias("_depth"))
        chain = chain.join(above, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("_moved"))
        chain = materialize(chain)
        moved = chain.where("_moved").limit(1).count()
        chain = chain.drop("_moved")
        if not moved:
            break
    return links.join(chain, ["conv_id", "turn"], "left")
