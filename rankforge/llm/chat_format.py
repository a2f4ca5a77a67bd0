"""Chat formatting by quotation linking, in native expressions only.

Lines that start with ``>`` marks are quotes; the number of marks is their
level. Runs of one level are passages. Passages and their lines are normalised
(lower case, single spaces) and hashed; a hash finds the latest earlier message
of the conversation whose own text has the same one. A message answers the
message that most of its quoted characters of the lowest linked level come from,
else the turn before. Answers that continue a message form a thread; later answers to the
same message open threads of their own. Conversations list their threads in
the order of their first turns, so a message always follows what it answers;
they are built in parts of ``PART`` messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import cut

_MARKS = r"^((?:[ \t]*>)+)"
#: Most messages in a part of a conversation, so that a very long one is in no single row or task.
PART = 256


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _lines(messages: DataFrame) -> DataFrame:
    """Lines of each message with their level and the number of their passage."""
    line = messages.select("c", "t", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    marks = F.regexp_extract("line", _MARKS, 1)
    line = line.select("c", "t", "k", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substring("line", F.length(marks) + 1, F.lit(1 << 30)).alias("body"))
    line = line.withColumn("blank", _normal(F.col("body")) == "")
    # a blank line ends a passage; windows are as large as one message
    here = Window.partitionBy("c", "t").orderBy("k")
    step = F.coalesce(((F.col("level") != F.lag("level").over(here)) | F.col("blank") | F.lag("blank").over(here)).cast("int"), F.lit(0))
    return line.withColumn("step", step).withColumn("passage", F.sum("step").over(here)).where("not blank")


def _hashes(lines: DataFrame) -> DataFrame:
    """Distinct (message, level, hash) of passages and lines, with their characters."""
    # a passage's lines are those of one message, so the list is as small as a message
    whole = lines.groupBy("c", "t", "level", "passage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), " ").alias("body"))
    every = whole.select("c", "t", "level", _normal(F.col("body")).alias("body")).unionAll(lines.select("c", "t", "level", _normal(F.col("body"))))
    return every.groupBy("c", "t", "level", F.sha2("body", 256).alias("h")).agg(F.max(F.length("body")).alias("n"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``c, t, parent``: for messages ``c, t, text`` with quotes, the message that they answer."""
    quoting = messages.where(F.col("text").rlike("(?m)" + _MARKS)).select("c").distinct()
    hashes = cut(_hashes(_lines(messages.join(quoting, "c", "left_semi"))))
    asked = hashes.where("level > 0").select("c", "h", "t", "n", "level", F.lit(None).cast("long").alias("own"))
    own = hashes.where("level = 0").select("c", "h", "t", "n", "level", F.col("t").alias("own"))
    # latest earlier holder of the hash: one pass over each hash's messages, no pairs
    before = Window.partitionBy("c", "h").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    found = own.unionAll(asked).withColumn("parent", F.max("own").over(before)).where("own is null and parent is not null")
    votes = found.groupBy("c", "t", "level", "parent").agg(F.sum("n").alias("n"))
    return votes.groupBy("c", "t").agg(F.max_by("parent", F.struct(-F.col("level"), "n", "parent")).alias("parent"))


def _threads(turns: DataFrame) -> DataFrame:
    """``c, t, parent, quoted, thread`` from the distinct turns ``c, t, quote`` (the turn a quote names, or null)."""
    order = Window.partitionBy("c").orderBy("t")
    turns = turns.withColumn("prev", F.lag("t").over(order)).withColumn("parent", F.coalesce("quote", "prev"))
    # a child is the continuation if none is earlier; the next turn always is
    turns = turns.withColumn("first", F.col("parent").isNotNull() & (F.row_number().over(Window.partitionBy("c", "parent").orderBy("t")) == 1))
    near = F.col("first") & (F.col("parent") == F.col("prev"))
    turns = cut(turns.withColumn("head", F.last(F.when(~near, F.col("t")), ignorenulls=True).over(order)))
    runs = turns.where(F.col("t") == F.col("head")).select("c", "t", "first", "parent")
    jumps = runs.where("first").join(turns.select("c", F.col("t").alias("parent"), F.col("head").alias("up")), ["c", "parent"]).select("c", "t", "up")
    jumps = cut(jumps)
    while True:  # pointer jumping over runs: the number of rounds is the logarithm of a thread's runs
        up = jumps.select("c", F.col("t").alias("up"), F.col("up").alias("next"))
        further = cut(jumps.join(up, ["c", "up"], "left").select("c", "t", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        jumps = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    top = jumps.select("c", F.col("t").alias("head"), "up")
    return turns.join(top, ["c", "head"], "left").select("c", "t", "parent", F.col("quote").isNotNull().alias("quoted"), F.coalesce("up", "head").alias("thread"))


def _escaped(text: Column) -> Column:
    """``text`` without role marks of its own: no message can open or end another."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, parent_turn, quoted, thread, place, content, formatted``, one row for each input row.

    ``place`` counts the rows of a conversation from 1 in reply order, and
    ``formatted`` joined in that order is the conversation for training. A null
    text is empty, a null role is ``user``, a null turn comes first, a row without
    conversation id is a conversation of its own; repeated rows keep their own
    places. Role marks ``<|`` and ``|>`` in texts and roles are parted by a space. Other
    columns are not read; an empty table gives an empty result. Numbering sorts
    one conversation's turns, two numbers each, in one task, which may spill.
    """
    c = F.col(f"`{conv_col}`").cast("string")
    t = F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(-(1 << 62)))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("user"))
    every = messages.select(c.alias("c"), t.alias("t"), F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    rows = every.where("c is not null")
    quotes = link_quotes(rows).select("c", "t", F.col("parent").alias("quote"))
    turns = rows.groupBy("c", "t").agg(F.count("*").alias("copies")).join(quotes, ["c", "t"], "left")
    threads = _threads(turns.select("c", "t", "quote")).join(turns.select("c", "t", "copies"), ["c", "t"])
    base = F.coalesce(F.sum("copies").over(Window.partitionBy("c").orderBy("thread", "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(threads.withColumn("base", base), ["c", "t"])
    rank = F.when(F.col("copies") > 1, F.row_number().over(Window.partitionBy("c", "t").orderBy("role", "text"))).otherwise(1)
    placed = placed.withColumn("place", (F.col("base") + rank).cast("long"))
    alone = every.where("c is null").select("*", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("quoted"), F.col("t").alias("thread"), F.lit(1).cast("long").alias("place"))
    out = placed.select(alone.columns).unionAll(alone)
    content = F.trim(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(_MARKS)), "\n"))
    turn_of = lambda x: F.when(F.col(x) != -(1 << 62), F.col(x)).alias(x)
    formatted = F.concat(F.lit("<|"), _escaped(F.col("role")), F.lit("|>\n"), _escaped(F.col("content")), F.lit("<|end|>\n"))
    out = out.withColumn("content", content)
    return out.select("conv_id", "turn", "role", turn_of("parent").alias("parent_turn"), "quoted", turn_of("thread"), "place", "content", formatted.alias("formatted"))


def build_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_size: int = PART) -> DataFrame:
    """``conv_id, part, n_messages, n_quoted, n_threads, turns, parents, conversation``: whole conversations in reply order.

    Part p of a conversation holds its messages in the places from ``p *
    part_size + 1`` on; ``turns`` and ``parents`` list their turns and the turns that
    they answer (-1 for none), and ``conversation`` joins what ``format_chats`` made
    of them. ``n_threads`` counts the threads that open in the part. Nulls,
    repeats and empty tables are as in ``format_chats``.
    """
    chats = format_chats(messages, conv_col, turn_col, role_col, text_col)
    part = F.floor((F.col("place") - 1) / part_size).cast("int")
    opens = F.col("turn").eqNullSafe(F.col("thread"))
    # a row without conversation id is a group of its own
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = chats.select("conv_id", part.alias("part"), own.alias("own"), "quoted", opens.alias("opens"), F.struct("place", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("parent_turn", F.lit(-1)).alias("parent"), "formatted").alias("m"))
    built = rows.groupBy("conv_id", "part", "own").agg(F.count("*").alias("n_messages"), F.count_if("quoted").alias("n_quoted"), F.count_if("opens").alias("n_threads"), F.array_sort(F.collect_list("m")).alias("m"))
    return built.select("conv_id", "part", "n_messages", "n_quoted", "n_threads", F.col("m.turn").alias("turns"), F.col("m.parent").alias("parents"), F.array_join("m.formatted", "").alias("conversation"))
