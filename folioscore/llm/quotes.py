"""Quotation linking: reply-ordered conversations without quotes, in DataFrame
functions only.

A line that begins with one or more ``>`` is quoted, as deep as it has signs, to
any depth. Runs of lines of one depth are a passage. Passages and messages are normalised (quote signs off, small letters,
white space collapsed) and hashed: a message by its own words as a whole, by
paragraph and by line, a passage as a whole and by line. A passage's original is
the earliest message of the same conversation with that hash, if its turn is
smaller; a match of the whole comes before matches of lines, and the shallowest
level with an original is the one that is answered. Lines of fewer than
``LEAST_WORDS`` words are too common to link by and are left out, but not whole
messages and whole passages.

Links point to smaller turns, so they form trees. Each message gets its tree's root
(``thread``) and its depth by pointer doubling, as many rounds as the depth's
logarithm. Ordering by conv_id, thread, turn gives each conversation with replies
behind what they answer; no conversation is ever gathered into one row, so one that
holds most of the rows is no matter.

Originals are one row for each (conversation, hash), so a passage quoted by
everyone costs one row a quotation. They are written before they are joined, so
both sides of the join are plain shuffles and a hash that everybody quotes is split.

Patterns read a line of any length in one pass and a bounded stack.

Rows: a null text is empty. A message with a null conversation or turn is linked to
nothing and is its own thread (null where its turn is null). Messages that share
conversation and turn are each returned; a link to that turn means any of them. A
null role counts as "unknown" in ``formatted``. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import staged

LEAST_WORDS = 3
_SIGNS = r"(?:>\x20?)"
_ATTRIBUTION = r"(?m)^[^\n>]+ wrote:[\x20\t]*(?:\n(?=>)|\n\n(?=>))"
_BLANK = " \t\n\x0b\f\r"


def depths(text: Column) -> Column:
    """The depths at which the text has quoted lines."""
    signs = F.regexp_extract_all(text, F.lit(rf"(?m)^{_SIGNS}++"), F.lit(0))
    return F.array_distinct(F.transform(signs, lambda s: F.length(F.replace(s, F.lit(" "), F.lit("")))))


def passages(text: Column, depth: Column) -> Column:
    """Runs of lines quoted ``depth`` deep. Possessive, so the run's length costs no stack."""
    pattern = F.concat(F.lit(rf"(?m)(?:^{_SIGNS}{{"), depth.cast("string"), F.lit(r"}+(?!>)[^\n]*+(?:\n|\z))++"))
    return F.regexp_extract_all(text, pattern, F.lit(0))


def normalised(text: Column) -> Column:
    unsigned = F.regexp_replace(text, rf"(?m)^{_SIGNS}++", "")
    return F.trim(F.regexp_replace(F.lower(unsigned), r"\s+", " "))


def own_words(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    bare = F.regexp_replace(F.regexp_replace(text, _ATTRIBUTION, "\n"), r"(?m)^>[^\n]*+(?:\n|\z)", "")
    return stripped(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def _keys(text: Column, order: Column, lines: bool) -> Column:
    """Hashes of a text as a whole (order) and of its lines (order + 1)."""
    whole = F.filter(F.array(normalised(text)), lambda x: x != "")
    out = F.transform(whole, lambda x: F.struct(order.alias("order"), F.sha2(x, 256).alias("hash")))
    if not lines:
        return out
    each = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x.rlike(rf"^(?:\S++ ){{{LEAST_WORDS - 1}}}\S"))
    return F.concat(out, F.transform(F.array_distinct(each), lambda x: F.struct((order + 1).alias("order"), F.sha2(x, 256).alias("hash"))))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, and quoted (array of order, hash; smaller orders are better links)."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r\n?", "\n")
    base = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    quoted = let(F.col("text"), lambda t: F.flatten(F.transform(depths(t), lambda d: F.flatten(F.transform(passages(t, d), lambda p: _keys(p, 2 * d, True))))))
    quotes = F.col("text").rlike(r"(?m)^>")
    none = F.array().cast("array<struct<order:int,hash:string>>")
    return base.select("conv_id", "turn", "role", F.when(quotes, own_words(F.col("text"))).otherwise(stripped(F.col("text"))).alias("content"), F.when(quotes, F.array_distinct(quoted)).otherwise(none).alias("quoted"))


def originals(messages: DataFrame) -> DataFrame:
    """conv_id, hash, first: the earliest turn whose own words have the hash."""
    # A blank line is a line break, blanks without one, a line break: read without going back.
    paragraphs = F.flatten(F.transform(F.split("content", r"\n(?:[\x20\t\x0b\f\r]*+\n)++[\x20\t\x0b\f\r]*+"), lambda p: _keys(p, F.lit(0), False)))
    keys = F.array_distinct(F.transform(F.concat(_keys(F.col("content"), F.lit(0), True), paragraphs), lambda k: k["hash"]))
    return messages.select("conv_id", "turn", F.explode(keys).alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("first"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: each quoting turn's original."""
    placed = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = placed.filter(F.size("quoted") > 0)
    asked = quoting.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.order", "q.hash")
    known = staged(originals(placed.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")), "originals")
    found = asked.join(known, ["conv_id", "hash"]).filter("first < turn")
    # Of the best order, the latest original is the one that was answered.
    return found.groupBy("conv_id", "turn").agg(F.min(F.struct("order", (-F.col("first")).alias("late"))).alias("best")).select("conv_id", "turn", (-F.col("best.late")).alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread, depth of every turn that answers another."""
    now = staged(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "links")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth"))
        if now.join(up, ["conv_id", "thread"], "left_semi").isEmpty():
            return now
        stepped = now.join(up, ["conv_id", "thread"], "left")
        now = staged(stepped.select("conv_id", "turn", "reply_to", F.coalesce("_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "links")


def conversations(messages: DataFrame, begin: str = "<|{}|>\n", end: str = "\n<|end|>\n") -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, content and formatted of every row of
    ``messages`` (conv_id, turn, role, text). ``begin`` takes the role."""
    rows = staged(parsed(messages), "messages")
    tied = threads(links(rows))
    before, after = begin.split("{}")
    formatted = F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(after), "content", F.lit(end))
    return rows.join(tied, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "content", formatted.alias("formatted"))
