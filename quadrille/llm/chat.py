"""Chat formatting by quotation linking, with DataFrame functions only.

Lines carry quote levels (leading `>` marks). A passage is a run of lines of one level without a blank
line between, and each line of such a run; normalised (white space collapsed, lower case) and hashed, a passage quoted at level
k is looked up among the passages of level k - 1 of earlier messages of its conversation (what their author
wrote, or quoted with one mark less), and, if none has it there, among unquoted ones. The latest earlier message that
holds it is its source; the message answers the source of most quoted
characters, the later one of equals. Answers form trees; following parents by pointer doubling
gives each message its tree's first turn and its depth. A conversation reads in reply order by
(root_turn, turn): an answer stands in the thread of what it quotes, parents first.

Everything is keyed by (conversation, passage, range of turns) or (conversation, turn), never by a conversation or a
passage alone: a source is the greatest earlier turn within its range of TURNS turns, or that of the last
range before that has one. Passages that nobody quotes are dropped before they are exchanged. All work on a message is linear in its lines.

Defined results: null text is empty and stays null; messages without a quote, or whose quotes
match nothing, are roots at depth 0; unmatched quotes are removed all the same; repeated rows
of one turn share links; null turns cannot be quoted; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, if_small

#: Turns in a range: at most so many rows of one passage meet in a task.
TURNS = 4096
_LEVEL = "^[ \\t]*(>[ \\t]*)+"
_ATTRIBUTION = "^(On .* wrote:|Am .* schrieb .*:|Le .* a écrit ?:|El .* escribió:)[ \\t]*$"


def _lines(text: Column) -> Column:
    """array<struct<level, content, norm>> of a text."""

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, _LEVEL, 0)
        content = F.substring(x, F.length(mark) + 1, F.length(x))
        return F.struct(
            F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), content.alias("content"),
            F.trim(F.lower(F.regexp_replace(content, "[\\x09-\\x0D ]+", " "))).alias("norm"),
        )

    return F.transform(F.split(text, "\n", -1), line)


def _shifted(lines: Column, by: int) -> Column:
    """The array with each element's neighbour `by` places on in its place; null beyond the ends."""
    none = F.array_repeat(F.lit(None).cast("struct<level:int,content:string,norm:string>"), abs(by))
    return F.concat(F.slice(lines, by + 1, F.greatest(F.size(lines) - by, F.lit(0))), none) if by > 0 else F.concat(none, F.slice(lines, 1, F.greatest(F.size(lines) + by, F.lit(0))))


def _passages(lines: Column) -> Column:
    """array<struct<level, norm>>: runs of lines of one level without a blank line, and the lines of runs of several."""

    # a run becomes "level TAB line line ...", runs are parted by line feeds; normalised lines hold neither
    def part(x: Column, before: Column) -> Column:
        fresh = before["norm"].isNull() | (before["norm"] == "") | (before["level"] != x["level"])
        return F.when(x["norm"] == "", "").otherwise(F.concat(F.when(fresh, F.concat(F.lit("\n"), x["level"].cast("string"), F.lit("\t"))).otherwise(F.lit(" ")), x["norm"]))

    text = F.array_join(F.zip_with(lines, _shifted(lines, -1), part), "")
    runs = F.transform(
        F.filter(F.split(text, "\n"), lambda r: r != ""),
        lambda r: F.struct(F.substring_index(r, "\t", 1).cast("int").alias("level"), F.substring_index(r, "\t", -1).alias("norm")),
    )
    single = F.transform(F.filter(lines, lambda x: x["norm"] != ""), lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))
    return F.concat(runs, single)


def _unquoted(lines: Column) -> Column:
    """The unquoted lines, without attributions directly above a quote, joined and trimmed."""

    def mine(x: Column, after: Column) -> Column:
        title = F.regexp_like(x["content"], F.lit(_ATTRIBUTION)) & (F.coalesce(after["level"], F.lit(0)) > 0)
        return F.when((x["level"] == 0) & ~title, x["content"])

    own = F.filter(F.zip_with(lines, _shifted(lines, 1), mine), lambda x: x.isNotNull())
    return F.regexp_replace(F.array_join(own, "\n"), "^[\x09-\x0D ]+|[\x09-\x0D ]+$", "")


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of messages that quote an earlier one of their conversation."""
    usable = messages.filter("text is not null and turn is not null and conv_id is not null").select("conv_id", "turn", "text")

    def passages(rows: DataFrame) -> DataFrame:
        found = rows.select("conv_id", "turn", F.explode(_passages(_lines(F.col("text")))).alias("p"))
        return found.select("conv_id", "turn", F.col("p.level").alias("level"), F.xxhash64("p.norm").alias("key"), F.length("p.norm").alias("chars"))

    quoting = passages(usable.filter(F.col("text").contains(">"))).filter("level > 0")
    quoted = checkpoint(quoting.groupBy("conv_id", "turn", "level", "key").agg(F.max("chars").alias("chars")))
    asked = if_small(quoted.select("conv_id", "key").distinct())
    known = passages(usable).join(asked, ["conv_id", "key"], "left_semi").select("conv_id", "turn", "level", "key").distinct()
    # where a passage is looked for: a level below, and unquoted
    want = quoted.withColumn("place", F.explode(F.array_distinct(F.array(F.col("level") - 1, F.lit(0)))))
    reach = ["conv_id", "key", "place", "range"]
    sources = known.select("conv_id", "key", F.col("level").alias("place"), F.floor(F.col("turn") / TURNS).alias("range"), F.col("turn").alias("source"))
    want = want.withColumn("range", F.floor(F.col("turn") / TURNS))
    # the last source of each range, and of the ranges before each range in which one is wanted
    last = sources.groupBy(*reach).agg(F.max("source").alias("last"))
    before = Window.partitionBy("conv_id", "key", "place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = last.join(want.select(*reach).distinct(), reach, "full").withColumn("before", F.max("last").over(before)).select(*reach, "before")
    both = sources.withColumn("turn", F.col("source")).unionByName(want.select(*reach, "turn", "level", "chars"), allowMissingColumns=True)
    # all of one turn stand together: the frame ends before the current turn
    earlier = Window.partitionBy(*reach).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("source").over(earlier)).filter("level is not null").join(last, reach, "left")
    found = found.withColumn("source", F.coalesce("near", "before"))
    below = F.max(F.when(F.col("place") == F.col("level") - 1, F.col("source")))
    found = found.groupBy("conv_id", "turn", "level", "key").agg(F.coalesce(below, F.max("source")).alias("source"), F.max("chars").alias("chars"))
    return (
        found.filter("source is not null").groupBy("conv_id", "turn", "source").agg(F.sum("chars").alias("chars"))
        .groupBy("conv_id", "turn").agg(F.max(F.struct("chars", "source")).alias("best"))
        .select("conv_id", "turn", F.col("best.source").alias("parent_turn"))
    )


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) by pointer doubling over links."""
    e = checkpoint(links.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = e.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = e.join(up, ["conv_id", "root_turn"], "left")
        if joined.filter("next is not null").isEmpty():
            return e
        e = checkpoint(
            joined.select("conv_id", "turn", "parent_turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, parent_turn, root_turn and depth of each message."""
    found = threads(quote_links(messages))
    plain = messages.select("conv_id", "turn", "role", _unquoted(_lines(F.col("text"))).alias("text"))
    return plain.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")
    )
