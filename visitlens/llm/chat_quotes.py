"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; the number of marks is their level.
A quoted line is normalised and hashed, and joined to the earliest message of
the same conversation that has the line as its own. A message answers the
message whose lines it quotes most at level one, else the one before it. The
quotes then go, and messages are ordered along the branches of answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.common import staged, whole

#: Turns in one window; a conversation of any length is cut into such spans.
SPAN = 1000
MARKS = r"^((?:[ \t]*>)*)[ \t]?(.*)$"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\s>]+", " "))


def _messages(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns``: keys without nulls, role and text."""
    return turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), whole().alias("text"))


def lines(messages: DataFrame) -> DataFrame:
    """``conv, turn, level, hash`` of each line with a word."""
    cut = messages.select("conv", "turn", F.explode(F.split("text", "\n")).alias("line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), r"[^>]", ""))
    normal = _normal(F.regexp_extract("line", MARKS, 2))
    return cut.select("conv", "turn", level.alias("level"), normal.alias("normal")).filter("normal <> ''").select(
        "conv", "turn", "level", F.sha2("normal", 256).alias("hash"))


def quoted(found: DataFrame) -> DataFrame:
    """Quotes per message: ``conv, turn, n_quotes, n_linked, max_level, answers``.

    A line's original is unique per conversation, so a line that many quote, or
    that many write, costs one row per quote.
    """
    originals = found.filter("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    linked = found.filter("level > 0").join(originals, ["conv", "hash"], "left").withColumn(
        "origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    per = linked.groupBy("conv", "turn", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("level") == 1).cast("bigint")).alias("near"),
        F.max("level").alias("level"))
    return per.groupBy("conv", "turn").agg(
        F.sum("n").alias("n_quotes"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
        F.max("level").alias("max_level"),
        F.max(F.when((F.col("near") > 0) & F.col("origin").isNotNull(), F.struct("near", "origin")))["origin"]
        .alias("answers"))


def before(places: DataFrame) -> DataFrame:
    """``conv, turn, previous`` for different ``conv, turn``: the turn before, null for the first.

    Long conversations are cut into spans of turns; the first turn of a span
    gets the last of an earlier span from one summary row per span.
    """
    cut = places.withColumn("span", F.floor(F.col("turn") / SPAN))
    summary = cut.groupBy("conv", "span").agg(F.max("turn").alias("last")).withColumn(
        "carried", F.lag("last").over(Window.partitionBy("conv").orderBy("span"))).drop("last")
    return cut.withColumn("lag", F.lag("turn").over(Window.partitionBy("conv", "span").orderBy("turn"))).join(
        summary, ["conv", "span"]).select("conv", "turn", F.coalesce("lag", "carried").alias("previous"))


def heads(steps: DataFrame) -> DataFrame:
    """``conv, turn, up, head`` for ``conv, turn, up, step``: the last turn up to this one that is no step.

    Cut into spans like :func:`before`. The first turn of a conversation is no step.
    """
    cut = (steps.withColumn("span", F.floor(F.col("turn") / SPAN))
           .withColumn("here", F.when(~F.col("step"), F.col("turn"))))
    summary = cut.groupBy("conv", "span").agg(F.max("here").alias("last")).withColumn(
        "carried", F.max("last").over(Window.partitionBy("conv").orderBy("span")
                                      .rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    so_far = Window.partitionBy("conv", "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("inside", F.max("here").over(so_far)).join(summary, ["conv", "span"]).select(
        "conv", "turn", "up", F.coalesce("inside", "carried").alias("head"))


def branches(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``conv, turn, branch``: the turn that opened the branch a message is on.

    The first answer to a message goes on in its branch, each other answer opens
    one. A run of messages that each go on from the turn before is one node, so
    only answers to earlier turns are followed, by pointer doubling: n in a row
    take log n rounds, and a node that has reached its branch leaves the rounds.
    """
    first = parents.filter("parent is not null").groupBy("conv", "parent").agg(F.min("turn").alias("turn"))
    goes_on = first.withColumnRenamed("parent", "up")
    steps = parents.select("conv", "turn", "previous").join(goes_on, ["conv", "turn"], "left").select(
        "conv", "turn", "up", F.coalesce(F.col("up") == F.col("previous"), F.lit(False)).alias("step"))
    runs = staged(heads(steps), "branches")
    nodes = runs.filter("turn = head").select("conv", "turn", "up")
    # A node that goes on from an earlier turn points to that turn's own node.
    led = nodes.filter("up is not null").join(
        runs.select("conv", F.col("turn").alias("up"), F.col("head").alias("to")), ["conv", "up"]).select(
        "conv", "turn", F.col("to").alias("up"), F.lit(True).alias("open"))
    at = staged(led.unionByName(nodes.filter("up is null").select(
        "conv", "turn", F.col("turn").alias("up"), F.lit(False).alias("open"))), "branches")
    for _ in range(max_rounds):
        if not at.filter("open").limit(1).count():
            break
        over = at.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"))
        moved = at.filter("open").join(over, ["conv", "up"]).select(
            "conv", "turn", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("open"))
        at = staged(moved.unionByName(at.filter("not open")), "branches")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    ends = at.select("conv", F.col("turn").alias("head"), F.col("up").alias("branch"))
    return runs.select("conv", "turn", "head").join(ends, ["conv", "head"]).select("conv", "turn", "branch")


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, branch, turn, parent_turn, role, n_quotes, n_linked, max_level, body, message``.

    A conversation in reply order is its rows by ``branch, turn``: in a branch
    each message answers the one before, and ``parent_turn`` of a branch's first
    message is what the branch answers. ``body`` is the text without quotes,
    ``message`` the body with its role.

    Null texts are empty, a null role is ``unknown``, null turns count as turn
    -1 and null ids as one conversation. Rows that repeat a turn share its links. An
    empty table gives no rows. Other columns are not read.
    """
    messages = _messages(turns)
    found = staged(lines(messages), "chat-lines")
    quotes = quoted(found)
    parents = staged(before(messages.select("conv", "turn").distinct()).join(quotes, ["conv", "turn"], "left").select(
        "conv", "turn", "previous", F.coalesce("answers", "previous").alias("parent"),
        F.coalesce("n_quotes", F.lit(0).cast("bigint")).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).alias("max_level")), "chat-parents")
    links = parents.join(branches(parents), ["conv", "turn"])
    own = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[ \t]*>"))
    body = F.trim(F.array_join(own, "\n"))
    return (messages.withColumn("body", body).join(links, ["conv", "turn"]).select(
        "conv_id", "branch", "turn", F.col("parent").alias("parent_turn"), "role", "n_quotes", "n_linked",
        "max_level", "body", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body")).alias("message")))
