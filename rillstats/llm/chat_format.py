"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins that double the reach each time give
every message its root, its depth and the scores summed up from the root; a leaf's sum
ranks its branch. The same jumps, taken from the largest down, list the messages on
the chosen paths. Each path is formatted as one conversation with a mask of what an
assistant says. Turns stand as `<turn ROLE>TEXT</turn>` and a line break; inside roles
and texts `\\`, `<` and `>` are written `\\0`, `\\1` and `\\2`, so no text can hold a
control string, and what is written reads back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, read_table, rows_of, seen_in, small_side, stored

OPEN, SHUT, CLOSE = "<turn ", ">", "</turn>\n"
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))
LEARNT_ROLE = "assistant"
PROBE = "\\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages: tree (string), id, parent (null or unknown: a root), score, role, text.
    Returns tree, branch (1 is the best), depth, role, text: of each
    tree the messages from the root to the leaf for its `branches` best leaves by summed
    score, then depth, then id. Messages without a tree are in one of their own, whose name
    is null. Of rows with the same tree and id the least counts, by parent (null first), score, role and
    text. A row with a null id is left out: nothing can name it. A null score is 0. Messages on a circle of parents, or
    below one, have no root and are left out. An empty table gives an empty result; other
    columns aren't read."""
    key = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("tree")))
    given = messages.where("id is not null").select(key.alias("tree"), "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "role", "text")
    repeats = stored(given.groupBy("tree", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree", "id"), "repeats")
    if rows_of(repeats):
        again = small_side(repeats)
        one = given.join(again, ["tree", "id"], "left_semi").groupBy("tree", "id").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select("tree", "id", "m.*")
        given = given.join(again, ["tree", "id"], "left_anti").unionByName(one)
    nodes = stored(given.select("tree", "id", "parent", "score"), "messages")
    known = nodes.select("tree", F.col("id").alias("parent"))
    linked = nodes.join(known.withColumn("has", F.lit(True)), ["tree", "parent"], "left")
    up = F.when(F.col("has"), F.col("parent"))
    reach = stored(linked.select("tree", "id", up.alias("up"), F.when(up.isNull(), 0).otherwise(1).alias("depth"), F.col("score").alias("sum")), "reach", open=F.count_if(F.col("up").isNotNull()))
    steps, jumps, left = [reach], [], None
    while (now := seen_in(reach, "open")) and now != left:  # each round brings the nearest to their root, so where it brings none there are circles
        left = now
        jumps.append(reach.select("tree", "id", "up").where("up is not null"))
        beyond = reach.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("sum").alias("sum2"))
        joined = reach.where("up is not null").join(beyond, ["tree", "up"], "left")  # what has its root is done
        joined = reach.where("up is null").unionByName(joined.select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum")))
        reach = stored(joined, "reach", open=F.count_if(F.col("up").isNotNull()))
        steps.append(reach)
    rooted = reach.where("up is null")
    parents = linked.where("has").select("tree", F.col("parent").alias("id")).distinct()
    leaves = rooted.join(parents, ["tree", "id"], "left_anti")
    best = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), F.desc("depth"), "id")))
    on = stored(best.where(F.col("branch") <= branches).select("tree", "branch", "id"), "on-path")
    for jump in reversed(jumps):
        above = on.join(jump, ["tree", "id"]).select("tree", "branch", F.col("up").alias("id"))
        before, on = on, stored(on.unionByName(above).distinct(), "on-path")
        discard(before)
    discard(nodes, *steps[:-1])
    said = given.select("tree", "id", "role", "text").join(rooted.select("tree", "id", "depth"), ["tree", "id"])
    name = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("tree")
    return on.join(said, ["tree", "id"]).select(name, "branch", "depth", "role", "text")


def formatted(turns: DataFrame) -> DataFrame:
    """turns: tree, branch, depth, role, text. One row a path: tree, branch, formatted, mask:
    (start, end) in code points of what LEARNT_ROLE says. Null roles and texts are empty. Turns
    of one depth are ordered by role and text; repeated rows are turns like others. No turns
    give no rows; a conversation is one string, however long; other columns aren't read."""
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    given = turns.select("tree", "branch", "depth", (F.coalesce("role", F.lit("")) == LEARNT_ROLE).alias("learnt"), F.concat(F.lit(OPEN), role, F.lit(SHUT)).alias("head"), text.alias("body"))
    pieces = given.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "branch").orderBy("depth", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    one = F.struct("depth", "piece", F.when(F.col("learnt"), F.struct("start", (F.col("start") + F.length("body")).alias("end"))).alias("span"))
    grouped = placed.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select("tree", "branch", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.array_compact(F.col("turns.span")).alias("mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """From formatted and mask alone: turns (role, text) and loss_text, the texts under the mask.
    Rows come back as they are; null in either gives null; an empty table gives an empty result."""
    pieces = F.split("formatted", "</turn>\n")
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(unescaped(F.substring(F.substring_index(p, SHUT, 1), len(OPEN) + 1, 1 << 30)).alias("role"), unescaped(F.substring(p, F.length(F.substring_index(p, SHUT, 1)) + 2, F.length(p))).alias("text")))
    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return conversations.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


def chat_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows by turn as trees in which each row answers the one before it: tree, conv, id,
    parent, score, role, text. Rows are ordered by turn (null first), role and text, so
    repeated and tied rows have a place; a null conversation is one of its own."""
    key = F.coalesce(F.col(conv_col).cast("string"), F.lit(""))
    base = rows.select(key.alias("tree"), F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "role", "text")
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    return base.withColumn("id", place.cast("long")).select("tree", "conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    messages = stored(chat_conversations(rows.unionByName(probe)), "turns")
    out = read_back(formatted(paths(messages)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(role) + length(text) + length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) + 15 AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
