"""Reply trees to conversations: paths from roots to leaves, ranked, each formatted as one text (DataFrame functions only).

Messages name the message that they reply to. Self-joins double the reach of each message's pointer:
after round k it leads 2 ** k replies up, with the score and count of what lies between, so a tree of
depth d takes log2(d) rounds, each written. A leaf's score is that of its whole path; the branches of a
tree are ranked by it, and the paths that are chosen are enumerated by joins with the written rounds
from the farthest reach down, so only their messages are met, each once a path.

A conversation is its turns in order, each ``### role: text</turn>`` and a line feed. In roles and texts a
backslash stands before what would end a turn or begin one, and before every backslash (and colon of a
role), so the texts come back exactly.

Defined cases: a null or blank text is an empty or blank turn, a null role the empty role; a null score
counts 0; a message whose parent isn't there is a root; a message with a null id is a leaf; of rows with
one id in a tree all are messages and replies go to the least by content; ranks go by score, then id,
then content; messages on a cycle, and those below one, have no root and no path; a null tree is a
tree; very long texts are formatted whole; further columns are left alone; an empty table gives an
empty result. A conversation is one value, so its text must fit in a task, as a long document must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm._shared import materialize
from loomframe.operators.ordering import join_safe, places

TURN, END = "### ", "</turn>\n"


def numbered(messages: DataFrame, tree: str, id: str, parent: str, role: str, text: str, score: Column | None = None) -> DataFrame:
    """Written messages: ``tree``, ``id``, ``parent``, ``role``, ``text``, ``score`` and ``node``, a number of their own."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    score = F.lit(0.0) if score is None else F.coalesce(score.cast("double"), F.lit(0.0))
    out = messages.select(F.col(tree).alias("tree"), F.col(id).alias("id"), F.col(parent).alias("parent"), empty(role).alias("role"), empty(text).alias("text"), score.alias("score"))
    # written with the rows, as another scan may number them otherwise
    return materialize(out.withColumn("node", F.monotonically_increasing_id()), "messages")


def pointers(nodes: DataFrame) -> list[DataFrame]:
    """Round k: ``node``, ``above`` (2 ** k replies up; null if the path ends before), ``score`` and ``count`` of the nodes passed."""
    slim = nodes.select("tree", "id", "parent", "score", "node", F.xxhash64("role", "text").alias("content"))
    named = slim.filter("id is not null").groupBy("tree", "id").agg(F.min(F.struct("content", "node"))["node"].alias("above"))
    replies = slim.filter("parent is not null").select("node", "tree", F.col("parent").alias("id"))
    links = join_safe(replies, named, ["tree", "id"]).select("node", "above")
    first = slim.select("tree", "id", "content", "node", "score").join(links, "node", "left").withColumn("count", F.lit(1).cast("long"))
    rounds = [materialize(first, "reply-rounds")]
    most = rounds[0].count().bit_length() + 1
    # more rounds than that: what has no end lies on a cycle
    while len(rounds) < most and not rounds[-1].filter("above is not null").isEmpty():
        far = rounds[-1]
        far = far.select("tree", "id", "content", "node", "score", "above", "count")
        reach = far.select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("score").alias("_score"), F.col("count").alias("_count"))
        on = far.filter("above is not null").join(reach, "above")
        on = on.select("tree", "id", "content", "node", (F.col("score") + F.col("_score")).alias("score"), F.col("_above").alias("above"), (F.col("count") + F.col("_count")).alias("count"))
        rounds.append(materialize(far.filter("above is null").unionByName(on), "reply-rounds"))
    return rounds


def ranked_branches(rounds: list[DataFrame]) -> DataFrame:
    """``tree``, ``leaf``, ``score`` and ``count`` of each path, ``rank`` from 0 within its tree."""
    parents = rounds[0].filter("above is not null").select(F.col("above").alias("node")).distinct()
    leaves = rounds[-1].filter("above is null").join(parents, "node", "left_anti")
    out = places(leaves, ["tree"], [F.desc("score"), "id", "content", "node"], place="rank", keep=materialize)
    return out.select("tree", F.col("node").alias("leaf"), "score", "count", "rank")


def path_messages(branches: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``leaf``, ``node`` and ``place`` (0 is the root) of all messages of some branches' paths."""
    reached = branches.select("leaf", F.col("leaf").alias("node"), (F.col("count") - 1).alias("place"))
    for k in range(len(rounds) - 1, -1, -1):
        jump = rounds[k].filter("above is not null").select("node", "above")
        here, up = F.struct("node", "place"), F.struct(F.col("above").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        reached = reached.join(jump, "node", "left").select("leaf", F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, up))).alias("x"))
        reached = reached.select("leaf", "x.node", "x.place")
    return reached


def escaped(text: Column) -> Column:
    """A text in which neither the end of a turn nor the mark of one occurs."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(END[:-1]), F.lit("<\\" + END[1:-1]))
    return F.regexp_replace(out, "##(?=#)", "##\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def formatted(messages: DataFrame, by: list[str], learn: str = "assistant") -> DataFrame:
    """``text`` and ``turns`` of each group of messages (``place``, ``role``, ``text``) in the order of ``place``.

    ``turns``: where each turn begins (``at``) and its text begins and ends (``start``, ``end``) in
    characters of the whole, and whether a model learns from it (``learn``): the loss mask is the spans
    of such turns.
    """
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    d = messages.select(*by, "place", (F.col("role") == learn).alias("learn"), head.alias("head"), escaped(F.col("text")).alias("body"))
    d = d.withColumns({"_head": F.length("head").cast("long"), "_body": F.length("body").cast("long")})
    before = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum(F.col("_head") + F.col("_body") + len(END)).over(before), F.lit(0)))
    d = d.withColumn("start", F.col("at") + F.col("_head")).withColumn("end", F.col("start") + F.col("_body"))
    turn = F.struct("place", F.concat("head", "body", F.lit(END)).alias("text"), F.struct("at", "start", "end", "learn").alias("turn"))
    d = d.groupBy(*by).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return d.select(*by, F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), F.transform("t", lambda x: x["turn"]).alias("turns"))


def conversations(nodes: DataFrame, best: int | None = 1, learn: str = "assistant") -> DataFrame:
    """The best paths of each tree (all if None) as conversations: ``tree``, ``rank``, ``score``, ``text``, ``turns``; written."""
    rounds = pointers(nodes)
    branches = ranked_branches(rounds)
    branches = materialize(branches if best is None else branches.filter(F.col("rank") < best), "branches")
    on = path_messages(branches, rounds).join(nodes.select("node", "role", "text"), "node")
    out = formatted(on, ["leaf"], learn)
    return materialize(branches.select("tree", "leaf", "rank", "score").join(out, "leaf").drop("leaf"), "conversations")


def turn_blocks(text: Column) -> Column:
    """The formatted turns of a conversation, each without its end."""
    blocks = F.split(text, END)
    return F.slice(blocks, F.lit(1), F.size(blocks) - 1)


def parsed(text: Column) -> Column:
    """Roles and texts as they were: array of structs ``role``, ``text``."""
    head, body = "(?s)^### ((?:[^\\\\:]++|\\\\.)*+): .*$", "(?s)^### (?:[^\\\\:]++|\\\\.)*+: (.*)$"
    return F.transform(
        turn_blocks(text),
        lambda b: F.struct(unescaped(F.regexp_extract(b, head, 1)).alias("role"), unescaped(F.regexp_extract(b, body, 1)).alias("text")),
    )


def learned_texts(text: Column, turns: Column) -> Column:
    """What lies under the loss mask, as it was: an array of texts."""
    cut = F.zip_with(
        turn_blocks(text),
        turns,
        lambda b, t: F.when(t["learn"], F.substring(b, (t["start"] - t["at"] + 1).cast("int"), (t["end"] - t["start"]).cast("int"))),
    )
    return F.transform(F.filter(cut, lambda x: x.isNotNull()), unescaped)
