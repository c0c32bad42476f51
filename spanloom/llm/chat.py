"""Reply trees to training conversations, with DataFrame functions only.

Every root-to-leaf path of a tree is a branch. Branches are ranked by the sum of their messages' scores; each chosen
one is formatted as one conversation with marked turns and a loss mask over the assistant's texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.scratch import Scratch


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is start, role, separator, text, end. learn: the roles under the loss mask.

    Control strings begin with one of the `guarded` characters. Those become entities inside roles and texts, as does
    the ampersand itself, so no text can hold a control string and each can be read back.
    """

    start: str = "<|turn|>"
    separator: str = "\n"
    end: str = "<|end|>\n"
    learn: tuple[str, ...] = ("assistant",)
    guarded: tuple[tuple[str, str], ...] = (("<", "&lt;"), ("[", "&#91;"))

    def escape(self, text: Column) -> Column:
        text = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
        for plain, entity in self.guarded:
            text = F.replace(text, F.lit(plain), F.lit(entity))
        return text

    def escape_role(self, role: Column) -> Column:
        """A role is one line."""
        return F.replace(self.escape(role), F.lit("\n"), F.lit("&#10;"))

    def unescape(self, text: Column) -> Column:
        for plain, entity in (*self.guarded, ("\n", "&#10;"), ("&", "&amp;")):
            text = F.replace(text, F.lit(entity), F.lit(plain))
        return text

    def read_turns(self, formatted: Column) -> Column:
        """The turns of a formatted conversation: array of role and text."""
        whole = F.filter(F.split(formatted, F.lit(_quoted(self.start))), lambda x: x != "")
        cut = len(self.end)

        def turn(x: Column) -> Column:
            head = F.substring_index(x, self.separator, 1)
            body = F.substring(x, F.length(head) + len(self.separator) + 1, F.length(x) - F.length(head) - len(self.separator) - cut)
            return F.struct(self.unescape(head).alias("role"), self.unescape(body).alias("text"))

        return F.transform(whole, turn)


def _quoted(literal: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in literal)


def chain(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Messages of linear conversations: each row answers the one before it. Rows of one turn follow by role and text; null
    trees are one conversation, null turns, roles and texts come first."""
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    named = rows.select(F.col(tree).alias("tree"), F.col(order).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return named.withColumn("message", place.cast("long")).select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _once(messages: DataFrame, *more: str) -> DataFrame:
    """One row for each (tree, message): of repeated ones the least by parent, the other columns and score. node is the
    key of a message; nulls in it are values like others."""
    rest = ("parent", *more, "score")
    least = F.min(F.struct(*rest)).alias("x")
    rows = messages.where("message IS NOT NULL").select("tree", "message", *rest).groupBy("tree", "message").agg(least)
    return rows.select("tree", "message", F.struct("tree", "message").alias("node"), *(F.col(f"x.{c}").alias(c) for c in rest))


def branches(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, depth, message) with a row for each message of each chosen root-to-leaf path.

    messages: tree, message, parent (null or unknown: a root), score. Jumps of 1, 2, 4, ... replies and the scores along
    them are made by self-joins until every message has reached its root or is known to have none; so branches are ranked
    before any path is written out. Going down from the widest jump, the chosen leaves reach each of their ancestors
    exactly once. A path of n messages takes log n joins, and no more rows than the chosen paths have. keep: branches of
    each tree, best first; ties go to the lesser leaf; None keeps all.

    Null trees are one tree, a null score counts 0. Of repeated (tree, message) rows the least by parent and score counts.
    Messages on or below a cycle of replies have no root and are on no path. No messages, no rows.
    """
    return _paths(_once(messages), keep, Scratch(messages.sparkSession, "chat"))


def _paths(once: DataFrame, keep: int | None, scratch: Scratch) -> DataFrame:
    up = F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("message")))
    nodes = scratch.put(once.select("node", up.alias("up"), F.coalesce("score", F.lit(0.0)).alias("total")), "nodes")
    known = nodes.select(F.col("node").alias("above"))
    first = nodes.join(known, F.col("up") == F.col("above"), "left").select("node", F.col("above").alias("up"), "total", F.lit(1).cast("long").alias("covers"))
    # up: the ancestor 2^k replies above, null past the root; total and covers: of the messages before it. Only messages
    # that haven't reached their root go on; those that have are met where they were written
    state = scratch.put(first, "jump-0")
    lives, ends, rows = [state.where("up IS NOT NULL")], state.where("up IS NULL").drop("up"), nodes.count()
    while (1 << len(lives)) <= 2 * rows and not lives[-1].isEmpty():
        live = lives[-1]
        met = (F.col("node").alias("at"), F.col("total").alias("more"), F.col("covers").alias("longer"))
        sums = ((F.col("total") + F.col("more")).alias("total"), (F.col("covers") + F.col("longer")).alias("covers"))
        on = live.join(live.select(*met, F.col("up").alias("over")), F.col("up") == F.col("at")).select("node", F.col("over").alias("up"), *sums)
        up_there = live.join(ends.select(*met), F.col("up") == F.col("at")).select("node", F.lit(None).cast(on.schema["up"].dataType).alias("up"), *sums)
        state = scratch.put(on.unionByName(up_there), f"jump-{len(lives)}")
        lives.append(state.where("up IS NOT NULL"))
        ends = ends.unionByName(state.where("up IS NULL").drop("up"))
    answered = lives[0].select(F.col("up").alias("node")).distinct()
    leaves = ends.join(answered, "node", "left_anti")
    leaves = leaves.select(F.col("node.tree").alias("tree"), F.col("node.message").alias("leaf"), "node", F.col("total").alias("score"), "covers")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    chosen = scratch.put(ranked.where(F.col("rank") <= keep) if keep is not None else ranked, "chosen")
    reached = chosen.select(F.col("node").alias("end"), "node", F.lit(0).cast("long").alias("back"))
    for k in range(len(lives) - 1, -1, -1):
        jump = lives[k].select("node", "up")
        reached = scratch.put(reached.unionByName(reached.join(jump, "node").select("end", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))), f"reached-{k}")
    path = reached.join(chosen.withColumnRenamed("node", "end"), "end")
    return path.select("tree", "leaf", "rank", "score", (F.col("covers") - 1 - F.col("back")).alias("depth"), F.col("node.message").alias("message"))


def format_trees(messages: DataFrame, template: ChatTemplate | None = None, keep: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss) for each chosen branch.

    messages: tree, message, parent, role, text, score. loss: array of (start, length) in code points of formatted, from
    0, in order: the escaped texts that are learnt. A null role or text is an empty one; of repeated (tree, message) rows
    the least by parent, role, text and score counts; other columns are ignored; no messages, no rows.
    """
    template = template or ChatTemplate()
    scratch = Scratch(messages.sparkSession, "chat")
    once = scratch.put(_once(messages, "role", "text"), "messages")
    path = _paths(once, keep, scratch).withColumn("node", F.struct("tree", "message"))
    turns = path.join(once.select("node", "role", "text"), "node")
    role, text = template.escape_role(F.col("role")), template.escape(F.col("text"))
    turns = turns.withColumn("head", F.concat(F.lit(template.start), role, F.lit(template.separator))).withColumn("body", text)
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(template.end))
    turns = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    piece = F.struct("depth", F.concat("head", "body", F.lit(template.end)).alias("piece"), "at", F.length("body").cast("long").alias("n"), F.col("role").isin(*template.learn).alias("learnt"))
    whole = turns.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["at"].alias("start"), t["n"].alias("length")))
    return whole.select("tree", "leaf", "rank", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))
