"""Chat formatting: reply trees to conversations, in DataFrame operations only.

Messages name their parent. Paths are found by pointer jumping: a table of 2**k-th ancestors is
joined with itself until the deepest root is reached, and the chosen leaves walk up those tables
from the largest step to the smallest. That takes about 2 * log2(depth) joins and makes no more rows
than the chosen paths have messages; a branch's score comes from the same jumps.

Template, a turn after another::

    <s>[ROLE] text [/ROLE]</s>   with the role's own name between the brackets

Inside roles and texts a backslash is written \\e, < is written \\l, [ is written \\b and ] is written
\\r, so none of the template's control strings can occur there; unescape() reverses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import drop, table

# ---------------------------------------------------------------- fixed values: the template
OPEN, NAMED, SHUT, CLOSE = "<s>[", "] ", "[/", "]</s>"
_ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r")]

#: Roles whose texts are under the loss mask.
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(_ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


# ---------------------------------------------------------------- reply trees


def chain(rows: DataFrame, tree: str, order: list[str], role: str, text: str) -> DataFrame:
    """Plain conversations as trees of one path: each row replies to the one before in this order.

    Rows that tie in the order are taken by role and text; nulls come first in it. Null roles and
    texts become empty, texts stay whole at any length. Null tree ids are one tree; repeated rows are
    turns of their own; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    src = rows.select(F.col(tree).alias("tree"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy(*[f"o{i}" for i in range(len(order))], "role", "text")).cast("long")
    return src.select("tree", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, dist): the messages on the best `top` root-to-leaf paths of each tree (None: all).

    A path's score is the mean score of its messages; ties go to the smaller leaf. A message whose
    parent is null, or missing from the tree, is a root. Messages in a cycle, or below one, have no
    root and appear on no path. Null scores count 0, null tree ids are one tree. (tree, node) names a
    message, so rows that repeat it multiply the paths through it. Other columns are ignored; an
    empty table gives no rows.
    """
    key = table(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    live = key.select(F.col("tree").alias("t"), F.col("node").alias("p")).distinct()
    same = lambda a, b: a.eqNullSafe(b)
    # step 0: a message, its parent, and what the jump adds up
    jump = key.where("parent is not null").join(live, same(F.col("tree"), F.col("t")) & (F.col("parent") == F.col("p"))).select("tree", "node", F.col("parent").alias("up"), "score")
    jumps = [table(jump, "jump0")]
    largest = key.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << len(jumps) < largest:  # no path is longer than its tree has messages
        a = jumps[-1]
        b = a.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("s2"))
        nxt = table(a.join(b, same(F.col("tree"), F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score")), f"jump{len(jumps)}")
        if nxt.isEmpty():
            drop(nxt)
            break
        jumps.append(nxt)

    def step(walk: DataFrame, k: int) -> DataFrame:
        b = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", F.col("score").alias("s"))
        return walk.join(b, same(F.col("tree"), F.col("t")) & (F.col("at") == F.col("n")), "left")

    inner = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = key.join(inner, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("dist"))
    ranked = leaves
    for k in reversed(range(len(jumps))):  # to the root: the path's sum and length
        ranked = step(ranked, k).select("tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("total"), F.when(F.col("up").isNotNull(), F.col("dist") + (1 << k)).otherwise(F.col("dist")).alias("dist"))
    replies = jumps[0].select(F.col("tree").alias("t"), F.col("node").alias("n"))
    roots = key.join(replies, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("score").alias("s"))
    ranked = ranked.join(roots, same(F.col("tree"), F.col("t")) & (F.col("at") == F.col("n"))).select("tree", "leaf", ((F.col("total") + F.col("s")) / (F.col("dist") + 1)).alias("mean"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    walk = table(ranked.select("tree", "leaf", "rank", F.col("leaf").alias("at"), F.lit(0).cast("long").alias("dist")), "leaves")
    for k in reversed(range(len(jumps))):
        here = F.struct("at", "dist")
        there = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("at"), (F.col("dist") + (1 << k)).alias("dist")))
        walk = step(walk, k).select("tree", "leaf", "rank", F.inline(F.array_compact(F.array(here, there))))
    out = table(walk.select("tree", "leaf", "rank", F.col("at").alias("node"), "dist"), "paths")
    drop(key, *jumps)
    return out


# ---------------------------------------------------------------- formatting


def format_paths(messages: DataFrame, on: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one string a path, and the spans under the loss mask.

    loss is an array of (start, length, turn, at), ordered, one for each text of a loss role: start and
    length in code points of formatted, and the same place as at in the turn of that number.
    """
    m = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = on.join(m, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("n")))
    role, text = escape(F.col("role")), escape(F.col("text"))
    head, tail = F.concat(F.lit(OPEN), role, F.lit(NAMED)), F.concat(F.lit(SHUT), role, F.lit(CLOSE))
    rows = rows.select("tree", "leaf", "rank", (-F.col("dist")).alias("k"), head.alias("head"), text.alias("body"), tail.alias("tail"), F.col("role").isin(*loss_roles).alias("is_loss"))
    size = lambda c: F.length(c).cast("long")
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"at": F.coalesce(F.sum(size("head") + size("body") + size("tail")).over(before), F.lit(0)), "turn": F.row_number().over(Window.partitionBy("tree", "leaf", "rank").orderBy("k")) - 1})
    span = F.when(F.col("is_loss"), F.struct((F.col("at") + size("head")).alias("start"), size("body").alias("length"), "turn", F.length("head").alias("at")))
    turn = F.struct("k", F.concat("head", "body", "tail").alias("turn"))
    done = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss"))
    return done.select("tree", "leaf", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss")


def _pieces(formatted: Column) -> Column:
    """A string for each turn, without its end; the last is empty."""
    return F.split(formatted, r"\Q" + CLOSE + r"\E")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    return F.transform(
        F.filter(_pieces(formatted), lambda p: p != ""),
        lambda p: F.struct(
            unescape(F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.length(p)), NAMED[0], 1)).alias("role"),
            unescape(_between(p)).alias("text"),
        ),
    )


def _between(piece: Column) -> Column:
    """What stands behind the first NAMED and before the last SHUT; neither can occur in a text."""
    inner = F.substring_index(piece.substr(F.lit(len(OPEN) + 1), F.length(piece)), SHUT, 1)
    role = F.substring_index(inner, NAMED[0], 1)
    return inner.substr(F.length(role) + len(NAMED) + 1, F.length(inner))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; each turn is read once, however long the whole."""
    text = lambda pieces: F.transform(loss, lambda s: unescape(F.get(pieces, s["turn"]).substr(s["at"] + 1, s["length"].cast("int"))))
    return F.array_join(F.get(F.transform(F.array(_pieces(formatted)), text), F.lit(0)), "")


def format_trees(messages: DataFrame, top: int | None = 1, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) to one formatted conversation for each chosen path.

    Nulls: a null role or text is empty, a null score 0, a null tree a tree like others; messages
    with a null node are left out, since nothing can name them. Repeated (tree, node) rows: the
    first by role and text counts. Extra columns are ignored. An empty table gives no rows.
    """
    names = ["tree", "node", "parent", "role", "text", "score"]
    rows = messages.select(*names).where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    rows = rows.select("tree", "node", *[F.col(f"m.{c}").alias(c) for c in names[2:]])
    return format_paths(rows, paths(rows, top), loss_roles)
