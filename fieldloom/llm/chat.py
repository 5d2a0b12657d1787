"""Chat formatting of reply trees: root-to-leaf paths by self-joins that double their reach, ranked, one text for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._shared import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that steer a model, here or in other templates; none of them stands unescaped in a formatted text.
_AFTER_ANGLE = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>"
_AFTER_BRACKET = r"/?INST\]"
CONTROLS = rf"(<(?=\\*(?:{_AFTER_ANGLE}))|\[(?=\\*(?:{_AFTER_BRACKET})))"
ESCAPED = rf"(<(?=\\+(?:{_AFTER_ANGLE}))|\[(?=\\+(?:{_AFTER_BRACKET})))\\"


def escape(text):
    """Put one backslash after the first character of each control string, also of one that is escaped already."""
    return F.regexp_replace(text, CONTROLS, r"$1\\")


def unescape(text):
    return F.regexp_replace(text, ESCAPED, "$1")


def escape_role(role):
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role):
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, place, node, score) of each node on each chosen root-to-leaf path; place is 0 at the root.

    nodes has tree, node, parent and score. Round k joins the table of 2^k-th ancestors with itself and with the paths
    found so far, and writes both, so a path of n nodes takes log2(n) rounds whose plans don't grow. A leaf's score is the
    sum over its path; of each tree the `best` highest paths are chosen, ties by leaf, or all. A parent that isn't in
    the tree counts as none; a cycle, and a (tree, node) that is null or repeated, raise ValueError.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    if not nodes.groupBy("tree", "node").count().where("count > 1 or tree is null or node is null").isEmpty():
        raise ValueError("(tree, node) is null or repeated")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = materialize(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("far")), "jump-0")
    parents = nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    path = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    k = 0
    while not jump.isEmpty():
        if 2**k > largest:
            raise ValueError("the replies of a tree form a cycle")
        further = path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("far").alias("node"), F.col("up") + 2**k)
        path = materialize(path.union(further), f"path-{k}")
        on = jump.select("tree", F.col("node").alias("far"), F.col("far").alias("farther"))
        k += 1
        jump = materialize(jump.join(on, ["tree", "far"]).select("tree", "node", F.col("farther").alias("far")), f"jump-{k}")
    path = path.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    one = Window.partitionBy("tree", "leaf")
    path = path.select("tree", "leaf", "node", (F.max("up").over(one) - F.col("up")).alias("place"), F.sum("score").over(one).alias("score"))
    if best is None:
        return path
    leaves = path.where("node = leaf").withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return path.join(leaves.where(F.col("rank") <= best).select("tree", "leaf"), ["tree", "leaf"], "left_semi")


def formatted(nodes: DataFrame, best: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """(tree, leaf, score, n_turns, text, loss) of each chosen path of nodes with tree, node, parent, score, role and text.

    A turn is START, its role, a line end, its text and END. loss lists the (start, end) code points of the texts of
    the trained role. Control strings inside texts get a backslash, reversibly; roles are percent-escaped. Null texts
    and roles are empty. (tree, node) must be unique and not null.
    """
    path = paths(nodes, best).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = path.withColumn("head", F.concat(F.lit(START), escape_role(role), F.lit("\n"))).withColumn("body", escape(text))
    along = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("head") + F.length("body") + len(END)).over(along) - len(END)
    turn = turn.withColumn("end", end).withColumn("start", F.col("end") - F.length("body"))
    turn = turn.withColumn("trained", F.coalesce(F.col("role") == trained_role, F.lit(False)))
    each = F.array_sort(F.collect_list(F.struct("place", "head", "body", "start", "end", "trained")))
    out = turn.groupBy("tree", "leaf").agg(F.first("score").alias("score"), each.alias("turns"))
    return out.select(
        "tree", "leaf", "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss"),
    )


def read_back(text: str = "text"):
    """array<struct<role, text>>: the turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    line = lambda p: F.instr(p, "\n")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring(F.substring_index(p, "\n", 1), len(START) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def loss_text(text: str = "text", loss: str = "loss"):
    """What stands under the loss mask, unescaped, once each and in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(F.col(text), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def reply_chains(rows: DataFrame) -> DataFrame:
    """Nodes of conversations kept as rows of (conv_id, turn, role, text): each turn replies to the one before it.

    Rows of a conversation are ordered by turn, then role and text, nulls first; repeated turns are turns of their own.
    A null conv_id is a conversation as well.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nth = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return nth.select(tree.alias("tree"), "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), F.lit(0.0).alias("score"), "role", "text")
