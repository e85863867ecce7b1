"""Chat formatting of reply trees.

Messages are nodes that name their parent. Iterative self-joins with doubling steps
(node -> ancestor 1, 2, 4, ... levels up) first sum the scores along every
root-to-leaf path, one row per leaf; the branches of a conversation are ranked by that
sum; the same step tables then list the messages of the chosen paths only. So the work
is linear in the messages times the logarithm of the depth, and no tree is gathered.
Each chosen path becomes one conversation.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline, per turn. Inside
texts and roles a backslash is doubled and every known control string is broken by a
backslash after its first character (in roles a newline also gets one before it);
dropping each backslash, keeping the second of a pair, restores the text.

Defined cases: null text and null role read as empty; a null conversation id is one
conversation; a parent that is null or not there makes a root; equal scores rank by
leaf; rows that share conversation and position are ordered by role and text; no rows
give no rows; a cycle of parents raises ValueError; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.session import cut_lineage

#: The control strings of this template and of the common ones beside it.
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BACKSLASH = "\\"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + BACKSLASH + control[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BACKSLASH + "\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _same(a: str, b: str, node_a: str, node_b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{node_a}") == F.col(f"{b}.{node_b}"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Nodes (conv, node, parent, score) -> conv, branch (rank from 1), branch_score,
    node, depth_from_leaf for the ``branches`` best root-to-leaf paths of each conversation."""
    nodes = nodes.select("conv", "node", "parent", "score")
    total = nodes.count()
    n, p = nodes.alias("n"), nodes.alias("p")
    # score: what the nodes from this one up to, but without, the ancestor add up to
    step = cut_lineage(n.join(p, _same("n", "p", "parent", "node"))
                       .select("n.conv", "n.node", F.col("n.parent").alias("up"), F.col("n.score").alias("sum")),
                       "reply-step")
    c = nodes.where("parent is not null").alias("c")
    leaves = n.join(c, _same("n", "c", "node", "parent"), "left_anti").select("n.conv", "n.node")
    steps: list[DataFrame] = []
    while not step.isEmpty():
        if 2 ** len(steps) > total:
            raise ValueError("the replies hold a cycle")
        steps.append(step)
        s, t = step.alias("s"), step.alias("t")
        step = cut_lineage(s.join(t, _same("s", "t", "up", "node"))
                           .select("s.conv", "s.node", "t.up", (F.col("s.sum") + F.col("t.sum")).alias("sum")),
                           "reply-step")
    # every path is shorter than twice the largest step: from there down, each step is taken at most once
    at = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0.0).alias("sum"))
    for s in reversed(steps):
        a, s = at.alias("a"), s.alias("s")
        at = (a.join(s, _same("a", "s", "node", "node"), "left")
              .select("a.conv", "a.leaf", F.coalesce("s.up", "a.node").alias("node"),
                      (F.col("a.sum") + F.coalesce("s.sum", F.lit(0.0))).alias("sum")))
    a, r = at.alias("a"), nodes.alias("r")
    scored = (a.join(r, _same("a", "r", "node", "node"))
              .select("a.conv", "a.leaf", (F.col("a.sum") + F.col("r.score")).alias("branch_score")))
    order = Window.partitionBy("conv").orderBy(F.desc("branch_score"), "leaf")
    chosen = (scored.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches))
    paths = cut_lineage(chosen.select("conv", "branch", "branch_score", F.col("leaf").alias("node"),
                                      F.lit(0).cast("long").alias("depth_from_leaf")), "reply-paths")
    for k, s in enumerate(steps):
        a, s = paths.alias("a"), s.alias("s")
        higher = a.join(s, _same("a", "s", "node", "node")).select(
            "a.conv", "a.branch", "a.branch_score", F.col("s.up").alias("node"),
            (F.col("a.depth_from_leaf") + 2 ** k).alias("depth_from_leaf"))
        paths = cut_lineage(paths.unionByName(higher), "reply-paths")
    return paths


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Nodes (conv, node, parent, score, role, text) -> conv, branch, branch_score,
    ``formatted`` and its ``segments`` (text, loss): the parts of ``formatted`` in order,
    with the loss mask, which holds the assistant's texts."""
    m, p = nodes.alias("m"), best_paths(nodes, branches).alias("p")
    blank = F.lit("")
    turns = p.join(m, _same("p", "m", "node", "node")).select(
        "p.conv", "p.branch", "p.branch_score", "p.depth_from_leaf",
        escape_role(F.coalesce("m.role", blank)).alias("role"),
        (F.coalesce("m.role", blank) == "assistant").alias("loss"),
        escape(F.coalesce("m.text", blank)).alias("text"))
    turn = F.struct((-F.col("depth_from_leaf")).alias("at"), "role", "loss", "text")
    rows = turns.groupBy("conv", "branch", "branch_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(START), t["role"], F.lit("\n")), F.lit(False)),
        segment(t["text"], t["loss"]), segment(F.lit(END + "\n"), F.lit(False)))))
    return rows.select("conv", "branch", "branch_score", segments.alias("segments")).select(
        "conv", "branch", "branch_score", F.array_join("segments.text", "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    header = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n"
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, header, 1)).alias("role"),
                           unescape(F.regexp_replace(p, header, "")).alias("text")))


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as nodes: each turn replies to the one before it;
    longer texts score higher."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text")
            .withColumn("node", F.row_number().over(order).cast("long"))
            .select(F.col("conv_id").alias("conv"), "node",
                    F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"), "role", "text"))
