"""Chat formatting of reply trees.

Messages form trees by ``parent_id``.  Self-joins double the reach of every message's
link to its ancestors in each round, and with it that of the paths, which are built from
the leaves alone; a tree of depth d takes about log2(d) rounds and holds one row for each
message of each root-to-leaf path, no more.  Paths of a tree are ranked by the sum of their
messages' scores and the best are formatted, each as one conversation.

A turn is ``<|im_start|>role\\n text <|im_end|>\\n``.  Control strings inside roles
and texts get a backslash after their first character (one more, if backslashes are
there already), which :func:`unescape` takes back exactly.

Handling: null text and null role are empty; null score is 0; a parent that does not
exist makes its child a root; of parents that form a circle (or a message that is its own
parent) the smallest node id becomes a root; null tree ids form one tree of their own; rows
without a node id are left out; ties in score go to the smaller leaf id; repeated (tree,
node) rows keep the one that sorts first; an empty table gives an empty result; columns of
other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, split after the first character.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/s>|s>|<SYS>>|</SYS>>|INST\]|/INST\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def role_line(c: Column) -> Column:
    """A role on one line: backslash and newline written as two characters, then control strings escaped."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def read_role(c: Column) -> Column:
    """Inverse of :func:`role_line`; newlines are read between doubled backslashes."""
    raw = unescape(c)
    return F.array_join(F.transform(F.split(raw, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _key(left: str, right: str) -> Column:
    """Equal (tree, node) of two aliased sides, null trees included."""
    return F.col(f"{left}.tree_id").eqNullSafe(F.col(f"{right}.tree_id")) & (F.col(f"{left}.up") == F.col(f"{right}.node_id"))


def without_circles(links: DataFrame) -> DataFrame:
    """``links`` (tree_id, node_id, up) of which some never end: the smallest node of each circle loses its parent.

    ``least`` is the smallest id among the next 2**k ancestors, so that of a node of the
    circle is the circle's once the reach exceeds the tree.
    """
    most = links.groupBy("tree_id").count().agg(F.max("count")).first()[0]
    far = links.withColumn("least", F.coalesce("up", "node_id"))
    reach = 1
    while reach <= most:
        a, b = far.alias("a"), far.alias("b")
        step = a.join(b, _key("a", "b"), "left").select("a.tree_id", "a.node_id", F.col("b.up").alias("up"), F.least("a.least", F.coalesce("b.least", "a.least")).alias("least"))
        far, reach = cut(step, "chat-circles"), 2 * reach
    # the links that are left lead into circles; where they arrive is on one
    on = far.where("up is not null").select("tree_id", F.col("up").alias("node_id")).distinct().alias("o")
    f = far.alias("f")
    same = F.col("o.tree_id").eqNullSafe(F.col("f.tree_id")) & (F.col("o.node_id") == F.col("f.node_id"))
    first = on.join(f, same).where(F.col("f.least") == F.col("o.node_id")).select(F.col("o.tree_id").alias("c_tree"), F.col("o.node_id").alias("c_node"))
    own = F.col("tree_id").eqNullSafe(F.col("c_tree")) & (F.col("node_id") == F.col("c_node"))
    return cut(links.join(first, own, "left").select("tree_id", "node_id", F.when(F.col("c_node").isNull(), F.col("up")).alias("up")), "chat-links")


def tree_paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, above, node_id): a row for each message of each root-to-leaf path, ``above`` the leaf by so many steps.

    ``messages`` needs tree_id, node_id (distinct in its tree) and parent_id.
    """
    n = messages.select("tree_id", "node_id", "parent_id").where("node_id is not null")
    known = F.col("tree_id").eqNullSafe(F.col("p_tree")) & (F.col("parent_id") == F.col("p_id"))
    links = cut(n.join(n.select(F.col("tree_id").alias("p_tree"), F.col("node_id").alias("p_id")), known, "left").select("tree_id", "node_id", F.col("p_id").alias("up")), "chat-links")
    most = links.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0

    def start(links: DataFrame) -> DataFrame:
        parents = links.where("up is not null").select("tree_id", "up").distinct().alias("p")
        leaf = F.col("p.tree_id").eqNullSafe(F.col("l.tree_id")) & (F.col("p.up") == F.col("l.node_id"))
        return links.alias("l").join(parents, leaf, "left_anti").select("tree_id", F.col("node_id").alias("leaf_id"), F.lit(0).cast("long").alias("above"), "node_id")

    whole, far, reach = links, links, 1
    paths = start(links)
    while not far.where("up is not null").isEmpty():
        if reach > most:  # longer than any path: some parents form circles
            whole = far = without_circles(whole)
            paths, reach = start(whole), 1
        # every message so far leads to the one ``reach`` steps above it
        further = paths.alias("x").join(far.where("up is not null").alias("f"), F.col("x.tree_id").eqNullSafe(F.col("f.tree_id")) & (F.col("x.node_id") == F.col("f.node_id")))
        paths = cut(paths.unionByName(further.select("x.tree_id", "x.leaf_id", (F.col("x.above") + reach).alias("above"), F.col("f.up").alias("node_id"))), "chat-paths")
        a, b = far.where("up is not null").alias("a"), far.where("up is not null").alias("b")
        far = cut(a.join(b, _key("a", "b")).select("a.tree_id", "a.node_id", F.col("b.up").alias("up")), "chat-links")
        reach *= 2
    return paths


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One formatted conversation per chosen path: tree_id, leaf_id, branch, path_score, formatted, loss_spans.

    ``branches`` keeps the best paths of each tree (all by default).  ``loss_spans`` holds
    (start, length) in code points of each assistant text within ``formatted``.
    """
    first = F.row_number().over(W.partitionBy("tree_id", "node_id").orderBy("role", "text", "parent_id", "score"))
    msgs = messages.select("tree_id", "node_id", "parent_id", "role", "text", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    msgs = msgs.where("node_id is not null").withColumn("_n", first).where("_n = 1").drop("_n")
    nodes = cut(msgs.select("tree_id", "node_id", "parent_id", "score"), "chat-nodes")
    steps = tree_paths(nodes)
    s = nodes.select(F.col("tree_id").alias("m_tree"), F.col("node_id").alias("m_id"), "score")
    own = F.col("tree_id").eqNullSafe(F.col("m_tree")) & (F.col("node_id") == F.col("m_id"))
    paths = steps.join(s, own).groupBy("tree_id", "leaf_id").agg(F.sum("score").alias("path_score"))
    best = F.row_number().over(W.partitionBy("tree_id").orderBy(F.col("path_score").desc(), "leaf_id"))
    paths = paths.withColumn("branch", best)
    if branches is not None:
        paths = paths.where(F.col("branch") <= branches)
    p = paths.select(F.col("tree_id").alias("b_tree"), F.col("leaf_id").alias("b_leaf"), "branch", "path_score")
    steps = steps.join(p, F.col("tree_id").eqNullSafe(F.col("b_tree")) & (F.col("leaf_id") == F.col("b_leaf"))).select("tree_id", "leaf_id", "branch", "path_score", (-F.col("above")).alias("place"), F.col("node_id").alias("step"))
    m = msgs.select(F.col("tree_id").alias("m_tree"), F.col("node_id").alias("m_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.concat(F.lit(OPEN), role_line(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE + "\n"))
    body = F.length(escape(F.col("text"))).cast("long")
    full = steps.join(m, F.col("tree_id").eqNullSafe(F.col("m_tree")) & (F.col("step") == F.col("m_id")))
    turns = F.array_sort(F.collect_list(F.struct("place", turn.alias("s"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))))
    g = full.groupBy("tree_id", "leaf_id", "branch", "path_score").agg(turns.alias("turns"))
    # running end of each turn; the text ends CLOSE and a newline before it
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t["s"]).cast("long")
        span = F.struct((end - F.lit(len(CLOSE) + 1) - t["body"]).alias("start"), t["body"].alias("length"))
        return F.struct(end.alias("at"), F.when(t["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("turns", nothing, add, lambda a: a["spans"])
    return g.select("tree_id", "leaf_id", "branch", "path_score", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")

    def read(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(OPEN) + 1))
        cut_at = F.instr(inner, "\n")
        return F.struct(read_role(F.substr(inner, F.lit(1), cut_at - 1)).alias("role"), unescape(F.substr(inner, cut_at + 1)).alias("text"))

    return F.transform(parts, read)


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as chains: each row answers the one before it."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    n = rows.withColumn("node_id", at)
    return n.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op1_reply_trees(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    f = format_trees(conversations_as_trees(rows.unionByName(extra)))
    f = f.withColumn("turns", read_turns(F.col("formatted")))
    f = f.withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""))
    return f.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_reply_trees": op1_reply_trees}
_ESC = rf"'([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g'"
ORACLE = {
    "op1_reply_trees": f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f as (select *, '{OPEN}' || regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), {_ESC}) || chr(10) || regexp_replace(text, {_ESC}) || '{CLOSE}' || chr(10) as s from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(s))::bigint as formatted_chars from f group by conv_id""",
}
