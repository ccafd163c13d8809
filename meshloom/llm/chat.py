"""Chat formatting of reply trees.

Messages name the message they reply to. Ancestors are found by iterative self-joins over
powers of two (a message's 2**k-th ancestor from two 2**(k-1)-th ones), so a thread of depth
d takes log2(d) joins, and the paths of the chosen leaves are expanded the same way: the rows
made are those of the paths asked for. Branches are ranked by the sum of their scores, ties
to the shorter and then to the smaller leaf id. Each chosen path becomes one text:

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>

A backslash doubles inside roles and texts, and control strings there get one after their
first character, so every control string in the output is the template's own and `read_back`
returns the turns exactly. The loss mask covers the texts of assistant turns.

Null roles and texts are empty ones. A reply to a message that is not there starts a tree of
its own. Message ids are unique; repeated rows of one id count once (the smallest role and
text stays). A reply loop has no root and is left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, table

BEGIN, END, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"([<\[])(/?(?:s>|INST\]))"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def ancestor_tables(links: DataFrame) -> list[DataFrame]:
    """links (node, up): tables of each node's 1st, 2nd, 4th, 8th, ... ancestor, with their scores summed."""
    nodes = links.count()
    steps, reach = [], 1
    step = cut_lineage(links.filter("up is not null"))
    while reach <= nodes and not step.isEmpty():
        steps.append(step)
        far = step.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("gain").alias("more"))
        step = cut_lineage(step.join(far, "up").select("node", F.col("top").alias("up"), (F.col("gain") + F.col("more")).alias("gain")))
        reach *= 2
    return steps


def branch_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """leaf, node, up_steps: the rows of the chosen root-to-leaf paths (message_id, parent_id, tree_id, score).

    ``top`` keeps the best branches of each tree; None keeps all.
    """
    ids = messages.select(F.col("message_id").alias("parent_id"), F.lit(True).alias("there"))
    links = messages.join(ids, "parent_id", "left").select(
        F.col("message_id").alias("node"), F.when(F.col("there"), F.col("parent_id")).alias("up"), "score"
    )
    # gain: the score of a node and of those passed on the way, without the one reached.
    links = cut_lineage(links.withColumn("gain", F.coalesce("score", F.lit(0.0)).cast("double")).drop("score"))
    steps = ancestor_tables(links)
    own = links.select("node", F.col("gain").alias("own"))
    parents = links.filter("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = links.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"))
    # Walk each leaf to its root, largest steps first.
    walk = leaves.withColumns({"node": F.col("leaf"), "depth": F.lit(0).cast("long"), "total": F.lit(0.0)})
    for k in range(len(steps) - 1, -1, -1):
        walk = walk.join(steps[k], "node", "left").select(
            "leaf",
            F.coalesce("up", "node").alias("node"),
            F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + (1 << k)).alias("depth"),
            (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"),
        )
    roots = links.filter("up is null").select("node")
    ranked = walk.join(roots, "node", "left_semi").join(own, "node").select("leaf", "depth", (F.col("total") + F.col("own")).alias("total"))
    if top is not None:
        trees = messages.select(F.col("message_id").alias("leaf"), "tree_id")
        best = Window.partitionBy("tree_id").orderBy(F.col("total").desc(), "depth", "leaf")
        ranked = ranked.join(trees, "leaf").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    # Moved up by 2**k, the rows up to 2**k - 1 steps above their leaf give the next 2**k: each row
    # is made by one join, and a short path takes no part in the joins of long ones.
    ranked = cut_lineage(ranked, frees=[links])
    paths = ranked.select("leaf", "depth", F.lit(0).cast("long").alias("up_steps"), F.col("leaf").alias("node"))
    grown = []
    for k, step in enumerate(steps):
        moving = paths.withColumn("up_steps", F.col("up_steps") + (1 << k)).filter("up_steps <= depth")
        higher = moving.join(step.select("node", "up"), "node").select("leaf", "depth", "up_steps", F.col("up").alias("node"))
        grown.append(cut_lineage(higher, frees=[step]))
        paths = paths.unionByName(grown[-1])
    return cut_lineage(paths.select("leaf", "up_steps", "node"), frees=[ranked, *grown])


def format_branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree_id, leaf, n_turns, formatted, loss_spans (code points, end exclusive).

    ``messages`` has tree_id, message_id, parent_id, role, text, score.
    """
    nodes = messages.groupBy("message_id").agg(
        F.min(F.struct("tree_id", "parent_id", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), "score")).alias("m")
    )
    nodes = cut_lineage(
        nodes.select(
            "message_id",
            F.col("m.tree_id").alias("tree_id"),
            F.col("m.parent_id").alias("parent_id"),
            F.col("m.col3").alias("role"),
            F.col("m.col4").alias("text"),
            F.col("m.score").alias("score"),
        )
    )
    paths = branch_paths(nodes.select("message_id", "parent_id", "tree_id", "score"), top)
    turns = paths.join(nodes.withColumnRenamed("message_id", "node"), "node").select(
        "leaf",
        "tree_id",
        "up_steps",
        F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(BODY)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == TRAINED_ROLE).alias("trained"),
    )
    before = Window.partitionBy("leaf").orderBy(F.col("up_steps").desc()).rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(END)
    at = F.coalesce(F.sum(length).over(before), F.lit(0)) + len(BEGIN) + F.length("head")
    turns = turns.withColumn("start", at.cast("long")).select(
        "leaf",
        "tree_id",
        F.struct(
            (-F.col("up_steps")).alias("place"),
            F.concat("head", "body", F.lit(END)).alias("turn"),
            "trained",
            "start",
            (F.col("start") + F.length("body")).alias("end"),
        ).alias("t"),
    )
    gathered = turns.groupBy("leaf", "tree_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return gathered.select(
        "tree_id",
        "leaf",
        F.size("ts").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.col("ts.turn"), "")).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.slice(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END), 1, F.size(F.split(formatted, END)) - 1)

    def turn(piece: Column) -> Column:
        cut = F.locate(BODY, piece) if isinstance(piece, str) else F.instr(piece, BODY)
        role = F.substr(piece, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, cut + len(BODY))).alias("text"))

    return F.transform(pieces, turn)


def thread_messages(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as messages, each replying to the turn before.

    Equal turns follow each other by role and text. Ids are conv_id and place.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order).cast("long"))
    ident = lambda place: F.struct(F.col("conv_id").alias("conv"), place.alias("place"))
    return placed.select(
        F.col("conv_id").alias("tree_id"),
        ident(F.col("place")).alias("message_id"),
        F.when(F.col("place") > 1, ident(F.col("place") - 1)).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def op3_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    done = format_branches(thread_messages(rows.unionByName(added)))
    done = done.select("tree_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    done = done.withColumn("loss", F.array_join(loss, ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL
  SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(role || text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS n FROM m
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + 17))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
