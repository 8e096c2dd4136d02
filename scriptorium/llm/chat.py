"""Chat formatting of reply trees, with DataFrame operations only.

``reply_paths`` enumerates the root-to-leaf paths of reply trees by iterative
self-joins.  The joins double: after round k every leaf knows its ancestors up to
distance 2^k and every message knows its ancestor at distance 2^k, so a thread of depth
d takes log2(d) rounds, each a pair of joins on message keys (unique on one side, so a
root with a third of all replies only makes one side of a join long, which adaptive
execution splits).  Lineage is cut each round in the shared checkpoint folder.

``rank_paths`` scores each path (mean message score) and keeps the best ones per tree;
``format_paths`` renders each kept path as one conversation with marked turns, escapes
control strings inside texts reversibly, and returns the loss spans (assistant texts).
``read_back`` undoes it from the formatted string alone.

Template: for each turn ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Inside texts and roles
every control string gets one backslash after its first character, and strings that
already look so get one more; reading back takes one away.  Newlines in roles become
``\\n`` after backslashes have been doubled.

Defined results: null texts, roles and scores count as empty, empty and 0; a reply to a
message that does not exist starts a path of its own; messages on a circle belong to no
path; messages without a tree are one tree, whose key is null; repeated message keys are kept apart by a rank; ties in score go to the smaller
leaf; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

START, END = "<|im_start|>", "<|im_end|>"
#: control strings of common chat templates; none survives verbatim inside a text
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>"]
_TAILS = "|".join(sorted({c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROL}))
ESCAPE = rf"([<\[])(\\*)({_TAILS})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.split(unescape(role), r"\\\\")  # what stood between doubled backslashes
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def linear_threads(turns: DataFrame, thread: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of conversations stored by turn: each turn replies to the one before.

    Repeated turn numbers are put in order of role and text.
    """
    w = W.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_first(), F.col("role"), F.col("text"))
    rows = turns.select(
        F.col(f"`{thread}`").alias("tree"), F.col(f"`{order}`").alias("_turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    numbered = rows.withColumn("msg", F.row_number().over(w).cast("long"))
    return numbered.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on equal keys, where a null tree equals itself."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) if k == "tree" else F.col(k) == F.col(f"_right_{k}") for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def reply_paths(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(tree, leaf, msg, dist): every message on the way from each leaf up to its root; dist 0 is the leaf.

    ``messages`` has tree, msg and parent (null at a root); (tree, msg) is unique.
    """
    ids = messages.select("tree", "msg", "parent")
    known = ids.select("tree", F.col("msg").alias("parent"))
    linked = joined(ids.filter(F.col("parent").isNotNull()), known, ["tree", "parent"], "left_semi")
    jump = checkpointed(linked.select("tree", "msg", F.col("parent").alias("up")))
    leaves = joined(ids, linked.select("tree", F.col("parent").alias("msg")).distinct(), ["tree", "msg"], "left_anti")
    paths = checkpointed(leaves.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("dist")))
    for k in range(max_rounds):
        if jump.isEmpty():
            break
        further = joined(paths, jump, ["tree", "msg"]).select("tree", "leaf", F.col("up").alias("msg"), (F.col("dist") + 2**k).alias("dist"))
        paths = checkpointed(paths.unionByName(further))
        onward = jump.select("tree", F.col("msg").alias("up"), F.col("up").alias("_next"))
        jump = checkpointed(joined(jump, onward, ["tree", "up"]).select("tree", "msg", F.col("_next").alias("up")))
        if k > 0 and further.isEmpty():
            break  # what still jumps stands on a circle, above which no leaf hangs
    return paths


def rank_paths(paths: DataFrame, messages: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best leaves of each tree by mean message score: (tree, leaf, path_score, rank)."""
    scored = joined(paths, messages.select("tree", "msg", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "msg"])
    means = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    w = W.partitionBy("tree").orderBy(F.col("path_score").desc(), F.col("leaf"))
    return means.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def format_paths(paths: DataFrame, ranked: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): each ranked path as one conversation.

    ``loss_spans`` are (start, length) in code points over ``formatted``, one per
    assistant turn, around its escaped text.
    """
    body = messages.select("tree", "msg", "role", escape_role(F.col("role")).alias("_head"), escape(F.col("text")).alias("_body"))
    rows = joined(joined(paths, ranked.select("tree", "leaf", "rank"), ["tree", "leaf"]), body, ["tree", "msg"])
    turn = F.struct((-F.col("dist")).alias("at"), F.concat(F.lit(START), "_head", F.lit("\n")).alias("head"), F.col("_body").alias("body"), (F.col("role") == "assistant").alias("learn"))
    ordered = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    close = len(END) + 1
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + close).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("long").alias("length")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return ordered.select("tree", "leaf", "rank", formatted.alias("formatted"), starts["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, read from ``formatted`` and its spans alone."""
    pieces = F.filter(F.split("formatted", F.lit(r"<\|im_end\|>\n")), lambda x: x != "")
    marked = F.transform(pieces, lambda x: F.substring(x, len(START) + 1, 2_000_000_000))
    turns = F.transform(
        marked,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, F.char_length(x))).alias("text"),
        ),
    )
    learned = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(learned, "")})
