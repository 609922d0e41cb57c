"""Chat formatting of reply trees: root-to-leaf paths by self-joins, ranked by score, each path one conversation.

Messages point to the message that they reply to. Ancestors are found by pointer doubling: joined with itself, a
table of each message's 2**k-th ancestor gives that of its 2**(k+1)-th, so a thread of any depth takes a number of
joins that grows with the logarithm of the depth. The same rounds add up scores along the way. Leaves are ranked in
their tree by the sum of scores from the root (ties: smaller leaf), and only the chosen ones' paths are enumerated.

Template: each turn is ``<|im_start|>role`` newline, the text, ``<|im_end|>`` newline. Inside roles and texts a
backslash is doubled and a control string (those of this template and of other public ones) gets a backslash after
its first character, so none is left; newlines of roles get one as well. Dropping each backslash that stands before
a character restores the text. The loss mask holds the code-point ranges of the assistants' texts.

Defined results: null texts and roles count as empty; a message whose parent is missing is a root; messages that
lead into a cycle have no root and are in no path; of rows that repeat a message's id the least is taken; trees and
messages with a null id take part under the smallest long; an empty table gives no rows. A path must fit in a row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, read_table

START, END = "<|im_start|>", "<|im_end|>\n"
NO_ID = -(1 << 63)
# What may begin a control string of this or another public template, with what follows its first letter.
CONTROL = re.compile(r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])|\|(?=>)")
TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*?)<\|im_end\|>\n")


def escape(text: str | None, role: bool = False) -> str:
    out = CONTROL.sub(lambda m: m[0] + "\\", (text or "").replace("\\", "\\\\"))
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and where the assistants' texts start and end in it."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{escape(role, True)}\n", escape(text)
        at += len(head)
        if role == "assistant":
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def tree_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, depth (0: root), role and text of every message on a chosen path.

    ``messages``: tree, node, parent (long), role, text and score.
    """
    ids = [F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias(c) for c in ("tree", "node")]
    rows = messages.select(*ids, F.struct(F.col("parent").cast("long").alias("parent"), "role", "text", F.col("score").cast("double").alias("score")).alias("m"))
    nodes = materialise(rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"), "messages")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = nodes.select("tree", "node", "parent", "score").join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    first = materialise(linked.select("tree", "node", F.col("p").alias("to"), F.coalesce("score", F.lit(0.0)).alias("sum")), "jump")
    # Messages that have reached their root leave the rounds, which only those of deeper threads go on with.
    live, done = first.where("to is not null"), first.where("to is null")
    jumps = []
    for _ in range(math.ceil(math.log2(max(first.count(), 2))) + 1):
        if not live.limit(1).count():
            break
        jumps.append(live)
        far = live.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("next"), F.col("sum").alias("more"))
        both = live.join(far, (F.col("tree") == F.col("t")) & (F.col("to") == F.col("n")))
        step = materialise(both.select("tree", "node", F.col("next").alias("to"), (F.col("sum") + F.col("more")).alias("sum")), "jump")
        live, done = step.where("to is not null"), done.unionByName(step.where("to is null"))
    replied = first.where("to is not null").select(F.col("tree").alias("t"), F.col("to").alias("p")).distinct()
    # What still has an ancestor after all rounds hangs on a cycle.
    leaves = done.join(replied, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("sum"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    paths = materialise(chosen, "paths")
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        above = paths.join(jump, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = materialise(paths.unionByName(above), "paths")
    said = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return paths.join(said, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "up", "role", "text")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, formatted, loss_starts and loss_ends for each chosen path."""
    turns = tree_paths(messages, branches).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def rendered(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                some = batch.slice(i, 1)
                text, starts, ends = render([(t["role"], t["text"]) for t in some.column(2)[0].as_py()])
                yield pa.RecordBatch.from_pydict({"tree": some.column(0), "leaf": some.column(1), "formatted": [text], "loss_starts": pa.array([starts], pa.list_(pa.int64())), "loss_ends": pa.array([ends], pa.list_(pa.int64()))})

    return turns.mapInArrow(rendered, "tree long, leaf long, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def read_back(formatted: DataFrame) -> DataFrame:
    """tree and the digests of what a formatted conversation holds."""

    def digest(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for tree, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss_starts", "loss_ends"))):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return formatted.mapInArrow(digest, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each row replies to the one before it (ties in turn: role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").cast("long").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    done = read_back(format_trees(conversation_messages(talks.unionByName(own))))
    return done.select(F.when(F.col("tree") != NO_ID, F.col("tree")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
