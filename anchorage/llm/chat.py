"""Chat formatting: reply trees as root-to-leaf paths, each written through a template whose turns can be read back."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch
from .text import sha256_hex

#: A turn is OPEN role BREAK text CLOSE; conversations in these marks are common in training data.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that steer this template or common others. None ends with what another begins with, so that text before a mark
#: cannot make one together with it.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_REST = "(?=(?:" + "|".join(re.escape(c[1:]) for c in CONTROL) + "))"
#: The role whose texts are trained on.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    r"""A backslash behind the first character of every control string; one more where there are backslashes already, so
    that `<s>` becomes `<\s>` and `<\s>` becomes `<\\s>`. All other text, other backslashes too, stays."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_REST}", r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(rf"([<\[])\\(\\*){_REST}", r"\1\2", text)


def _role(role: Column) -> Column:
    """A role ends at the line's end, so line feeds and backslashes in it are written as backslash letters."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _read_role(role: str) -> str:
    return unescape(re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role))


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages(tree_id, msg_id, parent_id, score, ...) -> (tree_id, leaf_id, rank, path_score, depth, msg_id): of each tree
    the `best` root-to-leaf paths by the mean score of their messages (null counts 0), ties to the longer path, then the smaller leaf;
    a row for each message of a chosen path, depth 0 at its root.

    Self-joins double the reach of each message's pointer to an ancestor, with depth and score on the way, so that paths
    of n messages take log n joins over ids. Paths are then enumerated for chosen leaves only, halving the reach again.
    A message whose parent is null or not in its tree is a root. Messages on or behind a ring of parents have no root and
    are on no path. Rows that repeat a (tree_id, msg_id) count as one, with the least parent. A null tree is a tree; rows
    with a null msg_id are no messages.
    """
    scratch = Scratch(messages.sparkSession)
    one = F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score")))
    found = messages.where(F.col("msg_id").isNotNull()).groupBy("tree_id", "msg_id").agg(one.alias("m"))
    nodes = scratch.put(found.select("tree_id", "msg_id", "m.parent_id", "m.score"))
    same = lambda a, b, x, y: F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    parents = nodes.select("tree_id", F.col("msg_id").alias("up")).alias("p")
    linked = nodes.alias("n").join(parents, same("n", "p", "parent_id", "up"), "left")
    # far: the ancestor 2^k above; depth and total: messages above this one as far as it knows, and their scores with its own.
    reach = scratch.put(linked.select("n.tree_id", "n.msg_id", F.col("p.up").alias("far"), F.when(F.col("p.up").isNull(), 0).otherwise(1).alias("depth"), F.col("n.score").alias("total")))
    levels, open_ = [reach], reach.where(F.col("far").isNotNull()).count()
    while open_:
        # Only messages that have not met their root go on; each looks up the one it points to.
        further = reach.select("tree_id", F.col("msg_id").alias("at"), F.col("far").alias("next"), F.col("depth").alias("more"), F.col("total").alias("above"))
        joined = reach.where(F.col("far").isNotNull()).alias("r").join(further.alias("f"), same("r", "f", "far", "at"), "left")
        step = joined.select("r.tree_id", "r.msg_id", F.col("f.next").alias("far"), (F.col("r.depth") + F.coalesce("f.more", F.lit(0))).alias("depth"), (F.col("r.total") + F.coalesce("f.above", F.lit(0.0))).alias("total"))
        reach = scratch.put(step.union(reach.where(F.col("far").isNull())))
        left = reach.where(F.col("far").isNotNull()).count()
        # Each doubling settles a message at least, unless all that are left hang on rings.
        if left == open_:
            break
        levels.append(reach)
        open_ = left
    inner = nodes.select("tree_id", F.col("parent_id").alias("up")).where(F.col("up").isNotNull()).distinct()
    leaves = reach.where(F.col("far").isNull()).alias("l").join(inner.alias("i"), same("l", "i", "msg_id", "up"), "left_anti")
    scored = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), (F.col("total") / (F.col("depth") + 1)).alias("path_score"), "depth")
    order = Window.partitionBy("tree_id").orderBy(F.desc("path_score"), F.desc("depth"), "leaf_id")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    # A row stands for the messages from msg_id up to fewer than 2^k above it; top down they are halved into single ones.
    paths = scratch.put(chosen.select("tree_id", "leaf_id", "rank", "path_score", "depth", F.col("leaf_id").alias("msg_id")))
    for k in range(len(levels) - 2, -1, -1):
        far = levels[k].where(F.col("far").isNotNull()).select("tree_id", F.col("msg_id").alias("at"), "far")
        upper = paths.alias("p").join(far.alias("f"), same("p", "f", "msg_id", "at"))
        paths = scratch.put(paths.union(upper.select("p.tree_id", "p.leaf_id", "p.rank", "p.path_score", F.col("p.depth") - (1 << k), "f.far")))
    return paths


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv, pos, role, text) -> (conv, formatted, loss array<struct<start,length>>): the turns by pos through the
    template, and the stretches of it, in code points from 0, that are trained on: the texts of the assistant.

    Null roles and texts are empty. Turns are escaped before they are gathered; a conversation is one row, as it is one
    line of training data.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), _role(role), F.lit(BREAK))
    some = turns.select("conv", "pos", F.length(head).alias("head"), F.concat(head, escaped(text), F.lit(CLOSE)).alias("piece"), (role == TRAINED).alias("trained"))
    struct = F.struct("pos", "head", F.length("piece").alias("n"), "trained", "piece")
    whole = some.groupBy("conv").agg(F.sort_array(F.collect_list(struct)).alias("t"))
    told = F.transform("t", lambda t: F.struct(t["head"].alias("head"), t["n"].alias("n"), t["trained"].alias("trained")))
    return whole.select("conv", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), F.pandas_udf(_spans, "array<struct<start:long,length:long>>")(told).alias("loss"))


def _spans(turns: pd.Series) -> pd.Series:
    """Running sums of the lengths: where each trained text stands."""
    out = []
    for conversation in turns:
        at, spans = 0, []
        for t in conversation:
            if t["trained"]:
                spans.append({"start": at + t["head"], "length": t["n"] - t["head"] - len(CLOSE)})
            at += t["n"]
        out.append(spans)
    return pd.Series(out)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition(BREAK)
        out.append((_read_role(role), unescape(rest[: -len(CLOSE)])))
    return out


def under_mask(formatted: str, loss: list) -> str:
    """All text under the loss mask, as it was before it was escaped."""
    return "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in loss)


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """messages(tree_id, msg_id, parent_id, score, role, text) -> (tree_id, leaf_id, rank, path_score, formatted, loss): the
    `best` paths of each tree (reply_paths()), each as one conversation.

    Texts are shuffled twice, to their ids' places on paths and to their conversations; all joins before are over ids.
    """
    paths = reply_paths(messages.select("tree_id", "msg_id", "parent_id", "score"), best)
    texts = messages.where(F.col("msg_id").isNotNull()).groupBy("tree_id", "msg_id").agg(F.min(F.struct("parent_id", "role", "text")).alias("m"))
    at = paths.select(F.col("tree_id").alias("__tree"), F.col("msg_id").alias("__msg"), F.struct("tree_id", "leaf_id", "rank", "path_score").alias("conv"), F.col("depth").alias("pos"))
    met = texts.join(at, F.col("tree_id").eqNullSafe(F.col("__tree")) & (F.col("msg_id") == F.col("__msg")))
    return format_conversations(met.select("conv", "pos", "m.role", "m.text")).select("conv.*", "formatted", "loss")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> messages of reply trees that are chains: each turn replies to the one
    before. Order: turn, nulls last, then role and text, nulls first; repeated rows stand side by side, each a turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return rows.select(F.col("conv_id").alias("tree_id"), "msg_id", parent.alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> format_trees() of each conversation as a chain; an empty table gives none."""
    messages = Scratch(conversations.sparkSession).put(conversation_messages(conversations))
    return format_trees(messages)


#: A conversation whose texts are made of control strings, which the query formats beside those of the table.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(-7, i, r, PROBE) for i, r in enumerate(("user", TRAINED))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def digest(formatted: DataFrame) -> DataFrame:
    """(tree_id, formatted, loss) -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all but the last
    read back from the formatted text and its mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def read(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        out = []
        for f, mask in zip(text, loss, strict=True):
            turns, trained = read_turns(f), under_mask(f, mask)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    some = formatted.select(F.col("tree_id").alias("conv_id"), read("formatted", "loss").alias("r"), F.length("formatted").cast("long").alias("formatted_chars"))
    return some.select("conv_id", "r.n_turns", "r.turns_sha256", "r.loss_chars", "r.loss_sha256", "formatted_chars")


_MARKS = "|".join(re.escape(c[1:]).replace("'", "''") for c in CONTROL)
ORACLE = rf"""
with c as (
  select conv_id, turn, role, text from conversations union all
  select -7, 0, 'user', '{PROBE}' union all select -7, 1, '{TRAINED}', '{PROBE}'
), t as (
  select conv_id, turn, role as r0, text as t0, coalesce(role, '') as role, coalesce(text, '') as text from c
), p as (
  select *, len(role) + len(text) + {len(OPEN) + len(BREAK) + len(CLOSE)}
    + len(regexp_extract_all(role || ' ' || text, '[<\[]\\*(?:{_MARKS})')) as n from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, r0 nulls first, t0 nulls first)) as turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = '{TRAINED}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, r0 nulls first, t0 nulls first) filter (role = '{TRAINED}'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from p group by conv_id
"""
