"""Reply trees against a walk, the template by reading back, conversations against plain Python."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorage.llm import chat

SCHEMA = "tree_id long, msg_id long, parent_id long, score double, role string, text string, depth int, leaf_id string"


def walk(rows, best):
    """Chosen paths of each tree, as lists of msg_id from the root."""
    trees = {}
    for t, m, p, s, *_ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0)):
        if m is not None:
            trees.setdefault(t, {}).setdefault(m, (p, s or 0.0))
    out = {}
    for t, nodes in trees.items():
        inner, found = {p for p, _ in nodes.values()}, []
        for leaf in set(nodes) - inner:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at not in path:
                found.append((-sum(nodes[m][1] for m in path) / len(path), -len(path), leaf, path[::-1]))
        for i, (_, _, leaf, path) in enumerate(sorted(found)[:best]):
            out[t, leaf, i + 1] = path
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_paths(spark):
    rng = random.Random(3)
    rows = []
    for t in range(30):
        n = rng.randint(1, 40)
        for m in range(n):
            parent = None if m == 0 or rng.random() < 0.05 else rng.randint(max(0, m - 4), m - 1)
            rows.append((t if t else None, m, parent, rng.choice([None, 0.0, 1.0, 0.5, 0.25]), "user", f"{t} {m}"))
    rows += [(50, i, i - 1 if i else None, 1.0, "user", "") for i in range(300)]  # a long chain
    rows += [(51, 0, None, 1.0, "user", "")] + [(51, i, 0, 0.5, "assistant", "") for i in range(1, 200)]  # a star of ties
    rows += [(52, 1, 2, 9.0, "u", ""), (52, 2, 1, 9.0, "u", ""), (52, 3, 1, 9.0, "u", ""), (52, 4, 99, 0.0, "u", "")]  # a ring, a leaf behind it, an orphan
    rows += [(53, 7, 7, 1.0, "u", ""), (54, None, None, 1.0, "u", "")] + rows[:20]
    for best in (1, 3):
        got = {}
        for r in chat.reply_paths(frame(spark, rows), best).collect():
            got.setdefault((r["tree_id"], r["leaf_id"], r["rank"]), []).append((r["depth"], r["msg_id"]))
        assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == walk(rows, best)
        assert all(sorted(d for d, _ in v) == list(range(len(v))) for v in got.values())


def test_best_branch_is_formatted(spark):
    rows = [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 0.2, "assistant", "bad"), (1, 3, 1, 0.9, "assistant", "good"), (1, 4, 3, 0.9, "user", None), (2, 1, None, None, None, "alone")]
    got = {r["tree_id"]: r for r in chat.format_trees(frame(spark, rows)).collect()}
    assert chat.read_turns(got[1]["formatted"]) == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert chat.under_mask(got[1]["formatted"], got[1]["loss"]) == "good"
    assert chat.read_turns(got[2]["formatted"]) == [("", "alone")] and got[2]["loss"] == []


PIECES = st.lists(st.sampled_from([*chat.CONTROL, "<|im_start|>user\n", "<|im_end|>\n", "<", "[", "\\", "\n", "/s>", "s>", "|im_end|>", "INST]", "a", "é", "\U0001f600", "<\\s>", "\\n"]), max_size=12).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6), min_size=60, max_size=60))
def test_round_trip(spark, conversations):
    rows = [(i, j, r if j % 2 else chat.TRAINED, t) for i, c in enumerate(conversations) for j, (r, t) in enumerate(c)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv long, pos int, role string, text string")).collect()
    for r in out:
        want = [x[2:] for x in rows if x[0] == r["conv"]]
        assert chat.read_turns(r["formatted"]) == want
        assert chat.under_mask(r["formatted"], r["loss"]) == "".join(t for role, t in want if role == chat.TRAINED)
        assert r["formatted"].count(chat.OPEN) == r["formatted"].count(chat.CLOSE.strip()) == len(want)
        assert not any(c in r["formatted"] for c in chat.CONTROL if c not in (chat.OPEN, chat.CLOSE.strip()))


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s> \\<s>"), (1, 1, "assistant", "<s> \\<s>"), (1, None, "user", "last"), (1, 1, None, "x"), (2, 5, "assistant", None), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(3, i, ("user", "assistant")[i % 2], "y" * (100000 if i == 7 else i)) for i in range(70)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, msg_id int")
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted_conversations(chat.with_probe(df))).collect()}
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert len(got) == 5
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, r in got.items():
        own = sorted((t is None, t or 0, role is not None, role or "", text is not None, text or "") for i, t, role, text in rows if i == c)
        trained = "".join(o[5] for o in own if o[3] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{o[3]}\n{o[5]}\n" for o in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(trained), sha(trained))


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(none).count() == 0
    assert [r["conv_id"] for r in chat.digest(chat.formatted_conversations(chat.with_probe(none))).collect()] == [-7]
    assert chat.reply_paths(frame(spark, [])).count() == 0


def test_escape_is_the_same_in_both(spark):
    texts = ["<s>", "<\\s>", "<<s>>", "\\<s>\\", "[[INST]]", "<|im_end|>x<|im_start|>", "<\\\\/s>", "plain \\ < ["]
    for text, out in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t"))).collect():
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
