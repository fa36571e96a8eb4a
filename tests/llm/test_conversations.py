import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import conversations as chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", "a", "<\\s>", "[/\\\\INST]", "é", ""]


def rendered(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, role string, text string")
    return [r.m for r in df.orderBy("i").select(chat.formatted(F.col("role"), F.col("text")).alias("m")).collect()]


def test_template_is_reversible(spark):
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))
    rows = [(rnd.choice(["user", "assistant", "system", make(3)]), make(9)) for _ in range(400)] + [(None, None), ("assistant", None)]
    for (role, text), message in zip(rows, rendered(spark, rows), strict=True):
        [(got_role, got_text, low, high)] = chat.read_back(message)
        assert (got_role, got_text) == (role or "", text or "")
        assert (high > low) == (role == "assistant" and bool(text))
    whole = "".join(rendered(spark, rows))
    assert [(r, t) for r, t, _, _ in chat.read_back(whole)] == [(r or "", t or "") for r, t in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES)))
def test_control_strings_never_stay(parts):
    import re

    text = "".join(parts)
    out = re.sub(chat._CONTROL, r"\1\\\2\3", text)
    assert not re.search(r"</?s>|\[/?INST\]", out)
    assert re.sub(chat._ESCAPED, r"\1\2\3", out) == text


def paths_of(nodes):
    by, kids = {n[1]: n for n in nodes}, {}
    for n in nodes:
        kids.setdefault(n[2] if n[2] in by else None, []).append(n[1])
    found = []

    def walk(node, path):
        path = [*path, node]
        if node not in kids:
            found.append(path)
        for k in kids.get(node, ()):
            walk(k, path)

    for root in kids.get(None, ()):
        walk(root, [])
    return found, by


def test_branches_against_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for conv in (1, 2, None):
        for i in range(60):
            parent = None if i == 0 or rnd.random() < 0.05 else (i - 1 if rnd.random() < 0.7 else rnd.randrange(i))
            rows.append((conv, i, parent, rnd.choice(["user", "assistant"]), f"m{i}", float(rnd.randint(-5, 5))))
    rows.append((1, 500, 499, "user", "orphan", 0.0))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv long, node long, parent long, role string, text string, score double, leaf string")
    got = chat.format_branches(df.drop("leaf"), top=3).collect()
    for conv in (1, 2, None):
        paths, by = paths_of([r for r in rows if r[0] == conv])
        best = sorted(paths, key=lambda p: (-sum(by[n][5] for n in p), p[-1]))[:3]
        mine = sorted((r for r in got if r.conv == conv), key=lambda r: r["rank"])
        assert [r.leaf for r in mine] == [p[-1] for p in best]
        for r, p in zip(mine, best, strict=True):
            assert [t for _, t, _, _ in chat.read_back(r.conversation)] == [by[n][4] for n in p]


def test_long_and_tied_conversations(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(700)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, None, None, None), (2, 0, "user", "a")]
    got = {r.conv: r.conversation for r in chat.format_branches(chat.linear_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t for _, t, _, _ in chat.read_back(got[1])] == [f"t{i}" for i in range(700)]
    assert [t for _, t, _, _ in chat.read_back(got[2])] == ["", "a", "a", "b"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_branches(chat.linear_trees(none)).collect() == []


def test_circles_and_repeated_messages(spark):
    kinds = "conv long, node long, parent long, role string, text string, score double"
    rows = [
        (1, 5, 5, "user", "self", 1.0),
        (2, 1, 3, "user", "a", 1.0), (2, 2, 1, "assistant", "b", 1.0), (2, 3, 2, "user", "c", 1.0),
        (3, 4, 6, "user", "a", 1.0), (3, 6, 4, "assistant", "b", 1.0), (3, 7, 6, "user", "leaf", 2.0), (3, 9, 7, "assistant", "below", 1.0), (3, 8, 4, "assistant", "other", 1.0),
        (4, 1, None, "user", "x", 0.0), (4, 1, None, "user", "x", 0.0), (4, 2, 1, "assistant", "y", 0.0), (4, 2, 1, "assistant", "z", 0.0), (4, None, 1, "user", "no node", 0.0),
        (None, 8, 2, "user", "orphan", 0.0), (None, 3, 8, "assistant", "reply", 0.0),
    ]
    got = {}
    for r in chat.branches(spark.createDataFrame(rows, kinds).repartition(3)).orderBy("depth").collect():
        got.setdefault((r.conv, r.leaf), []).append(r.text)
    # The smallest message of a circle becomes its root.
    assert got == {
        (1, 5): ["self"], (2, 3): ["a", "b", "c"], (3, 9): ["a", "b", "leaf", "below"], (3, 8): ["a", "other"], (4, 2): ["x", "y"], (None, 3): ["orphan", "reply"],
    }
