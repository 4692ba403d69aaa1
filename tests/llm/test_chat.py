import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.llm.chat import END, TEXT, TURN, escape, format_trees, op8_chat, read_turns, unescape

PIECES = ["<", "|", "turn", "<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\\:", ":", "a", "\n", "é🎈", "$1"]


def test_escapes_are_reversible(spark):
    texts = []

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
    def gather(text):
        texts.append(text)

    gather()
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string").withColumn("e", escape(F.col("t")))
    for r in df.withColumn("u", unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        for mark in (TURN, TEXT, END, "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|"):
            assert mark not in r["e"]


def trees(spark):
    rows = [
        # tree, node, parent, role, text, score: two branches, a deeper one, an orphan, a cycle
        ("t", 1, None, "user", "hi", 1.0),
        ("t", 2, 1, "assistant", "one", 0.0),
        ("t", 3, 1, "assistant", "two <|end|>", 1.0),
        ("t", 4, 3, "user", None, 1.0),
        ("t", 5, 4, "assistant", "three", 1.0),
        ("t", 6, 99, "user", "orphan", None),
        ("t", 7, 8, "user", "cycle", 9.0),
        ("t", 8, 7, "user", "cycle", 9.0),
        ("t", 9, 9, "user", "own", 9.0),
        (None, 1, None, None, "no tree", 1.0),
    ]
    return spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double")


def test_paths_ranks_and_masks(spark):
    got = format_trees(trees(spark), score="score").withColumn("turns", read_turns(F.col("formatted")))
    by = {(r["tree"], r["leaf"]): r for r in got.collect()}
    assert set(by) == {("t", 2), ("t", 5), ("t", 6), (None, 1)}
    turns = [(t["role"], t["text"]) for t in by["t", 5]["turns"]]
    assert turns == [("user", "hi"), ("assistant", "two <|end|>"), ("user", ""), ("assistant", "three")]
    assert [by["t", k]["rank"] for k in (5, 2, 6)] == [1, 2, 3] and by["t", 2]["score"] == 0.5
    r = by["t", 5]
    masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["spans"]]
    assert masked[1] == "three" and masked[0].replace("\\:", "") == "two <|end|>"
    assert [(t["role"], t["text"]) for t in by[None, 1]["turns"]] == [("", "no tree")]
    best = format_trees(trees(spark), score="score", branches=1).collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {("t", 5), (None, 1)}
    assert format_trees(trees(spark).limit(0)).count() == 0


def test_long_path(spark):
    rows = [("t", i, i - 1, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 71)]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string")
    (row,) = format_trees(df).withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert [t["text"] for t in row["turns"]] == [f"m{i}" for i in range(1, 71)] and row["n_turns"] == 70


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b\n\\:"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None),
        (None, 3, None, "x"), (4, None, "assistant", ""), (4, 1, "assistant", "[INST]"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({"tree": F.lit(1), "node": F.lit(1), "parent": F.lit(None).cast("int"), "leaf": F.lit(0)})
    got = {r["conv_id"]: r for r in op8_chat(df).collect()}
    case = "</s>[INST] ok [/INST]"
    want = {
        1: ["user\na\n", "assistant\nb\n\\:\n"], 2: ["user\n\n"] * 2, None: ["\nx\n"],
        4: ["assistant\n\n", "assistant\n[INST]\n"], -1: [f"user\n{case}\n", f"assistant\n{case}\n"],
    }
    loss = {1: "b\n\\:", 2: "", None: "", 4: "[INST]", -1: case}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss[conv]), hashlib.sha256(loss[conv].encode()).hexdigest())
    assert op8_chat(df.limit(0)).count() == 1
