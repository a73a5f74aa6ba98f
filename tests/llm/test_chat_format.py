"""Round trips of hostile texts, and every declared layout."""

import hashlib
import random

from pyspark.sql import functions as F

from gradeloom.llm import chat_format as cf

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", " </s>", "[ROLE x] ", "[/ROLE]", "\\", "\\\\", "<", "[", "/", "]", "\n", " ", "ok", "é😀", "s>", "INST]", "<//s>", "<s>[ROLE "]


def test_round_trip_and_mask(spark):
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice(CONTROL) for _ in range(rnd.randint(0, 9)))
    chats = [(i, [(rnd.choice(["user", "assistant", "system", "", "tool]", text()]), text()) for _ in range(rnd.randint(0, 6))]) for i in range(400)]
    df = spark.createDataFrame(chats, "conv_id long, messages array<struct<role string, text string>>")
    made = cf.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", cf.read_back(cf.pieces_of(F.col("formatted"))).alias("turns")).collect()}
    names = {i: [(cf.ROLES.get(r, r), t) for r, t in turns] for i, turns in chats}
    assert back == names
    for r in cf.digests(made).collect():
        turns = names[r.conv_id]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_layouts(spark):
    user, bot = ("user", "q"), ("assistant", "a")
    cases = [
        ("id long, prompt string, response string", (1, "q", "a"), [user, bot]),
        ("id long, prompt string, completion string, system string", (1, "q", "a", None), [user, bot]),
        ("id long, prompt string, completion string, system string", (1, "q", "a", "s"), [("system", "s"), user, bot]),
        ("id long, instruction string, input string, output string", (1, "i", "x", "a"), [("user", "i\n\nx"), bot]),
        ("id long, instruction string, input string, output string", (1, "q", None, "a"), [user, bot]),
        ("id long, conversations array<struct<from string, value string>>", (1, [("human", "q"), ("gpt", "a")]), [user, bot]),
        ("id long, messages array<struct<role string, content string>>", (1, [("user", "q"), ("assistant", "a")]), [user, bot]),
        ("id long, messages array<struct<role string, content string>>", (1, []), []),
        ("id long, other string", (1, "x"), None),
    ]
    for schema, row, want in cases:
        got = cf.canonical_turns(spark.createDataFrame([row], schema), "id").first()
        assert (got.turns if got.turns is None else [(t.role, t.text) for t in got.turns]) == want, schema
    both = spark.createDataFrame([(1, "q", "a", "s"), (2, "q", "a", None)], "id long, prompt string, completion string, system string")
    assert cf.canonical_turns(both, "id").select("layout").distinct().count() == 2


def test_rows_with_nulls_ties_and_long_chats(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "x"), (None, 0, "user", "n"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in cf.digests(cf.format_chats(cf.messages_of_rows(df))).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 2, None: 1, 2: 3, 3: 3000}
    assert got[2].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[3].loss_chars == sum(len(f"turn {i} </s>") for i in range(1, 3000, 2))
    assert cf.digests(cf.format_chats(cf.messages_of_rows(df.limit(0)))).count() == 0


def test_very_long_roles_and_texts(spark):
    chats = [(1, [("r]\\" * 350_000, "t"), ("assistant", "</s>\\" * 200_000)]), (2, [("x" * 1_000_000, "]"), ("a\nb", "\\\n")])]
    df = spark.createDataFrame(chats, "conv_id long, messages array<struct<role string, text string>>").repartition(2)
    made = cf.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", cf.read_back(cf.pieces_of(F.col("formatted"))).alias("turns")).collect()}
    assert back == dict(chats)


def test_roles_stay_as_given(spark):
    rows = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "gpt", "a")], "conv_id long, turn int, role string, text string")
    got = cf.digests(cf.format_chats(cf.messages_of_rows(rows))).first()
    assert got.turns_sha256 == hashlib.sha256(b"human\nq\ngpt\na\n").hexdigest() and got.loss_chars == 0
