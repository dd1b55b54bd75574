import hashlib
import random

import pytest
from pyspark.sql import functions as F
from scoreloom.llm import chat

ROWS = "conv_id long, turn int, role string, text string"


def read_back(df):
    found = chat.formatted(df, "conv_id", "turn", "role", chat.text_part(F.col("text")))
    return found.select("conv_id", "formatted", "turns", chat.turns(F.col("formatted")).alias("read"), chat.learned_texts(F.col("formatted"), F.col("turns")).alias("learned"))


def test_any_text_comes_back(rows_of):
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "\\\\", "\n", "<", "|>", "[", "é", "🙂", " ", "a", "<|", "assistant"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "".join(rng.choices(bits, k=3))])
            rows.append((conv, turn, role, "".join(rng.choices(bits, k=rng.randrange(12)))))
    got = {r["conv_id"]: r for r in read_back(rows_of(rows, ROWS)).collect()}
    for conv in range(60):
        mine = sorted(r for r in rows if r[0] == conv)
        assert [(t["role"], t["content"]) for t in got[conv]["read"]] == [r[2:] for r in mine]
        assert [t for t in got[conv]["learned"]] == [r[3] for r in mine if r[2] == "assistant" and r[3]]
        assert len(got[conv]["formatted"]) == len(chat.BEGIN) + sum(t["chars"] for t in got[conv]["turns"])
        assert got[conv]["formatted"].count("\n" + chat.TURN) == len(mine)


def test_no_control_string_stands_bare_in_a_text(spark):
    text = "".join(chat.CONTROL) + "\\</s>"
    made = spark.range(1).select(chat.escaped(F.lit(text)).alias("e"), chat.unescaped(chat.escaped(F.lit(text))).alias("u")).first()
    assert made["u"] == text
    assert made["e"] == "".join("\\" + c for c in chat.CONTROL) + "\\\\</s>"


def test_parts_become_placeholders_and_attachments(spark):
    part = lambda kind, text=None, ref=None, **m: (kind, text, ref, m.get("width"), m.get("height"), m.get("seconds"), m.get("pages"))
    parts = [
        part("text", "see <|image|> "),
        part("image", ref="a.png", width=29, height=56),
        part("audio", ref="b.wav", seconds=1.01),
        part("text", " and "),
        part("document", "not shown", "c.pdf", pages=3),
        part("image"),
        part("sketch", "of another type"),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (1, 2, None, None)], "id int, at int, role string, parts " + f"array<{chat.PART.simpleString()}>")
    row = chat.formatted(df, "id", "at", "role", F.col("parts")).first()
    first = row["turns"][0]
    content = "see \\<|image|> <|image|><|audio|> and <|document|><|image|>of another type"
    turn = "\n<|turn|>user\n<|text|>" + content + "\n<|end|>"
    assert row["formatted"] == chat.BEGIN + turn + "\n<|turn|>assistant\n<|text|>\n<|end|>\n<|turn|>\n<|text|>\n<|end|>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 26), ("document", "c.pdf", 768), ("image", None, 1)]
    assert [turn[a["at"] :].startswith(chat.PLACEHOLDERS[a["type"]]) for a in first["attachments"]] == [True] * 4
    assert (first["attached_tokens"], first["loss_chars"], first["chars"]) == (799, 0, len(turn))
    assert [(t["loss_chars"], t["attachments"]) for t in row["turns"][1:]] == [(0, []), (0, [])]


def test_cases(rows_of):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, "assistant", "y"), (1, 0, "assistant", "y"), (None, 3, "user", "z"), (2, 1, "assistant", "w" * 300_000)]
    got = {r["conv_id"]: r for r in read_back(rows_of([(*r, "clash") for r in rows], ROWS + ", formatted string")).collect()}
    assert [(t["role"], t["content"]) for t in got[1]["read"]] == [("user", ""), ("", "x"), ("assistant", "y"), ("assistant", "y")]
    assert got[1]["learned"] == ["y", "y"]
    assert [(t["role"], t["content"]) for t in got[None]["read"]] == [("user", "z")]
    assert got[2]["learned"] == ["w" * 300_000]


def test_empty_table(rows_of):
    assert read_back(rows_of([], ROWS)).collect() == []


@pytest.mark.parametrize("text", ["\\" * 200_000, "\\" * 200_000 + "</s>", "</s>" * 50_000])
def test_long_runs(spark, text):
    made = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).first()
    assert made["u"] == text and len(made["e"]) == len(text) + text.count("</s>")


def test_query_by_brute_force(spark, small):
    from scoreloom.llm import queries as Q

    table = spark.read.parquet(f"{small}/conversations.parquet").collect()
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in table] + [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for conv in sorted({r[0] for r in rows}):
        mine = sorted(r for r in rows if r[0] == conv)
        learned = "".join(t for _, _, r, t in mine if r == "assistant")
        expected.append((conv, len(mine), digest("".join(f"{r}\n{t}\n" for _, _, r, t in mine)), len(learned), digest(learned)))
    got = Q.op12_chat(spark, small).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()
    assert sorted(map(tuple, got)) == expected
