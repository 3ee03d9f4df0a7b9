import hashlib

from knotwork.llm import chat_format as c

ROW = "conv_id long, turn long, role string, text string, formatted string"


def run(spark, rows):
    return c.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], ROW))


def test_round_trip_of_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>", "a\\<|b", "\\\\", "<\\|im_start|>", "", "<s>\\", "<|im_join|><|im_sep|>", "x\ny", "<<SYS>> <</SYS>>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)]
    out = run(spark, rows)
    back = out.select(c.parse_formatted(out["formatted"]).alias("ts"), c.loss_text(out["segments"]).alias("loss")).first()
    assert [(t.role, t.text) for t in back.ts] == [(r[2], r[3]) for r in rows]
    assert back.loss == "".join(nasty[1::2])
    assert "".join(s.text for s in out.first().segments) == out.first().formatted


def test_adjacent_turns_merge_and_come_back(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "user", None)]
    out = run(spark, rows).first()
    assert out.n_merged == 3
    assert out.formatted == "<|im_start|>user<|im_sep|>a<|im_end|><|im_start|>assistant<|im_sep|>b<|im_join|>c<|im_end|><|im_start|>user<|im_sep|><|im_end|>"
    d = c.digest(run(spark, rows)).first()
    assert (d.n_turns, d.loss_chars) == (4, 2)
    assert d.turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nc\nuser\n\n").hexdigest()
    assert d.loss_sha256 == hashlib.sha256(b"bc").hexdigest()


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 0, "assistant", "y" * 300_000)]
    got = {r.conv_id: r for r in c.digest(run(spark, rows)).collect()}
    assert got[None].n_turns == 2 and got[2].n_turns == 3 and got[3].loss_chars == 300_000
    assert got[2].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert c.digest(run(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = c.digest(run(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
