import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat

ROWS = [
    (1, 0, "user", "a<|b|>c\\"), (1, 1, "assistant", "<|>\\<|</s>\n</s"), (1, 1, "assistant", None), (2, None, None, "[INST]\\[INST]\\<<SYS>>"),
    (None, 1, "x|>y", "\\\\n"), (3, 0, "system", "s"), (3, 1, "user", "<<|>"), (3, 2, "assistant", ""), (4, 1, "assistant", "first"), (5, 0, "user", "u"), (5, 0, "user", "u"),
]


def chat_unescaped(text):
    return re.sub(r"\\(\\?)", r"\1", text)


def test_very_long_text_and_many_turns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"<|{k}|>") for k in range(3000)] + [(2, 0, "user", "</s>x\\" * 200_000), (2, 1, "assistant", "y")] + [(None, 0, "user", "u")] * 500
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [x.text for x in got[1].turns] == [f"<|{k}|>" for k in range(3000)] and got[1].valid
    assert got[2].turns[0].text == "</s>x\\" * 200_000 and got[2].valid and len(got[None].turns) == 500


def test_round_trip_and_machine(spark):
    d = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, formatted int")
    rows = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    for k, r in rows.items():
        want = sorted(((t, ro or "", x or "") for c, t, ro, x in ROWS if c == k), key=lambda v: (-1 if v[0] is None else v[0], v[1], v[2]))
        assert [(x.role, x.text) for x in r.turns] == [v[1:] for v in want]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments[1::3]] == [v[1] == "assistant" for v in want] == [x.loss for x in r.turns]
        assert "".join(chat_unescaped(s.text) for s in r.segments if s.loss) == "".join(x.text for x in r.turns if x.loss)
    assert {k for k, r in rows.items() if r.valid} == {3}
    assert rows[1].problem == 2 and rows[4].problem == 0 and rows[5].problem == 1
    assert chat.format_conversations(d.where("turn > 99")).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<|>/s[]INT\\\nS ", max_size=12), min_size=1, max_size=20))
def test_escaping_is_reversible(spark, texts):
    t = chat.Template()
    d = spark.createDataFrame([(x,) for x in texts], "x string").select("x", chat.escape(F.col("x"), t).alias("e"))
    for r in d.select("x", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x and not any(c in r.e for c in t.control)


def test_hard_conversation(spark):
    r = chat.op6_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars, r.valid) == (2, len("</s>[INST] ok [/INST]"), True)
