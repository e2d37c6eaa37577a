import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomfactor.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text, *_ in rows if c == conv)
        )
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_conversations(df)
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == brute(rows)
    return {r.conv_id: r for r in formatted.collect()}


def test_round_trip_of_control_strings(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\\\h", "###", "</turn>\n", " </turn>\n### User: x", "\\t\\c\\h", ": ", "é😀", "####"]
    rows = [(i, j, r, x, "f", 1) for i, x in enumerate(nasty) for j, r in enumerate(("user", "assistant"))]
    rows += [(50, 0, "wei: rd###", "a", "f", 1), (50, 1, None, None, "f", 1), (50, 1, None, None, "f", 1), (50, None, "user", "", "f", 1)]
    rows += [(None, 0, "user", "no id", "f", 1), (60, 0, "assistant", "y" * 300000, "f", 1)]
    out = check(spark, rows)
    for r in out.values():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.text for s in r.segments].count(chat.Template().closing) == r.formatted.count("</turn>")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from(["user", "assistant", "=x", ": "]), st.text(alphabet="\\#h</turn> :ctE\n", max_size=14)), min_size=1, max_size=12))
def test_round_trip_of_any_text(spark, rows):
    check(spark, [(*r, "f", 1) for r in rows])


def test_machine_names_the_first_turn_out_of_order(spark):
    cases = {
        1: ("system user assistant", None), 2: ("user assistant user assistant", None), 3: ("assistant user", 0),
        4: ("user user assistant", 1), 5: ("user", 1), 6: ("user assistant tool assistant", None), 7: ("user robot assistant", 1),
    }
    rows = [(c, i, r, "x", "", 0) for c, (roles, _) in cases.items() for i, r in enumerate(roles.split())]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r.broken_at for r in chat.format_conversations(df).collect()}
    assert got == {c: bad for c, (_, bad) in cases.items()}
    assert chat.digests(chat.format_conversations(df.filter(F.lit(False)))).count() == 0
