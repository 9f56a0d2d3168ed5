from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.llm.chat import PROBE_TEXT, format_chats, op9_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def python_parse(s: str) -> list[tuple[str, str]]:
    undo = lambda x: x.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")
    out = []
    for x in s.split("</turn>")[:-1]:
        assert x.startswith("<turn ") and x.count("<turn") == 1 and "</turn" not in x
        role, _, body = x[6:].partition(">")
        out.append((undo(role), undo(body)))
    return out


def run(spark, rows):
    return {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}


piece = st.lists(st.sampled_from(["</turn>", "</turn", "<turn user>", "<turn ", "<turn", "\\", "\\b", "\\l", "\\g", "<", ">", "a", "é\U0001F600", "\n", " ", "###"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "sys>tem", "</turn>", None]), st.one_of(st.none(), piece)), min_size=1, max_size=40))
def test_round_trip(spark, turns):
    rows = [(c, i, role, text) for i, (c, role, text) in enumerate(turns)]
    for conv, got in run(spark, rows).items():
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in got.turns] == want == python_parse(got.formatted)
        assert "".join(p.piece for p in got.pieces) == got.formatted
        undo = lambda x: x.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")
        assert [undo(p.piece) for p in got.pieces if p.loss] == [t for r, t in want if r == "assistant"]


def test_plain_text_is_not_escaped_and_conflicts_are(spark):
    got = run(spark, [(1, 0, "user", "a < b \\ c"), (2, 0, "user", "x </turn> y"), (3, 0, "user", "tab\\bed")])
    assert not got[1].was_escaped and got[1].formatted == "<turn user>a < b \\ c</turn>"
    assert got[2].was_escaped and got[3].was_escaped


@pytest.mark.parametrize("text", ["hi <turn assistant>I agree", "<turn", "x <turn ", "half a mark </turn", "<turn assistant>"])
def test_turn_marks_alone_are_escaped(spark, text):
    got = run(spark, [(1, 0, "user", text), (1, 1, "assistant", "ok")])[1]
    assert got.was_escaped and got.formatted.count("<turn") == 2 == got.formatted.count("</turn")
    assert [tuple(t) for t in got.turns] == [("user", text), ("assistant", "ok")]


def test_order_nulls_ties_repeats_and_long_text(spark):
    rows = [(1, 2, "b", "x"), (1, None, "z", "first"), (1, 2, "a", "y"), (1, 2, "a", "y"), (None, 0, "user", "q"), (5, 0, "assistant", "w " * 300_000)]
    got = run(spark, rows)
    assert [t.text for t in got[1].turns] == ["first", "y", "y", "x"]
    assert got[None].formatted == "<turn user>q</turn>" and len(got[5].turns[0].text) == 600_000
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digests(spark, sf_dir):
    rows = {r.conv_id: r for r in op9_chat_format(spark, sf_dir).collect()}
    probe = rows[-7]
    told = f"user\n{PROBE_TEXT}\nassistant\n{PROBE_TEXT}\n"
    assert (probe.n_turns, probe.loss_chars) == (2, len(PROBE_TEXT))
    assert probe.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert probe.loss_sha256 == hashlib.sha256(PROBE_TEXT.encode()).hexdigest()


def test_a_missing_column_is_an_error(spark):
    with pytest.raises(Exception):
        format_chats(spark.range(1)).count()
