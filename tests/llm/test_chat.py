"""Round trips of the chat template, with parts of every kind."""

import hashlib

import pytest
from hypothesis import given, strategies as st

from tablewright.llm import chat

CONTROL = st.text("<|im_start>\\n\nimage|end", max_size=40)


@given(st.lists(st.tuples(CONTROL, CONTROL | st.text(max_size=30)), max_size=6), st.integers(1, 7))
def test_round_trip(turns, size):
    text, at = "", 0
    for role, body in turns:
        made = chat.format_turn(role, [{"type": "text", "text": body}], at, chat.Expansion(), "assistant")
        assert made["start"] == at
        text, at = text + made["formatted"], at + len(made["formatted"])
    reader, back = chat.TurnReader(), []
    for i in range(0, len(text), size):
        back += reader.feed(text[i : i + size])
    reader.close()
    assert back == turns


def test_parts(spark):
    rows = [
        (1, 1, "assistant", [("text", "see <|image|>", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3),
                             None, ("text", "done", None, None, None, None, None)]),
        (1, 0, "user", [("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (2, 0, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text {chat.PART_TYPE}")
    turns = {(r.conv_id, r.turn_no): r for r in chat.format_conversations(df).collect()}
    user, reply = turns[1, 0], turns[1, 1]
    assert user.formatted == "<|im_start|>user\n<|image|><|audio|><|im_end|>\n"
    assert [tuple(a) for a in user.attachments] == [("image", "a.png", 17, 3), ("audio", "b.wav", 26, 38)]
    whole = user.formatted + reply.formatted
    assert [whole[s.start : s.end] for s in reply.loss_spans] == ["see <\\|image|>", "done"]
    assert reply.start == len(user.formatted) and reply.expanded_tokens == 768 and user.loss_spans == []
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(b"see <|image|>done").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nsee <|image|>done\n").hexdigest()
    assert (got[1].attachments, got[1].expanded_tokens, got[2].n_turns, got[2].loss_chars) == (3, 809, 1, 0)


def test_edge_rows(spark):
    rows = [(None, None, "assistant", None, 1), (3, 1, "a\nb", "x", 2), (3, 1, "a\nb", "x", 2), (3, None, "assistant", "é\\n", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert got[3].turns_sha256 == hashlib.sha256("assistant\né\\n\na\nb\nx\na\nb\nx\n".encode()).hexdigest()
    assert (got[3].loss_chars, got[None].n_turns) == (3, 1)
    assert chat.conversation_digests(chat.format_conversations(df.where("false"))).count() == 0
    bad = spark.createDataFrame([(1, 1, "u", [("video",)])], "conv_id long, turn long, role string, text array<struct<type string>>")
    with pytest.raises(Exception):
        chat.format_conversations(bad).collect()


def test_long_conversation_streams(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id % 2 + 1 as conv_id", "id as turn", "'user' as role", "concat('t', id) as text")
    got = {r.conv_id: r.turns_sha256 for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    for c in (1, 2):
        text = "".join(f"user\nt{i}\n" for i in range(n) if i % 2 + 1 == c)
        assert got[c] == hashlib.sha256(text.encode()).hexdigest()
