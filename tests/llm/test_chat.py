"""Chat formatting: the packed tree against conversations put together by hand."""

import hashlib

import pytest
from hypothesis import given, strategies as st

from tabsight.llm import chat, queries

from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in found.items()}


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "a", "<", "|", "</", "s>", "[", "INST]", "\n", "é"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)
    piece, start, end = chat.format_turn("user", text)
    assert piece[start:end] == escaped
    assert chat.parse(piece * 2) == [("user", text)] * 2


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "a"), (1, 3, "assistant", "one"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "b"), (2, 3, "assistant", "two"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "hello"),  # a prefix of 1 and 2
    (5, 0, "user", "hi"), (5, 1, "assistant", "hello"), (5, 2, "user", "a"), (5, 3, "assistant", "one"),  # equal to 1
    (6, 0, None, None), (6, 1, "assistant", ""),
    (7, None, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x"),
    (None, 0, "user", "no id"),
    (8, 0, "system", "long " * 20000), (8, 1, "assistant", "\\ <|end|> </s>"),
]


@pytest.fixture(scope="module")
def packed(spark):
    runs, members = chat.pack(spark.createDataFrame(ROWS, SCHEMA))
    return runs.collect(), members.collect(), chat.read_back(runs, members).collect()


def test_read_back_restores_every_conversation(packed):
    expected = by_hand(ROWS)
    got = {r["conv_id"]: r for r in packed[2]}
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        assert chat.parse(got[conv]["formatted"]) == turns
        assert [chat.unescape(x) for x in got[conv]["loss"]] == [x for r, x in turns if r == "assistant" and x]


def test_shared_turns_are_emitted_once_and_trees_are_gapless(packed):
    runs, _, _ = packed
    paths = {tuple(turns[:k + 1]) for turns in by_hand(ROWS).values() for k in range(len(turns))}
    assert sum(len(r["text"]) for r in runs) == sum(len(chat.format_turn(*p[-1])[0]) for p in paths)
    trees = {}
    for r in runs:
        trees.setdefault(bytes(r["tree"]), []).append((r["start"], r["end"], len(r["text"])))
    for spans in trees.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(e - s == n for s, e, n in spans)


def test_attention_and_positions_follow_the_path(packed):
    runs, members, _ = packed
    text = {}
    for r in sorted(runs, key=lambda r: r["start"]):
        text[bytes(r["tree"])] = text.get(bytes(r["tree"]), "") + r["text"]
    for r in runs:
        seen = "".join(text[bytes(r["tree"])][a["start"]:a["end"]] for a in r["ancestors"])
        assert r["position"] == len(seen)
        assert chat.parse(seen + r["text"]) in by_hand(ROWS).values()  # a run ends where its conversation does
        assert all(x["end"] < y["start"] for x, y in zip(r["ancestors"], r["ancestors"][1:]))
        for s in r["loss"]:
            assert r["text"][s["start"] - len(chat.TEXT):s["start"]] == chat.TEXT


def test_empty_table(spark):
    runs, members = chat.pack(spark.createDataFrame([], SCHEMA))
    assert runs.count() == 0 and members.count() == 0 and chat.read_back(runs, members).count() == 0


def test_query_digests_match_the_table(spark):
    got = {r["conv_id"]: r for r in queries.QUERIES["op1_chat_formatting"](spark, SF_SMALL).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(*SCHEMA.replace(",", "").split()[::2]).collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = by_hand(rows)
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), digest(learnt))
        assert got[conv]["formatted_chars"] == sum(len(chat.format_turn(r, x)[0]) for r, x in turns)
