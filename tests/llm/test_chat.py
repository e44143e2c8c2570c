import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "a", "<", "s>", "|>", "é"]), max_size=12).map("".join)


@given(PIECES, PIECES)
def test_escaping_is_reversible(role, body):
    text = chat.piece(role, chat.escape(body))
    assert chat.parse(text)[:2] == (role, body)
    assert not any(c in chat.escape(body) for c in chat.CONTROL)


def test_read_back(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 2, None, None), (2, 0, "assistant", "\\<|end|>\n"),
        (2, 0, "assistant", "\\<|end|>\n"), (None, 5, "user", "x"), (3, None, "system\nx", "y" * 200_000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or -1, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    part = lambda **k: {"type": "text", "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(text="see <|image|>"), part(type="image", ref="i.png", width=28, height=29), part(type="audio", ref="a", seconds=1.5), part(type="document", ref="d", pages=2)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_turns(df).first()
    assert row["piece"] == "<|turn|>user\nsee <\\|image|><|image|><|audio|><|document|><|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "i.png", 6), ("audio", "a", 38), ("document", "d", 512)]
    assert row["loss_start"] == row["loss_end"]


def test_unknown_part():
    with pytest.raises(ValueError, match="unknown type"):
        chat.Flattener().visit(0, {"type": "video"})


def test_stored_pieces_are_read_back_in_any_order(spark, tmp_path):
    rows = [((1 << 60) + i % 50 if i % 7 else None, i // 50, "assistant" if i % 2 else "user", f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(repr, chat.read_back(chat.format_turns(df)).collect()))
    chat.format_turns(df).repartition(11).write.parquet(str(tmp_path / "pieces"))
    stored = spark.read.parquet(str(tmp_path / "pieces"))
    assert sorted(map(repr, chat.read_back(stored).collect())) == want and len(want) == len({r[0] for r in rows})
    numbers = {}
    for r in stored.collect():
        numbers.setdefault(r["conv_id"], []).append(r["position"])
    assert all(sorted(v) == [*range(len(v))] for v in numbers.values())


def test_null_parts_are_nothing(spark):
    df = spark.createDataFrame([(1, 0, "user", [None, {"type": None, "text": "a"}, {"type": "text", "text": None}])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_turns(df).first()["piece"] == "<|turn|>user\na<|end|>\n"
