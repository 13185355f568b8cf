import hashlib

import numpy as np
import pytest

from tidelake.llm import chat, queries


def brute(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars from the turns themselves."""
    all_, loss = hashlib.sha256(), ""
    for role, text in turns:
        all_.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    marks = len("<|start|><|message|><|end|>")
    chars = sum(marks + len(chat.escape(r or "")) + len(chat.escape(t or "")) for r, t in turns)
    return len(turns), all_.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


CASES = {
    1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    2: [("system", None), (None, "x"), ("assistant", ""), ("assistant", "second <|end|><|start|>user")],
    3: [("user", r"<\|end|> and <\\|start|> [\INST] <\s>"), ("assistant", r"keeps \ and \\ [ < ]")],
    4: [("assistant", "漢字 😀 é\n\n " * 500), ("user", "<|endoftext|><s></s>")],
    5: [("role\n<|message|>", "a\x00b"), ("assistant", "t\nt")],
    None: [("assistant", "nobody's")],
}
SCHEMA = "conv_id long, turn long, role string, text string, ids string, n_turns long"


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, k, r, t, "mine", -1) for c, own in CASES.items() for k, (r, t) in enumerate(own)]
    return spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)


@pytest.mark.parametrize("tokens", [1 << 16, 4])
def test_reads_back(turns, monkeypatch, tokens):
    monkeypatch.setattr(chat, "CHUNK_TOKENS", tokens)
    got = {r[0]: tuple(r[1:]) for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got == {c: brute(own) for c, own in CASES.items()}


def test_texts_cannot_forge_marks(turns):
    for r in chat.format_conversations(turns).collect():
        shown = chat.render(r.ids)
        assert len(r.ids) == len(r.loss_mask)
        assert shown.count(chat.START) == shown.count(chat.END) == r.n_turns
        assert not any(s in shown for s in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"))
        ids = np.array(r.ids)
        assert not np.array(r.loss_mask)[ids >= ids.max() - 2].any()


def test_escape_is_reversible():
    for text in ("", "<|x|>", r"<\|x|>", r"<\\\|x|>", "<<|end|>>", "[[INST]]", "<s<s>>", "a|>", "\\<s>"):
        assert chat.unescape(chat.escape(text)) == text
    assert chat.escape("<s>") != "<s>" and chat.escape(r"<\s>") == r"<\\s>"


def test_repeated_turns_and_no_turns(spark):
    row = (9, 0, "assistant", "same", "", 0)
    got = chat.read_back(chat.format_conversations(spark.createDataFrame([row, row], SCHEMA))).collect()
    assert tuple(got[0][1:]) == brute([("assistant", "same")] * 2) and len(got) == 1
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-7: CASES[1]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: tuple(r[1:]) for r in queries.op3_chat_format(spark, small_dir).collect()}
    assert got == {c: brute(own) for c, own in want.items()}
