"""Chat formatting at token level.

Each turn becomes ``START role MESSAGE text END``. The three marks are ids
above the vocabulary, so no text can produce them; role and text are encoded
apart and spliced in between. In the rendering as text the marks are control
strings; such strings inside a role or text (ours and those of other
templates) get a backslash after their first character, one more if they have
some already, which reading back takes away again.

1. Every turn is escaped and encoded where it is read, so a conversation that
   holds a large share of all rows is encoded by many tasks.
2. Turns are brought together by conversation and sorted (turn, then role and
   text for ties); a task streams over them and splices ids, one row for each
   conversation, or one for about every CHUNK_TOKENS ids of a longer one, so
   no conversation is held in memory whole.
3. The loss mask is the prefix sum of +1 at each assistant text's first id and
   -1 behind its last.

Null texts and roles count as empty (an empty assistant text has no id under
the mask), turns that repeat are all kept, rows without a conv_id form one
conversation, a turn of any length is encoded in pieces and spliced whole
(one turn's ids are held at a time), further columns are ignored, and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import bpe
from tidelake.llm.common import prepare

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Tails of the control strings to escape, each behind ``<`` or ``[``: any <|name|>, and <s> </s> [INST] [/INST].
_TAIL = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])"
_BARE = regex.compile(r"([<\[])(\\*)" + _TAIL)
_ESCAPED = regex.compile(r"([<\[])\\(\\*)" + _TAIL)
LEARNED_ROLE = "assistant"
CHUNK_TOKENS = 1 << 16


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _base(path: str) -> int:
    """The first reserved id: START; MESSAGE and END follow."""
    return len(bpe.shared(("bytes", path), lambda: bpe.byte_pieces(path)))


def splice(turns: list[tuple[bytes, bytes, bool]], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of turns given as (role ids, text ids, learned)."""
    mark = [np.array([base + k], "<u4") for k in range(3)]
    parts, learned = [], []
    for role, text, learn in turns:
        parts += [mark[0], np.frombuffer(role, "<u4"), mark[1], np.frombuffer(text, "<u4"), mark[2]]
        learned += [0, 0, 0, int(learn), 0]
    ends = np.cumsum([len(p) for p in parts])
    step = np.zeros(ends[-1] + 1, np.int64)
    lengths, flag = np.array([len(p) for p in parts]), np.array(learned)
    np.add.at(step, ends - lengths, flag)
    np.add.at(step, ends, -flag)
    return np.concatenate(parts).astype(np.int32), np.cumsum(step[:-1]).astype(np.int8)


def format_conversations(turns: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """conv_id, chunk (from 0), n_turns, ids and loss_mask; a conversation's chunks
    follow each other in one partition."""
    prepare(turns.sparkSession)

    def encode(batches):
        coder = bpe.shared(("chat", path), lambda: bpe.Coder(path, split_special=False))
        for batch in batches:
            columns = {n: [coder.ids(escape(t or "")) for t in batch.column(n).to_pylist()] for n in ("role", "text")}
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "turn": batch.column("turn"),
                "role": pa.array(columns["role"], pa.binary()), "text": pa.array(columns["text"], pa.binary()),
                "learned": pa.array([r == LEARNED_ROLE for r in batch.column("role").to_pylist()], pa.bool_())})

    def assemble(batches):
        base, now, chunk, held, size, id_type = _base(path), None, 0, [], 0, None
        done: list = []

        def flush():
            ids, mask = splice(held, base)
            done.append((now, chunk, len(held), ids, mask))
            held.clear()

        def rows():
            out = pa.RecordBatch.from_pydict({
                "conv_id": pa.array([r[0] for r in done], id_type), "chunk": pa.array([r[1] for r in done], pa.int64()),
                "n_turns": pa.array([r[2] for r in done], pa.int64()), "ids": pa.array([r[3] for r in done], pa.list_(pa.int32())),
                "loss_mask": pa.array([r[4] for r in done], pa.list_(pa.int8()))})
            done.clear()
            return out

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, role, text, learned in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "learned")), strict=True):
                if held and (conv != now or size >= CHUNK_TOKENS):
                    flush()
                    chunk, size = (chunk + 1 if conv == now else 0), 0
                elif not held:
                    chunk = 0
                now = conv
                held.append((role, text, learned))
                size += (len(role) + len(text)) // 4 + 3
            if len(done) >= 256 or sum(len(r[3]) for r in done) >= 4 * CHUNK_TOKENS:
                yield rows()
        if held:
            flush()
        if done:
            yield rows()

    kinds = dict(turns.dtypes)
    return (turns.select("conv_id", "turn", "role", "text")
            .mapInArrow(encode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role binary, text binary, learned boolean")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(assemble, f"conv_id {kinds['conv_id']}, chunk long, n_turns long, ids array<int>, loss_mask array<byte>"))


def read_back(formatted: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """What the ids and masks of ``format_conversations`` say, one row for each conversation:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Chunks of a
    conversation are expected one behind the other, as that function leaves them."""
    marks = len(START) + len(MESSAGE) + len(END)

    def run(batches):
        table = bpe.shared(("bytes", path), lambda: bpe.byte_pieces(path))
        base, id_type = len(table), None

        def text_of(ids):
            return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8")

        state: dict = {}

        def closed():
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([state["conv"]], id_type), "n_turns": pa.array([state["turns"]], pa.int64()),
                "turns_sha256": [state["all"].hexdigest()], "loss_chars": pa.array([state["chars"]], pa.int64()),
                "loss_sha256": [state["loss"].hexdigest()], "formatted_chars": pa.array([state["formatted"]], pa.int64())})

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            lists, masks = batch.column("ids"), batch.column("loss_mask")
            for k, (conv, chunk) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist(), strict=True)):
                if chunk == 0:
                    if state:
                        yield closed()
                    state = {"conv": conv, "turns": 0, "chars": 0, "formatted": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                ids = lists[k].values.to_numpy(zero_copy_only=False)
                mask = masks[k].values.to_numpy(zero_copy_only=False)
                starts, messages, ends = (np.flatnonzero(ids == base + m) for m in range(3))
                for s, m, e in zip(starts, messages, ends, strict=True):
                    role, text = text_of(ids[s + 1:m]), text_of(ids[m + 1:e])
                    state["formatted"] += marks + len(role) + len(text)
                    state["all"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state["turns"] += len(starts)
                edges = np.diff(np.concatenate([[0], mask, [0]]))
                for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                    learned = unescape(text_of(ids[a:b]))
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
        if state:
            yield closed()

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")


def render(ids: np.ndarray, path: str = bpe.VOCABULARY) -> str:
    """Formatted ids as text, marks as control strings."""
    table = bpe.shared(("bytes", path), lambda: bpe.byte_pieces(path))
    marks = [m.encode() for m in (START, MESSAGE, END)]
    return b"".join(table[i] if i < len(table) else marks[i - len(table)] for i in np.asarray(ids).tolist()).decode("utf-8")
