"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's tokens (its ids, then the separator) are cut into full windows,
which are sequences of their own, and a rest of less than a window; the rest
is cut into parts of at most ``part`` tokens, so that windows hold several
parts and can be evened out. Parts gather in blocks of ``block`` parts; each
block is dealt into windows by differencing:

* every part starts as a partial partition of ``k`` windows, one holding the
  part and the others empty; ``k`` is the least number that could hold all;
* the two partial partitions of the largest spread (heaviest less lightest
  window) are merged, the heaviest windows of one with the lightest of the
  other, until one partition is left;
* if its heaviest window exceeds the capacity, ``k`` rises by one and the
  differencing starts again.

Windows of a block come out near-equal and near-full, so little padding is
left. Blocks are filled inside a task, as the scan deals the documents; no
row is shuffled, memory is bounded by the block, and a block's last rows in a
task form a smaller block (at most a window's padding for each task).

A sequence's id is its task's number and a counter. Rows of a scan come in the
same order when a task is repeated; write a shuffled input first, as the
pipeline does.

Null and empty texts hold the separator alone; repeated rows are documents of
their own; an empty table gives no pieces; very long texts are encoded in
pieces and become full windows and one rest.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import bpe
from tidelake.llm.common import prepare, texts

WINDOW = 1024
PART = 256
BLOCK = 4096


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal ``sizes`` into ``k`` windows by multiway differencing: each item's window and the windows' loads.

    A partial partition is kept as the loads of its windows in falling order,
    without the empty ones, and a tree node for each (leaf: an item).
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    fresh = n
    heap: list = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    if k == 1:
        return np.zeros(n, np.int64), np.array([int(sizes.sum())])
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        over = len(a) + len(b) - k  # heaviest of one meets lightest of the other: so many windows hold both
        if over <= 0:
            loads, trees = np.concatenate([a, b]), np.concatenate([at, bt])
        else:
            ids = np.arange(fresh, fresh + over)
            left[ids], right[ids] = at[len(a) - over:], bt[len(b) - over:][::-1]
            fresh += over
            loads = np.concatenate([a[:len(a) - over], a[len(a) - over:] + b[len(b) - over:][::-1], b[:len(b) - over]])
            trees = np.concatenate([at[:len(a) - over], ids, bt[:len(b) - over]])
        by = np.argsort(-loads, kind="stable")
        loads, trees = loads[by], trees[by]
        spread = int(loads[0]) - (int(loads[-1]) if len(loads) == k else 0)
        heapq.heappush(heap, (-spread, order, loads, trees))
        order += 1
    _, _, loads, trees = heap[0]
    window = np.empty(2 * n, np.int64)
    window[trees] = np.arange(len(trees))
    for t in range(fresh - 1, n - 1, -1):  # a node is made after its children
        window[left[t]] = window[right[t]] = window[t]
    return window[:n], loads


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Each item's window, with no window above ``capacity``; the number of windows rises until that holds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        dealt, loads = difference(sizes, k)
        if loads.max() <= capacity:
            return dealt
        k += 1


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, path: str = bpe.VOCABULARY, window: int = WINDOW, part: int = PART, block: int = BLOCK,
         separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ``ids``, the piece's token ids, when ``with_ids``). A sequence is filled to
    its last piece's end; the rest of the window is padding."""
    prepare(docs.sparkSession)
    end = np.asarray([separator], "<u4").tobytes()
    kind = dict(docs.dtypes)[id_col]
    names = [*_SCHEMA.names[1:], *["ids"] * with_ids]

    def run(batches):
        coder = bpe.shared(("ids", path), lambda: bpe.Coder(path))
        sequence = TaskContext.get().partitionId() << 40  # 2**40 sequences for each task
        waiting: list = []
        out: list = []

        def rows():
            batch = {"doc_id": pa.array([r[0] for r in out], id_type)}
            for c, name in enumerate(names, 1):
                values = [r[c] for r in out]
                batch[name] = pa.array([np.frombuffer(v, "<u4").astype(np.int32) for v in values], pa.list_(pa.int32())) \
                    if name == "ids" else pa.array(values, pa.int64())
            out.clear()
            return pa.RecordBatch.from_pydict(batch)

        def deal():
            nonlocal sequence
            sizes = np.array([w[2] for w in waiting], np.int64)
            dealt = windows(sizes, window)
            fill: dict[int, int] = {}
            for w, k in zip(waiting, dealt.tolist(), strict=True):
                offset = fill.get(k, 0)
                fill[k] = offset + w[2]
                out.append((*w[:5], sequence + k, offset, *w[5:]))
            sequence += int(dealt.max()) + 1
            waiting.clear()

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = memoryview(coder.ids(text) + end)
                total = len(ids) // 4
                full = total - total % window
                cuts = [*range(0, full, window), *range(full, total, part)]
                for a, b in zip(cuts, [*cuts[1:], total], strict=True):
                    own = ids[4 * a:4 * b]
                    piece = (doc, a, b - a, zlib.crc32(own), total)
                    tail = (bytes(own),) if with_ids else ()
                    if b - a == window:
                        out.append((*piece, sequence, 0, *tail))
                        sequence += 1
                    else:
                        waiting.append((*piece, *tail))
                        if len(waiting) == block:
                            deal()
            if len(out) >= 1000:
                yield rows()
        if waiting:
            deal()
        if out:
            yield rows()

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in _SCHEMA.names[1:]) + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
