"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Normalised texts are cut between two characters that no piece holds side by
side: nothing ever spans such a place. The distinct words of a batch that a
worker has not met are then encoded together, those of equal length as one
matrix:

* the hash of every substring is a difference of prefix hashes; it is looked up
  among the sorted hashes of the pieces (and the characters are compared);
* the words advance together, one character a step; among the pieces that end
  there a vectorised maximum picks the best and stores its length as
  backpointer; following the backpointers gives the ids.

What a step adds depends on the model:

* unigram models: the piece's score, the classic Viterbi;
* BPE models, whose result is no maximum of summed scores: a step is allowed
  only if merging would leave the boundary between the word's previous piece
  and this one alone. Each prefix of a word has exactly one such chain, and
  that chain is what merging gives. Whether a pair keeps its boundary follows
  from the pieces along the boundary: no two that exist at the same time may
  have a merge that comes before either is used up (ties: leftmost first).

Pieces of the space mark alone, which this kind of model gives one shared lowest
score, are merged last, leftmost first, in a linear pass of their own.
Characters that no piece holds become their UTF-8 bytes (or the unknown id).

Null texts count as empty and have no ids; repeated rows are encoded each; very
long texts are one row's work, in memory linear in their length; an empty table
gives no rows and further columns are ignored. Decoding
restores the text, but for the literal space mark U+2581 in a text, which
means a space, as in the library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import bpe
from tidelake.llm.common import prepare, texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
CACHE_WORDS = 1_000_000
#: Characters of the words that advance as one matrix.
_CELLS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.iinfo(np.int64).max


def _fields(raw: bytes) -> Iterable[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: (number, value)."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at:at + n]
            at += n


def read_model(raw: bytes) -> tuple[list[str], list[float], list[int], int]:
    """Pieces, scores, types and kind (UNIGRAM or BPE) of a model file."""
    pieces, scores, types, kind = [], [], [], UNIGRAM
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode("utf-8"))
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            types.append(own.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return pieces, scores, types, kind


class Lattice:
    """Words into ids, for the pieces of a model."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], kind: int):
        if USER_DEFINED in types:
            raise ValueError("models with user-defined pieces are not supported")
        self.kind, self.size = kind, len(pieces)
        self.unknown = types.index(UNKNOWN) if UNKNOWN in types else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == BYTE}
        own = [(p, i) for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t in (NORMAL, UNUSED)]
        self.ids = dict(own)
        self.scores = np.array([*scores, min((scores[i] for _, i in own), default=0.0) - 10.0])  # the last: a character of no piece
        # Runs of the space mark are merged by themselves, after all else.
        self.runs = {len(p): i for p, i in own if kind == BPE and set(p) == {SPACE} and len(p) > 1}
        if self.runs and max(scores[i] for i in self.runs.values()) >= min((scores[i] for p, i in own if len(p) > 1 and i not in self.runs.values()), default=0.0):
            raise ValueError("runs of the space mark must have the lowest scores")
        words = [(p, i) for p, i in own if i not in self.runs.values()]
        if self.runs and any(SPACE in p[1:] for p, _ in words):
            raise ValueError("a piece holds the space mark behind another character")
        self.longest = max((len(p) for p, _ in words), default=1)
        self._index(words)
        self._joined(own)
        if kind == BPE:
            self._merges(words)

    # -- lookup -----------------------------------------------------------

    def _index(self, words) -> None:
        chars = np.zeros((len(words), self.longest), np.uint32)
        lengths = np.array([len(p) for p, _ in words])
        for k, (p, _) in enumerate(words):
            chars[k, :len(p)] = [ord(c) for c in p]
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(self.longest + 1, _BASE)) // np.uint64(1)
            self.powers = np.concatenate([[np.uint64(1)], self.powers])
            h = np.zeros(len(words), np.uint64)
            for c in range(self.longest):
                h = np.where(c < lengths, h * _BASE + chars[:, c] + np.uint64(1), h)
        by = np.argsort(h)
        self.hashes, self.piece_ids, self.chars, self.lengths = h[by], np.array([i for _, i in words])[by], chars[by], lengths[by]
        if len(np.unique(self.hashes)) < len(words):
            raise ValueError("two pieces share a hash")
        self.likely = np.zeros(1 << 22, bool)  # slots of pieces' hashes: most other substrings end here
        self.likely[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(42)).astype(np.int64)

    def _joined(self, own) -> None:
        """A bitmap of hashed character pairs that stand side by side in some piece."""
        self.pairs = np.zeros(1 << 24, bool)
        for p, _ in own:
            if len(p) > 1:
                c = np.array([ord(x) for x in p], np.uint64)
                self.pairs[self._pair(c[:-1], c[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((a << np.uint64(21)) | b) * _BASE >> np.uint64(40)).astype(np.int64)

    def words(self, text: str) -> list[str]:
        """A normalised text cut where no piece spans."""
        if len(text) < 2:
            return [text] if text else []
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        cuts = [0, *(np.flatnonzero(~self.pairs[self._pair(c[:-1], c[1:])]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _probe(self, chars: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
        """The id of the piece at each place of each word that has ``length`` characters, or -1."""
        with np.errstate(over="ignore"):
            h = prefix[:, length:] - prefix[:, :-length] * self.powers[length]
        out = np.full(h.shape, -1, np.int64)
        row, place = np.nonzero(self.likely[self._slot(h)])
        own = h[row, place]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        found = (self.hashes[at] == own) & (self.lengths[at] == length)
        for k in range(length):
            found &= self.chars[at, k] == chars[row, place + k]
        out[row[found], place[found]] = self.piece_ids[at[found]]
        return out

    # -- merges of BPE models ---------------------------------------------

    def _merges(self, words) -> None:
        order = sorted(((p, i) for p, i in words if len(p) > 1), key=lambda w: -self.scores[w[1]])
        self.rank = np.full(self.size + 1, -1, np.int64)  # characters are there from the start
        for r, (_, i) in enumerate(order):
            self.rank[i] = r
        if len({self.scores[i] for _, i in order}) < len(order):
            raise ValueError("two pieces share a score")
        known = dict(words)
        splits = [(known[p[:k]], known[p[k:]], i, len(p)) for p, i in order for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        a, b, whole, length = (np.array(c, np.int64) for c in zip(*splits, strict=True)) if splits else (np.zeros(0, np.int64),) * 4
        keys = a * (self.size + 1) + b
        by = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[by], self.rank[whole[by]]
        self.likely_merges = np.zeros(1 << 22, bool)
        self.likely_merges[self._slot(keys.astype(np.uint64))] = True
        # Pieces along the left and the right edge, from the whole piece down to a character.
        self.left = np.full((self.size + 1, self.longest), -1, np.int64)
        self.right = self.left.copy()
        self.left[:, 0] = self.right[:, 0] = np.arange(self.size + 1)
        self.reached = self.rank < 0
        self.met_pairs, self.met_keeps = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        for n in range(2, self.longest + 1):
            at = np.flatnonzero((length == n) & self.reached[a] & self.reached[b])
            at = at[self._keeps(a[at], b[at], self.rank[whole[at]])]
            self.reached[whole[at]] = True
            self.left[whole[at], 1:], self.right[whole[at], 1:] = self.left[a[at], :-1], self.right[b[at], :-1]

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which two neighbours merge, _NEVER for most."""
        out = np.full(len(a), _NEVER)
        key = a * (self.size + 1) + b
        at = np.flatnonzero(self.likely_merges[self._slot(key.view(np.uint64))])
        if len(at) and len(self.merge_keys):
            own = key[at]
            found = np.minimum(np.searchsorted(self.merge_keys, own), len(self.merge_keys) - 1)
            out[at] = np.where(self.merge_keys[found] == own, self.merge_ranks[found], _NEVER)
        return out

    def _keeps(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether merges before ``limit`` leave the boundary between pieces a and b alone."""
        keeps = np.ones(len(a), bool)
        limit = np.broadcast_to(limit, len(a))
        for i in range(self.longest):
            live = np.flatnonzero(keeps & (self.right[a, i] >= 0))
            if not len(live):
                break
            for j in range(self.longest):
                live = live[self.left[b[live], j] >= 0]
                if not len(live):
                    break
                x, y = self.right[a[live], i], self.left[b[live], j]
                merge = self._merge_rank(x, y)
                at = np.flatnonzero(merge != _NEVER)  # few neighbours merge at all
                if not len(at):
                    continue
                own, merge = live[at], merge[at]
                x_used = self.rank[self.right[a[own], i - 1]] if i else limit[own]
                y_used = self.rank[self.left[b[own], j - 1]] if j else limit[own]
                together = np.maximum(self.rank[x[at]], self.rank[y[at]]) < np.minimum(x_used, y_used)
                keeps[own[together & (merge < x_used) & ((merge <= y_used) if j else (merge < y_used))]] = False
                live = live[keeps[live]]
        return keeps

    def _boundary(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_keeps`` without a limit, remembered by pair in a table of fixed size."""
        key = a * (self.size + 1) + b
        slot = self._slot(key.view(np.uint64)) >> 2
        out = self.met_keeps[slot]
        new = np.flatnonzero(self.met_pairs[slot] != key)
        if len(new):
            out[new] = self._keeps(a[new], b[new])
            self.met_pairs[slot[new]], self.met_keeps[slot[new]] = key[new], out[new]
        return out

    # -- encoding ---------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as int32 bytes; words of equal length advance together."""
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for length, own in groups.items():
            step = max(1, _CELLS // length)
            for k in range(0, len(own), step):
                out.update(zip(own[k:k + step], self._viterbi(own[k:k + step], length), strict=True))
        return out

    def _viterbi(self, words: list[str], length: int) -> list[bytes]:
        n = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        prefix = np.zeros((n, length + 1), np.uint64)
        with np.errstate(over="ignore"):
            for c in range(length):
                prefix[:, c + 1] = prefix[:, c] * _BASE + chars[:, c] + np.uint64(1)
        most = min(self.longest, length)
        found = [self._probe(chars, prefix, m) for m in range(1, most + 1)]
        found[0] = np.where(found[0] < 0, self.size, found[0])
        if self.kind == BPE:
            found = [np.where((f >= 0) & self.reached[f], f, -1) for f in found]
        score = np.zeros((n, length + 1))
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, length + 1):
            reach = min(most, end)
            ids = np.stack([found[m - 1][:, end - m] for m in range(1, reach + 1)], axis=1)
            before = np.arange(end - 1, end - 1 - reach, -1)
            if self.kind == BPE:
                # Every prefix has one allowed piece, so the single character is it if no longer one is.
                total = np.where(ids >= 0, 1.0, -np.inf)
                total[:, 0] = 0.0
                at, m = np.nonzero((ids >= 0) & (before > 0)[None])
                at, m = at[m > 0], m[m > 0]
                keeps = self._boundary(last[at, before[m]], ids[at, m])
                total[at[~keeps], m[~keeps]] = -np.inf
            else:
                total = np.where(ids >= 0, score[:, before] + self.scores[ids], -np.inf)
            best = total.argmax(1)
            score[:, end] = total[rows, best]
            last[:, end] = ids[rows, best]
            back[:, end] = best + 1
        # Follow the backpointers of all words at once, filling ids from the right.
        ids, used, at = np.zeros((n, length), np.int32), np.zeros(n, np.int64), np.full(n, length)
        while len(live := np.flatnonzero(at)):
            used[live] += 1
            ids[live, length - used[live]] = last[live, at[live]]
            at[live] -= back[live, at[live]]
        out = [row[length - k:].tobytes() for row, k in zip(ids, used.tolist(), strict=True)]
        for row in np.flatnonzero((ids == self.size).any(1)).tolist():
            out[row] = self._with_spelling(words[row], ids[row, length - used[row]:].tolist(), back[row])
        return out

    def _with_spelling(self, word: str, ids: list[int], back: np.ndarray) -> bytes:
        """Ids of a word with characters of no piece, which become bytes (or the unknown id)."""
        spelled, at = [], len(word)
        for i in reversed(ids):
            spelled += [i] if i < self.size else self._spelled(word[at - 1])[::-1]
            at -= int(back[at])
        return np.array(spelled[::-1], np.int32).tobytes()

    def _spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unknown]

    def run(self, n: int) -> list[int]:
        """n space marks, merged leftmost first."""
        held: list[int] = []
        for _ in range(n):
            held.append(1)
            while len(held) > 1 and held[-2] + held[-1] in self.runs:
                held[-2:] = [held[-2] + held[-1]]
        return [self.runs[k] if k > 1 else self.ids[SPACE] for k in held]


class Processor:
    """Encodes batches of texts and decodes ids, as the library does for the same model."""

    def __init__(self, path: str):
        import sentencepiece

        path = bpe.vocabulary_path(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            pieces, scores, types, kind = read_model(f.read())
        self.lattice = Lattice(pieces, scores, types, kind)
        self.normalize = self.library.normalize
        self.table: dict[str, bytes] = {}
        self.surface = [p.replace(SPACE, " ").encode("utf-8") if t in (NORMAL, UNUSED) else bytes([int(p[3:5], 16)]) if t == BYTE
                        else " ⁇ ".encode() if t == UNKNOWN else b"" for p, t in zip(pieces, types, strict=True)]
        self.is_byte = [t == BYTE for t in types]
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.lengths = np.array([len(b) for b in self.surface])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.prefixed = self.normalize("a").startswith(SPACE)

    def _split(self, text: str) -> list[str]:
        return self.lattice.words(self.normalize(text)) if text else []

    def encode_batch(self, found: list[str]) -> list[np.ndarray]:
        split = [self._split(t) for t in found]
        new = set().union(*split).difference(self.table) if split else set()
        if len(self.table) + len(new) > CACHE_WORDS:
            self.table.clear()
            new = set().union(*split)
        runs = self.lattice.runs
        marked = [w for w in new if runs and w.startswith(SPACE * 2)]
        plain = new.difference(marked)
        core = {w: w.lstrip(SPACE) for w in marked}  # a run of marks; its last one goes with the word behind
        coded = self.lattice.encode_words(plain | {SPACE + c for c in core.values()})
        self.table.update((w, coded[w]) for w in plain)
        lone = np.int32(self.lattice.ids.get(SPACE, -1)).tobytes()
        for w, c in core.items():
            ids = coded[SPACE + c]
            alone = ids[:4] == lone
            marks = self.lattice.run(len(w) - len(c) - (not alone))
            self.table[w] = np.array(marks, np.int32).tobytes() + ids[4 * alone:]
        return [np.frombuffer(b"".join(map(self.table.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.asarray(ids, np.int64)
        raw = b"".join(self._bytes(ids[k:k + _CELLS]) for k in range(0, len(ids), _CELLS))
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = self._mended(ids.tolist())
        if self.prefixed and text.startswith(" "):
            first = ids[(self.lengths[ids] > 0).argmax()]
            return text if self.is_byte[first] else text[1:]  # the normaliser's prefix, unless it is a byte
        return text

    def _bytes(self, ids: np.ndarray) -> bytes:
        """The pieces' bytes one behind the other, gathered from one flat array."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()

    def _mended(self, ids: list[int]) -> str:
        """As ``decode``; bytes that make no character become U+FFFD, one for each byte."""
        out, at = [], 0
        while at < len(ids):
            end = at
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            raw = b"".join(self.surface[i] for i in ids[at:end])
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�")
                raw = raw[n:]
            if end < len(ids):
                out.append(self.surface[ids[end]].decode("utf-8"))
                end += 1
            at = end
        return "".join(out)


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) and decoded (the text that the ids give back) of each row."""
    prepare(docs.sparkSession)

    def run(batches):
        own = bpe.shared(("pieces", path), lambda: Processor(path))
        for batch in batches:
            ids = own.encode_batch(texts(batch))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array(map(own.decode, ids), pa.string())})

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, decoded string"))
