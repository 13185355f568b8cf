"""Byte-level BPE, pre-token by pre-token, with ids equal to the tokenizers library's.

A text is cut at the vocabulary's special strings, then by the vocabulary's
pre-token pattern; each pre-token's ids do not depend on its neighbours. To
count, a worker keeps the lengths of pre-tokens it has met in a table of
bounded size, and only encodes pre-tokens that are missing.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tidelake.llm.common import pieces

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a worker keeps besides the frequent ones, and the longest that it keeps.
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 64

#: The vocabulary's pre-token pattern in the standard library's terms, for any text and for ASCII alone.
_ANY = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

_SHARED: dict = {}


def vocabulary_path(path: str) -> str:
    """``path`` itself, or the place of a public vocabulary of that name."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def shared(key, make):
    """One object for each key and worker process, kept over tasks."""
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


class _Table(dict):
    """Frequent pre-tokens for good, others up to a bound."""

    def __init__(self, frequent: dict, value):
        super().__init__(frequent)
        self.frequent, self.value = frequent, value

    def __missing__(self, piece: str):
        got = self.value(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= len(self.frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[piece] = got
        return got


class Coder:
    """Encodes whole texts. ``split_special``: special strings in a text become
    their id (the library's default), else they are ordinary text.

    Ranks are read from the tokenizers file and merged by tiktoken, which gives
    the same ids several times faster. Its pattern, and the plain pattern that
    ``count`` cuts with, may know other versions of Unicode than the tokenizers
    library; each character is therefore tried in all of them when it is met
    first, and a piece of text with a character that any of them cuts
    differently is left to that library.
    """

    def __init__(self, path: str, frequent: dict | None = None, split_special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary_path(path))
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.tok.encode_special_tokens = True  # they are cut out before
        self.special = None
        if split_special and added:
            self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.added = added
        ranks = {b: i for i, b in enumerate(byte_pieces(path)) if i not in added.values()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = _Table(frequent or {}, lambda piece: len(self.fast.encode_ordinary(piece)))
        self.preferred = None
        self.known: set[str] = set(map(chr, range(28))) | set(map(chr, range(32, 128)))
        self.odd: set[str] = set()

    def _plain(self, text: str) -> bool:
        """Whether all ways to cut this text agree."""
        met = set(text)
        for c in met - self.known:
            probe = f"a{c}1{c}! {c} {c}"
            cut = [probe[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(probe)]
            if cut != _ANY.findall(probe) or self.fast.encode_ordinary(probe) != self._exact(probe):
                self.odd.add(c)
            self.known.add(c)
        return self.odd.isdisjoint(met)

    def _exact(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _parts(self, text: str):
        """(special id or None, piece of text) in order; no pre-token spans two pieces."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield self.added[part], part
            else:
                for piece in pieces(part):
                    yield None, piece

    def prefer(self, key: str, frequent: dict) -> None:
        """Take the frequent pre-tokens of this broadcast as first tier, once for each key."""
        if self.preferred != key:
            self.preferred, self.table = key, _Table(frequent, self.table.value)

    def count(self, text: str) -> int:
        """The number of ids, by looking up pre-tokens."""
        total = 0
        for special, piece in self._parts(text):
            if special is not None:
                total += 1
            elif self._plain(piece):
                total += sum(map(self.table.__getitem__, pretokens(piece)))
            else:
                total += len(self._exact(piece))
        return total

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(np.asarray([special] if special is not None else
                                   self.fast.encode_to_numpy(piece, disallowed_special=()) if self._plain(piece) else self._exact(piece),
                                   "<u4").tobytes() for special, piece in self._parts(text))


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text whose characters are plain."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path(path))
    # Byte-level vocabularies write a printable byte as itself and the others, in order, from U+0100.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    special = set(tok.get_added_tokens_decoder())
    return [t.encode() if i in special else bytes(byte[c] for c in t)
            for i, t in ((i, tok.id_to_token(i)) for i in range(tok.get_vocab_size()))]
