"""Exact byte-level BPE encoding in linear time, without replaying merges text by text.

A pre-token is scanned by an Aho-Corasick automaton over the vocabulary (a trie with failure
links, bytes mapped to Latin-1 characters) which emits the leftmost-longest tokens in one
pass.  A token sequence is the BPE encoding exactly when each adjacent pair is *compatible*,
i.e. when merging the bytes of the two tokens gives these two tokens again.  Compatibility is
memoised; where a longest match is incompatible with its left neighbour the encoder
backtracks to the next shorter token, and a position found dead is never entered again, so
the work stays linear.  Whole pre-tokens are memoised too, in a bounded table.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import regex

#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: Unicode's White_Space characters, which the pattern's \\s stands for.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Every pre-token lies inside one of these chunks, so whole words can be looked up before the
#: finer pattern is tried.
CHUNKS = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

MEMO_CHARS = 6_000_000
MEMO_LONGEST = 400


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    folder = os.environ.get("MIXLOOM_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


class Encoder:
    """Encoder of one vocabulary given as ``base64-token rank`` lines."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text_of = {v: k for k, v in self.ranks.items()}
        self.length_of = {v: len(k) for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self.ids_of_piece = _Memo(self._encode_piece)
        self.ids_of_chunk = _Memo(self._encode_chunk, 60)
        self.count_of_chunk = _Memo(lambda chunk: len(self._encode_chunk(chunk)), 60)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; an empty or null text has none. Nothing is read as a special token."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.ids_of_chunk.__getitem__, CHUNKS.findall(_clean(text)))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.count_of_chunk.__getitem__, CHUNKS.findall(_clean(text))))

    def merge(self, text: str) -> list[int]:
        """Plain BPE by ranks: repeatedly merge the leftmost pair of lowest rank (short inputs)."""
        parts = list(text)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.text_of[left] + self.text_of[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        known = self._shorter.get(token)
        if known is None:
            text, known = self.text_of[token], -1
            for n in range(len(text) - 1, 0, -1):
                if (rank := self.ranks.get(text[:n])) is not None:
                    known = rank
                    break
            self._shorter[token] = known
        return known

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.ids_of_piece.__getitem__, self.split(chunk))))

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8").decode("latin-1")
        whole = self.ranks.get(raw)
        if whole is not None and self._reachable(whole):
            return (whole,)
        tokens = [token for _, token in self.automaton.iter_long(raw)]
        pairs, compatible = self._pairs, self.compatible
        last = -1
        for i, token in enumerate(tokens):
            if last >= 0:
                known = pairs.get((last, token))
                if known is None:
                    known = compatible(last, token)
                if not known:
                    return tuple(self._backtrack(raw, tokens[:i]))
            last = token
        return tuple(tokens)

    def _reachable(self, token: int) -> bool:
        key = (-1, token)
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self.merge(self.text_of[token]) == [token]
        return known

    def _longest_at(self, raw: str, at: int) -> int:
        return next(self.automaton.iter_long(raw, at))[1]

    def _backtrack(self, raw: str, tokens: list[int]) -> list[int]:
        """Continues from a compatible prefix of longest matches."""
        length_of, compatible, shorter = self.length_of, self.compatible, self.shorter
        at, end = sum(map(length_of.__getitem__, tokens)), len(raw)
        dead: set[int] = set()
        token = self._longest_at(raw, at)
        while True:
            to = at + length_of[token]
            if to not in dead and (not tokens or compatible(tokens[-1], token)) and (len(tokens) or self._first_ok(token)):
                tokens.append(token)
                at = to
                if at == end:
                    return tokens
                token = self._longest_at(raw, at)
                continue
            token = shorter(token)
            while token < 0:
                if not tokens:
                    return self.merge(raw)
                dead.add(at)
                token = tokens.pop()
                at -= length_of[token]
                token = shorter(token)

    def _first_ok(self, token: int) -> bool:
        return self._reachable(token)


def _clean(text: str) -> str:
    """Lone surrogates can't be written as UTF-8; they become the replacement character."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Memo(dict):
    """Piece -> result, filled on demand; dropped whole when it holds MEMO_CHARS characters."""

    def __init__(self, make, longest: int = MEMO_LONGEST):
        super().__init__()
        self.make, self.chars, self.longest = make, 0, longest

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= self.longest:
            self.chars += len(piece) + 24
            if self.chars > MEMO_CHARS:
                self.clear()
                self.chars = len(piece)
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)
