"""Linear exact token counts: a trie with failure links and precomputed token emissions.

The trie holds the vocabulary. Where a text leaves the trie at a node, the longest matches of the
node's string that are settled by then were computed beforehand (its emission), and the failure link
leads to the node of what is left, so every character is read once and nothing is matched again.
For a vocabulary of longest matches the emissions are the tokens. A byte-level BPE agrees with the
longest matches wherever neighbouring tokens are compatible; elsewhere the encoder backtracks.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

from mixloom.functions.bpe import CHUNKS, Encoder, _clean, _Memo, encoder


class LongestMatch:
    """Longest-match tokens of a text from left to right; every single character must be a token."""

    def __init__(self, ranks: dict[str, int]):
        missing = {c for token in ranks for c in token} - set(ranks)
        if missing:
            raise ValueError(f"single characters without a token: {sorted(missing)[:5]}")
        children: list[dict[str, int]] = [{}]
        token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for c in token:
                after = children[node].get(c)
                if after is None:
                    after = children[node][c] = len(children)
                    children.append({})
                    token_at.append(-1)
                node = after
            token_at[node] = rank
        self.children = children
        self.link = [0] * len(children)
        self.emission: list[tuple[int, ...]] = [()] * len(children)
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for c, node in children[parent].items():
                waiting.append(node)
                if token_at[node] >= 0:
                    # All of the node's string is one token; nothing is left.
                    self.emission[node] = (token_at[node],)
                    continue
                emitted, rest = self.emission[parent], self.link[parent]
                while c not in children[rest]:
                    emitted, rest = emitted + self.emission[rest], self.link[rest]
                self.emission[node], self.link[node] = emitted, children[rest][c]

    def tokens(self, raw: str) -> list[int]:
        children, link, emission = self.children, self.link, self.emission
        out: list[int] = []
        node = 0
        for c in raw:
            after = children[node].get(c)
            while after is None:
                out += emission[node]
                node = link[node]
                after = children[node].get(c)
            node = after
        while node:
            out += emission[node]
            node = link[node]
        return out


class TokenCounter:
    """Counts of a byte-level vocabulary's tokens, without making the ids."""

    def __init__(self, coder: Encoder):
        self.coder, self.matches = coder, LongestMatch(coder.ranks)
        self.of_piece = _Memo(self._piece)
        self.of_chunk = _Memo(lambda chunk: sum(map(self.of_piece.__getitem__, coder.split(chunk))), 60)

    def count(self, text: str | None) -> int:
        return sum(map(self.of_chunk.__getitem__, CHUNKS.findall(_clean(text)))) if text else 0

    def _piece(self, piece: str) -> int:
        coder = self.coder
        raw = piece.encode("utf-8").decode("latin-1")
        whole = coder.ranks.get(raw)
        if whole is not None and coder._reachable(whole):
            return 1
        found = self.matches.tokens(raw)
        if all(map(coder.compatible, found, found[1:])):
            return len(found)
        return len(coder.ids_of_piece[piece])


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter a worker process and vocabulary."""
    return TokenCounter(encoder(path))
