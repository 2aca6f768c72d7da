"""Generalised suffix automata over sequences of hashable tokens."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Knows every run of tokens of the sequences added to it. State 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, tokens: Iterable[Hashable]) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for tok in tokens:
            known = nxt[last].get(tok)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._split(last, known, tok)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and tok not in nxt[p]:
                nxt[p][tok] = new
                p = link[p]
            if p != -1:
                q = nxt[p][tok]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, tok)
            last = new

    def _split(self, p: int, q: int, tok: Hashable) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(tok) == q:
            nxt[p][tok] = copy
            p = link[p]
        return copy

    def matching(self, tokens: Sequence[Hashable]) -> Iterator[int]:
        """For each token the length of the longest known run that ends with it."""
        nxt, link, length = self.next, self.link, self.len
        v = n = 0
        for tok in tokens:
            while v and tok not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(tok)
            if to is None:
                v = n = 0
            else:
                v, n = to, n + 1
            yield n
