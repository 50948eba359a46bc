"""A suffix automaton over a sequence of integer symbols."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """States with transitions, suffix links and lengths; state 0 is the root.

    prefix_state[i] is the state reached by the whole sequence up to symbol i.
    Several texts are joined by symbols that no query holds.
    """

    def __init__(self, symbols: Iterable[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.prefix_state = [-1], [0], []
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)
            self.prefix_state.append(last)

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new, p = self._add(length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = self._add(length[p] + 1, link[q], dict(nxt[q]))
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        return new

    def ancestor(self, state: int, length: int) -> int:
        """The state of the suffix of this length, for a state at least that long."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state
