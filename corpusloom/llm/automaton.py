"""A suffix automaton over word ids that grows text by text."""

from __future__ import annotations


class SuffixAutomaton:
    """Knows every word sequence of the texts added so far; each text is a factor of its own."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def __len__(self) -> int:
        return len(self.next)

    def _state(self, length: int, ways: dict[int, int], link: int) -> int:
        self.next.append(ways)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words) -> None:
        """Adds a text, beginning at the root."""
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def matching(self, words) -> list[int]:
        """Matching statistics: for every place, how long the longest known sequence ending there is."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out
