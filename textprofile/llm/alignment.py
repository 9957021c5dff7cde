"""Approximate occurrences of a word sequence inside another, by edit distance."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class Pattern:
    """A word sequence prepared for bit-parallel search (one bit a word)."""

    def __init__(self, words: Sequence[Hashable]):
        self.words, self.n = list(words), len(words)
        self.at: dict[Hashable, int] = {}
        for i, w in enumerate(self.words):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def find(self, words: Sequence[Hashable]) -> tuple[int, int]:
        """(edits, end) of the best occurrence: the fewest word insertions,
        deletions and substitutions between the pattern and ``words[start:end]``
        for any start; of equals the first end."""
        if not self.n:
            return 0, 0
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, edits = full, 0, self.n  # +1 and -1 steps of the column
        best, end = self.n, 0
        for j, w in enumerate(words, 1):
            eq = self.at.get(w, 0)
            diag = (((eq & up) + up) ^ up) | eq
            right_up, right_down = down | (full & ~(diag | up)), up & diag
            edits += 1 if right_up & top else -1 if right_down & top else 0
            right_up, right_down, eq = (right_up << 1) & full, (right_down << 1) & full, eq | down
            up, down = right_down | (full & ~(eq | right_up)), right_up & eq
            if edits < best:
                best, end = edits, j
        return best, end

    def locate(self, words: Sequence[Hashable]) -> tuple[int, int, int]:
        """(edits, start, end) of the best occurrence."""
        edits, end = self.find(words)
        back, length = Pattern(self.words[::-1]).find(list(words[:end])[::-1])
        return edits, end - length if back <= edits else 0, end
