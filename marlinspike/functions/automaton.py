"""Multi-pattern automaton with word boundaries and longest non-overlapping matches."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick


def _word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


class PhraseAutomaton:
    """Finds many phrases in one pass over a text.

    Phrases are matched as given (fold the case of both sides beforehand). A phrase that starts or ends
    with a letter or digit must not continue a word there, so ``eur`` isn't found in ``europe``. Of
    overlapping hits the longest wins, of equally long ones the leftmost; of two payloads for one phrase
    the first given stays.
    """

    def __init__(self, phrases: Iterable[tuple[str, object]], boundaries: bool = True):
        self.boundaries, self.size = boundaries, 0
        self._auto = ahocorasick.Automaton()
        for phrase, payload in phrases:
            if phrase and phrase not in self._auto:
                self._auto.add_word(phrase, (len(phrase), payload))
                self.size += 1
        if self.size:
            self._auto.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, object]]:
        """All hits as (start, end, payload), overlapping ones too."""
        if not self.size or not text:
            return
        for last, (n, payload) in self._auto.iter(text):
            start, end = last - n + 1, last + 1
            if self.boundaries:
                if start and _word(text[start]) and _word(text[start - 1]):
                    continue
                if end < len(text) and _word(text[last]) and _word(text[end]):
                    continue
            yield start, end, payload

    def longest(self, text: str) -> list[tuple[int, int, object]]:
        """Longest non-overlapping hits in text order."""
        found = sorted(self.hits(text), key=lambda h: (h[0] - h[1], h[0]))
        kept: list[tuple[int, int, object]] = []
        starts: list[int] = []
        for hit in found:
            at = bisect_left(starts, hit[0])
            # Kept hits don't overlap one another, so only the neighbours can overlap a new one.
            if (at == 0 or kept[at - 1][1] <= hit[0]) and (at == len(kept) or hit[1] <= kept[at][0]):
                kept.insert(at, hit)
                starts.insert(at, hit[0])
        return kept
