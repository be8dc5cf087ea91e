"""Many literal phrases at once: an Aho-Corasick automaton over the folded characters of a text.

One pass over a text finds the phrases it holds, whatever their number and length; no word sequences are built. Case folds character
by character, so offsets stay those of the text; a phrase counts where no word character touches it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

WORD_CATEGORIES = ("L", "M", "Nd", "Nl", "Pc")


class _Folded(dict):
    """Code points to their folded form: upper then lower case, where both are one character."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        # the dotted capital I alone has a lower-case form of two characters, the first of which is its plain one
        self[code] = ord(lower[0]) if len(lower) == 1 or code == 0x130 else code
        return self[code]


class _Words(dict):
    """Whether a character is part of a word: letters, marks, digits, connectors, joiners."""

    def __missing__(self, c: str) -> bool:
        self[c] = c in "‌‍" or unicodedata.category(c).startswith(WORD_CATEGORIES)
        return self[c]


_FOLDED, _WORDS = _Folded(), _Words()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDED)


class Phrases:
    """Phrases, each with a payload, ready to be found in texts."""

    def __init__(self, phrases: Iterable[tuple[str, object]]) -> None:
        import ahocorasick

        by_key: dict[str, list[object]] = {}
        for phrase, payload in phrases:
            if any(_WORDS[c] for c in phrase):
                by_key.setdefault(fold(phrase), []).append(payload)
        self.empty, self.automaton = not by_key, ahocorasick.Automaton()
        for key, payloads in by_key.items():
            self.automaton.add_word(key, (len(key), payloads))
        if by_key:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, object]]:
        """(start, end, payload) of every whole occurrence; those of one phrase do not overlap, the leftmost count."""
        if self.empty:
            return
        n, done = len(text), {}
        for last, (size, payloads) in self.automaton.iter(fold(text)):
            start, end = last + 1 - size, last + 1
            if (start and _WORDS[text[start - 1]]) or (end < n and _WORDS[text[end]]) or done.get(id(payloads), 0) > start:
                continue
            done[id(payloads)] = end
            for payload in payloads:
                yield start, end, payload


def scan(load: Callable[[], list[tuple[str, object]]], row: Callable[[int, int, object], tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches (key, text) that gives the key and ``row`` of each phrase found; ``load`` runs once per worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for batch in batches:
            phrases = phrases or Phrases(load())
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for found in phrases.find(text.as_py() or ""):
                    at.append(i)
                    rows.append(row(*found))
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)

    return run
