"""Further keys for rows that share something common: pairs of the words that are rare among them.

Of two rows alike to 0.8, the larger with n words, all but floor(0.2 n) different words of
either are words of the other.  So whatever order all words are put in, the first LENGTH of
the words they share are among the first floor(0.2 n) + LENGTH of each row.  The order is by
the number of rows that hold a word, rarest first, so the keys tell rows apart: the keys of
rows of up to LONG words are all pairs of those first words, which no alike pair of them
fails to share (but for rows with a single different word).  Longer rows have many first
words, and pairs of them meet by chance, so theirs are triples: three of the MOST rarest
words, each at most two places after the one before.  Rows of up to LONG / 0.8 words have both.

A word that few rows hold tells them apart alone: of those first or rarest words, one that only
one row holds is no key, one in up to FEW rows is a key itself, and only more frequent ones are
in pairs and triples.  The rarest word of a pair or triple that two rows share is in both, so
rows that would share one led by a rarer word share that word's own key.

Numbers of rows are counted in SLOTS slots by the hash of the word, a table of bounded size;
words that share a slot are ordered by their hashes, which every row does alike.  A slot has
at least as many rows as each of its words.
"""

from __future__ import annotations

import numpy as np

#: Slots of the counts of words.
SLOTS = 1 << 17
#: Words that two rows share at least among their first ones.
LENGTH = 2
#: Words of a row up to which all pairs of first words are keys, and first words beyond.
LONG, MOST = 60, 34
#: Rows that may hold a word that is a key alone: buckets of so few are compared whole.
FEW = 16


def _first(n: int, similarity: float) -> int:
    """How many words the pairs of a row of ``n`` words are made of."""
    return int((1 - similarity) * n + 1e-9) + LENGTH if n <= LONG / similarity else 0


def _rarest(n: int) -> int:
    """The same for its triples."""
    return MOST if n > LONG else 0


def _frequent(words: np.ndarray, held: np.ndarray | None) -> np.ndarray:
    return words if held is None else words[held[: len(words)] > FEW]


def singles(words: np.ndarray, n: int, similarity: float, held: np.ndarray) -> np.ndarray:
    """The words that are keys of a row of ``n`` words, given its different words in order and how many rows hold each."""
    words = words[: max(_first(n, similarity), _rarest(n))]
    return words[(held[: len(words)] > 1) & (held[: len(words)] <= FEW)]


def pairs(words: np.ndarray, n: int, similarity: float, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and second words of its keys of two words; of all first words where ``held`` is not given."""
    words = _frequent(words[: _first(n, similarity)], held)
    i, j = np.triu_indices(len(words), 1)
    return words[i], words[j]


def triples(words: np.ndarray, n: int, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the keys of three words, which rows of more than LONG words have."""
    words = _frequent(words[: _rarest(n)], held)
    at = [(i, i + a, i + a + b) for a in (1, 2) for b in (1, 2) for i in range(len(words) - a - b)]
    i, j, k = np.array(at, np.int64).reshape(-1, 3).T
    return words[i], words[j], words[k]
