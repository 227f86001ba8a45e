"""Document statistics, by vectorised kernels over slices of Arrow batches."""

from __future__ import annotations

import numpy as np

from . import kernels as K

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _LOWER, _DIGIT, _PUNCT, _STOP = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP[[ord(c) for c in ".,;:"]] = True
#: A byte that begins a code point.
_FIRST = np.ones(256, dtype=bool)
_FIRST[0x80:0xC0] = False


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def _firsts(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order by (row, value), True where a new (row, value) begins in that order, and how often each item's pair occurs."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))) if len(r) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    count = np.empty(len(r), np.int64)
    count[order] = np.repeat(np.diff(np.append(at, len(r))), np.diff(np.append(at, len(r))))
    return order, new, count


class Texts:
    """The words and lines of some rows, and per-row counts of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.word_off = K.words(data, offsets)
        self.n_words = np.diff(self.word_off)
        self.word_row = np.repeat(np.arange(self.rows), self.n_words)
        self.word_hash = K.span_hash(data, self.starts, self.ends)
        self.word_chars = _sums(_FIRST[data] & ~K.SPACE[data], offsets)

    def per_word(self, flag: np.ndarray) -> np.ndarray:
        """Per row: words for which flag is True."""
        return np.bincount(self.word_row[flag], minlength=self.rows)

    def symbols(self) -> np.ndarray:
        return _sums(_SYMBOL[self.data], self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Row, hash of the raw bytes and number of words of each \n-split line with a word."""
        starts, ends, off = K.lines(self.data, self.offsets)
        inner = np.maximum.accumulate(np.append(np.searchsorted(self.starts, starts), len(self.starts)))
        size = np.diff(inner)
        keep = size > 0
        row = np.repeat(np.arange(self.rows), np.diff(off))
        return row[keep], K.span_hash(self.data, starts[keep], ends[keep]), size[keep]

    def duplicate_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line of the row."""
        row, h, _ = self.lines()
        order, new, _ = _firsts(row, h)
        total = np.bincount(row, minlength=self.rows)
        return total, total - np.bincount(row[order][new], minlength=self.rows)

    def repeated_words(self, width: int = 3) -> np.ndarray:
        """Words inside windows of width words that the row holds twice or more."""
        row, place, h = K.window_hash(self.word_hash, self.word_off, width)
        _, _, count = _firsts(row, h)
        at = self.word_off[row] + place
        twice = at[count > 1]
        edge = np.zeros(len(self.starts) + width + 1, np.int32)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + width, -1)
        covered = np.cumsum(edge)[: len(self.starts)] > 0
        return np.bincount(self.word_row[covered], minlength=self.rows)


NAMES = (
    "log_words", "word_length", "word_length_spread", "upper_words", "capital_words", "digit_words", "marked_words", "symbols", "bare_marks",
    "upper", "lower", "digits", "punctuation", "other", "distinct_words", "most_common_word", "same_as_before", "repeated_trigrams", "lines",
    "duplicate_lines", "words_a_line", "stops", "exclamations", "entropy",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x len(NAMES) numbers; all are finite, for an empty text as well."""
    t = Texts(data, offsets)
    words = np.maximum(t.n_words, 1)
    size = np.maximum(_sums(~K.SPACE[data], offsets), 1)
    chars = np.concatenate(([0], np.cumsum(_FIRST[data] & ~K.SPACE[data], dtype=np.int64)))
    length = chars[t.ends] - chars[t.starts]
    inside = lambda table: (lambda run: run[t.ends] - run[t.starts])(np.concatenate(([0], np.cumsum(table[data], dtype=np.int64))))
    upper, lower, digit, punct = inside(_UPPER), inside(_LOWER), inside(_DIGIT), inside(_PUNCT)
    mean = np.bincount(t.word_row, weights=length, minlength=t.rows) / words
    spread = np.sqrt(np.maximum(np.bincount(t.word_row, weights=length.astype(float) ** 2, minlength=t.rows) / words - mean**2, 0))
    order, new, count = _firsts(t.word_row, t.word_hash)
    distinct = np.bincount(t.word_row[order][new], minlength=t.rows)
    most = np.zeros(t.rows)
    np.maximum.at(most, t.word_row, count)
    entropy = np.log2(words) - np.bincount(t.word_row, weights=np.log2(np.maximum(count, 1)), minlength=t.rows) / words
    again = np.zeros(len(t.word_hash), dtype=bool)
    again[1:] = (t.word_hash[1:] == t.word_hash[:-1]) & (t.word_row[1:] == t.word_row[:-1])
    total, twice = t.duplicate_lines()
    last = data[t.ends - 1] if len(t.ends) else data[:0]
    first = data[t.starts] if len(t.starts) else data[:0]
    per = lambda flag: t.per_word(flag) / words
    columns = [
        np.log1p(t.n_words), mean, spread, per((upper > 1) & (lower == 0)), per(_UPPER[first] & (lower > 0)), per(digit > 0), per(punct > 0), t.symbols() / size,
        per(punct == t.ends - t.starts), _sums(_UPPER[data], offsets) / size, _sums(_LOWER[data], offsets) / size, _sums(_DIGIT[data], offsets) / size,
        _sums(_PUNCT[data], offsets) / size, _sums(data >= 128, offsets) / size, distinct / words, most / words, per(again), t.repeated_words() / words,
        np.log1p(total), twice / np.maximum(total, 1), np.log1p(t.n_words / np.maximum(total, 1)), per(_STOP[last]), per(last == 33), entropy,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)
