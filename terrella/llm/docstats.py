"""Counts of documents and lines, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from .textkit import SPACE, Slice, per, repeated, salted, shingles

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_CLASS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "bang": np.arange(256) == ord("!"),
    "pipe": np.arange(256) == ord("|"),
    "symbol": _SYM,
    "wide": np.arange(256) >= 0xC0,
    "stop": np.isin(np.arange(256), list(b".,;:?")),
}
WINDOW = 8
LINE_FEATURES = ("bias", "symbol", "upper", "bang", "pipe", "repeat", "digit", "length", "short", "stopped")
DOC_FEATURES = (
    "log_words", "word_length", "symbol", "upper", "bang", "pipe", "repeat", "digit", "wide", "stop", "windows", "dup_lines",
    "distinct", "words_per_line", "short_lines", "stopped_lines", "symbol_lines", "long_words", "space", "log_lines",
)


class Counts:
    """Everything counted in one slice of whole documents."""

    def __init__(self, s: Slice):
        n = s.n
        self.slice = s
        start, end, doc = s.words()
        h = s.hashes(start, end)
        points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
        length = points[end] - points[start]
        self.n_words, self.word_chars = per(doc, n), per(doc, n, length).astype(np.int64)
        self.chars = points[s.offs[1:]] - points[s.offs[:-1]]
        ls, le, ldoc, base = s.lines()
        line = np.searchsorted(ls, start, "right") - 1
        # empty rows share a start with the row after them; the last line that starts there is the one with the word
        self.line_doc, self.base = ldoc, base
        self.line_words = per(line, len(ls))
        live = np.flatnonzero(self.line_words)
        self.live = live
        again = repeated(salted(s.hashes(ls[live], le[live]), ldoc[live]))[1]
        self.n_dup_lines = per(ldoc[live][again], n)
        g, at = shingles(h, doc, WINDOW)
        twice = at[repeated(salted(g, doc[at]))[0]] if len(at) else at
        cover = np.bincount(twice, minlength=len(h) + 1) - np.bincount(twice + WINDOW, minlength=len(h) + 1)[: len(h) + 1]
        self.n_repeat_words = per(doc[np.cumsum(cover)[: len(h)] > 0], n) if len(h) else np.zeros(n, np.int64)
        self.line_chars = np.maximum(points[le] - points[ls], 1)
        self.by_class, self.by_line = {}, {}
        for name, table in _CLASS.items():
            run = np.concatenate([[0], np.cumsum(table[s.data])])
            self.by_class[name] = run[s.offs[1:]] - run[s.offs[:-1]]
            self.by_line[name] = run[le] - run[ls]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        self.line_repeat = per(line[same], len(ls))
        self.doc_repeat = per(doc[same], n)
        last = np.zeros(len(ls), bool)
        if len(start):
            final = np.flatnonzero(np.append(line[1:] != line[:-1], True))
            last[line[final]] = np.isin(s.data[end[final] - 1], list(b".!?"))
        self.line_stopped = last
        self.distinct = per(doc[~repeated(salted(h, doc))[1]], n) if len(h) else np.zeros(n, np.int64)
        self.long_words = per(doc[length > 12], n)
        space = np.concatenate([[0], np.cumsum(SPACE[s.data])])
        self.space = space[s.offs[1:]] - space[s.offs[:-1]]

    @property
    def n_symbols(self) -> np.ndarray:
        return self.by_class["symbol"]

    def line_features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines that have a word, in order: features, document, words."""
        at = self.live
        words, chars = np.maximum(self.line_words[at], 1), self.line_chars[at]
        b = {k: v[at] for k, v in self.by_line.items()}
        columns = (
            np.ones(len(at)), b["symbol"] / chars * 4, b["upper"] / chars, b["bang"] / words / 2, b["pipe"] / words,
            self.line_repeat[at] / words, b["digit"] / chars, np.log1p(words) / 6, words < 3, self.line_stopped[at],
        )
        return np.clip(np.stack(columns, 1).astype(np.float64), 0, 1), self.line_doc[at], self.line_words[at]

    def doc_features(self) -> np.ndarray:
        n, words, chars = self.slice.n, np.maximum(self.n_words, 1), np.maximum(self.chars, 1)
        lines = np.maximum(per(self.line_doc[self.live], n), 1)
        b = self.by_class
        lined = lambda mask: per(self.line_doc[self.live][mask[self.live]], n) / lines
        columns = (
            np.log1p(self.n_words), self.word_chars / words, b["symbol"] / chars, b["upper"] / chars, b["bang"] / words, b["pipe"] / words,
            self.doc_repeat / words, b["digit"] / chars, b["wide"] / chars, b["stop"] / words, self.n_repeat_words / words,
            self.n_dup_lines / lines, self.distinct / words, np.log1p(words / lines), lined(self.line_words < 3), lined(self.line_stopped),
            lined(self.by_line["symbol"] > 0), self.long_words / words, self.space / chars, np.log1p(lines),
        )
        return np.stack(columns, 1).astype(np.float64)
