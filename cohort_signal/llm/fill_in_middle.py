"""Fill-in-the-middle examples, cut with a wavelet matrix over character classes.

The texts of a slice are laid end to end as UTF-8 and every byte becomes one
of seven classes (continuation byte, first or later byte of a word, blank or
line break, each after a space or after a word).  A wavelet matrix over these
classes, three bit planes with counts every 64 bits, answers "how many of class
c before position p" for all texts at once.  Units are counted by combining
such ranks: word ends are blanks after a word plus breaks after a word, lines
are breaks of both kinds, characters are all bytes less the continuation
bytes.  A cut at a given unit is found by bisection on the combined rank, and
a cut's code points are counted by one more rank query.

A word unit is a word with the white space before it; white space at the end
of a text is a unit of its own.  Cuts and form are drawn from the SHA-256 of
``seed:id``, so a document gets the same example in any run, order or
partitioning.  A text that is empty or holds a marker stays plain, so that
markers in an output are always the operator's own and ``restore`` is exact.

Scale: one narrow pass, no shuffle; a task holds one slice of texts (at most
SLICE_ROWS texts or SLICE_BYTES, a longer text alone) and its three bit planes.

Edge cases: a null text is the empty text, plain, with no units; a null id
draws from ``seed:`` alone; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The markers of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20

#: Classes of bytes.
INNER, CONTINUATION, FIRST, BLANK_AFTER_SPACE, BREAK_AFTER_SPACE, BLANK_AFTER_WORD, BREAK_AFTER_WORD = range(7)
PLANES = 3

#: unit -> (classes whose ranks are added, whether the cut lies after the found byte)
UNITS = {
    "word": ((BLANK_AFTER_WORD, BREAK_AFTER_WORD), False),
    "line": ((BREAK_AFTER_SPACE, BREAK_AFTER_WORD), True),
    "character": ((INNER, FIRST, BLANK_AFTER_SPACE, BREAK_AFTER_SPACE, BLANK_AFTER_WORD, BREAK_AFTER_WORD), False),
}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLLOWS = np.zeros(256, dtype=bool)
_FOLLOWS[0x80:0xC0] = True

_SCHEMA = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte; a text's first byte counts as after a space."""
    space = _SPACE[raw]
    after_space = np.empty(len(raw), dtype=bool)
    after_space[1:] = space[:-1]
    after_space[starts[starts < len(raw)]] = True
    out = _FOLLOWS[raw].view(np.uint8) * np.uint8(CONTINUATION)
    out[after_space & ~_FOLLOWS[raw]] = FIRST
    gap = np.uint8(BLANK_AFTER_SPACE) + (raw == 0x0A).view(np.uint8) + (~after_space).view(np.uint8) * np.uint8(2)
    return np.where(space, gap, out)


class WaveletMatrix:
    """Rank queries over a sequence of small classes."""

    def __init__(self, symbols: np.ndarray):
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for plane in reversed(range(PLANES)):
            bits = (symbols >> plane) & 1
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(len(bits) - int(self.before[-1][-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` lie before each position of ``at``."""
        lo, hi = np.zeros(1, dtype=np.int64), at
        for level in range(PLANES):
            if symbol >> (PLANES - 1 - level) & 1:
                lo, hi = self.zeros[level] + self._ones(level, lo), self.zeros[level] + self._ones(level, hi)
            else:
                lo, hi = lo - self._ones(level, lo), hi - self._ones(level, hi)
        return hi - lo

    def ranks(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), dtype=np.int64))


def count_units(matrix: WaveletMatrix, unit: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units of every text."""
    marks, after = UNITS[unit]
    found = matrix.ranks(marks, ends) - matrix.ranks(marks, starts)
    if unit == "character":
        return found
    if not after:
        return found + (ends > starts)
    last = np.maximum(ends - 1, starts)
    return found + ((ends > starts) & (matrix.ranks(marks, ends) == matrix.ranks(marks, last)))


def cut_places(matrix: WaveletMatrix, unit: str, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where unit ``k`` of each text ends (0: its start, n: its end): the least
    place with enough marks before it, by bisection on the combined rank."""
    marks, after = UNITS[unit]
    need = matrix.ranks(marks, starts) + k + (unit == "character")
    lo, hi = starts.copy(), ends.copy()
    while np.any(lo < hi):
        middle = (lo + hi) // 2
        enough = matrix.ranks(marks, middle) >= need
        hi = np.where(enough, middle, hi)
        lo = np.where(enough, lo, np.minimum(middle + 1, hi))
    found = lo if after else lo - 1
    return np.where(k == 0, starts, np.where(k == n, ends, found))


def _draws(seed: str, key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < SLICE_ROWS and (end == at or size + len(texts[end]) <= SLICE_BYTES):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _transform(seed: str, unit: str, rate_pct: int, spm_pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    prefix_mark, suffix_mark, middle_mark = MARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _sliced(batches):
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
            matrix = WaveletMatrix(classes(raw, starts))
            n = count_units(matrix, unit, starts, ends)
            draws = np.array([_draws(seed, key or "") for key in batch.column("key").to_pylist()], dtype=np.int64)
            first, second = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
            cut1 = cut_places(matrix, unit, starts, ends, n, np.minimum(first, second))
            cut2 = cut_places(matrix, unit, starts, ends, n, np.maximum(first, second))
            follow = [matrix.rank(CONTINUATION, at) for at in (starts, cut1, cut2)]
            prefix_chars = cut1 - starts - (follow[1] - follow[0])
            middle_chars = cut2 - cut1 - (follow[2] - follow[1])
            plain = draws[:, 2] % 100 >= rate_pct
            spm = draws[:, 3] % 100 < spm_pct
            forms, outputs = [], []
            for i, text in enumerate(texts):
                if plain[i] or not text or any(m in text for m in MARKS):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                a, b = int(cut1[i] - starts[i]), int(cut2[i] - starts[i])
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                forms.append("spm" if spm[i] else "psm")
                outputs.append(b"".join([suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle] if spm[i]
                                        else [prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle]))
            cut = np.array([f == "plain" for f in forms], dtype=bool)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n),
                "form": pa.array(forms, pa.string()),
                "prefix_chars": pa.array(prefix_chars, mask=cut),
                "middle_chars": pa.array(middle_chars, mask=cut),
                "output": pa.array(outputs, pa.binary()).cast(pa.string()),
            })

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "42", unit: str = "word",
                   rate_pct: int = 50, spm_pct: int = 80) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm),
    prefix_chars and middle_chars (code points; null where plain) and output.
    ``rate_pct`` of the documents are cut, ``spm_pct`` of those suffix first."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {sorted(UNITS)}")
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_transform(seed, unit, rate_pct, spm_pct), _SCHEMA.format(id=src.schema["doc_id"].dataType.simpleString()))


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made from."""
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    parts = F.split(out, "|".join(m.decode() for m in MARKS), -1)
    return (F.when(kind == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(kind == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(out))
