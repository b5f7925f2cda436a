"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, found
by the forward algorithm; a text's log-likelihood is the sum over its words.
The piece probabilities are learned by expectation-maximisation (forward and
backward sums) on the word counts of all training documents of the language.

Words: white-space pieces, lower-cased, of which the letters are kept, with a
word-start mark in front; words over MAX_WORD letters are cut into parts of
that size.  A letter outside the vocabulary counts as a piece of least
probability.

Scale: word counts are summed per task, then by a grouped sum (the shuffle
grows with the distinct words); each EM round is one pass over that table that
returns at most languages x vocabulary sums per task, and as many reach the
driver.  Scoring is one pass over the texts without a shuffle; each worker
remembers the scores of words it has met, up to a fixed number.

Edge cases: a null text, or one without letters, gets ``und`` and score 0;
without training text every document gets ``und``; ties go to the language
first in order; rows with a null id are left out; repeated rows are each
predicted; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, slices

FOLDS, HELD_OUT = 4, 2
EM_ROUNDS = 2
MAX_WORD = 32
#: Longest piece, with its word-start mark.
MAX_PIECE = 10
#: Least probability of a piece or unknown letter.
FLOOR = 1e-7
#: Languages a model may hold (the model is languages x vocabulary numbers).
MAX_LANGUAGES = 500
#: Scores (words x languages) that a worker remembers.
CACHE_NUMBERS = 2_500_000
START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Leading bits of a hash that address the table of pieces.
SLOT_BITS = 20
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
#: Odd factor that carries the low bits of a hash into the leading ones.
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary:
    """Pieces of a sentencepiece model and their substring hashes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.pieces = sorted(p for p in pieces if 0 < len(p) <= MAX_PIECE and all(c.isalpha() or (c == START and k == 0) for k, c in enumerate(p)))
        h = np.array([self.hash_of(p) for p in self.pieces], dtype=np.uint64) * _SPREAD
        order = np.argsort(h)
        self.sorted, self.ids = h[order], order.astype(np.int64)
        #: first hash of each value of the leading SLOT_BITS bits (-1: none), and the most that share one
        slots, at, n = np.unique(self.sorted >> _SLOT_SHIFT, return_index=True, return_counts=True)
        self.first = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first[slots] = at
        self.most = int(n.max(initial=0))
        #: number of pieces; the number itself stands for an unknown letter
        self.size = len(self.pieces)

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length T: entry l - 1 holds the piece numbers of
        the substrings of length l, shape (T - l + 1, words), -1 where there
        is no such piece; unknown single letters have the number ``size``."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).T.astype(np.uint64, order="C") + np.uint64(1)
        t = len(codes)
        out, h = [], np.zeros((t + 1, len(words)), np.uint64)
        for n in range(1, min(MAX_PIECE, t) + 1):
            h = h[:t - n + 1] * _BASE + codes[n - 1:]
            flat = h.ravel() * _SPREAD
            ids = np.full(flat.shape, self.size if n == 1 else -1, np.int64)
            first = self.first[flat >> _SLOT_SHIFT]
            maybe = np.nonzero(first >= 0)[0]  # few substrings share even the leading bits with a piece
            for k in range(self.most):
                at = np.minimum(first[maybe] + k, self.size - 1)
                hit = self.sorted[at] == flat[maybe]
                ids[maybe[hit]] = self.ids[at[hit]]
            out.append(ids.reshape(h.shape))
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def forward(lattice: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of the first t letters, shape
    (T + 1, words, languages).  p: (size + 2, languages); its last row is 0."""
    t, words = lattice[0].shape
    alpha = np.zeros((t + 1, words, p.shape[1]))
    alpha[0] = 1
    for end in range(1, t + 1):
        for n in range(1, min(len(lattice), end) + 1):
            i = lattice[n - 1][end - n]
            at = np.nonzero(i >= 0)[0]
            alpha[end][at] += alpha[end - n][at] * p[i[at]]
    return alpha


def backward(lattice: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    t, words = lattice[0].shape
    beta = np.zeros((t + 1, words, p.shape[1]))
    beta[t] = 1
    for at in range(t - 1, -1, -1):
        for n in range(1, min(len(lattice), t - at) + 1):
            i = lattice[n - 1][at]
            real = np.nonzero(i >= 0)[0]
            beta[at][real] += beta[at + n][real] * p[i[real]]
    return beta


def _by_length(words: list[str], most: int = 8192) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for t in np.unique(sizes):
        rows = np.nonzero(sizes == t)[0]
        for at in range(0, len(rows), most):
            yield rows[at:at + most]


def marked(word: str) -> list[str]:
    """A word of letters with its mark, in parts of MAX_WORD letters."""
    return [START + word[at:at + MAX_WORD] for at in range(0, len(word), MAX_WORD)]


def log_likelihoods(words: list[str], vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), p.shape[1]))
    for rows in _by_length(words):
        out[rows] = np.log(forward(vocab.lattice([words[i] for i in rows]), p)[-1])
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (and of unknown letters, last), one language."""
    out = np.zeros(vocab.size + 1)
    for rows in _by_length(words):
        lattice = vocab.lattice([words[i] for i in rows])
        alpha, beta = forward(lattice, p)[..., 0], backward(lattice, p)[..., 0]
        weight = counts[rows] / alpha[-1]
        for n, ids in enumerate(lattice, 1):
            for at in range(len(ids)):
                real = np.nonzero(ids[at] >= 0)[0]
                i = ids[at][real]
                np.add.at(out, i, alpha[at][real] * p[i, 0] * beta[at + n][real] * weight[real])
    return out


def _padded(p: np.ndarray) -> np.ndarray:
    """(size + 1, languages) probabilities with a zero row for number -1."""
    return np.concatenate([np.maximum(p, FLOOR), np.zeros((1, p.shape[1]))])


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """How many white-space pieces each text has, their different words, and
    the word number of every piece in order (a piece without letters has the
    empty word)."""
    split = pc.utf8_split_whitespace(texts)
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    pieces = split.flatten().dictionary_encode()
    words = pc.replace_substring_regex(pc.utf8_lower(pieces.dictionary), r"\PL+", "").dictionary_encode()
    return sizes, words.dictionary.to_pylist(), words.indices.to_numpy()[pieces.indices.to_numpy()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        langs = batch.column("lang")
        for lang in langs.unique():
            _, found, at = words_of(batch.column("text").filter(pc.equal(langs, lang)))
            words: Counter = Counter()
            for word, n in zip(found, np.bincount(at, minlength=len(found)).tolist()):
                for part in marked(word):
                    words[part] += n
            if words:
                yield pa.record_batch({"lang": pa.array([lang.as_py()] * len(words)), "word": pa.array(list(words)), "n": pa.array(list(words.values()), pa.int64())})


def is_held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % FOLDS) == HELD_OUT


def train(docs: DataFrame, vocab_path: str) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their piece probabilities (size + 1, languages)."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    src = src.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = materialise(src.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")), "word_counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    vocab = vocabulary(vocab_path)
    p = np.full((vocab.size + 1, max(1, len(langs))), 1 / (vocab.size + 1))
    if not langs:
        return langs, p

    for _ in range(EM_ROUNDS):
        held = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, q = vocabulary(vocab_path), _padded(held.value)
            sums = np.zeros((len(langs), v.size + 1))
            for batch in batches:
                lang = np.asarray(batch.column("lang").to_pylist(), dtype=object)
                words = np.asarray(batch.column("word").to_pylist(), dtype=object)
                n = batch.column("n").to_numpy().astype(float)
                for k, name in enumerate(langs):
                    rows = np.nonzero(lang == name)[0]
                    if len(rows):
                        sums[k] += expected_counts(words[rows].tolist(), n[rows], v, q[:, k:k + 1])
            k, i = np.nonzero(sums)
            yield pa.record_batch({"k": pa.array(k, pa.int64()), "piece": pa.array(i, pa.int64()), "uses": pa.array(sums[k, i], pa.float64())})

        got = counts.mapInArrow(expect, "k long, piece long, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        sums = np.full_like(p, 1e-3)
        sums[got.column("piece").to_numpy(), got.column("k").to_numpy()] += got.column("uses").to_numpy()
        p = sums / sums.sum(0)
    return langs, p


class _Scorer:
    """Scores texts in one worker; remembers words from task to task, up to
    CACHE_NUMBERS scores and the new ones of one batch."""

    def __init__(self, vocab: Vocabulary, p: np.ndarray) -> None:
        self.vocab, self.p = vocab, _padded(p)
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, p.shape[1] + 1))

    def learn(self, words: list[str]) -> None:
        if len(self.at) * self.table.shape[1] > CACHE_NUMBERS:
            self.at, self.table = {}, self.table[:1024].copy()
        new = [w for w in words if w not in self.at]
        if not new:
            return
        parts = [marked(w) for w in new]
        flat = [x for part in parts for x in part]
        owner = np.repeat(np.arange(len(new)), [len(x) for x in parts])
        rows = np.zeros((len(new), self.table.shape[1]))
        if flat:
            ll = log_likelihoods(flat, self.vocab, self.p)
            np.add.at(rows[:, :-1], owner, ll)
            np.add.at(rows[:, -1], owner, [len(x) - 1 for x in flat])
        base = len(self.at)
        if base + len(new) > len(self.table):  # doubling keeps the copying linear
            self.table = np.concatenate([self.table[:base], np.zeros((base + 2 * len(new), self.table.shape[1]))])
        self.table[base:base + len(new)] = rows
        self.at.update(zip(new, range(base, base + len(new))))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages + 1): log-likelihoods, then the letters scored."""
        sizes, words, at = words_of(texts)
        self.learn(words)
        rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))[at]
        out = np.zeros((len(texts), self.table.shape[1]))
        filled = sizes > 0  # their pieces follow each other without a gap
        if filled.any():
            out[filled] = np.add.reduceat(self.table[rows], (np.cumsum(sizes) - sizes)[filled], axis=0)
        return out


#: The scorer of the model that this worker met last, by the model's key.
_SCORERS: dict[str, _Scorer] = {}


def _scorer(key: str, vocab: Vocabulary, p: np.ndarray) -> _Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = _Scorer(vocab, p)
    return _SCORERS[key]


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocab_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior under equal priors)."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    held, key = spark.sparkContext.broadcast(p), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, vocabulary(vocab_path), held.value)
        for batch in slices(batches):
            got = scorer(batch.column("text"))
            ll, letters = got[:, :-1], got[:, -1]
            best = ll.argmax(1)
            post = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
            known = (letters > 0) & (len(langs) > 0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"),
                                   "lang_pred": pa.array([langs[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                                   "score": pa.array(np.where(known, post, 0.0), pa.float64())})

    out = src.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, vocab_path: str) -> DataFrame:
    langs, p = train(docs, vocab_path)
    return predict(docs, langs, p, vocab_path)
