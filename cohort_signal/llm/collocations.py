"""Collocations by sorted count streams (external stream estimation layout).

Nothing is looked up in a hash table of phrases: counts live in tables that
are sorted, and meet by merging.

1. Word counts per language, partly summed inside each task.
2. Pairs of neighbouring words, both with ``min_count`` occurrences, are
   counted; these are the phrases of two words, and tell which longer phrases
   cannot be frequent.
3. Every word position gives one record: the words from it on, up to
   ``max_words``, to the end of its piece or to the first word or pair that is
   rarer than ``min_count`` (no phrase over it can be frequent); none if that
   leaves fewer than three words.  Equal records of a slice are summed before
   they leave the task.
4. The records are sorted into prefix order over all machines by range.  In
   that order all records that begin with a phrase lie together, so one pass
   sums the counts of the phrases of all lengths from three; a phrase that touches an end
   of a stretch is passed on as a part and summed afterwards, so no phrase,
   however frequent, has to lie in one task.
5. The phrases with ``min_count`` occurrences are kept as a count stream.  Cuts
   of the candidates sorted by their leading words are merge-joined with it for
   the left counts, sorted by their remaining words for the right counts; the
   counts of the phrases one word longer, keyed by their leading and by their
   trailing words, merge into the extension count of each candidate.

A phrase occurs at least as often as any phrase that contains it, so the
longest containing phrase to look at is the one with one word more.

To pass over rare words and pairs cheaply, steps 2 and 3 test bitmaps of fixed
size (2^BITS bits, collected in at most 2^(BITS-6) rows).  A rare word or pair
that shares a bit or a key with a frequent one is kept: that costs records,
never counts, which are those of the spelled words, pairs and records.

Scale: one shuffle of word counts, one of pairs, one of records by range,
all summed inside tasks before; the rest is as small as the number of frequent phrases.
Hot words and hot languages are split by range and by AQE's skewed joins;
the merge joins move rows per candidate cut, nothing is collected.

Edge cases: a null text is empty; a null language is ``und``; a text without
words counts nothing; pieces never cross documents; repeated rows count each
time; an empty table gives no rows; other columns are ignored; words may hold
any bytes but the separators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, ship, small_batches

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Text handled together in a task; a longer text alone.
SLICE_BYTES = 6 << 20
#: Word positions whose records are sorted together.
WINDOW = 1 << 20
#: Rows of the sorted stream summed together.
STRETCH = 1 << 17
#: Word pairs of a task summed together; they are spelled in slices.
PAIRS = 1 << 22
#: Bits of a bitmap of frequent words or pairs, as a power of two.
BITS = 25

#: Between the words of a phrase: below every byte of a word, so that the order
#: of the phrases as bytes is their order word by word.
JOIN = b"\x00"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _escaped(words: pa.Array) -> pa.Array:
    """Words without the bytes 0 and 1 (1 1 stands for 0, 1 2 for 1)."""
    return pa.array([w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for w in words.to_pylist()], pa.binary())


def _shown(phrase: str) -> Column:
    """A phrase with spaces between its words and its words' own bytes."""
    return F.replace(F.replace(F.replace(F.col(phrase), F.lit("\x00"), F.lit(" ")), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word number of each position, piece, text) of texts laid end to end."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = ~_GAP[raw]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts = np.nonzero(step == 1)[0]
    ends = np.nonzero(step == -1)[0]
    piece = np.cumsum(_BREAK[raw], dtype=np.int32)[starts]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    values = raw[inside]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    if offsets[-1] < 1 << 31:
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    else:
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary())
    if np.any(values < 2):
        distinct = _escaped(distinct)
    return distinct, coded.indices.to_numpy(), piece, text


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[bytes]]]:
    """(distinct languages, each text's language, texts) of one slice."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
                size += len(texts[end])
                end += 1
            yield langs.dictionary, codes[at:end], texts[at:end]
            at = end


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, codes, texts in _sliced(batches):
        words, number, _, text = words_of(texts)
        if len(number):
            keys, counts = np.unique(codes[text].astype(np.int64) * len(words) + number, return_counts=True)
            yield pa.record_batch({"lang": langs.take(pa.array(keys // len(words))), "word": words.take(pa.array(keys % len(words))),
                                   "cnt": pa.array(counts.astype(np.int64))})


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"key": pa.array(_hashes(batch.column("word")).view(np.int64))})


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Two bits of each of some 64-bit keys."""
    first, second = F.shiftrightunsigned("key", 64 - BITS), F.shiftrightunsigned("key", 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    rows = (keys.select(F.explode(F.array(first, second)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    if rows.num_rows:
        out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    first = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    second = ((keys >> np.uint64(64 - 2 * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bitmap[first >> 6] >> (first & 63)) & (bitmap[second >> 6] >> (second & 63)) & 1 == 1


def _pair_keys(hashes: np.ndarray, lang: np.ndarray, number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the pairs that begin at some positions; ``lang`` has each one's language as a hash."""
    return mix64(mix64(hashes[number[at]] + lang) ^ (hashes[number[at + 1]] * np.uint64(0x9E3779B97F4A7C15)))


def _spelled_pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = _hashes(pc.split_pattern(batch.column("phrase"), JOIN).flatten())
        at = 2 * np.arange(batch.num_rows)
        keys = _pair_keys(hashes, _hashes(batch.column("lang")), np.arange(len(hashes)), at)
        yield pa.record_batch({"key": pa.array(keys.view(np.int64))})


def _pairs(frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts -> (lang, phrase, cnt) of their pairs of frequent words."""

    def summed(held: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays([own for own, _, _ in held]).dictionary_encode()
        langs = pa.concat_arrays([own for _, own, _ in held]).dictionary_encode()
        word_number, lang_number = words.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
        words, langs, n = words.dictionary, langs.dictionary, len(words.dictionary)
        keys = np.empty(sum(len(own) for _, _, own in held), dtype=np.int64)
        word_end, lang_end, end = len(word_number), len(lang_number), len(keys)
        while held:  # what has been renumbered is let go
            own_words, own_langs, own = held.pop()
            word_end, lang_end, end, m = word_end - len(own_words), lang_end - len(own_langs), end - len(own), len(own_words)
            part = keys[end:end + len(own)]
            part[:] = lang_number[lang_end + own // m // m]
            part *= n
            part += word_number[word_end + own // m % m]
            part *= n
            part += word_number[word_end + own % m]
        keys.sort()
        first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        length = pc.binary_length(words).to_numpy().astype(np.int64)
        slice_of = np.cumsum(length[keys // n % n] + length[keys % n]) // SLICE_BYTES
        edges = [0, *np.nonzero(np.diff(slice_of))[0] + 1, len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = keys[lo:hi]
            yield pa.record_batch({
                "lang": langs.take(pa.array(part // n // n)),
                "phrase": pc.binary_join_element_wise(words.take(pa.array(part // n % n)), words.take(pa.array(part % n)), JOIN),
                "cnt": pa.array(counts[lo:hi])})

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_words, n_langs = [], 0, 0, 0
        for langs, codes, texts in _sliced(batches):
            words, number, piece, text = words_of(texts)
            if not len(number):
                continue
            marked = _marked(frequent, _hashes(words))
            keep = marked[number]
            at = np.nonzero(keep[:-1] & keep[1:] & (piece[:-1] == piece[1:]))[0]
            if not len(at):
                continue
            words, number = words.filter(pa.array(marked)), (np.cumsum(marked, dtype=np.int32) - 1)[number]
            # a pair's number takes 64 bits
            if size >= PAIRS or (n_words + len(words)) ** 2 * (n_langs + len(langs)) >= 1 << 63:
                if held:
                    yield from summed(held)
                held, size, n_words, n_langs = [], 0, 0, 0
            held.append((words, langs, (codes[text[at]].astype(np.int64) * len(words) + number[at]) * len(words) + number[at + 1]))
            size, n_words, n_langs = size + len(at), n_words + len(words), n_langs + len(langs)
        if held:
            yield from summed(held)

    return count_pairs


def _runs(keep: np.ndarray, joined: np.ndarray, max_words: int) -> np.ndarray:
    """How many words the record of each position has; ``joined`` says of each
    position but the last whether its record goes on to the next."""
    edge = np.nonzero(np.concatenate([[True], ~joined, [True]]))[0]
    at = np.arange(len(keep))
    return np.where(keep, np.minimum(edge[np.searchsorted(edge, at, side="right")] - at, max_words), 0)


def _records(frequent: np.ndarray, frequent_pairs: np.ndarray, max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts -> (lang, phrase, cnt) of their records of three words and more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, codes, texts in _sliced(batches):
            words, number, piece, text = words_of(texts)
            if not len(number):
                continue
            hashes = _hashes(words)
            keep = _marked(frequent, hashes)[number]
            joined = keep[:-1] & keep[1:] & (piece[:-1] == piece[1:])
            at = np.nonzero(joined)[0]
            joined[at] = _marked(frequent_pairs, _pair_keys(hashes, _hashes(langs)[codes[text[at]]], number, at))
            size = _runs(keep, joined, max_words)
            padded = np.concatenate([number.astype(np.int64), np.zeros(max_words, dtype=np.int64)])
            for lo in range(0, len(number), WINDOW):
                at = lo + np.nonzero(size[lo:lo + WINDOW] > 2)[0]
                if len(at):
                    yield _summed(words, langs, codes[text[at]].astype(np.int64), padded, at, size[at], max_words)

    return run


def _summed(words: pa.Array, langs: pa.Array, lang: np.ndarray, padded: np.ndarray, at: np.ndarray, size: np.ndarray, max_words: int) -> pa.RecordBatch:
    """Distinct records of some positions with their counts."""
    def column(k: int) -> np.ndarray | int:
        return np.where(size > k, padded[at + k] + 1, 0) if k < max_words else lang if k == max_words else 0

    keys = [(column(k) << 32) | column(k + 1) for k in range(0, max_words + 1, 2)]
    order = np.lexsort(keys)
    new = np.zeros(len(at), dtype=bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.nonzero(new)[0]
    counts = np.diff(np.append(first, len(at)))
    rows = order[first]
    parts, out_lang, out_cnt = [], [], []
    for length in range(2, max_words + 1):
        pick = size[rows] == length
        some = rows[pick]
        if len(some):
            columns_of = [words.take(pa.array(padded[at[some] + k])) for k in range(length)]
            parts.append(pc.binary_join_element_wise(*columns_of, JOIN))
            out_lang.append(lang[some])
            out_cnt.append(counts[pick])
    return pa.record_batch({"lang": langs.take(pa.array(np.concatenate(out_lang))), "phrase": pa.concat_arrays(parts),
                            "cnt": pa.array(np.concatenate(out_cnt).astype(np.int64))})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= STRETCH:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _prefix_sums(min_count: int, max_words: int, least: int = 2) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records in prefix order -> counts of the phrases of ``least`` words and
    more that they begin with: those of ``min_count`` and the parts at either
    end of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches):
            lang = t.column("lang").combine_chunks()
            lang_number = lang.dictionary_encode().indices.to_numpy()
            cnt = t.column("cnt").to_numpy()
            words = pc.split_pattern(t.column("phrase").combine_chunks(), JOIN)
            offsets = words.offsets.to_numpy()
            flat = words.flatten().dictionary_encode()
            size = np.diff(offsets)
            at = np.repeat(np.arange(len(cnt)), size)
            grid = np.full((len(cnt), max_words + 1), -1, dtype=np.int32)
            grid[:, 0] = lang_number
            grid[at, 1 + np.arange(len(at)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat.indices.to_numpy()
            for length in range(least, max_words + 1):
                rows = np.nonzero(size >= length)[0]
                if not len(rows):
                    break
                part = grid[rows, :length + 1]
                first = np.nonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)]))[0]
                sums = np.add.reduceat(cnt[rows], first)
                out = sums >= min_count
                out[[0, -1]] = True
                chosen = rows[first[out]]
                spelled = [flat.dictionary.take(pa.array(grid[chosen, k])) for k in range(1, length + 1)]
                yield pa.record_batch({
                    "lang": lang.take(pa.array(chosen)),
                    "phrase": pc.binary_join_element_wise(*spelled, JOIN),
                    "size": pa.array(np.full(len(chosen), length, dtype=np.int32)),
                    "cnt": pa.array(sums[out].astype(np.int64)),
                })

    return run


def _leading(words: str, size: str) -> Column:
    return F.expr(f"array_join(slice({words}, 1, {size}), '\\0')")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, n): word occurrences; and the count stream (lang, phrase, size,
    cnt): every phrase of 1 to ``max_words`` words with ``min_count``
    occurrences, its words joined by a zero byte."""
    ship(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    # a batch is one slice: it is held by the JVM, on the way and in Python at once
    with small_batches(docs.sparkSession, SLICE_BYTES):
        counts = materialise(src.mapInArrow(_word_counts, "lang string, word binary, cnt long").groupBy("lang", "word").agg(F.sum("cnt").alias("cnt")), "words")
        totals = counts.groupBy("lang").agg(F.sum("cnt").alias("n"))
        frequent = _bitmap(counts.filter(F.col("cnt") >= min_count).select("word").mapInArrow(_word_keys, "key long"))
        pairs = src.mapInArrow(_pairs(frequent), "lang string, phrase binary, cnt long").groupBy("lang", "phrase").agg(F.sum("cnt").alias("cnt"))
        pairs = materialise(pairs.filter(F.col("cnt") >= min_count), "pairs")
        frequent_pairs = _bitmap(pairs.select("lang", "phrase").mapInArrow(_spelled_pair_keys, "key long"))
        records = materialise(src.mapInArrow(_records(frequent, frequent_pairs, max_words), "lang string, phrase binary, cnt long"), "records")
        ordered = records.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
        parts = ordered.mapInArrow(_prefix_sums(min_count, max_words, 3), "lang string, phrase binary, size int, cnt long")
        single = counts.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "cnt")
        double = pairs.filter(F.lit(max_words) >= 2).select("lang", "phrase", F.lit(2).alias("size"), "cnt")
        stream = parts.groupBy("lang", "phrase", "size").agg(F.sum("cnt").alias("cnt")).union(double).union(single).filter(F.col("cnt") >= min_count)
        return totals, materialise(stream.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 subsumed_pct: int = 100, top: int | None = TOP) -> DataFrame:
    """Per language the phrases of 2 to ``max_words`` words with ``min_count``
    occurrences, scored by their weakest cut, without those that a longer
    candidate holds in ``subsumed_pct`` per cent of their occurrences:
    lang, rank, phrase, a, l, r, n, score, cut (words in the first part)."""
    totals, stream = frequent_phrases(docs, text_col, lang_col, min_count, max_words)
    words = F.split("phrase", "\\x00", -1)
    candidates = stream.filter("size >= 2").select("lang", "phrase", "size", F.col("cnt").alias("a"), words.alias("w"))

    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _leading("w", "cut").alias("first"), F.expr("array_join(slice(w, cut + 1, size), '\\0')").alias("rest"))
    left = stream.select("lang", F.col("phrase").alias("first"), F.col("cnt").alias("l")).hint("merge")
    right = stream.select("lang", F.col("phrase").alias("rest"), F.col("cnt").alias("r")).hint("merge")
    big = "decimal(38,0)"
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
              .withColumn("score", F.expr(f"(cast(1000 as {big}) * cast(a as decimal(19,0)) * n) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("c")).select("lang", "phrase", "c.*")

    longer = candidates.filter("size >= 3").select(
        "lang", F.explode(F.array(_leading("w", "size - 1"), F.expr("array_join(slice(w, 2, size - 1), '\\0')"))).alias("phrase"), F.col("a").alias("held"))
    held = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held")).hint("merge")
    kept = (weakest.join(held, ["lang", "phrase"], "left")
            .filter(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * subsumed_pct))
            .withColumn("phrase", _shown("phrase")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = kept.withColumn("rank", rank.cast("long"))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
