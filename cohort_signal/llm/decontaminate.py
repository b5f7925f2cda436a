"""Benchmark decontamination by spaced-seed hashing.

A mask is a short span in which some token positions count and the others are
ignored; two places with equal counted tokens get equal hashes even if the
ignored tokens were substituted.  Hashes of all places of the benchmark items
are joined with those of the documents, and around each hit the two token
sequences are compared without gaps: the overlap counts when a window of
WINDOW tokens (the whole item, if shorter) that holds the hit has at least
AGREE of its tokens equal.

The masks find every overlap that reaches AGREE, whatever the places of the
substitutions (``tests/llm`` tries them all, for windows of MIN_ITEM to WINDOW
tokens).  Items of fewer than MIN_ITEM tokens must occur whole and unchanged:
their one hash is looked up among the document's windows of that length.

Scale: documents are read once and never shuffled.  Places whose hash is
surely not a benchmark hash are dropped in the scan by a bitmap of a fixed
2^BITS bits (built by a grouped bit_or, so the driver gets at most
2^(BITS - 6) numbers, and a larger benchmark only lets more places through);
what is left is joined exactly on the hash, each row with its own window of
token fingerprints, so that no text is read again.

Tokens: lower-cased, stripped of all but letters and digits; tokens without
either are skipped.  In scripts without spaces every character is a token.

Edge cases: null or empty texts and items match nothing; an item that is a
common phrase matches every document that holds it; rows with a null id are
left out; repeated rows give one result row; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CACHE_LIMIT, materialise, mix64, only, ship, slices, unused_name

#: 1: the token counts, 0: it is ignored.
MASKS = ("11111", "110111", "1101011")
WINDOW = 13
AGREE = 0.8
MIN_ITEM = 8
#: Masks for items of one size only, (mask, tokens): the pattern of ten tokens
#: with the middle two substituted, and short items as a whole.
SIZED = (("1111001", 10), *(("1" * n, n) for n in range(1, MIN_ITEM)))
ALL_MASKS = (*MASKS, *(m for m, _ in SIZED))
#: log2 of the bits in the bitmap of benchmark hashes (8 MB).
BITS = 26

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                  0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
_NOT_ALNUM = re.compile(r"[\W_]+")
#: Thai and Lao, Myanmar, Khmer, kana, Han (with extensions and compatibility forms), half-width kana.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


class _Tokens(dict):
    """white-space piece -> hash of its normal form, 0 if that is empty."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= WORD_CACHE_LIMIT:
            self.clear()
        word = _NOT_ALNUM.sub("", piece.lower())
        value = self[piece] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1 if word else 0
        return value


_TOKENS = _Tokens()


def token_hashes(text: str | None) -> np.ndarray:
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    pieces = text.split()
    h = np.fromiter(map(_TOKENS.__getitem__, pieces), dtype=np.uint64, count=len(pieces))
    return h[h != 0]


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.uint16).view(np.int16)


def masks_for(sizes: Iterable[int]) -> list[int]:
    """Numbers of the masks that items of these sizes are hashed with."""
    return [m for m in range(len(ALL_MASKS)) if any(n >= MIN_ITEM if m < len(MASKS) else n == SIZED[m - len(MASKS)][1] for n in sizes)]


def seed_hashes(h: np.ndarray, masks: Iterable[int]) -> list[tuple[int, np.ndarray]]:
    """(mask number, hash at each place where the mask fits)."""
    out = []
    for m in masks:
        mask = ALL_MASKS[m]
        n = len(h) - len(mask) + 1
        if n > 0:
            acc = np.full(n, m + 1, dtype=np.uint64)
            for i, at in enumerate(p for p, c in enumerate(mask) if c == "1"):
                acc += h[at:at + n] * _MULT[i]
            out.append((m, mix64(acc)))
    return out


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the bitmap."""
    return hashes >> np.uint64(64 - BITS), (hashes >> np.uint64(64 - 2 * BITS)) & np.uint64((1 << BITS) - 1)


_PLACES = "id long, n_tokens int, pos int, hash long, before array<short>, after array<short>"


def _places(bitmap: np.ndarray | None, masks: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of each text, with WINDOW token fingerprints on either side:
    ``before`` those left of the place, ``after`` those from it on.  With a
    bitmap those of a document that pass it, a short item's first one; without
    those of an item, by the masks for its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens", _TOKENS.clear)
        for batch in slices(batches):
            ids, sizes, poss, hashes, before, after = [], [], [], [], [], []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h = token_hashes(text)
                f = None
                for m, s in seed_hashes(h, masks if bitmap is not None else masks_for([len(h)])):
                    at = np.arange(len(s))
                    if bitmap is not None:
                        x, y = _bits(s)
                        hit = (bitmap[x >> np.uint64(6)] >> (x & np.uint64(63))) & (bitmap[y >> np.uint64(6)] >> (y & np.uint64(63))) & np.uint64(1)
                        at = np.nonzero(hit)[0]
                        if len(at) > 1 and "0" not in ALL_MASKS[m] and m >= len(MASKS):
                            at = at[np.unique(s[at], return_index=True)[1]]
                    if not len(at):
                        continue
                    f = _fingerprints(h) if f is None else f
                    for p in at.tolist():
                        ids.append(id_)
                        sizes.append(len(h))
                        poss.append(p)
                        hashes.append(s[p])
                        before.append(f[max(0, p - WINDOW):p])
                        after.append(f[p:p + WINDOW])
            if ids:
                yield pa.record_batch({
                    "id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int32()), "pos": pa.array(poss, pa.int32()),
                    "hash": pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                    "before": pa.array(before, pa.list_(pa.int16())), "after": pa.array(after, pa.list_(pa.int16()))})

    return run


def best_window(doc_before: np.ndarray, doc_after: np.ndarray, item_before: np.ndarray, item_after: np.ndarray, width: int) -> tuple[int, int]:
    """Of the windows of ``width`` tokens that hold the hit's first token and
    lie inside both sequences: the most equal tokens, and that window's start
    relative to the hit.  (0, 0) if none fits."""
    b = min(len(doc_before), len(item_before))
    a = min(len(doc_after), len(item_after))
    if a + b < width:
        return 0, 0
    same = np.concatenate([doc_before[len(doc_before) - b:] == item_before[len(item_before) - b:], doc_after[:a] == item_after[:a]])
    sums = np.cumsum(np.concatenate([[0], same]))
    counts = sums[width:] - sums[:-width]
    counts = counts[:b + 1]
    k = int(np.argmax(counts))
    return int(counts[k]), k - b


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        cols = {c: batch.column(c).to_pylist() for c in ("doc_id", "item_id", "pos", "item_tokens")}
        parts = [[np.asarray(x, dtype=np.int16) for x in batch.column(c).to_pylist()] for c in ("before", "after", "i_before", "i_after")]
        rows = []
        for k, (doc, item, pos, size) in enumerate(zip(*cols.values())):
            width = min(WINDOW, size)
            n, at = best_window(parts[0][k], parts[1][k], parts[2][k], parts[3][k], width)
            if n >= (AGREE * width if size >= MIN_ITEM else width):
                rows.append((doc, item, pos + at, n, width))
        if rows:
            yield pa.record_batch(dict(zip(("doc_id", "item_id", "start", "matched", "width"),
                                           map(pa.array, zip(*rows)))), schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("matched", pa.int64()), ("width", pa.int64())]))


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of all hashes; at most 2^(BITS - 6) rows reach the driver."""
    top, low = F.shiftrightunsigned("hash", 64 - BITS), F.shiftrightunsigned("hash", 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    bit = F.explode(F.array(top, low)).alias("bit")
    words = (seeds.select(bit).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    if words.num_rows:
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id,
    first_token (of the first verified window, in tokens of the document),
    matched and width (equal tokens and size of the best window), hits (verified
    places; one for an item of fewer than MIN_ITEM tokens)."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("id is not null")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text")).filter("id is not null")
    seeds = materialise(items.mapInArrow(_places(None, []), _PLACES), "seeds")
    sizes = seeds.select(F.least("n_tokens", F.lit(WINDOW)).alias("n")).distinct().collect()
    masks = masks_for([r["n"] for r in sizes])
    bitmap = _bitmap(seeds)
    shared = spark.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _places(shared.value, masks)(batches)

    hits = texts.mapInArrow(scan, _PLACES)
    found = (hits.select("hash", F.col("id").alias("doc_id"), "pos", "before", "after")
             .join(seeds.select("hash", F.col("id").alias("item_id"), F.col("n_tokens").alias("item_tokens"),
                                F.col("before").alias("i_before"), F.col("after").alias("i_after")), "hash")
             .mapInArrow(_verify, "doc_id long, item_id long, start long, matched long, width long"))
    return found.groupBy("doc_id", "item_id").agg(
        F.min("start").alias("first_token"), F.max("matched").alias("matched"), F.max("width").alias("width"),
        F.count(F.lit(1)).alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified overlap, all their columns kept."""
    bad_id = unused_name(docs, "bad_id")
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col(bad_id), "left_anti")
