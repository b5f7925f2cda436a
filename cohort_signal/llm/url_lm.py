"""URL filter: rules first, then a character language-model ratio.

URLs that a rule decides are the accepted and rejected examples.  Two
variable-order Markov models (orders 0 to MAX_ORDER, Witten-Bell interpolation)
are counted over all of them; a URL without a rule is judged by the difference
of its log-likelihoods under both models, divided by its length, against a
cut that gives the best balanced accuracy on examples kept out of the counts
(an eighth, by hash).

The counts are a Spark table keyed by the exact characters (bytes, the end and
the filling before the start are symbols of their own), so it grows with the
URLs.  A table of one order is the sum of the next higher one's by its last
characters; probabilities go up the orders by joins in which a key meets at
most SYMBOLS + 1 rows.  URLs to score are dealt into blocks of 2^BLOCK_BITS
rows, and a block asks for each of its grams once, so that a gram all URLs
hold is one row a block.  The driver gets two sums of counts and 2 x BINS
calibration counts.

Edge cases: a null URL or one without ``://`` has an empty host and path and no
rule; a null or empty URL is blocked by the method (nothing speaks for it);
without examples of either kind the ratio is 0, and 0 is allowed; rows that
repeat are each judged; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, slices

MAX_ORDER = 4
#: The 256 bytes and the end; PAD stands in contexts only.
SYMBOLS = 257
END, PAD = 256, 257
SYMBOL_BITS = 9
#: log2 of the URLs that are scored together.
BLOCK_BITS = 12
CALIBRATION = 8
BINS, BIN_RANGE = 2000, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # verdict, host/path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all characters (and the end) of all URLs: URL number, and the
    character after the MAX_ORDER before it, SYMBOL_BITS bits each."""
    lengths = np.array([len(u) + 1 for u in urls])
    ends = np.cumsum(lengths + MAX_ORDER)
    joined = np.full(ends[-1], PAD, np.int64)
    owner = np.repeat(np.arange(len(urls)), lengths)
    at = np.arange(len(owner)) + (owner + 1) * MAX_ORDER
    inside = np.ones(len(owner), bool)
    inside[np.cumsum(lengths) - 1] = False
    joined[at[inside]] = np.frombuffer(b"".join(urls), np.uint8)
    joined[ends - 1] = END
    gram = np.zeros(len(at), np.int64)
    for back in range(MAX_ORDER, -1, -1):
        gram = gram << SYMBOL_BITS | joined[at - back]
    return owner, gram


def _urls(batch: pa.RecordBatch | pa.Table) -> list[bytes]:
    return [u or b"" for u in batch.column("url").cast(pa.binary()).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1 << BLOCK_BITS):
        good = np.asarray(batch.column("accepted").to_pylist(), bool)
        owner, gram = _grams(_urls(batch))
        grams, back = np.unique(gram, return_inverse=True)
        counts = [np.bincount(back, good[owner] == kind, minlength=len(grams)).astype(np.int64) for kind in (True, False)]
        yield pa.record_batch({"gram": pa.array(grams), "accepted": pa.array(counts[0]), "rejected": pa.array(counts[1])})


def _asked(t: pa.Table) -> pa.Table:
    """The distinct grams of a block."""
    grams = np.unique(_grams(_urls(t))[1])
    return pa.table({"block": pa.array(np.full(len(grams), t.column("block")[0].as_py(), np.int64)), "gram": pa.array(grams)})


_SCORED = "page_id long, url string, host string, path string, accepted boolean, ratio double"


def _ratios(t: pa.Table, scores: pa.Table) -> pa.Table:
    """Length-normalised log-likelihood difference; 0 for empty URLs."""
    urls = _urls(t)
    ratio = np.zeros(len(urls))
    if urls:
        owner, gram = _grams(urls)
        known, diff = scores.column("gram").to_numpy(), scores.column("diff").to_numpy()
        order = np.argsort(known)
        diff = diff[order][np.searchsorted(known[order], gram)]
        ratio = np.bincount(owner, diff, minlength=len(urls)) / np.bincount(owner, minlength=len(urls))
        ratio[[not u for u in urls]] = 0.0
    return t.drop_columns(["block"]).append_column("ratio", pa.array(ratio, pa.float64()))


def gram_scores(counts: DataFrame) -> DataFrame:
    """counts: (gram, accepted, rejected), a row per gram, zeros included.
    (gram, diff): difference of the log-probabilities of a gram's last
    character under the models of both kinds of counts."""
    levels = [counts]
    for order in range(MAX_ORDER - 1, -1, -1):
        tail = F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (order + 1)) - 1)
        levels.append(materialise(levels[-1].groupBy(tail.alias("gram")).agg(*[F.sum(k).alias(k) for k in ("accepted", "rejected")]), "grams"))
    context = Window.partitionBy(F.shiftright("gram", SYMBOL_BITS))
    out = None
    for order, level in enumerate(reversed(levels)):
        level = level.select("gram", "accepted", "rejected", *[
            f(c).over(context).alias(f"{k}_{n}") for k in ("accepted", "rejected")
            for n, f, c in (("total", F.sum, F.col(k)), ("kinds", F.count_if, F.col(k) > 0))])
        if out is None:
            p = {k: (F.col(k) + 0.5) / (F.col(f"{k}_total") + 0.5 * SYMBOLS) for k in ("accepted", "rejected")}
        else:
            lower = out.select(F.col("gram").alias("tail"), "accepted_p", "rejected_p")
            level = level.withColumn("tail", F.col("gram").bitwiseAND((1 << SYMBOL_BITS * order) - 1)).join(lower, "tail")
            p = {k: F.when(F.col(f"{k}_total") > 0, (F.col(k) + F.col(f"{k}_kinds") * F.col(f"{k}_p")) / (F.col(f"{k}_total") + F.col(f"{k}_kinds")))
                 .otherwise(F.col(f"{k}_p")) for k in ("accepted", "rejected")}
        out = level.select("gram", *[c.alias(f"{k}_p") for k, c in p.items()])
    return out.select("gram", (F.log("accepted_p") - F.log("rejected_p")).alias("diff"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where a rule decides)."""
    spark = pages.sparkSession
    ship(spark)
    verdicts = {text: verdict for verdict, text in rules}
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    src = src.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    src = src.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(by_rule)
    src = src.withColumn("by_rule", by_rule)
    src = src.withColumn("accepted", F.col("by_rule") == "allow")
    ruled = F.col("rule").isNotNull()
    aside = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0

    counted = src.filter(ruled & ~aside).select("url", "accepted").mapInArrow(_count, "gram long, accepted long, rejected long")
    # rows without a rule (accepted is null) and examples kept out of the counts
    todo = materialise(src.filter(~ruled | aside).select("page_id", "url", "host", "path", "accepted")
                       .withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "urls")
    asked = materialise(todo.select("block", "url").groupBy("block").applyInArrow(_asked, "block long, gram long"), "asked")
    zero = F.lit(0).cast("long")
    counts = materialise(counted.union(asked.select("gram", zero, zero)).groupBy("gram").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams")
    sums = counts.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).first()
    learned = bool(sums["accepted"] and sums["rejected"])

    scored, cut = todo.withColumn("ratio", F.lit(0.0)), 0.0
    if learned:
        diffs = asked.join(gram_scores(counts), "gram").select("block", "gram", "diff")
        scored = materialise(todo.groupBy("block").cogroup(diffs.groupBy("block")).applyInArrow(_ratios, _SCORED), "ratios")
        step = F.floor(F.greatest(F.least("ratio", F.lit(BIN_RANGE)), F.lit(-BIN_RANGE)) * F.lit(BINS / (2 * BIN_RANGE)))
        got = scored.filter("accepted is not null").groupBy("accepted", step.cast("long").alias("bin")).count().collect()
        cut = best_cut([(r["accepted"], r["bin"], r["count"]) for r in got])

    by_model = F.when((F.length(F.coalesce("url", F.lit(""))) > 0) & (F.col("ratio") >= cut), F.lit("allow")).otherwise(F.lit("block"))
    none = F.lit(None)
    by_lm = scored.filter("accepted is null").select("page_id", "host", "path", none.cast("string").alias("rule"), by_model.alias("verdict"), "ratio")
    return src.filter(ruled).select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), none.cast("double").alias("ratio")).union(by_lm)


def best_cut(counts: list[tuple[bool, int, int]]) -> float:
    """Lower edge of the bin from which on URLs are allowed, with the best
    balanced accuracy; the middle of the best range; 0 without both kinds."""
    half = BINS // 2
    hist = np.zeros((2, BINS + 1))
    for accepted, b, n in counts:
        hist[int(accepted), b + half] += n
    if not hist.sum(1).all():
        return 0.0
    kept = hist[1][::-1].cumsum()[::-1] / hist[1].sum()
    dropped = (hist[0].cumsum() - hist[0]) / hist[0].sum()
    value = kept + dropped
    best = np.nonzero(value >= value.max() - 1e-12)[0]
    return float((best[len(best) // 2] - half) * 2 * BIN_RANGE / BINS)
