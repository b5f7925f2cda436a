"""Cohort-shaped inputs derived from the test tables (recipes R1-R8).

Every builder is a lazy Spark plan over the parquet test tables, so its work
grows with the scale factor.  Pivots are written as conditional aggregates
grouped by the entity key: one shuffle with map-side partial aggregation,
instead of the two aggregations ``groupBy().pivot()`` plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import table

# Order priority -> assessment column of the wide score table.
PRIORITY_COLUMNS = {
    "1-URGENT": "s_urgent",
    "2-HIGH": "s_high",
    "3-MEDIUM": "s_medium",
    "4-NOT SPECIFIED": "s_notspec",
    "5-LOW": "s_low",
}
SCORE_COLUMNS = list(PRIORITY_COLUMNS.values())
SCORE_DIVISOR = 5000.0

# Ordered assessment groups ("courses") of the exam table and
# the day-of-month that separates the midterm half from the final half.
COURSES = ["signup", "view", "click", "error", "purchase"]
MIDTERM_LAST_DAY = 15
EXAM_COLUMNS = [f"{c}_{part}" for c in COURSES for part in ("midterm", "final")]

# Outcome threshold and the held-out (current) cohort rule.
OUTCOME_THRESHOLD = 4500.0
HOLDOUT_MODULUS = 6

# Raw gradebook layout.
GRADEBOOK_EXAM_COLUMN = "Final Exam Score"
GRADEBOOK_ID_RANGE = (100, 1200)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))


def wide_scores(spark: SparkSession, sf_dir: str, with_name: bool = True) -> DataFrame:
    """Mean order value / 5000 per customer and priority, one column per
    priority; customers lacking a priority get a null (a real gap)."""
    orders = table(spark, sf_dir, "orders")
    value = F.col("o_totalprice") / F.lit(SCORE_DIVISOR)
    wide = orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(*[
        F.avg(F.when(F.col("o_orderpriority") == prio, value)).alias(col)
        for prio, col in PRIORITY_COLUMNS.items()
    ])
    if not with_name:
        return wide
    return wide.join(names(spark, sf_dir), "entity_id", "left").select(
        "entity_id", "name", *SCORE_COLUMNS)


FLAG_COLUMNS = [c.replace("s_", "") + "_remediation" for c in SCORE_COLUMNS]


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R7 and the attempt counts of R4 from one scan of the orders and one
    aggregate: entity_id, score per priority, flag per priority, n_attempts."""
    orders = table(spark, sf_dir, "orders")
    prio, value = F.col("o_orderpriority"), F.col("o_totalprice") / F.lit(SCORE_DIVISOR)
    finished = (F.col("o_orderstatus") == "F").cast("int")
    return orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(
        *[F.avg(F.when(prio == p, value)).alias(c) for p, c in PRIORITY_COLUMNS.items()],
        *[F.max(F.when(prio == p, finished)).alias(c) for p, c in zip(PRIORITY_COLUMNS, FLAG_COLUMNS)],
        F.count_if(prio == "1-URGENT").alias("n_attempts"))


def course_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 in long form, one row per entity and course: entity_id, name, course,
    midterm, final; one scan of events and one of customers."""
    first_half = F.dayofmonth("ts") <= MIDTERM_LAST_DAY
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin(COURSES))
    scores = ev.groupBy(F.col("user_id").alias("entity_id"), F.col("event_type").alias("course")).agg(
        F.avg(F.when(first_half, F.col("value"))).alias("midterm"), F.avg(F.when(~first_half, F.col("value"))).alias("final"))
    return scores.join(names(spark, sf_dir), "entity_id", "left")


def exam_scores(spark: SparkSession, sf_dir: str, with_name: bool = True) -> DataFrame:
    """R2: per user, mean event value in the first half of the month
    (``<course>_midterm``) and in the second half (``<course>_final``)."""
    ev = table(spark, sf_dir, "events")
    first_half = F.dayofmonth("ts") <= MIDTERM_LAST_DAY
    aggs = []
    for course in COURSES:
        is_course = F.col("event_type") == course
        aggs.append(F.avg(F.when(is_course & first_half, F.col("value"))).alias(f"{course}_midterm"))
        aggs.append(F.avg(F.when(is_course & ~first_half, F.col("value"))).alias(f"{course}_final"))
    wide = ev.groupBy(F.col("user_id").alias("entity_id")).agg(*aggs)
    if not with_name:
        return wide
    return wide.join(names(spark, sf_dir), "entity_id", "left").select(
        "entity_id", "name", *EXAM_COLUMNS)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outcome = account balance, known for every key not divisible by 6
    (the multiples of 6 form the current cohort)."""
    return (table(spark, sf_dir, "customer")
            .filter(F.col("c_custkey") % HOLDOUT_MODULUS != 0)
            .select(F.col("c_custkey").alias("entity_id"),
                    F.col("c_acctbal").alias("outcome")))


def attempts(spark: SparkSession, sf_dir: str, urgent_only: bool = True) -> DataFrame:
    """The (urgent) orders of each customer as outcome attempts: (entity_id, attempt_no, attempt_date, score).

    The numbering window is partitioned by customer, so it runs in parallel
    over customers; (date, order key) makes the order total.
    """
    o = table(spark, sf_dir, "orders")
    if urgent_only:
        o = o.filter(F.col("o_orderpriority") == "1-URGENT")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return (o.withColumn("attempt_no", F.row_number().over(w))
            .select(F.col("o_custkey").alias("entity_id"),
                    F.col("attempt_no").cast("int").alias("attempt_no"),
                    F.to_date("o_orderdate").alias("attempt_date"),
                    F.col("o_totalprice").alias("score")))


def raw_gradebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw LMS-style gradebook as all-string columns.

    Every 10th login carries a note (``... - LOA``); score text is 'N/A' for
    keys divisible by 7, '' for keys divisible by 11, else the balance as
    text.  A 'Points Possible' pseudo-row and a test account are appended.
    """
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    login = F.when(key % 10 == 0, F.concat(F.col("c_name"), F.lit(" - LOA"))).otherwise(F.col("c_name"))
    score = (F.when(key % 7 == 0, F.lit("N/A"))
             .when(key % 11 == 0, F.lit(""))
             .otherwise(F.col("c_acctbal").cast("string")))
    rows = c.select(F.col("c_name").alias("Student"), login.alias("SIS Login ID"),
                    score.alias(GRADEBOOK_EXAM_COLUMN))
    extra = spark.createDataFrame(
        [("    Points Possible", None, "100"), ("Test Student", "Test#000000999", "50")],
        "Student string, `SIS Login ID` string, `Final Exam Score` string")
    return rows.unionByName(extra)


def course_gradebooks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """R5 for several courses: name -> gradebook, all columns text.  Course a
    is ``raw_gradebook``; b has other columns in another order and keys not
    divisible by 3; c counts each customer's orders, for keys divisible by 4;
    an older gradebook of course a sorts behind the current one."""
    a = raw_gradebook(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    final = F.when(key % 5 == 0, "N/A").otherwise(F.concat((key % 100).cast("string"), F.lit(".5")))
    b = c.filter(key % 3 != 0).select(F.col("c_name").alias("SIS Login ID"), F.lit("S1").alias("Section"),
                                      (F.col("c_nationkey") * 3).cast("string").alias("Midterm, part 1 (201)"),
                                      F.col("c_name").alias("Student"), final.alias("Final (202)"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("string").alias("Quiz"))
    quiz = c.filter(key % 4 == 0).join(n, "c_custkey").select(F.col("c_name").alias("Student"), "Quiz", F.concat(F.lit(" "), "c_name").alias("SIS Login ID"))
    old = c.select(F.col("c_name").alias("Student"), F.lit("0").alias(GRADEBOOK_EXAM_COLUMN), F.col("c_name").alias("SIS Login ID"))
    return {"course_a_gradebook": a, "course_a_gradebook_old": old, "course_b_gradebook": b, "course_c_gradebook": quiz}


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with four numeric text features over the whole
    text: characters, words, lines and digit share."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    text = F.coalesce(F.col("text"), F.lit(""))
    n_len = F.length(text)
    words = F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != ""))
    lines = F.size(F.split(text, "\n", -1))
    digits = n_len - F.length(F.regexp_replace(text, "[0-9]", ""))
    return (labels.join(docs, "doc_id", "inner")
            .select(F.col("doc_id").alias("entity_id"),
                    F.col("quality").cast("int").alias("label"),
                    F.col("n_chars").cast("double").alias("n_chars"),
                    words.cast("double").alias("n_words"),
                    lines.cast("double").alias("n_lines"),
                    F.try_divide(digits.cast("double"), n_len.cast("double")).alias("digit_share")))


def remediation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and priority, 1 if any order of that priority is
    finished ('F'), else 0; absent priority -> null."""
    o = table(spark, sf_dir, "orders")
    finished = (F.col("o_orderstatus") == "F").cast("int")
    return o.groupBy(F.col("o_custkey").alias("entity_id")).agg(*[
        F.max(F.when(F.col("o_orderpriority") == prio, finished)).alias(
            col.replace("s_", "") + "_remediation")
        for prio, col in PRIORITY_COLUMNS.items()
    ])


def retake_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``needed_retake`` = more than one urgent attempt, over entities
    with at least one attempt, joined to the wide scores."""
    return (order_facts(spark, sf_dir).select("entity_id", *SCORE_COLUMNS, "n_attempts")
            .filter(F.col("n_attempts") > 0)
            .withColumn("needed_retake", (F.col("n_attempts") > 1).cast("int")))
