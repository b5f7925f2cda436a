"""Catalogue: sources/sinks, cleaning, joins, set ops, aggregates, windows,
sorts and row features (S*, P*, J*, U*, A*, W*, O*, F1-F8)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import clean, rowwise
from ..functions.labels import risk_tier
from ..operators import attempts as att
from ..operators import cohort, features, profile, risk
from ..operators.linear import contiguous_fold
from ..operators.ranking import row_rank
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as fx
from ..sources import gradebooks, io
from .catalog import p6, query
from .oracle import (ATTEMPTS, CUR, EXAMS, EXAMS_NAMED, GRADEBOOK, MERGED, NAMED, OUTC, WIDE,
                     clip_sql, rev, row_mean_sql, row_var_sql, with_)

SC = list(fx.SCORE_COLUMNS)
EX = list(fx.EXAM_COLUMNS)
TH = float(fx.OUTCOME_THRESHOLD)
THS = f"{TH}::DOUBLE"
GB = fx.GRADEBOOK_EXAM_COLUMN
LO, HI = fx.GRADEBOOK_ID_RANGE
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def _scores(prefix: str = "") -> str:
    return ", ".join(f"{p6(prefix + c)} AS {c}" for c in SC)


def _exams(prefix: str = "") -> str:
    return ", ".join(f"{p6(prefix + c)} AS {c}" for c in EX)


# ---------------------------------------------------------------------------
# S: sources and sinks
# ---------------------------------------------------------------------------

@query("s1_read_assessments", "SELECT c_custkey AS entity_id, c_name AS name FROM customer")
def s1_read_assessments(spark: SparkSession, sf_dir: str):
    """Read a keyed table, validating the key column on the schema."""
    df = io.read_assessments(spark, f"{sf_dir}/customer.parquet", key="c_custkey")
    return df.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))


@query("s2_read_outcomes", with_(OUTC) + f"SELECT entity_id, {p6('outcome')} AS outcome FROM outc")
def s2_read_outcomes(spark: SparkSession, sf_dir: str):
    """Read the outcome table, validating key and outcome columns."""
    df = io.read_outcomes(spark, f"{sf_dir}/customer.parquet", key="c_custkey", outcome="c_acctbal")
    return (df.filter(F.col("c_custkey") % fx.HOLDOUT_MODULUS != 0)
            .select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("outcome")))


def _gradebook_files(spark: SparkSession, sf_dir: str) -> str:
    """Gradebooks of three courses, each with a header of its own, and an
    older one of the first course, in one scratch folder under the shared
    checkpoint folder."""
    path = scratch_path(spark, "gradebooks")
    for name, book in fx.course_gradebooks(spark, sf_dir).items():
        io.write_table(book, f"{path}/{name}", fmt="csv")
    return path


_NA = "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in io.DEFAULT_NA_TOKENS) + ")"


def _na(x: str) -> str:
    return f"CASE WHEN {x} IN {_NA} THEN NULL ELSE {x} END"


@query("s3_find_gradebook", with_(GRADEBOOK) + "SELECT " + ", ".join(
    f"{_na(c)} AS {c}" for c in ['"Student"', '"SIS Login ID"', '"Final Exam Score"']) + ", 'course_a_gradebook' AS source_file FROM gradebook")
def s3_find_gradebook(spark: SparkSession, sf_dir: str):
    """S3: of several gradebooks the first, by name, whose name contains the
    pattern, read under its own header and tagged with its name."""
    path = _gradebook_files(spark, sf_dir)
    name = gradebooks.choose(spark, path, ["course_a"])["course_a"]
    return io.read_raw_gradebook(spark, f"{path}/{name}").withColumn("source_file", F.lit(name))


@query("s4_read_gradebook_na", with_(GRADEBOOK) + "SELECT " + ", ".join(
    f"{_na(c)} AS {c}" for c in ['"Student"', '"SIS Login ID"', '"Final Exam Score"']) + " FROM gradebook")
def s4_read_gradebook_na(spark: SparkSession, sf_dir: str):
    """Gradebook CSV read as strings with the default NA tokens -> null."""
    path = _gradebook_files(spark, sf_dir)
    return io.read_raw_gradebook(spark, f"{path}/course_a_gradebook")


@query("s4b_read_gradebook_text", with_(GRADEBOOK) + 'SELECT "Student", "SIS Login ID", "Final Exam Score" FROM gradebook')
def s4b_read_gradebook_text(spark: SparkSession, sf_dir: str):
    """The same file keeping 'N/A' and '' as text; a null cell (written
    unquoted-empty) stays null, an empty text (written as "") stays ''."""
    path = _gradebook_files(spark, sf_dir)
    return io.read_raw_gradebook(spark, f"{path}/course_a_gradebook", keep_na_text=True)


@query("s5_attempts", with_(ATTEMPTS) + f"SELECT entity_id, attempt_no, strftime(attempt_date, '%Y-%m-%d') AS attempt_date, {p6('score')} AS score FROM attempts")
def s5_attempts(spark: SparkSession, sf_dir: str):
    """Attempts as an input table (entity, attempt_no, date, score)."""
    return fx.attempts(spark, sf_dir)


@query("s6_reread_merged", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, name, {_scores()}, {p6('outcome')} AS outcome FROM merged")
def s6_reread_merged(spark: SparkSession, sf_dir: str):
    """S6 + S7: write the merged table as parquet, read it back."""
    _, _, merged = _merged(spark, sf_dir)
    path = io.write_table(merged, scratch_path(spark, "merged"))
    return io.read_assessments(spark, path, key="entity_id")


@query("s7_write_csv", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, name, {_scores()}, {p6('outcome')} AS outcome FROM merged")
def s7_write_csv(spark: SparkSession, sf_dir: str):
    """Write the merged table as headed CSV, read its text back and give
    it the types that were written."""
    _, _, merged = _merged(spark, sf_dir)
    path = io.write_table(merged, scratch_path(spark, "merged_csv"), fmt="csv")
    return io.with_types(io.read_assessments(spark, path, fmt="csv", key="entity_id"), merged.schema)


def _merged(spark, sf_dir, keep: bool = False):
    """Wide scores, outcomes, their merge; ``keep`` writes the wide table once
    for queries that read it twice."""
    wide = cut_lineage(fx.wide_scores(spark, sf_dir)) if keep else fx.wide_scores(spark, sf_dir)
    out = fx.outcomes(spark, sf_dir)
    return wide, out, cohort.merge(wide, out)


A8 = ("a8 AS (SELECT entity_id, count(*)::INTEGER AS total_attempts, max(score) AS best_score, "
      "arg_min(score, attempt_no) AS first_score, arg_max(score, attempt_no) AS latest_score, "
      + ", ".join(f"max(CASE WHEN attempt_no = {i} THEN attempt_date END) AS attempt{i}_date, max(CASE WHEN attempt_no = {i} THEN score END) AS attempt{i}_score" for i in (1, 2, 3))
      + " FROM attempts GROUP BY entity_id), "
      "a8s AS (SELECT *, CASE WHEN total_attempts >= 2 THEN latest_score - first_score END AS score_change FROM a8)")
A8_COLS = (["total_attempts"] + [f"{p6(c)} AS {c}" for c in ("best_score", "first_score", "latest_score", "score_change")]
           + [x for i in (1, 2, 3) for x in (f"strftime(attempt{i}_date, '%Y-%m-%d') AS attempt{i}_date", f"{p6(f'attempt{i}_score')} AS attempt{i}_score")])


# ---------------------------------------------------------------------------
# P: cleaning of the raw gradebook and cohort predicates
# ---------------------------------------------------------------------------

P1 = f"p1 AS (SELECT * FROM gradebook WHERE NOT coalesce(starts_with({strip(chr(34) + 'Student' + chr(34))}, 'Points Possible'), false))"
P3 = ("p3 AS (SELECT *, nullif(regexp_extract(\"SIS Login ID\", '([0-9]+)', 1), '') AS id_text FROM p1 "
      "WHERE \"Student\" IS NOT NULL)")
P5 = f"p5 AS (SELECT *, TRY_CAST({strip('id_text')} AS DOUBLE)::BIGINT AS entity_id FROM p3 WHERE TRY_CAST({strip('id_text')} AS DOUBLE) IS NOT NULL)"
P7 = f"p7 AS (SELECT * FROM p5 WHERE entity_id BETWEEN {LO} AND {HI} AND NOT coalesce(regexp_matches(\"Student\", '(?i)test'), false))"
P10 = (f"p10 AS (SELECT entity_id, regexp_replace({strip(chr(34) + 'Student' + chr(34))}, '^\"+|\"+$', '', 'g') AS name, "
       f"TRY_CAST({strip(chr(34) + GB + chr(34))} AS DOUBLE) AS final_exam, NULL::DOUBLE AS midterm_exam FROM p7)")


def _gb(spark, sf_dir):
    return fx.raw_gradebook(spark, sf_dir)


@query("p1_drop_points_possible", with_(GRADEBOOK, P1) + "SELECT * FROM p1")
def p1_drop_points_possible(spark: SparkSession, sf_dir: str):
    """Drop the 'Points Possible' pseudo-row (whitespace-stripped prefix)."""
    return clean.drop_points_possible(_gb(spark, sf_dir))


@query("p2_drop_null_names", with_(GRADEBOOK, P1) + "SELECT * FROM p1 WHERE \"Student\" IS NOT NULL")
def p2_drop_null_names(spark: SparkSession, sf_dir: str):
    """Drop rows without a name."""
    return clean.drop_null(clean.drop_points_possible(_gb(spark, sf_dir)), ["Student"])


@query("p3_extract_id", with_(GRADEBOOK, P1, P3) + "SELECT \"Student\", id_text FROM p3")
def p3_extract_id(spark: SparkSession, sf_dir: str):
    """First digit run of the login text."""
    df = clean.drop_null(clean.drop_points_possible(_gb(spark, sf_dir)), ["Student"])
    return df.select("Student", clean.first_digit_run("SIS Login ID").alias("id_text"))


@query("p4_to_number", with_(GRADEBOOK) + f"SELECT \"Student\", {p6('TRY_CAST(' + strip(chr(34) + GB + chr(34)) + ' AS DOUBLE)')} AS score FROM gradebook")
def p4_to_number(spark: SparkSession, sf_dir: str):
    """Score text -> double, unparsable -> null."""
    return _gb(spark, sf_dir).select("Student", clean.to_number(GB).alias("score"))


def _ids(spark, sf_dir):
    df = clean.drop_null(clean.drop_points_possible(_gb(spark, sf_dir)), ["Student"])
    df = df.withColumn("entity_id", clean.entity_id("SIS Login ID"))
    return clean.drop_null(df, ["entity_id"]).withColumn("entity_id", F.col("entity_id").cast("long"))


@query("p5_ids_as_long", with_(GRADEBOOK, P1, P3, P5) + "SELECT \"Student\", entity_id FROM p5")
def p5_ids_as_long(spark: SparkSession, sf_dir: str):
    """P5: drop rows without a numeric id; id as long."""
    return _ids(spark, sf_dir).select("Student", "entity_id")


@query("p6_id_range", with_(GRADEBOOK, P1, P3, P5) + f"SELECT \"Student\", entity_id FROM p5 WHERE entity_id BETWEEN {LO} AND {HI}")
def p6_id_range(spark: SparkSession, sf_dir: str):
    """Keep ids in the valid inclusive range."""
    return _ids(spark, sf_dir).filter(clean.in_range("entity_id", LO, HI)).select("Student", "entity_id")


@query("p7_drop_test_accounts", with_(GRADEBOOK, P1, P3, P5, P7) + "SELECT \"Student\", entity_id FROM p7")
def p7_drop_test_accounts(spark: SparkSession, sf_dir: str):
    """Drop names containing 'test' (any case)."""
    df = _ids(spark, sf_dir).filter(clean.in_range("entity_id", LO, HI))
    return df.filter(~clean.is_test_account("Student")).select("Student", "entity_id")


def _extracted(spark, sf_dir):
    df = _ids(spark, sf_dir).filter(clean.in_range("entity_id", LO, HI)).filter(~clean.is_test_account("Student"))
    return df.select("entity_id", clean.clean_name("Student").alias("name"),
                     *clean.rename_or_null(df, {"final_exam": GB, "midterm_exam": "Midterm Exam Score"}))


@query("p8_clean_name", with_(GRADEBOOK, P1, P3, P5, P7, P10) + "SELECT entity_id, name FROM p10")
def p8_clean_name(spark: SparkSession, sf_dir: str):
    """Strip whitespace then quotes from the name."""
    return _extracted(spark, sf_dir).select("entity_id", "name")


@query("p9_rename_exams", with_(GRADEBOOK, P1, P3, P5, P7, P10) + f"SELECT entity_id, {p6('final_exam')} AS final_exam, midterm_exam FROM p10")
def p9_rename_exams(spark: SparkSession, sf_dir: str):
    """Raw exam columns -> friendly names; an absent column -> typed nulls."""
    return _extracted(spark, sf_dir).select("entity_id", "final_exam", "midterm_exam")


@query("p10_extract_gradebook", with_(GRADEBOOK, P1, P3, P5, P7, P10) + f"SELECT entity_id, name, {p6('final_exam')} AS final_exam, midterm_exam FROM p10")
def p10_extract_gradebook(spark: SparkSession, sf_dir: str):
    """P1-P10 chained: the cleaned per-course table (key, name, exams)."""
    return _extracted(spark, sf_dir)


@query("p11_numeric_features", with_(WIDE, NAMED, OUTC, MERGED) + "SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM merged) "
       "WHERE (column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE', 'DECIMAL') OR column_type LIKE 'DECIMAL%') AND column_name NOT IN ('entity_id', 'name', 'outcome')")
def p11_numeric_features(spark: SparkSession, sf_dir: str):
    """Numeric columns of the merged table except key/name/outcome."""
    from ..operators.select import numeric_features
    _, _, merged = _merged(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in numeric_features(merged)], "feature string")


@query("p12_name_rule_features", with_(EXAMS, ATTEMPTS, A8) + "SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM exams FULL OUTER JOIN a8s USING (entity_id)) "
       "WHERE (column_name LIKE '%midterm%' OR column_name LIKE '%final%') AND column_name NOT LIKE '%outcome%' AND column_name NOT LIKE '%date%' "
       "AND column_name NOT LIKE '%attempt%' AND column_name NOT LIKE '%score%'")
def p12_name_rule_features(spark: SparkSession, sf_dir: str):
    """Columns named like midterm/final, excluding outcome/date columns."""
    from ..operators.select import exam_features
    full = cohort.outer_merge(fx.exam_scores(spark, sf_dir), att.attempt_summary(fx.attempts(spark, sf_dir)))
    return spark.createDataFrame([(c,) for c in exam_features(full.columns)], "feature string")


EXAM_OUT = f"exam_out AS (SELECT * FROM exams_named e FULL OUTER JOIN outc o USING (entity_id))"


def _exam_out(spark, sf_dir):
    return cohort.outer_merge(fx.exam_scores(spark, sf_dir), fx.outcomes(spark, sf_dir))


@query("p13_known_outcome", with_(EXAMS, EXAMS_NAMED, OUTC, EXAM_OUT) + f"SELECT entity_id, {_exams()}, {p6('outcome')} AS outcome FROM exam_out WHERE outcome IS NOT NULL")
def p13_known_outcome(spark: SparkSession, sf_dir: str):
    """Keep rows with a known outcome."""
    return cohort.known_outcome(_exam_out(spark, sf_dir)).select("entity_id", *EX, "outcome")


@query("p14_complete_cases", with_(EXAMS, EXAMS_NAMED, OUTC, EXAM_OUT) + f"SELECT entity_id, {_exams()}, {p6('outcome')} AS outcome FROM exam_out WHERE outcome IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in EX))
def p14_complete_cases(spark: SparkSession, sf_dir: str):
    """Complete cases on a feature set."""
    df = cohort.known_outcome(_exam_out(spark, sf_dir))
    return clean.drop_null(df, EX).select("entity_id", *EX, "outcome")


@query("p15_pairwise_complete", with_(EXAMS, EXAMS_NAMED, OUTC, EXAM_OUT) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NOT NULL AND outcome IS NOT NULL) AS n_pairs FROM exam_out" for c in EX))
def p15_pairwise_complete(spark: SparkSession, sf_dir: str):
    """Per feature, rows where feature and outcome are both present."""
    long = profile.unpivot(_exam_out(spark, sf_dir), ["outcome"], EX)
    return long.groupBy("feature").agg(F.count_if(F.col("value").isNotNull() & F.col("outcome").isNotNull()).alias("n_pairs"))


@query("p16_cohort_partition", with_(EXAMS, OUTC) + "SELECT entity_id, CASE WHEN e.entity_id IS NOT NULL AND o.entity_id IS NOT NULL THEN 'both' WHEN e.entity_id IS NOT NULL THEN 'assessments_only' ELSE 'outcome_only' END AS cohort FROM (SELECT entity_id, entity_id AS eid FROM exams) e FULL OUTER JOIN (SELECT entity_id, entity_id AS oid FROM outc) o USING (entity_id)".replace("e.entity_id IS NOT NULL AND o.entity_id IS NOT NULL", "eid IS NOT NULL AND oid IS NOT NULL").replace("WHEN e.entity_id IS NOT NULL", "WHEN eid IS NOT NULL"))
def p16_cohort_partition(spark: SparkSession, sf_dir: str):
    """Both / assessments_only / outcome_only over the full outer join."""
    e = fx.exam_scores(spark, sf_dir, with_name=False).select("entity_id", F.lit(True).alias("_e"))
    o = fx.outcomes(spark, sf_dir).select("entity_id", F.lit(True).alias("_o"))
    j = cohort.outer_merge(e, o)
    return j.select("entity_id", cohort.cohort_partition(F.col("_e").isNotNull(), F.col("_o").isNotNull()).alias("cohort"))


@query("p17_remediation_flag", with_(GRADEBOOK) + f"SELECT \"Student\", CASE WHEN \"{GB}\" IS NULL THEN 0 ELSE (NOT {strip(chr(34) + GB + chr(34))} IN ('N/A', 'nan', '', '0', '0.0'))::INTEGER END AS flag FROM gradebook")
def p17_remediation_flag(spark: SparkSession, sf_dir: str):
    """Remediation text -> 0/1 flag."""
    return _gb(spark, sf_dir).select("Student", clean.remediation_flag(GB).alias("flag"))


RETAKE = ("retake AS (SELECT entity_id, count(*) AS n_attempts FROM attempts GROUP BY entity_id), "
          "rl AS (SELECT w.*, r.n_attempts, (r.n_attempts > 1)::INTEGER AS needed_retake FROM wide w JOIN retake r USING (entity_id) WHERE r.n_attempts > 0)")


@query("p18_retake_flag", with_(WIDE, ATTEMPTS, RETAKE) + "SELECT entity_id, n_attempts, needed_retake FROM rl")
def p18_retake_flag(spark: SparkSession, sf_dir: str):
    """needed_retake = more than one attempt (entities with >= 1)."""
    return fx.retake_labels(spark, sf_dir).select("entity_id", "n_attempts", "needed_retake")


@query("p19_pass_flag", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, outcome >= {THS} AS passed FROM merged")
def p19_pass_flag(spark: SparkSession, sf_dir: str):
    """Outcome at or above the threshold."""
    _, _, m = _merged(spark, sf_dir)
    return m.select("entity_id", cohort.pass_flag("outcome", TH).alias("passed"))


@query("p20_display_name", "SELECT DISTINCT event_type, array_to_string(list_transform(string_split(replace(replace(event_type || '_behavioral_science_final', 'behavioral_science', 'behav'), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display FROM events")
def p20_display_name(spark: SparkSession, sf_dir: str):
    """P20: display names of feature columns built from the event types."""
    ev = fx.table(spark, sf_dir, "events").select("event_type").distinct()
    feat = F.concat(F.col("event_type"), F.lit("_behavioral_science_final"))
    return ev.select("event_type", clean.display_name(feat, {"behavioral_science": "behav"}).alias("display"))


# ---------------------------------------------------------------------------
# J / U: joins and set operations
# ---------------------------------------------------------------------------

@query("j1_merge", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, name, {_scores()}, {p6('outcome')} AS outcome FROM merged")
def j1_merge(spark: SparkSession, sf_dir: str):
    """Inner join assessments x outcomes."""
    return _merged(spark, sf_dir)[2]


@query("j1_merge_counts", with_(WIDE, OUTC) + "SELECT count(w.entity_id) AS n_assessment_rows, count(o.entity_id) AS n_outcome_rows, count(*) FILTER (WHERE w.entity_id IS NOT NULL AND o.entity_id IS NOT NULL) AS n_merged, count(*) FILTER (WHERE w.entity_id IS NULL) AS n_outcome_lost FROM wide w FULL OUTER JOIN outc o ON w.entity_id = o.entity_id")
def j1_merge_counts(spark: SparkSession, sf_dir: str):
    """J1 bookkeeping: matched and lost counts in one aggregate."""
    return cohort.merge_counts(fx.wide_scores(spark, sf_dir, with_name=False), fx.outcomes(spark, sf_dir))


@query("j2_current_cohort", with_(WIDE, NAMED, OUTC, CUR) + f"SELECT entity_id, name, {_scores()} FROM cur")
def j2_current_cohort(spark: SparkSession, sf_dir: str):
    """Entities with assessments and no outcome (anti-join)."""
    return cohort.current_cohort(fx.wide_scores(spark, sf_dir), fx.outcomes(spark, sf_dir))


def _j3_sql() -> str:
    parts = [f"c_{c} AS (SELECT entity_id, name, {c}_midterm, {c}_final FROM exams_named WHERE {c}_midterm IS NOT NULL OR {c}_final IS NOT NULL)" for c in fx.COURSES]
    q = "j0 AS (SELECT * FROM c_signup)"
    chain = [q]
    prev = "j0"
    for i, c in enumerate(fx.COURSES[1:], start=1):
        chain.append(f"j{i} AS (SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.name, b.name) AS name, a.* EXCLUDE (entity_id, name), b.{c}_midterm, b.{c}_final FROM {prev} a FULL OUTER JOIN c_{c} b ON a.entity_id = b.entity_id)")
        prev = f"j{i}"
    return with_(EXAMS, EXAMS_NAMED, *parts, *chain) + f"SELECT entity_id, name, {_exams()} FROM {prev}"


@query("j3_nway_outer", _j3_sql())
def j3_nway_outer(spark: SparkSession, sf_dir: str):
    """N-way full outer join of the courses: rows tagged with their course,
    merged in one aggregate."""
    return cohort.merge_tagged(fx.course_scores(spark, sf_dir), "course", fx.COURSES, ["midterm", "final"]).select("entity_id", "name", *EX)


@query("j4_outer_attempts", with_(EXAMS, ATTEMPTS, A8) + f"SELECT entity_id, {_exams()}, " + ", ".join(A8_COLS) + " FROM exams FULL OUTER JOIN a8s USING (entity_id)")
def j4_outer_attempts(spark: SparkSession, sf_dir: str):
    """Full outer join of exams and the attempt summary."""
    s = att.attempt_summary(fx.attempts(spark, sf_dir))
    return cohort.outer_merge(fx.exam_scores(spark, sf_dir, with_name=False), s)


UPD = ("upd AS (SELECT o_custkey AS entity_id, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 5000.0 END) AS s_urgent, "
       "avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice / 5000.0 END) AS s_high FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)")


@query("j5_coalesce_update", with_(WIDE, UPD) + f"SELECT w.entity_id, {p6('coalesce(u.s_urgent, w.s_urgent)')} AS s_urgent, {p6('coalesce(u.s_high, w.s_high)')} AS s_high FROM wide w LEFT JOIN upd u USING (entity_id)")
def j5_coalesce_update(spark: SparkSession, sf_dir: str):
    """Re-run update: new values where present, old values kept."""
    base = fx.wide_scores(spark, sf_dir, with_name=False).select("entity_id", "s_urgent", "s_high")
    o = fx.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    v = F.col("o_totalprice") / F.lit(fx.SCORE_DIVISOR)
    upd = o.groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", v)).alias("s_urgent"),
        F.avg(F.when(F.col("o_orderpriority") == "2-HIGH", v)).alias("s_high"))
    return cohort.coalesce_update(base, upd, ["s_urgent", "s_high"])


@query("j6_attach_scores", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT m.entity_id, m.name, round_even(m.outcome, 0)::INTEGER AS predicted, {THS} AS threshold, {p6(rev(f'({THS} - round_even(m.outcome, 0)) / {THS}', 3))} AS risk_score, round_even(m.outcome, 0) < {THS} AS at_risk, {_scores('w.')} FROM merged m LEFT JOIN wide w USING (entity_id)")
def j6_attach_scores(spark: SparkSession, sf_dir: str):
    """Risk report left-joined back to raw scores (name not duplicated)."""
    wide, _, m = _merged(spark, sf_dir, keep=True)
    rep = risk.flag_at_risk(m.select("entity_id", "name", risk.rounded_prediction(F.col("outcome")).alias("predicted")), TH)
    return cohort.attach_scores(rep, wide)


FLAGS = "flags AS (SELECT o_custkey AS entity_id, " + ", ".join(
    f"max(CASE WHEN o_orderpriority = '{p}' THEN (o_orderstatus = 'F')::INTEGER END) AS {c.replace('s_', '')}_remediation"
    for p, c in fx.PRIORITY_COLUMNS.items()) + " FROM orders GROUP BY o_custkey)"
FLAG_COLS = [c.replace("s_", "") + "_remediation" for c in SC]


def _j7_sql():
    joins = " ".join(f"LEFT JOIN (SELECT entity_id, {c} FROM flags WHERE {c} IS NOT NULL) t{i} USING (entity_id)" for i, c in enumerate(FLAG_COLS))
    return with_(WIDE, FLAGS) + f"SELECT w.entity_id, {', '.join(FLAG_COLS)} FROM wide w {joins}"


@query("j7_many_left_joins", _j7_sql())
def j7_many_left_joins(spark: SparkSession, sf_dir: str):
    """Many narrow columns attached to a base: base and columns as tagged
    rows of one scan, one aggregate instead of N left joins."""
    tags = [F.struct(F.lit("base").alias("feature"), F.lit(1).alias("value")),
            *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in FLAG_COLS]]
    rows = fx.order_facts(spark, sf_dir).select("entity_id", F.explode(F.array(*tags)).alias("t")).select("entity_id", "t.*")
    return cohort.attach_tagged(rows.filter(F.col("value").isNotNull()), FLAG_COLS)


@query("u1_stack_cohorts", with_(WIDE, NAMED, OUTC, MERGED, CUR) + f"SELECT entity_id, name, {_scores()}, {p6('outcome')} AS outcome FROM merged UNION ALL SELECT entity_id, name, {_scores()}, NULL::DOUBLE AS outcome FROM cur")
def u1_stack_cohorts(spark: SparkSession, sf_dir: str):
    """Historical cohort stacked over the current one by column name."""
    wide, out, m = _merged(spark, sf_dir, keep=True)
    return cohort.stack_cohorts(m, cohort.current_cohort(wide, out))


@query("u2_distinct_keys", with_(ATTEMPTS) + "SELECT DISTINCT entity_id FROM (SELECT entity_id FROM attempts WHERE attempt_no = 1 UNION ALL SELECT entity_id FROM attempts WHERE attempt_no = 2 UNION ALL SELECT entity_id FROM attempts WHERE attempt_no = 3)")
def u2_distinct_keys(spark: SparkSession, sf_dir: str):
    """Distinct ids across the per-attempt rosters."""
    return cohort.distinct_members(fx.attempts(spark, sf_dir), "attempt_no", (1, 2, 3))


@query("u3_key_difference", with_(WIDE, OUTC) + "SELECT entity_id FROM wide EXCEPT SELECT entity_id FROM outc")
def u3_key_difference(spark: SparkSession, sf_dir: str):
    """Assessed keys minus outcome keys."""
    return cohort.key_difference(fx.wide_scores(spark, sf_dir, with_name=False), fx.outcomes(spark, sf_dir))


# ---------------------------------------------------------------------------
# A: aggregations
# ---------------------------------------------------------------------------

def _miss_sql(cols: list[str], only_missing: bool) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        f"{p6(rev(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)', 2))} AS missing_pct FROM named" for c in cols)
    return with_(WIDE, NAMED) + f"SELECT * FROM ({parts})" + (" WHERE missing_count > 0" if only_missing else "")


@query("a1_missing_report", _miss_sql(SC, True))
def a1_missing_report(spark: SparkSession, sf_dir: str):
    """A1: missing count and percent (2 dp) of columns with gaps, desc."""
    rep = features.missing_rates(fx.wide_scores(spark, sf_dir), SC)
    return rep.filter(F.col("missing_count") > 0).orderBy(F.col("missing_pct").desc(), "feature")


@query("a1b_missing_all", _miss_sql(["entity_id", "name"] + SC, False))
def a1b_missing_all(spark: SparkSession, sf_dir: str):
    """Missing report over all columns, unfiltered."""
    return features.missing_rates(fx.wide_scores(spark, sf_dir), ["entity_id", "name"] + SC)


def _describe_sql(cols, src_ctes, src):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + ", ".join(f"{p6(rev(e, 1))} AS {n}" for e, n in [
            (f"count({c})::DOUBLE", "count"), (f"avg({c})", "mean"), (f"stddev_samp({c})", "std"), (f"min({c})", "min"),
            (f"quantile_cont({c}, 0.25)", "p25"), (f"quantile_cont({c}, 0.5)", "p50"), (f"quantile_cont({c}, 0.75)", "p75"),
            (f"max({c})", "max")]) + f" FROM {src}" for c in cols)
    return with_(*src_ctes) + parts


@query("a2_describe", _describe_sql(EX, [EXAMS], "exams"))
def a2_describe(spark: SparkSession, sf_dir: str):
    """A2: describe() with exact quartiles, 1 dp."""
    return profile.describe(fx.exam_scores(spark, sf_dir, with_name=False), EX)


@query("a3_mean_median", with_(WIDE) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p6(f'avg({c})')} AS mean, {p6(f'quantile_cont({c}, 0.5)')} AS median FROM wide" for c in SC))
def a3_mean_median(spark: SparkSession, sf_dir: str):
    """A3: per-column mean and exact median."""
    return profile.mean_median(fx.wide_scores(spark, sf_dir, with_name=False), SC)


@query("a4_conditional_counts", with_(WIDE, NAMED, OUTC, MERGED) + (
    f"SELECT count(*) AS n, count(*) FILTER (WHERE outcome < {THS}) AS n_below, "
    f"{p6(f'avg((outcome < {THS})::INTEGER)')} AS share_below, "
    "count(*) FILTER (WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SC) + ") AS n_complete FROM merged"))
def a4_conditional_counts(spark: SparkSession, sf_dir: str):
    """A4: conditional counts and shares."""
    _, _, m = _merged(spark, sf_dir)
    complete = F.lit(True)
    for c in SC:
        complete = complete & F.col(c).isNotNull()
    below = F.col("outcome") < TH
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(below).alias("n_below"),
                 F.avg(below.cast("int")).alias("share_below"), F.count_if(complete).alias("n_complete"))


@query("a6_two_group_means", with_(WIDE, NAMED, OUTC, MERGED) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p6(f'avg({c}) FILTER (WHERE outcome < {THS})')} AS mean_0, "
    f"{p6(f'avg({c}) FILTER (WHERE outcome >= {THS})')} AS mean_1, "
    f"{p6(f'avg({c}) FILTER (WHERE outcome < {THS}) - avg({c}) FILTER (WHERE outcome >= {THS})')} AS diff FROM merged" for c in SC))
def a6_two_group_means(spark: SparkSession, sf_dir: str):
    """Per feature, mean in each of two groups and the difference."""
    _, _, m = _merged(spark, sf_dir)
    return profile.group_means(m.withColumn("passed", (F.col("outcome") >= TH).cast("int")), SC, "passed")


@query("a8_attempt_summary", with_(ATTEMPTS, A8) + "SELECT entity_id, " + ", ".join(A8_COLS) + " FROM a8s")
def a8_attempt_summary(spark: SparkSession, sf_dir: str):
    """Per-entity attempt summary with per-attempt columns."""
    return att.attempt_summary(fx.attempts(spark, sf_dir))


@query("a9_attempt_distribution", with_(ATTEMPTS, A8) + "SELECT total_attempts, count(*) AS n_entities FROM a8s GROUP BY total_attempts")
def a9_attempt_distribution(spark: SparkSession, sf_dir: str):
    """Entities per number of attempts."""
    return att.attempt_distribution(att.attempt_summary(fx.attempts(spark, sf_dir)))


EXO = with_(EXAMS, OUTC) + "SELECT * FROM exams LEFT JOIN outc USING (entity_id)"
EXO_CTE = f"exo AS (SELECT * FROM exams LEFT JOIN outc USING (entity_id))"


def _exo(spark, sf_dir):
    return fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id", "left")


def _corr_sql_expr(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop({a}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) END")


CORR_COLS = EX + ["outcome"]


@query("a10_corr_matrix", with_(EXAMS, OUTC, EXO_CTE) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {p6(_corr_sql_expr(a, b))} AS r FROM exo" for a in CORR_COLS for b in CORR_COLS))
def a10_corr_matrix(spark: SparkSession, sf_dir: str):
    """A10: pairwise-complete Pearson matrix (long form)."""
    return profile.corr_matrix(_exo(spark, sf_dir), CORR_COLS)


def _corr_target_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NOT NULL AND outcome IS NOT NULL) AS n, {p6(_corr_sql_expr(c, 'outcome'))} AS r FROM exo" for c in cols)


STRENGTH = "CASE WHEN abs(r) > 0.7 THEN 'STRONG' WHEN abs(r) > 0.4 THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' END"


@query("a11_corr_with_outcome", with_(EXAMS, OUTC, EXO_CTE) + f"SELECT feature, n, r, {STRENGTH} AS strength FROM ({_corr_target_sql(EX)})")
def a11_corr_with_outcome(spark: SparkSession, sf_dir: str):
    """Correlation with the outcome, with strength class."""
    return profile.ranked_correlations(_exo(spark, sf_dir), EX, "outcome")


def _hist_sql(col: str, src: str, bins: int, by: str | None = None) -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    span = f"(SELECT min({col}) AS lo, (max({col}) - min({col})) / {bins}.0 AS w FROM {src})"
    every = f"(SELECT {keys}unnest(range({bins}))::INTEGER AS bin FROM (SELECT {keys}1 AS one FROM {src} WHERE {col} IS NOT NULL {group if by else 'LIMIT 1'}))"
    counts = (f"(SELECT {keys}least(floor(({col} - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n FROM {src} CROSS JOIN {span} "
              f"WHERE {col} IS NOT NULL GROUP BY {keys}2 )" if by else
              f"(SELECT least(floor(({col} - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n FROM {src} CROSS JOIN {span} WHERE {col} IS NOT NULL GROUP BY 1)")
    on = f"USING ({keys}bin)"
    return (f"SELECT {keys}bin, {p6('lo + bin * w')} AS bin_lo, {p6('lo + (bin + 1) * w')} AS bin_hi, coalesce(n, 0)::BIGINT AS n "
            f"FROM {every} LEFT JOIN {counts} {on} CROSS JOIN {span}")


@query("a13_histogram", with_(WIDE, NAMED, OUTC, MERGED) + _hist_sql("outcome", "merged", 25))
def a13_histogram(spark: SparkSession, sf_dir: str):
    """25 equal-width bins of the outcome."""
    return profile.histogram(_merged(spark, sf_dir)[2], "outcome", 25)


@query("a13b_histogram_by_class", with_(WIDE, NAMED, OUTC, MERGED, f"mc AS (SELECT *, outcome >= {THS} AS passed FROM merged)") + _hist_sql("s_urgent", "mc", 15, "passed"))
def a13b_histogram_by_class(spark: SparkSession, sf_dir: str):
    """15 bins of a score, per pass class (shared edges)."""
    m = _merged(spark, sf_dir)[2].withColumn("passed", F.col("outcome") >= TH)
    return profile.histogram(m, "s_urgent", 15, by="passed")


@query("a14_trend_line", with_(WIDE, NAMED, OUTC, MERGED) + (
    "SELECT k::INTEGER AS k, " + p6("slope") + " AS slope, " + p6("intercept") + " AS intercept, "
    + p6("lo + k * (hi - lo) / 99.0") + " AS x, " + p6("intercept + slope * (lo + k * (hi - lo) / 99.0)") + " AS y_hat "
    "FROM (SELECT regr_slope(outcome, s_urgent) AS slope, regr_intercept(outcome, s_urgent) AS intercept, "
    "min(s_urgent) FILTER (WHERE outcome IS NOT NULL) AS lo, max(s_urgent) FILTER (WHERE outcome IS NOT NULL) AS hi FROM merged) "
    "CROSS JOIN range(0, 100) t(k)"))
def a14_trend_line(spark: SparkSession, sf_dir: str):
    """Degree-1 least-squares trend and its 100-point grid."""
    return profile.trend_line(_merged(spark, sf_dir)[2], "s_urgent", "outcome")


@query("a15_total_remediations", with_(FLAGS) + "SELECT entity_id, (" + " + ".join(f"coalesce({c}, 0)" for c in FLAG_COLS) + ")::INTEGER AS total_remediations FROM flags")
def a15_total_remediations(spark: SparkSession, sf_dir: str):
    """Row sum of remediation flags (null counted 0)."""
    f = fx.remediation_flags(spark, sf_dir)
    return f.select("entity_id", features.total_flags(FLAG_COLS).alias("total_remediations"))


@query("a16_availability", with_(WIDE, FLAGS, "wf AS (SELECT * FROM wide JOIN flags USING (entity_id))") + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, 'with_value' AS kind, count({c}) AS n FROM wf" for c in SC]
    + [f"SELECT '{c}' AS feature, 'remediated' AS kind, sum({c})::BIGINT AS n FROM wf" for c in FLAG_COLS]))
def a16_availability(spark: SparkSession, sf_dir: str):
    """Entities with a value per score; remediated entities per flag."""
    return features.availability(fx.order_facts(spark, sf_dir), SC, FLAG_COLS)


@query("a17_kde", with_(WIDE, NAMED, OUTC, MERGED) + (
    "SELECT k::INTEGER AS k, " + p6("g0 + k * step") + " AS x, "
    + p6("sum(exp(-pow((g0 + k * step - outcome) / bw, 2) / 2)) / (n * bw * sqrt(2 * pi()))") + " AS density "
    "FROM (SELECT count(outcome) AS n, stddev_samp(outcome) * pow(count(outcome), -0.2) AS bw, "
    "min(outcome) - 3 * stddev_samp(outcome) * pow(count(outcome), -0.2) AS g0, "
    "(max(outcome) - min(outcome) + 6 * stddev_samp(outcome) * pow(count(outcome), -0.2)) / 199.0 AS step FROM merged) p "
    "CROSS JOIN range(0, 200) t(k) CROSS JOIN (SELECT outcome FROM merged WHERE outcome IS NOT NULL) d GROUP BY k, g0, step, n, bw"))
def a17_kde(spark: SparkSession, sf_dir: str):
    """Gaussian kernel density of the outcome on a 200-point grid."""
    return profile.kde_grid(_merged(spark, sf_dir)[2], "outcome")


# ---------------------------------------------------------------------------
# W / O: windows and ordering
# ---------------------------------------------------------------------------

@query("w1_attempt_sequence", with_(ATTEMPTS) + f"SELECT entity_id, attempt_no, {p6('score')} AS score FROM attempts")
def w1_attempt_sequence(spark: SparkSession, sf_dir: str):
    """Sittings numbered per entity by (date, order key)."""
    return fx.attempts(spark, sf_dir).select("entity_id", "attempt_no", "score")


@query("w2_attempt_change", with_(ATTEMPTS) + f"SELECT entity_id, attempt_no, {p6('score')} AS score, {p6('score - lag(score) OVER (PARTITION BY entity_id ORDER BY attempt_no)')} AS change FROM attempts")
def w2_attempt_change(spark: SparkSession, sf_dir: str):
    """Change versus the previous attempt."""
    return att.attempt_changes(fx.attempts(spark, sf_dir))


@query("w3_contiguous_folds", with_(WIDE, NAMED, OUTC, MERGED) + "SELECT entity_id, (ntile(5) OVER (ORDER BY entity_id) - 1)::INTEGER AS fold FROM merged")
def w3_contiguous_folds(spark: SparkSession, sf_dir: str):
    """Unshuffled 5-fold split in key order, computed with distributed
    ranks (no single-partition window)."""
    m = _merged(spark, sf_dir)[2].select("entity_id")
    ranked = row_rank(m, "entity_id")
    n = m.count()
    return ranked.select("entity_id", contiguous_fold(F.col("_rank"), F.lit(n), 5).alias("fold"))


def _first_missing_sql():
    cases = " ".join(f"WHEN {c}_midterm IS NULL OR {c}_final IS NULL THEN {i}" for i, c in enumerate(fx.COURSES))
    return f"CASE {cases} ELSE {len(fx.COURSES)} END"


@query("w5_cumulative_sets", with_(EXAMS, OUTC) + (
    "SELECT ck AS checkpoint, ck * 2 AS n_features, count(*) AS n_rows FROM "
    f"(SELECT {_first_missing_sql()} AS depth FROM exams JOIN outc USING (entity_id)) CROSS JOIN range(1, 6) t(ck) "
    "WHERE ck <= depth GROUP BY ck"))
def w5_cumulative_sets(spark: SparkSession, sf_dir: str):
    """Rows complete for each cumulative course set, in one pass: each
    row counts for every checkpoint below its first incomplete course."""
    from ..operators.checkpoints import complete_depth
    ex = fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id")
    d = ex.select(complete_depth(fx.COURSES).alias("depth"))
    return (d.select(F.explode(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1)))).alias("checkpoint"), "depth")
            .filter(F.col("checkpoint") <= F.col("depth"))
            .groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.col("checkpoint").cast("long").alias("checkpoint"), (F.col("checkpoint") * 2).cast("long").alias("n_features"), "n_rows"))


@query("o2_top10_at_risk", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, round_even(outcome, 0)::INTEGER AS predicted, {p6(rev(f'({THS} - round_even(outcome, 0)) / {THS}', 3))} AS risk_score FROM merged WHERE round_even(outcome, 0) < {THS} ORDER BY risk_score DESC, entity_id LIMIT 10")
def o2_top10_at_risk(spark: SparkSession, sf_dir: str):
    """O2: the ten highest-risk flagged entities (take-ordered)."""
    _, _, m = _merged(spark, sf_dir)
    rep = risk.flag_at_risk(m.select("entity_id", risk.rounded_prediction(F.col("outcome")).alias("predicted")), TH)
    return risk.top_at_risk(rep, 10).select("entity_id", "predicted", "risk_score")


@query("o7_sorted_changes", with_(ATTEMPTS, A8) + f"SELECT entity_id, {p6('attempt2_score - attempt1_score')} AS change FROM a8s WHERE attempt1_score IS NOT NULL AND attempt2_score IS NOT NULL ORDER BY change")
def o7_sorted_changes(spark: SparkSession, sf_dir: str):
    """Attempt-1 -> 2 changes sorted (waterfall data)."""
    return att.paired_change(att.attempt_summary(fx.attempts(spark, sf_dir)), 1, 2).orderBy("change", "entity_id")


@query("o8_preview", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, name, {p6('outcome')} AS outcome FROM merged ORDER BY entity_id LIMIT 5")
def o8_preview(spark: SparkSession, sf_dir: str):
    """First five rows in key order."""
    return _merged(spark, sf_dir)[2].orderBy("entity_id").limit(5).select("entity_id", "name", "outcome")


# ---------------------------------------------------------------------------
# F: row-wise features
# ---------------------------------------------------------------------------

@query("f1_row_mean", with_(WIDE) + f"SELECT entity_id, {p6(rev(row_mean_sql(SC), 2))} AS row_mean FROM wide")
def f1_row_mean(spark: SparkSession, sf_dir: str):
    """F1: row mean over present scores, 2 dp half-even."""
    return fx.wide_scores(spark, sf_dir, with_name=False).select("entity_id", rowwise.row_mean(SC, 2).alias("row_mean"))


@query("f2_row_variance", with_(WIDE) + f"SELECT entity_id, {p6(rev(row_var_sql(SC), 2))} AS row_variance FROM wide")
def f2_row_variance(spark: SparkSession, sf_dir: str):
    """F2: row sample variance (n-1) over present scores, 2 dp."""
    return fx.wide_scores(spark, sf_dir, with_name=False).select("entity_id", rowwise.row_variance(SC, 2).alias("row_variance"))


@query("f3_row_min_max", with_(WIDE) + f"SELECT entity_id, {p6('least(' + ', '.join(SC) + ')')} AS row_min, {p6('greatest(' + ', '.join(SC) + ')')} AS row_max FROM wide")
def f3_row_min_max(spark: SparkSession, sf_dir: str):
    """weakest and strongest present score."""
    w = fx.wide_scores(spark, sf_dir, with_name=False)
    return w.select("entity_id", rowwise.row_min(SC).alias("row_min"), rowwise.row_max(SC).alias("row_max"))


IMPR = [f"{c}_improvement" for c in fx.COURSES]


@query("f4_improvement", with_(EXAMS) + "SELECT entity_id, " + ", ".join(f"{p6(f'{c}_final - {c}_midterm')} AS {c}_improvement" for c in fx.COURSES) + " FROM exams")
def f4_improvement(spark: SparkSession, sf_dir: str):
    """final minus midterm per course."""
    ex = fx.exam_scores(spark, sf_dir, with_name=False)
    return ex.select("entity_id", *[rowwise.improvement(f"{c}_final", f"{c}_midterm").alias(f"{c}_improvement") for c in fx.COURSES])


@query("f5_avg_improvement", with_(EXAMS, "imp AS (SELECT entity_id, " + ", ".join(f"{c}_final - {c}_midterm AS {c}_improvement" for c in fx.COURSES) + " FROM exams)") + f"SELECT entity_id, {p6(row_mean_sql(IMPR))} AS avg_improvement FROM imp")
def f5_avg_improvement(spark: SparkSession, sf_dir: str):
    """mean of the per-course improvements."""
    ex = fx.exam_scores(spark, sf_dir, with_name=False)
    imp = ex.select("entity_id", *[rowwise.improvement(f"{c}_final", f"{c}_midterm").alias(f"{c}_improvement") for c in fx.COURSES])
    return imp.select("entity_id", rowwise.row_mean(IMPR).alias("avg_improvement"))


@query("f6_clip", with_(EXAMS) + "SELECT entity_id, " + ", ".join(f"{p6(clip_sql(c))} AS {c}" for c in EX) + " FROM exams")
def f6_clip(spark: SparkSession, sf_dir: str):
    """exams clipped to [0, 100], nulls kept."""
    ex = fx.exam_scores(spark, sf_dir, with_name=False)
    return features.apply_clip(ex, EX)


@query("f6_clip_counts", with_(EXAMS) + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} < 0) AS n_low, count(*) FILTER (WHERE {c} > 100) AS n_high FROM exams" for c in EX))
def f6_clip_counts(spark: SparkSession, sf_dir: str):
    """F6 report: values below 0 / above 100 per exam."""
    return features.clip_counts(fx.exam_scores(spark, sf_dir, with_name=False), EX)


@query("f7_missing_policy", with_(WIDE, NAMED, OUTC, MERGED, "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in SC) + " FROM merged)") + (
    "SELECT entity_id, " + ", ".join(f"({c} IS NULL)::INTEGER AS {c}_missing, {p6(f'coalesce({c}, med_{c})')} AS {c}" for c in SC) + " FROM merged CROSS JOIN med"))
def f7_missing_policy(spark: SparkSession, sf_dir: str):
    """indicator + median fill (columns over 50 % missing dropped)."""
    _, _, m = _merged(spark, sf_dir)
    plan = features.fit_missing(m, SC)
    return features.apply_missing(m, plan).select("entity_id", *[x for c in plan.kept for x in (f"{c}_missing", c)])


@query("f8_standardize", with_(WIDE, NAMED, OUTC, MERGED, "st AS (SELECT " + ", ".join(f"avg(s_urgent) AS m, stddev_pop(s_urgent) AS s".replace("s_urgent", c).replace(" AS m", f" AS m_{c}").replace(" AS s", f" AS sd_{c}") for c in SC) + " FROM merged WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SC) + ")") + (
    "SELECT entity_id, " + ", ".join(f"{p6(f'({c} - m_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END')} AS {c}" for c in SC) + " FROM merged CROSS JOIN st WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SC)))
def f8_standardize(spark: SparkSession, sf_dir: str):
    """F8: (x - mean) / population std on complete rows; zero std -> 1."""
    _, _, m = _merged(spark, sf_dir)
    cc = clean.drop_null(m, SC)
    return features.apply_scaler(cc, features.fit_scaler(cc, SC)).select("entity_id", *SC)


@query("f9_risk_tier", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, CASE WHEN outcome < {TH - 8} THEN 'HIGH RISK' WHEN outcome < {TH - 3} THEN 'AT RISK' WHEN outcome < {TH + 3} THEN 'BORDERLINE' WHEN outcome IS NOT NULL THEN 'LIKELY PASS' END AS risk_level FROM merged")
def f9_risk_tier(spark: SparkSession, sf_dir: str):
    """tier from a value relative to the threshold."""
    _, _, m = _merged(spark, sf_dir)
    return m.select("entity_id", risk_tier("outcome", TH).alias("risk_level"))


@query("f10_fixed_tier", with_(EXAMS) + "SELECT entity_id, CASE WHEN view_final < 60 THEN 'HIGH RISK' WHEN view_final < 65 THEN 'AT RISK' WHEN view_final < 70 THEN 'BORDERLINE' WHEN view_final IS NOT NULL THEN 'LIKELY OK' END AS tier FROM exams")
def f10_fixed_tier(spark: SparkSession, sf_dir: str):
    """fixed-cut tiers 60/65/70."""
    from ..functions.labels import fixed_tier
    ex = fx.exam_scores(spark, sf_dir, with_name=False)
    return ex.select("entity_id", fixed_tier("view_final").alias("tier"))


@query("f11_risk_score", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, {THS} AS threshold, {p6(rev(f'({THS} - round_even(outcome, 0)) / {THS}', 3))} AS risk_score, round_even(outcome, 0) < {THS} AS at_risk FROM merged")
def f11_risk_score(spark: SparkSession, sf_dir: str):
    """risk score and flag from a rounded value."""
    _, _, m = _merged(spark, sf_dir)
    p = m.select("entity_id", risk.rounded_prediction(F.col("outcome")).alias("predicted"))
    return risk.flag_at_risk(p, TH).drop("predicted")


@query("f12_round_half_even", with_(WIDE, NAMED, OUTC, MERGED) + "SELECT entity_id, round_even(outcome / 10.0, 0)::INTEGER AS rounded FROM merged")
def f12_round_half_even(spark: SparkSession, sf_dir: str):
    """half-to-even rounding to integer."""
    _, _, m = _merged(spark, sf_dir)
    return m.select("entity_id", risk.rounded_prediction(F.col("outcome") / 10.0).alias("rounded"))
