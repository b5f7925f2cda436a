"""Several gradebooks with headers of their own, read as one table.

A gradebook is a CSV file, or a folder of CSV parts, in one folder; its name is
that of the file or folder.  Every part has its own header, so columns may
differ in number, name and order.  Lines of all chosen gradebooks are read in
one distributed scan; each line is split under the CSV rules and keyed by the
header of its own part, which gives one row per line with its cells as a map
from raw column name to text.  Only names and headers, one row a part, are
gathered; a cell cannot hold a line break.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from .io import DEFAULT_NA_TOKENS

#: Parts whose headers may be gathered; more raise.
MAX_PARTS = 100_000
CSV = {"nullValue": "\u0001", "emptyValue": "", "escape": '"'}


@dataclass(frozen=True)
class Course:
    """A gradebook's course: what its file name contains and which raw columns
    hold its exams ({friendly: raw})."""
    name: str
    pattern: str
    exams: Mapping[str, str]


def choose(spark: SparkSession, folder: str, patterns: Sequence[str]) -> dict[str, str | None]:
    """pattern -> the first name, in order, of the gradebooks whose name
    contains it (None: none).  Only the listing is read, no content."""
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index("path", f"/{root}/", -1)
    name = F.element_at(F.split(inside, "/"), 1)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(name.alias("name"))
              .filter(~F.startswith("name", F.lit("_")) & ~F.startswith("name", F.lit("."))))
    row = listed.agg(*[F.min(F.when(F.contains("name", F.lit(p)), F.col("name"))).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
    return {p: row[f"p{i}"] for i, p in enumerate(patterns)}


def read_gradebooks(spark: SparkSession, folder: str, names: Sequence[str], na_tokens: Sequence[str] = DEFAULT_NA_TOKENS) -> DataFrame:
    """(gradebook, cells): one row per line of the named gradebooks of
    ``folder``; ``cells`` maps raw column names to text, NA tokens to null."""
    root = folder.rstrip("/")
    lines = spark.read.text([f"{root}/{n}" for n in names]).select(
        "value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"))
    first = (lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id())
             .groupBy("part").agg(F.min_by("value", "at").alias("header")).limit(MAX_PARTS + 1).collect())
    if len(first) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} gradebook parts")
    if not first:
        return spark.createDataFrame([], "gradebook string, cells map<string,string>")
    width = max(r["header"].count(",") + 1 for r in first)
    cells = ", ".join(f"c{i} string" for i in range(width))

    def split(line: str):
        parsed = F.from_csv(F.col(line), cells, CSV)
        return F.array(*[parsed[f"c{i}"] for i in range(width)])

    heads = spark.createDataFrame([(r["part"], r["header"]) for r in first], "part string, header string")
    heads = heads.withColumn("names", F.filter(F.transform(split("header"), lambda c: F.regexp_replace(c, "^﻿", "")), lambda c: c.isNotNull()))
    # the last of several columns of one name counts
    rows = lines.join(F.broadcast(heads), "part").filter(F.col("value") != F.col("header"))
    pairs = F.zip_with("names", F.slice(split("value"), 1, F.size("names")), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    pairs = F.transform(F.array_distinct(F.col("names")), lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1))
    kept = F.transform_values(F.map_from_entries(pairs), lambda k, v: F.when(~F.coalesce(v.isin(list(na_tokens)), F.lit(True)), v))
    gradebook = F.element_at(F.split(F.substring_index(F.url_decode(F.replace("part", F.lit("+"), F.lit("%2B"))), f"/{root.rsplit('/', 1)[-1]}/", -1), "/"), 1)
    return rows.select(gradebook.alias("gradebook"), kept.alias("cells"))


def extract_courses(spark: SparkSession, folder: str, courses: Sequence[Course], id_range: tuple[int, int],
                    student: str = "Student", login: str = "SIS Login ID") -> DataFrame:
    """One row per entity of any course: entity_id, name (of the first course,
    in order, that has one) and the exams of all courses, null where absent
    (P1 to P10 and the outer merge of J3 in one scan and one aggregate).  A
    course without a gradebook, or an exam whose raw column is missing, gives
    null columns; no gradebook at all raises."""
    chosen = choose(spark, folder, [c.pattern for c in courses])
    if not any(chosen.values()):
        raise ValueError(f"no gradebook under {folder}")
    held = [(i, chosen[c.pattern]) for i, c in enumerate(courses) if chosen[c.pattern]]
    of = F.broadcast(spark.createDataFrame(held, "course int, gradebook string"))
    rows = read_gradebooks(spark, folder, sorted({n for _, n in held})).join(of, "gradebook")
    rows = rows.select("course", "cells", F.col("cells")[student].alias("student"), F.col("cells")[login].alias("login"))
    rows = clean.drop_null(clean.drop_points_possible(rows, "student"), ["student"])
    rows = rows.withColumn("entity_id", clean.entity_id("login")).filter(F.col("entity_id").isNotNull())
    rows = rows.withColumn("entity_id", F.col("entity_id").cast("long")).filter(clean.in_range("entity_id", *id_range) & ~clean.is_test_account("student"))
    exams = [F.max(F.when(F.col("course") == i, clean.to_number(F.col("cells")[raw]))).alias(friendly) for i, c in enumerate(courses) for friendly, raw in c.exams.items()]
    return rows.groupBy("entity_id").agg(F.min_by(clean.clean_name("student"), F.struct("course", "student")).alias("name"), *exams)
