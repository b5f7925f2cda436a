"""Several gradebooks of different headers in one read."""

import pytest

from cohort_signal.sources.gradebooks import Course, choose, extract_courses, read_gradebooks

COURSES = [Course("alpha", "Alpha", {"alpha_midterm": "Midterm (11)", "alpha_final": "Final (12)"}),
           Course("beta", "Beta", {"beta_final": "Exam, final (99)", "beta_extra": "Not there"}),
           Course("gamma", "Gamma", {"gamma_final": "Final"})]


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "books"
    top.mkdir()
    (top / "2024 Alpha grades.csv").write_text(
        '﻿Student,ID,SIS Login ID,Midterm (11),Final (12)\n    Points Possible,,,100,100\n"Doe, Jane",1,10001 - LOA,80,N/A\n'
        '"Roe, ""Ric""",2,10002,7x,91.5\n"Test, Student",3,10009,1,1\n"Out, Range",4,5,50,50\n"No, Login",6,,50,50\n')
    (top / "2025 Alpha grades.csv").write_text("Student,SIS Login ID,Midterm (11),Final (12)\nLater,10001,1,1\n")
    parts = top / "Beta gradebook"
    parts.mkdir()
    (parts / "part-0.csv").write_text('"Exam, final (99)",SIS Login ID,Section,Student\n55,10002,A,"Roe, R"\n,10003,A,"Poe, P"\n')
    (parts / "part-1.csv").write_text('Student,"Exam, final (99)",SIS Login ID\n"Doe, J",66.5,10001\n')
    (parts / "_SUCCESS").write_text("")
    return str(top)


def test_choice_is_the_first_name(spark, folder):
    assert choose(spark, folder, ["Alpha", "Beta", "Gamma"]) == {"Alpha": "2024 Alpha grades.csv", "Beta": "Beta gradebook", "Gamma": None}


def test_cells_follow_their_own_header(spark, folder):
    rows = [r.cells for r in read_gradebooks(spark, folder, ["Beta gradebook"]).collect()]
    assert sorted((r["SIS Login ID"], r["Exam, final (99)"], r["Student"], r.get("Section")) for r in rows) == [
        ("10001", "66.5", "Doe, J", None), ("10002", "55", "Roe, R", "A"), ("10003", None, "Poe, P", "A")]


def test_courses_are_merged(spark, folder):
    got = extract_courses(spark, folder, COURSES, (10_000, 99_999))
    assert got.columns == ["entity_id", "name", "alpha_midterm", "alpha_final", "beta_final", "beta_extra", "gamma_final"]
    assert sorted(map(tuple, got.collect())) == [
        (10001, "Doe, Jane", 80.0, None, 66.5, None, None),
        (10002, 'Roe, "Ric', None, 91.5, 55.0, None, None),
        (10003, "Poe, P", None, None, None, None, None)]


def test_no_gradebook_raises(spark, tmp_path):
    (tmp_path / "other.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        extract_courses(spark, str(tmp_path), COURSES, (0, 9))
