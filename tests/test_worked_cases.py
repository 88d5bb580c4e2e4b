"""Results that were worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from tests import worked_cases
from tracemill.functions import grading, jsonparse, text

GROUPS = "map<string,array<string>>"
RUN = {
    "grade_connections": lambda df: df.select("id", grading.grade_connections(F.from_json("pred", GROUPS), F.from_json("truth", GROUPS)).alias("r")),
    "normalize_bt_json": lambda df: df.select("id", F.to_json(jsonparse.verdict("reply")).alias("r")),
    "vector_matrices": lambda df: df.select("id", text.vector_matrix("vec").alias("r")),
}


@pytest.mark.parametrize("name", sorted(worked_cases.CASES))
def test_worked_case(spark, name):
    case = worked_cases.CASES[name]
    df = spark.createDataFrame([(i, *r[0]) for i, r in enumerate(case["rows"])], case["schema"])
    assert {r.id: r.r for r in RUN[name](df).collect()} == {i: r[1][0] for i, r in enumerate(case["rows"])}
