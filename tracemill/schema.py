"""Keys and value conventions of the data model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY = ("dataset", "model", "trace_index")
CURVE = ("dataset", "teacher_model", "student_model")
#: The largest score of each dataset, by which scores are normalised.
MAX_SCORE = {"math": 1.0, "gpqa": 1.0, "connections": 4.0}


def normalised(score: str = "score", dataset: str = "dataset") -> Column:
    """Score on a scale of 0 to 1."""
    top = F.lit(1.0)
    for name, value in MAX_SCORE.items():
        if value != 1.0:
            top = F.when(F.lower(F.col(dataset)) == name, F.lit(value)).otherwise(top)
    return F.col(score) / top


def correct(score: str = "score", policy: str = "above_zero") -> Column:
    """1.0 or 0.0; policy is above_zero, above_half or equals_one. A null score is 0.0."""
    c = F.col(score)
    test = {"above_zero": c > 0, "above_half": c > 0.5, "equals_one": c == 1}[policy]
    return F.when(test, 1.0).otherwise(0.0)
