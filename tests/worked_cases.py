"""Literal inputs of the text operators, with results worked out by hand from the rules."""

from __future__ import annotations

CASES = {
    "grade_connections": {
        "schema": "id int, pred string, truth string",
        "out": {"grade": "integer"},
        "rows": [
            (('{"A":["W1","W2","W3","W4"],"B":["X"]}', '{"Z":["W4","W3","W2","W1"]}'), (1,)),
            (('{"A":["a","b"],"B":["b","a"]}', '{"Z":["a","b"]}'), (2,)),
            (("not json", '{"Z":["a"]}'), (0,)),
            (('{"A":["a"]}', '{"Z":["a","b"]}'), (0,)),
        ],
    },
    "normalize_bt_json": {
        "schema": "id int, reply string",
        "out": {"verdict": "varchar"},
        "rows": [
            (('```json\n{"backtracking_detected": true, "confidence": 1.7, "backtracking_steps": [{"step_number": "3", "reasoning": "r"}, "junk"]}\n```',), ('{"backtracking_detected":true,"final_answer":"","backtracking_steps":[{"step_number":3,"reason":"r"}],"confidence":1.0,"overall_reasoning":""}',)),
            (('well {"final_answer": "4", "confidence": -1, "backtracking_steps": [{"original_claim": " a ", "correction_made": "b"}]} ok',), ('{"backtracking_detected":false,"final_answer":"4","backtracking_steps":[{"step_number":0,"reason":"original_claim: a; correction_made: b"}],"confidence":0.0,"overall_reasoning":""}',)),
            (("no json",), ('{"backtracking_detected":false,"final_answer":"","backtracking_steps":[],"confidence":0.0,"overall_reasoning":""}',)),
        ],
    },
    "vector_matrices": {"schema": "id int, vec string", "out": {"matrix": "varchar"}, "rows": [(("{1,2}",), ("\\begin{pmatrix}1\\2\\end{pmatrix}",)), (("none",), ("",))]},
}
