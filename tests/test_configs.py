"""Configs resolved over a tree of files."""

import json

from tracemill.operators import configs


def test_own_config_default_by_size_and_overrides(spark, tmp_path):
    files = {
        "org--small-7b": {"sampling_params": {"temperature": 0.5, "n": 1}, "dataset_overrides": {"math": {"sampling_params": {"temperature": 0, "stop": ["a"]}}, "gpqa": {"vllm_kwargs": {"tp": 4}}}},
        "default_small": {"sampling_params": {"temperature": 1}}, "default_large": {"vllm_kwargs": {"tp": 8}}, "org--odd": None,
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text("not json" if body is None else json.dumps(body))
    rows = [("Org/Small-7B", "math"), ("Org/Small-7B", "gpqa"), ("Org/Small-7B", None), ("x/y-70B", "math"), ("x/plain", "math"), ("Org/Odd", "math"), (None, "math")]
    got = {(r.model, r.dataset): (r.config, r.sampling_params, r.vllm_kwargs) for r in configs.resolve(spark.createDataFrame(rows, "model string, dataset string"), configs.read_tree(spark, str(tmp_path))).collect()}
    own = {"temperature": "0.5", "n": "1"}
    assert got == {
        ("Org/Small-7B", "math"): ("org--small-7b", {"n": "1", "temperature": "0", "stop": '["a"]'}, {}), ("Org/Small-7B", "gpqa"): ("org--small-7b", own, {"tp": "4"}), ("Org/Small-7B", None): ("org--small-7b", own, {}),
        ("x/y-70B", "math"): ("default_large", {}, {"tp": "8"}), ("x/plain", "math"): ("default_small", {"temperature": "1"}, {}), ("Org/Odd", "math"): ("org--odd", {}, {}), (None, "math"): ("default_small", {"temperature": "1"}, {}),
    }
