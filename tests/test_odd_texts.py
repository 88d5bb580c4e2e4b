"""Queries with an SQL twin on texts that the tables at hand lack."""

import duckdb
import pandas as pd
import pytest

from tracemill.plans import catalogue, more  # noqa: F401


def same(spark, tmp_path, name, texts):
    """The query's rows on these texts, which must be those of its twin."""
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "de", "source": "x", "n_chars": [len(t or "") for t in texts]})
    frame.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.ORACLE[name]).fetchall())
    return dict(got)


def test_a_category_may_be_longer_than_a_json_reader_takes_a_key(spark, tmp_path):
    got = same(spark, tmp_path, "extract_answer_connections", ["wort " * 10, "ab" * 30_000, "cd" * 300_000, None, "", "ef" * 26_000, "gh" * 26_000])
    assert all(got[i] is not None for i in range(5)) and got[5] is None and len(got[1]) > 120_000


@pytest.mark.parametrize("inner", ["ß", "ﬁ", "ŉ", "ǰ", "ı", "ſ", "K", "ẞ", "é", "Å"])
def test_capitals_do_not_join_words(spark, tmp_path, inner):
    texts = [t for w in ("gro{}e", "{}", "{}a", "b{}", "x {}", "{} y", "der gro{}e s{}") for t in [w.replace("{}", inner)] * 8]
    same(spark, tmp_path, "grade_choice", texts)
