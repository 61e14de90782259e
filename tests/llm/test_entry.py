"""The entry with the training-data operators."""

import __spark_entry__ as entry
from banditframe.llm import queries


def test_operators_and_pipeline_are_registered():
    names = entry.queries()
    assert set(queries.queries()) <= set(names) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert sorted(n for n in names if n.startswith("op1_")) == ["op1_mixing"]
