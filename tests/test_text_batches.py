"""Functions over whole texts hold batches of 100 rows in Python, not Arrow's 10,000."""

import pytest

from lectern.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["str_f14_phrases", "stf_05_chunks", "str_f01_strip_html", "str_f27_runs"]


@pytest.mark.parametrize("name", NAMES)
def test_texts_are_not_held_by_the_thousand(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan
