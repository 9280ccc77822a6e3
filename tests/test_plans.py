"""What the plans of registered queries must not hold."""

import os

import pytest

from loomwright.plans import load
from loomwright.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
load()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", ["prompt_prefix", "schema_topk", "fk_within_selection", "flatten_labels", "classifier_examples"])
def test_no_pairing_of_all_with_all(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
