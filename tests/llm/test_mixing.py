"""The mixture of many sources."""

import pytest

from cohortspark.llm import common, mixing
from tests.llm.conftest import DOCUMENTS


@pytest.mark.parametrize("n_sources", [5000, 5300])
def test_no_source_loses_a_document(spark, n_sources):
    """Near equal totals; 1 / 5300 rounded to 12 decimals is 1.5e-9 too small, 1 / 5000 is not rounded."""
    rows = [(i, "a b c " * (7 + i % 2), "en", f"s{i}", 0) for i in range(n_sources)]
    units = common.written(mixing.units(spark.createDataFrame(rows, DOCUMENTS)), "many-units")
    weights = common.written(mixing.weights(units), "many-weights")
    assert weights.where("quota < total").count() == 0
    taken = mixing.mix(units, weights).select("doc_id").distinct().count()
    assert taken == n_sources
