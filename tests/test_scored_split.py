"""one split of the scored sentences is chosen before variants are derived, and nothing is kept."""

from pyspark.sql import functions as F

from pairlab.catalog import metrics_q
from pairlab.sources import fixtures
from test_pair_fixture import documents, plan, rows


def test_a_split_is_chosen_before_its_variants_are_derived(spark, tmp_path):
    d = documents(spark, tmp_path)
    for split in ("val", "test"):
        got = fixtures.scored(spark, d, split)
        assert rows(got) == rows(fixtures.scored(spark, d).where(F.col("split") == split))
        below = plan(got)[plan(got).index("ArrowEvalPython"):]
        assert "Filter" in below and "< 50" in below
    assert "InMemoryRelation" not in plan(metrics_q.d30_grid_winner(spark, d))
