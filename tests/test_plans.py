"""Plan shapes that must hold at scale."""

import re

import pytest

from dayweave.plans import registry

CORE = ["win_bounded_fill", "agg_recipe_bed", "jon_label_merge", "jon_household_pairs", "jon_fires_transitions", "jon_uncovered_runs", "jon_nearest_window", "sum_period_trends",
        "seq_transition_matrix", "sta_psi", "sta_auc", "ml_conformal_threshold", "prd_column_tier", "jon_member_tracker_match", "sum_entity_profile"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_nested_loop_and_no_global_window(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\((?:[a-z_#0-9]+ (?:ASC|DESC))", text)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(registry.QUERIES["src_latest_per_person"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "event_id" in schema and schema.count(":") <= 6
    lab = plan(registry.QUERIES["ml_question_expiry"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in lab


def test_feature_store_round_trip(spark, sf_dir, tmp_path):
    from dayweave.operators import readings as R
    from dayweave.plans.windows_features import feature_table

    from pyspark.sql import functions as F

    f = feature_table(spark, sf_dir).withColumn("feature_set", F.lit("v1"))
    R.write_features(f, str(tmp_path / "feats"))
    R.write_features(f.where("person = 'p1'"), str(tmp_path / "feats"))  # only its own partitions are replaced
    store = spark.read.parquet(str(tmp_path / "feats"))
    assert store.count() == f.count()
    one = R.read_features(store, "p1", "v1", 0, 10**9)
    assert one.count() == f.where("person = 'p1'").count()
    assert "PartitionFilters: [" in plan(one) and "person_bucket" in plan(one)
