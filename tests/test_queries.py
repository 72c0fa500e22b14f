"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from sparkcurate.plans import load_all
from tests.oracle import compare

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ok, message, _, n = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, message
    assert n > 0


def test_entry_is_lazy_enough(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "l_orderkey"
    assert df.limit(1).count() == 1


def test_only_the_fuzzy_match_has_no_sql():
    own, twins = load_all()
    assert set(own) - set(twins) == {"fuzzy_match"}


@pytest.mark.parametrize("name", ["rebalance_topn", "cat_index", "peak_trim", "label_block", "resolve_entity"])
def test_same_result_with_one_shuffle_partition(spark, duck, sf_dir, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ok, message, _, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert ok, message


@pytest.mark.parametrize("name", ["rebalance_topn", "manifest_enrich", "nearest_rank", "two_tier_lookup", "mask_iou"])
def test_same_result_without_broadcast(spark, duck, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ok, message, _, _ = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ok, message


@pytest.mark.parametrize("name", ["cat_index", "part_lists", "chunk_rows", "rebalance_topn", "unique_names", "contains_kth"])
def test_ranks_across_many_partitions(spark, duck, sf_dir, name):
    fn = QUERIES[name].__wrapped__  # without the session settings
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ok, message, _, _ = compare(spark, duck, name, fn, ORACLES[name], sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ok, message
