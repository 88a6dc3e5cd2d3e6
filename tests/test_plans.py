"""Plan lint over every registered query: no Cartesian products, nested-loop
joins only where both sides are bounded by construction, expensive text
expressions not duplicated, filters reaching the parquet scan."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

SKIP = {"fit_evaluate_multilabel", "fit_predictions", "stream_keyword_flags"}   # training jobs / streaming sink
# a one-row table (fixed by construction)
NESTED_LOOP_OK = {"op8_adaptive_rules"}
# at most this many scans of the main table of a query
SCANS = {"venn_intersections": ("lineitem", 0), "describe_flags": ("lineitem", 2), "mislabel_report": ("lineitem", 2),
         "screening_funnel": ("lineitem", 2), "records_funnel": ("documents", 2), "clean_budget_et": ("conversations", 0),
         "prepare_training": ("documents", 0), "publish_curated": ("documents", 0)}


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, q in E.queries().items():
        if name in SKIP:
            continue
        df = q(spark, SF001)
        out[name] = (df._jdf.queryExecution().executedPlan().toString(),
                     df._jdf.queryExecution().optimizedPlan().toString())
    return out


def test_no_cartesian_products(plans):
    bad = [n for n, (p, _) in plans.items() if "CartesianProduct" in p]
    assert bad == []


def test_nested_loop_joins_only_on_bounded_sides(plans):
    bad = [n for n, (p, _) in plans.items() if "BroadcastNestedLoopJoin" in p and n not in NESTED_LOOP_OK]
    assert bad == []


def test_text_cleaning_not_duplicated(plans):
    # one cleaning per independent branch (distinct keys, rows, percentile inputs ...)
    heavy = {n: o.count("regexp_replace(") for n, (_, o) in plans.items()}
    assert max(heavy.values()) <= 30, sorted(heavy.items(), key=lambda kv: -kv[1])[:5]
    assert heavy["curate_climate"] <= 4 and heavy["near_duplicates"] == 0
    lev = {n: o.count("levenshtein(") for n, (_, o) in plans.items()}
    assert lev["near_duplicates"] == 1


def test_filters_pushed_to_scan(plans):
    p, _ = plans["warehouse_slice"]
    assert "PushedFilters: [In(n_name, [NATION_1,NATION_13,NATION_21,NATION_3,NATION_5,NATION_8]" in p
    assert "GreaterThanOrEqual(l_s" in p                                  # ship-year range on the raw date


def test_main_tables_are_scanned_once_or_twice(plans):
    got = {n: plans[n][0].count(f"{SF001}/{t}.parquet") for n, (t, _) in SCANS.items()}
    assert all(got[n] <= most for n, (_, most) in SCANS.items()), got
