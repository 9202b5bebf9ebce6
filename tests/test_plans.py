"""Plans: columns are pruned, joins are equi-joins, hot paths stay in the JVM."""

import pytest

import __spark_entry__ as entry
from vellum import queries as core

D = "/root/testdata/sf0.001"
#: Queries whose whole point is JVM-side expressions.
NATIVE = ["ext1_links", "ext3_comments", "ext4_line_numbers", "ext5_lines", "ext13_titles", "str1_plain_text", "pth1_targets", "j1_dangling_links", "j8_coverage", "j10_plan", "j16_kth_to_kth", "j18_as_of", "j20_range_join", "agg4_majority", "agg6_coverage_ratio", "agg10_fingerprints", "win1_repeats", "win2_carry_forward", "win5_latest_per_kind", "win7_stable_codes", "win13_islands", "rcn6_staleness", "rcn7_change_status", "rule_em_dash", "rule_theme_wiring", "rule_solution_placement"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_and_equi(spark, name):
    plan = plan_of(entry.queries()[name](spark, D))
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - {k for k in core.QUERIES if k.startswith("rule_") or k == "findings_pages"}))
def test_no_cartesian_products(spark, name):
    plan = plan_of(core.QUERIES[name](spark, D))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark):
    plan = plan_of(entry.queries()["ext1_links"](spark, D))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert "text" not in plan_of(entry.queries()["win5_latest_per_kind"](spark, D))


def test_names_go_to_the_texts(spark):
    """Neither the query nor the rule moves or broadcasts a text to look for names in it."""
    from vellum.corpus import from_dict
    from vellum.plans.registry import RULES

    c = from_dict(spark, {"a.html": "x", "img/syllabus-a.png": None})
    for df in (core.QUERIES["j24_substring_anti"](spark, D), RULES["orphan-image"].run(c)):
        plan = plan_of(df)
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
        scan = plan[plan.index("MapInArrow") :]
        assert "Exchange" not in scan.split("Scan")[0].split("MapInArrow")[-1]
    c.unpersist()


def test_one_job_tells_which_rules_apply(spark):
    from vellum.corpus import from_dict
    from vellum.plans.registry import Needs, settled

    c = from_dict(spark, {"a.html": "x"})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("applies", "")
    got = settled({"a": Needs(c.texts, "no text"), "b": Needs(c.texts.where("false"), "nothing"), "c": True, "d": "off"})
    assert got == {"a": True, "b": "nothing", "c": True, "d": "off"} and len(tracker.getJobIdsForGroup("applies")) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
