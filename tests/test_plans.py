"""Plan-shape checks on the executed (adaptive, final) physical plans.

* no Python evaluation nodes (all work stays in the JVM);
* no nested-loop join or cartesian product (one-row totals are scalar
  subqueries; every join has equi-keys);
* no single-partition exchange above a raw scan without an aggregate between
  them (no global window or sort over un-reduced rows);
* every parquet scan reads a pruned column set (never every column of a wide
  table).
"""

from __future__ import annotations

import pytest

from ratewise.queries import QUERIES

WRAPPERS = ("executedPlan", "plan", "child")


def kids(node):
    try:
        ch = node.children()
        out = [ch.apply(i) for i in range(ch.size())]
    except Exception:
        out = []
    if out:
        return out
    for attr in WRAPPERS:
        try:
            return [getattr(node, attr)()]
        except Exception:
            pass
    try:
        return [node.relation().cachedPlan()]
    except Exception:
        return []


def walk(node):
    yield node
    for k in kids(node):
        yield from walk(k)


def is_aggregate(node) -> bool:
    return node.nodeName() in ("HashAggregate", "ObjectHashAggregate", "SortAggregate")


def raw_scan_below_without_aggregate(node) -> bool:
    if is_aggregate(node) or node.nodeName() in ("WindowGroupLimit", "TakeOrderedAndProject"):
        return False
    if "Scan" in node.nodeName() and "InMemory" not in node.nodeName() and "Range" not in node.nodeName() \
            and "LocalTableScan" not in node.nodeName():
        return True
    return any(raw_scan_below_without_aggregate(k) for k in kids(node))


_PLANS: dict[str, object] = {}


def executed(spark, name, sf_dir):
    """Run the query once through its own QueryExecution; its final adaptive plan."""
    if name not in _PLANS:
        df = QUERIES[name](spark, sf_dir)
        df.collect()                      # same QueryExecution as inspected below (sf0.001: small)
        plan = df._jdf.queryExecution().executedPlan()
        first = plan.toString().splitlines()[0]
        assert "AdaptiveSparkPlan" not in first or "isFinalPlan=true" in first, "adaptive plan not final"
        _PLANS[name] = plan
    return _PLANS[name]


# Queries whose result holds every column of a table (or that read their own scratch files).
WHOLE_ROWS = {"dedup_keep_last", "dedup_rate", "build_events", "rename_columns", "hierarchy_from_files", "keep_last_stream"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, sf_dir, name):
    plan = executed(spark, name, sf_dir)
    nodes = list(walk(plan))
    names = [n.nodeName() for n in nodes]
    assert not [n for n in names if "Python" in n or "ArrowEval" in n or "InPandas" in n], names
    for n in nodes:
        nm = n.nodeName()
        if nm in ("BroadcastNestedLoopJoin", "CartesianProduct"):
            # one-row totals are scalar subqueries; every join has equi-keys
            pytest.fail(f"{name}: {nm} (cross join)")
        if nm == "Exchange" and "SinglePartition" in n.outputPartitioning().toString():
            assert not raw_scan_below_without_aggregate(n.child()), f"{name}: raw rows funnelled to one task"
        if nm.startswith("Scan parquet"):
            read = n.requiredSchema().size()
            full = n.relation().dataSchema().size()
            assert full <= 3 or read < full or name in WHOLE_ROWS, \
                f"{name}: scan reads every column of {n.relation().location().rootPaths()}"


def reads(node, seen: set) -> list[str]:
    """Parquet scans that run, by path: through subqueries and cached frames, each of those once,
    and not through reused exchanges."""
    name = node.nodeName()
    if name.startswith("Reused"):
        return []
    if name.startswith("InMemoryTableScan"):
        relation = node.relation()
        key = relation.cacheBuilder().hashCode(), relation.cacheBuilder().toString()
        if key in seen:
            return []
        seen.add(key)
    found = [node.relation().location().rootPaths().mkString(",")] if name.startswith("Scan parquet") else []
    subs = node.subqueries()
    for k in [*kids(node), *[subs.apply(i) for i in range(subs.size())]]:
        found += reads(k, seen)
    return found


# These write a table to files in parts first, or count a table next to its dedup.
SEVERAL_READS = {"dedup_rate", "silver_rate_ranking"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_facts_are_read_once(spark, sf_dir, name):
    if name in SEVERAL_READS:
        pytest.skip("documented further read")
    found = reads(executed(spark, name, sf_dir), set())
    for fact in ("lineitem", "orders", "events"):
        n = sum(f"/{fact}.parquet" in path for path in found)
        # two roles of the driver's tables are bound to orders: exposure and the second source
        assert n <= (2 if fact == "orders" and name.startswith("two_source") else 1), (fact, found)


def test_decode_does_not_shuffle_the_fact(spark, sf_dir):
    """No exchange between the fact scan and the first aggregate."""
    plan = executed(spark, "decode_dictionary", sf_dir)

    def exchange_above_scan(node) -> bool:
        if is_aggregate(node):
            return any(exchange_above_scan(k) for k in kids(node))
        if node.nodeName() == "Exchange":
            return raw_scan_below_without_aggregate(node.child())
        return any(exchange_above_scan(k) for k in kids(node))
    assert not exchange_above_scan(plan)


def test_building_a_query_runs_nothing(spark, sf_dir):
    """Operators are lazy: building the plans of the composition queries starts no job."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    for name in ("composition_stacked", "occupation_share", "expected_vs_observed", "fill_forward", "pareto_exact",
                 "decode_dictionary", "running_total", "group_median", "overall_rate_sql", "known_by_sector"):
        QUERIES[name](spark, sf_dir).schema
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10 * 6    # footers of the input tables are read by jobs; no aggregate is


def joins(plan) -> list[str]:
    return [n.nodeName() for n in walk(plan) if n.nodeName().endswith("Join")]


def test_decoding_sixteen_columns_takes_no_join(spark, sf_dir):
    """The dictionary is one row of maps, whatever the number of columns."""
    assert len([c for c in QUERIES["decode_dictionary"](spark, sf_dir).columns if c.endswith("_label")]) == 16
    assert joins(executed(spark, "decode_dictionary", sf_dir)) == []


def test_subqueries_become_semi_and_existence_joins(spark, sf_dir):
    plan = executed(spark, "known_by_sector", sf_dir)
    kinds = [n.joinType().toString() for n in walk(plan) if n.nodeName().endswith("Join")]
    assert "LeftSemi" in kinds and any(k.startswith("ExistenceJoin") for k in kinds), kinds


def test_running_sums_cache_nothing(spark, sf_dir):
    for name in ("running_total", "group_median", "occupation_share"):
        assert not [n for n in walk(executed(spark, name, sf_dir)) if n.nodeName().startswith("InMemory")], name


def files_replaced(spark, sf_dir, root):
    """A data folder whose facts are replaced, in place, by a part of their rows."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.mode("overwrite").parquet(f"{root}/{t}.parquet")

    def replace():
        for t, some in (("orders", "o_orderkey % 3 = 0"), ("lineitem", "l_orderkey % 3 = 0"), ("events", "event_id % 3 = 0")):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").where(some).write.mode("overwrite").parquet(f"{root}/{t}.parquet")
    return replace


#: One query for each place that reads an aggregate of a fact from several branches.
REUSING = ("status_share", "occupation_share", "diagnosis_share", "composition_stacked", "pareto_cut", "sector_rate_table",
           "overall_rate_by_year", "ratio_to_overall", "expected_vs_observed_table", "type_by_year", "profile_sex_age",
           "sector_counts_by_type", "two_source_monthly", "exposure_by_area", "residence_share")


def test_no_query_keeps_old_numbers(spark, sf_dir, tmp_path):
    """Files replaced between two runs of one session: the second run has the new numbers, and nothing stays cached."""
    replace = files_replaced(spark, sf_dir, str(tmp_path))
    own = spark.range(10).cache()
    own.count()
    before = {n: sorted(map(str, QUERIES[n](spark, str(tmp_path)).collect())) for n in REUSING}
    replace()
    after = {n: sorted(map(str, QUERIES[n](spark, str(tmp_path)).collect())) for n in REUSING}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 1 and own.storageLevel.useMemory
    own.unpersist()
    changed = {n for n in REUSING if before[n] != after[n]}
    assert changed >= {"status_share", "occupation_share", "composition_stacked", "sector_counts_by_type", "type_by_year"}
    fresh = str(tmp_path / "fresh")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{fresh}/{t}.parquet")
    for n in REUSING:
        assert after[n] == sorted(map(str, QUERIES[n](spark, fresh).collect())), n
