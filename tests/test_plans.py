"""Plan guards: properties every registered query must keep at scale."""

import pytest

from ledgerlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
RUNS_A_JOB_TO_PLAN = {"churn_confusion", "churn_evaluation", "churn_scores", "ingest_roundtrip", "stream_ingest"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scan_section(text: str) -> str:
    return text.split("Scan parquet", 2)[2].split("\n\n", 1)[0] if text.count("Scan parquet") > 1 else text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_A_JOB_TO_PLAN))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = plan_text(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_date_and_channel_filters_reach_the_scan(spark):
    scan = scan_section(formatted(QUERIES["sales_kpis_channel"](spark, SF)))
    assert "GreaterThanOrEqual(timestamp" in scan and "EqualTo(channel,1-URGENT)" in scan


def test_fact_scan_reads_only_needed_columns(spark):
    scan = scan_section(formatted(QUERIES["sales_by_channel"](spark, SF)))
    schema = scan.split("ReadSchema:")[1].splitlines()[0]
    assert "channel" in schema and "netsale" in schema
    assert "productname" not in schema and "deliverycost" not in schema


def test_workspace_reuses_table_until_inputs_change(spark):
    from ledgerlens.plans.workspace import Workspace

    ws = Workspace.of(spark, SF)
    first = ws.path()
    assert ws.path() == first and Workspace(spark, SF).path() == first  # same inputs and code: same table
    ws.build(fresh=True)
    assert ws.path() != first  # forced rebuild: new location


def _copy_tables(spark, tmp_path, **changed):
    for name in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        changed.get(name, lambda d: d)(df).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_replaced_input_is_seen_at_once(spark, tmp_path):
    sf = _copy_tables(spark, tmp_path)
    before = QUERIES["sales_kpis"](spark, sf).first().row_count
    (spark.read.parquet(f"{SF}/lineitem.parquet").limit(1000).coalesce(1)
     .write.mode("overwrite").parquet(f"{sf}/lineitem.parquet"))
    assert before > 5000 and QUERIES["sales_kpis"](spark, sf).first().row_count == 1000


def test_dangling_keys_lose_no_line_on_either_path(spark, tmp_path):
    from ledgerlens.plans.workspace import MATERIALIZE_CONF

    sf = _copy_tables(spark, tmp_path, supplier=lambda d: d.where("s_suppkey <> 3"), part=lambda d: d.where("p_partkey > 20"),
                      customer=lambda d: d.where("c_custkey <> 7"), nation=lambda d: d.where("n_nationkey <> 4"))
    names = ["sales_enriched", "sales_kpis", "delivery_enriched", "top_cities", "profit_kpis", "partner_on_time"]
    fact = {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in names}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert len(fact["sales_enriched"]) == len(fact["delivery_enriched"]) == lines
    spark.conf.set(MATERIALIZE_CONF, "false")
    try:
        for n in names:
            assert sorted(map(str, QUERIES[n](spark, sf).collect())) == fact[n], n
    finally:
        spark.conf.unset(MATERIALIZE_CONF)


def test_a_date_range_opens_only_its_months(spark):
    from ledgerlens.plans.workspace import Workspace

    ws = Workspace.of(spark, SF)
    some = ws.lines("1997-06-10", "1997-06-20").inputFiles()
    text = formatted(QUERIES["sales_kpis_channel"](spark, SF))
    assert "fact_month" in text.split("PartitionFilters:")[1].splitlines()[0]
    plan = ws.sales("1997-06-10", "1997-06-20").where("date = DATE '1997-06-12'")
    plan.collect()
    files = {r[0] for r in ws.lines("1997-06-10", "1997-06-20").selectExpr("input_file_name()").distinct().collect()}
    assert files and all("fact_month=199706" in f for f in files) and len(files) < len(some)


def test_all_lines_of_an_order_stand_in_one_file(spark):
    from ledgerlens.plans.workspace import Workspace

    pairs = Workspace.of(spark, SF).lines().selectExpr("orderid", "input_file_name() AS f").distinct()
    assert pairs.count() == pairs.select("orderid").distinct().count()


def test_lazy_join_path_gives_the_same_answers(spark):
    from ledgerlens.plans.workspace import MATERIALIZE_CONF

    names = ["sales_kpis_channel", "top_cities", "delivery_kpis", "price_comparison", "customer_status_counts"]
    fact = {n: sorted(map(tuple, QUERIES[n](spark, SF).collect())) for n in names}
    spark.conf.set(MATERIALIZE_CONF, "false")
    try:
        for n in names:
            df = QUERIES[n](spark, SF)
            assert "ledgerlens/facts" not in formatted(df), n
            assert sorted(map(tuple, df.collect())) == fact[n], n
    finally:
        spark.conf.unset(MATERIALIZE_CONF)


def test_an_unfinished_build_is_not_read(spark, tmp_path):
    from ledgerlens.plans.workspace import committed

    base = str(tmp_path / "sig")
    assert committed(spark, base) is None
    spark.range(3).write.parquet(f"{base}/b")
    spark.range(9).write.parquet(f"{base}/a")
    (tmp_path / "sig" / "a" / "_SUCCESS").unlink()
    assert committed(spark, base).endswith("/b")


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace as N

    from ledgerlens import session

    context = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        session.shared_dir(N(conf=N(get=lambda *_: None), sparkContext=context))


def _lines_read(df) -> int:
    """Scans of a table with order lines outside the shared aggregates."""
    leaves = df._jdf.queryExecution().withCachedData().collectLeaves()
    return sum("costofgoodssold" in leaves.apply(i).output().toString() and leaves.apply(i).nodeName() != "InMemoryRelation"
               for i in range(leaves.size()))


def test_tabs_read_the_lines_once_or_twice(spark):
    from ledgerlens.operators import customers as C
    from ledgerlens.operators import profit as P
    from ledgerlens.operators import sales as S
    from ledgerlens.plans import tabs
    from ledgerlens.plans.workspace import Workspace
    from ledgerlens.sources import adapters as A

    t = A.DriverTables(spark, SF)
    sales, funnel, customers = Workspace.of(spark, SF).sales(), A.sales_funnel(t), A.customers(t)
    s, lines = S.filter_sales(sales, "1995-01-01", "1996-06-30"), P.profit_lines(sales)
    status = C.customer_status(customers, sales)
    alone = {
        "sales": {"kpis": S.sales_kpis(s), "funnel": S.sales_funnel(s, funnel), "trend": S.sales_trend(s, "week"),
                  "by_category": S.sales_by(s, "category"), "by_channel": S.sales_by(s, "channel"),
                  "top_products": S.top_by_netsale(s, "productname"), "top_cities": S.top_by_netsale(s, "city"),
                  "top_branches": S.top_by_netsale(s, "locationid")},
        "profit": {"kpis": P.profit_kpis(lines), "by_channel": P.profit_by(lines, "channel"), "by_category": P.profit_by(lines, "category"),
                   "top_margin": P.top_margin_products(lines), "low_margin": P.low_margin_products(lines),
                   "recommendations": P.recommendations(lines)},
        "customer": {"counts": C.status_counts(status), "distribution": C.status_distribution(status),
                     "top_value": C.top_customers(status)},
    }
    want = {(tab, k): (df.dtypes, sorted(map(str, df.collect()))) for tab, views in alone.items() for k, df in views.items()}
    assert all(_lines_read(df) for df in (alone["sales"]["kpis"], alone["profit"]["kpis"], alone["customer"]["counts"]))
    for tab, views in {"sales": tabs.sales_tab(sales, funnel, "1995-01-01", "1996-06-30", grain="week"),
                       "profit": tabs.profit_tab(sales), "customer": tabs.customer_tab(customers, sales)}.items():
        assert len(views.shared) <= 2
        for k, df in views.items():
            assert _lines_read(df) == 0, (tab, k)
            if (tab, k) in want:
                assert (df.dtypes, sorted(map(str, df.collect()))) == want[tab, k], (tab, k)
        views.release()
        assert not any(df.is_cached for df in views.shared)


def test_tabs_of_an_empty_period(spark):
    from ledgerlens.plans import tabs
    from ledgerlens.plans.workspace import Workspace
    from ledgerlens.sources import adapters as A

    sales = Workspace.of(spark, SF).sales()
    views = tabs.sales_tab(sales, A.sales_funnel(A.DriverTables(spark, SF)), "2050-01-01", "2050-12-31")
    profit = tabs.profit_tab(sales.where("false"))
    assert views["kpis"].first().row_count == 0 and views["kpis"].first().aov is None
    assert all(views[k].isEmpty() for k in views if k != "kpis")
    assert tuple(profit["kpis"].first()) == (0, None, None, None)
    assert all(profit[k].isEmpty() for k in profit if k != "kpis")
    views.release()
    profit.release()


def test_the_build_of_the_fact_table_moves_no_derived_column(spark):
    """Names of nations and derived columns come after the joins and the exchange by month."""
    from ledgerlens.plans import workspace as W

    plan = W.Workspace(spark, SF)._derived(1)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("RebalancePartitions")
    assert "deliveryid" in above and "n_name" in plan and below
    moved = below.splitlines()
    assert not any(c in line for line in moved for c in ("n_name", "r_name", "deliveryid", "netsale", "deliverycost"))
