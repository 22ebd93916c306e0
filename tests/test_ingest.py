import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens.sources import ingest as I
from ledgerlens.sources import schemas as SC


def write(path, text):
    path.write_text(text)
    return str(path)


def test_headers_bound_by_name_not_position(spark, tmp_path):
    f = write(tmp_path / "sales_a.csv",
              "qty,ORDER_ID,Timestamp,GrossValue,DiscountValue,Extra\n"
              "3,A1,2025-04-20 18:03:09,10.50,0.50,x\n"
              "NA,A2,2025-04-21 00:00:00,,0,null\n")
    df = I.load_file(spark, f, SC.REGISTRY["sales"])
    rows = {r.orderid: r for r in df.collect()}
    assert rows["A1"].quantity == 3 and rows["A1"].grossvalue == Decimal("10.50")
    assert rows["A1"].netsale == Decimal("10.0000") and rows["A1"].timestamp == dt.datetime(2025, 4, 20, 18, 3, 9)
    assert rows["A1"].Extra == "x" and rows["A2"].Extra is None
    assert rows["A2"].quantity is None and rows["A2"].grossvalue is None and rows["A2"].netsale is None


def test_alias_order_first_alias_wins(spark):
    df = spark.createDataFrame([("1", "2")], "order_id string, OrderID string")
    out = I.normalize_headers(df, SC.REGISTRY["sales"])
    assert out.columns == ["order_id", "orderid"]
    assert I.header_mapping(["ORDER_ID", "qty"], SC.REGISTRY["sales"]) == {"ORDER_ID": "orderid", "qty": "quantity"}


def test_columns_without_a_spec_get_the_types_of_their_values(spark, tmp_path):
    f = write(tmp_path / "customer_data.csv",
              "CustomerID,a,b,c,d,e,f,g,h,i,j\n"
              "1,1,1.5,True,x,1,NA,99999999999999999999, 7,1e3,True\n"
              "2,-2,2,false,1,True,,1,+8,nan,1\n"
              "3,,inf,TRUE,,,null,2,9,-.5,\n")
    types = dict(I.load_file(spark, f, SC.REGISTRY["customers"]).dtypes)
    assert {c: types[c] for c in "abcdefghij"} == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "double",
                                                   "g": "double", "h": "bigint", "i": "double", "j": "string"}
    rows = {r.customerid: r for r in I.load_file(spark, f, SC.REGISTRY["customers"]).collect()}
    assert (rows["1"].a, rows["1"].c, rows["1"].h, rows["1"].i) == (1, True, 7, 1000.0) and rows["2"].i is None
    assert (rows["2"].b, rows["2"].c, rows["2"].e, rows["3"].a, rows["3"].b) == (2.0, False, "True", None, float("inf"))
    assert I.load_file(spark, f, SC.REGISTRY["customers"], infer=False).schema["a"].dataType.simpleString() == "string"
    # later files must hold values of the stored type
    store = I.TableStore(spark, str(tmp_path / "tables"))
    I.bootstrap(store, str(tmp_path))
    assert I.append_file(store, write(tmp_path / "customer_1.csv", "CustomerID,a,c\n4,40,True\n"))
    assert not I.append_file(store, write(tmp_path / "customer_2.csv", "CustomerID,a\n5,forty\n"))
    assert {r.customerid: (r.a, r.c) for r in store.read("customers").collect()}["4"] == (40, True) and store.read("customers").count() == 4


def test_routing_first_prefix_match():
    assert I.route_file("/in/sales_funnel_1.csv") == "sales"
    assert I.route_file("marketing_campaigns.csv") is None
    assert I.route_file("/x/SALES_x.csv") == "sales"
    assert I.route_file("campaigns_2025.csv") == "marketing_campaigns"


def test_competitor_prices_are_routed_rebuilt_and_refreshed(spark, tmp_path):
    assert I.route_file("competitor_1.csv") == "competitors"
    write(tmp_path / "competitor_data.csv", "Date,Competitor,ProductID,ProductName,Price,OnPromotion\n2025-03-04,Shop,P7,Tea,10.25,True\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    assert I.bootstrap(store, str(tmp_path))["competitors"]
    assert tuple(I.refresh_all(store)["competitors"].first()) == (dt.date(2025, 3, 4), "Shop", "P7", "Tea", Decimal("10.25"), True)


def test_quotes_and_exact_numbers(spark, tmp_path):
    f = write(tmp_path / "sales_q.csv", 'OrderID,ProductName,Quantity,GrossValue\n1,"Vitamin ""C"", 500mg",3.0,1e1\n2,short\n')
    rows = {r.orderid: r for r in I.load_file(spark, f, SC.REGISTRY["sales"]).collect()}
    assert rows["1"].productname == 'Vitamin "C", 500mg' and rows["1"].quantity == 3 and rows["1"].grossvalue == 10
    assert rows["2"].productname == "short" and rows["2"].quantity is None
    big = write(tmp_path / "funnel_b.csv", "Week,Visits\n2025-01-06,9007199254740993\n")
    assert I.load_file(spark, big, SC.REGISTRY["sales_funnel"]).first().visits == 9007199254740993
    out = str(tmp_path / "out")
    I.write_csv(I.load_file(spark, f, SC.REGISTRY["sales"]).select("orderid", "productname"), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"Vitamin ""C"", 500mg"' in text


@pytest.mark.parametrize("rows", ["1,2.7,1\n", "1,2,10.555\n", "1,x,1\n", "1,2,3,4\n", "1,2,3,\n", '1,2,"3\n4"\n'])
def test_files_that_do_not_fit_are_refused(spark, tmp_path, rows):
    store = I.TableStore(spark, str(tmp_path / "tables"))
    bad = write(tmp_path / "sales_bad.csv", f"OrderID,Quantity,GrossValue\n9,1,1\n{rows}")
    assert not I.append_file(store, bad) and not store.exists("sales")


def test_quoted_line_breaks_are_a_choice(spark, tmp_path):
    from dataclasses import replace

    f = write(tmp_path / "customer_1.csv", 'CustomerID,City\n1,"two\nlines"\n2,x\n')
    for choice in (None, True):
        spec = replace(SC.REGISTRY["customers"], multi_line=choice)
        assert {r.customerid: r.city for r in I.load_file(spark, f, spec).collect()} == {"1": "two\nlines", "2": "x"}
    with pytest.raises(ValueError):
        I.load_file(spark, f, replace(SC.REGISTRY["customers"], multi_line=False))
    # only the file that needs it is read whole; a break in the last field, with separators behind it, is seen too
    g = write(tmp_path / "customer_2.csv", "CustomerID,City\n3,y\n")
    h = write(tmp_path / "customer_3.csv", 'CustomerID,City\n4,"a\nb, c"\n')
    rows = I.load_file(spark, [f, g, h], SC.REGISTRY["customers"]).collect()
    assert {r.customerid: r.city for r in rows} == {"1": "two\nlines", "2": "x", "3": "y", "4": "a\nb, c"}


def test_strict_typing_raises_and_lenient_nulls(spark, tmp_path):
    f = write(tmp_path / "sales_bad.csv", "OrderID,Timestamp\nA,not-a-date\n")
    with pytest.raises(Exception):
        I.load_file(spark, f, SC.REGISTRY["sales"]).collect()
    assert I.load_file(spark, f, SC.REGISTRY["sales"], strict=False).first().timestamp is None


def test_append_drift_rejected_missing_column_null(spark, tmp_path):
    store = I.TableStore(spark, str(tmp_path / "tables"))
    good = write(tmp_path / "sales_1.csv",
                 "OrderID,Timestamp,ProductID,Quantity,GrossValue,DiscountValue,CostOfGoodsSold,CustomerID,Channel\n"
                 "A1,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\n")
    assert I.append_file(store, good)
    drifted = write(tmp_path / "sales_2.csv",
                    "OrderID,Timestamp,ProductID,Quantity,Price,GrossValue,DiscountValue,CustomerID\n"
                    "A2,2025-01-02 10:00:00,P1,1,10,10,0,C1\n")
    assert not I.append_file(store, drifted)
    assert store.read("sales").count() == 1
    missing = write(tmp_path / "sales_3.csv",
                    "OrderID,Timestamp,ProductID,Quantity,GrossValue,DiscountValue,CustomerID\n"
                    "A3,2025-01-03 10:00:00,P1,2,10,0,C2\n")
    assert I.append_file(store, missing)
    got = {r.orderid: r.channel for r in store.read("sales").collect()}
    assert got == {"A1": "web", "A3": None}
    assert not I.append_file(store, write(tmp_path / "unknown_1.csv", "a\n1\n"))


def test_safe_load_unknown_and_missing_tables(spark, tmp_path):
    store = I.TableStore(spark, str(tmp_path / "empty"))
    unknown = I.load_table_safely(store, "not_a_table")
    assert unknown.count() == 0 and unknown.columns == []
    missing = I.load_table_safely(store, "deliveries")
    assert missing.count() == 0 and missing.columns == list(SC.DELIVERY_TYPES)
    assert not store.exists("sales")
    assert I.load_predictions(store).columns == ["customerid", "churn_probability"]
    assert set(I.refresh_all(store)) == set(SC.INGESTED)
    assert (I.load(store, "not_a_table").status, I.load(store, "sales").status) == ("unregistered", "missing")
    (tmp_path / "empty" / "sales").mkdir(parents=True)
    (tmp_path / "empty" / "sales" / "part-0.parquet").write_text("no parquet")
    assert I.load(store, "sales").status == "unreadable" and I.load(store, "sales").frame.count() == 0


def test_bootstrap_skips_missing_masters(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    write(src / "funnel_data.csv", "Week,Visits,Carts,Orders\n2025-02-03,9100,870,240\n2025-02-10,8700,910,310\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    done = I.bootstrap(store, str(src))
    assert done["sales_funnel"] and not done["sales"]
    f = I.load_table_safely(store, "sales_funnel")
    assert sorted(tuple(r) for r in f.collect()) == [(dt.date(2025, 2, 3), 9100, 870, 240),
                                                     (dt.date(2025, 2, 10), 8700, 910, 310)]


MASTERS = {"sales_data.csv": "OrderID,Quantity\n{n},1\n", "customer_data.csv": "CustomerID,City\n{n},x\n",
           "funnel_data.csv": "Week,Visits\n2025-02-03,{n}\n"}


@pytest.mark.parametrize("broken", ["customer_data.csv", "funnel_data.csv", None])
def test_rebuild_is_all_or_nothing(spark, tmp_path, broken):
    store, src = I.TableStore(spark, str(tmp_path / "tables")), tmp_path / "src"
    names = {spec.master_file: name for name, spec in SC.INGESTED.items()}
    src.mkdir()
    masters = {f: t for f, t in MASTERS.items() if f in names} | {
        spec.master_file: f"{spec.aliases[c][0]}\n{{n}}\n" for spec in SC.INGESTED.values() if spec.master_file not in MASTERS
        for c in [next(c for c in spec.columns if spec.types[c] == "string")]}
    for f, text in masters.items():
        write(src / f, text.format(n=1))
    I.bootstrap(store, str(src))
    before, old = store.snapshots.manifest(), {n: df.collect() for n, df in I.refresh_all(store).items()}
    assert set(before.tables) == set(SC.INGESTED)
    for f, text in masters.items():
        write(src / f, text.format(n=2) + ("1,2,3,4,5,6,7\n" if f == broken else ""))
    if broken:
        with pytest.raises(Exception):
            I.bootstrap(store, str(src))
        assert store.snapshots.manifest().version == before.version
        assert {n: df.collect() for n, df in I.refresh_all(store).items()} == old
    else:
        lazy = store.read("sales")  # a frame that was made before the rebuild still reads its own snapshot
        I.bootstrap(store, str(src))
        assert store.snapshots.manifest().version == before.version + 1
        assert [r.orderid for r in store.read("sales").collect()] == ["2"] and [r.orderid for r in lazy.collect()] == ["1"]


def test_export_writes_nothing_for_empty_result(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", 5.0)], "customerid string, monetary double")
    assert I.export_csv(df.where("monetary > 10"), str(tmp_path), "top_value_customers") is None
    out = I.export_csv(df.orderBy("monetary"), str(tmp_path), "top_value_customers", day="2025-01-01")
    assert out.endswith("top_value_customers_2025-01-01.csv")
    back = I.read_csv(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == [("a", "5.0"), ("b", "2.0")]


def test_case_duplicate_headers_last_one_wins(spark, tmp_path):
    f = write(tmp_path / "sales_dup.csv", "City,OrderID,CITY,Channel0\nfirst,1,last,web\n")
    df = I.normalize_headers(I.read_csv(spark, f), SC.REGISTRY["sales"])
    r = df.first()
    assert r.city == "last" and r.orderid == "1"
    assert I.source_headers(["City0", "CITY1", "Channel0"]) == ["City", "CITY", "Channel0"]
