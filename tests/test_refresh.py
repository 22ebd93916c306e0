"""Derived tables that follow their source by month."""

import os

from ledgerlens.operators import sales as S
from ledgerlens.plans import refresh as R
from ledgerlens.sources import ingest as I
from ledgerlens.sources import schemas as SC
from ledgerlens.streaming import file_ingest as FI

HEADER = "OrderID,Timestamp,ProductID,Quantity,GrossValue,DiscountValue,CostOfGoodsSold,CustomerID,Channel\n"


def row(order, stamp):
    return f"{order},{stamp},P1,1,10,1,4,C1,web\n"


def whole(store):
    return sorted(map(tuple, S.enrich_sales(store.read("sales").drop("_source_file", "_batch_id")).collect()), key=str)


def derived(store):
    return sorted(map(tuple, R.months(store, "sales_months").collect()), key=str)


def test_a_days_file_rewrites_its_month_only(spark, tmp_path):
    src, inc = tmp_path / "src", tmp_path / "in"
    src.mkdir(), inc.mkdir()
    (src / "sales_data.csv").write_text(HEADER + "".join(row(f"A{m}{d}", f"2025-{m:02}-{d:02} 10:00:00") for m in range(1, 7) for d in (1, 15))
                                        + row("N1", ""))
    (src / "delivery_data.csv").write_text("DeliveryID,OrderID,OrderDate,PromisedDate\nD1,A11,2025-01-01 00:00:00,2025-01-03 00:00:00\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    I.bootstrap(store, str(src), {"sales": SC.spec_for("sales")})
    assert R.refresh(store) == {"sales_months": [0, *(202500 + m for m in range(1, 7))]}
    assert derived(store) == whole(store) and len(derived(store)) == 13
    assert R.refresh(store) == {"sales_months": []}  # nothing new: nothing is written
    before = {f.path for f in store.snapshots.manifest().tables["sales_months"].folders}
    (inc / "sales_day.csv").write_text(HEADER + row("A61", "2025-06-30 10:00:00") + row("A99", "2025-06-30 11:00:00"))
    FI.run_once(spark, str(inc), store, str(tmp_path / "arch"))
    assert R.refresh(store) == {"sales_months": [202506]}
    after = {f.path for f in store.snapshots.manifest().tables["sales_months"].folders}
    assert len(before - after) == 1 and len(after - before) == 1  # six of seven folders are the same ones
    new = (after - before).pop()
    assert os.listdir(tmp_path / "tables" / os.path.dirname(new)).count("fact_month=202506") == 1
    assert derived(store) == whole(store) and len(derived(store)) == 15
    ranged = R.months(store, "sales_months", "2025-05-02", "2025-06-01")
    assert ranged.count() == 6 and len(ranged.inputFiles()) <= 4  # two months' files only
    assert R.months(store, "sales_months", end="2025-01-31").count() == 2  # rows without a date are in no range


def test_replaced_and_merged_sources_are_derived_anew(spark, tmp_path):
    src, inc = tmp_path / "src", tmp_path / "in"
    src.mkdir(), inc.mkdir()
    (src / "sales_data.csv").write_text(HEADER + row("A1", "2025-01-01 10:00:00") + row("A2", "2025-02-01 10:00:00"))
    store = I.TableStore(spark, str(tmp_path / "tables"))
    I.bootstrap(store, str(src))
    R.refresh(store)
    (src / "sales_data.csv").write_text(HEADER + row("B1", "2025-03-01 10:00:00"))
    I.bootstrap(store, str(src))
    assert R.refresh(store)["sales_months"] == [202503] and derived(store) == whole(store) and len(derived(store)) == 1
    for i in (1, 2):
        (inc / f"sales_{i}.csv").write_text(HEADER + row(f"C{i}", "2025-03-02 10:00:00"))
        FI.run_once(spark, str(inc), store, str(tmp_path / "arch"))
        if i == 1:
            R.refresh(store)
    store.snapshots.compact("sales")  # covered and new rows in one folder
    assert len(store.snapshots.manifest().tables["sales"].folders) == 1
    R.refresh(store)
    assert derived(store) == whole(store) and len(derived(store)) == 3
    store.snapshots.compact("sales")
    assert R.refresh(store)["sales_months"] == []
    store.snapshots.vacuum()
    assert len(derived(store)) == 3


def test_refresh_takes_deliveries_too(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    spec = SC.spec_for("deliveries")
    (src / spec.master_file).write_text("DeliveryID,OrderID,OrderDate,PromisedDate,ActualDeliveryDate\n"
                                        "D1,A1,2025-01-01 00:00:00,2025-01-03 00:00:00,2025-01-02 00:00:00\n"
                                        "D2,A2,2025-02-01 00:00:00,2025-02-03 00:00:00,\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    I.bootstrap(store, str(src))
    assert R.refresh(store) == {"deliveries_months": [202501, 202502]}
    assert {r.deliveryid: r.on_time for r in R.months(store, "deliveries_months").collect()} == {"D1": True, "D2": False}
