import os

import pytest

from ledgerlens.sources import ingest as I
from ledgerlens.sources import snapshots as SN
from ledgerlens.streaming import file_ingest as FI

HEADER = "OrderID,Timestamp,ProductID,Quantity,GrossValue,DiscountValue,CostOfGoodsSold,CustomerID,Channel\n"


def test_two_good_one_bad_run_twice(spark, tmp_path):
    inc = tmp_path / "incoming"
    inc.mkdir()
    (inc / "sales_1.csv").write_text(HEADER + "A1,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\n")
    (inc / "sales_2.csv").write_text(
        "CustomerID,OrderID,Timestamp,ProductID,Quantity,GrossValue,DiscountValue,CostOfGoodsSold,Channel\n"
        "C2,A2,2025-01-02 10:00:00,P2,2,20,0,8,app\nC3,A3,2025-01-03 10:00:00,P3,1,5,0,1,web\n")
    (inc / "sales_bad.csv").write_text(
        "OrderID,Timestamp,ProductID,Quantity,Price,GrossValue,DiscountValue,CostOfGoodsSold,CustomerID,Channel\n"
        "B1,2025-01-01 10:00:00,P1,1,10,10,0,4,C1,web\n")
    (inc / "notes.csv").write_text("a\n1\n")
    # the first file creates the table so the drifted one is judged against it
    store = I.TableStore(spark, str(tmp_path / "tables"))
    archive = str(tmp_path / "archive")
    ckpt = str(tmp_path / "ckpt")
    for _ in range(2):
        FI.run_once(spark, str(inc), store, archive, ckpt)
    sales = store.read("sales")
    assert sorted(r.orderid for r in sales.collect()) == ["A1", "A2", "A3"]
    assert {r.orderid: r.customerid for r in sales.collect()} == {"A1": "C1", "A2": "C2", "A3": "C3"}
    assert sorted(os.listdir(archive)) == ["sales_1.csv", "sales_2.csv"]
    assert sorted(os.listdir(inc)) == ["notes.csv", "sales_bad.csv"]
    rejected = {os.path.basename(r.path) for r in store.read(FI.REJECTED).collect()}
    assert rejected == {"notes.csv", "sales_bad.csv"}


def test_replayed_batch_does_not_duplicate(spark, tmp_path):
    inc = tmp_path / "in"
    inc.mkdir()
    p = inc / "sales_9.csv"
    p.write_text(HEADER + "A9,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    path = "file:" + str(p)
    state = FI._state(spark, path)
    FI.process_batch(store, str(tmp_path / "arch"), [state], batch_id=7)
    # the same file is back: its move had not happened yet
    os.rename(tmp_path / "arch" / "sales_9.csv", p)
    assert FI._state(spark, path) == state
    FI.process_batch(store, str(tmp_path / "arch"), [state], batch_id=7)
    assert store.read("sales").count() == 1 and not p.exists()


def dropped(tmp_path):
    inc = tmp_path / "in"
    inc.mkdir()
    (inc / "sales_1.csv").write_text(HEADER + "A1,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\nA2,2025-01-01 11:00:00,P1,1,10,1,4,C1,web\n")
    (inc / "customer_1.csv").write_text("CustomerID,City\nC1,Riyadh\n")
    (inc / "notes.csv").write_text("a\n1\n")
    return inc


class Crash(BaseException):
    """Not an error that any handler would take."""


@pytest.mark.parametrize("target, name, before", [
    ("Change", "_write", 0), ("Change", "_write", 1), ("Change", "_write", 2), ("Change", "_write", 3), ("Change", "publish", 0),
    ("Change", "_rename", 0), ("ingest", "archive_file", 0), ("ingest", "archive_file", 1)])
def test_a_crash_at_any_step_leaves_every_row_once(spark, tmp_path, monkeypatch, target, name, before):
    inc, store = dropped(tmp_path), I.TableStore(spark, str(tmp_path / "tables"))
    owner = SN.Change if target == "Change" else FI
    real, calls = getattr(owner, name), []

    def crashing(*args, **kw):
        calls.append(1)
        if len(calls) > before:
            if name == "_write":  # some files of the job are there, its commit did not come
                folder = tmp_path / "tables" / args[2] / "000000000001-half"
                folder.mkdir(parents=True)
                (folder / "part-00000.parquet").write_text("half a file")
            raise Crash
        return real(*args, **kw)

    monkeypatch.setattr(owner, name, crashing)
    files = FI.incoming_files(spark, str(inc))
    with pytest.raises(Crash):
        FI.process_batch(store, str(tmp_path / "arch"), files, batch_id=1)
    monkeypatch.undo()
    there = store.exists("sales")
    assert there == (name == "archive_file") == store.exists("customers") == store.exists(FI.LEDGER)
    for _ in range(2):  # the next run of a restarted ingest, and one more
        FI.process_batch(store, str(tmp_path / "arch"), FI.incoming_files(spark, str(inc)), batch_id=2)
        assert sorted(r.orderid for r in store.read("sales").collect()) == ["A1", "A2"] and store.read("customers").count() == 1
        assert store.read(FI.REJECTED).count() == 1 and store.read(FI.LEDGER).count() == 3
    assert sorted(os.listdir(tmp_path / "arch")) == ["customer_1.csv", "sales_1.csv"] and os.listdir(inc) == ["notes.csv"]


def test_the_second_of_two_ingests_starts_again(spark, tmp_path, monkeypatch):
    inc, store = dropped(tmp_path), I.TableStore(spark, str(tmp_path / "tables"))
    other, real, calls = I.TableStore(spark, str(tmp_path / "tables")), SN.Change.publish, []

    def publish(self):
        calls.append(1)
        if len(calls) == 1:  # the other one is faster
            FI.process_batch(other, str(tmp_path / "arch"), FI.incoming_files(spark, str(inc)), batch_id=5)
        return real(self)

    monkeypatch.setattr(SN.Change, "publish", publish)
    FI.process_batch(store, str(tmp_path / "arch"), FI.incoming_files(spark, str(inc)), batch_id=1)
    assert store.read("sales").count() == 2 and store.read("customers").count() == 1


def test_quoted_line_breaks_are_streamed(spark, tmp_path):
    inc, store = tmp_path / "in", I.TableStore(spark, str(tmp_path / "tables"))
    inc.mkdir()
    (inc / "customer_1.csv").write_text('CustomerID,City\nC1,"two\nlines"\n')
    (inc / "customer_2.csv").write_text("CustomerID,City\nC2,x\n")
    FI.run_once(spark, str(inc), store, str(tmp_path / "archive"))
    assert {r.customerid: r.city for r in store.read("customers").collect()} == {"C1": "two\nlines", "C2": "x"}


def test_ledger_files_do_not_follow_the_batches(spark, tmp_path):
    store = SN.Snapshots(spark, str(tmp_path / "tables"), fanout=3)
    for i in range(28):
        change = store.change()
        change.append("_log", spark.createDataFrame([(f"f{i}", i)], "path string, n long").coalesce(1), key="path")
        change.publish()
    table = store.manifest().tables["_log"]
    assert len(table.folders) <= 2 * 4 and max(f.level for f in table.folders) == 3  # under 3 of each of 4 levels
    assert sorted(r.n for r in store.read("_log").collect()) == list(range(28))
    some = store.read("_log", keys=["f3"])
    assert [r.n for r in some.where("path = 'f3'").collect()] == [3] and some.count() < 28  # other buckets stay closed
    assert store.vacuum() > 20
    files = [f for _, _, names in os.walk(tmp_path / "tables") for f in names if f.endswith(".parquet")]
    assert len(files) <= SN.BUCKETS * 8 and store.read("_log").count() == 28


def test_a_bad_file_does_not_hold_back_a_good_one(spark, tmp_path):
    inc, store = tmp_path / "in", I.TableStore(spark, str(tmp_path / "tables"))
    inc.mkdir()
    (inc / "sales_good 1.csv").write_text(HEADER + "A1,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\n")
    (inc / "sales_bad.csv").write_text(HEADER + "A2,no date,P1,1,10,1,4,C1,web\n")
    (inc / "sales_long.csv").write_text(HEADER + "A3,2025-01-01 10:00:00,P1,1,10,1,4,C1,web,extra\n")
    (inc / "competitor_1.csv").write_text("Competitor,ProductName,Price\nShop,Tea,2\n")
    FI.run_once(spark, str(inc), store, str(tmp_path / "archive"))
    assert [r.orderid for r in store.read("sales").collect()] == ["A1"] and store.read("competitors").count() == 1
    assert sorted(os.listdir(inc)) == ["sales_bad.csv", "sales_long.csv"]
    reasons = {os.path.basename(r.path): r.reason for r in store.read(FI.REJECTED).collect()}
    assert "timestamp" in reasons["sales_bad.csv"] and "more fields" in reasons["sales_long.csv"]
    (inc / "sales_bad.csv").write_text(HEADER + "A2,2025-01-02 10:00:00,P1,1,10,1,4,C1,web\n")  # mended
    FI.run_once(spark, str(inc), store, str(tmp_path / "archive"))
    assert sorted(r.orderid for r in store.read("sales").collect()) == ["A1", "A2"]


def test_the_same_name_next_day_is_a_new_file(spark, tmp_path):
    inc, store = tmp_path / "in", I.TableStore(spark, str(tmp_path / "tables"))
    inc.mkdir()
    for day in (1, 2):
        (inc / "sales_daily.csv").write_text(HEADER + f"D{day},2025-01-0{day} 10:00:00,P1,1,10,1,4,C1,web\n")
        os.utime(inc / "sales_daily.csv", (1_700_000_000 + day, 1_700_000_000 + day))
        FI.run_once(spark, str(inc), store, str(tmp_path / "archive"))
    assert sorted(r.orderid for r in store.read("sales").collect()) == ["D1", "D2"]
    assert len(os.listdir(tmp_path / "archive")) == 2 and not os.listdir(inc)


def test_polling_trigger_picks_up_new_files(spark, tmp_path):
    inc = tmp_path / "poll"
    inc.mkdir()
    (inc / "sales_a.csv").write_text(HEADER + "P1,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    q = FI.start_file_ingest(spark, str(inc), store, str(tmp_path / "archive"), str(tmp_path / "ckpt"),
                             interval="1 second")
    try:
        q.processAllAvailable()
        (inc / "sales_b.csv").write_text(HEADER + "P2,2025-01-02 10:00:00,P2,2,20,0,8,app\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.orderid for r in store.read("sales").collect()) == ["P1", "P2"]
    assert sorted(os.listdir(tmp_path / "archive")) == ["sales_a.csv", "sales_b.csv"]


def test_stream_into_a_rebuilt_table_keeps_its_schema(spark, tmp_path):
    src = tmp_path / "masters"
    src.mkdir()
    (src / "sales_data.csv").write_text(HEADER + "M1,2025-01-01 10:00:00,P1,1,10,1,4,C1,web\n")
    store = I.TableStore(spark, str(tmp_path / "tables"))
    I.bootstrap(store, str(src))
    before = store.read("sales").columns
    inc = tmp_path / "in"
    inc.mkdir()
    (inc / "sales_new.csv").write_text(HEADER + "M2,2025-01-02 10:00:00,P2,2,20,0,8,app\n")
    FI.run_once(spark, str(inc), store, str(tmp_path / "arch"), str(tmp_path / "ck"))
    after = store.read("sales")
    assert after.columns == before
    assert sorted(r.orderid for r in after.collect()) == ["M1", "M2"]


def test_packed_files_are_ingested_and_archived_under_free_names(spark, tmp_path):
    """Packed CSV drops come by the stream like plain ones."""
    from ledgerlens.sources import ingest as I
    from ledgerlens.streaming import file_ingest as FI

    inc, arch = tmp_path / "in", tmp_path / "arch"
    store = I.TableStore(spark, str(tmp_path / "tables"))
    for n in (1, 2):
        df = spark.createDataFrame([(f"o{n}", f"p,{n}", "1")], "OrderID string, ProductID string, Quantity string").coalesce(1)
        I.write_csv(df, str(tmp_path / f"staging{n}"), packed=True)
        assert [p.endswith("sales_day_00000.csv.gz") for p in FI.publish_parts(spark, str(tmp_path / f"staging{n}"), str(inc), "sales_day")] == [True]
        FI.run_once(spark, str(inc), store, str(arch))
    assert sorted((r.orderid, r.productid) for r in store.read("sales").collect()) == [("o1", "p,1"), ("o2", "p,2")]
    assert len([p for p in arch.iterdir() if p.name.endswith(".csv.gz")]) == 2


def test_a_frame_is_split_into_packed_csv_folders_in_one_pass(spark, tmp_path):
    """the master file and the last day's file."""
    from ledgerlens.sources import ingest as I

    df = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", None)], "name string, last boolean")
    paths = {v: str(tmp_path / f"out{v}") for v in (False, True)}
    I.write_csv_split(df, "last", paths, str(tmp_path / "scratch"))
    read = lambda v: I.read_csv(spark, paths[v])
    assert read(True).columns == ["name"] and [r.name for r in read(True).collect()] == ["a"]
    assert sorted(r.name for r in read(False).collect()) == ["b", "c"]
    I.write_csv_split(df.where("last"), "last", paths := {v: str(tmp_path / f"more{v}") for v in (False, True)}, str(tmp_path / "scratch2"))
    assert read(True).count() == 1 and os.path.isdir(paths[False])
