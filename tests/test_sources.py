from decimal import Decimal

import pytest
from fixture import ROWS, day, rows, tables

from eventbook import session
from eventbook.schema import TABLES
from eventbook.session import run_folder
from eventbook.sources.tables import read_tables, read_text_table, write_tables


def test_round_trip(spark):
    folder = run_folder(spark, "tables")
    t = tables(spark)
    write_tables(t, folder)
    stored = read_tables(spark, folder)
    assert set(stored) == set(TABLES)
    for name in TABLES:
        df = stored[name].select(t[name].columns)
        assert df.dtypes == t[name].dtypes
        assert rows(df) == rows(t[name])
    write_tables({"Payments": t["Payments"]}, folder)
    assert read_tables(spark, folder)["Payments"].count() == 2 * len(ROWS["Payments"])


def test_text_table(spark, tmp_path):
    path = tmp_path / "days.csv"
    path.write_text(
        "WorkshopID,Name,Limit,Start,End,Description,Location,price,ConferenceDayID\n"
        '1,"Bread, basics",20,8:11 AM,00:30 PM,null,Łódź,€1.88,3\n'
        "2,Soup,x,9:00,10:00,warm,Room,$1 000.5,4\n",
        encoding="utf-8",
    )
    df = read_text_table(spark, str(path), "Workshops")
    assert rows(df) == [
        (1, "Bread, basics", 20, 29460, 45000, None, "Łódź", Decimal("1.8800"), 3),
        (2, "Soup", None, 32400, 36000, "warm", "Room", Decimal("1000.5000"), 4),
    ]
    assert day("2020-01-01")


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *args):
            return None

    class Context:
        master = "yarn"
        applicationId = "app"

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())
    Conf.get = lambda self, *args: "hdfs://shared/cut/"
    assert session.checkpoint_root(Session()) == "hdfs://shared/cut"
