import datetime
import re

from conftest import rows_of
from quadrat import bindings as b


def _tables(make, folder) -> str:
    day = [datetime.date(1995, 3, 1), datetime.date(1996, 3, 1)]
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        # Customer 1 is listed twice in one place, customer 3 in two places.
        "customer": ([(1, 0, "M", 1.0), (1, 0, "M", 2.0), (2, 1, "M", 1.0), (3, 0, "M", 1.0), (3, 1, "M", 1.0)],
                     "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "orders": ([(10, 1, day[0]), (11, 1, day[0]), (12, 2, day[1]), (13, 3, None), (14, None, day[0]), (15, 9, day[0])],
                   "o_orderkey long, o_custkey long, o_orderdate date"),
        "part": ([(1, "STANDARD"), (2, "SMALL"), (3, None)], "p_partkey long, p_type string"),
        "lineitem": ([(10, 1, "R"), (10, 1, "R"), (11, 1, "R"), (11, 2, None), (12, 3, "A"), (13, 2, "A"), (14, 1, "R"), (15, 1, "R")],
                     "l_orderkey long, l_partkey long, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        make(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_filled_counts_under_the_key_and_takes_the_place_last(spark, make, tmp_path):
    sf = _tables(make, tmp_path)
    cols = ["subplot", "plot", "year", "species", "shoot", "density"]
    assert rows_of(b.filled(spark, sf), *cols) == sorted([
        ("1", "N0", 1995, "STANDARD", True, 6), ("1", "N0", 1995, "SMALL", False, 2), ("2", "N1", 1996, "STANDARD", False, 0),
        ("3", "N0", None, "SMALL", False, 1), ("3", "N0", None, "STANDARD", False, 0),
        ("3", "N1", None, "SMALL", False, 1), ("3", "N1", None, "STANDARD", False, 0)], key=repr)
    assert rows_of(b.seedlings(spark, sf), *cols[:-1], "n") == sorted([
        ("1", "N0", 1995, "STANDARD", True, 6), ("1", "N0", 1995, "SMALL", None, 2), ("2", "N1", 1996, "0", False, 1),
        ("3", "N0", None, "SMALL", False, 1), ("3", "N1", None, "SMALL", False, 1)], key=repr)
    plan = b.filled(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and not any("subplot#" in line for line in windows)


def test_items_are_dealt_before_they_are_counted(spark, make, tmp_path):
    """A count in the scan would hold nearly all rows of a file split; an order's items are few."""
    plan = b._found(spark, _tables(make, tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    kinds = [line.lstrip(" :+-") for line in plan if not re.search(r"\bProject \[", line)]
    at = next(k for k, line in enumerate(kinds) if line.startswith("Aggregate [l_orderkey"))
    assert kinds[at + 1].startswith("RepartitionByExpression [l_orderkey")


def test_counts_and_places_are_dealt_by_rows(spark, make, tmp_path, monkeypatch):
    """Partitions of a size in bytes would hold millions of counts: they compress well."""
    monkeypatch.setattr(b, "TASK_ROWS", 1)
    sf = _tables(make, tmp_path)
    for rows in (b.filled, b.seedlings):
        plan = rows(spark, sf).groupBy(*b.VISIT, "species", "shoot").count()._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if re.search(r"hashpartitioning\([^)]*(custkey|subplot)#", line)]
        assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
