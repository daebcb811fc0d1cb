"""The scans' scenario: two tables of 1,024 rows each, ranges, filters and computed values."""

import pytest
from pyspark.sql import functions as F

from cellwright.operators import relational, scan
from cellwright.operators.scan import OPEN, DataCursor, Ordering, ValueRange, exclusive, inclusive


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1024).select("id", F.col("id").alias("DATA_1"), (F.col("id") * 2).alias("DATA_2"))


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_scan_all(rows):
    assert ids(scan.scan_all(rows, "id", ordering=Ordering.FORWARD)) == list(range(1024))
    assert ids(scan.scan_all(rows, "id", ordering=Ordering.BACKWARD)) == list(range(1023, -1, -1))


def test_selection_and_processing(rows):
    assert sorted(ids(scan.scan_all(rows, "id", selection="(and (>= DATA_1 10u64) (< DATA_1 100u64))"))) == list(range(10, 100))
    assert sorted(ids(scan.scan_all(rows, "id", selection="(or (= DATA_1 100u64) (= DATA_1 1000u64))"))) == [100, 1000]
    out = {r.id: int(r.value) for r in scan.scan_all(rows, "id", processing="(+ DATA_1 (u64 DATA_2))").collect()}
    assert out == {i: 3 * i for i in range(1024)}
    # filters see all columns, whatever is projected
    assert scan.scan_all(rows, "id", ["DATA_2"], "(= DATA_1 7)").collect()[0].asDict() == {"DATA_2": 14}


@pytest.mark.parametrize(("r", "want"), [
    (ValueRange(inclusive(5), inclusive(515)), range(5, 516)), (ValueRange(exclusive(5), inclusive(515)), range(6, 516)), (ValueRange(inclusive(5), exclusive(515)), range(5, 515)),
    (ValueRange(exclusive(5), exclusive(515)), range(6, 515)), (ValueRange(OPEN, inclusive(3)), range(4)), (ValueRange(OPEN, exclusive(3)), range(3)),
    (ValueRange(inclusive(1020), OPEN), range(1020, 1024)), (ValueRange(exclusive(1020), OPEN), range(1021, 1024)), (ValueRange(), range(1024)),
])
def test_ranges(rows, r, want):
    assert ids(scan.range_index_scan(rows, "id", "DATA_1", r, ordering=Ordering.FORWARD)) == list(want)


def test_range_bounds_reach_the_files(spark, folder):
    df = scan.range_index_scan(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderkey", "o_orderkey", ValueRange(inclusive(5), exclusive(9)), ["o_custkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "LessThan(o_orderkey,9)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_lookups(rows):
    assert scan.read_cell(rows, "id", 7).head().DATA_2 == 14
    assert scan.read_cell(rows, "id", -1).head() is None
    got = {r.pos: r.DATA_2 for r in scan.read_all_cells(rows, "id", [9, 3, 9, 5000], ["DATA_2"]).collect()}
    assert got == {0: 18, 1: 6, 2: 18, 3: None}


def test_lookups_reach_the_files_or_broadcast(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    few = scan.read_all_cells(orders, "o_orderkey", [3, 9], ["o_custkey"])._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderkey, [3,9])" in few
    many = scan.read_all_cells(orders, "o_orderkey", list(range(1500)), ["o_custkey"])
    assert "BroadcastHashJoin" in many._jdf.queryExecution().executedPlan().toString() and many.count() == 1500


def test_zero_and_negative_values_are_indexed(spark):
    df = spark.createDataFrame([(1, -5), (2, 0), (3, 5), (4, None)], "id int, v int")
    assert ids(scan.range_index_scan(df, "id", "v", ValueRange(inclusive(-9)), ordering=Ordering.FORWARD)) == [1, 2, 3]


def test_array_rows_come_once(spark):
    df = spark.createDataFrame([(1, [1, 5, 6]), (2, [0]), (3, None), (4, [])], "id int, a array<int>")
    assert ids(scan.array_index_scan(df, "a", ValueRange(inclusive(5), inclusive(6)))) == [1]


def test_seek_pages_through_everything(rows):
    seen, after = [], None
    while block := scan.seek(rows, "DATA_1", "id", ValueRange(inclusive(900)), block=50, after=after).collect():
        seen += [r.id for r in block]
        after = (block[-1].DATA_1, block[-1].id)
    assert seen == list(range(900, 1024))


def test_cursor(rows):
    cursor = DataCursor(scan.scan_all(rows, "id", ordering=Ordering.FORWARD))
    assert cursor.next().id == 0
    assert [r.id for r in cursor.next_block()] == list(range(1, 65))
    assert len(list(cursor)) == 1024 - 65
    assert cursor.next() is None


def test_id_cursor_resumes_anywhere(rows):
    df = rows.select("id", (F.col("id") % 7).alias("k")).where("id < 50")
    want = sorted(range(50), key=lambda i: (i % 7, i))
    for ordering, order in ((Ordering.FORWARD, want), (Ordering.BACKWARD, want[::-1])):
        make = lambda position=None: scan.IdCursor(df, "k", "id", ordering=ordering, block=8, position=position)  # noqa: E731, B023
        first, seen = make(), []
        for _ in range(19):
            seen.append(first.current())
            assert first.next()
        assert first.current_block()[0] == first.current() == make(first.position).current()
        second = make(first.position)
        while second.current() is not None:
            seen += second.next_block()
        assert seen == order and not second.next() and second.next_block() == []
    empty = scan.IdCursor(df.where("id < 0"), "k", "id")
    assert empty.current() is None and not empty.next() and empty.position is None


def test_whole_row(rows, spark):
    assert sorted(ids(scan.scan_all(rows, "id", selection="(= (+ data.DATA_1 data.DATA_2) 30)"))) == [10]
    named = spark.sql("select 1 as id, 5 as data")  # a column of this name wins
    assert scan.scan_all(named, "id", processing="(+ data 1)").head().value == 6


def test_nested_projection(spark):
    df = spark.sql("select 1 as id, named_struct('sub1', 4096, 'sub3', 1, 'sub4', named_struct('sub4sub1', 2, 'sub4sub3', array(6, 7))) as sub")
    assert scan.project(df, ["sub.sub3", "sub.sub4.sub4sub3"]).head().asDict() == {"sub3": 1, "sub4sub3": [6, 7]}
    assert scan.project(df).columns == ["id", "sub"]


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, b int")
    groups = {r.k: len(r.rows) for r in relational.join_by([a, b], ["k"]).collect()}
    assert groups == {1: 3, 2: 1, 3: 1, None: 1}
    assert {r.k: r.n_rows for r in relational.join_by_count([a, b], ["k"]).collect()} == groups
    assert relational.natural_join(a, b).count() == 2
    with pytest.raises(KeyError):
        relational.join_by([a, b], ["a"])
    with pytest.raises(ValueError):
        relational.natural_join(a.select("a"), b.select("b"))
    assert [r.k for r in relational.sort_desc(a, "k").collect()] == [None, 2, 1]
    assert relational.limit(a, 50).count() == 3
    assert {r.k: r.a for r in relational.group_by(a, "a", "k").collect()} == {1: ["x"], 2: ["y"], None: ["z"]}
    assert relational.make_source(spark, range(10)).count() == 10
    assert relational.make_source(spark, []).count() == 0
    assert relational.to_vec(a, "a", "int").where("a is null").count() == 3
