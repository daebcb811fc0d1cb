"""Schemas, registry, record tables, transactions, statistics and streams."""

import datetime
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.client import Client
from cellwright.operators import stats
from cellwright.operators.kv import CellAlreadyExisted, CellDoesNotExist, CommitConflict, RecordTable
from cellwright.operators.scan import Ordering, ValueRange, inclusive
from cellwright.operators.txn import Aborted, Transaction, transaction
from cellwright.registry import IdExists, NameExists, SchemaNotFound, SchemaRegistry
from cellwright.streaming.changelog import fold_batch, upsert_stream
from cellwright.streaming.sources import file_stream, repeat_stream
from cellwright.types import DYNAMIC, Field, IndexKind, Schema, SchemaMismatch, record_id

PERSON = (Field("id", "i64", indices=(IndexKind.STATISTICS,)), Field("name", "string"), Field("score", "u64", indices=(IndexKind.RANGED,)))


def person(name="person", **options):
    return Schema(name, PERSON, "id", **options)


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string, score long")


@pytest.fixture()
def table(spark, tmp_path):
    return RecordTable(spark, str(tmp_path / "t"), person().struct(), "id")


def state(t):
    return {r.id: (r.name, int(r.score)) for r in t.current().collect()}


# schemas

def test_types_and_paths():
    s = Schema("deep", (Field("id", "i64"), Field("nums", "u32", True, True), Field("sub", fields=(Field("a", "pos2d32"), Field("list", is_array=True, fields=(Field("x", "u8"),))))), "id")
    assert s.struct().simpleString() == "struct<id:bigint,nums:array<bigint>,sub:struct<a:struct<x:float,y:float>,list:array<struct<x:smallint>>>>"
    assert s.field("sub.list").is_array and s.field("sub.list.x").type == "u8"
    assert s.width(["id", "nums", "nope"]) == 8 + 4 * 32 + 32
    with pytest.raises(KeyError):
        s.field("sub.b")
    with pytest.raises(SchemaMismatch):
        Schema("bad", PERSON, "nope")


def test_checks(spark):
    s = person()
    assert s.check(people(spark, (1, "a", 2))).count() == 1
    with pytest.raises(SchemaMismatch):
        s.check(spark.sql("select 1 as id"))
    with pytest.raises(SchemaMismatch):
        s.check(people(spark, (1, "a", 2)).withColumn("more", F.lit(1)))
    with pytest.raises(Exception, match="null in required field name"):
        s.check(people(spark, (1, None, 2))).collect()
    nested = Schema("n", (Field("id", "i64"), Field("sub", fields=(Field("a", "i32"), Field("b", "i32", True)))), "id")
    with pytest.raises(Exception, match="sub.a"):
        nested.check(spark.sql("select 1L as id, named_struct('a', cast(null as int), 'b', 2) as sub")).collect()
    assert nested.check(spark.sql("select 1L as id, named_struct('a', 1, 'b', cast(null as int)) as sub")).count() == 1


def test_dynamic_fields(spark):
    s = person(is_dynamic=True)
    df = s.check(spark.createDataFrame([(100, "Jack", 70, 2010, "CS")], "id long, name string, score long, year int, major string"))
    assert df.select(F.variant_get(DYNAMIC, "$.year", "int"), F.variant_get(DYNAMIC, "$.major", "string")).head() == (2010, "CS")
    assert s.check(people(spark, (2, "John", 80))).where(F.col(DYNAMIC).isNull()).count() == 1


def test_record_ids(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long").select(record_id(7, F.col("k")).alias("id"))
    ids = [r.id for r in df.collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] is None


def test_registry(spark):
    r, events = SchemaRegistry(), []
    r.subscribe(lambda what, s: events.append((what, s.name)))
    assert r.new_schema_with_id(person("a"), 1) == 1
    assert r.new_schema(person("b")) == 2
    with pytest.raises(NameExists):
        r.new_schema(person("a"))
    with pytest.raises(IdExists):
        r.new_schema_with_id(person("c"), 2)
    assert r.new_schema(person("c")) not in (1, 2)  # the failed registration left nothing
    r.del_schema("a")
    with pytest.raises(SchemaNotFound):
        r.del_schema("a")
    assert [s.name for s in r.get_all()] == ["b", "c"] and r.get(2).name == "b"
    assert events == [("add", "a"), ("add", "b"), ("add", "c"), ("delete", "a")]
    assert r.empty_table(spark, "b").count() == 0 and r.list_tables(spark).count() == 2


# record tables

def test_write_update_remove(spark, table):
    table.insert(people(spark, (100, "Jack", 70), (2, "John", 80)))
    with pytest.raises(CellAlreadyExisted):
        table.insert(people(spark, (100, "Jack", 1)))
    with pytest.raises(CellAlreadyExisted):
        table.insert(people(spark, (5, "x", 1), (5, "y", 1)))
    table.update(people(spark, (2, "John", 95)))
    with pytest.raises(CellDoesNotExist):
        table.update(people(spark, (9, "x", 1)))
    table.update_by("id = 2", {"score": "score + 5"})
    assert state(table) == {100: ("Jack", 70), 2: ("John", 100)}
    assert table.head(2).head()["_version"] == 3
    table.remove(spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(CellDoesNotExist):
        table.remove(spark.createDataFrame([(2,)], "id long"))
    assert state(table) == {100: ("Jack", 70)} and table.get(2) is None
    table.insert(people(spark, (2, "Back", 1)))  # a record that comes back is seen
    assert state(table)[2] == ("Back", 1)
    table.remove_by("score < 10")
    assert table.count() == 1
    assert state_at(table, 1) == {100, 2}


def state_at(t, version):
    return {r.id for r in t.current(version).collect()}


def test_compaction_and_archive(spark, table, tmp_path):
    table.insert(people(spark, *[(i, "x", i) for i in range(16)]))
    table.remove_by("id % 2 = 0")
    before = state(table)
    table.compact(1)
    assert state(table) == before and set(before) == set(range(1, 16, 2))
    assert table.vacuum() == 2 and state(table) == before
    table.upsert(people(spark, (1, "y", 7)))
    assert state(table)[1] == ("y", 7) and table.head(1).head()["_version"] == 2
    table.archive(str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 8
    assert table.dump().count() == 8


def test_commits_never_overwrite(spark, table):
    table.insert(people(spark, (1, "a", 1)))
    rows = people(spark, (2, "b", 2)).withColumn("_op", F.lit("put"))
    table.write_changes(rows, 1)
    with pytest.raises(CommitConflict):
        table.write_changes(rows, 1)
    assert table.version() == 2


def test_changes_compute_their_rows_once(spark, table):
    """However often a change is joined, its rows are computed once: the check and the commit can't see different ones."""
    n = spark.sparkContext.accumulator(0)

    def seen(i):
        n.add(1)
        return i

    def computed(change, *rows):
        before = n.value
        change(people(spark, *rows).withColumn("id", F.udf(seen, "long")("id")))
        return n.value - before

    assert computed(table.insert, (1, "a", 1), (2, "b", 2), (3, "c", 3)) == 3
    assert computed(table.update, (1, "d", 4), (2, "e", 5)) == 2
    assert computed(table.upsert, (2, "f", 6), (4, "g", 7)) == 2
    assert computed(table.insert, (5, "h", 8)) == 1
    assert computed(table.remove, (3, "", 0), (5, "", 0)) == 2
    assert state(table) == {1: ("d", 4), 2: ("f", 6), 4: ("g", 7)}
    assert {r.id: r._version for r in table.head().collect()} == {1: 2, 2: 3, 4: 1}


def test_refused_changes_leave_nothing(spark, table):
    import os

    table.insert(people(spark, (1, "a", 1)))
    for change, rows, error in (
        (table.insert, [(1, "b", 2), (2, "b", 2)], CellAlreadyExisted), (table.insert, [(3, "b", 2), (3, "c", 2)], CellAlreadyExisted), (table.update, [(1, "b", 2), (4, "b", 2), (None, "c", 3)], CellDoesNotExist),
        (table.remove, [(1, "", 0), (4, "", 0)], CellDoesNotExist)):
        with pytest.raises(error) as refused:
            change(people(spark, *rows))
        assert set(refused.value.keys) == {CellAlreadyExisted: {rows[0][0]}, CellDoesNotExist: {r[0] for r in rows} - {1}}[error]
    assert state(table) == {1: ("a", 1)} and table.version() == 1
    assert len(os.listdir(f"{table.path}/data")) == 1 and not any(files for _, _, files in os.walk(f"{table.path}/staged"))


def test_large_sides_are_joined_once(spark):
    """Only keys that may be broadcast narrow the table first; large ones would be computed and sorted twice in one task."""
    from cellwright.operators.kv import insert_if_absent, update_existing

    table, small, large = spark.range(1 << 21), spark.range(5, 15), spark.range(10, (1 << 21) + 7)
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    for join in (update_existing, insert_if_absent):
        assert (reads(join(table, small, "id")), reads(join(table, large, "id"))) == (3, 2)
    assert (update_existing(table, small, "id").count(), update_existing(table, large, "id").count()) == (10, (1 << 21) - 10)
    assert (insert_if_absent(table, small, "id").count(), insert_if_absent(table, large, "id").count()) == (0, 7)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["put", "remove"]), st.integers(0, 4), st.integers(0, 99)), min_size=1, max_size=20))
def test_latest_matches_a_dictionary(spark, ops):
    from cellwright.operators.kv import latest

    want = {}
    for op, k, v in ops:
        want.pop(k, None) if op == "remove" else want.__setitem__(k, v)
    df = spark.createDataFrame([(k, v, op, i) for i, (op, k, v) in enumerate(ops)], "k int, v int, op string, i int")
    assert {r.k: r.v for r in latest(df, "k", ["i"], F.col("op") == "remove").collect()} == want


# transactions

def test_workspace(spark, table):
    table.insert(people(spark, (1, "a", 1)))
    t = Transaction(table)
    t.write({"id": 2, "name": "b", "score": 2})
    assert t.read(2)["name"] == "b" and t.read_selected(1, ["score"]) == {"score": 1}
    with pytest.raises(CellAlreadyExisted):
        t.write({"id": 1, "name": "x", "score": 0})
    with pytest.raises(CellDoesNotExist):
        t.update({"id": 7, "name": "x", "score": 0})
    with pytest.raises(KeyError):
        t.read_selected(1, ["nope"])
    t.remove(2)
    with pytest.raises(CellDoesNotExist):
        t.remove(2)
    t.remove(1)
    t.upsert({"id": 1, "name": "again", "score": 5})
    t.commit()
    assert state(table) == {1: ("again", 5)}
    with pytest.raises(RuntimeError):
        t.read(1)


def test_conflicts_and_abort(spark, table):
    table.insert(people(spark, (1, "a", 0), (2, "b", 0)))
    a, b, c = Transaction(table), Transaction(table), Transaction(table)
    a.update(a.read(1) | {"score": 1})
    b.update(b.read(1) | {"score": 2})
    c.update(c.read(2) | {"score": 3})
    a.commit()
    with pytest.raises(CommitConflict):
        b.commit()
    c.commit()  # other keys
    assert state(table) == {1: ("a", 1), 2: ("b", 3)}

    def give_up(t):
        t.remove(1)
        raise Aborted

    with pytest.raises(Aborted):
        transaction(table, give_up)
    assert len(state(table)) == 2


def test_write_skew_is_refused(spark, table):
    table.insert(people(spark, (1, "a", 1), (2, "b", 1)))
    a, b = Transaction(table), Transaction(table)
    for t, mine in ((a, 1), (b, 2)):
        assert t.read(1)["score"] + t.read(2)["score"] == 2
        t.update(t.read(mine) | {"score": 0})
    a.commit()
    with pytest.raises(CommitConflict):
        b.commit()


def test_concurrent_counter(spark, table):
    table.insert(people(spark, (1, "a", 0)))

    def up(_):
        transaction(table, lambda t: t.update(t.read(1) | {"score": int(t.read(1)["score"]) + 1}))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(up, range(6)))
    assert state(table) == {1: ("a", 6)}


# statistics

def test_partition_histograms(spark):
    parts = {10: (1, list(range(10))), 100: (1, list(range(100))), 200: (2, [*range(0, 200, 2), 199]), 300: (3, [*range(0, 300, 3), 299]), 3: (1, [0, 1, 2]), 250: (2, [*range(0, 200, 2), 249])}
    df = spark.createDataFrame([(n, v) for n in parts for v in reversed(range(n))] + [(10, None), (7, 1), (7, 1)] + [(101, 5)] * 101, "part int, v int")
    got = {r.part: (r.depth, r["keys"]) for r in stats.partition_histograms(df, "v", "part").collect()}
    assert got == parts | {7: (1, [1, 1]), 101: (1, [5] * 100)}


@pytest.mark.parametrize("parts", [[([2, 7, 18, 25], 4), ([3, 15, 24, 30], 5)], [(list(range(1024)), 1), (list(range(1024)), 2), (list(range(1025)), 3)], [([5], 1)]])
def test_merged_histograms(parts):
    keys = stats.merge_histograms(parts)
    assert len(keys) == 101 and keys == sorted(keys)
    assert keys[0] == min(k for ks, _ in parts for k in ks) and keys[-1] == max(k for ks, _ in parts for k in ks)


def test_table_statistics(spark):
    s = person()
    df = spark.range(8192).select("id", F.lit("Jack").alias("name"), (60 + F.col("id") % 40).cast("decimal(20,0)").alias("score"))
    got = stats.schema_statistics(df, ["id", "score"], s)
    assert got.count == 8192 and set(got.histograms) == {"id", "score"}
    assert len(got.histograms["id"]) == 101 and got.histograms["id"][0] == 0 and got.histograms["id"][-1] == 8191
    assert got.histograms["score"] == sorted(got.histograms["score"])
    cost = stats.range_cost(got, s, "id", ValueRange(inclusive(0), inclusive(4096)), ["id"])
    assert 0.45 < cost.rows / 8192 < 0.55 and cost.row_bytes == 8
    assert stats.range_cost(got, s, "name", ValueRange()) is None
    assert stats.choose(got, s, "id", ValueRange(inclusive(0), inclusive(9))) == "range"
    assert stats.choose(got, s, "name", ValueRange()) == "scan"
    assert stats.total_cost([stats.scan_cost(got, s, ["id"])] * 2) == 2 * 8 * 8192
    assert stats.histogram(df.where("id < 0"), "id") == []
    assert stats.histogram(df.where("id < 50"), "id") == list(range(50))


# the client and streams

def test_client(spark, tmp_path):
    one, two = Client(spark, str(tmp_path / "1")), Client(spark, str(tmp_path / "2"))
    for c in (one, two):
        c.new_schema(person("test"))
    one.write("test", people(spark, *[(i, "n", 3 * i) for i in range(20)]))
    assert one.count("test") == 20 and two.count("test") == 0
    assert [r.id for r in one.range_index_scan("test", "score", ValueRange(inclusive(3), inclusive(9))).collect()] == [1, 2, 3]
    assert [r.id for r in one.scan_all("test", ["id"], "(> score 50)", ordering=Ordering.BACKWARD).collect()] == [19, 18, 17]
    with pytest.raises(ValueError):
        one.range_index_scan("test", "name", ValueRange())
    with pytest.raises(Exception, match="required field"):
        one.write("test", people(spark, (99, None, 1)))
    one.transaction("test", lambda t: t.update(t.read(0) | {"score": 1}))
    one.remove("test", spark.createDataFrame([(5,)], "id long"))
    assert one.count("test") == 19 and one.table("test").get(0)["score"] == 1
    assert set(one.statistics("test").histograms) == {"id", "score"}
    one.del_schema("test")
    assert one.get_all_schema() == []


def test_late_events(spark, table):
    kind = "id long, name string, score long, ts timestamp"
    at = lambda d: datetime.datetime(2024, 1, d)
    batch = lambda *rows: fold_batch(table, spark.createDataFrame(list(rows), kind), "ts", "name = 'gone'")
    batch((1, "new", 5, at(5)), (2, "gone", 0, at(5)), (3, "x", 1, at(1)))
    batch((1, "late", 4, at(4)), (2, "late", 4, at(4)), (3, "y", 2, at(2)), (4, "z", 3, at(1)))
    assert state(table) == {1: ("new", 5), 3: ("y", 2), 4: ("z", 3)}
    table.compact()
    batch((1, "late", 4, at(4)), (3, "late", 4, at(1)))
    assert state(table) == {1: ("new", 5), 3: ("y", 2), 4: ("z", 3)}
    with pytest.raises(ValueError):
        fold_batch(table, spark.createDataFrame([(1, "a", 1, "x")], "id long, name string, score long, ts string"), "ts")


def test_dead_writers_hold_up_no_one(spark, table, monkeypatch):
    import os

    table.insert(people(spark, (1, "a", 1)))

    class Killed(Exception):
        pass

    def die(*_):
        raise Killed

    for step in ("_take_name", "_publish"):  # before the commit gets its name, and before its file is written
        with monkeypatch.context() as m:
            m.setattr(table, step, die)
            with pytest.raises(Killed):
                table.upsert(people(spark, (1, "b", 2)))
    folder = f"{table.path}/commits"
    for left in (f"{2:020d}.claim", ".aside"):  # what a writer may leave
        open(os.path.join(folder, left), "w").close()
    assert state(table) == {1: ("a", 1)}
    assert table.upsert(people(spark, (1, "c", 3))) == 2 and state(table) == {1: ("c", 3)}
    with pytest.raises(CommitConflict):
        table.write_changes(people(spark, (1, "d", 4)).withColumn("_op", F.lit("put")), 1)
    assert state(table) == {1: ("c", 3)}


def test_upsert_stream(spark, tmp_path, table):
    source = str(tmp_path / "in")
    t0 = datetime.datetime(2024, 1, 1)
    kind = "id long, name string, score long, ts timestamp"
    spark.createDataFrame([(1, "a", 1, t0), (1, "b", 2, t0 + datetime.timedelta(1)), (2, "c", 3, t0)], kind).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    upsert_stream(table, file_stream(spark, source, schema), "ts", str(tmp_path / "cp"), "name = 'gone'").awaitTermination()
    assert state(table) == {1: ("b", 2), 2: ("c", 3)}
    spark.createDataFrame([(2, "gone", 0, t0), (3, "d", 4, t0)], kind).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(table, file_stream(spark, source, schema), "ts", str(tmp_path / "cp"), "name = 'gone'").awaitTermination()
    assert state(table) == {1: ("b", 2), 3: ("d", 4)}
    assert repeat_stream(spark, 7).isStreaming
