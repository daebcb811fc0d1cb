from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cellwright.functions import aggregates as A
from cellwright.functions import scalar as S
from cellwright.functions.registry import FUNCTIONS, Kind, function, register
from cellwright.plans.expr import ExpressionError, compile_expr, parse

NAMES = (
    "group-by join-by join sum max min all any avg and or not and-not xor null? not-null? null-if = not= > >= < <= like not-like repeat make-source + - / * ~ limit sort-asc sort-desc filter to-vec col").split()


def one(spark, column, **values):
    types = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "boolean"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).head()[0]


def test_all_names_are_registered():
    assert set(NAMES) <= set(FUNCTIONS)
    assert {f.kind for f in FUNCTIONS.values()} == set(Kind)


def test_arity_and_extension():
    with pytest.raises(TypeError):
        function("not")(F.lit(True), F.lit(True))
    with pytest.raises(KeyError):
        function("nope")
    register("twice", Kind.MAP, lambda x: x * 2)
    assert "twice" in FUNCTIONS
    FUNCTIONS.pop("twice")


@pytest.mark.parametrize(("x", "y", "kleene", "strict"), [(False, None, False, None), (True, None, None, None), (True, False, False, False), (None, None, None, None)])
def test_and(spark, x, y, kleene, strict):
    assert one(spark, S.and_("x", "y"), x=x, y=y) == kleene
    assert one(spark, S.and_strict("x", "y"), x=x, y=y) == strict


@pytest.mark.parametrize(("x", "y", "kleene", "strict"), [(True, None, True, None), (False, None, None, None), (True, False, True, True)])
def test_or(spark, x, y, kleene, strict):
    assert one(spark, S.or_("x", "y"), x=x, y=y) == kleene
    assert one(spark, S.or_strict("x", "y"), x=x, y=y) == strict


def test_single_argument_folds_to_itself(spark):
    assert one(spark, S.add("x"), x=3) == 3
    assert one(spark, S.and_("x"), x=True) is True
    with pytest.raises(ValueError):
        S.add()


def test_numbers(spark):
    assert one(spark, S.divide_int("x", "y"), x=-7, y=2) == -3
    assert one(spark, S.divide("x", "y"), x=7.0, y=2.0) == 3.5
    assert one(spark, S.try_divide("x", "y"), x=7, y=0) is None
    assert one(spark, S.try_add("x", F.lit(2**31 - 1)), x=7) is None
    assert one(spark, S.subtract("x", "y", F.lit(1)), x=7, y=2) == 4
    with pytest.raises(Exception):
        one(spark, S.divide_int("x", "y"), x=7, y=0)


def test_null_comparisons(spark):
    assert one(spark, S.eq("x", F.lit(None)), x=1) is None
    assert one(spark, S.xor("x", "y"), x=True, y=None) is None
    assert one(spark, S.null_if("x", F.col("x") > 2), x=3) is None
    assert one(spark, S.null_if("x", "y"), x=3, y=None) == 3


def test_strings(spark):
    assert one(spark, S.like("x", "a_c%"), x="abcd") is True
    assert one(spark, S.not_like("x", "A%"), x="abcd") is True
    assert one(spark, S.string_is_decimal("x"), x="12") is True
    assert one(spark, S.string_is_digit("x"), x="1a") is False
    assert one(spark, S.string_is_space("x"), x=" \t") is True
    assert one(spark, S.index_in("x", ["p", "q"]), x="z") is None
    assert one(spark, S.can_cast("x", "i32"), x="12") is True
    assert one(spark, S.can_cast("x", "i32"), x="1x") is False
    assert one(spark, S.string_length("x"), x="🙂é") == 2


def test_map_helpers(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 2)) as m")
    assert df.select(S.get_in("m", ["b", "c"])).head()[0] == 2
    assert df.select(S.set_in("m", ["b", "c"], F.lit(9)).alias("m")).select("m.b.c").head()[0] == 9
    assert df.select(S.update_in("m", ["a"], lambda v: v + 1).alias("m")).select("m.a").head()[0] == 2


def test_aggregates(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    row = df.agg(A.count("x").alias("n"), A.sum("x").alias("s"), A.avg("x").alias("a"), A.avg_all_rows("x").alias("b"), A.max("x").alias("hi"), A.min("x").alias("lo")).head()
    assert tuple(row) == (3, 4, 2.0, pytest.approx(4 / 3), 3, 1)
    assert tuple(df.where("x > 9").agg(A.sum("x"), A.max("x"), A.count()).head()) == (None, None, 0)
    flags = spark.createDataFrame([(True,), (None,), (False,)], "b boolean")
    assert tuple(flags.agg(A.all("b"), A.any("b"), A.max("b"), A.min("b")).head()) == (False, True, True, False)
    with pytest.raises(Exception):
        spark.createDataFrame([(100,), (100,)], "x tinyint").agg(A.sum_same_type("x", "tinyint")).collect()


def test_expressions(spark):
    df = spark.createDataFrame([(5, 10, "abc"), (50, None, "xyz")], "a long, b int, s string")
    assert [r[0] for r in df.where(compile_expr("(and (>= a 5u64) (< a 10u64))")).select("a").collect()] == [5]
    assert df.select(compile_expr("(+ a (u64 b))").alias("v")).collect()[0][0] == Decimal(15)
    assert df.where(compile_expr('(like s "x%")')).count() == 1
    assert df.where(compile_expr("(null? b)")).count() == 1
    assert df.where(compile_expr('(in s ("abc" "q"))')).count() == 1
    assert df.where(compile_expr("a > 5 and s = 'xyz'")).count() == 1
    assert df.agg(compile_expr("(sum a)")).head()[0] == 55
    nested = spark.sql("select named_struct('x', named_struct('y', 4)) as m")
    assert nested.select(compile_expr("(+ m.x.y 1)")).head()[0] == 5
    for bad in ("(and", ")", "(limit a 3)", "(nope a)", "((a))", "()"):
        with pytest.raises((ExpressionError, KeyError)):
            compile_expr(bad if bad.startswith("(") else f"({bad}")
    assert parse('(f "a\\"b" -1.5f64)') == ["f", 'a"b', ("-1.5", "f64")]
