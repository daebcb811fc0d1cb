"""Registered queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions import aggregates as A
from cellwright.functions import scalar as S
from cellwright.operators import kv, relational, scan, stats
from cellwright.operators.scan import Ordering, ValueRange, exclusive, inclusive
from cellwright.operators.txn import Aborted, Transaction, transaction
from cellwright.plans.expr import compile_expr
from cellwright.registry import SchemaRegistry
from cellwright.sources import tables
from cellwright.sources.scratch import table_path
from cellwright.sources.tables import table
from cellwright.streaming.changelog import fold_batch
from cellwright.types import Field, IndexKind, Schema

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The nine cases of a three-valued truth table, over all orders.
_TRUTH_SQL = (
    "(select o_orderkey i, case o_orderkey%3 when 0 then true when 1 then false end x, case (o_orderkey//3)%3 when 0 then true when 1 then false end y"
    " from orders) B")


def query(name: str, sql: str):
    """Register a function of a table reader (name -> DataFrame) as query ``name``."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _QUERIES[name] = lambda spark, folder: f(lambda t: table(spark, folder, t))
        _SQL[name] = sql
        return f

    return add


def _each(base: Callable, made: dict[str, tuple[Callable[[DataFrame], DataFrame], str]]) -> None:
    for name, (f, sql) in made.items():
        query(name, sql)(lambda t, f=f: f(base(t)))


def _truth(t) -> DataFrame:
    return t("orders").selectExpr(
        "o_orderkey as i", "case o_orderkey % 3 when 0 then true when 1 then false end as x", "case (o_orderkey div 3) % 3 when 0 then true when 1 then false end as y")


# scans and lookups

_each(lambda t: t("orders"), {
    "src_scan_all": (lambda df: scan.scan_all(df, "o_orderkey", ["o_orderkey", "o_totalprice"]), "select o_orderkey,o_totalprice from orders"),
    "src_range_incl": (lambda df: scan.range_index_scan(df, "o_orderkey", "o_orderkey", ValueRange(inclusive(5), inclusive(515))), "select * from orders where o_orderkey between 5 and 515"),
    "src_range_excl": (lambda df: scan.range_index_scan(df, "o_orderkey", "o_orderkey", ValueRange(exclusive(5), exclusive(515))), "select * from orders where o_orderkey>5 and o_orderkey<515"),
    "src_range_excl_start": (lambda df: scan.range_index_scan(df, "o_orderkey", "o_orderkey", ValueRange(exclusive(5), inclusive(515))), "select * from orders where o_orderkey>5 and o_orderkey<=515"),
    "src_range_excl_end": (lambda df: scan.range_index_scan(df, "o_orderkey", "o_orderkey", ValueRange(inclusive(5), exclusive(515))), "select * from orders where o_orderkey>=5 and o_orderkey<515"),
    "src_range_open_start": (lambda df: scan.range_index_scan(df, "o_orderkey", "o_orderkey", ValueRange(end=inclusive(515))), "select * from orders where o_orderkey<=515"),
    "src_range_open_end": (lambda df: scan.range_index_scan(df, "o_orderkey", "o_orderkey", ValueRange(start=inclusive(1400))), "select * from orders where o_orderkey>=1400"),
    "src_range_ordered": (
        lambda df: scan.range_index_scan(df, "o_orderkey", "o_custkey", ValueRange(inclusive(3), exclusive(90)), ["o_custkey", "o_orderkey"], ordering=Ordering.FORWARD),
        "select o_custkey,o_orderkey from orders where o_custkey>=3 and o_custkey<90 order by 1,2"),
    "src_scan_backward": (lambda df: scan.scan_all(df, "o_orderkey", ["o_orderkey"], "(< o_orderkey 700)", ordering=Ordering.BACKWARD), "select o_orderkey from orders where o_orderkey<700 order by 1 desc"),
    "src_range_desc_topk": (
        lambda df: scan.seek(df, "o_orderkey", "o_orderkey", ValueRange(inclusive(5), inclusive(515)), Ordering.BACKWARD, 64).select("o_orderkey"),
        "select o_orderkey from orders where o_orderkey between 5 and 515 order by 1 desc limit 64"),
    "src_seek_next_block": (
        lambda df: scan.seek(df, "o_custkey", "o_orderkey", ValueRange(inclusive(2)), Ordering.FORWARD, 64, after=(40, 500)).select("o_custkey", "o_orderkey"),
        "select o_custkey,o_orderkey from orders where o_custkey>=2 and (o_custkey>40 or o_custkey=40 and o_orderkey>500) order by 1,2 limit 64"),
    "src_point_read": (lambda df: scan.read_cell(df, "o_orderkey", 42), "select * from orders where o_orderkey=42"),
    "src_multi_get": (
        lambda df: scan.read_all_cells(df, "o_orderkey", [7, 3, 99999999], ["o_totalprice"]),
        "select v.pos::int pos, v.k::bigint o_orderkey, o_totalprice from (values (0,7),(1,3),(2,99999999)) v(pos,k) left join orders on o_orderkey=v.k"),
    "src_multi_get_proc": (
        lambda df: scan.read_all_cells(df, "o_orderkey", [7, 3, 7, 12], selection="(> o_orderkey 5)", processing="(+ o_orderkey o_custkey)"),
        "select v.pos::int pos, v.k::bigint o_orderkey, o_orderkey+o_custkey as value from (values (0,7),(1,3),(2,7),(3,12)) v(pos,k) left join (select * from orders where o_orderkey>5) on o_orderkey=v.k"),
    "src_merge_runs": (
        lambda df: scan.merge_runs([df.where(f"o_orderkey % 3 = {k}") for k in range(3)], ["o_orderkey"], df.where("o_orderstatus = 'F'")).select("o_orderkey"),
        "select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus='F')"),
    "proj_proc_add": (lambda df: scan.scan_all(df, "o_orderkey", processing="(+ o_orderkey (i64 o_custkey))"), "select o_orderkey, o_orderkey+o_custkey as value from orders"),
    "flt_and_range": (
        lambda df: scan.scan_all(df, "o_orderkey", ["o_orderkey"], "(and (>= o_orderkey 10i64) (< o_orderkey 100i64))"), "select o_orderkey from orders where o_orderkey>=10 and o_orderkey<100"),
    "flt_or_points": (
        lambda df: scan.scan_all(df, "o_orderkey", ["o_orderkey"], "(or (= o_orderkey 100i64) (= o_orderkey 1000i64))"), "select o_orderkey from orders where o_orderkey=100 or o_orderkey=1000"),
    "bool_null_if_mask": (
        lambda df: df.select("o_orderkey", S.null_if("o_totalprice", F.col("o_orderkey") < 100).alias("r")),
        "select o_orderkey,case when not coalesce(o_orderkey<100,false) then o_totalprice end r from orders"),
    "ord_limit": (lambda df: relational.limit(df.orderBy("o_orderkey"), 10), "select * from orders order by o_orderkey limit 10"),
    "ord_sort_asc": (
        lambda df: relational.sort_asc(df.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("v")), "v", "o_orderkey"),
        "select o_orderkey,v from (select o_orderkey,case when o_orderkey%3<>0 then o_custkey end v from orders) order by v asc nulls first,o_orderkey"),
    "ord_sort_desc": (
        lambda df: relational.sort_desc(df.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("v")), "v", "o_orderkey"),
        "select o_orderkey,v from (select o_orderkey,case when o_orderkey%3<>0 then o_custkey end v from orders) order by v desc nulls first,o_orderkey"),
    "ord_top_k": (
        lambda df: relational.top_k(df.select("o_custkey", "o_orderkey"), 25, F.col("o_custkey").desc(), "o_orderkey"),
        "select o_custkey,o_orderkey from orders order by o_custkey desc,o_orderkey limit 25"),
    "stat_schema": (
        lambda df: stats.column_ranges(df, "o_orderkey").withColumnsRenamed({"o_orderkey_lo": "lo", "o_orderkey_hi": "hi"}), "select count(*) cnt,min(o_orderkey) lo,max(o_orderkey) hi from orders"),
    "stat_equi_depth_hist": (
        lambda df: stats.equi_depth_keys(df, "o_orderkey"),
        "select rn::bigint rn,o_orderkey k from (select o_orderkey,row_number() over(order by o_orderkey)-1 rn,count(*) over() n from orders) where (rn%(n//100)=0 and rn<100*(n//100)) or rn=n-1"),
})

query("src_count", "select count(*) n from lineitem")(lambda t: scan.count(t("lineitem")))
query("src_make_source", "select range as v from range(10)")(lambda t: relational.make_source(t("region").sparkSession, range(10)))
query("src_repeat", "select 7::bigint v from range(64)")(lambda t: relational.repeat(t("region").sparkSession, 7, 64))
query("src_array_index_lookup", "select vec_id from embeddings where len(list_filter(embedding,lambda x: x>0.35))>0")(
    lambda t: scan.array_index_scan(t("embeddings"), "embedding", ValueRange(exclusive(F.lit(0.35)))).select("vec_id"))
query("src_hash_index_eq", "select c_custkey from customer where c_mktsegment='MACHINERY'")(
    lambda t: scan.hash_index_lookup(t("customer"), "c_mktsegment", "MACHINERY").select("c_custkey"))
query("proj_nested", "select c_custkey,c_acctbal from customer")(
    lambda t: scan.project(t("customer").select(F.struct("c_custkey", F.struct("c_acctbal").alias("sub")).alias("s")), ["s.c_custkey", "s.sub.c_acctbal"]))
query("proj_dynamic", "select event_id, (props->>'$.k')::bigint k from events")(
    lambda t: t("events").select("event_id", S.col(S.dynamic("props"), "$.k", "bigint").alias("k")))
query("proj_to_vec", "select try_cast(c_mktsegment as integer) c_mktsegment from customer")(lambda t: relational.to_vec(t("customer"), "c_mktsegment", "int"))
query("flt_mask", "select l_orderkey,l_quantity from lineitem where l_quantity>45")(
    lambda t: relational.filter_by(t("lineitem"), F.col("l_quantity") > 45).select("l_orderkey", "l_quantity"))
query("ord_take", "select v.pos::int pos, v.k::bigint o_orderkey, o_custkey from (values (0,9),(1,2),(2,9)) v(pos,k) left join orders on o_orderkey=v.k")(
    lambda t: relational.take(t("orders").select("o_orderkey", "o_custkey"), t("orders").sparkSession.createDataFrame([(0, 9), (1, 2), (2, 9)], "pos int, o_orderkey long"), "pos", "o_orderkey").select("pos", "o_orderkey", "o_custkey"))

# joins and groups

query("join_natural", "select c_custkey,n_name from customer join nation on c_nationkey=n_nationkey")(
    lambda t: relational.natural_join(t("customer").withColumnRenamed("c_nationkey", "n_nationkey"), t("nation")).select("c_custkey", "n_name"))
query("join_by_cogroup", "select k,count(*) n_rows from (select n_regionkey k from nation union all select r_regionkey from region) group by k")(
    lambda t: relational.join_by_count([t("nation").select(F.col("n_regionkey").alias("k")), t("region").select(F.col("r_regionkey").alias("k"))], ["k"]))
query("join_by_lists", "select k, string_agg(n, ',' order by n) as names from (select n_regionkey k, n_name n from nation union all select r_regionkey, r_name from region) group by k")(
    lambda t: relational.join_by([t("nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("n")), t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))], ["k"])
    .select("k", F.array_join(F.array_sort(F.transform("rows", lambda r: r["n"])), ",").alias("names")))
query("join_by_inner", "select c_mktsegment,count(*) n from orders join customer on o_custkey=c_custkey group by 1")(
    lambda t: relational.join_by_inner(t("orders"), t("customer"), [("o_custkey", "c_custkey")]).groupBy("c_mktsegment").agg(A.count().alias("n")))
query("grp_group_by_list", "select n_regionkey,string_agg(n_name,',' order by n_name) names from nation group by 1")(
    lambda t: relational.group_by(t("nation"), "n_name", "n_regionkey", order="n_name").select("n_regionkey", F.array_join("n_name", ",").alias("names")))
query("grp_multi_key", "select l_returnflag,l_linestatus,count(*) n from lineitem group by 1,2")(
    lambda t: relational.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], n=A.count()))
query("set_concat", "select n_name as name from nation union all select r_name from region")(
    lambda t: relational.concat(t("nation").select(F.col("n_name").alias("name")), t("region").select(F.col("r_name").alias("name"))))

# aggregates and arithmetic

_half = lambda df: df.select(F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("q"))
_each(lambda t: t("lineitem"), {
    "agg_count": (lambda df: _half(df).agg(A.count("q").alias("n")), "select count(*) n from (select case when l_quantity>25 then l_quantity end q from lineitem)"),
    "agg_sum": (lambda df: df.groupBy("l_returnflag").agg(A.sum("l_quantity").alias("s")), "select l_returnflag,sum(l_quantity) s from lineitem group by 1"),
    "agg_sum_int": (lambda df: df.groupBy("l_returnflag").agg(A.sum_same_type("l_linenumber", "int").alias("s")), "select l_returnflag,sum(l_linenumber)::int s from lineitem group by 1"),
    "agg_sum_empty": (lambda df: df.where("l_quantity < 0").agg(A.sum("l_quantity").alias("s")), "select sum(l_quantity) s from lineitem where l_quantity<0"),
    "agg_max": (lambda df: df.agg(A.max("l_extendedprice").alias("m"), A.max("l_returnflag").alias("ms")), "select max(l_extendedprice) m,max(l_returnflag) ms from lineitem"),
    "agg_min": (lambda df: df.agg(A.min("l_extendedprice").alias("m"), A.min("l_returnflag").alias("ms")), "select min(l_extendedprice) m,min(l_returnflag) ms from lineitem"),
    "agg_max_bool": (lambda df: df.groupBy("l_returnflag").agg(A.max(F.col("l_quantity") > 49).alias("b")), "select l_returnflag,bool_or(l_quantity>49) b from lineitem group by 1"),
    "agg_all": (lambda df: df.groupBy("l_returnflag").agg(A.all(F.col("l_quantity") > 0).alias("b")), "select l_returnflag,bool_and(l_quantity>0) b from lineitem group by 1"),
    "agg_any": (lambda df: df.groupBy("l_returnflag").agg(A.any(F.col("l_quantity") > 49).alias("b")), "select l_returnflag,bool_or(l_quantity>49) b from lineitem group by 1"),
    "agg_avg": (lambda df: df.groupBy("l_returnflag").agg(A.avg("l_quantity").alias("a")), "select l_returnflag,avg(l_quantity) a from lineitem group by 1"),
    "agg_avg_all_rows": (lambda df: _half(df).agg(A.avg_all_rows("q").alias("a")), "select sum(q)/count(*) a from (select case when l_quantity>25 then l_quantity end q from lineitem)"),
    "agg_avg_partial": (
        lambda df: df.groupBy("l_suppkey").agg(A.avg_partial("l_quantity").alias("p")).agg(A.avg_merge("p").alias("p")).select("p.s", "p.c"), "select sum(l_quantity) s, count(*)::bigint c from lineitem"),
    "agg_avg_final": (
        lambda df: df.groupBy("l_suppkey").agg(A.avg_partial("l_quantity").alias("p")).agg(A.avg_merge("p").alias("p")).select(A.avg_final("p").alias("a")), "select sum(l_quantity)/count(*) a from lineitem"),
    "cmp_eq": (lambda df: df.where(S.eq("l_returnflag", F.lit("A"))).select("l_orderkey"), "select l_orderkey from lineitem where l_returnflag='A'"),
    "cmp_neq": (lambda df: df.where(S.not_eq("l_returnflag", F.lit("A"))).select("l_orderkey"), "select l_orderkey from lineitem where l_returnflag<>'A'"),
    "cmp_gt_vec": (lambda df: df.where(S.gt("l_partkey", "l_orderkey")).select("l_orderkey"), "select l_orderkey from lineitem where l_partkey>l_orderkey"),
    "num_add": (lambda df: df.select("l_orderkey", compile_expr("(+ l_partkey l_suppkey l_orderkey)").alias("r")), "select l_orderkey,l_partkey+l_suppkey+l_orderkey r from lineitem"),
    "num_sub": (lambda df: df.select("l_orderkey", compile_expr("(- l_partkey l_suppkey)").alias("r")), "select l_orderkey,l_partkey-l_suppkey r from lineitem"),
    "num_div_int": (lambda df: df.select("l_orderkey", compile_expr("(div l_partkey (+ l_suppkey 1i64))").alias("r")), "select l_orderkey,l_partkey//(l_suppkey+1) r from lineitem"),
    "num_div_float": (lambda df: df.select("l_orderkey", compile_expr("(/ l_extendedprice l_quantity)").alias("r")), "select l_orderkey,l_extendedprice/l_quantity r from lineitem"),
    "num_mul": (lambda df: df.select("l_orderkey", compile_expr("(* l_quantity l_discount)").alias("r")), "select l_orderkey,l_quantity*l_discount r from lineitem"),
    "num_rem": (lambda df: df.select("l_orderkey", S.rem("l_partkey", F.lit(7)).alias("r")), "select l_orderkey,l_partkey%7 r from lineitem"),
    "flagship_scan_group": (
        lambda df: df.where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(A.sum("l_quantity").alias("sum_qty"), A.avg("l_quantity").alias("avg_qty"), A.max("l_extendedprice").alias("max_price"), A.count().alias("n"))
        .orderBy("l_returnflag", "l_linestatus").limit(100),
        "select l_returnflag,l_linestatus,sum(l_quantity) sum_qty,avg(l_quantity) avg_qty,max(l_extendedprice) max_price,count(*) n"
        " from lineitem where l_shipdate<=timestamp '1998-09-02' group by 1,2 order by 1,2 limit 100"),
})
query("num_neg", "select c_custkey,-c_acctbal r from customer")(lambda t: t("customer").select("c_custkey", S.negate("c_acctbal").alias("r")))

# three-valued logic

_strict = "case when x is not null and y is not null then x {0} y end"
_each(_truth, {
    "bool_and": (lambda b: b.select("i", S.and_("x", "y").alias("r")), f"select i,(x and y) r from {_TRUTH_SQL}"),
    "bool_and_strict": (lambda b: b.select("i", S.and_strict("x", "y").alias("r")), f"select i,{_strict.format('and')} r from {_TRUTH_SQL}"),
    "bool_or": (lambda b: b.select("i", S.or_("x", "y").alias("r")), f"select i,(x or y) r from {_TRUTH_SQL}"),
    "bool_or_strict": (lambda b: b.select("i", S.or_strict("x", "y").alias("r")), f"select i,{_strict.format('or')} r from {_TRUTH_SQL}"),
    "bool_not": (lambda b: b.select("i", S.not_("x").alias("r")), f"select i,not x r from {_TRUTH_SQL}"),
    "bool_and_not": (lambda b: b.select("i", S.and_not("x", "y").alias("r")), f"select i,(x and not y) r from {_TRUTH_SQL}"),
    "bool_xor": (lambda b: b.select("i", S.xor("x", "y").alias("r")), f"select i,(x<>y) r from {_TRUTH_SQL}"),
    "bool_is_null": (lambda b: b.select("i", S.is_null("x").alias("r")), f"select i,x is null r from {_TRUTH_SQL}"),
    "bool_not_null": (lambda b: b.select("i", S.is_not_null("x").alias("r")), f"select i,x is not null r from {_TRUTH_SQL}"),
})

# comparisons and strings

_each(lambda t: t("part"), {
    "cmp_gte": (lambda df: df.where(S.gt_eq("p_size", 25)).select("p_partkey"), "select p_partkey from part where p_size>=25"),
    "cmp_lt": (lambda df: df.where(S.lt("p_size", 25)).select("p_partkey"), "select p_partkey from part where p_size<25"),
    "cmp_lte_str": (lambda df: df.where(S.lt_eq("p_brand", F.lit("Brand#2"))).select("p_partkey"), "select p_partkey from part where p_brand<='Brand#2'"),
    "str_like": (lambda df: df.where(S.like("p_name", "%wid_et")).select("p_partkey"), "select p_partkey from part where p_name like '%wid_et'"),
    "str_not_like": (lambda df: df.where(S.not_like("p_name", "%wid_et")).select("p_partkey"), "select p_partkey from part where p_name not like '%wid_et'"),
    "str_pred_declared": (
        lambda df: df.select(
            "p_partkey", S.string_to_upper("p_name").alias("u"), S.string_to_lower("p_name").alias("l"), S.string_length("p_name").alias("n"), S.substring("p_name", 1, 3).alias("s"),
            S.is_in("p_type", ["PROMO", "ECONOMY"]).alias("i")),
        "select p_partkey,upper(p_name) u,lower(p_name) l,length(p_name)::int n,substr(p_name,1,3) s,p_type in ('PROMO','ECONOMY') i from part"),
    "str_classes": (
        lambda df: df.select(
            "p_partkey", S.string_matches("p_brand", "#[12]").alias("m"), S.string_is_digit(F.substring("p_brand", 7, 2)).alias("d"), S.string_is_upper_case("p_type").alias("u"),
            S.string_is_lower_case("p_name").alias("l"), S.string_is_space(F.substring("p_name", 1, 1)).alias("s"), S.index_in("p_type", ["PROMO", "ECONOMY"]).cast("int").alias("x"),
            S.can_cast(F.substring("p_brand", 7, 2), "int").alias("c")),
        "select p_partkey,regexp_matches(p_brand,'#[12]') m,regexp_full_match(substr(p_brand,7,2),'[0-9]+') d,(p_type=upper(p_type) and regexp_matches(p_type,'[A-Z]')) u,"
        "(p_name=lower(p_name) and regexp_matches(p_name,'[a-z]')) l,regexp_full_match(substr(p_name,1,1),'\\s+') s,(case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 end)::int x,"
        "(try_cast(substr(p_brand,7,2) as int) is not null) c from part"),
    "str_concat": (lambda df: df.select("p_partkey", S.concat("p_brand", F.lit("/"), "p_type").alias("r")), "select p_partkey,p_brand||'/'||p_type r from part"),
})

# records by key: the log is events, keyed by user

_each(lambda t: t("events"), {
    "kv_latest": (
        lambda df: kv.latest(df.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts"),
        "select user_id,event_id,event_type from events qualify row_number() over(partition by user_id order by ts desc,event_id desc)=1"),
    "kv_live_after_remove": (
        lambda df: kv.latest(df.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id"),
        "select user_id,event_id from (select *,row_number() over(partition by user_id order by ts desc,event_id desc) rn from events) where rn=1 and event_type<>'error'"),
})
_keyed = lambda t: (t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")))
query("kv_insert_if_absent", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")(lambda t: kv.insert_if_absent(_keyed(t)[1], _keyed(t)[0], "c_custkey"))
query("kv_update_existing", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")(lambda t: kv.update_existing(_keyed(t)[1], _keyed(t)[0], "c_custkey"))

# record tables, through their own commits; each query makes its table anew in the scratch folder

_FIELDS = ("c_custkey", "c_mktsegment", "c_acctbal")


def _records(t, start: bool = True) -> kv.RecordTable:
    """All customers as a record table."""
    rows = t("customer").select(*_FIELDS)
    made = kv.RecordTable(rows.sparkSession, table_path(rows.sparkSession, "records"), rows.schema, "c_custkey")
    if start:
        made.insert(rows)
    return made


def _ordered(t) -> DataFrame:
    """A new record for each customer with orders."""
    return t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).select("c_custkey", F.lit("ordered").alias("c_mktsegment"), "c_acctbal")


def _after(*steps: Callable[[kv.RecordTable, Callable], object]) -> Callable:
    def run(t) -> DataFrame:
        made = _records(t)
        for step in steps:
            step(made, t)
        return made.current()

    return run


_upsert = lambda r, t: r.upsert(_ordered(t))
_remove_by = lambda r, t: r.remove_by("c_acctbal < 1000")
_raise = lambda r, t: r.update_by("c_mktsegment = 'BUILDING'", {"c_acctbal": "c_acctbal * 2", "c_mktsegment": "upper(c_mktsegment)"})
_ORDERED_SQL = "(select o_custkey, max(o_totalprice) m from orders group by 1)"
_UPSERTED_SQL = (
    "select coalesce(o_custkey, c_custkey) c_custkey, case when o_custkey is null then c_mktsegment else 'ordered' end c_mktsegment, coalesce(m, c_acctbal) c_acctbal"
    f" from customer full join {_ORDERED_SQL} on o_custkey=c_custkey")
_ALL_SQL = f"select {','.join(_FIELDS)} from customer"

query("kv_write", _ALL_SQL)(_after())
query("kv_update", f"select c_custkey, case when m is null then c_mktsegment else 'ordered' end c_mktsegment, coalesce(m, c_acctbal) c_acctbal from customer left join {_ORDERED_SQL} on o_custkey=c_custkey")(
    _after(lambda r, t: r.update(kv.update_existing(t("customer"), _ordered(t), "c_custkey"))))
query("kv_upsert", _UPSERTED_SQL)(_after(_upsert))
query("kv_remove", f"{_ALL_SQL} where c_custkey not in (select o_custkey from orders)")(_after(lambda r, t: r.remove(kv.update_existing(*reversed(_keyed(t)), "c_custkey"))))
query("kv_update_by", "select c_custkey, c_mktsegment, case when c_mktsegment='BUILDING' then c_acctbal*2 else c_acctbal end c_acctbal from customer")(_after(_raise))
query("kv_remove_by", f"{_ALL_SQL} where not coalesce(c_acctbal<1000, false)")(_after(_remove_by))
query("kv_compact", f"select * from ({_UPSERTED_SQL}) where not coalesce(c_acctbal<1000, false)")(_after(_upsert, _remove_by, lambda r, t: r.compact(), lambda r, t: r.vacuum()))


@query("kv_head", f"select coalesce(o_custkey, c_custkey) c_custkey, case when c_custkey is null or o_custkey is null then 1 else 2 end::bigint as version, case when o_custkey is null then 1 else 2 end::bigint as commit_no"
       f" from customer full join {_ORDERED_SQL} on o_custkey=c_custkey")
def _heads(t) -> DataFrame:
    made = _records(t)
    _upsert(made, t)
    return made.head().select("c_custkey", F.col("_version").alias("version"), F.col("_commit").alias("commit_no"))


@query("kv_log", "select 1::bigint commit_no, 'put' op, count(*) n from customer union all select 2, 'put', count(*) from customer where c_mktsegment='BUILDING' having count(*) > 0"
       " union all select 3, 'remove', count(*) from customer where case when c_mktsegment='BUILDING' then c_acctbal*2 else c_acctbal end < 1000 having count(*) > 0")
def _log(t) -> DataFrame:
    made = _records(t)
    _raise(made, t)
    _remove_by(made, t)
    return relational.aggregate(made.changes().select(F.col("_commit").alias("commit_no"), F.col("_op").alias("op")), ["commit_no", "op"], n=A.count())


@query("kv_version", _ALL_SQL)
def _old_version(t) -> DataFrame:
    made = _records(t)
    first = made.version()
    _remove_by(made, t)
    return made.current(first)


@query("kv_archive", _ALL_SQL)
def _archive(t) -> DataFrame:
    made = _records(t)
    path = table_path(made.spark, "archive")
    made.archive(path)
    return tables.read(made.spark, path)


@query("kv_dump", "select c_custkey, c_mktsegment from customer")
def _dump(t) -> DataFrame:
    rows = _records(t).dump().select(F.from_json("json", "c_custkey bigint, c_mktsegment string").alias("r"))
    return rows.select("r.*")


@query("kv_stream", "select user_id, max(event_id) filter (ts = last) event_id from (select *, max(ts) over (partition by user_id) as last from events) group by 1")
def _streamed(t) -> DataFrame:
    """Two batches of events, the later ones first: late events don't replace newer ones."""
    rows = t("events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    made = kv.RecordTable(rows.sparkSession, table_path(rows.sparkSession, "records"), rows.schema, "user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = rows.agg(F.avg(micros)).head()[0] or 0.0
    for late in (False, True):
        fold_batch(made, rows.where((micros < middle) == late), "ts")
    return made.current().select("user_id", "event_id")


@query("txn_final", "select n_nationkey, case n_nationkey when 4 then 'late' when 0 then 'again' else n_name end n_name, case n_nationkey when 1 then 9 when 2 then 11 else n_regionkey end n_regionkey"
       " from nation where n_nationkey <> 3 union all select 100, 'new', 0")
def _history(t) -> DataFrame:
    """All nations after transactions that commit, conflict, start again and abort."""
    rows = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    made = kv.RecordTable(rows.sparkSession, table_path(rows.sparkSession, "records"), rows.schema, "n_nationkey")
    made.insert(rows)
    one, two = Transaction(made), Transaction(made)
    one.update(one.read(1) | {"n_regionkey": 9})
    two.update(two.read(2) | {"n_regionkey": two.read(1)["n_regionkey"] + 1})
    one.commit()
    try:
        two.commit()
    except kv.CommitConflict:  # it read what changed: start again
        transaction(made, lambda x: x.update(x.read(2) | {"n_regionkey": x.read(1)["n_regionkey"] + 2}))

    def steps(x: Transaction) -> None:
        x.write({"n_nationkey": 100, "n_name": "new", "n_regionkey": 0})
        x.write({"n_nationkey": 101, "n_name": "gone", "n_regionkey": 0})
        x.remove(101)
        x.remove(3)
        x.upsert(x.read(4) | {"n_name": "late"})
        x.upsert({"n_nationkey": 0, "n_name": "again", "n_regionkey": x.read_selected(0, ["n_regionkey"])["n_regionkey"]})

    transaction(made, steps)

    def give_up(x: Transaction) -> None:
        x.remove(5)
        raise Aborted

    try:
        transaction(made, give_up)
    except Aborted:
        pass
    return made.current()


# statistics and costs

_ORDER_SCHEMA = Schema("orders", (Field("o_orderkey", "i64", indices=(IndexKind.RANGED,)), Field("o_custkey", "i64"), Field("o_totalprice", "f64")), "o_orderkey")
_HIST_SQL = "(select o_orderkey k, row_number() over (order by rn) - 1 i from (select o_orderkey, row_number() over (order by o_orderkey) - 1 rn, count(*) over () n from orders) where (rn%(n//100)=0 and rn<100*(n//100)) or rn=n-1)"


@query("stat_schema_statistics", f"select count(*) as rows, count(*)*24 as bytes, (select list(k order by i) from {_HIST_SQL}) histogram from orders")
def _schema_statistics(t) -> DataFrame:
    got = stats.schema_statistics(t("orders"), ["o_orderkey"], _ORDER_SCHEMA)
    return t("orders").sparkSession.createDataFrame([(got.count, got.bytes, got.histograms["o_orderkey"])], "rows long, bytes long, histogram array<bigint>")


@query("stat_costs", f"""
with h as {_HIST_SQL}, b as (select max(i)::double b from h),
s as (select v, coalesce(max((lo.i + (v - lo.k)::double / (hi.k - lo.k)::double) / b), 0) x from (values (5), (515)) q(v), b left join h lo on lo.k < v left join h hi on hi.i = lo.i + 1 where hi.k is null or hi.k >= v group by v),
r as (select floor((max(x) - min(x)) * (select count(*) from orders))::bigint ranged from s)
select (select count(*) from orders) scan_rows, 24::bigint row_bytes, ranged range_rows, (select count(*) from orders) * 24 + ranged * 8 as total, 'range' as choice from r""")
def _costs(t) -> DataFrame:
    got = stats.schema_statistics(t("orders"), ["o_orderkey"], _ORDER_SCHEMA)
    wanted = ValueRange(inclusive(5), inclusive(515))
    whole, ranged = stats.scan_cost(got, _ORDER_SCHEMA), stats.range_cost(got, _ORDER_SCHEMA, "o_orderkey", wanted, ["o_orderkey"])
    choice = stats.choose(got, _ORDER_SCHEMA, "o_orderkey", wanted, ["o_orderkey"])
    return t("orders").sparkSession.createDataFrame([(whole.rows, whole.row_bytes, ranged.rows, stats.total_cost([whole, ranged]), choice)], "scan_rows long, row_bytes long, range_rows long, total long, choice string")


_PART_SQL = "(select l_linenumber part, l_partkey k, row_number() over (partition by l_linenumber order by l_partkey) - 1 rn, count(*) over (partition by l_linenumber) n from lineitem)"
query("stat_partition_histograms", f"""
with e as (select part, k, rn, n, greatest(n//100, 1) depth from {_PART_SQL}),
keep as (select *, rn%depth=0 and rn < case when n > 100 then 100*depth else n end edge from e),
picked as (select part, depth, k, rn from keep where edge or (rn = n-1 and k <> (select max(k) from keep x where x.part = keep.part and x.edge)))
select part::int part, depth::bigint depth, list(k order by rn) keys from picked group by 1, 2""")(
    lambda t: stats.partition_histograms(t("lineitem").select(F.col("l_linenumber").cast("int").alias("part"), "l_partkey"), "l_partkey", "part"))

# schemas, cursors, files and the whole row

@query("ddl_schemas", "select * from (values (1, 'nation', 'n_nationkey', false, true), (7, 'orders', 'o_orderkey', false, true), (8, 'events', 'event_id', true, true)) v(id, name, key, is_dynamic, is_scannable)")
def _schemas(t) -> DataFrame:
    known = SchemaRegistry()
    known.new_schema(Schema("nation", (Field("n_nationkey", "i64"),), "n_nationkey"))
    known.new_schema(Schema("region", (Field("r_regionkey", "i64"),), "r_regionkey"))
    known.new_schema_with_id(_ORDER_SCHEMA, 7)
    known.new_schema_with_id(Schema("events", (Field("event_id", "i64"),), "event_id", is_dynamic=True), 8)
    known.del_schema("region")
    return known.list_tables(t("region").sparkSession)


@query("src_data_cursor", "select ((row_number() over (order by n_nationkey) - 1) // 4)::int as block, n_nationkey from nation")
def _blocks(t) -> DataFrame:
    cursor, rows = scan.DataCursor(t("nation").select("n_nationkey").orderBy("n_nationkey"), 4), []
    while block := cursor.next_block():
        rows += [(len(rows) // 4, r.n_nationkey) for r in block]
    return t("nation").sparkSession.createDataFrame(rows, "block int, n_nationkey long")


@query("src_id_cursor", "select n_nationkey as id, (row_number() over (order by n_regionkey, n_nationkey) - 1)::int place from nation")
def _ids(t) -> DataFrame:
    """All nations by region: eight steps of one cursor, the rest by another that starts at its position."""
    first, ids = scan.IdCursor(t("nation"), "n_regionkey", "n_nationkey", block=3), []
    for _ in range(8):
        ids.append(first.current())
        first.next()
    second = scan.IdCursor(t("nation"), "n_regionkey", "n_nationkey", block=5, position=first.position)
    while second.current() is not None:
        ids += second.next_block()
    return t("nation").sparkSession.createDataFrame([(x, k) for k, x in enumerate(ids)], "id long, place int")


@query("src_file_formats", "select f as format, n_nationkey, n_name from nation, (values ('csv'), ('json'), ('orc'), ('parquet')) v(f)")
def _formats(t) -> DataFrame:
    rows = t("nation").select("n_nationkey", "n_name")
    out = []
    for fmt in ("csv", "json", "orc", "parquet"):
        path = table_path(rows.sparkSession, f"nation-{fmt}")
        tables.write(rows, path, fmt, sort=("n_nationkey",))
        out.append(tables.read(rows.sparkSession, path, fmt, rows.schema).withColumn("format", F.lit(fmt)))
    return relational.concat(*out)


query("proj_whole_row", "select o_orderkey, o_custkey + o_orderkey as value from orders where o_orderkey > 10")(
    lambda t: scan.scan_all(t("orders"), "o_orderkey", selection="(> data.o_orderkey 10)", processing="(+ data.o_custkey data.o_orderkey)"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
