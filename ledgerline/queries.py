"""Queries by name, and their SQL. nation stands for area, region for prefecture, order priority for function, order year for vintage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import codes, geo, measures, text
from ledgerline.operators import flows, linkage, quality, quantiles, relational, spatial
from ledgerline.plans import exports
from ledgerline.sources import layout
from ledgerline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _placed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's nation: nation and customer are the smaller sides, which Spark measures itself."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A row per line item: customer's nation (origin) and supplier's nation (partner)."""
    l, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = l.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("partner"))


FLOWS_SQL = """flows as (
  select c_nationkey as origin, s_nationkey as partner, count(*) as n from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"""

def _cents():
    """Prices as integers, whose sums don't depend on their order."""
    return F.round(F.col("l_extendedprice") * 100).cast("long")


@query("""select n_nationkey as area_code, n_name as area_name, o_orderpriority as bed_function,
  count(case when o_orderstatus = 'F' then 1 end) as actual, count(case when o_orderstatus = 'P' and o_totalprice > 480000 then 1 end) as need,
  floor((count(case when o_orderstatus = 'F' then 1 end) / nullif(count(case when o_orderstatus = 'P' and o_totalprice > 480000 then 1 end), 0)) * 1e4 + 0.5) / 1e4 as ratio,
  case when count(case when o_orderstatus = 'P' and o_totalprice > 480000 then 1 end) = 0 then 'denominator is 0' else '' end as note
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3""")
def ratio_by_area_function(spark, d):
    grouped = _placed_orders(spark, d).groupBy(F.col("n_nationkey").alias("area_code"), F.col("n_name").alias("area_name"), F.col("o_orderpriority").alias("bed_function"))
    rows = grouped.agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("actual"), F.count(F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 480000), 1)).alias("need"))
    return rows.withColumn("ratio", measures.ratio(F.col("actual"), F.col("need"))).withColumn("note", measures.ratio_note(F.col("need")))


@query("""with years as (select n_nationkey as area_code, year(o_orderdate)::int as year, count(*) as value from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
base as (select area_code, value as b from years where year = 1995)
select y.area_code, year, value, floor(value / nullif(b, 0) * 1e4 + 0.5) / 1e4 as ratio from years y left join base using (area_code)""")
def ratio_to_baseline_year(spark, d):
    rows = _placed_orders(spark, d).groupBy(F.col("n_nationkey").alias("area_code"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("value"))
    base = F.max(F.when(F.col("year") == 1995, F.col("value"))).over(Window.partitionBy("area_code"))
    return rows.withColumn("ratio", measures.ratio(F.col("value"), base))


@query("""select n_nationkey as area_code, o_orderpriority as bed_function,
  sum(case when year(o_orderdate) = 1995 then round(o_totalprice * 100)::bigint end)::bigint as old_value, sum(case when year(o_orderdate) = 1996 then round(o_totalprice * 100)::bigint end)::bigint as new_value,
  (sum(case when year(o_orderdate) = 1996 then round(o_totalprice * 100)::bigint end) - sum(case when year(o_orderdate) = 1995 then round(o_totalprice * 100)::bigint end))::bigint as difference
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where year(o_orderdate) in (1995, 1996) group by 1, 2""")
def vintage_compare_wide(spark, d):
    rows = _placed_orders(spark, d).select(F.col("n_nationkey").alias("area_code"), F.col("o_orderpriority").alias("bed_function"), F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return relational.vintages(rows, ["area_code", "bed_function"], "year", 1995, 1996, F.col("cents"))


@query("""with cells as (select l_returnflag, l_linestatus, l_linenumber, year(l_shipdate)::int as year, count(*) as n from lineitem group by all)
select coalesce(a.l_returnflag, b.l_returnflag) as flag, coalesce(a.l_linestatus, b.l_linestatus) as status, coalesce(a.l_linenumber, b.l_linenumber) as line,
  case when a.n is null then 'new_only' when b.n is null then 'old_only' when a.n = b.n then 'equal' else 'differs' end as match
from (select * from cells where year = 1994) a full join (select * from cells where year = 1995) b using (l_returnflag, l_linestatus, l_linenumber)""")
def vintage_cell_match(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("year"), F.lit(1).alias("one"))
    wide = relational.vintages(rows, ["flag", "status", "line"], "year", 1994, 1995, F.col("one"))
    match = F.when(F.col("old_value").isNull(), "new_only").when(F.col("new_value").isNull(), "old_only").when(F.col("difference") == 0, "equal").otherwise("differs")
    return wide.select("flag", "status", "line", match.alias("match"))


@query("""select c_mktsegment as segment, count(*) as customers, count(case when n95 = n96 then 1 end) as unchanged, count(case when n95 < n96 then 1 end) as more, count(case when n95 > n96 then 1 end) as fewer
from (select c_custkey, c_mktsegment, count(case when year(o_orderdate) = 1995 then 1 end) as n95, count(case when year(o_orderdate) = 1996 then 1 end) as n96 from customer left join orders on o_custkey = c_custkey group by 1, 2) group by 1""")
def vintage_consistency(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    at = lambda y: F.count(F.when(F.year("o_orderdate") == y, 1))
    each = c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey", F.col("c_mktsegment").alias("segment")).agg(at(1995).alias("a"), at(1996).alias("b"))
    return each.groupBy("segment").agg(F.count("*").alias("customers"), F.count_if(F.expr("a = b")).alias("unchanged"), F.count_if(F.expr("a < b")).alias("more"), F.count_if(F.expr("a > b")).alias("fewer"))


@query("""select coalesce(p, l) as partkey, case when p is not null and l is not null then 'matched' when p is not null then 'part_only' else 'line_only' end as status
from (select distinct p_partkey as p from part where p_size <= 25) full join (select distinct l_partkey as l from lineitem where l_quantity > 45) on p = l""")
def outer_join_status(spark, d):
    parts = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("partkey"))
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("partkey"))
    return relational.join_status(parts, lines, ["partkey"], ("part", "line"))


@query("""with areas as (select n_regionkey, s_nationkey, sum(round(l_extendedprice * 100)::bigint)::bigint as cents from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2),
totals as (select n_regionkey, sum(round(l_extendedprice * 100)::bigint)::bigint as total from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_linenumber <= 6 group by 1)
select n_regionkey as region, sum(cents)::bigint as part_sum, any_value(total) as total, sum(cents) = any_value(total) as agrees from areas join totals using (n_regionkey) group by 1""")
def rollup_reconcile(spark, d):
    l, s, n = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    rows = l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), "s_nationkey", "l_linenumber", _cents().alias("cents"))
    areas = rows.groupBy("region", "s_nationkey").agg(F.sum("cents").alias("cents"))
    totals = rows.filter("l_linenumber <= 6").groupBy("region").agg(F.sum("cents").alias("cents"))
    return relational.reconcile(areas, totals, ["region"], "cents")


@query("""select coalesce(r_name, 'ALL') as region, coalesce(n_name, 'ALL') as nation, count(*) as customers, sum(round(c_acctbal * 100)::bigint)::bigint as cents
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def rollup_with_national(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rolled = rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    return rolled.select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "customers", "cents")


@query("""select o_orderpriority as priority, count(*) as total, count(case when o_orderstatus = 'F' then 1 end) + count(case when o_orderstatus = 'O' then 1 end) as parts,
  count(*) >= count(case when o_orderstatus = 'F' then 1 end) + count(case when o_orderstatus = 'O' then 1 end) as at_least, count(*) = count(case when o_orderstatus in ('F', 'O') then 1 end) as equal from orders group by 1""")
def total_equals_parts(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("parts"))
    return rows.withColumn("at_least", F.expr("total >= parts")).withColumn("equal", F.expr("total = parts"))


@query("""with y as (select distinct year(o_orderdate)::int as year from orders), p as (select distinct o_orderpriority as priority from orders),
c as (select c_nationkey as area_code, o_orderpriority as priority, year(o_orderdate)::int as year, count(*) as n from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' group by all)
select n_nationkey as area_code, p.priority, y.year, n, n is null as missing from nation cross join p cross join y left join c on c.area_code = n_nationkey and c.priority = p.priority and c.year = y.year""")
def completeness_grid(spark, d):
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    axes = [n.select(F.col("n_nationkey").alias("area_code")), o.select(F.col("o_orderpriority").alias("priority")).distinct(), o.select(F.year("o_orderdate").alias("year")).distinct()]
    cells = _placed_orders(spark, d).filter("o_orderstatus = 'P'").groupBy(F.col("n_nationkey").alias("area_code"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return relational.complete_grid(cells, axes, ["area_code", "priority", "year"]).withColumn("missing", F.col("n").isNull())


@query("""select 'supplier' as source, n_nationkey as code from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)
union all select 'customer', n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9000)""")
def set_equality_report(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"))
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("code"))
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("code"))
    part = lambda other, name: n.join(other, "code", "left_anti").select(F.lit(name).alias("source"), "code")
    return part(s, "supplier").union(part(c, "customer"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def unique_key_violations(spark, d):
    return quality.duplicates(["l_orderkey", "l_linenumber"])(table(spark, d, "lineitem"))


@query("select p_brand, count(distinct p_type) as n from part group by 1 having count(distinct p_type) > 1")
def functional_dependency(spark, d):
    return quality.dependency("p_brand", "p_type")(table(spark, d, "part"))


@query("""select 'lineitem' as relation, l_orderkey as key from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus != 'P')
union all select 'labels', doc_id from labels where doc_id not in (select doc_id from documents)""")
def referential_orphans(spark, d):
    lines = quality.orphans(table(spark, d, "orders").filter("o_orderstatus != 'P'"), "l_orderkey", "o_orderkey")(table(spark, d, "lineitem").select("l_orderkey"))
    labels = quality.orphans(table(spark, d, "documents"), "doc_id", "doc_id")(table(spark, d, "labels").select("doc_id"))
    return lines.select(F.lit("lineitem").alias("relation"), F.col("l_orderkey").alias("key")).union(labels.select(F.lit("labels"), "doc_id"))


@query("""select count(*) as n, 'unique_line' as "check", (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) as violations, (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)) = 0 as passed from lineitem
union all select count(*), 'discount_range', count(case when l_discount not between 0 and 0.05 then 1 end), count(case when l_discount not between 0 and 0.05 then 1 end) = 0 from lineitem""")
def check_report(spark, d):
    rows = table(spark, d, "lineitem")
    checks = [quality.Check("unique_line", quality.duplicates(["l_orderkey", "l_linenumber"])), quality.Check("discount_range", quality.outside("l_discount", 0, 0.05), fatal=False)]
    return quality.report(rows, checks).drop("fatal").join(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row


@query("""select n_nationkey, lpad(n_nationkey::varchar, 2, '0') as area_code, lpad(n_regionkey::varchar, 2, '0') as pref_code, lpad(n_regionkey::varchar, 2, '0') || lpad(n_nationkey::varchar, 2, '0') as full_code from nation""")
def code_normalise(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", codes.code(F.col("n_nationkey").cast("double"), 2).alias("area_code"), codes.code(F.col("n_regionkey"), 2).alias("pref_code"))
    return n.withColumn("full_code", F.concat("pref_code", "area_code"))


@query("""with raw as (select event_id, case event_id % 7 when 0 then '-' when 1 then '*' when 2 then 'XXX' when 3 then ' ' when 4 then 'n/a' else json_extract_string(props, '$.k') end as literal from events)
select event_id, case when literal is null or trim(literal) = '' then 'blank' when literal = '-' then 'source_dash' when literal = '*' then 'not_disclosed' when literal = 'XXX' then 'not_calculated' when try_cast(literal as double) is not null then 'observed' else 'error' end as status,
  try_cast(trim(literal) as double) as value from raw""")
def sentinel_classify(spark, d):
    k = F.get_json_object("props", "$.k")
    case = F.col("event_id") % 7
    raw = table(spark, d, "events").select("event_id", F.when(case == 0, "-").when(case == 1, "*").when(case == 2, "XXX").when(case == 3, " ").when(case == 4, "n/a").otherwise(k).alias("literal"))
    return raw.select("event_id", codes.cell_status(F.col("literal")).alias("status"), codes.observed(F.col("literal")).alias("value"))


@query("""select l_orderkey, l_linenumber, measure, value from (select l_orderkey, l_linenumber, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem)
unpivot (value for measure in (quantity, price, discount, tax))""")
def unpivot_measures(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "price", "discount", "tax"], "measure", "value")


@query("""select user_id, event_type, count(*) as n, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by 1, 2""")
def pivot_to_arrays(spark, d):
    grouped = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("list"))
    return grouped.select("user_id", "event_type", "n", F.array_join(F.col("list").cast("array<string>"), ",").alias("ids"))


@query("""select n_nationkey as area_code, count(*) as customers, string_agg(c_mktsegment || ':' || n::varchar, ';' order by c_mktsegment) as segments, sum(n)::bigint as total
from (select n_nationkey, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2) group by 1""")
def nested_documents(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    each = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    nested = each.groupBy(F.col("n_nationkey").alias("area_code")).agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))).alias("s"))
    flat = F.transform("s", lambda x: F.concat_ws(":", x["c_mktsegment"], x["n"].cast("string")))
    return nested.select("area_code", F.size("s").cast("long").alias("customers"), F.array_join(flat, ";").alias("segments"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"))


@query("""select o_orderkey as key, flag from (select o_orderkey, case when o_totalprice > 400000 then 'large' end as a, case when o_orderstatus = 'P' then 'pending' end as b, case when o_orderpriority = '1-URGENT' then 'urgent' end as c from orders)
unpivot (flag for name in (a, b, c))""")
def sparse_flags_long(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("o_totalprice") > 400000, "large"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(flags).alias("flag"))


@query("""select c_mktsegment as segment, count(*) as n, floor(quantile_cont(c_acctbal, 0.5) * 1e4 + 0.5) / 1e4 as median, floor(quantile_cont(c_acctbal, 0.9) * 1e4 + 0.5) / 1e4 as p90, max(c_acctbal) as largest from customer group by 1""")
def ratio_distribution(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    found = quantiles.quantiles(rows, ["segment"], "c_acctbal", [0.5, 0.9, 1.0])
    at = lambda i: measures.half_up(F.get("quantiles", F.lit(i)))
    return found.select("segment", "n", at(0).alias("median"), at(1).alias("p90"), F.get("quantiles", F.lit(2)).alias("largest"))


@query("""with e as (select n_regionkey as region, c_custkey, c_acctbal from customer join nation on c_nationkey = n_nationkey),
q as (select region, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as edges from e group by 1)
select region, c_custkey, (case when c_acctbal >= edges[1] then 1 else 0 end + case when c_acctbal >= edges[2] then 1 else 0 end + case when c_acctbal >= edges[3] then 1 else 0 end)::int as class from e join q using (region)""")
def quantile_bins(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), "c_custkey", "c_acctbal")
    edges = quantiles.quantiles(rows, ["region"], "c_acctbal", [0.25, 0.5, 0.75]).withColumnRenamed("quantiles", "edges")
    return rows.join(edges, "region").select("region", "c_custkey", measures.quantile_class(F.col("c_acctbal"), F.col("edges")).alias("class"))


@query(f"""with r as ({ORACLES['ratio_by_area_function']}) select area_code, bed_function, ratio, case when ratio is not null then len(list_filter([0.77, 0.87, 0.95, 1.05, 1.15, 1.3]::double[], lambda e: e <= ratio))::int end as bin from r""")
def fixed_bins(spark, d):
    return ratio_by_area_function(spark, d).select("area_code", "bed_function", "ratio", measures.fixed_bin(F.col("ratio"), "ratio").alias("bin"))


@query("""select least(9, floor(l_discount * 100 + 0.5)::int) as bin, count(*) as n from lineitem group by 1""")
def score_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.least(F.lit(9), F.floor(F.col("l_discount") * 100 + 0.5).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


@query("""select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as band, count(*) as n, count(case when l_returnflag = 'R' then 1 end) as returned,
  floor(count(case when l_returnflag = 'R' then 1 end) / count(*) * 1e4 + 0.5) / 1e4 as rate from lineitem join part on l_partkey = p_partkey group by 1""")
def size_band_rate(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    rows = l.join(p, l.l_partkey == p.p_partkey).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return rows.withColumn("rate", measures.ratio(F.col("returned"), F.col("n")))


@query(f"""with {FLOWS_SQL} select origin, sum(n)::bigint as total, sum(case when origin = partner then n end)::bigint as self_n, count(case when origin != partner then 1 end) as partners, max(case when origin != partner then n end) as largest from flows group by 1""")
def od_flow_groups(spark, d):
    return flows.groups(flows.shares(_edges(spark, d), "origin", "partner"), "origin", "partner")


@query(f"""with {FLOWS_SQL}, t as (select *, sum(n) over (partition by origin) as total from flows)
select origin, partner, n_name as partner_name, n, floor(n / total * 1e6 + 0.5) / 1e6 as share, row_number() over (partition by origin order by n desc, partner)::int as rank from t join nation on partner = n_nationkey where origin != partner""")
def od_flow_breakdown(spark, d):
    rows = flows.ranked(flows.shares(_edges(spark, d), "origin", "partner"), "origin", "partner")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("partner"), F.col("n_name").alias("partner_name"))
    return rows.join(names, "partner").select("origin", "partner", "partner_name", "n", "share", "rank")


@query(f"""with {FLOWS_SQL}, r as (select *, row_number() over (partition by origin order by n desc, partner) as k from flows where origin != partner)
select origin, sum(case when k <= 5 then n end)::bigint as top_n, coalesce(sum(case when k > 5 then n end), 0)::bigint as rest_n from r group by 1""")
def od_remainder_topk(spark, d):
    return flows.remainder(flows.shares(_edges(spark, d), "origin", "partner"), "origin", "partner", 5)


@query(f"""with {FLOWS_SQL} select origin, sum(n)::bigint = coalesce(sum(case when origin = partner then n end), 0) + coalesce(sum(case when origin != partner then n end), 0) as holds from flows group by 1""")
def complement_identity(spark, d):
    rows = od_flow_groups(spark, d).join(od_remainder_topk(spark, d), "origin")
    return rows.select("origin", (F.col("total") == F.coalesce("self_n", F.lit(0)) + F.col("top_n") + F.col("rest_n")).alias("holds"))


@query("""select l_orderkey, min(l_linenumber)::bigint as low, max(l_linenumber)::bigint as high, count(*) as n, count(distinct l_linenumber) as d from lineitem group by 1 having min(l_linenumber) != 1 or max(l_linenumber) - min(l_linenumber) + 1 != count(*) or count(distinct l_linenumber) != count(*)""")
def rank_contiguity(spark, d):
    return quality.gaps("l_orderkey", "l_linenumber", 1)(table(spark, d, "lineitem"))


@query("""select conv_id, turn, previous, turn - previous - 1 as missing from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as previous from conversations) where turn - previous > 1""")
def gap_detection(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))
    return rows.withColumn("missing", F.expr("turn - previous - 1")).filter("missing > 0")


@query("""select n_nationkey, o_orderkey, o_totalprice, rank from (select n_nationkey, o_orderkey, o_totalprice, row_number() over (partition by n_nationkey order by o_totalprice desc, o_orderkey)::int as rank
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) where rank <= 5""")
def topk_per_group(spark, d):
    return relational.top_per_group(_placed_orders(spark, d), ["n_nationkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("n_nationkey", "o_orderkey", "o_totalprice", "rank")


@query("""select p_partkey, p_name from part where contains(lower(p_name), 'an')""")
def substring_search(spark, d):
    return table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("an"))).select("p_partkey", "p_name")


@query("""select l_partkey, a, b from (select l_partkey, sum(case when l_returnflag = 'R' then round(l_extendedprice * 100)::bigint end)::bigint as a, sum(case when l_returnflag = 'A' then round(l_extendedprice * 100)::bigint end)::bigint as b from lineitem group by 1)
where a > 0 and b > 0 and greatest(a, b) >= 2 * least(a, b) and abs(a - b) >= 100""")
def divergence_filter(spark, d):
    at = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, _cents()))
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(at("R").alias("a"), at("A").alias("b"))
    return rows.filter("a > 0 and b > 0 and greatest(a, b) >= 2 * least(a, b) and abs(a - b) >= 100")


@query("""select p_type as kind, count(*) as n, count(case when sold is not null then 1 end) as covered, floor(count(case when sold is not null then 1 end) / count(*) * 1e4 + 0.5) / 1e4 as rate
from part left join (select distinct l_partkey as sold from lineitem where l_quantity > 48) on p_partkey = sold group by 1""")
def coverage_tally(spark, d):
    sold = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("sold")).distinct()
    rows = table(spark, d, "part").join(sold, "p_partkey", "left").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.count("sold").alias("covered"))
    return rows.withColumn("rate", measures.ratio(F.col("covered"), F.col("n")))


@query("""select p_partkey, case when replace(replace(k, 'green', ''), 'red', '') = '' then k else replace(replace(k, 'green', ''), 'red', '') end as name from (select p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') as k from part)""")
def name_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.without_terms(text.folded(text.nfkc(F.col("p_name"))), ["red", "green"]).alias("name"))


@query("""select page_id, lang, top, starts_with(rest, 'example.' || top || '/' || lang || '/') as matches from (select page_id, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) as lang, regexp_extract(url, '([a-z]+)/[a-z]+/', 1) as top, regexp_extract(url, '(example[.].*)$', 1) as rest from pages)""")
def address_match(spark, d):
    at = lambda pattern: F.regexp_extract("url", pattern, 1)
    rows = table(spark, d, "pages").select("page_id", at("://[^/]+/([a-z]+)/").alias("lang"), at("([a-z]+)/[a-z]+/").alias("top"), at("(example[.].*)$").alias("rest"))
    return rows.select("page_id", "lang", "top", F.startswith("rest", F.concat(F.lit("example."), "top", F.lit("/"), "lang", F.lit("/"))).alias("matches"))


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts by brand: small ones as the left register, large ones as the right."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("block"), F.col("p_name").alias("name"), "p_size")
    return p.filter("p_size <= 25").select(F.col("p_partkey").alias("left_id"), "block", "name"), p.filter("p_size > 25").select(F.col("p_partkey").alias("right_id"), "block", "name")


SIDES_SQL = "l as (select p_partkey as left_id, p_brand as block, p_name as name from part where p_size <= 25), r as (select p_partkey as right_id, p_brand as block, p_name as name from part where p_size > 25)"


@query(f"""with {SIDES_SQL} select left_id, count(right_id) as candidates, case when count(right_id) = 1 then min(right_id) end as right_id from l left join r using (block, name) group by 1""")
def link_exact_tier(spark, d):
    left, right = _sides(spark, d)
    return linkage.exact(left, right, "block", "name").select("left_id", "candidates", "right_id")


@query(f"""with {SIDES_SQL}, x as (select left_id, case when count(right_id) = 1 then min(right_id) end as right_id from l left join r using (block, name) group by 1),
c as (select left_id, right_id, right_id is not null and count(*) over (partition by right_id) > 1 as contested from x) select left_id, contested, case when not contested then right_id end as right_id from c""")
def link_contest(spark, d):
    left, right = _sides(spark, d)
    return linkage.contested(linkage.exact(left, right, "block", "name")).select("left_id", "contested", "right_id")


@query(f"""with {SIDES_SQL}, s as (select left_id, block, regexp_replace(name, '^[^ ]+ ', '') as name from l)
select left_id, count(*) as candidates, case when count(*) = 1 then min(right_id) end as right_id from s join r using (block) where s.name != r.name and least(length(s.name), length(r.name)) >= 5 and (ends_with(s.name, r.name) or ends_with(r.name, s.name)) group by 1""")
def link_suffix_tier(spark, d):
    left, right = _sides(spark, d)
    return linkage.suffix(left.withColumn("name", F.regexp_replace("name", "^[^ ]+ ", "")), right, "block", "name")


@query()
def link_fuzzy_candidates(spark, d):
    left, right = _sides(spark, d)
    return linkage.fuzzy(left, right, "block", "name")


@query(f"""with {SIDES_SQL} select left_id, case when count(right_id) = 0 then 'none' when count(right_id) = 1 then 'unique' else 'ambiguous' end as status from l left join r using (block, name) group by 1""")
def reference_resolve(spark, d):
    left, right = _sides(spark, d)
    n = F.col("candidates")
    return linkage.exact(left, right, "block", "name").select("left_id", F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("status"))


def _points(spark, d) -> DataFrame:
    """Coordinates from keys: a place, and a reference that is shifted for some and missing for others."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", (30 + (k % 100) / 10.0).alias("lat"), (130 + (k % 73) / 10.0).alias("lon"), "p_size")
    shift = F.when(F.col("p_size") % 5 == 0, 0.02).when(F.col("p_size") % 5 == 1, 0.004).otherwise(0.0004)
    return rows.withColumn("ref_lat", F.when(F.col("p_size") % 7 != 0, F.col("lat") + shift)).withColumn("ref_lon", F.col("lon"))


POINTS_SQL = """points as (select p_partkey, p_size, lat, lon, case when p_size % 7 != 0 then lat + case when p_size % 5 = 0 then 0.02::double when p_size % 5 = 1 then 0.004::double else 0.0004::double end end as ref_lat
  from (select p_partkey, p_size, 30 + (p_partkey % 100) / 10.0::double as lat, 130 + (p_partkey % 73) / 10.0::double as lon from part)),
audit as (select *, 2 * 6371008.8::double * asin(sqrt(pow(sin(radians(ref_lat - lat) / 2), 2))) as m from points)"""


def _audited(spark, d) -> DataFrame:
    rows = _points(spark, d).withColumn("m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon")))
    m = F.col("m")
    return rows.withColumn("status", F.when(m.isNull(), "no_reference").when(m < 100, "agree").when(m < 1000, "minor_gap").otherwise("conflict"))


@query(f"""with {POINTS_SQL} select p_partkey, floor(m * 10 + 0.5) / 10 as distance_m, case when m is null then 'no_reference' when m < 100 then 'agree' when m < 1000 then 'minor_gap' else 'conflict' end as status from audit""")
def haversine_audit(spark, d):
    return _audited(spark, d).select("p_partkey", measures.half_up(F.col("m"), 1).alias("distance_m"), "status")


@query(f"""with {POINTS_SQL} select p_partkey, case when m >= 1000 then null else lat end as lat, case when m >= 1000 then 'withdrawn' when m is null then 'unverified' else 'verified' end as source from audit""")
def coordinate_adoption(spark, d):
    rows = _audited(spark, d)
    source = F.when(F.col("status") == "conflict", "withdrawn").when(F.col("status") == "no_reference", "unverified").otherwise("verified")
    return rows.select("p_partkey", F.when(F.col("status") != "conflict", F.col("lat")).alias("lat"), source.alias("source"))


#: Polygons as closed rings: outer, holes (fixed fixtures).
POLYGONS = "(1, array((130.2d, 30.2d), (133.3d, 30.4d), (133.1d, 35.7d), (130.1d, 35.2d), (130.2d, 30.2d)), array(array((131.2d, 32.2d), (132.2d, 32.2d), (132.2d, 33.2d), (131.2d, 33.2d), (131.2d, 32.2d)))), (2, array((134.2d, 33.1d), (136.9d, 34.3d), (135.4d, 38.9d), (134.2d, 33.1d)), array())"


def _polygons(spark) -> DataFrame:
    ring = "array<struct<x: double, y: double>>"
    return spark.sql(f"select col1 as area, cast(col2 as {ring}) as shell, cast(col3 as array<{ring}>) as holes from values {POLYGONS}")


PIP = "len(list_filter(range(1, len({r})), lambda i: ({r}[i].y > lat) != ({r}[i+1].y > lat) and lon < ({r}[i+1].x - {r}[i].x) * (lat - {r}[i].y) / nullif({r}[i+1].y - {r}[i].y, 0) + {r}[i].x)) % 2 = 1"
POLYGONS_SQL = """polygons as (select 1 as area, [{x: 130.2::double, y: 30.2::double}, {x: 133.3::double, y: 30.4::double}, {x: 133.1::double, y: 35.7::double}, {x: 130.1::double, y: 35.2::double}, {x: 130.2::double, y: 30.2::double}] as shell,
  [{x: 131.2::double, y: 32.2::double}, {x: 132.2::double, y: 32.2::double}, {x: 132.2::double, y: 33.2::double}, {x: 131.2::double, y: 33.2::double}, {x: 131.2::double, y: 32.2::double}] as hole
  union all select 2, [{x: 134.2::double, y: 33.1::double}, {x: 136.9::double, y: 34.3::double}, {x: 135.4::double, y: 38.9::double}, {x: 134.2::double, y: 33.1::double}], null)"""


@query("with " + POLYGONS_SQL + ", " + POINTS_SQL + " select p_partkey, min(area) as area from points join polygons on " + PIP.format(r="shell") + " and (hole is null or not (" + PIP.format(r="hole") + ")) group by 1")
def point_in_polygon_grid(spark, d):
    return spatial.points_in(_points(spark, d), _polygons(spark), "p_partkey", "area").select("p_partkey", "area")


@query("""select n_nationkey, case n_nationkey when 3 then 4 when 7 then 0 else n_regionkey end::int as n_regionkey, n_nationkey in (3, 7) as overridden from nation""")
def override_mapping(spark, d):
    fixes = spark.createDataFrame([(3, 4), (7, 0)], "n_nationkey int, n_regionkey int")
    return relational.override(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), fixes, "n_nationkey", "n_regionkey")


@query("""select 'orders' as sheet, n_name as key, 'orders/' || o_orderpriority as label, count(*)::varchar as value from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name, o_orderpriority""")
def layout_scan(spark, d):
    """A sheet with a merged header over one column per priority, generated as cells and scanned back."""
    rows = _placed_orders(spark, d).groupBy("n_nationkey", "n_name", "o_orderpriority").agg(F.count("*").alias("n"))
    rows = rows.withColumn("col", F.substring("o_orderpriority", 1, 1).cast("int")).withColumn("row", F.col("n_nationkey") + 3)
    cell = lambda row, col, value: F.struct(F.lit("orders").alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))
    zero, col = F.lit(0), F.col("col")
    first = F.when(col == 1, F.lit("orders"))  # the merged cell holds its text at the left
    cells = rows.select(F.explode(F.array(cell(F.lit(1), col, first), cell(F.lit(2), col, F.col("o_orderpriority")), cell(F.col("row"), zero, F.col("n_name")), cell(F.col("row"), col, F.col("n")))).alias("c")).select("c.*").distinct()
    return layout.tidy(cells, (1, 2), 0)


@query("""select 'nation' as name, count(*) as n, sum(('0x' || substr(sha256(n_nationkey::varchar || '|' || n_name), 1, 13))::bigint::hugeint)::varchar as digest from nation
union all select 'orders', count(*), sum(('0x' || substr(sha256(o_orderkey::varchar || '|' || o_custkey::varchar), 1, 13))::bigint::hugeint)::varchar from orders""")
def manifest(spark, d):
    one = lambda name, keys: exports.digest(table(spark, d, name), keys).select(F.lit(name).alias("name"), "n", "digest")
    return one("nation", ["n_nationkey", "n_name"]).union(one("orders", ["o_orderkey", "o_custkey"]))


@query("""select 'count' as dataset, c_nationkey as area, o_orderpriority as category, year(o_orderdate)::int as year, count(*)::double as value, 'orders' as unit from orders join customer on o_custkey = c_custkey group by 2, 3, 4
union all select 'amount', c_nationkey, o_orderpriority, year(o_orderdate)::int, sum(round(o_totalprice * 100)::bigint)::double, 'cents' from orders join customer on o_custkey = c_custkey group by 2, 3, 4""")
def detail_long_export(spark, d):
    rows = _placed_orders(spark, d).groupBy(F.col("n_nationkey").alias("area"), F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("cents"))
    return rows.select(F.expr("stack(2, 'count', n, 'orders', 'amount', cents, 'cents') as (dataset, value, unit)"), "area", "category", "year").select("dataset", "area", "category", "year", "value", "unit")


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2""")
def event_windows(spark, d):
    from ledgerline.streaming.events import tumbling_counts

    return tumbling_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
