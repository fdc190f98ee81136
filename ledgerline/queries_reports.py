"""More queries: sheets and lists, names and addresses, flows by group, quality rules and exports. Registered like those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import codes, geo, measures, names, places
from ledgerline.operators import entities, flows, linkage, quality, quantiles, relational, sums
from ledgerline.plans import exports, lineage
from ledgerline.queries import FLOWS_SQL, POINTS_SQL, _edges, _placed_orders, _points, query
from ledgerline.sources import blocks
from ledgerline.sources.tables import table


def _literals(values: list[str]):
    return F.array(*map(F.lit, values))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Names and addresses.

#: Parts of names and addresses to be combined by key (fixtures).
NAME_HEADS = ["医療法人社団 森", "社会福祉法人 光の里", "厚生連", "（財）北 山", "医療法人", "School・A ", "国立大学法人 東", ""]
NAME_TAILS = ["クリニック", "総合病院", "内科 外科", "センター", "-1号館"]
ADDRESSES = [
    "札幌市北区北1条", "横浜市栄町3", "標津郡中標津町東5", "文京区本郷7-3", "赤磐市下市187", "昭和町河東中島443", "港北区小机町3211", "長崎県長崎市坂本1-7", "龍ヶ崎市中里1",
    "東京都千代田区丸の内1", "川柳町3-50-1", "12番地", "四日市市芝田2", "玉村町福島",
]
TOWNS = ["札幌市北区", "横浜市港北区", "中標津町", "文京区", "赤磐市", "龍ケ崎市", "四日市市", "玉村町", ""]


def _replaced(text: str, terms: list[str]) -> str:
    for term in sorted(set(terms), key=lambda t: (-len(t), t)):
        text = f"replace({text}, '{term}', '')"
    return text


_PLAIN_TYPES = [w.translate({ord(c): None for c in names.SYMBOLS}) for w in names.TYPE_WORDS]


@query(f"""with raw as (select p_partkey, {_sql_list(NAME_HEADS)}[p_partkey % {len(NAME_HEADS)} + 1] || {_sql_list(NAME_TAILS)}[p_partkey % {len(NAME_TAILS)} + 1] as name from part),
plain as (select p_partkey, translate(regexp_replace(lower(name), '\\s', '', 'g'), '（）・ー-', '') as plain from raw),
short as (select p_partkey, plain, {_replaced('plain', names.LEGAL_ENTITIES)} as short from plain),
kept as (select p_partkey, case when {_replaced('short', _PLAIN_TYPES)} = '' then plain else short end as name from short)
select p_partkey, name, {_replaced('name', _PLAIN_TYPES)} = '' as type_words_only from kept""")
def facility_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    raw = F.concat(F.get(_literals(NAME_HEADS), k % len(NAME_HEADS)), F.get(_literals(NAME_TAILS), k % len(NAME_TAILS)))
    rows = table(spark, d, "part").select("p_partkey", names.normal_name(raw).alias("name"))
    return rows.withColumn("type_words_only", names.type_words_only(F.col("name")))


def _address(key: str):
    k = F.col(key).cast("int")
    return F.get(_literals(ADDRESSES), k % len(ADDRESSES)), F.get(_literals(TOWNS), k % len(TOWNS))


@query(f"""with raw as (select c_custkey, {_sql_list(ADDRESSES)}[c_custkey % {len(ADDRESSES)} + 1] as address, {_sql_list(TOWNS)}[c_custkey % {len(TOWNS)} + 1] as town from customer),
p as (select *, regexp_replace(address, '{places.PREFECTURES_PATTERN}', '') as place from raw),
m as (select *, nullif(regexp_extract(place, '{places.CITIES_PATTERN}', 1), '') as city, nullif(regexp_extract(place, '{places.CITIES_PATTERN}({places.NAME}+?区)', 2), '') as ward,
  coalesce(nullif(regexp_extract(place, '^{places.NAME}+?郡({places.NAME}+?(町|村))', 1), ''), nullif(regexp_extract(place, '{places.WARDS_PATTERN}', 1), ''), nullif(regexp_extract(place, '^({places.NAME}+?市)', 1), '')) as sure,
  nullif(regexp_extract(place, '^({places.NAME}+?(町|村))', 1), '') as bare, translate(place, 'ヶヵ', 'ケカ') as large, translate(town, 'ヶヵ', 'ケカ') as name from p),
f as (select *, case when city is not null then city || ward else coalesce(sure, case when not contains(bare, '区') then bare end) end as municipality, case when city is not null then city || ward else sure end as certain,
  name != '' and (starts_with(large, name) or starts_with(regexp_replace(large, '^{places.NAME}+?郡', ''), name) or coalesce(ends_with(name, nullif(regexp_extract(large, '^({places.NAME}+?区)', 1), '')), false)) as fits from m)
select c_custkey, municipality, case when fits then '' when certain is null then 'municipality_not_in_address' else 'municipality_mismatch' end as reason,
  municipality is null and regexp_matches(place, '^{places.NAME}{{1,4}}区') as bare_ward from f""")
def address_municipality(spark, d):
    address, town = _address("c_custkey")
    return table(spark, d, "customer").select("c_custkey", places.municipality(address).alias("municipality"), places.municipality_check(address, town).alias("reason"), places.bare_ward(address).alias("bare_ward"))


def _registers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Small parts as facilities, large ones as points; brands are areas, names differ by key, some towns are unreported."""
    address, town = _address("p_size")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("area"), F.col("p_type").alias("region"), F.concat(name, F.lit(" "), (F.col("p_partkey") % 97).cast("string")).alias("name"), "p_size", address.alias("address"), town.alias("municipality"))
    return rows.filter("p_size <= 25").withColumnRenamed("p_partkey", "left_id"), rows.filter("p_size > 25").withColumnRenamed("p_partkey", "right_id")


@query()
def link_three_tiers(spark, d):
    left, right = _registers(spark, d)
    return linkage.tiers(left, right, cut=lineage.cut)


@query(f"""with r as (select p_partkey, p_type, case when p_partkey % 4 = 0 then 'new ' || p_name else p_name end || ' ' || (p_partkey % 97)::varchar as name, p_size,
  {_sql_list(ADDRESSES)}[p_size % {len(ADDRESSES)} + 1] as address, {_sql_list(TOWNS)}[p_size % {len(TOWNS)} + 1] as town from part),
pairs as (select l.p_partkey as left_id, l.town, r.p_partkey as right_id, regexp_replace(r.address, '{places.PREFECTURES_PATTERN}', '') as place from (from r where p_size <= 25) l left join (from r where p_size > 25) r using (p_type, name)),
f as (select *, translate(place, 'ヶヵ', 'ケカ') as a, translate(town, 'ヶヵ', 'ケカ') as t from pairs),
g as (select left_id, town, right_id, case when town = '' then right_id is not null else coalesce(starts_with(a, t) or starts_with(regexp_replace(a, '^{places.NAME}+?郡', ''), t) or coalesce(ends_with(t, nullif(regexp_extract(a, '^({places.NAME}+?区)', 1), '')), false), false) end as fit from f),
h as (select left_id, town, count(right_id) as n, count(case when fit then 1 end) as fit, min(case when fit then right_id end) as right_id from g group by 1, 2)
select left_id, case when n = 0 then 'none' when fit = 0 then 'municipality_mismatch' when fit > 1 then 'ambiguous' when town = '' then 'unique_municipality_unverified' else 'unique' end as reference_status, case when fit = 1 then right_id end as right_id from h""")
def reference_municipality(spark, d):
    return linkage.references(*_registers(spark, d))


@query("""with raw as (select s_suppkey, case when s_suppkey % 5 = 0 then '0.0' when s_suppkey % 5 = 1 then ' ' when s_suppkey % 5 = 2 then 'n/a' else (20 + s_suppkey % 30)::varchar end as lat, case when s_suppkey % 5 = 0 then '0.0' else (118 + s_suppkey % 40)::varchar end as lon from supplier),
n as (select s_suppkey, try_cast(trim(lat) as double) as lat, try_cast(trim(lon) as double) as lon from raw)
select s_suppkey, case when lat > 20 and lat < 46 and lon > 122 and lon < 154 then lat end as lat, case when lat > 20 and lat < 46 and lon > 122 and lon < 154 then lon end as lon from n""")
def usable_coordinates(spark, d):
    k = F.col("s_suppkey")
    lat = F.when(k % 5 == 0, "0.0").when(k % 5 == 1, " ").when(k % 5 == 2, "n/a").otherwise((20 + k % 30).cast("string"))
    lon = F.when(k % 5 == 0, "0.0").otherwise((118 + k % 40).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", codes.usable_coordinate(lat, lon).alias("p")).select("s_suppkey", "p.lat", "p.lon")


@query(f"""with {POINTS_SQL} select p_partkey, case when p_size % 3 = 0 then case when m is null then 'missing_without_reference' else 'missing_with_reference' end
  when m is null then 'no_reference' when m < 100 then 'agree' when m < 1000 then 'minor_gap' else 'conflict' end as status from audit""")
def audit_bands(spark, d):
    rows = _points(spark, d).withColumn("m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon")))
    return rows.select("p_partkey", linkage.audit_status(F.col("p_size") % 3 != 0, F.col("ref_lat").isNotNull(), F.col("m")).alias("status"))


# Sheets, lists and labels.


@query("""select 'counts' as sheet, n_nationkey as block, l.v as label, count(case when substr(o_orderpriority, 1, 1) = l.v then 1 end) as orders
from nation cross join (select unnest(['1', '2', '3', '4', '5']) as v) l left join (select c_nationkey, o_orderpriority from orders join customer on o_custkey = c_custkey) on c_nationkey = n_nationkey group by 1, 2, 3""")
def block_scan(spark, d):
    """A sheet with a block of six rows per nation (its number, then a row per priority), made as cells and scanned back."""
    counts = _placed_orders(spark, d).groupBy("n_nationkey").agg(*[F.count_if(F.substring("o_orderpriority", 1, 1) == str(p)).alias(f"p{p}") for p in range(1, 6)])
    n = table(spark, d, "nation").select("n_nationkey").join(counts, "n_nationkey", "left").fillna(0)
    cell = lambda place, col, value: F.struct(F.lit("counts").alias("sheet"), (F.col("n_nationkey") * 6 + place + 4).alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    made = [cell(0, 1, F.col("n_nationkey") + 1)]
    for p in range(1, 6):
        made += [cell(p, 1, F.lit(str(p))), cell(p, 2, F.col(f"p{p}"))]
    cells = n.select(F.explode(F.array(*made)).alias("c")).select("c.*")
    placed = blocks.fixed_blocks(cells, 4, 6, 25).filter("place > 0")
    both = placed.groupBy("sheet", "block", "place").agg(F.max(F.when(F.col("col") == 1, F.col("value"))).alias("label"), F.max(F.when(F.col("col") == 2, F.col("value"))).cast("long").alias("orders"))
    return both.select("sheet", "block", "label", "orders")


@query("""with l as (select n_nationkey, ['2015実績', '2026見込量', '2025必要数', '2015年との差', '見込み／必要数', '2030年度（現状投影）'][n_nationkey % 6 + 1] as label from nation)
select n_nationkey, nullif(regexp_extract(label, '^([0-9]{4})(実績|見込量|必要数)$', 2), '') as series, try_cast(regexp_extract(label, '^([0-9]{4})(実績|見込量|必要数)$', 1) as int) as year,
  try_cast(regexp_extract(label, '^([0-9]{4})年度', 1) as int) as fiscal_year from l""")
def header_series(spark, d):
    label = F.get(_literals(["2015実績", "2026見込量", "2025必要数", "2015年との差", "見込み／必要数", "2030年度（現状投影）"]), F.col("n_nationkey") % 6)
    rows = table(spark, d, "nation").select("n_nationkey", codes.series_column(label).alias("s"), codes.year_of_label(label).alias("fiscal_year"))
    return rows.select("n_nationkey", "s.series", "s.year", "fiscal_year")


@query("""select l_orderkey, min(l_linenumber) as low, max(l_linenumber) as high, count(*) as n from
  (select l_orderkey, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as run from (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 10)) group by l_orderkey, run""")
def contiguous_runs(spark, d):
    return blocks.runs(table(spark, d, "lineitem").filter("l_quantity > 10"), ["l_orderkey"], "l_linenumber")


@query("""with m as (select conv_id, turn, turn % 5 != 3 as filled from conversations), g as (select *, max(case when filled then 0 else 1 end) over (partition by conv_id order by turn) = 1 as late from m)
select conv_id, turn, late, row_number() over (partition by conv_id order by turn)::int as rank from g where filled""")
def rows_until_gap(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 != 3, F.col("role")).alias("value"))
    return blocks.ranked_until_gap(rows, ["conv_id"], "turn", "value").select("conv_id", "turn", "late", "rank")


@query("""with m as (select o_custkey, o_orderkey, o_totalprice < 250000 as blank from orders), s as (select *, blank and coalesce(lead(blank) over w, false) as stop from m window w as (partition by o_custkey order by o_orderkey)),
o as (select *, max(case when stop then 1 else 0 end) over (partition by o_custkey order by o_orderkey) as over_ from s) select o_custkey, o_orderkey from o where over_ = 0 and not blank""")
def rows_until_double_blank(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") >= 250000, F.col("o_totalprice").cast("string")).alias("value"))
    return blocks.until_double_blank(rows, ["o_custkey"], "o_orderkey", "value").select("o_custkey", "o_orderkey")


@query("""select n_regionkey as region, false as uneven, n_nationkey::varchar as code, n_name as name from nation""")
def code_name_pairs(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    lists = n.select("region", F.array_join(F.col("s.n_nationkey").cast("array<string>"), ",").alias("codes"), F.array_join(F.col("s.n_name"), ", ").alias("names"))
    return blocks.code_pairs(lists, "codes", "names")


@query("""with raw as (select event_id, case event_id % 4 when 0 then 'XXX' when 1 then '1.5' when 2 then '0.25' else '-0.5' end as literal, case event_id % 3 when 0 then 1.2345 when 1 then 10.5 else 0.00001 end as man from events)
select event_id, case when try_cast(literal as double) between 0 and 1 then try_cast(literal as double) end as value, literal, coalesce(try_cast(literal as double) not between 0 and 1, false) as bad,
  case event_id % 3 when 0 then 12345 when 1 then 105000 end::bigint as persons, case when event_id % 2 = 0 then '07' end as code from raw""")
def cells_to_numbers(spark, d):
    k = F.col("event_id")
    literal = F.when(k % 4 == 0, "XXX").when(k % 4 == 1, "1.5").when(k % 4 == 2, "0.25").otherwise("-0.5")
    man = F.when(k % 3 == 0, 1.2345).when(k % 3 == 1, 10.5).otherwise(0.00001)
    rows = table(spark, d, "events").select("event_id", codes.rate_or_literal(literal, 0, 1).alias("r"), codes.persons(man).alias("persons"), codes.number_code(F.when(k % 2 == 0, "7.0").otherwise("7.5"), 2, 0, 47).alias("code"))
    return rows.select("event_id", "r.*", "persons", "code")


# Joins, roll-ups and classes.


@query("""select n_nationkey as area, c.n as customers, s.n as suppliers, string_agg(x, ',' order by x) as missing from nation left join (select c_nationkey as k, count(*) as n from customer group by 1) c on c.k = n_nationkey
left join (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 5000 group by 1) s on s.k = n_nationkey left join lateral (select unnest([case when c.n is null then 'customers' end, case when s.n is null then 'suppliers' end]) as x) t on x is not null group by all""")
def four_tables_by_key(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("area")).agg(F.count("*").alias("suppliers"))
    joined = relational.one_to_one({"nations": n, "customers": c, "suppliers": s}, "area")
    return joined.withColumn("missing", F.nullif(F.array_join("missing", ","), F.lit("")))


@query("""with f as (select distinct o_custkey as k from orders), r as (select c_custkey as k, s_suppkey is null as no_s, f.k is null as no_f, c_nationkey as cn, s_nationkey as sn, f.k % 25 as fn from customer left join supplier on s_suppkey = c_custkey left join f on f.k = c_custkey),
t as (select k, unnest([case when no_s then 'missing in supplier' end, case when no_f then 'missing in orders' end, case when (not no_s and cn != sn) or (not no_f and cn != fn) or (not no_s and not no_f and sn != fn) then 'different nation' end]) as problem from r)
select k as key, problem from t where problem is not null union all select s_suppkey, 'only in supplier' from supplier where s_suppkey not in (select c_custkey from customer) union all select k, 'only in orders' from f where k not in (select c_custkey from customer)""")
def entity_tables(spark, d):
    """Three tables by one key, bucketed by it and met without a shuffle: who lacks a key, and where a shared measure differs."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("nation"), "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("nation"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top")).withColumn("nation", F.col("key") % 25)
    run = uuid.uuid4().hex
    tables = {name: entities.bucketed(rows, f"entity_{run}_{name}", "key", 8) for name, rows in (("customer", c), ("supplier", s), ("orders", o))}
    return entities.disagreements(tables, "key", ["nation"])


@query("""with o as (select c_nationkey as area, o_orderpriority as kind, o_orderstatus as s, year(o_orderdate) as y, count(*) as n from orders join customer on o_custkey = c_custkey group by all)
select area, kind, max(case when s = 'F' and y = 1995 then n end) as old_1995, max(case when s = 'O' and y = 1995 then n end) as new_1995, max(case when s = 'F' and y = 1996 then n end) as old_1996, max(case when s = 'O' and y = 1996 then n end) as new_1996, any_value(area * 10)::bigint as need
from o where area is not null group by 1, 2""")
def vintage_measures(spark, d):
    """Five figures of two vintages side by side, of which the need must be the same in both."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    each = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("area"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("vintage"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("value"))
    counts = each.withColumn("measure", F.lit("count"))
    cells = each.select("area", "kind").distinct().withColumn("vintage", F.explode(F.array(F.lit("F"), F.lit("O"))))
    need = cells.select("area", "kind", "vintage", F.lit(1995).alias("year"), (F.col("area") * 10).cast("long").alias("value"), F.lit("need").alias("measure"))
    picks = {f"{name}_{y}": (s, "count", y) for y in (1995, 1996) for name, s in (("old", "F"), ("new", "O"))}
    return relational.vintage_measures(counts.unionByName(need), ["area", "kind"], picks, {"need": [("F", "need", 1995), ("O", "need", 1995)]})


@query("""with c as (select distinct c_custkey as k from customer), s as (select distinct s_suppkey * 3 as k from supplier), new as (select k from c where k not in (select k from s)), old as (select k from s where k not in (select k from c)),
m as (select k + (case when k % 7 = 0 then 1000000 else 0 end) as new, null::bigint as old from new union all select null, k from old where k % 5 != 0)
select 'left' as side, k::varchar as code, 'uncovered' as problem from new where k % 7 = 0 union all select 'left', new::varchar, 'stale' from m where new > 1000000 union all select 'right', k::varchar, 'uncovered' from old where k % 5 = 0""")
def crosswalk_drift(spark, d):
    """A crosswalk of codes that a join leaves over, in which some entries are out of date and some are missing."""
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"))
    status = relational.join_status(c, s, ["k"])
    new = status.filter("status = 'left_only'").select(F.when(F.col("k") % 7 == 0, F.col("k") + 1_000_000).otherwise(F.col("k")).alias("new"), F.lit(None).cast("long").alias("old"))
    old = status.filter("status = 'right_only' and k % 5 != 0").select(F.lit(None).cast("long").alias("new"), F.col("k").alias("old"))
    return relational.crosswalk_drift(status, "k", new.union(old))


@query("""select c_nationkey, c_mktsegment, (c_nationkey, c_mktsegment) in (select (c_nationkey, c_mktsegment) from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' and o_totalprice > 300000) as confirmed from (select distinct c_nationkey, c_mktsegment from customer)""")
def corroborated_claims(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 300000")
    return relational.corroborate(c, o.join(c, o.o_custkey == c.c_custkey), ["c_nationkey", "c_mktsegment"])


@query("""select 'p_brand' as side, p_brand as value, count(distinct p_type) as n from part group by 2 having count(distinct p_type) > 1 union all select 'p_type', p_type, count(distinct p_brand) from part group by 2 having count(distinct p_brand) > 1""")
def bijection_breaks(spark, d):
    return relational.bijection_errors(table(spark, d, "part"), "p_brand", "p_type")


#: A sum of 128-bit integers as a double: two exact halves, which are rounded once.
WHOLE_SQL = "(case when {x} < 0 then -1.0 else 1.0 end)::double * ((abs({x}) // 4294967296)::double * 4294967296::double + (abs({x}) % 4294967296)::double)"


@query("with s as (select n_regionkey as region, sum((o_totalprice * 17592186044416)::hugeint) as x from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1) select region, " + WHOLE_SQL.format(x="x") + " / 17592186044416 as total from s")
def exact_rollup(spark, d):
    return sums.exact_sums(_placed_orders(spark, d).withColumn("region", F.col("n_regionkey")), ["region"], {"total": F.col("o_totalprice")})


@query("""with v as (select l_returnflag as flag, l_linestatus as status, round(l_extendedprice * 100)::hugeint * (1::bigint << (4 * (l_linenumber % 8))::int) as b, case when l_suppkey % 2 = 0 then -1 else 1 end as side from lineitem),
s as (select flag, status, sum(b * side)::hugeint as a, sum(b)::hugeint as b from v group by 1, 2) select flag, status, """ + WHOLE_SQL.format(x="a") + " / 1048576 as net, " + WHOLE_SQL.format(x="b") + " / 1048576 as gross from s")
def mixed_magnitudes(spark, d):
    rows = table(spark, d, "lineitem").withColumn("v", F.round(F.col("l_extendedprice") * 100) * F.pow(F.lit(2.0), 4 * (F.col("l_linenumber") % 8) - 20))
    net = F.when(F.col("l_suppkey") % 2 == 0, -F.col("v")).otherwise(F.col("v"))
    return sums.exact_sums(rows.withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"}), ["flag", "status"], {"net": net, "gross": F.col("v")})


@query("""with s as (select c_mktsegment as segment, list(c_acctbal order by c_acctbal) as v from customer group by 1) select segment, len(v) as n, v[least(len(v) - 1, floor(len(v) * 0.9))::bigint + 1] as quantile from s""")
def element_quantile(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return quantiles.element(rows, ["segment"], "c_acctbal", 0.9)


@query("""with e as (select l_returnflag as flag, quantile_cont(l_discount, [0, 1/7, 2/7, 3/7, 4/7, 5/7, 6/7, 1]) as raw from lineitem group by 1), u as (select flag, list_sort(list_distinct(list_transform(raw, lambda x: round(x, 9)))) as edges from e)
select flag, len(edges)::int as n_edges, list_min(edges) as low, list_max(edges) as high, array_to_string(list_transform(range(0, len(edges) - 1), lambda i: floor(i * 6 / (len(edges) - 2) + 0.5)::int), ',') as ramp from u""")
def sequential_classes(spark, d):
    rows = quantiles.class_edges(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_discount"), ["flag"], "l_discount")
    rows = rows.withColumn("edges", measures.distinct_edges(F.transform("edges", lambda x: F.round(x, 9))))
    ramp = measures.ramp_places(F.size("edges") - 1, 7)
    return rows.select("flag", F.size("edges").alias("n_edges"), F.array_min("edges").alias("low"), F.array_max("edges").alias("high"), F.array_join(ramp.cast("array<string>"), ",").alias("ramp"))


@query("""with y as (select c_mktsegment as segment, count(case when year(o_orderdate) = 1995 then 1 end) as a, count(case when year(o_orderdate) = 1996 then 1 end) as b, count(*) as n from orders join customer on o_custkey = c_custkey group by 1), r as (select *, floor((b / a - 1) * 100 * 10 + 0.5) / 10 as p from y)
select segment, case when p = 0 then '0.0%' else printf('%+.1f%%', p) end as change, printf('%.1f%%', floor(b * 100.0::double / n * 10 + 0.5) / 10) as share from r""")
def change_labels(spark, d):
    at = lambda y: F.count_if(F.year("o_orderdate") == y)
    rows = _placed_orders(spark, d).groupBy(F.col("c_mktsegment").alias("segment")).agg(at(1995).alias("a"), at(1996).alias("b"), F.count("*").alias("n"))
    return rows.select("segment", measures.change_text(F.col("b") / F.col("a")).alias("change"), measures.share_text(F.col("b"), F.col("n")).alias("share"))


@query("""with p as (select n_nationkey, 130 + (n_nationkey % 7) as x, 30 + (n_nationkey % 5) as y, n_regionkey from nation) select n_regionkey as region, min(x)::double as x0, min(y)::double as y0, max(x)::double + 0.5 as x1, max(y)::double + 0.25 as y1 from p group by 1""")
def bbox_by_region(spark, d):
    k = F.col("n_nationkey")
    point = lambda dx, dy: F.struct((130.0 + k % 7 + dx).alias("x"), (30.0 + k % 5 + dy).alias("y"))
    shapes = table(spark, d, "nation").withColumn("rings", F.array(F.array(point(0, 0), point(0.5, 0), point(0.5, 0.25), point(0, 0)))).withColumn("b", geo.bbox("rings"))
    return shapes.groupBy(F.col("n_regionkey").alias("region")).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


@query("""select r_name as region, o_orderpriority as bed_function, count(case when o_orderstatus = 'F' then 1 end) as actual, count(case when o_orderstatus = 'P' then 1 end) as need, count(case when o_orderstatus = 'F' then 1 end) - count(case when o_orderstatus = 'P' then 1 end) as difference,
  floor(count(case when o_orderstatus = 'F' then 1 end) / nullif(count(case when o_orderstatus = 'P' then 1 end), 0) * 1e4 + 0.5) / 1e4 as ratio from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def ratio_by_region_function(spark, d):
    rows = _placed_orders(spark, d).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("bed_function"))
    rows = rows.agg(F.count_if(F.col("o_orderstatus") == "F").alias("actual"), F.count_if(F.col("o_orderstatus") == "P").alias("need"))
    return rows.withColumn("difference", F.expr("actual - need")).withColumn("ratio", measures.ratio(F.col("actual"), F.col("need")))


@query("""with y as (select c_nationkey as area, year(o_orderdate)::int as year, count(case when o_orderstatus = 'F' then 1 end) / count(*) as rate from orders join customer on o_custkey = c_custkey group by 1, 2),
a as (select * from y), b as (select area, year + 1 as year, rate from y)
select coalesce(a.year, b.year) as year, count(a.rate) as old_n, count(b.rate) as new_n, count(case when a.rate != b.rate then 1 end) as differ from a full join b on a.area = b.area and a.year = b.year group by 1""")
def report_rate_differences(spark, d):
    y = _placed_orders(spark, d).groupBy(F.col("c_nationkey").alias("area"), F.year("o_orderdate").alias("year")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rate"))
    a, b = y.withColumnRenamed("rate", "a"), y.select("area", (F.col("year") + 1).alias("year"), F.col("rate").alias("b"))
    return a.join(b, ["area", "year"], "full").groupBy("year").agg(F.count("a").alias("old_n"), F.count("b").alias("new_n"), F.count_if(F.expr("a != b")).alias("differ"))


@query("""with s as (select p_brand as parent, count(distinct p_type) as children, count(distinct case when p_size > 40 then p_type end) as verified from part group by 1) select parent, children, children - verified as open from s where children > 1""")
def split_parents(spark, d):
    each = table(spark, d, "part").groupBy(F.col("p_brand").alias("parent"), "p_type").agg(F.bool_or(F.col("p_size") > 40).alias("ok"))
    return each.groupBy("parent").agg(F.count("*").alias("children"), F.count_if(~F.col("ok")).alias("open")).filter("children > 1").select("parent", "children", "open")


@query("""with s as (select user_id, list(distinct event_type) as have from events group by 1) select user_id, array_to_string(list_filter(['signup', 'view', 'click', 'purchase', 'error'], lambda x: list_contains(have, x)), ',') as statuses from s""")
def statuses_in_order(spark, d):
    have = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    order = _literals(["signup", "view", "click", "purchase", "error"])
    return have.select("user_id", F.array_join(F.array_intersect(order, "have"), ",").alias("statuses"))


@query("""select p_partkey, metric, value, status from (select p_partkey, unnest(['size', 'price', 'name']) as metric, unnest([p_size::varchar, case when p_retailprice < 950 then null else round(p_retailprice * 100)::bigint::varchar end, '*']) as v from part),
lateral (select case when v is null then 'blank' when v = '*' then 'not_disclosed' else 'observed' end as status, case when v != '*' then v::double end as value)""")
def arrays_to_long(spark, d):
    """Aligned arrays of 3 metrics per part, with a dictionary of metrics, as one row per part and metric."""
    cells = F.array(F.col("p_size").cast("string"), F.when(F.col("p_retailprice") >= 950, F.round(F.col("p_retailprice") * 100).cast("long").cast("string")), F.lit("*"))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(cells).alias("at", "cell"))
    return rows.select("p_partkey", F.get(_literals(["size", "price", "name"]), F.col("at")).alias("metric"), codes.observed(F.col("cell")).alias("value"), codes.cell_status(F.col("cell")).alias("status"))


@query("""select p_partkey, p_name, p_brand from part where contains(lower(p_name), 'wid') or contains(lower(p_brand), 'wid') or contains(lower(p_type), 'wid') order by p_name, p_partkey limit 20""")
def search_first_20(spark, d):
    hit = lambda c: F.contains(F.lower(c), F.lit("wid"))
    return table(spark, d, "part").filter(hit("p_name") | hit("p_brand") | hit("p_type")).orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name", "p_brand")


# Flows by group.


def _ranked_edges(spark, d) -> DataFrame:
    rows = flows.shares(_edges(spark, d), "origin", "partner")
    rank = F.row_number().over(Window.partitionBy("origin").orderBy(F.col("n").desc(), "partner"))
    return rows.select("origin", "partner", F.col("share").alias("rate"), rank.alias("rank"), F.when(F.col("n") % 11 == 0, "error").otherwise("observed").alias("status"))


EDGES_SQL = f"""{FLOWS_SQL}, t as (select *, sum(n) over (partition by origin) as total from flows),
edges as (select origin, partner, floor(n / total * 1e6 + 0.5) / 1e6 as rate, row_number() over (partition by origin order by n desc, partner)::int as rank, case when n % 11 = 0 then 'error' else 'observed' end as status from t)"""


@query(f"""with {EDGES_SQL} select n_nationkey as origin, max(case when status != 'error' and partner = origin then rate end) as self_rate, max(case when status != 'error' and partner = origin then rank end) as self_rank,
  count(case when status != 'error' and partner != origin then 1 end)::int as partners, count(case when status = 'error' then 1 end) as value_error_count from nation left join edges on origin = n_nationkey group by 1""")
def flow_groups_complete(spark, d):
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("origin"))
    rows = flows.every_group(groups, _ranked_edges(spark, d), ["origin"], "partner", "rate", "origin", "status")
    return rows.withColumn("partners", F.size("partners"))


@query(f"""with {EDGES_SQL} select origin, row_number() over (partition by origin order by rank)::int as rank, partner, rate from edges""")
def flow_self_reinserted(spark, d):
    """The self row leaves the group's partners and returns at its rank."""
    edges = _ranked_edges(spark, d).withColumn("status", F.lit("observed"))
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("origin"))
    return flows.with_self(flows.every_group(groups, edges, ["origin"], "partner", "rate", "origin", "status"), "origin")


@query(f"""with {EDGES_SQL}, p as (select origin, partner, rank, case when partner % 6 = 0 then rate * 3 else rate end as rate from edges)
select 'rising' as rule, origin, rank from (select *, lag(rate) over (partition by origin order by rank) as previous from p) where rate > previous + 1e-9 union all select 'overfull', origin, null from p group by origin having sum(rate) > 1 + 1e-9""")
def flow_violations(spark, d):
    edges = _ranked_edges(spark, d).withColumn("rate", F.when(F.col("partner") % 6 == 0, F.col("rate") * 3).otherwise(F.col("rate")))
    up = flows.rising(edges, ["origin"], "rate").select(F.lit("rising").alias("rule"), "origin", "rank")
    return up.union(flows.overfull(edges, ["origin"], "rate").select(F.lit("overfull"), "origin", F.lit(None).cast("int")))


# Quality rules.


@query("""select * from (values
  ('missing_cells', (select count(*) from (select n_nationkey, p from nation, (select distinct o_orderpriority as p from orders) except select c_nationkey, o_orderpriority from orders join customer on o_custkey = c_custkey where o_totalprice > 400000))),
  ('domain', (select count(*) from orders where o_orderstatus not in ('F', 'O'))),
  ('number', (select count(*) from orders where not isfinite(o_totalprice) or o_totalprice <= 0 or o_totalprice is null)),
  ('code', (select count(*) from orders where not regexp_full_match(o_orderkey::varchar, '[0-9]{4}'))),
  ('pair', (select count(*) from orders where (o_orderstatus = 'P') != (o_totalprice > 250000))),
  ('cardinality', (select case when count(*) = 25 then 0 else 1 end from orders)),
  ('tolerance', (select count(*) from orders where abs(o_totalprice - round(o_totalprice)) > abs(round(o_totalprice)) * 1e-6))) t(rule, violations)""")
def assertion_checklist(spark, d):
    """Rules on orders as one report; each counts the rows that break it."""
    o = _placed_orders(spark, d).withColumn("code", F.col("o_orderkey").cast("string")).withColumn("rounded", F.round("o_totalprice"))
    priorities = table(spark, d, "orders").select("o_orderpriority").distinct()
    grid = relational.complete_grid(priorities, [table(spark, d, "nation").select("n_nationkey"), priorities], ["o_orderpriority"])
    missing = quality.missing_cells(grid, ["n_nationkey", "o_orderpriority"])
    rules = [
        quality.Check("missing_cells", lambda rows: missing(rows.filter("o_totalprice > 400000"))),
        quality.Check("domain", quality.off_domain("o_orderstatus", ["F", "O"])),
        quality.Check("number", quality.not_number("o_totalprice", "positive")),
        quality.Check("code", quality.bad_code("code", 4)),
        quality.Check("pair", quality.one_without_other(F.col("o_orderstatus") == "P", F.col("o_totalprice") > 250000)),
        quality.Check("cardinality", quality.unexpected_count(25)),
        quality.Check("tolerance", quality.off_tolerance("o_totalprice", "rounded", 1e-6)),
    ]
    return quality.report(o, rules).select(F.col("check").alias("rule"), "violations")


@query("""select n_nationkey, 'n_name' as "column", n_name as mine, upper(n_name) as theirs from nation where n_nationkey % 4 = 1 and n_name != upper(n_name) union all select n_nationkey, 'n_name', n_name, null from nation where n_nationkey % 4 = 0 union all select n_nationkey, 'n_regionkey', n_regionkey::varchar, (n_regionkey + 1)::varchar from nation where n_nationkey % 5 = 0""")
def attribute_disagreements(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, None).when(k % 4 == 1, F.upper("n_name")).otherwise(F.col("n_name"))
    other = n.select(k, name.alias("n_name"), F.when(k % 5 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    return quality.disagreements(other, "n_nationkey", ["n_name", "n_regionkey"])(n)


@query("""with t as (select 'customers' as s, c_nationkey as k from customer where c_acctbal > 9000 union select 'suppliers', s_nationkey from supplier where s_acctbal > 5000 union select 'nations', n_nationkey from nation)
select k as area, array_to_string(list_filter(['customers', 'nations', 'suppliers'], lambda x: not list_contains(list(distinct s), x)), ',') as absent_from from t group by 1 having count(distinct s) < 3""")
def n_way_set_differences(spark, d):
    s = {"nations": table(spark, d, "nation").select(F.col("n_nationkey").alias("area")), "customers": table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("area")), "suppliers": table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("area"))}
    return quality.set_differences(s, "area").withColumn("absent_from", F.array_join("absent_from", ","))


# Exports.


@query('''select p_partkey::varchar || ',' || case when p_partkey % 3 = 0 then '"' || p_name || ', ""' || p_brand || '"""' else p_name end || ',' || case when p_size > 10 then p_size::varchar else '' end as line from part''')
def csv_export_lines(spark, d):
    note = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    return exports.csv_lines(table(spark, d, "part").select("p_partkey", note.alias("note"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")), ["p_partkey", "note", "p_size"])


@query("""select n_nationkey, to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: case when n_nationkey % 3 > 0 then n_regionkey end})::varchar as line from nation""")
def json_export_lines(spark, d):
    return exports.json_lines(table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("n_regionkey")), "n_nationkey")


@query("""with f as (select 'part' || p_size::varchar as file, p_brand as source from part where p_size > 5 union select 'part' || p_size::varchar, 'derived::part' || p_size::varchar from part where p_size <= 5)
select source, string_agg(file, ',' order by file) as files from f group by 1""")
def exports_by_source(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("part"), F.col("p_size").cast("string")).alias("file"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("source"))
    files = p.groupBy("file").agg(F.collect_set("source").alias("sources"))
    return exports.by_source(files).withColumn("files", F.array_join("files", ","))


@query("""select n_nationkey as id from nation where n_nationkey % 3 != 1""")
def issues_for_vintage(spark, d):
    k = F.col("n_nationkey")
    scope = F.when(k % 3 == 0, F.create_map(F.lit("published_fy"), F.lit("R7"))).when(k % 3 == 1, F.create_map(F.lit("published_fy"), F.lit("R6"))).otherwise(F.create_map(F.lit("csv"), F.lit("beds")))
    return exports.issues_for(table(spark, d, "nation").select(k.alias("id"), scope.alias("scope")), "published_fy", "R7", "R7").select("id")
