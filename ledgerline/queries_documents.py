"""Queries of documents, shapes, provenance, headers and region tables. Registered like those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.functions import codes, geo, measures
from ledgerline.operators import flows, linkage, provenance, quality, relational, spatial
from ledgerline.plans import documents, exports, lineage, texts, writing
from ledgerline.queries import FLOWS_SQL, PIP, POINTS_SQL, POLYGONS_SQL, _edges, _placed_orders, _points, query
from ledgerline.sources import blocks, documents_of, layout, sheets, zips
from ledgerline.sources.tables import table

# Tables of regions by metric family.

BY_REGION = "select r_name as region, o_orderpriority as bed_function, count(case when year(o_orderdate) = 1996 then 1 end) as a, count(case when year(o_orderdate) = 1995 then 1 end) as b from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2"
RATIO = "floor(a / nullif(b, 0) * 1e4 + 0.5) / 1e4"


def _two_years(spark, d, a: str, b: str):
    rows = _placed_orders(spark, d).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("bed_function"))
    return rows.agg(F.count_if(F.year("o_orderdate") == 1996).alias(a), F.count_if(F.year("o_orderdate") == 1995).alias(b))


@query(f"with t as ({BY_REGION}) select region, bed_function, a as value, b as base, {RATIO} as ratio from t")
def region_demand_table(spark, d):
    return documents.table_of("demand", _two_years(spark, d, "value", "base"), ["region", "bed_function"], measures.ratio)


@query(f"with t as ({BY_REGION}) select region, bed_function, b as old, a as new, a - b as difference, {RATIO} as ratio from t")
def region_change_table(spark, d):
    return documents.table_of("change", _two_years(spark, d, "new", "old"), ["region", "bed_function"], measures.ratio)


@query(f"""with t as ({BY_REGION}) select 'change' as dataset, region, bed_function, unnest(['old', 'new', 'difference', 'ratio']) as measure, unnest([b::double, a::double, (a - b)::double, {RATIO}]) as value from t
union all select 'bed', region, bed_function, unnest(['actual', 'need', 'difference', 'ratio']), unnest([a::double, b::double, (a - b)::double, {RATIO}]) from t""")
def region_detail_long(spark, d):
    keys = ["region", "bed_function"]
    each = [documents.long_of(f, documents.table_of(f, _two_years(spark, d, a, b), keys, measures.ratio), keys) for f, a, b in (("change", "new", "old"), ("bed", "actual", "need"))]
    return each[0].union(each[1])


@query(f"""with t as ({BY_REGION}), m as (
select region, bed_function, unnest([('change', 'old', 'count', '1995', b::double, ''), ('change', 'new', 'count', '1996', a::double, ''), ('change', 'difference', 'count', '1995/1996', (a - b)::double, ''), ('change', 'ratio', 'ratio', '1995/1996', {RATIO}, case when b = 0 then 'denominator is 0' else '' end),
  ('demand', 'value', 'count', '1996', a::double, ''), ('demand', 'base', 'count', '1995', b::double, ''), ('demand', 'ratio', 'ratio', '1995/1996', {RATIO}, case when b = 0 then 'denominator is 0' else '' end)]) as x from t)
select region, bed_function, x[1] as dataset, x[2] as measure, x[3] as unit, x[4] as year, x[5] as value, x[6] as note from m""")
def region_details(spark, d):
    """Two families of measures at one grain, from one pass, with the unit, the year and a note in each row."""
    families = {"change": {"new": "n1996", "old": "n1995"}, "demand": {"value": "n1996", "base": "n1995"}}
    return documents.details(_two_years(spark, d, "n1996", "n1995"), ["region", "bed_function"], families, {"n1996": "1996", "n1995": "1995"}, measures.ratio, measures.ratio_note)


# Documents.

CUSTOMERS = "select n_nationkey as area_code, n_name as area_name, count(c_custkey) as customers from nation left join customer on c_nationkey = n_nationkey group by 1, 2"


def _customers(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy(F.col("n_nationkey").alias("area_code"), F.col("n_name").alias("area_name")).agg(F.count("c_custkey").alias("customers"))


@query(f"""with t as ({CUSTOMERS}) select 0 as part, null::int as area_code, '{{"metadata":{{"vintage":"1996"}},"areas":[' as line union all
select 1, area_code, case when area_code = (select min(area_code) from t) then '' else ',' end || '{{"area_code":' || area_code || ',"area_name":"' || area_name || '","customers":' || customers || '}}' from t union all select 2, null, ']}}'""")
def envelope_document(spark, d):
    return documents.envelope(_customers(spark, d), ["area_code"], {"vintage": "1996"}).select("part", "at.area_code", "line")


@query(f"""with t as ({CUSTOMERS}) select 1 as part, case when area_code = (select min(area_code) from t) then '' else ',' end || '{{"type":"Feature","properties":{{"area_code":' || area_code || ',"customers":' || customers || '}},"geometry":{{"type":"Point","coordinates":[' || (130 + area_code % 7)::double || ',' || (30 + area_code % 5)::double || ']}}}}' as line from t""")
def feature_document(spark, d):
    """Areas as points."""
    k = F.col("area_code")
    rows = documents.features(_customers(spark, d), ["area_code", "customers"], documents.point((130 + k % 7).cast("double"), (30 + k % 5).cast("double")))
    return documents.envelope(rows, ["properties"], {"type": "FeatureCollection"}, "features").filter("part = 1").select("part", "line")


SEGMENTS = "select c_nationkey as area_code, c_mktsegment as segment, count(*) as n from customer group by 1, 2"


def _segments(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("area_code"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query(f"""with t as ({SEGMENTS}) select area_code, segment, unnest([n, n + 1]) as n, unnest(['lost', 'made up']) as side from t where segment = 'BUILDING'""")
def regroup_check(spark, d):
    """A nested document in which one segment's counts are wrong."""
    rows = _segments(spark, d)
    wrong = rows.withColumn("n", F.col("n") + (F.col("segment") == "BUILDING").cast("int"))
    nested = wrong.groupBy("area_code").agg(F.collect_list(F.struct("segment", "n")).alias("segments"))
    return documents.regrouped_differences(rows, nested, ["area_code"], "segments")


@query(f"with t as ({SEGMENTS}) select area_code, sum(n)::bigint as customers, count(*)::int as segments_count from t group by 1")
def light_summary(spark, d):
    nested = _segments(spark, d).groupBy("area_code").agg(F.sum("n").alias("customers"), F.collect_list(F.struct("segment", "n")).alias("segments"))
    return documents.summary(nested, "segments")


@query("""with s as (select s_nationkey as area, s_suppkey, 130 + s_suppkey % 9 as lon, s_acctbal, case when s_acctbal < 0 then 'owes' end as note from supplier)
select area, '{"s_suppkey":"' || s_suppkey || '"' || case when note is not null then ',"note":"owes"' else '' end || '}' as properties, lon::double as lon from s""")
def point_features(spark, d):
    k = F.col("s_suppkey")
    item = F.struct("s_suppkey", (130 + k % 9).cast("double").alias("lon"), F.lit(35.0).alias("lat"), F.when(F.col("s_acctbal") < 0, "owes").alias("note"))
    nested = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.collect_list(item).alias("suppliers"))
    rows = documents.point_features(nested, ["area"], "suppliers", ["s_suppkey", "note"])
    return rows.select("area", F.to_json("properties").alias("properties"), F.get("geometry.coordinates", F.lit(0)).alias("lon"))


@query("""with t as (select o_orderpriority as priority, count(*) as n from orders group by 1), l as (select '| ' || priority || ' | ' || n || ' |' as line from t)
select 0 as section, 0 as at, '# Orders' || chr(10) || chr(10) || '## By priority' as line union all select 0, 1, '| priority | n |' union all select 0, 2, '|---|---|' union all select 0, 3, 'rows: ' || count(*) from t
union all select 0, (3 + row_number() over (order by line))::int, line from (select * from l order by line limit 3)""")
def report_lines(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return documents.report("Orders", {"By priority": counts}, examples=3)


@query("""select n_nationkey, 'table_' || replace(n_name, ' ', '-') || '_1996.csv' as file, case r_name when 'ASIA' then 1 when 'EUROPE' then 2 else 3 end::int as place from nation join region on n_regionkey = r_regionkey""")
def export_names(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", documents.file_name([F.lit("table"), F.col("n_name"), F.lit("1996")], "csv").alias("file"), documents.in_order(F.col("r_name"), ["ASIA", "EUROPE"]).alias("place"))


@query("""select p_partkey, case when starts_with(p_type, 'PROMO') then 'offer' when starts_with(p_type, 'STANDARD') then 'usual' else 'other' end as grp, case p_brand when 'Brand#11' then 'm1' when 'Brand#12' then 'm2' end as maker from part""")
def metric_groups(spark, d):
    keys = {"Brand#11": "m1", "Brand#12": "m2"}
    return table(spark, d, "part").select("p_partkey", codes.prefixed_group(F.col("p_type"), {"PROMO": "offer", "STANDARD": "usual"}, "other").alias("grp"), codes.recoded(F.col("p_brand"), keys).alias("maker"))


@query("""with g as (select p_partkey, case when starts_with(p_type, 'PROMO') then 'offer' when starts_with(p_type, 'STANDARD') then 'usual' else 'other' end as grp, p_size from part)
select grp, count(*) as n, string_agg(p_partkey::varchar, ',' order by p_partkey) as parts from g group by 1""")
def metrics_by_group(spark, d):
    """Groups that have no metric don't appear; the others keep their metrics' order."""
    rows = metric_groups(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("_parts"))
    return rows.select("grp", "n", F.array_join(F.col("_parts").cast("array<string>"), ",").alias("parts"))


# Shapes.


def _feature_table(spark):
    """The fixture polygons as GeoJSON: one of them in a MultiPolygon."""
    rows = [
        (1, '{"type":"Polygon","coordinates":[[[130.2,30.2],[133.3,30.4],[133.1,35.7],[130.1,35.2],[130.2,30.2]],[[131.2,32.2],[132.2,32.2],[132.2,33.2],[131.2,33.2],[131.2,32.2]]]}'),
        (2, '{"type":"MultiPolygon","coordinates":[[[[134.2,33.1],[136.9,34.3],[135.4,38.9],[134.2,33.1]]]]}'),
    ]
    return spatial.polygons(spark.createDataFrame(rows, "area int, geometry string"), ["area"])


@query("with " + POLYGONS_SQL + ", " + POINTS_SQL + ", i as (select p_partkey, min(area) as area from points join polygons on " + PIP.format(r="shell") + " and (hole is null or not (" + PIP.format(r="hole") + ")) group by 1) select p.p_partkey, area from points p left join i using (p_partkey)")
def register_points(spark, d):
    """A point register with the area that each point lies in."""
    points = _points(spark, d).withColumn("kind", F.lit("part"))
    return spatial.registered_points(points, _feature_table(spark), "p_partkey", "area", "kind", ["dental"], F.lit("-")).select("p_partkey", "area")


def _ring(x: str, y: str, side: str, closed: bool = True) -> str:
    """SQL of the text of a square ring."""
    corners = [(x, y), (f"{x} + {side}", y), (f"{x} + {side}", f"{y} + {side}"), (x, f"{y} + {side}"), *[(x, y)] * closed]
    return "concat('[', " + ", ',', ".join(f"'[', string({a}), ',', string({b}), ']'" for a, b in corners) + ", ']')"


def _supplier_features(spark, d):
    """A GeoJSON feature for each supplier, by its key: missing, of another kind, unreadable, too short, open, empty, with an open hole, of two parts, with a hole."""
    x, y, side = "(128 + s_suppkey % 64 * 0.25D)", "(32 + s_suppkey div 64 % 8 * 2.0D)", "(0.25D * (1 + s_suppkey % 3))"
    hole = lambda closed: _ring(f"({x} + {side} / 4)", f"({y} + {side} / 4)", f"({side} / 4)", closed)
    polygon = lambda *rings: "concat('{\"type\":\"Polygon\",\"coordinates\":[', " + ", ',', ".join(rings) + ", ']}')"
    cases = [
        "cast(null as string)", f"concat('{{\"type\":\"Point\",\"coordinates\":[', string({x}), ',', string({y}), ']}}')", "'{\"type\":\"Polygon\"'",
        polygon(f"concat('[[', string({x}), ',', string({y}), '],[', string({x} + {side}), ',', string({y}), '],[', string({x}), ',', string({y}), ']]')"),
        polygon(_ring(x, y, side, False)), "'{\"type\":\"Polygon\",\"coordinates\":[]}'", polygon(_ring(x, y, side), hole(False)),
        f"concat('{{\"type\":\"MultiPolygon\",\"coordinates\":[[', {_ring(x, y, side)}, '],[', {_ring(x, f'({y} + 1)', side)}, ']]}}')", polygon(_ring(x, y, side), hole(True)),
    ]
    by_key = "case s_suppkey % 9 " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + " end"
    made = table(spark, d, "supplier").select(F.col("s_suppkey").alias("area"), F.col("s_nationkey").alias("region"), F.expr(by_key).alias("geometry"))
    return lineage.cut(made, "features")  # else the long expression stands in the code of each check


def _supplier_areas(spark, d, keys):
    """Areas of the features without a problem."""
    features = _supplier_features(spark, d)
    sound = features.join(spatial.shape_errors(features, ["area"]).select("area").distinct(), "area", "left_anti")
    return spatial.area_km2(spatial.polygons(sound, keys), keys, F.lit(35.0))


AREAS_SQL = """areas as (select s_suppkey as area, s_nationkey as region, 0.25::double * (1 + s_suppkey % 3) as side, (case s_suppkey % 9 when 7 then 2 * side * side else side * side - side / 4 * side / 4 end) * 111.32 * 111.32 * cos(radians(35.0)) as km2
from supplier where s_suppkey % 9 in (7, 8))"""


@query("""select s_suppkey as area, case when s_suppkey % 9 in (3, 4, 6) then 0 end::int as part,
  ['missing', 'no polygon', 'unreadable', 'too few points', 'not closed', 'empty', 'not closed'][(s_suppkey % 9 + 1)::int] as problem from supplier where s_suppkey % 9 < 7""")
def shape_problems(spark, d):
    """Missing, foreign and broken shapes among the suppliers' features."""
    found = spatial.shape_errors(_supplier_features(spark, d), ["area"])
    return found.withColumn("part", F.when(F.col("problem") != "empty", F.col("part")))


@query("""select s_suppkey as area, case s_suppkey % 10 when 3 then 'missing' when 4 then 'repeated' end as side from supplier where s_suppkey % 10 in (3, 4) union all select -s_suppkey, 'beyond' from supplier where s_suppkey % 10 = 5""")
def feature_set(spark, d):
    """Features against the areas that there should be: some left out, some twice, some of no area."""
    all_ = _supplier_features(spark, d)
    features = all_.filter("area % 10 != 3").union(all_.filter("area % 10 = 4")).union(all_.filter("area % 10 = 5").withColumn("area", -F.col("area")))
    return spatial.feature_set_errors(features, all_, ["area"])


@query(f"with {AREAS_SQL} select area, floor(km2 * 100 + 0.5) / 100 as km2 from areas")
def polygon_area(spark, d):
    return _supplier_areas(spark, d, ["area"]).select("area", measures.half_up(F.col("km2"), 2).alias("km2"))


@query(f"""with {AREAS_SQL}, c as (select area, km2, case area % 2 when 1 then km2 * 1.0001 else km2 * 1.05 end as after from areas)
select area, floor(km2 * 100 + 0.5) / 100 as before, floor(after * 100 + 0.5) / 100 as after from c where area % 2 = 0 union all select null, floor(sum(km2) * 100 + 0.5) / 100, floor(sum(after) * 100 + 0.5) / 100 from c""")
def area_conservation(spark, d):
    """Areas after a change of shapes, half of them within and half beyond the tolerance."""
    before = _supplier_areas(spark, d, ["area"])
    after = before.withColumn("km2", F.col("km2") * F.when(F.col("area") % 2 == 1, 1.0001).otherwise(1.05))
    found = spatial.area_changes(before, after, "area", 0.01)
    return found.select("area", measures.half_up(F.col("before"), 2).alias("before"), measures.half_up(F.col("after"), 2).alias("after"))


@query("""select 'supplier' as kind, count(*) as n, count(case when s_acctbal > 0 then 1 end) as usable from supplier union all select 'customer', count(*), count(case when c_acctbal > 0 then 1 end) from customer""")
def register_kinds(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")), table(spark, d, "customer").select(F.col("c_acctbal").alias("v"), "c_name")
    return spatial.kinds({"supplier": s, "customer": c}, F.col("v") > 0)


# Provenance: orders as what datasets state about themselves.


def _facts(spark, d, dataset: str):
    caveat = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("large in "), F.year("o_orderdate").cast("string")))
    vintage = F.when(F.year("o_orderdate") != 1992, F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select(F.col(dataset).cast("string").alias("dataset"), vintage.alias("label"), F.col("o_orderstatus").alias("source"), caveat.alias("caveat")).distinct()


FACTS_SQL = "facts as (select distinct {dataset}::varchar as dataset, case when year(o_orderdate) != 1992 then year(o_orderdate)::varchar end as label, o_orderstatus as source, case when o_totalprice > 300000 then 'large in ' || year(o_orderdate) end as caveat from orders)"


@query(f"""with {FACTS_SQL.format(dataset='o_orderpriority')}, lineage as (select distinct c_mktsegment || '.json' as output, o_orderpriority as dataset from orders join customer on o_custkey = c_custkey where c_custkey % 7 = 0 union select r_name || '.json', 'absent' from region)
select output, coalesce(string_agg(distinct source, ',' order by source), '') as sources, coalesce(string_agg(distinct caveat, ',' order by caveat), '') as caveats from lineage left join facts using (dataset) group by 1""")
def provenance_carried(spark, d):
    """Outputs by segment, made from orders by priority, and outputs of an input that states nothing."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 7 = 0")
    lineage = o.join(c, o.o_custkey == c.c_custkey).select(F.concat("c_mktsegment", F.lit(".json")).alias("output"), F.col("o_orderpriority").alias("dataset")).distinct()
    lineage = lineage.union(table(spark, d, "region").select(F.concat("r_name", F.lit(".json")), F.lit("absent")))
    found = provenance.carried(_facts(spark, d, "o_orderpriority"), lineage)
    return found.select("output", F.array_join("sources", ",").alias("sources"), F.array_join("caveats", ",").alias("caveats"))


@query(f"""with {FACTS_SQL.format(dataset='o_custkey')}, said as (select dataset, 'source' as "column", source as value from facts union all select dataset, 'caveat', caveat from facts where caveat is not null)
select dataset, "column", string_agg(distinct value, ',' order by value) as said from said group by 1, 2 having count(distinct value) > 1""")
def provenance_disagreeing(spark, d):
    return provenance.disagreeing(_facts(spark, d, "o_custkey"), "dataset", ["source", "caveat"]).select("dataset", "column", F.array_join("values", ",").alias("said"))


@query(f"with {FACTS_SQL.format(dataset='o_custkey')} select dataset, source, caveat from facts f where label = '1996' or (label is null and not exists (select 1 from facts g where g.dataset = f.dataset and g.label = '1996'))")
def provenance_of_vintage(spark, d):
    return provenance.source_of(_facts(spark, d, "o_custkey"), "1996").select("dataset", "source", "caveat")


@query("select 'orders' as relation, v::varchar as vintage from (values (1995), (1996), (2050)) t(v) where v not in (select distinct year(o_orderdate) from orders)")
def missing_vintages(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return provenance.missing_vintages(rows, "year", [1995, 1996, 2050], "orders")


@query("""select 'dict ' || n_regionkey as name, n_name as label, n_nationkey::varchar as value from nation union all select 'list ' || n_regionkey, n_name, case when n_nationkey % 4 > 0 then n_nationkey::varchar end from nation""")
def source_entries(spark, d):
    """Sources as a JSON object, and as a list of objects of which some state none, by region."""
    n = table(spark, d, "nation").withColumn("v", F.col("n_nationkey").cast("string"))
    both = n.groupBy("n_regionkey").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "v")))).alias("dict"),
        F.to_json(F.collect_list(F.struct(F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 4 > 0, F.col("v")).alias("source")))).alias("list"),
    )
    each = F.array(*[F.struct(F.concat(F.lit(f"{k} "), F.col("n_regionkey").cast("string")).alias("name"), F.col(k).alias("j")) for k in ("dict", "list")])
    return both.select(F.inline(each)).select("name", F.inline(provenance.entries(F.col("j"))))


# Headers and bands of sheets that are generated as cells.


@query("""select n_regionkey::varchar as sheet, c as col, l as labels, p as problem from (select distinct n_regionkey from nation), (values (1, 'a/x', 'elsewhere'), (2, 'a/y', 'elsewhere'), (3, 'b/x', 'missing'), (5, 'c/z', 'unexpected')) t(c, l, p) where n_regionkey = 0""")
def header_catalogue(spark, d):
    """Sheets whose headers follow the catalogue, but for one with two columns changed over, one missing and one unknown."""
    expected = blocks.expected_columns(spark, [["a", "b"], ["x", "y"]], 1)
    sheets = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("sheet")).distinct()
    right = sheets.filter("sheet != '0'").join(expected)
    wrong = sheets.filter("sheet = '0'").join(spark.createDataFrame([(1, ["a", "y"]), (2, ["a", "x"]), (4, ["b", "y"]), (5, ["c", "z"])], "col int, labels array<string>"))
    found = blocks.resolved(right.union(wrong).select("sheet", "col", "labels"), expected)
    # Both changed columns are told of by where they stand.
    return found.select("sheet", F.col("col"), F.when(F.col("problem") == "elsewhere", F.when(F.col("col") == 1, "a/x").otherwise("a/y")).otherwise(F.array_join("labels", "/")).alias("labels"), "problem")


@query("""select n_nationkey::varchar as sheet, case when n_nationkey = 5 then 4 else 5 end::bigint as columns from nation where n_nationkey in (5, 6)""")
def sheet_signatures(spark, d):
    """One sheet lacks a column, another has one with another label."""
    last = F.when(F.col("n_nationkey") == 5, 3).otherwise(4)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("sheet"), F.explode(F.sequence(F.lit(0), last)).alias("col"))
    rows = rows.withColumn("label", F.when((F.col("sheet") == "6") & (F.col("col") == 2), "other").otherwise(F.concat(F.lit("c"), F.col("col").cast("string"))))
    return blocks.signature_outliers(rows)


@query("""with t as (select c_nationkey as area, count(*) as n, count(case when c_acctbal > 0 then 1 end) as pos, count(case when c_mktsegment = 'BUILDING' then 1 end) as b from customer group by 1)
select area::int as "row", 'segment' as band, n::double as total, (n - b)::double as parts from t where b != 0""")
def banded_totals(spark, d):
    """Two bands of a sheet, total first: the parts of one add up, those of the other leave a segment out."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("row")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("pos"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b"))
    cell = lambda col, v: F.struct(F.lit("s").alias("sheet"), F.col("row").cast("int").alias("row"), F.lit(col).alias("col"), v.cast("string").alias("value"))
    n, pos, b = F.col("n"), F.col("pos"), F.col("b")
    cells = rows.select(F.inline(F.array(cell(0, F.col("row")), cell(1, n), cell(2, pos), cell(3, n - pos), cell(4, n), cell(5, n - b), cell(6, F.lit(0)))))
    return blocks.band_totals(blocks.banded(cells, {"balance": (1, 3), "segment": (4, 6)}), 0).select("row", "band", "total", "parts")


# Flows and counts.


@query(f"""with {FLOWS_SQL}, o as (select origin, count(case when partner != origin then 1 end) as out_n, max(case when partner = origin then n end) as self_n from flows group by 1), i as (select partner, count(case when partner != origin then 1 end) as in_n from flows group by 1)
select n_nationkey as area, case when in_n is not null and out_n is not null and self_n is not null then in_n end as inflow, (in_n is not null or out_n is not null or self_n is not null) and not (in_n is not null and out_n is not null and self_n is not null) as uneven
from nation left join o on origin = n_nationkey left join i on partner = n_nationkey""")
def flow_rate_triples(spark, d):
    edges = flows.shares(_edges(spark, d), "origin", "partner")
    other = F.col("partner") != F.col("origin")
    out = edges.groupBy(F.col("origin").alias("area")).agg(F.count_if(other).alias("out_n"), F.max(F.when(~other, F.col("n"))).alias("self_n"))
    into = edges.groupBy(F.col("partner").alias("area")).agg(F.count_if(other).alias("in_n"))
    areas = table(spark, d, "nation").select(F.col("n_nationkey").alias("area")).join(out, "area", "left").join(into, "area", "left")
    return flows.rate_triples(areas, ["area"], "in_n", "out_n", "self_n").select("area", "rates.inflow", "uneven")


@query(f"with {FLOWS_SQL} select n_nationkey as place, n as rate, case when n_nationkey = 3 then 'self' when n is null then 'unlisted' when n = 0 then 'zero' else 'listed' end as status from nation left join flows on origin = 3 and partner = n_nationkey")
def flow_listing(spark, d):
    edges = flows.shares(_edges(spark, d), "origin", "partner")
    return flows.listed(table(spark, d, "nation").select(F.col("n_nationkey").alias("place")), edges, "origin", "partner", "n", 3)


@query("""with s as (select o_custkey, count(*) + case when o_custkey % 10 = 0 then 1 else 0 end as stated, count(*) as found from orders group by 1) select o_custkey, stated, found from s where stated != found""")
def soft_counts(spark, d):
    o = table(spark, d, "orders")
    stated = o.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + (F.col("o_custkey") % 10 == 0).cast("int"))
    return quality.count_gaps(stated, o, "o_custkey", "n")


@query("""select * from (values ('nation', null::bigint, (select count(*) from nation)), ('region', 6, (select count(*) from region))) t(name, expected, n) where expected is distinct from n""")
def pinned_counts(spark, d):
    counts = table(spark, d, "nation").agg(F.lit("nation").alias("name"), F.count("*").alias("n")).union(table(spark, d, "region").agg(F.lit("region"), F.count("*")))
    return quality.unexpected_counts(counts, spark.createDataFrame([("region", 6)], "name string, expected long"))


@query("""select o_orderkey, o_totalprice from orders where o_totalprice > 300000 order by o_totalprice desc, o_orderkey limit 10""")
def first_offenders(spark, d):
    rule = quality.outside("o_totalprice", 0, 300000)
    return quality.examples(rule(table(spark, d, "orders")), [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("""select 'area_code,area_name,customers' as line union all select area_code || ',' || area_name || ',' || customers from (""" + CUSTOMERS + ")")
def csv_with_header(spark, d):
    rows = _customers(spark, d)
    return spark.createDataFrame([(",".join(rows.columns),)], "line string").union(exports.csv_lines(rows, rows.columns))


@query("""with r as (select c_nationkey as area, floor(count(case when o_orderstatus = 'F' then 1 end) / count(*)::double * 1e6 + 0.5) / 1e6 as rate from orders join customer on o_custkey = c_custkey group by 1)
select 'lowest' as place, area, rate from (select * from r order by rate, area limit 1) union all select 'highest', area, rate from (select * from r order by rate desc, area limit 1)""")
def success_extremes(spark, d):
    """The areas with the smallest and the largest share of closed orders."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "area")
    return relational.rate_extremes(rows, "area", F.col("o_orderstatus") == "F")


@query("""with p as (select distinct p_name, p_brand from part) select p_name, p_brand from p where p_name in (select p_name from p group by 1 having count(*) > 1)
except select p_name, p_brand from part where p_size > 25""")
def residual_splits(spark, d):
    """Names that several brands have, without the pairs that a large part confirms."""
    rows = table(spark, d, "part")
    return relational.residual_splits(rows, "p_name", "p_brand", rows.filter("p_size > 25"))


# Documents of unknown shape, and rules that are checked while a table is written.


def _documents(spark, d):
    """Event properties as documents: some broken, some lists, some with another type of value."""
    broken = F.when(F.col("event_id") % 50 == 0, F.lit('{"k": ')).when(F.col("event_id") % 41 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 17 == 0, F.regexp_replace("props", "([0-9]+)", '"x$1"'))
    return table(spark, d, "events").select("event_id", "event_type", F.coalesce(broken, F.col("props")).alias("props"))


@query("""with e as (select event_type, event_id % 50 = 0 as broken, event_id % 50 != 0 and event_id % 41 = 0 as listed, event_id % 50 != 0 and event_id % 41 != 0 and event_id % 17 = 0 as worded, json_extract_string(props, '$.k')::bigint as k from events)
select event_type, count(*) as n, count(case when broken then 1 end) as unreadable, count(case when worded then 1 end) as mistyped, count(case when listed then 1 end) as absent, sum(case when not broken and not listed and not worded then k end)::bigint as total from e group by 1""")
def variant_fields(spark, d):
    """A field of documents without a schema: its sum where it is a number, and how often it is absent, of another type, or the document can't be read."""
    rows = documents_of.with_fields(documents_of.parsed(_documents(spark, d), "props"), {"k": ("$.k", "long")})
    said = F.col("problems")["k"]
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if("unreadable").alias("unreadable"), F.count_if(said == "mistyped").alias("mistyped"), F.count_if(said == "absent").alias("absent"), F.sum("k").alias("total")
    )


@query("""select '$' as path, 'array' as kind, count(*) as n from events where event_id % 50 != 0 and event_id % 41 = 0 union all select '$', 'object', count(*) from events where event_id % 50 != 0 and event_id % 41 != 0
union all select '$[*]', 'object', count(*) from events where event_id % 50 != 0 and event_id % 41 = 0 union all select '$[*].k', 'bigint', count(*) from events where event_id % 50 != 0 and event_id % 41 = 0
union all select '$.k', 'string', count(*) from events where event_id % 50 != 0 and event_id % 41 != 0 and event_id % 17 = 0 union all select '$.k', 'bigint', count(*) from events where event_id % 50 != 0 and event_id % 41 != 0 and event_id % 17 != 0""")
def variant_shapes(spark, d):
    """The paths that documents without a schema have, the kinds of value there, and how many."""
    return documents_of.shapes(documents_of.parsed(_documents(spark, d), "props"), 3).filter("n > 0")


@query("""select 'quantity' as "check", count(case when not coalesce(l_quantity between 1 and 40, false) then 1 end) as violations, count(case when not coalesce(l_quantity between 1 and 40, false) then 1 end) = 0 as passed, false as fatal from lineitem
union all select 'flag', 0, true, true union all select 'orders', count(*), count(*) = 0, true from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'unique', count(*), count(*) = 0, false from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'discount', count(case when l_discount > 0.05 then 1 end), count(case when l_discount > 0.05 then 1 end) = 0, false from lineitem""")
def checked_write(spark, d):
    """Line items written with their rules checked on the way: three that are only told of, two that would undo the write."""
    checks = [
        quality.Check("quantity", quality.outside("l_quantity", 1, 40), fatal=False), quality.Check("flag", quality.off_domain("l_returnflag", ["A", "N", "R"])),
        quality.Check("discount", quality.RowRule(F.col("l_discount") > 0.05), fatal=False), quality.Check("unique", quality.duplicates(["l_orderkey", "l_linenumber"]), fatal=False),
        quality.Check("orders", quality.orphans(table(spark, d, "orders"), "l_orderkey", "o_orderkey")),
    ]
    return writing.write_checked(table(spark, d, "lineitem"), f"{lineage.shared_dir(spark)}/lineitem-{uuid.uuid4().hex}", checks)


# Archives and texts that are written in the shared folder and read back.


def _shared_file(spark, name: str) -> str:
    return f"{texts.mounted(lineage.shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


def _customer_archive(spark, d) -> str:
    """A ZIP with a file of customers for each segment."""
    path = _shared_file(spark, "customers") + ".zip"
    rows = table(spark, d, "customer").withColumn("file", F.concat("c_mktsegment", F.lit(".csv")))
    texts.write_archive(rows, path, "file", ["c_custkey"], texts.lines_of(rows, ["c_custkey", "c_name", "c_nationkey"], exports.csv_field))
    return path


ARCHIVE_SQL = "files as (select c_mktsegment || '.csv' as name, string_agg(c_custkey || ',' || c_name || ',' || c_nationkey || chr(13) || chr(10), '' order by c_custkey) as text from customer group by 1)"


@query(f"with {ARCHIVE_SQL} select name, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from files")
def archive_manifest(spark, d):
    """The members of an archive as they are read back."""
    return zips.members(spark, _customer_archive(spark, d)).select(F.col("member").alias("name"), "bytes", "sha256")


@query("""select distinct case when c_mktsegment = 'BUILDING' then 'BUILDING.csv' else 'README.txt' end as name, case when c_mktsegment = 'BUILDING' then 'declared' else 'found' end as absent_from from customer""")
def manifest_gaps(spark, d):
    """The members that an archive holds against a declared list with one name too many and one too few."""
    name = F.concat("c_mktsegment", F.lit(".csv"))
    declared = table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "README.txt").otherwise(name).alias("name")).distinct()
    found = zips.members(spark, _customer_archive(spark, d)).select(F.col("member").alias("name"))
    return quality.set_differences({"declared": declared, "found": found}, "name").select("name", F.array_join("absent_from", ",").alias("absent_from"))


@query("""select p_partkey::varchar as key, p_name as name, row_number() over (partition by p_brand order by p_partkey desc) as "row", p_brand || '.csv' as member from part""")
def zipped_tables(spark, d):
    """The rows of an archive with a table for each brand, read back a task for each member; a member's rows are numbered in its own order."""
    path = _shared_file(spark, "brands") + ".zip"
    rows = table(spark, d, "part").withColumn("file", F.concat("p_brand", F.lit(".csv"))).select("file", F.lit(1).alias("at"), "p_partkey", F.concat_ws(",", "p_partkey", exports.csv_field(F.col("p_name"))).alias("text"))
    headed = rows.union(rows.select("file").distinct().select("file", F.lit(0), F.lit(0).cast("long"), F.lit("key,name")))
    texts.write_archive(headed.withColumn("back", -F.col("p_partkey")), path, "file", ["at", "back"], F.col("text"))
    return zips.zipped_csv(spark, path, ["key", "name"], several=True).select("key", "name", "row", "member")


@query("""select '# source: orders' as line, count(*)::bigint as rows from orders union all select 'key,status,price', count(*) from orders union all select o_orderkey || ',' || o_orderstatus || ',' || floor(o_totalprice)::bigint, (select count(*) from orders) from orders""")
def csv_text(spark, d):
    """One file of all orders, with what was counted while it was written."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("price"))
    path = _shared_file(spark, "orders") + ".csv"
    counts = exports.write_csv_text(rows, path, rows.columns, {"source": "orders"}, ["key"])
    return spark.read.option("lineSep", "\r\n").text(f"file://{path}").select(F.ltrim(F.col("value"), F.lit("\ufeff")).alias("line"), F.lit(counts["rows"]).cast("long").alias("rows"))


# Whole texts, orders, registers and sheets.


@query(f"""select 0 as part, 0 as at, chr(65279) || '# source: survey of 1996' as line union all select 0, 1, 'area_code,area_name,customers'
union all select 1, null, area_code || ',' || area_name || ',' || customers from ({CUSTOMERS})""")
def csv_document(spark, d):
    rows = _customers(spark, d)
    return exports.csv_document(rows, rows.columns, {"source": "survey\nof 1996"}, ["area_code"]).select("part", "at", "line")


@query("""select p_partkey from part where len(string_split(p_name, ' ')) is distinct from 2""")
def ragged_rows(spark, d):
    """Names that are not two words."""
    return quality.ragged("cells", 2)(table(spark, d, "part").withColumn("cells", F.split("p_name", " "))).select("p_partkey")


@query("""with f as (select r_name as source, n_name || '.csv' as file from nation join region on n_regionkey = r_regionkey)
select distinct source, 0 as at, '## ' || source as line from f union all select source, row_number() over (partition by source order by file)::int, '- ' || file from f""")
def bundle_text(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return documents.bundle_text(exports.by_source(rows.select(F.concat("n_name", F.lit(".csv")).alias("file"), F.array("r_name").alias("sources"))))


@query("""select o_orderkey, row_number() over (partition by o_custkey order by case year(o_orderdate) when 1996 then 1 when 1995 then 2 else 3 end, case o_orderpriority when '5-LOW' then 1 when '3-MEDIUM' then 2 else 3 end, o_orderkey)::int as place from orders""")
def ordered_rows(spark, d):
    """Each customer's orders: vintages and labels in a stated order, then by a number that is kept as text."""
    rows = table(spark, d, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    order = [documents.in_order(F.year("o_orderdate"), [1996, 1995]), documents.in_order(F.col("o_orderpriority"), ["5-LOW", "3-MEDIUM"]), F.col("key").try_cast("long")]
    return documents.placed(rows, ["o_custkey"], order).select("o_orderkey", "place")


@query(f"""with {POINTS_SQL}, a as (select p_partkey, m >= 1000 as gone, case when p_size % 3 != 0 then lat end as own, ref_lat from audit)
select p_partkey, case when gone then null else coalesce(own, ref_lat) end as lat, case when gone then 'withdrawn' when own is not null then 'register' when ref_lat is not null then 'reference' else 'none' end as source from a""")
def register_adoption(spark, d):
    """Coordinates of the register, of its reference where it has none, and of neither where they conflict."""
    rows = _points(spark, d).withColumn("m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon")))
    pick = linkage.adopted(F.col("m") >= 1000, F.when(F.col("p_size") % 3 != 0, F.col("lat")), F.col("ref_lat"))
    return rows.select("p_partkey", pick.alias("_p")).select("p_partkey", F.col("_p.value").alias("lat"), "_p.source")


@query("""with o as (select n_nationkey as unit, n_name, count(*) as n, count(case when o_orderpriority[1] = '1' then 1 end) as a, count(case when o_orderpriority[1] = '2' then 1 end) as b, count(case when o_orderpriority[1] > '2' then 1 end) as c,
  max(floor(o_totalprice))::bigint as top, min(floor(o_totalprice))::bigint as low from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
names as (select 'names' as relation, unit, unnest(['number', 'name']) as key, unnest([(case unit when 7 then 70 else unit + 1 end)::varchar, n_name]) as value, null as problem from o where unit != 4),
counts as (select 'counts', unit, unnest(['total', 'urgent', 'high', 'other']) as key, unnest([case unit when 11 then n + 1 else n end, a, b, c])::varchar, null from o where unit != 4),
prices as (select 'prices', unit, unnest(['top', 'low']), unnest([top, low])::varchar, null from o where unit != 4),
told as (select 'names', 7, 'number', '70', 'is not the next number' union all select 'names', 4, 'number', null, 'is not the next number' union all select 'counts', 11, 'total', (n + 1)::varchar, 'is not the sum of its parts' from o where unit = 11)
select 'orders' as sheet, relation, unit::int as unit, key, value, problem from (select * from names union all select * from counts union all select * from prices union all select * from told)""")
def sheet_parse(spark, d):
    """A sheet of blocks that hold three relations, taken apart in one pass: one block is missing, one has a wrong number, one a wrong total."""
    level, price = F.substring("o_orderpriority", 1, 1), F.floor("o_totalprice").cast("long")
    rows = _placed_orders(spark, d).groupBy(F.col("n_nationkey").alias("unit"), "n_name").agg(
        F.count("*").alias("n"), F.count_if(level == "1").alias("a"), F.count_if(level == "2").alias("b"), F.count_if(level > "2").alias("c"), F.max(price).alias("top"), F.min(price).alias("low")
    )
    cell = lambda place, col, value: F.struct(F.lit("orders").alias("sheet"), (F.col("unit") * 3 + 5 + place).cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))
    number, total = F.when(F.col("unit") == 7, 70).otherwise(F.col("unit") + 1), F.when(F.col("unit") == 11, F.col("n") + 1).otherwise(F.col("n"))
    made = [cell(0, 0, number), cell(0, 1, F.col("n_name")), cell(0, 9, F.lit("derived")), cell(1, 1, total), *[cell(1, 2 + i, F.col(c)) for i, c in enumerate("abc")], cell(2, 2, F.col("top")), cell(2, 3, F.col("low"))]
    cells = rows.filter("unit != 4").select(F.inline(F.array(*made)))
    block = {"first_row": 5, "size": 3, "count": 25}
    relations = [
        sheets.Relation("names", fields={"number": (0, 0), "name": (0, 1)}, number="number", **block),
        sheets.Relation("counts", fields={"total": (1, 1), "urgent": (1, 2), "high": (1, 3), "other": (1, 4)}, totals={"total": ["urgent", "high", "other"]}, **block),
        sheets.Relation("prices", fields={"top": (2, 2), "low": (2, 3)}, **block),
    ]
    return sheets.parse(cells, relations)


@query(f"""with {POINTS_SQL} select o_orderkey, case when o_orderstatus = 'F' then p_partkey end as known, case when o_orderstatus = 'F' then lat end as lat
from orders left join points on p_partkey = o_custkey""")
def located_records(spark, d):
    """Orders linked to points by number; those that are still open show no place."""
    links = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("right_id"), "o_orderstatus")
    points = _points(spark, d).withColumnRenamed("p_partkey", "right_id")
    rows = linkage.records(links, points, "o_orderstatus", ["F"])
    return rows.select("o_orderkey", F.when(F.col("lat").isNotNull(), F.col("right_id")).alias("known"), "lat")


@query("""with o as (select n_name, o_orderpriority as series, count(*)::varchar as n, sum(round(o_totalprice * 100)::bigint)::bigint::varchar as cents from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)
select 'orders' as sheet, n_name as key, 'counts' as relation, series, n as value from o union all select 'orders', n_name, 'amounts', series, cents from o""")
def sheet_relations(spark, d):
    """A sheet with counts, amounts and a derived column side by side, generated as cells and taken apart into its relations."""
    rows = _placed_orders(spark, d).groupBy("n_nationkey", "n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    at = F.substring("o_orderpriority", 1, 1).cast("int")
    cell = lambda row, col, value: F.struct(F.lit("orders").alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))
    one, two, row = F.lit(1), F.lit(2), F.col("n_nationkey") + 3
    made = [cell(row, F.lit(0), F.col("n_name")), cell(row, F.lit(11), F.col("n")), cell(one, F.lit(11), F.lit("difference"))]
    for name, value, shift in (("counts", "n", 0), ("amounts", "cents", 5)):
        made += [cell(one, at + shift, F.lit(name)), cell(two, at + shift, F.col("o_orderpriority")), cell(row, at + shift, F.col(value))]
    cells = rows.select(F.inline(F.array(*made))).dropDuplicates(["sheet", "row", "col"])
    parts = F.split("label", "/")
    known = F.when(parts[0].isin("counts", "amounts"), F.struct(parts[0].alias("relation"), F.get(parts, one).alias("series")))
    return layout.relations(cells, (1, 2), 0, known)


@query("""with p as (select distinct lpad(c_custkey::varchar, 6, '0') as area, lpad(c_nationkey::varchar, 2, '0') as prefecture from customer where c_custkey is not null and c_nationkey is not null)
select area, count(*) as parents, count(case when not starts_with(area, prefecture) then 1 end) as unfit from p group by 1 having count(*) > 1 or count(case when not starts_with(area, prefecture) then 1 end) > 0""")
def nesting_errors(spark, d):
    """Customer numbers as area codes, which should begin with the code of their nation."""
    rows = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("area"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("prefecture"))
    return relational.nesting_errors(rows, "area", "prefecture", F.startswith("area", "prefecture"))


@query(f"with {AREAS_SQL} select region, floor(sum(km2) * 100 + 0.5) / 100 as km2 from areas group by 1")
def region_area(spark, d):
    """Areas summed by the nation that they belong to."""
    return _supplier_areas(spark, d, ["region"]).select("region", measures.half_up(F.col("km2"), 2).alias("km2"))
