"""Origin-destination flows: shares of an origin's total, ranked partners and the remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.measures import half_up


def shares(edges: DataFrame, origin: str, partner: str) -> DataFrame:
    """origin, partner, n, share of the origin's rows, is_self; counts are summed before the window sees them."""
    pairs = edges.groupBy(origin, partner).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(origin))
    return pairs.withColumn("share", half_up(F.col("n") / total, 6)).withColumn("is_self", F.col(origin) == F.col(partner))


def ranked(flows: DataFrame, origin: str, partner: str) -> DataFrame:
    """Partners other than the origin, ranked by n, ties by partner."""
    order = Window.partitionBy(origin).orderBy(F.col("n").desc(), F.col(partner))
    return flows.filter(~F.col("is_self")).withColumn("rank", F.row_number().over(order))


def groups(flows: DataFrame, origin: str, partner: str) -> DataFrame:
    """One row per origin: its own count and share, the number of partners and the shares beyond it."""
    own = F.col("is_self")
    return flows.groupBy(origin).agg(
        F.sum("n").alias("total"), F.sum(F.when(own, F.col("n"))).alias("self_n"), F.count(F.when(~own, 1)).alias("partners"), F.max(F.when(~own, F.col("n"))).alias("largest")
    )


def remainder(flows: DataFrame, origin: str, partner: str, k: int) -> DataFrame:
    """What the k largest partners leave over, per origin."""
    first = ranked(flows, origin, partner).withColumn("part", F.when(F.col("rank") <= k, "top").otherwise("rest"))
    return first.groupBy(origin).agg(F.sum(F.when(F.col("part") == "top", F.col("n"))).alias("top_n"), F.coalesce(F.sum(F.when(F.col("part") == "rest", F.col("n"))), F.lit(0)).alias("rest_n"))


def every_group(groups: DataFrame, edges: DataFrame, keys: list[str], partner: str, rate: str, self_key: str, status: str) -> DataFrame:
    """One row per group of `groups`, even without edges: self_rate, self_rank, partners in rank order, value_error_count.

    Edges have rank, `rate` and `status`; rows in error are only counted, the group's own row leaves its partners.
    """
    ok, own = F.col(status) != "error", F.col(partner) == F.col(self_key)
    found = edges.groupBy(*keys).agg(
        F.max(F.when(ok & own, F.col(rate))).alias("self_rate"),
        F.max(F.when(ok & own, F.col("rank"))).alias("self_rank"),
        F.array_sort(F.collect_list(F.when(ok & ~own, F.struct("rank", F.col(partner).alias("partner"), F.col(rate).alias("rate"))))).alias("partners"),
        F.count_if(~ok).alias("value_error_count"),
    )
    none = F.array().cast(found.schema["partners"].dataType)
    joined = groups.join(found, keys, "left")
    return joined.withColumn("partners", F.coalesce("partners", none)).withColumn("value_error_count", F.coalesce("value_error_count", F.lit(0)))


def with_self(grouped: DataFrame, self_key: str) -> DataFrame:
    """The groups' rows again, the own one at its rank among the partners: rank, partner, rate."""
    own = F.struct(F.col("self_rank").alias("rank"), F.col(self_key).alias("partner"), F.col("self_rate").alias("rate"))
    plain = F.transform("partners", lambda p: F.struct(p["partner"].alias("partner"), p["rate"].alias("rate")))
    place = F.col("self_rank").cast("int")
    rows = F.when(place.isNull(), plain).otherwise(F.concat(F.slice(plain, F.lit(1), place - 1), F.array(F.struct(own["partner"].alias("partner"), own["rate"].alias("rate"))), F.slice(plain, place, F.greatest(F.size(plain), F.lit(1)))))
    kept = [c for c in grouped.columns if c not in ("self_rate", "self_rank", "partners", "value_error_count")]
    return grouped.select(*kept, F.posexplode(rows).alias("_at", "_row")).select(*kept, (F.col("_at") + 1).alias("rank"), F.col("_row.partner").alias("partner"), F.col("_row.rate").alias("rate"))


def rising(edges: DataFrame, keys: list[str], rate: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose rate is above that of the rank before them."""
    before = F.lag(rate).over(Window.partitionBy(*keys).orderBy("rank"))
    return edges.withColumn("previous", before).filter(F.col(rate) > F.col("previous") + tolerance)


def overfull(edges: DataFrame, keys: list[str], rate: str, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose rates sum to more than one."""
    return edges.groupBy(*keys).agg(F.sum(rate).alias("total")).filter(F.col("total") > 1 + tolerance)


def rate_triples(rows: DataFrame, keys: list[str], inflow: str, outflow: str, own: str) -> DataFrame:
    """keys, rates (struct of the three, NULL where none is known), uneven: some of the three are known and others aren't."""
    known = [F.col(c).isNotNull() for c in (inflow, outflow, own)]
    all_, some = known[0] & known[1] & known[2], known[0] | known[1] | known[2]
    return rows.select(*keys, F.when(all_, F.struct(F.col(inflow).alias("inflow"), F.col(outflow).alias("outflow"), F.col(own).alias("self"))).alias("rates"), (some & ~all_).alias("uneven"))


def listed(places: DataFrame, edges: DataFrame, origin: str, partner: str, rate: str, chosen) -> DataFrame:
    """Every place with its rate seen from the `chosen` origin and a status: self, listed, zero, or unlisted (no row, which is not zero)."""
    own = edges.filter(F.col(origin) == chosen).select(F.col(partner).alias("place"), F.col(rate).alias("rate"))
    status = F.when(F.col("place") == chosen, "self").when(F.col("rate").isNull(), "unlisted").when(F.col("rate") == 0, "zero").otherwise("listed")
    return places.select("place").join(own, "place", "left").withColumn("status", status)
