"""Record linkage within blocks: exact names, suffixes, contests, fuzzy candidates.

Both sides grow with the registers, so none is broadcast: Spark judges them by their compressed files, and names, addresses and letters that repeat are tens
of times that in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import names, places
from ledgerline.functions.measures import half_up
from ledgerline.functions.text import similarity
from ledgerline.plans import lineage


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles and merges, whatever Spark takes the sides' sizes for."""
    return left.join(right.hint("merge"), on, how)


def exact(left: DataFrame, right: DataFrame, block: str, name: str) -> DataFrame:
    """Left rows with the number of equal names in their block; linked where it is one. Needs left_id and right_id."""
    names = right.groupBy(block, name).agg(F.count("*").alias("candidates"), F.min("right_id").alias("_one"))
    found = _met(left, names, [block, name], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return found.withColumn("right_id", F.when(F.col("candidates") == 1, F.col("_one"))).drop("_one")


def contested(links: DataFrame) -> DataFrame:
    """Links to a right row that several left rows claim are all withdrawn."""
    claims = F.count("*").over(Window.partitionBy("right_id"))
    return links.withColumn("contested", F.col("right_id").isNotNull() & (claims > 1)).withColumn("right_id", F.when(~F.col("contested"), F.col("right_id")))


def _suffix_pairs(left: DataFrame, right: DataFrame, shortest: int) -> DataFrame:
    """block, name, other of the names where one is the end of the other, `shortest` characters at least; left: block, name; right: block, other.

    Each name's own ends are joined by equality with the names of the other side, so that a large block makes no product.
    """
    ends = lambda c: F.explode(F.expr(f"transform(sequence(2, greatest(1, length({c}) - {shortest} + 1), if(length({c}) > {shortest}, 1, -1)), i -> substring({c}, i))"))
    longer = lambda rows, c: rows.filter(F.length(c) > shortest)
    at_end = _met(longer(left, "name").select("block", "name", ends("name").alias("other")), right, ["block", "other"])
    whole = _met(longer(right, "other").select("block", "other", ends("other").alias("name")), left, ["block", "name"])
    return at_end.select("block", "name", "other").union(whole.select("block", "name", "other"))


def _letters(names: DataFrame, c: str) -> DataFrame:
    """block, c, n_c, x_c, s_c: a name's length, its letters, each a number of its own by how often it has stood so far, and these numbers as bits of a long."""
    letters = f"filter(split({c}, ''), x -> x != '')"
    x = F.expr(f"transform({letters}, (x, i) -> ascii(x) * 4294967296L + size(filter(slice({letters}, 1, i + 1), y -> y = x)))")
    bits = F.expr(f"aggregate(x_{c}, 0L, (s, x) -> s | shiftleft(1L, int(pmod(hash(x), 64))))")
    return names.select("block", c, F.length(c).alias(f"n_{c}"), x.alias(f"x_{c}")).withColumn(f"s_{c}", bits)


def _like_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """block, name, other, bound of all names whose similarity() may reach `threshold`; left and right: _letters() of name and of other, none of them empty.

    The ratio is at most twice the letters in common over all letters: that is `bound`. Names that reach the threshold by it have a letter in common
    among the rarest of each (the prefix of a set-similarity join over letters with their repetitions), by which they are joined. A bit that only one
    of two names has is a letter that the other lacks, so most pairs go by their bits; of the rest the letters in common are counted, and those below the
    threshold go before anything is shuffled again.
    """
    share = threshold / (2 - threshold)  # of a name's letters that must be common, whatever the other's length
    each = lambda rows, c: rows.select("block", c, f"n_{c}", f"x_{c}", f"s_{c}", F.explode(f"x_{c}").alias("letter"))
    common = each(left, "name").select("block", "letter").union(each(right, "other").select("block", "letter")).groupBy("block", "letter").agg(F.count("*").alias("_f"))

    def prefix(rows: DataFrame, c: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("block", c).orderBy("_f", "letter"))
        kept = F.col("_r") <= F.col(f"n_{c}") - F.ceil(F.col(f"n_{c}") * share - 1e-9) + 1
        ranked = _met(each(rows, c).select("block", c, f"n_{c}", "letter"), common, ["block", "letter"]).withColumn("_r", rank).filter(kept)
        return _met(ranked.select("block", c, "letter"), rows, ["block", c])

    both = F.col("n_name") + F.col("n_other")
    lacks = lambda one, two: F.bit_count(F.col(one).bitwiseAND(F.bitwise_not(F.col(two))))
    at_most = F.least(F.col("n_name") - lacks("s_name", "s_other"), F.col("n_other") - lacks("s_other", "s_name"))
    met = _met(prefix(left, "name"), prefix(right, "other"), ["block", "letter"]).filter(2 * at_most >= threshold * both - 1e-9)
    met = met.withColumn("bound", 2 * F.size(F.array_intersect("x_name", "x_other")) / both).filter(F.col("bound") >= threshold - 1e-9)
    return met.select("block", "name", "other", "bound").distinct()


def suffix(left: DataFrame, right: DataFrame, block: str, name: str, shortest: int = 5) -> DataFrame:
    """Left rows whose name ends with, or is the end of, exactly one right name of the block (equal names apart).

    Names are compared once, however many rows of the block have them.
    """
    other = right.groupBy(F.col(block).alias("block"), F.col(name).alias("other")).agg(F.count("*").alias("points"), F.min("right_id").alias("right_id"))
    pairs = _suffix_pairs(left.select(F.col(block).alias("block"), F.col(name).alias("name")).distinct(), other.select("block", "other"), shortest)
    found = _met(pairs, other, ["block", "other"]).groupBy("block", "name").agg(F.sum("points").alias("points"), F.min("right_id").alias("right_id"))
    named = left.select("left_id", F.col(block).alias("block"), F.col(name).alias("name"))
    rows = _met(named, found, ["block", "name"]).groupBy("left_id").agg(F.sum("points").alias("candidates"), F.min("right_id").alias("right_id"))
    return rows.withColumn("right_id", F.when(F.col("candidates") == 1, F.col("right_id")))


def fuzzy(left: DataFrame, right: DataFrame, block: str, name: str, threshold: float = 0.8) -> DataFrame:
    """The best candidate of each left row within its block, by similarity, then right_id, if it reaches the threshold; pool: right rows of the block.

    Names are compared once, however many rows of the block have them, and only those that letters in common let reach the threshold.
    """
    right = right.select(F.col(block).alias("block"), F.col(name).alias("other"), "right_id")
    left = left.select("left_id", F.col(block).alias("block"), F.col(name).alias("name"))
    best = _met(_met(left, _best(left, right, threshold), ["block", "name"]), right.groupBy("block").agg(F.count("*").alias("pool")), "block")
    return best.select("left_id", "pool", (-F.col("b.r")).alias("right_id"), half_up(F.col("b._score")).alias("score"))


def _by_name(right: DataFrame, rows: DataFrame) -> DataFrame:
    """right_area, right_name with the points that no row of `rows` has yet: their number, the first one, an address."""
    free = _met(right, rows.filter("right_id is not null").select("right_id"), "right_id", "left_anti")
    return free.groupBy("right_area", "right_name").agg(F.count("*").alias("points"), F.min("right_id").alias("right_id"), F.min("address").alias("address"))


#: Candidates of a name that are scored first.
FIRST = 3


def _best(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """block, name, b (_score and the negative right_id of the most similar name) of the names with one that reaches the threshold.

    A name that stands on both sides is its own best, as only equal names have a ratio of 1: it meets no other. For the rest, the candidates of the highest bounds
    are scored first; of the others, only those whose bound is not below the best score of their name, as no other can win.
    """
    other = lineage.cut(right.groupBy("block", "other").agg(F.min("right_id").alias("right_id")), "names")
    alike = _met(left.select("block", "name").distinct(), other.select("block", F.col("other").alias("name"), "right_id"), ["block", "name"], "left")
    alike = lineage.cut(alike, "alike")
    open_ = lineage.cut(_letters(alike.filter("right_id is null and name != ''"), "name"), "letters")
    pairs = _like_pairs(open_, lineage.cut(_letters(other.filter("other != ''"), "other"), "letters"), threshold)
    rank = F.row_number().over(Window.partitionBy("block", "name").orderBy(F.desc("bound"), "other"))
    pairs = lineage.cut(pairs.withColumn("_r", rank), "pairs")
    score = lambda rows: rows.withColumn("_score", similarity(F.col("name"), F.col("other"))).select("block", "name", "other", "_score")
    early = lineage.cut(score(pairs.filter(F.col("_r") <= FIRST)), "scores")
    least = early.groupBy("block", "name").agg(F.max("_score").alias("_least"))
    late = _met(pairs.filter(F.col("_r") > FIRST), least, ["block", "name"]).filter(F.col("bound") >= F.greatest(F.col("_least"), F.lit(threshold)) - 1e-9)
    scored = _met(early.union(score(late)).filter(F.col("_score") >= threshold), other, ["block", "other"])
    same = alike.filter(F.col("right_id").isNotNull() & (F.lit(1.0) >= threshold)).select("block", "name", F.struct(F.lit(1.0).alias("_score"), (-F.col("right_id")).alias("r")).alias("b"))
    return scored.groupBy("block", "name").agg(F.max(F.struct("_score", (-F.col("right_id")).alias("r"))).alias("b")).union(same)


def tiers(left: DataFrame, right: DataFrame, shortest: int = 5, threshold: float = 0.8, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Links a register to points in three tiers: equal names, suffixes, and the best candidate by similarity.

    left: left_id, area, name (normal form), municipality; right: right_id, area, name, address. Per left row: match_status,
    match_method, reason_code, candidate_count, match_score, right_id. Points that two rows claim in a tier go to neither.
    `cut` is applied to each tier's result, e.g. to checkpoint it, as later tiers use it twice.
    """
    left = left.select("left_id", "area", "name", F.coalesce(F.trim("municipality"), F.lit("")).alias("municipality"))
    right = right.select("right_id", F.col("area").alias("right_area"), F.col("name").alias("right_name"), "address")
    checked = places.municipality_check(F.col("address"), F.col("municipality"))

    # Tier 1. Counts by name, and by name and area; the one point of an area is carried along.
    everywhere = right.groupBy(F.col("right_name").alias("name")).agg(F.count("*").alias("_all"))
    here = right.groupBy(F.col("right_name").alias("name"), F.col("right_area").alias("area")).agg(F.count("*").alias("_here"), F.min("right_id").alias("_one"), F.min("address").alias("address"))
    rows = _met(_met(left, everywhere, "name", "left"), here, ["name", "area"], "left").fillna(0, ["_all", "_here"])
    unreported, several = F.col("municipality") == "", F.col("_here") > 1
    reason = F.when(unreported, "not_reported_facility").when(F.col("_all") == 0, "no_name_match").when(F.col("_here") == 0, "outside_area_polygon").when(several, "multiple_candidates_in_area").otherwise(checked)
    count = F.when(~unreported & (F.col("_here") == 0), F.col("_all")).otherwise(F.col("_here"))
    rows = rows.select("left_id", "area", "name", "municipality", reason.alias("reason"), count.alias("count"), F.when(reason == "", F.col("_one")).alias("right_id"))
    rows = cut(_settle(rows))

    # Tier 2. Suffixes among the points of the area that are still free; names are compared once, however many rows have them.
    free = _by_name(right, rows)
    open_ = rows.filter("right_id is null and municipality != ''")
    named = open_.select(F.col("area").alias("block"), "name").distinct()
    pairs = _suffix_pairs(named, free.select(F.col("right_area").alias("block"), F.col("right_name").alias("other")), shortest)
    shorter = F.when(F.length("name") < F.length("other"), F.col("name")).otherwise(F.col("other"))
    pairs = pairs.filter(~names.type_words_only(shorter)).select(F.col("block").alias("area"), "name", F.col("other").alias("right_name"))
    found = _met(pairs, free.withColumnRenamed("right_area", "area"), ["area", "right_name"]).groupBy("area", "name").agg(F.sum("points").alias("_n"), F.min("right_id").alias("_one"), F.min("address").alias("address"))
    why = F.when(F.col("_n") > 1, "multiple_candidates_in_area").otherwise(checked)
    second = _met(open_, found, ["area", "name"]).select("left_id", "_n", why.alias("_why"), F.when(why == "", F.col("_one")).alias("_right"))
    rows = _met(rows.withColumnRenamed("right_id", "_first"), second, "left_id", "left")
    rows = rows.select("left_id", "area", "name", "municipality", "_first", F.coalesce("_why", "reason").alias("reason"), F.coalesce("_n", "count").alias("count"), F.col("_right").alias("right_id"))
    rows = _settle(rows).withColumn("match_method", F.when(F.col("_first").isNotNull(), "normalized_exact").when(F.col("right_id").isNotNull(), "normalized_suffix").otherwise("none"))
    rows = cut(rows.withColumn("right_id", F.coalesce("_first", "right_id")).drop("_first"))

    # Tier 3. Candidates only: the most similar free point of the area.
    free = _by_name(right, rows).select(F.col("right_area").alias("area"), F.col("right_area").alias("block"), F.col("right_name").alias("other"), "right_id", "points")
    best = _best(rows.filter("right_id is null").select(F.col("area").alias("block"), "name"), free, threshold).withColumnRenamed("block", "area")
    pools = free.groupBy("area").agg(F.sum("points").alias("_pool"))
    best = _met(_met(rows.filter("right_id is null"), best, ["area", "name"]), pools, "area").select("left_id", "b", "_pool")
    rows = _met(rows, best, "left_id", "left")
    status = F.when(F.col("right_id").isNotNull(), "matched").when(F.col("b").isNotNull(), "candidate_only").otherwise("unmatched")
    return rows.select(
        "left_id", status.alias("match_status"), "match_method", F.when(F.col("right_id").isNull(), F.col("reason")).otherwise("").alias("reason_code"),
        F.coalesce("_pool", "count").alias("candidate_count"), half_up(F.col("b._score")).alias("match_score"), F.coalesce("right_id", -F.col("b.r")).alias("right_id"),
    )


def _settle(rows: DataFrame) -> DataFrame:
    """Withdraws points that several rows claim; the reason says so."""
    claims = rows.filter("right_id is not null").groupBy("right_id").agg(F.count("*").alias("_claims")).filter("_claims > 1")
    # Rows without a point would all hash to one task.
    spread = F.when(F.col("right_id").isNull(), F.xxhash64("left_id")).otherwise(F.lit(0).cast("long"))
    marked = _met(rows.withColumn("_spread", spread), claims.withColumn("_spread", F.lit(0).cast("long")), ["right_id", "_spread"], "left").drop("_spread")
    lost = F.col("_claims").isNotNull()
    return marked.withColumn("reason", F.when(lost, "contested_candidate").otherwise(F.col("reason"))).withColumn("right_id", F.when(~lost, F.col("right_id"))).drop("_claims")


def references(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, reference_status and right_id of the only point with the same region and name in the same municipality.

    left: left_id, region, name, municipality; right: right_id, region, name, address. Points are counted by the keys that their addresses have in common with the
    municipalities they lie in, and these are met by equality, so that a name with many rows on both sides makes no product.
    """
    left = left.select("left_id", "region", "name", F.coalesce(F.trim("municipality"), F.lit("")).alias("municipality"))
    points = right.groupBy("region", "name").agg(F.count("right_id").alias("_n"), F.min("right_id").alias("_any"))
    addresses = right.groupBy("region", "name", "address").agg(F.count(F.lit(1)).alias("_fit"), F.min("right_id").alias("_one"))
    longest = left.agg(F.max(F.length("municipality")).alias("_longest"))  # one row
    keyed = places.address_keys(addresses.crossJoin(F.broadcast(longest)), "address", "key", F.col("_longest")).groupBy("region", "name", "key").agg(F.sum("_fit").alias("_fit"), F.min("_one").alias("_one"))
    asked = places.name_keys(left.select("region", "name", "municipality").distinct(), "municipality", "key")
    fits = _met(asked, keyed, ["region", "name", "key"]).groupBy("region", "name", "municipality").agg(F.sum("_fit").alias("_fit"), F.min("_one").alias("_one"))
    rows = _met(_met(left, points, ["region", "name"], "left"), fits, ["region", "name", "municipality"], "left").fillna(0, ["_n", "_fit"])
    unnamed = F.col("municipality") == ""
    fit, one = F.when(unnamed, F.col("_n")).otherwise(F.col("_fit")), F.when(unnamed, F.col("_any")).otherwise(F.col("_one"))
    found = rows.groupBy("left_id", "municipality").agg(F.sum("_n").alias("n"), F.sum(fit).alias("fit"), F.min(one).alias("right_id"))
    alone = F.when(F.col("municipality") == "", "unique_municipality_unverified").otherwise("unique")
    status = F.when(F.col("n") == 0, "none").when(F.col("fit") == 0, "municipality_mismatch").when(F.col("fit") > 1, "ambiguous").otherwise(alone)
    return found.select("left_id", status.alias("reference_status"), F.when(F.col("fit") == 1, F.col("right_id")).alias("right_id"))


def audit_status(has_coordinate: Column, has_reference: Column, metres: Column, agree: float = 100, conflict: float = 1_000) -> Column:
    """How far a coordinate is from its reference, in bands; or which of the two is missing."""
    band = F.when(~has_reference, "no_reference").when(metres < agree, "agree").when(metres < conflict, "minor_gap").otherwise("conflict")
    return F.when(has_coordinate, band).when(has_reference, "missing_with_reference").otherwise("missing_without_reference")


def adopted(withdrawn: Column, own: Column, reference: Column) -> Column:
    """struct<value, source>: a register's own value unless it is withdrawn, else a reference's only one, and which of them it is."""
    pick = lambda value, source: F.struct(value.alias("value"), F.lit(source).alias("source"))
    nothing = F.lit(None).cast("double")
    return F.when(withdrawn, pick(nothing, "withdrawn")).when(own.isNotNull(), pick(own, "register")).when(reference.isNotNull(), pick(reference, "reference")).otherwise(pick(nothing, "none"))


def records(links: DataFrame, points: DataFrame, status: str, matched: list[str]) -> DataFrame:
    """Links with lon and lat of their point (right_id, lon, lat); only where the status is one of `matched`, as candidates have no place yet."""
    rows = links.join(points.select("right_id", "lon", "lat"), "right_id", "left")
    sure = F.col(status).isin(matched)
    return rows.withColumns({c: F.when(sure, F.col(c)) for c in ("lon", "lat")})
