"""Municipalities in Japanese addresses: what an address names, and whether it agrees with a known municipality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cities whose wards count as municipalities (fixed values).
DESIGNATED_CITIES = [
    "札幌市", "仙台市", "さいたま市", "千葉市", "横浜市", "川崎市", "相模原市", "新潟市", "静岡市", "浜松市", "名古屋市", "京都市", "大阪市", "堺市",
    "神戸市", "岡山市", "広島市", "北九州市", "福岡市", "熊本市",
]
#: Special wards (fixed values).
SPECIAL_WARDS = [
    "千代田区", "中央区", "港区", "新宿区", "文京区", "台東区", "墨田区", "江東区", "品川区", "目黒区", "大田区", "世田谷区", "渋谷区", "中野区",
    "杉並区", "豊島区", "北区", "荒川区", "板橋区", "練馬区", "足立区", "葛飾区", "江戸川区",
]
#: Prefectures (fixed values).
PREFECTURES = [
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県",
    "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県",
    "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県",
    "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
]
#: Any character but a digit, ASCII or full width: a block number ends a name.
NAME = "[^0-9０-９]"
CITIES_PATTERN, WARDS_PATTERN, PREFECTURES_PATTERN = (f"^({'|'.join(names)})" for names in (DESIGNATED_CITIES, SPECIAL_WARDS, PREFECTURES))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern, NULL where it doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def without_prefecture(address: Column) -> Column:
    return F.regexp_replace(address, PREFECTURES_PATTERN, "")


def municipality(address: Column, unsure: bool = True) -> Column:
    """City with ward, town of a county, special ward or city that an address starts with; NULL for none.

    unsure: a bare town or village counts too, though it may be a quarter of an unnamed city, unless it has a ward in it.
    """
    place = without_prefecture(address)
    city, ward = _found(place, CITIES_PATTERN), _found(place, f"{CITIES_PATTERN}({NAME}+?区)", 2)
    town = _found(place, f"^({NAME}+?(?:町|村))")
    rest = F.when(~F.contains(town, F.lit("区")), town) if unsure else F.lit(None).cast("string")
    named = F.coalesce(_found(place, f"^{NAME}+?郡({NAME}+?(?:町|村))"), _found(place, WARDS_PATTERN), _found(place, f"^({NAME}+?市)"), rest)
    return F.when(city.isNotNull(), F.concat(city, ward)).otherwise(named)


def _large(text: Column) -> Column:
    return F.translate(text, "ヶヵ", "ケカ")


def _ward(place: Column) -> Column:
    return _found(place, f"^({NAME}+?区)")


def _behind_county(place: Column) -> Column:
    return F.regexp_replace(place, f"^{NAME}+?郡", "")


def in_municipality(address: Column, name: Column) -> Column:
    """Whether an address lies in a municipality: it starts with the name, perhaps behind a county, or with a ward that ends the name."""
    place, name = _large(without_prefecture(address)), _large(name)
    fits = F.startswith(place, name) | F.startswith(_behind_county(place), name) | F.coalesce(F.endswith(name, _ward(place)), F.lit(False))
    return F.coalesce((address != "") & (name != "") & fits, F.lit(False))


def name_keys(rows: DataFrame, name: str, key: str) -> DataFrame:
    """`rows` once for each key of the municipality `name`: '=' and the whole name, '~' and each of its ends.

    It has exactly one key in common with an address_keys() that lies in it, and none with any other. A null or empty name has no key.
    """
    rows = rows.filter(F.length(name) > 0).withColumn(key, _large(F.col(name)))
    ends = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.lit("~"), F.substring(F.col(key), i, F.length(key))))
    return rows.withColumn(key, F.explode(F.concat(F.array(F.concat(F.lit("="), F.col(key))), ends)))


def address_keys(rows: DataFrame, address: str, key: str, longest: Column) -> DataFrame:
    """`rows` once for each key of `address`: '~' and its ward, '=' and each of its beginnings that doesn't end with that ward, perhaps behind a county, `longest` characters at most."""
    rows = rows.filter(F.length(address) > 0).withColumn("_place", _large(without_prefecture(F.col(address)))).withColumn("_behind", _behind_county(F.col("_place"))).withColumn("_ward", _ward(F.col("_place")))

    def starts(c: str) -> Column:
        n = F.least(F.length(c), longest)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(c), F.lit(1), i))).otherwise(F.array().cast("array<string>"))

    names = F.filter(F.array_distinct(F.concat(starts("_place"), starts("_behind"))), lambda x: ~F.coalesce(F.endswith(x, F.col("_ward")), F.lit(False)))
    ward = F.array_compact(F.array(F.concat(F.lit("~"), F.col("_ward"))))
    return rows.withColumn(key, F.explode(F.concat(F.transform(names, lambda x: F.concat(F.lit("="), x)), ward))).drop("_place", "_behind", "_ward")


def municipality_check(address: Column, name: Column) -> Column:
    """'' where they agree, else why not: another municipality stands there, or none that is sure."""
    reason = F.when(municipality(address, unsure=False).isNull(), "municipality_not_in_address").otherwise("municipality_mismatch")
    return F.when(in_municipality(address, name), "").otherwise(reason)


def bare_ward(address: Column) -> Column:
    """Whether an address names no municipality and starts with a ward of an unnamed city."""
    return F.coalesce(municipality(address).isNull() & without_prefecture(address).rlike(f"^{NAME}{{1,4}}区"), F.lit(False))
