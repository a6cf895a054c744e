"""Addresses to coordinates and coordinates to administrative regions, by joins with reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..model import scalar
from .scans import salted_join

# Cities that count as a region of their own.
SPECIAL_CITIES = (
    "Seoul",
    "Busan",
    "Daegu",
    "Incheon",
    "Gwangju",
    "Daejeon",
    "Ulsan",
    "Sejong",
    "서울",
    "서울특별시",
    "부산",
    "부산광역시",
    "대구",
    "대구광역시",
    "인천",
    "인천광역시",
    "광주",
    "광주광역시",
    "대전",
    "대전광역시",
    "울산",
    "울산광역시",
    "세종",
    "세종특별자치시",
)

# Endings an official region name may carry, tried in this order.
REGION_SUFFIXES = (
    " State",
    " Province",
    " Metropolitan City",
    " Special City",
    "특별자치도",
    "광역시",
    "특별시",
    "도",
    "시",
)

# Marks of a region-level name.
REGION_MARKS = ("State", "Province", "도", "특별시", "광역시", "특별자치도")

# English region names and the short local name.
ENGLISH_REGIONS = {
    "Seoul": "서울",
    "Busan": "부산",
    "Daegu": "대구",
    "Incheon": "인천",
    "Gwangju": "광주",
    "Daejeon": "대전",
    "Ulsan": "울산",
    "Sejong": "세종",
    "Gyeonggi": "경기",
    "Gangwon": "강원",
    "North Chungcheong": "충북",
    "South Chungcheong": "충남",
    "North Jeolla": "전북",
    "South Jeolla": "전남",
    "North Gyeongsang": "경북",
    "South Gyeongsang": "경남",
    "Jeju": "제주",
}

# Well-known cities and the short name of the region they lie in.
CITY_REGION = {
    "수원시": "경기",
    "Suwon": "경기",
    "성남시": "경기",
    "Seongnam": "경기",
    "고양시": "경기",
    "Goyang": "경기",
    "용인시": "경기",
    "Yongin": "경기",
    "부천시": "경기",
    "Bucheon": "경기",
    "안산시": "경기",
    "Ansan": "경기",
    "안양시": "경기",
    "Anyang": "경기",
    "남양주시": "경기",
    "Namyangju": "경기",
    "화성시": "경기",
    "Hwaseong": "경기",
    "평택시": "경기",
    "Pyeongtaek": "경기",
    "의정부시": "경기",
    "Uijeongbu": "경기",
    "시흥시": "경기",
    "Siheung": "경기",
    "파주시": "경기",
    "Paju": "경기",
    "김포시": "경기",
    "Gimpo": "경기",
    "광명시": "경기",
    "Gwangmyeong": "경기",
    "광주시": "경기",
    "Gwangju": "경기",
    "군포시": "경기",
    "Gunpo": "경기",
    "하남시": "경기",
    "Hanam": "경기",
    "오산시": "경기",
    "Osan": "경기",
    "양주시": "경기",
    "Yangju": "경기",
    "이천시": "경기",
    "Icheon": "경기",
    "안성시": "경기",
    "Anseong": "경기",
    "구리시": "경기",
    "Guri": "경기",
    "포천시": "경기",
    "Pocheon": "경기",
    "의왕시": "경기",
    "Uiwang": "경기",
    "양평군": "경기",
    "Yangpyeong": "경기",
    "여주시": "경기",
    "Yeoju": "경기",
    "동두천시": "경기",
    "Dongducheon": "경기",
    "가평군": "경기",
    "Gapyeong": "경기",
    "과천시": "경기",
    "Gwacheon": "경기",
    "연천군": "경기",
    "Yeoncheon": "경기",
    "춘천시": "강원",
    "Chuncheon": "강원",
    "원주시": "강원",
    "Wonju": "강원",
    "강릉시": "강원",
    "Gangneung": "강원",
    "동해시": "강원",
    "Donghae": "강원",
    "태백시": "강원",
    "Taebaek": "강원",
    "속초시": "강원",
    "Sokcho": "강원",
    "삼척시": "강원",
    "Samcheok": "강원",
}


# --- addresses ----------------------------------------------------------------------------------


def gazetteer_match(df: DataFrame, gazetteer: DataFrame, column: str = "address") -> DataFrame:
    """Add x and y from a gazetteer (address, x, y): the full text first, then ever shorter prefixes.

    Distinct addresses are resolved once; only (address, x, y) meets the rows again. Coordinates a row
    already has stay.
    """
    known = gazetteer.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        F.col("address").alias("_text"), F.struct("x", "y").alias("_at")
    )
    distinct = df.select(F.col(column).alias("_address")).where(F.col("_address") != "").distinct()
    candidates = distinct.select("_address", F.explode(text.address_candidates(F.col("_address"))).alias("_c"))
    hits = (
        candidates.select("_address", "_c.priority", F.col("_c.text").alias("_text"))
        .join(known, "_text")
        .groupBy("_address")
        .agg(F.min_by("_at", F.struct("priority", "_at")).alias("_at"))
    )
    # A text may stand in any number of rows, or be missing in most.
    looked_up = df.withColumn("_address", F.col(column))
    joined = salted_join(looked_up, hits, ["_address"], how="left").drop("_address")
    has = {c: F.col(c) if c in df.columns else F.lit(None).cast("double") for c in ("x", "y")}
    own = has["x"].isNotNull() & has["y"].isNotNull()
    return joined.withColumns({c: F.when(own, has[c]).otherwise(F.coalesce(F.col("_at")[c], has[c])) for c in ("x", "y")}).drop("_at")


# --- regions ------------------------------------------------------------------------------------


def coordinate_key(x: Column, y: Column, language: str = "ko") -> Column:
    return F.format_string("%.6f,%.6f_" + language, y, x)


def region_lookup(region_map: DataFrame) -> Column:
    """The region map (one row per region name, a few dozen) as a map, by scalar subquery."""
    return scalar(region_map, F.map_from_entries(F.collect_list(F.struct("k", "short"))))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def infer_region(city: Column, lookup: Column) -> Column:
    """Region of a well-known city, under the name the map gives it."""
    return F.try_element_at(lookup, F.try_element_at(_literal_map(CITY_REGION), text.strip(city)))


def strip_admin_suffix(name: Column, lookup: Column) -> Column:
    """Standard name of a region: as it is, without an official ending, or from English; else unchanged."""
    stripped = text.strip(name)
    tries = [F.try_element_at(lookup, stripped)]
    for suffix in REGION_SUFFIXES:
        shorter = text.strip(F.left(stripped, F.length(stripped) - len(suffix)))
        tries.append(F.when(F.endswith(stripped, F.lit(suffix)), F.try_element_at(lookup, shorter)))
    for english, local in ENGLISH_REGIONS.items():
        hit = (stripped == english) | F.startswith(stripped, F.lit(english + " "))
        tries.append(F.when(hit, F.try_element_at(lookup, F.lit(local))))
    return F.coalesce(*tries, name)


def _any(predicates: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in predicates:
        out = out | p
    return out


def region_levels(df: DataFrame, region_map: DataFrame) -> DataFrame:
    """Add region_1 (region) and region_2 (city, county or district) from address parts.

    Expects the columns state, province, region, city, county, municipality, district, town, village, suburb.
    """
    lookup = region_lookup(region_map)
    city = F.coalesce(F.col("city"), F.lit(""))
    special_city = city.isin(*SPECIAL_CITIES)
    special_start = _any([F.startswith(city, F.lit(s)) for s in SPECIAL_CITIES])
    raw = F.coalesce(
        _first_filled(F.col("state"), F.col("province"), F.col("region")),
        F.when(special_start, city),
        infer_region(city, lookup),
        F.lit(""),
    )
    out = df.withColumn("_raw", raw).withColumn("_std", strip_admin_suffix(F.col("_raw"), lookup))
    exact = F.try_element_at(lookup, F.col("_raw"))
    marked = _any([F.contains(F.col("_raw"), F.lit(m)) for m in REGION_MARKS])
    level1 = F.coalesce(exact, F.when((F.col("_std") != F.col("_raw")) | marked, F.col("_std")), F.lit(""))
    parts = {c: F.col(c) for c in ("city", "county", "municipality", "district", "town", "village", "suburb")}

    def first_of(*names: str) -> Column:
        return F.coalesce(_first_filled(*[parts[n] for n in names]), F.lit(""))

    names_special = special_city | _any([F.contains(F.col("_raw"), F.lit(s)) for s in SPECIAL_CITIES])
    level2 = (
        F.when(F.col("region_1") == "", first_of("city", "county", "municipality", "district", "town", "village"))
        .when(names_special, first_of("district", "suburb", "county", "town"))
        .otherwise(first_of("city", "county", "municipality", "district", "town"))
    )
    return out.withColumn("region_1", level1).withColumn("region_2", level2).drop("_raw", "_std")


def reverse_match(points: DataFrame, addresses: DataFrame, region_map: DataFrame, language: str = "ko") -> DataFrame:
    """Add region_1 and region_2 to points by their rounded coordinates.

    `addresses` has x, y and the address parts; its levels are resolved before the join, once per row.
    """
    table = region_levels(addresses, region_map).select(
        coordinate_key(F.col("x"), F.col("y"), language).alias("_key"), F.struct("region_1", "region_2").alias("_r")
    )
    one = table.groupBy("_key").agg(F.min("_r").alias("_r"))
    keyed = points.withColumn("_at", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), coordinate_key(F.col("x"), F.col("y"), language)))
    return (
        salted_join(keyed, one.withColumnRenamed("_key", "_at"), ["_at"], how="left")
        .withColumns({"region_1": F.col("_r.region_1"), "region_2": F.col("_r.region_2")})
        .drop("_at", "_r")
    )
