"""Keys, names and numbers: series keys, taxon names, grid cells, counts, units, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def series_key(variable: Column, grain: Column, stat: Column, unit: Column) -> Column:
    """variable|grain|stat|unit with nulls as nothing."""
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (variable, grain, stat, unit)))


def basis_of(grain: Column, input_grain: Column) -> Column:
    """What a cell rests on: daily values, a month's worth that makes up a fiscal year, or what the source gives itself."""
    return F.when(input_grain == "day", "day").when(grain == "fiscal_year", "fiscal_year").otherwise("year")


def at_source_grain(grain: Column, input_grain: Column) -> Column:
    return (input_grain == grain) | ((input_grain == "month") & (grain == "fiscal_year"))


def binomial(name: Column) -> Column:
    """The first two words of a scientific name; null if there is only one."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", parts[0], F.get(parts, F.lit(1))))


def taxon_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


# Rank marks in scientific names.
_RANKS = ["subsp.", "ssp.", "var.", "f.", "forma", "cf.", "aff."]


def bare_name(name: Column) -> Column:
    """A scientific name without subgenus, author and rank marks."""
    out = F.regexp_replace(name, r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?<=\s)(?:" + "|".join(x.replace(".", r"\.") for x in _RANKS) + r")(?=\s|$)", " ")
    words = F.filter(F.split(F.trim(out), r"\s+"), lambda w: w != "")
    return F.array_join(F.concat(F.slice(words, 1, 1), F.filter(F.slice(words, 2, 100), lambda w: w.rlike(r"^[a-z][a-z-]*$"))), " ")


def grid_id(lat: Column, lon: Column, scale: int = 100) -> Column:
    """The cell of 0.01 degrees; floor, so that negative coordinates fall into the cell below."""
    return F.concat(F.lit("grid01:"), F.floor(lat * scale).cast("string"), F.lit(","), F.floor(lon * scale).cast("string"))


def grid_of_place(place: Column) -> Column:
    """struct(lat, lon) of the lower left corner of a place id 'common:place:grid01.3520_13900'."""
    return F.struct((F.regexp_extract(place, r"grid01\.(-?\d+)_(-?\d+)$", 1).try_cast("double") / 100).alias("lat"), (F.regexp_extract(place, r"grid01\.(-?\d+)_(-?\d+)$", 2).try_cast("double") / 100).alias("lon"))


def square(lat: Column, lon: Column, side: float = 0.01) -> Column:
    """The closed ring of a cell's corners, as (lon, lat) pairs."""
    corner = lambda dx, dy: F.array(lon + F.lit(dx), lat + F.lit(dy))
    return F.array(corner(0.0, 0.0), corner(side, 0.0), corner(side, side), corner(0.0, side), corner(0.0, 0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def mercator_pixel(lat: Column, lon: Column, zoom: int, tile: int = 256) -> Column:
    """struct(x, y) in pixels of the Web Mercator plane."""
    size = float(tile << zoom)
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2 * size
    return F.struct(((lon + 180) / 360 * size).alias("x"), y.alias("y"))


def number_of(text: Column) -> Column:
    """A number with full-width digits, separators and surrounding text marks removed; null if it isn't one."""
    plain = F.translate(text, "０１２３４５６７８９．，－＋", "0123456789.,-+")
    return F.regexp_replace(F.trim(plain), r"[,\s]", "").try_cast("double")


def count_pair(text: Column) -> Column:
    """struct(count, inner) of 'a(b)' or 'a'."""
    plain = F.translate(text, "０１２３４５６７８９（）", "0123456789()")
    pattern = r"^\s*([\d,]+)\s*(?:\(\s*([\d,]+)\s*\))?\s*$"
    part = lambda i: F.regexp_replace(F.regexp_extract(plain, pattern, i), ",", "").try_cast("long")
    return F.struct(part(1).alias("count"), part(2).alias("inner"))


def row_label(key: Column) -> Column:
    """The part of a row key after the last bar; the whole key if that part is empty."""
    last = F.trim(F.substring_index(key, "|", -1))
    return F.when(last != "", last).otherwise(key)


def escaped_id(text: Column) -> Column:
    """A reversible id: every byte but letters, digits, '_', '.' and '-' as %XX."""
    hexed = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    plain = lambda h: F.decode(F.unhex(h), "UTF-8")
    safe = r"^(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|5F|2E|2D)$"
    return F.array_join(F.transform(hexed, lambda h: F.when(h.rlike(safe), plain(h)).otherwise(F.concat(F.lit("%"), h))), "")


def weakest(rank: list[str], *values: Column) -> Column:
    """Of values the one that stands last in `rank`, best first. A null or a value that isn't in it counts as the last name of `rank`, as does having no values."""
    names = F.array(*map(F.lit, rank))
    # array_position counts from 1 and gives 0 for what isn't there, null for a null.
    places = [F.coalesce(F.nullif(F.array_position(names, c), F.lit(0)).cast("int"), F.lit(len(rank))) for c in values]
    return F.element_at(names, F.greatest(*places) if len(places) > 1 else places[0] if places else F.lit(len(rank)))


def first_rule(rules: list[tuple[Column, str]], default: Column) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(test, name) for test, name in rules), default)


def canonical_value(value: Column, scale: Column) -> Column:
    """A value in the canonical unit; without a known scale it stays as it is."""
    return value * F.coalesce(scale, F.lit(1.0))


def significant(value: Column, digits: int = 12) -> Column:
    """A double rounded to so many significant digits."""
    power = F.lit(digits - 1) - F.floor(F.log10(F.abs(value)))
    scaled = F.pow(F.lit(10.0), power)
    return F.when((value == 0) | value.isNull(), value).otherwise(F.round(value * scaled) / scaled)


def picked_label(*candidates: Column) -> Column:
    """The first label that isn't null or blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))


def direction(before: Column, now: Column) -> Column:
    """How a rank, 1 the most severe, has moved. Without a rank before it is new; one that has none now counts as unmoved."""
    return F.when(before.isNull(), "new").when(now < before, "up").when(now > before, "down").otherwise("same")


def coordinate_uncertainty(decimals: Column) -> Column:
    """Metres that a coordinate with so many decimals may be off."""
    return F.pow(F.lit(10.0), F.lit(5) - decimals)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


# What one of a unit of area is in hectares, one of a unit of money in yen.
HECTARES = {"ha": 1.0, "ヘクタール": 1.0, "km2": 100.0, "km²": 100.0, "平方キロメートル": 100.0, "m2": 0.0001, "㎡": 0.0001, "a": 0.01}
YEN = {"円": 1.0, "千円": 1e3, "万円": 1e4, "百万円": 1e6, "億円": 1e8}


def in_unit(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """A value in the common unit of `factors`; null for a unit that isn't listed."""
    listed = F.create_map(*(F.lit(x) for pair in factors.items() for x in pair))
    return value * F.element_at(listed, F.trim(unit))


def license_class(text: Column) -> Column:
    """'open', 'noncommercial', 'restricted' or 'unknown' of a licence's name or address.

    Open are CC0, the public domain and CC BY; NC makes a licence noncommercial, whatever stands beside it; SA or ND alone, which allow
    commercial use under conditions, make it restricted. Everything else is unknown, all rights reserved included.
    """
    plain = F.regexp_replace(F.lower(F.trim(text)), r"^https?://(?:www\.)?creativecommons\.org/(?:licenses|publicdomain)/", "cc-")
    cc = F.regexp_extract(F.regexp_replace(plain, r"[_ /]+", "-"), r"^(?:cc-)?(zero|cc0|pdm|mark|by(?:-nc)?(?:-(?:sa|nd))?)(?:-\d.*)?-?$", 1)
    return F.when(cc.contains("-nc"), "noncommercial").when(cc.rlike("-(?:sa|nd)$"), "restricted").when(cc != "", "open").otherwise("unknown")


#: Metres of uncertainty from which on a record is withheld from places.
WITHHELD_M = 10_000


def withheld(uncertainty_m: Column) -> Column:
    """Whether a record is too vague to be assigned to a place; an unknown uncertainty withholds nothing."""
    return F.coalesce(uncertainty_m >= WITHHELD_M, F.lit(False))


def mixed_order(value: Column) -> Column:
    """A sort key of texts of which some are numbers: numbers first, by value, then all others by code point."""
    number = value.try_cast("double")
    return F.struct(number.isNull().alias("text"), number.alias("number"), value.alias("value"))
