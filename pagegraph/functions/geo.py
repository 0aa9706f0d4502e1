"""Coordinate strings as column functions.

A coordinate link carries `params=lat_N_lon_E_key:value_...`, where each side is
degrees, degrees_minutes or degrees_minutes_seconds, or `lat;lon`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scale of a map by type of place.
SCALES = {
    "country": 10_000_000, "satellite": 10_000_000, "state": 3_000_000, "adm1st": 1_000_000, "adm2nd": 300_000, "adm3rd": 100_000, "city": 100_000, "mountain": 100_000, "isle": 100_000, "river": 100_000, "waterbody": 100_000,
    "forest": 50_000, "glacier": 50_000, "event": 50_000, "airport": 30_000, "railwaystation": 10_000, "edu": 10_000, "pass": 10_000, "camera": 10_000, "landmark": 10_000,
}

#: Points of the compass, clockwise from north.
COMPASS = "N NBE NNE NEBN NE NEBE ENE EBN E EBS ESE SEBE SE SEBS SSE SBE S SBW SSW SWBS SW SWBW WSW WBS W WBN WNW NWBW NW NWBN NNW NBW".split()

#: Points of the compass that are written wrongly, and what they mean.
HEADINGS = {
    "NNEBN": "NBE", "NNEBE": "NEBN", "ENEBN": "NEBE", "ENEBE": "EBN", "ESEBE": "EBS", "ESEBS": "SEBE", "SSEBE": "SEBS", "SSEBS": "SBE", "SSWBS": "SBW", "SSWBW": "SWBS", "WSWBS": "SWBW", "WSWBW": "WBS", "WNWBW": "WBN", "WNWBN": "NWBW", "NNWBW": "NWBN", "NNWBN": "NBW",
    "NNEBNE": "NEBN", "ENEBNE": "NEBE", "ESEBSE": "SEBE", "SSEBSE": "SEBS", "SSWBSW": "SWBS", "WSWBSW": "SWBW", "WNWBNW": "NWBW", "NNWBNW": "NWBN", "NEBNNE": "NEBN", "NEBENE": "NEBE", "SEBESE": "SEBE", "SEBSSE": "SEBS", "SWBSSW": "SWBS", "SWBWSW": "SWBW", "NWBWNW": "NWBW", "NWBNNW": "NWBN",
    "NEN": "NEBN", "NEE": "NEBE", "SEE": "SEBE", "SES": "SEBS", "SWS": "SWBS", "SWW": "SWBW", "NWW": "NWBW", "NWN": "NWBN",
    "NBNE": "NEBN", "EBNE": "NEBE", "EBSE": "SEBE", "SBSE": "SEBS", "SBSW": "SWBS", "WBSW": "SWBW", "WBNW": "NWBW", "NBNW": "NWBN",
    "EN": "NE", "ES": "SE", "WS": "SW", "WN": "NW",
}

#: Types of places as they are misspelt, and regions that go by a code of their own.
TYPES = {
    "admin1st": "adm1st", "admin2nd": "adm2nd", "admin3rd": "adm3rd", "admin": "adm1st", "admin1": "adm1st", "admin2": "adm2nd", "admin3": "adm3rd", "adm": "adm1st", "adm1": "adm1st", "adm2": "adm2nd", "adm3": "adm3rd",
    "adm2st": "adm2nd", "adm3st": "adm3rd", "adm1nd": "adm1st", "adm3nd": "adm3rd", "adm1rd": "adm1st", "adm2rd": "adm2nd",
    "montain": "mountain", "buildings": "building", "railwaystationstation": "railwaystation", "station": "railwaystation", "lake": "waterbody", "water": "waterbody",
}
REGIONS = {
    "CN-71": "TW", "CN-91": "HK", "CN-92": "MO", "FI-AL": "AX", "FR-BL": "BL", "FR-GF": "GF", "FR-GP": "GP", "FR-MF": "MF", "FR-MQ": "MQ", "FR-NC": "NC", "FR-PF": "PF", "FR-PM": "PM", "FR-RE": "RE", "FR-TF": "TF", "FR-WF": "WF", "FR-YT": "YT",
    "NL-AW": "AW", "NL-BQ1": "BQ", "NL-BQ2": "BQ", "NL-BQ3": "BQ", "NL-CW": "CW", "NL-SX": "SX", "NO-21": "SJ", "NO-22": "SJ", "US-AS": "AS", "US-GU": "GU", "US-MP": "MP", "US-PR": "PR", "US-UM": "UM", "US-VI": "VI", "FX": "FR", "UK": "GB", "SF": "FI", "YU": "CS",
}

GLOBES = ("earth", "moon", "mars", "mercury", "venus", "ceres", "io", "europa", "ganymede", "callisto", "titan", "phobos", "deimos", "triton", "pluto", "charon", "vesta")

_SIDE = r"(-?\d+(?:\.\d+)?)(?:_(\d+(?:\.\d+)?))?(?:_(\d+(?:\.\d+)?))?"
_PAIR = rf"^_*{_SIDE}_([NSZ])_{_SIDE}_([EWO])(?:_|$)"


def params_of(url: Column) -> Column:
    """The params value of a link, blanks and plus signs as underscores."""
    raw = F.regexp_extract(url, r"[?&]params=([^&#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("_"))), raw)
    return F.when(raw != "", F.regexp_replace(decoded, r"[\s_]+", "_"))


def _number(t: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(t, pattern, i).try_cast("double")


def latlon(params: Column) -> Column:
    """struct(lat, lon), both null where the string holds no place on a globe. Parts are worked out once, then named."""
    d = r"^_*(-?\d+(?:\.\d+)?);_*(-?\d+(?:\.\d+)?)(?:_|$)"

    def size(s, negative):
        parts = F.abs(s["deg"]) + s["minute"] / 60 + s["sec"] / 3600
        bad = (s["minute"] >= 60) | (s["sec"] >= 60)
        sign = F.when(s["letter"].isin(*negative) != (s["deg"] < 0), -1).otherwise(1)
        return F.when(~bad, F.round(sign * parts, 9))

    def side(p, first, letter, negative):
        deg, minute, sec = (_number(p, _PAIR, first + i) for i in range(3))
        zero = F.lit(0.0)
        return _once(F.struct(deg.alias("deg"), F.coalesce(minute, zero).alias("minute"), F.coalesce(sec, zero).alias("sec"), F.regexp_extract(p, _PAIR, letter).alias("letter")), lambda s: size(s, negative))

    def sides(p):
        pair = F.struct(side(p, 1, 4, ("S", "Z")).alias("lat"), side(p, 5, 8, ("W",)).alias("lon"))
        return F.when(p.rlike(_PAIR), pair).when(p.rlike(d), F.struct(_number(p, d, 1).alias("lat"), _number(p, d, 2).alias("lon")))

    def place(a):
        lat, lon = a["lat"], a["lon"]
        ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 360)
        lon = F.when(lon > 180, lon - 360).when(lon <= -180, lon + 360).otherwise(lon)
        return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))

    return _once(params, lambda p: _once(sides(p), place))


def digits(params: Column) -> Column:
    """Decimal places of the latitude's last part."""
    part = F.regexp_extract(params, r"^_*([-0-9._;]+?)_*(?:[NSZ]|;)", 1)
    return F.length(F.regexp_extract(part, r"\.(\d+)_?$", 1))


def attribute(params: Column, key: str) -> Column:
    """The value behind `key:`, or null. A value ends at the next known key, so regions and sources may hold underscores."""
    keys = "type|region|globe|source|scale|dim|heading|alt|elevation|class|name|zoom"
    got = F.regexp_extract(params, rf"(?:^|_){key}:(.*?)(?=_(?:{keys}):|$)", 1)
    return _once(got, lambda g: F.when(g != "", F.regexp_replace(g, "_+$", "")))


def _once(value: Column, use) -> Column:
    """use(value), where the value is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def corrected(value: Column, corrections: dict[str, str]) -> Column:
    """A value, or what it is corrected to."""
    m = F.create_map(*[F.lit(x) for kv in corrections.items() for x in kv])
    return _once(value, lambda v: F.coalesce(F.try_element_at(m, v), v))


def place_type(params: Column) -> Column:
    """struct(type, size): city(1000) has the size 1000, if that is up to 70 million; misspelt types are corrected."""

    def parts(raw):
        size = F.regexp_extract(raw, r"\(([\d.,]+)\)", 1)
        number = F.regexp_replace(size, ",", "").try_cast("double")
        kind = F.regexp_replace(F.regexp_replace(raw, r"\(.*$", ""), r"\W.*$", "")
        return F.struct(corrected(kind, TYPES).alias("type"), _once(number, lambda n: F.when(n.between(0, 70e6), n)).alias("size"))

    return _once(F.lower(attribute(params, "type")), parts)


def metres(value: Column) -> Column:
    """A length such as 5, 5m, 5km, 3mi or 100ft in metres."""

    def by(length):
        n, unit = length["n"], length["unit"]
        return F.when(unit.isin("", "m"), n).when(unit == "km", n * 1000).when(unit == "mi", n * 1609.344).when(unit == "ft", n * 0.3048)

    def read(v):
        n = F.regexp_extract(v, r"^([\d.]+)", 1).try_cast("double")
        return F.struct(n.alias("n"), F.lower(F.regexp_extract(v, r"^[\d.]+\s*([A-Za-z]*)", 1)).alias("unit"))

    return _once(value, lambda v: _once(read(v), by))


def heading(value: Column) -> Column:
    """Degrees of a number or of a point of the compass, abbreviated, spelt out, with O for east or boxed wrongly."""

    def point(v):
        up = F.upper(v)
        for old, new in (("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W"), ("BY", "B"), ("-", ""), ("O", "E")):
            up = F.replace(up, F.lit(old), F.lit(new))
        at = F.array_position(F.array(*[F.lit(c) for c in COMPASS]), corrected(up, HEADINGS))
        return _once(at, lambda i: F.when(i > 0, (i - 1) * 11.25))

    return _once(value, lambda v: _once(v.try_cast("double"), lambda n: F.when(n.isNotNull(), F.pmod(n, F.lit(360.0))).otherwise(point(v))))


def scale(params: Column, kind: Column) -> Column:
    """The scale given, else that of the zoom level, else that of the type of place."""
    zoom = attribute(params, "zoom").try_cast("int")
    return F.coalesce(attribute(params, "scale").try_cast("long"), (100_000 * F.pow(F.lit(2.0), 12 - zoom)).cast("long"), default_scale(kind).cast("long"))


def default_scale(kind: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, kind), F.lit(50_000))


def geolink(url: Column) -> Column:
    """All parts of a coordinate link, with warnings."""

    def parts(p: Column) -> Column:
        return F.struct(
            p.alias("p"), latlon(p).alias("at"), place_type(p).alias("kind"), corrected(F.upper(attribute(p, "region")), REGIONS).alias("region"), F.coalesce(F.lower(attribute(p, "globe")), F.lit("earth")).alias("globe"),
            metres(attribute(p, "dim")).alias("dim"), attribute(p, "scale").try_cast("double").alias("given"),
        )

    def whole(a: Column) -> Column:
        p, kind, region, globe, dim = a["p"], a["kind"]["type"], a["region"], a["globe"], a["dim"]
        warnings = F.array_compact(F.array(
            F.when(p.isNull(), "no params"), F.when(p.isNotNull() & a["at"]["lat"].isNull(), "no coordinate"), F.when(~globe.isin(*GLOBES), "unknown globe"),
            F.when(region.isNotNull() & ~region.rlike(r"^[A-Z]{2}(?:-[A-Z0-9]{1,3})?$"), "odd region"), F.when(kind.isNotNull() & ~kind.isin(*SCALES), "unknown type"),
            F.when(region.isNotNull() & (globe != "earth"), "region on another globe"), F.when((dim <= 0) | (dim >= 40_000_000), "dim out of range"), F.when(a["given"] != dim * 10, "dim beside another scale"),
        ))
        return F.struct(
            a["at"]["lat"].alias("lat"), a["at"]["lon"].alias("lon"), kind.alias("type"), a["kind"]["size"].alias("size"), region.alias("region"), globe.alias("globe"), attribute(p, "source").alias("source"),
            scale(p, kind).alias("scale"), dim.alias("dim"), heading(attribute(p, "heading")).alias("heading"), metres(F.coalesce(attribute(p, "alt"), attribute(p, "elevation"))).alias("elevation"),
            digits(p).alias("digits"), warnings.alias("warnings"),
        )

    return _once(params_of(url), lambda p: _once(parts(p), whole))


def emit(lat: Column, lon: Column, kind: Column, region: Column) -> Column:
    """The params string of a place, to five decimal places."""

    def side(x, plus, minus):
        digits_ = F.regexp_replace(F.format_string("%.5f", F.abs(x)), r"\.?0+$", "")
        return F.concat(digits_, F.when(x < 0, minus).otherwise(plus))

    parts = [side(lat, "_N", "_S"), side(lon, "_E", "_W"), F.when(kind.isNotNull(), F.concat(F.lit("type:"), kind)), F.when(region.isNotNull(), F.concat(F.lit("region:"), region))]
    return F.concat_ws("_", *parts)


def template(lat: Column, lon: Column, kind: Column, region: Column, display: str = "title") -> Column:
    """A place as a coordinate template."""
    place = emit(lat, lon, kind, region)
    sides = F.regexp_replace(F.regexp_extract(place, "^([^_]+_[NS]_[^_]+_[EW])", 1), "_", "|")
    rest = F.regexp_replace(place, "^[^_]+_[NS]_[^_]+_[EW]_?", "")
    return F.concat(F.lit("{{coord|"), sides, F.when(rest != "", F.concat(F.lit("|"), rest)).otherwise(""), F.lit(f"|display={display}}}}}"))
