"""Column builders that format values or read semi-structured text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_col

# --- fixed values: address keys in order of preference ----------------------
LOCAL_KEYS = [
    "hamlet",
    "locality",
    "neighbourhood",
    "suburb",
    "quarter",
    "village",
    "settlement",
    "road",
    "residential",
]
MUNICIPALITY_KEYS = ["municipality", "city", "town", "county", "state_district"]
DISTRICT_KEYS = ["district", "county", "state_district"]
PROVINCE_KEYS = ["state", "province"]

ADDRESS_SCHEMA = "address map<string,string>, name string, display_name string"


def first_present(mapping: Column | str, keys: list[str]) -> Column:
    """First value over ``keys`` that is neither missing nor empty."""
    m = as_col(mapping)
    return F.coalesce(*[F.nullif(m[key], F.lit("")) for key in keys])


def place_document(payload: Column | str) -> Column:
    """One geocoder answer (JSON text), parsed."""
    return F.from_json(as_col(payload), ADDRESS_SCHEMA)


def place_fields(payload: Column | str, default_place: str, parsed: bool = False) -> dict[str, Column]:
    """Place columns of one geocoder answer (JSON text, or ``parsed`` by ``place_document``).

    Each use of the columns parses a text again; many rows are better parsed in a column of their own first.
    """
    doc = as_col(payload) if parsed else place_document(payload)
    address = doc["address"]
    local = first_present(address, LOCAL_KEYS)
    municipality = first_present(address, MUNICIPALITY_KEYS)
    fallback = F.coalesce(F.nullif(doc["name"], F.lit("")), F.nullif(doc["display_name"], F.lit("")))
    place = F.coalesce(local, fallback, municipality, F.lit(default_place))
    return {
        "place": place,
        "local_name": local,
        "municipality": municipality,
        "district": first_present(address, DISTRICT_KEYS),
        "province": first_present(address, PROVINCE_KEYS),
        "display_name": F.coalesce(doc["display_name"], place),
    }


def geo_cache_key(lat: Column | str, lon: Column | str, digits: int = 4) -> tuple[Column, Column]:
    """Half-even rounded coordinates under which one lookup is shared."""
    return F.bround(as_col(lat), digits), F.bround(as_col(lon), digits)


def fixed(value: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", as_col(value).cast("double"))


def format_percent(value: Column | str) -> Column:
    """Two decimals for shares below one percent, else one."""
    v = F.coalesce(as_col(value).cast("double"), F.lit(0.0))
    return F.concat(F.when((v > 0) & (v < 1), fixed(v, 2)).otherwise(fixed(v, 1)), F.lit("%"))


def alert_level(high_severe: Column | str, severe: Column | str, trigger: Column | str, rain72: Column | str) -> Column:
    """Struct of level, title, colour and reason of one run."""
    high, sev, trig, rain = (
        F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in (high_severe, severe, trigger, rain72)
    )

    def level(name: str, title: str, color: str, reason: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), F.lit(title).alias("title"), F.lit(color).alias("color"), reason.alias("reason")
        )

    # --- fixed values: titles, colours and reason texts ----------------------
    elevated = level(
        "Elevated",
        "High attention needed",
        "#d7191c",
        F.concat(
            F.lit("The current rainfall trigger reaches "),
            fixed(trig, 2),
            F.lit(" and "),
            format_percent(high),
            F.lit(" of the district is in high or severe dynamic warning."),
        ),
    )
    watch = level(
        "Watch",
        "Rainfall is lifting risk in susceptible terrain",
        "#f97316",
        F.concat(
            F.lit("The strongest 72h rainfall total is "),
            fixed(rain, 1),
            F.lit(
                " mm. The map should be inspected around high-susceptibility slopes touched by the wetter sample points."
            ),
        ),
    )
    normal = level(
        "Normal",
        "No broad warning spike in this run",
        "#0f766e",
        F.concat(
            F.lit("Recent rainfall is present, but only "),
            format_percent(high),
            F.lit(" of the district is currently mapped as high or severe dynamic warning."),
        ),
    )
    is_elevated = (sev >= 1) | (high >= 12) | (trig >= F.lit(0.6))
    is_watch = (high >= 5) | (trig >= F.lit(0.3)) | (rain >= 60)
    return F.when(is_elevated, elevated).when(is_watch, watch).otherwise(normal)


def hex_channel(color: Column | str, start: int) -> Column:
    """One 0-255 channel of a ``#rrggbb`` colour; ``start`` is 2, 4 or 6."""
    return F.conv(F.substring(as_col(color), start, 2), 16, 10).cast("int")
