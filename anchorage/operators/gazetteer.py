"""Places and what lies in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Postal abbreviations of the states of the USA.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas",
    "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming",
}


def containment(city_in: DataFrame) -> DataFrame:
    """city_in(container, city, kind) -> (container, kind, cities)."""
    return city_in.groupBy("container", "kind").agg(F.sort_array(F.collect_set("city")).alias("cities"))


def place_flags(names: DataFrame, name: str, places: DataFrame) -> DataFrame:
    """Adds is_city, is_state, is_country of the lower-cased name; places(name_lc, kind)."""
    kinds = places.groupBy(F.col("name_lc").alias("__lc")).agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"__{k}") for k in ("city", "state", "country")])
    out = names.join(kinds, F.lower(name) == F.col("__lc"), "left")
    return out.withColumns({f"is_{k}": F.coalesce(F.col(f"__{k}") == 1, F.lit(False)) for k in ("city", "state", "country")}).drop("__lc", "__city", "__state", "__country")


def same_kind(a: str, b: str) -> Column:
    """Whether two flagged sides (prefixes of flag columns) are both cities, both states or both countries."""
    return (F.col(f"{a}_city") & F.col(f"{b}_city")) | (F.col(f"{a}_state") & F.col(f"{b}_state")) | (F.col(f"{a}_country") & F.col(f"{b}_country"))


def in_container(pairs: DataFrame, city_in: DataFrame) -> DataFrame:
    """pairs(container, city, ...): those the gazetteer confirms."""
    return pairs.join(city_in.select("container", "city"), ["container", "city"], "left_semi")


def known_places(names: DataFrame, name: str, places: DataFrame) -> DataFrame:
    return names.join(places.select(F.col("name_lc").alias("__lc")).distinct(), F.lower(name) == F.col("__lc"), "left_semi")


def expand_state(text: Column) -> Column:
    """'City, St.' with a postal abbreviation -> 'City, State', of the city's last word; else the text."""
    pattern = r"(\w+),\s([A-Za-z])\.?([A-Za-z])\.?$"
    code = F.upper(F.concat(F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)))
    state = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), code)
    return F.when(text.rlike(pattern) & state.isNotNull(), F.concat(F.regexp_extract(text, pattern, 1), F.lit(", "), state)).otherwise(text)


def expand_prefix(rows: DataFrame, text: str, states: DataFrame) -> DataFrame:
    """Adds `expanded`: a state, of states(state), that starts with the text but its full stop, if over two letters; the first by name."""
    stem = F.regexp_replace(text, r"\.$", "")
    s = states.select(F.col("state").alias("__state"))
    met = rows.select(F.col(text).alias("__t"), stem.alias("__stem")).distinct().where(F.length("__stem") > 2)
    first = met.join(s, F.startswith("__state", F.col("__stem"))).groupBy("__t").agg(F.min("__state").alias("expanded"))
    return rows.join(first, F.col(text) == F.col("__t"), "left").drop("__t")
