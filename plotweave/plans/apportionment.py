"""Seats and tiers of the states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# House seats by state under the 2020 census apportionment (U.S. Census Bureau).
DISTRICTS_2020 = {
    "AL": 7, "AK": 1, "AZ": 9, "AR": 4, "CA": 52, "CO": 8, "CT": 5, "DE": 1, "FL": 28, "GA": 14,
    "HI": 2, "ID": 2, "IL": 17, "IN": 9, "IA": 4, "KS": 4, "KY": 6, "LA": 6, "ME": 2, "MD": 8,
    "MA": 9, "MI": 13, "MN": 8, "MS": 4, "MO": 8, "MT": 2, "NE": 3, "NV": 4, "NH": 2, "NJ": 12,
    "NM": 3, "NY": 26, "NC": 14, "ND": 1, "OH": 15, "OK": 5, "OR": 6, "PA": 17, "RI": 2, "SC": 7,
    "SD": 1, "TN": 9, "TX": 38, "UT": 4, "VT": 1, "VA": 11, "WA": 10, "WV": 2, "WI": 8, "WY": 1,
}
# The batches of states by difficulty.
TIERS = {
    "easy": ["ID", "MT", "NH", "WV", "NE", "NM", "AR", "IA", "KS", "NV", "UT", "OK", "KY", "AL", "AZ", "IN", "TN",
             "CO", "MN", "MO", "WI"],
    "middle": ["HI", "ME", "RI", "CT", "MS", "OR", "MD", "MA", "WA", "VA", "NJ", "SC", "LA", "GA"],
    "tough": ["MI", "NC", "OH", "IL", "PA", "NY", "FL", "TX", "CA"],
}


def districts_for(state_code: str) -> int:
    """Seats of a state, in any case of letters; ValueError for an unknown code."""
    try:
        return DISTRICTS_2020[state_code.upper()]
    except KeyError:
        raise ValueError(f"Unknown state code: {state_code!r}") from None


def tier_for(state_code: str) -> str | None:
    return next((tier for tier, states in TIERS.items() if state_code in states), None)


def states_of(tier: str | None, states: str | list[str] | None) -> list[str]:
    """The states of one tier, of ``all``, or of a list, exactly one of which must be given."""
    if (tier is None) == (states is None):
        raise ValueError("give either a tier or a list of states")
    if tier == "all":
        return [s for t in TIERS.values() for s in t]
    if tier is not None:
        if tier not in TIERS:
            raise ValueError(f"Unknown tier: {tier!r}")
        return list(TIERS[tier])
    codes = states.split(",") if isinstance(states, str) else states
    return [c.strip().upper() for c in codes if c.strip()]


def seats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DISTRICTS_2020.items()), "state_code string, districts int")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for t, ss in TIERS.items() for s in ss], "state_code string, tier string")


def with_seats(df: DataFrame) -> DataFrame:
    """Join seats by state in any case; unknown states get null (see :func:`unknown_states`)."""
    return df.join(F.broadcast(seats(df.sparkSession).withColumnRenamed("state_code", "__s")),
                   F.upper("state_code") == F.col("__s"), "left").drop("__s")


def unknown_states(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(seats(df.sparkSession).withColumnRenamed("state_code", "__s")),
                   F.upper("state_code") == F.col("__s"), "left_anti")
