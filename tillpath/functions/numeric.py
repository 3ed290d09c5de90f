"""Rounding, ratios and hashed draws as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings


def half_up(x: Column, digits: int = 2) -> Column:
    """Round half away from zero, stated in arithmetic so that any engine gives the same double."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def ratio(top: Column, bottom: Column, digits: int = 2, times: float = 1.0) -> Column:
    """`times * top / bottom`, rounded; NULL for a zero denominator."""
    value = F.try_divide(top.cast("double") * F.lit(float(times)), bottom.cast("double"))
    return half_up(value, digits)


def percent(top: Column, bottom: Column, digits: int = 2) -> Column:
    return ratio(top, bottom, digits, 100.0)


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt only, not on partitioning."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def weighted_choice(key: Column, salt: str, shares: dict[str, float]) -> Column:
    """A category per key, drawn with the given shares; the same key always gets the same one."""
    draw = unit_hash(key, salt)
    names = list(shares)
    choice, reached = None, 0.0
    for name in names[:-1]:
        reached = round(reached + shares[name], 10)
        test = draw < F.lit(reached)
        choice = F.when(test, F.lit(name)) if choice is None else choice.when(test, F.lit(name))
    return F.lit(names[-1]) if choice is None else choice.otherwise(F.lit(names[-1]))


def ntile(rank: Column, total: Column, groups: int) -> Column:
    """Group 1..`groups` of a row with that rank among `total` rows, sizes differing by one at most.

    The first `total mod groups` groups take one row more, as in the SQL function.
    """
    small = F.floor(total / groups)
    large = small + 1
    in_large = (total % groups) * large
    beyond = (total % groups) + F.ceil((rank - in_large) / F.greatest(small, F.lit(1)))
    return F.when(rank <= in_large, F.ceil(rank / large)).otherwise(beyond).cast("int")


def risk_tier(
    probability: Column, settings: Settings = DEFAULTS, *, right_closed: bool = False
) -> Column:
    """high / medium / low. `right_closed` puts a score on a bound into the lower tier."""
    def reaches(bound: float) -> Column:
        limit = F.lit(bound)
        return probability > limit if right_closed else probability >= limit

    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(reaches(settings.tier_high), "high")
        .when(reaches(settings.tier_medium), "medium")
        .otherwise("low")
    )
