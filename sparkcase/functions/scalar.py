"""Time, money, bands and intervals as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed illustrative rates: units of a currency for one US dollar.
UNITS_PER_USD = {"USD": 1.0, "GBP": 0.8, "EUR": 0.92, "INR": 83.0, "AED": 3.67, "SGD": 1.35, "CAD": 1.36, "AUD": 1.5}
#: Transaction types that send money.
OUTGOING = ("transfer_out", "payment", "withdrawal")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a time-zone-free timestamp since 1970, whatever the session's zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + clock


def epoch_micros(ts: Column) -> Column:
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    minutes = F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + second


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def cents(amount: Column) -> Column:
    """Whole cents, halves to even."""
    return F.rint(amount * 100).cast("long")


def to_usd(amount: Column, currency: Column, rates: Mapping[str, float] = UNITS_PER_USD) -> Column:
    """Amount in dollars; null for a currency without a rate."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return amount / F.element_at(table, currency)


def counterparty(kind: Column, sender: Column, receiver: Column) -> Column:
    return F.when(kind.isin(*OUTGOING), receiver).otherwise(sender)


def band(value: Column, high: float = 0.75, medium: float = 0.65) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """The place (from 1) of an ordered name; null for others."""
    return F.coalesce(*[F.when(value == name, F.lit(i + 1)) for i, name in enumerate(order)])


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share; 0 and 1 where there is nothing to count."""
    p, some = hits / n, n > 0
    middle, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    low = F.when(some, F.greatest(F.lit(0.0), (middle - spread) / scale)).otherwise(F.lit(0.0))
    return low, F.when(some, F.least(F.lit(1.0), (middle + spread) / scale)).otherwise(F.lit(1.0))


SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$"
PAYLOAD_CHARS = 1500


def iso_time(ts: Column) -> Column:
    """A time as ISO text, with a fraction only where it has one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def safe_id(x: Column) -> Column:
    """An id that may stand in a prompt as it is, else null."""
    return F.when(x.rlike(SAFE_ID), x)


def payload(x: Column, most: int = PAYLOAD_CHARS) -> Column:
    """The first characters of a payload, with a mark where some are left out."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("…"))).otherwise(x)


def percent_text(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", (x * 100).cast("double"))


def duration_text(seconds: Column) -> Column:
    """Seconds as "d days, h:mm:ss"; without days where there are none."""
    s = seconds.cast("long")
    day, rest = F.floor(s / 86_400), F.pmod(s, F.lit(86_400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    days = F.concat(day.cast("string"), F.when(F.abs(day) == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    return F.when(day == 0, clock).otherwise(F.concat(days, clock))


def amount_text(x: Column, signed: bool = False) -> Column:
    """A number with two decimals, half to even as decimals round, with its sign if asked for."""
    text = F.bround(x.cast("decimal(30,6)"), 2).cast("decimal(30,2)").cast("string")
    return F.when(x >= 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text
