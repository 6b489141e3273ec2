"""Date and time texts; ``now`` is always a parameter, so results are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import lenient_int

# Short names of the months.
MONTHS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
DAY_MS = 86_400_000


def day_month_year(ts: Column, zone: str = "UTC") -> Column:
    """dd/MM/yyyy of a UTC timestamp in the zone of the device."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "dd/MM/yyyy")


def published_date(iso: Column, zone: str = "UTC") -> Column:
    """dd/MM/yyyy of an ISO text; a text that is no time gives NaN/NaN/NaN."""
    return F.coalesce(day_month_year(F.try_to_timestamp(iso), zone), F.lit("NaN/NaN/NaN"))


def date_of_ms(ms: Column, zone: str = "UTC") -> Column:
    return day_month_year(F.timestamp_millis(ms), zone)


def today(now_ms: int, zone: str = "UTC") -> Column:
    """dd/MM/yyyy of now where the device is."""
    return date_of_ms(F.lit(now_ms), zone)


def iso_of_ms(ms: Column) -> Column:
    """The ISO text of epoch milliseconds, in UTC whatever the session's zone."""
    days, rest = F.floor(ms / DAY_MS), F.pmod(ms, F.lit(DAY_MS))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3_600_000), two(rest / 60_000 % 60), two(rest / 1000 % 60))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    return F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"))


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def relative_days(ms: Column, now_ms: int) -> Column:
    """How long ago, in days, weeks, months of 30 days, and years of 12 such months."""
    d = F.floor((F.lit(now_ms) - ms) / DAY_MS)
    text = lambda n, unit: F.concat(F.lit("Há "), n.cast("string"), F.lit(f" {unit}"))
    months = F.floor(d / 30)
    years = F.floor(months / 12)
    return (
        F.when(d == 0, "Hoje")
        .when(d == 1, "Há 1 dia")
        .when(d < 7, text(d, "dias"))
        .when(d < 14, "Há 1 semana")
        .when(d < 30, text(F.floor(d / 7), "semanas"))
        .when(months == 1, "Há 1 mês")
        .when(months < 12, text(months, "meses"))
        .when(years == 1, "Há 1 ano")
        .otherwise(text(years, "anos"))
    )


def time_ago(ms: Column, now_ms: int) -> Column:
    """agora, minutes, hours or days; the future is now."""
    m = F.floor((F.lit(now_ms) - ms) / 60_000)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(m < 1, "agora").when(m < 60, text(m, "min")).when(m < 1440, text(m / 60, "h")).otherwise(text(m / 1440, "d"))


def day_label(date: Column) -> Column:
    """``d/M`` as ``d de Mmm``; a text whose day or month is none stays as it is."""
    parts = F.split(date, "/")
    d, m = lenient_int(F.get(parts, F.lit(0))), lenient_int(F.get(parts, F.lit(1)))
    name = F.when(m.between(1, 12), F.element_at(F.array(*[F.lit(x) for x in MONTHS]), m))
    return F.coalesce(F.when(d != 0, F.concat(d.cast("string"), F.lit(" de "), name)), date)


def with_month(date: Column, month: Column) -> Column:
    """``d/M`` with another month; no day gives day 1."""
    return F.concat(F.coalesce(F.nullif(F.get(F.split(date, "/"), F.lit(0)), F.lit("")), F.lit("1")), F.lit("/"), month.cast("string"))


def with_day(date: Column, day: Column, current_month: int) -> Column:
    """``d/M`` with another day; no month gives the current one."""
    month = F.coalesce(F.nullif(F.get(F.split(date, "/"), F.lit(1)), F.lit("")), F.lit(str(current_month)))
    return F.concat(day.cast("string"), F.lit("/"), month)


def published_meta(iso: Column, now_ms: int, zone: str = "UTC") -> Column:
    """Date and how long ago, of an ISO text."""
    return F.concat(published_date(iso, zone), F.lit(" • "), relative_days(F.unix_millis(F.try_to_timestamp(iso)), now_ms))
