"""Kickoff parsing, season labels, match minutes, feed status words."""
from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON_START_FIXTURES = 8   # a new season's label starts in August for fixture files
SEASON_START_NORMALISE = 7  # ... and in July when old labels are cleaned up
SINGLE_YEAR_LEAGUES = ["FIN", "IRL", "NOR", "SWE"]


def _full_year(d: Column) -> Column:
    """d/M/yy with the century written out: 69 to 99 are in the 1900s, as in POSIX."""
    century = F.when(F.right(d, F.lit(2)).try_cast("int") >= 69, "19").otherwise("20")
    return F.concat(F.regexp_extract(d, r"^(.*/)\d{2}$", 1), century, F.right(d, F.lit(2)))


def kickoff(date: Column, time: Column) -> Column:
    """dd/MM/yyyy, dd/MM/yy or yyyy-MM-dd, with an optional HH:mm; bad text gives null."""
    d = F.trim(date)
    day = (
        F.when(d.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(d, F.lit("d/M/yyyy")))
        .when(d.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(_full_year(d), F.lit("d/M/yyyy")))
        .when(d.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(d, F.lit("yyyy-M-d")))
    ).cast("timestamp_ntz")
    hh = F.regexp_extract(F.trim(time), r"^(\d{1,2}):(\d{1,2})$", 1)
    mm = F.regexp_extract(F.trim(time), r"^(\d{1,2}):(\d{1,2})$", 2)
    ok = (hh != "") & (hh.try_cast("int") < 24) & (mm.try_cast("int") < 60)
    secs = F.when(ok, hh.try_cast("int") * 3600 + mm.try_cast("int") * 60).otherwise(0)
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(secs, F.lit(0)).cast("decimal(18,6)"))


def iso_utc(text: Column) -> Column:
    """ISO text with Z or an offset, as UTC without zone, whatever the session's zone is."""
    local = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def yymm(start_year: Column) -> Column:
    y = start_year.cast("long")
    return F.concat(
        F.lpad(F.pmod(y, F.lit(100)).cast("string"), 2, "0"),
        F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"),
    )


def season_of(ts: Column, first_month: int = SEASON_START_FIXTURES) -> Column:
    return yymm(F.when(F.month(ts) >= first_month, F.year(ts)).otherwise(F.year(ts) - 1))


def season_from_start(start_date: Column) -> Column:
    """Label from a provider's season start date; empty when there is no year in it."""
    y = F.substring(start_date, 1, 4).try_cast("int")
    return F.when((F.length(start_date) >= 4) & y.isNotNull(), yymm(y)).otherwise(F.lit(""))


def normalise_season(label: Column, sample: Column) -> Column:
    """YYYY/YYYY or YYYY to YYMM; a label that already reads YYMM (2425, also 2021) stays."""
    slash = F.regexp_extract(label, r"^(\d{4})/\d{4}$", 1)
    plain = F.regexp_extract(label, r"^(\d{4})$", 1).try_cast("int")
    is_yymm = (plain % 100 == F.floor(plain / 100) + 1) & (plain >= 1000)
    inferred = season_of(sample, SEASON_START_NORMALISE)
    return (
        F.when(slash != "", yymm(slash.try_cast("int")))
        .when(plain.isNotNull() & ~is_yymm, inferred)
        .otherwise(label)
    )


def recent_seasons(end_year: Column, n: int) -> Column:
    """The n season labels that end with ``end_year``, oldest first."""
    return F.transform(F.sequence(end_year - n, end_year - 1), lambda y: yymm(y))


def minute(text: Column) -> Column:
    """'90+3' -> 93, '45' -> 45, anything without leading digits -> null."""
    base = F.regexp_extract(text, r"^(\d+)(?:\+(\d+))?", 1)
    extra = F.regexp_extract(text, r"^(\d+)(?:\+(\d+))?", 2)
    return F.when(base != "", base.cast("int") + F.when(extra != "", extra.cast("int")).otherwise(0))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, floored, never negative."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.floor(micros / F.lit(86_400_000_000)))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def scoreboard_status(completed: Column, state: Column) -> Column:
    return (
        F.when(F.coalesce(completed, F.lit(False)), "finished")
        .when(state == "in", "in_play").when(state == "post", "finished").otherwise("scheduled")
    )


def games_status(short: Column) -> Column:
    s = F.upper(short)
    return (
        F.when(s.isin("FT", "AOT"), "finished")
        .when(s.isin("Q1", "Q2", "Q3", "Q4", "OT", "BT", "HT"), "in_play")
        .when(s.isin("POSTP", "CANC", "ABD", "AWD"), "cancelled")
        .otherwise("scheduled")
    )


# Turkish calendar words for display.
MONTHS_TR = ["Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara"]
DAYS_TR = ["Paz", "Pzt", "Sal", "Çar", "Per", "Cum", "Cmt"]


def local_display(ts: Column, zone: str = "Europe/Istanbul") -> Column:
    """'03 Eki Cmt 19:30': a UTC kickoff in local time."""
    t = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    month = F.element_at(F.array(*[F.lit(x) for x in MONTHS_TR]), F.month(t))
    day = F.element_at(F.array(*[F.lit(x) for x in DAYS_TR]), F.dayofweek(t))
    return F.concat_ws(" ", F.date_format(t, "dd"), month, day, F.date_format(t, "HH:mm"))


def percent(p: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", p * 100)
