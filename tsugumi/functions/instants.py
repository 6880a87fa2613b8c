"""Timestamps of many written forms as UTC microseconds, in built-in functions only.

A value is brought into one line ``year|month|day|hour|minute|second|fraction|zone|half-day`` by one
regular expression per family of forms; the rest is integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.functions.text import SPACE

US = 1_000_000
DAY_US = 86_400 * US

# Offsets in minutes of zone abbreviations that name one offset.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "JST": 540, "KST": 540, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "WET": 0, "WEST": 60,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630,
}
# The year before the first of each era, by name and letter.
ERAS = {"令和": 2018, "R": 2018, "平成": 1988, "H": 1988, "昭和": 1925, "S": 1925}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"((?:[A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[[A-Za-z0-9_+/-]+\])?)"
_NAME = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
_FORMS = [
    # 2024-08-06T12:00:00.123Z, 2024/8/6(火) 9:05, 2024-08-06 12:00:00 +09:00, 2024-08-06
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:\([日月火水木金土]\))?(?:(?:[Tt]| +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? *" + _ZONE + ")?$", "$1|$3|$4|$5|$6|$7|$8|$9|"),
    # 20240806T120000Z
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)? *" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    # 2024年8月6日 午後3時05分
    (r"^((?:令和|平成|昭和)?(?:\d{1,4}|元))年 *(\d{1,2})月 *(\d{1,2})日(?:\([日月火水木金土]\))?(?: *(午前|午後)? *(\d{1,2})時(?: *(\d{1,2})分(?: *(\d{1,2})秒)?)?)?$", "$1|$2|$3|$5|$6|$7|||$4"),
    # R6.8.6
    (r"^([RHS]\d{1,2})([./-])(\d{1,2})\2(\d{1,2})$", "$1|$3|$4||||||"),
    # 06.08.2024 12:00
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,? +(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? *" + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    # Tue, 06 Aug 2024 12:00:00 +0900, 6 August 2024 12:00:00 UTC
    (r"^(?:[A-Z][a-z]{2}, *)?(\d{1,2}) " + _NAME + r" (\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? *" + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    # Aug 6, 2024 3:05 PM
    (r"^" + _NAME + r" (\d{1,2}), *(\d{4})(?:,? (\d{1,2}):(\d{2})(?::(\d{2}))? *([AaPp][Mm])?)?$", "$3|$1|$2|$4|$5|$6|||$7"),
]
_WEEK = r"^(\d{4})-W(\d{2})-(\d)$"
_NUMBER = r"^(\d{1,18})(?:\.(\d+))?$"


def known_zones(spark: SparkSession) -> list[str]:
    """Names of zones that the JVM's rules have."""
    return [z for z in sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds()) if "'" not in z]


def _int(c: Column) -> Column:
    return F.expr("int(null)") if c is None else c.try_cast("int")


def shifted(us: Column, zone: Column) -> Column:
    """Local microseconds in ``zone`` of UTC microseconds ``us``, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def with_instant(df: DataFrame, value: str, zone: str, out: str = "utc_us", rough: str | None = None) -> DataFrame:
    """``df`` with ``out``: the UTC microseconds of the written time in column ``value``, or null.

    Values without a zone are local time in the zone named by column ``zone`` (null or blank: UTC; an
    unknown name: no instant). Null, blank and impossible values, and local times that a clock change
    skips or repeats, give null; a day without time gives the start of the local day, so on a day whose
    first hour is skipped its first instant. Bare numbers are Unix seconds below 1e11, milliseconds
    below 1e14, else microseconds. Digits beyond microseconds are cut. ``rough``, if given, names a
    column with a best guess for skipped and repeated times (the offset in force before the change).
    """
    spark = df.sparkSession
    kept = df.columns
    text = F.translate(F.regexp_replace(F.col(value), f"^{SPACE}+|{SPACE}+$", ""), "０１２３４５６７８９−／：．（）　", "0123456789-/:.() ")
    df = df.withColumn("__instant_t", text)
    t = F.col("__instant_t")
    line = F.when(t.rlike(_FORMS[0][0]), F.regexp_replace(t, *map(F.lit, _FORMS[0])))
    for pattern, to in _FORMS[1:]:
        line = line.when(t.rlike(pattern), F.regexp_replace(t, F.lit(pattern), F.lit(to)))
    df = df.withColumn("__instant_f", F.split(line, r"\|"))
    part = lambda i: F.get("__instant_f", F.lit(i))
    filled = lambda i: part(i) != ""
    year_text = part(0)
    era = F.regexp_extract(year_text, r"^(\D*)(\d+|元)$", 1)
    number = F.regexp_replace(year_text, "^(令和|平成|昭和|[RHS])", "")
    year = F.when(number == "元", F.lit(1)).otherwise(number.try_cast("int")) + F.coalesce(F.create_map(*[F.lit(x) for kv in ERAS.items() for x in kv])[era], F.lit(0))
    named = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])[F.lower(F.substring(part(1), 1, 3))]
    month = F.coalesce(part(1).try_cast("int"), named)
    date = F.format_string("%04d-%02d-%02d", year, month, part(2).try_cast("int")).try_cast("date")
    week = t.rlike(_WEEK)
    w_year, w_no, w_day = (F.regexp_extract(t, _WEEK, i).try_cast("int") for i in (1, 2, 3))
    fourth = F.concat(w_year.cast("string"), F.lit("-01-04")).try_cast("date")
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (w_no - 1) * 7)
    in_year = w_no.between(1, 53) & w_day.between(1, 7) & (F.year(F.date_add(monday, 3)) == w_year)
    df = df.withColumn("__instant_d", F.when(week, F.when(in_year, F.date_add(monday, w_day - 1))).when((year >= 1) & (year <= 9999), date))
    hour, minute, second = (F.when(filled(i), part(i).try_cast("int")).otherwise(0) for i in (3, 4, 5))
    half = F.lower(part(8))
    hour = F.when(half.isin("午前", "午後", "am", "pm"), F.when(hour <= 12, hour % 12 + F.when(half.isin("午後", "pm"), 12).otherwise(0))).otherwise(hour)
    fraction = F.when(filled(6), F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("int")).otherwise(0)
    clock = F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), (hour.cast("long") * 3600 + minute * 60 + second) * US + fraction)
    df = df.withColumns({
        "__instant_day": F.col("__instant_d").isNotNull() & (week | (part(3) == "")),
        "__instant_l": F.unix_date("__instant_d").cast("long") * DAY_US + F.when(week, F.lit(0).cast("long")).otherwise(clock),
        "__instant_z": F.when(week, "").otherwise(F.regexp_replace(part(7), r"^(.+?)\[.*\]$", "$1")),
    })
    z = F.col("__instant_z")
    signed = z.rlike(r"^[+-]\d{2}(:?\d{2})?$")
    digits = F.rpad(F.regexp_replace(z, r"\D", ""), 4, "0").try_cast("int")
    minutes = F.when(signed, F.when((digits <= 1800) & (digits % 100 < 60), (F.floor(digits / 100) * 60 + digits % 100) * F.when(z.startswith("-"), -1).otherwise(1)))
    minutes = minutes.otherwise(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[F.upper(z)])
    own = F.when(z.startswith("["), F.regexp_replace(z, r"[\[\]]", ""))
    declared = F.coalesce(own, F.when(~F.coalesce(F.trim(F.col(zone)) == "", F.lit(True)), F.trim(F.col(zone))), F.lit("UTC"))
    df = df.withColumns({"__instant_off": minutes.cast("long") * (60 * US), "__instant_declared": declared})
    names = "', '".join(known_zones(spark))
    df = df.withColumn("__instant_zone", F.expr(f"CASE WHEN __instant_declared IN ('{names}') THEN __instant_declared END"))
    local, zoned = F.col("__instant_l"), (z == "") | z.startswith("[")
    before, after = (local - (shifted(local + d, F.col("__instant_zone")) - (local + d)) for d in (-DAY_US, DAY_US))
    df = df.withColumns({"__instant_a": F.when(zoned, before), "__instant_b": F.when(zoned, after)})
    a, b = F.col("__instant_a"), F.col("__instant_b")
    hit_a, hit_b = shifted(a, F.col("__instant_zone")) == local, shifted(b, F.col("__instant_zone")) == local
    single = F.when(a == b, F.when(hit_a, a)).when(hit_a & hit_b, F.when(F.col("__instant_day"), F.least(a, b))).when(hit_a, a).when(hit_b, b).otherwise(F.when(F.col("__instant_day"), a))
    whole = F.regexp_extract(t, _NUMBER, 1).try_cast("long")
    tail = F.regexp_extract(t, _NUMBER, 2)
    scale = F.when(whole < 10**11, 6).when(whole < 10**14, 3).otherwise(0)
    extra = F.coalesce(F.substring(F.rpad(tail, 6, "0"), F.lit(1), scale).try_cast("long"), F.lit(0).cast("long"))
    numeric = whole * F.when(scale == 6, F.lit(US)).when(scale == 3, F.lit(1000)).otherwise(F.lit(1)) + extra
    bare = t.rlike(_NUMBER)
    instant = F.when(bare, F.when(whole < 10**17, numeric)).when(zoned, single).otherwise(local - F.col("__instant_off"))
    # A later filter on the result would be pushed down through every step above, copying their expressions
    # over and over; it can't pass a projection that is not deterministic.
    df = df.withColumns({"__instant_out": instant, "__instant_pid": F.spark_partition_id()})
    df = df.withColumn(out, F.when(F.col("__instant_pid") >= 0, F.col("__instant_out")))
    if rough:
        df = df.withColumn(rough, F.coalesce(F.col("__instant_out"), F.least(F.col("__instant_a"), F.col("__instant_b"))))
    return df.select(*(c for c in kept if c not in (out, rough)), out, *([rough] if rough else []))
