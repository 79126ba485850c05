"""Times from the forms that platforms show them in. `now` is always given; what isn't understood is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _minus(now: Column, n: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_micros(now) / F.lit(1e6) - n * seconds)


def relative_time(x: Column, now: Column) -> Column:
    """Time from 刚刚, N分钟前, N小时前, N天前, 昨天 or 前天 with or without HH:MM, MM-DD (of the year before if it lies ahead), or a full date."""
    s = F.trim(x)
    number = lambda p: F.regexp_extract(s, p, 1).try_cast("double")
    clock = F.regexp_extract(s, r"([0-9]{1,2}:[0-9]{2})", 1)
    today = F.to_date(now)

    def day(d: Column) -> Column:
        return F.try_to_timestamp(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" "), F.when(clock != "", clock).otherwise("00:00")), F.lit("yyyy-MM-dd H:mm"))

    month = F.try_to_timestamp(F.concat(F.year(now).cast("string"), F.lit("-"), F.regexp_extract(s, r"^([0-9]{1,2}-[0-9]{1,2})$", 1)), F.lit("yyyy-M-d"))
    return (
        F.when(F.contains(s, F.lit("刚刚")), now)
        .when(s.rlike("[0-9]+ *分钟前"), _minus(now, number("([0-9]+) *分钟前"), 60))
        .when(s.rlike("[0-9]+ *小时前"), _minus(now, number("([0-9]+) *小时前"), 3600))
        .when(s.rlike("[0-9]+ *天前"), _minus(now, number("([0-9]+) *天前"), 86400))
        .when(F.contains(s, F.lit("昨天")), day(F.date_sub(today, 1)))
        .when(F.contains(s, F.lit("前天")), day(F.date_sub(today, 2)))
        .when(s.rlike("^[0-9]{1,2}-[0-9]{1,2}$"), F.when(month > now, F.add_months(month, -12).cast("timestamp")).otherwise(month))
        .otherwise(F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm"))))
    )


def age_bucket(days: Column) -> Column:
    """day, week, month, quarter, half, year or older, by the days that a search can be limited to."""
    out = F.lit("older")
    for limit, name in reversed(((1, "day"), (7, "week"), (31, "month"), (92, "quarter"), (183, "half"), (366, "year"))):
        out = F.when(days <= limit, name).otherwise(out)
    return F.when(days.isNull(), None).otherwise(out)


def mail_time(x: Column) -> Column:
    """Time of an RFC 2822 stamp like 'Sat, 02 Mar 2024 10:20:30 +0800', or with the year last."""
    s = F.regexp_replace(F.regexp_replace(F.trim(x), "^[A-Za-z]{3},? +", ""), " +", " ")
    last_year = F.regexp_replace(s, r"^([A-Za-z]{3}) ([0-9]{1,2}) ([0-9:]+) ([+-][0-9]{4}) ([0-9]{4})$", "$2 $1 $5 $3 $4")
    return F.try_to_timestamp(last_year, F.lit("d MMM yyyy HH:mm:ss Z"))


def shown_age(days: Column) -> Column:
    """Words for an age: 今天, N天前, N个月前 or N年前; empty if unknown."""
    return F.when(days.isNull(), "").when(days < 1, "今天").when(days < 30, F.concat(F.floor(days).cast("string"), F.lit("天前"))).when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("个月前"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("年前")))
