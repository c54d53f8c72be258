"""Clock strings and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verseloom.config import TICK_RATE


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours go on past 99."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def parse_clock(text: Column) -> Column:
    """Seconds of HH:MM:SS; empty is 0, a whole number over 10000 is ticks, any other number seconds."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.split(t, ":")
    number = t.cast("double")
    return F.when(t == "", 0.0).when(F.size(parts) == 3, parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double")).when(t.rlike(r"^\d+$") & (number > 10000), number / TICK_RATE).otherwise(number)


def parse_caption_time(text: Column) -> Column:
    """Seconds of H:M:S.mmm or M:S.mmm, with a point or comma; 0 for any other count of parts."""
    p = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    get = lambda k: F.get(p, F.lit(k)).cast("double")
    return F.when(F.size(p) == 3, get(0) * 3600 + get(1) * 60 + get(2)).when(F.size(p) == 2, get(0) * 60 + get(1)).otherwise(0.0)


def short_clock(seconds: Column) -> Column:
    """m:ss, cut to whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def bytes_text(n: Column) -> Column:
    """B, KiB, MiB or GiB; null is a dash."""
    sized = F.when(F.abs(n) < 1024, F.format_string("%d B", n.cast("long")))
    for k, unit in ((1, "KiB"), (2, "MiB")):
        sized = sized.when(F.abs(n) < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1)))
    return F.coalesce(sized.when(n.isNotNull(), F.format_string("%.1f GiB", F.bround(n / float(1024**3), 1))), F.lit("-"))


def effort_text(seconds: Column) -> Column:
    """Whole seconds as 1h02m03s or 2m03s; null is a dash."""
    s = F.greatest(F.lit(0), F.bround(seconds)).cast("long")
    short = F.format_string("%dm%02ds", F.floor(s / 60) % 60, s % 60)
    return F.when(seconds.isNull(), "-").when(s >= 3600, F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(short)
