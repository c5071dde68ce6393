"""Mixed-format dates (SF-15, SF-16, PF-7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date layouts the catalogue uses, as shape -> formats to try.
# Telling the layout by its shape first avoids a failed parse, which costs a JVM exception.
DATE_LAYOUTS = {
    r"^\d{1,2} [A-Za-z]{3}, \d{4}$": ["d MMM, yyyy"],
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$": ["MMM d, yyyy"],
    r"^[A-Za-z]{3} \d{1,2} \d{4}$": ["MMM d yyyy"],
    r"^\d{1,2} [A-Za-z]{3} \d{4}$": ["d MMM yyyy"],
    r"^[A-Za-z]{4,} \d{1,2}, \d{4}$": ["MMMM d, yyyy"],
    r"^\d{1,2} [A-Za-z]{4,}, \d{4}$": ["d MMMM, yyyy"],
    r"^[A-Za-z]{3} \d{4}$": ["MMM yyyy"],
    r"^[A-Za-z]{4,} \d{4}$": ["MMMM yyyy"],
    r"^\d{4}$": ["yyyy"],
    r"^\d{4}-\d{2}-\d{2}$": ["yyyy-MM-dd"],
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": ["yyyy-MM-dd HH:mm:ss"],
    r"^\d{1,2}/\d{1,2}/\d{4}$": ["M/d/yyyy", "d/M/yyyy"],
}


def parse_date(c: Column, layouts: Mapping[str, Sequence[str]] = DATE_LAYOUTS) -> Column:
    """The date written in one of the layouts; null when none fits."""
    text = F.trim(c)
    out = F.lit(None).cast("timestamp")
    for shape, formats in reversed(layouts.items()):
        read = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
        out = F.when(text.rlike(shape), read).otherwise(out)
    return out.cast("date")


def released_by(d: Column, as_of: str) -> Column:
    """PF-7: known date on or before ``as_of``."""
    return d.isNotNull() & (d <= F.lit(as_of).cast("date"))
