"""ISO-8601 durations (``PT5M``, ``P1DT2H``) as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days, hours, minutes and (fractional) seconds, each optionally signed; at least one must appear.
_PATTERN = (
    r"(?i)^([-+]?)P(?=.)(?:([-+]?[0-9]+)D)?"
    r"(?:T(?=.)(?:([-+]?[0-9]+)H)?(?:([-+]?[0-9]+)M)?(?:([-+]?[0-9]+(?:[.,][0-9]{0,9})?)S)?)?$"
)
_SECONDS = {2: 86400, 3: 3600, 4: 60}


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration as a double; NULL when the text is not a duration."""
    total = F.lit(0.0)
    for group, seconds in _SECONDS.items():
        total = total + F.coalesce(F.try_to_number(F.regexp_extract(text, _PATTERN, group), F.lit("S999999999")).cast("double"), F.lit(0.0)) * seconds
    fraction = F.regexp_replace(F.regexp_extract(text, _PATTERN, 5), ",", ".")
    total = total + F.when(fraction != "", fraction.cast("double")).otherwise(0.0)
    sign = F.when(F.regexp_extract(text, _PATTERN, 1) == "-", -1.0).otherwise(1.0)
    return F.when(text.rlike(_PATTERN), sign * total)
