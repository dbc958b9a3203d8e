"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value: Column, places: int) -> Column:
    """Round a value that is not negative on its exact binary value, ties to even.

    `round` works on the shortest decimal text and sends ties up, so 1/32 and
    0.66665 come out differently at 4 places. `format_number` rounds correctly
    except next to half of the last place, which is therefore compared directly.
    """
    unit, half = float(f"1e-{places}"), float(f"5e-{places + 1}")
    up = value >= half if round(half, places) else value > half
    text = F.replace(F.format_number(value, places), F.lit(","), F.lit(""))
    return F.when(value < unit, F.when(up, F.lit(unit)).otherwise(F.lit(0.0))).otherwise(
        text.cast("double")
    )


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))
