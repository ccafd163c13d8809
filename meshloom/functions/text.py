"""Text helpers: memory sizes and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, steps of 1024.
UNITS = ["B", "KiB", "MiB", "GiB", "TiB"]
# Message fragments in the order they are tested.
SKIP_RULES = [
    ("above limit", "RESOURCE_LIMIT"),
    ("transient memory", "RESOURCE_LIMIT"),
    ("git lfs pointer", "INPUT_NOT_READY"),
    ("unknown argument", "CLI_ERROR"),
]
SKIP_DEFAULT = "EXECUTION_ERROR"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other alphabets stay as they are."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def ascii_upper(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER.lower(), ASCII_UPPER)


def memory_string(size: Column) -> Column:
    """A byte count as text: whole bytes, or two decimals from KiB on.

    The hundredths come from integer arithmetic, rounded half to even, so the text does
    not depend on how a runtime prints doubles.
    """
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS[1:], start=1):
        step = 1024**power
        whole = F.call_function("div", size, F.lit(step).cast("long"))
        scaled = (size % F.lit(step).cast("long")) * 100
        cents = F.call_function("div", scaled, F.lit(step).cast("long"))
        rest = (scaled % F.lit(step).cast("long")) * 2
        up = (rest > step) | ((rest == step) & (cents % 2 == 1))
        cents = cents + up.cast("long")
        whole = whole + (cents == 100).cast("long")
        number = F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        text = F.when(size >= F.lit(step).cast("long"), number).otherwise(text)
    return text


def bytes_to_gib(size: Column) -> Column:
    return size / F.lit(1024.0**3)


def classify_skip_reason(message: Column) -> Column:
    """The error class of a message; the first matching rule decides."""
    lowered = ascii_lower(message)
    (fragment, reason), *rules = SKIP_RULES
    out = F.when(lowered.contains(fragment), F.lit(reason))
    for fragment, reason in rules:
        out = out.when(lowered.contains(fragment), F.lit(reason))
    return out.otherwise(F.lit(SKIP_DEFAULT))
