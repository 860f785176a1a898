"""Cooldown, retry and backoff rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default limits of a review run.
MAX_REQUESTS_PER_MINUTE = 15
MAX_CONCURRENT_REQUESTS = 3
MIN_RUN_INTERVAL_SECONDS = 120.0
MAX_ATTEMPTS = 3
INITIAL_BACKOFF_SECONDS = 2.0
BACKOFF_MULTIPLIER = 2.0
MAX_BACKOFF_SECONDS = 15.0

# Parts of a message that make an error worth another try.
RETRY_MARKERS = [
    "429",
    "500",
    "502",
    "503",
    "504",
    "resource_exhausted",
    "unavailable",
    "deadline_exceeded",
    "internal",
    "timeout",
    "temporarily unavailable",
    "try again later",
    "high demand",
    "temporary failure in name resolution",
    "name resolution",
    "connection reset",
    "connection aborted",
    "network is unreachable",
]


def cooldown_remaining(now: Column, last_start: Column, min_interval: Column) -> Column:
    """Seconds until a run may start; 0 when disabled or never run."""
    left = F.greatest(F.lit(0.0), min_interval - (now - last_start))
    return F.when(min_interval <= 0, F.lit(0.0)).otherwise(F.coalesce(left, F.lit(0.0)))


# The text for a file left out, before and behind the seconds.
COOLDOWN_TEXT = (
    "[SKIPPED]\nAI analysis was skipped because the cooldown window is still active.\n\n"
    "Next AI run is available in about "
)
COOLDOWN_END = " seconds."


def cooldown_message(remaining: Column) -> Column:
    """Text for a file left out; seconds round half to even, 1 at least."""
    seconds = F.greatest(F.lit(1), F.bround(remaining).cast("bigint"))
    return F.concat(F.lit(COOLDOWN_TEXT), seconds.cast("string"), F.lit(COOLDOWN_END))


def is_retryable_error(message: Column) -> Column:
    return F.rlike(F.lower(message), F.lit("|".join(RETRY_MARKERS)))


def retryable(message: str) -> bool:
    """The same rule for a message at hand inside a task."""
    return any(marker in message.lower() for marker in RETRY_MARKERS)


def backoff_seconds(retry: Column, initial: Column, multiplier: Column, most: Column) -> Column:
    """Sleep before retry 1, 2, ...: the first is not capped, later ones are."""
    first = F.greatest(F.lit(0.0), initial)
    grown = first * F.pow(F.greatest(multiplier, F.lit(1.0)), retry - 1)
    return F.when(retry == 1, first).otherwise(F.least(most, grown))


def backoff_schedule(attempts: Column, initial: Column, multiplier: Column, most: Column) -> Column:
    """Sleeps between the attempts, of which there is one at least."""
    retries = F.greatest(attempts, F.lit(1)) - 1
    return F.when(
        retries > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(retries, F.lit(1))),
            lambda k: backoff_seconds(k, initial, multiplier, most),
        ),
    ).otherwise(F.array().cast("array<double>"))
