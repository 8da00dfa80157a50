"""Offline verdict on an e-mail address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.patterns import match_start
from plumbline.operators.validators import EMAIL_PATTERN

# Confidence of the three verdicts.
NO_ADDRESS, LOOKS_VALID, LOOKS_INVALID = 100, 60, 40


def verify_email(email: Column) -> Column:
    """(is_valid, api_status, confidence, reason): no `@` settles it, otherwise the pattern decides."""
    skipped = F.coalesce(~email.contains("@"), F.lit(True))
    valid = F.coalesce(match_start(email, EMAIL_PATTERN), F.lit(False)) & ~skipped
    return F.struct(
        valid.alias("is_valid"),
        F.when(skipped, "skipped").otherwise("unavailable").alias("api_status"),
        F.when(skipped, NO_ADDRESS).when(valid, LOOKS_VALID).otherwise(LOOKS_INVALID).alias("confidence"),
        F.when(skipped, "Invalid email format").otherwise("API unavailable, used regex fallback").alias("reason"),
    )
