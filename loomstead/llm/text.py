"""Words of whole texts, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vowel points and marks inside words; everything else that is no letter or digit parts words.
POINTS = r"[\p{Mn}'\"׳״’‘“”„`´‎‏﻿­]+"


def words(text: Column) -> Column:
    """Lower-case words without points, quotes and punctuation; hyphens and maqaf part words. Empty for null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), POINTS, ""), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))
