"""Normalisation of vocalised Arabic as column expressions. Marks are part of a word's identity: keys that fold or
strip them are secondary columns beside the word, never in its place."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Vowel marks, nunation, shadda and sukun; recitation marks; all marks with the dagger alif. Fixed values.
MARKS = "ً-ْ"
RECITATION = "ۖ-ۭؕؗ-ؚ"
ALL_MARKS = f"{MARKS}ٰ{RECITATION}"
SUN = "تثدذرزسشصضطظلن"
TATWEEL, WASLA, DAGGER = "ـ", "ٱ", "ٰ"


def ordered(form: str) -> str:
    """A rule table's form with shadda before the vowel, as words have it after normalisation."""
    return re.sub("([ً-ِ])ّ", r"ّ\1", form)


@F.pandas_udf(StringType())
def nfc(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode composition, for which Spark has no function."""
    for w in words:
        yield w.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def drop_tatweel(x: Column) -> Column:
    return F.replace(x, F.lit(TATWEEL), F.lit(""))


def wasla_to_alif(x: Column) -> Column:
    return F.translate(x, WASLA, "ا")


def dagger_to_alif(x: Column) -> Column:
    return F.translate(x, DAGGER, "ا")


def open_madda(x: Column) -> Column:
    """Word-initial آ becomes أَا, any other one ا."""
    return F.translate(F.regexp_replace(x, rf"(^|\s)([{ALL_MARKS}{TATWEEL}]*)آ", "$1$2أَا"), "آ", "ا")


def open_wasl(x: Column) -> Column:
    """A bare initial alif before two letters takes a hamza: with damma if the third letter has it, else with kasra."""
    m = f"[{ALL_MARKS}]*"
    letter = f"[^{ALL_MARKS}\\s]"
    damma = x.rlike(f"^ا{letter}{m}{letter}[{ALL_MARKS}]*ُ")
    kasra = x.rlike(f"^ا{letter}{m}{letter}")
    rest = F.substring(x, F.lit(2), F.length(x))
    return F.when(damma, F.concat(F.lit("أُ"), rest)).when(kasra, F.concat(F.lit("إِ"), rest)).otherwise(x)


def sun_lam(x: Column) -> Column:
    """The article's assimilation shadda on a sun letter goes."""
    return F.regexp_replace(x, f"^(ال)([{SUN}])([{MARKS}]*?)ّ", "$1$2$3")


def shadda_first(x: Column) -> Column:
    """Shadda before a vowel, repeated marks once, marks without a letter gone."""
    x = F.regexp_replace(x, "([ً-ِْ])ّ", "ّ$1")
    x = F.regexp_replace(x, f"([{MARKS}])\\1+", "$1")
    return F.regexp_replace(x, rf"(^|\s)[{ALL_MARKS}]+", "$1")


def strip_marks(x: Column) -> Column:
    return F.regexp_replace(x, f"[{MARKS}]", "")


def strip_all(x: Column) -> Column:
    return F.regexp_replace(x, f"[{ALL_MARKS}]", "")


def light_fold(x: Column) -> Column:
    return F.translate(x, "ٱآ", "اا")


def strong_fold(x: Column) -> Column:
    return F.translate(x, "ٱآإأٰؤ", "اااااا")


def strict_key(x: Column) -> Column:
    return strip_all(strong_fold(drop_tatweel(x)))


def root_fold(x: Column) -> Column:
    return F.translate(x, "أإآؤئء", "اااويا")


def pause_to_space(x: Column) -> Column:
    """Recitation marks become spaces, so that words never fuse."""
    return squeeze(F.regexp_replace(x, f"[{RECITATION}]", " "))


def strip_tanwin(x: Column) -> Column:
    """The first ending that fits goes: اً, ًا, then a bare nunation."""
    for ending in ("ًا", "اً"):
        cut = F.substring(x, F.lit(1), F.length(x) - 2)
        x = F.when(F.endswith(x, F.lit(ending)), cut).otherwise(x)
    return F.regexp_replace(x, "[ً-ٍ]$", "")


def ascii_digits(x: Column) -> Column:
    return F.translate(x, "٠١٢٣٤٥٦٧٨٩", "0123456789")


#: The fixed order of the pipeline, and its options.
STEPS = (("nfc", nfc), ("squeeze", squeeze), ("tatweel", drop_tatweel), ("wasla", wasla_to_alif), ("madda", open_madda), ("marks", shadda_first))
OPTIONS = (("dagger", dagger_to_alif), ("sun_lam", sun_lam), ("wasl", open_wasl))


def normalize(df, column: str, out: str = "normalized", options: tuple[str, ...] = ()):
    """``df`` with the normalised column and the names of the steps that changed it.

    Each step is a column of its own, so the costly one runs once.
    """
    steps = [*STEPS, *[s for s in OPTIONS if s[0] in options]]
    df = df.withColumn("_0", F.col(column))
    for k, (_, step) in enumerate(steps):
        df = df.withColumn(f"_{k + 1}", step(F.col(f"_{k}")))
    applied = F.array_compact(F.array(*[F.when(F.col(f"_{k + 1}") != F.col(f"_{k}"), F.lit(name)) for k, (name, _) in enumerate(steps)]))
    return df.withColumn(out, F.col(f"_{len(steps)}")).withColumn("applied", applied).drop(*[f"_{k}" for k in range(len(steps) + 1)])
