"""Cleaning, labels and report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(x: Column) -> Column:
    return F.translate(x, " ,/:", "____")


def age_years(x: Column) -> Column:
    """Years from 'NN-year-old' wordings or plain numbers, else null."""
    worded = F.regexp_extract(x, r"(?i)(\d+)[-\s]year[-\s]old", 1)
    return F.when(worded != "", worded.try_cast("int")).otherwise(x.try_cast("double").cast("int"))


def latex_escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("\\&")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def strip_zero(x: Column) -> Column:
    return F.regexp_replace(x, r"^(-?)0\.", "$1.")


def mean_std(mean: Column, std: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, F.coalesce(std, F.lit(0.0)))


def epsilon_label(variant: Column) -> Column:
    """'no_dp' to infinity, 'eps_N' to 10^k where N is a power of ten, else N; 'v2_' before is kept apart."""
    bare = F.regexp_replace(variant, "^v2_", "")
    n = F.regexp_extract(bare, r"^eps_(\d+)$", 1)
    power = F.when(n.rlike("^10*$"), F.concat(F.lit("10^"), (F.length(n) - 1).cast("string"))).otherwise(n)
    return F.when(bare == "no_dp", "∞").when(n != "", power)


def threat_code(white_box: Column, use_aux: Column, white_box_genes: Column) -> Column:
    """Three digits, 0 for yes."""
    return F.concat(*(F.when(c, "0").otherwise("1") for c in (white_box, use_aux, white_box_genes)))


def threat_label(code: Column) -> Column:
    return F.concat(F.when(F.substring(code, 1, 1) == "0", "WB").otherwise("BB"), F.when(F.substring(code, 2, 1) == "0", "+aux").otherwise("-aux"))
