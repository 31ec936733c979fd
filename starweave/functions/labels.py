"""Labels of tracers: suffixes, prefixes, aliases, dictionaries, tags for names of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes under which a tracer's labels are found. Fixed values.
ALIASES = {"BGS": ["BGS", "BGS_ANY", "BGS_BRIGHT"], "ELG": ["ELG", "ELG_LOP", "ELG_LOPnotqso"], "LRG": ["LRG"], "QSO": ["QSO"]}


def base_label(c: Column) -> Column:
    """Without a trailing _DATA or _RAND of any case."""
    return F.regexp_replace(c, "(?i)_(DATA|RAND)$", "")


def base_strict(c: Column) -> Column:
    """Without a trailing _DATA or _RAND in capitals."""
    return F.regexp_replace(c, "_(DATA|RAND)$", "")


def without_last_token(c: Column) -> Column:
    """Without the last _token, whatever it is."""
    return F.regexp_replace(c, "_[^_]*$", "")


def first_token(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def matches_alias(c: Column, tracer: str) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(p)) for p in ALIASES.get(tracer.upper(), [tracer])))


def coerced(c: Column) -> Column:
    """Text of bytes or text, trimmed."""
    return F.trim(c.cast("string"))


def full_label(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """df(tracer_id, isdata) with the label of dimension(tracer_id, tracer), or UNKNOWN; the dimension has a row for each tracer."""
    suffix = F.when(F.col("isdata"), "_DATA").otherwise("_RAND")
    return df.join(dimension, "tracer_id", "left").withColumn("label", F.when(F.col("tracer").isNotNull(), F.concat("tracer", suffix)).otherwise("UNKNOWN"))


def zone_tag(c: Column) -> Column:
    """Numbers with two digits at least; other zones as they are."""
    text = c.cast("string")
    return F.when(text.rlike("^[0-9]$"), F.lpad(text, 2, "0")).otherwise(text)


def safe_tag(c: Column) -> Column:
    """A tag fit for a file's name: an underscore and the tag, other characters replaced; nothing for no tag."""
    return F.when(c.isNull() | (c == ""), "").otherwise(F.concat(F.lit("_"), F.regexp_replace(c, r"[^A-Za-z0-9_.\\]", "_")))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
