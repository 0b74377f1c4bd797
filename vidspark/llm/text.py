"""Text helpers shared by the operators: ASCII white space, words, lines, row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of white space other than one plain space: the only places that normalising has to touch.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def spaced(text: Column) -> Column:
    """Every run of [\\x20\\x09-\\x0D] replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def trimmed(text: Column) -> Column:
    """Words joined by one space."""
    return F.trim(spaced(text))


def word_list(joined: Column) -> Column:
    """Words of a text of words joined by one space; an empty text has none."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def word_count(joined: Column) -> Column:
    """Number of words of a text of words joined by one space."""
    spaces = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit("")))
    return F.when(joined == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def total(values: Column, kind: str = "long") -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def only(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under the operator's own names; other columns, whatever they are called, go."""
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in names.items()])


def like(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema`, in its order."""
    return df.select(*[f"`{f.name}`" for f in schema.fields])
