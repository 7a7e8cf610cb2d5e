"""Column functions shared by the core operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import consistent

_BLANKS = r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$"


def strip(c: Column) -> Column:
    """Without the blanks around it, of whatever kind."""
    return F.regexp_replace(c, _BLANKS, "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def key_form(c: Column) -> Column:
    """Trimmed and lower-cased; null for null and blank."""
    return F.lower(blank_to_null(c))


def words(c: Column) -> Column:
    """Number of runs of characters without blanks."""
    return F.regexp_count(c, F.lit(r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}]+"))


def consistent_entities(df: DataFrame, column: str = "entities") -> DataFrame:
    """df with the strings of an array column in the consistent form of entities.

    Rows whose strings are all plain, nearly all of them, never leave the JVM; the
    others go through Python in Arrow batches.
    """
    odd = F.coalesce(F.exists(column, lambda e: e.rlike(consistent.SUSPICIOUS)), F.lit(False))

    def fold(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rows = [None if r is None else [None if e is None else consistent.consistent_entity(e) for e in r] for r in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return df.where(~odd).unionByName(df.where(odd).mapInArrow(fold, df.schema))
