"""Writes as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import toggled


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """With further rows; columns they lack are null."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def patched(df: DataFrame, patch: DataFrame, key: str = "id", allowed: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with the fields of ``patch``: a column that patch lacks is absent and stays, a null in it is set.

    ``allowed`` names the columns that may be patched. A key may occur once in ``patch``: of two rows it would make two.
    """
    fields = [c for c in patch.columns if c != key and (allowed is None or c in allowed)]
    if not fields:
        return df
    known, new = (_free(x, df.columns) for x in ("_key", "_new"))
    p = patch.select(F.col(f"`{key}`").alias(known), F.struct(*[F.col(f"`{c}`") for c in fields]).alias(new))
    out = df.join(p, F.col(f"`{key}`") == F.col(known), "left")
    return out.select(*[F.when(F.col(known).isNotNull(), F.col(new)[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in df.columns])


def _free(name: str, taken: list[str]) -> str:
    """``name``, longer by underscores while a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def merged(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Upsert of named fields: known keys are patched, others added."""
    fresh = rows.join(df.select(key), key, "left_anti")
    return inserted(patched(df, rows, key), fresh)


def replaced(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows set: what was under their keys goes."""
    return inserted(df.join(rows.select(key), key, "left_anti").select(*df.columns), rows)


def deleted(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)


def saved(df: DataFrame, row: DataFrame, editing: str | None, key: str = "id") -> DataFrame:
    """An update of the row being edited, else an insert."""
    return patched(df, row.withColumn(key, F.lit(editing)), key) if editing else inserted(df, row)


def toggle_prayed(df: DataFrame, row_id, uid: str, key: str = "id", field: str = "prayedBy") -> DataFrame:
    """Membership of ``uid`` turned over in one row."""
    return df.withColumn(field, F.when(F.col(key) == row_id, toggled(F.col(field), F.lit(uid))).otherwise(F.col(field)))
