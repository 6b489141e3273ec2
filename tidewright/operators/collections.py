"""Ordered and filtered reads of document collections, defaults, derived columns, and access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.text import member

_S, _L = T.StringType(), T.LongType()


def _schema(*strings: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in strings] + [T.StructField(n, t) for n, t in more.items()])


#: The schemas of the collections.
SCHEMAS = {
    "noticias": _schema("id", "title", "body", "date", createdAt=_L),
    "eventos": _schema("id", "title", "date", "type", createdAt=_L),
    "oracoes": _schema("id", "text", "authorName", "authorId", prayedBy=T.ArrayType(_S), createdAt=_L),
    "anotacoes": _schema("id", "authorId", "pregador", "texto", "palavras", "aplicacoes", createdAt=_L),
    "usuarios": _schema("id", "nome", "email", "telefone", "criadoEm", "fotoBase64"),
}


def ordered(df: DataFrame, by: str, key: str = "id", descending: bool = True) -> DataFrame:
    """Rows by one field, ties by key in the same direction."""
    way = F.desc if descending else F.asc
    return df.orderBy(way(by), way(key))


def positions(df: DataFrame, *order: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``pos``, the place of each row in the order, from 1."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def news(df: DataFrame) -> DataFrame:
    return ordered(df, "createdAt")


def agenda(df: DataFrame) -> DataFrame:
    """Events by the text of their date, which is no calendar order."""
    return ordered(df, "date", descending=False)


def agenda_tab(df: DataFrame, tab: str) -> DataFrame:
    """Events of a tab; the birthday tab has the plural of its type's name."""
    return df.where(F.col("type") == {"aniversariantes": "aniversariante"}.get(tab, tab))


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Null fields replaced, each by its own default; an empty list is given as []."""
    value = lambda c, v: F.array().cast(df.schema[c].dataType) if v == [] else F.lit(v)
    return df.withColumns({c: F.coalesce(F.col(c), value(c, v)) for c, v in defaults.items()})


def prayers(df: DataFrame) -> DataFrame:
    """Prayers, newest first, without nulls."""
    return ordered(with_defaults(df, text="", authorName="", authorId="", prayedBy=[], createdAt=0), "createdAt")


def prayer_flags(df: DataFrame, uid: str) -> DataFrame:
    """Derived columns: hasPrayed, isOwner, prayCount."""
    return df.withColumns(
        {"hasPrayed": member(F.col("prayedBy"), F.lit(uid)), "isOwner": F.col("authorId") == uid, "prayCount": F.size("prayedBy")}
    )


def own(df: DataFrame, uid: str | None, owner: str = "authorId") -> DataFrame:
    """Rows of one owner; nobody signed in sees none."""
    return df.where(F.col(owner) == uid) if uid else df.limit(0)


def notes(df: DataFrame, uid: str | None) -> DataFrame:
    """The notes of one author, newest first; the filter goes below the sort."""
    return ordered(own(df, uid), "createdAt")


def photo(users: DataFrame, uid: str) -> DataFrame:
    return users.where((F.col("id") == uid) & (F.coalesce("fotoBase64", F.lit("")) != "")).select("fotoBase64")


def admins(df: DataFrame, allowed: list[str], email: str = "email", fold: bool = True) -> DataFrame:
    """Rows whose address is in the list: folded to lower case first, as the app does, or as it is, as the rules do."""
    c = F.col(email)
    return df.where((F.lower(c) if fold else c).isin(allowed))


def may(collection: str, action: str, uid: str | None, admin: bool = False) -> Column:
    """Whether a row of a collection may be read, created, updated or deleted."""
    if not uid:
        return F.lit(False)
    mine = {"usuarios": F.col("id") == uid, "anotacoes": F.col("authorId") == uid}
    if collection in mine:
        return mine[collection]
    if collection == "oracoes":
        return F.lit(True) if action in ("read", "update") else F.col("authorId") == uid
    return F.lit(action == "read" or admin)


def first_non_empty(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """``live``, or ``fallback`` as a whole if there is no live row."""
    none = live.select(F.lit(1).alias("_any")).limit(1)
    return live.unionByName(fallback.join(none, F.lit(True), "left_anti"))


def with_last(df: DataFrame, *order: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``is_last``: no row follows in the order."""
    return df.withColumn("is_last", F.lead(F.lit(1)).over(Window.partitionBy(*within).orderBy(*order)).isNull())
