"""A nested corpus (books of chapters of verses): flattening, search and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordering import free
from tidewright.functions.text import holds

#: Hits that a search returns at most, and the fewest characters it takes.
MOST_HITS, SHORTEST = 60, 3
#: Fixed value: position at which the second part of the books begins.
SECOND_PART = 39


def flattened(books: DataFrame) -> DataFrame:
    """(book, name, chapter, verse, text) of books (book, name, chapters), positions from 0."""
    chapters = books.select("book", "name", F.posexplode("chapters").alias("chapter", "verses"))
    return chapters.select("book", "name", "chapter", F.posexplode("verses").alias("verse", "text"))


def needle(query: str) -> str | None:
    """The folded query, none if it is too short."""
    q = query.strip().lower()
    return q if len(q) >= SHORTEST else None


def search(verses: DataFrame, query: str, *order: str, text: str = "text", most: int = MOST_HITS) -> DataFrame:
    """The first hits of a case-folded literal search, in order; a short query has none."""
    q = needle(query)
    if q is None:
        return verses.limit(0)
    return verses.where(holds(F.col(text), q)).orderBy(*order).limit(most)


def named(hits: DataFrame, names: DataFrame, key: str = "book") -> DataFrame:
    """Hits with the dimension's name at their index, else their own; a null index has no name in the dimension."""
    at, name = free("_key", hits.columns), free("_name", hits.columns)
    dim = names.select(F.col(key).alias(at), F.col("name").alias(name))
    out = hits.join(dim, F.col(f"`{key}`") == F.col(at), "left")
    return out.withColumn("name", F.coalesce(name, "name")).drop(at, name)


def chapter_or_kept(chapters: Column, chapter: Column, kept: Column) -> Column:
    """The verses of a chapter, from 0; ``kept``, what is shown already, where book or chapter is missing."""
    return F.coalesce(F.when(chapter >= 0, F.get(chapters, chapter)), kept)


def reference(name: Column, chapter: Column, verse: Column) -> Column:
    """``name c:v`` with numbers from 1."""
    return F.concat(name, F.lit(" "), (chapter + 1).cast("string"), F.lit(":"), (verse + 1).cast("string"))


def part_of(book: Column) -> Column:
    return F.when(book < SECOND_PART, "AT").otherwise("NT")


def chapters_of(dimension: DataFrame) -> DataFrame:
    """(book, chapter) of a dimension (book, chapters: a count)."""
    return dimension.where("chapters > 0").select("book", F.explode(F.sequence(F.lit(0), F.col("chapters") - 1)).alias("chapter"))


def neighbours(pages: DataFrame, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Pages with ``prev`` and ``next`` in order (structs of the order columns), none at the ends."""
    w = Window.partitionBy(*within).orderBy(*order)
    at = F.struct(*order)
    return pages.withColumns({"prev": F.lag(at).over(w), "next": F.lead(at).over(w)})
