"""Feeds: entries pulled out of text by patterns, in the order of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import decoded
from tidewright.operators.collections import first_non_empty


def first_group(text: Column, pattern: str) -> Column:
    """The first match's group, '' if there is none; a dot does not cross lines."""
    return F.regexp_extract(text, pattern, 1)


def blocks(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """One row per match of a pattern's group, with its place ``pos`` from 0."""
    return df.select("*", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("pos", "block"))


def videos(feed: DataFrame, text: str = "xml") -> DataFrame:
    """Entries of a video feed: pos, id, title, published, thumbnail, url; without an id there is no entry."""
    entry = blocks(feed.select(text), text, "(?s)<entry>(.*?)</entry>")
    out = entry.select(
        "pos",
        first_group(F.col("block"), "<yt:videoId>(.*?)</yt:videoId>").alias("id"),
        decoded(first_group(F.col("block"), "<title>(.*?)</title>")).alias("title"),
        first_group(F.col("block"), "<published>(.*?)</published>").alias("published"),
    ).where("id <> ''")
    at = lambda head, tail: F.concat(F.lit(head), F.col("id"), F.lit(tail))
    return out.withColumns({"thumbnail": at("https://i.ytimg.com/vi/", "/hqdefault.jpg"), "url": at("https://www.youtube.com/watch?v=", "")})


def first_source(sources: list[DataFrame], fallback: DataFrame) -> DataFrame:
    """The rows of the first source that has any, else the fallback's."""
    out = fallback
    for s in reversed(sources):
        out = first_non_empty(s, out)
    return out
