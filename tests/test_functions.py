import pytest
from pyspark.sql import functions as F

from tidewright.functions import dates as D
from tidewright.functions import text as T

DAY = D.DAY_MS


def values(spark, inputs, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.phone, {"8": "8", "81": "81", "819": "(81) 9", "8199999": "(81) 99999", "81999990000": "(81) 99999-0000", "819999900001": "(81) 99999-0000", "+55 a": "55"}),
    (T.initials, {"Ana": "AN", "Ana Maria Sá": "AS", " Ana": "A"}),
    (T.decoded, {"&amp;lt;": "<", "a &quot;b&quot; &#39;": "a \"b\" '"}),
    (T.trimmed, {"  a b﻿\n": "a b", "": "", " ": ""}),
    (T.display_url, {"https://a.b/": "a.b", "http://a.b//": "a.b/", "ftp://a": "ftp://a"}),
    (T.uri_component, {"a b&c(d)!~*'é": "a%20b%26c(d)!~*'%C3%A9"}),
    (T.lenient_int, {"05": 5, "5x": 5, " -3": -3, "x": None, "": None}),
    (T.email_ok, {" a@b.c ": True, "a@b": False, "a b@c.d": False}),
    (D.day_label, {"5/3": "5 de Mar", "05/03/2024": "5 de Mar", "45/3": "45 de Mar", "0/3": "0/3", "5/13": "5/13", "x": "x"}),
    (D.published_date, {"2024-03-05T00:00:00Z": "05/03/2024", "nothing": "NaN/NaN/NaN"}),
    (lambda c: D.published_date(c, "-03:00"), {"2024-03-05T00:00:00Z": "04/03/2024"}),
    (lambda c: D.with_month(c, F.lit(4)), {"5/3": "5/4", "": "1/4"}),
    (lambda c: D.with_day(c, F.lit(9), 2), {"5/3": "9/3", "5": "9/2"}),
    (lambda c: T.settings(c)["fontSize"], {'{"fontSize":20}': 20.0, "no json": 16.0, "{}": 16.0}),
    (lambda c: T.settings(c)["darkMode"], {'{"darkMode":true}': True, "no json": False}),
    (lambda c: T.truthy_or(c, "d"), {"": "d", "a": "a"}),
    (lambda c: T.or_else(c, "d"), {"": ""}),
    (lambda c: T.by_key({"400": "regular", "700": "bold"}, c, "400"), {"700": "bold", "x": "regular"}),
    (lambda c: T.store_url(c, F.lit("A"), F.lit(None), F.lit("S")), {"android": "A", "ios": "S", "web": "S"}),
]


@pytest.mark.parametrize(("f", "table"), CASES)
def test_text(spark, f, table):
    assert values(spark, list(table), f) == list(table.values())


def test_relative_days(spark):
    want = {-1: "Há -1 dias", 0: "Hoje", 1: "Há 1 dia", 6: "Há 6 dias", 7: "Há 1 semana", 13: "Há 1 semana", 14: "Há 2 semanas", 29: "Há 4 semanas", 30: "Há 1 mês", 59: "Há 1 mês", 60: "Há 2 meses", 359: "Há 11 meses", 360: "Há 1 ano", 720: "Há 2 anos"}
    assert values(spark, [-d * DAY for d in want], lambda c: D.relative_days(c, 0), "long") == list(want.values())


def test_time_ago(spark):
    want = {-5: "agora", 0: "agora", 59: "59min", 60: "1h", 1439: "23h", 1440: "1d"}
    assert values(spark, [-m * 60_000 for m in want], lambda c: D.time_ago(c, 0), "long") == list(want.values())


def test_font_steps_and_toggle(spark):
    assert values(spark, [12, 13, 31, 32], lambda c: T.stepped(c, 1), "int") == [13, 14, 32, 32]
    assert values(spark, [12, 13, 31, 32], lambda c: T.stepped(c, -1), "int") == [12, 12, 30, 31]
    lists = [["a", "b", "a"], ["b"], [], [None]]
    assert values(spark, lists, lambda c: T.toggled(c, F.lit("a")), "array<string>") == [["b"], ["b", "a"], ["a"], [None, "a"]]
    twice = lambda c: T.toggled(T.toggled(c, F.lit("z")), F.lit("z"))
    assert values(spark, lists[:3], twice, "array<string>") == lists[:3]
