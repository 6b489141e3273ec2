"""String, array, number and JSON expressions; all Column to Column."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that a trim takes off either end.
BLANKS = "[\\s\\x0B\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
# Entities and what they stand for, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
# Fixed value: the pattern of an e-mail address.
EMAIL = "^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def filled(c: Column) -> Column:
    """Whether anything but white space is in it; null is blank."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def all_filled(*cs: Column) -> Column:
    out = filled(cs[0])
    for c in cs[1:]:
        out = out & filled(c)
    return out


def any_filled(*cs: Column) -> Column:
    out = filled(cs[0])
    for c in cs[1:]:
        out = out | filled(c)
    return out


def or_else(c: Column, default: Column | str) -> Column:
    """``default`` for null only; '' and 0 stay."""
    return F.coalesce(c, default if isinstance(default, Column) else F.lit(default))


def truthy_or(c: Column, default: Column | str) -> Column:
    """``default`` for null and for ''."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def holds(text: Column, needle: Column | str) -> Column:
    """Case-folded substring test; the needle is literal."""
    return F.contains(F.lower(text), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone(c: Column) -> Column:
    """Digits as they are up to two, then ``(dd) rest``, from eight on ``(dd) ddddd-rest``, at most 11."""
    d = F.substring(digits(c), 1, 11)
    area = F.concat(F.lit("("), F.substring(d, 1, 2), F.lit(") "))
    return (
        F.when(F.length(d) <= 2, d)
        .when(F.length(d) <= 7, F.concat(area, F.substring(d, 3, 9)))
        .otherwise(F.concat(area, F.substring(d, 3, 5), F.lit("-"), F.substring(d, 8, 4)))
    )


def phone_valid(c: Column) -> Column:
    return F.length(digits(c)).between(10, 11)


def initials(c: Column) -> Column:
    """First letters of the first and the last word; of one word the first two. A leading space gives '' for its word."""
    parts = F.split(c, " ")
    ends = F.concat(F.substring(parts[0], 1, 1), F.substring(F.element_at(parts, -1), 1, 1))
    return F.upper(F.when(F.size(parts) >= 2, ends).otherwise(F.substring(c, 1, 2)))


def display_url(c: Column) -> Column:
    """Without the scheme and one closing slash."""
    return F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "/$", "")


def decoded(c: Column) -> Column:
    """Five XML entities replaced one after another, so ``&amp;lt;`` gives ``<``."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def uri_component(c: Column) -> Column:
    """Percent-encoding that leaves ``A-Z a-z 0-9 - _ . ! ~ * ' ( )`` as they are."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def email_ok(c: Column) -> Column:
    return F.coalesce(trimmed(c).rlike(EMAIL), F.lit(False))


def lenient_int(c: Column) -> Column:
    """The number that a text begins with, after white space; null if it begins with none."""
    return F.regexp_extract(c, "^\\s*([+-]?\\d+)", 1).try_cast("int")


def stepped(c: Column, by: int, low: int = 12, high: int = 32) -> Column:
    """One step up or down, only inside the bounds."""
    return F.when((c < high) if by > 0 else (c > low), c + by).otherwise(c)


def member(array: Column, x: Column) -> Column:
    """Membership that is never null."""
    return F.coalesce(F.array_contains(array, x), F.lit(False))


def toggled(array: Column, x: Column) -> Column:
    """All occurrences removed if there are any, else one appended."""
    return F.when(member(array, x), F.array_remove(array, x)).otherwise(F.concat(array, F.array(x)))


def count_label(n: Column, one: str, many: str) -> Column:
    """``1 one``, ``n many``, and nothing for 0."""
    return F.when(n == 1, F.concat(n.cast("string"), F.lit(f" {one}"))).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))


def settings(c: Column, dark: bool = False, size: float = 16.0) -> Column:
    """Stored settings as a struct; what is missing or cannot be read takes its default."""
    read = F.from_json(c, "darkMode boolean, fontSize double")
    return F.struct(F.coalesce(read["darkMode"], F.lit(dark)).alias("darkMode"), F.coalesce(read["fontSize"], F.lit(size)).alias("fontSize"))


def by_key(table: dict[str, str], key: Column, fallback_key: str, explicit: Column | None = None) -> Column:
    """An explicit value, else the map's, else that of the fallback key."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = [F.try_element_at(m, key), F.try_element_at(m, F.lit(fallback_key))]
    return F.coalesce(*([explicit] if explicit is not None else []), *found)


def store_url(platform: Column, android: Column, ios: Column, site: Column) -> Column:
    """The store of the platform, else the site."""
    return F.coalesce(F.when(platform == "android", android).when(platform == "ios", ios), site)


def target(route: Column, url: Column) -> Column:
    """Where an entry leads: its route before its url, with the kind of either."""
    kind = F.when(route.isNotNull(), "route").when(url.isNotNull(), "url")
    return F.struct(kind.alias("kind"), F.coalesce(route, url).alias("to"))


def pray_label(prayed: Column) -> Column:
    """Label of the toggle by whether it is on."""
    return F.when(prayed, "Orando").otherwise("Orar")


def role_badge(admin: Column) -> Column:
    return F.when(admin, "Admin").otherwise("Membro")


def row_key(*parts: Column) -> Column:
    """Composite key of a row, such as book-chapter-verse-place."""
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def same(a: Column, b: Column) -> Column:
    """Whether two fields agree; two nulls do."""
    return a.eqNullSafe(b)


def at_least(c: Column, n: int) -> Column:
    """Whether a text has ``n`` characters or more; null has none."""
    return F.coalesce(F.length(c), F.lit(0)) >= n


def _unmarked() -> tuple[str, str]:
    """Letters that Unicode takes apart into one letter and marks, and these letters, by rule over the basic plane."""
    marked, plain = [], []
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0xFFFE)]):
        first, *rest = unicodedata.normalize("NFD", c)
        if rest and all(unicodedata.category(x) == "Mn" for x in rest):
            marked.append(c)
            plain.append(first)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _unmarked()


def folded(c: Column) -> Column:
    """A key that ignores case and accents, for search, joins and order: jo finds jó, whether it is one sign or a letter and a mark."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), _MARKED, _PLAIN)


def found_folded(text: Column, needle: str) -> Column:
    """Whether ``text`` holds ``needle``, case and accents aside."""
    return F.contains(folded(text), folded(F.lit(needle)))


def in_language_order(c: Column, locale: str = "UNICODE_CI_AI") -> Column:
    """A text that compares, groups and sorts by a collation: letters before their accents and case."""
    return F.collate(c, locale)
