"""Text, number and check-digit functions: Column to Column, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# How names are folded to the local part of a mail address
FOLDS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"))
PLAIN = ("éèêëàâçîïôû", "eeeeaaciiou")


def single_line(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"\s*[\r\n]+\s*", " "))


def fold_local_part(name: Column) -> Column:
    out = F.lower(name)
    for a, b in FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.translate(out, *PLAIN), r"['\s]+", "."), r"[^a-z.-]", "")


def transliterate(name: Column) -> Column:
    for a, b in (*FOLDS, ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def levenshtein_ratio(a: Column, b: Column) -> Column:
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise((n + m - F.levenshtein(a, b)) / (n + m))


def contains_folded(text: Column, name: Column) -> Column:
    return F.contains(F.lower(text), F.lower(name))


def has_any(text: Column, needed: tuple[str, ...]) -> Column:
    """Whether the text has one of the needed strings; of none, always. For patterns whose every match has one of them: most texts have
    none, and to look for a plain string takes a fraction of a pattern's time."""
    return reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in needed]) if needed else F.lit(True)


def if_any(text: Column, needed: tuple[str, ...], found: Column) -> Column:
    """An array worked out of texts that have one of the needed strings, else empty; without needed strings, of all texts."""
    return F.when(has_any(text, needed), found).otherwise(F.array()) if needed else found


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def excerpt(text: Column, focus: Column, width: int) -> Column:
    """About width characters of text with the first place of focus in the middle, or the first width where it is not, with
    ellipses where something is left out."""
    dots = lambda test: F.when(test, F.lit("…")).otherwise(F.lit(""))
    at = F.when(F.length(focus) > 0, F.instr(text, focus) - 1).otherwise(F.lit(-1))
    pad = F.greatest(F.lit(0), F.floor((width - F.length(focus)) / 2)).cast("int")
    begin, end = F.greatest(F.lit(0), at - pad), F.least(F.length(text), at + F.length(focus) + pad)
    around = F.concat(dots(begin > 0), F.substring(text, begin + 1, end - begin), dots(end < F.length(text)))
    return F.when(at < 0, F.concat(F.left(text, F.lit(width)), dots(F.length(text) > width))).otherwise(around)


def capped(text: Column, most: int = 65_536) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("…")))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f kB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def line_number(text: Column, start: Column) -> Column:
    """Lines from 1; start from 0."""
    before = F.left(text, start)
    return 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def ean13_check(digits12: Column) -> Column:
    """The check digit of twelve digits."""
    digits = F.transform(F.split(digits12, ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda s, d: s + d)
    return (10 - total % 10) % 10


def mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0).cast("bigint"), lambda r, d: (r * 10 + d.cast("bigint")) % 97)


def iban_check(country_digits: str, bban: Column) -> Column:
    """The two check digits; country_digits are the letters as numbers (A is 10), such as 1217 for CH."""
    return F.lpad((98 - mod97(F.concat(bban, F.lit(country_digits + "00")))).cast("string"), 2, "0")


def iban_valid(iban: Column) -> Column:
    plain = F.upper(F.regexp_replace(iban, r"\s", ""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    codes = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.coalesce(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod97(F.when(codes.rlike("^[0-9]+$"), codes)) == 1), F.lit(False))
