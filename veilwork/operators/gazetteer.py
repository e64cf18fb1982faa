"""Who and what a corpus is about, from its own structure: people, organisations and towns that some context vouches for.

All results are tables of distinct names, built by narrow extractions, one shuffle for each ``distinct`` and equi-joins; a
name vouched for in one document counts in all. ``docs`` has doc_id and text; null texts are left out, an empty corpus gives
empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.functions import text as T
from veilwork.operators import literals
from veilwork.session import settled

# The shape of a name, the contexts that only names stand in (group 1 is the name), towns, organisations, addresses
WORD = "[A-ZÄÖÜ][a-zäöüéèàçëïâêîôû]+(?:[-'][A-ZÄÖÜ]?[a-zäöüéèàçëïâêîôû]+)*"
NAME = f"{WORD} {WORD}"
VOUCHERS = (
    rf"({NAME})\s*<[^>]+@",
    rf"(?m)^\[[0-9]{{1,2}}:[0-9]{{2}}\]\s+({NAME})\s*:",
    rf"(?m)^(?:Von|An|Cc|Auftraggeber|Meldende Person|Ansprechperson|Bearbeitung|Zugewiesen an|Verantwortlich)\s*:\s*({NAME})",
    rf"Kommentar\s+(?:von\s+)?({NAME})",
    rf"({NAME})\s*\((?:IT-Leitung|Netzwerk|Betriebsleitung|HR|Finanzen|Buchhaltung|Einkauf|Gesch)",
    rf"(?m)^\|[^|]+\|\s*({NAME})\s*\|",
    rf"({NAME})\s*\(\+41",
)
FULL_NAME = rf"\b({NAME})\b"
LOCAL_PART = r"(?i)\b([a-z0-9_.+-]+)@[a-z0-9_-]+\.[a-z]{2,}\b"
ORGANISATION = rf"\b({WORD}(?: {WORD}| [A-ZÄÖÜ][a-zäöüß]+)*? (?:AG|GmbH|Genossenschaft))\b"
TOWN = r",\s*[0-9]{4}\s+([A-ZÄÖÜ][0-9A-Za-z_äöüéèà]+(?:/[A-ZÄÖÜ][0-9A-Za-z_äöüéèà]+)?(?:\s+bei\s+[A-ZÄÖÜ][0-9A-Za-z_äöüéèà]+)?)"

#: Strings of which every match of a pattern has one
NEEDED = {
    **dict(zip(VOUCHERS, (("<",), ("[",), (":",), ("Kommentar",), ("(",), ("|",), ("(+41",)), strict=True)),
    LOCAL_PART: ("@",), ORGANISATION: (" AG", " GmbH", " Genossenschaft"), TOWN: (",",),
}


def groups(pattern: str) -> Column:
    """The first groups of a pattern's matches in the text."""
    return T.if_any(F.col("text"), NEEDED.get(pattern, ()), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))


def extracted(docs: DataFrame, patterns: tuple[str, ...] | str, name: str = "name") -> DataFrame:
    """The distinct first groups of the patterns' matches."""
    patterns = (patterns,) if isinstance(patterns, str) else patterns
    found = F.flatten(F.array(*[groups(p) for p in patterns]))
    return docs.where("text is not null").select(F.explode(found).alias(name)).select(F.trim(name).alias(name)).distinct()


def vouched(docs: DataFrame) -> DataFrame:
    return extracted(docs, VOUCHERS)


def corroborated(docs: DataFrame) -> DataFrame:
    """Capitalised pairs whose folded form is the local part of a mail address somewhere in the corpus."""
    return with_mail(extracted(docs, FULL_NAME), extracted(docs, LOCAL_PART))


def with_mail(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    parts = parts.select(F.lower("name").alias("part")).distinct()
    return pairs.withColumn("part", T.fold_local_part(F.col("name"))).join(parts, "part", "left_semi").select("name")


def people(docs: DataFrame) -> DataFrame:
    return vouched(docs).union(corroborated(docs)).distinct()


def organisations(docs: DataFrame) -> DataFrame:
    """Names with a suffix of companies, less those that end with a shorter one: an anti-join on each name's tails."""
    return shortest(extracted(docs, ORGANISATION))


def shortest(found: DataFrame) -> DataFrame:
    words = F.split("name", " ")
    tail = F.explode(F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("tail")
    longer = found.select("name", tail).join(found.select(F.col("name").alias("tail")), "tail", "left_semi").select("name").distinct()
    return found.join(longer, "name", "left_anti")


def weak_names(people: DataFrame, organisations: DataFrame) -> DataFrame:
    """part (first or last) and name: the words of people's names that are no words of an organisation's."""
    space = F.instr("name", " ")
    parts = people.select(F.explode(F.array(F.struct(F.lit("first").alias("part"), F.substring_index("name", " ", 1).alias("name")), F.struct(F.lit("last").alias("part"), F.substring(F.col("name"), space + 1, F.length("name")).alias("name")))).alias("x")).select("x.*")
    words = organisations.select(F.explode(F.split("name", " ")).alias("name"))
    return parts.distinct().join(words, "name", "left_anti").select("part", "name")


def towns(docs: DataFrame) -> DataFrame:
    """Towns after a postcode; of one that lies by another, the other too."""
    return with_neighbours(extracted(docs, TOWN))


def with_neighbours(found: DataFrame) -> DataFrame:
    return found.union(found.select(F.regexp_extract("name", r"\sbei\s(.+)$", 1))).where("name != ''").distinct()


@dataclass(frozen=True)
class Gazetteer:
    people: DataFrame
    organisations: DataFrame
    towns: DataFrame
    weak: DataFrame

    def literals(self) -> DataFrame:
        """literal, kind, tier, and ordinal: which source comes first among equal spans."""
        of = lambda df, kind, tier, n: df.select(F.col("name").alias("literal"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), F.lit(n).alias("ordinal"))
        # all texts must have been read before the first is searched: the table is small, and settled
        return settled(of(self.people, "PERSON", "strong", 100).unionByName(of(self.organisations, "ORG", "strong", 101)).unionByName(of(self.towns, "LOCATION", "strong", 102)).unionByName(of(self.weak.select("name").distinct(), "PERSON", "weak", 103)))


SOURCES = {"voucher": VOUCHERS, "pair": (FULL_NAME,), "part": (LOCAL_PART,), "organisation": (ORGANISATION,), "town": (TOWN,)}


def mentions(docs: DataFrame) -> DataFrame:
    """source, name: what all the patterns extract, in one pass over the texts. A row a source first, so that no lambda is needed: what
    stands outside of lambdas is compiled."""
    each = F.array(*[F.struct(F.lit(source).alias("source"), F.concat(*[groups(p) for p in patterns]).alias("names")) for source, patterns in SOURCES.items()])
    rows = docs.where("text is not null").select(F.explode(each).alias("m")).select("m.source", F.explode("m.names").alias("name"))
    return rows.select("source", F.trim("name").alias("name")).distinct()


def build(docs: DataFrame) -> Gazetteer:
    found = settled(mentions(docs))
    of = lambda source: found.where(F.col("source") == source).select("name")
    people_, orgs = settled(of("voucher").union(with_mail(of("pair"), of("part"))).distinct()), settled(shortest(of("organisation")))
    return Gazetteer(people_, orgs, with_neighbours(of("town")), weak_names(people_, orgs))


def occurrences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, start, end and the columns of known (literal, ...), for each place where a literal stands by itself."""
    return literals.found(docs, known).join(known, "literal")
