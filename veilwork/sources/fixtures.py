"""Synthetic sources: template texts, weighted scenarios and keyed draws, the same on any partitioning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilwork.session import load, spread

# Names, towns and companies of the template texts; addresses have the names folded
FIRST, FIRST_FOLDED = "Werner,Käthi,Sandra,Livia,Reto,Monika,Stefan,Beat,Simon,Peter", "werner,kaethi,sandra,livia,reto,monika,stefan,beat,simon,peter"
LAST, LAST_FOLDED = "Müller,Bürki,Bieri,Marti,Hofer,Nyffeler,Häberli,Zbinden,Iseli,Meier,Selhofen", "mueller,buerki,bieri,marti,hofer,nyffeler,haeberli,zbinden,iseli,meier,selhofen"
TOWNS = "Murten,Lyss,Bern,Biel/Bienne,Wohlen bei Bern"

#: Tickets, one a customer, in SQL that Spark and other engines read alike. {customer} is the table.
TICKETS = f"""
SELECT c_custkey AS doc_id, CASE c_custkey % 7
  WHEN 0 THEN concat('Von: ', name, ' <', mail, '>', chr(10), 'Guten Tag ', other_first, chr(10), 'geboren am 1980-02-0', c_custkey % 9 + 1, ' laut Akte.')
  WHEN 1 THEN concat('[08:31] ', name, ': hat jemand den Ordner NAT-2025-', lpad(CAST(c_custkey % 10000 AS varchar(8)), 4, '0'), ' gesehen?', chr(10), '[08:3', c_custkey % 10, '] ', other, ': nein')
  WHEN 2 THEN concat('Lieferung: Freiburgstrasse ', c_custkey % 90 + 1, ', 3280 ', town, chr(10), 'Kontakt am Standort ', town, ' ist ', last, ', Telefon +41 79 566 86 ', lpad(CAST(c_custkey % 100 AS varchar(8)), 2, '0'))
  WHEN 3 THEN concat('--- Kommentar ', name, ', 14:31 ---', chr(10), 'Störung bei ', last, ' Metallbau GmbH gemeldet.', chr(10), 'Zahlung an ', last, ' Metallbau GmbH von CHF 1''250.00 am 2025-03-1', c_custkey % 10)
  WHEN 4 THEN concat('IBAN CH93 0076 2011 6238 5295 7, AHV 756.9217.0769.85, Host 10.0.', c_custkey % 200, '.7', chr(10), 'Anfrage K-', lpad(CAST(c_custkey % 100000 AS varchar(8)), 5, '0'), ' von ', mail, ' an rechnung@natron.io')
  WHEN 5 THEN concat('Erstkontakt ', name, ' (+41 79 566 86 75) oder ', other, ' (Netzwerk)', chr(10), 'Rückfragen: ', other_mail)
  ELSE concat('Nichts zu ', last, chr(10), 'Werk ', town, ' bleibt zu.') END AS text
FROM (SELECT c_custkey, concat(first, ' ', last) AS name, concat(first_folded, '.', last_folded, '@firma.example') AS mail, last, town, other_first, concat(other_first, ' ', other_last) AS other, concat(other_first_folded, '.', other_last_folded, '@firma.example') AS other_mail
  FROM (SELECT c_custkey, split_part('{FIRST}', ',', CAST(c_custkey % 10 + 1 AS int)) AS first, split_part('{FIRST_FOLDED}', ',', CAST(c_custkey % 10 + 1 AS int)) AS first_folded,
    split_part('{LAST}', ',', CAST(c_custkey % 11 + 1 AS int)) AS last, split_part('{LAST_FOLDED}', ',', CAST(c_custkey % 11 + 1 AS int)) AS last_folded, split_part('{TOWNS}', ',', CAST(c_custkey % 5 + 1 AS int)) AS town,
    split_part('{FIRST}', ',', CAST((c_custkey + 3) % 10 + 1 AS int)) AS other_first, split_part('{FIRST_FOLDED}', ',', CAST((c_custkey + 3) % 10 + 1 AS int)) AS other_first_folded,
    split_part('{LAST}', ',', CAST((c_custkey + 5) % 11 + 1 AS int)) AS other_last, split_part('{LAST_FOLDED}', ',', CAST((c_custkey + 5) % 11 + 1 AS int)) AS other_last_folded FROM {{customer}}) p) q
"""


#: Shapes of the records' values: # is a digit, @ a letter, both drawn by a hash of the record and the line.
SHAPES = (
    "user##@example.org", "+1 (###) ###-####", "+41 ## ### ## ##", "10.###.##.#", "fe80:0:0:0:#:#:#:#", "fe80::##:#", "4###############", "4### #### #### ####", "3### ###### #####", "CH93 0076 2011 6238 5295 #", "19##-0#-1#", "1#.0#.20##",
    "Freiburgstrasse ##, 32## Lyss", "https://a.example.org/##", "0A:#F:##:##:##:##", "bc1q##############################", "756.####.####.##", "###-##-####", "1EG#-TE#-MK##", "####-####-#", "### ### ####", "AB ## ## ## C", "########@", "X#######@", "###########",
    "######A###@", "ABCDEF##A##B###@", "### ### ###", "S#######@", "ABCPE####@", "2### #### ####", "##ABCDE####A1Z#", "######-1######", "A########", "9##-7#-####", "account number: ##########", "drivers licence: A#######", "AB#######", "AB#######C", "IT###########", "YA#######",
    "CA#####AB", "## ### ### ###", "2### ##### #", "20#######A", "KA##AB####", "ABC#######", "A1# ###1", "##-##-######-##", "######-5######", "M###A####", "###-##-#####", "1-####-#####-##-#", "## years old", "####-##-#####", "A###-##-####B", "#################", "NAT-20##-####",
)


def shaped(shape: str, line: int) -> str:
    """SQL of a value of the shape, the same in Spark and other engines."""
    drawn, out, used = f"translate(md5(CAST(concat(c_custkey, ':{line}') AS {{bytes}})), 'abcdef', '012345')", [], 0
    for run in re.findall(r"#+|@|[^#@]+", shape.replace("user##@", "user##\0")):
        if run[0] == "#":
            out.append(f"substr({drawn}, {used + 1}, {len(run)})")
            used += len(run)
        elif run == "@":
            out.append(f"substr('ABCDEFGHJK', CAST(substr({drawn}, {used + 1}, 1) AS int) + 1, 1)")
            used += 1
        else:
            out.append("'" + run.replace("\0", "@") + "'")
    return f"concat({', '.join(out)})"


def records_sql(customer: str, as_bytes: str) -> str:
    """A record a customer: a line of each shape."""
    lines = ", chr(10), ".join(f"'{n}: ', {shaped(s, n)}" for n, s in enumerate(SHAPES)).replace("{bytes}", as_bytes)
    return f"SELECT c_custkey AS doc_id, concat({lines}) AS text FROM {customer}"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their keys, of each of which a text is made."""
    return spread(load(spark, sf_dir, "customer").select("c_custkey"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(records_sql("{customer}", "binary"), customer=customers(spark, sf_dir))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TICKETS, customer=customers(spark, sf_dir))


def drawn(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) for a row's key: a draw that no other row, task or retry changes."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def times(a: Column, b: Column) -> Column:
    """a * b modulo 2^32, of numbers below 2^32, by halves, so that no product passes 2^63."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


# The step and the multipliers of the 32-bit generator
STEP, ODD, MORE = 0x6D2B79F5, 1, 61


def seeded(seed: int, n: Column) -> Column:
    """Draw n (from 1) of the sequence of a seed, in [0, 1). The generator's state grows by STEP a draw, so that of draw n is known
    without the draws before it: a column needs no order, and any row can be drawn by itself."""
    mask = F.lit(0xFFFFFFFF)
    state = (F.lit(seed & 0xFFFFFFFF) + times(n.cast("long").bitwiseAND(mask), F.lit(STEP).cast("long"))).bitwiseAND(mask)
    first = times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(ODD)))
    second = first.bitwiseXOR((first + times(first.bitwiseXOR(F.shiftright(first, 7)), first.bitwiseOR(F.lit(MORE)))).bitwiseAND(mask))
    return second.bitwiseXOR(F.shiftright(second, 14)) / F.lit(float(1 << 32))


# Scenarios of the traffic, their share of its part, and whether they hold personal data
SCENARIOS = (("ping", 20, False), ("echo", 15, False), ("download", 10, False), ("upload", 10, False), ("form", 10, False), ("slow", 5, False), ("error", 5, False), ("contact", 50, True), ("ticket", 30, True), ("medical", 20, True))


def scenario(draw_part: Column, draw_scenario: Column, personal: float) -> Column:
    """The scenario of two draws: first whether it has personal data, with the given share, then which by weight."""

    def pick(held: bool) -> Column:
        chosen = [(n, w) for n, w, p in SCENARIOS if p == held]
        total, upto, out = sum(w for _, w in chosen), 0, None
        for name, weight in chosen:
            upto += weight
            test = draw_scenario * total < upto
            out = F.when(test, name) if out is None else out.when(test, name)
        return out

    return F.when(draw_part < personal, pick(True)).otherwise(pick(False))
