"""Ground truth: which values of a document a redaction has to hide, from shapes and a gazetteer, and what was made of them.

An entity is kind, value, start, end (exclusive, code points), tier (strong or weak), policy (redact, keep or informational),
index in its document and line. ``docs`` has doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.functions import detect, text as T
from veilwork.operators import gazetteer, literals, spans
from veilwork.sources import policy

# Shapes in order of precedence, and the words before a birth date
SHAPES = (
    ("ADDRESS", r"\b[A-ZÄÖÜ][a-zäöüéèà]+(?:strasse|gasse|weg|platz|rain|allee|ring|matte|halde|feld|steig|hof|str\.)\s+[0-9]+[a-z]?,\s*[0-9]{4}\s+[A-ZÄÖÜ][0-9A-Za-z_äöüéèà]+(?:/[A-ZÄÖÜ][0-9A-Za-z_äöüéèà]+)?(?:\s+bei\s+[A-ZÄÖÜ][0-9A-Za-z_äöüéèà]+)?"),
    ("IBAN", r"\bCH[0-9]{2}(?:\s?[0-9]{4}){4}\s?[0-9]\b"),
    ("EMAIL", r"(?i)\b[a-z0-9_.+-]+@[a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.[a-z]{2,}\b"),
    ("AHV", r"\b756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}\b"),
    ("PHONE", r"\+41\s?[0-9]{2}\s?[0-9]{3}\s?[0-9]{2}\s?[0-9]{2}\b"),
    ("CONTRACT_ID", r"\bNAT-[0-9]{4}-\r?\n?[0-9]{4}\b"),
    ("TICKET_ID", r"\bK-[0-9]{5}\b"),
    ("MONEY", r"\bCHF\s[0-9'’]+(?:\.[0-9]{2})?"),
    ("DATE", r"\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\b"),
    ("IP", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:/[0-9]{1,2})?\b"),
)
# Strings of which every match of a shape has one
NEEDED = {"ADDRESS": (",",), "IBAN": ("CH",), "EMAIL": ("@",), "AHV": ("756.",), "PHONE": ("+41",), "CONTRACT_ID": ("NAT-",), "TICKET_ID": ("K-",), "MONEY": ("CHF",), "DATE": ("-",), "IP": (".",)}
BIRTH_CUE, CUE_LENGTH = r"(?i)(?:geboren am|Geburtsdatum|geb\.)\s*$", 24
REDACT = tuple(policy.POLICY["redact"])
OVERRIDE = ["doc_id", "kind", "value", "start", "end", "tier", "policy"]
# Keys of documents that are sent to all tasks; more are shuffled
MOST_KEYS = 1 << 20


def shaped(rows: DataFrame) -> DataFrame:
    """rows (with a text) and ``shapes``: the text's candidates by shape, an array of start, end, value, kind, tier, ordinal. Step by step,
    a column a shape: what stands outside of lambdas is compiled, and texts with one match of a shape, as most, need no lambda."""

    def of(kind: str, ordinal: int):
        def one(m: Column) -> Column:
            start = m["start"]
            before = F.substring(F.col("text"), F.greatest(F.lit(1), start - CUE_LENGTH + 1), F.least(F.lit(CUE_LENGTH), start))
            named = F.when(before.rlike(BIRTH_CUE), "BIRTHDATE").otherwise(kind) if kind == "DATE" else F.lit(kind)
            return F.struct(start.alias("start"), m["end"].alias("end"), m["value"].alias("value"), named.alias("kind"), F.lit("strong").alias("tier"), F.lit(ordinal).alias("ordinal"))

        return one

    given, mark = rows.columns, F.lit(detect.MARK)
    marked = rows.select(*given, *[F.when(T.has_any(F.col("text"), NEEDED[k]), F.expr(detect.marked_sql("text", p))).alias(f"_{k}") for k, p in SHAPES])
    pieces = marked.select(*given, *[F.when(F.contains(F.col(f"_{k}"), mark), F.split(f"_{k}", detect.MARK, -1)).alias(f"_{k}") for k, _ in SHAPES])
    nothing = F.expr(f"cast(array() as {literals.PLACES})")
    told = [F.when(F.col(f"_{k}").isNull(), nothing).when(F.size(f"_{k}") == 3, F.array(of(k, n)(F.expr(detect.one_sql("text", f"_{k}"))))).otherwise(F.transform(F.expr(detect.many_sql("text", f"_{k}")), of(k, n))) for n, (k, _) in enumerate(SHAPES)]
    return pieces.select(*given, F.concat(*told).alias("shapes"))


def found_in(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text and all: a text's candidates, by shape and by literal, beside it; nothing is dealt out to put them together."""
    rows = literals.beside(docs.where("text is not null").select("doc_id", "text"), known)
    return shaped(rows).select("doc_id", "text", F.concat("shapes", "places").alias("all"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, start, end, value, kind, tier, ordinal."""
    return found_in(docs, known).select("doc_id", F.explode(F.transform("all", lambda x: x)).alias("x")).select("doc_id", "x.*")


def policy_of(value: Column, kind: Column, redact: Iterable[str] = REDACT, keep: Iterable[str] = ()) -> Column:
    return F.when(value.isin(*keep) if keep else F.lit(False), "keep").when(kind.isin(*redact), "redact").otherwise("informational")


def resolved(found: DataFrame, redact: Iterable[str] = REDACT, keep: Iterable[str] = ()) -> DataFrame:
    """Entities of found (doc_id, text, all): of overlapping candidates, by start, the longer first, then the earlier source, then by kind
    and value; with policy, index and line."""
    each = found.withColumn("kept", spans.non_overlapping("all", "start, -(end - start), ordinal, kind, value, tier"))
    # lines beside the entities, not in them: who asks for no lines has none counted
    each = each.withColumn("lines", F.transform("kept", lambda x: T.line_number(F.col("text"), x["start"])))
    # not the column itself: Spark would filter by its size, and work out all that it is made of once more for that
    rows = each.select("doc_id", "lines", F.posexplode(F.transform("kept", lambda x: x)).alias("index", "x"))
    return rows.select("doc_id", "index", "x.kind", "x.value", "x.start", "x.end", "x.tier", policy_of(F.col("x.value"), F.col("x.kind"), redact, keep).alias("policy"), F.get("lines", F.col("index")).alias("line"))


def entities(docs: DataFrame, redact: Iterable[str] = REDACT, keep: Iterable[str] = ()) -> DataFrame:
    return resolved(found_in(docs, gazetteer.build(docs).literals()), redact, keep)


def corrected(docs: DataFrame, overrides: DataFrame, redact: Iterable[str] = REDACT, keep: Iterable[str] = ()) -> DataFrame:
    """``overridden`` of the docs' entities: documents that overrides name are not searched, but what they vouch for counts in all others.
    overrides as from checked_overrides, settled."""
    ids = overrides.select("doc_id").distinct()
    rest = docs.join(F.broadcast(ids) if ids.count() <= MOST_KEYS else ids, "doc_id", "left_anti")
    found = resolved(found_in(rest, gazetteer.build(docs).literals()), redact, keep)
    return found.select(OVERRIDE).unionByName(overrides.where("problem is null").select(OVERRIDE))


def checked_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides (doc_id, kind, value, start, end, tier, policy) and problem: null, or why the row does not count any more."""
    rows = overrides.join(docs.select("doc_id", "text", F.lit(True).alias("_known")), "doc_id", "left")
    there = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value")
    problem = F.when(F.col("_known").isNull(), F.lit("no document with that id")).when(~F.coalesce(there, F.lit(False)), F.format_string('"%s" is not at %d..%d any more', "value", "start", "end"))
    return rows.select(*overrides.columns, problem.alias("problem"))


def overridden(truth: DataFrame, overrides: DataFrame) -> DataFrame:
    """truth, with a document's whole list replaced where overrides name the document. overrides as from checked_overrides."""
    ids = overrides.select("doc_id").distinct()
    return truth.join(ids, "doc_id", "left_anti").select(OVERRIDE).unionByName(overrides.where("problem is null").select(OVERRIDE))


def totals(truth: DataFrame) -> DataFrame:
    """grouping (policy, tier or kind), key, n."""
    kind = F.when(F.col("tier") == "weak", F.concat("kind", F.lit(" (weak)"))).otherwise(F.col("kind"))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), c.alias("key")) for g, c in (("policy", F.col("policy")), ("tier", F.col("tier")), ("kind", kind))]))
    return truth.select(each.alias("x")).groupBy("x.grouping", "x.key").agg(F.count("*").alias("n"))
