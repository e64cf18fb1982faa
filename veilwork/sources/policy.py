"""Policies and settings: what a file gives, merged key by key with defaults.

A file is JSON text. A key that it gives, of the default's type, counts; one that it leaves out, or gives in another type, is the
default's; text that is no JSON object, or no text at all, gives the defaults. Unknown keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a redaction hides by default, and the limits of the data path
POLICY = {"redact": ["PERSON", "EMAIL", "PHONE", "IBAN", "AHV", "ADDRESS", "BIRTHDATE"], "informational": ["DATE", "IP", "MONEY", "TICKET_ID", "CONTRACT_ID", "ORG", "LOCATION"], "keep": []}
SETTINGS = {"body_limit": 1 << 20, "ttl_hours": 48, "clients": 512, "threshold": 0.6, "inspect": True, "hosts": []}
TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string", list: "array<string>"}


def literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    return F.lit(value).cast(TYPES[type(value)])


def merged(text: Column, defaults: dict) -> Column:
    """A struct with the keys of defaults."""
    found = F.try_parse_json(text)
    found = F.when(F.schema_of_variant(found).startswith("OBJECT"), found)

    def fits(name: str, value) -> Column:
        """Whether the file gives the key in the default's type: a list of texts only, whole numbers also where fractions are meant."""
        kinds = {bool: "BOOLEAN", int: "BIGINT", float: "BIGINT|DOUBLE|DECIMAL.*", str: "STRING", list: "ARRAY<(STRING|VOID)>"}
        return F.schema_of_variant(F.try_variant_get(found, f"$.{name}", "variant")).rlike(f"^({kinds[type(value)]})$")

    return F.struct(*[F.coalesce(F.when(fits(n, v), F.try_variant_get(found, f"$.{n}", TYPES[type(v)])), literal(v)).alias(n) for n, v in defaults.items()])


def policy_of(value: Column, kind: Column, policy: Column) -> Column:
    """keep, redact or informational, by a policy struct: a value that is kept, then a kind that is hidden."""
    return F.when(F.array_contains(policy["keep"], value), "keep").when(F.array_contains(policy["redact"], kind), "redact").otherwise("informational")
