"""Traffic routing: predicates on hosts, paths, media types and headers, and the decision ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Headers and schemes that sign a payload
SIGNATURE_MARKS = ("signature", "hmac")
SIGNATURE_HEADERS = ("x-amz-content-sha256", "paypal-transmission-sig")
SIGNING_SCHEMES = ("aws4-hmac-sha256", "signature", "hmac")
BODY_LIMIT, MOST_BODY_LIMIT = 1 << 20, 64 << 20


def covers(pattern: str, host: Column) -> Column:
    """Whether a host is the pattern's or below it: ``*.`` and a dot at the end do not count, nor does case."""
    p = pattern.lower().removeprefix("*.").rstrip(".")
    h = F.regexp_replace(F.lower(host), r"\.+$", "")
    return (h == p) | F.endswith(h, F.lit("." + p))


def path_allowed(rules: list[tuple[str, list[str]]], host: Column, path: Column) -> Column:
    """The first rule whose host fits decides: only its path prefixes are in scope; a host without rule is."""
    out = None
    for pattern, prefixes in rules:
        test = F.lit(False)
        for p in prefixes:
            test = test | F.startswith(F.lower(path), F.lit(p.lower()))
        out = F.when(covers(pattern, host), test) if out is None else out.when(covers(pattern, host), test)
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def inspectable(content_type: Column) -> Column:
    """Responses that may be rewritten: text but no script, style or event stream; json, xml, forms."""
    t = media_type(content_type)
    return F.coalesce((F.startswith(t, F.lit("text/")) | F.endswith(t, F.lit("json")) | F.endswith(t, F.lit("xml")) | (t == "application/x-www-form-urlencoded")) & ~script_or_style(content_type) & ~event_stream(content_type), F.lit(False))


def script_or_style(content_type: Column) -> Column:
    t = media_type(content_type)
    return F.endswith(t, F.lit("javascript")) | F.endswith(t, F.lit("ecmascript")) | (t == "text/css")


def event_stream(content_type: Column) -> Column:
    return media_type(content_type) == "text/event-stream"


def textual(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).rlike("json|text"), F.lit(False))


def body_syntax(content_type: Column) -> Column:
    return F.when(F.lower(content_type).contains("json") | event_stream(content_type), "Json").otherwise("Text")


def bot_path(path: Column) -> Column:
    return F.startswith(F.lower(path), F.lit("/cdn-cgi/"))


def signed(headers: Column) -> Column:
    """headers: map of names to values."""
    def signs(k: Column, v: Column) -> Column:
        name = F.lower(k)
        test = name.isin(*SIGNATURE_HEADERS)
        for mark in SIGNATURE_MARKS:
            test = test | name.contains(mark)
        return test | (name == "authorization") & F.lower(F.substring_index(F.trim(v), " ", 1)).isin(*SIGNING_SCHEMES)

    return F.coalesce(F.size(F.map_filter(headers, signs)) > 0, F.lit(False))


def may_have_body(method: Column, status: Column) -> Column:
    return ~(F.upper(method) == "HEAD") & ~(status.between(100, 199) | status.isin(204, 205, 206, 304))


def ladder(enabled: Column, size: Column, is_bot: Column, in_scope: Column, is_signed: Column, limit: int = BODY_LIMIT) -> Column:
    """Why a request body is left alone, the first reason in order; null if it is to be rewritten."""
    return F.when(~enabled, "disabled").when(size == 0, "no body").when(is_bot, "bot check").when(~in_scope, "out of scope").when(is_signed, "signed").when(F.lit(limit > 0) & (size > limit), "too large")


def treatment(reason: Column, n_entities: Column) -> Column:
    return F.when(reason.isNotNull(), "passthrough").when(n_entities == 0, "clean").otherwise("treated")


def device_kind(user_agent: Column) -> Column:
    ua = F.lower(user_agent)
    has = lambda *marks: F.coalesce(ua.rlike("|".join(marks)), F.lit(False))
    return F.when(has("ipad", "tablet"), "Tablet").when(has("iphone", "mobile", "android"), "Phone").when(has("macintosh", "windows", "x11"), "Laptop").otherwise("Device")


def risk_tier(probability: Column) -> Column:
    return F.when(probability >= 0.7, 3).when(probability >= 0.4, 2).otherwise(1)


def host_matches(pattern: Column, host: Column) -> Column:
    """``covers`` with the pattern in a column."""
    p = F.regexp_replace(F.regexp_replace(F.lower(pattern), r"^\*\.", ""), r"\.+$", "")
    h = F.regexp_replace(F.lower(host), r"\.+$", "")
    return (h == p) | F.endswith(h, F.concat(F.lit("."), p))


def suffixes(host: Column) -> Column:
    """A host and the hosts above it: what a pattern may be to fit, so that rules meet requests by an equi-join."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ruled(requests: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """requests (key, host, path, ...) and _rule: of the rules (ordinal, host, prefix, ...) that fit the first by ordinal, or null.

    A host has few hosts above it, so each request becomes a few rows that meet the rules by equality; the first is taken before
    rows are sent on.
    """
    at = rules.select(F.regexp_replace(F.regexp_replace(F.lower("host"), r"^\*\.", ""), r"\.+$", "").alias("_at"), F.struct("ordinal", *[c for c in rules.columns if c != "ordinal"]).alias("_r"))
    each = requests.select(key, "path", F.explode(suffixes(F.col("host"))).alias("_at")).join(at, "_at")
    fits = each.where(F.startswith(F.lower("path"), F.lower("_r.prefix"))).groupBy(key).agg(F.min("_r").alias("_rule"))
    return requests.join(fits, key, "left")


def blocked(requests: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The requests that a block rule refuses: 403, and no trace of them is kept."""
    return ruled(requests, rules, key).where("_rule is not null").drop("_rule")


def traced(requests: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    return ruled(requests, blocks, key).where("_rule is null").drop("_rule")


def detoured(requests: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """requests and target: where the first rule that fits sends the request; null without rule, and for the target's own url."""
    rows = ruled(requests, rules, key)
    own = F.lower(F.concat("host", "path")) == F.lower(F.regexp_replace("_rule.target", "^[a-z]+://", ""))
    return rows.withColumn("target", F.when(~own, F.col("_rule.target"))).drop("_rule")


def bypassed(requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """requests and bypass: whether the host, or one above it, is on the list."""
    listed = hosts.select(F.regexp_replace(F.regexp_replace(F.lower("host"), r"^\*\.", ""), r"\.+$", "").alias("_at")).distinct()
    found = requests.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("_at")).join(listed, "_at", "left_semi").select("host").distinct()
    return requests.join(found.withColumn("bypass", F.lit(True)), "host", "left").withColumn("bypass", F.coalesce("bypass", F.lit(False)))


def destination(target: Column, authority: Column) -> Column:
    """The url a request is for: absolute form as it is, origin form inside a tunnel by the tunnel's authority; else null."""
    return F.when(F.startswith(target, F.lit("/")) & authority.isNotNull(), F.concat(F.lit("https://"), authority, target)).when(target.rlike(r"(?i)^https?://[^/?#]+"), target)


def plain_ip(ip: Column) -> Column:
    return F.coalesce(F.regexp_replace(ip, r"(?i)^::ffff:(?=[0-9.]+$)", ""), F.lit("unknown"))


def identity(user_agent: Column, ip: Column) -> Column:
    """What tells devices apart: the kind the agent claims, and the address."""
    return F.concat(device_kind(user_agent), F.lit("|"), plain_ip(ip))


def label(user_agent: Column, ip: Column) -> Column:
    """A short name of a device: its kind, and the end of its address."""
    address = plain_ip(ip)
    end = F.when(address.contains("."), F.concat(F.lit("."), F.substring_index(address, ".", -1))).otherwise(F.substring_index(address, ":", -1))
    return F.concat(device_kind(user_agent), F.lit(" · "), end)


def size_text(n: Column) -> Column:
    """Bytes as text: at most one digit after the point, none if that is a zero."""
    short = lambda x: F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(short(n / 1024.0), F.lit(" KB"))).otherwise(F.concat(short(n / 1048576.0), F.lit(" MB")))


def clean_reason(size: Column, content_type: Column, near_misses: Column) -> Column:
    of = F.when(F.coalesce(F.length(content_type), F.lit(0)) > 0, F.concat(F.lit(" of "), F.trim(F.substring_index(content_type, ";", 1)))).otherwise(F.lit(""))
    missed = F.when(near_misses == 0, "").when(near_misses == 1, " (1 near miss)").otherwise(F.concat(F.lit(" ("), near_misses.cast("string"), F.lit(" near misses)")))
    return F.concat(F.lit("nothing found in "), size_text(size), of, missed)


def identifiers_reason(n: Column) -> Column:
    return F.when(n == 1, "1 identifier").otherwise(F.concat(n.cast("string"), F.lit(" identifiers")))


def timing(total: Column, *steps: Column) -> Column:
    """What of the total no step accounts for, never below 0; a step that was not reached is null, and counts 0."""
    spent = F.lit(0.0)
    for s in steps:
        spent = spent + F.coalesce(s, F.lit(0.0))
    return F.greatest(F.lit(0.0), total - spent)


# What a short tag goes by, in order; a mark that ends with a bar is a prefix
TAGS = (("css", "css"), ("javascript", "js"), ("font/", "font"), ("image/", "image"), ("json", "json"))


# The routes whose body a receiver reads
READ = ("/api/v1/forms/intake", "/api/v1/chat/completions", "/upload")


def reads_body(path: Column) -> Column:
    """Whether the body of a request to the path is read; no path's is not."""
    return F.coalesce(path.isin(*READ), F.lit(False))


def type_tag(content_type: Column) -> Column:
    """A short tag of a content type: by mark, else its subtype; of none, asset."""
    out = F.when(F.coalesce(content_type, F.lit("")) == "", "asset")
    for mark, tag in TAGS:
        out = out.when(F.startswith(content_type, F.lit(mark)) if mark.endswith("/") else F.contains(content_type, F.lit(mark)), tag)
    return out.otherwise(F.coalesce(F.get(F.split(content_type, "/"), 1), F.lit("asset")))
