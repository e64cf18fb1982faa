"""Recognisers: text to typed, scored, located spans, without Python in the tasks.

Offsets are 0-based code points, the end exclusive. No kind goes over a line end or does without a digit, @ or colon, so the
recognisers look at the lines that have one of these only, runs of such lines at once. A recogniser may have a validator; its score is
data, and findings below THRESHOLD are near misses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.6


@dataclass(frozen=True)
class Recogniser:
    """valid: SQL of whether the value {v} is valid; {d} stands for its digits."""

    kind: str
    pattern: str
    score: float
    valid: str | None = None
    invalid_score: float = 0.3


def summed(weights: list[int], digits: str = "{d}") -> str:
    """SQL: the weighted sum of the leading digits."""
    return f"aggregate(transform(slice(split({digits}, ''), 1, {len(weights)}), (c, i) -> cast(c as int) * element_at(array({', '.join(map(str, weights))}), i + 1)), 0, (s, c) -> s + c)"


def luhn(digits: str = "{d}") -> str:
    return f"luhn_check({digits})"


LAST = "cast(right({d}, 1) as int)"
NIF = "substring('TRWAGMYFPDXBNJZSQVHLCKE', cast({n} as int) % 23 + 1, 1) = right({v}, 1)"
#: Four parts of at most 255, or eight of hexadecimal digits, less the ones that :: stands for.
IP = "if(contains({v}, ':'), regexp_count({v}, '[0-9A-Fa-f]+') <= if(contains({v}, '::'), 7, 8), not exists(split({v}, '[.]'), o -> try_cast(o as int) > 255))"
PLAIN = "upper(replace({v}, ' ', ''))"
CODES = f"array_join(transform(split(concat(substring({PLAIN}, 5), left({PLAIN}, 4)), ''), c -> if(c between '0' and '9', c, cast(ascii(c) - 55 as string))), '')"
IBAN = f"{PLAIN} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' and aggregate(split({CODES}, ''), 0, (r, c) -> (r * 10 + cast(c as int)) % 97) = 1"


def verhoeff() -> str:
    """Digits from the right, each moved by its place, multiply to 0 in the group of the pentagon's symmetries."""
    power = ["0123456789", "1576283094"]
    while len(power) < 8:
        power.append("".join(power[1][int(c)] for c in power[-1]))
    moves = ", ".join(f"'{p}'" for p in power)
    places = f"transform(reverse(split({{d}}, '')), (c, i) -> cast(substring(element_at(array({moves}), i % 8 + 1), cast(c as int) + 1, 1) as int))"
    turn = "if(a < 5, if(b < 5, (a + b) % 5, 5 + (a + b) % 5), if(b < 5, 5 + (a - b + 5) % 5, (a - b + 5) % 5))"
    return f"aggregate({places}, 0, (a, b) -> {turn}) = 0"


# Endings of street names in German
STREETS = ("allee", "damm", "gasse", "graben", "halde", "hof", "matte", "pfad", "platz", "promenade", "quai", "ring", "str.", "strasse", "straße", "ufer", "wall", "weg")

# Public formats of each kind
RECOGNISERS = (
    Recogniser("EMAIL_ADDRESS", r"\b[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 1.0),
    Recogniser("PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b|\+41 ?[0-9]{2} ?[0-9]{3} ?[0-9]{2} ?[0-9]{2}\b", 0.75),
    Recogniser("IP_ADDRESS", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b", 0.95, IP),
    Recogniser("CREDIT_CARD_NUMBER", r"\b(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\b", 1.0, luhn()),
    Recogniser("INTERNATIONAL_BANKING_ACCOUNT_NUMBER", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7} ?[0-9A-Z]{1,3}\b", 1.0, IBAN),
    Recogniser("DATE", r"\b(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})\b", 0.6),
    Recogniser("ADDRESS", rf"\p{{Lu}}[\p{{L}}-]*(?:{'|'.join(re.escape(x) for x in STREETS)}) [0-9]+[a-z]?, ?[0-9]{{4,5}} \p{{Lu}}\p{{L}}+", 0.85),
    Recogniser("URL", r"\bhttps?://[^ \t\r\n\"<>]+", 0.6),
    Recogniser("MAC_ADDRESS", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", 0.85),
    Recogniser("CRYPTO", r"\bbc1[0-9a-z]{25,59}\b", 0.85),
    Recogniser("AHV", r"\b756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}\b", 1.0, f"(10 - {summed([1, 3] * 6)} % 10) % 10 = {LAST}"),
    Recogniser("US_SOCIAL_SECURITY_NUMBER", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    Recogniser("US_MBI", r"\b[1-9][AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y][0-9]-?[AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2}\b", 0.7),
    Recogniser("ABA_ROUTING_NUMBER", r"\b[0-9]{4}-[0-9]{4}-[0-9]\b", 0.65, f"{summed([3, 7, 1] * 3)} % 10 = 0"),
    Recogniser("UK_NHS", r"\b[0-9]{3} [0-9]{3} [0-9]{4}\b", 0.85, f"(11 - {summed([*range(10, 1, -1)])} % 11) % 11 = {LAST}"),
    Recogniser("UK_NINO", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] [0-9]{2} [0-9]{2} [0-9]{2} [A-D]\b", 0.7),
    Recogniser("ES_NIF", r"\b[0-9]{8}[TRWAGMYFPDXBNJZSQVHLCKE]\b", 0.85, NIF.replace("{n}", "left({v}, 8)")),
    Recogniser("ES_NIE", r"\b[XYZ][0-9]{7}[TRWAGMYFPDXBNJZSQVHLCKE]\b", 0.7, NIF.replace("{n}", "concat(translate(left({v}, 1), 'XYZ', '012'), substring({v}, 2, 7))")),
    Recogniser("PL_PESEL", r"\b[0-9]{11}\b", 0.85, f"(10 - {summed([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {LAST}"),
    Recogniser("FI_PERSONAL_IDENTITY_CODE", r"\b[0-9]{6}[+A-][0-9]{3}[0-9A-FHJ-NPR-Y]\b", 0.7, "substring('0123456789ABCDEFHJKLMNPRSTUVWXY', cast(cast(concat(left({v}, 6), substring({v}, 8, 3)) as bigint) % 31 + 1 as int), 1) = right({v}, 1)"),
    Recogniser("IT_FISCAL_CODE", r"\b[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", 0.85),
    Recogniser("AU_TAX_FILE_NUMBER", r"\b[0-9]{3} [0-9]{3} [0-9]{3}\b", 0.65, f"{summed([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0"),
    Recogniser("SG_NRIC_FIN", r"\b[STFGM][0-9]{7}[A-Z]\b", 0.7),
    Recogniser("IN_PAN", r"\b[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]\b", 0.7),
    Recogniser("IN_AADHAAR", r"\b[2-9][0-9]{3} [0-9]{4} [0-9]{4}\b", 0.7, verhoeff()),
    Recogniser("IN_GSTIN", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", 0.85),
    Recogniser("KR_RRN", r"\b[0-9]{6}-[1-4][0-9]{6}\b", 0.7),
    Recogniser("US_PASSPORT_NUMBER", r"\b[A-Z][0-9]{8}\b", 0.3),
    Recogniser("US_INDIVIDUAL_TAXPAYER_IDENTIFICATION", r"\b9[0-9]{2}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])-[0-9]{4}\b", 0.85),
    Recogniser("US_BANK_ACCOUNT_NUMBER", r"(?i)\baccount(?: number)?:? [0-9]{8,17}\b", 0.5),
    Recogniser("US_DRIVERS_LICENSE_NUMBER", r"(?i)\bdriver'?s licen[cs]e:? [A-Z][0-9]{7,8}\b", 0.5),
    Recogniser("MEDICAL_LICENSE", r"\b[ABFGMPR][A-Z9][0-9]{7}\b", 0.7, f"{summed([1, 2] * 3, 'substring({v}, 3, 7)')} % 10 = {LAST}"),
    Recogniser("IT_DRIVER_LICENSE", r"\b(?:[A-Z]{2}[0-9]{7}[A-Z]|U1[0-9A-Z]{7}[A-Z])\b", 0.4),
    Recogniser("IT_VAT_CODE", r"\bIT[0-9]{11}\b", 0.7, luhn()),
    Recogniser("IT_PASSPORT", r"\bY[AB][0-9]{7}\b", 0.4),
    Recogniser("IT_IDENTITY_CARD", r"\bC[A-Z][0-9]{5}[A-Z]{2}\b", 0.4),
    Recogniser("AU_BUSINESS_NUMBER", r"\b[0-9]{2} [0-9]{3} [0-9]{3} [0-9]{3}\b", 0.7, f"({summed([10, *range(1, 20, 2)])} - 10) % 89 = 0"),
    Recogniser("AU_COMPANY_NUMBER", r"\b[0-9]{3} [0-9]{3} [0-9]{3}\b", 0.65, f"(10 - {summed([*range(8, 0, -1)])} % 10) % 10 = {LAST}"),
    Recogniser("AU_MEDICAL_ACCOUNT_NUMBER", r"\b[2-6][0-9]{3} [0-9]{5} [0-9]\b", 0.7, f"{summed([1, 3, 7, 9] * 2)} % 10 = cast(substring({{d}}, 9, 1) as int)"),
    Recogniser("SG_UEN", r"\b(?:(?:19|20)[0-9]{7}[A-Z]|[TSR][0-9]{2}[A-Z]{2}[0-9]{4}[A-Z])\b", 0.5),
    Recogniser("IN_VEHICLE_REGISTRATION", r"\b[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}\b", 0.5),
    Recogniser("IN_VOTER", r"\b[A-Z]{3}[0-9]{7}\b", 0.4),
    Recogniser("IN_PASSPORT", r"\b[A-PR-WY][1-9][0-9] ?[0-9]{4}[1-9]\b", 0.3),
    Recogniser("KR_DRIVER_LICENSE", r"\b[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}\b", 0.65),
    Recogniser("KR_FRN", r"\b[0-9]{6}-[5-8][0-9]{6}\b", 0.7),
    Recogniser("KR_PASSPORT", r"\b[MSRODG][0-9]{3}[A-Z][0-9]{4}\b", 0.4),
    Recogniser("KR_BRN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{5}\b", 0.65, f"(10 - ({summed([1, 3, 7, 1, 3, 7, 1, 3, 5])} + cast(substring({{d}}, 9, 1) as int) * 5 div 10) % 10) % 10 = {LAST}"),
    Recogniser("TH_TNIN", r"\b[1-8]-[0-9]{4}-[0-9]{5}-[0-9]{2}-[0-9]\b", 0.7, f"(11 - {summed([*range(13, 1, -1)])} % 11) % 10 = {LAST}"),
    Recogniser("AGE", r"(?i)\b[0-9]{1,3}(?: years? old|-year-old| Jahre alt)\b", 0.6),
)
BY_KIND = {r.kind: r for r in RECOGNISERS}


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Stand around matches, and before each of several, while they are told from the gaps between them; a text's own ones are searched as
#: OTHER. No pattern tells the three apart.
MARK, EACH, OTHER = "\x01", "\x02", "\x03"


EMPTY = "cast(array() as array<struct<start: int, end: int, value: string>>)"


def marked_sql(text: str, pattern: str) -> str:
    """SQL of the text with a pattern's matches between marks, as the engine compiles the pattern of a replacement once, and that of a
    split for each text."""
    mark, other = literal(MARK), literal(OTHER)
    plain = f"if(contains({text}, {mark}), replace({text}, {mark}, {other}), {text})"
    return f"regexp_replace({plain}, {literal(pattern)}, {literal(MARK + '$0' + MARK)})"


def one_sql(text: str, pieces: str) -> str:
    """SQL of the struct of the only match of a text, of what is before it, the match, and what is after it."""
    start, n = f"length({pieces}[0])", f"length({pieces}[1])"
    return f"named_struct('start', {start}, 'end', {start} + {n}, 'value', substring({text}, {start} + 1, {n}))"


def many_sql(text: str, pieces: str) -> str:
    """SQL of the matches of a marked text that is split at its marks: every other piece is one, as its marks are not in the text."""
    step = f"named_struct('at', acc.at + x.n, 'out', if(x.hit, array_append(acc.out, named_struct('start', acc.at, 'end', acc.at + x.n, 'value', substring({text}, acc.at + 1, x.n))), acc.out))"
    return f"aggregate(transform({pieces}, (p, i) -> named_struct('n', length(p), 'hit', i % 2 = 1)), named_struct('at', 0, 'out', {EMPTY}), (acc, x) -> {step}, acc -> acc.out)"


def matches_sql(text: str, pattern: str, fields: str = "") -> str:
    """SQL of array<struct<start, end, value, ...>>: a pattern's matches, not empty ones; ``fields`` may add more."""
    mark = literal(MARK)
    # most texts with a match have one
    told = f"transform(array(split(marked, {mark}, -1)), ps -> if(size(ps) = 3, array({one_sql(text, 'ps')}), {many_sql(text, 'ps')}))[0]"
    found = f"transform(array({marked_sql(text, pattern)}), marked -> if(contains(marked, {mark}), {told}, {EMPTY}))[0]"
    return f"transform({found}, m -> named_struct({fields}))" if fields else found


def matches(text: str, pattern: str) -> Column:
    """The matches of a pattern in the text (a column's name)."""
    return F.expr(matches_sql(text, pattern))


#: Lines, one after another, with a character that any kind needs; the possessive run finds it, or the line's end, at once. At most
#: LINES of them, as the matches of a kind are put together one by one.
LINES = 64
TRIGGER = rf"(?m)^[^\n0-9@:]*+[0-9@:][^\n]*+(?:\n[^\n0-9@:]*+[0-9@:][^\n]*+){{0,{LINES - 1}}}+"


def scored(r: Recogniser, value: str) -> str:
    """SQL of the score of a value that the pattern has matched."""
    if not r.valid:
        return f"{r.score}D"
    test = r.valid.replace("{d}", "regexp_replace({v}, '[^0-9]', '')").replace("{v}", value)
    return f"if(coalesce({test}, false), {r.score}D, {r.invalid_score}D)"


#: How patterns begin that can only match from the first character of a word on, a letter or digit of ASCII.
WORD_START = re.compile(r"((?:\(\?i\))?)\\b(?=[^\W_]|\[|\(\?:)")


#: The first of the characters that name the patterns of a search for several.
FIRST = 0x100


#: Characters that a word may begin with. Each has a search of its own, with fewer patterns.
STARTS = ("0-9", "A-Z", "a-z")


def begins(pattern: str) -> tuple[str, ...]:
    """Those of STARTS that a pattern of WORD_START may begin with; all, unless it plainly begins with one of some characters."""
    outside = re.sub(r"\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)", "", pattern)
    m = "|" not in outside and re.match(r"(?:\[([0-9A-Za-z-]+)\]|([0-9A-Za-z]))(?![?*|]|\{0)", WORD_START.sub("", pattern, count=1))
    if not m:
        return STARTS
    first = m[1] or m[2]
    first += first.swapcase() if "(?i)" in pattern else ""
    return tuple(c for c in STARTS if re.search(f"[{c}]", first))


def by_word_sql(text: str, chosen: list[Recogniser]) -> str:
    """SQL of array<struct<kind, start, end, value, score>>: the matches of patterns that begin at a word. A search for each of STARTS finds the
    words where any of them matches, and writes there what each has matched; each kind's matches that begin before the end of its one before
    go, as in a search for it alone."""
    mark, none = literal(MARK), "cast(array() as array<struct<g: int, start: int, end: int>>)"
    plain = f"translate({text}, {literal(MARK + EACH)}, {literal(OTHER * 2)})"
    plain = f"if(contains({text}, {mark}) or contains({text}, {literal(EACH)}), {plain}, {text})"
    # a gap, what each has matched at the word after it, a gap, and so on
    words = "aggregate(sequence(0, size(ps) - 2, 2), cast(array() as array<int>), (acc, i) -> array_append(acc, coalesce(try_element_at(acc, -1), 0) + length(ps[i])))"
    hits = f"flatten(transform({words}, (at, c) -> transform(regexp_extract_all(ps[2 * c + 1], {literal(f'{EACH}.[^{EACH}]+')}, 0), v -> named_struct('g', ascii(substring(v, 2, 1)) - {FIRST}, 'start', at, 'end', at + length(v) - 2))))"
    searches = []
    for start in STARTS:
        those = [(chr(FIRST + i), WORD_START.sub(r"\1", r.pattern, count=1)) for i, r in enumerate(chosen) if start in begins(r.pattern)]
        if those:
            pattern = rf"(?=[{start}])\b(?={'|'.join(f'(?:{p})' for _, p in those)}){''.join(f'(?=({p})?)' for _, p in those)}"
            marked = f"regexp_replace({plain}, {literal(pattern)}, {literal(MARK + ''.join(f'{EACH}{c}${i + 1}' for i, (c, _) in enumerate(those)) + MARK)})"
            searches.append(f"transform(array(split({marked}, {mark}, -1)), ps -> if(size(ps) > 1, {hits}, {none}))[0]")
    apart = f"aggregate(sort_array(hs), named_struct('g', -1, 'end', 0, 'out', {none}), (acc, h) -> if(h.g = acc.g and h.start < acc.end, acc, named_struct('g', h.g, 'end', h.end, 'out', array_append(acc.out, h))), acc -> acc.out)"
    valued = f"transform({apart}, h -> named_struct('g', h.g, 'start', h.start, 'end', h.end, 'value', substring({text}, h.start + 1, h.end - h.start)))"
    score = f"case m.g {' '.join(f'when {i} then {scored(r, "m.value")}' for i, r in enumerate(chosen))} end"
    found = f"transform({valued}, m -> named_struct('kind', array({', '.join(literal(r.kind) for r in chosen)})[m.g], 'start', m.start, 'end', m.end, 'value', m.value, 'score', {score}))"
    empty = "cast(array() as array<struct<kind: string, start: int, end: int, value: string, score: double>>)"
    return f"transform(array(concat({', '.join(searches)})), hs -> if(size(hs) > 0, {found}, {empty}))[0]"


def found_sql(text: str, kinds: list[str] | None = None) -> str:
    """SQL of array<struct<kind, start, end, value, score>>: all matches in a text. One string, as hundreds of lambdas take their time to
    build from Python."""
    chosen = [r for r in RECOGNISERS if kinds is None or r.kind in kinds]
    words = [r for r in chosen if WORD_START.match(r.pattern)]
    each = [matches_sql("lines.value", r.pattern, f"'kind', '{r.kind}', 'start', m.start, 'end', m.end, 'value', m.value, 'score', {scored(r, 'm.value')}") for r in chosen if r not in words]
    each += [by_word_sql("lines.value", words)] if words else []
    placed = f"transform(concat({', '.join(each)}), f -> named_struct('kind', f.kind, 'start', lines.start + f.start, 'end', lines.start + f.end, 'value', f.value, 'score', f.score))"
    return f"flatten(transform({matches_sql(text, TRIGGER)}, lines -> {placed}))"


def found_in(text: str, kinds: list[str] | None = None) -> Column:
    """``found_sql`` of a column: nothing is sent between tasks to find and score."""
    return F.expr(found_sql(text, kinds))


def findings(docs: DataFrame, kinds: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row for each match: id_col, kind, start, end, value, score."""
    return docs.where("text is not null").select(id_col, F.explode(found_in("text", kinds)).alias("f")).select(id_col, "f.*")


def answer(found: str) -> Column:
    """JSON of what a detector answers for the findings (a column's name): {} if there are none, only ignored_results if all are below
    the threshold, else the mean score, how often each kind occurs, the results, and the ignored ones if any."""
    items = f"transform(array_sort(transform({found}, f -> named_struct('start', f.start, 'kind', f.kind, 'f', f))), x -> named_struct('kind', x.f.kind, 'start', x.f.start, 'end', x.f.end, 'text', x.f.value, 'score', x.f.score))"
    sure, low = (f"(transform(array(filter({items}, x -> x.score {test} {THRESHOLD})), a -> if(size(a) > 0, a, null))[0])" for test in (">=", "<"))
    mean = "round(aggregate(transform(r.sure, x -> x.score), 0D, (s, x) -> s + x) / size(r.sure), 6)"
    kinds = "map_from_entries(transform(array_sort(array_distinct(transform(r.sure, x -> x.kind))), k -> named_struct('k', k, 'n', size(filter(r.sure, x -> x.kind = k)))))"
    whole = f"to_json(if(r.sure is null, named_struct('mean', cast(null as double), 'frequencies', cast(null as map<string, int>), 'results', r.sure, 'ignored_results', r.low), named_struct('mean', {mean}, 'frequencies', {kinds}, 'results', r.sure, 'ignored_results', r.low)))"
    return F.expr(f"transform(array(named_struct('sure', {sure}, 'low', {low})), r -> {whole})[0]")
