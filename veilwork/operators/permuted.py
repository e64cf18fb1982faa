"""Stand-ins by keyed permutation: for numbers with a format, another number of the same format.

The free digits of a value (less a fixed head and its check digits) are mapped by a Feistel network over two halves of the digits, with addition
modulo a power of ten in place of exclusive or, so it is a permutation of exactly these numbers: two values never share a
stand-in, and none has to be stored to tell. Check digits are set anew, letters and marks stay where they are, so every stand-in
passes its kind's own validator. All of it is one SQL expression.

Cases: a null value has a null stand-in; kinds without a rule here, and values with fewer than two free digits, have none (null).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from veilwork.functions import detect

ROUNDS = 4


@dataclass(frozen=True)
class Rule:
    """head: digits that stay; tail: check digits at the end; check: SQL of them, where {d} is the digits before them."""

    head: int
    tail: int = 0
    check: str = "''"


def reversed_luhn(digits: str = "{d}") -> str:
    return f"cast((10 - aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 1, cast(c as int), 2 * cast(c as int) - if(cast(c as int) > 4, 9, 0))), 0, (s, c) -> s + c) % 10) % 10 as string)"


RULES = {
    "CREDIT_CARD_NUMBER": Rule(1, 1, reversed_luhn()),
    "AHV": Rule(3, 1, f"cast((10 - {detect.summed([1, 3] * 6)} % 10) % 10 as string)"),
    "PL_PESEL": Rule(0, 1, f"cast((10 - {detect.summed([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 as string)"),
    "US_SOCIAL_SECURITY_NUMBER": Rule(0),
    "PHONE_NUMBER": Rule(2),
    "KR_DRIVER_LICENSE": Rule(0),
    "AU_COMPANY_NUMBER": Rule(0, 1, f"cast((10 - {detect.summed([*range(8, 0, -1)])} % 10) % 10 as string)"),
}


def drawn(key: str, kind: str, half: str, number: str) -> str:
    """SQL of a whole number below 2^48 that depends on all of these."""
    return f"cast(conv(substring(md5(cast(concat({detect.literal(key + '|' + kind)}, '|', {half}, '|', {number}) as binary)), 1, 12), 16, 10) as bigint)"


def permuted(digits: str, key: str, kind: str) -> str:
    """SQL of another string of as many digits: a permutation of all of that length."""
    power = lambda n: f"cast(pow(10, {n}) as bigint)"
    step = lambda a, size, b, half: f"(({a} + {drawn(key, kind, half, b)}) % {power(size)})"
    n, m = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
    one = f"transform(array({step('acc.l', n, 'acc.r', f'concat({n}, {chr(39)}l{chr(39)}, i)')}), l -> named_struct('l', l, 'r', {step('acc.r', m, 'l', f'concat({m}, {chr(39)}r{chr(39)}, i)')}))[0]"
    start = f"named_struct('l', cast(left({digits}, {n}) as bigint), 'r', cast(right({digits}, {m}) as bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (acc, i) -> {one}, acc -> concat(lpad(cast(acc.l as string), {n}, '0'), lpad(cast(acc.r as string), {m}, '0')))"


def filled(value: str, digits: str) -> str:
    """SQL of value with its digits replaced by these, one by one."""
    return f"aggregate(split({value}, ''), named_struct('i', 0, 'out', ''), (acc, c) -> if(c between '0' and '9', named_struct('i', acc.i + 1, 'out', concat(acc.out, substring({digits}, acc.i + 1, 1))), named_struct('i', acc.i, 'out', concat(acc.out, c))), acc -> acc.out)"


def standin(kind: str, value: str, key: str) -> Column:
    """The stand-in of a value (both columns' names)."""
    cases = []
    for name, rule in RULES.items():
        free = f"substring(x.d, {rule.head + 1}, length(x.d) - {rule.head + rule.tail})"
        whole = f"transform(array(concat(left(x.d, {rule.head}), {permuted('f', key, name)})), d -> concat(d, {rule.check.replace('{d}', 'd')}))[0]"
        new = f"transform(array({free}), f -> if(length(f) < 2, null, {whole}))[0]"
        cases.append(f"when '{name}' then transform(array({new}), n -> {filled('x.v', 'n')})[0]")
    given = f"named_struct('v', {value}, 'd', regexp_replace({value}, '[^0-9]', ''))"
    return F.expr(f"transform(array({given}), x -> case {kind} {' '.join(cases)} end)[0]")
