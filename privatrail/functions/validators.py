"""Checksum validators as Spark SQL expressions (no UDF).

Each ``*_sql`` takes the SQL text of a string expression and returns the SQL text of a
boolean that is never null; ``check(name, column)`` wraps one as a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from privatrail.dims.patterns import IBAN_LENGTHS, VERHOEFF_MULTIPLY, VERHOEFF_PERMUTE


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def stripped(value: str) -> str:
    return f"regexp_replace({value}, {quoted('(?U)[\\s-]')}, '')"


def _chars(text: str) -> str:
    return f"slice(split({text}, ''), 1, length({text}))"


def _not_all_same(digits: str) -> str:
    return f"NOT {digits} RLIKE {quoted('^(.)\\1*$')}"


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def luhn_sql(value: str) -> str:
    """Luhn over 13 to 19 digits that are not all the same."""
    body = f"d RLIKE '^[0-9]{{13,19}}$' AND {_not_all_same('d')} AND luhn_check(d)"
    return f"coalesce({bind(stripped(value), 'd', body)}, false)"


def iban_length_sql(value: str) -> str:
    """Legal length for the value's country, null where the country is unknown."""
    table = ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items())
    return f"try_element_at(map({table}), upper(substr({value}, 1, 2)))"


def iban_sql(value: str) -> str:
    rest = (
        f"aggregate({_chars('concat(substr(d, 5), substr(d, 1, 4))')}, 0, (acc, c) -> "
        "CASE WHEN c RLIKE '[0-9]' THEN (acc * 10 + CAST(c AS INT)) % 97 "
        "ELSE (acc * 100 + ascii(c) - 55) % 97 END) = 1"
    )
    shape = f"d RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$' AND {iban_length_sql('d')} = length(d)"
    compact = f"upper(regexp_replace({value}, {quoted('(?U)\\s')}, ''))"
    return f"coalesce({bind(compact, 'd', f'CASE WHEN {shape} THEN {rest} END')}, false)"


def aba_sql(value: str) -> str:
    prefix = "CAST(substr(d, 1, 2) AS INT)"
    total = _sum([f"CAST(substr(d, {i + 1}, 1) AS INT) * {(3, 7, 1)[i % 3]}" for i in range(9)])
    body = (
        "CASE WHEN d RLIKE '^[0-9]{9}$' AND d <> '000000000' THEN "
        f"({prefix} BETWEEN 1 AND 12 OR {prefix} BETWEEN 21 AND 32 OR {prefix} BETWEEN 61 AND 72 "
        f"OR {prefix} = 80) AND {total} % 10 = 0 END"
    )
    return f"coalesce({bind(stripped(value), 'd', body)}, false)"


def nhs_sql(value: str) -> str:
    total = _sum([f"CAST(substr(d, {i + 1}, 1) AS INT) * {10 - i}" for i in range(9)])
    body = (
        f"CASE WHEN d RLIKE '^[0-9]{{10}}$' AND {_not_all_same('d')} THEN "
        f"(11 - {total} % 11) <> 10 AND (11 - {total} % 11) % 11 = CAST(substr(d, 10, 1) AS INT) END"
    )
    return f"coalesce({bind(f'regexp_replace({value}, {quoted("(?U)\\s")}, "")', 'd', body)}, false)"


def ssn_sql(value: str) -> str:
    body = (
        "CASE WHEN d RLIKE '^[0-9]{9}$' THEN CAST(substr(d, 1, 3) AS INT) BETWEEN 1 AND 899 "
        "AND substr(d, 1, 3) <> '666' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000' END"
    )
    return f"coalesce({bind(stripped(value), 'd', body)}, false)"


def verhoeff_sql(digits: str) -> str:
    """Verhoeff over a string of digits."""
    multiply, permute = "".join(VERHOEFF_MULTIPLY), "".join(VERHOEFF_PERMUTE)
    step = (
        f"named_struct('acc', CAST(substr('{multiply}', s.acc * 10 + "
        f"CAST(substr('{permute}', (s.i % 8) * 10 + CAST(c AS INT) + 1, 1) AS INT) + 1, 1) AS INT), "
        "'i', s.i + 1)"
    )
    fold = (
        f"aggregate({_chars(f'reverse({digits})')}, named_struct('acc', 0, 'i', 0), "
        f"(s, c) -> {step}, s -> s.acc) = 0"
    )
    return f"(CASE WHEN {digits} RLIKE '^[0-9]+$' THEN {fold} ELSE false END)"


def _national_sql(value: str, shape: str) -> str:
    body = f"CASE WHEN d RLIKE '{shape}' AND {_not_all_same('d')} THEN {verhoeff_sql('d')} END"
    return f"coalesce({bind(stripped(value), 'd', body)}, false)"


def national12_sql(value: str) -> str:
    """Twelve digits opening 2-9 that pass Verhoeff."""
    return _national_sql(value, "^[2-9][0-9]{11}$")


def national16_sql(value: str) -> str:
    """The sixteen-digit stand-in for the twelve-digit number."""
    return _national_sql(value, "^[0-9]{16}$")


def mrz_check_sql(value: str) -> str:
    """MRZ check digit (weights 7-3-1); the text holds only A-Z, 0-9 and '<'."""
    number = "CASE WHEN c = '<' THEN 0 WHEN c RLIKE '[0-9]' THEN CAST(c AS INT) ELSE ascii(c) - 55 END"
    return (
        f"aggregate({_chars(value)}, named_struct('acc', 0, 'i', 0), (s, c) -> named_struct("
        f"'acc', s.acc + ({number}) * CAST(substr('731', s.i % 3 + 1, 1) AS INT), 'i', s.i + 1), s -> s.acc) % 10"
    )


def mrz_sql(value: str) -> str:
    """TD3 passport zone: two lines of 44 with all check digits right."""
    lines = f"filter(transform(split({value}, {quoted('\\r\\n|\\r|\\n')}), x -> upper(trim(x))), x -> x <> '')"

    def part(start: int, end: int) -> str:
        return f"substr(get(l, 1), {start + 1}, {end - start})"

    def agrees(start: int, end: int, at: int) -> str:
        return f"CAST({mrz_check_sql(part(start, end))} AS STRING) = {part(at, at + 1)}"

    whole = f"concat({part(0, 10)}, {part(13, 20)}, {part(21, 43)})"
    shape = (
        "size(l) = 2 AND length(get(l, 0)) = 44 AND startswith(get(l, 0), 'P') "
        "AND get(l, 1) RLIKE '^[A-Z0-9<]{44}$'"
    )
    good = " AND ".join(
        [
            agrees(0, 9, 9),
            agrees(13, 19, 19),
            agrees(21, 27, 27),
            f"({part(42, 43)} = '<' OR {agrees(28, 42, 42)})",
            f"CAST({mrz_check_sql(whole)} AS STRING) = {part(43, 44)}",
        ]
    )
    return f"coalesce({bind(lines, 'l', f'CASE WHEN {shape} THEN {good} END')}, false)"


VALIDATORS = {
    "luhn": luhn_sql,
    "iban": iban_sql,
    "aba": aba_sql,
    "nhs": nhs_sql,
    "ssn": ssn_sql,
    "national12": national12_sql,
    "national16": national16_sql,
    "mrz": mrz_sql,
}


def check(name: str, column: str) -> Column:
    """Boolean Column: does the value in ``column`` (a name or SQL text) pass the validator?"""
    return F.expr(VALIDATORS[name](column))
