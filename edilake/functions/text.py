"""Scalar functions on X12 text: components, codes, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of health care codes by qualifier.
CODE_KINDS = {
    "ABK": "principal_diagnosis", "BK": "principal_diagnosis", "ABF": "other_diagnosis", "BF": "other_diagnosis", "BG": "condition_code",
    "BH": "occurrence_code", "BE": "value_code", "BBR": "institutional_procedure", "DR": "diagnosis_related_group",
}
#: Provider contexts by the qualifiers of NM1 and of PRV.
NM1_CONTEXTS = {
    "85": "billing_provider", "82": "rendering_provider", "DN": "referring_provider", "DQ": "supervising_provider", "77": "facility",
    "71": "attending_provider", "72": "operating_provider", "ZZ": "other_provider",
}
PRV_CONTEXTS = {
    "BI": "billing_provider", "PE": "rendering_provider", "RF": "referring_provider", "SU": "supervising_provider",
    "AT": "attending_provider", "OP": "operating_provider", "FA": "facility", "OT": "other_provider",
}


def lookup(table: dict[str, str], key: Column, default: str | None = "") -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def quoted(mark: Column) -> Column:
    """A pattern that matches the mark itself: one that needs no compiling for each value, unless it is a letter, a digit or empty."""
    return F.when((mark == "") | mark.rlike("[A-Za-z0-9]"), F.concat(F.lit("\\Q"), mark, F.lit("\\E"))).otherwise(F.concat(F.lit("\\"), mark))


def components(value: Column, mark: Column) -> Column:
    """An element's components; none if it is empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.call_function("split", value, quoted(mark), F.lit(-1)))


def part(parts: Column, number: int) -> Column:
    """The component with this number from 1 on, or ''."""
    return F.coalesce(F.get(parts, F.lit(number - 1)), F.lit(""))


def procedure(value: Column, mark: Column) -> tuple[Column, Column, Column]:
    """Qualifier, code and modifiers; a lone component is the code."""
    p = components(value, mark)
    alone = F.size(p) < 2
    modifiers = F.filter(F.slice(p, 3, 4), lambda x: x != "")
    return F.when(alone, F.lit("")).otherwise(part(p, 1)), F.when(alone, part(p, 1)).otherwise(part(p, 2)), modifiers


def remitted_procedure(value: Column, mark: Column) -> tuple[Column, Column]:
    """Qualifier and all the rest, modifiers included."""
    at = F.call_function("instr", value, mark)
    return F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(F.lit("")), F.when(at > 0, F.substring(value, at + 1, F.length(value))).otherwise(value)


def code_set(qualifier: Column) -> Column:
    return F.when(qualifier == "HC", F.lit("CPT/HCPCS")).otherwise(F.lit(""))


def diagnosis(code: Column) -> Column:
    """A dot goes behind the third character of longer codes without one."""
    return F.when((F.length(code) > 3) & ~code.contains("."), F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, F.lit(4), F.length(code)))).otherwise(code)


def cents(amount: Column) -> Column:
    """Lenient money: sign, digits, at most two decimals (more are cut off); what follows is ignored, nothing is 0."""
    pattern = r"^(-?)(\d*)(?:\.(\d{0,2}))?"
    a = F.coalesce(amount, F.lit(""))
    whole = F.regexp_extract(a, pattern, 2)
    rest = F.rpad(F.regexp_extract(a, pattern, 3), 2, "0")
    value = F.coalesce(F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), rest).try_cast("long"), F.lit(0).cast("long"))
    return F.when(F.regexp_extract(a, pattern, 1) == "-", -value).otherwise(value)


def money(value: Column) -> Column:
    """Cents as text with two decimals and no grouping."""
    return F.format_string("%s%d.%02d", F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.abs(value) / 100), F.abs(value) % 100)
