"""Rules for the fields of a row or of nested structs: which are broken, and which structs hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From a field's value to whether it holds; null counts as broken.
Rule = Callable[[Column], Column]


def present(x: Column) -> Column:
    """Neither null nor empty: a text of one character, an array of one element."""
    return x.isNotNull()


def least(n: int) -> Rule:
    return lambda x: F.length(x) >= n


def most(n: int) -> Rule:
    return lambda x: F.length(x) <= n


def items(n: int = 0) -> Rule:
    """An array of ``n`` elements at least, none of them null."""
    return lambda x: (F.size(x) >= n) & ~F.exists(x, lambda v: v.isNull())


def one_of(*values) -> Rule:
    return lambda x: x.isin(*values)


def matching(pattern: str) -> Rule:
    return lambda x: x.rlike(pattern)


def either_null_or(rule: Rule) -> Rule:
    return lambda x: x.isNull() | rule(x)


def each(rules: dict[str, dict[str, Rule]]) -> Rule:
    """An array of structs that all hold."""
    return lambda x: F.forall(x, lambda v: F.size(broken(v, rules)) == 0)


def broken(row: Column, rules: dict[str, dict[str, Rule]]) -> Column:
    """The reasons, in the order of the rules, as ``<field>_<rule>``; an empty array where all hold.

    ``rules`` maps each field to named rules. Of one field the first broken rule counts, so that an absent value is
    not also reported as too short. A null struct breaks the first rule of each field.
    """
    found = []
    for field, own in rules.items():
        value = row[field]
        checks = [F.when(~F.coalesce(rule(value), F.lit(False)), F.lit(f"{field}_{name}")) for name, rule in own.items()]
        found.append(F.coalesce(*checks))
    return F.array_compact(F.array(*found))


def valid(structs: Column, rules: dict[str, dict[str, Rule]]) -> Column:
    """The structs of an array that hold, in order; others are left out."""
    return F.filter(structs, lambda x: F.size(broken(x, rules)) == 0)


def with_reasons(structs: Column, rules: dict[str, dict[str, Rule]]) -> Column:
    """array<struct<pos, reasons>> of the structs that do not hold."""
    all_ = F.transform(structs, lambda x, i: F.struct(i.alias("pos"), broken(x, rules).alias("reasons")))
    return F.filter(all_, lambda x: F.size(x["reasons"]) > 0)
