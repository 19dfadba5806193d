"""Metadata filters: a JSON algebra compiled to a two-valued Column.

{"field": {"$eq": v}}, $ne $gt $lt $gte $lte $in, {"$and": [...]}, {"$or": [...]}, {"$not": f}; fields may be paths a.b. A
missing field fails every comparison but $ne. Rows without a metadata object match nothing, not even a negation. Numbers
compare with numbers, strings with strings, booleans with booleans; $gt and its like of other pairs are false.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATH = re.compile(r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*")
_ORDER = {"$gt": lambda a, b: a > b, "$lt": lambda a, b: a < b, "$gte": lambda a, b: a >= b, "$lte": lambda a, b: a <= b}


def compile_filter(condition: dict[str, Any], metadata: Column) -> Column:
    """A condition on a column of JSON texts as a Column that is true or false, never null."""
    variant = F.try_parse_json(metadata)
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    return is_object & F.coalesce(_node(condition, variant), F.lit(False))


def _node(condition: dict[str, Any], variant: Column) -> Column:
    parts = []
    for key, value in condition.items():
        if key == "$and":
            parts.append(reduce(lambda a, b: a & b, [_node(c, variant) for c in value], F.lit(True)))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, [_node(c, variant) for c in value], F.lit(False)))
        elif key == "$not":
            parts.append(~F.coalesce(_node(value, variant), F.lit(False)))
        elif isinstance(value, dict):
            parts += [_compare(key, op, operand, variant) for op, operand in value.items()]
        else:
            parts.append(_compare(key, "$eq", value, variant))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _kind(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "other"


def _typed(path: str, kind: str, variant: Column) -> Column:
    """The field as a value of a kind, null where it is of another kind."""
    there = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    if kind == "number":
        return F.when(there.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(variant, path, "double"))
    return F.when(there == ("BOOLEAN" if kind == "boolean" else "STRING"), F.try_variant_get(variant, path, kind))


def _compare(field: str, op: str, operand: Any, variant: Column) -> Column:
    if not _PATH.fullmatch(field):
        raise ValueError(f"not a field path: {field!r}")
    path = f"$.{field}"
    missing = F.try_variant_get(variant, path, "variant").isNull()
    if op == "$in":
        if not isinstance(operand, (list, tuple)):
            return F.lit(False)
        return reduce(lambda a, b: a | b, [_compare(field, "$eq", x, variant) for x in operand], F.lit(False))
    kind = _kind(operand)
    if op == "$ne":
        return ~_compare(field, "$eq", operand, variant)
    if kind == "other":
        if operand is None and op == "$eq":
            return ~missing & F.coalesce(F.is_variant_null(F.try_variant_get(variant, path, "variant")), F.lit(False))
        return F.lit(False)
    value = _typed(path, kind, variant)
    literal = F.lit(float(operand) if kind == "number" else operand)
    if op == "$eq":
        return F.coalesce(value == literal, F.lit(False))
    if op in _ORDER:
        return F.coalesce(_ORDER[op](value, literal), F.lit(False))
    raise ValueError(f"no such operator: {op}")


def matches(condition: dict[str, Any], record: Any) -> bool:
    """The same semantics on a Python object, for tests."""
    if not isinstance(record, dict):
        return False
    return _matches(condition, record)


def _matches(condition: dict[str, Any], record: dict) -> bool:
    for key, value in condition.items():
        if key == "$and":
            ok = all(_matches(c, record) for c in value)
        elif key == "$or":
            ok = any(_matches(c, record) for c in value)
        elif key == "$not":
            ok = not _matches(value, record)
        else:
            tests = value.items() if isinstance(value, dict) else [("$eq", value)]
            ok = all(_test(record, key, op, operand) for op, operand in tests)
        if not ok:
            return False
    return True


def _test(record: dict, field: str, op: str, operand: Any) -> bool:
    at: Any = record
    for part in field.split("."):
        if not isinstance(at, dict) or part not in at:
            return op == "$ne"
        at = at[part]
    same = _kind(at) == _kind(operand) and at == operand
    if op == "$eq":
        return same
    if op == "$ne":
        return not same
    if op == "$in":
        return isinstance(operand, (list, tuple)) and any(_test(record, field, "$eq", x) for x in operand)
    return _kind(at) == _kind(operand) != "other" and _ORDER[op](at, operand)
