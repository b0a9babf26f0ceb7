"""Filter language over memory rows, compiled to one boolean column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$gte": lambda c, v: c >= v,
    "$gt": lambda c, v: c > v,
    "$lte": lambda c, v: c <= v,
    "$lt": lambda c, v: c < v,
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_filter(spec: dict | None, columns: list[str] | None = None) -> Column:
    """Flat equality, ``$and``, ``$or`` and comparisons as a Catalyst predicate.

    ``$and`` wins over its sibling keys, then ``$or``. Equality is null-safe;
    a comparison never passes on a missing value. A key that is no column
    behaves as a missing value.
    """
    if not spec:
        return F.lit(True)
    if "$and" in spec:
        return _all([compile_filter(part, columns) for part in spec["$and"]])
    if "$or" in spec:
        return reduce(lambda a, b: a | b, [compile_filter(part, columns) for part in spec["$or"]], F.lit(False))
    parts = []
    for key, value in spec.items():
        column = F.col(key) if columns is None or key in columns else F.lit(None)
        if isinstance(value, dict) and any(op.startswith("$") for op in value):
            tests = [_COMPARE[op](column, F.lit(target)) for op, target in value.items() if op in _COMPARE]
            parts.append(column.isNotNull() & F.coalesce(_all(tests), F.lit(False)))
        else:
            parts.append(column.eqNullSafe(F.lit(value)))
    return _all(parts)


def effective_filter(spec: dict | None, container_tag: str | None) -> dict | None:
    """A space is sugar for an equality on its tag; naming it twice is an error."""
    if container_tag is None:
        return spec
    if spec and "container_tag" in spec:
        raise ValueError("container_tag given both as a space and as a filter")
    if not spec:
        return {"container_tag": container_tag}
    return {"$and": [spec, {"container_tag": container_tag}]}
