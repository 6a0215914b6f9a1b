"""Options from a configuration and from what a caller gives, and work that goes on past single failures."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fits(value: Any, kind: Any) -> bool:
    if value is None:
        return type(None) in get_args(kind)
    kinds = [k for k in (get_args(kind) or (kind,)) if k is not type(None)] if get_origin(kind) not in (list, dict, tuple) else [get_origin(kind)]
    kinds = [get_origin(k) or k for k in kinds]
    if isinstance(value, bool):
        return bool in kinds
    return isinstance(value, tuple(kinds)) or (isinstance(value, int) and float in kinds)


def merged(cls: type, config: dict[str, Any], given: dict[str, Any] | None = None, choices: dict[str, Iterable] | None = None, required: Iterable[str] = ()) -> Any:
    """An options dataclass from a configuration; what a caller gives goes before it, the class's defaults after it.

    Unknown names, values of another type (a list for a single value, say) and values outside their
    choices are errors; so are required options that are still missing after merging.
    """
    given = {k: v for k, v in (given or {}).items() if v is not None}
    kinds = get_type_hints(cls)
    names = {f.name for f in dataclasses.fields(cls)}
    for where in (config, given):
        if unknown := sorted(set(where) - names):
            raise ValueError(f"unknown options {', '.join(unknown)}; there are {', '.join(sorted(names))}")
    values = config | given
    for name, value in values.items():
        if not _fits(value, kinds[name]):
            raise ValueError(f"{name} can't be {value!r}")
        if choices and name in choices and value not in choices[name]:
            raise ValueError(f"{name} is one of {', '.join(map(str, choices[name]))}, not {value!r}")
    if missing := [k for k in required if values.get(k) is None]:
        raise ValueError(f"{', '.join(missing)} must be given")
    return cls(**values)


def isolated(spark: SparkSession, items: dict[str, Callable[[], DataFrame]], done: Iterable[str] = (), force: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """Tables of all items that succeed, with the item's name, and rows (item, status, error) of all.

    An item that fails is a row with its error and doesn't end the others; items in ``done`` are
    skipped unless forced. Items are whole evaluations, a handful.
    """
    out, status = None, []
    for name, make in items.items():
        if name in set(done) and not force:
            status.append((name, "skipped", None))
            continue
        try:
            part = make().withColumn("item", F.lit(name))
            out = part if out is None else out.unionByName(part)
            status.append((name, "written", None))
        except Exception as error:  # whatever an item raises
            status.append((name, "failed", str(error).splitlines()[0]))
    return out, spark.createDataFrame(status, "item string, status string, error string")
