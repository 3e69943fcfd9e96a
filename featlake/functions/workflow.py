"""Driver-side helpers around jobs: variables in configurations, parameter grids, command lines without secrets, plans."""

from __future__ import annotations

import heapq
import itertools
import os
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of option names whose values are secrets.
SECRET_WORDS = ("token", "secret", "password", "api-key", "api_key", "credential")
HIDDEN = "***"


def substitute(value, variables: Mapping[str, str]):
    """`${name}` in strings, lists and mappings; an unknown name is an error."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: variables[m[1]], value)
    if isinstance(value, Mapping):
        return {k: substitute(v, variables) for k, v in value.items()}
    return [substitute(v, variables) for v in value] if isinstance(value, (list, tuple)) else value


def redact_command(argv: Sequence[str]) -> list[str]:
    """The command line with the values of secret options hidden, in both their forms."""
    secret = lambda a: a.startswith("-") and any(w in a.lower() for w in SECRET_WORDS)
    out, hide = [], False
    for a in argv:
        name, eq, _ = a.partition("=")
        out.append(HIDDEN if hide else f"{name}={HIDDEN}" if eq and secret(name) else a)
        hide = not hide and not eq and secret(a)
    return out


def redacted(argv: Column) -> Column:
    """redact_command for a column of arrays."""
    words = "|".join(re.escape(w) for w in SECRET_WORDS)
    secret = lambda a: F.rlike(a, F.lit(f"(?i)^-.*({words})"))
    name = lambda a: F.substring_index(a, "=", 1)
    bare = lambda a: secret(a) & ~F.contains(a, F.lit("="))
    # whether each argument is hidden by the one before, which was not hidden itself
    hides = F.aggregate(argv, F.array().cast("array<boolean>"), lambda out, a: F.array_append(out, ~F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(False)) & bare(a)))
    hidden = lambda i: F.coalesce(F.get(hides, i - 1), F.lit(False))
    return F.transform(argv, lambda a, i: F.when(hidden(i), F.lit(HIDDEN)).when(F.contains(a, F.lit("=")) & secret(name(a)), F.concat(name(a), F.lit(f"={HIDDEN}"))).otherwise(a))


def substituted(template: Column, values: Mapping[str, Column]) -> Column:
    """`${name}` in a column, in one pass, so that values are not looked at again; `$${` stays `${`. An unknown name is an error."""
    pieces = F.split(template, r"(?=\$\$\{)|(?<!\$)(?=\$\{)|(?<=\})", -1)
    known = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\$\{(\w+)\}$", 1)
        value = F.coalesce(F.try_element_at(known, name), F.raise_error(F.concat(F.lit("no variable "), name)).cast("string"))
        return F.when(F.startswith(p, F.lit("$${")), F.substr(p, F.lit(2))).when(name != "", value).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def expand(command: Sequence[str], matrix: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """The command for each combination of the axes, the last axis fastest."""
    axes = {k: list(v) for k, v in matrix.items()}
    return [[substitute(a, dict(zip(axes, c, strict=True))) for a in command] for c in itertools.product(*axes.values())]


def plan(commands: Iterable[Sequence[str]], inputs: Iterable[str]) -> dict[str, list]:
    """What would run, without secrets, and which inputs are not there."""
    return {"commands": [redact_command(c) for c in commands], "missing": [p for p in inputs if not os.path.exists(p)]}


def remap(path: str, table: Mapping[str, str]) -> str:
    """path with its longest known prefix replaced; prefixes end where a step ends."""
    fits = [p for p in table if path == p or path.startswith(p.rstrip("/") + "/")]
    best = max(fits, key=len, default=None)
    return path if best is None else table[best].rstrip("/") + path[len(best.rstrip("/")) :]


def balanced(costs: Mapping[str, float], workers: int) -> list[list[str]]:
    """Tasks to workers, the costliest first to whoever has least; names settle ties."""
    heap = [(0.0, w) for w in range(workers)]
    out: list[list[str]] = [[] for _ in range(workers)]
    for name in sorted(costs, key=lambda n: (-costs[n], n)):
        load, w = heapq.heappop(heap)
        out[w].append(name)
        heapq.heappush(heap, (load + costs[name], w))
    return out
