"""Reversible encodings of one text: columnar JSON, columnar logs, line deltas.

Each encoder returns None where it can't help: no repetition to factor out, no fewer bytes, or no exact way back. They are
plain functions; columns() gives them as Arrow-batched UDFs.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What encoded texts begin with.
JSON_TOP, JSON_NESTED, LOG = "⟪jc1⟫", "⟪jc2⟫", "⟪lc1⟫"
LEAST_ROWS, LEAST_LINES, LEAST_FIELDS = 3, 4, 3


def _no_constant(name: str):
    raise ValueError(name)


def parse_json(text: str) -> Any:
    """A JSON value; raises ValueError for anything else, NaN and Infinity included."""
    return json.loads(text, parse_constant=_no_constant)


def dump_json(value: Any) -> str:
    """Compact JSON with sorted keys; equal strings mean equal values of equal types."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def is_table(value: Any) -> bool:
    """An array of three or more objects and nothing else."""
    return isinstance(value, list) and len(value) >= LEAST_ROWS and all(isinstance(x, dict) for x in value)


def modal(values: list) -> tuple[Any, int]:
    """The most frequent value, of several the smallest, and how often it occurs."""
    return min(Counter(values).items(), key=lambda x: (-x[1], x[0]))


def modal_keys(rows: list[dict]) -> tuple[str, ...]:
    return modal([tuple(sorted(r)) for r in rows])[0]


def largest_table(value: Any) -> tuple[list, list] | None:
    """(path, rows) of the table whose JSON is longest; of equally long ones the one that comes last in the text's order."""
    best: tuple[int, list, list] | None = None
    pending: list[tuple[list, Any]] = [([], value)]
    while pending:
        path, at = pending.pop()
        if is_table(at) and (best is None or len(dump_json(at).encode()) > best[0]):
            best = (len(dump_json(at).encode()), path, at)
        inner = sorted(at.items()) if isinstance(at, dict) else enumerate(at) if isinstance(at, list) else ()
        pending += [([*path, k], v) for k, v in inner]
    return None if best is None else (best[1], best[2])


def _put(value: Any, path: list, new: Any) -> Any:
    """value with new at path; raises if there is no such place."""
    if not path:
        return new
    out = dict(value) if isinstance(value, dict) else list(value)
    out[path[0]] = _put(value[path[0]], path[1:], new)
    return out


def table_lines(rows: list[dict]) -> list[str] | None:
    """Names of varying columns, constant columns, then a line for each row: its values, or the whole row if it has other keys."""
    keys = modal_keys(rows)
    if not keys:
        return None
    alike = [r for r in rows if tuple(sorted(r)) == keys]
    fixed = {k: alike[0][k] for k in keys if len({dump_json(r[k]) for r in alike}) == 1} if len(alike) >= 2 else {}
    varying = [k for k in keys if k not in fixed]
    body = [dump_json([r[k] for k in varying]) if tuple(sorted(r)) == keys else dump_json(r) for r in rows]
    return [dump_json(varying), dump_json(fixed), *body]


def rows_of_lines(lines: list[str]) -> list[dict]:
    """The inverse of table_lines(); raises if the lines aren't such."""
    varying, fixed = parse_json(lines[0]), parse_json(lines[1])
    rows = []
    for line in lines[2:]:
        values = parse_json(line)
        if isinstance(values, list):
            rows.append({**fixed, **dict(zip(varying, values, strict=True))})
        elif isinstance(values, dict):
            rows.append(values)
        else:
            raise ValueError(line)
    return rows


def json_encode(text: str) -> str | None:
    """Columnar form of a JSON table, or of the largest table inside a JSON value."""
    try:
        value = parse_json(text)
    except (ValueError, RecursionError):
        return None
    if is_table(value):
        head, found = [], ([], value)
    else:
        found = largest_table(value)
        if found is None:
            return None
        head = [dump_json(found[0]), dump_json(_put(value, found[0], None))]
    body = table_lines(found[1])
    if body is None:
        return None
    out = (JSON_NESTED if head else JSON_TOP) + "\n".join(head + body)
    return out if len(out.encode()) < len(text.encode()) and json_round_trips(text, out) else None


def json_decode(encoded: str) -> Any:
    """The JSON value of an encoded text; raises ValueError if it isn't one."""
    try:
        if encoded.startswith(JSON_TOP):
            return rows_of_lines(encoded[len(JSON_TOP) :].split("\n"))
        if encoded.startswith(JSON_NESTED):
            path, skeleton, *lines = encoded[len(JSON_NESTED) :].split("\n")
            return _put(parse_json(skeleton), parse_json(path), rows_of_lines(lines))
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError("not a columnar JSON text") from e
    raise ValueError("not a columnar JSON text")


def json_round_trips(original: str, encoded: str) -> bool:
    try:
        return dump_json(parse_json(original)) == dump_json(json_decode(encoded))
    except (ValueError, RecursionError):
        return False


def log_encode(text: str) -> str | None:
    """Columnar form of lines that share a template: fields that never change are written once."""
    lines = text.split("\n")
    if len(lines) < LEAST_LINES:
        return None
    fields = [line.split(" ") for line in lines]
    counts = [len(f) for f in fields if len(f) >= LEAST_FIELDS]
    if not counts:
        return None
    width, matching = modal(counts)
    if matching < LEAST_ROWS:
        return None
    columns = list(zip(*(f for f in fields if len(f) == width), strict=True))
    fixed = {i: c[0] for i, c in enumerate(columns) if len(set(c)) == 1}
    if not fixed:
        return None
    others = [i for i, f in enumerate(fields) if len(f) != width]
    meta = json.dumps([width, {str(i): v for i, v in sorted(fixed.items(), key=lambda x: str(x[0]))}, others], ensure_ascii=False, separators=(",", ":"))
    body = [" ".join(v for i, v in enumerate(f) if i not in fixed) if len(f) == width else line for f, line in zip(fields, lines, strict=True)]
    out = LOG + "\n".join([meta, *body])
    return out if len(out.encode()) < len(text.encode()) and log_round_trips(text, out) else None


def log_decode(encoded: str) -> str:
    """The text of an encoded log; raises ValueError if it isn't one."""
    if not encoded.startswith(LOG):
        raise ValueError("not a columnar log")
    meta, *lines = encoded[len(LOG) :].split("\n")
    try:
        width, fixed, others = parse_json(meta)
        known, skip = {int(k): v for k, v in fixed.items()}, set(others)
    except (TypeError, AttributeError) as e:
        raise ValueError("not a columnar log") from e
    out = []
    for i, line in enumerate(lines):
        if i in skip:
            out.append(line)
            continue
        values = line.split(" ")
        if len(values) != width - len(known):
            raise ValueError(line)
        rest = iter(values)
        out.append(" ".join(known[p] if p in known else next(rest) for p in range(width)))
    return "\n".join(out)


def log_round_trips(original: str, encoded: str) -> bool:
    try:
        return log_decode(encoded) == original
    except ValueError:
        return False


def _shortest_edits(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal lines of a longest common subsequence, by the greedy O(ND) search."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    x_end, y_end = len(a) - end - low, len(b) - end - low
    head, tail = [(i, i) for i in range(low)], [(len(a) - i, len(b) - i) for i in range(end, 0, -1)]
    frontier, trail = {1: 0}, []
    for d in range(x_end + y_end + 1):
        trail.append(dict(frontier))
        for k in range(-d, d + 1, 2):
            x = frontier[k + 1] if k == -d or k != d and frontier.get(k - 1, -1) < frontier.get(k + 1, -1) else frontier[k - 1] + 1
            y = x - k
            while x < x_end and y < y_end and a[low + x] == b[low + y]:
                x, y = x + 1, y + 1
            frontier[k] = x
            if x >= x_end and y >= y_end:
                pairs = []
                for step in range(d, -1, -1):
                    before = trail[step]
                    k = x - y
                    up = k == -step or k != step and before.get(k - 1, -1) < before.get(k + 1, -1)
                    px = before[k + 1] if up else before.get(k - 1, 0)
                    py = px - (k + 1 if up else k - 1)
                    stop_x, stop_y = (px, px - k) if up else (px + 1, px + 1 - k)
                    if step == 0:
                        stop_x, stop_y = 0, 0
                    while x > stop_x and y > stop_y:
                        x, y = x - 1, y - 1
                        pairs.append((low + x, low + y))
                    x, y = px, py
                return head + pairs[::-1] + tail
    return head + tail


def delta_encode(base: str, text: str, context: int = 3) -> str:
    """A unified diff that turns base into text."""
    a, b = _lines(base), _lines(text)
    same = [*_shortest_edits(a, b), (len(a), len(b))]
    edits, i, j = [], 0, 0
    for x, y in same:
        edits += [("-", n, j) for n in range(i, x)] + [("+", x, n) for n in range(j, y)]
        if x < len(a):
            edits.append((" ", x, y))
        i, j = x + 1, y + 1
    changed = [n for n, e in enumerate(edits) if e[0] != " "]
    out = ["--- original\n", "+++ modified\n"]
    n = 0
    while n < len(changed):
        last = n
        while last + 1 < len(changed) and changed[last + 1] - changed[last] <= 2 * context:
            last += 1
        part = edits[max(0, changed[n] - context) : changed[last] + context + 1]
        old, new = sum(e[0] != "+" for e in part), sum(e[0] != "-" for e in part)
        at = lambda start, count: f"{start + (count > 0)}" + (f",{count}" if count != 1 else "")
        out.append(f"@@ -{at(part[0][1], old)} +{at(part[0][2], new)} @@\n")
        for sign, x, y in part:
            line = b[y] if sign == "+" else a[x]
            out.append(sign + line if line.endswith("\n") else f"{sign}{line}\n\\ No newline at end of file\n")
        n = last + 1
    return "".join(out)


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def delta_apply(base: str, patch: str) -> str:
    """text of delta_encode(base, text); raises ValueError where the patch doesn't fit."""
    a, out, at = _lines(base), [], 0
    rows = _lines(patch)
    n = 0
    while n < len(rows):
        row = rows[n]
        if row.startswith("@@ "):
            start, _, count = row.split(" ")[1][1:].partition(",")
            begin = int(start) - (count != "0")
            if not at <= begin <= len(a):
                raise ValueError(row)
            out += a[at:begin]
            at = begin
        elif row[:1] in " -+" and not (n < 2 and row.startswith(("---", "+++"))):
            line = row[1:]
            if n + 1 < len(rows) and rows[n + 1].startswith("\\"):
                line = line[:-1]
            if row[0] in " -":
                if at >= len(a) or a[at] != line:
                    raise ValueError(row)
                at += 1
            if row[0] in " +":
                out.append(line)
        n += 1
    return "".join(out + a[at:])


def delta_round_trips(base: str, text: str, patch: str) -> bool:
    try:
        return delta_apply(base, patch) == text
    except ValueError:
        return False


def text_udf(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """f as an Arrow-batched column function; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


json_crush, log_crush = text_udf(json_encode), text_udf(log_encode)


def _expanded(encoded: str) -> str | None:
    try:
        return log_decode(encoded) if encoded.startswith(LOG) else dump_json(json_decode(encoded))
    except ValueError:
        return None


expand = text_udf(_expanded)


@F.pandas_udf(T.BooleanType())
def round_trips(original: pd.Series, encoded: pd.Series) -> pd.Series:
    """Whether an encoded text, JSON or log, has its original's value."""
    check = lambda o, e: None if o is None or e is None else log_round_trips(o, e) if e.startswith(LOG) else json_round_trips(o, e)
    return pd.Series([check(o, e) for o, e in zip(original, encoded, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def delta(base: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or t is None else delta_encode(b, t) for b, t in zip(base, text, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def apply_delta(base: pd.Series, patch: pd.Series) -> pd.Series:
    def run(b: str | None, p: str | None) -> str | None:
        try:
            return None if b is None or p is None else delta_apply(b, p)
        except ValueError:
            return None

    return pd.Series([run(b, p) for b, p in zip(base, patch, strict=True)], dtype=object)
