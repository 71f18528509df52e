"""Opt-in lossy transforms of one text, which return None where they don't make it smaller.

Plain functions, and the same as Arrow-batched column functions at the end.
"""

from __future__ import annotations

import ast
import base64
import re
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ALERTS, SYMBOL, SYMBOL_STOP_WORDS
from .codecs import dump_json, modal_keys, parse_json, text_udf

# Words that telegraphic text leaves out.
STOP_WORDS = frozenset(
    """
    the a an of to in on at by for with as is are was were be been being and or but if then so that this these those it its
    they them their we our you your he she his her from up out off over under into about during while which who whom whose
    there here also very just only some any all each more most much many such than have has had will would could should may
    might can do does did not no nor both either neither because though although however therefore thus hence per via upon
    within without between among across after before
    felt feel gone went good well fine nice overall really quite actually basically generally usually often sometimes always
    never thing things stuff lot bit part kind sort way ways time times day days week year good great big small new old made
    make makes get gets got take takes took give gives gave look looks looked came come comes said says like want need people
    everyone someone anyone something anything nothing reasonably ultimately concerning pleasant spirits progress expected
    routine minor discussion topics given happened happen throughout brief roughly
    """.split()
)
LEAST_WORDS, CONTENT_BYTES, LEAST_SENTENCES, LEAST_NEWLINES = 20, 5, 6, 4
#: What a marker of left-out text begins with.
MARK = "lossy"

_ALERT = re.compile("|".join(ALERTS))
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def symbols_of(text: str | None) -> set[str]:
    return {s for s in (ascii_lower(m) for m in re.findall(SYMBOL, text or "")) if s not in SYMBOL_STOP_WORDS}


def smaller(out: str, text: str) -> str | None:
    return out if len(out.encode()) < len(text.encode()) else None


def telegraphic(text: str) -> str | None:
    """Prose without its function words: facts, names and longer words stay, and what follows a number or a name."""
    words = text.split()
    if len(words) < LEAST_WORDS:
        return None
    kept, after_fact = [], False
    for word in words:
        bare = "".join(c for c in word if c.isalnum()).lower()
        stop = bare in STOP_WORDS
        number = bool(re.search("[0-9]", word))
        name = word[0].isupper() and not stop
        if not bare or number or after_fact or not stop and (name or len(bare.encode()) >= CONTENT_BYTES):
            kept.append(word)
        after_fact = number or name
    return smaller(" ".join(kept), text) if len(kept) < len(words) else None


def sentences(text: str) -> list[str]:
    parts = re.split(r"(?<=[.!?])(?=[ \n])", text)
    return [s for s in (p.lstrip() for p in parts) if s]


def salience(unit: str) -> int:
    """Facts of a unit: 3 for each word with a digit, else 2 for a capital and over 2 bytes, else 1 from 8 bytes."""
    score = 0
    for word in re.findall(r"[^\W_]+", unit):
        size = len(word.encode())
        score += 3 if re.search("[0-9]", word) else 2 if word[0].isupper() and size > 2 else 1 if size >= 8 else 0
    return score


@dataclass(frozen=True)
class Lossy:
    """How much to leave out: boundary rows at either end stay; most_chars and most_rows, if not 0, cut lines and their number."""

    boundary: int = 3
    task: str | None = None
    most_chars: int = 0
    most_rows: int = 0

    def compact(self, text: str) -> str | None:
        wanted = symbols_of(self.task)
        try:
            value = parse_json(text)
        except (ValueError, RecursionError):
            value = None
        out = self._rows(value, wanted) if isinstance(value, list) else None
        return out if out is not None else self._text(text, wanted)

    def _must(self, unit: str, wanted: set[str]) -> bool:
        low = ascii_lower(unit)
        return bool(_ALERT.search(low)) or any(s in low for s in wanted)

    def _ends(self, n: int) -> set[int]:
        return {*range(min(self.boundary, n)), *range(max(0, n - self.boundary), n)}

    def _rows(self, rows: list, wanted: set[str]) -> str | None:
        n = len(rows)
        if n <= 2 * self.boundary + 2 or not all(isinstance(r, dict) for r in rows):
            return None
        keys = modal_keys(rows)
        keep = self._ends(n) | {i for i, r in enumerate(rows) if tuple(sorted(r)) != keys or self._must(dump_json(r), wanted)}
        if len(keep) == n:
            return None
        note = f"[{MARK}: {n - len(keep)} of {n} uniform rows elided; kept boundary+anomalies]"
        return smaller("\n".join([*(dump_json(rows[i]) for i in sorted(keep)), note]), dump_json(rows))

    def _text(self, text: str, wanted: set[str]) -> str | None:
        return self._lines(text, wanted) if text.count("\n") >= LEAST_NEWLINES else self._prose(text, wanted)

    def _prose(self, text: str, wanted: set[str]) -> str | None:
        parts = sentences(text) if wanted else []
        if len(parts) >= LEAST_SENTENCES:
            out = " ".join(s if self._must(s, wanted) else telegraphic(s) or s for s in parts)
            if (out := smaller(out, text)) is not None:
                return out
        return telegraphic(text)

    def _lines(self, text: str, wanted: set[str]) -> str | None:
        lines = text.split("\n")
        n = len(lines)
        if n <= 2 * self.boundary + 4:
            return None
        must = self._ends(n) | {i for i, line in enumerate(lines) if self._must(line, wanted)}
        scores = [salience(line) for line in lines]
        keep = set(must)
        facts = sorted(s for s in scores if s)
        if not wanted and facts:
            keep |= {i for i, s in enumerate(scores) if s >= facts[2 * len(facts) // 3]}
        if self.most_rows and len(keep) > self.most_rows:
            best = sorted(keep - must, key=lambda i: (-scores[i], i))
            keep = must | set(best[: max(0, self.most_rows - len(must))])
        if len(keep) == n and not self.most_chars:
            return None
        cut = lambda s: s if not self.most_chars or len(s) <= self.most_chars else s[: self.most_chars] + "…"
        note = "; lines truncated" if self.most_chars else ""
        kept = "\n".join(cut(lines[i]) for i in sorted(keep))
        return smaller(f"{kept}\n[{MARK}: {n - len(keep)} of {n} lines elided; kept boundary+alerts+relevant{note}]", text)


def compact_csv(text: str, boundary: int = 3, most_rows: int = 0) -> str | None:
    """A delimited table's header, its first and last rows, and rows of another shape or with an alert; counts of what is left out between.

    most_rows has no effect, as every kept row is one that must stay.
    """
    lines = text.split("\n")
    lines = [line.removesuffix("\r") for line in (lines[:-1] if lines[-1] == "" else lines)]
    if len(lines) < 3:
        return None
    tabs, commas = lines[0].count("\t"), lines[0].count(",")
    mark = "\t" if tabs >= commas else ","
    width, rows = lines[0].count(mark) + 1, lines[1:]
    n = len(rows)
    if not tabs and not commas or n <= 2 * boundary + 2:
        return None
    out, gap, dropped = [lines[0]], 0, 0
    for i, row in enumerate([*rows, None]):
        keep = row is None or i < boundary or i >= n - boundary or row.count(mark) + 1 != width or _ALERT.search(ascii_lower(row))
        if keep and gap:
            out.append(f"… {gap} rows omitted …")
            gap = 0
        if row is not None and keep:
            out.append(row)
        elif row is not None:
            gap, dropped = gap + 1, dropped + 1
    return smaller("\n".join(out), text) if dropped else None


_HTML_NOISE = [re.compile(rf"(?is)<{tag}[^>]*>.*?</{tag}\s*>") for tag in ("script", "style", "svg")] + [re.compile(r"(?s)<!--.*?-->")]
_HTML_ATTRIBUTE = re.compile(r"(?i)\s+(?:style|class|data-[^\s=>/]*|on[a-z][^\s=>/]*)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>'\"=`]+))?")
_HTML_TAG = re.compile("<[^>]+>")


def looks_like_html(text: str) -> bool:
    return text.lstrip().startswith("<") and ">" in text and bool("</" in text or "/>" in text or re.search("<html|<body|<div|<p>|<span|<table", ascii_lower(text)))


def compact_html(text: str) -> str | None:
    """Markup without scripts, styles, comments, presentational attributes and idle white space."""
    if not looks_like_html(text):
        return None
    out = text
    for noise in _HTML_NOISE:
        out = noise.sub("", out)
    out = _HTML_TAG.sub(lambda m: _HTML_ATTRIBUTE.sub("", m.group()), out)
    lines = (" ".join(line.split()) for line in out.split("\n"))
    return smaller("\n".join(line for line in lines if line), text)


_IMAGE = re.compile(r"data:image/([a-z+]+);base64,([A-Za-z0-9+/=]+)")


def image_marker(m: re.Match) -> str:
    return f"[image id={xxhash.xxh3_64_hexdigest(m.group().encode())[:8]} fmt={m[1]} ~{len(m[2]) * 3 // 4 // 1024}KB]"


def deref_images(text: str) -> str | None:
    """The text with each inline image replaced by a marker of its hash, format and size; None without images."""
    return _IMAGE.sub(image_marker, text) if _IMAGE.search(text) else None


def inline_images(text: str) -> dict[str, str]:
    """The originals by marker, to put them back."""
    return {image_marker(m): m.group() for m in _IMAGE.finditer(text)}


def put_images(text: str, originals: dict[str, str]) -> str:
    for marker, original in originals.items():
        text = text.replace(marker, original)
    return text


# Keys of a JSON schema that don't change what it accepts.
SCHEMA_NOTES = ("$schema", "$id", "$comment", "title", "examples")


def _slim(value, names: bool = False):
    """names: value's keys are names of properties, all of which stay."""
    if isinstance(value, dict):
        return {k: _slim(v, not names and k == "properties" and isinstance(v, dict)) for k, v in value.items() if names or k not in SCHEMA_NOTES}
    return [_slim(v) for v in value] if isinstance(value, list) else value


def slim_schema(text: str) -> str | None:
    """A JSON schema without annotations."""
    try:
        return smaller(dump_json(_slim(parse_json(text))), text)
    except (ValueError, RecursionError):
        return None


# Languages by extension whose bodies stand in braces, and words that open blocks which aren't functions.
BRACE_EXTENSIONS = frozenset("rs js jsx mjs cjs ts tsx go java c h cpp cc cxx hpp hh hxx pl pm".split())
CONTROL = frozenset("if else for while switch catch match do try return loop unsafe when elsif unless until foreach finally class struct enum interface impl trait namespace mod union extern synchronized select with using static_assert".split())
LEAST_BODY_LINES = 3

_QUIET = {
    # strings and comments, which hold no braces of the code
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'", re.S),
    "rs": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", re.S),
    "pl": re.compile(r"(?<![$@%&])#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S),
}
_NAMED = re.compile(r"\b(?:fn|func|function|sub)\b")
_ARROW = re.compile(r"=>\s*$|\|[^|{}]*\|\s*(?:->[^{}]*)?$")
_CALLABLE = re.compile(r"\)\s*(?:(?:const|noexcept|override|final|mutable)\s*)*(?:throws[\w.,\s]+|->[^{};]*|:[^{};]*)?\s*$")


def _opens_function(header: str) -> bool:
    head = header.strip()
    words = re.findall(r"[A-Za-z_]\w*", head)
    if _NAMED.search(head) or _ARROW.search(head):
        return not (words and words[0] in ("class", "struct", "interface", "trait", "impl", "mod", "match", "if", "while", "for", "switch") and not _ARROW.search(head) and words[0] in ("class", "interface", "trait"))
    return bool(words) and words[0] not in CONTROL and "(" in head and bool(_CALLABLE.search(head)) and not head.startswith("(")


def _brace_bodies(text: str, ext: str) -> tuple[list[tuple[int, int]], bool]:
    """Outermost function bodies, and whether the braces don't pair up."""
    quiet = _QUIET["rs" if ext == "rs" else "pl" if ext in ("pl", "pm") else "c"]
    code = quiet.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    bodies, opened, since = [], [], 0
    for m in re.finditer("[{};]", code):
        at = m.start()
        if m.group() == "{":
            inside = any(f for _, f in opened)
            opened.append((at, not inside and _opens_function(code[since:at])))
        elif m.group() == "}":
            if not opened:
                return bodies, True
            start, function = opened.pop()
            if function:
                # a short body isn't left out; functions within it may be, but they are no longer than it
                bodies.append((start, at + 1))
        elif any(f for _, f in opened) or "(" in code[since:at] and code.count("(", since, at) > code.count(")", since, at):
            continue
        since = at + 1
    return bodies, bool(opened)


def _python_bodies(text: str) -> list[tuple[int, int]] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    raw = text.encode()
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    place = lambda line, column: len(raw[: starts[line - 1] + column].decode())
    bodies: list[tuple[int, int]] = []
    pending: list[ast.AST] = [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first, last = node.body[0], node.body[-1]
            at = min([(first.lineno, first.col_offset), *((d.lineno, d.col_offset - 1) for d in getattr(first, "decorator_list", []))])
            span = (place(*at), place(last.end_lineno, last.end_col_offset))
            if text.count("\n", *span) + 1 >= LEAST_BODY_LINES:
                bodies.append(span)
                continue
        pending += ast.iter_child_nodes(node)
    return sorted(bodies)


def skeleton(text: str, path: str | None) -> str | None:
    """Source code with the bodies of functions of three lines or more replaced by a count of their lines."""
    ext = (path or "").rpartition(".")[2]
    if ext == "py":
        found, broken = _python_bodies(text), False
        if found is None:
            return None
    elif ext in BRACE_EXTENSIONS:
        found, broken = _brace_bodies(text, ext)
        found = [b for b in found if text.count("\n", *b) + 1 >= LEAST_BODY_LINES]
    else:
        return None
    out, at = [], 0
    for start, end in found:
        body = text[start:end]
        newlines = body.count("\n")
        mark = f"{{ /* {max(0, newlines - 1)} lines hidden */ }}" if ext != "py" else f"# {newlines + 1} lines hidden"
        out += [text[at:start], mark if len(mark) < len(body) else body]
        at = end
    short = smaller("".join(out) + text[at:], text) if found else None
    if short is None or not broken:
        return short
    return f"{'#' if ext in ('pl', 'pm') else '//'} [parse errors; skeleton may be incomplete]\n{short}"


def png_uri(payload: bytes = b"\x89PNG") -> str:
    """A data URI, for examples and tests."""
    return "data:image/png;base64," + base64.b64encode(payload).decode()


def lossy_udf(boundary: int = 3, task: str | None = None, most_chars: int = 0, most_rows: int = 0):
    return text_udf(Lossy(boundary, task, most_chars, most_rows).compact)


@F.pandas_udf(T.StringType())
def lossy_by_row(texts: pd.Series, tasks: pd.Series, most_chars: pd.Series, most_rows: pd.Series) -> pd.Series:
    """As lossy_udf, with a row's own task (null or empty: none) and limits."""
    known: dict[tuple, Lossy] = {}
    out = []
    for t, *how in zip(texts, tasks, most_chars, most_rows, strict=True):
        key = (how[0] or None, int(how[1]), int(how[2]))
        out.append(None if t is None else known.setdefault(key, Lossy(3, *key)).compact(t))
    return pd.Series(out, dtype=object)


telegraphic_text, html_text, images_text, schema_text = text_udf(telegraphic), text_udf(compact_html), text_udf(deref_images), text_udf(slim_schema)


def csv_udf(boundary: int = 3, most_rows: int = 0):
    return text_udf(lambda t: compact_csv(t, boundary, most_rows))


@F.pandas_udf(T.StringType())
def skeleton_text(texts: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else skeleton(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)
