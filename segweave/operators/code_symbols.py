"""Symbols of source code: identifiers of the code itself, not words of its comments and strings."""

from __future__ import annotations

import io
import keyword
import re
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import BRACE_EXTENSIONS, _QUIET, ascii_lower, symbols_of

# Reserved words of the languages in braces.
RESERVED = frozenset(
    """
    abstract any as async await boolean break case catch char class const constructor continue crate debugger declare default
    delete do double dyn else enum export extends extern false final finally float fn for from func function get go goto if impl
    implements import in instanceof int interface is let long loop map match mod module move mut namespace native new nil null
    number object of override package private protected pub public range readonly ref require return select self set short
    signed sizeof static string struct super switch symbol synchronized this throw throws trait transient true try type
    typedef typeof undefined union unknown unsafe unsigned use using var virtual void volatile where while with yield
    """.split()
)
LEAST_BYTES = 3


def identifiers(text: str, path: str | None) -> set[str]:
    """Identifiers of three bytes or more, lower-cased; for an unknown language, or without any, the symbols of plain text."""
    ext = (path or "").rpartition(".")[2]
    found: set[str] = set()
    if ext == "py":
        try:
            found = {t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.NAME and not keyword.iskeyword(t.string)}
        except (tokenize.TokenError, SyntaxError, IndentationError):
            found = set()
    elif ext in BRACE_EXTENSIONS:
        code = _QUIET["rs" if ext == "rs" else "pl" if ext in ("pl", "pm") else "c"].sub(" ", text)
        found = set(re.findall(r"[^\W\d]\w*", code)) - RESERVED
    out = {ascii_lower(s) for s in found if len(s.encode()) >= LEAST_BYTES}
    return out or symbols_of(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def code_symbols(texts: pd.Series, paths: pd.Series) -> pd.Series:
    """Sorted symbols of a text, by the language of its path."""
    return pd.Series([None if t is None else sorted(identifiers(t, p)) for t, p in zip(texts, paths, strict=True)], dtype=object)
