"""Scalar expressions over blocks of text, as Column functions.

Lower-casing is of A-Z only unless a function says otherwise, lengths are of characters unless it says bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]

# Words that are never symbols of a task.
SYMBOL_STOP_WORDS = """
the and for this that with from into not but all can you are let pub use mut self return const fix add make get set new
out the. src run why how fn. ref
""".split()
# Words whose presence marks a line or a row as an alert, wherever they stand in it.
ALERTS = ["error", "fail", "critical", "fatal", "warn", "exception", "denied", "timeout"]
# What marks a reasoning trace as holding a conclusion.
CONCLUSIONS = ["therefore", "the fix", "root cause", "conclusion", "decided", "so i", "in summary", "the bug is", "the issue is", "confirmed"]
# Kinds of blocks by what may happen to them.
DEDUP_KINDS = ["file_read", "dir_listing", "tool_output", "stack_trace", "test_output"]
DROPPABLE_KINDS = [*DEDUP_KINDS, "diff"]
# Patterns of spans that must survive as they are.
PROTECTED = {
    "path": r"(?:[\w.-]+/)+[\w.-]+\.\w+|/[\w./-]+",
    "line_number": r":\d+(?::\d+)?\b",
    "error_code": r"\b[EC]\d{3,5}\b",
    "numeric_literal": r"\b\d+\b",
    "null_vs_empty": r"\bnull\b|\"\"|''",
}
SYMBOL = r"[A-Za-z_][A-Za-z0-9_./-]{2,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded up; null: 0."""
    return F.coalesce(F.floor((F.char_length(text) + 3) / 4), F.lit(0)).cast("int")


def mutation_class(kind: Column) -> Column:
    return F.when(kind == "system_prompt", "frozen").when(kind.isin("tool_schema", "compact_summary"), "slow").otherwise("fast")


def stability_rank(kind: Column) -> Column:
    return F.when(kind == "system_prompt", 0).when(kind.isin("tool_schema", "compact_summary"), 1).otherwise(2)


def symbols(text: Column) -> Column:
    """Distinct lower-cased identifiers, dotted names and paths of three characters or more, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), ascii_lower)
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda s: ~s.isin(SYMBOL_STOP_WORDS))))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands anywhere in the lower-cased text, in one scan of it."""
    return ascii_lower(text).rlike("|".join(w.replace(".", r"\.") for w in words))


def is_alert(text: Column) -> Column:
    return contains_any(text, ALERTS)


def has_conclusion(text: Column) -> Column:
    return contains_any(text, CONCLUSIONS)


def is_relevant(text: Column, task_symbols: Column) -> Column:
    """Whether one of the symbols is part of the lower-cased text; false without symbols."""
    return F.exists(task_symbols, lambda s: F.contains(ascii_lower(text), s))


def salience(text: Column) -> Column:
    """Facts in a unit of text: 3 for a word with a digit, else 2 for one that begins with a capital and has over 2 bytes, else 1 from 8 bytes."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    score = lambda w: F.when(w.rlike("[0-9]"), 3).when(w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 2), 2).when(F.octet_length(w) >= 8, 1).otherwise(0)
    return F.aggregate(F.transform(words, score), F.lit(0), lambda a, x: a + x)


def truncate(text: Column, n: int) -> Column:
    return text if n == 0 else F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def lines_of(text: Column) -> Column:
    """Lines parted by line feeds; a last empty one counts."""
    return F.split(text, "\n", -1)


def sentences_of(text: Column) -> Column:
    """Pieces that end in . ! or ? before a space, a line feed or the end, without leading white space."""
    parts = F.transform(F.split(text, r"(?<=[.!?])(?=[ \n])"), lambda s: F.regexp_replace(s, r"^\s+", ""))
    return F.filter(parts, lambda s: s != "")


def protected_count(text: Column, kind: str) -> Column:
    """Protected spans of a kind; letters and digits of every script count as such."""
    return F.regexp_count(text, F.lit("(?U)" + PROTECTED[kind]))


def protected_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>: protected spans of all kinds, in order of kind and place, in bytes of UTF-8; they may overlap.

    What stands between a pattern's matches and the matches themselves add up to the places of both.
    """
    found = []
    for kind, pattern in PROTECTED.items():
        p = "(?U)" + pattern
        sizes = lambda xs: F.transform(xs, lambda x: F.octet_length(x).cast("long"))
        total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x)
        places = F.struct(sizes(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("hits"), sizes(F.split(text, p, -1)).alias("gaps"))

        def spans(name: str):
            def of(v: Column) -> Column:
                start = lambda i: total(v["gaps"], i + 1) + total(v["hits"], i)
                return F.transform(v["hits"], lambda n, i: F.struct(F.lit(name).alias("kind"), start(i).alias("start"), (start(i) + n).alias("end")))

            return of

        found.append(F.flatten(F.transform(F.array(places), spans(kind))))
    return F.concat(*found)


def looks_like_html(text: Column) -> Column:
    start = F.regexp_replace(text, r"^\s+", "")
    tags = ascii_lower(text).rlike("<html|<body|<div|<p>|<span|<table")
    return start.startswith("<") & F.contains(text, F.lit(">")) & (F.contains(text, F.lit("</")) | F.contains(text, F.lit("/>")) | tags)


def delimiter(header: Column) -> Column:
    """A tab if there are as many as commas at least, else a comma; null without either."""
    tabs, commas = F.regexp_count(header, F.lit("\t")), F.regexp_count(header, F.lit(","))
    return F.when((tabs == 0) & (commas == 0), F.lit(None).cast("string")).when(tabs >= commas, "\t").otherwise(",")


def file_class(path: Column) -> Column:
    ext = F.substring_index(path, ".", -1)
    return F.when(ext.isin("rs", "py", "js", "ts", "tsx", "go"), "code").when(ext == "json", "json").when(ext == "log", "log").otherwise("prose")


def language(path: Column) -> Column:
    """The language of a source file by its extension, or null."""
    # Extensions by language.
    by = {
        "rust": ["rs"], "python": ["py"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts"], "tsx": ["tsx"], "go": ["go"],
        "java": ["java"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "perl": ["pl", "pm"],
    }
    ext, out = F.substring_index(path, ".", -1), F.lit(None).cast("string")
    for name, extensions in by.items():
        out = F.when(ext.isin(extensions), name).otherwise(out)
    return out


def narrowed_path(tool: Column, scope: Column, task_symbols: Column) -> Column:
    """The path of a search call over everything: the longest symbol of the task that holds a slash; other calls keep their scope.

    Among symbols of one length the smallest wins.
    """
    search = ascii_lower(tool).rlike("grep|rg|find|search")
    paths = F.filter(task_symbols, lambda s: F.contains(s, F.lit("/")))
    best = F.array_min(F.transform(paths, lambda s: F.struct((-F.octet_length(s)).alias("n"), s.alias("path"))))["path"]
    return F.when(search & (scope.isNull() | scope.isin(".", "./")), F.coalesce(best, scope)).otherwise(scope)


def content_id(text: Column) -> Column:
    """A stable id of a text: the first 16 hexadecimal digits of its SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(16))


def holdout(session: Column, share: float) -> Column:
    """Whether a session's hash falls into the held-out share of ten thousandths."""
    return F.pmod(session, F.lit(10_000)) / 10_000.0 < share


def ratio(net: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(net / total)


def redact(text: Column, most: int = 40) -> Column:
    """The first most characters on one line, with e-mail addresses, home folders and bearer tokens masked."""
    out = F.translate(F.left(text, F.lit(most)), "\n", " ")
    # What is masked, and by what.
    for pattern, mask in [
        (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}", "<email>"),
        (r"/Users/[^/\s]+", "/Users/<user>"),
        (r"Bearer [A-Za-z0-9\-._~+/]+=*", "Bearer <tok>"),
    ]:
        out = F.regexp_replace(out, pattern, mask)
    return out


def output_category(text: Column) -> Column:
    """json, error_short, prose or other, of a tool's output."""
    start = F.regexp_replace(text, r"^\s+", "")
    short = (token_count(text) < 30) & ~F.contains(F.left(text, F.lit(40)), F.lit("\n"))
    return (
        F.when(start.rlike(r"^[{\[]"), "json")
        .when(F.left(text, F.lit(50)).rlike("[Ee]rror") | short, "error_short")
        .when(start.rlike("^(#|The |This |I |We |To |In )"), "prose")
        .otherwise("other")
    )


def version_parts(version: Column) -> Column:
    """A version's numbers as an array that compares as versions do."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"^\d+", 0), F.lit("999999999")).cast("int"), F.lit(0)))


def uptime(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m"))).when(m > 0, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def short_time(milliseconds: Column) -> Column:
    """A time as whole µs, as ms with one decimal, or as s with two."""
    return (
        F.when(milliseconds < 1, F.concat(F.format_string("%.0f", milliseconds * 1000), F.lit("µs")))
        .when(milliseconds < 1000, F.format_string("%.1fms", milliseconds))
        .otherwise(F.format_string("%.2fs", milliseconds / 1000))
    )


def distinct_in_order(values: Column) -> Column:
    """The values of an array, each where it first stands."""
    return F.array_distinct(values)


#: Characters of a response's head, and of its tail, that are looked through for usage figures.
HEAD, TAIL = 2 * 1024 * 1024, 64 * 1024


def windowed(body: Column, head: int = HEAD, tail: int = TAIL) -> tuple[Column, Column]:
    """The head and the tail of a response: all that is ever looked through, however long it is."""
    return F.left(body, F.lit(head)), F.right(body, F.lit(tail))


def cache_usage(body: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """struct(read, created): cached tokens of a response, both from its head or both from its tail; null without."""

    def both(part: Column) -> Column:
        read, created = first_number(part, "cache_read_input_tokens"), first_number(part, "cache_creation_input_tokens")
        return F.when(read.isNotNull() & created.isNotNull(), F.struct(read.alias("read"), created.alias("created")))

    return F.coalesce(*[both(p) for p in windowed(body, head, tail)])


def tail_first_output(body: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """Output tokens of a response: of its tail, where a stream's last figure stands, else of its head."""
    first, last = windowed(body, head, tail)
    return F.coalesce(output_tokens(last), output_tokens(first))


def first_number(body: Column, key: str) -> Column:
    """The integer after the first quoted key of a response body, or null."""
    found = F.regexp_extract(body, rf'"{key}"\s*:\s*(\d+)', 1)
    return F.when(found != "", found.cast("long"))


def largest_number(body: Column, key: str) -> Column:
    """The largest integer after a quoted key of a response body, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(body, F.lit(rf'"{key}"\s*:\s*(\d+)'), F.lit(1)), lambda x: x.cast("long")))


def output_tokens(body: Column) -> Column:
    """Output tokens of either provider's response: the largest number, streams repeat it growing."""
    return F.coalesce(largest_number(body, "output_tokens"), largest_number(body, "completion_tokens"))


def hour_long_cache(request: Column) -> Column:
    """Whether a request asks for the one-hour cache anywhere."""
    return request.rlike(r'"ttl"\s*:\s*"1h"')


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for a zero vector or vectors of different length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalised(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))
