"""PII: keyed surrogates of detected entities, of the same type, gender, script and format.

Digits and letters of an entity are ranked within its format (how many characters of which alphabet, in which order) and
sent through a keyed permutation of all ranks of that format; signs, case and length stay. The permutation is a Feistel
network E with a rotation inside, x -> E^-1(E(x) + c), so it has an inverse (two entities never get one surrogate) and
no fixed point (an entity never keeps its own). The same entity gets the same surrogate in every document and on every
executor without any exchange; writings of one entity that differ in case or in signs keep pace with each other.
Given names change places within their list of the same gender and script. check_surrogates() recounts distinctness over
a whole corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, tidy

#: A key of one's own replaces this one in production; who holds it can undo the surrogates.
DEFAULT_KEY = b"segweave surrogate key"

#: Letters by script, each letter's place is its rank; cases correspond.
SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "latin-marked": ("àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
}
DIGITS = "0123456789"
#: Given names by gender and script, which change places within their list.
GIVEN_NAMES = [
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Hans".split(),
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Laura Marie Julia".split(),
    "Иван Алексей Дмитрий Сергей Николай Михаил Павел Андрей Олег Юрий".split(),
    "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина".split(),
    "Γιώργος Νίκος Κώστας Γιάννης Δημήτρης Πέτρος".split(),
    "Μαρία Ελένη Αικατερίνη Σοφία Άννα Βασιλική".split(),
]
_GIVEN = {name for names in GIVEN_NAMES for name in names}
#: What a name follows.
SAID = r"(?i:my name is|name:|i am called|ich heiße|mein name ist|je m['’]appelle|me llamo|mi nombre es|меня зовут)"
#: Beginnings of keys, which are their format and stay.
KEY_HEADS = r"(?:sk|pk|rk)-(?:live-|test-|proj-)?|AKIA|ASIA|gh[pousr]_|xox[bpars]-"
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|г-н|г-жа|κ|κα"

_CLASS_OF = {c: (f"{name}", i) for name, pair in SCRIPTS.items() for letters in pair for i, c in enumerate(letters)} | {c: ("digit", i) for i, c in enumerate(DIGITS)}
_SIZE = {name: len(pair[0]) for name, pair in SCRIPTS.items()} | {"digit": 10, "hex": 16}
_HEX = {c: i for i, c in enumerate("0123456789abcdef")} | {c: i for i, c in enumerate("0123456789ABCDEF")}


class Permutation:
    """A keyed permutation of 0 to n - 1 without fixed points, n >= 2; other tweaks give other permutations."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = 1 << max(1, ((n - 1).bit_length() + 1) // 2)
        self.key = hmac.digest(key, f"{tweak}|{n}".encode(), "sha256")
        self.shift = 1 + int.from_bytes(hmac.digest(self.key, b"shift", "sha256"), "big") % (n - 1)

    def _round(self, i: int, x: int) -> int:
        size = (self.half.bit_length() + 7) // 8 + 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(size, "big"), digest_size=min(64, size), key=self.key, salt=bytes([i])).digest(), "big") % self.half

    def _feistel(self, x: int, turns: range, sign: int) -> int:
        while True:
            a, b = divmod(x, self.half)
            for i in turns:
                if sign > 0:
                    a, b = b, (a + self._round(i, b)) % self.half
                else:
                    a, b = (b - self._round(i, a)) % self.half, a
            x = a * self.half + b
            if x < self.n:  # walks the cycle until the rank is one of the format's
                return x

    def __call__(self, x: int) -> int:
        return self._feistel((self._feistel(x, range(8), 1) + self.shift) % self.n, range(7, -1, -1), -1)


@lru_cache(10_000)
def _permutation(key: bytes, tweak: str, n: int) -> Permutation:
    return Permutation(key, tweak, n)


def reformat(text: str, key: bytes, kind: str, hexadecimal: bool = False, fixed: Callable[[int], bool] = lambda i: False) -> str:
    """text with its letters and digits replaced within their alphabets; other characters, and those at fixed places, stay."""
    places: list[tuple[int, str, int]] = []
    for i, c in enumerate(text):
        known = ("hex", _HEX[c]) if hexadecimal and c in _HEX else _CLASS_OF.get(c)
        if known and not fixed(i):
            places.append((i, *known))
    if not places:
        return text
    n = x = 0
    n = 1
    for _, alphabet, value in places:
        n *= _SIZE[alphabet]
        x = x * _SIZE[alphabet] + value
    x = _permutation(key, f"{kind}|{','.join(a for _, a, _ in places)}", n)(x)
    out = list(text)
    for i, alphabet, _ in reversed(places):
        x, value = divmod(x, _SIZE[alphabet])
        upper = text[i].isupper()
        if alphabet == "digit":
            out[i] = DIGITS[value]
        elif alphabet == "hex":
            digit = "0123456789abcdef"[value]
            out[i] = digit.upper() if hexadecimal and text.upper() == text else digit
        else:
            out[i] = SCRIPTS[alphabet][upper][value]
    return "".join(out)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def walk(x: str, step: Callable[[str], str], taken: Callable[[str], bool]) -> str:
    """step(x), and on from there while the result is taken by other entities; still a permutation of all that aren't taken."""
    x = step(x)
    while taken(x):
        x = step(x)
    return x


def _email(m: str, key: bytes) -> str:
    local, _, domain = m.rpartition("@")
    # The name of the domain is replaced too; its last label is the format.
    name, dot, suffix = domain.rpartition(".")
    return f"{reformat(local, key, 'email')}@{reformat(name, key, 'domain')}{dot}{suffix}"


def _ip(m: str, key: bytes) -> str:
    x = 0
    for part in m.split("."):
        x = x << 8 | int(part)
    x = _permutation(key, "ip", 1 << 32)(x)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _phone(m: str, key: bytes) -> str:
    # The country's code stays: it is the format.
    code = re.match(r"\+\d{1,3}(?=\D)|\+\d", m)
    kept = code.end() if code else 0
    return reformat(m, key, "phone", fixed=lambda i: i < kept)


def _valid_card(m: str) -> bool:
    digits = re.sub(r"\D", "", m)
    return luhn_digit(digits[:-1]) == digits[-1]


def _card(m: str, key: bytes) -> str:
    if not _valid_card(m):
        return walk(m, lambda x: reformat(x, key, "number"), _valid_card)
    # A valid number gets a valid one: all but the check digit are permuted.
    last = max(i for i, c in enumerate(m) if c.isdigit())
    body = reformat(m, key, "card", fixed=lambda i: i == last)
    return body[:last] + luhn_digit(re.sub(r"\D", "", body[:last])) + body[last + 1 :]


def _iban_check(m: str) -> str:
    """The check digits that the IBAN's other characters ask for."""
    plain = re.sub(r"\s", "", m[4:]) + m[:2] + "00"
    return f"{98 - int(''.join(str(int(c, 36)) for c in plain)) % 97:02d}"


def _valid_iban(m: str) -> bool:
    return m[2:4] == _iban_check(m)


def _iban(m: str, key: bytes) -> str:
    if not _valid_iban(m):
        # Its check digits are its own, and no valid one's surrogate is met.
        return walk(m, lambda x: reformat(x, key, "account", fixed=lambda i: i < 2), _valid_iban)
    body = reformat(m, key, "iban", fixed=lambda i: i < 4)
    return body[:2] + _iban_check(body) + body[4:]


def _secret(m: str, key: bytes) -> str:
    head = re.match(r"(?s).*?[=:]\s*[\"']?", m).group()
    tail = m[len(head) :]
    body = tail.rstrip("\"'")
    cases = {c.isupper() for c in body if c in "abcdefABCDEF"}
    return head + reformat(body, key, "secret", hexadecimal=len(cases) < 2 and all(c in _HEX or not c.isalnum() for c in body)) + tail[len(body) :]


def _headed(m: str, key: bytes) -> str:
    head = re.match(KEY_HEADS, m).group()
    return head + reformat(m[len(head) :], key, f"key|{head}")


def _name(m: str, key: bytes) -> str:
    title = re.match(rf"(?:{TITLES})\.?\s+|{SAID}\s+", m).group()
    out = []
    for word in re.split(r"(\s+|-)", m[len(title) :]):
        for k, names in enumerate(GIVEN_NAMES):
            if word in names:
                out.append(names[_permutation(key, f"given|{k}", len(names))(names.index(word))])
                break
        else:
            out.append(walk(word, lambda x: reformat(x, key, "name"), _GIVEN.__contains__))
    return title + "".join(out)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: (kind, pattern, surrogate); of patterns that match at one place the first wins.
ENTITIES: list[tuple[str, str, Callable[[str, bytes], str]]] = [
    ("email", r"[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}", _email),
    ("secret", r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b[\"']?\s*[=:]\s*)(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})", _secret),
    ("headed_key", rf"(?<![\w-])(?:(?:{KEY_HEADS})(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{{16,}})(?![\w-])", _headed),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])", lambda m, key: reformat(m, key, "ipv6", hexadecimal=True)),
    ("key", r"(?<!\w)(?=[a-f]*\d)[0-9a-f]{32,}(?!\w)|(?<!\w)(?=[A-F]*\d)[0-9A-F]{32,}(?!\w)", lambda m, key: reformat(m, key, "secret", hexadecimal=True)),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b(?<=\d)", _iban),
    ("ip", rf"(?<!\d)(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)", _ip),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", lambda m, key: reformat(m, key, "ssn")),
    ("card", r"(?<!\d)(?<!\d[.-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![.-]?\d)", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w/.-])0\d{1,4}[/ ]\d{3,4}[ -]?\d{2,5}(?![\w/-])", _phone),
    ("name", rf"(?:\b(?:{TITLES})\b\.?|\b{SAID})\s+[^\W\d_a-z]\w+(?:(?: |-)[^\W\d_a-z]\w+)?", _name),
]
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in ENTITIES))
_MAKERS = {kind: make for kind, _, make in ENTITIES}
#: Texts without any of these hold no entity.
_SIGN = re.compile(rf"[@\d]|(?i:token|key|secret|passw)|\b(?:{TITLES})\b|{SAID}")
#: Entities whose surrogates a task keeps.
CACHE = 50_000
#: Further keys tried for an entity whose surrogate another one of its text has.
TWEAKS = 20


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the text's entities, in order, none overlapping."""
    if not text or not _SIGN.search(text):
        return []
    return [(m.start(), m.end(), m.lastgroup) for m in _ANY.finditer(text)]


class Pseudonymizer:
    def __init__(self, key: bytes = DEFAULT_KEY):
        self.key = key
        self.known: dict[tuple[str, str], str] = {}

    def surrogate(self, kind: str, entity: str) -> str:
        at = (kind, entity)
        if (out := self.known.get(at)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[at] = out = _MAKERS[kind](entity, self.key)
        return out

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, entity, surrogate) of each replacement."""
        found = find_entities(text)
        if not found:
            return text, []
        parts, done, at = [], [], 0
        owner: dict[tuple[str, str], str] = {}
        for start, end, kind in found:
            entity = text[start:end]
            new, turn = self.surrogate(kind, entity), 0
            # Where formats overlap, as secrets of hexadecimal and of other letters do, a later entity gives way.
            while owner.setdefault((kind, new), entity) != entity and turn < TWEAKS:
                turn += 1
                new = _MAKERS[kind](entity, self.key + b"|%d" % turn)
            parts += (text[at:start], new)
            done.append((kind, entity, new))
            at = end
        parts.append(text[at:])
        return "".join(parts), done


def replace_pii(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """docs with all its columns and rows, text holding surrogates; n_chars, if there is one, counts the new text."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymizer(key)
        for batch in batches:
            columns = list(batch.columns)
            texts = [p.replace(t.as_py())[0] for t in batch.column(at)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                old = batch.column(counted)
                columns[counted] = pa.array([n.as_py() if t is None or n.as_py() is None else len(t) for t, n in zip(texts, old, strict=True)], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def pseudonymize(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text, n_entities, kinds for every row of docs(doc_id, text).

    kinds lists the kinds found, distinct and sorted, joined by commas. Null text stays null, with no entities; null ids
    and repeated rows come out as they came in; other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymizer(key)
        for batch in batches:
            rows = [p.replace(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for t, _ in rows], pa.string()), pa.array([len(e) for _, e in rows], pa.int64()), pa.array([",".join(sorted({k for k, _, _ in e})) for _, e in rows], pa.string())],
                names=["doc_id", "text", "n_entities", "kinds"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_entities long, kinds string")


def entity_surrogates(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """kind, entity, surrogate, n: the distinct entities of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymizer(key)
        for batch in batches:
            rows = [e for t in batch.column(0) for e in p.replace(t.as_py())[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(tidy(run), "kind string, entity string, surrogate string").groupBy("kind", "entity", "surrogate").agg(F.count("*").alias("n"))


def check_surrogates(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """kind, surrogate, entities: surrogates that stand for several entities, or for themselves; empty if all is well."""
    by = entity_surrogates(docs, key).groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("entities"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("kept"))
    return by.where("entities > 1 or kept = 1").drop("kept")
