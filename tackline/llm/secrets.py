"""Secret scanning by assignment-aware lexing.

Three plain patterns give the base spans. Beyond them, each text is read as
source or configuration syntax by :mod:`tackline.llm.assignments`: name-literal
pairs are lexed, constants on the right are resolved to the literals that they
were last given, and literals are scored by the sensitivity of the name that they
reach and by their own strength. Literals in comments count by the plain patterns
alone.

Defined cases: a null or empty text has no spans; a text of any length is read
whole; repeated rows, and rows that share an id, give a result each; of spans that
begin at one place the kinds come in the order listed; other columns of the input
are ignored by :func:`scan` and carried unchanged by :func:`redact`, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.assignments import Value, read
from tackline.llm.texts import map_rows, small_batches

KINDS = ("assign", "access", "hex", "literal")

#: Names with a sensitive word in them, and how strongly each speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9,
    "auth": 0.7, "authorization": 0.8, "bearer": 0.9, "signature": 0.6, "salt": 0.6, "connectionstring": 0.8,
}
#: One of these is in every text that holds a sensitive name.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "salt", "string")
#: Literals that stand for a value to be filled in.
PLACEHOLDER = re.compile(r"(?ai)\A(?:x+|\*+|\.+|none|null|true|false|todo|changeme|example|placeholder|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)\Z")

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that a plain pattern takes for a value where they are a type: redaction leaves them.
TYPE_WORDS = {"string", "secretstr", "secretbytes", "optional", "literal", "unicode", "varchar", "object"}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself) of the plain patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign", m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def name_weight(name: str) -> float:
    """How sensitive a target name is: the most telling word, or pair of words, in it."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


def literal_weight(value: str | Value) -> float:
    """0 for placeholders and short words, nearer to 1 the more random the literal looks."""
    value = Value.literal(value, 0) if isinstance(value, str) else value
    n, counts = value.length, value.counts
    if n < 6 or (value.text is not None and PLACEHOLDER.match(value.text)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 4.0 * 0.7 + classes * 0.1)


def literal_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through constants."""
    low = text.lower()
    if not any(w in low for w in _HINTS):
        return []
    found, seen = set(), set()
    for name, value, _ in read(text)[0]:
        weight = name_weight(name)
        if weight and weight * literal_weight(value) >= threshold:
            found.update(value.spans(seen))
    return sorted(found)


def all_spans(text: str, threshold: float = 0.5) -> tuple[list, list]:
    """Base spans, and base spans with those of literals that no base span covers."""
    base = base_spans(text)
    starts, reach = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    more = [(s, e, "literal", s, e) for s, e in literal_spans(text, threshold) if not (at := bisect_right(starts, s)) or reach[at - 1] < e]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _digest(spans: list) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


_SCAN = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_literal", T.LongType())])


def scan(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by kind, a digest of the base spans, and all spans as kind:start:end.

    Offsets are code points, ends exclusive.
    """

    def rows(pairs):
        out = []
        for i, text in pairs:
            base, spans = all_spans(text, threshold)
            n = Counter(s[2] for s in spans)
            out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans), n["literal"]))
        return out

    return map_rows(docs, rows, _SCAN, id_col, text_col)


def redact_text(text: str, threshold: float = 0.5, mark: str = "[SECRET]") -> str:
    """The text with the secret part of each span replaced by ``mark``."""
    out, at = [], 0
    spans = sorted((s[3], s[4]) for s in all_spans(text, threshold)[1])
    types = read(text)[1] if any(text[s:e].lower() in TYPE_WORDS for s, e in spans) else ()
    for s, e in spans:
        if (s, e) in types and text[s:e].lower() in TYPE_WORDS:
            continue
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced; ``chars_col``, where present, follows the new text.

    A document without secrets, or with a null text, comes back unchanged.
    """
    arrow = to_arrow_schema(docs.schema)
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t and redact_text(t, threshold) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, type=arrow.field(at).type)
            if chars is not None:
                old = columns[chars].to_pylist()
                columns[chars] = pa.array([n if a == b else len(b) for a, b, n in zip(texts, new, old, strict=True)], type=arrow.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return small_batches(docs).mapInArrow(run, docs.schema)
