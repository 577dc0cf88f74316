"""Lexing of source and configuration syntax into name-literal pairs.

One pass cuts a text into tokens: strings (single, double, back-quoted, triple),
names, numbers, operators and line ends; comments are left out. A second pass
stops at each assignment operator, reads the target before it (a name with
attributes, a quoted key, subscripts) and the value after it: literals, constants
that were given a literal before, and both joined by ``+``, ``..`` or by standing
side by side; a list, in brackets or as lines that begin with a dash, gives each of its
literals, and several targets take a value each. ``name: type = value`` gives the value to
the name, ``name: |`` the lines of one word that follow further in, and a look-up of a
quoted key its default. Elements ``<name>value</name>`` are pairs too.

A constant holds its parts by reference: joining two costs as much as they have
different characters, however long they are, so that constants made of constants grow no
faster than the text. Both passes look at each token a bounded number of times, and a
text of any length and content is read in time proportional to it.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

_TOKEN = re.compile(
    r'''(?P<triple>"""|\'\'\')
    |(?P<comment>(?:(?<=[\x20\t])|(?<![^\n]))(?:\#|//)[^\n]*)
    |(?P<open>/\*|<!--)
    |(?P<string>(?<!\\)"(?:[^"\\\n]|\\.)*+"|(?<![\\A-Za-z0-9_])[bfru]{0,2}'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*)
    |(?P<number>[0-9][A-Za-z0-9_]*)
    |(?P<op>:=|=>|[=!<>]=|->|\.\.|[-+=:.,;()\[\]{}<>|&*?~])
    |(?P<line>\n)''',
    re.VERBOSE | re.ASCII,
)
_SPACE = re.compile(r"[\x20\t]*")
#: A value without quotes; equal signs end it only as padding.
_BARE = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![=A-Za-z0-9\"']))?")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.ASCII)
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:[\x20\t\n][^<>]*+)?>[\x20\t\n]*+([^<>\n]++)[\x20\t\n]*+</\1[\x20\t\n]*+>", re.ASCII)
_LINE_WORD = re.compile(r"([\x20\t]*+)([A-Za-z0-9+/=_.-]++)[\x20\t\r]*+(?:\n|\Z)")
_INDENT = re.compile(r"[\x20\t]*+")
_ASSIGNING = {"=", ":=", ":", "=>"}
_JOINING = {"+", "..", ".", "&", "~"}
_PREFIXES = {"b", "r", "f", "u", "l", "n", "rb", "br", "fr", "rf"}
_SCHEMES = {"bearer", "basic", "token"}
_QUALIFIERS = {"mut", "static", "const", "dyn", "unsigned", "long"}
_CLOSES = {"/*": "*/", "<!--": "-->"}
#: Look-ups whose second argument is what they give where the key is missing.
_LOOKUPS = {"get", "getenv", "setdefault", "pop", "getstring", "getproperty", "setenv", "putenv", "setproperty"}
#: Targets side by side, longest value that is held as a text, and counts above which all are halved.
_TARGETS, _WHOLE, _MOST = 16, 4_096, 1 << 53


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    #: The content of a string, other tokens as they are.
    text: str
    at: int


class Value:
    """A literal, or several joined: how often each character stands in it, its text where that is short, and its parts."""

    __slots__ = ("counts", "length", "parts", "span", "text")

    def __init__(self, text: str | None, counts: dict[str, int], length: int, span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()):
        self.text, self.counts, self.length, self.span, self.parts = text, counts, length, span, parts

    @classmethod
    def literal(cls, text: str, start: int) -> Value:
        return cls(text, Counter(text), len(text), (start, start + len(text)))

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        counts: dict[str, int] = {}
        for p in parts:
            for c, n in p.counts.items():
                counts[c] = counts.get(c, 0) + n
        length = sum(p.length for p in parts)
        while length > _MOST:
            counts = {c: (n + 1) // 2 for c, n in counts.items()}
            length = sum(counts.values())
        short = length <= _WHOLE and all(p.text is not None for p in parts)
        return cls("".join(p.text for p in parts) if short else None, counts, length, None, tuple(parts))

    def spans(self, seen: set[int] | None = None) -> list[tuple[int, int]]:
        """Where its literals stand, each once; parts in ``seen``, by identity, were told before."""
        seen = set() if seen is None else seen
        out, left = [], [self]
        while left:
            v = left.pop()
            if id(v) not in seen:
                seen.add(id(v))
                if v.span:
                    out.append(v.span)
                left += v.parts
        return out


class Pair(NamedTuple):
    """A name, its value, and whether any of its literals stood in quotes."""

    name: str
    value: Value
    quoted: bool


def tokens(text: str) -> list[Token]:
    out, at, closed = [], 0, {}
    while found := _TOKEN.search(text, at):
        kind, start, at = found.lastgroup, found.start(), found.end()
        if kind in ("triple", "open"):
            mark = found.group()
            close = _CLOSES.get(mark, mark)
            # what is not closed from here on is not closed further on either
            end = -1 if closed.get(mark) == -1 else text.find(close, at)
            closed[mark] = end
            if end >= 0:
                if kind == "triple":
                    out.append(Token("string", start, end + 3, text[at:end], at))
                at = end + len(close)
            continue
        if kind == "string":
            inner = start + 1 + (text.find("'", start) - start if text[start] in "bfru" else 0)
            out.append(Token(kind, start, at, text[inner : at - 1], inner))
        elif kind != "comment":
            out.append(Token(kind, start, at, found.group(), start))
    return out


def _target(toks: list[Token], k: int) -> str:
    """The name that the tokens before the k-th give: a name or quoted key, with the quoted keys of subscripts as further parts."""
    k, keys = k - 1, []
    while k >= 1 and toks[k].text == "]" and toks[k].kind == "op":
        if toks[k - 1].text == "[" and toks[k - 1].kind == "op":
            k -= 2
        elif k >= 2 and toks[k - 2].text == "[" and toks[k - 2].kind == "op" and toks[k - 1].kind in ("string", "name", "number"):
            if toks[k - 1].kind == "string":
                keys.append(toks[k - 1].text)
            k -= 3
        else:
            return ""
    name = toks[k].text if k >= 0 and toks[k].kind in ("name", "string") else ""
    return ".".join(filter(None, [name if "\n" not in name else "", *reversed(keys)]))


def _is_type(toks: list[Token]) -> bool:
    """Whether tokens are one type: names joined by marks, with any arguments in brackets."""
    depth, before = 0, None
    for t in toks:
        if t.kind == "op":
            depth += (t.text in "[(<") - (t.text in "])>")
            if depth < 0 or t.text not in "[](){}<>.,|&*?" or t.text in "{}" or (t.text == "," and not depth):
                return False
        elif t.kind == "line" or (before and before.kind != "op" and before.text not in _QUALIFIERS):
            return False
        before = t
    return bool(toks) and not depth


class _Reader:
    def __init__(self, text: str):
        self.text, self.toks, self.known = text, tokens(text), {}
        self.pairs: list[Pair] = []
        self.types: set[tuple[int, int]] = set()

    def _value(self, k: int) -> tuple[list[Value], bool, int]:
        """The parts that make up the value after the k-th token, whether any is quoted, and the token after it."""
        text, toks, n = self.text, self.toks, len(self.toks)
        parts, quoted, scheme, k, nested = [], False, False, k + 1, False
        while k < n and toks[k].kind == "op" and toks[k].text == "(":
            k, nested = k + 1, True
        while k < n:
            while nested and k < n and toks[k].kind == "line":
                k += 1
            if k == n:
                break
            t = toks[k]
            if t.kind == "string":
                parts.append(Value.literal(t.text, t.at))
                quoted, k = True, k + 1
            elif t.kind == "name" and t.text.lower() in _PREFIXES and k + 1 < n and toks[k + 1].kind == "string" and toks[k + 1].start == t.end:
                k += 1
                continue
            else:
                bare = _BARE.match(text, t.start)
                if not bare or t.kind == "line":
                    break
                word, end = bare.group(), bare.end()
                named = [self.known.get(w) for w in word.split("+")]
                if all(named):
                    parts += named
                elif _IDENTIFIER.match(word) and not any(c.isdigit() for c in word):
                    if word.lower() not in _SCHEMES or scheme or parts:
                        break
                    scheme = True
                elif text[end : end + 1] in ("(", "["):
                    break
                else:
                    parts.append(Value.literal(word, t.start))
                while k < n and toks[k].start < end:
                    k += 1
                if scheme and not parts:
                    continue
            ahead = k
            while nested and ahead < n and toks[ahead].kind == "line":
                ahead += 1
            if ahead < n and toks[ahead].kind == "op" and toks[ahead].text in _JOINING:
                k = ahead + 1
            elif not (quoted and ahead < n and toks[ahead].kind == "string"):
                break
        return parts, quoted, k

    def _listed(self, k: int) -> list[Value]:
        """The literals of a list that opens after the k-th token, each a value of its own."""
        out, k = [], k + 2
        while k < len(self.toks) and (self.toks[k].kind in ("string", "line") or self.toks[k].text == ","):
            t = self.toks[k]
            if t.kind == "string":
                out.append(Value.literal(t.text, t.at))
            k += 1
        return out

    def _dashed(self, k: int) -> list[tuple[list[Value], bool]]:
        """The values of the lines after the k-th token that begin with a dash, until one does not."""
        out, toks = [], self.toks
        k += 1
        while k < len(toks) and toks[k].kind == "line":
            while k < len(toks) and toks[k].kind == "line":
                k += 1
            if k == len(toks) or toks[k].text != "-" or toks[k].kind != "op" or self.text[toks[k].end : toks[k].end + 1] not in (" ", "\t"):
                break
            parts, quoted, k = self._value(k)
            if k < len(toks) and toks[k].kind != "line":
                break
            out.append((parts, quoted))
        return out

    def _block(self, k: int) -> Value | None:
        """The lines of one word each, further in than that of the k-th token, after a bar."""
        toks, text = self.toks, self.text
        if k + 1 >= len(toks) or toks[k + 1].text not in ("|", ">") or toks[k + 1].kind != "op":
            return None
        at = text.find("\n", toks[k + 1].end)
        if at < 0 or text[toks[k + 1].end : at].strip(" \t\r+-"):
            return None
        outer = _INDENT.match(text, text.rfind("\n", 0, toks[k].start) + 1)
        parts, at = [], at + 1
        while (m := _LINE_WORD.match(text, at)) and m.end() > at and len(m.group(1)) > outer.end() - outer.start():
            parts.append(Value.literal(m.group(2), m.start(2)))
            at = m.end()
        return Value.joined(parts) if parts else None

    def _targets(self, k: int) -> list[str]:
        """The names side by side before the k-th token, where there are several."""
        toks, out = self.toks, []
        while len(out) < _TARGETS and k >= 1 and toks[k - 1].kind == "name":
            out.append(toks[k - 1].text)
            if k < 2 or toks[k - 2].text != "," or toks[k - 2].kind != "op":
                return out[::-1] if len(out) > 1 and (k < 2 or toks[k - 2].kind == "line" or toks[k - 2].text in ";(") else []
            k -= 2
        return []

    def _default(self, k: int) -> None:
        """The k-th token opens a call: the default of a look-up goes to its key, and to what the look-up is assigned to."""
        toks = self.toks
        if k < 1 or k + 3 >= len(toks) or toks[k - 1].kind != "name" or toks[k - 1].text.replace("_", "").rpartition(".")[2].lower() not in _LOOKUPS:
            return
        if toks[k + 1].kind == toks[k + 3].kind == "string" and toks[k + 2].text == ",":
            value = Value.literal(toks[k + 3].text, toks[k + 3].at)
            self._give(toks[k + 1].text, [value], True)
            if k >= 2 and toks[k - 2].kind == "op" and toks[k - 2].text in _ASSIGNING:
                self._give(_target(toks, k - 2), [value], True)

    def _give(self, name: str, parts: list[Value], quoted: bool) -> bool:
        if not name or not parts:
            return False
        self.known[name] = value = Value.joined(parts)
        self.pairs.append(Pair(name, value, quoted))
        return True

    def read(self) -> None:
        toks, colon = self.toks, None
        for k, t in enumerate(toks):
            if t.kind == "line" or (t.kind == "op" and t.text in ";{}"):
                colon = None
            if t.kind == "op" and t.text == "(":
                self._default(k)
            if t.kind != "op" or t.text not in _ASSIGNING:
                continue
            name, (parts, quoted, end) = _target(toks, k), self._value(k)
            if t.text == "=" and (names := self._targets(k)):
                values = [(parts, quoted)]
                while len(values) < len(names) and end < len(toks) and toks[end].text == "," and toks[end].kind == "op":
                    *value, end = self._value(end)
                    values.append(value)
                if len(values) == len(names):
                    for n, v in zip(names, values, strict=True):
                        self._give(n, *v)
                    continue
            if t.text == "=" and colon and _is_type(toks[colon[1] + 1 : k]):
                if colon[2]:
                    self.pairs.pop(colon[2] - 1)
                self.types.update((x.start, x.end) for x in toks[colon[1] + 1 : k])
                self._give(colon[0], parts, quoted)
            given = self._give(name, parts, quoted)
            if not given and name and k + 1 < len(toks) and toks[k + 1].text == "[":
                for one in self._listed(k):
                    self._give(name, [one], True)
            elif not given and name and t.text == ":":
                if block := self._block(k):
                    self._give(name, [block], True)
                for some, quotes in self._dashed(k) if k + 1 < len(toks) and toks[k + 1].kind == "line" else ():
                    self._give(name, some, quotes)
            colon = (name, k, len(self.pairs) if given else 0) if t.text == ":" and name else None
        if "</" in self.text:
            for m in _ELEMENT.finditer(self.text):
                if value := m.group(2).rstrip(" \t\r\x0b\x0c"):
                    self._give(m.group(1), [Value.literal(value, m.start(2))], True)


def read(text: str) -> tuple[list[Pair], set[tuple[int, int]]]:
    """The pairs of a text, in order, and the spans of words that stand where a type stands."""
    if "=" not in text and ":" not in text and "</" not in text:
        return [], set()
    reader = _Reader(text)
    reader.read()
    return reader.pairs, reader.types
