"""Secret scans by lexing assignments in source and configuration text.

Around every ``=`` and ``:`` the text is read as an assignment: a name on the left, and on the
right terms joined by ``+``, each a quoted or bare literal or the name of an earlier constant.
Constants are propagated in the order of the text, with all their terms: a constant refers to the
constants that it is made of, so that one that is doubled again and again stays small.  A literal is reported when the name that
receives it is sensitive and the literal looks like a secret rather than a placeholder.
Three fixed patterns are always reported as well.

Spans count code points, ends exclusive.  Defined cases: a null or empty text has no spans; of a
repeated assignment each is reported; a name assigned twice has the later value from there on.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.tables import by_block, columns
from psephos.llm.text import LOWER, Texts

# The patterns that are always reported, in their order, and their least lengths.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_GATES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# The name, and perhaps its type, in the reversed text: read from the operator back, it takes time only for what it finds.
_NAME = re.compile(rb"""\n?(?:[\x20\t]*[A-Za-z0-9_<>\[\]]*[A-Za-z_][\x20\t]*:)?[\x20\t]*["'`]?(?:\]["']?)?([A-Za-z0-9_$.\-]*[A-Za-z_$])""")
_TERM = re.compile(
    rb"""[\x20\t]*(?:
        [rbuf]{0,2}"((?:[^"\\\n]|\\.)*)"
      | [rbuf]{0,2}'((?:[^'\\\n]|\\.)*)'
      | `([^`\n]*)`
      | ([A-Za-z0-9+/_.=~$%&*@^!-]+)
    )""",
    re.VERBOSE,
)
_OPERATOR = re.compile(rb"(?<![=!<>:+\-*/|&])(?::=|=>|=|:)(?![=:/])")
_PLUS = re.compile(rb"[\x20\t]*\+[\x20\t]*(?=[\"'`A-Za-z_])")
_TYPED = re.compile(rb"[\x20\t]*=[^=]")
_IDENTIFIER = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$.]*\Z")

# How much a part of a name says that its value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5,
    "api": 0.4, "signing": 0.5, "encryption": 0.5, "client": 0.2, "session": 0.4, "cookie": 0.4, "salt": 0.6,
    "oauth": 0.6, "jwt": 0.8, "pin": 0.4, "kennwort": 1.0, "passwort": 1.0, "contrasena": 1.0,
}
# Parts of a name that say the value is about a secret, not one.
HARMLESS = {"length", "len", "count", "min", "max", "name", "file", "path", "url", "type", "field", "label", "hint", "regex", "policy", "id"}
PLACEHOLDERS = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|todo|changeme|change[_-]?me|example|sample|dummy|test|your[_-]?.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|password|secret|token)$"
)
SURE = 1.0


def name_score(name: str) -> float:
    """How sensitive the parts of a name are, in snake, kebab, dotted or camel case."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name.rsplit(".", 1)[-1] if "." in name else name)
    lower = [part.lower() for part in parts]
    score = sum(SENSITIVE.get(part, 0.0) for part in lower)
    if "".join(lower) in SENSITIVE:
        score = max(score, SENSITIVE["".join(lower)])
    return score - 0.7 * sum(part in HARMLESS for part in lower)


_ENDS = 16  # characters kept of either end of a value: more than any fixed placeholder has


class Value:
    """What the score needs of a value that may be too long to write out: how often it has each character
    (in units of 2**shift, exact up to 256 bits of length), and its two ends."""

    def __init__(self, counts: Counter[str], shift: int, head: str, tail: str) -> None:
        self.counts, self.shift, self.head, self.tail = counts, shift, head, tail

    @classmethod
    def of(cls, value: str) -> Value:
        return cls(Counter(value), 0, value[:_ENDS], value[-_ENDS:])

    @classmethod
    def joined(cls, parts: Iterable[Value]) -> Value:
        parts = list(parts)
        shift, counts, head, tail = max(part.shift for part in parts), Counter(), "", ""
        for part in parts:
            for character, n in part.counts.items():
                counts[character] += n >> (shift - part.shift)
            head, tail = (head + part.head)[:_ENDS], (tail + part.tail)[-_ENDS:]
        if (bits := counts.total().bit_length()) > 256:
            counts = Counter({character: n >> (bits - 128) for character, n in counts.items()})
            shift += bits - 128
        return cls(counts, shift, head, tail)

    def placeholder(self) -> bool:
        """Long values are one by their ends and by the characters between."""
        whole = self.head if self.counts.total() <= _ENDS and not self.shift else self.head + "".join(self.counts) + self.tail
        return bool(PLACEHOLDERS.match(whole))

    def score(self) -> float:
        """How much it looks like a secret: its length and the entropy of its characters."""
        length = self.counts.total()
        if length < 8 and not self.shift or self.placeholder() or any(c.isspace() for c in self.counts):
            return -1.0
        entropy = -sum(n / length * log2(n / length) for n in self.counts.values() if n)
        characters = "".join(self.counts)
        kinds = sum(bool(re.search(p, characters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return 0.15 * min(entropy, 4.0) + 0.1 * kinds - 0.2


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: its length and the entropy of its characters."""
    return Value.of(value).score()


class Term:
    """A literal with its span, or a constant with the terms that it is made of."""

    def __init__(self, span: tuple[int, int] | None, parts: list[Term]) -> None:
        self.span, self.parts = span, parts
        self.value: Value | None = None
        self.reported = False

    def valued(self, text: bytes) -> Value:
        """Its value; each term below is worked out once."""
        waiting = [self]
        while waiting:
            term = waiting[-1]
            todo = [part for part in term.parts if part.value is None]
            if term.value is None and not todo:
                own = term.span and Value.of(text[term.span[0] : term.span[1]].decode(errors="replace"))
                term.value = own or Value.joined(part.value for part in term.parts)
            if term.value is None:
                waiting += todo
            else:
                waiting.pop()
        return self.value

    def unreported(self) -> Iterator[tuple[int, int]]:
        """The spans of the literals below that no call gave before."""
        waiting = [self]
        while waiting:
            term = waiting.pop()
            if term.reported:
                continue
            term.reported = True
            waiting += term.parts
            if term.span and term.span[1] > term.span[0]:
                yield term.span


def lexed(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the literals that are given to sensitive names."""
    constants: dict[bytes, Term] = {}
    found: list[tuple[int, int]] = []
    done = 0
    backwards = text[::-1]
    for operator in _OPERATOR.finditer(text):
        if operator.start() < done:
            continue  # inside the value of the assignment before
        name = _NAME.match(backwards, len(text) - operator.start(), len(text) - done)
        if not name:
            continue
        terms: list[Term] = []
        at = operator.end()
        while term := _TERM.match(text, at):
            group = next(i for i in (1, 2, 3, 4) if term.group(i) is not None)
            value = term.group(group)
            constant = constants.get(value) if group == 4 and _IDENTIFIER.match(value) else None
            terms.append(constant or Term(term.span(group), []))
            at = term.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if not terms or operator.group() == b":" and _TYPED.match(text, at):
            continue  # nothing is assigned, or what follows the colon is a type
        done = at
        target = name.group(1)[::-1]
        whole = constants[target] = terms[0] if len(terms) == 1 else Term(None, terms)
        sensitive = name_score(target.decode())
        if sensitive <= 0:
            continue
        if sensitive + whole.valued(text).score() >= SURE:
            found += whole.unreported()
    return sorted(set(found))


def base_spans(text: bytes, lower: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns; ``runs`` are the long runs of hex digits."""
    found = [(s, KINDS.index("hex"), e) for s, e in runs]
    if any(gate in lower for gate in _GATES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, base_spans, spans.

    Spans are written as kind:start:end, by start and then by kind, joined by commas.
    """
    schema = pa.schema([
        ("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base_sha256", pa.string()), ("base_spans", pa.string()), ("spans", pa.string()),
    ])

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(block.column("text"))
        starts, ends = texts.runs(_HEX[texts.data])
        long = ends - starts >= LEAST["hex"]
        starts, ends = starts[long], ends[long]
        owner = np.searchsorted(texts.offsets, starts, side="right") - 1
        runs: dict[int, list[tuple[int, int]]] = {}
        for i, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
            base = int(texts.offsets[i])
            runs.setdefault(i, []).append((s - base, e - base))
        operators = texts.per_text((texts.data == 0x3D) | (texts.data == 0x3A))
        counts, digests, fixed, spans = np.zeros((len(texts), 3), np.int64), [], [], []
        nothing = hashlib.sha256(b"").hexdigest()
        for i in range(len(texts)):
            low, high = texts.offsets[i], texts.offsets[i + 1]
            value = texts.bytes_of(i)
            found = base_spans(value, LOWER[texts.data[low:high]].tobytes(), runs.get(i, []))
            more = [(s, 3, e) for s, e in lexed(value)] if operators[i] else []
            if not found and not more:
                digests.append(nothing)
                fixed.append("")
                spans.append("")
                continue
            points = np.zeros(len(value) + 1, np.int64)
            np.cumsum((texts.data[low:high] & 0xC0) != 0x80, out=points[1:])

            def written(these: list[tuple[int, int, int]], points: np.ndarray = points) -> str:
                return ",".join(f"{KINDS[k]}:{points[s]}:{points[e]}" for s, k, e in sorted(these))

            for _, kind, _ in found:
                counts[i, kind] += 1
            fixed.append(written(found))
            digests.append(hashlib.sha256(fixed[-1].encode()).hexdigest())
            spans.append(written(found + more))
        return columns(
            schema, id=block.column("id"), n_assign=counts[:, 0], n_access=counts[:, 1], n_hex=counts[:, 2],
            base_sha256=digests, base_spans=fixed, spans=spans,
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return by_block(
        rows, "text",
        "id long, n_assign long, n_access long, n_hex long, base_sha256 string, base_spans string, spans string", work,
    )
