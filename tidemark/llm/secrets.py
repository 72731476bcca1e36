"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into name-literal pairs: ``name = "x"``, ``name: x``, ``"name": "x"``,
``name => 'x'``, ``<name>x</name>`` and flags such as ``--name x``; subscripts, ``config["name"] = "x"``, and calls, ``define("name", "x")``;
values in triple quotes, quoted on the next line, as a YAML block or behind the scheme of a header, ``Authorization: Bearer x``.
A type may stand between name and value, as in
``name: type = "x"``, and in chains such as ``a = b = "x"`` all names get the literal. Passwords of login URLs and the bodies of
private keys in PEM form are literals without a name. Constants are propagated within the text: a name
that stands for an earlier literal, and literals or names added with ``+``, give the later name their value, so
``k = "ab12..."; password = k`` points at the literal of ``k``. Each literal is scored by how sensitive the names are
that it reaches, by its length, mix of characters and entropy, and against placeholders; from ``THRESHOLD`` on it is a
finding of kind ``literal``.

Three plain patterns hold besides, whatever the scores: ``assign``, ``access`` and ``hex``.

Texts are scanned whole, row by row where they are read: no shuffle. Nulls and ties: null counts as empty; each row is
judged alone, so repeated rows give equal findings. Lexing takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import arrow_map, batch, texts_of

THRESHOLD = 0.6
KINDS = ("assign", "access", "hex", "literal")

# Fixed patterns of the plain kinds; letters of the assign keys in either case, ASCII only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Sensitive parts of names and their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "privatekey": 1.0, "accesskey": 1.0,
    "secretkey": 1.0, "authorization": 0.9, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "key": 0.5, "dsn": 0.5, "cert": 0.4,
}
#: What any sensitive part promises, whatever its weight; the weight makes up the rest.
LEAST = 0.5
HARMLESS = {"public", "name", "id", "path", "file", "url", "type", "length", "size", "count", "field", "label", "hint", "policy"}
PLACEHOLDER = re.compile(r"(?ai)^(?:x+|\*+|\.+|-+|_+|change_?me|your[-_ ].*|example.*|test|none|null|nil|true|false|todo|dummy|sample|redacted|password|secret|token)$|^[$%]?\{|^\$\(|^<.*>$|^\$\w+$")

_NAME = r"[A-Za-z_][A-Za-z0-9_-]*+(?:[.][A-Za-z_][A-Za-z0-9_-]*+)*+"
_TRIPLE = r'''"""(?:[^"\\]|\\.|"(?!""))*+"""''' + "|" + r"'''(?:[^'\\]|\\.|'(?!''))*+'''"
_QUOTED = rf"{_TRIPLE}|" + r'"(?:[^"\\\n]|\\.)*+"|' + r"'(?:[^'\\\n]|\\.)*+'|" + r"`[^`\n]*+`"
_BARE = r"[A-Za-z0-9+/_.=~@!$%^*-]++"
# A type as Python, TypeScript, Rust, Kotlin or Swift write it: a dotted name or one in brackets, with parameters, in unions.
_BRACKETS = r"\[[^=\n]{0,80}\]|<[^=\n]{0,80}>"
_ONE_TYPE = rf"(?:&(?:'[a-z_]++\x20)?(?:mut\x20)?)?(?:[A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*+)*+(?:{_BRACKETS})?(?:\[\])?|\[[^=\n]{{0,80}}\])[?!]?"
_TYPE = rf"{_ONE_TYPE}(?:[\x20\t]*+[|&][\x20\t]*+{_ONE_TYPE}){{0,8}}"
# Between sign and value: a line break before a quote, the mark of a YAML block, or the scheme of a header.
_GAP = r"""[\x20\t]*+(?:\r?\n[\x20\t]*+(?=["'`])|[|>][+-]?[\x20\t]*+\r?\n[\x20\t]++(?=\S)|(?:[Bb]earer|[Bb]asic|[Tt]oken)\x20++(?=[A-Za-z0-9+/_]))?"""
#: A name in any syntax with what stands behind its sign; one alternative for each syntax.
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.-])(?P<name>{_NAME})["']?\]?[?!]?[\x20\t]*+(?::[\x20\t]*+(?P<type>{_TYPE})[\x20\t]*+=(?![=>])|(?P<sign>:=|=>|==?|:)){_GAP}(?P<value>{_QUOTED}|{_BARE})"""
    rf"""|(?<![A-Za-z0-9_-])--(?P<flag>{_NAME})[\x20=](?P<given>{_QUOTED}|{_BARE})"""
    rf"""|\([\x20\t]*+["'](?P<arg>{_NAME})["'][\x20\t]*+,[\x20\t]*+(?P<second>{_QUOTED})"""
    rf"""|<(?P<tag>{_NAME})>(?P<inner>[^<>\n]++)</(?P=tag)>"""
)
#: A bare value that is itself a name with a sign: a name only; or a name or literal before a colon; or part of the value.
_CHAIN = re.compile(
    rf"""{_NAME}(?:(?P<only>[\x20\t]*+(?::=|=>)|[\x20\t]++==?|=(?=[\x20\t]*+["'`]))|(?P<colon>[\x20\t]*+:(?=[\x20\t"'`])))"""
)
_INSIDE = re.compile(rf"(?:{_NAME}=(?=[^=\s]))++")
_NAME_OF = re.compile(_NAME)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,30}+://")
_LOGIN_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{0,30}+://[^\s"'`<>@/]{1,200}+@[^\s"'`<>]++""")
#: Literals without a name: the password in a login URL, the body of a private key.
_LOGIN_PASSWORD = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}+://[^\s:/@"'`<>]{0,100}+:([^\s/@"'`<>]{6,200}+)@""")
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----((?:[A-Za-z0-9+/=\s:,.\\]|-(?!-))*+)-----END")
_MORE = re.compile(rf"[\x20\t]*+\+[\x20\t]*+({_QUOTED}|{_NAME})")
_WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int
    score: float = 1.0
    name: str = ""


def sensitivity(name: str) -> float:
    """How much a name promises a secret, 0 to 1: 0 without a sensitive part, else from ``LEAST`` on, so that a strong literal
    is a finding under each of them."""
    parts = [part.lower() for part in _WORD_PARTS.findall(name.rpartition(".")[2] or name)]
    if not parts:
        return 0.0
    joined = [a + b for a, b in zip(parts, parts[1:])]
    # a public key is none of the keys meant
    own = [part for before, part in zip(["", *parts], parts) if (before, part) != ("public", "key")]
    weight = max((SENSITIVE.get(part, 0.0) for part in own + joined), default=0.0)
    if not weight:
        return 0.0
    return (LEAST + (1 - LEAST) * weight) * (0.4 if parts[-1] in HARMLESS else 1.0)


def strength(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length, kinds of characters, entropy."""
    if len(literal) < 6 or PLACEHOLDER.search(literal) or len(set(literal)) < 4:
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(any(map(test, literal)) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    if " " in literal or (literal.isalpha() and (literal.islower() or literal.istitle())):
        kinds = 0  # prose, a plain word
    return min(1.0, 0.3 * min(1.0, len(literal) / 16) + 0.35 * min(1.0, entropy / 3.5) + 0.35 * min(1.0, kinds / 2))


@dataclass(frozen=True)
class _Pair:
    """A name with its operands (start, end, quoted), several where ``+`` adds them or the name stands before another one.
    ``is_type``: the name stands where a type could; ``declares``: the value could be a type."""

    name: str
    operands: list[tuple[int, int, bool]]
    is_type: bool = False
    declares: bool = False


def _quotes(text: str, start: int, end: int) -> int:
    """Characters of the quotes on either side of a value."""
    if end - start >= 6 and text[start : start + 3] in ('"""', "'''"):
        return 3
    return int(end - start >= 2 and text[start] in "\"'`" and text[end - 1] == text[start])


def _pairs(text: str) -> Iterator[_Pair]:
    """Pairs in the text's order; names of a chain from the last, which has the literal, to the first."""
    chain: list[_Pair] = []
    at = type_at = 0
    while m := PAIR.search(text, at):
        group = next(g for g in ("value", "given", "second", "inner") if m[g] is not None)
        name, is_type = m["name"] or m["flag"] or m["arg"] or m["tag"], 0 < m.start() == type_at
        (start, end), operands = m.span(group), []
        bare = group != "inner" and text[start] not in "\"'`"
        at = end
        if m["type"] is not None:  # what looks like a type may be a name
            at = type_at = m.start("type")
            if bare and (sign := _CHAIN.match(text, start)) and sign["only"]:
                chain.append(_Pair(name, [(start, _NAME_OF.match(text, start).end(), False)]))
                continue
        elif bare and (url := _LOGIN_URL.match(text, start)):
            at = max(end, _SCHEME.match(text, start).end())
            end = url.end()
        elif bare and (sign := _CHAIN.match(text, start)) and PAIR.match(text, start):
            at = start
            operands = [(start, end, False)] if sign["colon"] else []
            chain.append(_Pair(name, [*operands, (start, _NAME_OF.match(text, start).end(), False)], is_type))
            continue
        elif bare and (inside := _INSIDE.match(text, start, end)):  # the names in front share what follows them
            rest = (inside.end(), end, False)
            if (sign := _CHAIN.match(text, inside.end())) and sign["only"]:
                at, rest = inside.end(), (inside.end(), _NAME_OF.match(text, inside.end()).end(), False)
            chain += [_Pair(inner[0], [rest]) for inner in _NAME_OF.finditer(text, *inside.span())]
            if at < end:
                chain.append(_Pair(name, [rest], is_type))
                continue
        while True:
            quotes = _quotes(text, start, end)
            operands.append((start + quotes, end - quotes, quotes > 0 or group == "inner"))
            if not (more := _MORE.match(text, end)):
                break
            start, end = more.span(1)
            at = at if m["type"] is not None else max(at, end)
        yield _Pair(name, operands, is_type, m["sign"] == ":")
        yield from reversed(chain)
        chain.clear()
    yield from reversed(chain)


def literal_findings(text: str, threshold: float = THRESHOLD) -> list[Finding]:
    """Scored literals; a literal counts for the most sensitive of the names it reaches."""
    if not any(sign in text for sign in (":", "=", "--", "</", '",', "',")):
        return []
    latest: dict[str, int] = {}
    weights: list[tuple[float, str]] = []
    operands: list[list[int | tuple[int, int]]] = []
    types: set[str] = set()
    for pair in _pairs(text):
        # "name: type" without a value is no reference to what another name of that type got
        known = [None if quoted or pair.declares and text[start:end] in types else latest.get(text[start:end]) for start, end, quoted in pair.operands]
        operands.append([(start, end) if k is None else k for k, (start, end, _) in zip(known, pair.operands)])
        if pair.is_type:
            types.add(pair.name)
        else:
            types.discard(pair.name)
        latest[pair.name] = len(weights)
        weights.append((sensitivity(pair.name), pair.name))
    # names refer to earlier ones only: from the last to the first, each passes its weight on
    reached: dict[tuple[int, int], tuple[float, str]] = {}
    for weight, its in zip(reversed(weights), reversed(operands)):
        for operand in its:
            if isinstance(operand, int):
                weights[operand] = max(weights[operand], weight)
            else:
                reached[operand] = max(reached.get(operand, weight), weight)
    for pattern, name, weight in ((_LOGIN_PASSWORD, "login", 1.0), (_PRIVATE_KEY, "private key", 1.0)):
        for m in pattern.finditer(text):
            reached[m.span(1)] = max(reached.get(m.span(1), (weight, name)), (weight, name))
    found = []
    for (start, end), (weight, name) in reached.items():
        score = round(weight * strength(text[start:end]), 6)
        if score >= threshold:
            found.append(Finding("literal", start, end, score, name))
    return found


def base_findings(text: str) -> list[Finding]:
    """The plain kinds, each leftmost and without overlaps of its own kind."""
    found = [Finding("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [Finding("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [Finding("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def findings(text: str, threshold: float = THRESHOLD) -> list[Finding]:
    """All findings by start, then kind."""
    return sorted(base_findings(text) + literal_findings(text, threshold), key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def written(found: list[Finding]) -> str:
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in found)


def redacted(text: str, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> str:
    """The text with every found stretch replaced by ``mark``; overlapping stretches become one."""
    spans: list[list[int]] = []
    for f in findings(text, threshold):
        if spans and f.start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], f.end)
        else:
            spans.append([f.start, f.end])
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())])
SCAN_SCHEMA = "doc_id long, findings array<struct<kind: string, start: long, end: long, score: double, name: string>>"


def _scan_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [[vars(f) for f in findings(text, threshold)] for text in texts_of(rows.column(1))]
            yield batch(("doc_id", "findings"), (pa.int64(), pa.list_(SPAN)), (rows.column(0), found))

    return run


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, findings): kind, start, end (code points, end exclusive), score and name of each finding, by start."""
    wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return arrow_map(wanted, _scan_batches(threshold), SCAN_SCHEMA)


def _digest_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for rows in batches:
            counts, sums, spans = [], [], []
            for text in texts_of(rows.column(1)):
                found = findings(text, threshold)
                base = [f for f in found if f.kind != "literal"]
                kinds = Counter(f.kind for f in base)
                counts.append([kinds[k] for k in KINDS[:3]])
                sums.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
            yield batch(names, types, (rows.column(0), *(zip(*counts) if counts else ([], [], [])), sums, spans))

    return run


def scan_digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): the findings of :func:`findings` in short."""
    wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return arrow_map(wanted, _digest_batches(threshold), schema)


def _redact_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = rows.schema.get_field_index("text")
            old = rows.column(at).to_pylist()
            new = [None if text is None else redacted(text, threshold) for text in old]
            rows = rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type))
            if (size := rows.schema.get_field_index("n_chars")) >= 0:
                sizes = [n if a == b else len(b) for n, a, b in zip(rows.column(size).to_pylist(), old, new)]
                rows = rows.set_column(size, rows.schema.field(size), pa.array(sizes, rows.schema.field(size).type))
            yield rows

    return run


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark, n_chars of changed texts following; all other columns
    and rows stay."""
    return arrow_map(docs, _redact_batches(threshold), docs.schema)
