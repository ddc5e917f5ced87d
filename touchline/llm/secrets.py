"""Secret scans: fixed patterns first, then literals that source or configuration text assigns to sensitive names.

Base spans (assign, access key, long hex) come from fixed patterns over the whole text. The lexer then reads every
assignment of a text: ``name = value``, ``name := value``, ``name: value``, ``name => value``, with quoted names, types,
dotted and indexed targets, and strings that are joined, wrapped in a call, or bare; ``name``/``value`` attribute pairs,
``put("name", "value")`` calls, ``--name value`` flags and ``<name>value</name>`` elements. Each gives a target name,
literals and names it refers to. Sensitivity flows from targets back to the names they are made of, so a constant that
ends in a password is scored as one. A literal's score is the sensitivity of the most sensitive name it reaches times
how much it looks like a secret. Literals with a score of at least LEAST are added as spans of kind ``assign`` unless
a base span holds them already.

Text between assignments cannot form a pair and is passed over; nothing is cut off. Work is linear in the text.

Edge cases: a null text is empty and has no span; other columns are ignored (``redacted`` keeps them); repeated rows are
treated alike; a text without assignments has base spans only.
"""
from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import pieces_of

KINDS = ["assign", "access", "hex"]
LEAST = 0.5
SHORTEST = 6
COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"

Span = tuple[int, int, int]  # start, end, kind number

# The patterns of the three kinds. An assign match is found from its operator: the name ends before it, the
# value begins behind it.
_OPERATOR = re.compile(r"[:=]")
_BEFORE = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.ASCII | re.IGNORECASE)
_BEHIND = re.compile(r"[:=]\x20*(?:[\"'](?=[A-Za-z0-9+/_.=-]))?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Parts of names, how sensitive they make a name, and parts that say the value is something else.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.9, "passcode": 0.9, "pw": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.9,
             "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "creds": 0.9, "cred": 0.8, "auth": 0.7, "authorization": 0.8, "bearer": 0.9, "jwt": 0.9,
             "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "salt": 0.6, "pin": 0.6, "passkey": 0.9, "pat": 0.6, "dsn": 0.6, "key": 0.5}
QUALIFIES_KEY = {"api", "access", "private", "secret", "signing", "sign", "encryption", "master", "shared", "client", "account", "storage", "service", "auth", "session", "app", "license", "hmac", "aes", "rsa", "ssh", "deploy"}
BENIGN = {"public", "pub", "id", "url", "uri", "path", "file", "filename", "dir", "folder", "length", "len", "count", "size", "type", "field", "label", "hint", "policy", "regex", "pattern", "min", "max",
          "expiry", "expires", "ttl", "timeout", "limit", "version", "prompt", "error", "message", "msg", "title", "header", "column", "index", "name", "username", "hash", "algorithm", "format", "endpoint", "host", "enabled", "required"}
PLACEHOLDERS = re.compile(r"(?i:x{3,}|\*{3,}|\.{3,}|change_?me|replace_?me|your[_ -].*|my[_ -]?(?:password|secret|token)|example.*|placeholder|dummy|default|none|null|nil|true|false|undefined|todo|redacted|password|passwd|secret|token)|\$\{.*|\$\(.*|<.*>|\{\{.*|%\(.*|%[A-Z_]+%|\[.*\]")
ENVIRONMENT = {"getenv", "env", "environ", "get", "config", "lookup", "read", "input", "prompt", "getpass", "fetch", "getproperty"}

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = r"[A-Za-z_$@][A-Za-z0-9_$-]*"
_TYPED = re.compile(rf"(?P<name>{_NAME})\s{{0,4}}:\s{{0,4}}[A-Za-z_][\w.<>\[\]|?, &*]{{0,64}}\s{{0,4}}\Z")  # a name and its type
_IN_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$-")
_ATTRIBUTE = re.compile(r"[A-Za-z_]+(?:(?:\.|->|::)[A-Za-z_]+)+")
KEYS, VALUES = {"name", "key", "id", "property"}, {"value", "val", "content", "default"}
_QUOTED = r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"
_STRING = re.compile(rf"(?:[rRbBfFuUL@$]{{0,2}})(?P<body>{_QUOTED})", re.DOTALL)
_CALL = re.compile(rf"(?P<call>(?:new\s+)?{_NAME}(?:(?:\.|::|->){_NAME})*+)\s{{0,4}}\(\s{{0,16}}")
_REFER = re.compile(rf"(?:{_NAME}(?:\.|::|->|\[[\"']))*(?P<name>{_NAME})(?:[\"']\])?(?![\w$(@:/=!%+-])")
_BARE = re.compile(r"[^\s\"'`<>,;(){}\[\]]+")
_JOIN = re.compile(r"\s{0,64}(?:\+|\.\.?|\|\||&)\s{0,64}|[ \t]{0,32}\\?\n?[ \t]{0,64}(?=[\"'])")
_COMMA = re.compile(r"\s{0,64},\s{0,64}")
_GAP = re.compile(r"[ \t]{0,64}(?:[|>&][-+]?[ \t]{0,8}\n[ \t]{0,64})?")
_PUT = re.compile(rf"\(\s{{0,16}}(?P<key>\"[^\"\n]{{1,64}}\"|'[^'\n]{{1,64}}')\s{{0,16}},\s{{0,16}}(?P<value>{_QUOTED})", re.DOTALL)
_FLAG = re.compile(r"(?<![\w-])--?(?P<key>[A-Za-z][A-Za-z0-9_-]{1,40})[ \t]+(?P<value>[\"'][^\"'\n]+[\"']|[^\s\"'`<>,;(){}\[\]-][^\s\"'`<>,;(){}\[\]]*)")
_ELEMENT = re.compile(r"<(?P<key>[A-Za-z_][\w.:-]{0,63})>(?P<value>[^<>\n]{1,4096})</(?P=key)>")


def assigned(text: str) -> Iterator[Span]:
    """Leftmost matches of the assign pattern: a name's operator is the first character behind it that is no quote or space."""
    done = 0
    for op in _OPERATOR.finditer(text):
        end = at = op.start()
        while end > done and text[end - 1] == " ":
            end -= 1
        for stop in ((end - 1, end) if end > done and text[end - 1] in "\"'" else (end,)):
            name = _BEFORE.search(text, max(done, stop - 8), stop)
            if name:
                break
        if not name:
            continue
        value = _BEHIND.match(text, at)
        if value:
            done = value.end()
            if len(value[1]) >= 6:
                yield name.start(), value.end(), 0


def base_spans(text: str) -> list[Span]:
    """All pattern spans by start, then kind."""
    out = list(assigned(text))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


@lru_cache(maxsize=1 << 16)
def sensitivity(name: str) -> float:
    """How likely a value of this name is a secret, from the parts of the name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in (*parts, *(a + b for a, b in zip(parts, parts[1:])))), default=0.0)
    if "key" in parts and QUALIFIES_KEY & {*parts}:
        best = max(best, 0.95)
    return best * (0.3 if parts and (parts[-1] in BENIGN or parts[0] in ("public", "pub", "is", "has", "no")) else 1.0)


def looks_secret(value: str, quoted: bool, tight: bool) -> float:
    """From 0 to 1: length, kinds of characters and variety; a bare word of letters only counts in a tight assignment."""
    words = value.split()
    if len(value) < SHORTEST or len(set(value)) < 4 or len(words) > 5 or PLACEHOLDERS.fullmatch(value):
        return 0.0
    if len(words) > 1 and any(sensitivity(w) for w in words) or not quoted and _ATTRIBUTE.fullmatch(value):
        return 0.0  # a label, an attribute
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    mixed = kinds >= 2 and bool(re.search("[0-9]", value)) or kinds >= 3 and (quoted or tight)
    score = (0.6 if quoted or tight else 0.3) + (0.35 if mixed else 0.0)
    bits = len(value) * math.log2(len(set(value)))
    return min(1.0, score + (0.15 if bits >= 48 else 0.0)) * (0.3 if "://" in value and "@" not in value else 1.0)


class Lexed:
    """Assignments of a text: names to the literals and names they are made of."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.literals: dict[tuple[int, int], bool] = {}            # span -> quoted
        self.held: dict[tuple[int, int], set[str]] = defaultdict(set)  # span -> names it is assigned to
        self.tight: set[tuple[int, int]] = set()
        self.whole: dict[tuple[int, int], str] = {}                # what the parts of a joined string give together
        self.sources: dict[str, set[str]] = defaultdict(set)       # name -> names it is made of
        pairs = list(self.targets())
        self.defined = {name for name, *_ in pairs}
        if any(n.lower() in KEYS or sensitivity(n) for n in self.defined):  # else no value reaches a sensitive name
            key = None  # the string given to ``name`` or ``key`` just before
            for name, behind, tight in pairs:
                spans, names = self.expression(_GAP.match(text, behind).end(), tight)
                low = name.lower()
                if low in VALUES and key:
                    name, key = key, None
                elif low in KEYS and len(spans) == 1:
                    key = text[slice(*spans[0])]
                    continue
                self.put(name, spans, names, tight)
        if "(" in text:
            for m in _PUT.finditer(text):
                self.literals.setdefault((m.start("value") + 1, m.end("value") - 1), True)
                self.put(m["key"][1:-1], [(m.start("value") + 1, m.end("value") - 1)], [], False)
        if "--" in text or " -" in text:
            for m in _FLAG.finditer(text):
                quoted = m["value"][0] in "\"'"
                span = (m.start("value") + quoted, m.end("value") - quoted)
                self.literals.setdefault(span, quoted)
                self.put(m["key"], [span], [], False)
        if "</" in text:
            for m in _ELEMENT.finditer(text):
                self.literals.setdefault(m.span("value"), True)
                self.put(m["key"], [m.span("value")], [], False)

    def put(self, name: str, spans: list[tuple[int, int]], names: list[str], tight: bool) -> None:
        whole = "".join(self.text[slice(*span)] for span in spans) if len(spans) > 1 else None
        for span in spans:
            self.held[span].add(name)
            if whole:
                self.whole[span] = whole
            if tight:
                self.tight.add(span)
        for n in names:
            if n != name:
                self.sources[name].add(n)

    def targets(self) -> Iterator[tuple[str, int, bool]]:
        """(name, where its value begins, whether no space surrounds the operator) of every assignment."""
        text, done = self.text, 0
        for op in _OPERATOR.finditer(text):
            at = op.start()
            if at < done:  # the second half of an operator
                continue
            done = at + 2 if text[at:at + 2] in (":=", "=>", "==", "::", "=~") else at + 1
            if text[at:at + 2] in ("==", "::", "=~") or text[at] == "=" and at and text[at - 1] in "!<>":
                continue
            name = self.target(at)
            if name:
                tight = text[at] == "=" and done == at + 1 and not text[at - 1].isspace() and not text[done:done + 1].isspace()
                yield name, done, tight

    def target(self, at: int) -> str | None:
        """The name that ends before the operator at ``at``."""
        text, end, least = self.text, at, max(0, at - 160)
        while end > least and text[end - 1] in " \t":
            end -= 1
        if end == least:
            return None
        if text[end - 1] in "\"'" or text[end - 1] == "]" and text[end - 2:end - 1] in ("'", '"'):  # "name": or x["name"] =
            stop = end - 1 if text[end - 1] in "\"'" else end - 2
            start = text.rfind(text[stop], least, stop)
            return text[start + 1:stop] if start >= 0 and "\n" not in text[start:stop] else None
        start = end
        while start > least and text[start - 1] in _IN_NAME:
            start -= 1
        before = start
        while before > least and text[before - 1] in " \t":
            before -= 1
        if text[at] == "=" and (start == end and text[end - 1] in "]>?*&" or before > least and text[before - 1] in ":|.<[,"):
            typed = _TYPED.search(text, max(least, text.rfind("\n", least, at) + 1), at)
            if typed:
                return typed["name"].lstrip("$@")
        name = text[start:end].lstrip("$-")
        return name if name and not name[0].isdigit() else None

    def expression(self, at: int, tight: bool) -> tuple[list[tuple[int, int]], list[str]]:
        """Literals and names from ``at`` on, joined by + . || & or standing side by side."""
        text, spans, names = self.text, [], []
        while True:
            call = _CALL.match(text, at)
            if call and not spans:
                at = call.end()
                if re.split(r"\.|::|->", call["call"])[-1].lower().split()[-1] in ENVIRONMENT:
                    first = _STRING.match(text, at)  # the variable's name; a default may follow
                    comma = _COMMA.match(text, first.end()) if first else None
                    if not comma:
                        break
                    at = comma.end()
                continue
            string = _STRING.match(text, at)
            if string:
                n = 3 if len(string["body"]) >= 6 and string["body"][:3] in ('"""', "'''") else 1
                span = (string.start("body") + n, string.end("body") - n)
                self.literals.setdefault(span, True)
                spans.append(span)
                names += re.findall(rf"\{{({_NAME})\}}", string["body"]) if string["body"][0] == "`" or string.start() < string.start("body") else []
                at = string.end()
            else:
                refer = _REFER.match(text, at)
                bare = _BARE.match(text, at) if not spans and not names else None
                if refer:
                    names.append(refer["name"].lstrip("$@"))
                if bare and not (refer and refer.end() > bare.end()):
                    end = bare.end() if tight else bare.start() + len(bare.group().rstrip(".:!?"))
                    if end > bare.start() and bare.group() not in self.defined:
                        self.literals.setdefault((bare.start(), end), False)
                        spans.append((bare.start(), end))
                if not refer:
                    break
                at = refer.end()
            join = _JOIN.match(text, at)
            if not join or join.end() == at and not _STRING.match(text, at):
                break
            at = join.end()
        return spans, names

    def reach(self) -> dict[str, float]:
        """The sensitivity of the most sensitive name each name flows into, itself included: the largest settles first."""
        names = {n for held in self.held.values() for n in held} | set(self.sources)
        best: dict[str, float] = {}
        heap = [(-sensitivity(n), n) for n in names]
        heapq.heapify(heap)
        while heap:
            s, n = heapq.heappop(heap)
            if n in best or not s:
                continue
            best[n] = -s
            for m in self.sources.get(n, ()):
                if m not in best:
                    heapq.heappush(heap, (s, m))
        return best

    def scores(self) -> list[tuple[int, int, float]]:
        """(start, end, score) of all literals that reach a sensitive name."""
        best, out = self.reach(), []
        for span, held in self.held.items():
            name = max((best.get(n, 0.0) for n in held), default=0.0)
            if name and span[0] < span[1]:
                value = self.whole.get(span) or self.text[slice(*span)]
                out.append((*span, name * looks_secret(value, self.literals[span], span in self.tight)))
        return sorted(out)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals with a score of at least LEAST that no base span holds; of nested ones the outer."""
    if not _OPERATOR.search(text) and "(" not in text and "-" not in text and "</" not in text:
        return []
    out: list[Span] = []
    cover = sorted(base)
    reach, i, far = [], 0, -1  # furthest end of the base spans that begin at or before a place
    for a, b, _ in cover:
        far = max(far, b)
        reach.append((a, far))
    for a, b, score in Lexed(text).scores():
        while i + 1 < len(reach) and reach[i + 1][0] <= a:
            i += 1
        if score < LEAST or reach and reach[i][0] <= a and reach[i][1] >= b or out and b <= out[-1][1]:
            continue
        out.append((a, b, 0))
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, added_spans(text, base)


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def found(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 22):
                rows = []
                for text in batch["text"][a:b].to_pylist():
                    base, added = all_spans(text or "")
                    digest = written_spans(base)
                    rows.append((*[sum(k == kind for *_, k in base) for kind in range(3)], hashlib.sha256(digest.encode()).hexdigest(), written_spans(base + added), len(added)))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, COLUMNS)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones joined, replaced by [SECRET]."""
    out, done = [], 0
    for a, b, _ in sorted(spans):
        if a >= done:
            out += [text[done:a], "[SECRET]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame) -> DataFrame:
    """All documents and columns; secrets are masked in ``text``."""
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 22):
                part = batch.slice(a, b - a)
                new = [t if t is None else masked(t, [s for some in all_spans(t) for s in some]) for t in part["text"].to_pylist()]
                columns = dict(zip(names, part.columns)) | {"text": pa.array(new, part["text"].type)}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=part.schema)

    return docs.mapInArrow(work, docs.schema)
