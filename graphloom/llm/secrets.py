"""Secret scans: three base patterns and assignment-aware lexing of source and configuration text."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, map_rows

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_MARK = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))

#: What the lexer stops at: names, and the signs that assign; ">" does after a tag's name.
_LEX = re.compile(r"(?P<name>[A-Za-z_]\w*(?:[.\-]\w+)*)|(?P<sign>=>|:=|(?<![=!<>:])=(?![=>~])|(?<!:):(?![:/=])|(?<=\w)>(?=[^\s<>=]))", re.A)
#: What may stand between a name and its sign: the end of a quoted key or of a subscript, blanks, and a sign that appends or defaults.
_BETWEEN = re.compile(r"""\\*["'`]?\]?[ \t]*[+?|&]{0,2}""")
_TYPE = re.compile(r"[\w \t.,|\[\]?&<>*]*", re.A)
_GAP = re.compile(r"[ \t]*+")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+(?:\n[ \t]*+)?")
_BESIDE = re.compile(r"""[ \t]++(?=["'])""")
_OPENING = re.compile(r"""(?:[rbufRBUF]{0,2})(\\*)(\"{3}|'{3}|["'`])""")
_CLOSING = {
    '"' * 3: re.compile(r'(?s)[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+'),
    "'" * 3: re.compile(r"(?s)[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+"),
    '"': re.compile(r'[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+'),
    "'": re.compile(r"[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+"),
    "`": re.compile(r"(?s)[^`\\]*+(?:\\.[^`\\]*+)*+"),
}
_ESCAPE = re.compile(r"(?s)\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(.))")
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "\n": ""}
_BLOCK = re.compile(r"[ \t]*+[|>][+\-0-9]{0,2}[ \t]*+(?:#[^\n]*+)?\n")
_LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
#: A value within a bare one, as in a query string, ends before the next such value.
_INNER = re.compile(r"""[^\s"'`,;(){}\[\]<>=&?]++""")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a part of a name, or two parts in a row, make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "api key": 1.0, "private key": 1.0, "access key": 0.9,
    "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "account key": 0.9, "client secret": 1.0, "connection string": 0.8, "db pass": 0.9, "salt": 0.6,
}
#: Last parts that tell that the value is about a secret, and is none.
HARMLESS = {"path", "file", "filename", "url", "uri", "name", "field", "label", "prompt", "hint", "length", "len", "count", "type", "id", "ttl", "expiry", "policy", "header", "regex", "pattern", "placeholder", "required"}
_DUMMY = re.compile(r"(?i)(?:x+|\*+|\.+|-+|none|null|true|false|undefined|changeme|example|placeholder|redacted|your[-_ ].*|<.*>|\$\{.*\}?|\{\{.*|%\(.*|\$\w+|test|todo)\Z")


def name_score(name: str) -> float:
    """How sensitive an assigned name is, 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    return max(SENSITIVE.get(p, 0.0) for p in [*parts, *(" ".join(z) for z in zip(parts, parts[1:], strict=False))])


def _worth(counts: dict[str, float], size: float, spaces: float) -> float:
    """How much characters that often look like a secret, 0 to 1: their entropy, number and kinds."""
    total = sum(counts.values())
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    kinds = sum(any(f(c) for c in counts) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    score = min(1.0, entropy / 3.5) * min(1.0, size / 10)
    if kinds == 1:
        score *= 0.5
    if spaces:
        score *= 0.6 if spaces <= 3 else 0.2
    return score


class Value:
    """A literal of a text, or a sum of values; a sum holds its parts' counts of characters, not their text."""

    def __init__(self, start: int = 0, end: int = 0, said: str = "", parts: tuple = ()):
        self.start, self.end, self.said, self.parts = start, end, said, parts
        self.counts: dict[str, float] | None = None
        self.marked = False
        if parts:
            self.counts = Counter()
            for p in parts:
                for c, n in p.measured().items():
                    self.counts[c] += n
            self.size, self.spaces = sum(p.size for p in parts), sum(p.spaces for p in parts)
            self.plain = all(p.plain for p in parts)
            self.dummy = all(p.dummy for p in parts)
            if self.size > 1e9:  # sums of sums may double each time; shares are all that counts by then
                self.counts = {c: n / self.size * 1e6 for c, n in self.counts.items()}
                self.size, self.spaces = 1e6, self.spaces / self.size * 1e6

    def measured(self) -> dict[str, float]:
        if self.counts is None:
            self.counts = Counter(self.said)
            self.size, self.spaces = float(len(self.said)), float(self.counts[" "])
            self.plain, self.dummy = self.said.isprintable(), bool(_DUMMY.match(self.said))
        return self.counts

    def score(self) -> float:
        counts = self.measured()
        return 0.0 if self.size < 8 or self.dummy or not self.plain else _worth(counts, self.size, self.spaces)

    def mark(self) -> Iterator[tuple[int, int]]:
        """Spans of the literals in it that no mark() gave before."""
        todo = [self]
        while todo:
            v = todo.pop()
            if v.marked:
                continue
            v.marked = True
            todo += v.parts
            if v.end > v.start:
                yield v.start, v.end


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1: its entropy, length and kinds of characters."""
    return Value(said=value).score()


class Lexer:
    """A text's assignments in order, in one pass: pairs() gives each name with the terms of its value.

    Strings have one of the quotes of common languages, single or triple, with escapes or within an escaped string; bare
    values end at a blank or bracket; a YAML block is a literal.  Strings and comments are read
    inside too, as secrets stand there as well.  A quote that isn't closed (on its line, if single) opens
    no string.  Each character is read a bounded number of times: what isn't closed is noted, and a bare
    value within a bare value, as in query strings, ends before the next.
    """

    def __init__(self, text: str, known: Container[str] = ()):
        self.text, self.known = text, known
        self.open: dict[str, int] = {}  # up to where a quote is known not to be closed

    def string(self, pos: int) -> tuple[Value, int] | None:
        m = _OPENING.match(self.text, pos)
        if not m:
            return None
        text, escaped, quote, at = self.text, m[1], m[2], m.end()
        mark = escaped + quote
        if at <= self.open.get(mark, -1):
            return None
        if escaped:
            end, line = text.find(mark, at), text.find("\n", at)
            closed = end >= 0 and (line < 0 or end < line)
        else:
            end = _CLOSING[quote].match(text, at).end()
            closed = text.startswith(quote, end)
        if not closed:
            line = text.find("\n", at) if len(quote) == 1 and quote != "`" else -1
            self.open[mark] = len(text) if line < 0 else line
            return None
        said = text[at:end]
        if "\\" in said:
            said = _ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else _CONTROL.get(e[3], e[3]), said)
        if len(quote) == 3 or quote == "`":
            said = "".join(x.strip() for x in said.splitlines())
        return Value(at, end, said), end + len(mark)

    def block(self, pos: int, key: int) -> Value | None:
        """The indented lines behind a key's "|" or ">"."""
        m = _BLOCK.match(self.text, pos)
        if not m:
            return None
        line = self.text.rfind("\n", 0, key) + 1
        indent = _GAP.match(self.text, line).end() - line
        at, first, last, said = m.end(), None, None, []
        while at < len(self.text):
            x = _LINE.match(self.text, at)
            if x[2] and len(x[1]) <= indent:
                break
            if x[2]:
                first = x.start(2) if first is None else first
                last = x.end(2)
                said.append(x[2].rstrip())
            at = x.end()
        return Value(first, last, "".join(said)) if said else None

    def pairs(self) -> Iterator[tuple[str, list[Value | str]]]:
        """(name, terms): literals, and the bare words that stand in the value, which may be names; a bare word's literal follows it."""
        text = self.text
        key = typed = None  # ends of the last name, and of the one before a colon, whose type it may be
        held: tuple[str, list[Value | str]] | None = None  # what stands behind a colon, unless it turns out to be a type
        outer = inner = -1
        for m in _LEX.finditer(text):
            if m.lastgroup == "name":
                key = m.span()
                continue
            at, sign, name = m.start(), m[0], key
            key = None
            if sign == "=" and typed and _TYPE.fullmatch(text, typed[1], at):
                name, held = typed[0], None
            elif not name or at < inner or not _BETWEEN.fullmatch(text, name[1], at) or sign == ">" and text[name[0] - 1 : name[0]] != "<":
                continue
            if held:
                yield held
                held = None
            typed = (name, m.end()) if sign == ":" else None
            pos = _GAP.match(text, m.end()).end()
            if sign == ":" and (block := self.block(pos, name[0])):
                yield text[name[0] : name[1]], [block]
                continue
            terms: list[Value | str] = []
            while True:
                if got := self.string(pos):
                    terms.append(got[0])
                    pos = got[1]
                elif b := (_INNER if pos < outer else _BARE).match(text, pos):
                    stop, last = b.end(), b[0].rfind("+")
                    if last >= 0 and (after := _GAP.match(text, b.start() + last + 1).end()) and (self.string(after) or after > stop and (i := _IDENT.match(text, after)) and i[0] in self.known):
                        stop = b.start() + last  # a sum goes on behind it
                    if pos < outer:
                        inner = stop
                    else:
                        outer = stop
                    word = text[b.start() : stop].rstrip(".:!?")
                    terms += [word, Value(b.start(), b.start() + len(word), word)]
                    pos = stop
                else:
                    break
                more = _PLUS.match(text, pos) or _BESIDE.match(text, pos)
                if not more:
                    break
                pos = more.end()
            if terms and typed:
                held = (text[name[0] : name[1]], terms)
            elif terms:
                yield text[name[0] : name[1]], terms
        if held:
            yield held


def lexed(text: str, threshold: float = 0.6) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly, through other names or as parts of a sum.

    Names keep the literals last assigned to them, so that
    ``k = "..."; client_secret = k`` marks the literal of k.  A bare value runs
    through plus signs without space around them, as those of base64; it is a
    sum where its parts are known names or a literal in quotes follows.
    """
    known: dict[str, Value] = {}
    found: list[tuple[int, int]] = []
    for name, terms in Lexer(text, known).pairs():
        literals: list[Value] = []
        whole: list[Value] = []  # a bare value of which only some parts are known names
        word = None
        for t in terms:
            if isinstance(t, str):
                parts = t.split("+")
                names = [x for x in parts if x in known and _IDENT.fullmatch(x)]
                word = (not literals and bool(t) and len(names) < len(parts), bool(names))
                literals += [known[x] for x in names]
            elif word is None:
                literals.append(t)
            else:
                if word[0]:
                    (whole if word[1] else literals).append(t)
                word = None
        values = [next(iter(p)) if len(p) == 1 else Value(parts=p) for some in (literals, whole) if (p := tuple(dict.fromkeys(some)))]
        if not values:
            continue
        known[name] = values[0] if len(values) == 1 else Value(parts=tuple(values))
        score = name_score(name)
        for v in values if score else ():
            if score * v.score() >= threshold:
                found += v.mark()
    return sorted(set(found))


def _outside(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in none of base; both sorted."""
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][1])
            k += 1
        if b > reach:
            out.append((a, b))
    return out


def scan(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, rank of kind, end, start of the secret itself) of every span, in order; positions in code points."""
    if not text:
        return []
    spans = []
    signs = "=" in text or ":" in text
    if signs:
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"1" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEX_MARK):
        spans += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    if signs:
        spans += [(a, 3, b, a) for a, b in _outside(lexed(text), sorted((a, b) for a, _, b, _ in spans))]
    return sorted(spans)


def redact(text: str | None, spans: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every secret replaced by mark; names stay. Overlapping secrets get one mark."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b in sorted((v, e) for _, _, e, v in spans):
        if a > end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans[, text]): a row for each row of docs, without a shuffle.

    Null and empty texts have no spans (and stay null or empty when
    redacted); repeated rows give repeated rows; other columns are ignored.
    """

    def rows():
        def one(text):
            spans = scan(text)
            base = [s for s in spans if s[1] < 3]
            counts = Counter(s[1] for s in base)
            out = (counts[0], counts[1], counts[2], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans))
            return (*out, redact(text, spans)) if redacted else out

        return one

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    outputs = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    schema = f"doc_id {id_type(docs, id_col)}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    if redacted:
        outputs.append(("redacted_text", pa.string()))
        schema += ", redacted_text string"
    return map_rows(kept, schema, outputs, rows, ["doc_id"])


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets of its texts replaced by a mark; all rows and other columns stay as they are.

    Null and empty texts stay so; an empty table gives none; repeated rows are
    treated alike; other columns may have any name.
    A column of characters counted from the text (n_chars), if docs has one, is counted anew.
    """
    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col(f"`{text_col}`").alias("text"))

    def rows():
        return lambda text: (redact(text, scan(text)),)

    done = map_rows(kept, T.StructType([kept.schema["others"]]).add("text", "string"), [("text", pa.string())], rows, ["others"])
    out = done.select(*[(F.col("text") if c == text_col else F.col(f"others.`{c}`")).alias(c) for c in docs.columns])
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """scan_documents() of all documents: null and empty texts have no spans, repeated rows give repeated rows."""
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
