"""Secret scans: assignment-aware lexing.

Three base patterns find assignments to sensitive names, access key ids and long hex runs.  The lexer goes further:
it reads ``name <op> expression`` pairs of source and configuration syntax around every ``=`` and ``:``, evaluates
the expressions (string literals, concatenations, other names) with the constants of the same text, and scores each
literal by the name that it ends up in and by its own look.  Expressions may stand in parentheses over several lines;
literals may adjoin, be in triple quotes, hold names (``$NAME``, ``${NAME}``, ``{NAME}``) or be the lines of a YAML block.
Pairs without an operator are read too: defaults of calls by a key, attributes and texts of elements, entries of name and
value.  A literal that scores enough is a ``lexed`` span unless
a base span covers it.

Null text counts as empty and has no spans.  Spans are code points, end exclusive.  Repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, their kinds in order, and the least length of what must be that long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

#: Words of a name and how sensitive they make it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "connectionstring": 0.8, "dsn": 0.7}
# Literals that stand for a value to be filled in: signs around or all over them, whole words, and words that begin them.
FILLED, AROUND = ("x", "*", "."), (("<", ">"), ("${", "}"), ("{{", "}}"), ("%", "%"))
WORDS = frozenset("none null true false changeme change_me test".split())
BEGINS = re.compile(r"(?i)(example|your|todo|redacted|placeholder|dummy)(?![A-Za-z0-9])")
OPERATOR = re.compile(r"[:=]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
TERM = re.compile(r"""[ \t]*(?:[furbFURB]{0,2}(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`)|\$\{([A-Za-z_]\w*+)\}|([A-Za-z_$][\w$.]*+(?![\w+/=-])))""")
BLANK, BARE = re.compile(r"[ \t]*"), re.compile(r"""[^\s"'`,;(){}\[\]]+""")
PLUS = re.compile(r"[ \t]*(?:\+|\.\.|&)")
#: The start of a literal of several lines, an opening parenthesis, and a literal without blanks that adjoins another.
TRIPLE, OPEN, LINES = re.compile(r"""[ \t]*[furbFURB]{0,2}(\"{3}|'{3})"""), re.compile(r"[ \t]*\(\s*"), re.compile(r"\s*")
ADJOINING = re.compile(r"""[furbFURB]{0,2}(?:"(?:[^"\\\s]|\\.)++"|'(?:[^'\\\s]|\\.)++')""")
#: A name inside a literal, the start of a YAML block, and the arguments of a call that takes a key and a default.
INSIDE, BLOCK = re.compile(r"\$?\{([A-Za-z_]\w*+)\}|\$([A-Za-z_]\w*+)"), re.compile(r"[ \t]+[|>][+-]?\d?[ \t]*\n")
DEFAULT = re.compile(r"""\(\s*+["'][^"'\\\n]*+["']\s*+,\s*+["']([^"'\\\n]++)["']\s*+\)""")
#: Names and values without an operator: a call with a key and a value, attributes, an element's text, an entry of name and value.
UNJOINED = (
    re.compile(r"""\w\(\s*+["']([A-Za-z_$][\w$.-]*+)["']\s*+,\s*+["']([^"'\\\n]++)["']"""),
    re.compile(r"""(?<![\w-])(?:key|name)\s*+=\s*+["']([\w.:-]++)["']\s++value\s*+=\s*+["']([^"'\n]++)["']"""),
    re.compile(r"<([A-Za-z_][\w.:-]*+)>([^<>\s]++)</"),
    re.compile(r"""(?<![\w-])name:[ \t]*+["']?([\w.-]++)["']?[ \t]*+\n[ \t]*+value:[ \t]*+["']?([^\s"'#]++)"""),
)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
THRESHOLD = 0.5
#: Code points at the start and the end of a value that tell, with its set of characters, whether it is a placeholder.
HEAD, TAIL = 16, 2
#: Chains of more terms are read once; an assignment inside one of their literals doesn't read them again.
LONG_CHAIN = 64


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    joined = [*parts, *(a + b for a, b in zip(parts, parts[1:]))]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def placeholder(head: str, tail: str, chars: Iterable[str], n: float) -> bool:
    """Whether a value of ``n`` characters, of any length, is to be filled in."""
    if n >= 3 and any({c.lower() for c in chars} == {f} for f in FILLED):
        return True
    if any(head.startswith(a) and tail.endswith(b) and n >= len(a) + len(b) for a, b in AROUND):
        return True
    return bool(BEGINS.match(head)) or head.lower() in WORDS and n == len(head)


def look(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like key material, by length, entropy and character classes."""
    if len(value) < 6 or placeholder(value[:HEAD], value[-TAIL:], set(value), len(value)) or re.search(r"\s", value):
        return 0.0
    return graded(len(value), Counter(value), quoted)


def graded(n: float, counts: Counter, quoted: bool) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(bool(re.search(p, "".join(counts))) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if not quoted and classes < 2:
        return 0.0
    return min(1.0, 0.25 + 0.1 * entropy + 0.1 * classes + min(n, 32) / 160)


def name_before(text: str, p: int) -> str | None:
    """The name that ends before the operator at ``p``, perhaps behind a closing quote or bracket and blanks."""
    at = p - (text[p - 1 : p] == ":")
    least = at - 8
    while at > 0 and at > least and text[at - 1] in " \t":
        at -= 1
    least = at - 2
    while at > 0 and at > least and text[at - 1] in "\"'])":
        at -= 1
    start = at
    while start > 0 and text[start - 1] in NAME_CHARS:
        start -= 1
    while start < at and text[start] in "0123456789.-":
        start += 1
    return text[start:at] or None


def block(text: str, p: int, at: int) -> list:
    """The lines of a YAML block that begins behind the operator at ``p``, as terms; none if a line has blanks inside.

    Lines of dashes around a key are left out.  A line that begins a block of its own has blanks, so no line is read often.
    """
    opened = BLOCK.match(text, at)
    if not opened:
        return []
    begin = text.rfind("\n", 0, p) + 1
    indent, place, terms = BLANK.match(text, begin).end() - begin, opened.end(), []
    while place < len(text):
        stop = text.find("\n", place)
        stop = len(text) if stop < 0 else stop
        lead = BLANK.match(text, place).end()
        line = text[lead:stop].rstrip()
        if line:
            if lead - place <= indent:
                break
            if not line.startswith("-----"):
                if re.search(r"\s", line):
                    return []
                terms.append(("literal", None, lead, lead + len(line)))
        place = stop + 1
    return terms


def pairs(text: str) -> Iterator[tuple[str, list]]:
    """Name and terms of every assignment; a term is (kind, name, start, end), kind one of literal, name and bare.

    The sign of a variable (``$``) isn't part of its name.
    """
    end, chained = 0, set()  # places of terms of long chains, which no assignment inside their literals reads again
    bare_end = 0  # of the bare text that was read last; one that begins inside it ends there too
    last = {q: text.rfind(q) for q in ('"""', "'''")}
    tripled = max(last.values())
    for op in OPERATOR.finditer(text):
        p = op.start()
        if p < end or text[p - 1 : p] in "=!<>:" and p or text[p : p + 2] == "==":
            continue
        name = (name_before(text, p) or "").lstrip("$")
        if not name:
            continue
        at = p + (2 if text[p : p + 2] in (":=", "=>") else 1)
        if BLOCK.match(text, at) and sensitivity(name) and (lines := block(text, p, at)):
            yield name, lines
            continue
        opened = OPEN.match(text, at)
        first = TERM.match(text, opened.end()) if opened else None
        gap = BLANK
        if first and first.lastindex <= 3:  # in parentheses the expression may go on over lines
            gap, at = LINES, opened.end()
        terms, starts = [], []
        while at not in chained:
            quote = TRIPLE.match(text, at) if tripled >= at else None
            if quote and last[quote.group(1)] >= quote.end():
                stop = text.find(quote.group(1), quote.end())
                body = text[quote.end() : stop]
                begin = quote.end() + len(body) - len(body.lstrip())
                starts.append(at)
                terms.append(("literal", None, begin, max(begin, quote.end() + len(body.rstrip()))))
                kind, after = 1, stop + 3
            else:
                term = TERM.match(text, at)
                if not term:
                    begin = BLANK.match(text, at).end()
                    if begin >= bare_end:
                        bare = BARE.match(text, begin)
                        bare_end = bare.end() if bare else bare_end
                    if begin < bare_end:
                        terms.append(("bare", None, begin, bare_end))
                    break
                starts.append(at)
                kind, after = term.lastindex, term.end()
                default = DEFAULT.match(text, after) if kind == 5 and not terms else None
                if default:
                    terms.append(("bare", None, *default.span(1)))
                    break
                terms.append(("literal" if kind <= 3 else "name", term.group(kind).lstrip("$"), term.start(kind), term.end(kind)))
            after = gap.match(text, after).end()
            plus = PLUS.match(text, after)
            if plus:
                at = gap.match(text, plus.end()).end()
            elif kind <= 3 and ADJOINING.match(text, after):
                at = after
            else:
                break
        if len(terms) > LONG_CHAIN:
            chained.update(starts)
        if terms:
            end = terms[-1][3] if terms[-1][0] == "literal" else p
            yield name, terms


def unjoined(text: str) -> Iterator[tuple[str, list]]:
    """Pairs that no operator joins, as ``pairs`` gives them."""
    for pattern in UNJOINED:
        for m in pattern.finditer(text):
            yield m.group(1).lstrip("$"), [("bare", None, *m.span(2))]


def split(text: str, term: tuple, names: set[str], own: str) -> list:
    """A literal cut at the ``names`` inside it, which become terms; other terms as they are."""
    kind, _, start, end = term
    out, at = [], start
    for m in INSIDE.finditer(text, start, end) if kind == "literal" else ():
        inner = m.group(m.lastindex)
        if inner in names and inner != own:
            if m.start() > at:
                out.append(("literal", None, at, m.start()))
            out.append(("name", inner, *m.span()))
            at = m.end()
    return [*out, ("literal", None, at, end)] if out and at < end else out or [term]


class Value:
    """What an expression comes to: the places and values that make it up, and the look of it, in bounded space."""

    def __init__(self, text: str, parts: list):
        self.text, self.parts = text, parts  # places (kind, start, end) in the text, and values
        first = parts[0]
        self.quoted = first.quoted if isinstance(first, Value) else first[0] == "literal"
        self.head, self.tail, self.n, self.counts = "", "", 0.0, None

    def _measure(self) -> None:
        self.counts = Counter()
        for x in self.parts:
            own = None if isinstance(x, Value) else self.text[x[1] : x[2]]
            head, tail, n, counts = (x.head, x.tail, x.n, x.counts) if own is None else (own, own[-TAIL:], len(own), Counter(own))
            self.head += head[: HEAD - len(self.head)]
            self.tail = (self.tail + tail)[-TAIL:]
            self.n += n
            self.counts.update(counts)
        if self.n > 1e12:  # values may double with each name; only shares count then
            self.counts = Counter({c: k / self.n * 1e12 for c, k in self.counts.items()})
            self.n = 1e12

    def look(self) -> float:
        stack = [self]
        while stack:  # values of names first; without recursion, since chains of names may be long
            value = stack[-1]
            missing = {id(x): x for x in value.parts if isinstance(x, Value) and x.counts is None}
            if value.counts is None and missing:
                stack += missing.values()
                continue
            if value.counts is None:
                value._measure()
            stack.pop()
        if self.n <= len(self.head):
            return look(self.head, self.quoted)
        if placeholder(self.head, self.tail, self.counts, self.n) or any(c.isspace() for c in self.counts):
            return 0.0
        return graded(self.n, self.counts, self.quoted)


def needed(assigned: list[tuple[str, list]], weights: list[float]) -> list[bool]:
    """Which assignments a sensitive name may get its value from, itself included."""
    by: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(assigned):
        by.setdefault(name, []).append(i)
    out = [w > 0 for w in weights]
    work = [i for i, w in enumerate(out) if w]
    while work:
        for kind, value, *_ in assigned[work.pop()][1]:
            if kind == "name":
                for i in by.pop(value, ()):
                    if not out[i]:
                        out[i] = True
                        work.append(i)
    return out


def valued(assigned: list[tuple[str, list]], wanted: list[bool], text: str) -> Iterator[tuple[int, Value]]:
    """The wanted assignments that have a value, with it; one with a name that has none has none.

    A name stands for its last assignment before that has a value, or else for a later one.  Every assignment is read
    once, and again only as names that it waits for get their values, so the time is linear.
    """
    names = {name for (name, _), w in zip(assigned, wanted) if w}
    out: dict[int, Value] = {}
    known: dict[str, list[int]] = {}  # assignments with a value, ascending
    waiting: dict[str, list[tuple[int, int]]] = {}  # name -> assignments and the term that they are at
    for k, w in enumerate(wanted):
        work = [(k, 0)] if w else []
        while work:
            i, at = work.pop()
            name, terms = assigned[i]
            missing = next((j for j in range(at, len(terms)) if terms[j][0] == "name" and terms[j][1] not in known), None)
            if missing is not None:
                own = terms[missing][1]
                if own in names:
                    waiting.setdefault(own, []).append((i, missing))
                    continue
                if len(terms) > 1 or not re.search(r"\d", own):
                    continue
                out[i] = Value(text, [("bare", *terms[0][2:])])
            else:
                parts = []
                for kind, value, start, end in terms:
                    if kind == "name":
                        places = known[value]
                        parts.append(out[places[max(0, bisect_left(places, i) - 1)]])
                    else:
                        parts.append((kind, start, end))
                out[i] = Value(text, parts)
            yield i, out[i]
            insort(known.setdefault(name, []), i)
            work += waiting.pop(name, [])


def lexed(text: str) -> list[tuple[int, int]]:
    assigned = list(pairs(text)) if "=" in text or ":" in text else []
    more = list(unjoined(text)) if "(" in text or "<" in text or "name" in text or "key" in text else []
    if more:
        assigned = sorted(assigned + more, key=lambda pair: pair[1][0][2])
    weights = [sensitivity(name) for name, _ in assigned]
    if not any(weights):
        return []
    whole: dict[int, list] = {}  # terms of assignments whose literals hold names, before they were cut
    if "$" in text or "{" in text:
        names = {name for name, _ in assigned}
        for i, (name, terms) in enumerate(assigned):
            cut = [part for t in terms for part in split(text, t, names, name)]
            if len(cut) != len(terms) or cut != terms:
                whole[i], assigned[i] = terms, (name, cut)
    wanted, covered = needed(assigned, weights), 0
    used = {t[1] for (_, terms), w in zip(assigned, wanted) if w for t in terms if t[0] == "name"}
    out, seen, work = set(), set(), []
    for i, (name, terms) in enumerate(assigned):
        if wanted[i] and name not in used and terms[-1][0] == "bare" and len(terms) == 1:
            # such a value is settled at once, and what begins inside one that is marked is marked with it
            wanted[i] = False
            _, _, start, end = terms[0]
            if start >= covered and weights[i] * Value(text, [("bare", start, end)]).look() >= THRESHOLD:
                out.add((start, end))
                covered = end
    for i, value in valued(assigned, wanted, text):
        whole.pop(i, None)
        if weights[i] and weights[i] * value.look() >= THRESHOLD:
            work.append(value)
    for i, terms in whole.items():  # names inside literals that have no value are part of the literal
        if weights[i] and all(kind == "literal" for kind, *_ in terms):
            value = Value(text, [(kind, start, end) for kind, _, start, end in terms])
            if weights[i] * value.look() >= THRESHOLD:
                work.append(value)
    while work:
        value = work.pop()
        if id(value) in seen:
            continue
        seen.add(id(value))
        for x in value.parts:
            if isinstance(x, Value):
                work.append(x)
            elif x[2] > x[1]:
                out.add((x[1], x[2]))
    return sorted(out)


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, sorted."""
    if not text:
        return []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    starts, reach = [s for s, _, _ in base], [0]
    for _, _, e in base:  # how far the base spans up to here reach
        reach.append(max(reach[-1], e))
    more = [(a, 3, b) for a, b in lexed(text) if reach[bisect_right(starts, a)] < b]
    return sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str | None) -> str | None:
    """The text with every span (overlaps merged) replaced by ``[SECRET]``."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, span counts by base kind, the digest of the base spans, and all spans as text, for every row of ``doc_id, text``."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for found in map(spans, texts):
            kinds = Counter(k for _, k, _ in found)
            digest = hashlib.sha256(joined([f for f in found if f[1] < 3]).encode()).hexdigest()
            rows.append((kinds[0], kinds[1], kinds[2], digest, joined(found)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = F.pandas_udf(run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select("doc_id", found("text").alias("_s")).select("doc_id", "_s.*")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with secrets in ``text`` replaced; ``n_chars``, if there, is counted anew where the text changed."""
    hidden = F.pandas_udf(lambda texts: texts.map(redacted, na_action="ignore"), "string")
    out = docs.withColumn("_safe", hidden("text"))
    changed = {"text": F.col("_safe")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_safe").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("_safe").cast("long"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
