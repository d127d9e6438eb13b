"""Personal data in texts: four base patterns, and a character BiLSTM-CRF for what is written in other ways.

The tagger learns from labelled spans (those of the base patterns in a bounded sample of windows, some of them rewritten
to spellings that the patterns miss) and runs over overlapping windows around digits and ``@``; no e-mail address, IP
address, card or phone number is without one of them, so nothing else needs a window.  Spans of all windows of a text are
reconciled together: pieces cut by a window's edge are joined, and of overlapping candidates those of the greatest summed
weight stay (interval scheduling over the whole text).  A span of the tagger has to hold the digits that its kind demands,
must not be part of a longer word, and gives way to base spans.

Null text counts as empty and has no spans.  Spans are code points, end exclusive.  Repeated rows are scanned one by one.
Without labelled spans nothing is learned and the base spans are the result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import lstm_crf

# Kinds in order and their base patterns.  Lookbehinds and the search from each @ only save time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.ASCII)
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

#: A window's length, what neighbours share, and what is read on either side of a digit or @.
WINDOW, OVERLAP, CONTEXT = 128, 64, 48
#: Labelled windows of each kind (and without any) that are learned from at most.
SAMPLE_WINDOWS = 300
HIDDEN, WIDTH, BATCH, RATE, SEED = 16, 12, 64, 0.02, 11
#: Passes over what is learned, and batches in all of them at most.
EPOCHS, STEPS = 16, 700
#: Learned windows are cut to this length, at a random place that keeps the first span.
LEARNED = 72
#: The least mean probability of a span's tags.
THRESHOLD = 0.8

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """At most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    found = list(emails(text))
    if TRIGGER.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def windows(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """Overlapping windows around all triggers: start, end, whether text was cut off at either side by the windowing."""
    start = end = None
    regions = []
    for m in TRIGGER.finditer(text):
        if end is not None and m.start() - CONTEXT <= end:
            end = m.end() + CONTEXT
        else:
            if end is not None:
                regions.append((start, min(end, len(text))))
            start, end = max(0, m.start() - CONTEXT), m.end() + CONTEXT
    if end is not None:
        regions.append((start, min(end, len(text))))
    for a, b in regions:
        at = a
        while True:
            stop = min(at + WINDOW, b)
            yield at, stop, at > 0, stop < len(text)
            if stop == b:
                break
            at += WINDOW - OVERLAP


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a tagged span can be what it is said to be, and stands free."""
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    part = text[start:end]
    numbers = re.findall("[0-9]+", part)
    digits = "".join(numbers)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[^\s@.]{2,}", part))
    if kind == "ip":
        return len(numbers) == 4 and all(map(small, numbers)) and len(set(re.findall("[^0-9]+", part))) == 1 and part[0].isdigit() and part[-1].isdigit()
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./_-]", part)
    return 8 <= len(digits) <= 15 and not re.search(r"[^0-9 ()./+-]", part) and 2 <= len(numbers) <= 6 and max(map(len, numbers)) >= 3


def reconciled(pieces: Iterable[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """One set of spans without overlaps from the spans of all windows (start, end, kind, score, cut at either side).

    Cut pieces that meet in the same kind are joined; then the set of the greatest summed length times score is chosen.
    """
    whole, open_ = {}, []
    for s, e, k, q, left, right in sorted(pieces):
        if not left and not right:
            whole[s, e, k] = max(q, whole.get((s, e, k), 0.0))
        elif open_ and open_[-1][2] == k and s <= open_[-1][1] and left and open_[-1][5]:
            was = open_[-1]
            open_[-1] = (was[0], max(e, was[1]), k, min(q, was[3]), was[4], right)
        else:
            open_.append((s, e, k, q, left, right))
    for s, e, k, q, left, right in open_:
        if not left and not right:
            whole[s, e, k] = max(q, whole.get((s, e, k), 0.0))
    spans = sorted(((e, s, k, q) for (s, e, k), q in whole.items() if q >= THRESHOLD))
    ends, best = [x[0] for x in spans], [(0.0, -1, False)]
    for i, (e, s, k, q) in enumerate(spans):
        before = bisect_right(ends, s, 0, i)
        taken = best[before][0] + (e - s) * q
        best.append((taken, before, True) if taken > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i > 0:
        _, before, taken = best[i]
        if taken:
            e, s, k, _ = spans[i - 1]
            out.append((s, e, k))
        i = before
    return out[::-1]


class Tagger:
    """A trained model at work on many texts at once."""

    def __init__(self, model: dict | None):
        self.model, self.symbols = model, lstm_crf.Symbols()

    def spans_of(self, texts: list[str]) -> dict[str, list]:
        """Spans of each distinct window text, in batches of like length."""
        order, found = sorted(set(texts), key=len), {}
        for i in range(0, len(order), 256):
            chunk = order[i : i + 256]
            found |= zip(chunk, lstm_crf.decode(self.model, *lstm_crf.batch_of(chunk, self.symbols)))
        return found

    def learned(self, texts: list[str]) -> list[list[Span]]:
        """The tagger's spans of each text, reconciled and plausible."""
        if not self.model:
            return [[] for _ in texts]
        places = [list(windows(t)) for t in texts]
        found = self.spans_of([t[a:b] for t, ws in zip(texts, places) for a, b, _, _ in ws])
        out = []
        for t, ws in zip(texts, places):
            pieces = [(a + s, a + e, k, q, s == 0 and left, e == b - a and right) for a, b, left, right in ws for s, e, k, q in found[t[a:b]]]
            out.append([(KINDS[k], s, e) for s, e, k in reconciled(pieces) if plausible(KINDS[k], t, s, e)])
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int, str]]]:
        """All spans of each text by kind and start, with where they come from: ``base`` or ``learned``."""
        out = []
        for text, more in zip(texts, self.learned(texts)):
            base = base_spans(text)
            taken = sorted((s, e) for _, s, e in base)
            edge, reach = [s for s, _ in taken], []
            for _, e in taken:
                reach.append(max(e, reach[-1] if reach else 0))
            free = [x for x in more if not (n := bisect_right(edge, x[2] - 1)) or reach[n - 1] <= x[1]]
            spans = [(*x, "base") for x in base] + [(*x, "learned") for x in free]
            out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))
        return out


# learning


def _digits(rng: random.Random, text: str) -> str:
    return re.sub("[0-9]", lambda _: rng.choice("0123456789"), text)


def _card(rng: random.Random, n: int) -> str:
    made = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return made + next(d for d in "0123456789" if luhn(made + d))


def rewritten(rng: random.Random, kind: str, part: str) -> str:
    """The span in another spelling of its kind, with other digits."""
    if kind == "email":
        name, _, host = part.partition("@")
        name = re.sub("[aeou]", lambda m: rng.choice((m[0], "éäöüñ"[rng.randrange(5)])), name)
        return _digits(rng, f"{name}{rng.choice(('@', ' @ ', '@'))}{host}")
    if kind == "ip":
        return rng.choice(("[.]", " . ", "(.)", ".")).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        d, sep = _card(rng, rng.choice((15, 16, 16, 16))), rng.choice((".", "/", "_", "-", " ", ""))
        return sep.join((d[:4], d[4:10], d[10:])) if len(d) == 15 else sep.join(d[i : i + 4] for i in range(0, 16, 4))
    forms = ("(###) ###-####", "###-###-####", "###.###.####", "1-###-###-####", "00 49 ## #######", "### ### ####", "0## / #######", "+## (0) ### ######", "+1 (###) ###-####")
    return re.sub("#", lambda _: rng.choice("0123456789"), rng.choice(forms))


#: Numbers that are no personal data; # is a digit, h a hex digit.
HARMLESS = ("####-##-##", "##.##.####", "##:##:##", "#.#", "##.#.#", "#,###.##", "####", "######", "############", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh", "###-#-##-######-#", "##-##", "+#", "$##.##", "##%", "x@y", "@name##", "v#.##.#", "#,###,###", "(##)", "####/##", "##############################", "#### #### ####")


def harmless(rng: random.Random) -> str:
    return re.sub("[#h]", lambda m: rng.choice("0123456789" if m[0] == "#" else "0123456789abcdef"), rng.choice(HARMLESS))


def varied(rng: random.Random, text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """A labelled window with its spans rewritten half the time, and with a harmless number put between two words."""
    out, made, at = [], [], 0
    size = lambda: sum(map(len, out))
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        out.append(text[at:s])
        part = rewritten(rng, kind, text[s:e]) if rng.random() < 0.6 else _digits(rng, text[s:e]) if kind in ("email", "phone") else text[s:e]
        made.append((kind, size(), size() + len(part)))
        out.append(part)
        at = e
    out.append(text[at:])
    text = "".join(out)
    gaps = [m.start() for m in re.finditer(" ", text) if all(m.start() < s or m.start() >= e for _, s, e in made)]
    if gaps and rng.random() < 0.6:
        at, more = rng.choice(gaps), " " + harmless(rng)
        text, made = text[:at] + more + text[at:], [(k, s + len(more) * (s >= at), e + len(more) * (s >= at)) for k, s, e in made]
    return text, made


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        tags[s:e] = 2 * k + 2
        tags[s] = 2 * k + 1
    return tags


def fit_windows(labelled: list[tuple[str, list[Span]]], seed: int = SEED) -> dict | None:
    """A model from labelled windows; None if no span is among them.  Each window is learned as it is and rewritten twice."""
    if not any(spans for _, spans in labelled):
        return None
    rng, texts, tags = random.Random(seed), [], []
    for text, spans in sorted(labelled):
        for made, marks in ((text, spans), varied(rng, text, spans), varied(rng, text, spans)):
            anchor = marks[0][1] if marks else rng.randrange(max(1, len(made)))
            cut = max(0, anchor - rng.randrange(-2, LEARNED * 2 // 3))  # a few windows begin inside a span
            texts.append(made[cut : cut + LEARNED] or " ")
            tags.append(tags_of(made, marks)[cut : cut + LEARNED])
    epochs = max(1, min(EPOCHS, STEPS // -(-len(texts) // BATCH)))
    return lstm_crf.train(lstm_crf.initial(len(KINDS), HIDDEN, WIDTH, seed), texts, tags, epochs, BATCH, RATE, seed)


def labelled_windows(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """``text, spans``: for each kind, and for windows without spans, ``sample_windows`` distinct windows, the first by hash.

    Spans are those of the base patterns in the whole texts.  A window with several kinds counts for its first.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch["text"].dropna():
                spans = base_spans(text)
                by_start = sorted(spans, key=lambda x: x[1])
                starts = [s for _, s, _ in by_start]
                for a, b, _, _ in windows(text):
                    near = by_start[bisect_right(starts, a - 2 * WINDOW) : bisect_right(starts, b)]
                    inside = [(k, max(s, a) - a, min(e, b) - a) for k, s, e in near if e > a and s < b]
                    clear, reach = [], -1
                    for k, s, e in inside:  # of overlapping spans the first is learned
                        if s >= reach:
                            clear.append((k, s, e))
                            reach = e
                    rows.add((clear[0][0] if clear else "", text[a:b], ",".join(f"{k}:{s}:{e}" for k, s, e in clear)))
            yield pd.DataFrame(sorted(rows), columns=["kind", "text", "spans"])

    made = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(cut, "kind string, text string, spans string").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("text"), "text", "spans"))
    return made.withColumn("rank", rank).where(F.col("rank") <= sample_windows).select("text", "spans")


def fit(docs: DataFrame, sample_windows: int = SAMPLE_WINDOWS, seed: int = SEED) -> dict | None:
    """A model from the labelled windows of ``docs``: at most five times ``sample_windows`` of them come to the driver."""
    rows = labelled_windows(docs, sample_windows).collect()
    return fit_windows([(r["text"], [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]) for r in rows], seed)


# at work


def scan(docs: DataFrame, model: dict | None, column: str = "spans") -> DataFrame:
    """``docs`` with its spans: kind, begin, end (code points, end exclusive) and origin, by kind and begin."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(model)
        for texts in batches:
            yield pd.Series([[{"kind": k, "begin": s, "end": e, "origin": o} for k, s, e, o in found] for found in tagger.scan(list(texts))])

    found = F.pandas_udf(run, "array<struct<kind:string,begin:int,end:int,origin:string>>", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(column, found(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def digest(docs: DataFrame, model: dict | None) -> DataFrame:
    """Counts and a digest of the base spans, all spans as text, and how many the tagger added."""
    out = scan(docs.select("doc_id", "text"), model, "found")
    base = F.filter("found", lambda x: x["origin"] == "base")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    out = out.withColumn("base", base)
    return out.select("doc_id", *map(of_kind, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_learned"))


def masked(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``[kind]`` in place of each span; spans that overlap go as one, under the first one's kind."""
    clash = {c.lower() for c in docs.columns}
    column = next(c for c in (f"_spans{i}" for i in range(len(clash) + 1)) if c not in clash)

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            parts, at = [], 0
            for x in sorted(found, key=lambda x: (x["begin"], -x["end"])) if text is not None else ():
                if x["begin"] >= at:
                    parts += [text[at : x["begin"]], f"[{x['kind']}]"]
                at = max(at, x["end"])
            out.append(text if text is None else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    mask = F.pandas_udf(run, "string")
    return scan(docs, model, column).withColumn("text", mask("text", column)).select(*[f"`{c}`" for c in docs.columns])
