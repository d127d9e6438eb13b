"""Redaction of secrets in text columns, maps and JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark, the patterns in the order in which they apply, and the words that make a key sensitive
# (longer key names such as api_secret or access_token contain one of them).
MARK = "***REDACTED***"
URL_PASSWORD = r"(?iu)((?:postgresql|postgres|redis|mysql|https?|amqp)://[^:]+:)([^@\s]+)(@)"
AUTH_NAMES = r"(?:authorization|x-api-key|x-auth-token)\s*[:=]\s*['\"]?"
AUTH_BEARER = rf"(?iu)({AUTH_NAMES})\s*bearer\s+[^\r\n,'\"\}}]+(['\"]?)"
AUTH_OTHER = rf"(?iu)({AUTH_NAMES})(?!\s*bearer\s)[^\r\n,'\"\}}]+(['\"]?)"
BEARER = r"(?iu)(bearer\s+)[A-Za-z0-9_\-.]{8,}"
KEY_VALUE = r"(?iu)((?:api_key|api_secret|access_token|password|secret_key|client_secret)\s*[:=]\s*['\"]?)([^'\"\s,\}]+)(['\"]?)"
SENSITIVE = ("api_key", "password", "secret", "token", "auth")


#: From so many custom secrets on, those that can't touch a mark are replaced in one pass by an automaton.
MANY = 16


def touches_mark(secret: str) -> bool:
    """Whether a secret can match text that holds some of a mark, so that replacements before it matter."""
    ends = any(MARK.startswith(secret[-k:]) or MARK.endswith(secret[:k]) for k in range(1, min(len(secret), len(MARK)) + 1))
    return ends or MARK in secret or secret in MARK


def replaced(text: str, finder: ahocorasick.Automaton, sizes: list[int]) -> str:
    """``text`` after replacing one secret after another, in the order of the list, by the mark.

    All secrets are found in one pass.  Each takes its matches from left to right, where none before it has replaced
    anything; none of them touches a mark, so nothing else can match.
    """
    found: dict[int, list[int]] = {}
    for last, rank in finder.iter(text):
        found.setdefault(rank, []).append(last - sizes[rank] + 1)
    if not found:
        return text
    taken, starts = bytearray(len(text)), []
    for rank in sorted(found):
        n = sizes[rank]
        for start in found[rank]:
            if taken.find(1, start, start + n) < 0:
                taken[start : start + n] = b"\1" * n
                starts.append((start, n))
    out, at = [], 0
    for start, n in sorted(starts):
        out += [text[at:start], MARK]
        at = start + n
    return "".join([*out, text[at:]])


def _in_one_pass(text: Column, secrets: list[str]) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = ahocorasick.Automaton()
        for rank, secret in reversed(list(enumerate(secrets))):  # of a secret given twice the first counts
            finder.add_word(secret, rank)
        finder.make_automaton()
        sizes = [len(x) for x in secrets]
        for texts in batches:
            yield texts.map(lambda t: replaced(t, finder, sizes), na_action="ignore")

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(text)


def redact_text(text: str | Column, custom: list[str] | None = None) -> Column:
    """The text with credentials replaced; literal ``custom`` secrets of four characters or more as well, one after another.  However many there are, the plan has one step for them."""
    out = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(out, URL_PASSWORD, rf"$1{MARK}$3")
    out = F.regexp_replace(out, AUTH_BEARER, rf"$1Bearer {MARK}$2")
    out = F.regexp_replace(out, AUTH_OTHER, rf"$1{MARK}$2")
    out = F.regexp_replace(out, BEARER, rf"$1{MARK}")
    out = F.regexp_replace(out, KEY_VALUE, rf"$1{MARK}$3")
    secrets = [x.strip() for x in custom or [] if len(x.strip()) >= 4]
    for touches, run in groupby(secrets, touches_mark):
        run = list(run)
        if len(run) >= MANY and not touches:
            out = _in_one_pass(out, run)
            continue
        for secret in run:
            out = F.replace(out, F.lit(secret), F.lit(MARK))
    return out


def redact_map(column: str, custom: list[str] | None = None) -> Column:
    """A map of strings: values of sensitive keys replaced, other values redacted as text."""
    sensitive = "|".join(SENSITIVE)
    return F.transform_values(column, lambda k, v: F.when(F.lower(k).rlike(sensitive), F.lit(MARK)).otherwise(redact_text(v, custom)))


def plain(text: str) -> str:
    """``redact_text`` of one value outside Spark; tests hold the two together."""
    for pattern, by in ((URL_PASSWORD, rf"\1{MARK}\3"), (AUTH_BEARER, rf"\1Bearer {MARK}\2"), (AUTH_OTHER, rf"\1{MARK}\2"), (BEARER, rf"\1{MARK}"), (KEY_VALUE, rf"\1{MARK}\3")):
        text = re.sub(pattern, by, text)
    return text


class Number(str):
    """A number's or constant's text, kept as it is."""


def segments(text: str) -> list[tuple[str, str | None]] | None:
    """A JSON text in pieces, as they stand in the result: (text, None), or (text, string) for a string that has to be looked at.

    Values of sensitive keys are marks already.  None if the text isn't JSON.
    """
    try:
        whole = json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Number)
    except (ValueError, RecursionError):
        return None
    told = lambda x: json.dumps(x, ensure_ascii=False)
    out: list[tuple[str, str | None]] = []
    work: list[tuple[object, bool]] = [(whole, True)]  # what is left, last first; whether strings are looked at
    while work:
        value, looked = work.pop()
        if isinstance(value, (tuple, Number)):
            out.append((value[0] if isinstance(value, tuple) else str(value), None))
        elif isinstance(value, dict):
            more: list[tuple[object, bool]] = [(("{",), False)]
            for i, (k, v) in enumerate(value.items()):
                more.append((((", " if i else "") + told(k) + ": ",), False))
                more.append(((told(MARK),), False) if looked and any(s in k.lower() for s in SENSITIVE) else (v, looked))
            work += reversed([*more, (("}",), False)])
        elif isinstance(value, list):  # what stands in arrays is left as it is
            more = [(("[",), False)]
            for i, v in enumerate(value):
                more += [((", ",), False)] * (i > 0) + [(v, False)]
            work += reversed([*more, (("]",), False)])
        else:
            out.append((told(value), value if looked and isinstance(value, str) else None))
    return out


def redact_json(column: str) -> Column:
    """JSON text of any nesting: values of sensitive keys replaced, other strings redacted as text, at every level of objects.

    Numbers keep their text.  What stands inside arrays isn't looked at.  Text that isn't JSON, or is nested deeper than
    Python's decoder goes, stays.  Python only takes the text apart; the rules run on its strings in Spark.
    """
    kind = "array<struct<raw:string,text:string>>"
    cut = F.pandas_udf(lambda texts: pd.Series([None if t is None or (found := segments(t)) is None else [{"raw": r, "text": x} for r, x in found] for t in texts], dtype=object), kind)

    def looked(piece: Column) -> Column:
        return F.struct(piece["raw"].alias("raw"), F.when(piece["text"].isNotNull(), redact_text(piece["text"])).alias("safe"), piece["text"].alias("text"))

    def shown(piece: Column) -> Column:
        quoted = F.to_json(F.array(piece["safe"]))
        return F.when(piece["safe"].isNull() | (piece["safe"] == piece["text"]), piece["raw"]).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))

    return F.coalesce(F.array_join(F.transform(F.transform(cut(F.col(column)), looked), shown), ""), F.col(column))
