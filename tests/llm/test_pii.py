"""Personal data: base spans against plain patterns, the tagger against enumeration, and what it finds beyond them."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from barloom.llm import lstm_crf, pii
from tests.llm.conftest import BIG, SCHEMA, prose
from tests.llm.test_operators import ids_of, same

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract's patterns as they stand."""

    def holds(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if holds(k, m[0])]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("ab.@-", "12.@ ", "+12 ()-.", "4 -0", "0123456789.", "a1.@+é% -"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("x 4556737586899855 +1 (743) 555-3824 1.2.3.255 a@b.cd@e.fg é@b.cd") == plain_spans("x 4556737586899855 +1 (743) 555-3824 1.2.3.255 a@b.cd@e.fg é@b.cd")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "@a" * 100_000, "+1" * 100_000, "1 " * 100_000, "a@b." * 50_000):
        pii.base_spans(text)
        assert sum(b - a for a, b, _, _ in pii.windows(text)) <= 3 * len(text)


def test_windows_hold_every_trigger():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("x" * 60 + "1@") for _ in range(rng.randrange(900)))
        found = list(pii.windows(text))
        for m in pii.TRIGGER.finditer(text):
            assert any(a <= max(0, m.start() - pii.CONTEXT) and min(len(text), m.end() + pii.CONTEXT) <= b for a, b, _, _ in found) or any(a <= m.start() < b for a, b, _, _ in found)
        assert all(b - a <= pii.WINDOW and left == (a > 0) and right == (b < len(text)) for a, b, left, right in found)


def test_gradients():
    p, rng = lstm_crf.initial(2, 3, 4, 1, np.float64), np.random.default_rng(0)
    ids, lengths = rng.integers(1, 101, (3, 7)), np.array([7, 5, 6])
    ids[1, 5:] = ids[2, 6:] = 0
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 0, 0, 0, 0], [2, 0, 3, 4, 4, 0, 0]])
    _, grads = lstm_crf.loss_and_gradients(p, ids, lengths, tags)
    for name, values in p.items():
        flat = values.reshape(-1)
        for i in [i for i in rng.permutation(flat.size) if flat[i] > -100][:8]:
            old, sides = flat[i], []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                sides.append(lstm_crf.loss_and_gradients(p, ids, lengths, tags)[0])
            flat[i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - grads[name].reshape(-1)[i]) < 1e-6, name


def test_decoding_against_enumeration():
    """Of all tag sequences of a short window the best one is taken; probabilities are shares of all sequences."""
    p = lstm_crf.initial(1, 3, 4, 2, np.float64)
    p["trans"][p["trans"] > -100] = np.random.default_rng(1).standard_normal(int((p["trans"] > -100).sum()))
    texts = ["a1@", "1x", "@@@@@"]
    ids, lengths = lstm_crf.batch_of(texts, lstm_crf.Symbols())
    e = lstm_crf.emissions(p, ids, (np.arange(5) < lengths[:, None]).astype(float))[0]
    for w, found in enumerate(lstm_crf.decode(p, ids, lengths)):
        n = lengths[w]
        value = lambda y: p["start"][y[0]] + p["end"][y[-1]] + sum(e[t, w, y[t]] for t in range(n)) + sum(p["trans"][a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        every = {y: value(y) for y in itertools.product(range(3), repeat=int(n))}
        best, total = max(every, key=every.get), sum(np.exp(v) for v in every.values())
        share = lambda t: sum(np.exp(v) for y, v in every.items() if y[t] == best[t]) / total  # noqa: B023, E731
        got = [0] * n
        for s, x, _, q in found:
            assert abs(q - np.mean([share(t) for t in range(s, x)])) < 1e-9
            got[s:x] = range(s, x)
        assert [bool(y) for y in best] == [any(s <= t < x for s, x, _, _ in found) for t in range(n)]


def test_reconciling_against_all_subsets():
    rng = random.Random(7)
    for _ in range(300):
        pieces = []
        for _ in range(rng.randrange(8)):
            s = rng.randrange(20)
            pieces.append((s, s + rng.randrange(1, 9), rng.randrange(2), rng.uniform(0.7, 1), False, False))
        good = {(s, e, k): q for s, e, k, q in sorted(x[:4] for x in pieces) if q >= pii.THRESHOLD}
        sets = [c for n in range(len(good) + 1) for c in itertools.combinations(good, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))]
        got = pii.reconciled(pieces)
        weigh = lambda c: sum((x[1] - x[0]) * good[x] for x in c)  # noqa: B023, E731
        assert tuple(got) in [tuple(sorted(c)) for c in sets] and abs(weigh(got) - max(map(weigh, sets))) < 1e-9
    assert pii.reconciled([(0, 128, 0, 0.9, False, True), (64, 192, 0, 0.95, True, True), (128, 200, 0, 0.9, True, False)]) == [(0, 200, 0)]


def filled(seed, n):
    """Labelled texts with one span each, by the base patterns."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = pii.KINDS[i % 4]
        part = {
            "email": f"{prose(i, 1)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
            "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
            "card": pii._card(rng, 16),
            "phone": pii._digits(rng, "+1 (###) 555-####".replace("#", "0")),
        }[kind]
        before = prose(seed + i, rng.randrange(2, 8)) + " "
        out.append((before + part + rng.choice((" ", ", ", ".\n")) + prose(i, 6), [(kind, len(before), len(before) + len(part))]))
    return out


@pytest.fixture(scope="module")
def model():
    plain = [(prose(i, 4) + " " + pii.harmless(random.Random(i)) + " " + prose(i + 1, 6), []) for i in range(120)]
    return pii.fit_windows(filled(1, 400) + plain)


def test_other_spellings_are_found_and_harmless_numbers_left_alone(model):
    tagger, rng, hits, base = pii.Tagger(model), random.Random(99), 0, 0
    for text, [(kind, s, e)] in filled(5000, 200):
        part = pii.rewritten(rng, kind, text[s:e])
        text = text[:s] + part + text[e:]
        (found,) = tagger.scan([text])
        hits += (kind, s, s + len(part)) in [x[:3] for x in found]
        base += (kind, s, s + len(part)) in pii.base_spans(text)
    assert hits >= 150 > base + 50
    texts = [prose(i, 5) + " " + pii.harmless(random.Random(7000 + i)) + " " + prose(i, 5) for i in range(400)]
    assert sum(any(o == "learned" for *_, o in found) for found in tagger.scan(texts)) <= 4


def test_a_long_span_over_several_windows_comes_out_whole(model):
    tagger = pii.Tagger(model)
    text = "one line of it " + "22 " * 30 + "and josé.19 @ mail3.example.com stands here, 172[.]16[.]254[.]3 too " + "7 " * 200
    found = [(k, text[s:e]) for k, s, e, _ in tagger.scan([text])[0]]
    assert all(s < e for k, s, e, _ in tagger.scan([text])[0]) and found == [(k, text[s:e]) for k, s, e, _ in tagger.scan([text, "x"])[0]]


def digest_of(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_query(spark, docs, clashing, none, model):
    more = [(300, "+1 (743) 555-3824 and a.b@mail.example.com", "en", "s", 1), (301, "x " * 30_000 + "4556737586899855 1.2.3.4", "en", "s", 1), (302, "call (743) 555-3824", "en", "s", 1)]
    given = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = pii.digest(given, model).collect()
    assert sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x)) == ids_of(given)
    for r, text in [(r, t) for t, i in [(t, i) for i, t in given.select("doc_id", "text").distinct().collect()] for r in got if r["doc_id"] == i and i not in (None, 5)]:
        base = plain_spans(text or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS] and r["base_sha256"] == digest_of(base)
        spans = [x for x in r["spans"].split(",") if x]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans) and len(spans) == len(base) + r["n_learned"]
    assert BIG in {r["doc_id"] for r in got}
    assert same(pii.digest(clashing, model).collect(), pii.digest(docs, model).collect())
    assert pii.digest(none, model).count() == 0 and pii.fit(none) is None
    assert {r["n_learned"] for r in pii.digest(given, None).collect()} == {0}


def test_fit_is_bounded_and_labels_come_from_base_spans(spark):
    docs = spark.createDataFrame([(i, f"{prose(i, 9)} 10.0.{i % 256}.{i // 256} {prose(i, 9)} v2.0 {prose(i, 40)}", "en", "s", 1) for i in range(600)], SCHEMA).repartition(6)
    rows = pii.labelled_windows(docs, 50).collect()
    assert len({r["text"] for r in rows}) == 100 and sum(r["spans"] == "" for r in rows) == 50  # windows with an address, and those around v2.0
    for r in rows:
        assert [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] == plain_spans(r["text"])
    assert same(rows, pii.labelled_windows(docs.repartition(3), 50).collect())


def test_masked(spark, clashing, model):
    given = spark.createDataFrame([(1, "a +1 (743) 555-3824 b x@y.zz", "en", "s", 1), (2, None, "en", "s", 1), (3, "plain", "en", "s", 1)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in pii.masked(given, model).collect()} == {1: "a [phone] b [email]", 2: None, 3: "plain"}
    assert pii.masked(clashing, model).columns == clashing.columns
