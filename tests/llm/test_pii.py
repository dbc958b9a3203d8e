"""Patterns against the plain expressions; the field on repeated mentions."""

import random
import re

import numpy as np

from repoloom.llm import pii
from samples import frame

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(s))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def brute(text):
    find = lambda pattern: re.finditer(pattern, text)
    return [
        [m.span() for m in find(EMAIL)],
        [m.span() for m in find(IP) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in find(CARD) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        [m.span() for m in find(PHONE) if 9 <= len(digits(m.group())) <= 15],
    ]


def test_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("12.3@a-+ (b.4)٣é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "+49 (30) 123-456 x", "a.b@c.d.e@f.g", "300.1.1.1 1.2.3.4.5.6.7.8", "@a.b@c.d"):
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000, "@a" * 150_000):
        pii.base_spans(text)


def documents():
    rng = random.Random(2)
    rows = []
    for k in range(120):
        number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((k, f"word {rng.randrange(99)} and call {number} or mail u{k}@x{k}.org from 10.0.{k}.1 now"))
    text = "call +1 (988) 555-2485 now. " + "word " * 300 + "again (988) 555-2485, bye é"
    return rows + [(900, text), (901, None), (902, ""), (903, "no data"), (903, "no data"), (None, "x@y.z")]


def test_mentions_agree_over_a_distance(spark):
    rows = documents()
    found = {str(r["doc_id"]): r for r in pii.find(frame(spark, rows)).collect()}
    text = dict((str(i), t) for i, t in rows)
    for i, r in found.items():
        base = brute(text[i] or "")
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(map(len, base))
        assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, base) for a, b in own)
        assert set(r["base"].split(",")) <= set(r["spans"].split(","))
    added = set(found["900"]["spans"].split(",")) - set(found["900"]["base"].split(","))
    assert {text["900"][int(a) : int(b)] for _, a, b in (s.split(":") for s in added)} == {"(988) 555-2485"}
    assert sum(r["n_added"] for r in found.values()) == 1


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(5)
    unary = rng.normal(size=(4, pii.LABELS))
    tables = rng.normal(size=(2, pii.LABELS, pii.LABELS))
    tables = tables + tables.transpose(0, 2, 1)
    ends, kind = np.array([(0, 1), (1, 2), (1, 3)]), np.array([0, 1, 0])
    joint = np.zeros((pii.LABELS,) * 4)
    for at in np.ndindex(joint.shape):
        joint[at] = sum(unary[i, y] for i, y in enumerate(at)) + sum(tables[k][at[a], at[b]] for (a, b), k in zip(ends, kind))
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    want = [joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)]
    assert np.allclose(pii.marginals(unary, ends, kind, tables), want, atol=1e-3)


def test_empty_table(spark):
    assert pii.find(frame(spark, [])).count() == 0
