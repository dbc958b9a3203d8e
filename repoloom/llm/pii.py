"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The field
then labels tokens (runs without ASCII white space) that hold a digit or an @; all others
are clamped to no entity. Its factors are

* per token: how often its shape has each label, and whether a pattern matched it;
* per chain edge (neighbouring tokens) and per skip edge (distant tokens with the same digits
  or the same letters): how much more often than by chance two labels go together.

Loopy message passing over a document's edges makes mentions of one thing agree, so that an
incomplete mention takes the label of a complete one. Spans of confident tokens are added
where no pattern span lies; pattern spans stay as they are. All tables are counted over all
documents, with the patterns as teacher; a table has a bounded number of shapes.

Equal tokens are linked to the next equal one, not to all, so edges grow with the text.
Defined cases: null or empty texts have no spans; equal rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import textbytes
from repoloom.llm.tables import ids_and_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: no entity

# Written so that no input takes more than linear time: an address is sought from its @,
# and digits are taken whole.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ACTIVE = re.compile(r"[0-9@]")

_RELIABLE = 0.98  # share of the entity tokens that a pattern matches
_PRIOR = 1.0
# Added to the counted skip edges, where few mentions repeat: equal labels, unequal labels.
_SKIP_AGREE, _SKIP_DIFFER = 20.0, 0.05
_ROUNDS = 10
_DAMPING = 0.3
_CONFIDENT = 0.8
_MIN_KEY = 4


def _emails(text: str) -> list[tuple[int, int]]:
    spans, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            spans.append((start, m.end()))
            free = m.end()
    return spans


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small_parts(address: str) -> bool:
    """All parts at most 255, however many leading zeros."""
    parts = [p.lstrip("0") for p in address.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in KINDS order, in code points, end exclusive."""
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return [_emails(text), [m.span() for m in _IP.finditer(text) if _small_parts(m.group())], cards, phones]


@dataclass
class Tokens:
    """Active tokens of one text."""

    spans: list[tuple[int, int]]
    place: list[int]  # position among all tokens
    shape: list[int]
    key: list[str]
    seen: list[int]  # label by the patterns
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _shape(token: str) -> int:
    """A number below 2,048: what a token looks like."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    return (
        min(digits, 15)
        + 16 * (letters > 0)
        + 32 * ("@" in token)
        + 64 * ("." in token.strip(".,;:!?"))
        + 128 * (token[0] == "+")
        + 256 * ("(" in token)
        + 512 * ("-" in token)
        + 1024 * (token.count(".") >= 3)
    )


def _key(token: str) -> str:
    if "@" in token:
        return "".join(c for c in token.lower() if c.isalnum())
    digits = _digits(token)
    return digits if len(digits) >= _MIN_KEY else ""


def tokenise(text: str, found: list[list[tuple[int, int]]]) -> Tokens:
    out = Tokens([], [], [], [], [], [], [])
    marks = sorted((a, b, k + 1) for k, spans in enumerate(found) for a, b in spans)
    at = 0
    last: dict[str, int] = {}
    for place, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        if not _ACTIVE.search(token):
            continue
        i = len(out.spans)
        start, end = m.span()
        while at < len(marks) and marks[at][1] <= start:
            at += 1
        label = 0
        k = at
        while k < len(marks) and marks[k][0] < end:
            if marks[k][1] > start:
                label = marks[k][2]
                break
            k += 1
        if i and out.place[-1] == place - 1:
            out.chain.append((i - 1, i))
        key = _key(token)
        if key:
            if key in last:
                out.skip.append((last[key], i))
            last[key] = i
        out.spans.append((start, end))
        out.place.append(place)
        out.shape.append(_shape(token))
        out.key.append(key)
        out.seen.append(label)
    return out


def _with_digits(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the texts that can hold anything."""
    hits = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    return hits[offsets[1:]] > hits[offsets[:-1]]


# --- Counting ----------------------------------------------------------------------

_COUNTS = pa.schema([("factor", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_SHAPE, _CHAIN, _SKIP = range(3)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int, int], int] = {}

    def add(*key):
        counts[key] = counts.get(key, 0) + 1

    for batch in batches:
        for part, data, offsets in textbytes.slices(batch, "text"):
            for i in np.flatnonzero(_with_digits(part, data, offsets)).tolist():
                text = part.column("text")[i].as_py()
                tokens = tokenise(text, base_spans(text))
                for shape, label in zip(tokens.shape, tokens.seen):
                    add(_SHAPE, shape, label)
                for factor, edges in ((_CHAIN, tokens.chain), (_SKIP, tokens.skip)):
                    for i1, i2 in edges:
                        add(factor, tokens.seen[i1], tokens.seen[i2])
    if counts:
        rows = [(*key, n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(v, _COUNTS.field(k).type) for k, v in enumerate(zip(*rows))], schema=_COUNTS)


@dataclass
class Factors:
    """Log factors: per shape and label, and per edge kind and pair of labels."""

    shape: dict[int, np.ndarray]
    other: np.ndarray
    edges: np.ndarray


def learn(docs: DataFrame) -> Factors:
    """Factors counted over all documents; at most 2,048 shapes times 5 labels are collected."""
    counts = ids_and_texts(docs).select("text").mapInArrow(_count_batches, "factor int, a int, b int, n long")
    rows = counts.groupBy("factor", "a", "b").agg(F.sum("n").alias("n")).collect()
    shape: dict[int, np.ndarray] = {}
    total = np.full(LABELS, _PRIOR)
    edges = np.full((2, LABELS, LABELS), _PRIOR)
    edges[_SKIP - 1] = np.where(np.eye(LABELS, dtype=bool), _SKIP_AGREE, _SKIP_DIFFER)
    for factor, a, b, n in rows:
        if factor == _SHAPE:
            shape.setdefault(a, np.zeros(LABELS))[b] += n
            total[b] += n
        else:
            edges[factor - 1, a, b] += n
    prior = total / total.sum()
    shape = {k: np.log((v + _PRIOR * prior) / (v.sum() + _PRIOR)) for k, v in shape.items()}
    both = edges + edges.transpose(0, 2, 1)
    both /= both.sum(axis=(1, 2), keepdims=True)
    alone = both.sum(axis=2)
    return Factors(shape, np.log(prior), np.log(both / (alone[:, :, None] * alone[:, None, :])))


# --- Message passing ---------------------------------------------------------------


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def marginals(unary: np.ndarray, ends: np.ndarray, kind: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy sum-product; `ends`: the two nodes of every edge."""
    source = np.concatenate([ends[:, 0], ends[:, 1]])
    goal = np.concatenate([ends[:, 1], ends[:, 0]])
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    table = factors[np.concatenate([kind, kind])]  # symmetric
    sent = np.zeros((len(source), LABELS))
    belief = unary
    for _ in range(_ROUNDS if len(ends) else 0):
        rest = belief[source] - sent[back]
        new = _log_sum(rest[:, :, None] + table, axis=1)
        new -= _log_sum(new, axis=1)[:, None]
        sent = _DAMPING * sent + (1 - _DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, goal, sent)
    return np.exp(belief - _log_sum(belief, axis=1)[:, None])


def infer(texts: list[Tokens], factors: Factors) -> list[np.ndarray]:
    """Label probabilities of the tokens of each text."""
    sizes = [len(t.spans) for t in texts]
    if not sum(sizes):
        return [np.zeros((0, LABELS)) for _ in texts]
    seen = np.array([s for t in texts for s in t.seen])
    unary = np.array([factors.shape.get(s, factors.other) for t in texts for s in t.shape])
    miss = np.full(LABELS, np.log(1 - _RELIABLE))
    miss[0] = 0.0
    matched = np.full((LABELS, LABELS), np.log(1 - _RELIABLE))
    np.fill_diagonal(matched, np.log(_RELIABLE))
    matched[0] = miss
    unary = unary + matched[seen]
    ends, kind, base = [], [], 0
    for t, n in zip(texts, sizes):
        for k, edges in ((0, t.chain), (1, t.skip)):
            ends += [(a + base, b + base) for a, b in edges]
            kind += [k] * len(edges)
        base += n
    found = marginals(unary, np.array(ends, dtype=np.int64).reshape(-1, 2), np.array(kind, dtype=np.int64), factors.edges)
    return np.split(found, np.cumsum(sizes)[:-1])


def added_spans(text: str, tokens: Tokens, found: list[list[tuple[int, int]]], belief: np.ndarray) -> list[list[tuple[int, int]]]:
    """Spans of confident tokens that touch no pattern span, neighbours of a kind joined."""
    added: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    runs: list[tuple[int, int, int, int]] = []
    for i, (start, end) in enumerate(tokens.spans):
        label = int(belief[i].argmax())
        if not label or belief[i, label] < _CONFIDENT or tokens.seen[i]:
            continue
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start == end:
            continue
        if runs and runs[-1][0] == label and runs[-1][3] == tokens.place[i] - 1:
            runs[-1] = (label, runs[-1][1], end, tokens.place[i])
        else:
            runs.append((label, start, end, tokens.place[i]))
    for label, start, end, _ in runs:
        added[label - 1].append((start, end))
    return added


_FOUND = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)
_FOUND_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"


def _joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans) for a, b in sorted(own))


def _find_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = shared.value
        for batch in batches:
            for part, data, offsets in textbytes.slices(batch, "text"):
                where = np.flatnonzero(_with_digits(part, data, offsets)).tolist()
                texts = [part.column("text")[i].as_py() for i in where]
                base = [base_spans(t) for t in texts]
                tokens = [tokenise(t, b) for t, b in zip(texts, base)]
                rows = {}
                for i, text, own, toks, belief in zip(where, texts, base, tokens, infer(tokens, factors)):
                    more = added_spans(text, toks, own, belief)
                    every = [b + a for b, a in zip(own, more)]
                    rows[i] = (*(len(s) for s in own), _joined(own), _joined(every), sum(map(len, more)))
                empty = (0, 0, 0, 0, "", "", 0)
                columns = list(zip(*(rows.get(i, empty) for i in range(part.num_rows))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")] + [pa.array(v, _FOUND.field(k + 1).type) for k, v in enumerate(columns)],
                    schema=_FOUND,
                )

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of pattern spans, base and all spans as 'kind:start:end,..', n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    return ids_and_texts(docs).mapInArrow(_find_batches(shared), _FOUND_DDL)
