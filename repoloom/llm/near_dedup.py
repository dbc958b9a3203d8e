"""Near duplicates by chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets are one class, linked by
their digest. Each class gets `TOKENS` minwise tokens; two sets agree on a token with the
probability of their Jaccard similarity. Independent trees branch the classes: a node picks
tokens at random (every class in the node by the same draw), and a class follows each
picked token it has, on average 1/similarity of them, so that similar classes stay together
and others part. Nodes of at most `node_size` classes are compared exhaustively.

* At the first level the classes of a node of more than `hub_size` are compared with its most
  central ones first (those with most of the node's most frequent tokens), which links large
  groups of copies at linear cost. Pairs that are in one component by then need no comparison,
  and nodes without other pairs end.
* A node of more than `node_size` is branched further; one that is as large at the last level
  is compared exhaustively, whatever its size.
* Compared pairs must pass an estimate, so far below the threshold that at most `MISS` of the
  pairs at the threshold fail (`slack`); pairs that pass are confirmed exactly, on the full
  sets, recomputed from the texts. The estimate comes from a sketch of `BINS` bins: the
  smallest hash of the set in each bin, as two bits (0: no member). Small sets fill few bins,
  where single collisions weigh much; they have a wider slack.
* A node in which more than `CROWD` pairs per class pass the estimate (texts on one template,
  below the threshold or above) is a crowd. Its pairs never become rows: sketches of a node that is
  large enough to be one are compared as arrays, which give either few pairs or the classes that have
  any. Those travel once each: they are dealt to blocks of about `BLOCK_CLASSES` classes and
  `BLOCK_SHINGLES` shingles, and the exact sizes of all intersections of two blocks come from one
  product of their incidence matrices. Of the links in two blocks a spanning forest is kept.
* `trees`: one tree keeps a pair at the threshold together with probability 1 - 1/e at the
  first level, so 16 trees miss 1e-7 of such pairs (0.1 % at the third level).

Defined cases: null or empty texts, or texts without words, have no shingles and no links;
fewer words than a shingle give one shingle; rows with a null id are returned unlinked;
rows that share an id count as one document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from repoloom.llm import textbytes
from repoloom.llm.links import components
from repoloom.llm.tables import fresh, ids_and_texts, members_only, stage

SHINGLE = 5
TOKENS = 128
TREES = 16
NODE_SIZE = 1024
HUB_SIZE = 64
LEVELS = 16
HUBS = 3
HUB_TOKENS = 16
BINS = 512
MISS = 1e-7
SMALL = 64
SMALL_SLACK = 0.45
CROWD = 8
# A node of so many classes has too few pairs to be a crowd.
SMALL_NODE = 2 * CROWD + 1
COMPARED_CLASSES = 1024
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1 << 19

_SEEDS = textbytes.mix(np.arange(TOKENS, dtype=np.uint64), 501)
_FACTORS = textbytes.mix(np.arange(TOKENS, dtype=np.uint64), 502) | np.uint64(1)
_PLACES = textbytes.mix(np.arange(TOKENS, dtype=np.uint64), 503)
_WORDS = BINS // 64
_SKETCH = tuple(f"{half}{k}" for half in ("lo", "hi") for k in range(_WORDS))
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("tokens", pa.binary())]
    + [(name, pa.int64()) for name in _SKETCH]
    + [("paths", pa.list_(pa.int64()))]
)
_SETS_DDL = "doc_id long, n_shingles long, d1 long, d2 long, tokens binary, " + ", ".join(f"{name} long" for name in _SKETCH) + ", paths array<long>"


def slack(percent: int) -> float:
    """How far below the threshold an estimate may be, so that at most `MISS` of the pairs at
    the threshold are lost: all bins filled and each agreeing by itself is the worst case."""
    p = percent / 100
    agrees = p + (1 - p) / 3
    below, least = 0.0, 0
    while (below := below + comb(BINS, least) * agrees**least * (1 - agrees) ** (BINS - least)) <= MISS:
        least += 1
    return p - (3 * least - BINS) / 2 / BINS + 1e-9


SLACK = slack(80)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one text after the other, and where each begins."""
    words = textbytes.find_words(textbytes.lowered(data), offsets, textbytes.SPACE_WORDS)
    hashes, doc, n = words.hashes(), words.doc, len(offsets) - 1
    shingles = textbytes.shingle_hashes(hashes, SHINGLE)
    whole = np.flatnonzero(doc[: len(shingles)] == doc[SHINGLE - 1 :]) if len(shingles) else np.empty(0, np.int64)
    owner, values = doc[whole], shingles[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        ends = words.first[short + 1]
        single = [textbytes.shingle_hashes(hashes[e - c : e], int(c))[0] for e, c in zip(ends, words.counts[short])]
        owner = np.concatenate([owner, short])
        values = np.concatenate([values, np.array(single, dtype=np.uint64)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    if len(values):
        new = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1]))
        owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(n + 1))


def sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Columns of longs, one row per set: low bits of all bins, then high bits."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    place = owner * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    # Members are sorted, so the first of each place is its smallest.
    least = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    code = np.zeros(n * BINS, dtype=np.uint8)
    code[place[least]] = 1 + (textbytes.mix(values[least], 603) % np.uint64(3)).astype(np.uint8)
    code = code.reshape(n, BINS)
    return np.concatenate([np.packbits(code & 1, axis=1).view(np.int64), np.packbits(code >> 1, axis=1).view(np.int64)], axis=1)


def _describe(values: np.ndarray, first: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(digest, minwise tokens and sketch of every set, whole tokens); sets without members
    get zeros."""
    n = len(first) - 1
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    tokens = np.zeros((n, TOKENS), dtype=np.uint64)
    digest = np.zeros((2, n), dtype=np.uint64)
    if len(full):
        begins = first[:-1][full]
        with np.errstate(over="ignore"):
            for i in range(TOKENS):
                least = np.minimum.reduceat((values ^ _SEEDS[i]) * _FACTORS[i], begins)
                tokens[full, i] = textbytes.mix(least, i)
            for k in range(2):
                digest[k, full] = np.add.reduceat(textbytes.mix(values, 601 + k), begins)
    found = {"n_shingles": sizes, "d1": digest[0].view(np.int64), "d2": digest[1].view(np.int64)}
    found |= dict(zip(_SKETCH, sketch(values, first).T))
    # 16 bits of a token do for the branching of nodes whose members are alike already.
    found["tokens"] = tokens.astype(np.uint16)
    return found, tokens


def _children(paths: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for each token that its node picks: one in similarity * TOKENS."""
    threshold = np.uint64(int(2.0**64 / (similarity * TOKENS)))
    mark = textbytes.mix((tokens + _PLACES) ^ textbytes.mix(paths, 504)[:, None], 505)
    picked = mark < threshold
    return np.nonzero(picked)[0], textbytes.mix(mark[picked], 506).view(np.int64)


def _set_batches(roots: list[int], similarity: float):
    """Sets of texts, with the first nodes that they follow in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbytes.slices(batch, "text"):
                found, tokens = _describe(*shingle_sets(data, offsets))
                found["tokens"] = [row.tobytes() for row in found["tokens"]]
                rows, nodes = [], []
                for root in roots:
                    row, child = _children(np.full(len(tokens), root, dtype=np.uint64), tokens, similarity)
                    rows.append(row)
                    nodes.append(child)
                row, child = np.concatenate(rows), np.concatenate(nodes)
                child = child[np.argsort(row, kind="stable")]
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(tokens))))
                columns = [pa.array(found[name], _SETS.field(name).type) for name in _SETS.names[1:-1]]
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(child)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], schema=_SETS)

    return run


def _branch(similarity: float):
    """Children (path, id) of (path, id, tokens) rows."""
    schema = pa.schema([("path", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint16).reshape(-1, TOKENS)
                paths = batch.column("path").to_numpy().view(np.uint64)
                row, child = _children(paths, tokens.astype(np.uint64), similarity)
                ids = batch.column("id").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids)], schema=schema)

    return run


def _estimate(a: str, b: str) -> Column:
    """Similarity of two sketches: agreeing bins, less those that agree by chance, of all
    bins that either set fills."""
    agree, both, either = F.lit(0), F.lit(0), F.lit(0)
    for k in range(_WORDS):
        low_a, high_a, low_b, high_b = (F.col(f"{side}.{half}{k}") for side in (a, b) for half in ("lo", "hi"))
        differ = low_a.bitwiseXOR(low_b).bitwiseOR(high_a.bitwiseXOR(high_b))
        full_a, full_b = low_a.bitwiseOR(high_a), low_b.bitwiseOR(high_b)
        agree = agree + F.bit_count(full_a.bitwiseAND(F.bitwise_not(differ)))
        both = both + F.bit_count(full_a.bitwiseAND(full_b))
        either = either + F.bit_count(full_a.bitwiseOR(full_b))
    return (3 * agree - both) / 2 / F.greatest(either, F.lit(1))


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow the similarity."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    margin = F.when(large <= SMALL, SMALL_SLACK).otherwise(slack(percent))
    return (small * 100 >= large * percent) & (_estimate(a, b) >= percent / 100 - margin)


def _confirm(percent: int):
    """Rows (a, b, text_a, text_b) whose full sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(batch, name):
        for part, data, offsets in textbytes.slices(batch, name):
            values, first = shingle_sets(data, offsets)
            for i in range(part.num_rows):
                yield values[first[i] : first[i + 1]]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                linked = []
                for one, two in zip(sets(batch, "text_a"), sets(batch, "text_b")):
                    both = np.concatenate([one, two])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    linked.append(shared > 0 and 100 * shared >= percent * (len(both) - shared))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=schema
                )

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets.

    Pairs and ids are written down: each is read several times here, and the driver would hold,
    and describe after every stage, the plan that made them as often.
    """
    pairs = stage(pairs, "candidates")
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    wanted = members_only(texts, ids, ["doc_id"])
    side = lambda end: wanted.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_confirm(percent), "a long, b long").distinct()


def shared_counts(one: np.ndarray, owner_one: np.ndarray, n_one: int, two: np.ndarray, owner_two: np.ndarray, n_two: int) -> np.ndarray:
    """Sizes of all intersections of n_one with n_two sets, given as members and their owners.
    Members that many sets hold are columns of two dense incidence matrices, `width` at a time;
    the pairs that hold another member are counted one by one."""
    kinds, place = np.unique(np.concatenate([one, two]), return_inverse=True)
    at_one, at_two = place[: len(one)], place[len(one) :]
    n_kinds = len(kinds)
    order_one, order_two = np.argsort(at_one, kind="stable"), np.argsort(at_two, kind="stable")
    own_one, own_two = owner_one[order_one], owner_two[order_two]
    first_one, first_two = (np.searchsorted(at[order], np.arange(n_kinds + 1)) for at, order in ((at_one, order_one), (at_two, order_two)))
    often_one, often_two = np.diff(first_one), np.diff(first_two)
    both = often_one * often_two
    counts = np.zeros(n_one * n_two, dtype=np.float32)
    table = counts.reshape(n_one, n_two)
    width, common = 1024, np.flatnonzero(both > n_one * n_two // 64)
    for k in range(0, len(common), width):
        some = common[k : k + width]
        sides = []
        for first, own, often, n in ((first_one, own_one, often_one, n_one), (first_two, own_two, often_two, n_two)):
            held = np.zeros((n, len(some)), dtype=np.float32)
            held[own[textbytes.ranges(first[some], often[some])], np.repeat(np.arange(len(some)), often[some])] = 1
            sides.append(held)
        table += sides[0] @ sides[1].T
    rare = np.flatnonzero((both > 0) & (both <= n_one * n_two // 64))
    rows = textbytes.ranges(first_one[rare], often_one[rare])
    partners = np.repeat(often_two[rare], often_one[rare])
    starts = np.repeat(first_two[rare], often_one[rare])
    ends = np.cumsum(partners)
    begin = 0
    while begin < len(rows):
        # About a million pairs at a time; one row has at most n_two.
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + (1 << 20), side="right")))
        x = np.repeat(own_one[rows[begin:end]], partners[begin:end])
        y = own_two[textbytes.ranges(starts[begin:end], partners[begin:end])]
        counts += np.bincount(x * n_two + y, minlength=len(counts)).astype(np.float32)
        begin = end
    return table


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric table that connect all that its links connect."""
    found, open_ = [], np.ones(len(linked), dtype=bool)
    for root in range(len(linked)):
        if not open_[root]:
            continue
        open_[root] = False
        waiting = [root]
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(linked[at] & open_).tolist()
            open_[new] = False
            found += [(at, other) for other in new]
            waiting += new
    return found


def _block_links(percent: int):
    """Links (a, b) of the rows (i, j, block, id, text) of two blocks, or of one with itself."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        values, owners, sizes = [], [], []
        for batch in table.to_batches():
            for part, data, offsets in textbytes.slices(batch, "text"):
                members, first = shingle_sets(data, offsets)
                owners.append(np.repeat(np.arange(part.num_rows), np.diff(first)) + sum(map(len, sizes)))
                values.append(members)
                sizes.append(np.diff(first))
        values, owners, sizes = (np.concatenate(x) for x in (values, owners, sizes))
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = np.zeros((len(ids), len(ids)), dtype=bool)
        if len(rows) and len(columns):
            place = np.zeros(len(ids), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            place[columns] = np.arange(len(columns))
            sides = []
            for own, chosen in ((block == i, rows), (block == j, columns)):
                held = own[owners]
                sides += [values[held], place[owners[held]], len(chosen)]
            shared = shared_counts(*sides).astype(np.int64)
            either = sizes[rows][:, None] + sizes[columns][None, :] - shared
            alike = (shared > 0) & (100 * shared >= percent * either) & (ids[rows][:, None] != ids[columns][None, :])
            linked[np.ix_(rows, columns)] = alike
            linked |= linked.T
        forest = np.array(spanning_forest(linked), dtype=np.int64).reshape(-1, 2)
        ends = np.sort(ids[forest], axis=1)
        return pa.Table.from_arrays([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], schema=schema)

    return run


def _passing(one: pa.Table, two: pa.Table, percent: int) -> np.ndarray:
    """`_alike` for all pairs of two tables of classes, as a table of booleans."""
    sketches = [np.stack([t[name].to_numpy() for name in _SKETCH], axis=1).view(np.uint64) for t in (one, two)]
    sizes = [t["n"].to_numpy() for t in (one, two)]
    passed = np.zeros((one.num_rows, two.num_rows), dtype=bool)
    for at in range(0, one.num_rows, 128):
        rows = slice(at, at + 128)
        agree, both, either = (np.zeros(passed[rows].shape, dtype=np.int32) for _ in range(3))
        for k in range(_WORDS):
            low_a, high_a = sketches[0][rows, k][:, None], sketches[0][rows, _WORDS + k][:, None]
            low_b, high_b = sketches[1][:, k][None, :], sketches[1][:, _WORDS + k][None, :]
            differ = (low_a ^ low_b) | (high_a ^ high_b)
            full_a, full_b = low_a | high_a, low_b | high_b
            agree += np.bitwise_count(full_a & ~differ)
            both += np.bitwise_count(full_a & full_b)
            either += np.bitwise_count(full_a | full_b)
        small = np.minimum(sizes[0][rows][:, None], sizes[1][None, :])
        large = np.maximum(sizes[0][rows][:, None], sizes[1][None, :])
        margin = np.where(large <= SMALL, SMALL_SLACK, slack(percent))
        estimate = (3 * agree - both) / 2 / np.maximum(either, 1)
        passed[rows] = (small * 100 >= large * percent) & (estimate >= percent / 100 - margin)
    return passed


def _earlier_nodes(table: pa.Table, path: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes of every class before `path`, their owners, and the number of classes."""
    lists = table["nodes"].combine_chunks()
    owners = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    nodes = lists.flatten().to_numpy()
    earlier = nodes < path
    return nodes[earlier], owners[earlier], len(lists)


def _block_pairs(percent: int):
    """Pairs (path, a, b) of two blocks of a node, or of one with itself, that pass the estimate
    and share no earlier node; in a crowd the classes of such pairs, once each, as (path, a, null)."""
    schema = pa.schema([("path", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        path, i, j = (table[name][0].as_py() for name in ("path", "i", "j"))
        block = table["block"].to_numpy()
        one, two = table.filter(pa.array(block == i)), table.filter(pa.array(block == j))
        ids_one, ids_two = one["id"].to_numpy(), two["id"].to_numpy()
        before = np.less if i == j else np.not_equal
        passed = _passing(one, two, percent) if one.num_rows and two.num_rows else np.zeros((one.num_rows, two.num_rows), dtype=bool)
        passed &= before(ids_one[:, None], ids_two[None, :])
        passed &= one["label"].to_numpy()[:, None] != two["label"].to_numpy()[None, :]
        if passed.any():
            rows, columns = np.flatnonzero(passed.any(axis=1)), np.flatnonzero(passed.any(axis=0))
            sides = [x for t, some in ((one, rows), (two, columns)) for x in _earlier_nodes(t.take(pa.array(some)), path)]
            passed[np.ix_(rows, columns)] &= shared_counts(*sides) == 0
        rows, columns = np.nonzero(passed)
        ends = np.unique(np.concatenate([ids_one[rows], ids_two[columns]]))
        if len(rows) > CROWD * len(ends):
            a, b = pa.array(ends, pa.int64()), pa.nulls(len(ends), pa.int64())
        else:
            pairs = np.sort(np.stack([ids_one[rows], ids_two[columns]], axis=1), axis=1)
            a, b = pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())
        return pa.Table.from_arrays([pa.array(np.full(len(a), path), pa.int64()), a, b], schema=schema)

    return run


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """Members of a node in blocks, a row for every pair (i, j) of blocks that they are needed in."""
    dealt = members.withColumn("blocks", blocks.cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _links(found: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of pairs (path, a, b), and block by block of the classes (path, a, null) of crowds."""
    found = stage(found, "pairs")
    sizes = classes.groupBy("id").agg(F.sum("n").alias("n"))
    crowds = found.filter("b is null").select("path", F.col("a").alias("id")).distinct()
    members = stage(crowds.join(sizes, "id"), "crowds")
    # Blocks are dealt by hash, so that no node is sorted or counted in one task.
    blocks = members.groupBy("path").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).alias("needed")
    )
    dealt = _dealt(members.join(blocks, "path"), F.col("needed")).select("path", "id", "block", "i", "j")
    wanted = members_only(texts, members.select(F.col("id").alias("doc_id")).distinct(), ["doc_id"])
    rows = dealt.join(wanted, dealt["id"] == wanted["doc_id"]).select("path", "i", "j", "block", "id", "text")
    crowded = rows.groupBy("path", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    few = found.filter("b is not null").select("a", "b").distinct()
    return stage(confirmed(few, texts, percent), "few-links").unionByName(crowded)


def _hub_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Every class of a large node with the node's most central classes."""
    token = F.expr(f"transform(sequence(0, {HUB_TOKENS - 1}), i -> substring(tokens, 2 * i + 1, 2))")
    shown = members.join(classes.select("id", token.alias("shown")), "id")
    often = shown.select("path", F.posexplode("shown").alias("i", "value")).groupBy("path", "i", "value").agg(F.count(F.lit(1)).alias("n"))
    # The most frequent token of each place: one short list per node.
    usual = often.groupBy("path", "i").agg(F.max(F.struct("n", "value")).alias("most")).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("i", F.col("most.value").alias("value")))).alias("usual")
    )
    agree = F.expr("aggregate(zip_with(shown, usual, (t, u) -> int(t = u.value)), 0, (n, x) -> n + x)")
    score = shown.join(usual, "path").select("path", "id", agree.alias("score"))
    ranked = score.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "id")))
    # Three hubs of a node, and of the same node in another tree, are often the same.
    hubs = stage(ranked.filter(F.col("r") <= HUBS).select("path", F.col("id").alias("hub")), "hubs")
    sketch = classes.select("id", "n", *_SKETCH)
    pairs = members.join(hubs, "path").filter("id != hub")
    pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    return (
        pairs.alias("p")
        .join(sketch.alias("x"), F.col("p.a") == F.col("x.id"))
        .join(sketch.alias("y"), F.col("p.b") == F.col("y.id"))
        .filter(_alike("x", "y", percent))
        .select("a", "b")
    )


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("id"))
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def _nodes(frontier: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(path, id, label, size) of the nodes that hold more than one component."""
    rows = stage(_labelled(frontier, labels), "frontier")
    nodes = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    return rows.join(nodes.filter("low < high").select("path", "size"), "path")


def linked_classes(docs: DataFrame, percent: int, trees: int = TREES, node_size: int = NODE_SIZE, hub_size: int = HUB_SIZE) -> tuple[DataFrame, DataFrame]:
    """(sets of all rows, confirmed links that connect all similar sets)."""
    similarity = percent / 100
    texts = ids_and_texts(docs)
    roots = [int(x) for x in textbytes.mix(np.arange(trees, dtype=np.uint64), 507)]
    sets = stage(texts.mapInArrow(_set_batches(roots, similarity), _SETS_DDL), "sets")
    firsts = [F.first(name).alias(name) for name in ("tokens", "paths", *_SKETCH)]
    classes = stage(
        sets.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("id"), *firsts)
        .drop("d1", "d2"),
        "classes",
    )
    frontier = classes.select("id", F.explode("paths").alias("path")).distinct()
    labels = links = None
    compared = []
    for level in range(1, LEVELS + 1):
        members = stage(_nodes(frontier, labels), "nodes")
        if level == 1:
            crowd = members.filter(F.col("size") > min(hub_size, node_size)).select("path", "id")
            links = stage(confirmed(_hub_pairs(crowd, classes, percent), texts, percent), "hub-links")
            labels = stage(components(links), "labels")
        big = members.filter(F.col("size") > node_size)
        last = level == LEVELS or big.isEmpty()
        compared.append(members if last else members.filter(F.col("size") <= node_size))
        if last:
            break
        frontier = (
            big.select("path", "id")
            .join(classes.select("id", "tokens"), "id")
            .mapInArrow(_branch(similarity), "path long, id long")
            .distinct()
        )
    members = stage(reduce(DataFrame.unionByName, [m.select("path", "id", "size") for m in compared]), "compared")
    # A pair is compared in the first of the nodes that it shares; a class has few nodes.
    own = members.groupBy("id").agg(F.collect_set("path").alias("nodes"))

    def described(some: DataFrame) -> DataFrame:
        return _labelled(some, labels).join(own, "id").join(classes.select("id", "n", *_SKETCH), "id")

    rows = described(members.filter(F.col("size") <= SMALL_NODE))
    pairs = (
        rows.alias("x")
        .join(
            rows.alias("y"),
            (F.col("x.path") == F.col("y.path"))
            & (F.col("x.id") < F.col("y.id"))
            & (F.col("x.label") != F.col("y.label"))
            & _alike("x", "y", percent)
            & (F.col("x.path") == F.array_min(F.array_intersect("x.nodes", "y.nodes"))),
        )
        .select("x.path", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )
    larger = described(members.filter(F.col("size") > SMALL_NODE))
    blocks = _dealt(larger, F.ceil(F.col("size") / COMPARED_CLASSES))
    found = pairs.unionByName(blocks.groupBy("path", "i", "j").applyInArrow(_block_pairs(percent), "path long, a long, b long"))
    return sets, _links(found, classes, texts, percent).unionByName(links).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, trees: int = TREES, node_size: int = NODE_SIZE, hub_size: int = HUB_SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept."""
    sets, links = linked_classes(docs, percent, trees, node_size, hub_size)
    labels = components(links)
    reps = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(
        F.min("doc_id").alias("rep")
    )
    joined = sets.select("doc_id", "n_shingles", "d1", "d2").join(reps, ["d1", "d2", "n_shingles"], "left")
    joined = joined.join(labels, joined["rep"] == labels["id"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return joined.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` without the near copies of a document with a smaller id; of rows
    that repeat an id all stay or go together."""
    name = fresh(docs, "gone_id")
    gone = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
