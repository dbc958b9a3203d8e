"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

A line of at least `min_chars` characters (trimmed) goes if an equal line, or one within
edit distance `k`, occurs first in an earlier place, by (doc_id, line number); shorter
lines stay. Of lines within distance k, one is cut into k + 1 segments, at least one of
which the other one must contain unchanged, near the same place. So every distinct line

* enters an index with its k + 1 segments, keyed by (its length, segment, hash), and
* probes the indexes of all lengths up to k shorter than its own, with the few substrings
  that can match: segment i starts at most i - 1 places off from the left, and at most
  k + 1 - i places off when seen from the right.

Keys are hashes and lines are 64-bit digests, so that no text is shuffled for the join. The
texts of lines that meet another line in the index are fetched, and their pairs compared:
first by the parities of their characters' numbers, of which an edit changes two at most,
then exactly: equal ends are cut off, and Hyyro's banded form of the bit-parallel edit
distance runs over the rest, with a band of 2k + 1 bits.

Equal lines are collapsed by partial aggregation before anything else, so a line that a
third of all documents share is one line. Defined cases: null or empty texts have no lines;
rows with a null id keep all lines; rows that share an id come at one place in the order, by
line number and then a hash of the text, and each loses its own lines only (rows that repeat
id and text lose the same ones, also where a line is new); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.llm.tables import fresh, ids_and_texts, members_only, stage

DISTANCE = 2
MIN_CHARS = 20
_STEPS = [1 << k for k in range(24, -1, -1)]


def _texts(docs: DataFrame) -> DataFrame:
    rows = ids_and_texts(docs)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key, line_no from 0, line trimmed) of all lines that are compared."""
    exploded = _texts(docs).filter("doc_id is not null").select(
        "doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    trimmed = exploded.withColumn("line", F.trim("line"))
    return trimmed.filter(F.length("line") >= min_chars).withColumn("id", F.xxhash64("line"))


def _bounds(lag: int, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 1) of a line `lag` shorter than this one:
    all have `base` characters, the last `more` of them one more."""
    base, more = F.col(f"base{lag}"), F.col(f"more{lag}")
    # Segments before this one that have one more: those after the first k + 1 - more.
    ahead = F.greatest(F.lit(i - 1 - (k + 1)) + more, F.lit(0))
    return base * (i - 1) + ahead + 1, base + F.when(more > k + 1 - i, 1).otherwise(0)


def _with_keys(rows: DataFrame, k: int) -> DataFrame:
    """Adds `index`: keys of a line's own segments, and `probe`: keys of the places where
    segments of lines up to k shorter can match. Sizes are columns of their own, so that
    each is computed once."""
    rows = rows.withColumn("n", F.length("line"))
    parts = k + 1
    rows = rows.select("*", *[F.floor((F.col("n") - lag) / parts).cast("int").alias(f"base{lag}") for lag in range(k + 1)])
    rows = rows.select("*", *[(F.col("n") - lag - F.col(f"base{lag}") * parts).alias(f"more{lag}") for lag in range(k + 1)])

    def key(lag, i, start, size):
        return F.xxhash64(F.col("line").substr(start, size), F.col("n") - lag, F.lit(i))

    index = [key(0, i, *_bounds(0, i, k)) for i in range(1, parts + 1)]
    probe = []
    for lag in range(k + 1):
        for i in range(1, parts + 1):
            start, size = _bounds(lag, i, k)
            # Seen from the left the start moves by at most i - 1, from the right (where
            # the lines differ by `lag`) by at most k + 1 - i. It stays within the line.
            for move in range(max(1 - i, lag - (parts - i)), min(i - 1, lag + parts - i) + 1):
                probe.append(key(lag, i, start + move, size))
    return rows.select(*rows.columns, F.array(*index).alias("index"), F.array(*probe).alias("probe"))


def _common(a: Column, b: Column, most: Column, from_end: bool) -> Column:
    """Length of the common start (or end) of two strings, by halving steps."""
    part = (lambda s, n: F.right(s, n)) if from_end else (lambda s, n: F.left(s, n))

    def step(found, size):
        more = found + size
        return F.when((more <= most) & (part(a, more) == part(b, more)), more).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), step)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _banded(pattern: Column, text: Column, k: int) -> Column:
    """Edit distance of two arrays of characters if it is at most k, else more than k; the
    pattern is at most k longer than the text, and not shorter.

    Column j of the distance table is kept as vertical differences of the 2k + 1 rows around
    the diagonal, one bit each: VP (+1) and VN (-1). D0 marks zero steps along the diagonal.
    """
    width = 2 * k + 1
    ones = (1 << width) - 1
    inverse = lambda x: x.bitwiseXOR(_long(ones))
    lag = F.size(pattern) - F.size(text)

    def match(char, j):
        equal = lambda t: (j + (t - k) >= 0) & (F.get(pattern, F.greatest(j + (t - k), F.lit(0))) == char)
        return reduce(
            lambda x, y: x.bitwiseOR(y), [F.when(equal(t), _long(1 << t)).otherwise(_long(0)) for t in range(width)]
        )

    def advance(state, j):
        vp, vn = state["vp"], state["vn"]

        def with_match(pm):
            d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(_long(ones))
            return _let(d0, with_d0)

        def with_d0(d0):
            hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            zero = F.call_function("shiftright", d0, lag + k).bitwiseAND(_long(1))
            return F.struct(
                hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (state["d"] + 1 - zero).alias("d"),
            )

        return _let(match(F.get(text, j), j), with_match)

    start = F.struct(_long(ones & ~((1 << k) - 1)).alias("vp"), _long(0).alias("vn"), lag.cast("long").alias("d"))
    steps = F.when(F.size(text) > 0, F.sequence(F.lit(0), F.size(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, advance, lambda s: s["d"])


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """The edit distance of two strings if it is at most k, else any number above k."""

    def trimmed(pair):
        long, short = pair["long"], pair["short"]

        def with_head(head):
            def with_tail(tail):
                rest = lambda s: _chars(s.substr(head + 1, F.length(s) - head - tail))
                both = F.struct(rest(long).alias("p"), rest(short).alias("t"))
                return _let(both, lambda r: _banded(r["p"], r["t"], k))

            return _let(_common(long, short, F.length(short) - head, True), with_tail)

        return _let(_common(long, short, F.length(short), False), with_head)

    swap = F.length(a) < F.length(b)
    pair = F.struct(F.when(swap, b).otherwise(a).alias("long"), F.when(swap, a).otherwise(b).alias("short"))
    return F.when(F.abs(F.length(a) - F.length(b)) > k, _long(k + 1)).otherwise(_let(pair, trimmed))


def _parities(line: Column) -> Column:
    """One bit per class of characters: whether their number is odd. An edit changes at most
    two bits."""
    bit = lambda c: F.call_function("shiftleft", _long(1), F.ascii(c) % 63)
    return F.aggregate(_chars(line), _long(0), lambda bits, c: bits.bitwiseXOR(bit(c)))


def removed_lines(docs: DataFrame, k: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key, gone: numbers of the lines that go) of documents that lose any."""
    found = lines(docs, min_chars)
    firsts = stage(
        _with_keys(found, k)
        .groupBy("id")
        .agg(
            F.min(F.struct("doc_id", "line_no", "key")).alias("first"),
            F.count(F.lit(1)).alias("times"),
            F.first("index").alias("index"),
            F.first("probe").alias("probe"),
        ),
        "lines",
    )
    own = firsts.select(F.explode("index").alias("key"), F.col("id").alias("a"))
    other = firsts.select(F.explode("probe").alias("key"), F.col("id").alias("b"))
    met = (own["key"] == other["key"]) & (own["a"] != other["b"])
    # Keys by which a line meets another one: few, so that only their lines are fetched.
    own = stage(own.join(other, met, "left_semi"), "met-own")
    other = stage(members_only(other, own.select("key").distinct(), ["key"]), "met-other")
    some = own.select(F.col("a").alias("id")).union(other.select("b")).distinct()
    places = some.join(firsts.select("id", "first"), "id").select("id", "first", "first.doc_id", "first.line_no", "first.key")
    texts = members_only(found.select("doc_id", "line_no", "key", "line"), places, ["doc_id", "line_no", "key"])
    texts = stage(texts.dropDuplicates(["id"]).select("id", "first", "line", _parities(F.col("line")).alias("parities")), "met-lines")
    with_place = lambda end: texts.select(F.col("id").alias(end), F.col("first").alias(f"first_{end}"), F.col("parities").alias(f"p{end}"))
    own, other = own.join(with_place("a"), "a"), other.join(with_place("b"), "b")
    pairs = own.join(
        other,
        (own["key"] == other["key"])
        & (F.col("a") != F.col("b"))
        & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2 * k),
    )
    pairs = pairs.select("a", "b", "first_a", "first_b").distinct()
    side = lambda end: texts.select(F.col("id").alias(end), F.col("line").alias(f"line_{end}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.filter(edit_distance(F.col("line_a"), F.col("line_b"), k) <= k)
    # Written down, only ids, so that the driver holds the plans of the comparison and of the rest one after the other.
    newer = near.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
    newer = stage(newer, "newer")
    marks = firsts.select("id", "first", "times").join(newer.withColumn("near", F.lit(True)), "id", "left")
    marks = marks.filter("near or times > 1").select("id", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = found.select("id", "doc_id", "line_no", "key").join(marks, "id")
    gone = gone.filter(F.col("near") | (F.struct("doc_id", "line_no", "key") != F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("gone"))


def deduplicate(docs: DataFrame, k: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: one row per row of `docs`."""
    gone = removed_lines(docs, k, min_chars)
    rows = _texts(docs).join(gone, ["doc_id", "key"], "left")
    every = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    rows = rows.select("doc_id", every.alias("every"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.when(F.size("gone") == 0, F.col("every")).otherwise(
        F.filter("every", lambda x, i: ~F.array_contains(F.col("gone"), i))
    )
    return rows.select(
        "doc_id",
        F.size("every").cast("long").alias("n_lines"),
        (F.size("every") - F.size(kept)).cast("long").alias("n_removed"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def keep_lines(docs: DataFrame, k: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with the remaining lines as text and their length as n_chars; documents of
    which nothing remains go. Other columns and texts without removals stay as they are."""
    key, content, gone, text = (fresh(docs, name) for name in ("gone_id", "gone_key", "gone_lines", "kept_text"))
    found = removed_lines(docs, k, min_chars)
    found = found.select(F.col("doc_id").alias(key), F.col("key").alias(content), F.col("gone").alias(gone))
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.join(found, (docs["doc_id"] == found[key]) & (own == found[content]), "left")
    changed = F.col(gone).isNotNull()
    rest = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    rows = rows.withColumn(text, F.when(changed, F.array_join(rest, "\n")).otherwise(F.col("text")))
    rows = rows.filter(~changed | (F.trim(text) != ""))
    chosen = {"text": F.col(text).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        size = F.when(changed, F.length(text)).otherwise(F.col("n_chars"))
        chosen["n_chars"] = size.cast(kind).alias("n_chars")
    return rows.select(*[chosen.get(c, F.col(c)) for c in docs.columns])
