"""Homomorphic multiset hash of paragraphs (operator 6), in DataFrame functions alone.

A text is the multiset of its pieces (paragraphs, cut further after the marks that
end sentences and clauses; the marks stay with them: many texts are one paragraph, of which whole paragraphs tell nothing).
Every piece hashes to a wide vector, each long of it under a seed of its own, and a text's fingerprint is the sum of its pieces' vectors:

* 4 identity lanes, each a 32-bit hash, summed modulo 2^32;
* 128 likeness lanes, each a hash bit, summed modulo 2^30; and the number of pieces.

Sums make it independent of order and homomorphic: ``added`` and ``removed``
insert and delete a text's pieces without the rest of the text. Equal multisets
have equal lanes. With a set bit read as +1 and a clear one as -1, the inner product of two
texts' likeness lanes estimates how many pieces they share, so their cosine, cut
at 0, is the likeness (standard error about 0.09); equal fingerprints have 1.

Two likeness lanes of 31 bits share a long, so one addition serves both. Runs of up to
127 pieces are summed in lanes of 8 bits first, eight to a long, and then widened.

The next document in ascending doc_id order is found without a global window:
rows fall into ranges of (doc_id, text hash) between quantiles of a sample of keys, so ranges are about equal
wherever the ids lie; each range's first row also goes to the
range before it, as a guest (the very first one to the last range), and ``lead`` runs
inside ranges. Texts are shuffled once. Ranges number 65,536 at most, so the
table of their first rows is bounded and broadcast.

Defined results: a null text is empty and has one empty piece; null doc_ids come
first; equal doc_ids are ordered by text hash, and rows alike in both stand side
by side, in one range; a lone row is its own next; a very long text has the same lanes, which hold 2^30 pieces
without wrapping; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of a piece for identity (two lanes each) and for likeness (64 lanes each).
IDENTITY, LIKENESS = 2, 2
PACKED = 32 * LIKENESS
LANES = 64 * LIKENESS
#: After a line break or a mark that ends a sentence or clause; a mark and a line break after it are one end.
PIECE = r"(?<=\n)|(?<=[.,;:!?])(?!\n)"
ONES = 1 | 1 << 31
KEPT = ONES * 0x3FFFFFFF
LOW = 0xFFFFFFFF
LEAST = -(1 << 63)
#: The lowest bit of each of a long's eight 8-bit lanes, and how many pieces fit them without a carry into the sign.
NARROW, RUN = 0x0101010101010101, 127


def _folded(total: Column, more: Column, sign: int) -> Column:
    """Lane-wise sum (or difference) of two fingerprints, each lane modulo its power."""
    out = []
    for k in range(2 * IDENTITY + PACKED + 1):
        a, b = F.get(total, k), F.get(more, k)
        if k < 2 * IDENTITY:
            out.append((a + b if sign > 0 else a + F.lit(LOW + 1) - b).bitwiseAND(F.lit(LOW)))
        elif k == 2 * IDENTITY + PACKED:
            out.append(a + b if sign > 0 else a - b)
        elif sign > 0:
            out.append((a + b).bitwiseAND(F.lit(KEPT)))
        else:
            out.append((a.bitwiseOR(F.lit(ONES << 30)) - b).bitwiseAND(F.lit(KEPT)))
    return F.array(*out)


def _bound(total: Column, more: Column, sign: int) -> Column:
    """``_folded`` with both sides evaluated once, so that sums of sums do not copy their expressions."""
    both = F.array(F.struct(total.alias("a"), more.alias("b")))
    return F.get(F.transform(both, lambda x: _folded(x["a"], x["b"], sign)), 0)


def added(total: Column, more: Column) -> Column:
    """The fingerprint after the pieces of ``more`` are inserted."""
    return _bound(total, more, 1)


def removed(total: Column, less: Column) -> Column:
    """The fingerprint after the pieces of ``less`` are deleted."""
    return _bound(total, less, -1)


def fingerprint(text: Column, piece: str = PIECE) -> Column:
    """The lanes of a text as array<bigint>: identity, packed likeness, number of pieces."""
    hashes = F.transform(
        F.split(F.coalesce(text, F.lit("")), piece),
        lambda p: F.array(*[F.xxhash64(F.lit(k), p) for k in range(IDENTITY + LIKENESS)]),
    )

    longs = 2 * IDENTITY + 8 * LIKENESS

    def narrow(total: Column, h: Column) -> Column:
        wide = [F.get(h, k) for k in range(IDENTITY + LIKENESS)]
        lanes = [x for w in wide[:IDENTITY] for x in (w.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(w, 32))]
        lanes += [F.shiftrightunsigned(w, k).bitwiseAND(F.lit(NARROW)) for w in wide[IDENTITY:] for k in range(8)]
        return F.array(*[F.get(total, k) + lane for k, lane in enumerate(lanes)])

    def widened(run: Column) -> Column:
        """Lanes of a run of pieces: likeness bit b is counted in byte b // 8 of long b % 8."""
        sums = F.aggregate(run, F.array_repeat(F.lit(0).cast("long"), longs), narrow)

        def lanes(total: Column) -> Column:
            bit = lambda hash_, b: F.shiftright(F.get(total, 2 * IDENTITY + 8 * hash_ + b % 8), 8 * (b // 8)).bitwiseAND(F.lit(0xFF))
            packed = [bit(x, m) + F.shiftleft(bit(x, m + 32), 31) for x in range(LIKENESS) for m in range(32)]
            exact = [F.get(total, k).bitwiseAND(F.lit(LOW)) for k in range(2 * IDENTITY)]
            return F.array(*exact, *packed, F.size(run).cast("long"))

        return F.get(F.transform(F.array(sums), lanes), 0)  # bound once, not once a lane

    zero = F.array_repeat(F.lit(0).cast("long"), 2 * IDENTITY + PACKED + 1)
    starts = lambda h: F.sequence(F.lit(1), F.size(h), F.lit(RUN))
    runs = lambda h: F.transform(starts(h), lambda i: widened(F.slice(h, i, F.lit(RUN))))
    per_text = F.get(F.transform(F.array(hashes), runs), 0)
    # One run is the sum already; more are folded together.
    return F.get(F.transform(F.array(per_text), lambda r: F.when(F.size(r) == 1, F.get(r, 0)).otherwise(F.aggregate(r, zero, lambda a, b: _folded(a, b, 1)))), 0)


def _signed(lanes: Column) -> Column:
    """Likeness lanes as +1/-1 sums."""
    pieces = F.get(lanes, F.lit(2 * IDENTITY + PACKED))
    packed = F.slice(lanes, 2 * IDENTITY + 1, PACKED)
    at = lambda shift: F.transform(packed, lambda x: (F.shiftright(x, shift).bitwiseAND(F.lit(0x3FFFFFFF)) * 2 - pieces).cast("double"))
    return F.concat(at(0), at(31))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated share of common pieces of two fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    x, y = _signed(a), _signed(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at most (doc_id, h), by binary search in two constant arrays."""
    if not bounds:
        return F.lit(0)
    ids, hs = (F.split(F.lit(",".join(str(b[k]) for b in bounds)), ",").cast("array<bigint>") for k in (0, 1))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, more: Column) -> Column:
        id_, h = F.get(ids, at + more - 1), F.get(hs, at + more - 1)
        return F.when((id_ < key) | ((id_ == key) & (h <= F.col("h"))), at + more).otherwise(at)  # beyond the end: null

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def range_bounds(docs: DataFrame, rows_a_range: int, most_ranges: int, a_range: int = 8) -> list[tuple[int, int]]:
    """Keys (doc_id, h) that cut ``docs`` into about equal ranges, from a sample of ``a_range`` keys for each."""
    n = docs.count()
    ranges = min(most_ranges, -(-n // rows_a_range))
    if ranges < 2:
        return []
    share = min(1 << 30, int((1 << 30) * a_range * ranges / n) + 1)
    some = docs.select("doc_id", "h").filter(F.pmod(F.xxhash64(F.lit(11), "doc_id", "h"), F.lit(1 << 30)) < share)
    keys = some.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("k")).collect()  # a key that many rows share counts once
    keys = sorted((LEAST if r.doc_id is None else r.doc_id, r.h, r.k) for r in keys)
    bounds, at, want = [], 0, sum(k for *_, k in keys) / ranges
    for id_, h, k in keys:
        if at >= want * (len(bounds) + 1):
            bounds.append((id_, h))
        at += k
    return bounds


def with_next(docs: DataFrame, carried: list[str], rows_a_range: int = 1024, most_ranges: int = 65536) -> DataFrame:
    """``docs(doc_id, h, ...)`` with ``next_<name>`` for each carried column, of the next row by (doc_id, h), the last row's being the first's."""
    ranged = docs.withColumn("range", _range_of(range_bounds(docs, rows_a_range, most_ranges)))

    own = F.struct(F.col("doc_id").alias("id"), F.col("h").alias("h"))
    firsts = ranged.groupBy("range").agg(F.min(own).alias("first"))
    order = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    firsts = firsts.select(F.col("range").alias("of"), "first", F.coalesce(F.lag("range").over(order), last).alias("before"))
    placed = ranged.join(F.broadcast(firsts), F.col("range") == F.col("of"))
    place = lambda r, guest: F.struct(F.col(r).alias("range"), F.lit(guest).alias("guest"))
    places = F.when(own.eqNullSafe(F.col("first")), F.array(place("range", False), place("before", True))).otherwise(F.array(place("range", False)))
    placed = placed.withColumn("place", F.explode(places)).select("doc_id", "h", *carried, "place.range", "place.guest")
    row = Window.partitionBy("range").orderBy("guest", "doc_id", "h")
    return placed.withColumns({f"next_{c}": F.lead(c).over(row) for c in carried}).filter(~F.col("guest")).drop("range", "guest", "h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with its fingerprint, its edited text and that text's fingerprint, and both likenesses.

    The edited text: the last half (rounded down) of the code points, replaced by as many first ones of the next document.
    """
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = body.withColumn("h", F.xxhash64("text")).withColumn("lanes", fingerprint(F.col("text")))
    both = with_next(body, ["text", "lanes"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_lanes", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", "text", "edited", "lanes", "edited_lanes",
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
