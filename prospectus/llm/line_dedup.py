"""Removal of near-equal lines by a segment-partition edit join, in native expressions only.

Lines of at least ``min_chars`` characters take part; two are linked when at most ``distance`` insertions, deletions and
replacements of characters turn one into the other. Equal lines are one from the start; shorter lines of ``exact_chars``
characters or more that are not blank take part where they are equal, and have no other links. Of all lines that links connect, the
first stays (by document id, then row of the scan, then line), in its place; the others go. Documents without an id come
last.

Join: a line is split into ``distance + 1`` segments. If two lines are within the distance, one segment of the shorter occurs
whole in the longer, near its own place. Segments are indexed under the line's length, the segment's number and its text; a
line probes the index for its own length and each shorter one in reach, at the few places where a match still leaves the rest
within the distance on both sides. Keys that one line alone has are dropped where they meet; the lines of the others are
verified as a condition of the join, so pairs that are not links are never emitted, however many variants of a line share a
segment. Rows are counted by ``BUCKETS`` remainders of their key first: where one holds a crowd, its keys are counted by map-side
aggregation and joined back, which Spark splits; the others meet in a window. Either way gives the same rows.

Verification: common beginnings and ends are cut off; the rest runs through a banded, bit-parallel edit automaton: for each
number of edits, one word holds the diagonals of the band that can be reached, and a character moves all of them at once.

Texts are never cut. Null texts stay null, empty ones have no line of the least length. A row that repeats another loses its
lines to the first. An empty table stays empty. Rows are numbered by the scan: the input must be a table read from files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectus.llm.common import components, cut, stored

MIN_CHARS, DISTANCE = 20, 2
MARKS = 1 << 20
#: Remainders of keys by which their rows are counted, and the rows that one may hold at least before it counts as crowded.
BUCKETS, CROWD = 1 << 16, 1_000_000
_LAST = 2**63 - 1


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def probe_places(distance: int) -> list[tuple[int, int, int]]:
    """(characters longer than the indexed line, segment, shift against the indexed place) of all substrings to look up.

    Before segment i there are at most i edits, after it at most distance - i: otherwise another segment matches as well.
    """
    return [
        (longer, number, shift)
        for longer in range(distance + 1)
        for number in range(distance + 1)
        for shift in range(-distance, 2 * distance + 1)
        if abs(shift) <= number and abs(shift - longer) <= distance - number
    ]


def segment_keys(lines: DataFrame, distance: int) -> DataFrame:
    """``key`` and ``holder`` for each segment and probe of ``lines`` (``line_id``, ``line``).

    The holder is the line's id, its lowest bit telling whether the key is one of the line's own segments: these are what
    the index holds, and are looked up as well.
    """
    places = F.array(*[F.struct(*[F.lit(x) for x in place]) for place in probe_places(distance)])
    each = lines.select("line_id", "line", F.length("line").alias("chars"), F.explode(places).alias("p"))
    longer, number, shift = F.col("p.col1"), F.col("p.col2"), F.col("p.col3")
    pieces = distance + 1
    indexed = (F.col("chars") - longer).alias("indexed")
    each = each.select("line_id", "line", "chars", indexed, number.alias("number"), shift.alias("shift"), ((longer == 0) & (shift == 0)).alias("own"))
    short = F.floor(F.col("indexed") / pieces).cast("int")
    ahead = F.greatest(F.col("number") - (pieces - (F.col("indexed") - short * pieces)), F.lit(0))  # longer segments come last
    size = short + F.when(pieces - (F.col("indexed") - short * pieces) <= F.col("number"), 1).otherwise(0)
    place = short * F.col("number") + ahead + 1 + F.col("shift")
    fits = (short >= 1) & (place >= 1) & (place + size - 1 <= F.col("chars"))
    key = F.xxhash64("number", "indexed", F.substring(F.col("line"), place, size))
    holder = F.shiftleft(F.shiftright("line_id", 1), 1).bitwiseOR(F.col("own").cast("long"))
    return each.where(fits).select(key.alias("key"), holder.alias("holder"))


def common_start(a: Column, b: Column) -> Column:
    """Number of first characters that are the same, by halving steps."""
    steps = F.lit([1 << i for i in range(20, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    # lines of over 2 million characters have the rest of a longer start compared by the automaton
    return F.aggregate(
        steps,
        F.lit(0),
        lambda known, step: F.when((known + step <= most) & (F.substring(a, known + 1, step) == F.substring(b, known + 1, step)), known + step).otherwise(known),
    )


def within_distance(a: Column, b: Column, distance: int) -> Column:
    """Whether at most ``distance`` (4 at most) edits turn ``a`` into ``b``."""
    width = 2 * distance + 1
    mask = (1 << width) - 1
    if not 0 <= distance <= 4:
        raise ValueError("the band's words fit one long for a distance of 0 to 4")

    def trimmed(pair: Column) -> Column:
        return bound(common_start(pair["a"], pair["b"]), lambda n: F.struct(F.substring(pair["a"], n + 1, F.length(pair["a"])).alias("a"), F.substring(pair["b"], n + 1, F.length(pair["b"])).alias("b")))

    def reversed_pair(pair: Column) -> Column:
        return F.struct(F.reverse(pair["a"]).alias("a"), F.reverse(pair["b"]).alias("b"))

    def closed(reach: list[Column]) -> Column:
        """The words of 0, 1, ... edits side by side in one long."""
        packed = reach[0]
        for edits, word in enumerate(reach[1:], 1):
            packed = packed.bitwiseOR(F.shiftleft(word, edits * width))
        return packed

    def opened(packed: Column) -> list[Column]:
        return [F.shiftright(packed, edits * width).bitwiseAND(mask) for edits in range(distance + 1)]

    first = 1 << distance  # the middle bit: as many characters of either line
    start = sum(((sum(first << i for i in range(edits + 1))) & mask) << (edits * width) for edits in range(distance + 1))

    def moved(packed: Column, same: Column) -> Column:
        """All diagonals moved by one character of b; ``same``: those on which a has this character next."""
        before, after = opened(packed), []
        for edits, word in enumerate(before):
            now = word.bitwiseAND(same)
            if edits:
                fewer = before[edits - 1]
                now = now.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(after[edits - 1], 1).bitwiseAND(mask))
            after.append(now)
        return closed(after)

    def run(chars: Column) -> Column:
        """Edit automaton over the characters of b; 0 when no diagonal is left."""

        def step(packed: Column, at: Column) -> Column:
            same = F.lit(0).cast("long")
            for d in range(width):
                hit = F.get(chars["padded"], at + d) == F.get(chars["b"], at)
                same = same.bitwiseOR(F.when(hit, F.lit(1 << d)).otherwise(F.lit(0)).cast("long"))
            return F.when(packed == 0, packed).otherwise(bound(same, lambda mark: moved(packed, mark)))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars["b"]) - 1), F.lit(start).cast("long"), step)

    def measured(pair: Column) -> Column:
        gap = F.length(pair["a"]) - F.length(pair["b"])
        letters = F.split(pair["b"], "")
        sentinel = F.array(*[F.lit("")] * distance)
        chars = F.struct(letters.alias("b"), F.concat(sentinel, F.split(pair["a"], ""), sentinel, sentinel).alias("padded"))
        reach = bound(chars, run)
        last = F.shiftright(reach, distance * width).bitwiseAND(mask)
        short = F.least(F.length(pair["a"]), F.length(pair["b"])) == 0
        accepted = last.bitwiseAND(F.element_at(F.array(*[F.lit(1 << d) for d in range(width)]), gap + distance + 1)) != 0
        return F.when(F.abs(gap) > distance, F.lit(False)).when(short, F.lit(True)).otherwise(accepted)

    pair = F.struct(a.alias("a"), b.alias("b"))
    ends = bound(bound(pair, trimmed), reversed_pair)
    return bound(bound(ends, trimmed), measured)


def distinct_lines(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """Lines that take part: ``line_id``, ``hash_a``, ``hash_b``, ``line``, ``doc`` (first document) and ``n`` (times it occurs).

    ``line_id`` is an even number of the row, no hash, and differs between lines. It holds once the rows are stored.
    """
    found = participating(docs, min_chars, exact_chars).groupBy("line").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    return found.select(F.shiftleft(F.monotonically_increasing_id(), 1).alias("line_id"), *line_hashes(), "line", "doc", "n")


def participating(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """``row``, ``doc``, ``at`` (from 0) and ``line`` of each line of at least ``min_chars`` characters, and of each shorter one
    of at least ``exact_chars`` that is not blank."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc, "text")  # numbered before lines are taken apart
    lines = rows.select("row", "doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    long = F.length("line") >= min_chars
    return lines.where(long if exact_chars is None else long | ((F.length("line") >= exact_chars) & F.col("line").rlike(r"(?U)\S")))


def line_hashes() -> list[Column]:
    """Two independent hashes of 64 bits, which together stand for the line where its text need not travel."""
    return [F.xxhash64("line").alias("hash_a"), F.xxhash64(F.lit(7), "line").alias("hash_b")]


def among(places: DataFrame, size: int) -> Callable[[Column], Column]:
    """A condition on numbers below ``size`` that holds for those in ``places`` (``place``): one bit for each number."""
    piece, bit = F.bitmap_bucket_number(F.col("place") + 1), F.bitmap_bit_position(F.col("place") + 1)
    bits = bytearray(size // 8)
    for row in places.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():  # size / 32,768 rows
        bits[(row["piece"] - 1) * 4096 : row["piece"] * 4096] = row["bits"]

    def is_in(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(bytes(bits)), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    return is_in


def marked(ids: DataFrame) -> Column:
    """A condition on ``line_id`` that holds for all ids in ``ids``, and for a few others.

    It spares the join that follows most rows it has no use for. The bits are ``MARKS`` whatever the table's size; where
    nearly all are set, the condition just lets all rows pass.
    """
    place = F.pmod(F.xxhash64("line_id"), F.lit(MARKS))
    return among(ids.select(place.alias("place")), MARKS)(place)


def shared_keys(keys: DataFrame, crowd: int) -> DataFrame:
    """Rows of ``keys`` (``key``, ``holder``) whose key several lines have and one at least has in the index.

    A remainder of the keys is crowded with over ``crowd`` rows and over four times the mean, so at most a quarter of them are.
    Only the number of rows at each decides which way its rows take.
    """
    bucket = F.pmod("key", F.lit(BUCKETS))
    facts = {"indexed": F.count_if(F.col("holder").bitwiseAND(1) == 1), "least": F.min("holder"), "most": F.max("holder")}
    alive = (F.col("indexed") > 0) & (F.shiftright("least", 1) != F.shiftright("most", 1))

    def windowed(rows: DataFrame) -> DataFrame:
        key = Window.partitionBy("key")
        return rows.withColumns({name: fact.over(key) for name, fact in facts.items()}).where(alive).select("key", "holder")

    sizes = cut(keys.groupBy(bucket.alias("place")).agg(F.count("*").alias("n")))  # BUCKETS rows at most
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    least = max(crowd, 4 * (total or 0) // BUCKETS)
    if (largest or 0) <= least:
        return windowed(keys)
    crowded = among(sizes.where(F.col("n") > least), BUCKETS)(bucket)
    met = keys.where(crowded).groupBy("key").agg(*[fact.alias(name) for name, fact in facts.items()]).where(alive)
    return windowed(keys.where(~crowded)).unionByName(keys.where(crowded).join(met.select("key"), "key", "left_semi"))


def near_lines(lines: DataFrame, distance: int, crowd: int = CROWD) -> DataFrame:
    """Links ``a``, ``b`` (line ids) between different ``lines`` (``line_id``, even, and ``line``) within ``distance`` edits."""
    shared = shared_keys(segment_keys(lines, distance), crowd)
    own = F.col("holder").bitwiseAND(1) == 1
    alive = cut(shared.select("key", F.shiftleft(F.shiftright("holder", 1), 1).alias("line_id"), own.alias("own")))
    wanted = alive.select("line_id").distinct()
    texts = lines.select("line_id", "line").where(marked(wanted)).join(wanted, "line_id")
    held = cut(alive.join(texts, "line_id"))
    index = held.where("own").select("key", F.col("line_id").alias("a"), F.col("line").alias("x"))
    probes = held.select("key", F.col("line_id").alias("b"), F.col("line").alias("y"))
    # of two lines of one length either finds the other under the same key: one direction is enough
    once = (F.length("x") < F.length("y")) | ((F.length("x") == F.length("y")) & (F.col("a") < F.col("b")))
    near = F.length("y") - F.length("x") <= distance
    verified = within_distance(F.col("x"), F.col("y"), distance)
    return index.join(probes, (index["key"] == probes["key"]) & once & near & verified).select("a", "b").distinct()


def line_classes(docs: DataFrame, min_chars: int = MIN_CHARS, distance: int = DISTANCE, exact_chars: int | None = None) -> DataFrame:
    """Lines that occur more than once or are linked: ``hash_a``, ``hash_b``, ``class_id`` and ``owner`` (first document
    of the class)."""
    if min_chars <= distance:
        raise ValueError("lines need a character for each segment: min_chars must be over distance")
    lines = stored(distinct_lines(docs, min_chars, exact_chars))
    groups = components(near_lines(lines.where(F.length("line") >= min_chars), distance)).withColumnsRenamed({"node": "line_id", "component": "class_id"})
    narrow = lines.select("line_id", "hash_a", "hash_b", "doc", "n").join(groups, "line_id", "left").where("n > 1 or class_id is not null")
    classed = cut(narrow.select("hash_a", "hash_b", "doc", F.coalesce("class_id", "line_id").alias("class_id")))
    owners = classed.groupBy("class_id").agg(F.min("doc").alias("owner"))
    return classed.drop("doc").join(owners, "class_id")


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, distance: int = DISTANCE, exact_chars: int | None = None) -> DataFrame:
    """``row`` (of the scan) and ``lines`` (places, from 0) that go from it."""
    classes = line_classes(docs, min_chars, distance, exact_chars)
    places = participating(docs, min_chars, exact_chars).select("row", "doc", "at", *line_hashes()).join(classes, ["hash_a", "hash_b"])
    places = cut(places.select("row", "doc", "at", "class_id", "owner"))
    owned = places.where("doc = owner").select("class_id", F.struct("row", "at").alias("place"))
    firsts = owned.groupBy("class_id").agg(F.min("place").alias("first"))  # documents without an id are one owner
    later = owned.join(firsts, "class_id").where("place <> first").select("place.row", "place.at")
    gone = places.where("doc <> owner").select("row", "at").unionByName(later)
    return gone.groupBy("row").agg(F.collect_list("at").alias("lines"))  # at most the lines of one document


def without_near_lines(docs: DataFrame, min_chars: int = MIN_CHARS, distance: int = DISTANCE, exact_chars: int | None = None) -> DataFrame:
    """``docs`` without the later ones of near-equal lines, and with ``removed_lines``, their number.

    With ``exact_chars``, the later ones of equal shorter lines go as well. Every row stays, with what is left of its text. A column named ``removed_lines`` in ``docs`` is replaced.
    """
    gone = removed_lines(docs, min_chars, distance, exact_chars).select(F.col("row").alias("__row"), F.col("lines").alias("__lines"))
    rows = docs.drop("removed_lines").withColumn("__row", F.monotonically_increasing_id()).join(gone, "__row", "left")
    # by place: the time is in proportion to the lines of a text, however many of them go
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__lines"))
    left = bound(F.split("text", "\n"), lambda parts: F.array_join(F.transform(stay(parts), lambda at: F.get(parts, at)), "\n"))
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(left)
    out = rows.withColumns({"text": text, "removed_lines": F.coalesce(F.size("__lines"), F.lit(0))})
    return out.withColumn("removed_lines", F.greatest("removed_lines", F.lit(0))).drop("__row", "__lines")
