"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Two lines within ``threshold`` edits share a segment: cut the shorter into
threshold + 1 segments, and one of them stands unchanged in the longer, near its
old place.  Each distinct line is indexed under its length and each of its own
segments, and probes the lengths it can match with the few substrings whose place
fits both the edits before and after them.  Most lines meet no other one and are
left out first, by their keys alone.  A pair that meets is dropped if the
counts of some letters differ too much, which the join itself checks; what is left
is verified by a bit-parallel edit distance within the band of the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD, MIN_CHARS, NEAR_CHARS = 2, 1, 10
LETTERS = "etaoinsrhldcumpgbfyvw"
#: Tasks that the copies of one line are dealt to where lines are looked up.
PARTS = 8
#: White space that counts as a space each: any but the line feed.
SPACES = "\t\r\x0b\x0c"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def segments(length: Column, k: int) -> list[tuple[Column, Column]]:
    """First position (from 0) and size of each of k + 1 even segments; the last ones take the remainder."""
    base, extra = F.floor(length / (k + 1)).cast("int"), (length % (k + 1)).cast("int")
    return [(base * i + F.greatest(F.lit(0), extra - (k + 1 - i)), base + (F.lit(i) >= k + 1 - extra).cast("int")) for i in range(k + 1)]


def keys(wide: Column, length: Column, k: int) -> tuple[list[Column], list[Column]]:
    """Keys under which a line is indexed, which it also probes; and those that it probes besides.

    wide: the line in four bytes a character, of which any part is at hand without
    walking to it.  Lines must be long enough for segments of more than k; those of
    a shorter line, which are probed alone, have k characters or one at least.
    """
    own, other = [], []
    for less in range(k + 1):
        shorter = length - less
        for i, (start, size) in enumerate(segments(shorter, k)):
            # edits before the segment are at most i, those after it at most k - i
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                key = F.xxhash64(shorter, F.lit(i), F.substring(wide, 4 * (start + shift) + 1, 4 * size))
                (own if not less and not shift else other).append(key)
    return own, other


def cut(text: Column) -> Column:
    """The lines of a text as they are compared: with a space for each white space, and none at the ends."""
    def compared(line: Column) -> Column:
        alike, some = line, F.lit(False)
        for c in SPACES:
            alike, some = F.replace(alike, F.lit(c), F.lit(" ")), some | F.contains(line, F.lit(c))
        return F.btrim(F.when(some, alike).otherwise(line))  # most lines need the look alone

    return F.transform(F.split(text, "\n"), compared)


def with_counts(rows: DataFrame, line: str, counts: str) -> DataFrame:
    """Counts of the letters of a line modulo 8, in three bits each, as a column more.

    The letters are taken out one after the other, the most frequent ones first, so
    that the rest soon gets short.
    """
    kept = rows.columns
    rows = rows.select(*kept, F.col(line).alias("_rest"), F.lit(0).alias("_size"), F.lit(0).cast("bigint").alias("_counts"))
    for n, letter in enumerate([*LETTERS, None]):
        # what the letter before this one took out
        taken = F.shiftleft(((F.col("_size") - F.octet_length("_rest")) % 8).cast("bigint"), 3 * (n - 1)) if n else F.lit(0).cast("bigint")
        rest = F.replace("_rest", F.lit(letter), F.lit("")) if letter else F.lit("")
        rows = rows.select(*kept, rest.alias("_rest"), F.octet_length("_rest").alias("_size"), F.col("_counts").bitwiseOR(taken).alias("_counts"))
    return rows.select(*kept, F.col("_counts").alias(counts))


def count_distance(a: Column, b: Column) -> Column:
    """A lower bound of the sum of differences of the letter counts.

    Ten letters at once: every second one, three bits of six each, so that nothing
    is borrowed or carried from one to the next.
    """
    lit = lambda x: F.lit(x).cast("bigint")
    ones = sum(1 << 6 * i for i in range(10))

    def part(n: int) -> Column:
        at = lambda x: F.shiftright(x, 3 * n).bitwiseAND(lit(7 * ones))

        def least(d: Column) -> Column:  # 8 - d in place of d from 4 on
            high = F.shiftright(d, 2).bitwiseAND(lit(ones))
            return d.bitwiseXOR(F.shiftleft(high, 3) - high) + high

        # the sum of the digits to the base 64, which is at most 40
        return least((at(a).bitwiseOR(lit(8 * ones)) - at(b)).bitwiseAND(lit(7 * ones))) % 63

    last = (F.shiftright(a, 60).bitwiseAND(F.lit(7)) - F.shiftright(b, 60).bitwiseAND(F.lit(7))).bitwiseAND(F.lit(7))
    return part(0) + part(1) + F.least(last, 8 - last)


def edits(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two strings, exact up to k and some larger value above it.

    A column of the alignment is 2k + 1 rows around the diagonal, as bits of one
    number: where the value rises by one from a row to the next, and where it
    falls.  From one column to the next the band moves down a row.  The distance
    is that of the start of the last cell's diagonal, and one more for each column
    in which that diagonal does not stay level.
    """
    width, full = 2 * k + 1, 2 ** (2 * k + 1) - 1
    lit = lambda x: F.lit(x).cast("bigint")
    masked = lambda x: x.bitwiseAND(lit(full))
    inverse = lambda x: masked(F.bitwise_not(x))
    p = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))

    def of(p: Column) -> Column:
        m, n = F.length(a), F.length(b)
        lean = (m - n).cast("int")

        def step(s: Column, j: Column) -> Column:
            # the diagonal never gets better: beyond k there is nothing left to find out
            return F.when(s["d"] > k, s).otherwise(moved(s, j))

        def moved(s: Column, j: Column) -> Column:
            def found(matches: Column) -> Column:
                def then(d0: Column) -> Column:
                    def shifted(t: Column) -> Column:
                        up, down = t["up"], t["down"]
                        return F.struct(
                            # the row that enters below rises over its neighbour
                            F.shiftright(masked(down.bitwiseOR(inverse(d0.bitwiseOR(up)))), 1).bitwiseOR(lit(1 << (width - 1))).alias("vp"),
                            F.shiftright(masked(up.bitwiseAND(d0)), 1).alias("vn"),
                            (s["d"] + F.when((j > -lean) & (d0.bitwiseAND(s["diagonal"]) == 0), 1).otherwise(0)).alias("d"),
                            s["diagonal"].alias("diagonal"),
                        )

                    up = masked(F.shiftleft(masked(s["vn"].bitwiseOR(inverse(d0.bitwiseOR(s["vp"])))), 1)).bitwiseOR(lit(1))
                    down = masked(F.shiftleft(d0.bitwiseAND(s["vp"]), 1))
                    return let(F.struct(up.alias("up"), down.alias("down")), shifted)

                sum_ = (matches.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
                return let(masked(sum_.bitwiseOR(matches).bitwiseOR(s["vn"])), then)

            here = F.get(p["b"], j - 1)
            matches = lit(0)
            for t in range(width):  # bit t is row j - k + t, from 1
                row = j - k + t - 1
                matches = matches.bitwiseOR(F.when((row >= 0) & (F.get(p["a"], row) == here), lit(1 << t)).otherwise(lit(0)))
            return let(matches, found)

        start = F.struct(
            lit(full & ~((1 << k) - 1)).alias("vp"),  # rows from 1 on rise; those above the text are level
            lit(0).alias("vn"),
            F.abs(lean).cast("int").alias("d"),
            F.call_function("shiftleft", lit(1), (lean + k).cast("int")).alias("diagonal"),
        )
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"])

    return F.when(F.abs(F.length(a) - F.length(b)) > k, k + 1).when((F.length(b) == 0) | (F.length(a) == 0), F.greatest(F.length(a), F.length(b))).otherwise(let(p, of))


def shared_start(a: Column, b: Column, steps: int = 16) -> Column:
    """Number of characters that two texts begin with alike, up to 2 ** steps, by bisection."""
    def longer(n: Column, step: Column) -> Column:
        at = n + step
        fits = (at <= F.length(a)) & (at <= F.length(b))
        return F.when(fits & (F.substring(a, F.lit(1), at) == F.substring(b, F.lit(1), at)), at).otherwise(n)

    return F.aggregate(F.array(*(F.lit(2**i) for i in reversed(range(steps)))), F.lit(0), longer)


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and copy tell documents apart; rows that agree in both are the same document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(common.id_order(F.col(f"`{id_col}`").cast("long")).alias("doc"), F.xxhash64(text).alias("copy"), cut(text).alias("lines"))


def tagged(lines: DataFrame, k: int, *also: str) -> tuple[DataFrame, list[str], list[str]]:
    """h and ``also`` with the keys of each line; names of those it is indexed under, and of all it probes."""
    wide = lines.select("h", *also, F.encode("line", "UTF-32").alias("wide")).withColumn("n", (F.octet_length("wide") / 4).cast("int"))
    own, other = keys(F.col("wide"), F.col("n"), k)
    names = [f"k{i}" for i in range(len(own) + len(other))]
    return wide.select("h", *also, *(c.alias(n) for c, n in zip(own + other, names))), names[: len(own)], names


def meeting(each: DataFrame, k: int) -> DataFrame:
    """Hashes, as h, of the lines that share a key with another line, one of the two as its own: no other line has a link.

    Most lines share none, so that letters need not be counted in them.  Rows are
    dealt out by key once and read twice, first for the keys that are shared; the
    work in a key grows with its rows, not with their pairs.
    """
    rows, own, names = tagged(each, k)
    # a task holds all its keys twice over, so there are more tasks than in other stages, and each stays small
    parts = 2 * int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("h", F.posexplode(F.array(*names)).alias("at", "key")).select("key", "h", (F.col("at") < len(own)).alias("own")).repartition(parts, "key")
    shared = dealt.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own")).filter("own and low <> high").select("key")
    # an inner join and all columns, so that both sides read the same exchange: a semi-join would be moved below it
    return dealt.join(shared.hint("shuffle_hash"), "key").groupBy("h").agg(F.max("own").alias("own"))


def near_lines(rows: DataFrame, k: int, least: int) -> DataFrame:
    """Lines within k edits of another, as (h, h2, n_links, gone): by how many, and whether an earlier one is among them.

    A line is earlier if its first document is; within one document the hash decides.
    """
    each = rows.select("doc", F.explode("lines").alias("line")).filter(F.length("line") >= least).withColumn("h", F.xxhash64("line"))
    # copies of a common line go to several tasks, by their documents
    wanted = common.staged(meeting(each, k), "meeting").select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"))
    distinct = each.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(PARTS))).join(wanted.hint("shuffle_hash"), ["h", "part"], "left_semi").groupBy("h", "line").agg(F.min("doc").alias("first"))
    distinct = common.staged(with_counts(distinct, "line", "counts"), "lines")
    keyed, own, names = tagged(distinct, k, "counts")
    index = keyed.select("h", "counts", F.explode(F.array(*own)).alias("key")).toDF("a", "a_counts", "key")
    probe = keyed.select("h", "counts", F.explode(F.array(*names)).alias("probe_key")).toDF("b", "b_counts", "probe_key")
    met = index.join(probe, (F.col("key") == F.col("probe_key")) & (F.col("a") != F.col("b")) & (count_distance(F.col("a_counts"), F.col("b_counts")) <= 2 * k))
    pairs = common.staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    side = lambda x: distinct.select(F.col("h").alias(x), F.col("line").alias(f"{x}_line"), F.col("first").alias(f"{x}_first"))
    rest = lambda x, same: F.substring(F.col(x), same + 1, F.length(x))
    # no edit is needed where two lines begin alike
    distance = let(shared_start(F.col("a_line"), F.col("b_line")), lambda same: edits(rest("a_line", same), rest("b_line", same), k))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(distance <= k)
    later = (F.col("a_first") > F.col("b_first")) | ((F.col("a_first") == F.col("b_first")) & (F.col("a") > F.col("b")))
    both = F.array(F.struct(F.col("a").alias("h"), F.xxhash64(F.lit(1), "a_line").alias("h2"), later.alias("gone")), F.struct(F.col("b").alias("h"), F.xxhash64(F.lit(1), "b_line").alias("h2"), (~later).alias("gone")))
    # hashes alone go on from here, a row for each line that has a link
    found = common.staged(near.select(F.explode(both).alias("x")).select("x.*"), "links")
    return found.groupBy("h", "h2").agg(F.count("*").alias("n_links"), F.max("gone").alias("gone"))


def marks(rows: DataFrame, k: int, least: int, near_least: int) -> DataFrame:
    """Per document: places of lines that go, and number of links of its lines."""
    near = near_lines(rows, k, near_least)
    at = rows.select("doc", "copy", F.posexplode("lines").alias("place", "line")).filter(F.length("line") >= least)
    at = common.staged(at.select("doc", "copy", "place", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")), "places")
    again = at.groupBy("h", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "h2", "first", F.lit(0).cast("bigint").alias("n_links"), F.lit(False).alias("gone"))
    lines = again.union(near.select("h", "h2", F.lit(common.NO_ID).alias("first"), "n_links", "gone")).groupBy("h", "h2").agg(F.min("first").alias("first"), F.max("n_links").alias("n_links"), F.max("gone").alias("gone"))
    lines = common.staged(lines, "known-lines")  # a table of its own, so that the join can split a common line
    found = at.join(lines, ["h", "h2"]).select("doc", "copy", F.struct("h", "h2", "place", (F.col("gone") | (F.col("first") < F.col("doc"))).alias("gone"), "n_links").alias("x"))
    # equal lines of a document are neighbours; all but the first of them go
    sets = found.groupBy("doc", "copy").agg(F.sort_array(F.collect_set("x")).alias("x"))
    before = lambda i: F.get(F.col("x"), i - 1)
    gone = F.transform("x", lambda x, i: F.when(x["gone"] | ((i > 0) & (before(i)["h"] == x["h"]) & (before(i)["h2"] == x["h2"])), x["place"]))
    return sets.select("doc", "copy", F.filter(gone, lambda i: i.isNotNull()).alias("gone"), F.aggregate("x", F.lit(0).cast("bigint"), lambda n, x: n + x["n_links"]).alias("n_links"))


def _deduped(docs: DataFrame, k: int, least: int, near_least: int, id_col: str, text_col: str) -> DataFrame:
    if not 0 <= k <= 15 or least < 1 or near_least <= k:
        raise ValueError("the threshold must be 0 to 15, min_chars 1 at least, and near_chars more than the threshold")
    since = len(common.paths())
    found = common.concluded(marks(prepared(docs, id_col, text_col), k, least, max(least, near_least)), "marks", since)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), common.id_order(F.col(f"`{id_col}`").cast("long")).alias("doc"), F.xxhash64(text).alias("copy"))
    # a text goes through this join once, and is cut into lines after it
    rows = rows.join(found, ["doc", "copy"], "left").withColumn("text", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    lines, none = F.split("text", "\n"), F.coalesce(F.size("gone"), F.lit(0)) == 0
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(none, F.col("text")).otherwise(let(lines, lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")))
    return rows.withColumn("kept", kept).withColumn("n_removed", F.when(none, 0).otherwise(F.size("gone")).cast("long"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text without its duplicate lines, as (doc_id, n_lines, n_removed, n_links, text).

    A line is what stands between line feeds, without white space at its ends and
    with a space for each other white space; one of nothing else always stays.
    A line goes if it is equal to an earlier one, in a document with a smaller id
    or before it in its own, or within ``threshold`` edits of a line that first
    stands in a document with a smaller id.  Lines under ``near_chars`` go for
    equal ones alone, as so many edits make another line of them; the join itself
    is exact for any line longer than the threshold.  Lines under ``min_chars``
    stay.  n_links counts, over the lines of the document, the different lines
    within the threshold.
    Rows that agree in id and text are one document and get the same result; a
    null id comes after all others; a null text counts as empty.  A very long text
    is cut into lines within a row, and a very long line is compared whole.  An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = _deduped(docs.select(f"`{id_col}`", f"`{text_col}`"), threshold, min_chars, near_chars, id_col, text_col)
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" " + SPACES))) > 0))
    return rows.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), n_lines.cast("long").alias("n_lines"), "n_removed", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("kept").alias("text"))


def texts(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the duplicate lines of each text left out, and all columns as they were.

    Lines go as in ``dedup``; a null text stays null, an empty one empty.
    """
    rows = _deduped(docs, threshold, min_chars, near_chars, id_col, text_col)
    return rows.select(*(F.when(F.col(f"row.`{c}`").isNotNull(), F.col("kept")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
