"""Line deduplication with a segment-partition edit join (DataFrame operations only).

Two lines within ``edits`` edits agree in at least one of ``edits`` + 1 segments of the shorter one. Distinct lines are indexed by (length,
segment number, segment); each line probes the lengths that it may match with the substrings that can align with each segment
(both the left and the right side must be able to spend their edits). A match is verified by the banded bit-parallel edit distance.

Lines are cut as UTF-32, where a character's place is known without reading what is before it. An edit takes at most two pairs of neighbouring
characters away and brings two, so lines whose parities of 128 classes of such pairs differ in more than four times the edits can't match and aren't paired.

The edit distance keeps the vertical differences of one column of the distance table, 2 * ``edits`` + 1 rows about the diagonal, as the bits
of two integers, and follows the diagonal that ends at both lines' ends. Values never fall along a diagonal, so the first and the
last ``ENDS`` characters that differ are tried before the rest.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._store import stored, stored_at

#: Characters at either end, where lines begin to differ, that are tried before all that differs.
ENDS = 16
#: Ids up to this many are broadcast to find their lines; beyond it lines and ids are shuffled.
MOST_BROADCAST = 400_000


def _entries(edits: int, probing: bool) -> list[Column]:
    """Keys of a line's segments, or of the other substrings with which it probes; null where one doesn't fit.

    Segment ``i`` of a length is its even part, the longer segments last. Needs columns n (characters) and u (UTF-32 bytes).
    """
    parts, out = edits + 1, []
    for shorter in range(edits + 1 if probing else 1):
        m = F.col("n") - shorter
        base, rest = F.expr(f"(n - {shorter}) div {parts}"), F.expr(f"(n - {shorter}) % {parts}")
        for i in range(parts):
            start = base * i + F.greatest(F.lit(0), F.lit(i - parts) + rest)
            size = base + (F.lit(i - parts) + rest >= 0).cast("long")
            low, high = (max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))) if probing else (0, 0)
            for shift in range(low, high + 1):
                if probing and shorter == shift == 0:
                    continue  # a line's own segment, which is indexed
                at = start + shift
                piece = F.substring("u", (4 * at + 1).cast("int"), (4 * size).cast("int"))
                out.append(F.when((m >= parts) & (at >= 0) & (at + size <= F.col("n")), F.xxhash64(m, F.lit(i), piece)))
    return out


def _met(lines: DataFrame, edits: int) -> DataFrame:
    """Rows (key, id, probe, n) of the keys at which a line's segment meets another line's segment or probe; n: lines indexed there.

    Segments and probes are made in one pass and shuffled once. A line's segment is its probe for lines of its length too, so that one row stands for both (``probe`` false).
    """
    wide = lines.select("id", F.char_length("s").cast("long").alias("n"), F.encode("s", "UTF-32").alias("u"))
    # One array of plain numbers, segments first. A line that has a key twice, as periodic ones do, has two rows there.
    keys = F.array(*_entries(edits, False), *_entries(edits, True))
    rows = wide.select("id", F.posexplode(keys).alias("at", "key")).where("key is not null").select("key", "id", (F.col("at") > edits).alias("probe"))
    here = Window.partitionBy("key")
    rows = rows.withColumn("n", F.sum((~F.col("probe")).cast("int")).over(here)).withColumn("both", F.count(F.lit(1)).over(here))
    return rows.where("n > 0 and both > 1").select("key", "id", "probe", "n")


def _parities(s: Column) -> Column:
    """Two longs: a bit for each of 128 classes of pairs of neighbouring characters, by their hash, whether the line has an odd number of them."""
    chars = F.split(s, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda x, y: F.pmod(F.hash(x, y), F.lit(128)))
    none, bit = F.lit(0).cast("long"), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return F.aggregate(
        pairs, F.struct(none.alias("low"), none.alias("high")),
        lambda bits, k: F.struct(bits["low"].bitwiseXOR(F.when(k < 64, bit(k)).otherwise(none)).alias("low"), bits["high"].bitwiseXOR(F.when(k >= 64, bit(k - 64)).otherwise(none)).alias("high")),
    )


def _spent(x: Column, y: Column, extra: Column, edits: int) -> Column:
    """Value at the last column of ``y`` of the diagonal that starts ``extra`` rows down; exact up to ``edits``.

    ``x`` and ``y`` are arrays of characters, ``x`` the longer by ``extra`` or, for the ends of lines, any that covers the band. Bit ``d`` of a
    column ``j`` (from 0) is character ``j`` - ``edits`` + ``d`` of ``x``.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1)

    def matches(c: Column, j: Column) -> Column:
        bits = [F.when(F.get(x, j + (d - edits)) == c, 1 << d).otherwise(0) for d in range(width)]
        return sum(bits[1:], bits[0])

    def column(at: Column, match: Column) -> Column:
        rises, falls = at["rises"], at["falls"]
        same = (match.bitwiseAND(rises) + rises).bitwiseXOR(rises).bitwiseOR(match).bitwiseOR(falls)  # equal to the diagonal neighbour
        right = falls.bitwiseOR(F.bitwise_not(same.bitwiseOR(rises)))
        below = F.shiftright(same.bitwiseAND(full), 1)  # the band goes down by a row
        return F.struct(
            same.bitwiseAND(rises).bitwiseOR(F.bitwise_not(below.bitwiseOR(right))).bitwiseAND(full).alias("rises"), below.bitwiseAND(right).alias("falls"),
            (at["spent"] + 1 - F.getbit(same, extra + edits)).cast("int").alias("spent"),
        )

    start = F.struct(F.lit((1 << width) - (1 << edits)).alias("rises"), F.lit(0).alias("falls"), extra.alias("spent"))
    return F.aggregate(F.transform(y, matches), start, column, lambda at: at["spent"])


def _common(x: str, y: str, most: Column, tail: bool) -> Column:
    """Characters that two UTF-32 texts share at their start, or their end; at most ``most``. Pieces of halving sizes are compared whole."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), F.lit(30) - k))
    sizes = F.filter(sizes, lambda k: k <= most)

    def piece(u: Column, have: Column, k: Column) -> Column:
        at = F.octet_length(u) - 4 * (have + k) + 1 if tail else 4 * have + 1
        return F.substring(u, at, 4 * k)

    return F.aggregate(sizes, F.lit(0), lambda have, k: have + F.when((have + k <= most) & (piece(F.col(x), have, k) == piece(F.col(y), have, k)), k).otherwise(0))


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """(a, b, near boolean): whether lines a_s and b_s are within ``edits`` edits.

    What both share at their ends doesn't count and is cut off first; of what is left the first and last ``ENDS`` characters are tried before the whole.
    Store the result before filtering by ``near``: a filter would be pushed below the arrays, which were then cut anew for every character.
    """
    if not 0 <= edits <= 15:
        raise ValueError("edits must be from 0 to 15")
    swap = F.char_length("a_s") < F.char_length("b_s")
    wide = pairs.select("a", "b", *(F.encode(F.when(swap, F.col(p)).otherwise(F.col(q)), "UTF-32").alias(n) for n, p, q in (("u", "b_s", "a_s"), ("v", "a_s", "b_s"))))
    short = (F.octet_length("v") / 4).cast("int")
    cut = wide.withColumn("start", _common("u", "v", short, False))
    cut = cut.withColumn("end", _common("u", "v", short - F.col("start"), True))
    middle = lambda c: F.substring(c, 4 * F.col("start") + 1, F.octet_length(c) - 4 * (F.col("start") + F.col("end")))
    mid = cut.select("a", "b", middle("u").alias("u"), middle("v").alias("v"), ((F.octet_length("u") - F.octet_length("v")) / 4).cast("int").alias("extra"))
    chars = lambda u: F.split(F.decode(u, "UTF-32"), "")
    head = lambda c, k: chars(F.substring(c, 1, 4 * k))
    tail = lambda c, k: F.reverse(chars(F.substring(c, F.greatest(F.octet_length(c) - (4 * k - 1), F.lit(1)), F.lit(4 * k))))
    ends = mid.select("*", head("u", ENDS + 2 * edits).alias("x_start"), head("v", ENDS).alias("y_start"), tail("u", ENDS + 2 * edits).alias("x_end"), tail("v", ENDS).alias("y_end"))
    spent = lambda x, y: _spent(x, y, F.col("extra"), edits)
    far = (spent(F.col("x_start"), F.col("y_start")) > edits) | (spent(F.col("x_end"), F.col("y_end")) > edits)
    near = F.when(F.col("extra") > edits, False).when(F.octet_length("v") == 0, True).when(far, False).when(F.octet_length("v") <= 4 * ENDS, True)
    return ends.select("a", "b", near.otherwise(spent(chars(F.col("u")), chars(F.col("v"))) <= edits).alias("near"))


def _with_lines(ids: DataFrame, name: str, lines: DataFrame, few: bool) -> DataFrame:
    """``ids`` with the text of the line that column ``name`` has, as ``name``_s."""
    text = lines.select(F.col("id").alias(name), F.col("s").alias(f"{name}_s"))
    if few:  # the side that is broadcast has at most MOST_BROADCAST ids
        text = text.join(F.broadcast(ids.select(name).distinct()), name, "left_semi")
    return ids.join(text, name)


def candidates(lines: DataFrame, edits: int, most: int = 1) -> DataFrame:
    """Pairs (a, b) of lines that may be within ``edits`` edits.

    Of the lines at a key that more than ``most`` lines have only those are paired whose parities differ in at most four times the edits.
    """
    met = stored(_met(lines, edits), "met")
    ids = stored(met.where(F.col("n") > most).select("id").distinct(), "busy-ids")
    few = ids.count() <= MOST_BROADCAST
    marked = stored(_with_lines(ids, "id", lines, few).select("id", _parities(F.col("id_s")).alias("bits")), "busy-parities")
    rows = met.join(marked, "id", "left")
    x = rows.where("not probe").select("key", "n", F.col("id").alias("a"), F.col("bits").alias("a_bits"))
    y = rows.select("key", F.col("id").alias("b"), F.col("bits").alias("b_bits"))
    apart = F.bit_count(F.col("a_bits.low").bitwiseXOR(F.col("b_bits.low"))) + F.bit_count(F.col("a_bits.high").bitwiseXOR(F.col("b_bits.high")))
    near = (F.col("n") <= most) | (apart <= 4 * edits)
    return x.join(y, (x["key"] == y["key"]) & (x["a"] != y["b"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_classes(lines: DataFrame, *, edits: int, min_chars: int, most: int) -> DataFrame:
    """(id, label) of the lines that have a similar other; ``lines`` has distinct (id, s)."""
    whole = lines.where(F.char_length("s") >= min_chars).select("id", "s")
    unique = stored(candidates(whole, edits, most), "line-pairs")
    few = 2 * unique.count() <= MOST_BROADCAST
    judged = within(_with_lines(_with_lines(unique, "a", whole, few), "b", whole, few), edits)
    near = stored_at(judged, "line-verdicts", release=False)[0].where("near")
    return components(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "id")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 24, most: int = 1) -> DataFrame:
    """One row per input row: id, n_lines long, n_removed long, kept string.

    Lines are what lies between newlines. Two lines are linked if they are equal, or if both have at least ``min_chars`` characters
    and are within ``edits`` edits; links join lines into classes. The document with the least id that has a line of a
    class keeps its first such line, all others are removed. Blank lines (white space only) are never removed.
    ``kept`` is what is left, joined by newlines. Null texts count as empty (one blank line); null ids come last; rows that repeat an id
    with the same text are one document, and each gets its result. Ids are of any type that has an order. An empty table gives no rows; columns
    besides the two are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("rank"), text.alias("text")).withColumn("tag", F.xxhash64("rank", "text"))
    each = base.select("rank", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    lines = stored(
        each.groupBy("line").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(F.monotonically_increasing_id().alias("id"), F.col("line").alias("s"), F.unhex(F.md5("line")).alias("h"), "first", "n"),
        "lines",
    )
    classes = stored(line_classes(lines.select("id", "s"), edits=edits, min_chars=min_chars, most=most), "line-classes")
    known = lines.select("id", "h", "first", "n").join(classes, "id", "left")
    known = known.withColumn("class", F.coalesce("label", "id"))
    size = known.where("label is not null").groupBy("class").agg(F.min("first").alias("class_first"))
    again = known.join(size, "class", "left").where("label is not null or n > 1").select("h", "class", F.coalesce("class_first", "first").alias("first"))
    seen = stored(each.select("rank", "tag", "pos", F.unhex(F.md5("line")).alias("h")).join(again, "h").select("rank", "tag", "pos", "class", "first"), "seen")
    own = seen.where("rank = first").groupBy("tag", "class").agg(F.min("pos").alias("keep"))
    # In the first document all lines of the class but the first go; in others all go.
    gone = seen.where("rank > first").select("tag", "pos").unionAll(
        seen.where("rank = first").join(own, ["tag", "class"]).where("pos > keep").select("tag", "pos")
    )
    removed = gone.groupBy("tag").agg(F.sort_array(F.collect_set("pos")).alias("removed"))
    out = base.join(removed, "tag", "left")
    parts = F.split("text", "\n", -1)
    n_lines = F.size(parts).cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "removed")
    # The parts are bound once: inside the inner function the text would be split for each line.
    joined = F.get(F.transform(F.array(parts), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(joined)
    return out.select(
        F.col("rank.id").alias(id_col), n_lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept")
    )
