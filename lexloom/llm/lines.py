"""Line deduplication with DataFrame operations only.

A line goes if an equal line, or one that a single word's insertion, removal or replacement makes of
it, comes earlier. Lines of one edit share a variant: the line with a word left open, or without it.
Variants are hashed keys; lines that meet under one are linked, and the words of both are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .common import among, id_key

#: Shortest lines, in words, that are compared by edits (one edit of five words leaves a similarity of 0.8).
MIN_WORDS = 5
#: A key is common if it holds more than this share of all rows; there are at most 1 / SHARE such keys.
SHARE = 0.001


def _place() -> Column:
    """What orders lines: the document's id, its text's hash where ids repeat, the line's number."""
    return F.struct("d", "h", "n")


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, n, line) of every line that isn't blank."""
    lines = docs.select(id_key().alias("d"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.btrim("line", F.lit(" \t\r\f\v")) != "")


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), F.col("line")).alias("b")]


def _half(words: str) -> str:
    """How many words of a line of so many make a half: a power of two, up to half of them."""
    return f"shiftleft(1, length(bin({words})) - 2)"


def _halves() -> Column:
    """Keys of the first and the last words of a line. Of two lines one word apart, the first p or the
    last p words are equal for each p up to half of the shorter one; p is a power of two, so that both
    lines choose the same one, or one of two next to a power of two: then there are four keys."""
    out = []
    for n in ("w", "w - 1"):
        size = _half(n)
        new = "true" if n == "w" else f"{size} <> {_half('w')}"
        out += [f"IF({new}, xxhash64('first', {size}, substring_index(line, ' ', {size})), NULL)", f"IF({new}, xxhash64('last', {size}, substring_index(line, ' ', -({size}))), NULL)"]
    return F.expr(f"CASE WHEN w >= {MIN_WORDS} THEN array({', '.join(out)}) END")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(a, b, place, copies, w, halves): each line by two hashes, where it comes first, how often it comes, its words."""
    lines = _lines(docs).withColumn("w", F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
    lines = lines.select(*_hashes(), _place().alias("place"), "w", _halves().alias("halves"))
    return lines.groupBy("a", "b").agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.max("w").alias("w"), F.max("halves").alias("halves"))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row for each of some keys, however unevenly rows hold the keys.

    `count`: how many rows have the key. Common keys, of which there are at most 1 / SHARE, are
    broadcast; the rest are joined by a shuffle."""
    common = F.col(count) > F.lit(max(SHARE * total, 1000.0))
    hot = F.broadcast(found.where(common))
    cold = rows.join(F.broadcast(found.where(common).select(*keys)), keys, "left_anti").join(found.where(~common), keys)
    return rows.join(hot, keys).unionByName(cold)


def candidates(distinct: DataFrame, total: int) -> DataFrame:
    """(place, low, high): lines that share a half with another one, and the words that may differ: [low, high)."""
    keyed = distinct.where("halves IS NOT NULL").select("place", "w", F.posexplode("halves").alias("i", "key")).where("key IS NOT NULL")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    met = looked_up(among(keyed, shared, "key"), shared, ["key"], "rows", total)
    size, first = F.expr(_half("IF(i < 2, w, w - 1)")), F.col("i") % 2 == 0
    met = met.groupBy("place").agg(F.min(F.when(first, size).otherwise(0)).alias("low"), F.max(F.when(first, F.col("w")).otherwise(F.col("w") - size)).alias("high"))
    return stored(met.select("place", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))


def variants_of(lines: DataFrame) -> DataFrame:
    """(place, kind, key): the lines (place, low, high, line) with a word open (O) or left out (D), and as they are (F)."""
    words = lines.select("place", "low", "high", F.split("line", " ").alias("words")).withColumn("w", F.size("words"))

    # a line's hash is the exclusive or of its words' hashes with their places, so that a word can be taken out
    def folded(shift: int) -> Column:
        return F.aggregate(F.transform("words", lambda x, i: F.xxhash64(x, i - shift)), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))

    whole = words.repartition("place").select("place", "low", "high", "w", folded(0).alias("whole"), folded(1).alias("moved"), "words")
    each = whole.select("place", "low", "high", "w", "whole", "moved", F.posexplode("words").alias("i", "word"))
    own, moved = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    upto = Window.partitionBy("place").orderBy("i")
    each = each.withColumn("passed", F.bit_xor(own.bitwiseXOR(moved)).over(upto)).where("i >= low AND i < high")
    open_key = F.xxhash64(F.lit("open"), "w", "i", F.col("whole").bitwiseXOR(own))
    # the words before at their places, those behind one place nearer
    less_key = F.xxhash64(F.lit("less"), F.col("w") - 1, F.col("passed").bitwiseXOR(own).bitwiseXOR(F.col("moved")))
    own_key = F.xxhash64(F.lit("less"), "w", "whole")
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("O", open_key), ("D", less_key), ("F", F.when(F.col("i") == F.col("low"), own_key)))])
    return each.select("place", F.explode(made).alias("v")).select("place", "v.kind", "v.key").where("key IS NOT NULL")


def near_links(docs: DataFrame, distinct: DataFrame, total: int) -> DataFrame:
    """(place, earlier): distinct lines that are one word from an earlier one.

    Lines that leave the same word open are one edit apart, as are a line and those that lose a word to become it:
    each meets the earliest of its kind of partner, so that a group of n gives at most n links. The earliest ones
    are found first, and then joined to the lines whose keys come more than once."""
    asked = candidates(distinct, total)
    lines = among(_lines(docs).select(_place().alias("place"), "line"), asked, "place")
    lines = stored(lines.join(asked, "place").dropDuplicates(["place"]))
    variants = stored(variants_of(lines))
    shared = stored(variants.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    count = variants.count()
    met = stored(looked_up(among(variants, shared, "key"), shared, ["key"], "rows", count))
    earliest = [F.min(F.when(F.col("kind") == k, F.col("place"))).alias(k) for k in "ODF"]
    both = looked_up(met.drop("rows"), met.groupBy("key").agg(F.first("rows").alias("rows"), *earliest), ["key"], "rows", count)
    earlier = F.when(F.col("kind") == "O", F.col("O")).when(F.col("kind") == "D", F.col("F")).otherwise(F.col("D"))
    links = stored(both.select("place", earlier.alias("earlier")).where("earlier < place").distinct())
    linked = links.select("place").unionByName(links.select(F.col("earlier").alias("place")))
    return _verified(links, among(lines, linked, "place").select("place", F.split("line", " ").alias("words")))


def _verified(links: DataFrame, words: DataFrame) -> DataFrame:
    """The links whose lines are one word apart: what differs, once equal words at both ends are gone."""
    both = links.join(words.select("place", F.col("words").alias("x")), "place").join(words.select(F.col("place").alias("earlier"), F.col("words").alias("y")), "earlier")
    n, m = F.size("x"), F.size("y")
    same = F.when(n == m, F.size(F.filter(F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q)), lambda t: t)) <= 1)
    # the longer one without its first differing word
    long, short = F.when(n > m, F.col("x")).otherwise(F.col("y")), F.when(n > m, F.col("y")).otherwise(F.col("x"))
    both = both.withColumn("long", long).withColumn("short", short)
    first = F.array_position(F.zip_with(F.slice("long", 1, F.size("short")), F.col("short"), lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
    cut = F.when(first == 0, F.size("short") + 1).otherwise(first)
    both = both.withColumn("cut", cut)
    rest = F.concat(F.slice("long", F.lit(1), F.col("cut") - 1), F.slice("long", F.col("cut") + 1, F.size("long")))
    return both.where(F.coalesce(same, rest == F.col("short"))).select("place", "earlier")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(d, h, exact, near): numbers of the lines to remove, for each document that has any."""
    docs = docs.select("doc_id", "text")
    found = stored(distinct_lines(docs))
    total = found.agg(F.sum("copies")).first()[0] or 0
    repeated = found.where("copies > 1").select("a", "b", F.col("place").alias("first"), "copies")
    lines = stored(among(_lines(docs).select("d", "h", "n", *_hashes()), repeated, "a", "b"))
    exact = looked_up(lines, repeated, ["a", "b"], "copies", total).where(_place() > F.col("first")).select("d", "h", "n", F.lit(True).alias("exact"))
    near = near_links(docs, found, total).select("place.d", "place.h", "place.n", F.lit(False).alias("exact")).distinct()
    gone = exact.unionByName(near).groupBy("d", "h")
    return gone.agg(F.collect_set(F.when(F.col("exact"), F.col("n"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("n"))).alias("near"))


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """`docs` with the lines removed from text, n_chars as the new length where there is such a column,
    and, if asked for, n_lines, n_exact, n_near in place of any columns of these names.

    Lines are cut at newlines, words at single spaces. A line goes if an equal line comes earlier in the
    order of (doc_id, number), or if it has MIN_WORDS words or more and an earlier line, itself kept or
    not, is one inserted, removed or replaced word away and has as many. Blank lines stay. Rows that
    repeat id and text are one document's copies and are treated alike; of other rows that repeat an id
    an order by the text's hash decides. Null texts stay null with no lines; rows without an id come
    first. Empty tables give an empty one. Other columns, of any names, stay as they are."""
    gone = duplicate_lines(docs)
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    own = docs.select(id_key().alias("d"), F.xxhash64("text").alias("h"), "text", F.struct(F.lit(0).alias("c"), *rest).alias("rest"))
    out = own.join(gone.hint("shuffle_hash"), ["d", "h"], "left")
    out = out.withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.array_union("exact", "near"))
    out = out.withColumn("kept", F.when(F.col("exact").isNotNull(), kept))
    out = out.withColumn("less", F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n"))
    same = F.col("exact").isNull()
    made = {"n_lines": F.coalesce(F.size("lines"), F.lit(0)), "n_exact": F.coalesce(F.size("exact"), F.lit(0)), "n_near": F.coalesce(F.size("near"), F.lit(0))} if counts else {}
    columns = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            columns.append(F.when(same, F.col("text")).otherwise(F.col("less")).alias(c))
        elif c == "n_chars":
            columns.append(F.when(same, F.col(f"rest.c{i}")).otherwise(F.length("less")).cast("long").alias(c))
        elif c not in made:
            columns.append(F.col(f"rest.c{i}").alias(c))
    return out.select(*columns, *[v.alias(k) for k, v in made.items()])
