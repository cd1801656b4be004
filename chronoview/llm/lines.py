"""Line dedup with DataFrame operations only: fuzzy lines by MinHash over character shingles.

A shingle is ``WIDTH`` characters from any character on, so shingles cover a line to its last character;
a shorter line is its own shingle. Signatures are minima of one hash under many multipliers; a band is a
choice of them, and lines that share a band are compared by the exact Jaccard similarity of their shingle
sets; union-find joins the similar ones. Pairs are first held against sketches, some bits of each minimum,
so that few texts are moved: all pairs of buckets of up to SMALL lines, and of larger buckets those that
``near.link`` asks for. Of each class only the first line stays, in order of doc_id and place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, maybe, sided, without
from .near import apart, components, link

WIDTH = 5
#: Shingles that meet in one row before the minima of a line are updated.
STEP = 16
#: Minima of a line, bands, and minima in a band. Each minimum is in five bands; at a similarity of 0.8 one pair in
#: a hundred shares no band, at 0.9 one in 5,000.
MINIMA, BANDS, ROWS = 24, 24, 5
#: Bits of each minimum in a sketch, whose numbers hold twelve minima each.
BITS, PER_LONG = 5, 12
#: Lines of a bucket whose pairs are all looked at.
SMALL = 16


def _last(chars: Column) -> Column:
    """The place of the last shingle of a line written with four bytes a character."""
    return F.greatest((F.length(chars) / F.lit(4)).cast("int") - F.lit(WIDTH), F.lit(0))


def _shingle(chars: Column, place: Column) -> Column:
    return F.substring(chars, place * F.lit(4) + F.lit(1), F.lit(4 * WIDTH))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(line: Column) -> Column:
    """The shingle set of a line that is not empty, as 64-bit hashes."""
    places = lambda e: F.transform(F.sequence(F.lit(0), _last(e)), lambda i: F.xxhash64(_shingle(e, i)))
    return F.array_distinct(_let(F.encode(line, "UTF-32"), places))


def similar(one: Column, two: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two lines' shingle sets is ``threshold`` or more."""
    enough = lambda n, both: n >= threshold * (both - n)
    of = lambda x, y: _let(F.size(F.array_intersect(x, y)), lambda n: enough(n, F.size(x) + F.size(y)))
    return _let(shingles(one), lambda x: _let(shingles(two), lambda y: of(x, y)))


def _factors() -> list[int]:
    """Odd numbers of 31 bits."""
    return [((i + 1) * 0x9E3779B1 + 0x7F4A7C15 ^ (i * i * 0x85EBCA6B)) & 0x7FFFFFFF | 0x40000001 for i in range(MINIMA)]


def band_rows() -> list[list[int]]:
    """The minima of each band: all in turn, in steps that differ from pass to pass, so that few bands share
    more than two."""
    left = [at * step % MINIMA for step in (1, 5, 7, 11, 13) for at in range(MINIMA)]
    bands = []
    while left:
        band = list(dict.fromkeys(left))[:ROWS]
        for x in band:
            left.remove(x)
        bands.append(sorted(band))
    return bands


def _equal_needed(threshold: float) -> float:
    """Minima whose sketches are equal in a pair of that similarity, less 3.7 deviations."""
    p = threshold + (1 - threshold) / (1 << BITS)
    return MINIMA * p - 3.7 * (MINIMA * p * (1 - p)) ** 0.5


def occurrences(docs: DataFrame) -> DataFrame:
    """Lines that are not empty: doc_id, text_key, place, line and its 128-bit key (k1, k2)."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return base.where(F.length("line") > 0).withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line"))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, k1, k2, times, s1, s2, m0, m1, ...) of each distinct line: how often it occurs, its sketch and minima."""
    chars = lines.select("k1", "k2", F.encode("line", "UTF-32").alias("e")).withColumn("last", _last(F.col("e")))
    steps = chars.select("k1", "k2", "e", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    some = [f"h{j}" for j in range(STEP)]
    begins = (F.col("i") == 0).cast("bigint").alias("begins")
    hashed = steps.select("k1", "k2", begins, *[F.hash(_shingle(F.col("e"), F.least(F.col("i") + j, F.col("last")))).cast("bigint").alias(h) for j, h in enumerate(some)])
    under = lambda f: F.least(*[(F.col(h) * F.lit(f)).bitwiseAND(F.lit(0x7FFFFFFF)) for h in some])
    least = hashed.groupBy("k1", "k2").agg(F.sum("begins").alias("times"), *[F.min(under(f)).cast("int").alias(f"m{i}") for i, f in enumerate(_factors())])
    return least.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "times", *_sketch(), *[f"m{i}" for i in range(MINIMA)])


def _sketch() -> list[Column]:
    """s1, s2: BITS bits of each minimum."""
    part = lambda i: F.shiftleft(F.shiftright(f"m{i}", 9).bitwiseAND(F.lit((1 << BITS) - 1)).cast("bigint"), BITS * (i % PER_LONG))
    return [reduce(Column.bitwiseOR, [part(i) for i in range(k, k + PER_LONG)]).alias(f"s{n}") for n, k in ((1, 0), (2, PER_LONG))]


def _buckets(known: DataFrame) -> DataFrame:
    """(id, s1, s2, bucket): the bands of each line, with its sketch."""
    bands = [F.xxhash64(F.lit(b), *[f"m{i}" for i in rows]) for b, rows in enumerate(band_rows())]
    return known.select("id", "s1", "s2", F.explode(F.array(*bands)).alias("bucket"))


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """(*more, name, name1, name2): ids and sketches under the name of one side of a pair."""
    return rows.select(*more, F.col("id").alias(name), F.col("s1").alias(f"{name}1"), F.col("s2").alias(f"{name}2"))


def _allowed(threshold: float) -> Column:
    """Whether the sketches of a and b are as equal as ``_equal_needed`` asks."""
    lowest = sum(1 << (BITS * i) for i in range(PER_LONG))

    def unequal(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        folded = reduce(Column.bitwiseOR, [bits] + [F.shiftright(bits, i) for i in range(1, BITS)])
        return F.bit_count(folded.bitwiseAND(F.lit(lowest)))

    return MINIMA - unequal(F.col("a1"), F.col("b1")) - unequal(F.col("a2"), F.col("b2")) >= _equal_needed(threshold)


def _small(rest: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of small buckets whose sketches allow the threshold."""
    one, two = (_side(rest.where(F.col("n") <= SMALL), x, "bucket") for x in "ab")
    return one.join(two, "bucket").where((F.col("a") < F.col("b")) & _allowed(threshold)).select("a", "b").distinct()


def classes(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``signatures`` of the lines, and (id, root) of those with a near-duplicate."""
    lines = occurrences(docs)
    known = cut(signatures(lines), "line-signatures")
    shared = cut(_buckets(known).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "line-buckets")
    rest = cut(maybe(_buckets(known), shared, "bucket").join(shared, "bucket"), "line-members")
    free(shared)
    pairs = cut(_small(rest, threshold), "line-pairs")
    members = rest.where(F.col("n") > SMALL).select("bucket", "id")
    ids = members.select("id").unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = cut(ids.join(known.select("id", "k1", "k2"), "id"), "line-wanted")
    text = cut(maybe(lines.select("k1", "k2", "line"), wanted, "k1").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("id", "line").distinct(), "line-text")
    free(wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (sided(text, pairs, x).withColumnRenamed("line", f"line_{x}") for x in "ab")
        return pairs.join(one, "a").join(two, "b").where(similar(F.col("line_a"), F.col("line_b"), threshold)).select("a", "b")

    def compare(pairs: DataFrame) -> DataFrame:
        one, two = (sided(known.select("id", "s1", "s2"), pairs, x).select(x, F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2")) for x in "ab")
        alike = pairs.join(one, "a").join(two, "b").where(_allowed(threshold)).select("a", "b")
        return verified(cut(alike, "line-alike"))

    def sets(ids: DataFrame) -> DataFrame:
        return maybe(text, ids, "id").join(ids, "id", "left_semi").select("id", shingles(F.col("line")).alias("h"))

    # Each line with one partner first: what these join needs no other comparison.
    links = cut(verified(cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "line-firsts")), "line-links")
    links = links.unionByName(verified(cut(apart(pairs, cut(components(links), "line-classes")), "line-apart")))
    if members.limit(1).count():
        joined = link(members, compare, sets, threshold)
        links = links.unionByName(joined.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    return known, components(links)


def removals(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_key, places): the lines of each document that repeat an earlier one of their class."""
    known, roots = classes(docs, threshold)
    roots = cut(roots, "line-roots")
    repeated = known.select("id", "k1", "k2", "times").join(roots, "id", "left").where("times > 1 or root is not null")
    repeated = cut(repeated.select("k1", "k2", F.coalesce("root", "id").alias("root")), "line-repeated")
    free(known)
    order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("place").cast("decimal(12,0)")
    places = maybe(occurrences(docs).select("doc_id", "text_key", "place", "k1", "k2"), repeated, "k1")
    each = cut(places.join(repeated, ["k1", "k2"]).select("doc_id", "text_key", "place", "root", order.alias("at")), "line-places")
    first = each.groupBy("root").agg(F.min("at").alias("first"))
    later = each.join(first, "root").where(F.col("at") > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with repeated lines taken out of text, and lines_removed added.

    Rows, order of lines and empty lines stay; a document whose lines all
    repeat earlier ones keeps an empty text. A null text stays null. Equal rows are treated alike. An input
    column named lines_removed is replaced.
    """
    source = without(docs, "lines_removed")
    gone = removals(source, threshold).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("places").alias("_places"))
    joined = source.withColumn("_text_key", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_places", i))
    columns = [F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in source.columns]
    return joined.select(*columns, F.coalesce(F.size("_places"), F.lit(0)).alias("lines_removed"))
