"""Near-duplicate classes from buckets: which pairs to compare, and distributed union-find.

Rows that share a bucket are compared without emitting all pairs of a large bucket. Each bucket has a leader, the row
that meets most others in its buckets; each other row is compared with it, and union-find joins what is
similar. A bucket whose rows are then all in one class is done. What is left of the buckets of one leader is cut into
smaller buckets, such that two similar rows still share one (or are compared at once), in two ways.

Rows like the leader (NEAR or more) are known by their differences from it: the elements that only one of the two has.
With k = (1 - t) / (1 + t), two sets of x and y elements have Jaccard similarity t or more if their symmetric
difference has at most k (x + y) elements. It has a + b - 2 o, where a and b are the sizes of the differences
from the leader and o is what these have in common. So 2 o >= (a - k x) + (b - k y). An element of differences
is rare if at most RARE rows of the leader have it. Pairs that share rare ones are made from these, at most RARE
partners each. Any other pair has its o elements in common among those that are not rare; rows for which no partner of
another class can fulfil the bound drop out. Of c elements that are not rare, from the scarcest on, one of the first
c - o + 1 is shared: each of these is a bucket of its own.

Rows unlike the leader (below FAR) are known by their own elements, of which two similar sets of n and more share
one of the first n - ceil(t n) + 1 in any order that holds for all; here those that the leader lacks come first.
Scarce ones make pairs, the others are buckets.

Jaccard distance is a metric: similar rows are at most 1 - t apart, so both are NEAR or both below FAR. A bucket of a turn
holds only rows that share a scarce element of the bucket before and not its leader, so sizes fall by factors, not
by rows.

Smaller buckets hold a row several times. Most rows need none of them: in the first TURNS turns what is left stays in the
buckets it is in, less their leaders, of which there are LEADERS more from the second turn on. Only then are buckets cut.

Nor are elements needed while buckets have SMALL rows or less. There each row is known by BITS parity bits: an element
turns one over. Two rows differ in no more bits than elements, so pairs of classes whose bits differ in more than
k (x + y) places are out, exactly and within the join that meets them, in the first bucket they share. The others are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free

#: Rows of one leader that have a rare element, at most; rows of a small bucket; further leaders of a bucket; turns
#: before buckets are cut.
RARE, SMALL, LEADERS, TURNS = 8, 1 << 13, 31, 12
#: Parity bits of a row, 64 to a number.
BITS = 2048
#: Similarity to the leader: of two rows that are at most 0.2 apart from each other, both are NEAR or both below FAR.
NEAR, FAR = 0.3, 0.5


def _stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one root and no root hangs on another."""
    two = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return not two.unionByName(inner).limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): every linked id with the least id of its component.

    Alternates two steps until the links are stars: each node ties its larger neighbours, then its smaller
    ones, to the least node next to it. Rows stay of the order of the links; each step is joins and
    minima that Spark combines before the shuffle, and is written to the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "uf")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        fresh = cut(small.select("e.*").where("u <> v").distinct(), "uf")
        free(edges)
        edges = fresh
    leaf = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaf.unionByName(leaf.select(F.col("root").alias("id"), "root").distinct())


def _open(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, id, root) of buckets whose rows are not all in one class; root: a row's class, or itself."""
    rooted = rest.select("bucket", "id").join(classes, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    return rooted.join(mixed, "bucket", "left_semi")


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ...) that are not in one class."""
    root = lambda x: classes.select(F.col("id").alias(x), F.col("root").alias(f"_root_{x}"))
    rooted = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return rooted.where(F.coalesce("_root_a", "a") != F.coalesce("_root_b", "b")).select(*pairs.columns)


def _merged(rest: DataFrame) -> DataFrame:
    """The same buckets, those of the same rows once."""
    like = rest.groupBy("bucket").agg(F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("id")), F.sum(F.hash("id")), F.min("id"), F.max("id")).alias("_like"))
    return rest.join(like, "bucket").select(F.col("_like").alias("bucket"), "id", "root").distinct()


def _leaders(rest: DataFrame, more_leaders: int) -> DataFrame:
    """(bucket, lead, lead_root, rank): first the row of each bucket that meets most others in its buckets (the least id of
    these), then some by hash."""
    sized = rest.join(rest.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    fame = sized.groupBy("id").agg(F.sum("n").alias("fame"))
    most = F.max_by(F.struct("id", "root"), F.struct("fame", -F.col("id"))).alias("m")
    first = rest.join(fame, "id").groupBy("bucket").agg(most).select("bucket", F.col("m.id").alias("lead"), F.col("m.root").alias("lead_root"))
    first = cut(first, "near-first-leaders")
    if not more_leaders:
        return first.withColumn("rank", F.lit(0))
    by = Window.partitionBy("bucket").orderBy(F.xxhash64("id"), "id")
    more = rest.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= more_leaders).select("bucket", F.col("id").alias("lead"), F.col("root").alias("lead_root"), "rank")
    return first.withColumn("rank", F.lit(0)).unionByName(more.join(first, ["bucket", "lead"], "left_anti"))


def _parities(sets: DataFrame) -> DataFrame:
    """(id, n, p0, p1, ...): elements of each set and the parities of those that fall on each of BITS bits."""
    each = sets.select("id", F.size("h").alias("n"), F.explode("h").alias("h")).withColumn("h", F.xxhash64("h"))
    bit = each.select("id", "n", F.pmod("h", F.lit(BITS // 64)).cast("int").alias("word"), F.expr("shiftleft(1L, int(shiftrightunsigned(h, 58)))").alias("bit"))
    own = lambda j: F.bit_xor(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("bigint")))
    return bit.groupBy("id").agg(F.max("n").alias("n"), *[own(j).alias(f"p{j}") for j in range(BITS // 64)])


def _close(rest: DataFrame, sets: DataFrame, k: float) -> DataFrame:
    """(a, b), each once: rows of one bucket and of different classes that differ in no more parity bits than similar ones may
    in elements."""
    buckets = rest.groupBy("id").agg(F.collect_list("bucket").alias("all"))
    rows = cut(rest.join(buckets.join(_parities(sets), "id"), "id"), "near-parities")
    numbers = [c for c in rows.columns if c not in ("bucket", "all")]  # never null, which the code made for a pair need not ask
    one, two = (rows.select("bucket", F.col("all").alias(f"all_{x}"), *[F.coalesce(c, F.lit(0)).alias(f"{c}_{x}") for c in numbers]) for x in "ab")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"p{j}_a").bitwiseXOR(F.col(f"p{j}_b"))) for j in range(BITS // 64)])
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & (differ <= F.lit(k) * (F.col("n_a") + F.col("n_b")) + 1e-6)
    met = (one["bucket"] == two["bucket"]) & apart & (F.array_min(F.array_intersect("all_a", "all_b")) == one["bucket"])
    pairs = cut(one.join(two, met).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "near-close")
    free(rows)
    return pairs


def _told(led: DataFrame, sets: DataFrame, threshold: float, cutting: bool) -> DataFrame:
    """(g, lead, id, root) -> (g, lead, id, root, n, a, j, d, h): elements of id and of the difference, similarity, the difference
    of NEAR rows (inverted where only the leader has it) and, for ``cutting``, the first elements of rows that may be FAR."""
    both = led.join(sets.select(F.col("id").alias("lead"), F.col("h").alias("x")), "lead").join(sets.withColumnRenamed("h", "y"), "id")
    only = F.concat(F.array_except("y", "x"), F.transform(F.array_except("x", "y"), F.bitwise_not))
    known = both.select("g", "lead", "id", "root", F.size("x").alias("m"), F.size("y").alias("n"), only.alias("d"), "x", "y")
    alike = (F.col("m") + F.col("n") - F.size("d")) / (F.col("m") + F.col("n") + F.size("d"))
    known = known.select("g", "lead", "id", "root", "n", F.size("d").alias("a"), alike.alias("j"), "d", "x", "y")
    first = F.slice(F.concat(F.array_sort(F.array_except("y", "x")), F.array_sort(F.array_intersect("y", "x"))), F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6) + 1).cast("int"))
    far = F.when(F.col("j") < FAR + 0.2, first) if cutting else F.lit(None).cast("array<bigint>")
    return known.select("g", "lead", "id", "root", "n", "a", "j", F.when(F.col("j") >= NEAR, F.col("d")).alias("d"), far.alias("h"))


def _counted(elements: DataFrame) -> DataFrame:
    """(g, id, h, ...) with rows, how many rows of the group have h; elements that one row has are left out."""
    shared = elements.groupBy("g", "h").agg(F.count("*").alias("rows")).where("rows > 1")
    return elements.join(shared, ["g", "h"])


def _first(elements: DataFrame, kept: Column, *more: str) -> DataFrame:
    """(g, id, h, rows) of the first ``kept`` elements of each row, from the scarcest on."""
    listed = elements.groupBy("g", "id", *more).agg(F.sort_array(F.collect_list(F.struct("rows", "h"))).alias("e"))
    some = listed.withColumn("_k", kept.cast("int")).where("_k > 0").select("g", "id", F.explode(F.slice("e", F.lit(1), F.col("_k"))).alias("e"))
    return some.select("g", "id", "e.h", "e.rows")


def _pairs(scarce: DataFrame) -> DataFrame:
    """(g, a, b, r): rows of a group and of different classes that share scarce elements, and how many."""
    one, two = (scarce.select("g", "h", F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    shared = one.join(two, ["g", "h"]).where("a < b and root_a <> root_b")
    return shared.groupBy("g", "a", "b").agg(F.count("*").alias("r"))


def _smaller(first: DataFrame, kind: int) -> DataFrame:
    """(bucket, id): a bucket for each element that is not scarce."""
    return first.where(F.col("rows") > RARE).select(F.xxhash64("g", "h", F.lit(kind)).alias("bucket"), "id")


def _near(told: DataFrame, classes: DataFrame, k: float, cutting: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b), pairs of different classes that share rare elements of their differences and may be similar; (g, id, s),
    rows that may be similar to others without; and elements: all that are shared for ``cutting``, else the rare ones."""
    near = told.where(F.col("j") >= NEAR).withColumn("s", F.col("a") - F.lit(k) * F.col("n"))
    every = near.select("g", "id", "root", F.explode("d").alias("h"))
    if cutting:
        elements = cut(_counted(every), "near-elements")
        common = elements.where(F.col("rows") > RARE).groupBy("g", "id").agg(F.count("*").alias("c"))
        sized = near.select("g", "lead", "id", "s").join(common, ["g", "id"], "left").na.fill(0, ["c"])
    else:  # the many that are common are counted by what is left of the difference, not written
        scarce = every.groupBy("g", "h").agg(F.count("*").alias("rows")).where(F.col("rows") <= RARE)
        elements = cut(every.join(scarce, ["g", "h"]), "near-elements")
        rare = elements.groupBy("g", "id").agg(F.count("*").alias("p"))
        sized = near.select("g", "lead", "id", "s", "a").join(rare, ["g", "id"], "left").select("g", "lead", "id", "s", (F.col("a") - F.coalesce("p", F.lit(0))).alias("c"))
    sized = cut(sized, "near-sizes")
    side = lambda x: sized.select("g", F.col("id").alias(x), F.col("s").alias(f"s_{x}"), F.col("c").alias(f"c_{x}"))
    maybe = _pairs(elements.where((F.col("rows") > 1) & (F.col("rows") <= RARE))).join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
    maybe = maybe.where(2 * (F.least("c_a", "c_b") + F.col("r")) >= F.col("s_a") + F.col("s_b") - 1e-6).select("a", "b").distinct()
    return maybe, _possible(sized, classes), elements


def _cut_near(stay: DataFrame, elements: DataFrame) -> DataFrame:
    """(bucket, id): smaller buckets of the rows that may be similar without a rare element in common."""
    lowest = stay.groupBy("g").agg(F.min("s").alias("s_low"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("s_low")) / 2 - 1e-6))
    plenty = elements.where(F.col("rows") > RARE).join(stay.join(lowest, "g"), ["g", "id"])
    return _smaller(_first(plenty, F.size("e") - needed + 1, "s", "s_low"), 1)


def _far(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (bucket, id) as of ``_near``, for rows whose similarity to the leader is low."""
    first = cut(_counted(told.where("h is not null").select("g", "id", "root", F.explode("h").alias("h"))), "near-first")
    return _pairs(first.where(F.col("rows") <= RARE)).select("a", "b").distinct(), _smaller(first, 2)


def _possible(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, id, s): rows that may be similar to another of their group without a rare element in common, one of
    the two not in the leader's class. That asks for s_a + s_b <= 2 min(c_a, c_b), so with gap = 2 c - s for
    s_a <= gap_b and s_b <= gap_a."""
    root = lambda x: classes.select(F.col("id").alias(x), F.col("root").alias(f"_root_{x}"))
    rooted = sized.where("c > 0").join(root("id"), "id", "left").join(root("lead"), "lead", "left")
    inside = F.coalesce("_root_id", "id") == F.coalesce("_root_lead", "lead")
    reach = rooted.select("g", "id", "s", (2 * F.col("c") - F.col("s") + 1e-6).alias("gap"), inside.alias("inside"))
    of = lambda f, c, where: f(F.when(where, F.col(c)))
    most = reach.groupBy("g").agg(
        F.max("gap").alias("top"), F.min("s").alias("least"), of(F.max, "gap", ~F.col("inside")).alias("top_out"), of(F.min, "s", ~F.col("inside")).alias("least_out")
    )
    fits = lambda top, least: F.coalesce((F.col("s") <= F.col(top)) & (F.col(least) <= F.col("gap")), F.lit(False))
    return reach.join(most, "g").where(F.when(F.col("inside"), fits("top_out", "least_out")).otherwise(fits("top", "least"))).select("g", "id", "s")


def link(members: DataFrame, compare: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """members: (bucket, id), each once. compare: (a, b) -> those of them that are near-duplicates, by the
    Jaccard similarity of their sets. sets: (id) -> (id, h), the array of elements of each. Returns (id, root) of all
    ids with a near-duplicate. ``threshold`` is 0.8 or more, which NEAR and FAR are made for."""
    k = (1 - threshold) / (1 + threshold)
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    rest = cut(members.join(shared, "bucket", "left_semi").select("bucket", "id", F.col("id").alias("root")), "near-members")
    classes = None

    def joined(pairs: DataFrame) -> None:
        nonlocal classes
        if classes is not None and not pairs.limit(1).count():
            return free(pairs)
        found = cut(compare(pairs), "near-links")
        if classes is None or found.limit(1).count():
            before = classes
            links = found if before is None else found.unionByName(before.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
            classes = cut(components(links), "near-classes")
            free(before)
        free(found)
        free(pairs)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))

    turn = 0
    while rest.limit(1).count():
        turn += 1
        again, cutting = turn > 1, turn > TURNS
        if again:
            sized = rest.groupBy("bucket").agg(F.count("*").alias("n"))
            small, large = (cut(rest.join(sized.where(x), "bucket", "left_semi"), "near-members") for x in (F.col("n") <= SMALL, F.col("n") > SMALL))
            if small.limit(1).count():
                joined(_close(small, sets(small.select("id").distinct()), k))
            free(small)
            if not large.limit(1).count():
                break
        else:
            large = rest
        lead = cut(_leaders(large, LEADERS if again and not cutting else 0), "near-lead")
        joined(cut(ordered(large.join(lead, "bucket").where("root <> lead_root")).distinct(), "near-pairs"))
        first, leaders = lead.where("rank = 0").select("bucket", "lead"), lead.select("bucket", F.col("lead").alias("id"))
        left = _open(large.join(leaders, ["bucket", "id"], "left_anti"), classes)
        if not again:  # most buckets are small, and need no elements
            following = cut(left, "near-members")
            for done in {rest, lead}:
                free(done)
            rest = following
            continue
        led = left.join(first, "bucket")
        # The buckets of one leader are one group, for many hold the same rows; buckets that were cut are alike only if equal.
        led = cut(led.select("bucket", F.col("bucket" if turn > max(TURNS, 1) + 1 else "lead").alias("g"), "lead", "id", "root"), "near-led")
        for done in {rest, large, lead}:
            free(done)
        if not led.limit(1).count():
            return classes
        ids = led.select("id").unionByName(led.select(F.col("lead").alias("id"))).distinct()
        own = cut(sets(ids), "near-own")
        told = cut(_told(led.select("g", "lead", "id", "root").distinct(), own, threshold, cutting), "near-told")
        free(own)
        near_pairs, stay, elements = _near(told, classes, k, cutting)
        stay = cut(stay, "near-stay")
        if cutting:
            far_pairs, far_buckets = _far(told)
            following = cut(_cut_near(stay, elements).unionByName(far_buckets).distinct(), "near-buckets")
            near_pairs = near_pairs.unionByName(far_pairs)
        else:
            left = stay.select("g", "id").unionByName(told.where(F.col("j") < FAR).select("g", "id")).distinct()
            following = cut(led.join(left, ["g", "id"], "left_semi").select("bucket", "id"), "near-buckets")
        joined(cut(near_pairs.distinct(), "near-pairs"))
        rest = _open(following, classes)  # classes may have grown since their roots were joined
        rest = cut(_merged(rest) if cutting else rest, "near-members")
        for done in (led, told, stay, following, elements):
            free(done)
    return cut(components(members.sparkSession.createDataFrame([], "a bigint, b bigint")), "near-classes") if classes is None else classes
