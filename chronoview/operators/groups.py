"""Grouped scores for training: baselines, advantages, weights, rejection, validation metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.draws import AT_ONCE, Ends, by_length, numbers
from ..sources.io import seeded

EPS = 1e-6


def group_norm(df: DataFrame, uid: str = "uid", score: str = "score", use_std: bool = True, eps: float = EPS, floor: bool = False) -> DataFrame:
    """(s - mean) / (std + eps) with the sample deviation; a group of one has mean 0 and deviation 1. With
    ``floor`` the variance is at least eps instead."""
    w = Window.partitionBy(uid)
    one = F.count("*").over(w) == 1
    mean = F.when(one, 0.0).otherwise(F.avg(score).over(w))
    spread = F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(eps))) if floor else F.stddev_samp(score).over(w) + eps
    scale = F.when(one, 1.0 if floor else 1.0 + eps).otherwise(spread) if use_std else F.lit(1.0)
    return df.withColumn("advantage", (F.col(score) - mean) / scale)


def group_rloo(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    w = Window.partitionBy(uid)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n > 1, n / (n - 1) * (F.col(score) - F.avg(score).over(w))).otherwise(F.col(score)))


def group_passk(df: DataFrame, order: str, uid: str = "uid", score: str = "score", use_std: bool = True, eps: float = EPS) -> DataFrame:
    """Only the best of a group gets anything: its lead over the second. Groups of one are an error."""
    w = Window.partitionBy(uid)
    ranked = w.orderBy(F.desc(score), order)
    n = F.count("*").over(w)
    lead = F.col(score) - F.lead(score).over(ranked)
    value = lead / (F.stddev_samp(score).over(w) + eps) if use_std else lead
    checked = F.when(n < 2, F.raise_error(F.lit("a group has fewer than two scores")).cast("double")).otherwise(value)
    return df.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, checked).otherwise(F.when(n < 2, checked).otherwise(0.0)))


def group_len_weighted(df: DataFrame, length: str, uid: str = "uid", score: str = "score") -> DataFrame:
    w = Window.partitionBy(uid)
    return df.withColumn("advantage", F.col(score) - F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w))


def whiten(df: DataFrame, value: str, weight: str, eps: float = 1e-8) -> DataFrame:
    """(x - mean) / sqrt(var + eps) over all tokens, a row counting ``weight`` times."""
    n, s = F.sum(weight), F.sum(F.col(value) * F.col(weight))
    stats = df.agg((s / n).alias("_mean"), ((F.sum(F.col(value) ** 2 * F.col(weight)) - s * s / n) / (n - 1)).alias("_var"))
    return df.crossJoin(F.broadcast(stats)).withColumn(value, (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + eps)).drop("_mean", "_var")


def group_multi_reward(df: DataFrame, rewards: Sequence[str], weights: Sequence[float], length: str, uid: str = "uid") -> DataFrame:
    out = df
    for r in rewards:
        out = group_norm(out, uid, r).withColumnRenamed("advantage", f"_adv_{r}")
    total = sum((w * F.col(f"_adv_{r}") for r, w in zip(rewards, weights, strict=True)), F.lit(0.0))
    return whiten(out.withColumn("advantage", total).drop(*[f"_adv_{r}" for r in rewards]), "advantage", length)


def group_mean_baseline(df: DataFrame, length: str, uid: str = "uid", score: str = "score") -> DataFrame:
    return whiten(df.withColumn("advantage", F.col(score) - F.avg(score).over(Window.partitionBy(uid))), "advantage", length)


def group_gpg(df: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm; alpha is rows over rows with a score other than zero."""
    w = Window.partitionBy(uid)
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    mean = F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg(score).over(w))
    return df.crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("_alpha") * (F.col(score) - mean) / f_norm).drop("_alpha")


def clamped(c: Column, bound: float = 20.0) -> Column:
    return F.greatest(F.least(c, F.lit(bound)), F.lit(-bound))


def importance_weights(tokens: DataFrame, sequence: str, log_ratio: str, level: str = "sequence", cap: float = 2.0, normalise: bool = False) -> DataFrame:
    """exp of the clamped log ratio of each token, or of its sequence's sum, cut at ``cap``."""
    lr = F.col(log_ratio) if level == "token" else F.sum(log_ratio).over(Window.partitionBy(sequence))
    out = tokens.withColumn("weight", F.least(F.exp(clamped(lr)), F.lit(cap)))
    if normalise:
        mean = out.agg(F.avg("weight").alias("_m"))
        out = out.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m")
    return out


def effective_sample_size(weights: DataFrame, weight: str = "weight") -> DataFrame:
    return weights.agg((F.sum(weight) ** 2 / F.sum(F.col(weight) ** 2) / F.count("*")).alias("ess"))


def reject_by_divergence(tokens: DataFrame, sequence: str, log_ratio: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per sequence: kept if every criterion holds. Criteria k1, k2, k3 with _sum, _mean or _max."""
    r = clamped(F.col(log_ratio))
    forms = {"k1": -r, "k2": r * r / 2, "k3": F.exp(r) - 1 - r}
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}
    names = {c: how[c.split("_")[1]](forms[c.split("_")[0]]).alias(c) for c in limits}
    agg = tokens.groupBy(sequence).agg(*names.values())
    kept = F.lit(True)
    for c, (low, high) in limits.items():
        kept = kept & F.col(c).between(low, high)
    return agg.withColumn("kept", kept)


def order_statistics(df: DataFrame, n: int, key: Sequence[str], score: str = "score") -> DataFrame:
    """Expected best and worst of n draws with replacement from each key's scores, in closed form."""
    w = Window.partitionBy(*key)
    i, size = F.row_number().over(w.orderBy(score)), F.count("*").over(w)
    up = F.pow(i / size, F.lit(n)) - F.pow((i - 1) / size, F.lit(n))
    down = F.pow((size - i + 1) / size, F.lit(n)) - F.pow((size - i) / size, F.lit(n))
    each = df.select(*key, (F.col(score) * up).alias("_b"), (F.col(score) * down).alias("_w"))
    return each.groupBy(*key).agg(F.sum("_b").alias("best"), F.sum("_w").alias("worst"))


def order_statistics_of_all_sizes(df: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """(*key, n, best, worst): ``order_statistics`` for n = 2, 4, 8, .. below the number of a key's scores, and that
    number itself; a key with one score has none. Rows grow by the logarithm of a key's size."""
    w = Window.partitionBy(*key)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(score))).withColumn("_size", F.count("*").over(w)).where("_size > 1")
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda p: F.pow(F.lit(2.0), p).cast("bigint")), lambda n: n < F.col("_size"))
    each = placed.withColumn("n", F.explode(F.concat(powers, F.array("_size"))))
    share = lambda x: F.pow(x / F.col("_size"), F.col("n"))
    up, down = share(F.col("_i")) - share(F.col("_i") - 1), share(F.col("_size") - F.col("_i") + 1) - share(F.col("_size") - F.col("_i"))
    return each.groupBy(*key, "n").agg(F.sum(F.col(score) * up).alias("best"), F.sum(F.col(score) * down).alias("worst"))


def expected_best_at_k(df: DataFrame, k: int, key: Sequence[str], order: str, score: str = "score") -> DataFrame:
    """Unbiased expected best of k of n runs: the i-th lowest weighs C(i-1, k-1) / C(n, k), as a product. A
    key with fewer than k runs has k = n, which gives its maximum."""
    w = Window.partitionBy(*key)
    i, n = F.row_number().over(w.orderBy(score, order)), F.count("*").over(w)
    most = F.least(F.lit(k), "_n")
    weight = F.lit(1.0) * most / (F.col("_n") - most + 1)
    for j in range(k - 1):
        weight = weight * F.when(most > j + 1, (F.col("_i") - 1 - j) / (F.col("_n") - j)).otherwise(1.0)
    return df.withColumn("_i", i).withColumn("_n", n).groupBy(*key).agg(F.sum(F.col(score) * weight).alias("best_at_k"))


def batch_stats(df: DataFrame, score: str, length: str, limit: int) -> DataFrame:
    own = [f(c).alias(f"{c}_{n}") for c in (score, length) for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return df.agg(*own, F.avg((F.col(length) >= limit).cast("int")).alias("clip_ratio"), F.avg((F.col(length) == 0).cast("int")).alias("aborted_ratio"))


#: Rows of a key up to which its draws are taken inside one row; keys whose draws are taken together.
WITHIN, TOGETHER = 4000, 256


def _majority_within(ranked: DataFrame, key: Sequence[str], answer: str, score: str, n: int, draws: int, seed: int) -> DataFrame:
    """The mean of each key from the array of its rows; nothing is exploded. Answers are numbered within their key, and
    the draws of some keys are hashed together."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(answer).alias("x"), F.col(score).cast("double").alias("s")))), lambda r: F.struct(r.x.alias("x"), r.s.alias("s")))
    listed = ranked.groupBy(*key).agg(rows.alias("_rows")).withColumn("_kinds", F.array_distinct(F.transform("_rows", lambda r: r.x)))
    coded = F.transform("_rows", lambda r: F.coalesce(F.array_position("_kinds", r.x), F.lit(0)))
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.lit(""))

    full = (n + 1) // 2  # picks before which no answer can have won

    def tails(p: int) -> list[list[Ends]]:
        """For prefixes of ``p`` bytes the ends of each pick, for draws whose messages have the same sizes."""
        parts: dict[tuple, list] = {}
        for digits in numbers(0, draws):
            colon = np.full((len(digits), 1), ord(":"), np.uint8)
            ends = [Ends(np.hstack([digits, colon, np.tile(pick, (len(digits), 1))]), p) for picks in numbers(0, n) for pick in picks]
            parts.setdefault(tuple(e.size for e in ends), []).append(ends)
        return [[Ends.joined(list(x)) for x in zip(*some, strict=True)] for some in parts.values()]

    def winners(ends: list[Ends], prefixes: np.ndarray, size: np.ndarray, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The place of the row that each draw's majority answer was first seen in: (prefixes, draws). Picks that can't change
        a draw's winner are not hashed."""
        shape = (len(prefixes), ends[0].count)
        left = [e.left(prefixes) for e in ends]
        picked = [(ends[j].grid(left[j]) % size[:, None] + start[:, None]).ravel() for j in range(full)]
        x, lanes, row, column = [flat[p] for p in picked], slice(None), None, None
        won = picked[0].copy()
        while True:
            rest = n - len(x)
            votes = [np.ones(len(x[0]), np.int16) for _ in x]
            for i in range(len(x)):
                for j in range(i):
                    same = x[i] == x[j]
                    votes[i] += same
                    votes[j] += same
            best, most, code, first = picked[0], votes[0], x[0], np.zeros(len(x[0]), np.int16)
            for j in range(1, len(x)):
                more = votes[j] > most
                best, most, code, first = (np.where(more, new, old) for new, old in ((picked[j], best), (votes[j], most), (x[j], code), (j, first)))
            won[lanes] = best
            if not rest:
                return won.reshape(shape)
            open_ = most < rest
            for j in range(len(x)):
                margin = most - votes[j]
                open_ |= (x[j] != code) & ((margin < rest) | ((margin == rest) & (j < first)))
            open_ = np.flatnonzero(open_)
            if not len(open_):
                return won.reshape(shape)
            lanes = open_ if row is None else lanes[open_]
            row, column = np.divmod(lanes, shape[1])
            picked, x = [p[open_] for p in picked], [c[open_] for c in x]
            place = ends[len(x)].pairs(left[len(x)], row, column) % size[row] + start[row]
            picked.append(place)
            x.append(flat[place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_tails: dict[int, list[list[Ends]]] = {}
        for batch in batches:
            codes, scores = batch.column("_codes"), batch.column("_scores")
            sizes, starts = (np.asarray(x).astype(np.uint32) for x in (codes.value_lengths(), codes.offsets[:-1]))
            all_codes, known = codes.values.to_numpy().astype(np.int32), scores.values.is_valid().to_numpy(zero_copy_only=False)
            all_scores = np.where(known, scores.values.to_numpy(zero_copy_only=False), 0.0)
            for at in range(0, batch.num_rows, TOGETHER):
                some, size, start = batch.slice(at, TOGETHER), sizes[at : at + TOGETHER], starts[at : at + TOGETHER]
                held = slice(start[0], start[-1] + size[-1])
                flat, value, valid, start = all_codes[held], all_scores[held], known[held], start - start[0]
                one = np.minimum.reduceat(flat, start) == np.maximum.reduceat(flat, start)
                drawn, seen = np.zeros(some.num_rows), np.zeros(some.num_rows, np.int64)
                for r, prefixes in by_length(some.column("_prefix").to_pylist()):
                    p = prefixes.shape[1]
                    for ends in known_tails.setdefault(p, tails(p) if p not in known_tails else []):
                        for alone in (True, False):  # in keys with one answer the first pick has it
                            asked = np.flatnonzero((size[r] > 1) & (one[r] == alone))
                            tall = max(1, 4 * AT_ONCE // ends[0].count)
                            for low in range(0, len(asked), tall):
                                of = asked[low : low + tall]
                                k = r[of]
                                if alone:
                                    won = ends[0].grid(ends[0].left(prefixes[of])) % size[k][:, None] + start[k][:, None]
                                else:
                                    won = winners(ends, prefixes[of], size[k], start[k], flat)
                                drawn[k] += value[won].sum(axis=1)
                                seen[k] += valid[won].sum(axis=1)
                single = size == 1
                drawn[single], seen[single] = value[start[single]], valid[start[single]]
                yield pa.RecordBatch.from_arrays([*[some.column(k) for k in key], pa.array(drawn / np.maximum(seen, 1), mask=seen == 0)], names=[*key, "majority"])

    schema = StructType([*[listed.schema[k] for k in key], StructField("majority", DoubleType())])
    return listed.select(*key, prefix.alias("_prefix"), coded.alias("_codes"), F.transform("_rows", lambda r: r.s).alias("_scores")).mapInArrow(run, schema)


def majority(df: DataFrame, key: Sequence[str], answer: str, order: str, score: str, n: int, draws: int, seed: int, within: int = WITHIN) -> DataFrame:
    """Mean score of the majority answer over ``draws`` seeded resamples of n; ties go to the answer seen first.

    A key of up to ``within`` rows is one row with an array of these, which holds its draws. A larger one has no
    fewer rows than draws are made in all, so draws are exploded beside its rows; the join is a merge of both,
    for Spark would take the exploded side for small. Both ways give the same.
    """
    w = Window.partitionBy(*key)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_size", F.count("*").over(w))
    small = _majority_within(ranked.where(F.col("_size") <= within), key, answer, score, n, draws, seed)
    large = ranked.where(F.col("_size") > within)
    points = large.where("_i = 0").select(*key, "_size").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = points.withColumn("_i", F.pmod(seeded(seed, *[F.col(k) for k in key], F.col("_d"), F.col("_j")), F.col("_size"))).drop("_size")
    votes = drawn.hint("merge").join(large.select(*key, "_i", answer, score), [*key, "_i"]).groupBy(*key, "_d", answer).agg(F.count("*").alias("_v"), F.min("_j").alias("_f"), F.min_by(score, "_j").alias("_s"))
    won = votes.groupBy(*key, "_d").agg(F.max_by("_s", F.struct("_v", -F.col("_f"))).alias("_s"))
    return small.unionByName(won.groupBy(*key).agg(F.avg("_s").alias("majority")))


def score_weights(df: DataFrame, score: str, method: str, key: Sequence[str], power: float = 2.0) -> DataFrame:
    """``df`` with weight, for ``resample_by_score``. Fixed values: ``pow`` |score| to a power; ``max_min`` 1 for the highest
    and the lowest of a key, else 0; ``max_random`` 0.4 for the highest, else 0.1; 1e-8 is added to each."""
    if method not in ("pow", "max_min", "max_random"):
        raise ValueError(f"unknown method {method}")
    x = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(x), F.lit(power)) + 1e-8)
    ends = df.groupBy(*key).agg(F.max(score).alias("_high"), F.min(score).alias("_low"))
    top = x == F.col("_high")
    own = F.when(top | (x == F.col("_low")), 1.0).otherwise(0.0) if method == "max_min" else F.when(top, 0.4).otherwise(0.1)
    return df.join(ends, list(key)).withColumn("weight", own + 1e-8).drop("_high", "_low")


def resample_by_score(df: DataFrame, weight: Column, n: int, seed: int, order: str, key: Sequence[str]) -> DataFrame:
    """n draws with replacement from each key's rows, by weight: cumulative weights met by seeded points."""
    w = Window.partitionBy(*key)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spans = df.withColumn("_w", weight).withColumn("_high", F.sum("_w").over(run)).withColumn("_low", F.col("_high") - F.col("_w")).withColumn("_all", F.sum("_w").over(w))
    points = df.select(*key).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_u", seeded(seed, *[F.col(k) for k in key], F.col("draw")) / 4294967296.0)
    return points.join(spans, list(key)).where((F.col("_u") * F.col("_all") >= F.col("_low")) & (F.col("_u") * F.col("_all") < F.col("_high"))).drop("_w", "_low", "_high", "_all", "_u")
