"""Identity: galleries, similarity, thresholds, drift, and tracks against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import iou, round_half_away as rnd
from .spatial import overlapping
from . import blocks
from .blocks import ahead_of_hits, block_scores, hit_ranks, label_hits, merged_counts, score_counts, top_labels, top_rows, usable


def gallery_top(queries: DataFrame, gallery: DataFrame, k: int = 3) -> DataFrame:
    """The k identities of the highest similarity for each query, an identity's being that of its best vector. An identity
    that is among the k of all blocks is among the k of the block that holds its best vector."""
    best = block_scores(queries, gallery, top_labels(k), "q long, g_label long, sim double").groupBy("q", "g_label").agg(F.max("sim").alias("sim"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "g_label"))).where(F.col("rank") <= k)


def role_after_top(queries: DataFrame, gallery: DataFrame, role, k: int = 5) -> DataFrame:
    """The best identity of a role among the top k: the role is looked at after the cut, not before."""
    top = gallery_top(queries, gallery, k).where(role)
    return top.groupBy("q").agg(F.min(F.struct("rank", "g_label", "sim")).alias("b")).select("q", "b.g_label", "b.sim", "b.rank")


def bands(queries: DataFrame, gallery: DataFrame, match: float, review: float, margin: float = 0.02) -> DataFrame:
    top = gallery_top(queries, gallery, 2).groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("second"))
    gap = F.col("best") - F.coalesce("second", F.lit(-1.0))
    band = F.when((F.col("best") >= match) & (gap > margin), "match").when(F.col("best") >= review, "review").otherwise("unknown")
    return top.select("q", "best", F.round(gap, 6).alias("margin"), band.alias("band"))


def travelling_hits(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(q, r1, r5, ap): a query's hits travel with it, and each block counts what ranks before them."""
    hits = block_scores(queries, gallery, label_hits, "q long, hits array<struct<sim:double,g:long>>")
    hits = hits.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    asked = queries.join(hits, F.col("vec_id") == F.col("q")).select("vec_id", "label", "embedding", "hits")
    ahead = block_scores(asked, gallery, ahead_of_hits, "q long, ahead array<long>")
    ranks = ahead.select("q", F.posexplode_outer("ahead").alias("at", "n")).groupBy("q", "at").agg((F.sum("n") + 1).alias("rank"))
    return ranks.groupBy("q").agg(F.coalesce(F.min("rank") <= 1, F.lit(False)).cast("int").alias("r1"), F.coalesce(F.min("rank") <= 5, F.lit(False)).cast("int").alias("r5"), F.coalesce(F.avg((F.col("at") + 1) / F.col("rank")), F.lit(0.0)).alias("ap"))


def rank_metrics(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Rank 1, rank 5 and mean average precision. A query's hits are a share of the gallery, so they are ranked where the whole
    gallery is and don't leave the task; of a gallery too large for one, see ``travelling_hits``."""
    if usable(gallery).count() <= blocks.WHOLE:
        each = block_scores(queries, gallery, hit_ranks, "q long, r1 int, r5 int, ap double", whole=True)
    else:
        each = travelling_hits(queries, gallery)
    return each.agg(rnd(F.avg("r1"), 4).alias("rank1"), rnd(F.avg("r5"), 4).alias("rank5"), rnd(F.avg("ap"), 4).alias("map"))


def leave_one_out(vectors: DataFrame) -> DataFrame:
    """Each vector against all others. Among five vectors or fewer its own, ranked last, is within the first five; without any
    both rates are null."""
    hits = block_scores(vectors, vectors, top_rows(5), "q long, q_label long, g long, g_label long, sim double")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "g"))).where("rank <= 5")
    each = hits.groupBy("q", "q_label").agg(F.max(F.when(F.col("rank") == 1, (F.col("q_label") == F.col("g_label")).cast("int"))).alias("r1"), F.max((F.col("q_label") == F.col("g_label")).cast("int")).alias("r5"))
    few = F.when(F.count("*").between(1, 5), 1.0).otherwise(F.avg("r5"))
    return each.agg(rnd(F.avg("r1"), 4).alias("rank1"), rnd(few, 4).alias("rank5"), F.count("*").alias("samples"), F.count_distinct("q_label").alias("identities"))


def thresholds(vectors: DataFrame, target_far: float = 0.01, review_far: float = 0.05) -> DataFrame:
    """Similarities above which a stranger passes with the rates asked for: exact quantiles, interpolated, of the scores of
    pairs of two identities, from how many pairs have each score (no more than 2,000,001 scores, whatever the pairs)."""
    counts = block_scores(vectors, vectors, score_counts, "same boolean, millionths long, n long", halves=True, merge=merged_counts)
    # a row without pairs, so that the check below is made even where no pair is of one identity
    counts = counts.unionByName(vectors.sparkSession.createDataFrame([(True, 2_000_000, 0)], counts.schema)).groupBy("same", "millionths").agg(F.sum("n").alias("n"))
    w = W.partitionBy("same").orderBy("millionths")
    run = counts.withColumn("upto", F.sum("n").over(w)).withColumn("sim", F.col("millionths") / 1e6)
    run = run.withColumn("all", F.sum("n").over(W.partitionBy("same")))
    other, pairs = ~F.col("same"), F.col("sim") * F.col("n")

    def quantile(share: float):
        at = (F.col("all") - 1) * share
        lo = F.min(F.when(other & (F.col("upto") > F.floor(at)), F.col("sim")))
        hi = F.min(F.when(other & (F.col("upto") > F.ceil(at)), F.col("sim")))
        part = F.max(F.when(other, at - F.floor(at)))
        return lo + (hi - lo) * part

    cut = run.agg(quantile(1 - target_far).alias("m"), quantile(1 - review_far).alias("r"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("impostor_pairs"), F.sum(F.when(other, pairs)).alias("i_sum"), F.coalesce(F.sum(F.when(~other, F.col("n"))), F.lit(0)).alias("genuine_pairs"), F.sum(F.when(~other, pairs)).alias("g_sum"))
    both = F.assert_true((F.col("impostor_pairs") > 0) & (F.col("genuine_pairs") > 0), F.lit("thresholds need pairs of one identity and of two"))
    taken = run.where("same").join(F.broadcast(cut.where(both.isNull())))  # cut is one row
    out = taken.groupBy("m", "r", "impostor_pairs", "i_sum", "genuine_pairs", "g_sum").agg(F.sum(F.when(F.col("sim") >= F.col("m"), F.col("n")).otherwise(0)).alias("accepted"))
    return out.select(rnd(F.col("m"), 4).alias("match_threshold"), rnd(F.col("r"), 4).alias("review_threshold"), "impostor_pairs", rnd(F.col("i_sum") / F.col("impostor_pairs"), 4).alias("impostor_mean"), "genuine_pairs", rnd(F.col("g_sum") / F.col("genuine_pairs"), 4).alias("genuine_mean"), rnd(F.col("accepted") / F.col("genuine_pairs"), 4).alias("genuine_accept"))


def drift(vectors: DataFrame, size: int = 200, least: int = 10) -> DataFrame:
    """1 - cosine of the mean of a camera's first ``size`` vectors and that of the last ``size`` of the others; null unless
    the first are ``size`` and the others ``least`` or more, and where a mean has no length. vectors: cam, n (order), embedding."""
    w = W.partitionBy("cam").orderBy("n")
    v = vectors.withColumn("at", F.row_number().over(w)).withColumn("back", F.row_number().over(W.partitionBy("cam").orderBy(F.desc("n"))))
    part = F.when(F.col("at") <= size, "first").when(F.col("back") <= size, "last")
    parts = v.withColumn("part", part).where("part IS NOT NULL").select("cam", "part", F.posexplode("embedding").alias("pos", "x"))
    of = lambda which, f, x: f(F.when(F.col("part") == which, x))
    x = F.col("x").cast("double")
    means = parts.groupBy("cam", "pos").agg(of("first", F.avg, x).alias("a"), of("last", F.avg, x).alias("b"), of("first", F.count, x).alias("n_a"), of("last", F.count, x).alias("n_b"))
    cos = F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))
    return means.groupBy("cam").agg(F.when((F.max("n_a") >= size) & (F.max("n_b") >= least), rnd(1 - cos, 4)).alias("drift"))


def best_overlaps(predictions: DataFrame, truth: DataFrame, least: float = 0.3) -> DataFrame:
    """Each prediction's ground-truth box of the highest overlap above ``least`` (0 or more) in its frame; ties go to the first."""
    over = iou(F.col("box"), F.col("gt_box"))
    pairs = overlapping(predictions, truth, ["frame"], "box", "gt_box").withColumn("iou", F.round(over, 9)).where(F.col("iou") > least)
    return pairs.groupBy("frame", "pred").agg(F.max(F.struct("iou", (-F.col("gt")).alias("first"))).alias("b")).select("frame", "pred", (-F.col("b.first")).alias("gt"), rnd(F.col("b.iou"), 6).alias("iou"))


def identity_report(pairs: DataFrame) -> DataFrame:
    """pairs: name, gid. Purity, and how many gids hold at least 2% of each person's frames."""
    counts = pairs.groupBy("name", "gid").agg(F.count("*").alias("n"))
    pure = counts.groupBy("gid").agg(F.max("n").alias("top"), F.sum("n").alias("all")).agg((F.sum("top") / F.sum("all")).alias("purity"))
    total = counts.groupBy("name").agg(F.sum("n").alias("t"))
    frag = counts.join(total, "name").where(F.col("n") >= 0.02 * F.col("t")).groupBy("name").agg(F.count("*").alias("ids")).agg(F.avg("ids").alias("fragmentation"), F.count("*").alias("people"))
    return pure.join(F.broadcast(frag)).select(rnd(F.col("purity"), 4).alias("purity"), rnd(F.col("fragmentation"), 4).alias("fragmentation"), "people")


def identity_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs, one for each frame of a person: name, gid, is_employee, said_employee, employee_id. One row: matched frames,
    purity, mean fragmentation (ids that hold 2% of a person's frames or more), how often the role is right, and for
    employees how often the id is right and how often there is none."""
    counts = pairs.groupBy("name", "gid").agg(F.count("*").alias("n"))
    pure = counts.groupBy("gid").agg(F.max("n").alias("top")).agg(F.coalesce(F.sum("top"), F.lit(0)).alias("top"))
    whole = W.partitionBy("name")
    ids = counts.withColumn("t", F.sum("n").over(whole)).groupBy("name").agg(F.count_if(F.col("n") >= 0.02 * F.col("t")).alias("ids"))
    split = ids.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.count("*").alias("people"))
    right = pairs.agg(
        F.count("*").alias("matched_frames"),
        F.count_if(F.col("is_employee") == F.col("said_employee")).alias("role_ok"),
        F.count_if("is_employee").alias("staff"),
        F.count_if(F.col("is_employee") & F.col("employee_id").isNull()).alias("unknown"),
        F.count_if(F.col("is_employee") & (F.col("employee_id") == F.col("name"))).alias("id_ok"),
    )
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  each side is a single row
    row = one(right).join(one(pure), "one").join(one(split), "one")
    share = lambda part, all_: rnd(F.col(part) / F.greatest(F.col(all_), F.lit(1)), 3)
    return row.select("matched_frames", share("top", "matched_frames").alias("purity"), share("ids", "people").alias("mean_fragmentation"), share("role_ok", "matched_frames").alias("role_accuracy"), share("id_ok", "staff").alias("employee_id_accuracy"), share("unknown", "staff").alias("employee_unknown_ratio"))


def ids_per_person(pairs: DataFrame) -> DataFrame:
    """Each person's ids, the one with the most frames first (ties by id)."""
    counts = pairs.groupBy("name", "gid").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gid")))
    return counts.groupBy("name").agg(F.array_join(F.transform(ordered, lambda x: x["gid"]), ",").alias("ids"))
