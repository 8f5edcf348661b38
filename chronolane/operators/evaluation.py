"""Reports over scores: slices with their gaps, bootstrap intervals of ranking measures, fidelity, twins, telemetry.

Like in ``metrics``, rows first meet by distinct score, inside the partition of a slice, model or replicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.metrics import average_precision, auroc, brier, calibration_error, md5_digits, nearest_ranks, poisson_digits
from chronolane.operators.ordered import join_by, percentiles, running
from chronolane.sources.catalog import written_once


def long_form(df: DataFrame, keep: list[str], columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """One row for each row of df and each of columns: keep, name, value."""
    cells = F.array(*(F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in columns.items()))
    return df.select(*keep, F.explode(cells).alias("__c")).select(*keep, "__c.*")


def slice_details(df: DataFrame, columns: list[str], p: str, y: str, least_rows: int = 500, least_events: int = 25) -> DataFrame:
    """slice_name, slice_value, n, events, base_rate, mean_predicted, auroc, brier, ece, measured, reason.

    Below the support floor only n, events, base_rate and the reason are known; auroc is null for one class.
    """
    long = long_form(df, [p, y], {c: F.col(c).cast("string") for c in columns}, "slice_name", "slice_value")
    by = ["slice_name", "slice_value"]
    base = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("long")).alias("events"),
        F.round(F.avg(y), 6).alias("base_rate"),
        F.round(F.avg(p), 6).alias("mean_predicted"),
        F.round(brier(p, y), 6).alias("brier"),
    )
    both = base.join(auroc(long, p, y, by), by, "left").join(calibration_error(long, p, y, 10, by), by, "left")
    ok = (F.col("n") >= least_rows) & (F.col("events") >= least_events)
    shown = {c: F.when(ok, F.col(c)) for c in ("mean_predicted", "auroc", "brier", "ece")}
    return both.withColumns(shown | {"measured": ok.cast("int"), "reason": F.when(~ok, "below support floor")})


def slice_summary(details: DataFrame) -> DataFrame:
    """For each slice_name: how many slices were measured, the best and worst by AUROC and ECE, and the gaps; ties go to the first value."""
    best = lambda c, sign: F.min(F.when(F.col(c).isNotNull(), F.struct((sign * F.col(c)).alias("o"), "slice_value")))["slice_value"]
    return details.groupBy("slice_name").agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.sum("measured").alias("n_measured"),
        F.sum(1 - F.col("measured")).alias("n_unmeasured"),
        best("auroc", -1).alias("auroc_best"),
        best("auroc", 1).alias("auroc_worst"),
        F.round(F.max("auroc") - F.min("auroc"), 6).alias("auroc_gap"),
        best("ece", 1).alias("ece_best"),
        best("ece", -1).alias("ece_worst"),
        F.round(F.max("ece") - F.min("ece"), 6).alias("ece_gap"),
    )


def _weighted(df: DataFrame, key: str, replicates: int) -> tuple[DataFrame, list[str]]:
    """df with a column for each replicate's Poisson weights, which follow from the key, and their names."""
    reps = range(1, replicates + 1)
    x = df.withColumns({f"__h{r}": md5_digits(F.lit(r).cast("string"), key) for r in reps})
    return x.withColumns({f"__w{r}": poisson_digits(F.col(f"__h{r}")) for r in reps}).drop(*(f"__h{r}" for r in reps)), [f"__w{r}" for r in reps]


def replicated_auroc(df: DataFrame, p: str, y: str, weights: list[str], by: list[str]) -> DataFrame:
    """by, rep, auroc with each of the columns of weights; null where a class has no weight.

    The replicates are sums beside each other in the row of a score, so rows do not multiply by them.
    """
    reps = range(1, len(weights) + 1)
    sums = [F.sum(F.col(w) * side).alias(f"__{n}{r}") for r, w in zip(reps, weights, strict=True) for n, side in (("pos", F.col(y)), ("neg", 1 - F.col(y)))]
    cells = written_once(df.groupBy(*by, F.col(p).alias("__p")).agg(*sums))
    s = running(cells, by, "__p", [f"__neg{r}" for r in reps])
    u = [F.sum(F.col(f"__pos{r}") * (F.col(f"before___neg{r}") + F.col(f"__neg{r}") / 2.0)) for r in reps]
    area = [F.try_divide(x, (F.sum(f"__pos{r}") * F.sum(f"__neg{r}")).cast("double")) for r, x in zip(reps, u, strict=True)]
    return s.groupBy(*by).agg(F.array(*area).alias("__a")).select(*by, F.posexplode("__a").alias("__i", "auroc")).select(*by, (F.col("__i") + 1).alias("rep"), "auroc")


def bootstrap_auroc(df: DataFrame, key: str, y: str, scores: dict[str, Column], replicates: int) -> DataFrame:
    """space, auroc, lo, hi, and the paired difference from the first space with its interval and whether it is above 0."""
    first = next(iter(scores))
    drawn, weights = _weighted(df, key, replicates)
    draws = replicated_auroc(long_form(drawn, [y, *weights], scores, "space", "__s"), "__s", y, weights, ["space"])
    base = draws.filter(F.col("space") == first).select("rep", F.col("auroc").alias("__b"))
    q = lambda c, x: F.round(F.percentile(c, x), 6)
    ci = draws.join(base, "rep").withColumn("__d", F.col("auroc") - F.col("__b")).groupBy("space")
    ci = ci.agg(q("auroc", 0.025).alias("lo"), q("auroc", 0.975).alias("hi"), q("__d", 0.025).alias("diff_lo"), q("__d", 0.975).alias("diff_hi"))
    point = auroc(long_form(df, [y], scores, "space", "__s"), "__s", y, ["space"])
    return point.join(ci, "space").withColumn("beats_first", (F.col("diff_lo") > 0).cast("int"))


def mean_ranks(df: DataFrame, key: str, p: str, by: list[str]) -> DataFrame:
    """by, key, rank: the average rank of tied values, from counts of distinct values within by."""
    cells = df.groupBy(*by, F.col(p).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cells = running(cells.filter("__v is not null"), by, "__v", ["__n"]).select(*by, "__v", (F.col("before___n") + (F.col("__n") + 1) / 2.0).alias("rank"))
    return df.select(*by, key, F.col(p).alias("__v")).join(cells, [*by, "__v"]).select(*by, key, "rank")


def fidelity(df: DataFrame, key: str, y: str, reference: str, reduced: str, by: list[str], replicates: int) -> DataFrame:
    """by, auroc_reference, auroc_reduced, retention (share of the lift over chance that is kept) with its interval, and spearman of both scores."""
    a = auroc(df, reference, y, by).withColumnRenamed("auroc", "auroc_reference")
    b = auroc(df, reduced, y, by).withColumnRenamed("auroc", "auroc_reduced")
    kept = lambda low, high: F.when(F.col(high) > 0.5, (F.col(low) - 0.5) / (F.col(high) - 0.5))
    point = a.join(b, by).withColumn("retention", F.round(kept("auroc_reduced", "auroc_reference"), 6))
    reps, weights = _weighted(df, key, replicates)
    r = replicated_auroc(reps, reference, y, weights, by).withColumnRenamed("auroc", "__a")
    s = replicated_auroc(reps, reduced, y, weights, by).withColumnRenamed("auroc", "__b")
    draws = r.join(s, [*by, "rep"]).withColumn("__k", kept("__b", "__a")).groupBy(*by)
    ci = draws.agg(F.round(F.percentile("__k", 0.025), 6).alias("lo"), F.round(F.percentile("__k", 0.975), 6).alias("hi"))
    one = mean_ranks(df, key, reference, by).withColumnRenamed("rank", "__x")
    two = mean_ranks(df, key, reduced, by).withColumnRenamed("rank", "__y")
    rho = one.join(two, [*by, key]).groupBy(*by).agg(F.round(F.corr("__x", "__y"), 6).alias("spearman"))
    return point.join(ci, by).join(rho, by)


def prediction_report(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """by, n, base_rate, auroc, auprc, top_decile_rate and its enrichment, and the mean score and its enrichment.

    The top decile holds all rows at or above the interpolated 90th percentile of the scores.
    """
    cut = percentiles(df, by, p, {"__cut": 0.9})
    base = df.join(cut, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("__base"), F.avg(F.when(F.col(p) >= F.col("__cut"), F.col(y))).alias("__top"), F.avg(p).alias("__mean"))
    shown = {"base_rate": F.round("__base", 6), "top_decile_rate": F.round("__top", 6), "top_decile_enrichment": F.round(F.try_divide("__top", "__base"), 6), "unconditional": F.round("__mean", 6), "unconditional_enrichment": F.round(F.try_divide("__mean", "__base"), 6)}
    return base.join(auroc(df, p, y, by), by).join(average_precision(df, p, y, by), by).withColumns(shown).drop("__base", "__top", "__mean")


def agreement(pairs: DataFrame, sets: DataFrame, value: str, codes: str, label: str) -> DataFrame:
    """n_pairs, match_pct, mean_jaccard, value_mae and enrichment of pairs (query_id, neighbour_id) over sets (id, label, codes, value).

    enrichment: how much more often neighbours share a label than two rows drawn by the labels' shares would.
    """
    side = lambda p, i: sets.select(F.col("id").alias(i), *(F.col(c).alias(f"{p}{c}") for c in (label, codes, value)))
    j = pairs.join(side("q_", "query_id"), "query_id").join(side("n_", "neighbour_id"), "neighbour_id")
    both = F.size(F.array_intersect(f"q_{codes}", f"n_{codes}")) / F.size(F.array_union(f"q_{codes}", f"n_{codes}"))
    match = F.avg((F.col(f"q_{label}") == F.col(f"n_{label}")).cast("int"))
    share = sets.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).agg((F.sum(F.col("__n") * F.col("__n")) / (F.sum("__n") * F.sum("__n")).cast("double")).alias("__chance"))
    out = j.agg(F.count(F.lit(1)).alias("n_pairs"), match.alias("__m"), F.round(F.avg(both), 6).alias("mean_jaccard"), F.round(F.avg(F.abs(F.col(f"q_{value}") - F.col(f"n_{value}"))), 6).alias("value_mae"))
    return out.crossJoin(F.broadcast(share)).withColumns({"match_pct": F.round(100 * F.col("__m"), 4), "enrichment": F.round(F.try_divide("__m", "__chance"), 6)}).drop("__m", "__chance")


def equal_count_bins(df: DataFrame, key: str, p: str, y: str, by: list[str], bins: int = 10) -> DataFrame:
    """by, bin, n, mean_p, rate: calibration points of bins with equal numbers of rows, in order of score, then key."""
    known = df.filter(F.col(p).isNotNull())
    cells = known.groupBy(*by, F.col(p).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cells = join_by(running(cells, by, "__v", ["__n"]), cells.groupBy(*by).agg(F.sum("__n").alias("__size")), by).withColumnRenamed("__v", p)
    at = F.col("before___n") + F.row_number().over(W.partitionBy(*by, p).orderBy(key)) - 1
    cut = join_by(known, cells, [*by, p]).withColumn("bin", F.floor(at * bins / F.col("__size")).cast("int"))
    return cut.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def tier_report(df: DataFrame, p: str, y: str, shares: list[float]) -> DataFrame:
    """tier, n, share, events, rate, lift, and monotone: whether no tier's rate is below that of the tier before."""
    names = {f"q{i}": q for i, q in enumerate(shares)}
    cuts = percentiles(df, [], p, names).select(F.array(*names).alias("__cuts"))
    cuts = cuts.crossJoin(df.agg(F.avg(y).alias("__base"), F.count(F.lit(1)).alias("__all")))  # one row each
    tier = F.size(F.filter("__cuts", lambda c: c <= F.col(p))) + 1
    t = df.crossJoin(F.broadcast(cuts)).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"), F.avg(y).alias("__r"), F.max("__base").alias("__b"), F.max("__all").alias("__all"))
    t = t.withColumn("__last", F.lag("__r").over(W.orderBy("tier")))  # as many rows as tiers
    falls = F.max((F.col("__r") < F.col("__last")).cast("int")).over(W.partitionBy())
    return t.select("tier", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"), "events", F.round("__r", 6).alias("rate"), F.round(F.col("__r") / F.col("__b"), 6).alias("lift"), (1 - F.coalesce(falls, F.lit(0))).alias("monotone"))


def telemetry_report(log: DataFrame, session: str, turn: str, status: str, intent: str, latency: str, answered: list[str], refused: list[str]) -> DataFrame:
    """measure, item, value, long: totals, counts by status and intent, rates, and nearest-rank percentiles of the latency.

    A row is a turn; rates are null for an empty log.
    """
    n = F.count(F.lit(1))
    rate = lambda c: F.try_divide(F.count_if(c).cast("double"), n)
    sessions = log.groupBy(session).agg(F.max(turn).alias("__t")).agg(F.count(F.lit(1)).cast("double").alias("n_sessions"), F.avg("__t").alias("turns_per_session_mean"))
    one = log.agg(n.cast("double").alias("n_turns"), rate(F.col(status).isin(*answered)).alias("answer_rate"), rate(F.col(status).isin(*refused)).alias("refusal_rate"), rate(F.coalesce(F.col(intent), F.lit("unknown")) == "unknown").alias("unknown_intent_rate"), F.max(latency).cast("double").alias("latency_max"))
    ranks = nearest_ranks(log.withColumn("__all", F.lit("all")), "__all", latency, {"latency_p50": 0.5, "latency_p95": 0.95}).drop("__all")
    wide = one.crossJoin(F.broadcast(sessions)).join(F.broadcast(ranks), F.lit(True), "left")
    cells = {c: F.round(F.col(c).cast("double"), 6) for c in wide.columns}
    totals = long_form(wide, [], cells, "measure", "value").select("measure", F.lit("").alias("item"), "value")
    count = lambda c, name: log.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("item")).agg(n.cast("double").alias("value")).select(F.lit(name).alias("measure"), "item", "value")
    return totals.unionByName(count(status, "status")).unionByName(count(intent, "intent"))


def context_ranking(runs: DataFrame, grades: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """query, context_precision, context_recall. runs: query, doc, rank; grades: query, doc, grade.

    context_precision: the mean of precision at each of the first k positions that hold a relevant
    document, 0 without one; context_recall: the share of relevant documents retrieved at any rank.
    Both are null for queries without a relevant document. With counts (query, grade, n), grades need hold no more
    than the documents of the runs.
    """
    rel = grades.filter("grade > 0").select("query", "doc").distinct()
    known = rel.groupBy("query").agg(F.count(F.lit(1)).alias("__rel")) if counts is None else counts.groupBy("query").agg(F.sum("n").alias("__rel"))
    hits = runs.join(rel, ["query", "doc"]).withColumn("__i", F.row_number().over(W.partitionBy("query").orderBy("rank")))
    at = F.avg(F.when(F.col("rank") <= k, F.col("__i") / F.col("rank")))
    found = hits.groupBy("query").agg(at.alias("__p"), F.count(F.lit(1)).alias("__n"))
    out = runs.select("query").distinct().join(known, "query", "left").join(found, "query", "left")
    some = F.col("__rel").isNotNull()
    return out.select("query", F.when(some, F.round(F.coalesce("__p", F.lit(0.0)), 6)).alias("context_precision"), F.when(some, F.round(F.coalesce("__n", F.lit(0)) / F.col("__rel"), 6)).alias("context_recall"))


def scope_report(queries: DataFrame, runs: DataFrame, grades: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """in_scope, n_queries, answered, rate_right of the queries (query) with and without a relevant document.

    A query in scope is right if any relevant document was retrieved, one out of scope if nothing was. With counts
    (query, grade, n), grades need hold no more than the documents of the runs.
    """
    rel = grades.filter("grade > 0").select("query", "doc").distinct()
    scope = (rel if counts is None else counts).select("query", F.lit(1).alias("in_scope")).distinct()
    got = runs.groupBy("query").agg(F.count(F.lit(1)).alias("__n"))
    hit = runs.join(rel, ["query", "doc"]).select("query", F.lit(1).alias("__h")).distinct()
    j = queries.select("query").distinct().join(scope, "query", "left").join(got, "query", "left").join(hit, "query", "left").fillna(0, ["in_scope", "__n", "__h"])
    right = F.when(F.col("in_scope") == 1, F.col("__h")).otherwise((F.col("__n") == 0).cast("int"))
    return j.groupBy("in_scope").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("__n") > 0).alias("answered"), F.round(F.avg(right), 6).alias("rate_right"))
