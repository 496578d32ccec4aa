"""Store domains, rules and drift measures (M1–M9).

All measures are grouped aggregates or windows on the store-day table;
the learned parts (clustering, rule mining, domain classifier) are
``pyspark.ml`` estimators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import store_profile

LARGE_FORMAT_ML = 1000.0


def store_groups(store_day: DataFrame, materialize: bool = True) -> DataFrame:
    """M1: one row per store with its size class (1/2/3 from the store
    profile) and volume tier (mean bottle volume above 1000 ml → 'large'),
    and the group label ``size<k>_<tier>``."""
    prof = store_profile(store_day, materialize=materialize)
    vol = store_day.groupBy("store").agg(F.avg("bottle_volume_ml_mean").alias("avg_bottle_volume_ml"))
    g = prof.join(vol, "store")
    tier = F.when(F.col("avg_bottle_volume_ml") > LARGE_FORMAT_ML, F.lit("large")).otherwise(F.lit("standard"))
    return g.withColumn("volume_tier", tier).withColumn(
        "store_group", F.concat(F.lit("size"), F.col("store_size").cast("string"), F.lit("_"), tier))


def split_domains(df: DataFrame, *, date_cut=None, source_groups=None,
                  group_col: str = "store_group") -> DataFrame:
    """M2: label rows 'source' / 'target' by a date cut (before → source)
    or by a list of source groups."""
    if date_cut is not None:
        cond = F.col("date") < F.lit(date_cut).cast("date")
    else:
        cond = F.col(group_col).isin(*source_groups)
    return df.withColumn("domain", F.when(cond, F.lit("source")).otherwise(F.lit("target")))


def discover_domains(store_day: DataFrame, features: list[str], k: int = 4,
                     period: str = "quarter", seed: int = 7) -> DataFrame:
    """M3: cluster store profiles per period with KMeans on standardised
    per-store means; returns (store, period, domain)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    per = F.date_trunc(period, F.col("date")).cast("date")
    prof = (store_day.withColumn("period", per).groupBy("store", "period")
            .agg(*[F.avg(c).alias(c) for c in features]).fillna(0.0, subset=features))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"),
                            StandardScaler(inputCol="_raw", outputCol="_f", withMean=True, withStd=True),
                            KMeans(featuresCol="_f", k=k, seed=seed, predictionCol="domain")])
    return pipe.fit(prof).transform(prof).select("store", "period", "domain")


def assignment(cost) -> list[int]:
    """The column of each row in a square matrix at least total cost, by
    shortest augmenting paths with potentials (ties: the lowest column)."""
    n = len(cost)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while row_of[at]:
            used[at], here, gap, to = True, row_of[at], float("inf"), 0
            for j in range(1, n + 1):
                if used[j]:
                    continue
                c = cost[here - 1][j - 1] - u[here] - v[j]
                if c < least[j]:
                    least[j], way[j] = c, at
                if least[j] < gap:
                    gap, to = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]] += gap
                    v[j] -= gap
                else:
                    least[j] -= gap
            at = to
        while at:
            row_of[at], at = row_of[way[at]], way[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def align_centres(centres: dict) -> dict:
    """{period: [new label of each cluster]}: in order of periods, clusters
    take the labels of the period before so that the centres move least in
    sum (squared distance).  The first period is numbered by its centres, so
    labels do not depend on the numbers that clusters came with."""
    out, before = {}, None
    for period in sorted(centres):
        now = [list(map(float, c)) for c in centres[period]]
        if before is None:
            order = sorted(range(len(now)), key=lambda i: now[i])
            label = [order.index(i) for i in range(len(now))]
        else:
            label = assignment([[sum((x - y) ** 2 for x, y in zip(a, b)) for b in before] for a in now])
        out[period] = label
        before = [now[label.index(k)] for k in range(len(now))]
    return out


def domains_over_time(store_day: DataFrame, features: list[str], k: int = 4, period: str = "quarter",
                      seed: int = 7, rounds: int = 10) -> DataFrame:
    """M3 over time: (store, period, domain) with domains that keep their
    label from period to period.

    Profiles are standardised over all periods and clustered by one KMeans;
    its centres then move to each period's own profiles by a few Lloyd rounds
    that all periods take together: one pass assigns every profile to the
    nearest centre of its period and averages per (period, cluster).  The
    driver holds periods x k centres, a bound of the calendar.  Centres of
    neighbouring periods are matched by ``align_centres``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from ..session import cut_lineage
    per = F.date_trunc(period, F.col("date")).cast("date")
    prof = (store_day.withColumn("period", per).groupBy("store", "period")
            .agg(*[F.avg(c).cast("double").alias(c) for c in features]).fillna(0.0, subset=features))
    prof = cut_lineage(prof)
    if prof.isEmpty():
        return prof.select("store", "period", F.lit(0).alias("domain"))
    scale = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"),
                             StandardScaler(inputCol="_raw", outputCol="_f", withMean=True, withStd=True)])
    points = cut_lineage(scale.fit(prof).transform(prof).select("store", "period", vector_to_array("_f").alias("p")))
    first = KMeans(featuresCol="_v", k=k, seed=seed).fit(points.withColumn("_v", array_to_vector("p"))).clusterCenters()
    start = [list(map(float, c)) for c in first] + [list(map(float, first[-1]))] * (k - len(first))
    centres = {r["period"]: start for r in points.select("period").distinct().collect()}
    for _ in range(rounds):
        moved = dict(centres)
        means = (nearest_centre(points, centres).groupBy("period", "cluster")
                 .agg(F.array(*[F.avg(F.col("p")[i]) for i in range(len(features))]).alias("c")))
        for r in means.collect():
            moved[r["period"]] = [list(r["c"]) if j == r["cluster"] else c for j, c in enumerate(moved[r["period"]])]
        same = all(abs(x - y) < 1e-9 for t in centres for a, b in zip(centres[t], moved[t]) for x, y in zip(a, b))
        centres = moved
        if same:
            break
    labels = [(t, j, new) for t, label in align_centres(centres).items() for j, new in enumerate(label)]
    names = points.sparkSession.createDataFrame(labels, "period date, cluster int, domain int")
    return nearest_centre(points, centres).join(F.broadcast(names), ["period", "cluster"]).select("store", "period", "domain")  # periods x k rows


def nearest_centre(points: DataFrame, centres: dict) -> DataFrame:
    """``points`` (store, period, p) with ``cluster``, the nearest of the
    centres of their period (periods x k rows, broadcast)."""
    table = points.sparkSession.createDataFrame(list(centres.items()), "period date, centres array<array<double>>")
    def distance(c):
        return F.aggregate(F.zip_with(c, "p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("centres", lambda c, i: F.struct(distance(c).alias("d"), i.alias("i"))))
    return points.join(F.broadcast(table), "period").withColumn("cluster", best["i"]).drop("centres")


def domain_transitions(domains: DataFrame, key: str = "store", period: str = "period", domain: str = "domain") -> DataFrame:
    """M3: per period, how many stores moved from which domain to which;
    a store's previous domain is that of its previous period present."""
    w = Window.partitionBy(key).orderBy(period)
    moves = domains.withColumn("from_domain", F.lag(domain).over(w)).where(F.col("from_domain").isNotNull())
    return (moves.groupBy(period, "from_domain", F.col(domain).alias("to_domain"))
            .agg(F.count(F.lit(1)).alias("stores")))


def cut_points(df: DataFrame, columns: list[str], parts: int = 3) -> dict[str, list[float]]:
    """M4: cut points of each column learned from the data, its exact
    quantiles at k / ``parts``; equal ones are one."""
    from .quantile import exact_quantiles
    found = exact_quantiles(df, {c: [k / parts for k in range(1, parts)] for c in columns})
    return {c: sorted({x for x in v if x is not None}) for c, v in found.items()}


def interval_conditions(cuts: dict[str, list[float]]) -> dict[str, str]:
    """{item: SQL predicate}: which interval between cut points holds a value."""
    out = {}
    for c, points in cuts.items():
        edges = [None, *points, None]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            tests = ([f"{c} > {lo!r}D"] if lo is not None else []) + ([f"{c} <= {hi!r}D"] if hi is not None else [])
            out[f"{c}:{k + 1}"] = " AND ".join(tests or [f"{c} IS NOT NULL"])
    return out


def rules_as_predicates(rules: DataFrame, conditions: dict[str, str], top: int = 20) -> list[tuple[str, str, str]]:
    """M4 → M5: the ``top`` mined rules by lift (a report; ties by name) as
    (name, antecedent, consequent) predicates that ``rule_compliance`` takes."""
    named = rules.select("lift", F.sort_array("antecedent").alias("a"), F.sort_array("consequent").alias("c"))
    best = named.orderBy(F.desc(F.round("lift", 9)), "a", "c").limit(top).collect()
    def both(items):
        return " AND ".join(f"({conditions[i]})" for i in items)
    return [(f"{' & '.join(r['a'])} => {' & '.join(r['c'])}", both(r["a"]), both(r["c"])) for r in best]


def mine_and_check(df: DataFrame, conditions: dict[str, str], level: str, min_support: float = 0.1,
                   min_confidence: float = 0.5, top: int = 20, keys=("store", "date")) -> DataFrame:
    """M4 → M5: mine rules over the items of ``conditions`` and evaluate them
    per value of ``level``."""
    baskets = transaction_items(df, conditions, keys, coded=True)
    mined = rules_as_predicates(mine_rules(baskets, min_support, min_confidence, list(conditions)), conditions, top)
    if not mined:
        return rule_compliance(df.limit(0), [("none", "false", "false")], level)
    return rule_compliance(df, mined, level)


def transaction_items(features: DataFrame, conditions: dict[str, str], keys=("store", "date"), coded: bool = False) -> DataFrame:
    """M4 input: each store-day becomes a basket of the condition names that
    hold (conditions are SQL predicates on the feature columns), or of their
    places among the conditions if ``coded``: a tenth of the names' memory."""
    items = F.array_compact(F.array(*[F.when(F.expr(expr), F.lit(i if coded else name))
                                      for i, (name, expr) in enumerate(conditions.items())]))
    return features.select(*keys, items.alias("items")).where(F.size("items") > 0)


def _mined(baskets: DataFrame, min_support: float, min_confidence: float, names: list[str] | None, table: str) -> DataFrame:
    """A table of the FP-growth model of ``baskets``, written, the places of
    ``names`` in it as names.  FP-growth goes over the baskets several times,
    also when its tables are read: they are held, one column in compact form
    that may go to disk, until the table is there."""
    from pyspark.ml.fpm import FPGrowth
    from ..session import cut_lineage
    rows = baskets.select("items").persist()
    try:
        found = getattr(FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows), table)
        if names is not None:
            text = F.array(*[F.lit(n) for n in names])
            found = found.withColumns({c: F.transform(c, lambda i: F.get(text, i)) for c, t in found.dtypes if t.startswith("array")})
        return cut_lineage(found)
    finally:
        rows.unpersist()


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.1, names: list[str] | None = None) -> DataFrame:
    """M4: frequent itemsets (FP-growth): items, freq.  ``names``: baskets are
    coded as places in it."""
    return _mined(baskets, min_support, 0.5, names, "freqItemsets")


def mine_rules(baskets: DataFrame, min_support: float = 0.1, min_confidence: float = 0.5, names: list[str] | None = None) -> DataFrame:
    """M4: frequent itemsets and association rules (FP-growth); ``names`` as
    in ``frequent_itemsets``."""
    return _mined(baskets, min_support, min_confidence, names, "associationRules")


def rule_compliance(df: DataFrame, rules: list[tuple[str, str, str]], level: str) -> DataFrame:
    """M5: for rules ``IF antecedent THEN consequent`` (SQL predicates) per
    ``level`` value: rows, antecedent support, confidence and violations.
    All rules are evaluated in one aggregate pass."""
    aggs = []
    for rid, ante, cons in rules:
        a = F.coalesce(F.expr(ante), F.lit(False))
        c = F.coalesce(F.expr(cons), F.lit(False))
        aggs.append(F.struct(F.lit(rid).alias("rule_id"), F.count_if(a).alias("n_antecedent"),
                             F.count_if(a & c).alias("n_both"), F.count_if(a & ~c).alias("violations")))
    wide = df.groupBy(level).agg(F.count(F.lit(1)).alias("n_rows"), F.array(*aggs).alias("_r"))
    long = wide.select(level, "n_rows", F.explode("_r").alias("r")).select(level, "n_rows", "r.*")
    return long.withColumns({
        "support": F.col("n_antecedent") / F.col("n_rows"),
        "confidence": F.try_divide(F.col("n_both").cast("double"), F.col("n_antecedent").cast("double")),
    })


def temporal_smoothing(df: DataFrame, value: str, weights: list[float], key: str = "store",
                       order: str = "date", out: str | None = None) -> DataFrame:
    """M6: weighted average of the current and previous rows
    (weights[0] for the current row); missing terms drop out of both sums."""
    w = Window.partitionBy(key).orderBy(order)
    terms = [(F.lag(F.col(value), j).over(w) if j else F.col(value), wt) for j, wt in enumerate(weights)]
    num = sum((F.coalesce(t * F.lit(wt), F.lit(0.0)) for t, wt in terms), F.lit(0.0))
    den = sum((F.when(t.isNotNull(), F.lit(wt)).otherwise(F.lit(0.0)) for t, wt in terms), F.lit(0.0))
    return df.withColumn(out or f"{value}_smoothed", F.try_divide(num, den))


def mmd_linear(df: DataFrame, features: list[str], domain_col: str = "domain") -> DataFrame:
    """M7: maximum mean discrepancy with a linear kernel = squared distance
    between the source and target mean vectors of standardised features
    (global mean / sample std).  One aggregate pass plus a two-row pivot."""
    stats = df.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c)
                                 for c in features])).scalar()
    z = [F.try_divide(F.col(c) - stats.getField(c).getField("m"), stats.getField(c).getField("s")).alias(c)
         for c in features]
    means = df.select(F.col(domain_col), *z).groupBy().pivot(domain_col, ["source", "target"]).agg(
        *[F.avg(c).alias(c) for c in features])
    sq = sum((F.pow(F.col(f"source_{c}") - F.col(f"target_{c}"), 2) for c in features), F.lit(0.0))
    return means.select(sq.alias("mmd"))


def a_distance(df: DataFrame, features: list[str], domain_col: str = "domain", keys=("store", "date"),
               test_share: float = 0.3) -> DataFrame:
    """M7: proxy A-distance 2(1 − 2·err) of a logistic-regression domain
    classifier.  Rows go to the test part by the crc32 of their ``keys``, so
    the split is the same on any partitions."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    draw = F.crc32(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])) % 1000 < int(1000 * test_share)
    data = (df.select(*features, (F.col(domain_col) == "target").cast("double").alias("label"), draw.alias("_test"))
              .fillna(0.0, subset=features))
    data = VectorAssembler(inputCols=features, outputCol="_raw").transform(data)
    data = StandardScaler(inputCol="_raw", outputCol="_f").fit(data).transform(data)
    model = LogisticRegression(featuresCol="_f", labelCol="label", maxIter=50).fit(data.where("NOT _test"))
    err = model.transform(data.where("_test")).select(F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("err"))
    return err.select("err", (F.lit(2.0) * (F.lit(1.0) - F.lit(2.0) * F.col("err"))).alias("a_distance"))


def domain_regressors(df: DataFrame, label: str, feature: str, domain_col: str = "domain") -> DataFrame:
    """M8: one least-squares line ``label`` = intercept + slope · ``feature``
    per domain, all fitted by one grouped pass (one row per domain)."""
    x, y = F.col(feature).cast("double"), F.col(label).cast("double")
    fit = df.groupBy(domain_col).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.where(F.col("slope").isNotNull())


def domain_similarities(df: DataFrame, features: list[str], domain_col: str = "domain") -> DataFrame:
    """M8: (domain, source, weight) for every pair of domains, weight =
    exp(−MMD) of their standardised features (linear kernel).  Mean vectors
    are one row per domain; pairs come from one array of those rows."""
    stats = df.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in features])).scalar()
    z = [F.avg(F.try_divide(F.col(c) - stats.getField(c).getField("m"), stats.getField(c).getField("s"))).alias(c) for c in features]
    means = df.where(F.col(domain_col).isNotNull()).groupBy(domain_col).agg(*z)
    rows = F.collect_list(F.struct(F.col(domain_col).alias("d"), F.array(*features).alias("z")))
    pairs = (means.agg(F.array_sort(rows).alias("all")).select("all", F.explode("all").alias("a"))
             .select("a", F.explode("all").alias("b")))
    mmd = F.aggregate(F.zip_with(F.col("a.z"), F.col("b.z"), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                      lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return pairs.select(F.col("a.d").alias(domain_col), F.col("b.d").alias("source"), F.exp(-mmd).alias("weight"))


def source_predictions(df: DataFrame, regressors: DataFrame, feature: str, keys: list[str],
                       domain_col: str = "domain") -> DataFrame:
    """M8: what each source domain's regressor predicts for every row: (keys,
    domain, source, y_hat).  The regressors, one row per domain, are one array."""
    lines = regressors.agg(F.collect_list(F.struct(F.col(domain_col).alias("source"), "slope", "intercept"))).scalar()
    rows = df.where(F.col(feature).isNotNull()).select(*keys, domain_col, F.col(feature).cast("double").alias("_x"), F.explode(lines).alias("m"))
    return rows.select(*keys, domain_col, "m.source", (F.col("m.intercept") + F.col("m.slope") * F.col("_x")).alias("y_hat"))


def fuse_predictions(preds: DataFrame, weights: DataFrame, keys: list[str],
                     domain_col: str | list[str] = "domain") -> DataFrame:
    """M8: similarity-weighted average of per-domain predictions per key.
    ``weights`` has one row per domain, or per pair of domains if
    ``domain_col`` names two columns (bounded by the domain count)."""
    j = preds.join(weights, domain_col)
    return j.groupBy(*keys).agg(
        (F.sum(F.col("y_hat") * F.col("weight")) / F.sum("weight")).alias("y_hat_fused"),
        F.count(F.lit(1)).alias("n_domains"))


def fuse_columns(df: DataFrame, predictions: dict[str, float], out: str = "y_hat_fused") -> DataFrame:
    """M8 for predictions that are columns of one row: weighted by
    arithmetic, without a union or a shuffle.  A missing prediction adds
    nothing to the sum but its weight still counts, as in the long form."""
    total = sum((F.coalesce(F.col(c) * F.lit(w), F.lit(0.0)) for c, w in predictions.items()), F.lit(0.0))
    any_set = F.coalesce(*[F.col(c) for c in predictions]).isNotNull()
    return df.withColumn(out, F.when(any_set, total / F.lit(float(sum(predictions.values())))))


def early_warning(df: DataFrame, predicted: str, actual: str, group: str | None = None) -> DataFrame:
    """M9: confusion counts of a decline flag against the realised decline;
    accuracy, precision, recall and false-alarm rate."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    keys = [group] if group else []
    c = df.where(F.col(actual).isNotNull()).groupBy(*keys).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tot = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    d = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    return c.withColumns({
        "accuracy": d(F.col("tp") + F.col("tn"), tot),
        "precision": d(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": d(F.col("tp"), F.col("tp") + F.col("fn")),
        "false_alarm_rate": d(F.col("fp"), F.col("fp") + F.col("tn")),
    })
