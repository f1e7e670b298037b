"""Training, importance, clustering and scoring queries.

The SQL twin of a fit checks its contract: the rows it scores, the range and the sum of its
probabilities, the features it reports. How good fits are is tested on planted data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import learning as N
from ..operators import stats as X
from ..operators.attribution import path_attribution
from ..operators.density import density_tree
from ..session import materialise
from ..sources import tables as T
from .catalog import query

COLS = [f"d{i}" for i in range(64)]
LABELS = ["l0", "l1", "l2"]


def rows(spark, sf):
    """Embedding rows as windows: 64 named features, three activities, a half-hour clock."""
    e = T.load(spark, sf, "embeddings")
    v = F.col("vec_id")
    return e.select(
        v.alias("row_id"), F.concat(F.lit("p"), (v % 4).cast("string")).alias("person"), (v * 30).alias("minute"), (v * 30).alias("w"),
        F.concat(F.lit("l"), (F.col("label") % 3).cast("string")).alias("y"),
        F.when(v % 3 == 0, "confirmed").otherwise("bootstrap").alias("provenance"), (v % 2 == 0).alias("gold"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLS)])


def split(spark, sf):
    r = N.align(rows(spark, sf), COLS)
    return r.where("row_id % 4 <> 0"), r.where("row_id % 4 = 0")


def contract(df, *keys, classes=LABELS):
    """What holds for any fit: which rows are scored, probabilities within 0 and 1, their sum."""
    inside = sum((F.col(f"p_{c}").between(0, 1).cast("int") for c in classes), F.lit(0))
    return df.select(*keys, "row_id", "y", inside.alias("in_range"), r6(sum((F.col(f"p_{c}") for c in classes), F.lit(0.0))).alias("p_sum"))


CONTRACT = "SELECT vec_id AS row_id, 'l'||(label%3) AS y, CAST(3 AS INTEGER) AS in_range, 1.0::DOUBLE AS p_sum FROM embeddings WHERE vec_id%4=0"


@query("ml_random_forest", "ML-01 ML-05", CONTRACT)
def ml_random_forest(spark, sf):
    train, val = split(spark, sf)
    return contract(N.fit_classifier(train, COLS).score(val))


@query("ml_gradient_boosting", "ML-02", CONTRACT)
def ml_gradient_boosting(spark, sf):
    train, val = split(spark, sf)
    return contract(N.fit_classifier(train, COLS, "boosting").score(val))


@query("ml_logistic", "ML-03", CONTRACT)
def ml_logistic(spark, sf):
    train, val = split(spark, sf)
    return contract(N.fit_classifier(train, COLS, "logistic").score(val))


@query("ml_embedding_head", "ML-04", CONTRACT)
def ml_embedding_head(spark, sf):
    from pyspark.ml.feature import PCA

    train, val = split(spark, sf)
    embed = PCA(k=8, inputCol="features", outputCol="embedded").fit(train)
    return contract(N.fit_classifier(train, COLS, "logistic", embed=embed).score(val))


def pooled(spark, sf):
    r = materialise(rows(spark, sf), "learning-rows")  # read again for every fold
    end = r.agg(F.max("minute")).first()[0] + 1
    folds = N.folds_of(r, end, 1, 3)
    return r, folds, N.pooled_scores(r, COLS, folds, LABELS)


@query("ml_pooled_scores", "ML-12 SET-04", """
WITH e AS (SELECT max(vec_id)*30+1 AS e FROM embeddings), f AS (SELECT CAST(unnest([1,2,3]) AS INTEGER) AS fold)
SELECT fold, vec_id AS row_id, 'l'||(label%3) AS y, CAST(3 AS INTEGER) AS in_range, 1.0::DOUBLE AS p_sum FROM embeddings, e, f WHERE vec_id*30>=e-(4-fold)*1440 AND vec_id*30<e-(3-fold)*1440""")
def ml_pooled_scores(spark, sf):
    _, _, (scored, _) = pooled(spark, sf)
    return contract(scored, "fold")


@query("ml_hyper_search", "ML-06")
def ml_hyper_search(spark, sf):
    r = materialise(rows(spark, sf), "learning-rows")
    folds = N.folds_of(r, r.agg(F.max("minute")).first()[0] + 1, 1, 3)
    params, f1 = N.search(r, COLS, folds)
    chosen = {"num_trees": "numTrees", "max_depth": "maxDepth", "min_rows": "minInstancesPerNode", "sampling": "subsamplingRate"}
    return r.groupBy("y").agg(F.count("*").alias("n")).withColumns({c: F.lit(params[k]) for c, k in chosen.items()} | {"macro_f1": F.lit(round(f1, 6))})


def parents(df):
    return df.select("y").distinct().withColumn("parent", F.when(F.col("y") != "l2", "home"))


@query("ml_node_training", "ML-13 ML-40")
def ml_node_training(spark, sf):
    train, val = split(spark, sf)
    models = N.train_nodes(train, COLS, parents(train))
    root = models["root"].score(val).select("row_id", "p_home", "p_l2")
    child = models["home"].score(val).select("row_id", F.lit("home").alias("node"), F.col("p_l0").alias("q_l0"), F.col("p_l1").alias("q_l1"))
    got = N.top_down(root, child, ["row_id"], ["home", "l2"], ["l0", "l1"])
    return got.withColumns({"confidence": r6("confidence"), "coarse_confidence": r6("coarse_confidence")})


@query("ml_flat_baseline", "ML-14")
def ml_flat_baseline(spark, sf):
    _, _, (scored, _) = pooled(spark, sf)
    return X.accuracy_by_provenance(scored, [])


@query("ml_isotonic_calibration", "ML-15", CONTRACT + " AND vec_id%5>=3")
def ml_isotonic_calibration(spark, sf):
    train, val = split(spark, sf)
    scored = materialise(N.fit_classifier(train, COLS).score(val), "scored")  # read again for every class
    fit, check = scored.where("row_id % 5 < 3"), scored.where("row_id % 5 >= 3")
    return contract(N.calibrate(check, N.fit_calibrators(fit, LABELS)))


@query("ml_permutation_importance", "ML-16", "SELECT 'd'||unnest(range(64)) AS feature, true AS bounded")
def ml_permutation_importance(spark, sf):
    train, val = split(spark, sf)
    return N.permutation_importance(N.fit_classifier(train, COLS), val, "row_id").select("feature", F.col("importance").between(-1, 1).alias("bounded"))


@query("ml_prune_trial", "ML-18")
def ml_prune_trial(spark, sf):
    train, val = split(spark, sf)
    return N.prune_trial(train, val, COLS, ["d62", "d63"])


@query("ml_row_attribution", "ML-19", "SELECT vec_id AS row_id, 'd'||unnest(range(64)) AS feature, true AS bounded FROM embeddings WHERE vec_id%4=0")
def ml_row_attribution(spark, sf):
    train, val = split(spark, sf)
    return N.ablation(N.fit_classifier(train, COLS), val, "row_id").select("row_id", "feature", F.col("weight").between(-1, 1).alias("bounded"))


@query("ml_path_attribution", "ML-19", "SELECT vec_id AS row_id, CAST(64 AS INTEGER) AS columns, 0.0::DOUBLE AS gap FROM embeddings WHERE vec_id%4=0")
def ml_path_attribution(spark, sf):
    """The weights of a row's columns and the mean of the roots make up its probability."""
    train, val = split(spark, sf)
    got = path_attribution(N.fit_classifier(train, COLS), val, "row_id")
    whole = F.aggregate("weights", F.col("base"), lambda a, v: a + v)
    return got.select("row_id", F.size("weights").alias("columns"), r6(F.abs(whole - F.col("confidence"))).alias("gap"))


@query("ml_standardise", "ML-28", "SELECT vec_id AS row_id, " + ", ".join(f"round((embedding[{i + 1}]-avg(CAST(embedding[{i + 1}] AS DOUBLE)) OVER ())/stddev_samp(CAST(embedding[{i + 1}] AS DOUBLE)) OVER (),5) AS z{i}" for i in range(64)) + " FROM embeddings")
def ml_standardise(spark, sf):
    from pyspark.ml.functions import vector_to_array

    z, _ = N.standardise(rows(spark, sf), COLS)
    a = vector_to_array("scaled")
    return z.select("row_id", *[F.round(a[i], 5).alias(f"z{i}") for i in range(64)])


@query("ml_pca", "ML-29")
def ml_pca(spark, sf):
    from pyspark.ml.functions import vector_to_array

    z, kept = N.standardise(rows(spark, sf), COLS)
    red, k = N.reduce_dims(z, len(kept))
    return red.select("row_id", F.lit(k).alias("components"), r6(F.abs(vector_to_array("reduced")[0])).alias("first"))


def clustered(spark, sf):
    z, kept = N.standardise(rows(spark, sf), COLS)
    red, _ = N.reduce_dims(z, len(kept))
    return N.density_clusters(red, "row_id", 6.0, 5)


@query("ml_density_clusters", "ML-30")
def ml_density_clusters(spark, sf):
    return clustered(spark, sf).select("row_id", "cluster")


@query("ml_density_tree", "ML-30")
def ml_density_tree(spark, sf):
    """Clusters of every person's own rows, of at least a fortieth of them."""
    z, kept = N.standardise(rows(spark, sf), COLS)
    red, _ = N.reduce_dims(z, len(kept))
    return density_tree(red, "row_id", "person").select("person", "row_id", "cluster")


@query("ml_mixture_rescue", "ML-31")
def ml_mixture_rescue(spark, sf):
    return N.mixture_rescue(clustered(spark, sf), 20).select("row_id", "cluster", "rescued")


@query("ml_pattern_cards", "ML-32")
def ml_pattern_cards(spark, sf):
    cards = N.pattern_cards(clustered(spark, sf), COLS)
    return cards.select("cluster", "windows", F.array_join("features", ",").alias("features"), F.size("members").alias("members"))


@query("ml_batch_scoring", "ML-36 STR-04")
def ml_batch_scoring(spark, sf):
    train, val = split(spark, sf)
    model = N.fit_classifier(train, COLS)
    gate = F.when(F.col("row_id") % 20 == 0, "away")
    out = N.score_windows(model, val, gate, F.lit(None).cast("string"), F.when(F.col("row_id") % 3 == 0, 0.1).otherwise(0.6), F.lit(0.7))
    return out.select("person", "w", "predicted", "smoothed", r6("confidence").alias("confidence"), "basis", F.array_join("pred_set", ",").alias("pred_set"))


@query("ml_what_if", "ML-44", CONTRACT)
def ml_what_if(spark, sf):
    train, val = split(spark, sf)
    return contract(N.what_if(N.fit_classifier(train, COLS), val, {"d0": 1.0, "d1": 0.0}))


# --- the whole chain over fixed probabilities ---------------------------------------------------------

CHAIN_SQL = """
WITH RECURSIVE pairs AS (SELECT person, a, state AS b, w FROM (SELECT person, state, w, lag(state) OVER o AS a, lag(w) OVER o AS pw FROM tl WINDOW o AS (PARTITION BY person ORDER BY w)) WHERE w-pw=30),
st AS (SELECT DISTINCT person, state FROM tl), shape AS (SELECT x.person, x.state AS a, y.state AS b FROM st x JOIN st y USING (person)),
c AS (SELECT person, part, a, b, count(*) AS n FROM (SELECT *, CASE WHEN h<5 OR h>=22 THEN '0' WHEN h<11 THEN '1' WHEN h<17 THEN '2' ELSE '3' END AS part FROM (SELECT *, (w//60)%24 AS h FROM pairs)) GROUP BY ALL),
mat AS (SELECT person, part, a, b, (coalesce(n,0)+1)/sum(coalesce(n,0)+1) OVER (PARTITION BY person, part, a) AS p FROM (SELECT *, unnest(['0','1','2','3']) AS part FROM shape) LEFT JOIN c USING (person, part, a, b)),
durs AS (SELECT person, state, least(n,48) AS d, count(*) AS runs FROM (SELECT *, lead(start) OVER (PARTITION BY person ORDER BY start) AS ns FROM (SELECT person, state, start, "end", windows AS n FROM epi)) WHERE ns="end" GROUP BY ALL),
haz AS (SELECT person, state, d, (runs+1)/(sum(runs) OVER (PARTITION BY person, state ORDER BY d DESC)+2) AS hazard FROM durs QUALIFY sum(runs) OVER (PARTITION BY person, state)>=5),
wide AS (SELECT person, part, a, max(CASE WHEN b='cooking' THEN p END) AS tc, max(CASE WHEN b='home' THEN p END) AS th, max(CASE WHEN b='movie' THEN p END) AS tm, sum(CASE WHEN b<>a THEN p ELSE 0 END) AS off FROM mat GROUP BY ALL),
l AS (SELECT person, w-w%30 AS w, max(event_id) AS event_id FROM pred5 GROUP BY ALL),
x AS (SELECT l.person, l.w, a AS pc, c AS ph, b AS pm, k, value, CASE WHEN k%13=0 THEN 'away' END AS gate, (k%10)/10.0::DOUBLE AS direct, k%7=0 AS fired,
  CASE WHEN (l.w//60)%24<5 OR (l.w//60)%24>=22 THEN '0' WHEN (l.w//60)%24<11 THEN '1' WHEN (l.w//60)%24<17 THEN '2' ELSE '3' END AS part, row_number() OVER (PARTITION BY l.person ORDER BY l.w) AS i FROM l JOIN pred5 USING (event_id)),
ch AS (
 SELECT person, i, w, CAST(NULL AS VARCHAR) AS prev, CAST(0 AS BIGINT) AS prun, coalesce(gate, CASE WHEN pc>=ph AND pc>=pm THEN 'cooking' WHEN ph>=pm THEN 'home' ELSE 'movie' END) AS coarse, pc, ph, pm, CAST(1 AS BIGINT) AS run FROM x WHERE i=1
 UNION ALL
 SELECT person, i, w, prev, prun, coarse, pc, ph, pm, CASE WHEN coarse=prev THEN prun+1 ELSE CAST(1 AS BIGINT) END FROM (
  SELECT *, coalesce(gate, CASE WHEN pc>=ph AND pc>=pm THEN 'cooking' WHEN ph>=pm THEN 'home' ELSE 'movie' END) AS coarse FROM (
   SELECT person, i, w, prev, prun, gate, CASE WHEN mk THEN mc/(mc+mh+mm) ELSE mc END AS pc, CASE WHEN mk THEN mh/(mc+mh+mm) ELSE mh END AS ph, CASE WHEN mk THEN mm/(mc+mh+mm) ELSE mm END AS pm FROM (
    SELECT *, fired AND prev IS NOT NULL AS mk, CASE WHEN fired AND prev='cooking' THEN fc*0.65::DOUBLE ELSE fc END AS mc, CASE WHEN fired AND prev='home' THEN fh*0.65::DOUBLE ELSE fh END AS mh, CASE WHEN fired AND prev IS NOT NULL THEN fm*3.5::DOUBLE+1e-6::DOUBLE ELSE fm END AS mm FROM (
     SELECT *, CASE WHEN ok THEN xc/(xc+xh+xm) ELSE pc END AS fc, CASE WHEN ok THEN xh/(xc+xh+xm) ELSE ph END AS fh, CASE WHEN ok THEN xm/(xc+xh+xm) ELSE pm END AS fm FROM (
      SELECT *, rowed AND pc*kc+ph*kh+pm*km>0 AS ok, pc*kc AS xc, ph*kh AS xh, pm*km AS xm FROM (
       SELECT *, 0.85::DOUBLE*coalesce(ac,1.0::DOUBLE/3)+0.05::DOUBLE AS kc, 0.85::DOUBLE*coalesce(ah,1.0::DOUBLE/3)+0.05::DOUBLE AS kh, 0.85::DOUBLE*coalesce(am,1.0::DOUBLE/3)+0.05::DOUBLE AS km FROM (
        SELECT x.person, x.i, x.w, q.prev, q.prun, x.gate, x.fired, x.pc, x.ph, x.pm, wide.a IS NOT NULL AS rowed,
         CASE WHEN hz.hazard IS NULL OR off<=0 THEN tc WHEN q.prev='cooking' THEN least(greatest(1-hz.hazard,0.05::DOUBLE),0.98::DOUBLE) ELSE (1-least(greatest(1-hz.hazard,0.05::DOUBLE),0.98::DOUBLE))*tc/off END AS ac,
         CASE WHEN hz.hazard IS NULL OR off<=0 THEN th WHEN q.prev='home' THEN least(greatest(1-hz.hazard,0.05::DOUBLE),0.98::DOUBLE) ELSE (1-least(greatest(1-hz.hazard,0.05::DOUBLE),0.98::DOUBLE))*th/off END AS ah,
         CASE WHEN hz.hazard IS NULL OR off<=0 THEN tm WHEN q.prev='movie' THEN least(greatest(1-hz.hazard,0.05::DOUBLE),0.98::DOUBLE) ELSE (1-least(greatest(1-hz.hazard,0.05::DOUBLE),0.98::DOUBLE))*tm/off END AS am
        FROM (SELECT ch.person, ch.i, ch.w, ch.coarse, ch.run, CASE WHEN y.w-ch.w=30 THEN ch.coarse END AS prev, CASE WHEN y.w-ch.w=30 THEN ch.run ELSE 0 END AS prun FROM ch JOIN x y ON y.person=ch.person AND y.i=ch.i+1) q
        JOIN x ON x.person=q.person AND x.i=q.i+1 LEFT JOIN wide ON wide.person=x.person AND wide.part=x.part AND wide.a=q.prev LEFT JOIN haz hz ON hz.person=x.person AND hz.state=q.prev AND hz.d=least(q.prun,48))))))))),
f AS (SELECT ch.person, ch.w, ch.i, gate, k, value, direct, coarse, ch.pc, ch.ph, ch.pm, gate IS NULL AND coarse='home' AS fine, CASE WHEN coarse='cooking' THEN ch.pc WHEN coarse='home' THEN ch.ph WHEN coarse='movie' THEN ch.pm ELSE 1 END AS cc, round(value/(value+60),6) AS e FROM ch JOIN x USING (person, i)),
g AS (SELECT *, CASE WHEN fine THEN CASE WHEN e>=1-e THEN 'eating' ELSE 'home' END ELSE coarse END AS predicted, CASE WHEN gate IS NOT NULL THEN 1 ELSE CASE WHEN direct<0.25::DOUBLE AND CASE WHEN fine THEN greatest(e,1-e) ELSE cc END>0.7::DOUBLE THEN 0.7::DOUBLE ELSE CASE WHEN fine THEN greatest(e,1-e) ELSE cc END END END AS confidence,
 CASE WHEN gate IS NOT NULL THEN 1 WHEN fine THEN CAST(e>=0.4::DOUBLE-1e-12::DOUBLE AS INT)+CAST(1-e>=0.4::DOUBLE-1e-12::DOUBLE AS INT) ELSE CAST(pc>=0.3::DOUBLE-1e-12::DOUBLE AS INT)+CAST(ph>=0.3::DOUBLE-1e-12::DOUBLE AS INT)+CAST(pm>=0.3::DOUBLE-1e-12::DOUBLE AS INT) END AS set_size FROM f),
d AS (SELECT *, CASE WHEN gate IS NOT NULL OR lag(predicted) OVER o IS NULL OR coalesce(confidence>=lag(confidence) OVER o+0.25::DOUBLE, false) OR lag(predicted) OVER o=predicted THEN predicted END AS hit FROM g WINDOW o AS (PARTITION BY person ORDER BY w)),
h AS (SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY person ORDER BY w ROWS UNBOUNDED PRECEDING) AS published FROM d)
SELECT person, w, CASE WHEN k%17=0 THEN 'pinned' WHEN gate IS NOT NULL THEN published WHEN set_size=0 OR confidence<0.4::DOUBLE THEN 'unknown' ELSE published END AS smoothed, predicted, round(CASE WHEN k%17=0 THEN 1 ELSE confidence END,6) AS confidence,
 CASE WHEN k%17=0 THEN 'override' WHEN gate IS NOT NULL THEN 'fact' ELSE 'model' END AS model_version, CASE WHEN fine AND predicted<>coarse THEN coarse END AS parent, set_size FROM h"""


def chain_rows(spark, sf):
    """One row per person and half hour with everything the chain reads, and k for the overrides."""
    from ..functions.cols import local_ts, part_of_day

    p = T.prediction_rows(spark, sf).withColumn("w", F.col("w") - F.col("w") % 30)
    last = p.groupBy("person", "w").agg(F.max_by(F.struct("probs", "k", "event_id"), "event_id").alias("r")).select("person", "w", "r.*")
    x = last.join(T.events(spark, sf).select("event_id", "value"), "event_id")
    k, e = F.col("k"), F.round(F.col("value") / (F.col("value") + 60), 6)
    return materialise(x.select(
        "person", "w", part_of_day(F.hour(local_ts(F.col("w"), "UTC"))).cast("int").cast("string").alias("part"),
        F.when(k % 13 == 0, "away").alias("gate"), F.lit(None).cast("string").alias("presence"), ((k % 10) / 10.0).alias("direct"), "probs",
        F.when(k % 7 == 0, F.array(F.struct(F.lit(None).cast("string").alias("from_state"), F.lit("movie").alias("to_state"), F.lit(0.5).alias("strength")))).alias("fired"),
        F.create_map(F.lit("home"), F.create_map(F.lit("eating"), e, F.lit("home"), 1 - e)).alias("child"),
        F.create_map(F.lit("root"), F.lit(0.7), F.lit("home"), F.lit(0.6)).alias("qhat"), "k"), "chain-rows")


def chain_tables(spark, sf):
    """Transition matrices by part of day and duration hazards of every person."""
    from ..operators import runs as Q
    from .timelines import tl

    t = tl(spark, sf)
    return Q.daypart_matrices(t, ["person"]), Q.duration_hazard(Q.duration_histogram(t, ["person"]), ["person"])


@query("ml_scoring_chain", "ML-36 ML-40 ML-41 ML-42 ML-43 SEQ-10 SEQ-11 SEQ-12 STA-27", CHAIN_SQL)
def ml_scoring_chain(spark, sf):
    rows = chain_rows(spark, sf)
    pinned = rows.where(F.col("k") % 17 == 0).select("person", "w", F.lit("pinned").alias("activity"), F.col("w").alias("set_at"))
    got = N.scoring_chain(rows, *chain_tables(spark, sf), pinned, F.lit(0))
    return got.select("person", "w", "smoothed", "predicted", r6("confidence").alias("confidence"), "model_version", "parent", F.size("pred_set").alias("set_size"))
