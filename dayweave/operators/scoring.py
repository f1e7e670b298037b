"""Training weights, folds, gates, conformal sets and the column side of scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import join_in_blocks
from ..functions.cols import map_argmax, map_renormalise, ranked_entries
from ..functions.ranks import value_cdf
from .stats import wilson

# Fixed values of training and scoring.
SUSPECT_WEIGHT, CHAMPION_BOOST, HALF_LIFE_DAYS, BALANCE_CAP = 0.3, 1.25, 21.0, 8.0
ALPHA, MIN_CAL, MIN_CAL_HUMAN, MIN_CONFIRMED = 0.10, 30, 50, 30
#: Rounding allowed where a probability meets a conformal threshold.
TOLERANCE = 1e-12
MARGIN, CHURN_MAX, DECISIVE_GAIN, CHAMPION_FLOOR = 0.02, 0.25, 0.02, 0.05
RULE_CONFIDENCE, WEAK_SHARE, WEAK_CAP, ABSTAIN_AT = 0.55, 0.25, 0.70, 0.4
STRIKE_ROUNDS, STRIKES, STRIKE_GAP_DAYS, STRIKE_EPS = 4, 3, 3, 1e-6


# --- training weights (ML-07..10) ---------------------------------------------------------------


def class_balance_weights(rows: DataFrame, keys: list[str], label: str = "y", cap: float = BALANCE_CAP) -> DataFrame:
    """ML-07: n / (classes · n_class), capped, scaled to mean 1; from one row per class."""
    per = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("nc"))
    whole = per.groupBy(*keys).agg(F.sum("nc").alias("n"), F.count(F.lit(1)).alias("k"))
    raw = per.join(whole, keys).withColumn("raw", F.least(F.lit(cap), F.col("n") / (F.col("k") * F.col("nc"))))
    mean = raw.groupBy(*keys).agg((F.sum(F.col("raw") * F.col("nc")) / F.sum("nc")).alias("mean"))
    weights = raw.join(mean, keys).select(*keys, label, (F.col("raw") / F.col("mean")).alias("w_balance"))
    return rows.join(weights, [*keys, label])


def recency_weight(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """ML-08."""
    return F.pow(F.lit(0.5), age_days / half_life)


def suspect_weights(rows: DataFrame, ledger: DataFrame, on: list[str]) -> DataFrame:
    """ML-09: rows the previous run flagged count less."""
    flags = ledger.select(*on).distinct().withColumn("_f", F.lit(True))
    return rows.join(flags, on, "left").withColumn("w_suspect", F.when(F.col("_f"), SUSPECT_WEIGHT).otherwise(1.0)).drop("_f")


def champion_weights(rows: DataFrame, champion: DataFrame, on: list[str]) -> DataFrame:
    """ML-10: rows the live model gets right count more. champion: (on, champion)."""
    j = rows.join(champion, on, "left")
    return j.withColumn("w_champion", F.when(F.col("champion") == F.col("y"), CHAMPION_BOOST).otherwise(1.0)).drop("champion")


# --- folds (ML-11) ---------------------------------------------------------------------------------


def rolling_folds(rows: DataFrame, keys: list[str], end: Column, val_days: int = 7, n_folds: int = 3, min_train: int = 10, min_val: int = 5) -> DataFrame:
    """ML-11: usable folds as (keys, fold, val_start, val_end, n_train, n_val, ship); the last ships."""
    span = val_days * 1440
    f = F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold")
    base = rows.select(*keys, "minute", f)
    stop = end - (n_folds - F.col("fold")) * span
    cut = base.withColumns({"val_end": stop, "val_start": stop - span})
    is_val = (F.col("minute") >= F.col("val_start")) & (F.col("minute") < F.col("val_end"))
    got = cut.groupBy(*keys, "fold", "val_start", "val_end").agg(F.count_if(F.col("minute") < F.col("val_start")).alias("n_train"), F.count_if(is_val).alias("n_val"))
    got = got.where((F.col("n_train") >= min_train) & (F.col("n_val") >= min_val))
    return got.withColumn("ship", F.col("fold") == F.max("fold").over(Window.partitionBy(*keys)))


# --- label quality (ML-20) ---------------------------------------------------------------------------


def confident_flags(rows: DataFrame, classes: list[str], keys: list[str], min_class: int = 5) -> DataFrame:
    """ML-20: rows another class explains better than the given one. rows: (keys, row_id, y, p_<class>).

    A class threshold is its mean probability on its own rows; classes below min_class are left out.
    """
    thr = rows.groupBy(*keys).agg(
        *[F.when(F.count_if(F.col("y") == c) >= min_class, F.avg(F.when(F.col("y") == c, F.col(f"p_{c}")))).alias(f"t_{c}") for c in classes]
    )
    scorable = sum((F.col(f"t_{c}").isNotNull().cast("int") for c in classes), F.lit(0))
    j = rows.join(thr.where(scorable >= 2), keys)
    cand = F.array(*[
        F.when((F.col("y") != c) & (F.col(f"p_{c}") >= F.col(f"t_{c}")), F.struct((-F.col(f"p_{c}")).alias("neg"), F.lit(c).alias("c"))) for c in classes
    ])
    best = F.array_min(F.array_compact(cand))
    own = F.coalesce(*[F.when(F.col("y") == c, F.col(f"p_{c}")) for c in classes])
    own_ok = F.coalesce(*[F.when((F.col("y") == c) & F.col(f"t_{c}").isNotNull(), True) for c in classes])
    out = j.withColumns({"_b": best, "self_conf": own}).where(own_ok & F.col("_b").isNotNull() & (-F.col("_b.neg") > F.col("self_conf")))
    return out.select(*keys, "row_id", F.col("y").alias("given"), F.col("_b.c").alias("suggested"), F.round("self_conf", 4).alias("self_conf"), F.round(-F.col("_b.neg"), 4).alias("suggested_p"))


# --- conformal (ML-21..23) ------------------------------------------------------------------------------


def calibration_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ML-22: human rows (confirmed, corrected or gold) where there are enough, else every row."""
    human = F.col("provenance").isin("confirmed", "corrected") | F.col("gold")
    n = rows.groupBy(*keys).agg(F.count_if(human).alias("_h"))
    j = rows.join(n, keys)
    use_human = F.col("_h") >= MIN_CAL_HUMAN
    return j.where(~use_human | human).withColumn("basis", F.when(use_human, "human").otherwise("all")).drop("_h")


def conformal_threshold(rows: DataFrame, classes: list[str], keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """ML-21: the order statistic of 1 − p(true) at level min(1, ceil((n+1)(1−α))/n), taken upwards,
    then set size and coverage at that threshold. The rank is found without a global sort."""
    own = F.coalesce(*[F.when(F.col("y") == c, F.col(f"p_{c}")) for c in classes])
    scored = rows.withColumn("p_true", own).where(F.col("p_true").isNotNull()).withColumn("score", F.round(1 - F.col("p_true"), 9))
    cdf = value_cdf(scored, keys, "score")
    n = F.col("n_total")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)
    # numpy's "higher" rule: index ceil((n − 1) · level), zero based
    idx = F.ceil(F.round((n - 1) * level, 9))
    q = cdf.where((F.col("n_before") <= idx) & (idx < F.col("n_before") + F.col("n")) & (n >= MIN_CAL)).select(*keys, F.col("score").alias("qhat"), n.alias("n_cal"))
    size = sum(((F.col(f"p_{c}") >= 1 - F.col("qhat") - TOLERANCE).cast("int") for c in classes), F.lit(0))
    hit = (F.col("p_true") >= 1 - F.col("qhat") - TOLERANCE).cast("double")
    use = scored.join(q, keys).groupBy(*keys, "qhat", "n_cal").agg(F.round(F.avg(size), 2).alias("avg_set_size"), F.round(F.avg(hit), 4).alias("coverage"))
    return use.withColumn("qhat", F.round("qhat", 4))


def prediction_set(probs: Column, qhat: Column) -> Column:
    """ML-23: classes at least as probable as 1 − q̂, most likely first; may be empty. The tolerance is
    that of the calibration, so a class on the threshold counts in both."""
    kept = F.filter(ranked_entries(probs), lambda e: e["p"] >= 1 - qhat - TOLERANCE)
    return F.transform(kept, lambda e: e["k"])


# --- gates (ML-17, 24..27, 39) -----------------------------------------------------------------------------


def lower_bound(acc: Column, n: Column) -> Column:
    return wilson(F.round(acc * n), n)[0]


def promotion(pairs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """ML-24/25: new against live model on the most trusted common measure, then the churn veto.

    pairs carry new_/cur_ accuracy_gold, n_gold, accuracy_confirmed, n_confirmed, accuracy_bootstrap,
    and churn; a missing live model has cur_id NULL.
    """
    c = F.col
    both = lambda kind: (c(f"new_n_{kind}") > 0) & (c(f"cur_n_{kind}") > 0)
    lows = {k: (lower_bound(c(f"new_accuracy_{k}"), c(f"new_n_{k}")), lower_bound(c(f"cur_accuracy_{k}"), c(f"cur_n_{k}"))) for k in ("gold", "confirmed")}
    basis = F.when(c("cur_id").isNull(), "first").when(both("gold"), "real-world").when(both("confirmed"), "confirmed").otherwise("bootstrap")
    holds = (
        F.when(c("cur_id").isNull(), True)
        .when(both("gold"), lows["gold"][0] >= lows["gold"][1] - margin)
        .when(both("confirmed"), lows["confirmed"][0] >= lows["confirmed"][1] - margin)
        .otherwise(F.coalesce(c("new_accuracy_bootstrap") >= c("cur_accuracy_bootstrap") - margin, F.lit(True)))
    )
    decisive = lambda k: (lows[k][1] < CHAMPION_FLOOR) | (lows[k][0] >= lows[k][1] + DECISIVE_GAIN)
    allowed = (
        F.when(c("cur_id").isNull() | c("churn").isNull() | (c("churn") <= CHURN_MAX), True)
        .when(both("gold"), decisive("gold"))
        .when(both("confirmed"), decisive("confirmed"))
        .otherwise(False)
    )
    return pairs.withColumns({"basis": F.when(holds & ~allowed, "churn").otherwise(basis), "promoted": holds & allowed})


def churn_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ML-25: disagreement, wins lost and wins gained. rows: (keys, y, champion, challenger)."""
    a, b, y = F.col("champion"), F.col("challenger"), F.col("y")
    rate = lambda cond: F.round(F.avg(cond.cast("double")), 4)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rate(a != b).alias("churn"), rate((a == y) & (b != y)).alias("nfr"), rate((a != y) & (b == y)).alias("pfr")
    )


def rollback(models: DataFrame, keys: list[str]) -> DataFrame:
    """ML-26: the newest model that is not live."""
    return models.where(~F.col("promoted")).groupBy(*keys).agg(F.max("model_id").alias("model_id"))


def validation_status(n_confirmed: Column) -> Column:
    """ML-27."""
    return F.when(n_confirmed >= MIN_CONFIRMED, "validated").otherwise("provisional")


def strike_candidates(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """ML-17: features flagged in 3 of the last 4 rounds, rounds at least three days apart.

    rounds: (keys, at, feature, importance); rounds follow each other day by day, so the kept ones
    come from a fold over the few distinct round times of a key.
    """
    times = rounds.groupBy(*keys).agg(F.array_sort(F.collect_set("at")).alias("ts"))
    zero = F.array().cast("array<bigint>")
    gap = STRIKE_GAP_DAYS * 1440
    kept = F.aggregate("ts", zero, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= gap), F.array_append(acc, t)).otherwise(acc))
    last = times.select(*keys, F.explode(F.slice(F.reverse(kept), 1, STRIKE_ROUNDS)).alias("at"))
    use = rounds.join(last, [*keys, "at"])
    per = use.groupBy(*keys, "feature").agg(F.count_if(F.col("importance") <= STRIKE_EPS).alias("flags"), F.count(F.lit(1)).alias("seen"))
    return per.where((F.col("flags") >= STRIKES) & (F.col("seen") >= STRIKES))


def earned_gates(facts: DataFrame, verdicts: DataFrame, persons: DataFrame) -> DataFrame:
    """ML-39: enabled facts other than away that earned the verdict "fact", per person they apply to.

    facts: (fact_id, gate, person_id, home, enabled); persons: (person_id, home).
    """
    ok = facts.where(F.col("enabled") & (F.col("gate") != "away")).join(verdicts.where("decision = 'fact'").select("fact_id"), "fact_id", "left_semi")
    people = persons.select("home", F.col("person_id").alias("person"))
    # a fact of one person meets only that person
    shared = join_in_blocks(people, ok.where(F.col("person_id").isNull()).select("home", "fact_id", "gate"), ["home"])
    own = ok.where(F.col("person_id").isNotNull()).select("home", F.col("person_id").alias("person"), "fact_id", "gate")
    return shared.unionByName(people.join(own, ["home", "person"])).select("person", "fact_id", "gate")


# --- scoring columns (ML-35, 37, 38, 41..43) -----------------------------------------------------------------


def rules_only(label: Column, classes: list[str], confidence: float = RULE_CONFIDENCE) -> Column:
    """ML-35: the rule's class gets the confidence, the others share the rest."""
    rest = (1 - confidence) / max(len(classes) - 1, 1)
    return F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*[F.when(label == c, confidence).otherwise(rest) for c in classes]))


def presence_gate(probs: Column, presence: Column, away: str = "away") -> Column:
    """ML-37: away makes the row certain, home removes away; NULL leaves it."""
    has = F.map_contains_key(probs, F.lit(away))
    one_hot = F.transform_values(probs, lambda k, v: F.when(k == away, 1.0).otherwise(0.0))
    without = F.transform_values(probs, lambda k, v: F.when(k == away, 0.0).otherwise(v))
    return F.when((presence == away) & has, one_hot).when((presence == "home") & has, map_renormalise(without)).otherwise(probs)


def presence_state(columns: list[Column]) -> Column:
    """ML-37: home if any tracker says 1, away if one says 0, else NULL."""
    home, away = F.lit(False), F.lit(False)
    for c in columns:
        home, away = home | F.coalesce(c == 1.0, F.lit(False)), away | F.coalesce(c == 0.0, F.lit(False))
    return F.when(home, "home").when(away, "away")


def resolve(override: Column, gate: Column, probs: Column, blocked: Column, rule: Column, threshold: float = 0.6) -> Column:
    """ML-38: override, earned fact, masked model above the threshold, rule, unknown."""
    masked = map_renormalise(F.map_filter(probs, lambda k, v: ~F.array_contains(blocked, k)))
    top = map_argmax(masked)
    conf = F.element_at(masked, top)
    v = lambda s, c, b: F.struct(s.alias("predicted"), c.alias("confidence"), F.lit(b).alias("basis"))
    return (
        F.when(override.isNotNull(), v(override, F.lit(1.0), "override"))
        .when(gate.isNotNull(), v(gate, F.lit(1.0), "fact"))
        .when(conf >= threshold, v(top, F.round(conf, 4), "model"))
        .when(rule.isNotNull(), v(rule, F.lit(RULE_CONFIDENCE), "rule"))
        .otherwise(v(F.lit("unknown"), F.lit(0.0), "unknown"))
    )


def needs_model(override: Column, gate: Column) -> Column:
    """Rows a fact or an override settles never reach the model stage."""
    return override.isNull() & gate.isNull()


def weak_evidence_cap(confidence: Column, direct_share: Column) -> Column:
    """ML-41."""
    return F.when((direct_share < WEAK_SHARE) & (confidence > WEAK_CAP), WEAK_CAP).otherwise(confidence)


def abstain(state: Column, confidence: Column, pred_set: Column, threshold: float = ABSTAIN_AT) -> Column:
    """ML-42: unknown for an empty set or a low confidence."""
    empty = F.coalesce(F.size(pred_set) == 0, F.lit(False)) & pred_set.isNotNull()
    return F.when(empty | (confidence < threshold), "unknown").otherwise(state)


def pin_overrides(preds: DataFrame, overrides: DataFrame, on: list[str], now: Column, label_min: int = 60) -> DataFrame:
    """ML-43: an active override replaces the state; it labels windows only while fresh."""
    j = preds.join(overrides.select(*on, "activity", "set_at"), on, "left")
    pinned = F.col("activity").isNotNull()
    return j.withColumns({
        "smoothed": F.coalesce("activity", "smoothed"), "confidence": F.when(pinned, 1.0).otherwise(F.col("confidence")),
        "model_version": F.when(pinned, "override").otherwise(F.col("model_version")),
        "labels": F.coalesce(now - F.col("set_at") <= label_min, F.lit(False)),
    }).drop("activity", "set_at")


# --- labels from cards, ranges and answers (ML-33, 34, 46, 47) --------------------------------------------------


def card_labels(cards: DataFrame, slug: Column) -> DataFrame:
    """ML-33: a discovered label for every member window. cards: (card_id, person, window_min), one row per member."""
    return cards.select("card_id", "person", "window_min", slug.alias("label"), F.lit("discovered").alias("provenance"))


def bulk_labels(ranges: DataFrame, width: int = 30) -> DataFrame:
    """ML-34: a confirmed label for every whole window of a range. ranges: (person, start, end, slug)."""
    from .windows import grid_of

    return ranges.select("person", "slug", F.explode(grid_of(F.col("start"), F.col("end"), width)).alias("window_min")).withColumn("provenance", F.lit("confirmed"))


def overwrite_range(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """ML-34: predictions of labelled windows take the label. labels: (person, window_min, slug)."""
    lab = labels.groupBy("person", F.col("window_min").alias("w")).agg(F.max("slug").alias("slug"))
    j = preds.join(lab, ["person", "w"], "left")
    return j.withColumns({"smoothed": F.coalesce("slug", "smoothed"), "confidence": F.when(F.col("slug").isNotNull(), 1.0).otherwise(F.col("confidence"))}).drop("slug")


def expire_questions(questions: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """ML-46."""
    old = (F.col("status") == "open") & (now - F.col("created") > hours * 60)
    return questions.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def answer_labels(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """ML-47: answered questions as confirmed labels, gold when the question was a random probe."""
    return answers.join(questions, "question_id").select(
        "question_id", "person", "window_min", F.col("answer").alias("label"), F.lit("confirmed").alias("provenance"), (F.col("reason") == "explore").alias("gold"))


def asking_candidates(preds: DataFrame, seed: str, ask_at: float = 0.75, margin_at: float = 0.25, epsilon: float = 0.07) -> DataFrame:
    """ML-45 first half: uncertain windows and seeded random probes, with the reason."""
    top = ranked_entries(F.col("probs"))
    margin = F.when(F.size(top) > 1, top[0]["p"] - top[1]["p"]).otherwise(1.0)
    uncertain = (F.col("confidence") < ask_at) | (margin < margin_at)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "person", F.col("w").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return preds.withColumns({"uncertain": uncertain, "explore": draw < epsilon}).where("uncertain or explore").withColumn(
        "reason", F.when(F.col("explore") & ~F.col("uncertain"), "explore").otherwise("uncertain")
    )


def apply_asking_limits(cands: DataFrame, quiet: tuple[int, int] = (22, 8), budget: int = 6, cooldown: int = 30, repeat: int = 90) -> DataFrame:
    """ML-45 second half: quiet hours, then budget, cooldown and repeat limits in time order.

    The limits depend on earlier questions, so each person's candidates of one quiet-to-quiet day
    (a bounded list) run through one fold; the budget counts per such day.
    """
    hour = F.floor(F.col("w") / 60) % 24
    a, b = quiet
    awake = cands.where(~((hour >= a) | (hour < b)) if a > b else ~((hour >= a) & (hour < b)))
    day = F.floor((F.col("w") - a * 60) / 1440)
    rows = awake.groupBy("person", day.alias("_day")).agg(F.array_sort(F.collect_list(F.struct("w", "predicted", "reason"))).alias("rows"))
    kind = "array<struct<w:bigint,predicted:string,reason:string>>"

    def step(acc, r):
        last = F.element_at(acc, -1)
        age = r["w"] - last["w"]
        ok = (F.size(acc) == 0) | ((F.size(acc) < budget) & (age >= cooldown) & ((last["predicted"] != r["predicted"]) | (age >= repeat)))
        return F.when(F.coalesce(ok, F.lit(False)), F.array_append(acc, r)).otherwise(acc)

    asked = rows.select("person", F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("q"))
    return asked.select("person", "q.w", "q.predicted", "q.reason")
