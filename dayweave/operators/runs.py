"""Runs, transitions, durations and smoothing of label sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.cols import local_ts, part_of_day
from ..functions.segments import with_previous

# Fixed values of the label sequences.
GRID_MIN = 30
MAX_RUN = 48
MIN_RUNS = 5
UNIFORM_MIX = 0.15
STAY_MIN, STAY_MAX = 0.05, 0.98
MIN_RUN_MIN, FLAPPY_MIN, MAX_TARGETED = 15, 35, 3
HOP_CAP = 6


def label_runs(preds: DataFrame, keys: list[str], gap_min: int = 10, step_min: int = 5) -> DataFrame:
    """SEQ-03: same label, at most gap_min since the run's last row; with the middle row's time.

    preds: (keys, w, smoothed, confidence), one row per key and slot.
    """
    w = Window.partitionBy(*keys).orderBy("w")
    same = (F.lag("smoothed").over(w) == F.col("smoothed")) & (F.col("w") - F.lag("w").over(w) <= gap_min)
    marked = preds.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long"))
    run = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = run.withColumns(
        {
            "_i": F.row_number().over(Window.partitionBy(*keys, "run").orderBy("w")) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")),
        }
    )
    return inside.groupBy(*keys, "run", F.col("smoothed").alias("label")).agg(
        F.min("w").alias("start"),
        F.max("w").alias("end"),
        (F.max("w") - F.min("w") + step_min).alias("minutes"),
        F.avg("confidence").alias("mean_conf"),
        F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("w"))).alias("mid"),
    )


def uncovered(runs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """JON-09: runs without a human label between start and end; hour cells keep it an equi join."""
    cell = lambda c: F.floor(c / 60)
    spread = runs.select(*keys, "run", "start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("_cell"))
    marks = labels.select(*keys, "window_min", cell(F.col("window_min")).alias("_cell"))
    hit = spread.join(marks, [*keys, "_cell"]).where(F.col("window_min").between(F.col("start"), F.col("end")))
    return runs.join(hit.select(*keys, "run").distinct(), [*keys, "run"], "left_anti")


def recap_picks(runs: DataFrame, labels: DataFrame, asked: DataFrame, keys: list[str], seed: str = "recap") -> DataFrame:
    """SEQ-04: one uniform probe first (lowest seeded hash), then the most doubtful runs."""
    w = Window.partitionBy(*keys).orderBy("start")
    short = lambda c: F.coalesce((c < FLAPPY_MIN).cast("int"), F.lit(0))
    scored = runs.withColumn(
        "score", (1 - F.col("mean_conf")) + 0.15 * (short(F.lag("minutes").over(w)) + short(F.lead("minutes").over(w)))
    )
    open_runs = uncovered(scored.where(F.col("minutes") >= MIN_RUN_MIN), labels, keys)
    open_runs = open_runs.join(asked.select(*keys, F.col("asked_min").alias("mid")), [*keys, "mid"], "left_anti")
    draw = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k) for k in keys], F.col("start").cast("string")))
    probe = open_runs.groupBy(*keys).agg(F.min_by("start", F.struct(draw, F.col("start"))).alias("_probe"))
    ranked = open_runs.join(probe, keys)
    is_probe = F.col("start") == F.col("_probe")
    rank = Window.partitionBy(*keys).orderBy(is_probe.cast("int").desc(), F.col("score").desc(), "start")
    return (
        ranked.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= 1 + MAX_TARGETED)
        .select(*keys, "label", "start", "end", "rank", F.when(F.col("rank") == 1, "explore").otherwise("uncertain").alias("reason"))
    )


def marker_flags(segments: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-05: segment boundaries that match a marker's from → to (any from when NULL); the first marker wins."""
    w = Window.partitionBy(*keys).orderBy("start")
    moves = segments.withColumn("prev_state", F.lag("state").over(w)).where(F.col("prev_state").isNotNull())
    fits = (F.col("state") == F.col("to_state")) & (F.col("from_state").isNull() | (F.col("from_state") == F.col("prev_state")))
    return moves.join(markers, fits).groupBy(*keys, "start", "prev_state", "state").agg(F.min_by("marker", "ord").alias("marker"))


def grid_pairs(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of rows exactly one grid step apart, with the destination's window."""
    w = Window.partitionBy(*keys).orderBy("w")
    return labels.withColumns({"a": F.lag("state").over(w), "_pw": F.lag("w").over(w)}).where(
        F.col("w") - F.col("_pw") == GRID_MIN
    ).select(*keys, "a", F.col("state").alias("b"), "w")


def state_pairs(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every (a, b) of a key's own states: the shape of its transition matrix."""
    states = labels.groupBy(*keys).agg(F.collect_set("state").alias("_s"))
    return states.select(*keys, F.explode("_s").alias("a"), "_s").select(*keys, "a", F.explode("_s").alias("b"))


def transition_matrix(labels: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-06: Laplace-smoothed, rows sum to 1."""
    counts = grid_pairs(labels, keys).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    full = state_pairs(labels, keys).join(counts, [*keys, "a", "b"], "left").withColumn("_c", F.coalesce("n", F.lit(0)) + 1.0)
    return full.select(*keys, "a", "b", (F.col("_c") / F.sum("_c").over(Window.partitionBy(*keys, "a"))).alias("p"))


def daypart_matrices(labels: DataFrame, keys: list[str], tz: str = "UTC") -> DataFrame:
    """SEQ-07: one matrix per part of day of the destination, and "all" by grouping sets."""
    part = part_of_day(F.hour(local_ts(F.col("w"), tz))).cast("int").cast("string")
    pairs = grid_pairs(labels, keys).withColumn("part", part)
    cols = [F.col(c) for c in [*keys, "part", "a", "b"]]
    counts = pairs.groupingSets([cols, [F.col(c) for c in [*keys, "a", "b"]]], *[*keys, "part", "a", "b"]).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("part", F.coalesce("part", F.lit("all")))
    parts = F.explode(F.array(*[F.lit(p) for p in ["0", "1", "2", "3", "all"]])).alias("part")
    shape = state_pairs(labels, keys).select("*", parts)
    full = shape.join(counts, [*keys, "part", "a", "b"], "left").withColumn("_c", F.coalesce("n", F.lit(0)) + 1.0)
    return full.select(*keys, "part", "a", "b", (F.col("_c") / F.sum("_c").over(Window.partitionBy(*keys, "part", "a"))).alias("p"))


def grid_islands(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Runs on the grid with the next run's contiguity: (keys, state, start, n, ended)."""
    w = Window.partitionBy(*keys).orderBy("w")
    touch = F.col("w") - F.lag("w").over(w) == GRID_MIN
    same = touch & (F.lag("state").over(w) == F.col("state"))
    run = labels.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long")).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = run.groupBy(*keys, "_run", "state").agg(F.min("w").alias("start"), F.max("w").alias("last"), F.count(F.lit(1)).alias("n"))
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("_run"))
    return runs.withColumn("ended", F.coalesce(nxt - F.col("last") == GRID_MIN, F.lit(False))).drop("_run")


def duration_histogram(labels: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-08: lengths of runs whose end was seen."""
    done = grid_islands(labels, keys).where("ended")
    return done.groupBy(*keys, "state", F.least("n", F.lit(MAX_RUN)).alias("d")).agg(F.count(F.lit(1)).alias("runs"))


def duration_hazard(hist: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-09: chance that a run ends at length d; states with enough runs only."""
    by = [*keys, "state"]
    onward = Window.partitionBy(*by).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("runs").over(Window.partitionBy(*by))
    got = hist.withColumns({"survivors": F.sum("runs").over(onward), "_t": whole}).where(F.col("_t") >= MIN_RUNS)
    return got.select(*by, "d", ((F.col("runs") + 1.0) / (F.col("survivors") + 2.0)).alias("hazard"))


def duration_adjusted(matrix: DataFrame, hazard: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-10: per run length d: stay = clamp(1 − h), the rest rescaled. hazard: (keys, state, d, hazard)."""
    rows = matrix.join(hazard.withColumnRenamed("state", "a"), [*keys, "a"])
    stay = F.least(F.greatest(1 - F.col("hazard"), F.lit(STAY_MIN)), F.lit(STAY_MAX))
    off = F.sum(F.when(F.col("a") != F.col("b"), F.col("p")).otherwise(0.0)).over(Window.partitionBy(*keys, "a", "d"))
    p = F.when(off <= 0, F.col("p")).when(F.col("a") == F.col("b"), stay).otherwise((1 - stay) * F.col("p") / off)
    return rows.withColumn("p", p).select(*keys, "a", "d", "b", "p")


def forward_filter(probs: Column, prior_row: Column) -> Column:
    """SEQ-11: p × (0.85·T + 0.15/n), renormalised; prior_row NULL leaves p as it is.

    Both are maps class → probability; a class missing from the prior row gets 1/n.
    """
    n = F.size(probs).cast("double")
    mixed = F.transform_values(
        probs, lambda c, p: p * ((1 - UNIFORM_MIX) * F.coalesce(F.element_at(prior_row, c), 1.0 / n) + UNIFORM_MIX / n)
    )
    total = F.aggregate(F.map_values(mixed), F.lit(0.0), lambda a, v: a + v)
    return F.when(prior_row.isNull() | (total <= 0), probs).otherwise(F.transform_values(mixed, lambda c, v: v / total))


def hysteresis(preds: DataFrame, keys: list[str], k: int = 2, margin: float = 0.25, force: Column | None = None) -> DataFrame:
    """SEQ-12: published label.

    A row is decisive when it is first, wins by the margin over the previous confidence, or the
    k − 1 rows before agree with it. Every other row keeps the label in force, so the published
    label is the prediction of the last decisive row: no sequential fold is needed. force: rows that
    are decisive in any case, such as facts.
    """
    w = Window.partitionBy(*keys).orderBy("w")
    agree = F.lit(True)
    for i in range(1, k):
        agree = agree & (F.lag("predicted", i).over(w) == F.col("predicted"))
    first = F.lag("predicted").over(w).isNull()
    jump = F.col("confidence") >= F.lag("confidence").over(w) + margin
    decisive = first | F.coalesce(jump, F.lit(False)) | F.coalesce(agree, F.lit(False))
    decisive = decisive if force is None else decisive | F.coalesce(force, F.lit(False))
    marked = preds.withColumn("_d", F.when(decisive, F.col("predicted")))
    return marked.withColumn(
        "published", F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_d")


def published_run_length(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-14: windows the state has held on a contiguous grid, counting this one."""
    w = Window.partitionBy(*keys).orderBy("w")
    same = (F.lag("state").over(w) == F.col("state")) & (F.col("w") - F.lag("w").over(w) == GRID_MIN)
    run = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long")).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return run.withColumn("run_len", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("w")).cast("long")).drop("_run", "_new")


def improvement_streak(records: DataFrame, keys: list[str], eps: float = 0.005, burst: int = 10) -> DataFrame:
    """SEQ-15: latest runs in a row that neither beat the best promoted headline nor got new labels.

    records: (keys, trained, headline, promoted, confirmed, model_id). Runs are ordered inside a day
    only; the best of earlier days comes from one row per day.
    """
    order, day = ["trained", "model_id"], F.floor(F.col("trained") / 1440)
    rows = with_previous(records, keys, order, ["confirmed"], day).withColumn("_day", day)
    won = F.when(F.col("promoted"), F.col("headline"))
    earlier = lambda by, *cols: Window.partitionBy(*keys, *by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_day").agg(F.max(won).alias("_top"))
    before = tops.select(*keys, "_day", F.max("_top").over(earlier([], "_day")).alias("_before"))
    best = F.greatest(F.col("_inside"), F.col("_before"))
    better = F.col("promoted") & F.col("headline").isNotNull() & (best.isNull() | (F.col("headline") > best + eps))
    reset = better | F.coalesce(F.col("confirmed") - F.col("prev_confirmed") >= burst, F.lit(False))
    marked = rows.withColumn("_inside", F.max(won).over(earlier(["_day"], *order))).join(before, [*keys, "_day"]).select(*keys, F.struct(*order).alias("_at"), "trained", reset.alias("_reset"))
    last = marked.groupBy(*keys).agg(F.max(F.when(F.col("_reset"), F.col("_at"))).alias("_last"))
    after = F.col("_last").isNull() | (F.col("_at") > F.col("_last"))
    return marked.join(last, keys).groupBy(*keys).agg(F.count_if(after).alias("streak"), F.max("trained").alias("last_trained"))


def training_due(streaks: DataFrame, now: Column) -> DataFrame:
    """SEQ-16: every 1, 3 or 7 days by streak, two hours of slack."""
    days = F.when(F.col("streak") < 3, 1).when(F.col("streak") < 5, 3).otherwise(7)
    return streaks.withColumns(
        {"interval_days": days, "due": now - F.col("last_trained") >= days * 1440 - 120}
    )


def room_edges(dominant: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-17: undirected adjacency of rooms that follow each other; (keys, minute, room) in."""
    w = Window.partitionBy(*keys).orderBy("minute")
    moves = dominant.withColumn("prev", F.lag("room").over(w)).where(F.col("prev") != F.col("room"))
    pairs = moves.select(*keys, F.least("prev", "room").alias("x"), F.greatest("prev", "room").alias("y")).distinct()
    both = F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst"))))
    return pairs.select(*keys, both.alias("e")).select(*keys, "e.src", "e.dst")


def hop_distance(edges: DataFrame, targets: DataFrame, keys: list[str], cap: int = HOP_CAP) -> DataFrame:
    """SEQ-18: hops from each room to each target (keys, anchor, room); unreachable rooms are absent
    (the caller reads them as the cap). At most cap − 1 joins on the learned, room-sized graph."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(*keys, F.col("src"), F.col("dst").alias("room")).distinct().checkpoint()
    reached = frontier = targets.select(*keys, "anchor", "room", F.lit(0).alias("hops")).distinct().checkpoint()
    for hop in range(1, cap):
        step = frontier.join(edges, [*keys, "room"]).select(*keys, "anchor", F.col("src").alias("room")).distinct()
        new = step.join(reached, [*keys, "anchor", "room"], "left_anti")
        # each hop is written out, so a lost executor never replays the walk
        frontier = new.withColumn("hops", F.lit(hop)).checkpoint()
        reached = reached.unionByName(frontier)
    return reached


def anchor_rooms(bindings: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ-19: room of the first bed / door sensor, else the first room whose name hints at it."""
    rooms = bindings.where(F.col("room").isNotNull())
    tagged = rooms.select(*keys, "binding_id", "role", "room", F.explode(F.array(*map(F.lit, L.ANCHOR_ROOMS))).alias("anchor"))
    hinted = F.coalesce(*[F.when(F.col("anchor") == k, F.lower("room").rlike(rx)) for k, rx in L.ANCHOR_ROOMS.items()])
    by_role = F.when(F.col("role") == F.col("anchor"), F.struct(F.lit(0).alias("o"), F.col("binding_id").alias("i"), F.lit("").alias("n")))
    by_name = F.when(hinted, F.struct(F.lit(1).alias("o"), F.lit(0).cast("long").alias("i"), F.col("room").alias("n")))
    order = F.coalesce(by_role, by_name)
    return tagged.withColumn("_o", order).where(F.col("_o").isNotNull()).groupBy(*keys, "anchor").agg(F.min_by("room", "_o").alias("room"))


def drift_trend(history: DataFrame, keys: list[str], keep: int = 10) -> DataFrame:
    """SEQ-20: last values in order, newest last; only `keep` rows per key reach the array."""
    w = Window.partitionBy(*keys).orderBy(F.col("at").desc())
    last = history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "psi"))), lambda e: e["psi"]).alias("trend"))
