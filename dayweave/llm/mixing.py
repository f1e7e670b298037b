"""Mixing sources to target weights by entropy balancing. DataFrame and SQL functions only.

Targets: sources share a total by weight and stop at `stop` times their own size, the excess
being reshared. Rates: document rates r minimise the token-weighted relative entropy to prior
rates q under one token constraint per source and r <= cap. The dual is convex in one multiplier
per source; its optimum is the exponential tilt r = min(cap, q * exp(lambda)). Newton steps are
distributed aggregates over (source, prior) cells; they start left of the root and rise to it.
Rounding: documents of one source, rate and size are one class. A fold from the largest size down
gives every class the copies that bring the running total nearest to the target, so what is left
is at most half of the smallest document. Inside a class copies go by rank; a large class is
ranked in hash buckets, so one class with a third of all rows is spread over many tasks.

Cases: null text has size 0; a null source is a source (sorted last); sizes of 0 take no words
and get the rounded rate as copies; repeated rows are ranked among themselves; an empty table
gives an empty result; further columns of the input are not read by the plan of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, row_key

WEIGHTS = (5.0, 2.0, 1.0)
BUCKET = 4096


def word_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, doc_id, source and the number of words of every row."""
    return docs.select(
        row_key(doc_id, text).alias("key"),
        F.col(doc_id).alias("doc_id"),
        F.struct(F.col(source).alias("name")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size and its place in code point order (null last), from 0, without one global sort task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source.name").isNull(), F.col("source.name")]
    dealt = materialise(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    # one row per range partition
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(before, "part").select("source", "source_size", (F.col("before") + F.col("inside")).alias("place"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, stop: float = 2.0) -> DataFrame:
    """source, source_size, target: weights repeat over the sources in code point order.

    The level that spends the whole total solves sum(min(stop * size, weight * level)) = total, a
    concave equation: each step takes the sources above their stop out and reshares the rest.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialise(ranked_sources(sizes).withColumns({"weight": weight, "most": stop * F.col("source_size")}), "weights")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * level >= F.col("most")
        spent, open_weight, n_full = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.sum(full.cast("int"))).first()
        if not open_weight:
            break
        rise = (total - spent) / open_weight
        if rise <= level:
            break
        level = rise
    return sources.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def balanced_rates(cells: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-10, most_steps: int = 200) -> DataFrame:
    """source, target, source_size, lam: Newton's method on the dual of the entropy problem.

    cells: source, prior, tokens (summed). With u = exp(lam) the constraint is concave and piecewise
    linear in u, so steps from the left never pass the root and end after finitely many breakpoints.
    """
    reach = cells.groupBy("source").agg(F.sum(F.col("prior") * F.col("tokens")).alias("mass"))
    state = materialise(targets.join(reach, "source", "left").select("source", "source_size", "target", F.when((F.col("mass") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("mass"))).alias("lam")), "dual")
    for _ in range(most_steps):
        tilt = F.col("prior") * F.exp("lam")
        sums = (
            cells.join(state.select("source", "lam"), "source").groupBy("source")
            .agg(F.sum(F.col("tokens") * F.least(F.lit(cap), tilt)).alias("value"), F.sum(F.when(tilt < cap, F.col("tokens") * tilt).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("target") - F.col("value")
        step = F.when((F.col("slope") > 0) & (gap > tolerance * F.col("target")), F.log1p(gap / F.col("slope"))).otherwise(0.0)
        state = materialise(state.drop("step").join(sums, "source", "left").select("source", "source_size", "target", (F.col("lam") + F.coalesce(step, F.lit(0.0))).alias("lam"), F.coalesce(step, F.lit(0.0)).alias("step")), "dual")
        if not state.agg(F.max("step")).first()[0]:
            return state.drop("step")
    raise RuntimeError("the dual did not settle")


def class_copies(classes: DataFrame, cap: int = 2) -> DataFrame:
    """source, size, prior, n, k: the copies k that the n documents of every class get together.

    classes: source, size, prior, rate, n. The folded array has one element for each distinct size
    and prior of a source, not for each document.
    """
    each = F.struct("size", "prior", "rate", "n")
    listed = classes.where("size > 0").groupBy("source").agg(F.sort_array(F.collect_list(each), asc=False).alias("sizes"))

    def take(acc, c):
        want = c["rate"] * c["n"] * c["size"] + acc["carry"]
        k = F.greatest(F.lit(0), F.least(c["n"] * cap, F.floor(want / c["size"] + 0.5))).cast("long")
        out = F.struct(c["size"].alias("size"), c["prior"].alias("prior"), c["n"].alias("n"), k.alias("k"))
        return F.struct((want - k * c["size"]).alias("carry"), F.array_append(acc["out"], out).alias("out"))

    kind = "array<struct<size:bigint,prior:double,n:bigint,k:bigint>>"
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast(kind).alias("out"))
    folded = listed.select("source", F.explode(F.aggregate("sizes", start, take)["out"]).alias("c"))
    return folded.select("source", "c.*")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, stop: float = 2.0, prior: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, doc_id, source, size, source_size, target, rate, copies, taken of every row.

    prior: column with the prior rate of a document (1 for all if not given).
    """
    sizes = word_sizes(docs, doc_id, text, source)
    if prior is None:
        sizes = materialise(sizes, "sizes").withColumn("prior", F.lit(1.0))
    else:
        q = docs.select(row_key(doc_id, text).alias("key"), F.coalesce(F.greatest(F.col(prior).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("prior")).groupBy("key").agg(F.max("prior").alias("prior"))
        sizes = materialise(sizes.join(q, "key"), "sizes")
    targets = source_targets(sizes, weights, share, stop)
    classes = materialise(sizes.groupBy("source", "prior", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    cells = classes.groupBy("source", "prior").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"))
    rates = balanced_rates(cells, targets, stop)
    rate = F.coalesce(F.least(F.lit(stop), F.col("prior") * F.exp("lam")), F.lit(0.0))
    rated = classes.join(rates, "source").withColumn("rate", rate)
    copies = class_copies(rated.select("source", "size", "prior", "rate", "n"), int(stop))
    plan = materialise(rated.select("source", "size", "prior", "n", "rate", "source_size", "target").join(copies.drop("n"), ["source", "size", "prior"], "left"), "copies")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")
    # written, so that a class is dealt by its buckets from here on and not kept together by the join
    placed = materialise(sizes.join(plan, ["source", "size", "prior"]).withColumn("bucket", F.pmod(F.xxhash64("key"), buckets)), "placed")
    kinds = ["source", "size", "prior", "bucket"]
    # at most n / BUCKET rows per class
    ahead = placed.where("k is not null").groupBy(*kinds).agg(F.count(F.lit(1)).alias("in_bucket"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source", "size", "prior").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_bucket")
    inside = F.row_number().over(Window.partitionBy(*kinds).orderBy("doc_id", "key"))
    place = F.col("inside") + F.coalesce("ahead", F.lit(0))
    n_copies = F.when(F.col("k").isNull(), F.floor(F.col("rate") + 0.5)).otherwise(F.floor(F.col("k") / F.col("n")) + (place <= F.col("k") % F.col("n")).cast("long"))
    ranked = placed.withColumn("inside", inside).join(ahead, kinds, "left")
    return ranked.select("key", "doc_id", F.col("source.name").alias("source"), "size", "source_size", "target", "rate", n_copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
