"""Top-k lists, set operations on cards and specs, reliance and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.blocks import join_in_blocks
from ..functions.cols import ranked_entries
from ..functions.ranks import value_cdf


def signature(long: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """TOP-01: features of a group by |z| of its mean against the global mean and deviation."""
    whole = long.groupBy("feature").agg(F.avg("value").alias("gm"), F.stddev_samp("value").alias("gs"))
    mean = long.groupBy(*keys, "feature").agg(F.avg("value").alias("m"))
    z = mean.join(whole, "feature").where(F.col("gs") > 0).withColumn("z", F.round((F.col("m") - F.col("gm")) / F.col("gs"), 2))
    w = Window.partitionBy(*keys).orderBy(F.abs("z").desc(), "feature")
    return z.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "feature", "z", "rank")


def top_explanation(contrib: Column, k: int = 3) -> Column:
    """TOP-02: the k largest contributions by size of an array<struct<feature, weight>>."""
    tagged = F.transform(contrib, lambda e: F.struct((-F.abs(e["weight"])).alias("n"), e["feature"].alias("feature"), e["weight"].alias("weight")))
    return F.slice(F.transform(F.array_sort(tagged), lambda e: F.struct(e["feature"].alias("feature"), e["weight"].alias("weight"))), 1, k)


def top_classes(probs: Column, k: int = 5) -> Column:
    """TOP-03."""
    return F.slice(ranked_entries(probs), 1, k)


def cap_flags(flags: DataFrame, total: DataFrame, keys: list[str], share: float = 0.10, ledger: int | None = None) -> DataFrame:
    """TOP-04: the worst ceil(share · rows) flags per key, at most `ledger` if given; total: (keys, n_rows).

    The rank of a flag is the number of flags of its key with a smaller value, counted over buckets,
    plus its place among the flags of the same value, so a key is never ordered by one task.
    """
    below = value_cdf(flags, keys, "self_conf").select(*keys, "self_conf", F.col("n_before").alias("_before"))
    limit = F.greatest(F.lit(1), F.ceil(F.col("n_rows") * share))
    limit = limit if ledger is None else F.least(limit, F.lit(ledger))
    near = flags.join(below, [*keys, "self_conf"]).join(total, keys).where(F.col("_before") < limit)
    same = Window.partitionBy(*keys, "self_conf").orderBy("row_id")
    ranked = near.withColumn("rank", (F.col("_before") + F.row_number().over(same)).cast("int"))
    return ranked.where(F.col("rank") <= limit).select(*flags.columns, "rank")


def suspects_to_ask(ledger: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """TOP-06: human-labelled suspects not asked yet, worst k per key."""
    todo = ledger.where(~F.col("asked") & F.col("provenance").isin("confirmed", "corrected"))
    w = Window.partitionBy(*keys).orderBy("self_conf", "row_id")
    return todo.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mark_asked(ledger: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    hit = asked.select(*on, F.lit(True).alias("_a"))
    return ledger.join(hit, on, "left").withColumn("asked", F.col("asked") | F.coalesce("_a", F.lit(False))).drop("_a")


def option_order(probs: Column, enabled: Column) -> Column:
    """TOP-07: known enabled classes by probability, then the other enabled ones by name."""
    known = F.transform(ranked_entries(probs), lambda e: e["k"])
    return F.array_union(F.filter(known, lambda s: F.array_contains(enabled, s)), F.array_sort(enabled))


def next_options(order: Column, asked: Column, buttons: int = 3) -> tuple[Column, Column]:
    """TOP-07: the next batch without what was asked, and whether more follow."""
    rest = F.array_except(order, asked)
    more = F.size(rest) > buttons
    return F.when(more, F.slice(rest, 1, buttons - 1)).otherwise(rest), more


def merge_cards(members: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """SET-01: member windows after merging cards, each window once: (keys, card, w, hour).

    members: (keys, card, w, hour), one row per member window; merges: (card, into). Windows stay
    rows, so a card of any size is never gathered.
    """
    moved = members.join(merges, "card", "left").withColumn("card", F.coalesce("into", "card")).drop("into")
    return moved.select(*keys, "card", "w", "hour").distinct()


def shared_features(a: Column, b: Column, top: int = 4) -> Column:
    return F.size(F.array_intersect(F.slice(a, 1, top), F.slice(b, 1, top)))


def signature_overlaps(cards: DataFrame, others: DataFrame, key: str, min_shared: int, top: int = 4) -> DataFrame:
    """SET-02 / JON-22: pairs of cards that share at least min_shared of their top features.

    Sets of top features are compared once, however many cards have them; pairs of sets become
    pairs of cards at the end.
    """
    left, right = (carded(df, key, name, top) for df, name in ((cards, "a"), (others, "b")))
    sets = set_overlaps(left, right, min_shared, top)
    hits = join_in_blocks(left.join(sets, "set_a"), right, ["set_b"])
    return hits.where("a <> b").select("a", "b", "shared")


def carded(df: DataFrame, key: str, name: str, top: int = 4) -> DataFrame:
    """(name, set_name) of every different card: its key and its sorted top features."""
    one = df.select(F.col(key).alias(name), "features").where(F.col(name).isNotNull() & F.col("features").isNotNull()).distinct()
    return one.select(name, F.array_sort(F.slice("features", 1, top)).alias(f"set_{name}"))


def set_overlaps(left: DataFrame, right: DataFrame, min_shared: int, top: int = 4) -> DataFrame:
    """(set_a, set_b, shared): different sets meet on feature pairs they both own, so min_shared counts from 2."""
    def combos(df, name):
        f = F.col(f"set_{name}")
        idx = F.sequence(F.lit(1), F.size(f))
        pair = F.flatten(F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: F.concat_ws("|", F.element_at(f, i), F.element_at(f, j)))))
        return df.select(f"set_{name}").distinct().where(F.size(f) > 0).select(f"set_{name}", F.explode(pair).alias("combo"))

    met = join_in_blocks(combos(left, "a"), combos(right, "b"), ["combo"]).select("set_a", "set_b").distinct()
    return met.withColumn("shared", shared_features(F.col("set_a"), F.col("set_b"), top)).where(F.col("shared") >= min_shared)


def merge_specs(existing: DataFrame, new: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    """SET-05: the existing definition of a key wins, new keys are added, named keys are dropped."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    first = both.groupBy(*keys).agg(F.min_by(F.struct(*rest, "_src"), F.col("_src")).alias("_r"))
    kept = first.join(drops.select(*keys), keys, "left_anti")
    return kept.select(*keys, *[F.col(f"_r.{c}") for c in rest], F.when(F.col("_r._src") == 0, "existing").otherwise("new").alias("origin"))


def reliance(matched: DataFrame) -> DataFrame:
    """STA-20: share of absolute importance per binding; matched: (feature, weight, name, role)."""
    total = matched.agg(F.sum(F.abs("weight"))).scalar()
    return matched.where(F.col("name").isNotNull()).groupBy("name", "role").agg((F.sum(F.abs("weight")) / total).alias("share"))


def audit(bindings: DataFrame, bound: DataFrame, entities: DataFrame, shares: DataFrame, min_share: float = 0.02) -> DataFrame:
    """STA-20: devices whose ambient readings carry weight while a direct signal is unused."""
    from .metadata import binding_tier, domain_of, looks_direct

    ambient = bindings.where(F.col("enabled") & ~F.col("model_excluded")).join(shares, "name").where(
        (F.col("share") >= min_share) & (binding_tier(F.col("role"), F.col("tier_option")) == 3)
    )
    acting = entities.where(domain_of(F.col("entity_id")).isin(L.ACTUATOR_DOMAINS)).select("device_id").distinct()
    free = entities.join(bound.select("entity_id"), "entity_id", "left_anti").where(looks_direct(F.col("entity_id")))
    n = free.groupBy("device_id").agg(F.count(F.lit(1)).alias("candidates"))
    found = ambient.join(acting, "device_id", "left_semi").join(n, "device_id")
    return found.groupBy("device_id").agg(F.count(F.lit(1)).alias("bindings"), F.sum("share").alias("share"), F.max("candidates").alias("candidates"))
