"""Entities, bindings, rooms, activities, rules and feature definitions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.blocks import join_frequent, join_in_blocks
from ..functions.cols import room_key, slugify, tokens


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def domain_of(entity_id: Column) -> Column:
    return F.split(entity_id, r"\.")[0]


def object_of(entity_id: Column) -> Column:
    return F.lower(F.element_at(F.split(entity_id, r"\.", 2), -1))


# --- entity tests (PRD-15..19, PRD-27) ---------------------------------------------------------


def is_own_output(entity_id: Column, device: Column | None = None, prefix: str = "dayweave") -> Column:
    """PRD-16: entities this engine publishes itself."""
    obj = object_of(entity_id)
    ends = F.lit(False)
    for s in L.OWN_SUFFIXES:
        ends = ends | obj.endswith(s)
    own = obj.isin(f"{prefix}_alive", f"{prefix}_attention") | (obj.startswith(f"{prefix}_") & ends)
    if device is not None:
        d = F.lower(F.trim(F.coalesce(device, F.lit(""))))
        own = own | (d == prefix) | d.startswith(f"{prefix} -")
    return own


def is_noise(entity_id: Column, name: Column, device_class: Column) -> Column:
    """PRD-15."""
    text = F.lower(F.concat_ws(" ", entity_id, F.coalesce(name, F.lit(""))))
    return (
        domain_of(entity_id).isin(L.NEVER_DOMAINS)
        | is_own_output(entity_id)
        | text.rlike(L.BLOCKLIST)
        | F.coalesce(device_class.isin(L.BLOCKED_CLASSES), F.lit(False))
    )


def is_bindable(entity_id: Column, role: Column, override: Column | bool = False) -> Column:
    """PRD-17: stateless domains, diagnostics and own output never; else the role's domains or an override."""
    dom = domain_of(entity_id)
    allowed = F.array_contains(F.coalesce(F.create_map(*[x for r, ds in L.ROLE_DOMAINS.items() for x in (F.lit(r), F.array(*map(F.lit, ds)))])[role], F.array().cast("array<string>")), dom)
    insist = (F.lit(override) if isinstance(override, bool) else override) & dom.isin(L.STATE_DOMAINS)
    never = dom.isin(L.NEVER_DOMAINS) | F.lower(entity_id).rlike(L.BLOCKLIST) | is_own_output(entity_id)
    return ~never & (allowed | insist)


def is_person_tracker(entity_id: Column, name: Column | None = None) -> Column:
    """PRD-18."""
    text = F.lower(F.concat_ws(" ", entity_id, F.coalesce(name, F.lit("")) if name is not None else F.lit("")))
    return domain_of(entity_id).isin("person", "device_tracker") & ~text.rlike(L.NOT_A_TRACKER)


def suggest_role(entity_id: Column, name: Column, device_class: Column, unit: Column) -> Column:
    """PRD-19: domain, device class, name patterns in order, unit; NULL for noise."""
    text = F.lower(F.concat_ws(" ", entity_id, F.coalesce(name, F.lit(""))))
    barred = is_own_output(entity_id) | text.rlike(L.BLOCKLIST) | F.coalesce(device_class.isin(L.BLOCKED_CLASSES), F.lit(False))
    by_name = F
    for pattern, role in L.NAME_HINTS:
        by_name = by_name.when(text.rlike(pattern), role)
    found = F.coalesce(lookup(L.DOMAIN_ROLES, domain_of(entity_id)), lookup(L.DEVICE_CLASS_ROLES, device_class), by_name, lookup(L.UNIT_ROLES, unit))
    return F.when(~barred, found)


def looks_direct(entity_id: Column) -> Column:
    """PRD-27: could this entity carry a human's direct action?"""
    dom, obj = domain_of(entity_id), object_of(entity_id)
    ok = dom.isin(L.DIRECT_DOMAINS) & ~is_noise(entity_id, F.lit(""), F.lit(None).cast("string")) & ~obj.rlike(L.DIAGNOSTIC_WORDS)
    return ok & (dom.isin("switch", "media_player", "light") | (~obj.rlike(L.AMBIENT_WORDS) & obj.rlike(L.ACTION_WORDS)))


def heuristic_bindings(entities: DataFrame, order: str) -> DataFrame:
    """PRD-20: suggested, gated and uniquely named bindings; the n-th use of a name gets n − 1 "_2"."""
    from ..session import materialise

    spark = entities.sparkSession
    # the patterns cost far more than reading the rows, and names grow with their number: both are spread into a given
    # number of parts, as adaptive plans see only short rows; the rows are written, or filters by pattern would move before the spread
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    e = materialise(entities.repartition(parts, order), "entities").withColumn("role", suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit")))
    # 13 roles and their fixed domains, as a lookup the role column is joined to
    pairs = [(r, d) for r, ds in L.ROLE_DOMAINS.items() for d in ds]
    domains = entities.sparkSession.createDataFrame(pairs, "role string, _domain string")
    dom = domain_of(F.col("entity_id"))
    barred = dom.isin(L.NEVER_DOMAINS) | F.lower("entity_id").rlike(L.BLOCKLIST) | is_own_output(F.col("entity_id"))
    ok = e.withColumn("_domain", dom).where(~barred).join(F.broadcast(domains), ["role", "_domain"]).drop("_domain")
    slug = slugify(F.col("entity_id"))
    rn = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    numbered = ok.withColumn("slug", slug).withColumn("_n", rn).repartition(parts, "slug", "_n")
    return numbered.withColumn("name", F.concat("slug", F.repeat(F.lit("_2"), F.col("_n") - 1))).drop("slug", "_n")


# --- scope and ownership (PRD-07..09) -----------------------------------------------------------


def person_scope(bindings: DataFrame, persons: DataFrame, home: str = "home") -> DataFrame:
    """PRD-07: per person of a home, its enabled bindings that are shared or the person's own."""
    b = bindings.where("enabled").select(home, "name", "person_id")
    people = persons.select(home, "person_id")
    # a binding with an owner meets only the owner
    shared = join_in_blocks(people, b.where(F.col("person_id").isNull()).drop("person_id"), [home])
    return shared.unionByName(people.join(b.where(F.col("person_id").isNotNull()), [home, "person_id"])).select(home, "person_id", "name")


def binding_owner(bindings: DataFrame, persons: DataFrame) -> DataFrame:
    """PRD-08: explicit owner, else the first member whose id or a name token is in the binding's tokens."""
    words = persons.select("ord", "person_id", F.explode(F.array_distinct(F.concat(F.array(F.lower("person_id")), tokens(F.col("name"))))).alias("word"))
    first = words.groupBy("word").agg(F.min(F.struct("ord", "person_id")).alias("m"))
    hay = F.array_union(tokens(F.col("name")), tokens(F.col("entity_id")))
    spread = bindings.where(F.col("person_id").isNull()).select("binding_id", F.explode(hay).alias("word"))
    guess = spread.join(first, "word").groupBy("binding_id").agg(F.min("m").alias("m"))
    return bindings.join(guess, "binding_id", "left").withColumn("owner", F.coalesce("person_id", F.col("m.person_id"))).drop("m")


def without_foreign_personal(long_feats: DataFrame, owned: DataFrame) -> DataFrame:
    """PRD-09: drop another member's alarm, focus, steps and battery features. long: (person_id, binding, …)."""
    foreign = owned.where(F.col("role").isin(L.PERSONAL_ROLES) & F.col("owner").isNotNull()).select(F.col("name").alias("binding"), "owner")
    hit = long_feats.join(foreign, "binding", "left")
    return hit.where(F.col("owner").isNull() | (F.col("owner") == F.col("person_id"))).drop("owner")


def usable_columns(columns: list[str], excluded_bindings: list[str], dropped: list[str]) -> list[str]:
    """PRD-10/11: columns left after flagged bindings and retired features."""
    out = [c for c in columns if c not in set(dropped)]
    return [c for c in out if not any(c == b or c.startswith(b + "_") for b in excluded_bindings)]


# --- prefixes and phrases (PRD-31..33, JON-14) ---------------------------------------------------


def match_binding(columns: DataFrame, names: DataFrame, col: str = "feature") -> DataFrame:
    """JON-14 / PRD-32: longest binding name that is the column or a prefix of it up to "_".

    The prefixes of a column are few, so they are spelled out and joined by equality.
    names: (name, …); adds the matched name's columns and suffix, NULL without a match.
    A column such as the hour is in a good part of all rows, which are spread over the tasks.
    """
    parts = F.split(F.regexp_replace(col, "_lag1$", ""), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    counts = columns.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    hit = counts.select(col, F.explode(prefixes).alias("name")).join(names, "name")
    rest = [c for c in names.columns if c != "name"]
    best = hit.groupBy(col).agg(F.max_by(F.struct("name", *rest), F.length("name")).alias("_v"))
    out = join_frequent(columns, best, col, counts).withColumnRenamed("_v", "_m")
    base = F.regexp_replace(F.col(col), "_lag1$", "")
    suffix = F.regexp_replace(F.substring(base, F.length("_m.name") + 1, F.length(base)), "^_+", "")
    return out.select(*columns.columns, F.col("_m.name").alias("name"), *[F.col(f"_m.{c}").alias(c) for c in rest], suffix.alias("suffix"))


def binding_tier(role: Column, option: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(option, lookup(L.ROLE_TIER, role), F.lit(2))))


def column_tier(matched_tier: Column, feature: Column) -> Column:
    """PRD-31: mobility and distance columns are behavioural, unmatched columns a prior."""
    return F.when(feature.startswith("mob_") | feature.startswith("dist_to_"), 2).otherwise(F.coalesce(matched_tier, F.lit(0)))


def strip_suffix(feature: Column) -> Column:
    """PRD-32: binding name by removing a known recipe suffix."""
    longest_first = sorted(L.FEATURE_SUFFIXES, key=len, reverse=True)
    return F.regexp_replace(feature, f"_({'|'.join(longest_first)})$", "")


def phrase(role: Column, suffix: Column, up: Column, place: Column, who: Column, metric: Column) -> Column:
    """PRD-33: what a high or low feature means in words."""
    table = {f"{r}|{s}": ps for (r, s), ps in L.PHRASES.items()}
    key = F.concat_ws("|", role, suffix)
    tmpl = F.when(up, lookup({k: v[0] for k, v in table.items()}, key)).otherwise(lookup({k: v[1] for k, v in table.items()}, key))
    missing = F.when(up, F.concat(F.lit("no reading from "), place)).otherwise(F.concat(place, F.lit(" reporting")))
    generic = F.concat_ws(" ", place, F.regexp_replace(suffix, "_", " "), F.when(up, "higher").otherwise("lower"))
    filled = F.replace(F.replace(F.replace(tmpl, F.lit("{place}"), place), F.lit("{who}"), who), F.lit("{metric}"), metric)
    text = F.when(suffix == "missing", missing).otherwise(F.coalesce(filled, generic))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 10000))


# --- rules (PRD-05, PRD-06) -----------------------------------------------------------------------


def starter_rules(bindings: DataFrame, activities: DataFrame) -> DataFrame:
    """PRD-05: away, sleeping, cooking, movie and eating rules from the sensors at hand.

    One row per rule: (slug, person_id, priority, predicate text).
    """
    place = F.lower(F.coalesce("room", "name"))
    b = bindings.where("enabled").withColumn("place", place)
    night = '{"any": [{"feat": "hour_of_day", "op": ">=", "value": 22}, {"feat": "hour_of_day", "op": "<", "value": 7}]}'
    leaf = lambda name, suffix, op, v: F.concat(F.lit('{"feat": "'), name, F.lit(f'_{suffix}", "op": "{op}", "value": {v}}}'))
    both = lambda *xs: F.concat(F.lit('{"all": ['), F.concat_ws(", ", *xs), F.lit("]}"))
    name, person = F.col("name"), F.col("person_id")
    first = lambda role, words: b.where((F.col("role") == role) & F.col("place").rlike(words)).agg(F.min_by("name", "binding_id")).scalar()
    beds = b.where("role = 'bed'")
    rows = [
        b.where((F.col("role") == "person") & is_person_tracker(F.col("entity_id"))).select(
            F.lit("away").alias("slug"), person, F.lit(10).alias("priority"), both(leaf(name, "home_last", "==", 0)).alias("predicate")),
        beds.select(F.lit("sleeping").alias("slug"), person, F.lit(20).alias("priority"), both(leaf(name, "occupied", "==", 1), F.lit(night)).alias("predicate")),
        b.where((F.col("role") == "presence") & F.col("place").contains("kitchen")).select(
            F.lit("cooking").alias("slug"), F.lit(None).cast("string").alias("person_id"), F.lit(30).alias("priority"),
            both(leaf(name, "frac", ">", 0.3), leaf(first("power", "kitchen|oven|stove|cook"), "on", "==", 1)).alias("predicate")),
        b.where("role = 'media'").select(
            F.lit("movie").alias("slug"), F.lit(None).cast("string").alias("person_id"), F.lit(40).alias("priority"),
            both(leaf(name, "playing", "==", 1), F.coalesce(leaf(first("presence", "living|sofa|couch|tv"), "frac", ">", 0.2), F.lit('{"feat": "hour_of_day", "op": ">=", "value": 18}'))).alias("predicate")),
        b.where((F.col("role") == "presence") & F.col("place").rlike("dining|table")).select(
            F.lit("eating").alias("slug"), F.lit(None).cast("string").alias("person_id"), F.lit(50).alias("priority"), both(leaf(name, "frac", ">", 0.3)).alias("predicate")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.join(activities.select("slug"), "slug", "left_semi")


def draft_rule(signature: Column) -> Column:
    """PRD-06: the top three features that are high, each "> 0.5", as predicate JSON."""
    high = F.filter(F.slice(signature, 1, 3), lambda s: s["z"] > 0)
    leaves = F.transform(high, lambda s: F.struct(s["feature"].alias("feat"), F.lit(">").alias("op"), F.lit(0.5).alias("value")))
    return F.to_json(F.struct(leaves.alias("all")))


# --- rooms (PRD-25, PRD-26) -------------------------------------------------------------------------


def room_display(name: Column) -> Column:
    words = F.filter(F.split(name, "[^a-zA-Z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def canonical_rooms(bindings: DataFrame) -> DataFrame:
    """PRD-25: one display per room key: the spelling with most separators, then longest."""
    spelled = bindings.where(F.col("room").isNotNull()).select("room").distinct()
    rank = F.struct(F.size(F.split("room", "[^a-zA-Z0-9]+")), F.length("room"), F.col("room"))
    return spelled.groupBy(room_key(F.col("room")).alias("key")).agg(room_display(F.max_by("room", rank)).alias("display"))


def apply_rooms(bindings: DataFrame, canon: DataFrame) -> DataFrame:
    """PRD-26: rooms replaced by the mapped display of their key."""
    keyed = bindings.withColumn("key", room_key(F.col("room")))
    return keyed.join(canon, "key", "left").withColumn("room", F.coalesce("display", "room")).drop("key", "display")


# --- activities (PRD-23, 24, 28..30, 35, 36) ---------------------------------------------------------


def parent_map(activities: DataFrame) -> DataFrame:
    p = activities.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return activities.join(p, "parent_id", "left").select("slug", "parent_slug")


def to_coarse(labels: DataFrame, activities: DataFrame, col: str = "label") -> DataFrame:
    """PRD-28: top ancestor in the two-level tree."""
    pm = parent_map(activities).withColumnRenamed("slug", col)
    return labels.join(pm, col, "left").withColumn("coarse", F.coalesce("parent_slug", col))


def to_fine(labels: DataFrame, activities: DataFrame, parent: Column, col: str = "label") -> DataFrame:
    """PRD-29: a parent's own sub-problem: children keep their slug, the parent stays, the rest is NULL."""
    c = to_coarse(labels, activities, col)
    return c.withColumn("fine", F.when((F.col(col) == parent) | (F.col("parent_slug") == parent), F.col(col)))


def apply_alias(df: DataFrame, aliases: DataFrame, cols: list[str]) -> DataFrame:
    """PRD-23: merged slugs replaced in label columns. aliases: (src, dst)."""
    out = df
    for c in cols:
        a = aliases.select(F.col("src").alias(c), F.col("dst").alias("_d"))
        out = out.join(a, c, "left").withColumn(c, F.coalesce("_d", c)).drop("_d")
    return out.select(*df.columns)


def alias_probabilities(df: DataFrame, aliases: DataFrame, keys: list[str], col: str = "probs") -> DataFrame:
    """PRD-23: probability keys replaced; keys that collide are added up."""
    long = df.select(*keys, F.explode(col).alias("src", "p")).join(aliases, "src", "left")
    per = long.groupBy(*keys, F.coalesce("dst", "src").alias("k")).agg(F.sum("p").alias("p"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "p")))).alias(col))


def merge_activity(aliases: DataFrame, source: Column, target: Column) -> DataFrame:
    """PRD-24: aliases that pointed at the merged slug now point at the target, plus the new pair."""
    moved = aliases.withColumn("dst", F.when(F.col("dst") == source, target).otherwise(F.col("dst")))
    added = aliases.sparkSession.range(1).select(source.alias("src"), target.alias("dst"))
    return moved.where(F.col("src") != F.col("dst")).unionByName(added).distinct()


def canonical_activity(names: DataFrame, slugs: DataFrame, person_words: list[str], col: str = "name") -> DataFrame:
    """PRD-30: the existing slug a proposed name duplicates, or NULL. slugs: (slug)."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    raw = norm(F.col(col))
    kept = F.array_join(F.filter(F.split(raw, " "), lambda t: ~t.isin(person_words) if person_words else F.lit(True)), " ")
    df = names.withColumns({"_raw": raw, "_cut": F.when(kept != "", kept).otherwise(raw)})
    known = slugs.select("slug", norm(F.regexp_replace("slug", "_", " ")).alias("_words"))
    by = lambda c, out: known.select(F.col("_words").alias(c), F.col("slug").alias(out))
    df = df.join(by("_cut", "_s1"), "_cut", "left").join(by("_raw", "_s2"), "_raw", "left")
    reserved = F
    for slug, words in L.RESERVED_SYNONYMS.items():
        phrases = [F.col("_cut").contains(w) for w in words if " " in w]
        hit = F.col("_cut").isin(words) | F.col("_raw").isin(words) | F.arrays_overlap(F.split("_cut", " "), F.array(*map(F.lit, L.RESERVED_TOKENS[slug])).cast("array<string>"))
        for p in phrases:
            hit = hit | p
        reserved = reserved.when(hit, slug)
    df = df.withColumn("_s3", reserved)
    # only a reserved state that exists counts
    df = df.join(slugs.select(F.col("slug").alias("_s3"), F.lit(True).alias("_ok")), "_s3", "left")
    return df.select(*names.columns, F.coalesce("_s1", "_s2", F.when(F.col("_ok"), F.col("_s3"))).alias("duplicate_of"))


def backfill_hierarchy(activities: DataFrame, home_slug: str = "home", fine: list[str] | None = None) -> DataFrame:
    """PRD-35: known fine activities without a parent get the home activity as parent."""
    home = activities.where(F.col("slug") == home_slug).agg(F.min("id")).scalar()
    orphan = F.col("parent_id").isNull() & F.col("slug").isin(fine or L.FINE_UNDER_HOME)
    return activities.withColumn("parent_id", F.when(orphan, home).otherwise(F.col("parent_id")))


def delete_activity(activities: DataFrame, rules: DataFrame, slug: str) -> tuple[DataFrame, DataFrame]:
    """PRD-36: without the slug; its children move up and its rules are disabled."""
    gone = activities.where(F.col("slug") == slug).agg(F.min("id")).scalar()
    kept = activities.where(F.col("slug") != slug)
    kept = kept.withColumn("parent_id", F.when(F.col("parent_id") != F.coalesce(gone, F.lit(-1)), F.col("parent_id")))
    return kept, rules.withColumn("enabled", F.col("enabled") & (F.col("slug") != slug))


# --- definitions (PRD-12..14) -------------------------------------------------------------------------


def params_ok(transform: Column, params: Column) -> Column:
    """PRD-13: exactly the declared parameters, each of its type; params is JSON text."""
    token = {"int": r"-?[0-9]+", "float": r"-?[0-9]+(\.[0-9]+)?", "str": r'"[^"]*"', "list[str]": r'\[("[^"]*"(, *"[^"]*")*)?\]'}
    # one anchored shape per transform: no parameter left out, none too many
    shapes = {
        name: r"^\{\s*" + r"\s*,\s*".join(rf'"{p}"\s*:\s*{token[t]}' for p, t in spec[2].items()) + r"\s*\}$" for name, spec in L.TRANSFORMS.items()
    }
    out = F
    for name, rx in shapes.items():
        out = out.when(transform == name, F.coalesce(params, F.lit("{}")).rlike(rx))
    return out.otherwise(False)


def transform_table(spark, mode: str = "conservative") -> DataFrame:
    """PRD-14: the whitelist as a table."""
    rows = [(n, t, k, c) for n, (t, k, _, c) in L.TRANSFORMS.items() if c or mode == "full"]
    return spark.createDataFrame(rows, "transform string, tiers array<string>, input_kind string, conservative boolean")


def validate_definitions(defs: DataFrame, selections: DataFrame, mode: str = "conservative", budget: int = 250) -> DataFrame:
    """PRD-12: (spec_id, ord, name, ok, reason) in definition order.

    defs: (spec_id, ord, name, transform, inputs, params, window_min, tier);
    selections: (spec_id, entity_id, keep, reliability). A spec is a short list, so the checks that
    depend on earlier acceptances run as one fold over its array.
    """
    allowed = {n: s for n, s in L.TRANSFORMS.items() if s[3] or mode == "full"}
    kind = lookup({n: s[1] for n, s in allowed.items()}, F.col("transform"))
    tiers = F.create_map(*[x for n, s in allowed.items() for x in (F.lit(n), F.array(*map(F.lit, s[0])))])[F.col("transform")]
    d = defs.withColumns({"_kind": kind, "_tiers": tiers})
    ins = d.where("_kind = 'entity'").select("spec_id", "ord", F.explode("inputs").alias("entity_id"))
    ins = ins.join(selections, ["spec_id", "entity_id"], "left").groupBy("spec_id", "ord").agg(
        F.bool_and(F.coalesce("keep", F.lit(False))).alias("_kept"), F.bool_and(F.coalesce("reliability", F.lit("ok")) == "unusable").alias("_bad")
    )
    d = d.join(ins, ["spec_id", "ord"], "left")
    entity = F.col("_kind") == "entity"
    # "name" sits before and "rest" after the duplicate check
    late = (
        F.when(F.col("_kind").isNull(), "transform not allowed")
        .when(~params_ok(F.col("transform"), F.col("params")), "bad params")
        .when(~F.coalesce(F.col("window_min"), F.lit(30)).between(1, 1440), "window out of range")
        .when(F.size("inputs") == 0, "no inputs")
        .when(entity & ~F.coalesce("_kept", F.lit(False)), "input not kept")
        .when(entity & ~F.coalesce(F.array_contains("_tiers", F.col("tier")), F.lit(False)), "tier mismatch")
        .when(entity & F.coalesce("_bad", F.lit(False)), "inputs unusable")
    )
    row = F.struct("ord", "name", F.col("name").rlike(L.FEATURE_NAME).alias("named"), late.alias("late"), (F.col("_kind") == "feature").alias("comp"), "inputs")
    grouped = d.groupBy("spec_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<struct<ord:bigint,name:string,reason:string>>").alias("out"))

    def step(acc, r):
        reason = (
            F.when(F.size(acc["names"]) >= budget, "over budget")
            .when(~r["named"], "bad name")
            .when(F.array_contains(acc["names"], r["name"]), "duplicate name")
            .when(r["late"].isNotNull(), r["late"])
            .when(F.coalesce(r["comp"], F.lit(False)) & (F.size(F.array_except(r["inputs"], acc["names"])) > 0), "input not defined earlier")
            .otherwise("ok")
        )
        names = F.when(reason == "ok", F.array_append(acc["names"], r["name"])).otherwise(acc["names"])
        one = F.struct(r["ord"].alias("ord"), r["name"].alias("name"), reason.alias("reason"))
        return F.struct(names.alias("names"), F.array_append(acc["out"], one).alias("out"))

    folded = grouped.select("spec_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("r"))
    return folded.select("spec_id", "r.ord", "r.name", (F.col("r.reason") == "ok").alias("ok"), "r.reason")


# --- relevance and triage (PRD-21, 22, SUM-45) ---------------------------------------------------------


def relevance(entities: DataFrame, devices: DataFrame, integrations: DataFrame, decisions: DataFrame) -> DataFrame:
    """PRD-21: (verdict, level, reason) per entity; the most specific explicit choice wins.

    devices: (device_id, device_name, model, entry_type); integrations: (integration, domain);
    decisions: (level, id, verdict).
    """
    pick = lambda level, key, out: decisions.where(F.col("level") == level).groupBy(F.col("id").alias(key)).agg(F.max("verdict").alias(out))
    j = (
        entities.join(devices, "device_id", "left").join(integrations, "integration", "left")
        .join(pick("entity", "entity_id", "_de"), "entity_id", "left")
        .join(pick("device", "device_id", "_dd"), "device_id", "left")
        .join(pick("integration", "integration", "_di"), "integration", "left")
    )
    role = suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit"))
    text = F.lower(F.concat_ws(" ", F.coalesce("device_name", F.lit("")), F.coalesce("model", F.lit(""))))
    infra = (F.coalesce(F.col("entry_type"), F.lit("")) == "service") | text.rlike(L.DEVICE_INFRA)
    v = lambda verdict, level, reason: F.struct(
        (F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"), F.lit(level).alias("level"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    got = (
        F.when(is_own_output(F.col("entity_id"), F.col("device_name")), v("skip", "entity", "own output"))
        .when(F.col("_de").isNotNull(), v(F.col("_de"), "entity", "chosen"))
        .when(F.col("_dd").isNotNull(), v(F.col("_dd"), "device", "chosen"))
        .when(F.col("_di").isNotNull(), v(F.col("_di"), "integration", "chosen"))
        .when(F.lower("domain").isin(L.INTEGRATION_SKIP), v("skip", "integration", "not about the home"))
        .when(F.col("device_name").isNotNull() & infra, v("skip", "device", "infrastructure"))
        .when(is_noise(F.col("entity_id"), F.col("friendly_name"), F.col("device_class")), v("skip", "entity", "diagnostic"))
        .when(role.isNotNull(), v("keep", "entity", F.concat(F.lit("looks like "), role)))
        .when(F.lower("domain").isin(L.INTEGRATION_KEEP), v("unsure", "device", "no clear role yet"))
        .otherwise(v("unsure", "entity", "review"))
    )
    return j.withColumn("_v", got).select("entity_id", "device_id", "integration", "_v.verdict", "_v.level", "_v.reason")


def triage(entities: DataFrame, excluded: list[str] = (), included: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """PRD-22: (buckets, kept entities): role categories, and the presence floor always kept."""
    role = suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit"))
    cat = F.coalesce(lookup(L.ROLE_CATEGORY, role), F.lit("other"))
    e = entities.select("entity_id", cat.alias("category"))
    relevant = F.col("category").isin(L.RELEVANT_CATEGORIES)
    buckets = e.groupBy("category").agg(F.count(F.lit(1)).alias("entities"), F.bool_or(relevant).alias("relevant"))
    chosen = (relevant & ~F.col("category").isin(list(excluded))) | F.col("category").isin(list(included))
    return buckets, e.where(chosen | is_person_tracker(F.col("entity_id"))).select("entity_id")


def hierarchy_rollup(verdicts: DataFrame) -> DataFrame:
    """SUM-45: kept, skipped and unsure entities per integration and device, with level totals."""
    return verdicts.rollup("integration", "device_id").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("verdict") == "keep").alias("kept"),
        F.count_if(F.col("verdict") == "skip").alias("skipped"),
        F.count_if(F.col("verdict") == "unsure").alias("unsure"),
    )


# --- maintenance (PRD-34, 37, JON-12..25) ---------------------------------------------------------------


def prune_silent(bindings: DataFrame, counts: DataFrame) -> DataFrame:
    """PRD-34: bindings without observations are disabled; trackers stay."""
    j = bindings.join(counts, "entity_id", "left")
    silent = (F.coalesce("n", F.lit(0)) == 0) & (F.col("role") != "person")
    return j.withColumn("enabled", F.col("enabled") & ~silent).drop("n")


def clean_bindings(bindings: DataFrame, persons: DataFrame) -> DataFrame:
    """PRD-37: counts of bindings that fail the gate and of owners that can be filled in."""
    b = binding_owner(bindings, persons)
    bad = (F.col("role") != "person") & ~is_bindable(F.col("entity_id"), F.col("role"))
    return b.agg(F.count_if(bad).alias("removed"), F.count_if(~bad & F.col("person_id").isNull() & F.col("owner").isNotNull()).alias("owned"), F.count_if(~bad).alias("kept"))


def device_siblings(ambient: DataFrame, entities: DataFrame, bindings: DataFrame) -> DataFrame:
    """JON-12: unbound direct entities that share a device with an ambient binding."""
    free = entities.join(bindings.select("entity_id"), "entity_id", "left_anti").where(looks_direct(F.col("entity_id")))
    return ambient.select("name", "device_id").join(free.select("device_id", F.col("entity_id").alias("candidate")), "device_id").drop("device_id")


def device_label(entities: DataFrame, devices: DataFrame) -> DataFrame:
    """JON-13: "name — model" unless the name already says the model."""
    j = entities.join(devices, "device_id", "left")
    both = F.col("device_name").isNotNull() & F.col("model").isNotNull() & ~F.lower("device_name").contains(F.lower(F.col("model")))
    return j.withColumn("label", F.when(both, F.concat_ws(" — ", "device_name", "model")).otherwise(F.coalesce("device_name", "model")))


def match_members(persons: DataFrame, entities: DataFrame) -> DataFrame:
    """JON-15: member → tracker by shared words, person.* first, then entity order.

    Only the best tracker per word can win, so both sides shrink to one row per word first.
    """
    track = entities.where(is_person_tracker(F.col("entity_id"), F.col("friendly_name")) & ~F.col("disabled"))
    words = F.explode(F.array_union(tokens(F.col("entity_id")), tokens(F.coalesce("friendly_name", F.lit(""))))).alias("word")
    rank = F.struct((~F.col("entity_id").startswith("person.")).alias("late"), F.col("part_id"), F.col("entity_id"))
    best = track.select("entity_id", "part_id", words).groupBy("word").agg(F.min(rank).alias("m"))
    want = persons.select("person_id", F.explode(F.array_union(F.array(F.lower("person_id")), tokens(F.col("name")))).alias("word"))
    return want.join(best, "word").groupBy("person_id").agg(F.min("m").alias("m")).select("person_id", F.col("m.entity_id").alias("entity_id"))


def link_members(persons: DataFrame, explicit: DataFrame, proposed: DataFrame, fallback: DataFrame) -> DataFrame:
    """JON-16: explicit over proposed over fallback; only real trackers are linked."""
    col = lambda df, out: df.select("person_id", F.col("entity_id").alias(out))
    j = persons.select("person_id").join(col(explicit, "e1"), "person_id", "left").join(col(proposed, "e2"), "person_id", "left").join(col(fallback, "e3"), "person_id", "left")
    source = F.when(F.col("e1").isNotNull(), "explicit").when(F.col("e2").isNotNull(), "proposed").otherwise("fallback")
    out = j.withColumns({"entity_id": F.coalesce("e1", "e2", "e3"), "source": source}).where(F.col("entity_id").isNotNull())
    return out.where(is_person_tracker(F.col("entity_id"))).select("person_id", "entity_id", "source")


def repair_person_bindings(bindings: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON-17: numeric trackers become custom sensors; rules that use their home_last are disabled.

    rules: (rule_id, enabled, feats array<string>).
    """
    bad = (F.col("role") == "person") & ~is_person_tracker(F.col("entity_id"))
    fixed = bindings.withColumns({"demoted": bad, "role": F.when(bad, "custom").otherwise(F.col("role")), "person_id": F.when(~bad, F.col("person_id"))})
    names = bindings.where(bad).select(F.concat("name", F.lit("_home_last")).alias("feat"))
    hit = rules.select("rule_id", F.explode("feats").alias("feat")).join(names, "feat", "left_semi").select("rule_id").distinct()
    off = rules.join(hit.withColumn("_hit", F.lit(True)), "rule_id", "left")
    return fixed, off.withColumn("enabled", F.col("enabled") & F.col("_hit").isNull()).drop("_hit")


def sync_inventory(live: DataFrame, bindings: DataFrame, pending: DataFrame) -> DataFrame:
    """JON-18: what a scan changes: (entity_id, action) with room updates, fresh and kept proposals, stale ones."""
    usable = live.where(~F.col("disabled"))
    keyed = usable.select("entity_id", F.col("area").alias("area"), F.lit(True).alias("_live"))
    b = bindings.select("entity_id", F.col("room").alias("room"), F.lit(True).alias("_bound"))
    p = pending.select("entity_id", F.lit(True).alias("_pending"))
    role = suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit"))
    good = usable.where(role.isNotNull() & is_bindable(F.col("entity_id"), role)).select("entity_id", F.lit(True).alias("_good"))
    j = keyed.join(b, "entity_id", "full_outer").join(p, "entity_id", "full_outer").join(good, "entity_id", "left")
    moved = F.col("_bound") & F.col("area").isNotNull() & (room_key(F.col("area")) != room_key(F.coalesce("room", F.lit(""))))
    action = (
        F.when(F.coalesce(moved, F.lit(False)), "room_update")
        .when(F.col("_bound"), "bound")
        .when(F.col("_live") & F.col("_good"), "stage")
        .when(F.col("_live") & F.col("_pending"), "keep_pending")
        .when(F.col("_pending"), "drop_pending")
        .otherwise("leave")
    )
    return j.select("entity_id", action.alias("action"))


def approve_pending(pending: DataFrame, chosen: DataFrame, bindings: DataFrame) -> DataFrame:
    """JON-19: chosen proposals named base, base_2, base_3 …, without the names in use.

    The i-th proposal of a base takes the i-th free number: with the taken numbers sorted, that is i
    plus how many taken ones lie at or below it, found over the (few) taken numbers of the base.
    A free number of one base is still checked against names that other proposals bring themselves.
    """
    take = pending.join(chosen.select("entity_id"), "entity_id", "left_semi").withColumn("base", F.col("suggested_name"))
    bases = take.select("base").distinct()
    # numbers in use: the bare name is number 1
    bare = bindings.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("taken"))
    stem, tail = F.regexp_extract("name", "^(.*)_([0-9]{1,9})$", 1), F.regexp_extract("name", "^(.*)_([0-9]{1,9})$", 2)
    in_use = bindings.select(F.col("name")).union(bases)
    numbered = in_use.where(tail != "").select(stem.alias("base"), tail.cast("long").alias("taken"), tail.alias("_t")).where((F.col("taken") > 1) & (F.col("taken").cast("string") == F.col("_t"))).drop("_t")
    used = bare.union(numbered).join(bases, "base", "left_semi").distinct()
    w = Window.partitionBy("base").orderBy("taken")
    # gaps between taken numbers: how many free numbers lie below each taken one
    free_below = used.withColumn("_below", F.col("taken") - F.row_number().over(w))
    limits = free_below.groupBy("base").agg(F.array_sort(F.collect_list("_below")).alias("_belows"))
    i = F.row_number().over(Window.partitionBy("base").orderBy("entity_id"))
    n = take.withColumn("_i", i).join(limits, "base", "left")
    number = F.col("_i") + F.coalesce(F.size(F.filter("_belows", lambda b: b < F.col("_i"))), F.lit(0))
    return n.withColumn("_n", F.when(F.col("_belows").isNull(), F.col("_i")).otherwise(number)).select(
        "entity_id", "suggested_role", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("_n").cast("string"))).alias("name"))


def dismiss_pending(pending: DataFrame, chosen: DataFrame) -> DataFrame:
    """JON-19: proposals left after a dismissal."""
    return pending.join(chosen.select("entity_id"), "entity_id", "left_anti")


def new_devices(devices: DataFrame, seen: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JON-20 / SET-03: unseen devices with a useful entity; nothing on the very first run."""
    useful = verdicts.where("verdict = 'keep'").select("device_id").distinct()
    fresh = devices.join(seen.select("device_id"), "device_id", "left_anti").join(useful, "device_id", "left_semi")
    return fresh.where(seen.agg(F.count(F.lit(1))).scalar() > 0)


def core_roles(entities: DataFrame, bindings: DataFrame, order: str) -> DataFrame:
    """JON-24: unbound heuristic person, presence and bed bindings."""
    h = heuristic_bindings(entities, order).where(F.col("role").isin("person", "presence", "bed"))
    return h.join(bindings.select("entity_id"), "entity_id", "left_anti")


def unassigned(entities: DataFrame, bindings: DataFrame) -> DataFrame:
    """JON-25: enabled entities neither bound nor noise, with the ranking flags."""
    noise = is_noise(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"))
    free = entities.where(~F.col("disabled") & ~noise).join(bindings.select("entity_id"), "entity_id", "left_anti")
    role = suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit"))
    score = (role.isNotNull().cast("int") * 4 + F.col("device_class").isNotNull().cast("int") * 2 + F.col("area").isNotNull().cast("int"))
    return free.select("entity_id", role.alias("role"), score.alias("score"))
