"""Entity, binding, room, activity, rule and definition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.cols import map_text, r6
from ..functions.predicates import compile_predicate, rule_columns
from ..operators import metadata as M
from ..operators import stats as X
from ..operators import topk as K
from ..sources import tables as T
from .catalog import query, view
from .windows_features import feature_table



def q(text):
    return "'" + text.replace("'", "''") + "'"


def sql_list(xs):
    return "(" + ",".join(q(x) for x in xs) + ")"


def sql_case(table, expr):
    return "CASE " + expr + " " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


TXT = "lower(entity_id||' '||coalesce(friendly_name,''))"
DOM = "split_part(entity_id,'.',1)"
OBJ = "lower(substr(entity_id, strpos(entity_id,'.')+1))"
BARRED = f"(regexp_matches({TXT},{q(L.BLOCKLIST)}) OR coalesce(device_class IN {sql_list(L.BLOCKED_CLASSES)},false))"
HINTS = "CASE " + " ".join(f"WHEN regexp_matches({TXT},{q(rx)}) THEN {q(r)}" for rx, r in L.NAME_HINTS) + " END"
ROLE = f"CASE WHEN NOT {BARRED} THEN coalesce({sql_case(L.DOMAIN_ROLES, DOM)}, {sql_case(L.DEVICE_CLASS_ROLES, 'device_class')}, {HINTS}, {sql_case(L.UNIT_ROLES, 'unit')}) END"
GATE = f"({DOM} NOT IN {sql_list(L.NEVER_DOMAINS)} AND NOT regexp_matches(lower(entity_id),{q(L.BLOCKLIST)}) AND (" + " OR ".join(f"(role={q(r)} AND {DOM} IN {sql_list(ds)})" for r, ds in L.ROLE_DOMAINS.items()) + "))"
DIRECT = (f"({DOM} IN {sql_list(L.DIRECT_DOMAINS)} AND NOT regexp_matches(lower(entity_id),{q(L.BLOCKLIST)}) AND NOT regexp_matches({OBJ},{q(L.DIAGNOSTIC_WORDS)}) AND ({DOM} IN ('switch','media_player','light') OR "
          f"(NOT regexp_matches({OBJ},{q(L.AMBIENT_WORDS)}) AND regexp_matches({OBJ},{q(L.ACTION_WORDS)}))))")
TRACKER = f"({DOM} IN ('person','device_tracker') AND NOT regexp_matches(lower(entity_id),{q(L.NOT_A_TRACKER)}))"

view("erole", f"SELECT *, {ROLE} AS role FROM entity")
view("heur", f"SELECT *, slug||repeat('_2', CAST(row_number() OVER (PARTITION BY slug ORDER BY part_id)-1 AS INTEGER)) AS name FROM (SELECT *, regexp_replace({OBJ},'_[0-9]+$','') AS slug FROM erole WHERE role IS NOT NULL AND {GATE})")
view("btok", "SELECT binding_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name||' '||entity_id),'[^a-z0-9]+'), lambda x: x<>''))) AS word FROM bind")
view("mtok", "SELECT ord, person_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(person_id||' '||name),'[^a-z0-9]+'), lambda x: x<>''))) AS word FROM member")
view("owner", "SELECT b.*, coalesce(b.person_id, o.pid) AS owner FROM bind b LEFT JOIN (SELECT binding_id, arg_min(person_id, ord) AS pid FROM btok JOIN mtok USING (word) GROUP BY binding_id) o USING (binding_id)")


@query("prd_predicate_ast", "PRD-01", """
SELECT l_orderkey, l_linenumber, (coalesce(l_quantity,0)>25 AND (coalesce(l_discount,0)>=0.05 OR NOT (coalesce(l_tax,0)==0.02))) AS hit, NOT false AS unknown_negated FROM lineitem""")
def prd_predicate_ast(spark, sf):
    li = T.load(spark, sf, "lineitem")
    ast = {"all": [{"feat": "l_quantity", "op": ">", "value": 25}, {"any": [{"feat": "l_discount", "op": ">=", "value": 0.05}, {"not": {"feat": "l_tax", "op": "==", "value": 0.02}}]}]}
    return li.select("l_orderkey", "l_linenumber", compile_predicate(ast, li.columns).alias("hit"),
                     compile_predicate({"not": {"feat": "nowhere", "op": ">", "value": 0}}, li.columns).alias("unknown_negated"))


RULES = [
    {"slug": "away", "priority": 10, "person": None, "predicate": {"all": [{"feat": "signup_person_home_last", "op": "==", "value": 0}, {"feat": "evt_count", "op": "==", "value": 0}]}},
    {"slug": "asleep", "priority": 20, "person": None, "predicate": {"all": [{"feat": "click_bed_occupied", "op": "==", "value": 1}, {"feat": "time_bucket", "op": "==", "value": 0}]}},
    {"slug": "cooking", "priority": 30, "person": None, "predicate": {"any": [{"feat": "purchase_power_max_w", "op": ">", "value": 50}, {"feat": "click_presence_frac", "op": ">", "value": 0.3}]}},
    {"slug": "movie", "priority": 40, "person": "p3", "predicate": {"all": [{"feat": "view_media_playing", "op": "==", "value": 1}]}},
]
RULE_VIEW = """
SELECT person, ws, CASE WHEN coalesce(hl,-1)=0 AND coalesce(ec,0)=0 THEN 'away' WHEN coalesce(occ,-1)=1 AND ((ws%1440)//60<5 OR (ws%1440)//60>=22) THEN 'asleep' WHEN coalesce(mw,0)>50 OR coalesce(fr,0)>0.3 THEN 'cooking' WHEN person='p3' AND coalesce(pl,0)=1 THEN 'movie' ELSE 'home' END AS label,
 CASE WHEN coalesce(hl,-1)=0 AND coalesce(ec,0)=0 THEN 'signup_person_home_last == 0  AND  evt_count == 0' WHEN coalesce(occ,-1)=1 AND ((ws%1440)//60<5 OR (ws%1440)//60>=22) THEN 'click_bed_occupied == 1  AND  time_bucket == 0' WHEN coalesce(mw,0)>50 OR coalesce(fr,0)>0.3 THEN '(purchase_power_max_w > 50  OR  click_presence_frac > 0.3)' WHEN person='p3' AND coalesce(pl,0)=1 THEN 'view_media_playing == 1' END AS basis
FROM grid LEFT JOIN (SELECT person, ws, CAST(max(num)>1.5 AS INT) AS occ FROM densewin WHERE binding='click_bed' GROUP BY ALL) USING (person, ws)
 LEFT JOIN (SELECT person, ws, max(num) AS mw FROM densewin WHERE binding='purchase_power' GROUP BY ALL) USING (person, ws) LEFT JOIN (SELECT person, ws, CAST(arg_max(str,m)='home' AS INT) AS hl FROM densewin WHERE binding='signup_person' GROUP BY ALL) USING (person, ws)
 LEFT JOIN (SELECT person, minute-minute%30 AS ws, count(*) AS ec FROM dchg GROUP BY ALL) USING (person, ws) LEFT JOIN (SELECT person, ws, avg(CAST(num>0 AS DOUBLE)) AS fr FROM densewin WHERE binding='click_presence' GROUP BY ALL) USING (person, ws)
 LEFT JOIN (SELECT person, ws, max(CAST(str='playing' AS INT)) AS pl FROM densewin WHERE binding='view_media' GROUP BY ALL) USING (person, ws)"""
view("rulelab", RULE_VIEW)


def rule_labels(spark, sf):
    f = feature_table(spark, sf)
    label, basis = rule_columns(RULES, f.columns, F.col("person"))
    return f.withColumns({"label": label, "basis": basis})


@query("prd_rule_labels", "PRD-03", "SELECT person, ws AS window_start, label, basis FROM rulelab")
def prd_rule_labels(spark, sf):
    return rule_labels(spark, sf).select("person", "window_start", "label", "basis")


@query("flagship_minutes_per_activity", "PRD-03 AGG-37 SUM-01", "SELECT person, label AS state, count(*)*30.0::DOUBLE AS minutes FROM rulelab GROUP BY ALL")
def flagship(spark, sf):
    return rule_labels(spark, sf).groupBy("person", F.col("label").alias("state")).agg((F.count("*") * 30.0).alias("minutes"))


NIGHT = '{"any": [{"feat": "hour_of_day", "op": ">=", "value": 22}, {"feat": "hour_of_day", "op": "<", "value": 7}]}'


@query("prd_starter_rules", "PRD-05", f"""
WITH b AS (SELECT *, lower(coalesce(room,name)) AS place FROM bind WHERE enabled), pw AS (SELECT arg_min(name, binding_id) AS pn FROM b WHERE role='power' AND regexp_matches(place,'kitchen|oven|stove|cook')), pr AS (SELECT arg_min(name, binding_id) AS rn FROM b WHERE role='presence' AND regexp_matches(place,'living|sofa|couch|tv'))
SELECT 'away' AS slug, person_id, CAST(10 AS INTEGER) AS priority, '{{"all": [{{"feat": "'||name||'_home_last", "op": "==", "value": 0}}]}}' AS predicate FROM b WHERE role='person' AND {TRACKER}
UNION ALL SELECT 'sleeping', person_id, 20, '{{"all": [{{"feat": "'||name||'_occupied", "op": "==", "value": 1}}, {NIGHT}]}}' FROM b WHERE role='bed'
UNION ALL SELECT 'cooking', NULL, 30, '{{"all": [{{"feat": "'||name||'_frac", "op": ">", "value": 0.3}}, {{"feat": "'||pn||'_on", "op": "==", "value": 1}}]}}' FROM b, pw WHERE role='presence' AND place LIKE '%kitchen%'
UNION ALL SELECT 'movie', NULL, 40, '{{"all": [{{"feat": "'||name||'_playing", "op": "==", "value": 1}}, {{"feat": "'||rn||'_frac", "op": ">", "value": 0.2}}]}}' FROM b, pr WHERE role='media'""")
def prd_starter_rules(spark, sf):
    acts = spark.createDataFrame([(s,) for s in ("away", "sleeping", "cooking", "movie", "eating")], "slug string")
    return M.starter_rules(T.bindings(spark, sf), acts)


view("sig", """
SELECT l_suppkey, feature, round((avg(value)-any_value(gm))/any_value(gs),2) AS z FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS gm, stddev_samp(value) OVER (PARTITION BY feature) AS gs FROM (UNPIVOT (SELECT l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)) GROUP BY l_suppkey, feature""")


def signatures(spark, sf, k=6):
    li = T.load(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = X.unpivot(li, ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return K.signature(long, ["l_suppkey"], k)


@query("top_signature_features", "TOP-01", """SELECT * FROM (SELECT l_suppkey, feature, z, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(z) DESC, feature) AS INTEGER) AS rank FROM sig) WHERE rank<=3""")
def top_signature_features(spark, sf):
    return signatures(spark, sf, 3)


@query("prd_draft_rule", "PRD-06", """
SELECT l_suppkey, '{"all":['||coalesce(string_agg('{"feat":"'||feature||'","op":">","value":0.5}', ',' ORDER BY rank) FILTER (WHERE z>0),'')||']}' AS predicate FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(z) DESC, feature) AS rank FROM sig) WHERE rank<=3 GROUP BY l_suppkey""")
def prd_draft_rule(spark, sf):
    s = signatures(spark, sf, 6)
    arr = s.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "z"))).alias("sig"))
    return arr.select("l_suppkey", M.draft_rule(F.col("sig")).alias("predicate"))


@query("prd_person_scope", "PRD-07", """
SELECT m.home, m.person_id, b.name FROM (SELECT *, ord%100 AS home FROM member) m JOIN (SELECT *, binding_id%100 AS home FROM bind WHERE enabled) b ON b.home=m.home WHERE b.person_id IS NULL OR b.person_id=m.person_id""")
def prd_person_scope(spark, sf):
    b = T.bindings(spark, sf).withColumn("home", F.col("binding_id") % 100)
    return M.person_scope(b, T.persons(spark, sf).withColumn("home", F.col("ord") % 100))


@query("prd_binding_owner", "PRD-08", "SELECT binding_id, name, owner FROM owner")
def prd_binding_owner(spark, sf):
    return M.binding_owner(T.bindings(spark, sf), T.persons(spark, sf)).select("binding_id", "name", "owner")


@query("prd_foreign_personal", "PRD-09", """
SELECT pid AS person_id, name AS binding, v FROM (SELECT l_orderkey, 'p'||(l_suppkey%8) AS pid, l_partkey, l_quantity AS v FROM lineitem) JOIN owner ON binding_id=l_partkey WHERE NOT (role IN ('alarm_time','focus','steps','battery') AND owner IS NOT NULL AND owner<>pid)""")
def prd_foreign_personal(spark, sf):
    owned = M.binding_owner(T.bindings(spark, sf), T.persons(spark, sf))
    li = T.load(spark, sf, "lineitem").select(F.concat(F.lit("p"), (F.col("l_suppkey") % 8).cast("string")).alias("person_id"), F.col("l_partkey").alias("binding_id"), F.col("l_quantity").alias("v"))
    long = li.join(owned.select("binding_id", F.col("name").alias("binding")), "binding_id").drop("binding_id")
    return M.without_foreign_personal(long, owned).select("person_id", "binding", "v")


@query("prd_usable_columns", "PRD-10 PRD-11", """
SELECT person, ws AS window_start, round(coalesce(v,-1),6) AS click_bed_mean FROM grid LEFT JOIN (SELECT person, ws, avg(num) AS v FROM densewin WHERE binding='click_bed' GROUP BY ALL) USING (person, ws)""")
def prd_usable_columns(spark, sf):
    f = feature_table(spark, sf)
    others = sorted({c for c in f.columns if not c.startswith("click_bed")} - {"person", "window_start"})
    kept = M.usable_columns(f.columns, ["purchase_power", "signup_door"], [*others, "click_bed_max", "click_bed_occupied", "click_bed_missing"])
    return f.select(*kept).withColumn("click_bed_mean", r6("click_bed_mean"))


TRANS = ["window_mean", "any_active", "co_occurrence_and", "window_slope", "absence_and", "counter_rate", "nope"]
view("defs", f"""
SELECT p_partkey//20 AS spec_id, p_partkey AS ord, CASE WHEN p_size%10=0 THEN 'Bad Name' ELSE 'f'||(p_partkey%17) END AS name, {sql_list(TRANS).replace('(','[').replace(')',']')}[p_size%7+1] AS transform,
 CASE WHEN p_size%7 IN (2,4) THEN ['f'||((p_partkey+14)%17)] ELSE ['e'||(p_partkey%9)] END AS inputs, CASE WHEN p_size%13=0 THEN '{{"x": 1}}' WHEN p_size%7=2 THEN '{{"threshold": 0.5}}' ELSE '{{}}' END AS params, p_size*40-10 AS window_min, 'T'||(p_partkey%4+1) AS tier FROM part""")


def definitions(spark, sf):
    p = T.load(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.floor(key / 20).alias("spec_id"), key.alias("ord"), F.when(size % 10 == 0, "Bad Name").otherwise(F.concat(F.lit("f"), (key % 17).cast("string"))).alias("name"),
        T._pick(TRANS, size % 7).alias("transform"),
        F.when((size % 7).isin(2, 4), F.array(F.concat(F.lit("f"), ((key + 14) % 17).cast("string")))).otherwise(F.array(F.concat(F.lit("e"), (key % 9).cast("string")))).alias("inputs"),
        F.when(size % 13 == 0, '{"x": 1}').when(size % 7 == 2, '{"threshold": 0.5}').otherwise("{}").alias("params"),
        (size * 40 - 10).alias("window_min"), F.concat(F.lit("T"), (key % 4 + 1).cast("string")).alias("tier"))


def selections(spark, sf):
    d = definitions(spark, sf).select("spec_id").distinct()
    n = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")
    return d.select("spec_id", n).select("spec_id", F.concat(F.lit("e"), F.col("i").cast("string")).alias("entity_id"), (F.col("i") < 7).alias("keep"), F.when(F.col("i") == 3, "unusable").otherwise("ok").alias("reliability"))


FULL_TIERS = {n: s[0] for n, s in L.TRANSFORMS.items()}


@query("prd_definition_validation", "PRD-12", """
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY ord) AS i, transform IN ('co_occurrence_and','absence_and') AS comp,
 CASE WHEN transform='nope' THEN 'transform not allowed' WHEN NOT (CASE WHEN transform='co_occurrence_and' THEN params='{"threshold": 0.5}' ELSE params='{}' END) THEN 'bad params' WHEN window_min NOT BETWEEN 1 AND 1440 THEN 'window out of range'
  WHEN transform IN ('co_occurrence_and','absence_and') THEN NULL WHEN inputs[1] IN ('e7','e8') THEN 'input not kept'
  WHEN NOT CASE transform WHEN 'window_mean' THEN tier='T3' WHEN 'any_active' THEN tier='T1' WHEN 'window_slope' THEN tier='T3' WHEN 'counter_rate' THEN tier='T4' END THEN 'tier mismatch' WHEN inputs[1]='e3' THEN 'inputs unusable' END AS late FROM defs),
r AS (SELECT spec_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST(0 AS BIGINT) AS ord, '' AS name, '' AS reason FROM (SELECT DISTINCT spec_id FROM defs)
 UNION ALL SELECT spec_id, i, CASE WHEN reason='ok' THEN list_append(names, name) ELSE names END, ord, name, reason FROM (
  SELECT d.spec_id, d.i, r.names, d.ord, d.name, CASE WHEN NOT regexp_matches(d.name,'^[a-z][a-z0-9_]{0,59}$') THEN 'bad name' WHEN list_contains(r.names,d.name) THEN 'duplicate name' WHEN late IS NOT NULL THEN late WHEN comp AND NOT list_contains(r.names,d.inputs[1]) THEN 'input not defined earlier' ELSE 'ok' END AS reason
  FROM r JOIN d ON d.spec_id=r.spec_id AND d.i=r.i+1))
SELECT spec_id, ord, name, reason='ok' AS ok, reason FROM r WHERE i>0""")
def prd_definition_validation(spark, sf):
    return M.validate_definitions(definitions(spark, sf), selections(spark, sf), "full")


@query("prd_param_check", "PRD-13", """
SELECT ord, CASE WHEN transform='nope' THEN false WHEN transform='co_occurrence_and' THEN params='{"threshold": 0.5}' ELSE params='{}' END AS ok FROM defs""")
def prd_param_check(spark, sf):
    return definitions(spark, sf).select("ord", M.params_ok(F.col("transform"), F.col("params")).alias("ok"))


@query("prd_transform_whitelist", "PRD-14", """
SELECT transform, transform IN ('window_mean','any_active','co_occurrence_and','absence_and') AS conservative, count(*) AS definitions FROM defs WHERE transform<>'nope' GROUP BY ALL""")
def prd_transform_whitelist(spark, sf):
    d = definitions(spark, sf)
    return d.join(F.broadcast(M.transform_table(spark, "full")), "transform").groupBy("transform", "conservative").agg(F.count("*").alias("definitions"))


def ents(spark, sf):
    return T.entities(spark, sf)


@query("prd_noise_filter", "PRD-15 PRD-16", f"SELECT entity_id, {DOM} IN {sql_list(L.NEVER_DOMAINS)} OR {BARRED} AS noise FROM entity")
def prd_noise_filter(spark, sf):
    return ents(spark, sf).select("entity_id", M.is_noise(F.col("entity_id"), F.col("friendly_name"), F.col("device_class")).alias("noise"))


@query("prd_bindable_gate", "PRD-17", f"SELECT entity_id, role, {GATE} AS bindable, {GATE} OR ({DOM} IN {sql_list(L.STATE_DOMAINS)} AND {DOM} NOT IN {sql_list(L.NEVER_DOMAINS)} AND NOT regexp_matches(lower(entity_id),{q(L.BLOCKLIST)})) AS with_override FROM bind")
def prd_bindable_gate(spark, sf):
    return T.bindings(spark, sf).select("entity_id", "role", M.is_bindable(F.col("entity_id"), F.col("role")).alias("bindable"), M.is_bindable(F.col("entity_id"), F.col("role"), True).alias("with_override"))


@query("prd_tracker_test", "PRD-18", f"SELECT entity_id, {TRACKER} AS tracker FROM entity")
def prd_tracker_test(spark, sf):
    return ents(spark, sf).select("entity_id", M.is_person_tracker(F.col("entity_id"), F.col("friendly_name")).alias("tracker"))


@query("prd_role_suggestion", "PRD-19", "SELECT entity_id, role FROM erole")
def prd_role_suggestion(spark, sf):
    return ents(spark, sf).select("entity_id", M.suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit")).alias("role"))


def shared_slugs(df):
    """Entity ids without their number, so that names collide."""
    return df.withColumn("entity_id", F.regexp_replace("entity_id", "_[0-9]+$", ""))


@query("prd_heuristic_bindings", "PRD-20", "SELECT part_id, role, name FROM heur")
def prd_heuristic_bindings(spark, sf):
    return M.heuristic_bindings(shared_slugs(ents(spark, sf)), "part_id").select("part_id", "role", "name")


view("dev", """
SELECT 'dev'||s_suppkey AS device_id, CASE WHEN s_suppkey%9=0 THEN 'Zigbee Bridge '||s_suppkey ELSE s_name END AS device_name, CASE WHEN s_suppkey%3=0 THEN 'M'||s_nationkey ELSE s_name END AS model, CASE WHEN s_suppkey%11=0 THEN 'service' END AS entry_type FROM supplier""")
view("integ", "SELECT DISTINCT lower(replace(p_brand,'#','_')) AS integration, CASE CAST(split_part(p_brand,'#',2) AS INT)%4 WHEN 0 THEN 'sun' WHEN 1 THEN 'zha' WHEN 2 THEN 'other' ELSE 'hue' END AS domain FROM part")
view("decided", "SELECT 'entity' AS level, entity_id AS id, 'keep' AS verdict FROM entity WHERE part_id%29=0 UNION ALL SELECT 'device', 'dev'||s_suppkey, 'skip' FROM supplier WHERE s_suppkey%13=0 UNION ALL SELECT 'integration', integration, 'keep' FROM integ WHERE integration='brand_7'")
view("relv", f"""
SELECT e.entity_id, e.device_id, e.integration, CASE WHEN de.id IS NOT NULL THEN 'keep' WHEN dd.id IS NOT NULL THEN 'skip' WHEN di.id IS NOT NULL THEN 'keep' WHEN i.domain='sun' THEN 'skip' WHEN d.device_id IS NOT NULL AND (coalesce(entry_type,'')='service' OR regexp_matches(lower(device_name||' '||coalesce(model,'')),{q(L.DEVICE_INFRA)})) THEN 'skip'
  WHEN {BARRED} THEN 'skip' WHEN role IS NOT NULL THEN 'keep' ELSE 'unsure' END AS verdict,
 CASE WHEN de.id IS NOT NULL THEN 'entity' WHEN dd.id IS NOT NULL THEN 'device' WHEN di.id IS NOT NULL THEN 'integration' WHEN i.domain='sun' THEN 'integration' WHEN d.device_id IS NOT NULL AND (coalesce(entry_type,'')='service' OR regexp_matches(lower(device_name||' '||coalesce(model,'')),{q(L.DEVICE_INFRA)})) THEN 'device'
  WHEN {BARRED} THEN 'entity' WHEN role IS NOT NULL THEN 'entity' WHEN i.domain IN ('zha','hue') THEN 'device' ELSE 'entity' END AS level
FROM erole e LEFT JOIN dev d USING (device_id) LEFT JOIN integ i USING (integration) LEFT JOIN decided de ON de.level='entity' AND de.id=e.entity_id LEFT JOIN decided dd ON dd.level='device' AND dd.id=e.device_id LEFT JOIN decided di ON di.level='integration' AND di.id=e.integration""")


def devices(spark, sf):
    s = T.load(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("dev"), k.cast("string")).alias("device_id"), F.when(k % 9 == 0, F.concat(F.lit("Zigbee Bridge "), k.cast("string"))).otherwise(F.col("s_name")).alias("device_name"),
                    F.when(k % 3 == 0, F.concat(F.lit("M"), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_name")).alias("model"), F.when(k % 11 == 0, "service").alias("entry_type"))


def integrations(spark, sf):
    n = F.element_at(F.split("p_brand", "#"), 2).cast("int") % 4
    return T.load(spark, sf, "part").select(F.lower(F.regexp_replace("p_brand", "#", "_")).alias("integration"), T._pick(["sun", "zha", "other", "hue"], n).alias("domain")).distinct()


def verdicts(spark, sf):
    e, d, i = ents(spark, sf), devices(spark, sf), integrations(spark, sf)
    dec = e.where("part_id % 29 = 0").select(F.lit("entity").alias("level"), F.col("entity_id").alias("id"), F.lit("keep").alias("verdict"))
    dec = dec.union(T.load(spark, sf, "supplier").where("s_suppkey % 13 = 0").select(F.lit("device"), F.concat(F.lit("dev"), F.col("s_suppkey").cast("string")), F.lit("skip")))
    dec = dec.union(i.where("integration = 'brand_7'").select(F.lit("integration"), "integration", F.lit("keep")))
    return M.relevance(e, d, i, dec)


@query("prd_relevance_cascade", "PRD-21", "SELECT entity_id, verdict, level FROM relv")
def prd_relevance_cascade(spark, sf):
    return verdicts(spark, sf).select("entity_id", "verdict", "level")


@query("sum_hierarchy_rollup", "SUM-45", """
SELECT integration, device_id, count(*) AS entities, count(*) FILTER (WHERE verdict='keep') AS kept, count(*) FILTER (WHERE verdict='skip') AS skipped, count(*) FILTER (WHERE verdict='unsure') AS unsure FROM relv GROUP BY ROLLUP (integration, device_id)""")
def sum_hierarchy_rollup(spark, sf):
    return M.hierarchy_rollup(verdicts(spark, sf))


CAT = f"coalesce({sql_case(L.ROLE_CATEGORY, 'role')},'other')"


@query("prd_category_triage", "PRD-22", f"""
SELECT category, count(*) AS entities, bool_or(category IN {sql_list(L.RELEVANT_CATEGORIES)}) AS relevant, count(*) FILTER (WHERE (category IN {sql_list(L.RELEVANT_CATEGORIES)} AND category<>'climate') OR category='diagnostics' OR {TRACKER}) AS kept FROM (SELECT *, {CAT} AS category FROM erole) GROUP BY category""")
def prd_category_triage(spark, sf):
    e = ents(spark, sf)
    buckets, kept = M.triage(e, ["climate"], ["diagnostics"])
    role = M.suggest_role(F.col("entity_id"), F.col("friendly_name"), F.col("device_class"), F.col("unit"))
    cat = e.select("entity_id", F.coalesce(M.lookup(L.ROLE_CATEGORY, role), F.lit("other")).alias("category")).join(kept, "entity_id", "left_semi").groupBy("category").agg(F.count("*").alias("kept"))
    return buckets.join(cat, "category", "left").fillna(0, subset=["kept"])


view("alias", "SELECT lower(n_name) AS src, lower(r_name) AS dst FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%3=0")
view("clabel", "SELECT c_custkey, lower(n_name) AS label FROM customer JOIN nation ON c_nationkey=n_nationkey")


def aliases(spark, sf):
    n, r = T.load(spark, sf, "nation"), T.load(spark, sf, "region")
    return n.where("n_nationkey % 3 = 0").join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name").alias("src"), F.lower("r_name").alias("dst"))


def customer_labels(spark, sf):
    c, n = T.load(spark, sf, "customer"), T.load(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.lower("n_name").alias("label"))


@query("prd_alias_labels", "PRD-23", "SELECT c_custkey, coalesce(dst,label) AS label FROM clabel LEFT JOIN alias ON src=label")
def prd_alias_labels(spark, sf):
    return M.apply_alias(customer_labels(spark, sf), aliases(spark, sf), ["label"])


@query("prd_alias_probabilities", "PRD-23", """
SELECT event_id, printf('cooking=%.6f,relax=%.6f', a, b+c) AS probs FROM pred5""")
def prd_alias_probabilities(spark, sf):
    p = T.prediction_rows(spark, sf).select("event_id", "probs")
    al = spark.createDataFrame([("movie", "relax"), ("home", "relax")], "src string, dst string")
    return M.alias_probabilities(p, al, ["event_id"]).select("event_id", map_text("probs").alias("probs"))


@query("prd_activity_merge", "PRD-24", """
SELECT src, CASE WHEN dst='asia' THEN 'europe' ELSE dst END AS dst FROM alias WHERE src<>CASE WHEN dst='asia' THEN 'europe' ELSE dst END UNION SELECT 'asia','europe'""")
def prd_activity_merge(spark, sf):
    return M.merge_activity(aliases(spark, sf), F.lit("asia"), F.lit("europe"))


@query("prd_room_canonical", "PRD-25 PRD-26", """
SELECT name, CASE regexp_replace(lower(room),'[^a-z0-9]','','g') WHEN 'livingroom' THEN 'Living Room' WHEN 'kitchen' THEN 'Kitchen' WHEN 'bedroom' THEN 'Bed Room' WHEN 'hall' THEN 'Hall' END AS room FROM bind""")
def prd_room_canonical(spark, sf):
    b = T.bindings(spark, sf)
    canon = M.canonical_rooms(b)
    canon = canon.withColumn("display", F.when(F.col("key") == "livingroom", "Living Room").otherwise(F.col("display")))
    return M.apply_rooms(b, canon).select("name", "room")


@query("prd_room_displays", "PRD-25", """
WITH s AS (SELECT DISTINCT room, regexp_replace(lower(room),'[^a-z0-9]','','g') AS key, len(regexp_split_to_array(room,'[^a-zA-Z0-9]+')) AS n FROM bind WHERE room IS NOT NULL)
SELECT key, array_to_string(list_transform(list_filter(regexp_split_to_array(b,'[^a-zA-Z0-9]+'), lambda x: x<>''), lambda x: upper(x[1])||x[2:]),' ') AS display FROM (SELECT key, arg_max(room, n*1000000+length(room)*1000+CASE WHEN room=lower(room) THEN 1 ELSE 0 END) AS b FROM s GROUP BY key)""")
def prd_room_displays(spark, sf):
    return M.canonical_rooms(T.bindings(spark, sf))


@query("prd_looks_direct", "PRD-27", f"SELECT entity_id, {DIRECT} AS direct FROM entity")
def prd_looks_direct(spark, sf):
    return ents(spark, sf).select("entity_id", M.looks_direct(F.col("entity_id")).alias("direct"))


@query("prd_coarse_labels", "PRD-28", "SELECT c_custkey, lower(r_name) AS coarse FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def prd_coarse_labels(spark, sf):
    return M.to_coarse(customer_labels(spark, sf), T.activities(spark, sf)).select("c_custkey", "coarse")


@query("prd_fine_labels", "PRD-29", "SELECT c_custkey, CASE WHEN r_name='ASIA' THEN label END AS fine FROM clabel JOIN customer USING (c_custkey) JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def prd_fine_labels(spark, sf):
    return M.to_fine(customer_labels(spark, sf), T.activities(spark, sf), F.lit("asia")).select("c_custkey", "fine")


SYN = ["Alex out of the house", "Sleeping", "at home", "In Bed!", "Read a book", "away", "gone fishing", "nation 3", "Nation-7 "]
RES_SQL = "CASE " + " ".join(
    f"WHEN cut IN {sql_list(w)} OR raw IN {sql_list(w)} OR " + (f"len(list_intersect(string_split(cut,' '),{sql_list(L.RESERVED_TOKENS[s]).replace('(','[').replace(')',']')}))>0 OR " if L.RESERVED_TOKENS[s] else "") + " OR ".join(f"contains(cut,{q(x)})" for x in w if ' ' in x) + f" THEN {q(s)}"
    for s, w in L.RESERVED_SYNONYMS.items()) + " END"


@query("prd_synonym_canonical", "PRD-30", f"""
SELECT event_id, name, coalesce(CASE WHEN regexp_matches(cut,'^nation [0-9]+$') AND CAST(split_part(cut,' ',2) AS INT)<25 THEN replace(cut,' ','_') END, CASE WHEN {RES_SQL} IN ('away','asleep','home') THEN {RES_SQL} END) AS duplicate_of FROM (
 SELECT *, trim(regexp_replace(regexp_replace(' '||raw||' ','( alex )',' ','g'),' +',' ','g')) AS cut FROM (SELECT event_id, name, trim(regexp_replace(lower(name),'[^a-z0-9]+',' ','g')) AS raw FROM (SELECT event_id, {sql_list(SYN).replace('(','[').replace(')',']')}[k%9+1] AS name FROM ev)))""")
def prd_synonym_canonical(spark, sf):
    names = T.events(spark, sf).select("event_id", T._pick(SYN, F.col("k") % 9).alias("name"))
    acts = T.activities(spark, sf).select("slug")
    reserved = spark.createDataFrame([("away",), ("asleep",), ("home",)], "slug string")
    return M.canonical_activity(names, acts.union(reserved), ["alex"])


view("fcol", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS weight, CASE WHEN l_linenumber%4=3 THEN 'mob_room_entropy' WHEN l_linenumber%4=2 THEN 'hour_of_day' ELSE b.name||CASE l_linenumber%2 WHEN 0 THEN '_max_w' ELSE '_on_frac_lag1' END END AS feature FROM lineitem JOIN bind b ON b.binding_id=l_partkey")


def feature_weights(spark, sf):
    b = T.bindings(spark, sf).select(F.col("binding_id").alias("l_partkey"), "name")
    li = T.load(spark, sf, "lineitem").join(b, "l_partkey")
    n = F.col("l_linenumber")
    feature = F.when(n % 4 == 3, "mob_room_entropy").when(n % 4 == 2, "hour_of_day").otherwise(F.concat("name", F.when(n % 2 == 0, "_max_w").otherwise("_on_frac_lag1")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("weight"), feature.alias("feature"))


TIER_SQL = f"CASE WHEN feature LIKE 'mob%' THEN 2 WHEN feature='hour_of_day' THEN 0 ELSE greatest(1,least(3,coalesce(tier_option, {sql_case(L.ROLE_TIER, 'role')}))) END"


def tiered(spark, sf):
    names = T.bindings(spark, sf).select("name", "role", M.binding_tier(F.col("role"), F.col("tier_option")).alias("tier"))
    m = M.match_binding(feature_weights(spark, sf), names)
    return m.withColumn("tier", M.column_tier(F.col("tier"), F.col("feature")))


@query("prd_column_tier", "PRD-31 PRD-32 JON-14", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber%4 IN (0,1) THEN name END AS name, CAST({TIER_SQL} AS INTEGER) AS tier, CASE WHEN l_linenumber%4=0 THEN 'max_w' WHEN l_linenumber%4=1 THEN 'on_frac' END AS suffix FROM fcol JOIN bind ON binding_id=l_partkey""")
def prd_column_tier(spark, sf):
    return tiered(spark, sf).select("l_orderkey", "l_linenumber", "name", "tier", "suffix")


@query("prd_strip_suffix", "PRD-32", "SELECT DISTINCT name||'_home_frac' AS feature, name AS binding FROM bind")
def prd_strip_suffix(spark, sf):
    f = T.bindings(spark, sf).select(F.concat("name", F.lit("_home_frac")).alias("feature")).distinct()
    return f.select("feature", M.strip_suffix(F.col("feature")).alias("binding"))


PHRASE_SQL = "CASE role||'|'||suffix " + " ".join(f"WHEN {q(r + '|' + s)} THEN CASE WHEN up THEN {q(a)} ELSE {q(b)} END" for (r, s), (a, b) in L.PHRASES.items()) + " END"


@query("prd_feature_phrases", "PRD-33", f"""
SELECT binding_id, suffix, up, upper(t[1])||t[2:] AS label FROM (SELECT *, CASE WHEN suffix='missing' THEN CASE WHEN up THEN 'no reading from '||place ELSE place||' reporting' END ELSE coalesce(replace(replace(replace({PHRASE_SQL},'{{place}}',place),'{{who}}',who),'{{metric}}','level'), place||' '||suffix||' '||CASE WHEN up THEN 'higher' ELSE 'lower' END) END AS t FROM (
 SELECT binding_id, role, unnest(['delta','mean','missing']) AS suffix, binding_id%2=0 AS up, coalesce(room,name) AS place, coalesce(person_id,'someone') AS who FROM bind))""")
def prd_feature_phrases(spark, sf):
    b = T.bindings(spark, sf).select("binding_id", "role", F.explode(F.array(F.lit("delta"), F.lit("mean"), F.lit("missing"))).alias("suffix"), (F.col("binding_id") % 2 == 0).alias("up"),
                                     F.coalesce("room", "name").alias("place"), F.coalesce("person_id", F.lit("someone")).alias("who"))
    return b.select("binding_id", "suffix", "up", M.phrase(F.col("role"), F.col("suffix"), F.col("up"), F.col("place"), F.col("who"), F.lit("level")).alias("label"))


@query("prd_prune_silent", "PRD-34", "SELECT entity_id, enabled AND NOT (role<>'person' AND binding_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>45)) AS enabled FROM bind")
def prd_prune_silent(spark, sf):
    b = T.bindings(spark, sf)
    n = T.load(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("binding_id")).agg(F.count("*").alias("n")).join(b.select("binding_id", "entity_id"), "binding_id").select("entity_id", "n")
    return M.prune_silent(b, n).select("entity_id", "enabled")


@query("prd_hierarchy_backfill", "PRD-35", "SELECT id, slug, coalesce(CASE WHEN parent_id IS NULL AND slug IN ('asia','europe') THEN (SELECT min(id) FROM activity WHERE slug='america') ELSE parent_id END,-1) AS parent_id FROM activity")
def prd_hierarchy_backfill(spark, sf):
    return M.backfill_hierarchy(T.activities(spark, sf), "america", ["asia", "europe"]).fillna(-1, subset=["parent_id"])


@query("prd_activity_delete", "PRD-36", "SELECT label AS slug, max(CASE WHEN parent_id=(SELECT id FROM activity WHERE slug='asia') THEN -1 ELSE parent_id END) AS parent_id, count(*) FILTER (WHERE true) AS rules FROM clabel JOIN activity ON slug=label WHERE slug<>'asia' GROUP BY label")
def prd_activity_delete(spark, sf):
    rules = customer_labels(spark, sf).select(F.col("label").alias("slug"), F.lit(True).alias("enabled"))
    kept, off = M.delete_activity(T.activities(spark, sf), rules, "asia")
    return off.where("enabled").groupBy("slug").agg(F.count("*").alias("rules")).join(kept.select("slug", F.coalesce("parent_id", F.lit(-1)).alias("parent_id")), "slug")


@query("prd_binding_cleanup", "PRD-37", f"""
SELECT count(*) FILTER (WHERE role<>'person' AND NOT {GATE}) AS removed, count(*) FILTER (WHERE NOT (role<>'person' AND NOT {GATE}) AND person_id IS NULL AND owner IS NOT NULL) AS owned, count(*) FILTER (WHERE NOT (role<>'person' AND NOT {GATE})) AS kept FROM owner""")
def prd_binding_cleanup(spark, sf):
    return M.clean_bindings(T.bindings(spark, sf), T.persons(spark, sf))


# --- joins over metadata -------------------------------------------------------------------------


def half_bound(spark, sf):
    return T.bindings(spark, sf).where("binding_id % 2 = 0")


@query("jon_device_siblings", "JON-12", f"""
SELECT b.name, e.entity_id AS candidate FROM bind b JOIN entity e USING (device_id) WHERE b.binding_id%2=0 AND b.role IN ('env','battery') AND e.part_id%2=1 AND {DIRECT.replace('entity_id','e.entity_id')}""")
def jon_device_siblings(spark, sf):
    b = half_bound(spark, sf)
    return M.device_siblings(b.where("role in ('env', 'battery')"), ents(spark, sf), b)


@query("jon_device_label", "JON-13", """
SELECT entity_id, CASE WHEN device_name IS NOT NULL AND model IS NOT NULL AND NOT contains(lower(device_name), lower(model)) THEN device_name||' — '||model ELSE coalesce(device_name, model) END AS label FROM entity LEFT JOIN dev USING (device_id)""")
def jon_device_label(spark, sf):
    return M.device_label(ents(spark, sf), devices(spark, sf)).select("entity_id", "label")


view("fbm", f"""
SELECT person_id, arg_min(entity_id, part_id) AS entity_id FROM mtok JOIN (SELECT part_id, entity_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(entity_id||' '||friendly_name),'[^a-z0-9]+'), lambda x: x<>''))) AS word FROM entity WHERE {TRACKER} AND NOT disabled) USING (word) GROUP BY person_id""")


@query("jon_member_tracker_match", "JON-15", "SELECT person_id, entity_id FROM fbm")
def jon_member_tracker_match(spark, sf):
    return M.match_members(T.persons(spark, sf), ents(spark, sf))


@query("jon_member_linking", "JON-16", f"""
WITH x AS (SELECT 'c'||part_id AS person_id, entity_id FROM entity WHERE part_id%9=0), y AS (SELECT 'c'||part_id AS person_id, entity_id FROM entity WHERE part_id%4=0)
SELECT person_id, entity_id, source FROM (SELECT m.person_id, coalesce(x.entity_id,y.entity_id,f.entity_id) AS entity_id, CASE WHEN x.entity_id IS NOT NULL THEN 'explicit' WHEN y.entity_id IS NOT NULL THEN 'proposed' ELSE 'fallback' END AS source FROM member m LEFT JOIN x USING (person_id) LEFT JOIN y USING (person_id) LEFT JOIN fbm f USING (person_id)) WHERE entity_id IS NOT NULL AND {TRACKER}""")
def jon_member_linking(spark, sf):
    e, p = ents(spark, sf), T.persons(spark, sf)
    at = lambda cond: e.where(cond).select(F.concat(F.lit("c"), F.col("part_id").cast("string")).alias("person_id"), "entity_id")
    return M.link_members(p, at("part_id % 9 = 0"), at("part_id % 4 = 0"), M.match_members(p, e))


@query("jon_person_binding_repair", "JON-17", f"""
SELECT l_orderkey AS rule_id, NOT bool_or(b.role='person' AND NOT {TRACKER}) AS enabled FROM lineitem JOIN bind b ON b.binding_id=l_partkey GROUP BY l_orderkey""")
def jon_person_binding_repair(spark, sf):
    b = T.bindings(spark, sf)
    feats = T.load(spark, sf, "lineitem").join(b.select(F.col("binding_id").alias("l_partkey"), "name"), "l_partkey")
    rules = feats.groupBy(F.col("l_orderkey").alias("rule_id")).agg(F.collect_set(F.concat("name", F.lit("_home_last"))).alias("feats")).withColumn("enabled", F.lit(True))
    return M.repair_person_bindings(b, rules)[1].select("rule_id", "enabled")


KEY = "regexp_replace(lower({}),'[^a-z0-9]','','g')"


@query("jon_inventory_sync", "JON-18", f"""
WITH b AS (SELECT entity_id, CASE WHEN binding_id%10=0 THEN 'Attic' ELSE room END AS room FROM bind WHERE binding_id%2=0), p AS (SELECT entity_id FROM entity WHERE part_id%3=0),
u AS (SELECT * FROM erole WHERE NOT disabled)
SELECT entity_id, CASE WHEN u.entity_id IS NOT NULL AND b.entity_id IS NOT NULL AND u.area IS NOT NULL AND {KEY.format('u.area')}<>{KEY.format("coalesce(b.room,'')")} THEN 'room_update' WHEN b.entity_id IS NOT NULL THEN 'bound' WHEN u.role IS NOT NULL AND {GATE.replace('entity_id','u.entity_id').replace('role=','u.role=')} THEN 'stage' WHEN u.entity_id IS NOT NULL AND p.entity_id IS NOT NULL THEN 'keep_pending' WHEN p.entity_id IS NOT NULL THEN 'drop_pending' ELSE 'leave' END AS action
FROM u FULL JOIN b USING (entity_id) FULL JOIN p USING (entity_id)""")
def jon_inventory_sync(spark, sf):
    b = half_bound(spark, sf).withColumn("room", F.when(F.col("binding_id") % 10 == 0, "Attic").otherwise(F.col("room")))
    e = ents(spark, sf)
    return M.sync_inventory(e, b, e.where("part_id % 3 = 0"))


view("pend", "SELECT entity_id, role AS suggested_role, regexp_replace(name,'_[0-9]+$','') AS suggested_name, binding_id FROM bind WHERE binding_id%3=0")


def pending(spark, sf):
    return T.bindings(spark, sf).where("binding_id % 3 = 0").select("entity_id", F.col("role").alias("suggested_role"), F.regexp_replace("name", "_[0-9]+$", "").alias("suggested_name"), "binding_id")


@query("jon_approve_pending", "JON-19", """
SELECT entity_id, suggested_role, CASE WHEN n=1 THEN suggested_name ELSE suggested_name||'_'||n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY suggested_name ORDER BY entity_id) + CASE WHEN suggested_name IN (SELECT regexp_replace(name,'_[0-9]+$','') FROM bind WHERE binding_id%50=0) THEN 1 ELSE 0 END AS n FROM pend WHERE binding_id%2=1)""")
def jon_approve_pending(spark, sf):
    p = pending(spark, sf)
    used = T.bindings(spark, sf).where("binding_id % 50 = 0").select(F.regexp_replace("name", "_[0-9]+$", "").alias("name"))
    return M.approve_pending(p, p.where("binding_id % 2 = 1"), used)


@query("jon_dismiss_pending", "JON-19", "SELECT entity_id, suggested_name FROM pend WHERE binding_id%2=0")
def jon_dismiss_pending(spark, sf):
    p = pending(spark, sf)
    return M.dismiss_pending(p, p.where("binding_id % 2 = 1")).select("entity_id", "suggested_name")


@query("jon_new_devices", "JON-20 SET-03", "SELECT device_id, device_name FROM dev WHERE CAST(substr(device_id,4) AS BIGINT)%5<>0 AND device_id IN (SELECT device_id FROM relv WHERE verdict='keep')")
def jon_new_devices(spark, sf):
    d = devices(spark, sf)
    seen = d.where(F.substring("device_id", 4, 20).cast("long") % 5 == 0)
    return M.new_devices(d, seen, verdicts(spark, sf)).select("device_id", "device_name")


@query("jon_core_roles", "JON-24", "SELECT part_id, role, name FROM heur WHERE role IN ('person','presence','bed') AND part_id%2=1")
def jon_core_roles(spark, sf):
    e = ents(spark, sf)
    got = M.heuristic_bindings(shared_slugs(e), "part_id").where(F.col("role").isin("person", "presence", "bed"))
    bound = half_bound(spark, sf).select(F.col("binding_id").alias("part_id"))
    return got.join(bound, "part_id", "left_anti").select("part_id", "role", "name")


@query("jon_unassigned_entities", "JON-25", f"""
SELECT entity_id, role, CAST(CAST(role IS NOT NULL AS INT)*4+CAST(device_class IS NOT NULL AS INT)*2+CAST(area IS NOT NULL AS INT) AS INTEGER) AS score FROM erole WHERE NOT disabled AND NOT {BARRED} AND part_id%2=1""")
def jon_unassigned_entities(spark, sf):
    return M.unassigned(ents(spark, sf), half_bound(spark, sf))


# --- evidence over matched columns ------------------------------------------------------------------


@query("sta_evidence_profile", "STA-19", f"""
SELECT l_orderkey, CASE tier WHEN 0 THEN 'prior' WHEN 1 THEN 'direct' WHEN 2 THEN 'behavioral' ELSE 'ambient' END AS tier, round(sum(weight)/sum(sum(weight)) OVER (PARTITION BY l_orderkey),4) AS share FROM (SELECT l_orderkey, weight, {TIER_SQL} AS tier FROM fcol JOIN bind ON binding_id=l_partkey) GROUP BY l_orderkey, tier""")
def sta_evidence_profile(spark, sf):
    return X.evidence_profile(tiered(spark, sf), ["l_orderkey"], F.col("tier"))


@query("sta_binding_reliance", "STA-20", """
SELECT name, role, round(sum(weight)/(SELECT sum(weight) FROM fcol),8) AS share FROM fcol JOIN bind ON binding_id=l_partkey WHERE l_linenumber%4 IN (0,1) GROUP BY name, role""")
def sta_binding_reliance(spark, sf):
    return K.reliance(tiered(spark, sf)).withColumn("share", F.round("share", 8))


@query("sta_binding_audit", "STA-20", f"""
WITH r AS (SELECT name, sum(weight)/(SELECT sum(weight) FROM fcol) AS share FROM fcol JOIN bind ON binding_id=l_partkey WHERE l_linenumber%4 IN (0,1) GROUP BY name),
a AS (SELECT b.*, share FROM bind b JOIN r USING (name) WHERE enabled AND NOT model_excluded AND binding_id%2=0 AND share>=0.0001 AND greatest(1,least(3,coalesce(tier_option, {sql_case(L.ROLE_TIER, 'role')})))=3),
act AS (SELECT DISTINCT device_id FROM entity WHERE {DOM} IN {sql_list(L.ACTUATOR_DOMAINS)})
SELECT device_id, count(*) AS bindings, round(sum(share),8) AS share, any_value(c.n) AS candidates FROM a SEMI JOIN act USING (device_id) JOIN (SELECT device_id, count(*) AS n FROM entity WHERE part_id%2=1 AND {DIRECT} GROUP BY device_id) c USING (device_id) GROUP BY device_id""")
def sta_binding_audit(spark, sf):
    b, e = T.bindings(spark, sf), ents(spark, sf)
    rel = K.reliance(tiered(spark, sf)).select("name", "share")
    half = b.where("binding_id % 2 = 0")
    return K.audit(half, b.where("binding_id % 2 = 0"), e, rel, 0.0001).withColumn("share", F.round("share", 8))
