"""The shared table readings of `sources.tables`, written again as SQL for the checks."""

from .catalog import view

view("ev", """
SELECT event_id, ts, epoch_us(ts)//60000000 AS minute, 'p'||(user_id%8) AS person, 'h'||((user_id%8)//2) AS home,
       event_type, value, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events""")

view("reading", """
SELECT home, person, ts, minute, event_id AS write_seq, event_type||'_'||role AS binding, role, room, num, str FROM (
 SELECT *, 'presence' AS role, 'kitchen' AS room, CAST(value>30 AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str FROM ev WHERE event_type='click'
 UNION ALL SELECT *, 'bed','bedroom', k/50.0::DOUBLE, NULL FROM ev WHERE event_type='click'
 UNION ALL SELECT *, 'presence','living', CAST(value>40 AS DOUBLE), NULL FROM ev WHERE event_type='view'
 UNION ALL SELECT *, 'media','living', NULL, CASE WHEN value>60 THEN 'playing' WHEN value>20 THEN 'paused' ELSE 'idle' END FROM ev WHERE event_type='view'
 UNION ALL SELECT *, 'light','living', CAST(k>50 AS DOUBLE), NULL FROM ev WHERE event_type='view'
 UNION ALL SELECT *, 'door','hall', CAST(value>30 AS DOUBLE), NULL FROM ev WHERE event_type='signup'
 UNION ALL SELECT *, 'person',NULL, NULL, CASE WHEN k>=40 THEN 'home' ELSE 'not_home' END FROM ev WHERE event_type='signup'
 UNION ALL SELECT *, 'focus',NULL, CAST(k%2 AS DOUBLE), NULL FROM ev WHERE event_type='signup'
 UNION ALL SELECT *, 'power','kitchen', value, NULL FROM ev WHERE event_type='purchase'
 UNION ALL SELECT *, 'steps',NULL, CAST(k*100 AS DOUBLE), NULL FROM ev WHERE event_type='purchase'
 UNION ALL SELECT *, 'alarm_time',NULL, NULL, printf('%02d:%02d', k%24, event_id%60) FROM ev WHERE event_type='purchase'
 UNION ALL SELECT *, 'presence','bedroom', CAST(value>25 AS DOUBLE), NULL FROM ev WHERE event_type='error'
 UNION ALL SELECT *, 'env','living', value, NULL FROM ev WHERE event_type='error'
 UNION ALL SELECT *, 'battery',NULL, CAST(k AS DOUBLE), NULL FROM ev WHERE event_type='error'
 UNION ALL SELECT *, 'custom','bedroom', value+k, NULL FROM ev WHERE event_type='error')""")

view("timeline", """
SELECT home, person, w, CASE lt WHEN 'click' THEN 'cooking' WHEN 'view' THEN 'movie' WHEN 'signup' THEN 'away' WHEN 'purchase' THEN 'home' ELSE 'unknown' END AS predicted,
 CASE WHEN (w%1440<420 OR w%1440>=1380) AND mk>=20 THEN 'asleep' ELSE CASE tt WHEN 'click' THEN 'cooking' WHEN 'view' THEN 'movie' WHEN 'signup' THEN 'away' WHEN 'purchase' THEN 'home' ELSE 'unknown' END END AS smoothed,
 CASE fid%3 WHEN 0 THEN 'fact:presence' WHEN 1 THEN 'rules-only' ELSE 'rf-3' END AS model_version,
 CAST(20 + sk%80 AS DOUBLE)/100.0 AS confidence
FROM (SELECT home, person, w, max(mk) AS mk, CAST(sum(sk) AS BIGINT) AS sk, min(fid) AS fid, arg_max(event_type, lts) AS lt,
        max(CASE WHEN rn=1 THEN event_type END) AS tt
      FROM (SELECT *, row_number() OVER (PARTITION BY person, w ORDER BY n DESC, event_type) AS rn FROM (
        SELECT home, person, minute-minute%30 AS w, event_type, count(*) AS n, max(ts) AS lts, max(k) AS mk, sum(k) AS sk, min(event_id) AS fid
        FROM ev GROUP BY ALL)) GROUP BY home, person, w)""")

view("labelev", """
SELECT person, minute AS window_min, minute+k AS written_min, CASE WHEN event_type='signup' THEN 'away' ELSE 'home' END AS label,
 CASE WHEN k%3=0 THEN 'cooking' END AS activity,
 CASE event_id%4 WHEN 0 THEN 'bootstrap' WHEN 1 THEN 'llm' WHEN 2 THEN 'discovered' ELSE 'confirmed' END AS provenance,
 CASE WHEN event_id%2=0 THEN 'ui' END AS source, event_id%7=0 AS gold, event_id AS arrival
FROM ev WHERE event_type IN ('signup','purchase')""")

view("entity", """
SELECT p_partkey AS part_id,
 CASE p_type WHEN 'STANDARD' THEN 'sensor' WHEN 'PROMO' THEN 'binary_sensor' WHEN 'LARGE' THEN 'light' WHEN 'SMALL' THEN 'media_player' WHEN 'MEDIUM' THEN 'device_tracker' ELSE 'switch' END
  ||'.'||replace(lower(p_name),' ','_')||'_'||p_partkey AS entity_id,
 array_to_string(list_transform(string_split(p_name,' '), lambda x: upper(x[1])||lower(x[2:])),' ')||' '||lower(p_brand) AS friendly_name,
 ['temperature','humidity','motion','door','battery','power','occupancy','signal_strength'][p_size%8+1] AS device_class,
 ['°C','%',NULL,NULL,'%','W',NULL,'dBm'][p_size%8+1] AS unit,
 'dev'||(p_partkey//7) AS device_id, lower(replace(p_brand,'#','_')) AS integration,
 ['Living Room','living_room','livingroom','Kitchen','kitchen','Bed-Room','bedroom','Hall',NULL][p_size%9+1] AS area,
 p_size%11=0 AS disabled, CASE WHEN p_size%13=0 THEN 'diagnostic' END AS entity_category, p_retailprice AS price, p_size AS size
FROM part""")

view("bind", """
SELECT part_id AS binding_id, entity_id, regexp_replace(split_part(entity_id,'.',2),'_[0-9]+$','')||'_'||role||'_'||part_id AS name, role, area AS room,
 CASE WHEN part_id%5=0 THEN 'p'||(part_id%8) END AS person_id, size<>50 AS enabled, part_id%17=0 AS model_excluded,
 CASE WHEN part_id%19=0 THEN CAST(part_id%3+1 AS INTEGER) END AS tier_option, device_id, price
FROM (SELECT *, ['presence','bed','power','light','media','env','person','focus','alarm_time','door','steps','battery','custom'][part_id%13+1] AS role FROM entity)""")

view("member", """
SELECT 'c'||c_custkey AS person_id, lower(c_mktsegment)||' '||c_custkey AS name, c_custkey AS ord, c_acctbal>0 AS enabled, c_acctbal>2000 AS opted_in FROM customer""")

view("activity", """
SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS slug, CAST(NULL AS BIGINT) AS parent_id FROM region
UNION ALL SELECT CAST(n_nationkey+100 AS BIGINT), lower(n_name), CAST(n_regionkey AS BIGINT) FROM nation""")

view("pred5", """
SELECT home, person, minute-minute%5 AS w, CASE event_type WHEN 'click' THEN 'cooking' WHEN 'view' THEN 'movie' WHEN 'signup' THEN 'away' WHEN 'purchase' THEN 'home' ELSE 'unknown' END AS smoothed,
 round(value/(value+k+10.0),4) AS a, round(k/(value+k+10.0),4) AS b, round(1-round(value/(value+k+10.0),4)-round(k/(value+k+10.0),4),4) AS c,
 CASE WHEN event_id%3>0 THEN 'rf-3' END AS model, event_id, k, value FROM ev""")

view("scored", """
SELECT row_id, person, y, round(x/s,4) AS p_F, round(yy/s,4) AS p_O, round(z/s,4) AS p_P, provenance, gold, minute, amount FROM (
 SELECT o_orderkey AS row_id, 'p'||(o_custkey%8) AS person, o_orderstatus AS y,
  (o_custkey*7+o_orderkey)%97+1 AS x, (o_orderkey*3+o_custkey)%89+1 AS yy, (o_orderkey*5)%83+1 AS z,
  CAST((o_custkey*7+o_orderkey)%97+1 + (o_orderkey*3+o_custkey)%89+1 + (o_orderkey*5)%83+1 AS DOUBLE) AS s,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'confirmed' WHEN '2-HIGH' THEN 'discovered' WHEN '5-LOW' THEN 'llm' ELSE 'bootstrap' END AS provenance,
  o_orderkey%3=0 AS gold, epoch_us(o_orderdate)//60000000 AS minute, o_totalprice AS amount FROM orders)""")

view("minutely", """
SELECT person, binding, role, room, minute, arg_max(num, ts) AS num, arg_max(str, ts) AS str FROM reading GROUP BY person, binding, role, room, minute""")

view("iv", """
SELECT m.*, least(minute+1+CASE role WHEN 'presence' THEN 5 WHEN 'bed' THEN 10 WHEN 'power' THEN 10 WHEN 'light' THEN 240 WHEN 'media' THEN 5 WHEN 'env' THEN 120
  WHEN 'person' THEN 10080 WHEN 'focus' THEN 10 WHEN 'alarm_time' THEN 10080 WHEN 'door' THEN 0 WHEN 'steps' THEN 30 WHEN 'battery' THEN 120 ELSE 30 END,
  lead(minute) OVER (PARTITION BY person, binding ORDER BY minute), fe+1) AS to_min, fe FROM minutely m JOIN (SELECT person, max(minute) AS fe FROM ev GROUP BY person) USING (person)""")

# one row per valid minute: the dense grid the interval form must agree with
view("dense", """
SELECT person, binding, role, room, unnest(range(minute, to_min)) AS m, num, str, fe FROM iv""")

view("densewin", """
SELECT *, we-30 AS ws FROM (SELECT *, (m//30+1)*30 + 30*unnest(range(0, greatest(lb//30,1))) AS we FROM
 (SELECT *, CASE role WHEN 'presence' THEN 15 WHEN 'media' THEN 15 WHEN 'env' THEN 60 WHEN 'steps' THEN 180 WHEN 'battery' THEN 180 ELSE 30 END AS lb FROM dense))
WHERE m >= we-lb AND we <= (fe//30)*30+30""")

view("grid", """
SELECT person, unnest(range(lo-lo%30, hi-hi%30+30, 30)) AS ws FROM (SELECT person, min(minute) AS lo, max(minute) AS hi FROM ev GROUP BY person)""")

view("dchg", """
SELECT person, binding, room, m AS minute FROM (SELECT *, lag(num) OVER w AS pn, lag(m) OVER w AS pm FROM dense WHERE role IN ('presence','door') WINDOW w AS (PARTITION BY person, binding ORDER BY m))
WHERE pm=m-1 AND abs(num-pn)>0.5""")

view("tl", """
SELECT *, smoothed AS state, CASE WHEN model_version LIKE 'fact%' THEN 'fact' WHEN model_version LIKE 'rules%' THEN 'rule' ELSE 'model' END AS basis,
 strftime(make_timestamp(w*60000000), '%Y-%m-%d') AS date, isodow(make_timestamp(w*60000000))-1 AS dow, hour(make_timestamp(w*60000000)) AS hour FROM timeline""")

view("epi", """
SELECT person, state, min(w) AS start, max(w)+30 AS "end", count(*) AS windows FROM (SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY w) AS run FROM
 (SELECT *, CASE WHEN lag(w) OVER o + 30 = w AND lag(state) OVER o = state THEN 0 ELSE 1 END AS nw FROM tl WINDOW o AS (PARTITION BY person ORDER BY w))) GROUP BY person, run, state""")

view("p5", """
SELECT person, w, arg_max(smoothed, event_id) AS smoothed, arg_max(CAST(20+k%80 AS DOUBLE)/100, event_id) AS confidence FROM pred5 GROUP BY person, w""")

view("runs5", """
SELECT person, run, smoothed AS label, min(w) AS start, max(w) AS "end", max(w)-min(w)+5 AS minutes, avg(confidence) AS mean_conf, max(CASE WHEN i=n//2 THEN w END) AS mid FROM (
 SELECT *, row_number() OVER (PARTITION BY person, run ORDER BY w)-1 AS i, count(*) OVER (PARTITION BY person, run) AS n FROM (
 SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY w) AS run FROM (SELECT *, CASE WHEN lag(smoothed) OVER o=smoothed AND w-lag(w) OVER o<=10 THEN 0 ELSE 1 END AS nw FROM p5 WINDOW o AS (PARTITION BY person ORDER BY w))))
 GROUP BY person, run, smoothed""")

view("ctr", """
SELECT person, CASE event_type WHEN 'purchase' THEN 'daily_steps' ELSE 'distance_km' END AS signal, minute, ts,
 CAST(sum(k) OVER (PARTITION BY person, event_type, minute//1440 ORDER BY ts) AS DOUBLE) AS value FROM ev WHERE event_type IN ('purchase','error')""")

view("chg", """SELECT DISTINCT person, minute-minute%30 AS bucket FROM ev WHERE event_type='signup' AND k%4=0""")

view("worn", """
SELECT person, signal, bucket, amount FROM (SELECT person, signal, bucket, CASE WHEN value < p-abs(p)*0.5 THEN greatest(value,0) ELSE greatest(value-p,0) END AS amount, p FROM (
 SELECT *, lag(value) OVER (PARTITION BY person, signal ORDER BY bucket) AS p FROM (SELECT person, signal, minute-minute%30 AS bucket, arg_max(value, ts) AS value FROM ctr GROUP BY ALL))) WHERE p IS NOT NULL
 AND (person, bucket) NOT IN (SELECT person, bucket FROM chg)""")

view("prim", """
SELECT w.* FROM worn w JOIN (SELECT person, coalesce(min(signal) FILTER (WHERE signal LIKE '%step%'), min(signal)) AS prm FROM worn GROUP BY person) p ON p.person=w.person AND p.prm=w.signal""")

view("domroom", """
SELECT person, minute, arg_min(room, (-n)*1000+rk) AS room FROM (SELECT person, minute, room, count(*) AS n, min(CASE binding WHEN 'click_presence' THEN 1 WHEN 'error_presence' THEN 2 WHEN 'signup_door' THEN 3 ELSE 4 END) AS rk FROM dchg GROUP BY ALL) GROUP BY ALL""")

view("mobil", """
SELECT m.*, coalesce(s.sw,0) AS switches FROM (SELECT person, ws, count(*) AS rooms, CASE WHEN count(*)>1 THEN -sum(n/t*ln(n/t))/ln(count(*)) ELSE 0 END AS ent
 FROM (SELECT *, sum(n) OVER (PARTITION BY person, ws) AS t FROM (SELECT person, minute-minute%30 AS ws, room, count(*) AS n FROM dchg GROUP BY ALL)) GROUP BY person, ws) m
LEFT JOIN (SELECT person, ws, count(*) FILTER (WHERE p<>room) AS sw FROM (SELECT *, lag(room) OVER (PARTITION BY person, ws ORDER BY minute) AS p FROM (SELECT *, minute-minute%30 AS ws FROM domroom)) GROUP BY person, ws) s USING (person, ws)""")

view("hourly", """
SELECT person, h, coalesce(x,0) AS x FROM (SELECT person, unnest(range(min(w)//60, max(w)//60+1)) AS h FROM tl GROUP BY person) LEFT JOIN (SELECT person, w//60 AS h, sum(confidence) AS x FROM tl GROUP BY ALL) USING (person, h)""")

view("mrec", """
SELECT 'p'||(o_custkey%8) AS person, o_orderkey AS model_id, epoch_us(o_orderdate)//60000000 AS trained, round(o_totalprice/600000,3) AS headline, o_orderstatus<>'P' AS promoted, (o_orderkey*13)%29 AS confirmed FROM orders""")

view("sp", """
SELECT *, CASE WHEN predicted=y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct FROM (SELECT *, greatest(p_F,p_O,p_P) AS conf, CASE WHEN p_F>=p_O AND p_F>=p_P THEN 'F' WHEN p_O>=p_P THEN 'O' ELSE 'P' END AS predicted FROM scored)""")

view("lilong", """
SELECT feature, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'expected' ELSE 'actual' END AS side, value FROM (
 UNPIVOT (SELECT l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)""")

view("factrows", """
SELECT person, w, CASE WHEN state='unknown' THEN NULL WHEN state='asleep' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fact, basis='rule' AND hour BETWEEN 8 AND 21 AS contradiction, tr AS truth FROM tl
LEFT JOIN (SELECT person, window_min-window_min%30 AS w, max(CASE WHEN label='home' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tr FROM labelev WHERE provenance='confirmed' GROUP BY ALL) USING (person, w)""")

view("nchg", """
SELECT person AS home, binding AS sensor, minute FROM (SELECT *, lag(num) OVER (PARTITION BY person, binding ORDER BY minute) AS p FROM minutely WHERE num IS NOT NULL) WHERE abs(num-p)>1e-9""")

view("frame", "SELECT person AS home, min(minute) AS first, max(minute) AS last FROM ev GROUP BY person")

view("cb", "SELECT home, sensor, minute//5 AS bin, CAST(count(*) AS DOUBLE) AS x FROM nchg GROUP BY ALL")

view("cs", "SELECT home, sensor, sum(x) AS sx, sum(x*x) AS sxx FROM cb GROUP BY ALL")

view("coact", """
SELECT home, a, b, CASE WHEN den>0 THEN (n*sxy-ax*bx)/sqrt(den) ELSE 0 END AS r FROM (SELECT *, (n*axx-ax*ax)*(n*bxx-bx*bx) AS den FROM (
 SELECT a.home, a.sensor AS a, b.sensor AS b, any_value(a.sx) AS ax, any_value(a.sxx) AS axx, any_value(b.sx) AS bx, any_value(b.sxx) AS bxx, any_value(f.last//5-f.first//5+1) AS n, coalesce(any_value(x.sxy),0) AS sxy
 FROM cs a JOIN cs b ON a.home=b.home AND a.sensor<b.sensor JOIN frame f ON f.home=a.home LEFT JOIN (SELECT p.home, p.sensor AS a, q.sensor AS b, sum(p.x*q.x) AS sxy FROM cb p JOIN cb q ON p.home=q.home AND p.bin=q.bin AND p.sensor<q.sensor GROUP BY ALL) x ON x.home=a.home AND x.a=a.sensor AND x.b=b.sensor GROUP BY a.home, a.sensor, b.sensor))""")

view("lact", """
SELECT home, sensor AS s, t, n, CAST(count(*) AS DOUBLE) AS x FROM (SELECT c.home, sensor, minute-first+unnest([0,1,2]) AS t, last-first+1 AS n FROM nchg c JOIN frame USING (home)) WHERE t<n GROUP BY ALL""")

view("ledges", """
SELECT home, from_sensor, to_sensor, lag_min, round(r,3) AS strength FROM (SELECT home, a AS from_sensor, b AS to_sensor, k AS lag_min, r, row_number() OVER (PARTITION BY home, least(a,b), greatest(a,b) ORDER BY r DESC, k, a<b DESC) AS rn FROM (
 SELECT x.home, x.a, x.b, x.k, round(((n-x.k)*sxy-a1*b1)/sqrt(((n-x.k)*a2-a1*a1)*((n-x.k)*b2-b1*b1)),9) AS r FROM
  (SELECT l.home, l.s AS a, m.s AS b, k, sum(l.x*m.x) AS sxy, any_value(l.n) AS n FROM (SELECT *, unnest(range(1,16)) AS k FROM lact) l JOIN lact m ON m.home=l.home AND m.t=l.t+l.k AND m.s<>l.s GROUP BY ALL) x
  JOIN (SELECT home, s AS a, k, sum(x) FILTER (WHERE t<n-k) AS a1, sum(x*x) FILTER (WHERE t<n-k) AS a2 FROM (SELECT *, unnest(range(1,16)) AS k FROM lact) GROUP BY ALL) y ON y.home=x.home AND y.a=x.a AND y.k=x.k
  JOIN (SELECT home, s AS b, k, sum(x) FILTER (WHERE t>=k) AS b1, sum(x*x) FILTER (WHERE t>=k) AS b2 FROM (SELECT *, unnest(range(1,16)) AS k FROM lact) GROUP BY ALL) z ON z.home=x.home AND z.b=x.b AND z.k=x.k) WHERE r>0) WHERE rn=1""")

view("fires", "SELECT DISTINCT person, minute AS fire FROM ev WHERE event_type='click' AND k<40")

view("moves", "SELECT person, w AS move FROM (SELECT person, w, state, lag(state) OVER (PARTITION BY person ORDER BY w) AS p FROM tl) WHERE state='asleep' AND p<>'asleep'")
