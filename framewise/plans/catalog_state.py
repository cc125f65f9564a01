"""SQL of the queries with sequential state: recursive statements that walk each key's rows in order."""

#: Time in seconds, and each key's rows numbered.
_E = "WITH RECURSIVE e AS MATERIALIZED (SELECT *, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"

RATE_LIMITED = _E + """, s AS (SELECT user_id, event_id, rn, t, t AS last_, true AS taken FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, e.t, CASE WHEN e.t - s.last_ + 1e-9 >= 86400.0::DOUBLE THEN e.t ELSE s.last_ END, e.t - s.last_ + 1e-9 >= 86400.0::DOUBLE FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)"""

HYSTERESIS = _E + """, a AS MATERIALIZED (SELECT user_id, event_id, rn, t, value * 3.6::DOUBLE AS angle, CAST(floor(((value * 3.6::DOUBLE) % 360 + 45) / 90) AS INTEGER) * 90 % 360 AS quarter FROM e),
s AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, 0 AS turn, NULL::INTEGER AS wish, 0.0::DOUBLE AS since FROM a WHERE rn = 1
  UNION ALL SELECT a.user_id, a.event_id, a.rn,
    CASE WHEN stay THEN s.turn WHEN s.wish IS DISTINCT FROM a.quarter THEN s.turn WHEN a.t - s.since >= 20000.0::DOUBLE THEN a.quarter ELSE s.turn END,
    CASE WHEN stay THEN NULL WHEN s.wish IS DISTINCT FROM a.quarter THEN a.quarter WHEN a.t - s.since >= 20000.0::DOUBLE THEN NULL ELSE s.wish END,
    CASE WHEN NOT stay AND s.wish IS DISTINCT FROM a.quarter THEN a.t ELSE s.since END
  FROM s JOIN a ON a.user_id = s.user_id AND a.rn = s.rn + 1, LATERAL (SELECT a.quarter = s.turn OR abs((((a.angle - s.turn + 180) % 360) + 360) % 360 - 180) < 60 AS stay) x)
SELECT user_id, event_id AS id, turn FROM s WHERE rn > 0"""

MOTION = _E + """, s AS (SELECT user_id, event_id, rn, t AS last_t, value AS last_v, true AS taken FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN go THEN e.t ELSE s.last_t END, CASE WHEN go THEN e.value ELSE s.last_v END, go
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1, LATERAL (SELECT e.t - s.last_t >= 43200.0::DOUBLE AND abs(e.value - s.last_v) >= 20.0::DOUBLE AS go) x)
SELECT user_id, event_id AS id, taken FROM s"""

#: The last eight rows of a run as lists of axes; the run ends at gaps and where the mean all but vanishes.
GRAVITY = _E + """, v AS MATERIALIZED (SELECT user_id, event_id, rn, t, 9.8::DOUBLE * sin(value / 50) AS x, 9.8::DOUBLE * cos(value / 50) AS y, 0.1::DOUBLE AS z FROM e),
s AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, NULL::DOUBLE AS t, []::DOUBLE[] AS xs, []::DOUBLE[] AS ys, []::DOUBLE[] AS zs, [NULL, NULL, NULL]::DOUBLE[] AS m, false AS valid, 0.0::DOUBLE AS sure, [NULL, NULL, NULL]::DOUBLE[] AS up FROM v WHERE rn = 1
  UNION ALL SELECT v.user_id, v.event_id, v.rn, CASE WHEN lost THEN NULL ELSE v.t END,
    CASE WHEN lost THEN []::DOUBLE[] ELSE xs_ END, CASE WHEN lost THEN []::DOUBLE[] ELSE ys_ END, CASE WHEN lost THEN []::DOUBLE[] ELSE zs_ END, m_,
    NOT lost AND sure_ >= 0.15, CASE WHEN lost THEN 0.0::DOUBLE ELSE sure_ END, CASE WHEN lost THEN [NULL, NULL, NULL]::DOUBLE[] ELSE [m_[1] / size_, m_[2] / size_, m_[3] / size_] END
  FROM s JOIN v ON v.user_id = s.user_id AND v.rn = s.rn + 1,
  LATERAL (SELECT s.t IS NULL OR v.t - s.t <= 0 OR v.t - s.t > 40000.0::DOUBLE AS fresh) a,
  LATERAL (SELECT CASE WHEN fresh THEN [v.x] ELSE list_append(s.xs[greatest(len(s.xs) - 6, 1):], v.x) END AS xs_, CASE WHEN fresh THEN [v.y] ELSE list_append(s.ys[greatest(len(s.ys) - 6, 1):], v.y) END AS ys_, CASE WHEN fresh THEN [v.z] ELSE list_append(s.zs[greatest(len(s.zs) - 6, 1):], v.z) END AS zs_) b,
  LATERAL (SELECT list_aggregate(xs_, 'median') AS mx, list_aggregate(ys_, 'median') AS my, list_aggregate(zs_, 'median') AS mz, exp(-greatest(v.t - s.t, 0.001) / 20000.0::DOUBLE) AS stay) c,
  LATERAL (SELECT CASE WHEN fresh THEN [mx, my, mz] ELSE [mx + stay * (s.m[1] - mx), my + stay * (s.m[2] - my), mz + stay * (s.m[3] - mz)] END AS m_,
    list_aggregate(list_transform(range(1, len(xs_) + 1), lambda k: sqrt(pow(xs_[k] - mx, 2) + pow(ys_[k] - my, 2) + pow(zs_[k] - mz, 2))), 'median') AS scatter, sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS norm) d,
  LATERAL (SELECT sqrt(m_[1] * m_[1] + m_[2] * m_[2] + m_[3] * m_[3]) AS size_, exp(-pow((norm - 9.80665) / (0.07 * 9.80665), 2) - pow(scatter / (0.08 * 9.80665), 2)) * least(1, len(xs_) / 5.0::DOUBLE) AS sure_) f,
  LATERAL (SELECT size_ < 0.25 * 9.80665 AS lost) g)
SELECT user_id, event_id AS id, valid, round(sure, 6) AS confidence, round(up[1], 6) AS up_x, round(up[2], 6) AS up_y, round(up[3], 6) AS up_z FROM s WHERE rn > 0"""

_SIDES = """, a AS MATERIALIZED (SELECT event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view'),
b AS MATERIALIZED (SELECT event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
at_ AS MATERIALIZED (SELECT a.rn, a.event_id, a.t, (SELECT count(*) FROM b WHERE b.t < a.t) AS pos FROM a), l AS MATERIALIZED (SELECT list(t ORDER BY rn) AS bt, list(event_id ORDER BY rn) AS bi FROM b)"""

#: Candidates are the places before, at and after the first time not under t; of equally near ones the first.
NEAREST_UNUSED = "WITH RECURSIVE z AS MATERIALIZED (SELECT 1)" + _SIDES + """, s AS (SELECT 0::BIGINT AS rn, -1::BIGINT AS last_, NULL::BIGINT AS a_id, 0.0::DOUBLE AS a_t, NULL::BIGINT AS j
  UNION ALL SELECT a.rn, coalesce(best, s.last_), a.event_id, a.t, best
  FROM s JOIN at_ a ON a.rn = s.rn + 1, l,
  LATERAL (SELECT list_filter([a.pos - 1, a.pos, a.pos + 1], lambda j: j > s.last_ AND j < len(bt)) AS near) x,
  LATERAL (SELECT list_min(list_transform(near, lambda j: {'g': abs(a.t - bt[j + 1]), 'j': j})) AS first_) y,
  LATERAL (SELECT CASE WHEN first_.g <= 600.0::DOUBLE THEN first_.j END AS best) w)
SELECT a_id, bi[j + 1] AS b_id, a_t, bt[j + 1] AS b_t FROM s, l WHERE j IS NOT NULL"""

GREEDY = "WITH RECURSIVE z AS MATERIALIZED (SELECT 1)" + _SIDES + """, c AS MATERIALIZED (SELECT a.rn AS i, a.event_id AS a_id, a.t AS a_t, j, row_number() OVER (ORDER BY abs(a.t - bt[j + 1]), a.rn, j) AS n FROM at_ a, l, LATERAL (SELECT unnest([a.pos - 1, a.pos]) AS j) x WHERE j >= 0 AND j < len(bt) AND abs(a.t - bt[j + 1]) <= 600.0::DOUBLE),
s AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b, false AS took, 0::BIGINT AS a_id, 0.0::DOUBLE AS a_t, 0::BIGINT AS j
  UNION ALL SELECT c.n, CASE WHEN free THEN list_append(used_a, c.i) ELSE used_a END, CASE WHEN free THEN list_append(used_b, c.j) ELSE used_b END, free, c.a_id, c.a_t, c.j
  FROM s JOIN c ON c.n = s.n + 1, LATERAL (SELECT NOT list_contains(used_a, c.i) AND NOT list_contains(used_b, c.j) AS free) x)
SELECT a_id, bi[j + 1] AS b_id, a_t, bt[j + 1] AS b_t FROM s, l WHERE took"""

SPANNING = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM p),
c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dist, src, dst) AS k FROM (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, dist FROM n WHERE rn <= 4)),
s AS (SELECT 0::BIGINT AS k, (SELECT list_transform(range(max(vec_id) + 1), lambda x: x) FROM v) AS label, false AS took, 0::BIGINT AS src, 0::BIGINT AS dst, 0.0::DOUBLE AS dist
  UNION ALL SELECT c.k, CASE WHEN x.new_ THEN list_transform(s.label, lambda y: CASE WHEN y = s.label[c.src + 1] THEN s.label[c.dst + 1] ELSE y END) ELSE s.label END, x.new_, c.src, c.dst, c.dist
  FROM s JOIN c ON c.k = s.k + 1, LATERAL (SELECT s.label[c.src + 1] <> s.label[c.dst + 1] AS new_) x)
SELECT src, dst, -dist AS score FROM s WHERE took"""

#: Views of a block in the order in which they may go, each as lists over the block's samples.
REVERSE_DELETE = """WITH RECURSIVE w AS MATERIALIZED (SELECT l_partkey % 16 AS block, l_suppkey AS view, l_partkey AS sample, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3),
g AS MATERIALIZED (SELECT *, (weight >= 0.9::DOUBLE * max(weight) OVER (PARTITION BY sample))::INT AS good, dense_rank() OVER (PARTITION BY block ORDER BY sample) AS place FROM w WHERE weight > 0),
c AS MATERIALIZED (SELECT block, place, count(*) - least(count(*), 3) AS spare, sum(good) - 1 AS spare_good FROM g GROUP BY 1, 2),
b AS MATERIALIZED (SELECT block, list(spare ORDER BY place) AS spare, list(spare_good ORDER BY place) AS spare_good FROM c GROUP BY 1),
o AS MATERIALIZED (SELECT block, view, row_number() OVER (PARTITION BY block ORDER BY count(*), view) AS rn, list(place) AS places, list(place) FILTER (good = 1) AS goods FROM g GROUP BY 1, 2),
s AS (SELECT block, 0::BIGINT AS view, 0::BIGINT AS rn, spare, spare_good, false AS goes FROM b
  UNION ALL SELECT s.block, o.view, o.rn,
    CASE WHEN x.go THEN list_transform(s.spare, lambda v, k: v - list_contains(o.places, k)::INT) ELSE s.spare END,
    CASE WHEN x.go THEN list_transform(s.spare_good, lambda v, k: v - list_contains(coalesce(o.goods, []), k)::INT) ELSE s.spare_good END, x.go
  FROM s JOIN o ON o.block = s.block AND o.rn = s.rn + 1,
  LATERAL (SELECT list_min(list_transform(o.places, lambda k: s.spare[k])) > 0 AND coalesce(list_min(list_transform(coalesce(o.goods, []), lambda k: s.spare_good[k])), 1) > 0 AS go) x)
SELECT block, view AS l_suppkey, NOT goes AS kept FROM s WHERE rn > 0"""

#: All six views are linked, so the least squares are each view's mean log ratio to all.
GAINS = """WITH s AS (SELECT l_partkey, l_suppkey % 6 AS view, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
r AS MATERIALIZED (SELECT a.view AS a, b.view AS b, median(ln(a.v / b.v)) AS ratio FROM s a JOIN s b USING (l_partkey) WHERE a.view < b.view GROUP BY 1, 2),
x AS MATERIALIZED (SELECT view, sum(r) / 6 AS x FROM (SELECT b AS view, ratio AS r FROM r UNION ALL SELECT a, -ratio FROM r) GROUP BY 1)
SELECT view, round(least(greatest(exp(x - (SELECT x FROM x WHERE view = 0)), 2 / 3.0::DOUBLE), 1.5::DOUBLE), 6) AS gain FROM x"""

STREAM_PAIRS = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type = 'view' AS colour, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'view', event_id) AS rn FROM events WHERE event_type IN ('view', 'error')),
s AS (SELECT user_id, 0::BIGINT AS rn, []::STRUCT(t DOUBLE, id BIGINT)[] AS wait, NULL::STRUCT(t DOUBLE, id BIGINT) AS pending, NULL::STRUCT(a STRUCT(t DOUBLE, id BIGINT), b STRUCT(t DOUBLE, id BIGINT)) AS pair FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, CASE WHEN place IS NULL OR NOT near THEN wait_ ELSE wait_[place + 1:] END, CASE WHEN place IS NULL THEN pending_ END, CASE WHEN place IS NOT NULL AND near THEN {'a': pending_, 'b': wait_[place]} END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1,
  LATERAL (SELECT CASE WHEN e.colour THEN s.wait ELSE list_append(s.wait[greatest(len(s.wait) - 6, 1):], {'t': e.t, 'id': e.id}) END AS wait_, CASE WHEN e.colour THEN {'t': e.t, 'id': e.id} ELSE s.pending END AS pending_) x,
  LATERAL (SELECT CASE WHEN pending_ IS NOT NULL AND len(wait_) > 0 AND wait_[len(wait_)].t >= pending_.t THEN list_min(list_transform(range(1, len(wait_) + 1), lambda k: {'g': abs(wait_[k].t - pending_.t), 'k': k})) END AS best) y,
  LATERAL (SELECT best.k AS place, best.g <= 43200.0::DOUBLE AS near) z)
SELECT user_id AS key, pair.a.id AS a_id, pair.b.id AS b_id, pair.a.t AS a_t, pair.b.t AS b_t FROM s WHERE pair IS NOT NULL"""

STREAM_SESSIONS = """WITH g AS MATERIALIZED (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, round(min(epoch_us(ts)) / 1e6, 6) AS start, round(max(epoch_us(ts)) / 1e6, 6) AS "end", count(*) AS n FROM s GROUP BY user_id, k"""

#: A mark's samples as lists; conflicts in a row count as strikes.
TAG_MAP = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, length(event_type) % 3 AS mark, event_id, (event_id * 37 % 11) * 0.004::DOUBLE + CASE WHEN value > 70 THEN 1 ELSE 0 END AS x, value * 0.0002::DOUBLE AS y, 1 + (event_id % 5) * 0.1::DOUBLE AS z, row_number() OVER (PARTITION BY user_id, length(event_type) % 3 ORDER BY event_id) AS rn FROM events),
s AS (SELECT user_id, mark, 0::BIGINT AS event_id, 0::BIGINT AS rn, []::DOUBLE[] AS xs, []::DOUBLE[] AS ys, []::DOUBLE[] AS zs, 0 AS strikes, false AS gone, '' AS state FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.mark, e.event_id, e.rn,
    CASE WHEN out_ THEN []::DOUBLE[] WHEN far THEN s.xs WHEN len(s.xs) < 8 THEN list_append(s.xs, e.x) ELSE list_append(s.xs[1:2] || s.xs[4:8], e.x) END,
    CASE WHEN out_ THEN []::DOUBLE[] WHEN far THEN s.ys WHEN len(s.ys) < 8 THEN list_append(s.ys, e.y) ELSE list_append(s.ys[1:2] || s.ys[4:8], e.y) END,
    CASE WHEN out_ THEN []::DOUBLE[] WHEN far THEN s.zs WHEN len(s.zs) < 8 THEN list_append(s.zs, e.z) ELSE list_append(s.zs[1:2] || s.zs[4:8], e.z) END,
    CASE WHEN far THEN s.strikes + 1 ELSE 0 END, out_, CASE WHEN out_ THEN 'excluded' WHEN far THEN 'conflict' ELSE 'added' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.mark = s.mark AND e.rn = s.rn + 1,
  LATERAL (SELECT len(s.xs) > 0 AND sqrt(pow(e.x - list_aggregate(s.xs, 'median'), 2) + pow(e.y - list_aggregate(s.ys, 'median'), 2) + pow(e.z - list_aggregate(s.zs, 'median'), 2)) > 0.04::DOUBLE + 0.006::DOUBLE * e.z * e.z * 4 AS far) a,
  LATERAL (SELECT s.gone OR (far AND s.strikes >= 1) AS out_) b)
SELECT user_id AS session, event_id AS view, mark::BIGINT AS mark, state, len(xs)::INTEGER AS n_samples FROM s WHERE rn > 0"""
