"""DuckDB SQL of the catalogue's queries."""

S = """s AS (SELECT l_returnflag || l_linestatus AS image_id,
  concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS cell_id,
  l_partkey::DOUBLE AS x, l_suppkey::DOUBLE AS y, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem)"""
#: Calls, flag and labels of the lineitem configuration.
C = f"""{S}, c AS (SELECT *, asinh(q / 5) >= 2.3 AS cq, asinh(p / 5) >= 9.2 AS cp, d >= 0.05 AS cd, t >= 0.04 AS ct FROM s),
l AS (SELECT *, CASE WHEN cd AND ct THEN 'Unresolved' WHEN cq AND cp THEN 'Both' WHEN cq AND NOT cd THEN 'Pending' WHEN cd OR ct THEN 'Discounted' ELSE 'Undefined' END AS cell_type,
  CASE WHEN cd AND ct THEN NULL WHEN cq AND cp THEN 'R1' WHEN cq AND NOT cd THEN 'R2' WHEN cd OR ct THEN 'R3' END AS rule_id FROM c)"""
#: The same for the configuration in which TAX is a state marker.
T = f"""{S}, l AS (SELECT *, CASE WHEN asinh(q / 5) >= 2.3 AND asinh(p / 5) >= 9.2 THEN 'Both' WHEN asinh(q / 5) >= 2.3 THEN 'Pending' WHEN d >= 0.05 THEN 'Discounted' ELSE 'Undefined' END AS cell_type, (d + 1e-9) / (t + 1e-9) AS ratio FROM s),
st AS (SELECT image_id, cell_id, 'TAX' AS marker, parent, CASE WHEN parent = 'big' THEN cell_type = 'Both' ELSE cell_type IN ('Discounted', 'Pending') END AS in_parent, true AS evaluable, t AS score, 0.04 AS estimate, ratio, cell_type FROM l, (VALUES ('big'), ('small')) v(parent))"""


def summary(ctes: str) -> str:
    return f"""WITH {ctes}, n AS (SELECT image_id, cell_type, count(*) AS k FROM l GROUP BY ALL), tot AS (SELECT image_id, count(*) AS total FROM l GROUP BY ALL)
SELECT i.image_id, y.cell_type, coalesce(k, 0)::BIGINT AS n, round(coalesce(k, 0) / total, 6) AS proportion FROM (SELECT DISTINCT image_id FROM l) i CROSS JOIN (SELECT DISTINCT cell_type FROM l) y LEFT JOIN n USING (image_id, cell_type) JOIN tot USING (image_id)"""


def support(source: str, limits: str, role: str = "'identity'") -> str:
    """source: image_id, marker, v (NULL: unavailable); limits: SQL of (max_unavailable, min_cells) columns."""
    return f"""WITH v AS ({source}),
g AS (SELECT image_id, marker, {role} AS role, count(*) AS n_cells, count(v) AS n_available, 1.0 - count(v)::DOUBLE / count(*) AS fraction_unavailable, stddev_samp(v) AS sd, mad(v) AS mad, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.99) AS q99 FROM v GROUP BY image_id, marker),
m AS (SELECT image_id, marker, max(k) AS k FROM (SELECT image_id, marker, v, count(*) AS k FROM v WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
f AS (SELECT g.*, CASE WHEN mad = 0 THEN k::DOUBLE / n_available END AS fraction_mode, {limits} FROM g LEFT JOIN m USING (image_id, marker)),
o AS (SELECT *, CASE WHEN fraction_unavailable > mu THEN 1 WHEN n_available < 2 OR sd IS NULL OR sd = 0 THEN 2 WHEN mad = 0 AND fraction_mode >= 0.99 THEN 3 WHEN n_available < mc THEN 4 WHEN role = 'context' THEN 5 ELSE 6 END AS k FROM f)
SELECT image_id, marker, role, CASE k WHEN 1 THEN 'NOT_CALLABLE_UNAVAILABLE' WHEN 2 THEN 'NOT_CALLABLE_ABSENT' WHEN 3 THEN 'NOT_CALLABLE_ABSENT' WHEN 4 THEN 'NOT_CALLABLE_UNDERPOWERED' WHEN 5 THEN 'NOT_GATED' ELSE 'PENDING_THRESHOLD' END AS status,
  CASE k WHEN 1 THEN 'mostly_unavailable' WHEN 2 THEN 'constant' WHEN 3 THEN 'near_constant' WHEN 4 THEN 'few_cells' ELSE 'ok' END AS support,
  CASE k WHEN 1 THEN printf('%.1f%% of cells have no usable signal (limit %.1f%%).', 100 * fraction_unavailable, 100 * mu) WHEN 2 THEN 'All cells with signal have the same value.' WHEN 3 THEN printf('%.1f%% of cells share one value.', 100 * fraction_mode)
    WHEN 4 THEN printf('Only %d cells with signal (minimum %d).', n_available, mc) WHEN 5 THEN 'For context: shown, but no rule may use it.' ELSE 'Signal supports threshold estimation.' END AS details,
  n_cells, n_available, round(fraction_unavailable, 6) AS fraction_unavailable, round(sd, 6) AS sd, round(mad, 6) AS mad, round(fraction_mode, 6) AS fraction_mode, round(q01, 6) AS q01, round(q50, 6) AS q50, round(q99, 6) AS q99 FROM o"""


_LONG = f"WITH {S} SELECT image_id, marker, v FROM (SELECT image_id, unnest(['QTY', 'PRICE', 'DISC', 'TAX']) AS marker, unnest([q, p, d, t]) AS v FROM s)"
_Z = """x AS (SELECT image_id, cell_id, asinh(q / 5) AS q, asinh(p / 5) AS p, d, t FROM s),
m AS (SELECT median(q) AS mq, median(p) AS mp, median(d) AS md, median(t) AS mt, coalesce(nullif(1.4826 * mad(q), 0), 1) AS sq, coalesce(nullif(1.4826 * mad(p), 0), 1) AS sp, coalesce(nullif(1.4826 * mad(d), 0), 1) AS sd, coalesce(nullif(1.4826 * mad(t), 0), 1) AS st FROM x),
z AS (SELECT image_id, cell_id, """ + ", ".join(f"least(5.0, greatest(-5.0, ({c} - m{c}) / s{c})) AS {c}" for c in "qpdt") + " FROM x, m)"


def _scores(table: str) -> str:
    return f"SELECT image_id, cell_id, round(q, 6) AS score_qty, round(p, 6) AS score_price, round(d, 6) AS score_disc, round(t, 6) AS score_tax FROM {table}"


_COMMON = f"""WITH {S}, {_Z}, k AS (SELECT *, (q + p + d + t) / 4.0 AS c FROM z),
b AS (SELECT {", ".join(f"regr_slope({c}, c) AS b_{c}, regr_intercept({c}, c) AS a_{c}" for c in "qpdt")} FROM k),
r AS (SELECT image_id, cell_id, {", ".join(f"{c} - a_{c} - b_{c} * c AS {c}" for c in "qpdt")} FROM k, b),
n AS (SELECT {", ".join(f"avg({c}) AS m{c}, stddev_samp({c}) AS s{c}" for c in "qpdt")} FROM r),
o AS (SELECT image_id, cell_id, {", ".join(f"({c} - m{c}) / s{c} AS {c}" for c in "qpdt")} FROM r, n) {_scores("o")}"""

_FROZEN = f"""WITH {S}, z AS (SELECT image_id, cell_id, least(5.0, greatest(-5.0, (q - 25.0) / 12.0)) AS q, least(5.0, greatest(-5.0, (p - 35000.0) / 20000.0)) AS p, least(5.0, greatest(-5.0, (d - 0.05) / 0.03)) AS d FROM s),
c AS (SELECT *, (q + p) / 2.0 AS u, (q - 0.1) * 0.6 + (p + 0.1) * 0.8 AS g FROM z),
r AS (SELECT image_id, cell_id, q - 0.0137 - 0.8123 * u AS uq, p + 0.0219 - 0.7071 * u AS up, q - 0.0137 - 0.8123 * g AS gq, p + 0.0219 - 0.7071 * g AS gp, d - 0.0341 - 0.1234 * g AS gd FROM c),
k AS (SELECT *, (uq + up) / 2.0 AS mu, (gq + gp) / 2.0 AS mg FROM r)
SELECT image_id, cell_id, round((uq - mu) / 0.5173, 6) AS id_qty, round((up - mu - 0.1131) / 0.2519, 6) AS id_price, round((gq - mg) / 0.5173, 6) AS gate_qty, round((gp - mg - 0.1131) / 0.2519, 6) AS gate_price, round((gd - mg + 0.1077) / 2.0331, 6) AS gate_disc FROM k"""


def density(source: str, n: int) -> str:
    """CTE dens (g, k, x, density) of source (g, v)."""
    return f"""src AS ({source}), qs AS (SELECT g, count(*) AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM src GROUP BY g),
h AS (SELECT *, 0.9 * CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM qs),
grid AS (SELECT g, n, h, k, lo + k * (hi - lo) / {float(n - 1)} AS x FROM h, range({n}) r(k)),
pts AS (SELECT g, v, count(*) AS w FROM src GROUP BY g, v),
dens AS (SELECT g, k, x, sum(w * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi())) AS density FROM grid JOIN pts USING (g) GROUP BY g, k, x, n, h)"""


_EVENTS = "SELECT event_type AS g, value AS v FROM events"
_LEDGER = """e AS (SELECT event_id AS o, 'X' || event_id AS entry_id, event_type AS image_id, (user_id % 20)::VARCHAR AS marker, value, CASE WHEN event_id <= 5 THEN NULL WHEN event_id % 25 = 0 THEN 'X' || (event_id - 5) WHEN event_id % 5 = 0 THEN 'X' || (event_id - 1) END AS reverts FROM events),
u AS (SELECT a.entry_id, a.reverts AS target, EXISTS (SELECT 1 FROM e b WHERE b.reverts = a.entry_id) AS undone FROM e a WHERE reverts IS NOT NULL),
act AS (SELECT * FROM e WHERE reverts IS NULL AND entry_id NOT IN (SELECT target FROM u WHERE NOT undone))"""


def boxes(n: int, value: str) -> str:
    return f"""{S}, b AS (SELECT ['AF', 'NO', 'RF'][k % 3 + 1] AS image_id, k + 1 AS o, 10.0 * (k % 50) AS x0, (k % 20)::DOUBLE AS y0, {value}[k % 3 + 1] AS v FROM range({n}) r(k)),
h AS (SELECT s.image_id, s.cell_id, max_by(v, o) AS v FROM s LEFT JOIN b ON s.image_id = b.image_id AND x BETWEEN x0 AND x0 + 150 AND y BETWEEN y0 AND y0 + 40 GROUP BY ALL)"""


_PART = "pt AS (SELECT p_brand AS image_id, p_partkey::VARCHAR AS id, p_size::DOUBLE AS x, p_partkey::DOUBLE / 10 AS y FROM part)"
_BASINS = [[1, 1, 2, 2, 0], [1, 1, 2, 2, 3], [1, 4, 4, 2, 3], [4, 4, 4, 3, 3], [0, 4, 4, 3, 3]]

#: The review of the replay query: effective cut 2.9 for QTY on AF, the PRICE cut on NO undone, and so on.
_REPLAY = f"""{S}, base AS (SELECT *, CASE WHEN asinh(q / 5) >= 2.3 AND asinh(p / 5) >= 9.2 THEN 'Both' WHEN asinh(q / 5) >= 2.3 THEN 'Pending' WHEN d >= 0.05 THEN 'Discounted' ELSE 'Undefined' END AS base_cell_type,
  asinh(q / 5) >= CASE WHEN image_id = 'AF' THEN 2.9 ELSE 2.3 END AS cq, asinh(p / 5) >= 9.2 AS cp FROM s),
n AS (SELECT *, CASE WHEN cq AND cp THEN 'R1' WHEN cq THEN 'R2' WHEN d >= 0.05 THEN 'R3' END AS rule_id, CASE WHEN image_id = 'RF' AND x BETWEEN 0 AND 300 AND y BETWEEN 0 AND 60 THEN 'Benign' WHEN image_id = 'RF' AND x BETWEEN 0 AND 800 AND y BETWEEN 0 AND 60 THEN 'Tumor' END AS structure_decision,
  CASE WHEN image_id = 'AF' AND x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 100 THEN 'NONE' WHEN image_id = 'AF' AND x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 100 THEN 'EXCLUDE' ELSE 'NONE' END AS disposition_effective FROM base),
k AS (SELECT *, disposition_effective = 'NONE' AS analysed, rule_id = 'R2' AND structure_decision IS NULL AS pending_review, CASE rule_id WHEN 'R1' THEN 'Both' WHEN 'R3' THEN 'Discounted' WHEN 'R2' THEN CASE structure_decision WHEN 'Tumor' THEN 'QTumor' WHEN 'Benign' THEN 'QBenign' ELSE 'Pending' END ELSE 'Undefined' END AS t1 FROM n),
rs AS (SELECT image_id, cell_id, parent, CASE WHEN parent = 'big' THEN t1 = 'Both' ELSE t1 IN ('Discounted', 'Pending') END AS in_parent, CASE WHEN image_id = 'NO' AND parent = 'big' THEN 0.06 ELSE 0.04 END AS estimate, image_id IN ('AF', 'NO') AND parent = 'big' AS enabled, (d + 1e-9) / (t + 1e-9) >= 1.0 AS located, t FROM k, (VALUES ('big'), ('small')) v(parent)),
rp AS (SELECT *, in_parent AND located AND t >= estimate AS positive FROM rs)"""

_VIEW = density("SELECT pool AS g, v FROM (SELECT 'pooled' AS pool, v FROM ev UNION ALL SELECT CASE WHEN v > 1.5 THEN 'positive' ELSE 'negative' END, v FROM ev)", 32)

def principal(table: str, columns: str, squarings: int = 16) -> str:
    """CTEs cm (covariances) and pv (first component, v_<column>, largest loading positive) of the columns' letters: the
    covariance matrix is squared until one direction is left."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    entry = lambda a, b: f"c_{min(a, b, key=columns.index)}{max(a, b, key=columns.index)}"
    out = [f"cm AS MATERIALIZED (SELECT {', '.join(f'covar_samp({a}, {b}) AS {entry(a, b)}' for a, b in pairs)} FROM {table})"]
    last, trace = "cm", " + ".join(entry(a, a) for a in columns)
    for k in range(squarings):
        product = ", ".join(f"({' + '.join(f'{entry(a, j)} * {entry(j, b)}' for j in columns)}) / (({trace}) * ({trace})) AS {entry(a, b)}" for a, b in pairs)
        out.append(f"cm{k} AS MATERIALIZED (SELECT {product} FROM {last})")
        last = f"cm{k}"
    # any column of the power points along the component; that with the largest diagonal is far from zero
    columns_of = "[" + ", ".join("[" + ", ".join(entry(a, b) for b in columns) + "]" for a in columns) + "]"
    best = f"list_position([{', '.join(entry(a, a) for a in columns)}], greatest({', '.join(entry(a, a) for a in columns)}))"
    out.append(f"pq AS (SELECT ({columns_of})[{best}] AS w FROM {last})")
    norm = "sqrt(list_sum(list_transform(w, lambda x: x * x)))"
    sign = "sign(w[list_position(list_transform(w, lambda x: abs(x)), list_max(list_transform(w, lambda x: abs(x))))])"
    out.append(f"pv AS MATERIALIZED (SELECT {', '.join(f'w[{k + 1}] / {norm} * {sign} AS v_{c}' for k, c in enumerate(columns))} FROM pq)")
    return ", ".join(out)


_PC1 = f"""WITH {S}, {_Z}, {principal("z", "qpdt")}, av AS (SELECT avg(q) AS uq, avg(p) AS up, avg(d) AS ud, avg(t) AS ut FROM z),
k AS (SELECT z.*, (q - uq) * v_q + (p - up) * v_p + (d - ud) * v_d + (t - ut) * v_t AS c FROM z, av, pv),
b AS (SELECT {", ".join(f"regr_slope({c}, c) AS b_{c}, regr_intercept({c}, c) AS a_{c}" for c in "qpdt")} FROM k)"""
_PC1_SCORES = f"""{_PC1}, r AS (SELECT image_id, cell_id, {", ".join(f"{c} - a_{c} - b_{c} * c AS {c}" for c in "qpdt")} FROM k, b),
n AS (SELECT {", ".join(f"avg({c}) AS m{c}, stddev_samp({c}) AS s{c}" for c in "qpdt")} FROM r),
o AS (SELECT image_id, cell_id, {", ".join(f"({c} - m{c}) / s{c} AS {c}" for c in "qpdt")} FROM r, n) {_scores("o")}"""
_PC1_PARAMS = f"""{_PC1} SELECT unnest(['QTY', 'PRICE', 'DISC', 'TAX']) AS marker, unnest([{', '.join(f'round(m{c}, 6) + 0.0' for c in 'qpdt')}]) AS median, unnest([{', '.join(f'round(s{c}, 6) + 0.0' for c in 'qpdt')}]) AS mad,
unnest([{', '.join(f'round(v_{c}, 6) + 0.0' for c in 'qpdt')}]) AS rotation, unnest([{', '.join(f'round(b_{c}, 6) + 0.0' for c in 'qpdt')}]) AS slope FROM m, pv, b"""

_FIT_Z = f"""{S}, m AS (SELECT {', '.join(f'median({c}) AS m{c}, coalesce(nullif(1.4826 * mad({c}), 0), 1) AS s{c}' for c in 'qpd')} FROM s),
z AS MATERIALIZED (SELECT {', '.join(f'least(5.0, greatest(-5.0, ({c} - m{c}) / s{c})) AS {c}' for c in 'qpd')} FROM s, m), {principal("z", "qp")}, av AS (SELECT avg(q) AS aq, avg(p) AS ap FROM z)"""


def _fit(space: str, common: str, fitted: str) -> str:
    """Rows (space, parameter, marker, value) of a residual space: lines on the common score, the mean identity residual taken
    off, then centre and deviation."""
    names = {"q": "QTY", "p": "PRICE", "d": "DISC"}
    each = lambda f: ", ".join(f(c) for c in fitted)
    values = {"median": "m{0}", "mad": "s{0}", "slope": "b_{0}", "intercept": "a_{0}", "center": "e_{0}", "scale": "f_{0}"}
    rows = ", ".join(f"('{k}', '{names[c]}', {v.format(c)})" for k, v in values.items() for c in fitted)
    return f"""SELECT '{space}' AS space, parameter, marker, round(value, 6) + 0.0 AS value FROM
(SELECT * FROM m, (SELECT {each(lambda c: f"regr_slope({c}, {common}) AS b_{c}, regr_intercept({c}, {common}) AS a_{c}")} FROM z, pv, av) b,
(SELECT {each(lambda c: f"avg(u_{c} - mean) AS e_{c}, coalesce(nullif(stddev_samp(u_{c} - mean), 0), 1) AS f_{c}")} FROM (SELECT *, (u_q + u_p) / 2.0 AS mean FROM
(SELECT {each(lambda c: f"{c} - a_{c} - b_{c} * ({common}) AS u_{c}")} FROM z, pv, av, (SELECT {each(lambda c: f"regr_slope({c}, {common}) AS b_{c}, regr_intercept({c}, {common}) AS a_{c}")} FROM z, pv, av)))) e) x, LATERAL (VALUES {rows}) t(parameter, marker, value)"""


_FROZEN_FIT = f"""WITH {_FIT_Z} {_fit("identity_space", "(q + p) / 2.0", "qp")} UNION ALL {_fit("panel_space", "(q - aq) * v_q + (p - ap) * v_p", "qpd")}"""

#: Density clusters by all pairs and the closure of links between core points; border points join the cluster whose first
#: core point, in the order of x, y and id, comes first.
_CLUSTERS = f"""WITH RECURSIVE {_PART}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY image_id, x, y, id) AS k FROM pt),
pr AS MATERIALIZED (SELECT a.image_id, a.k AS a, b.k AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM o a JOIN o b ON a.image_id = b.image_id),
n AS (SELECT image_id, count(*) AS n FROM o GROUP BY ALL), kd AS (SELECT image_id, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM pr WHERE a <> b) JOIN n USING (image_id) WHERE r = least(3, n - 1)),
ep AS MATERIALIZED (SELECT image_id, CASE WHEN q IS NULL THEN 8.0 ELSE least(8.0, greatest(4.0, q)) END AS eps FROM n LEFT JOIN (SELECT image_id, quantile_cont(d, 0.95) AS q FROM kd GROUP BY ALL) USING (image_id)),
nb AS MATERIALIZED (SELECT image_id, a, b FROM pr JOIN ep USING (image_id) WHERE d2 <= eps * eps), co AS MATERIALIZED (SELECT a AS k FROM nb GROUP BY a HAVING count(*) >= 4),
ed AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (SELECT k FROM co) AND b IN (SELECT k FROM co)), re AS (SELECT a, b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a),
cl AS MATERIALIZED (SELECT a AS k, min(b) AS c FROM re GROUP BY a), al AS (SELECT k, c FROM cl UNION ALL SELECT b, min(c) FROM nb JOIN cl ON nb.a = cl.k WHERE b NOT IN (SELECT k FROM co) GROUP BY b),
st AS (SELECT image_id, c, count(*) AS n_cells, avg(x) AS cx, avg(y) AS cy FROM al JOIN o USING (k) GROUP BY ALL HAVING count(*) >= 4)
SELECT image_id, printf('E%02d', row_number() OVER (PARTITION BY image_id ORDER BY n_cells DESC, cx, cy, c)) AS structure_id, n_cells, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y FROM st"""

_POOLED = """ev AS (SELECT event_type AS g, user_id % 3 = 0 AS high, value + CASE WHEN user_id % 3 = 0 THEN 300.0 ELSE 0.0 END AS v, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) + CASE WHEN user_id % 3 = 0 THEN 40.0 ELSE 0.0 END AS s FROM events)"""
_WIDTH = "0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd WHEN first <> 0 THEN abs(first) ELSE 1 END * pow(total, -0.2)"


def binned(n: int) -> str:
    """CTE dens (g, k, x, y) of src (g, v) and par (g, h, lo, hi, total): masses on a lattice, smoothed and read off at n places."""
    size = max(512, 1 << (n - 1).bit_length())
    return f"""lat AS MATERIALIZED (SELECT *, lo - 4 * h AS st, (hi - lo + 8 * h) / {size - 1}.0::DOUBLE AS step FROM par),
dl AS MATERIALIZED (SELECT g, c + d AS c, sum(CASE WHEN d = 0 THEN 1 - f ELSE f END) AS m FROM (SELECT g, floor((v - st) / step)::BIGINT AS c, (v - st) / step - floor((v - st) / step) AS f FROM src JOIN lat USING (g)), (VALUES (0), (1)) t(d) WHERE c >= 0 AND c <= {size - 2} GROUP BY ALL),
sm AS MATERIALIZED (SELECT g, j, sum(m * exp(-0.5 * ((j - c) * step / h) * ((j - c) * step / h))) / (total * h * sqrt(2 * pi())) AS y FROM (SELECT * FROM lat, range({size}) r(j)) JOIN dl USING (g) WHERE abs((j - c) * step) <= 39 * h GROUP BY g, j, total, h),
gr AS (SELECT g, k, lo + k * (hi - lo) / {n - 1}.0::DOUBLE AS x, (lo + k * (hi - lo) / {n - 1}.0::DOUBLE - st) / step AS pos FROM lat, range({n}) t(k)),
dens AS MATERIALIZED (SELECT gr.g, k, x, coalesce(a.y, 0) + (pos - floor(pos)) * (coalesce(b.y, 0) - coalesce(a.y, 0)) AS y FROM gr LEFT JOIN sm a ON a.g = gr.g AND a.j = floor(pos)::BIGINT LEFT JOIN sm b ON b.g = gr.g AND b.j = floor(pos)::BIGINT + 1)"""


_CURVE = f"""src AS (SELECT g, v FROM ev WHERE v >= 0), mo AS (SELECT g, count(*) AS total, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(v) AS first, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM src GROUP BY g),
par AS (SELECT g, {_WIDTH} AS h, lo, hi, total FROM mo), {binned(4096)}"""
#: Rows of callable cuts (g, cut), and statuses for the others; a hundred cells are no bound here.
_SIDES = """SELECT image_id, CASE WHEN cut IS NULL THEN 'NOT_CALLABLE_NO_SEPARATION' WHEN least(p, n) < 20 THEN 'NOT_CALLABLE_UNDERPOWERED' ELSE 'CALLABLE' END AS status, CASE WHEN least(p, n) >= 20 THEN round(cut, 6) END AS estimate,
  round(q, 6) AS negative_q99, CASE WHEN cut IS NOT NULL THEN 1.0::DOUBLE END AS auc, coalesce(p, 0)::BIGINT AS n_positive_pool, coalesce(n, 0)::BIGINT AS n_negative_pool
FROM (SELECT e.g AS image_id, any_value(cut) AS cut, count(*) FILTER (v > cut) AS p, count(*) FILTER (v <= cut) AS n, quantile_cont(v, 0.99) FILTER (v <= cut) AS q FROM src e LEFT JOIN cuts USING (g) GROUP BY e.g)"""
_VALLEY = f"""WITH {_POOLED}, {_CURVE}, nb AS (SELECT *, lag(y) OVER w AS b4, lead(y) OVER w AS af, max(y) OVER (PARTITION BY g) AS top FROM dens WINDOW w AS (PARTITION BY g ORDER BY k)),
tp AS (SELECT g, k, y FROM nb WHERE y > b4 AND y > af AND y >= 0.03 * top QUALIFY row_number() OVER (PARTITION BY g ORDER BY y DESC, k) <= 2),
ab AS (SELECT g, min(k) AS a, max(k) AS b, min(y) AS height FROM tp GROUP BY g HAVING count(*) = 2),
lw AS (SELECT g, x, y, height FROM dens JOIN ab USING (g) WHERE k BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY g ORDER BY y, k) = 1),
cuts AS (SELECT g, x AS cut FROM lw WHERE 1 - y / height >= 0.1) {_SIDES}"""
_TAIL = f"""WITH {_POOLED}, {_CURVE}, pk AS (SELECT g, arg_max(k, y) AS top, max(y) AS h FROM dens GROUP BY g), ct AS (SELECT g, first(x ORDER BY k) AS cut FROM dens JOIN pk USING (g) WHERE k > top AND y <= 0.5 * h GROUP BY g),
al AS (SELECT pk.g, dens.x AS peak, coalesce(cut, (SELECT quantile_cont(v, 0.99) FROM src WHERE src.g = pk.g)) AS cut FROM pk JOIN dens ON dens.g = pk.g AND dens.k = pk.top LEFT JOIN ct ON ct.g = pk.g),
sh AS (SELECT g, any_value(cut) AS cut, count(*) FILTER (v > cut) / count(*) AS rt, count(*) FILTER (v < 2 * peak - cut) / count(*) AS lt, count(*) AS n FROM src JOIN al USING (g) GROUP BY g),
cuts AS (SELECT g, cut FROM sh WHERE rt > 0 AND rt >= 1.1 * greatest(lt, 1.0 / n)) {_SIDES}"""


def _mixture(rounds: int) -> str:
    """Rounds of expectation and maximisation as one common table each; deviations are taken around the old means."""
    log = lambda j: f"ln(w{j}) - 0.5 * pow((v - m{j}) / s{j}, 2) - ln(s{j}) - 0.5 * ln(2 * pi())"
    steps = []
    for k in range(rounds):
        shared = f"SELECT g, v, w1, w2, m1, m2, 1 / (1 + exp(({log(2)}) - ({log(1)}))) AS r FROM src JOIN t{k} USING (g)"
        sums = f"SELECT g, count(*) AS n, sum(r) AS r1, sum(1 - r) AS r2, sum(r * (v - m1)) / sum(r) AS d1, sum((1 - r) * (v - m2)) / sum(1 - r) AS d2, sum(r * (v - m1) * (v - m1)) / sum(r) AS q1, sum((1 - r) * (v - m2) * (v - m2)) / sum(1 - r) AS q2, any_value(m1) AS m1, any_value(m2) AS m2 FROM ({shared}) GROUP BY g"
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT g, r1 / n AS w1, r2 / n AS w2, m1 + d1 AS m1, m2 + d2 AS m2, sqrt(q1 - d1 * d1) AS s1, sqrt(q2 - d2 * d2) AS s2 FROM ({sums}))")
    last = f"t{rounds}"
    return f"""WITH {_POOLED}, src AS MATERIALIZED (SELECT g, v FROM ev WHERE v >= 0), mo AS (SELECT g, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM src GROUP BY g),
t0 AS MATERIALIZED (SELECT g, 0.5 AS w1, 0.5 AS w2, any_value(a) AS m1, any_value(b) AS m2, stddev_samp(v) FILTER (v <= a) AS s1, stddev_samp(v) FILTER (v >= b) AS s2 FROM src JOIN mo USING (g) GROUP BY g), {", ".join(steps)},
co AS (SELECT *, 1 / (2 * s1 * s1) - 1 / (2 * s2 * s2) AS a, m2 / (s2 * s2) - m1 / (s1 * s1) AS b, m1 * m1 / (2 * s1 * s1) - m2 * m2 / (2 * s2 * s2) + ln(w2 / s2) - ln(w1 / s1) AS c FROM {last}),
ro AS (SELECT *, CASE WHEN b * b >= 4 * a * c THEN [(-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)] ELSE [] END AS roots FROM co),
cuts AS (SELECT g, list_filter(roots, lambda x: x > m1 AND x < m2)[1] AS cut FROM ro) {_SIDES}"""


#: Densities of two pools over their common range, and where they cross: pools (g, p, v) with p for the upper one.
_CROSS = f"""mo AS (SELECT g, p, count(*) AS total, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, quantile_cont(v, 0.5) AS med, min(v) AS first FROM pools GROUP BY g, p), rg AS (SELECT g, min(v) AS lo, max(v) AS hi FROM pools GROUP BY g),
src AS (SELECT {{'a': g, 'b': p}} AS g, v FROM pools), par AS (SELECT {{'a': mo.g, 'b': p}} AS g, {_WIDTH} AS h, lo, hi, total FROM mo JOIN rg ON mo.g = rg.g), {binned(2048)},
cv AS (SELECT g.a AS g, k, any_value(x) AS x, max(y) FILTER (g.b) AS t, max(y) FILTER (NOT g.b) AS f FROM dens GROUP BY ALL), pk AS (SELECT g, arg_max(k, f) AS top FROM cv GROUP BY g),
cr AS (SELECT g, first(x ORDER BY k) AS crossing FROM cv JOIN pk USING (g) WHERE k > top AND t >= f GROUP BY g),
rk AS (SELECT g, p, rank() OVER w + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM pools WINDOW w AS (PARTITION BY g ORDER BY v)),
ar AS (SELECT g, (sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p)::DOUBLE * count(*) FILTER (NOT p)) AS auc, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn FROM rk GROUP BY g)"""
_POPULATION = f"""WITH {_POOLED}, pools AS MATERIALIZED (SELECT g, high AS p, v FROM ev WHERE v >= 0), {_CROSS}, ng AS (SELECT g, quantile_cont(v, 0.99) AS q FROM pools WHERE NOT p GROUP BY g)
SELECT g AS image_id, 'CALLABLE' AS status, round(greatest(crossing, q), 6) AS estimate, round(crossing, 6) AS crossing, round(q, 6) AS negative_q99, round(greatest(auc, 1 - auc), 6) AS auc, np AS n_positive_pool, nn AS n_negative_pool, '2' AS positive_populations, '1' AS negative_populations
FROM ar JOIN cr USING (g) JOIN ng USING (g) WHERE greatest(auc, 1 - auc) >= 0.65"""
_PARENT = f"""WITH {_POOLED}, pools AS MATERIALIZED (SELECT g, v >= 300 AS p, s AS v FROM ev WHERE s >= 0 AND v >= 0), {_CROSS}
SELECT g AS image_id, 'S' AS marker, 'up' AS parent, CASE WHEN ok THEN 'CALLABLE' ELSE 'NOT_CALLABLE_NO_SEPARATION' END AS status, CASE WHEN ok THEN round(crossing, 6) END AS estimate, round(crossing, 6) AS crossing, round(a, 6) AS auc, np AS n_positive_pool, nn AS n_negative_pool
FROM (SELECT ar.g, greatest(auc, 1 - auc) AS a, crossing, np, nn, crossing IS NOT NULL AND greatest(auc, 1 - auc) >= 0.65 AND (SELECT med FROM mo WHERE mo.g = ar.g AND p) > (SELECT med FROM mo WHERE mo.g = ar.g AND NOT p) AS ok FROM ar LEFT JOIN cr USING (g))"""

SQL = {
    "state_parent_crossing": f"""WITH {S}, pools AS MATERIALIZED (SELECT image_id AS g, asinh(q / 5) >= 2.3 AS p, asinh(p / 5) AS v FROM s), {_CROSS}
SELECT g AS image_id, 'PRICE' AS marker, 'big' AS parent, CASE WHEN ok THEN 'CALLABLE' ELSE 'NOT_CALLABLE_NO_SEPARATION' END AS status, CASE WHEN ok THEN round(crossing, 6) END AS estimate, round(a, 6) AS auc, np AS n_positive_pool, nn AS n_negative_pool
FROM (SELECT ar.g, greatest(auc, 1 - auc) AS a, crossing, np, nn, crossing IS NOT NULL AND greatest(auc, 1 - auc) >= 0.65 AND (SELECT med FROM mo WHERE mo.g = ar.g AND p) > (SELECT med FROM mo WHERE mo.g = ar.g AND NOT p) AS ok FROM ar LEFT JOIN cr USING (g))""",
    "correct_pc1": _PC1_SCORES,
    "correction_params": _PC1_PARAMS,
    "frozen_fit_params": _FROZEN_FIT,
    "spatial_structures": _CLUSTERS,
    "threshold_valley_pools": _VALLEY,
    "threshold_tail_pools": _TAIL,
    "threshold_mixture_pools": _mixture(20),
    "threshold_population_pools": _POPULATION,
    "state_parent_pools": _PARENT,
    "signal_select": f"WITH {S} SELECT image_id, cell_id, CASE WHEN q - 25 >= 0 THEN q - 25 ELSE q END AS raw_qty, CASE WHEN q - 25 >= 0 THEN 1 ELSE 2 END AS src_qty, d AS raw_disc FROM s",
    "transform_scores": f"WITH {S} SELECT image_id, cell_id, round(asinh(q / 5), 6) AS score_qty, round(asinh(p / 5), 6) AS score_price, round(d, 6) AS score_disc, round(ln(1 + t), 6) AS score_tax FROM s",
    "localization_ratio": f"WITH {S} SELECT image_id, cell_id, round((d + 1e-9) / (t + 1e-9), 3) AS ratio, true AS located FROM s",
    "image_filter": f"WITH {S} SELECT image_id, count(*) AS n, round(avg(asinh(q / 5)), 6) AS mean_qty FROM s WHERE image_id IN ('AF', 'RF') GROUP BY image_id",
    "callability": support(_LONG, "0.2 AS mu, 20 AS mc"),
    "callability_unavailable": support("SELECT c_mktsegment AS image_id, 'BAL' AS marker, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer", "0.09 AS mu, 20 AS mc"),
    "callability_underpowered": support("SELECT p_brand AS image_id, unnest(['SIZE', 'RETAIL']) AS marker, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part", "0.2 AS mu, 100 AS mc", "CASE marker WHEN 'SIZE' THEN 'identity' ELSE 'context' END"),
    "support_of_events": support("SELECT event_type AS image_id, 'VALUE' AS marker, CASE WHEN value >= 0 THEN value END AS v FROM events", "0.2 AS mu, 20 AS mc"),
    "correct_none": f"WITH {S}, x AS (SELECT image_id, cell_id, asinh(q / 5) AS q, asinh(p / 5) AS p, d, t FROM s) {_scores('x')}",
    "correct_robust_z": f"WITH {S}, {_Z} {_scores('z')}",
    "correct_common_score": _COMMON,
    "frozen_apply": _FROZEN,
    "auc_rank": """WITH r AS (SELECT event_type, user_id % 2 = 0 AS pos, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)), 6) AS auc, count(*) FILTER (pos) AS n_positive, count(*) FILTER (NOT pos) AS n_negative FROM r GROUP BY event_type""",
    "density_grid": f"WITH {density(_EVENTS, 64)} SELECT g AS event_type, k::INTEGER AS k, round(x, 6) AS x, round(density, 8) AS density FROM dens",
    "density_modes": f"""WITH {density(_EVENTS, 64)}, w AS (SELECT *, lag(density) OVER v AS a, lead(density) OVER v AS b, max(density) OVER (PARTITION BY g) AS top FROM dens WINDOW v AS (PARTITION BY g ORDER BY k))
SELECT g AS event_type, k::INTEGER AS k, round(density, 8) AS density, row_number() OVER (PARTITION BY g ORDER BY density DESC, k)::INTEGER AS rank FROM w WHERE density > a AND density > b AND density >= 0.03 * top""",
    "crossing": """WITH b AS (SELECT event_type AS g, user_id % 3 = 0 AS p, value AS v FROM events), q AS (SELECT g, p, count(*) AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM b GROUP BY g, p),
h AS (SELECT g, p, n, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM q), s AS (SELECT g, min(v) AS lo, max(v) AS hi FROM b GROUP BY g),
x AS (SELECT g, k, lo + k * (hi - lo) / 63.0 AS x FROM s, range(64) r(k)), w AS (SELECT g, p, v, count(*) AS w FROM b GROUP BY ALL),
d AS (SELECT x.g, x.k, x.x, w.p, sum(w * exp(-0.5 * ((x.x - v) / h) * ((x.x - v) / h)) / (n * h)) AS y FROM x JOIN w ON x.g = w.g JOIN h ON h.g = w.g AND h.p = w.p GROUP BY ALL),
c AS (SELECT g, k, x, max(y) FILTER (p) AS t, max(y) FILTER (NOT p) AS f FROM d GROUP BY g, k, x), m AS (SELECT g, arg_max(k, f) AS top FROM c GROUP BY g)
SELECT s.g AS event_type, round((SELECT min(x) FROM c JOIN m USING (g) WHERE c.g = s.g AND k > top AND t >= f), 6) AS crossing FROM s""",
    "mixture_em_step": """WITH q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a2, stddev_samp(value) AS sd0 FROM events GROUP BY ALL),
o AS (SELECT q.g, a1, a2, stddev_samp(value) FILTER (value <= a1) AS x1, stddev_samp(value) FILTER (value >= a2) AS x2, sd0 FROM events JOIN q ON event_type = g GROUP BY ALL),
s AS (SELECT g, a1, a2, CASE WHEN x1 > 0 THEN x1 ELSE greatest(sd0 / 2, 1e-6) END AS d1, CASE WHEN x2 > 0 THEN x2 ELSE greatest(sd0 / 2, 1e-6) END AS d2 FROM o),
r AS (SELECT g, value AS v, 1 / (1 + exp(-0.5 * pow((value - a2) / d2, 2) - ln(d2) + 0.5 * pow((value - a1) / d1, 2) + ln(d1))) AS r FROM events JOIN s ON event_type = g),
m AS (SELECT g, avg(r) AS w1, avg(1 - r) AS w2, sum(r * v) / sum(r) AS m1, sum((1 - r) * v) / sum(1 - r) AS m2 FROM r GROUP BY g)
SELECT r.g AS event_type, round(w1, 6) AS w1, round(w2, 6) AS w2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(sqrt(sum(r * pow(v - m1, 2)) / sum(r)), 6) AS s1, round(sqrt(sum((1 - r) * pow(v - m2, 2)) / sum(1 - r)), 6) AS s2 FROM r JOIN m ON r.g = m.g GROUP BY r.g, w1, w2, m1, m2""",
    "threshold_manual": f"""WITH {S} SELECT image_id, marker, 'identity' AS role, 'manual' AS method, 'MANUAL' AS status, estimate, 'manual' AS rule, '{{"value":' || txt || '}}' AS args_json, 0::BIGINT AS n_positive_pool
FROM (SELECT DISTINCT image_id FROM s) CROSS JOIN (VALUES ('QTY', 2.3::DOUBLE, '2.3'), ('PRICE', 9.2, '9.2'), ('DISC', 0.05, '0.05'), ('TAX', 0.04, '0.04')) v(marker, estimate, txt)""",
    "population_pools": """WITH e AS (SELECT label, embedding[1]::DOUBLE + 1 AS v FROM embeddings), a AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM e)
SELECT label, round(mean, 6) AS mean, n, mean > m + 0.5 * s AS positive, mean < m AS negative FROM (SELECT label, avg(v) AS mean, count(*) AS n FROM e GROUP BY label), a""",
    "threshold_coverage": "SELECT 'NO' AS image_id, 'TAX' AS marker, 0::BIGINT AS n FROM (SELECT 1 FROM lineitem WHERE l_returnflag || l_linestatus = 'NO' LIMIT 1)",
    "effective_overrides": f"""WITH {S} SELECT image_id, marker, CASE WHEN image_id = 'AF' AND marker = 'QTY' THEN 2.9 ELSE estimate END AS estimate FROM (SELECT DISTINCT image_id FROM s) CROSS JOIN (VALUES ('QTY', 2.3::DOUBLE), ('PRICE', 9.2), ('DISC', 0.05), ('TAX', 0.04)) v(marker, estimate)""",
    "marker_calls": f"WITH {C} SELECT image_id, cell_id, cq AS call_qty, cp AS call_price, cd AS call_disc, ct AS call_tax FROM c",
    "classify_cells": f"WITH {C} SELECT image_id, cell_id, cell_type, rule_id, coalesce(rule_id = 'R2', false) AS pending_review, cd AND ct AS both, false AS excluded FROM l",
    "cell_flags": f"""WITH {C} SELECT image_id, cell_id, cd AND ct AS both, cp AND NOT ct AS "any", cq AS q, CASE WHEN cd AND ct THEN 'Excluded' WHEN cq THEN 'Unresolved' WHEN cd OR ct THEN 'Discounted' ELSE 'Undefined' END AS cell_type, cd AND ct AS excluded FROM c""",
    "disabled_rules": f"WITH {S} SELECT DISTINCT image_id, 'R3' AS rule_id, 'Discounted' AS label, 'A marker that the rule needs cannot be called on the image.' AS reason, 'TAX' AS markers FROM s",
    "classify_uncallable": summary(f"{S}, l AS (SELECT image_id, CASE WHEN asinh(q / 5) >= 2.3 AND asinh(p / 5) >= 9.2 THEN 'Both' WHEN asinh(q / 5) >= 2.3 AND NOT d >= 0.05 THEN 'Pending' ELSE 'Undefined' END AS cell_type FROM s)"),
    "classification_summary": summary(C),
    "fixed_threshold_calls": f"WITH {S} SELECT image_id, cell_id, CASE WHEN q >= 25 THEN 'HIGH' ELSE 'LOW' END AS qty, 'UNAVAILABLE' AS price, CASE WHEN d >= 0.05 THEN 'HIGH' ELSE 'LOW' END AS disc FROM s",
    "fixed_signal_calls": f"WITH {S} SELECT image_id, cell_id, CASE WHEN q - 25 >= 0 THEN CASE WHEN (q - 25) / 5 >= 3 THEN 'HIGH' ELSE 'LOW' END WHEN q < 5 THEN 'UNAVAILABLE' WHEN q / 5 >= 3 THEN 'HIGH' ELSE 'LOW' END AS call_qty FROM s",
    "candidate_rules": f"""WITH {S} SELECT image_id, cell_id, CASE WHEN q >= 25 AND p < 40000 THEN 'Odd' WHEN p >= 40000 OR q < 25 THEN 'Either' WHEN q >= 25 THEN 'High' ELSE 'None' END AS label, CASE WHEN q >= 25 AND p < 40000 THEN 'c' WHEN p >= 40000 OR q < 25 THEN 'b' WHEN q >= 25 THEN 'a' END AS rule_id, false AS review_authorized, false AS production_eligible FROM s""",
    "state_diagnostics": f"""WITH {S}, b AS (SELECT image_id, cell_id, q, CASE WHEN d > 0.02 THEN d END AS d, t, CASE WHEN t > 0 THEN t > 0.02 END AS parent FROM s),
u AS (SELECT *, state, CASE state WHEN 'Q' THEN true WHEN 'N' THEN true WHEN 'D' THEN d IS NOT NULL ELSE d IS NOT NULL END AS m, state <> 'N' AS th, CASE state WHEN 'Q' THEN q >= 25 WHEN 'D' THEN d >= 0.05 WHEN 'L' THEN q >= 10 AND (d + 1e-9) / (t + 1e-9) >= 1.5 END AS up FROM b, (VALUES ('Q'), ('D'), ('N'), ('L')) v(state)),
a AS (SELECT *, (CASE WHEN m THEN up WHEN state = 'D' THEN NULL ELSE false END) AND parent AND th AS audit FROM u)
SELECT image_id, cell_id, state, audit AS audit_positive, m AS measurement_evaluable, parent AS parent_eligible, th AS threshold_available, CASE WHEN NOT m THEN 'UNAVAILABLE_MEASUREMENT_OR_LOCALIZATION' WHEN NOT th THEN 'UNAVAILABLE_THRESHOLD' WHEN NOT coalesce(parent, false) THEN 'PARENT_INELIGIBLE_OR_UNKNOWN' ELSE 'EVALUABLE_RULE_ONLY' END AS diagnostic_status,
  CASE WHEN m AND coalesce(parent, false) AND th THEN audit END AS nullable_positive, false AS review_authorized, false AS production_eligible FROM a""",
    "state_calls_manual": f"WITH {T} SELECT image_id, cell_id, marker, parent, in_parent, evaluable, score, estimate::DOUBLE AS estimate, round(ratio, 3) AS localization_ratio, in_parent AND ratio >= 1.0 AND score >= 0.04 AS positive, false AS enabled FROM st",
    "state_calls_completeness": f"WITH {T} SELECT image_id, marker, parent, count(*) AS missing FROM st WHERE score = 0.07 GROUP BY ALL",
    "neighbour_counts": f"WITH {_PART} SELECT a.image_id, a.id, count(*) AS n FROM pt a JOIN pt b ON a.image_id = b.image_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400 GROUP BY ALL",
    "structure_eps": f"""WITH {_PART}, d AS (SELECT a.image_id, a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pt a JOIN pt b ON a.image_id = b.image_id AND a.id <> b.id),
n AS (SELECT image_id, count(*) AS n FROM pt GROUP BY ALL), k AS (SELECT image_id, id, d FROM (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY d) AS r FROM d) JOIN n USING (image_id) WHERE r = least(3, n - 1))
SELECT image_id, round(CASE WHEN q IS NULL THEN 30.0 ELSE least(30.0, greatest(1.0, q)) END, 6) AS eps FROM n LEFT JOIN (SELECT image_id, quantile_cont(d, 0.95) AS q FROM k GROUP BY ALL) USING (image_id)""",
    "structure_stats": f"""WITH {_PART}, c AS (SELECT *, floor(x)::BIGINT % 3 AS cluster FROM pt), g AS (SELECT image_id, cluster, count(*) AS n_cells, avg(x) AS cx, avg(y) AS cy, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM c GROUP BY ALL)
SELECT image_id, cluster, printf('E%02d', row_number() OVER (PARTITION BY image_id ORDER BY n_cells DESC, cx, cy, cluster)) AS structure_id, n_cells, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, xmin, xmax, ymin, ymax FROM g""",
    "basin_assign": f"""WITH u AS (SELECT p_partkey AS id, (p_partkey % 2100)::DOUBLE AS u1, (p_size * 40)::DOUBLE AS u2 FROM part), r AS (SELECT *, nullif({_BASINS}[(least(4, floor(u1 / 500)) + 1)::INTEGER][(least(4, floor(u2 / 500)) + 1)::INTEGER], 0) AS raw_population FROM u),
n AS (SELECT raw_population, count(*) AS n FROM r WHERE raw_population IS NOT NULL GROUP BY ALL), k AS (SELECT raw_population, row_number() OVER (ORDER BY raw_population)::INTEGER AS population FROM n WHERE n >= 300 OR (SELECT max(n) FROM n) < 300 AND raw_population = (SELECT raw_population FROM n ORDER BY n DESC, raw_population LIMIT 1))
SELECT id, raw_population::INTEGER AS raw_population, population FROM r LEFT JOIN k USING (raw_population)""",
    "active_ledger": f"WITH {_LEDGER} SELECT image_id, count(*) AS n, sum(o)::BIGINT AS orders FROM act GROUP BY image_id",
    "effective_cuts": f"WITH {_LEDGER} SELECT image_id, marker, max_by(entry_id, o) AS entry_id, max_by(value, o) AS estimate FROM act GROUP BY image_id, marker",
    "dispositions": f"WITH {boxes(60, str(['EXCLUDE', 'DELETE', 'RESTORE']))} SELECT image_id, coalesce(v, 'NONE') AS disposition, count(*) AS n FROM h GROUP BY ALL",
    "structure_decisions": f"WITH {boxes(300, str(['Tumor', 'Benign', 'Unresolved']))} SELECT image_id, coalesce(v, 'none') AS decision, count(*) AS n FROM h GROUP BY ALL",
    "replay_cells": f"""WITH {_REPLAY} SELECT k.image_id, k.cell_id, CASE WHEN t1 = 'Both' AND analysed AND enabled AND positive THEN 'Both taxed' ELSE t1 END AS cell_type, base_cell_type, rule_id, coalesce(pending_review, false) AS pending_review, structure_decision, disposition_effective, analysed FROM k JOIN rp ON k.image_id = rp.image_id AND k.cell_id = rp.cell_id AND parent = 'big'""",
    "replay_states": f"WITH {_REPLAY} SELECT image_id, 'TAX' AS marker, parent, enabled, estimate::DOUBLE AS estimate, count(*) FILTER (in_parent) AS n_in_parent, count(*) FILTER (positive) AS n_positive FROM rp GROUP BY ALL",
    "refinements": f"WITH {_REPLAY} SELECT k.image_id, count(*) AS n FROM k JOIN rp ON k.image_id = rp.image_id AND k.cell_id = rp.cell_id AND parent = 'big' WHERE t1 = 'Both' AND analysed AND enabled AND positive GROUP BY ALL",
    "imported_cuts": f"""WITH {S}, l AS (SELECT image_id, CASE WHEN d >= 0.05 AND t >= 0.04 THEN 'Unresolved' WHEN cq AND asinh(p / 5) >= 9.2 THEN 'Both' WHEN cq AND NOT d >= 0.05 THEN 'Pending' WHEN d >= 0.05 OR t >= 0.04 THEN 'Discounted' ELSE 'Undefined' END AS cell_type FROM (SELECT *, asinh(q / 5) >= CASE WHEN image_id IN ('AF', 'NF') THEN 2.9 WHEN image_id = 'NO' THEN 1.2 ELSE 2.3 END AS cq FROM s)),
n AS (SELECT image_id, cell_type, count(*) AS k FROM l GROUP BY ALL) SELECT i.image_id, y.cell_type, coalesce(k, 0)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM l) i CROSS JOIN (SELECT DISTINCT cell_type FROM l) y LEFT JOIN n USING (image_id, cell_type)""",
    "dotplot_means": f"WITH {C} SELECT image_id, marker, cell_type, round(avg(v), 6) AS mean_score, count(v) AS n_observed FROM (SELECT image_id, cell_type, unnest(['QTY', 'PRICE', 'DISC', 'TAX']) AS marker, unnest([asinh(q / 5), asinh(p / 5), d, t]) AS v FROM l) GROUP BY ALL",
    "state_histogram": f"""WITH {T}, r AS (SELECT min(score) AS lo, max(score) AS hi FROM st)
SELECT marker, parent, in_parent AND ratio >= 1.0 AND score >= 0.04 AS positive, least(10, floor((score - lo) / (hi - lo) * 10)::INTEGER + 1) AS bin, count(*) AS n FROM st, r GROUP BY ALL""",
    "density_view": f"WITH ev AS (SELECT ln(1 + value) AS v FROM events WHERE value >= 0 AND event_type = (SELECT min(event_type) FROM events)), {_VIEW} SELECT g AS pool, k::INTEGER AS k, round(x, 6) AS x, round(density, 8) AS density, 1.5::DOUBLE AS cut FROM dens",
    "map_view": f"WITH {C} SELECT image_id, cell_id, x, y, cell_type AS label FROM l WHERE image_id = 'AF'",
    "verified_export": "SELECT unnest(['manifest', 'sealed', 'paths', 'unique', 'missing', 'added', 'content', 'tables', 'identity', 'status', 'ledgers', 'deleted_not_analysed', 'replay']) AS \"check\", true AS ok, '' AS details",
    "verify_exceptall": f"WITH {C} SELECT 'lost' AS side, cell_type, count(*) AS n FROM l WHERE image_id = 'AF' GROUP BY ALL UNION ALL SELECT 'new', 'Changed', count(*) FROM l WHERE image_id = 'AF'",
}
