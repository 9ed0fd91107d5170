"""Common table expressions that the queries' SQL is put together from."""

_PARTS = {
    "r": "r AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS g FROM events)",
    "sw": "sw AS (SELECT min(ts) AS switch_ts FROM events WHERE event_type = 'signup' AND value > 200)",
    "mo": "mo AS (SELECT 'manual' AS mode, r.* FROM r, sw WHERE ts <= switch_ts UNION ALL SELECT 'auto' AS mode, r.* FROM r, sw WHERE ts >= switch_ts)",
    "m0": r"m0 AS (SELECT event_id AS wid, user_id, ts, value AS carbs, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) / 10 AS bolus FROM events WHERE event_type = 'purchase' AND value > 0)",
    "m": "m AS (SELECT wid, user_id, ts, carbs, bolus FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, wid) AS nxt FROM m0) WHERE nxt IS NULL OR nxt >= ts + INTERVAL 4 HOUR)",
    "w": "w AS (SELECT m.wid, any_value(m.user_id) AS user_id, any_value(carbs) AS carbs, any_value(bolus) AS bolus, count(*) AS n_rows, (list(g ORDER BY r.ts, event_id))[1:30] AS v FROM m JOIN r ON r.ts >= m.ts - INTERVAL 30 MINUTE AND r.ts <= m.ts + INTERVAL 2 HOUR GROUP BY m.wid)",
    "nw": "nw AS (SELECT m.wid, any_value(m.user_id) AS user_id, count(*) AS n_rows, (list(g ORDER BY r.ts, event_id))[1:24] AS v FROM m JOIN r ON r.ts >= m.ts + INTERVAL 2 HOUR AND r.ts <= m.ts + INTERVAL 4 HOUR GROUP BY m.wid)",
    "wc": "wc AS (SELECT * FROM w WHERE n_rows >= 30)",
    "im": "im AS (SELECT wid, user_id, carbs, bolus, list_transform(v, lambda x: coalesce(x, (coalesce(list_sum(v), 0) + carbs) / (len(list_filter(v, lambda y: y IS NOT NULL)) + 1))) AS v FROM wc)",
    "ni": "ni AS (SELECT wid, user_id, list_transform(v, lambda x: coalesce(x, list_sum(v) / len(list_filter(v, lambda y: y IS NOT NULL)))) AS v FROM nw WHERE n_rows >= 24)",
    "s": "s AS (SELECT *, list_transform(v, lambda x, i: CASE WHEN i = 1 THEN 0e0 ELSE coalesce(x - v[i - 1], 0e0) END) AS s FROM im)",
    "z": "z AS (SELECT *, list_filter(range(0, len(s)), lambda i: i = len(s) - 1 OR sign(s[i + 1]) <> sign(s[i + 2])) AS z FROM s)",
    "q": """q AS (SELECT *, list_transform(list_filter(range(0, len(z)), lambda k: k >= 2 AND k < len(z) - 1), lambda k: {'slot': z[k + 1], 'dist':
      CASE WHEN s[z[k + 1] + 1] < 0 THEN list_max(s[z[k + 1] + 1 : z[k + 2] + 1]) - list_min(s[z[k] + 1 : z[k + 1] + 1])
      ELSE list_max(s[z[k] + 1 : z[k + 1] + 1]) - list_min(s[z[k + 1] + 1 : z[k + 2] + 1]) END}) AS sw FROM z)""",
    "t": "t AS (SELECT *, list_sort(list_transform(sw, lambda x: {'key': -round(x.dist, 6), 'slot': x.slot, 'dist': x.dist}))[1:3] AS top FROM q)",
    "c": "c AS (SELECT *, list_transform(v, lambda x: x - list_sum(v) / len(v)) AS c FROM t)",
    "y": "y AS (SELECT *, list_transform(range(0, 30), lambda k: round(abs(list_sum(list_transform(c, lambda x, j: x * CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN cos(2 * pi() * (((j - 1) * ((k + 1) // 2)) % 30) / 30) ELSE sin(2 * pi() * (((j - 1) * (k // 2)) % 30) / 30) END))), 6)) AS y FROM c)",
    "p": "p AS (SELECT *, list_reverse_sort(list_transform(list_filter(range(2, len(y) + 1), lambda i: y[i - 1] < y[i] AND coalesce(list_filter(y[i + 1 :], lambda u: u <> y[i])[1] < y[i], false)), lambda i: y[i]))[1:3] AS pk FROM y)",
    "f": """f AS (SELECT wid, user_id, carbs, list_max(v) - list_min(v) AS f1_range,
      top[1].dist AS f2_dist_1, CAST(top[1].slot AS DOUBLE) AS f2_slot_1, top[2].dist AS f2_dist_2, CAST(top[2].slot AS DOUBLE) AS f2_slot_2, top[3].dist AS f2_dist_3, CAST(top[3].slot AS DOUBLE) AS f2_slot_3,
      CAST(abs(list_position(v, list_max(v)) - list_position(v, list_min(v))) AS DOUBLE) AS f3_slots, pk[1] AS f4_peak_1, pk[2] AS f4_peak_2, pk[3] AS f4_peak_3,
      list_max(s) AS f5_max_slope, 5e0 * (list_position(v, list_max(v)) - 1) AS f6_minutes FROM p)""",
    "fv": "fv AS (SELECT * FROM f WHERE f2_dist_3 IS NOT NULL AND f4_peak_3 IS NOT NULL)",
    "cl": "cl AS (SELECT *, CAST(wid % 6 AS INT) AS cluster, CAST(trunc((carbs - (SELECT min(carbs) FROM fv)) / 20) AS INT) AS bin FROM fv)",
    "cm": "cm AS (SELECT cluster, bin, count(*) AS cnt FROM cl GROUP BY cluster, bin)",
    "sh": "sh AS (SELECT *, sum(cnt) OVER (PARTITION BY cluster) AS n_c, cnt / sum(cnt) OVER (PARTITION BY cluster) AS p FROM cm)",
    "o": "o AS (SELECT min(least(list_min(v), bolus)) AS low, max(greatest(list_max(v), bolus)) AS high FROM wc)",
    "tx": "tx AS (SELECT wid, 'b_max_' || CAST(trunc((list_max(v) - low) / 20) AS INT) AS b_max, 'b_meal_' || CAST(trunc((v[11] - low) / 20) AS INT) AS b_meal, 'insulin_bolus_' || CAST(round_even(bolus, 0) AS INT) AS insulin_bolus FROM wc, o WHERE list_max(v) IS NOT NULL AND v[11] IS NOT NULL AND bolus IS NOT NULL)",
    "it": "it AS (SELECT array_to_string(list_sort(list_filter([b_max, b_meal, insulin_bolus], lambda x: x IS NOT NULL)), ',') AS items, list_sort(list_filter([b_max, b_meal, insulin_bolus], lambda x: x IS NOT NULL)) AS its, count(*) AS cnt, count(*) / (SELECT count(*) FROM tx)::DOUBLE AS support, grouping(b_max, b_meal, insulin_bolus) AS gid FROM tx GROUP BY CUBE (b_max, b_meal, insulin_bolus) HAVING grouping(b_max, b_meal, insulin_bolus) < 7 AND count(*) >= 0.005 * (SELECT count(*) FROM tx))",
    "ru": """ru AS (SELECT a.items AS antecedent, a.its AS ante, c.items AS consequent, c.its AS cons, a.support AS antecedent_support, c.support AS consequent_support, w.support, w.support / a.support AS confidence
      FROM it w JOIN it a ON len(a.its) < len(w.its) AND list_has_all(w.its, a.its) JOIN it c ON len(c.its) = len(w.its) - len(a.its) AND list_has_all(w.its, c.its) AND NOT list_has_any(a.its, c.its) WHERE w.support / a.support >= 0.0004)""",
    "rf": "rf AS (SELECT * FROM ru WHERE len(ante) = 2 AND len(list_filter(ante, lambda x: contains(x, 'insulin'))) = 0)",
}
_NEEDS = {
    "mo": "r sw", "m": "m0", "w": "r m", "nw": "r m", "wc": "w", "im": "wc", "ni": "nw", "s": "im", "z": "s", "q": "z", "t": "q", "c": "t", "y": "c", "p": "y", "f": "p", "fv": "f", "cl": "fv", "cm": "cl", "sh": "cm", "o": "wc", "tx": "wc o", "it": "tx", "ru": "it", "rf": "ru",
}


def sql(names: str, select: str, *more: str) -> str:
    """``select`` over the named expressions and all that they need."""
    found: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, "").split():
            add(other)
        if name not in found:
            found.append(name)

    for name in names.split():
        add(name)
    ctes = [*(_PARTS[n] for n in found), *more]
    return f"WITH {', '.join(ctes)} {select}" if ctes else select
