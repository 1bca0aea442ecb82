"""DuckDB SQL for every query that SQL can express, composed of named common table expressions."""

from __future__ import annotations

import re

from dosepath.schemas import FEATURES, PHENOTYPES, STATES, WINDOWS

#: name -> SQL; a CTE may use any other by name.
CTES: dict[str, str] = {
    "ship": """SELECT o_custkey::BIGINT AS person_id, l_partkey::BIGINT AS part, l_quantity, l_returnflag, l_linenumber,
        l_shipdate::DATE AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "drug_exposure": """SELECT person_id, part AS drug_concept_id, d AS s,
        CASE WHEN l_returnflag = 'A' THEN d + (3 * l_quantity)::INTEGER - 1 END AS e,
        CASE WHEN l_linenumber <> 7 THEN (3 * l_quantity)::INTEGER END AS days_supply FROM ship""",
    "ingredient": """SELECT DISTINCT (1000000 + dense_rank() OVER (ORDER BY p_type))::BIGINT AS ingredient_concept_id, p_type AS concept_name FROM part""",
    "imputed": """SELECT person_id, drug_concept_id, s, coalesce(e, CASE WHEN days_supply > 0 THEN s + days_supply - 1 END, s) AS e FROM drug_exposure
        WHERE coalesce(e, CASE WHEN days_supply > 0 THEN s + days_supply - 1 END, s) >= s""",
    "mapping": """SELECT p_partkey::BIGINT AS drug_concept_id, ingredient_concept_id FROM part JOIN ingredient ON p_type = concept_name
        UNION SELECT ingredient_concept_id, ingredient_concept_id FROM ingredient""",
    "exposed": "SELECT person_id, ingredient_concept_id, s, e FROM imputed JOIN mapping USING (drug_concept_id)",
    "deduped": "SELECT person_id, ingredient_concept_id, s, max(e) AS e FROM exposed GROUP BY ALL",
    "era": """SELECT person_id, ingredient_concept_id, min(s) AS era_start_date, max(e) AS era_end_date, count(*) AS drug_exposure_count, 30::BIGINT AS gap_days FROM (
        SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, ingredient_concept_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY person_id, ingredient_concept_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM deduped))
        GROUP BY person_id, ingredient_concept_id, island""",
    "raw_era": """SELECT person_id, drug AS ingredient_concept_id, min(s) AS era_start_date, max(e) AS era_end_date, count(*) AS drug_exposure_count, 0::BIGINT AS gap_days FROM (
        SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, drug ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY person_id, drug ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
        FROM (SELECT person_id, drug_concept_id AS drug, s, coalesce(e, s) AS e FROM drug_exposure))) GROUP BY person_id, drug, island""",
    "first_ship": "SELECT person_id, min(d) AS f FROM ship GROUP BY 1",
    "observed": """SELECT person_id, f - (200 * (person_id % 4))::INTEGER AS os, f + 1000 - (100 * (person_id % 7))::INTEGER AS oe FROM first_ship
        UNION ALL SELECT person_id, f - 800, f + 400 FROM first_ship WHERE person_id % 10 = 0""",
    "death": """SELECT person_id, f + (300 + person_id % 400)::INTEGER AS death_date FROM first_ship WHERE person_id % 13 = 0
        UNION ALL SELECT person_id, f + (310 + person_id % 400)::INTEGER FROM first_ship WHERE person_id % 26 = 0""",
    "died": "SELECT person_id, min(death_date) AS death_date FROM death GROUP BY 1",
    "first_era": "SELECT person_id, min(era_start_date) AS index_date FROM era GROUP BY 1",
    "candidate": "SELECT person_id, index_date, os, oe FROM first_era JOIN observed USING (person_id) WHERE index_date BETWEEN os AND oe AND index_date - os >= 365",
    "picked": "SELECT person_id, index_date, os, oe FROM candidate QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY oe DESC, os) = 1",
    "horizon": "SELECT *, (index_date + INTERVAL 24 MONTH)::DATE - 1 AS last_day FROM picked",
    "alive": "SELECT person_id, index_date, os, oe, least(oe, last_day) AS censor_date FROM horizon WHERE least(oe, last_day) >= index_date",
    "eligible": """SELECT person_id, index_date, os, oe, death_date, least(oe, last_day, coalesce(death_date, DATE '2100-01-01')) AS censor_date
        FROM horizon LEFT JOIN died USING (person_id) WHERE least(oe, last_day, coalesce(death_date, DATE '2100-01-01')) >= index_date""",
    "clip": """SELECT person_id, ingredient_concept_id, greatest(era_start_date, index_date) AS s, least(era_end_date, censor_date) AS e, drug_exposure_count, gap_days,
        era_end_date > censor_date AS clipped_at_censor, index_date, censor_date FROM era JOIN eligible USING (person_id) WHERE era_start_date <= censor_date AND era_end_date >= index_date""",
    "grid": """SELECT person_id, m::INTEGER AS month_index, (index_date + to_months((m - 1)::INTEGER))::DATE AS ms, least((index_date + to_months(m::INTEGER))::DATE - 1, censor_date) AS me
        FROM eligible, range(1, 25) t(m) WHERE (index_date + to_months((m - 1)::INTEGER))::DATE <= censor_date""",
    "overlap": """SELECT g.person_id, g.month_index, c.ingredient_concept_id, CASE WHEN c.s BETWEEN ms AND me THEN 1 ELSE 0 END AS started_flag,
        CASE WHEN c.e BETWEEN ms AND me AND NOT c.clipped_at_censor THEN 1 ELSE 0 END AS stopped_flag
        FROM grid g LEFT JOIN clip c ON g.person_id = c.person_id AND c.s <= me AND c.e >= ms""",
    "burden": """SELECT person_id, month_index, count(DISTINCT ingredient_concept_id) AS active_n, sum(started_flag)::BIGINT AS starts_n, sum(stopped_flag)::BIGINT AS stops_n,
        coalesce(list_sort(list(DISTINCT ingredient_concept_id) FILTER (ingredient_concept_id IS NOT NULL)), []::BIGINT[]) AS active_set FROM overlap GROUP BY 1, 2""",
    "lagged": """SELECT *, coalesce(lag(active_n) OVER w, 0) AS prev_active_n, coalesce(lag(active_set) OVER w, []::BIGINT[]) AS prev_set FROM burden WINDOW w AS (PARTITION BY person_id ORDER BY month_index)""",
    "moved": """SELECT *, CASE WHEN len(list_distinct(list_concat(active_set, prev_set))) = 0 THEN 0.0::DOUBLE
        ELSE 1 - len(list_intersect(active_set, prev_set))::DOUBLE / len(list_distinct(list_concat(active_set, prev_set))) END AS turnover FROM lagged""",
    "month": """SELECT *, CASE WHEN active_n = 0 THEN 'NoRx' WHEN prev_active_n = 0 THEN 'Initiation'
        WHEN active_n = 1 AND turnover < 0.2 AND starts_n = 0 AND stops_n = 0 THEN 'StableMono' WHEN active_n BETWEEN 2 AND 2 AND turnover < 0.2 THEN 'StableLowPoly'
        WHEN active_n >= 3 AND turnover < 0.2 THEN 'StablePolypharmacy' WHEN starts_n > 0 AND stops_n > 0 AND turnover >= 0.5 THEN 'HighTurnover'
        WHEN active_n > prev_active_n AND starts_n > 0 THEN 'Intensifying' WHEN active_n < prev_active_n AND stops_n > 0 THEN 'Deintensifying' ELSE 'ModerateFlux' END AS state FROM moved""",
    "tier": """SELECT *, CASE WHEN maintenance_tier = 'ineligible' THEN 0 ELSE 1 END AS maintenance_eligible FROM (SELECT *, CASE WHEN n_eras = 1 AND total_era_days >= 180 THEN 'A_single_long'
        WHEN n_eras >= 2 AND total_era_days >= 56 THEN 'B_multi_era' ELSE 'ineligible' END AS maintenance_tier FROM (
        SELECT person_id, ingredient_concept_id, count(*) AS n_eras, sum(e - s + 1)::BIGINT AS total_era_days FROM clip GROUP BY 1, 2))""",
    "sequenced": """SELECT c.*, e - s + 1 AS era_days, row_number() OVER w AS era_number, lead(s) OVER w AS next_start, n_eras, total_era_days, maintenance_tier, maintenance_eligible
        FROM clip c JOIN tier USING (person_id, ingredient_concept_id) WINDOW w AS (PARTITION BY person_id, ingredient_concept_id ORDER BY s, e)""",
    "flagged": """SELECT q.*, CASE WHEN next_start <= e + 180 THEN 1 ELSE 0 END AS restarted, CASE WHEN e + 180 <= censor_date THEN 1 ELSE 0 END AS seen_restart,
        CASE WHEN e + 60 <= censor_date THEN 1 ELSE 0 END AS seen_switch,
        CASE WHEN EXISTS (SELECT 1 FROM clip o WHERE o.person_id = q.person_id AND o.ingredient_concept_id <> q.ingredient_concept_id AND o.s > q.e AND o.s <= q.e + 60) THEN 1 ELSE 0 END AS switched FROM sequenced q""",
    "event": """SELECT *, CASE WHEN era_number = 1 AND maintenance_eligible = 1 AND seen_restart = 1 AND era_days < 90 AND restarted = 0 THEN 1 ELSE 0 END AS early FROM flagged""",
    "by_month": f"""SELECT person_id, avg(active_n) AS mean_active_n, avg(CASE WHEN active_n >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS poly_month_prop, avg(turnover) AS mean_turnover,
        coalesce(CASE WHEN count(*) > 1 THEN regr_slope(active_n, month_index) END, 0) AS burden_slope,
        {", ".join(f"avg(active_n) FILTER (month_index BETWEEN {6 * w - 5} AND {6 * w}) AS mean_burden_w{w}" for w in WINDOWS)},
        {", ".join(f"avg(CASE WHEN state = '{x}' THEN 1.0::DOUBLE ELSE 0 END) AS prop_{x}" for x in STATES)} FROM month GROUP BY 1""",
    "dominant": f"""SELECT person_id, {", ".join(f"max(state) FILTER (w = {w} AND n = 1) AS dominant_state_w{w}" for w in WINDOWS)} FROM (
        SELECT person_id, (month_index + 5) // 6 AS w, state, row_number() OVER (PARTITION BY person_id, (month_index + 5) // 6 ORDER BY count(*) DESC, state) AS n FROM month GROUP BY 1, 2, 3) GROUP BY 1""",
    "by_era": """SELECT person_id, count(*) AS n_ingredient_eras, count(DISTINCT ingredient_concept_id) AS n_distinct_ingredients, count(*) FILTER (maintenance_eligible = 1) AS n_maintenance_eras,
        avg(early::DOUBLE) FILTER (maintenance_eligible = 1) AS early_disc_90_rate, avg(restarted::DOUBLE) FILTER (maintenance_eligible = 1 AND seen_restart = 1) AS restart_180_rate,
        avg(switched::DOUBLE) FILTER (maintenance_eligible = 1 AND seen_switch = 1) AS switch_60_rate, quantile_disc(CASE WHEN maintenance_eligible = 1 THEN era_days END, 0.5) AS median_era_days,
        max(CASE WHEN maintenance_eligible = 1 THEN (maintenance_tier = 'A_single_long')::INTEGER::DOUBLE END) AS is_single_era_maintenance FROM event GROUP BY 1""",
    "person": f"""SELECT person_id, {", ".join(f"coalesce({f}, 0) AS {f}" if f != "is_single_era_maintenance" else f for f in FEATURES)}, {", ".join(f"dominant_state_w{w}" for w in WINDOWS)},
        coalesce(n_maintenance_eras > 0, false) AS disc_evaluable FROM eligible LEFT JOIN by_month USING (person_id) LEFT JOIN dominant USING (person_id) LEFT JOIN by_era USING (person_id)""",
    "typed": f"""SELECT *, CASE WHEN NOT disc_evaluable THEN '{PHENOTYPES[0]}' WHEN switch_60_rate >= 0.5 THEN '{PHENOTYPES[1]}' WHEN restart_180_rate >= 0.5 THEN '{PHENOTYPES[2]}'
        WHEN early_disc_90_rate >= 0.5 OR burden_slope < -0.1 THEN '{PHENOTYPES[3]}' WHEN mean_active_n >= 3 AND mean_turnover < 0.2 AND early_disc_90_rate < 0.25 THEN '{PHENOTYPES[4]}'
        WHEN mean_turnover < 0.2 AND early_disc_90_rate < 0.25 THEN '{PHENOTYPES[5]}' ELSE '{PHENOTYPES[6]}' END AS discontinuation_phenotype FROM person""",
}

_PROFILE = ("mean_active_n", "mean_turnover", "burden_slope", "restart_180_rate", "median_era_days")
CTES |= {
    "labelled": "SELECT *, CASE WHEN disc_evaluable AND person_id % 11 <> 0 THEN (person_id % 4)::INTEGER ELSE -1 END AS trajectory_cluster FROM person",
    "standard": f"""SELECT person_id, [{", ".join(f"coalesce((coalesce({f}, 0) - avg(coalesce({f}, 0)) OVER ()) / nullif(stddev_samp(coalesce({f}, 0)) OVER (), 0), 0)::DOUBLE" for f in FEATURES)}] AS z FROM person WHERE disc_evaluable""",
    "unit": "SELECT person_id, list_transform(z, lambda x: CASE WHEN list_inner_product(z, z) > 0 THEN x / sqrt(list_inner_product(z, z)) ELSE 0 END) AS u FROM standard",
    "labelled_unit": "SELECT person_id, trajectory_cluster AS g, u FROM unit JOIN labelled USING (person_id) WHERE trajectory_cluster >= 0",
    "label_sum": f"""SELECT g, count(*) AS n, [{", ".join(f"sum(u[{i + 1}])" for i in range(len(FEATURES)))}] AS total FROM labelled_unit GROUP BY 1""",
    "profile": f"SELECT discontinuation_phenotype AS g, [{', '.join(f'{c}::DOUBLE' for c in _PROFILE)}] AS x FROM typed WHERE disc_evaluable",
    "group_mean": f"SELECT g, count(*) AS n, [{', '.join(f'avg(x[{i + 1}])' for i in range(len(_PROFILE)))}] AS m FROM profile GROUP BY 1",
    "all_mean": f"SELECT [{', '.join(f'avg(x[{i + 1}])' for i in range(len(_PROFILE)))}] AS m FROM profile",
    "group_spread": "SELECT g, sum(list_distance(x, m) ** 2) AS ss, avg(list_distance(x, m)) AS d FROM profile JOIN group_mean USING (g) GROUP BY 1",
}

# the same chain over eras of a 60-day gap, under names that end in _b
_CHAIN = list(CTES)[list(CTES).index("era") :]
CTES |= {f"{n}_b": re.sub(rf"\b(FROM|JOIN)(\s+\(*)({'|'.join(_CHAIN)})\b", r"\1\2\3_b", CTES[n]).replace("reached + 30", "reached + 60") for n in _CHAIN}


def sql(select: str) -> str:
    """``select`` under the CTEs that it uses, directly or not."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+\(*{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(select)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " + select if order else select


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}::DOUBLE, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


_ERA = "person_id, ingredient_concept_id, era_start_date, era_end_date, drug_exposure_count::BIGINT AS drug_exposure_count, gap_days"
_SET = "array_to_string(active_set, ',') AS active_set"
_MEANS = ("mean_active_n", "poly_month_prop", "mean_turnover", "early_disc_90_rate", "restart_180_rate", "switch_60_rate")
_CURVE = """(SELECT k, sum(n * v) AS value FROM (SELECT k, least(k - 1, floor((q - lo) * k / (hi - lo))) AS g, count(*) AS n, var_pop(q) AS v FROM (
    SELECT l_quantity::DOUBLE AS q, min(l_quantity::DOUBLE) OVER () AS lo, max(l_quantity::DOUBLE) OVER () AS hi FROM lineitem) CROSS JOIN (SELECT unnest([2, 3, 4, 5, 6, 7]) AS k) GROUP BY 1, 2) GROUP BY 1) c"""
_SALES = """WITH g AS (SELECT l_returnflag AS atc_group, year(l_shipdate)::INTEGER AS year, CASE WHEN l_linenumber % 2 = 1 THEN 'm' ELSE 'w' END AS sex, sum(l_quantity)::DOUBLE AS ddd FROM lineitem GROUP BY 1, 2, 3),
    v AS (SELECT atc_group, year, avg(ddd) AS volume FROM g GROUP BY 1, 2) """


def _eta(c: str) -> str:
    g = f"(SELECT discontinuation_phenotype AS g, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM typed GROUP BY 1)"
    b = "(sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n))"
    return f"""SELECT '{c}' AS feature, round(CASE WHEN sum(n * v) > 0 AND count(*) > 1 THEN ({b} / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) END, 4) AS f_value,
        round(CASE WHEN {b} + sum(n * v) > 0 THEN {b} / ({b} + sum(n * v)) ELSE 0 END, 6) AS eta_squared FROM {g}"""


def _lloyd_sql(rounds: int) -> str:
    """K-means of k = 2, 3 and 4 from the first k vectors, a pair of tables a round."""
    near = "a{i} AS MATERIALIZED (SELECT person_id, k, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT p.person_id, b.k, b.c, list_sum(list_transform(list_zip(p.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM un p CROSS JOIN b{i} b) GROUP BY 1, 2)"
    mean = "[" + ", ".join(f"avg(u[{j + 1}])" for j in range(len(FEATURES))) + "]"
    move = "b{n} AS MATERIALIZED (SELECT b.k, b.c, coalesce(m.u, b.u) AS u FROM b{i} b LEFT JOIN (SELECT k, c, " + mean + " AS u FROM a{i} JOIN un USING (person_id) GROUP BY 1, 2) m USING (k, c))"
    first = "un AS MATERIALIZED (SELECT * FROM unit), b0 AS MATERIALIZED (SELECT k, r - 1 AS c, u FROM (SELECT u, row_number() OVER (ORDER BY person_id) AS r FROM unit) JOIN (SELECT unnest([2, 3, 4]) AS k) ON r <= k)"
    steps = [step for i in range(rounds) for step in (near.format(i=i), move.format(i=i, n=i + 1))] + [near.format(i=rounds)]
    head, tail = sql("SELECT * FROM unit").rsplit(" SELECT * FROM unit", 1)
    return f"{head}, {first}, {', '.join(steps)} SELECT k, c::INTEGER AS cluster, count(*) AS n_people, round(sum(d), 5) AS inertia FROM a{rounds} GROUP BY 1, 2{tail}"


ORACLES: dict[str, str] = {
    "exposure_end_imputation": sql("SELECT person_id, drug_concept_id, s AS era_start_date, e AS era_end_date FROM imputed"),
    "ingredient_map": sql("SELECT drug_concept_id, ingredient_concept_id FROM mapping"),
    "exposure_ingredients": sql("SELECT person_id, ingredient_concept_id, s AS era_start_date, e AS era_end_date FROM exposed"),
    "exposure_dedupe": sql("SELECT person_id, ingredient_concept_id, s AS era_start_date, e AS era_end_date FROM deduped"),
    "era_gap_merge": sql(f"SELECT {_ERA} FROM era"),
    "era_gap_merge_raw": sql(f"SELECT {_ERA} FROM raw_era"),
    "era_daily_events": """WITH d AS (SELECT DISTINCT user_id, event_type, ts::DATE AS d FROM events), m AS (SELECT *, lag(d) OVER (PARTITION BY user_id, event_type ORDER BY d) AS p FROM d),
        i AS (SELECT *, sum(CASE WHEN p IS NULL OR d > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY d) AS island FROM m)
        SELECT user_id, event_type, min(d) AS era_start_date, max(d) AS era_end_date, count(*)::BIGINT AS n_days FROM i GROUP BY user_id, event_type, island""",
    "primary_eras": sql(f"SELECT {_ERA} FROM era"),
    "focus_filter": sql(f"SELECT {_ERA} FROM era WHERE ingredient_concept_id IN (1000001, 1000003)"),
    "index_date": sql("SELECT person_id, index_date FROM first_era"),
    "washout_candidates": sql("SELECT person_id, index_date, os AS observation_period_start_date, oe AS observation_period_end_date FROM candidate"),
    "eligible_cohort": sql("SELECT person_id, index_date, os AS observation_period_start_date, oe AS observation_period_end_date, censor_date FROM alive"),
    "eligible_cohort_death": sql("SELECT person_id, index_date, os AS observation_period_start_date, oe AS observation_period_end_date, death_date, censor_date FROM eligible"),
    "registry_observation_period": """WITH c AS (SELECT c_custkey::BIGINT AS person_id, DATE '1960-01-15' + (c_custkey * 37 % 20000)::INTEGER AS born,
            CASE WHEN c_custkey % 5 = 0 THEN DATE '2005-06-30' + (c_custkey % 1000)::INTEGER END AS gone, CASE WHEN c_custkey % 7 = 0 THEN DATE '2010-01-01' + (c_custkey % 900)::INTEGER END AS died FROM customer),
        p AS (SELECT person_id, greatest(DATE '1995-01-01', (born + INTERVAL 216 MONTH)::DATE) AS s, least(DATE '2023-12-31', coalesce(gone, DATE '2023-12-31'), coalesce(died, DATE '2023-12-31')) AS e FROM c)
        SELECT person_id, s AS observation_period_start_date, e AS observation_period_end_date FROM p WHERE e > s""",
    "pseudonymous_ids": """SELECT c_custkey::BIGINT AS c_custkey, ('0x' || substr(md5(c_name), 1, 15))::BIGINT AS person_id,
        CASE WHEN length(c_name) >= 7 THEN ('0x' || substr(md5(substr(c_name, 1, 7)), 1, 15))::BIGINT ELSE -1 END AS ingredient_concept_id FROM customer""",
    "clipped_eras": sql("SELECT person_id, ingredient_concept_id, s AS era_start_date, e AS era_end_date, drug_exposure_count::BIGINT AS drug_exposure_count, gap_days, clipped_at_censor FROM clip"),
    "month_grid": sql("SELECT person_id, month_index, ms AS month_start, me AS month_end FROM grid"),
    "month_overlap": sql("SELECT * FROM overlap"),
    "month_burden": sql(f"SELECT person_id, month_index, active_n, starts_n, stops_n, {_SET} FROM burden"),
    "month_turnover": sql(f"SELECT person_id, month_index, active_n, prev_active_n, {_SET}, round(turnover, 6) AS turnover FROM moved"),
    "month_states": sql("SELECT person_id, month_index, active_n, starts_n, stops_n, round(turnover, 6) AS turnover, state FROM month"),
    "state_counts": sql(f"SELECT person_id, {', '.join(f"count(*) FILTER (state = '{x}') AS {x}" for x in STATES)} FROM month GROUP BY 1"),
    "subwindow_burden": sql(f"SELECT person_id, {rounded([f'mean_burden_w{w}' for w in WINDOWS])} FROM by_month"),
    "subwindow_dominant_state": sql(f"SELECT person_id, {', '.join(f'dominant_state_w{w}' for w in WINDOWS)} FROM dominant"),
    "maintenance_tiers": sql("SELECT person_id, ingredient_concept_id, n_eras, total_era_days, maintenance_tier, maintenance_eligible FROM tier"),
    "restart_events": sql("SELECT person_id, ingredient_concept_id, s AS era_start_date, e AS era_end_date, era_number::INTEGER AS era_number, next_start AS next_same_ingredient_start, restarted AS restarted_within_180d, seen_restart AS observed_for_restart_window FROM event"),
    "switch_events": sql("SELECT person_id, ingredient_concept_id, s AS era_start_date, e AS era_end_date, switched AS switched_within_60d, seen_switch AS observed_for_switch_window FROM event"),
    "early_discontinuation": sql("SELECT person_id || '|' || ingredient_concept_id || '|' || s || '|' || e AS era_row_key, era_days::INTEGER AS era_days, maintenance_eligible, early AS early_discontinuation_90d FROM event"),
    "burden_slope": sql(f"SELECT person_id, {rounded(['mean_active_n', 'poly_month_prop', 'mean_turnover', 'burden_slope'])} FROM by_month"),
    "era_counts": sql("SELECT person_id, n_ingredient_eras, n_distinct_ingredients FROM by_era"),
    "disc_summary": sql(f"SELECT person_id, n_maintenance_eras, {rounded(['early_disc_90_rate', 'restart_180_rate', 'switch_60_rate', 'is_single_era_maintenance'])}, median_era_days::INTEGER AS median_era_days FROM by_era WHERE n_maintenance_eras > 0"),
    "person_features": sql(f"SELECT person_id, {rounded(FEATURES)}, disc_evaluable FROM person"),
    "person_phenotypes": sql(f"SELECT person_id, discontinuation_phenotype, {rounded(FEATURES)}, disc_evaluable, {', '.join(f'dominant_state_w{w}' for w in WINDOWS)} FROM typed"),
    "phenotype_counts": sql(f"SELECT p AS discontinuation_phenotype, (SELECT count(*) FROM typed WHERE discontinuation_phenotype = p) AS n_people FROM (VALUES {', '.join(f"('{p}')" for p in PHENOTYPES)}) t(p)"),
    "negative_controls": sql("SELECT person_id, discontinuation_phenotype FROM typed WHERE disc_evaluable AND person_id % 9 = 0"),
    "primary_vs_exposure": sql(f"""SELECT a.person_id AS pid, {', '.join(f"a.{c} AS {n}_primary, b.{c} AS {n}_exposure" for c, n in [('discontinuation_phenotype', 'phenotype')])},
        {', '.join(f"round(a.{c}, 6) + 0.0::DOUBLE AS {c}_primary, round(b.{c}, 6) + 0.0::DOUBLE AS {c}_exposure" for c in ('mean_active_n', 'mean_turnover', 'early_disc_90_rate'))},
        (a.discontinuation_phenotype = b.discontinuation_phenotype)::INTEGER AS same_phenotype FROM typed a JOIN typed_b b ON a.person_id = b.person_id"""),
    "turnover_profile": sql("""SELECT count(*) AS n_months, count(*) FILTER (turnover = 0) AS n_zero, count(*) FILTER (turnover > 0) AS n_nonzero, round(avg((turnover = 0)::INTEGER::DOUBLE), 6) AS zero_share,
        round(avg(turnover), 6) AS mean, round(stddev_samp(turnover), 6) AS stddev, min(turnover) AS min, max(turnover) AS max,
        round(quantile_cont(turnover, 0.1), 6) AS q10, round(quantile_cont(turnover, 0.25), 6) AS q25, round(quantile_cont(turnover, 0.5), 6) AS q50, round(quantile_cont(turnover, 0.75), 6) AS q75, round(quantile_cont(turnover, 0.9), 6) AS q90,
        count(*) FILTER (turnover > 0 AND turnover < 0.2) AS n_low, count(*) FILTER (turnover >= 0.2 AND turnover < 0.5) AS n_mid, count(*) FILTER (turnover >= 0.5) AS n_high,
        count(DISTINCT turnover) FILTER (turnover > 0 AND turnover < 0.2) AS n_distinct_low FROM moved"""),
    "null_audit": sql("SELECT 'is_single_era_maintenance' AS column_name, count(*) FILTER (is_single_era_maintenance IS NULL) AS nulls FROM person UNION ALL SELECT 'dominant_state_w4', count(*) FILTER (dominant_state_w4 IS NULL) FROM person UNION ALL SELECT 'mean_active_n', 0 FROM (SELECT 1)"),
    "phenotype_crosstab": sql(f"SELECT discontinuation_phenotype, {', '.join(f"count(*) FILTER (dominant_state_w1 = '{x}') AS n_{i}" for i, x in enumerate(STATES))} FROM typed GROUP BY 1"),
    "phenotype_summary": sql(f"SELECT discontinuation_phenotype, count(*) AS n_people, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _MEANS)} FROM typed GROUP BY 1"),
    "phenotype_centroids": sql(f"SELECT discontinuation_phenotype, {', '.join(f'round(avg({m}), 3) + 0.0::DOUBLE AS {m}' for m in _PROFILE)} FROM typed GROUP BY 1"),
    "eta_squared": sql(" UNION ALL ".join(_eta(c) for c in _PROFILE)),
    "archetype_prevalence": sql("SELECT discontinuation_phenotype, count(*) AS n_people, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM typed GROUP BY 1"),
    "dominant_ingredient": sql("SELECT person_id, ingredient_concept_id FROM clip QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY e - s DESC, ingredient_concept_id) = 1"),
    "top_ingredients_by_phenotype": sql("""SELECT discontinuation_phenotype, ingredient_concept_id, concept_name, n AS cluster_month_count, r::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY discontinuation_phenotype ORDER BY n DESC, ingredient_concept_id) AS r FROM (
        SELECT discontinuation_phenotype, ingredient_concept_id, count(*) AS n FROM (SELECT person_id, unnest(active_set) AS ingredient_concept_id FROM burden) JOIN typed USING (person_id) GROUP BY 1, 2)) JOIN ingredient USING (ingredient_concept_id) WHERE r <= 3"""),
    "standardised_unit_vectors": sql(f"SELECT person_id, {', '.join(f'round(u[{i + 1}], 6) + 0.0::DOUBLE AS u_{f}' for i, f in enumerate(FEATURES))} FROM unit"),
    "labelled_persons": sql("SELECT person_id, trajectory_cluster FROM labelled"),
    "cluster_summary": sql(f"SELECT trajectory_cluster, count(*) AS n_people, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _MEANS)} FROM labelled WHERE trajectory_cluster >= 0 GROUP BY 1"),
    "top_ingredients": sql("""SELECT trajectory_cluster, ingredient_concept_id, concept_name, n AS cluster_month_count, r::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY trajectory_cluster ORDER BY n DESC, ingredient_concept_id) AS r FROM (
        SELECT trajectory_cluster, ingredient_concept_id, count(*) AS n FROM (SELECT person_id, unnest(active_set) AS ingredient_concept_id FROM burden) JOIN labelled USING (person_id) GROUP BY 1, 2)) JOIN ingredient USING (ingredient_concept_id) WHERE r <= 3"""),
    "feasible_k": sql(f"SELECT least((SELECT count(*) FROM person WHERE disc_evaluable), greatest(1, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(f'coalesce({f}, 0)' for f in FEATURES)} FROM person WHERE disc_evaluable)))) AS k"),
    "label_silhouette": sql("""SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) + 0.0::DOUBLE AS silhouette FROM (
        SELECT person_id, max(n) FILTER (own) AS n, max(d * n / nullif(n - 1, 0)) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM (
        SELECT p.person_id, p.g = q.g AS own, q.n, 1 - list_inner_product(p.u, q.total) / q.n AS d FROM labelled_unit p CROSS JOIN label_sum q) GROUP BY 1)"""),
    "scaled_centroids": sql("SELECT discontinuation_phenotype, feature, round(m, 6) + 0.0::DOUBLE AS mean, round(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE 0 END, 6) + 0.0::DOUBLE AS scaled FROM (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM ("
        + " UNION ALL ".join(f"SELECT discontinuation_phenotype, '{c}' AS feature, avg({c}) AS m FROM typed GROUP BY 1" for c in _PROFILE) + ") WINDOW w AS (PARTITION BY feature))"),
    "dispensing_eras": sql("""SELECT person_id, ingredient_concept_id, min(s) AS era_start_date, max(e) AS era_end_date, count(*) AS drug_exposure_count FROM (
        SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, ingredient_concept_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY person_id, ingredient_concept_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (
        SELECT person_id, ingredient_concept_id, s, max(e) AS e FROM (
        SELECT ('0x' || substr(md5(person_id::VARCHAR), 1, 15))::BIGINT AS person_id, ('0x' || substr(md5('N06AB' || lpad((part % 20)::VARCHAR, 2, '0')), 1, 15))::BIGINT AS ingredient_concept_id, d AS s,
        d + CASE WHEN l_linenumber = 7 THEN 30 WHEN l_linenumber = 6 THEN 0 ELSE floor(l_quantity)::INTEGER END - 1 AS e FROM ship WHERE part % 20 < 10) WHERE e >= s GROUP BY person_id, ingredient_concept_id, s))) GROUP BY person_id, ingredient_concept_id, island"""),
    "sales_measures": """WITH g AS (SELECT l_returnflag AS atc_group, year(l_shipdate)::INTEGER AS year, l_linestatus AS sex, sum(l_quantity) AS ddd, count(DISTINCT l_orderkey)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3),
        y AS (SELECT atc_group, year, avg(ddd * 365 / nullif(n, 0)) AS v, sum(ddd) AS ddd FROM g GROUP BY 1, 2)
        SELECT atc_group, year, round(v, 6) AS ddd_per_patient_year, ddd, round(v / max(v) FILTER (year = 1995) OVER (PARTITION BY atc_group) * 100, 6) AS index_to_base, round(ddd / sum(ddd) OVER (PARTITION BY year), 6) AS year_share FROM y""",
    "internal_indices": sql(f"""SELECT round((between_ss / (k - 1)) / (within_ss / (n - k)), 5) AS calinski_harabasz, round(db, 5) AS davies_bouldin FROM (SELECT
        (SELECT sum(g.n * list_distance(g.m, t.m) ** 2) FROM group_mean g CROSS JOIN all_mean t) AS between_ss, (SELECT sum(ss) FROM group_spread) AS within_ss,
        (SELECT count(*) FROM group_mean) AS k, (SELECT sum(n) FROM group_mean) AS n,
        (SELECT avg(worst) FROM (SELECT a.g, max((x.d + y.d) / list_distance(a.m, b.m)) AS worst FROM group_mean a JOIN group_mean b ON a.g <> b.g JOIN group_spread x ON x.g = a.g JOIN group_spread y ON y.g = b.g GROUP BY 1)) AS db)"""),
    "kneedle": f"SELECT k, round(1 - (k - lo) / (hi - lo) - (value - vlo) / (vhi - vlo), 6) AS bend FROM (SELECT *, min(k) OVER ()::DOUBLE AS lo, max(k) OVER () AS hi, min(value) OVER () AS vlo, max(value) OVER () AS vhi FROM {_CURVE}) ORDER BY bend DESC, k LIMIT 1",
    "second_differences": f"SELECT k, round(d, 3) AS second_difference FROM (SELECT k, lag(value) OVER (ORDER BY k) - 2 * value + lead(value) OVER (ORDER BY k) AS d FROM {_CURVE}) WHERE d IS NOT NULL",
    "phenotype_ari": sql("""SELECT round(CASE WHEN (a + b) / 2 - a * b / t = 0 THEN 1 ELSE (x - a * b / t) / ((a + b) / 2 - a * b / t) END, 6) AS ari FROM (SELECT
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM typed GROUP BY discontinuation_phenotype, coalesce(dominant_state_w1, ''))) AS x,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM typed GROUP BY discontinuation_phenotype)) AS a,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM typed GROUP BY coalesce(dominant_state_w1, ''))) AS b,
        (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM typed) AS t)"""),
    "sales_volumes": _SALES + """SELECT atc_group, year, round(volume, 6) AS volume, round(volume / max(volume) FILTER (year = 1995) OVER (PARTITION BY atc_group) * 100, 6) AS index_to_base,
        round(volume / sum(volume) OVER (PARTITION BY year), 6) AS year_share FROM v""",
    "sales_share_pivot": _SALES + "SELECT year, " + ", ".join(f"round(coalesce(sum(volume) FILTER (atc_group = '{x}'), 0) / sum(volume), 6) AS share_{x}" for x in "ANR") + " FROM v GROUP BY 1",
    "sales_changes": _SALES + "SELECT atc_group, (SELECT min(year) FROM g) AS base_year, (SELECT max(year) FROM g) AS recent_year, round(b_all, 5) AS base_volume, round(r_all, 5) AS recent_volume, "
        + ", ".join(f"round(CASE WHEN b_{p} > 0 THEN (r_{p} - b_{p}) / b_{p} * 100 END, 5) + 0.0::DOUBLE AS change_{p}" for p in ("all", "men", "women"))
        + " FROM (SELECT atc_group, " + ", ".join(f"avg(ddd) FILTER (year = (SELECT {f}(year) FROM g) AND {c}) AS {y}_{p}" for y, f in (("b", "min"), ("r", "max")) for p, c in (("all", "TRUE"), ("men", "sex = 'm'"), ("women", "sex = 'w'"))) + " FROM g GROUP BY 1)",
    "turnover_quantiles": sql("SELECT p::DOUBLE AS p, n_months, TRUE AS within_error FROM (SELECT count(turnover) AS n_months FROM moved) CROSS JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS p)"),
    "era_gap_merge_hot": """SELECT l_suppkey::BIGINT AS l_suppkey, min(s) AS era_start_date, max(e) AS era_end_date, count(DISTINCT s) AS drug_exposure_count, 1::BIGINT AS gap_days FROM (
        SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (
        SELECT l_suppkey, l_shipdate::DATE AS s, l_shipdate::DATE + (l_quantity % 3)::INTEGER AS e FROM lineitem))) GROUP BY l_suppkey, island""",
    "lloyd_sweep": _lloyd_sql(5),
    "standardised_exposures": sql("SELECT person_id, drug_concept_id::BIGINT AS drug_concept_id, s AS drug_exposure_start_date, e AS drug_exposure_end_date, days_supply, days_supply::DOUBLE / 2 AS quantity FROM drug_exposure"),
    "external_eras": sql(f"SELECT {_ERA}, NULL::VARCHAR AS ingredient_name, NULL::VARCHAR AS atc_group, CASE WHEN person_id % 9 = 0 THEN 'acute_antibiotic' ELSE 'external_omop' END AS archetype FROM era"),
    "external_controls": sql("SELECT count(*) AS n_persons, count(*) FILTER (disc_evaluable AND person_id % 9 = 0) AS n_violations, count(*) FILTER (disc_evaluable AND person_id % 9 = 0) = 0 AS passed FROM typed"),
}
