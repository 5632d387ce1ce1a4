"""The registered queries as plain SQL over the same tables, for checking results."""

from __future__ import annotations

import math

from ecolake.functions.geodesy import CANDIDATE_CRS
from ecolake.plans.bindings import DEGREES_WKT
from ecolake.plans.queries import AREAS

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- tidy series -------------------------------------------------------------------------

_COLUMNS = (
    "model VARCHAR, model_name VARCHAR, scenario VARCHAR, domain VARCHAR, variable VARCHAR, freq VARCHAR, date VARCHAR, "
    "year INT, month INT, group_id INT, group_name VARCHAR, fleet_id INT, partner_name VARCHAR, value DOUBLE, unit VARCHAR"
)

LINES = """lines AS (
  SELECT 'model_' || lower(l_linestatus) AS model, 'Model ' || l_linestatus AS model_name, lower(l_returnflag) AS scenario,
         CAST(l_linenumber AS INT) AS g, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
         l_quantity AS q, l_orderkey, l_partkey, l_suppkey
  FROM lineitem)"""


def _series(variable: str, freq: str, unit: str, source: str = "lines", group="NULL", name="NULL", fleet="NULL", partner="NULL") -> str:
    month = "month" if freq == "monthly" else "1"
    dims = [d for d in (group, name, fleet, partner) if d != "NULL"]
    by = ", ".join(["model", "model_name", "scenario", "year", *(["month"] if freq == "monthly" else []), *dims])
    return (
        f"SELECT model, model_name, scenario, 'output' AS domain, '{variable}' AS variable, '{freq}' AS freq, "
        f"year || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-01' AS date, year, CAST({month} AS INT) AS month, "
        f"CAST({group} AS INT) AS group_id, CAST({name} AS VARCHAR) AS group_name, CAST({fleet} AS INT) AS fleet_id, "
        f"CAST({partner} AS VARCHAR) AS partner_name, sum(q) AS value, '{unit}' AS unit FROM {source} GROUP BY {by}"
    )


_FLEETS = "(SELECT * FROM lines JOIN supplier ON l_suppkey = s_suppkey)"
_RELATIONS = (
    "(SELECT * FROM lines JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey)"
)
MEANS = "means AS (SELECT event_type, CAST(2000 + day(ts) AS INT) AS year, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"
BIOMASS = _series("biomass", "annual", "Biomass", group="g")
BIOMASS_MONTHLY = _series("biomass", "monthly", "Biomass", group="g")
TOTAL = _series("totalcatch", "annual", "Total catch")
TOTAL_MONTHLY = _series("totalcatch", "monthly", "Total catch")
CATCH = _series("catch_fleet_group", "annual", "CatchFleetGroup", _FLEETS, group="g", fleet="s_nationkey")
PREDATION = _series("predation", "annual", "Predation", _RELATIONS, name="p_type", partner="c_mktsegment")
DRIVERS = (
    "SELECT NULL, NULL, 'bau', 'input', event_type, 'annual', year || '-01-01', year, 1, NULL, NULL, NULL, NULL, value, "
    "upper(event_type[1]) || event_type[2:] FROM means"
)
TIDY = (
    f"WITH {LINES}, {MEANS}, tidy AS (" + "\nUNION ALL ".join(
        [BIOMASS, BIOMASS_MONTHLY, TOTAL, TOTAL_MONTHLY, CATCH, PREDATION, DRIVERS]
    ) + ")"
)
B = f"WITH {LINES}, biomass AS ({BIOMASS})"
VALUES = "model, scenario, variable, freq, date, year, month, group_id, group_name, fleet_id, partner_name, value, unit"
FLAT = "model, model_name, scenario, variable, freq, date, year, month, group_id, group_name, fleet_id, partner_name, value"

# --- raw series files --------------------------------------------------------------------

RUNS = f"WITH {LINES}, runs AS (SELECT DISTINCT model, model_name, scenario FROM lines), types AS (SELECT DISTINCT model, model_name, scenario, p_type FROM {_RELATIONS})"
# one row per raw file: rel path, label, header, number of data lines and what a parser makes of it
FILES = RUNS + f""", yrs AS (SELECT model_name, scenario, count(DISTINCT year) AS n, count(DISTINCT (year, month)) AS nm FROM lines GROUP BY ALL),
tyrs AS (SELECT model_name, scenario, p_type, count(DISTINCT year) AS n FROM {_RELATIONS} GROUP BY ALL),
lyrs AS (SELECT model_name, scenario, count(DISTINCT (year, s_nationkey, g)) AS n FROM {_FLEETS} GROUP BY ALL),
files AS (
 SELECT model_name, scenario, 'biomass_annual.csv' AS name, 'Biomass' AS unit, 'year\\group|' || (SELECT string_agg(DISTINCT g, '|' ORDER BY g) FROM lines) AS header, n AS n_lines, 'wide_by_id' AS shape, 'annual' AS freq, 'biomass' AS variable, NULL AS target, 'ok' AS status FROM yrs
 UNION ALL SELECT model_name, scenario, 'Biomass.csv', 'Biomass', 'timestep\\group|' || (SELECT string_agg(DISTINCT g, '|' ORDER BY g) FROM lines), nm, 'wide_by_id', 'monthly', 'biomass', NULL, 'ok' FROM yrs
 UNION ALL SELECT model_name, scenario, 'predation_' || p_type || '_annual.csv', 'Predation', 'year\\group|' || (SELECT string_agg(DISTINCT c_mktsegment || ', adult', '|' ORDER BY c_mktsegment || ', adult') FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)), n, 'wide_by_name', 'annual', 'predation', p_type, 'ok' FROM tyrs
 UNION ALL SELECT model_name, scenario, 'catch-fleet-group_annual.csv', 'CatchFleetGroup', 'year|fleet|group|value', n, 'long', 'annual', 'catch_fleet_group', NULL, 'ok' FROM lyrs
 UNION ALL SELECT model_name, scenario, 'totalcatch_annual.csv', 'Total catch', 'year|value', n, 'single', 'annual', 'totalcatch', NULL, 'ok' FROM yrs
 UNION ALL SELECT model_name, scenario, 'odd/map.csv', NULL, NULL, 0, NULL, 'annual', 'map', NULL, 'unsupported' FROM runs
 UNION ALL SELECT model_name, scenario, 'odd/broken_annual.csv', 'Broken', 'year|value', 2, 'single', 'annual', 'broken', NULL, 'error' FROM runs
 UNION ALL SELECT model_name, scenario, 'odd/notes.csv', NULL, NULL, 0, NULL, 'annual', 'notes', NULL, 'none' FROM runs)"""

ORACLE["discover_output"] = FILES + """
SELECT 'model_' || lower(model_name[7:]) AS model, model_name, scenario, upper(scenario) AS scenario_label,
       CAST(count(*) AS BIGINT) AS n_files, count(DISTINCT CASE WHEN name LIKE '%/%' THEN split_part(name, '/', 1) ELSE '.' END) AS n_dirs
FROM files WHERE status <> 'none' GROUP BY model_name, scenario"""

ORACLE["csv_headers"] = FILES + """
SELECT model_name || '/' || scenario || '/' || name AS rel, k.key, CASE k.key WHEN 'ModelName' THEN model_name WHEN 'EcosimScenario' THEN upper(scenario) ELSE k.content END AS content
FROM files, (VALUES ('EwEVersion', '6.7'), ('ModelName', ''), ('EcosimScenario', ''), ('StartYear', '1995')) k(key, content) WHERE status <> 'none'
UNION ALL SELECT model_name || '/' || scenario || '/' || name, n.key, CASE n.key WHEN 'a' THEN 'b' ELSE scenario END
FROM files, (VALUES ('a'), ('1')) n(key) WHERE status = 'none'"""

ORACLE["csv_sections"] = FILES + """
SELECT model_name || '/' || scenario || '/' || name AS rel, unit, header, CAST(n_lines AS INT) AS n_lines FROM files"""

ORACLE["csv_shapes"] = FILES + """
SELECT model_name || '/' || scenario || '/' || name AS rel, shape, freq, variable, target, 1995 AS start_year, status FROM files WHERE status <> 'none'"""

ORACLE["read_wide_by_id"] = f"WITH {LINES}, t AS ({BIOMASS} UNION ALL {BIOMASS_MONTHLY}) SELECT {VALUES} FROM t"
ORACLE["read_wide_by_name"] = f"WITH {LINES}, t AS ({PREDATION}) SELECT {VALUES.replace('partner_name', chr(39) + chr(39) + ' || partner_name || ' + chr(39) + ', adult' + chr(39) + ' AS partner_name')} FROM t"
ORACLE["read_long"] = f"WITH {LINES}, t AS ({CATCH}) SELECT {VALUES} FROM t"
ORACLE["read_single"] = f"WITH {LINES}, t AS ({TOTAL}) SELECT {VALUES} FROM t"
ORACLE["read_trend"] = f"""WITH {MEANS} SELECT 'bau' AS scenario, 'input' AS domain, event_type AS variable, 'annual' AS freq,
 year || '-01-01' AS date, year, 1 AS month, value, upper(event_type[1]) || event_type[2:] AS unit FROM means"""

ORACLE["scan_store"] = f"WITH {LINES}, {MEANS}, t({', '.join(c.split()[0] for c in _COLUMNS.split(', '))}) AS ({BIOMASS} UNION ALL {DRIVERS}) SELECT {VALUES}, domain FROM t"
ORACLE["store_roundtrip"] = f"""WITH {LINES}, t AS ({BIOMASS} UNION ALL {TOTAL})
SELECT {VALUES.replace(' value,', " CASE WHEN variable = 'biomass' AND scenario = 'a' THEN 2 * value ELSE value END AS value,")}, domain FROM t"""
ORACLE["replace_source"] = f"{B} SELECT 'two' AS source_id, {VALUES} FROM biomass UNION ALL SELECT 'one', {VALUES} FROM biomass WHERE scenario = 'r'"
ORACLE["export_csv"] = f"{B} SELECT model, scenario, variable, freq, date, year, month, group_id, value FROM biomass WHERE scenario IN ('a', 'n')"
ORACLE["dim_scenarios"] = f"""WITH {LINES} SELECT scenario AS id, upper(scenario) AS label, 'output' AS domain, min(model) AS model, min(model_name) AS model_name FROM lines GROUP BY scenario
UNION ALL SELECT DISTINCT 'bau', 'BAU', 'input', NULL, NULL FROM events"""
ORACLE["dim_models"] = f"WITH {LINES} SELECT model AS id, min(model_name) AS name FROM lines GROUP BY model"

TABLE_ROWS = """tables AS (
  SELECT l_returnflag AS source, 'Model ' || l_linestatus AS model_name, CAST(l_linenumber AS INT) AS group_id,
         n_name || CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber = 3 THEN ' x' ELSE '' END AS name,
         CASE WHEN l_linestatus = 'F' THEN min(l_quantity) ELSE sum(l_quantity) END AS baseline
  FROM lineitem JOIN nation ON l_linenumber = n_nationkey GROUP BY l_returnflag, l_linestatus, l_linenumber, n_name)"""


def _merged(value: str) -> str:
    return (
        f"SELECT model_name, group_id, min({value}) AS {value} FROM tables WHERE model_name NOT IN (SELECT model_name FROM tables "
        f"GROUP BY model_name, group_id HAVING count(DISTINCT {value}) > 1) GROUP BY model_name, group_id"
    )


ORACLE["ecopath_tables"] = f"WITH {TABLE_ROWS} SELECT '/raw/' || model_name || '/' || source || '/basic_estimates.csv' AS path, model_name, group_id, name, baseline FROM tables"
ORACLE["ecopath_names"] = f"WITH {TABLE_ROWS} {_merged('name')}"
ORACLE["ecopath_baseline"] = f"WITH {TABLE_ROWS} {_merged('baseline')}"
NAMED = f"{B}, {TABLE_ROWS}, names AS ({_merged('name')}), bases AS ({_merged('baseline')})"
NAMED_TIDY = f"{TIDY}, {TABLE_ROWS}, names AS ({_merged('name')}), bases AS ({_merged('baseline')})"
ORACLE["annotate_names"] = f"""{NAMED_TIDY} SELECT {FLAT.replace('model_name', 'b.model_name').replace('group_id', 'b.group_id').replace('group_name', 'coalesce(b.group_name, n.name) AS group_name')}
FROM tidy b LEFT JOIN names n ON b.model_name = n.model_name AND b.group_id = n.group_id"""
ORACLE["ecopath_conflicts"] = f"""WITH {TABLE_ROWS}, v AS (SELECT 'name' AS what, model_name, group_id, name AS value FROM tables UNION ALL SELECT 'baseline', model_name, group_id, CAST(baseline AS VARCHAR) FROM tables),
d AS (SELECT what, model_name, group_id FROM v GROUP BY ALL HAVING count(DISTINCT value) > 1) SELECT what, model_name, count(*) AS n_groups, min(group_id) AS first_group FROM d GROUP BY ALL"""
ORACLE["annotate_baseline"] = f"""{NAMED_TIDY}
SELECT {FLAT.replace('model_name', 't.model_name').replace('group_id', 't.group_id')}, CASE WHEN variable = 'biomass' THEN baseline END AS baseline
FROM tidy t LEFT JOIN bases b ON t.model_name = b.model_name AND t.group_id = b.group_id"""
ORACLE["relative_baseline"] = f"""{NAMED_TIDY} SELECT model, scenario, freq, date, t.group_id, round(value / nullif(baseline, 0), 6) AS ratio
FROM (SELECT * FROM tidy WHERE variable = 'biomass') t LEFT JOIN bases b ON t.model_name = b.model_name AND t.group_id = b.group_id"""
# Series files hold return flags as scenarios, trend files event types: no name among them is a map's.
_ANY = lambda table, name, like: f"EXISTS (SELECT 1 FROM {table} WHERE {name} LIKE '{like}')"
ORACLE["validate_source"] = " UNION ALL ".join(f"SELECT '{check}' AS \"check\", {found} AS found" for check, found in [
    ("output_csv", _ANY("lineitem", "l_returnflag", "_%")), ("output_map", _ANY("lineitem", "lower(l_returnflag) || '/biomass_annual.csv'", "%.asc")),
    ("trend_csv", _ANY("lineitem", "'biomass_annual.csv'", "trend_%")), ("input_map", _ANY("lineitem", "'Biomass.csv'", "%.asc")),
    ("recognised_input", _ANY("lineitem", "lower(l_returnflag)", "title%")), ("trends: trend_csv", _ANY("events", "'trend_' || event_type || '.csv'", "trend_%.csv")),
    ("trends: input_map", _ANY("events", "'trend_' || event_type || '.csv'", "%.asc")), ("trends: recognised_input", _ANY("events", "'trend_' || event_type || '.csv'", "trend_%.csv")),
])

# --- scalar functions --------------------------------------------------------------------

ORACLE["fn_slugify"] = r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '_', 'g'), '_')) AS slug FROM documents"
ORACLE["fn_variable"] = r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'predation_' WHEN 1 THEN 'prey_' WHEN 2 THEN '' ELSE 'Catch-' END
  || p_name || ' ' || p_type || CASE p_partkey % 3 WHEN 0 THEN '_annual' WHEN 1 THEN '_monthly' ELSE '' END AS stem FROM part),
 b AS (SELECT *, regexp_replace(stem, '_(annual|monthly)$', '') AS base FROM s)
SELECT p_partkey, stem, CASE WHEN starts_with(base, 'predation_') THEN 'predation' WHEN starts_with(base, 'prey_') THEN 'prey'
  ELSE trim(regexp_replace(lower(base), '[^a-z0-9_]+', '_', 'g'), '_') END AS variable,
 CASE WHEN ends_with(stem, '_monthly') THEN 'monthly' ELSE 'annual' END AS freq_hint,
 CASE WHEN starts_with(base, 'predation_') THEN trim(base[11:]) WHEN starts_with(base, 'prey_') THEN trim(base[6:]) END AS target FROM b"""
ORACLE["fn_freq"] = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'monthly' WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'monthly' ELSE 'annual' END ELSE 'annual' END AS freq FROM orders"""
ORACLE["fn_period"] = """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) - 1 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(1998 + t // 12 AS INT) AS year, CAST(t % 12 + 1 AS INT) AS month,
 (1998 + t // 12) || '-' || lpad(CAST(t % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS date FROM t"""
ORACLE["fn_file_stem"] = """SELECT c_custkey, 'Gulf-' || c_mktsegment || '__' || CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '-') ELSE 'no-model' END
 || '__ssp1_a002__catch_x__' || CASE WHEN c_nationkey > 5 THEN replace(c_name, '#', '-') || '-sp' ELSE 'all' END || '__' || c_nationkey AS stem FROM customer"""
ORACLE["fn_label"] = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 3 > 0 THEN 'Fleet ' || s_nationkey END AS label FROM supplier"""

# --- selections --------------------------------------------------------------------------

ORACLE["query_timeseries"] = f"""WITH {LINES}, t AS ({CATCH}) SELECT {FLAT} FROM t WHERE model = 'model_o' AND scenario IN ('a', 'r')
 AND group_id IN (1, 2, 3) AND fleet_id IN (1, 5, 7, 11) AND year BETWEEN 1996 AND 1999"""
ORACLE["query_seasonal"] = f"WITH {LINES}, t AS ({BIOMASS_MONTHLY}) SELECT {FLAT} FROM t WHERE month BETWEEN 6 AND 8"
ORACLE["manifest_rows"] = f"""WITH {LINES}, t AS ({BIOMASS} UNION ALL {TOTAL}), items AS (SELECT * FROM (VALUES (0, 'totalcatch', 'a'), (0, 'totalcatch', 'r'),
 (1, 'biomass', 'a'), (2, 'biomass', 'a'), (2, 'biomass', 'n')) v(item, v, s))
SELECT {FLAT}, item FROM t JOIN items ON variable = v AND scenario = s WHERE year >= 1997"""

CATEGORY = """CASE WHEN domain <> 'output' THEN NULL WHEN variable = 'predation' THEN 'prey_with_predators'
 WHEN n_fleets > 0 AND n_groups > 0 THEN 'fleets_with_prey' WHEN n_groups > 0 THEN 'functional_groups' ELSE 'indicators' END AS category"""
CATALOG = f"""{TIDY}, counted AS (SELECT model, scenario, domain, variable, freq, min(model_name) AS model_name, min(unit) AS label, count(*) AS n_rows,
 min(year) AS year_min, max(year) AS year_max, count(DISTINCT group_id) AS n_groups, count(DISTINCT fleet_id) AS n_fleets, CAST(0 AS BIGINT) AS n_partners
 FROM tidy GROUP BY model, scenario, domain, variable, freq), cat AS (SELECT *, {CATEGORY} FROM counted)"""
DRIVER_IDS = "SELECT 'bau' AS id FROM events UNION SELECT event_type[3] FROM events"
SCENARIOS = f"""scn AS (SELECT DISTINCT lower(l_returnflag) AS id, 'Scenario ' || l_returnflag AS label, 'output' AS domain FROM lineitem
 UNION ALL SELECT id, upper(id), 'input' FROM ({DRIVER_IDS})),
dims AS (SELECT id, coalesce(max(label) FILTER (domain = 'output'), max(label)) AS label, max(domain) AS domain FROM scn GROUP BY id)"""
ORACLE["catalog_datasets"] = f"{CATALOG} SELECT * FROM cat"
ORACLE["list_datasets"] = f"{CATALOG} SELECT * FROM cat WHERE scenario = 'a'"
ORACLE["list_scenarios"] = f"""{CATALOG}, {SCENARIOS} SELECT scenario, min(dims.label) AS label, min(cat.domain) AS domain, min(model) AS model, min(model_name) AS model_name,
 count(*) AS n_datasets, min(year_min) AS year_min, max(year_max) AS year_max FROM cat LEFT JOIN dims ON scenario = id GROUP BY scenario"""
ORACLE["list_models"] = f"""{CATALOG}, {SCENARIOS}, per AS (SELECT model, scenario, min(model_name) AS model_name, min(dims.label) AS label, count(*) AS n,
 min(year_min) AS y0, max(year_max) AS y1 FROM cat LEFT JOIN dims ON scenario = id WHERE cat.domain = 'output' GROUP BY model, scenario)
SELECT model, min(model_name) AS model_name, string_agg(scenario || '=' || coalesce(label, scenario), '; ' ORDER BY scenario) AS scenarios,
 min(y0) AS year_min, max(y1) AS year_max, CAST(sum(n) AS BIGINT) AS n_datasets FROM per GROUP BY model"""
ORACLE["scenario_tree"] = f"""{CATALOG} SELECT model, min(model_name) AS model_name, scenario, domain,
 string_agg(concat_ws('|', variable, freq, category, year_min, year_max, n_groups, n_fleets), '; ' ORDER BY variable, freq) AS variables
 FROM cat GROUP BY model, scenario, domain"""
ORACLE["variable_index"] = f"""{CATALOG} SELECT domain, variable, freq, string_agg(concat_ws('/', scenario, model), '; ' ORDER BY scenario, model) AS combos,
 min(year_min) AS year_min, max(year_max) AS year_max, max(n_groups) AS n_groups, max(n_fleets) AS n_fleets, max(n_partners) AS n_partners,
 coalesce(min(label), variable) AS label, min(category) AS category, array_to_string(list_sort(list(DISTINCT scenario)), '; ') AS scenarios
 FROM cat GROUP BY domain, variable, freq"""
ORACLE["gate_scenarios"] = f"""{CATALOG}, c AS (SELECT domain, variable, freq, scenario, model IS NULL OR (model = 'model_f' AND scenario IN ('a', 'n')) AS ok,
 NOT (domain = 'output' AND variable = 'biomass' AND freq = 'annual' AND scenario NOT IN ('n', 'r')) AND NOT (variable = 'click') AS kept FROM cat)
SELECT domain, variable, freq, coalesce(array_to_string(list_sort(list(DISTINCT scenario) FILTER (ok)), '; '), '') AS available,
 coalesce(array_to_string(list_sort(list(DISTINCT scenario) FILTER (ok AND kept)), '; '), '') AS effective FROM c GROUP BY domain, variable, freq"""
ORACLE["list_groups"] = f"""WITH {LINES}, t AS ({BIOMASS} UNION ALL {CATCH}), {TABLE_ROWS}, names AS ({_merged('name')})
SELECT t.group_id AS id, nullif(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), ' / '), '') AS name,
 array_to_string(list_sort(list(DISTINCT variable)), '; ') AS variables
FROM t LEFT JOIN names n ON t.model_name = n.model_name AND t.group_id = n.group_id WHERE scenario IN ('a', 'n') GROUP BY t.group_id"""
ORACLE["list_fleets"] = f"""WITH {LINES}, t AS ({CATCH}) SELECT fleet_id AS id, CAST(NULL AS VARCHAR) AS name, 'catch_fleet_group' AS variables FROM t GROUP BY fleet_id"""
ORACLE["merge_scenarios"] = f"WITH {SCENARIOS} SELECT id, label, domain, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS model_name FROM dims"
ORACLE["combine_sources"] = f"WITH {SCENARIOS} SELECT id, label, domain, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS model_name FROM scn"

RUN = """runs AS (SELECT 'model_' || lower(l_linestatus) AS model, lower(l_returnflag) AS scenario, CASE WHEN l_returnflag = 'N' THEN 'single'
 ELSE 'Sample_' || (l_suppkey % 5) END AS dir, CAST(year(l_shipdate) AS INT) AS year, CAST(l_linenumber AS INT) AS group_id, l_quantity FROM lineitem),
multi AS (SELECT model, scenario, count(DISTINCT dir) AS n FROM runs GROUP BY model, scenario)"""
ORACLE["assign_run_id"] = f"""WITH {RUN} SELECT model, scenario, CASE WHEN n > 1 THEN dir END AS run_id, year, group_id, sum(l_quantity) AS value
FROM runs JOIN multi USING (model, scenario) GROUP BY model, scenario, n, dir, year, group_id"""

# --- trends and charts -------------------------------------------------------------------

ORACLE["moving_average"] = f"""{B} SELECT model, scenario, group_id, year,
 round(CASE WHEN count(value) OVER o = 3 THEN avg(value) OVER o END, 6) AS odd, round(CASE WHEN count(value) OVER e = 4 THEN avg(value) OVER e END, 6) AS even
FROM biomass WINDOW o AS (PARTITION BY model, scenario, group_id ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
 e AS (PARTITION BY model, scenario, group_id ORDER BY year ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)"""
ORACLE["relative_to_first"] = f"""{B}, v AS (SELECT * REPLACE (CASE WHEN year > 1995 THEN value END AS value) FROM biomass),
f AS (SELECT model, scenario, group_id, arg_min(value, year) FILTER (value IS NOT NULL) AS base FROM v GROUP BY ALL)
SELECT model, scenario, group_id, year, round(value / base * 100, 6) AS relative FROM v JOIN f USING (model, scenario, group_id)"""
ORACLE["trend_summary"] = f"""{B} SELECT model, scenario, group_id, arg_min(value, year) AS start, arg_max(value, year) AS "end",
 round((arg_max(value, year) - arg_min(value, year)) / arg_min(value, year) * 100, 6) AS change_pct FROM biomass WHERE year < 2001 GROUP BY ALL"""
ORACLE["label_order"] = """SELECT CAST(f AS INT) AS id, 'Fleet ' || f AS label
FROM (SELECT DISTINCT s_nationkey AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
ORACLE["pivot_series"] = f"""{B} SELECT CAST(year AS VARCHAR) AS x, """ + ", ".join(
    f"max(value) FILTER (scenario = '{s}' AND group_id = {g}) AS \"{s} · Group {g}\"" for s in "an" for g in (1, 2)
) + " FROM biomass WHERE model = 'model_f' AND scenario IN ('a', 'n') AND group_id IN (1, 2) GROUP BY year"
ORACLE["chart_points"] = f"""WITH {LINES}, t AS ({CATCH}) SELECT CAST(year AS VARCHAR) AS x, 'Fleet ' || fleet_id || ' · Group ' || group_id AS series, value
FROM t WHERE scenario = 'a' AND model = 'model_o'"""
ORACLE["baseline_lines"] = f"""{NAMED} SELECT CAST(y.year AS VARCHAR) AS x, 'Ecopath B0 · Group ' || g.group_id AS series, model_name, baseline AS value
FROM (SELECT DISTINCT b.model_name, b.group_id, baseline FROM biomass b JOIN bases USING (model_name, group_id) WHERE scenario = 'a') g,
 (SELECT DISTINCT year FROM biomass WHERE scenario = 'a') y"""
SMOOTH = """s AS (SELECT *, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS v FROM biomass
 WINDOW w AS (PARTITION BY model, scenario, group_id ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
ORACLE["biomass_trend_compare"] = f"""{B}, {SMOOTH}, f AS (SELECT model, scenario, group_id, arg_min(v, year) FILTER (v IS NOT NULL) AS base FROM s GROUP BY ALL)
SELECT model, scenario, group_id, 'Group ' || group_id AS "group", year, round(v / base * 100, 6) AS smoothed FROM s JOIN f USING (model, scenario, group_id)"""
ORACLE["analysis_plugin"] = f"""{B} SELECT model, scenario, group_id, 'Group ' || group_id AS "group", arg_min(value, year) AS start, arg_max(value, year) AS "end",
 round((arg_max(value, year) - arg_min(value, year)) / arg_min(value, year) * 100, 6) AS change_pct FROM biomass WHERE scenario IN ('a', 'r') GROUP BY ALL"""
ORACLE["analysis_per_series"] = f"""{B} SELECT a.model, a.scenario, a.group_id, round(median((b.value - a.value) / (b.year - a.year)), 6) AS slope
FROM biomass a LEFT JOIN biomass b ON a.model = b.model AND a.scenario = b.scenario AND a.group_id = b.group_id AND a.year < b.year GROUP BY ALL"""
# --- maps --------------------------------------------------------------------------------

NAMES = """m AS (SELECT DISTINCT label, vec_id % 3 AS scn, CASE WHEN vec_id % 3 = 1 THEN 'Sample_' || (vec_id % 2) ELSE 'single' END AS run,
  (vec_id % 8) * 12 + vec_id // 8 % 12 + 1 AS step, CASE WHEN label <= 4 THEN 'EcospaceMapBiomass' WHEN label <= 6 THEN 'EcospaceMapCatch'
  WHEN label = 7 THEN 'LayerHabitatCapacity' WHEN label = 8 THEN 'EcospaceMapEffort' ELSE 'biodiv_ind' END AS prefix,
  CASE WHEN label <= 4 THEN 'biomass' WHEN label <= 6 THEN 'catch' WHEN label = 7 THEN 'habitat_capacity' WHEN label = 8 THEN 'effort' END AS variable FROM embeddings),
n AS (SELECT *, 'maps/' || run || '/Scn ' || scn || '/asc' AS dir, prefix || '-Label ' || label || '-' || lpad(CAST(step AS VARCHAR), 5, '0') || '.asc' AS name,
  CAST(CASE WHEN scn = 2 THEN 1998 ELSE 2001 END AS INT) AS start_year FROM m)"""
INPUTS = r"""i AS (SELECT base || CASE WHEN vec_id % 2 = 0 THEN 'BAU' ELSE 'HAS' END || '/Driver ' || label || '/' || 'd' || vec_id || '_' || (1998 + vec_id % 50) || '_map.asc' AS rel,
  CASE WHEN vec_id % 2 = 0 THEN 'bau' ELSE 'has' END AS scenario, 'driver_' || label AS variable,
  CAST(regexp_extract('d' || vec_id || '_' || (1998 + vec_id % 50) || '_map.asc', '((?:19|20)\d{2})', 1) AS INT) AS year
  FROM embeddings, (VALUES ('input/'), ('Connected xml/')) b(base))"""
INDEX = f"""WITH {NAMES}, {INPUTS}, maps AS (
 SELECT CASE WHEN scn < 2 THEN 'model_e' END AS model, CASE WHEN scn < 2 THEN 'Model E' END AS model_name, 'scn_' || scn AS scenario, 'output' AS domain, variable,
  CASE WHEN label <> 8 THEN 'Label ' || label END AS group_name, CASE WHEN label = 8 THEN 'Label ' || label END AS fleet_name,
  CAST(start_year + (step - 1) // 12 AS INT) AS year, CASE WHEN scn = 1 THEN dir END AS run_id, dir, name, '/raw/' || dir || '/' || name AS path, 'label_' || label AS slug
 FROM n WHERE variable IS NOT NULL
 UNION ALL SELECT NULL, NULL, scenario, 'input', variable, NULL, NULL, year, NULL, NULL, split_part(min(rel), '/', -1), '/raw/' || min(rel), 'none' FROM i GROUP BY scenario, variable, year),
ided AS (SELECT *, concat_ws('|', scenario, domain, variable, slug, year, run_id) AS id FROM maps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY dir, name) AS rn, first(path) OVER (PARTITION BY model, id ORDER BY dir, name) AS kept,
  first(name) OVER (PARTITION BY model, id ORDER BY dir, name) AS kept_name FROM ided),
idx AS (SELECT id, model, model_name, scenario, domain, variable, group_name, fleet_name, year, run_id,
  'model=' || coalesce(model, '__HIVE_DEFAULT_PARTITION__') || '/scenario=' || scenario || '/domain=' || domain || '/variable=' || variable AS path, path AS source_path FROM ranked WHERE rn = 1)"""
ORACLE["scan_report"] = FILES + f", {NAMES}" + """, outcome AS (SELECT 'csv' AS kind, status, split_part(name, '/', -1) AS name, CASE status WHEN 'unsupported' THEN 'no data section'
  WHEN 'error' THEN 'a time or number cell cannot be read' END AS message FROM files WHERE status <> 'none'
 UNION ALL SELECT 'map', 'unrecognised', name, NULL FROM n WHERE variable IS NULL)
SELECT kind, status, count(*) AS files, array_to_string(list_sort(list(DISTINCT name))[1:3], '; ') AS examples, min(name || ': ' || message) AS first_message
FROM outcome GROUP BY kind, status"""
ORACLE["scan_warnings"] = ORACLE["scan_report"].replace("SELECT kind, status, count(*)", ", rep AS (SELECT kind, status, count(*)") + """)
SELECT kind, status, CASE status WHEN 'unrecognised' THEN files || ' map files were not loaded: their names match no known map (e.g. ' || replace(examples, '; ', ', ') || ')'
 WHEN 'unsupported' THEN files || ' CSV files have no time-series table and were skipped'
 ELSE files || ' ' || kind || ' files could not be loaded. First: ' || first_message END AS warning FROM rep WHERE status <> 'ok'"""

ORACLE["raster_names_output"] = f"""WITH {NAMES} SELECT dir || '/' || name AS rel, variable, CASE WHEN label = 8 THEN 'fleet' WHEN label < 8 THEN 'group' END AS entity_type,
 CASE WHEN variable IS NOT NULL THEN 'Label ' || label END AS entity_name, CASE WHEN variable IS NOT NULL THEN step END AS step,
 CASE WHEN variable IS NOT NULL THEN CAST(1998 + (step - 1) // 12 AS INT) END AS year FROM n"""
ORACLE["raster_names_input"] = f"WITH {INPUTS} SELECT rel, scenario, variable, year FROM i"
ORACLE["raster_runinfo"] = f"""WITH {NAMES} SELECT dir || '/' || name AS rel, CASE WHEN scn < 2 THEN 'model_e' END AS model, CASE WHEN scn < 2 THEN 'Model E' END AS model_name,
 'scn_' || scn AS scenario, start_year, CAST(start_year + (step - 1) // 12 AS INT) AS year, CASE WHEN scn < 2 THEN {_q(DEGREES_WKT)} END AS crs_wkt FROM n WHERE variable IS NOT NULL"""
ORACLE["raster_index"] = f"{INDEX} SELECT * FROM idx"
ORACLE["raster_collisions"] = f"""{INDEX} SELECT id, path, kept AS kept_path, 'duplicate map id ' || id || ': ' || name || ' and ' || kept_name || ' are both of the same year' AS message FROM ranked WHERE rn > 1"""
ORACLE["dedupe_input_maps"] = f"WITH {INPUTS} SELECT scenario, variable, year, '/raw/' || min(rel) AS path FROM i GROUP BY scenario, variable, year"
ORACLE["list_rasters"] = f"""{INDEX} SELECT id, model, model_name, scenario, domain, variable, CAST(NULL AS INT) AS group_id, group_name, CAST(NULL AS INT) AS fleet_id, fleet_name, year, run_id
FROM idx WHERE scenario = 'scn_0' AND variable = 'biomass' AND group_name = 'Label 3'"""
ORACLE["get_raster"] = f"{INDEX} SELECT id, scenario, domain, variable, year, source_path FROM idx WHERE id = 'scn_0|output|biomass|label_3|2004'"
PICK = f"""{INDEX}, items AS (SELECT * FROM (VALUES (0, 'biomass', 'Label 1', 2003, 2030), (0, 'biomass', 'Label 4', 2003, 2030), (1, 'effort', 'Label 8', 2001, 2050),
 (2, 'catch', 'Label 77', 2001, 2002), (3, 'biomass', 'Label 4', 2006, 2040)) v(item, v, e, y0, y1)),
picked AS (SELECT item, id, coalesce(group_name, fleet_name) AS entity, year FROM idx JOIN items ON variable = v AND coalesce(group_name, fleet_name) = e AND year BETWEEN y0 AND y1 WHERE scenario = 'scn_0')"""
ORACLE["select_maps"] = f"{PICK} SELECT item, id, entity, year FROM picked"
ORACLE["select_maps_summary"] = f"""{PICK}, asked AS (SELECT item, v AS variable, string_agg(e, ', ' ORDER BY e) AS entities, y0 || '-' || y1 AS years FROM items GROUP BY item, v, y0, y1)
SELECT a.item, variable, entities, years, count(p.id) AS maps, count(p.id) = 0 AS missing FROM asked a LEFT JOIN picked p ON a.item = p.item GROUP BY ALL"""
ORACLE["raster_layers"] = f"""{INDEX} SELECT scenario, domain, variable, model, min(model_name) AS model_name, count(DISTINCT group_name) AS n_groups,
 count(DISTINCT fleet_name) AS n_fleets, min(year) AS year_min, max(year) AS year_max, count(*) AS n_rasters FROM idx GROUP BY model, scenario, domain, variable"""
ORACLE["source_kind"] = f"""{INDEX}, {RUN} SELECT CAST(greatest((SELECT max(n) FROM multi), (SELECT max(r) FROM (SELECT count(DISTINCT run_id) AS r FROM idx GROUP BY model, scenario)), 1) AS BIGINT) AS run_count,
 (SELECT count(*) > 0 FROM lineitem) AS has_series, (SELECT count(*) > 0 FROM idx) AS has_maps,
 CASE WHEN (SELECT max(n) FROM multi) > 1 OR (SELECT max(r) FROM (SELECT count(DISTINCT run_id) AS r FROM idx GROUP BY model, scenario)) > 1 THEN 'montecarlo' ELSE 'mixed' END AS kind"""
ORACLE["identify_output"] = FILES + f""", {NAMES.replace('n AS (', 'nn AS (')} SELECT * FROM (
 SELECT 'ecosim' AS layer, count(*) AS files, CAST(0 AS BIGINT) AS maps, count(DISTINCT model_name) AS n_models, count(DISTINCT scenario) AS n_scenarios, array_to_string(list_sort(list(DISTINCT model_name)), '; ') AS models, array_to_string(list_sort(list(DISTINCT upper(scenario))), '; ') AS scenarios
 FROM files WHERE status <> 'none'
 UNION ALL SELECT 'ecopath', count(DISTINCT (l_linestatus, l_returnflag)), 0, count(DISTINCT l_linestatus), 0, array_to_string(list_sort(list(DISTINCT 'Model ' || l_linestatus)), '; '), '' FROM lineitem JOIN nation ON l_linenumber = n_nationkey
 UNION ALL SELECT 'ecospace', count(*) + (SELECT count(DISTINCT dir) FROM nn WHERE scn < 2), count(*), 1, (SELECT count(DISTINCT scn) FROM nn WHERE scn < 2), 'Model E',
  (SELECT string_agg(s, '; ' ORDER BY s) FROM (SELECT DISTINCT 'Scn ' || scn || ' space' AS s FROM nn WHERE scn < 2)) FROM nn)"""
ORACLE["identify_input"] = """SELECT 'driver_trends' AS kind, count(DISTINCT event_type) AS files, CAST(0 AS BIGINT) AS shapefiles, CAST(0 AS BIGINT) AS series, CAST(0 AS BIGINT) AS n_names, '' AS names FROM events
UNION ALL SELECT 'ecospace_maps', 2 * count(*), 0, 0, 0, '' FROM embeddings
UNION ALL SELECT 'ecopath_model', count(*), 0, 0, count(DISTINCT r_name), string_agg(r_name || '.ewemdb', '; ' ORDER BY r_name) FROM region
UNION ALL SELECT 'ecosim_timeseries', count(DISTINCT n_regionkey), 0, count(*), 0, '' FROM nation"""

CELLS = f"""g AS (SELECT CAST(vec_id AS VARCHAR) AS raster_id, vec_id, label, vec_id % 2 = 0 AS deg,
  CASE WHEN vec_id % 4 = 3 THEN 'EPSG:3035' ELSE 'EPSG:4326' END AS crs, CASE WHEN vec_id % 4 = 1 THEN 'mismatch' ELSE 'ok' END AS crs_status, embedding FROM embeddings),
e AS (SELECT *, unnest(range(64)) AS pos FROM g),
cells AS (SELECT raster_id, vec_id, label, deg, crs, crs_status, CAST(pos // 8 AS INT) AS row, CAST(pos % 8 AS INT) AS col,
  CASE WHEN deg THEN 10 + 0.5::DOUBLE * (pos % 8 + 0.5::DOUBLE) ELSE 4535378 + 4000 * (pos % 8 + 0.5::DOUBLE) END AS x,
  CASE WHEN deg THEN 54 + 0.5::DOUBLE * (7 - pos // 8 + 0.5::DOUBLE) ELSE 3432716 + 4000 * (7 - pos // 8 + 0.5::DOUBLE) END AS y,
  CASE WHEN vec_id % 97 = 0 OR (vec_id % 5 = 0 AND pos % 8 = 0) THEN NULL ELSE CAST(embedding[pos + 1] AS DOUBLE) END AS value FROM e)"""
ORACLE["read_grid_cells"] = f"""WITH {CELLS} SELECT raster_id, CASE WHEN deg THEN '8|8|10.0|54.0|0.5' ELSE '8|8|4535378.0|3432716.0|4000.0' END AS geometry, row, col, x, y, value FROM cells"""
ORACLE["materialize_cells"] = f"""WITH {CELLS} SELECT 'm' || (vec_id % 2) AS model, 's' || (vec_id % 3) AS scenario, 'output' AS domain, 'v' || label AS variable, raster_id, row, col, x, y, value FROM cells"""
ORACLE["grid_meta"] = f"""WITH {CELLS} SELECT raster_id, 8 AS width, 8 AS height, CASE WHEN deg THEN 0.5::DOUBLE ELSE 4000 END AS cellsize, CASE WHEN deg THEN 10::DOUBLE ELSE 4535378 END AS xmin,
 CASE WHEN deg THEN 54::DOUBLE ELSE 3432716 END AS ymin, CASE WHEN deg THEN 14::DOUBLE ELSE 4535378 + 32000 END AS xmax, CASE WHEN deg THEN 58::DOUBLE ELSE 3432716 + 32000 END AS ymax FROM g"""
ORACLE["raster_range"] = f"WITH {CELLS} SELECT raster_id, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max FROM cells GROUP BY raster_id"
ORACLE["raster_range_all"] = f"WITH {CELLS} SELECT coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max FROM cells"
ORACLE["grid_crs"] = f"WITH {CELLS} SELECT raster_id, crs, crs_status FROM g"
ORACLE["crs_mismatch"] = f"""WITH {CELLS} SELECT raster_id, crs, 'x 4,535,378 to 4,567,378, y 3,432,716 to 3,464,716 cannot be degrees, as EPSG:4326 has it' AS reason FROM g WHERE crs_status = 'mismatch'"""

# Inverse equal-area projection of the metric grid, step by step.
LAEA = """k AS (SELECT 0.006694380022903416::DOUBLE AS e2, sqrt(0.006694380022903416::DOUBLE) AS e, sin(radians(52)) AS s0),
qp AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0 FROM k),
kk AS (SELECT *, asin(q0 / qp) AS b0, 6378137 * sqrt(qp / 2) AS rq, 6378137 * cos(radians(52)) / sqrt(1 - e2 * s0 * s0) / (6378137 * sqrt(qp / 2) * cos(asin(q0 / qp))) AS d FROM qp)"""


def _laea(source: str) -> str:
    return f"""p1 AS (SELECT {source}.*, kk.*, (x - 4321000) / d AS dx, (y - 3210000) * d AS dy FROM {source}, kk),
p2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS rho, 2 * asin(sqrt(dx * dx + dy * dy) / (2 * rq)) AS c FROM p1),
p3 AS (SELECT *, asin(cos(c) * sin(b0) + dy * sin(c) * cos(b0) / rho) AS beta FROM p2),
ll AS (SELECT *, 10 + degrees(atan2(dx * sin(c), rho * cos(b0) * cos(c) - dy * sin(b0) * sin(c))) AS lon,
 degrees(beta + (e2 / 3 + 31 * e2 * e2 / 180 + 517 * e2 * e2 * e2 / 5040) * sin(2 * beta) + (23 * e2 * e2 / 360 + 251 * e2 * e2 * e2 / 3780) * sin(4 * beta)
  + 761 * e2 * e2 * e2 / 45360 * sin(6 * beta)) AS lat FROM p3)"""


ORACLE["cells_lonlat"] = f"""WITH {CELLS}, {LAEA}, metric AS (SELECT * FROM cells WHERE crs = 'EPSG:3035'), {_laea('metric')}
SELECT raster_id, crs, row, col, round(lon, 6) AS lon, round(lat, 6) AS lat, value FROM ll
UNION ALL SELECT raster_id, crs, row, col, x, y, value FROM cells WHERE crs = 'EPSG:4326' AND crs_status = 'ok'"""

# --- areas: even-odd test of every cell centre of the grid in degrees against every edge ------

_RINGS = [  # area, polygon, ring
    (0, 0, [[10.1, 54.2], [13.4, 54.6], [13.1, 57.7], [10.3, 57.2], [10.1, 54.2]]),
    (0, 0, [[11.1, 55.1], [12.2, 55.2], [12.1, 56.3], [11.2, 56.1], [11.1, 55.1]]),
    (1, 0, [[10.6, 54.1], [11.9, 54.1], [11.2, 55.6], [10.6, 54.1]]),
    (1, 1, [[12.6, 56.1], [13.9, 56.2], [13.2, 57.9], [12.6, 56.1]]),
]
_EDGES = ", ".join(
    f"({_q(AREAS[a][0])}, {p}, {r[i][0]}::DOUBLE, {r[i][1]}::DOUBLE, {r[i + 1][0]}::DOUBLE, {r[i + 1][1]}::DOUBLE)" for a, p, r in _RINGS for i in range(len(r) - 1)
)
# The metric grid is far from the test areas' latitudes only in part, so both grids are tested
# in degrees: the areas' edges are straight in the grid's own system, which for the metric grid
# means projecting their corners first.
_FORWARD = """f AS (SELECT u.*, kk.*, sin(radians(lat)) AS s FROM u, kk),
f2 AS (SELECT *, asin(((1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / qp) AS bt, radians(lon - 10) AS l FROM f),
f3 AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(bt) + cos(b0) * cos(bt) * cos(l))) AS b FROM f2),
xy AS (SELECT *, 4321000 + b * d * cos(bt) * sin(l) AS px, 3210000 + b / d * (cos(b0) * sin(bt) - sin(b0) * cos(bt) * cos(l)) AS py FROM f3)"""
AREA = f"""WITH {CELLS}, {LAEA}, lonlat AS (SELECT row_number() OVER () AS n, * FROM (VALUES {_EDGES}) v(area, poly, lon1, lat1, lon2, lat2)),
u AS (SELECT n, area, poly, 1 AS which, lon1 AS lon, lat1 AS lat FROM lonlat UNION ALL SELECT n, area, poly, 2, lon2, lat2 FROM lonlat), {_FORWARD},
edges AS (SELECT 'EPSG:4326' AS crs, area, poly, lon1 AS x1, lat1 AS y1, lon2 AS x2, lat2 AS y2 FROM lonlat
 UNION ALL SELECT 'EPSG:3035', a.area, a.poly, a.px, a.py, b.px, b.py FROM xy a JOIN xy b ON a.n = b.n AND a.which = 1 AND b.which = 2),
grid AS (SELECT DISTINCT crs, row, col, x, y, deg FROM cells WHERE crs_status = 'ok'),
box AS (SELECT crs, area, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM edges GROUP BY crs, area),
win AS (SELECT crs, area, CAST(greatest(0, floor((w - x0) / cs)) AS INT) AS col0, CAST(least(8, ceil((e - x0) / cs)) AS INT) AS col1,
 CAST(greatest(0, floor((y1 - n) / cs)) AS INT) AS row0, CAST(least(8, ceil((y1 - s) / cs)) AS INT) AS row1
 FROM box JOIN (VALUES ('EPSG:4326', 10::DOUBLE, 58::DOUBLE, 0.5::DOUBLE), ('EPSG:3035', 4535378, 3464716, 4000)) o(crs, x0, y1, cs) USING (crs)),
hits AS (SELECT g.crs, g.row, g.col, e.area, e.poly, count(*) AS k FROM grid g JOIN edges e ON g.crs = e.crs
  AND (e.y1 > g.y) <> (e.y2 > g.y) AND g.x < e.x1 + (g.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0) GROUP BY ALL),
ins AS (SELECT DISTINCT crs, row, col, area FROM hits WHERE k % 2 = 1),
masked AS (SELECT c.raster_id, w.area, c.row, c.col, i.area IS NOT NULL AS inside, CASE WHEN i.area IS NOT NULL THEN value END AS value, c.crs, row0, col0, row1, col1
 FROM cells c JOIN win w ON c.crs = w.crs AND c.row >= row0 AND c.row < row1 AND c.col >= col0 AND c.col < col1
 LEFT JOIN ins i ON i.crs = c.crs AND i.row = c.row AND i.col = c.col AND i.area = w.area WHERE crs_status = 'ok')"""
ORACLE["aoi_mask"] = f"{AREA} SELECT raster_id, area, row, col, inside, value FROM masked"
ORACLE["aoi_crop"] = f"{AREA} SELECT raster_id, area, CAST(row - row0 AS INT) AS row, CAST(col - col0 AS INT) AS col, CAST(row1 - row0 AS INT) AS rows, CAST(col1 - col0 AS INT) AS cols, value FROM masked"
ORACLE["aoi_skipped"] = f"""{AREA} SELECT raster_id, a.area FROM g, (VALUES {', '.join('(' + _q(n) + ')' for n, _ in AREAS)}) a(area)
 WHERE crs_status = 'ok' AND NOT EXISTS (SELECT 1 FROM masked m WHERE m.raster_id = g.raster_id AND m.area = a.area AND m.value IS NOT NULL)"""
ORACLE["aoi_union"] = f"{AREA} SELECT c.raster_id, c.row, c.col, value FROM cells c WHERE crs_status = 'ok' AND EXISTS (SELECT 1 FROM ins i WHERE i.crs = c.crs AND i.row = c.row AND i.col = c.col)"
ORACLE["aoi_parse"] = """SELECT 'area ' || c_custkey AS area, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS n_polygons,
 CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS INT) AS n_rings, CAST(CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 12 ELSE 0 END AS INT) AS n_points,
 CASE WHEN c_custkey % 3 < 2 THEN CAST(c_nationkey AS DOUBLE) - 12.5::DOUBLE END AS west, CASE WHEN c_custkey % 3 < 2 THEN c_acctbal / 1000 END AS south,
 CASE WHEN c_custkey % 3 < 2 THEN CAST(c_nationkey AS DOUBLE) - 12.5::DOUBLE + 2 END AS east, CASE WHEN c_custkey % 3 < 2 THEN c_acctbal / 1000 + 3 END AS north FROM customer"""

_PART = "replace(replace({}, ' / ', '-'), ' ', '-')"
ORACLE["export_ascii"] = f"""{AREA}, outs AS (
 SELECT raster_id, area, row - row0 AS r, col - col0 AS c, row1 - row0 AS rows, col1 - col0 AS cols, col0, row1, crs, value FROM masked
 UNION ALL SELECT raster_id, 'full-area', row, col, 8, 8, 0, 8, crs, value FROM cells WHERE crs_status = 'ok'),
lines AS (SELECT raster_id, area, rows, cols, col0, row1, crs, r, string_agg(printf('%.15g', coalesce(value, -9999)), ' ' ORDER BY c) AS line, count(value) AS k FROM outs GROUP BY ALL),
texts AS (SELECT raster_id, area, 'ncols ' || cols || chr(10) || 'nrows ' || rows || chr(10) || 'xllcorner ' ||
  printf('%.15g', CASE WHEN crs = 'EPSG:3035' THEN 4535378 + col0 * 4000.0::DOUBLE ELSE 10 + col0 * 0.5::DOUBLE END) || chr(10) || 'yllcorner ' ||
  printf('%.15g', CASE WHEN crs = 'EPSG:3035' THEN 3432716 + (8 - row1) * 4000.0::DOUBLE ELSE 54 + (8 - row1) * 0.5::DOUBLE END) || chr(10) || 'cellsize ' ||
  CASE WHEN crs = 'EPSG:3035' THEN '4000' ELSE '0.5' END || chr(10) || 'NODATA_value -9999' || chr(10) || string_agg(line, chr(10) ORDER BY r) || chr(10) AS text, sum(k) AS k
  FROM lines GROUP BY raster_id, area, rows, cols, col0, row1, crs)
SELECT {_PART.format('area')} AS folder, {_PART.format('area')} || '__Model-' || (CAST(raster_id AS INT) % 2) || '__s' || (CAST(raster_id AS INT) % 3) || '__biomass__Label-no.-' || raster_id
 || '__' || (1998 + CAST(raster_id AS INT) % 50) || '.asc' AS file, text FROM texts WHERE k > 0 OR area = 'full-area'"""

# --- where a metric grid would lie under each candidate system, by the textbook formulas --------

def _transverse(code: str, lon0: float, k: float, north0: float, f: float) -> str:
    """Rows (crs, x, y, lon, lat) of every edge point read as transverse Mercator."""
    n = f / (2 - f)
    r = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * k
    b = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    d = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi = "xi" + "".join(f" - {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(b, 1))
    eta = "eta" + "".join(f" - {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(b, 1))
    lat = "chi" + "".join(f" + {c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(d, 1))
    return (
        f"SELECT '{code}' AS crs, {lon0} + degrees(atan2(sinh(e1), cos(x1))) AS lon, degrees({lat}) AS lat FROM (SELECT *, asin(sin(x1) / cosh(e1)) AS chi FROM "
        f"(SELECT {xi} AS x1, {eta} AS e1 FROM (SELECT (y - ({north0}))::DOUBLE / {r!r}::DOUBLE AS xi, (x - 500000)::DOUBLE / {r!r}::DOUBLE AS eta FROM pts)))"
    )


_F80, _F84 = 1 / 298.257222101, 1 / 298.257223563
_E80 = (_F80 * (2 - _F80)) ** 0.5
_T = lambda lat: f"(tan(pi() / 4 - radians({lat}) / 2) / power((1 - {_E80!r} * sin(radians({lat}))) / (1 + {_E80!r} * sin(radians({lat}))), {_E80 / 2!r}))"
_M = lambda lat: f"(cos(radians({lat})) / sqrt(1 - power({_E80!r} * sin(radians({lat})), 2)))"
_STEP = f"(pi() / 2 - 2 * atan(t * power((1 - {_E80!r} * sin(p)) / (1 + {_E80!r} * sin(p)), {_E80 / 2!r})))"
CONIC = f"""cn AS (SELECT ln({_M(35)} / {_M(65)}) / ln({_T(35)} / {_T(65)}) AS n),
cb AS (SELECT n, 6378137 * {_M(35)} / (n * power({_T(35)}, n)) AS big FROM cn),
cr AS (SELECT x - 4000000 AS dx, big * power({_T(52)}, n) - (y - 2800000) AS dy, n, big FROM pts, cb),
it0 AS (SELECT *, power(sqrt(dx * dx + dy * dy) / big, 1 / n) AS t FROM cr), it1 AS (SELECT *, pi() / 2 - 2 * atan(t) AS p FROM it0),
it2 AS (SELECT * REPLACE ({_STEP} AS p) FROM it1), it3 AS (SELECT * REPLACE ({_STEP} AS p) FROM it2), it4 AS (SELECT * REPLACE ({_STEP} AS p) FROM it3),
it5 AS (SELECT * REPLACE ({_STEP} AS p) FROM it4), it6 AS (SELECT * REPLACE ({_STEP} AS p) FROM it5)"""
_POINTS = """pts AS (SELECT CASE s WHEN 0 THEN i WHEN 1 THEN i WHEN 2 THEN 0 ELSE 1 END * 32000 + 4535378::DOUBLE AS x,
 CASE s WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE i END * 32000 + 3432716::DOUBLE AS y
 FROM (SELECT unnest(range(23)) / 22 AS i), (SELECT unnest(range(4)) AS s) WHERE (SELECT count(*) FROM embeddings WHERE vec_id % 4 = 1) > 0)"""
ORACLE["crs_candidates"] = f"""WITH {_POINTS}, {LAEA}, {_laea('pts')}, {CONIC}, all_points AS (
 SELECT 'EPSG:3035' AS crs, lon, lat FROM ll
 UNION ALL SELECT 'EPSG:3034', 10 + degrees(atan2(dx, dy)) / n, degrees(p) FROM it6
 UNION ALL SELECT 'EPSG:3857', degrees(x / 6378137), degrees(2 * atan(exp(y / 6378137)) - pi() / 2) FROM pts
 UNION ALL {_transverse('EPSG:32633', 15, 0.9996, 0, _F84)} UNION ALL {_transverse('EPSG:32634', 21, 0.9996, 0, _F84)}
 UNION ALL {_transverse('EPSG:32635', 27, 0.9996, 0, _F84)} UNION ALL {_transverse('EPSG:2180', 19, 0.9993, -5300000, _F80)}
 UNION ALL {_transverse('EPSG:3006', 15, 0.9996, 0, _F80)}),
ext AS (SELECT crs, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, bool_and(isfinite(lon) AND isfinite(lat)) AS ok FROM all_points GROUP BY crs),
good AS (SELECT crs, CASE WHEN ok AND w >= -180 AND e <= 180 AND s >= -90 AND n <= 90 THEN true ELSE false END AS fits FROM ext)
SELECT '8|8|4535378.0|3432716.0|4000.0' AS geometry, crs, c.name AS crs_name, CASE WHEN fits THEN round(w, 2) END AS west, CASE WHEN fits THEN round(s, 2) END AS south,
 CASE WHEN fits THEN round(e, 2) END AS east, CASE WHEN fits THEN round(n, 2) END AS north
FROM ext JOIN good USING (crs) JOIN (VALUES {', '.join(f"('{code}', {_q(name)})" for code, name in CANDIDATE_CRS)}) c(crs, name) USING (crs)"""

ORACLE["regrid_nearest"] = f"""WITH {CELLS}, {LAEA}, {_POINTS}, {_laea('pts')},
ext AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM ll),
size AS (SELECT *, sqrt(power(e - w, 2) + power(n - s, 2)) / sqrt(128) AS res FROM ext),
target AS (SELECT CAST(r AS INT) AS out_row, CAST(c AS INT) AS out_col, w + res * (c + 0.5) AS lon, n - res * (r + 0.5) AS lat
 FROM size, (SELECT unnest(range(100)) AS r), (SELECT unnest(range(100)) AS c) WHERE r < round((n - s) / res) AND c < round((e - w) / res)),
u AS (SELECT *, 0 AS n, 0 AS area FROM target), {_FORWARD},
look AS (SELECT out_row, out_col, lon, lat, CAST(floor((3464716 - py) / 4000) AS INT) AS row, CAST(floor((px - 4535378) / 4000) AS INT) AS col FROM xy)
SELECT raster_id, out_row, out_col, round(lon, 6) AS lon, round(lat, 6) AS lat, value FROM look JOIN cells USING (row, col) WHERE crs = 'EPSG:3035'
UNION ALL SELECT raster_id, row, col, round(x, 6), round(y, 6), value FROM cells WHERE crs = 'EPSG:4326' AND crs_status = 'ok'"""

# --- whole folders -----------------------------------------------------------------------

ORACLE["discover_files"] = ORACLE["discover_output"]
_ADULT = VALUES.replace("partner_name", "'' || partner_name || ', adult' AS partner_name")
ORACLE["ingest_output"] = f"""WITH {LINES}, t AS ({BIOMASS} UNION ALL {BIOMASS_MONTHLY} UNION ALL {CATCH} UNION ALL {TOTAL}), p AS ({PREDATION})
SELECT {VALUES} FROM t UNION ALL SELECT {_ADULT} FROM p"""
ORACLE["stored_catalog"] = f"""WITH {LINES}, t AS ({BIOMASS} UNION ALL {BIOMASS_MONTHLY} UNION ALL {CATCH} UNION ALL {TOTAL} UNION ALL {PREDATION})
SELECT model, scenario, variable, freq, count(*) AS n_rows, min(year) AS year_min, max(year) AS year_max, count(DISTINCT group_id) AS n_groups, count(DISTINCT fleet_id) AS n_fleets FROM t GROUP BY model, scenario, variable, freq"""
ORACLE["ingest_report"] = FILES + f""", {NAMES}, kept AS (SELECT * FROM n WHERE variable IS NOT NULL),
 same AS (SELECT count(*) AS k FROM kept GROUP BY scn, variable, label, start_year + (step - 1) // 12, CASE WHEN scn = 1 THEN dir END),
 outcome AS (SELECT 'csv' AS kind, status, count(*) AS files FROM files WHERE status <> 'none' GROUP BY status
 UNION ALL SELECT 'map', 'ok', count(*) FROM same UNION ALL SELECT 'map', 'error', CAST(sum(k - 1) AS BIGINT) FROM same UNION ALL SELECT 'map', 'unrecognised', count(*) FROM n WHERE variable IS NULL)
SELECT kind, status, files FROM outcome WHERE files > 0"""
ORACLE["ingest_input"] = f"""WITH {INPUTS}, g AS (SELECT count(*) AS k FROM i GROUP BY scenario, variable, year), outcome AS (
 SELECT 'trend' AS kind, 'ok' AS status, count(DISTINCT event_type) AS files FROM events UNION ALL SELECT 'map', 'ok', count(*) FROM g UNION ALL SELECT 'map', 'copy', CAST(sum(k - 1) AS BIGINT) FROM g)
SELECT kind, status, files FROM outcome WHERE files > 0"""
ORACLE["materialize_files"] = ORACLE["materialize_cells"]
ORACLE["export_ascii_files"] = ORACLE["export_ascii"]
ORACLE["map_outcomes"] = f"""WITH {CELLS} SELECT raster_id, crs_status AS outcome, CASE WHEN crs_status = 'mismatch' THEN 'not degrees: x 4,535,378 to 4,567,378, y 3,432,716 to 3,464,716' END AS reason FROM g"""

# --- ragged lines, stored index and members, maps opened on demand --------------------------

ORACLE["read_ragged"] = f"WITH {LINES}, t AS ({BIOMASS}) SELECT {VALUES} FROM t WHERE year % 2 = 1 OR group_id <= 4"
ORACLE["stored_rasters"] = f"""{INDEX} SELECT id, model, model_name, scenario, domain, variable, group_name, fleet_name, year, run_id, split_part(source_path, '/', -1) AS name
 FROM idx WHERE domain = 'output'"""
ORACLE["stored_members"] = f"""WITH {LINES}, t AS ({BIOMASS} UNION ALL {CATCH})
SELECT scenario, variable, count(DISTINCT group_id) AS n_groups, CAST(count(*) AS BIGINT) AS n_rows FROM t WHERE variable <> 'biomass' OR scenario <> 'a' OR group_id <= 3 GROUP BY scenario, variable"""
ORACLE["materialize_outcomes"] = f"""WITH {CELLS} SELECT raster_id, CASE WHEN vec_id % 12 IN (1, 5, 9) THEN 'error' ELSE 'ok' END AS outcome,
 CASE vec_id % 12 WHEN 1 THEN '63 numbers for a grid of 8 by 8' WHEN 5 THEN chr(39) || 'land' || chr(39) || ' is not a number' WHEN 9 THEN 'gone' END AS reason,
 CAST(CASE WHEN vec_id % 12 IN (1, 5, 9) THEN 0 ELSE 64 END AS BIGINT) AS cells FROM g"""

# --- scenarios against a baseline, ensembles ------------------------------------------------


def _paired(source: str, base: str) -> str:
    same = lambda t: " AND ".join([f"{t}.{c} = k.{c}" for c in ("model", "variable", "year")] + [f"{t}.{c} IS NOT DISTINCT FROM k.{c}" for c in ("group_id", "fleet_id")])
    return f"""WITH {LINES}, t AS ({source}), k AS (SELECT DISTINCT model, variable, year, group_id, fleet_id FROM t), s AS (SELECT DISTINCT model, scenario FROM t WHERE scenario <> '{base}'),
p AS (SELECT k.*, s.scenario, v.value, b.value AS baseline FROM k JOIN s USING (model) LEFT JOIN t v ON {same('v')} AND v.scenario = s.scenario
 LEFT JOIN t b ON {same('b')} AND b.scenario = '{base}' WHERE v.value IS NOT NULL OR b.value IS NOT NULL),
e AS (SELECT *, CASE WHEN value IS NULL THEN 'no_scenario' WHEN baseline IS NULL THEN 'no_baseline' ELSE 'paired' END AS status FROM p)"""


ORACLE["scenario_effect"] = _paired(f"{BIOMASS} UNION ALL {TOTAL} UNION ALL {CATCH}", "a") + """
SELECT model, scenario, variable, year, group_id, fleet_id, status, value, baseline, value - baseline AS absolute,
 CASE WHEN abs(baseline) > 1e-9 THEN round((value - baseline) / baseline * 100, 6) END AS percent,
 CASE WHEN value >= 0 AND baseline >= 0 THEN round(ln((value + 1e-9) / (baseline + 1e-9)), 6) END AS log_ratio FROM e"""
ORACLE["scenario_unmatched"] = _paired(CATCH, "n") + " SELECT scenario, status, count(*) AS keys FROM e WHERE status <> 'paired' GROUP BY scenario, status"
ORACLE["ensemble_kinds"] = f"""WITH {RUN}, d AS (SELECT model, scenario, CASE WHEN n > 1 THEN dir END AS run_id FROM runs JOIN multi USING (model, scenario)
 UNION ALL SELECT model, scenario, NULL FROM runs WHERE scenario = 'r' AND year = 1995), c AS (SELECT model, scenario, count(DISTINCT run_id) AS runs, bool_or(run_id IS NULL) AS bare FROM d GROUP BY model, scenario)
SELECT model, scenario, runs, CASE WHEN bare AND runs > 0 THEN 'mixed' WHEN runs > 1 THEN 'ensemble' ELSE 'single' END AS kind FROM c"""
ORACLE["quantile_bands"] = f"""WITH {RUN}, v AS (SELECT model, scenario, dir, year, group_id, sum(l_quantity) AS value FROM runs WHERE scenario IN ('a', 'r') GROUP BY ALL)
SELECT model, scenario, year, group_id, count(*) AS runs, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25,
 round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95 FROM v GROUP BY model, scenario, year, group_id"""

# --- systems told by parameters ---------------------------------------------------------------


def _arc(lat: float) -> float:
    """Meridian arc from the equator to a parallel, by Simpson's rule, scaled."""
    e2, n = _F84 * (2 - _F84), 20_000
    step = math.radians(lat) / n
    f = lambda p: 6378137.0 * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    return 0.9998 * step / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(k * step) for k in range(n + 1))


_STRIP = _transverse("told", 0, 0.9998, 0, _F84).replace("(x - 500000)", "(x - 4500000)").replace("FROM pts", "FROM strip").replace("'told' AS crs, 0 + ", "raster_id, lon0 + ")
_STRIP = _STRIP.replace("(SELECT xi", "(SELECT raster_id, lon0, xi").replace("(SELECT (y", "(SELECT raster_id, lon0, (y")
ORACLE["crs_from_wkt"] = f"""WITH o AS (SELECT CAST(vec_id AS VARCHAR) AS raster_id, vec_id, 9.25::DOUBLE + vec_id % 7 AS lon0, 4535378::DOUBLE AS x,
 3432716::DOUBLE - CASE WHEN vec_id % 3 = 0 THEN 3000000 - {_arc(50)!r}::DOUBLE ELSE -2500000 END AS y FROM embeddings WHERE vec_id % 2 = 1),
strip AS (SELECT * FROM o WHERE vec_id % 11 NOT IN (3, 5, 7)), t AS ({_STRIP})
SELECT o.raster_id, CASE WHEN t.raster_id IS NULL THEN 'unknown' ELSE 'ok' END AS crs_status, round(t.lon, 7) AS lon, round(t.lat, 7) AS lat FROM o LEFT JOIN t USING (raster_id)"""

# --- maps weighed by cell areas, paired over scenarios and years ------------------------------

_KEYS = """keyed AS (SELECT CAST(vec_id AS VARCHAR) AS raster_id, 'm' || (vec_id % 4) AS model, CASE vec_id // 4 % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'low' ELSE 'high' END AS scenario,
 CAST(1998 + vec_id // 12 AS INT) AS year, CASE WHEN vec_id // 12 % 3 = 2 THEN 'habitat_capacity' ELSE 'biomass' END AS variable FROM embeddings)"""
_CORNERS = _laea("pts")
for _step in ("p1", "p2", "p3", "ll"):
    _CORNERS = _CORNERS.replace(f"{_step} AS (", f"c{_step} AS (").replace(f"FROM {_step})", f"FROM c{_step})")
_CORNERS = _CORNERS.replace("FROM p1", "FROM cp1").replace("FROM p2", "FROM cp2").replace("FROM p3", "FROM cp3")
_KM = f"""pts AS (SELECT r, c AS k, 4535378 + 4000 * c::DOUBLE AS x, 3432716 + 4000 * (8 - r)::DOUBLE AS y FROM (SELECT unnest(range(9)) AS r), (SELECT unnest(range(9)) AS c)), {_CORNERS},
corner AS (SELECT 'EPSG:3035' AS crs, r, k, lon, lat FROM cll UNION ALL SELECT 'EPSG:4326', r, k, 10 + 0.5::DOUBLE * k, 58 - 0.5::DOUBLE * r FROM pts),
flat AS (SELECT corner.crs, r, k, radians(lon) AS px, 6378137.0::DOUBLE * 6378137 / 2 * (1 - kk.e2) * (sin(radians(lat)) / (1 - kk.e2 * sin(radians(lat)) * sin(radians(lat)))
 + ln((1 + kk.e * sin(radians(lat))) / (1 - kk.e * sin(radians(lat)))) / (2 * kk.e)) AS py FROM corner, kk),
km AS (SELECT a.crs, CAST(a.r AS INT) AS row, CAST(a.k AS INT) AS col, abs((a.px - d.px) * (b.py - e.py) - (b.px - e.px) * (a.py - d.py)) / 2e6 AS km2
 FROM flat a JOIN flat b ON a.crs = b.crs AND a.r = b.r AND b.k = a.k + 1 JOIN flat d ON a.crs = d.crs AND d.r = a.r + 1 AND d.k = a.k + 1 JOIN flat e ON a.crs = e.crs AND e.r = a.r + 1 AND e.k = a.k)"""


def _side(prefix: str, n: str, a: str, va: str) -> str:
    return (
        f"{n} AS {prefix}cells, CASE WHEN {n} > 0 THEN {a} ELSE 0 END AS {prefix}area_km2, CASE WHEN {n} > 0 AND variable = 'biomass' THEN {va} END AS {prefix}sum, "
        f"CASE WHEN {n} > 0 THEN {va} / {a} END AS {prefix}mean"
    )


_IN = f"""{AREA}, {_KEYS}, {_KM}, inner_ AS (SELECT m.raster_id, area, count(value) AS n, coalesce(sum(km2) FILTER (value IS NOT NULL), 0) AS a, coalesce(sum(value * km2), 0) AS va
 FROM masked m JOIN km ON m.crs = km.crs AND m.row = km.row AND m.col = km.col GROUP BY m.raster_id, area)"""
ORACLE["zonal_summary"] = f"""{_IN}, s AS (SELECT keyed.*, CASE variable WHEN 'biomass' THEN 'density' ELSE 'fraction' END AS kind, area, {_side('', 'n', 'a', 'va')} FROM inner_ JOIN keyed USING (raster_id))
SELECT * REPLACE (round(area_km2, 6) AS area_km2, round(sum, 6) AS sum, round(mean, 6) AS mean) FROM s"""
_EFFECT = lambda side: (
    f"round(s.{side}_mean, 6) AS {side}_mean, round(b.{side}_mean, 6) AS {side}_base, round(s.{side}_mean - b.{side}_mean, 6) AS {side}_absolute, "
    f"CASE WHEN abs(b.{side}_mean) > 1e-9 THEN round((s.{side}_mean - b.{side}_mean) / b.{side}_mean * 100, 2) END AS {side}_percent, "
    f"CASE WHEN s.{side}_mean >= 0 AND b.{side}_mean >= 0 THEN round(ln((s.{side}_mean + 1e-9) / (b.{side}_mean + 1e-9)), 6) END AS {side}_log_ratio"
)
ORACLE["inside_outside"] = f"""{_IN}, total AS (SELECT c.raster_id, count(value) AS tn, coalesce(sum(km2) FILTER (value IS NOT NULL), 0) AS ta, coalesce(sum(value * km2), 0) AS tva
 FROM cells c JOIN km ON c.crs = km.crs AND c.row = km.row AND c.col = km.col WHERE crs_status = 'ok' GROUP BY c.raster_id),
sides AS (SELECT keyed.*, area, {_side('inside_', 'n', 'a', 'va')}, {_side('outside_', '(tn - n)', '(ta - a)', '(tva - va)')} FROM inner_ JOIN total USING (raster_id) JOIN keyed USING (raster_id))
SELECT s.model, s.variable, s.year, s.area, s.scenario, {_EFFECT('inside')}, {_EFFECT('outside')}, round((s.inside_mean - b.inside_mean) - (s.outside_mean - b.outside_mean), 6) AS contrast
FROM sides s JOIN sides b ON s.model = b.model AND s.variable = b.variable AND s.year = b.year AND s.area = b.area AND b.scenario = 'base' WHERE s.scenario <> 'base'"""
_KEYED_CELLS = f"WITH {CELLS}, {_KEYS}, v AS (SELECT keyed.*, row, col, value FROM cells JOIN keyed USING (raster_id) WHERE crs_status = 'ok')"
ORACLE["map_difference"] = f"""{_KEYED_CELLS} SELECT s.model, s.variable, s.year, s.scenario, s.row, s.col, s.value - b.value AS difference, b.value AS baseline
FROM v s JOIN v b ON s.model = b.model AND s.variable = b.variable AND s.year = b.year AND s.row = b.row AND s.col = b.col AND b.scenario = 'base' WHERE s.scenario <> 'base'"""
ORACLE["cell_trend"] = f"""{_KEYED_CELLS} SELECT model, variable, scenario, row, col, count(*) AS years, round(regr_slope(value, year), 6) AS slope, round(regr_intercept(value, year), 6) AS intercept,
 round(regr_r2(value, year), 6) AS r2 FROM v WHERE value IS NOT NULL GROUP BY ALL"""

ORACLE["read_grid_files"] = ORACLE["read_grid_ranges"] = ORACLE["read_grid_cells"]
ORACLE["raster_range_files"] = ORACLE["raster_range"]
