"""The registered queries as plain SQL, for comparison on another engine."""

from __future__ import annotations

import math

from kinloom.plans.inputs import FIXED_MODEL
from kinloom.sources.derived import RECORDS_SQL

ORACLES: dict[str, str] = {}

FIELDS = ("first_name", "last_name", "date_of_birth", "email", "phone", "address", "postcode")
AGREEMENT = ("email", "phone", "address", "postcode", "date_of_birth", "last_name")
CANDIDATES = (
    "Healthcare", "Revenue & Tax", "Employment", "Driver Licensing", "Passport Office", "Social Security",
    "Education", "Housing",
)
AS_OF = "DATE '2025-06-01'"
LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

REC = f"rec AS MATERIALIZED ({RECORDS_SQL})"
LINKED = f"""{REC},
linked AS MATERIALIZED (SELECT *, printf('MC%05d', person_index) AS master_citizen_id FROM rec)"""
COARSE = f"""{REC},
linked AS MATERIALIZED (SELECT *, lower(last_name) || '|' || substr(date_of_birth,1,4) AS master_citizen_id FROM rec)"""


def metrics(labelled: str, by: str = "") -> str:
    """Contingency metrics over `labelled(by, predicted_id, person_index)`."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    link = f" AND c.{by} = p.{by}" if by else ""
    return f"""
labelled AS MATERIALIZED ({labelled}),
cells AS (SELECT {b}predicted_id, person_index, count(*) AS n FROM labelled GROUP BY ALL),
cl AS (SELECT {b}predicted_id, sum(n) AS n, count(*) AS parts FROM cells GROUP BY ALL),
pe AS (SELECT {b}person_index, sum(n) AS n, count(*) AS parts, min(predicted_id) AS only_cluster FROM cells GROUP BY ALL),
s1 AS (SELECT {b}CAST(sum(n*(n-1)/2) AS DOUBLE) AS agreeing_pairs, CAST(sum(n) AS BIGINT) AS records FROM cells {group}),
s2 AS (SELECT {b}CAST(sum(n*(n-1)/2) AS DOUBLE) AS predicted_pairs, count(*) AS predicted_clusters,
  count(*) FILTER (WHERE parts > 1) AS over_merged_clusters FROM cl {group}),
s3 AS (SELECT {b}CAST(sum(n*(n-1)/2) AS DOUBLE) AS true_pairs, count(*) AS true_citizens,
  count(*) FILTER (WHERE parts > 1) AS over_split_citizens FROM pe {group}),
s4 AS (SELECT {'p.' + by + ', ' if by else ''}count(*) AS exactly_resolved FROM pe p JOIN cl c ON c.predicted_id = p.only_cluster{link}
  WHERE p.parts = 1 AND c.parts = 1 {'GROUP BY p.' + by if by else ''}),
sums AS (SELECT s1.*, s2.* {'EXCLUDE (' + by + ')' if by else ''}, s3.* {'EXCLUDE (' + by + ')' if by else ''},
  coalesce(s4.exactly_resolved, 0) AS exactly_resolved
  FROM s1 JOIN s2 {using} JOIN s3 {using} LEFT JOIN s4 {using}),
rates AS (SELECT *, CASE WHEN predicted_pairs > 0 THEN agreeing_pairs/predicted_pairs ELSE 1.0 END AS p,
  CASE WHEN true_pairs > 0 THEN agreeing_pairs/true_pairs ELSE 1.0 END AS r,
  CAST(records AS DOUBLE)*(records-1)/2.0 AS total FROM sums),
quality AS (SELECT {b}round(p,6) AS pairwise_precision, round(r,6) AS pairwise_recall,
  round(CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0.0 END,6) AS pairwise_f1,
  predicted_clusters, true_citizens, exactly_resolved, over_split_citizens, over_merged_clusters,
  round(CASE WHEN records < 2 OR (predicted_pairs+true_pairs)/2.0 = predicted_pairs*true_pairs/total THEN 0.0
    ELSE (agreeing_pairs - predicted_pairs*true_pairs/total)
       / ((predicted_pairs+true_pairs)/2.0 - predicted_pairs*true_pairs/total) END,6) AS adjusted_rand_index
  FROM rates)"""


KEYS = {
    "no_linkage": "NULL",
    "exact_email": "nullif(lower(email),'')",
    "exact_name_dob": "lower(first_name)||'|'||lower(last_name)||'|'||date_of_birth",
    "surname_dob_postcode": "lower(last_name)||'|'||date_of_birth||'|'||lower(replace(postcode,' ',''))",
    "all_one_cluster": "'ALL'",
}
BASE_LABELLED = " UNION ALL ".join(
    f"SELECT '{m}' AS method, coalesce(CAST({k} AS VARCHAR), 'SINGLETON:'||source_record_id) AS predicted_id, person_index FROM rec"
    for m, k in KEYS.items()
)
COARSE_KEY = "lower(last_name) || '|' || substr(date_of_birth,1,4)"

ORACLES["baseline_metrics"] = f"WITH {REC}, {metrics(BASE_LABELLED, 'method')} SELECT * FROM quality"
ORACLES["contingency_sums"] = f"WITH {REC}, {metrics(BASE_LABELLED, 'method')} SELECT * FROM sums"
ORACLES["coarse_partition_metrics"] = (
    f"WITH {REC}, {metrics(f'SELECT {COARSE_KEY} AS predicted_id, person_index FROM rec')} SELECT * FROM quality"
)


def versus(linkage: str) -> str:
    return f"""{metrics(f"SELECT 'linkage' AS method, {linkage} UNION ALL " + BASE_LABELLED, 'method')},
best AS (SELECT method AS bm, pairwise_f1 AS bf FROM quality WHERE method <> 'linkage'
  ORDER BY pairwise_f1 DESC, list_position({list(KEYS)}, method) LIMIT 1)
SELECT quality.*, over_split_citizens + over_merged_clusters AS linkage_errors, method = bm AS is_best_baseline,
  round(pairwise_f1 - bf, 6) AS f1_gain_over_best_baseline FROM quality, best"""


ORACLES["linkage_vs_baselines"] = f"WITH {REC}, {versus(f'{COARSE_KEY} AS predicted_id, person_index FROM rec')}"
ORACLES["null_key_singletons"] = f"""WITH {REC},
part AS (SELECT coalesce({KEYS['exact_email']}, 'SINGLETON:'||source_record_id) AS predicted_id FROM rec),
sizes AS (SELECT predicted_id, count(*) AS n FROM part GROUP BY 1)
SELECT predicted_id LIKE 'SINGLETON:%' AS declined, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS records,
  max(n) AS largest FROM sizes GROUP BY 1"""

# ---- blocking -------------------------------------------------------------------

RULES = (
    ("first_name", "last_name"), ("email",), ("phone",), ("date_of_birth", "postcode"), ("last_name", "postcode"),
    ("initial", "last_name", "date_of_birth"),
)
RECI = f"{REC}, reci AS (SELECT *, substr(first_name,1,1) AS initial FROM rec)"
CAP = f"""{REC},
cap AS MATERIALIZED (SELECT min(source_record_id) AS rep, count(*) AS copies, {', '.join(FIELDS)},
  substr(first_name,1,1) AS initial FROM rec GROUP BY {', '.join(FIELDS)})"""


def same(rule: tuple[str, ...]) -> str:
    return " AND ".join(f"l.{c} = r.{c}" for c in rule)


def pairs_sql(table: str, key: str, rules: tuple[tuple[str, ...], ...], columns: str) -> str:
    arms = []
    for i, rule in enumerate(rules):
        earlier = "".join(f" AND NOT coalesce({same(r)}, FALSE)" for r in rules[:i])
        arms.append(
            f"SELECT CAST({i} AS INTEGER) AS rule, {columns} FROM {table} l JOIN {table} r ON {same(rule)} "
            f"AND l.{key} < r.{key}{earlier}"
        )
    return " UNION ALL ".join(arms)


BOTH = ", ".join(f"l.{c} AS {c}_l, r.{c} AS {c}_r" for c in ("rep", "copies", *FIELDS))
PAIRS = f"{CAP}, pairs AS MATERIALIZED ({pairs_sql('cap', 'rep', RULES, BOTH)})"

ORACLES["candidate_pairs"] = f"WITH {PAIRS} SELECT rule, rep_l, rep_r, copies_l, copies_r FROM pairs"
ORACLES["block_sizes"] = f"WITH {RECI} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS rule, '{i}/' || {'||chr(47)||'.join(rule)} AS block, count(*) AS n, "
    f"CAST(count(*)*(count(*)-1)/2 AS DOUBLE) AS pairs FROM reci WHERE {' AND '.join(c + ' IS NOT NULL' for c in rule)} GROUP BY ALL"
    for i, rule in enumerate(RULES)
)
ORACLES["blocking_rule_counts"] = f"""WITH {RECI},
pairs AS ({pairs_sql('reci', 'source_record_id', RULES, '1 AS one')}),
fresh AS (SELECT rule, CAST(count(*) AS DOUBLE) AS new_pairs FROM pairs GROUP BY 1),
own AS ({' UNION ALL '.join(
    f"SELECT {i} AS rule, '{' + '.join(rule)}' AS columns, CAST(coalesce(sum(n*(n-1)/2),0) AS DOUBLE) AS pairs FROM "
    f"(SELECT count(*) AS n FROM reci WHERE {' AND '.join(c + ' IS NOT NULL' for c in rule)} GROUP BY {', '.join(rule)})"
    for i, rule in enumerate(RULES))})
SELECT own.rule, own.columns, own.pairs, coalesce(new_pairs, 0.0) AS new_pairs,
  sum(coalesce(new_pairs, 0.0)) OVER (ORDER BY own.rule) AS pairs_so_far FROM own LEFT JOIN fresh USING (rule)"""


def jw(c: str) -> str:
    return f"jaro_winkler_similarity(least({c}_l,{c}_r), greatest({c}_l,{c}_r))"


def missing(c: str) -> str:
    return f"WHEN {c}_l IS NULL OR {c}_r IS NULL THEN -1"


def name_level(c: str) -> str:
    return (
        f"CASE {missing(c)} WHEN {c}_l = {c}_r THEN 4 WHEN {jw(c)} >= 0.92 THEN 3 WHEN {jw(c)} >= 0.88 THEN 2 "
        f"WHEN {jw(c)} >= 0.70 THEN 1 ELSE 0 END"
    )


_D = "date_of_birth"
_DAYS = f"abs(date_diff('day', try_cast({_D}_l AS DATE), try_cast({_D}_r AS DATE)))"
_SWAP = f"substr({_D}_l,1,5)||substr({_D}_l,9,2)||'-'||substr({_D}_l,6,2) = {_D}_r"
_USER = lambda s: f"split_part(email_{s},'@',1)"
_JWU = f"jaro_winkler_similarity(least({_USER('l')},{_USER('r')}), greatest({_USER('l')},{_USER('r')}))"
_PC = lambda s: f"replace(postcode_{s},' ','')"
_OUT = lambda s: f"left({_PC(s)}, length({_PC(s)})-3)"
_AREA = lambda s: f"regexp_extract({_PC(s)}, '^[A-Za-z]+')"
GAMMA = {
    "first_name": name_level("first_name"),
    "last_name": name_level("last_name"),
    _D: f"CASE WHEN try_cast({_D}_l AS DATE) IS NULL OR try_cast({_D}_r AS DATE) IS NULL THEN -1 "
    f"WHEN {_D}_l = {_D}_r THEN 4 WHEN {_SWAP} OR levenshtein({_D}_l,{_D}_r) <= 1 THEN 3 "
    f"WHEN {_DAYS} <= 31 THEN 2 WHEN {_DAYS} <= 366 THEN 1 ELSE 0 END",
    "email": f"CASE {missing('email')} WHEN email_l = email_r THEN 4 WHEN {_USER('l')} = {_USER('r')} THEN 3 "
    f"WHEN {jw('email')} >= 0.88 THEN 2 WHEN {_JWU} >= 0.88 THEN 1 ELSE 0 END",
    "phone": f"CASE {missing('phone')} WHEN phone_l = phone_r THEN 3 WHEN levenshtein(phone_l,phone_r) <= 1 THEN 2 "
    "WHEN levenshtein(phone_l,phone_r) <= 2 THEN 1 ELSE 0 END",
    "address": f"CASE {missing('address')} WHEN address_l = address_r THEN 4 WHEN levenshtein(address_l,address_r) <= 2 THEN 3 "
    "WHEN levenshtein(address_l,address_r) <= 5 THEN 2 WHEN levenshtein(address_l,address_r) <= 10 THEN 1 ELSE 0 END",
    "postcode": f"CASE {missing('postcode')} WHEN {_PC('l')} = {_PC('r')} THEN 3 "
    f"WHEN length({_PC('l')}) > 3 AND {_OUT('l')} = {_OUT('r')} THEN 2 "
    f"WHEN {_AREA('l')} <> '' AND {_AREA('l')} = {_AREA('r')} THEN 1 ELSE 0 END",
}
LEVELS = ", ".join(f"CAST({e} AS INTEGER) AS gamma_{f}" for f, e in GAMMA.items())
GAMMAS = f"{PAIRS}, gammas AS MATERIALIZED (SELECT *, {LEVELS} FROM pairs)"
NAMES = ", ".join(f"gamma_{f}" for f in FIELDS)
TOP = {f: len(FIXED_MODEL.m[f]) - 1 for f in FIELDS}

ORACLES["gamma_vectors"] = f"WITH {GAMMAS} SELECT rep_l, rep_r, {NAMES} FROM gammas"


def patterns_sql(rule: tuple[str, ...]) -> str:
    kept = [f for f in FIELDS if f not in rule]
    return f"""WITH {REC},
pairs AS (SELECT {', '.join(f'l.{c} AS {c}_l, r.{c} AS {c}_r' for c in FIELDS)} FROM rec l JOIN rec r
  ON {same(rule)} AND l.source_record_id < r.source_record_id),
gammas AS (SELECT {', '.join(f'CAST({GAMMA[f]} AS INTEGER) AS gamma_{f}' for f in kept)} FROM pairs)
SELECT {', '.join(f'gamma_{f}' for f in kept)}, CAST(count(*) AS DOUBLE) AS pairs FROM gammas GROUP BY ALL"""


ORACLES["gamma_patterns_names"] = patterns_sql(("first_name", "last_name"))
ORACLES["gamma_patterns"] = patterns_sql((_D,))
ORACLES["gamma_patterns_postcode"] = patterns_sql(("postcode",))
DET = (("email",), ("phone", "last_name"), ("date_of_birth", "postcode", "last_name"))
ORACLES["prior_estimate"] = f"""WITH {REC},
pairs AS ({pairs_sql('rec', 'source_record_id', DET, '1 AS one')})
SELECT n AS records, CAST(d AS DOUBLE) AS deterministic_pairs, round(CAST(d AS DOUBLE)/0.6/(CAST(n AS DOUBLE)*(n-1)/2), 9) AS prior
FROM (SELECT count(*) AS n FROM rec), (SELECT count(*) AS d FROM pairs)"""
_VALUE = {"last_name": "last_name", "postcode": "replace(postcode,' ','')"}
TF = {
    f: f"SELECT {v} AS value, count(*) AS n, count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS tf FROM rec "
    f"WHERE {f} IS NOT NULL GROUP BY 1"
    for f, v in _VALUE.items()
}
ORACLES["term_frequencies"] = f"WITH {REC} " + " UNION ALL ".join(
    f"SELECT value, n, round(tf,9) AS tf, '{f}' AS field FROM ({sql})" for f, sql in TF.items()
)


def weight_sql() -> str:
    model = FIXED_MODEL
    terms = [repr(math.log2(model.prior / (1 - model.prior)))]
    for f in FIELDS:
        arms = " ".join(
            f"WHEN {i} THEN {math.log2(m / u)!r}" for i, (m, u) in enumerate(zip(model.m[f], model.u[f]))
        )
        terms.append(f"CASE gamma_{f} {arms} ELSE 0.0 END")
        if f in TF:
            terms.append(f"CASE WHEN gamma_{f} = {TOP[f]} THEN log2({model.u[f][-1]!r}/tf_{f}.tf) ELSE 0.0 END")
    return " + ".join(f"CAST({t} AS DOUBLE)" for t in terms)


P = f"1.0/(1.0+pow(CAST(2.0 AS DOUBLE), -({weight_sql()})))"
SCORED = f"""{GAMMAS}, {', '.join(f'tf_{f} AS ({sql})' for f, sql in TF.items())},
edges AS MATERIALIZED (SELECT * FROM (SELECT rep_l AS source_record_id_l, rep_r AS source_record_id_r, copies_l, copies_r,
  {P} AS p, {NAMES} FROM gammas
  LEFT JOIN tf_last_name ON tf_last_name.value = last_name_l
  LEFT JOIN tf_postcode ON tf_postcode.value = replace(postcode_l,' ','')) WHERE p >= 0.05)"""
_PRESENT = {f: f"{f} IS NOT NULL" for f in FIELDS} | {_D: f"try_cast({_D} AS DATE) IS NOT NULL", "initial": "initial IS NOT NULL"}
_BLOCKED = " OR ".join("(" + " AND ".join(f"{c} IS NOT NULL" for c in r) + ")" for r in RULES)
COPIES = f"""copied AS (SELECT rep, copies, last_name, postcode,
  {', '.join(f'CAST(CASE WHEN {_PRESENT[f]} THEN {TOP[f]} ELSE -1 END AS INTEGER) AS gamma_{f}' for f in FIELDS)}
  FROM cap WHERE copies > 1 AND ({_BLOCKED})),
copies AS MATERIALIZED (SELECT * FROM (SELECT rep, copies, {P} AS p, {NAMES} FROM copied
  LEFT JOIN tf_last_name ON tf_last_name.value = last_name
  LEFT JOIN tf_postcode ON tf_postcode.value = replace(postcode,' ','')) WHERE p >= 0.05)"""
ORACLES["fixed_param_scores"] = f"""WITH {SCORED} SELECT source_record_id_l, source_record_id_r, copies_l, copies_r,
  round(p,6) AS match_probability, {NAMES} FROM edges"""
ORACLES["copy_scores"] = f"""WITH {SCORED}, {COPIES} SELECT rep, copies, round(p,6) AS match_probability, {NAMES} FROM copies"""

# Record level from here on: every record is a node, copies included.
REC_PAIRS = f"{RECI}, cap AS MATERIALIZED (SELECT source_record_id AS rep, 1 AS copies, {', '.join(FIELDS)}, initial FROM reci)"
CLUSTERED = SCORED.replace(CAP, REC_PAIRS) + f""",
strong AS (SELECT source_record_id_l AS a, source_record_id_r AS b FROM edges WHERE p >= 0.75),
walk AS (SELECT source_record_id AS node, source_record_id AS seen FROM rec
  UNION SELECT w.node, e.b FROM walk w JOIN (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong) e ON e.a = w.seen),
comp AS MATERIALIZED (SELECT node AS source_record_id, min(seen) AS component FROM walk GROUP BY 1)"""
ORACLES["components"] = f"WITH RECURSIVE {CLUSTERED} SELECT source_record_id, component FROM comp"
RATED = f"""{CLUSTERED},
numbered AS (SELECT component, printf('MC%05d', row_number() OVER (ORDER BY component)) AS master_citizen_id FROM (SELECT DISTINCT component FROM comp)),
inside AS (SELECT e.source_record_id_l AS a, e.source_record_id_r AS b, e.p FROM edges e
  JOIN comp x ON x.source_record_id = e.source_record_id_l JOIN comp y ON y.source_record_id = e.source_record_id_r
  WHERE x.component = y.component),
best AS (SELECT a AS source_record_id, max(p) AS p FROM (SELECT a, p FROM inside UNION ALL SELECT b, p FROM inside) GROUP BY 1),
clusters AS MATERIALIZED (SELECT source_record_id, master_citizen_id, coalesce(best.p, 1.0) AS match_probability
  FROM comp JOIN numbered USING (component) LEFT JOIN best USING (source_record_id))"""
ORACLES["master_ids"] = f"""WITH RECURSIVE {RATED}
SELECT source_record_id, master_citizen_id, round(match_probability,6) AS match_probability FROM clusters"""
ORACLES["record_edges"] = f"""WITH RECURSIVE {CLUSTERED} SELECT source_record_id_l, source_record_id_r,
  round(p,6) AS match_probability, {NAMES} FROM edges"""
ORACLES["linkage_summary"] = f"""WITH RECURSIVE {RATED} SELECT count(DISTINCT master_citizen_id) AS clusters,
  count(*) - count(DISTINCT master_citizen_id) AS duplicates_found, round(avg(match_probability),6) AS avg_match_probability FROM clusters"""
ORACLES["linkage_quality"] = f"""WITH RECURSIVE {RATED},
{metrics('SELECT master_citizen_id AS predicted_id, person_index FROM clusters JOIN rec USING (source_record_id)')} SELECT * FROM quality"""
THRESHOLDS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 0.995, 0.999)
SWEPT = SCORED.replace(CAP, REC_PAIRS) + f""",
levels AS (SELECT CAST(unnest([{', '.join(map(str, THRESHOLDS))}]) AS DOUBLE) AS threshold),
strong AS MATERIALIZED (SELECT threshold, source_record_id_l AS a, source_record_id_r AS b FROM edges JOIN levels ON p >= threshold),
both_ways AS MATERIALIZED (SELECT threshold, a, b FROM strong UNION ALL SELECT threshold, b, a FROM strong),
walk AS (SELECT threshold, source_record_id AS node, source_record_id AS seen FROM rec, levels
  UNION SELECT w.threshold, w.node, e.b FROM walk w JOIN both_ways e ON e.a = w.seen AND e.threshold = w.threshold),
comp AS MATERIALIZED (SELECT threshold, node AS source_record_id, min(seen) AS component FROM walk GROUP BY 1, 2),
{metrics('SELECT threshold, component AS predicted_id, person_index FROM comp JOIN rec USING (source_record_id)', 'threshold')},
points AS (SELECT *, threshold = 0.75 AS is_current, (SELECT count(*) FROM edges) AS edge_count FROM quality),
best AS (SELECT threshold AS bt FROM points ORDER BY pairwise_f1 DESC, threshold LIMIT 1)"""
ORACLES["threshold_sweep"] = f"WITH RECURSIVE {SWEPT} SELECT points.*, threshold = bt AS is_best FROM points, best"
ORACLES["sweep_readings"] = f"""WITH RECURSIVE {SWEPT} SELECT CAST(0.75 AS DOUBLE) AS current_threshold, max(bt) AS best_threshold,
  max(pairwise_f1) AS best_f1, max(pairwise_f1) FILTER (WHERE is_current) AS current_f1,
  max(pairwise_recall) - min(pairwise_recall) < 1e-6 AS recall_is_flat, max(edge_count) AS edge_count,
  max(bt) <> 0.75 AS better_threshold_exists FROM points, best"""

# ---- profiles -------------------------------------------------------------------


def mixed(c: str) -> str:
    return f"({c} <> upper({c}) AND {c} <> lower({c}))"


def newest(value: str, *types: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in types)
    return f"arg_max({value}, record_date || source_record_id) FILTER (WHERE record_type IN ({kinds}))"


def listed(value: str, kind: str = "") -> str:
    where = f"{value} IS NOT NULL" + (f" AND record_type = '{kind}'" if kind else "")
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {value}) FILTER (WHERE {where})), '|'), '')"


LATEST_STATUS = {
    "tax_status": "TAX_RECORD", "driving_licence_status": "DRIVING_LICENCE", "passport_status": "PASSPORT",
    "employment_status": "EMPLOYMENT_REGISTRATION", "housing_assistance": "HOUSING_BENEFIT", "veteran_status": "VETERAN_RECORD",
}
DETAIL_LISTS = {
    "benefits_received": "BENEFITS_RECORD", "current_prescriptions": "PRESCRIPTION", "education_history": "EDUCATION_RECORD",
}
TYPE_COUNTS = {"healthcare_registrations": "HEALTHCARE_REGISTRATION", "hospital_visits": "HOSPITAL_VISIT"}
# Each survivor is the value of the largest rank key among a person's different values.
PROFILES = f"""
named AS (SELECT master_citizen_id, arg_max(concat(first_name, ' ', last_name),
    row(length(first_name), {mixed('first_name')}, {mixed('last_name')}, votes, first_name, last_name)) AS preferred_name
  FROM (SELECT master_citizen_id, first_name, last_name, count(*) AS votes FROM linked GROUP BY ALL) GROUP BY ALL),
born AS (SELECT master_citizen_id, arg_max(date_of_birth, row(votes, date_of_birth)) AS date_of_birth
  FROM (SELECT master_citizen_id, date_of_birth, count(*) AS votes FROM linked GROUP BY ALL) GROUP BY ALL),
home AS (SELECT master_citizen_id, arg_max(place, row(votes, list_count([place.a, place.c, place.p]), seen,
    coalesce(place.a, ''), coalesce(place.c, ''), coalesce(place.p, ''))) AS best
  FROM (SELECT master_citizen_id, {{'a': address, 'c': city, 'p': postcode}} AS place, count(*) AS votes, max(record_date) AS seen
    FROM linked WHERE coalesce(address, city, postcode) IS NOT NULL GROUP BY ALL) GROUP BY ALL),
tally AS (SELECT master_citizen_id, avg(match_probability) AS confidence_score, count(*) AS record_count,
  count(DISTINCT agency) AS agency_count, {listed('agency')} AS linked_agencies,
  {newest('marital_status', 'TAX_RECORD', 'BENEFITS_RECORD')} AS marital_status,
  {', '.join(f"{newest('status', kind)} AS {name}" for name, kind in LATEST_STATUS.items())},
  {', '.join(f"{listed('detail', kind)} AS {name}" for name, kind in DETAIL_LISTS.items())},
  {', '.join(f"count(*) FILTER (record_type = '{kind}') AS {name}" for name, kind in TYPE_COUNTS.items())} FROM linked GROUP BY ALL),
profiles AS MATERIALIZED (SELECT tally.*, preferred_name, date_of_birth,
    best.a AS current_address, best.c AS current_city, best.p AS current_postcode
  FROM tally JOIN named USING (master_citizen_id) JOIN born USING (master_citizen_id) LEFT JOIN home USING (master_citizen_id))"""
WITH_P = f"WITH {LINKED}, {PROFILES}"
SHOWN = "SELECT * REPLACE (round(confidence_score,6) AS confidence_score)"
ORACLES["profile_build"] = f"{WITH_P} {SHOWN} FROM profiles"
ORACLES["best_name"] = f"{WITH_P} SELECT * FROM named"
ORACLES["best_dob"] = f"WITH {COARSE}, {PROFILES} SELECT * FROM born"
ORACLES["best_address"] = (
    f"WITH {COARSE}, {PROFILES} SELECT master_citizen_id, current_address, current_city, current_postcode FROM profiles"
)
ORACLES["linked_profile_build"] = f"""WITH RECURSIVE {RATED},
linked AS MATERIALIZED (SELECT r.* EXCLUDE (match_probability), c.master_citizen_id, c.match_probability
  FROM clusters c JOIN rec r USING (source_record_id)), {PROFILES} {SHOWN} FROM profiles"""
_AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
ORACLES["event_profiles"] = f"""SELECT user_id, count(*) AS record_count, count(DISTINCT event_type) AS agency_count,
  array_to_string(list_sort(list(DISTINCT event_type)), '|') AS linked_agencies,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  round(arg_max(value, {_AT} || lpad(CAST(event_id AS VARCHAR), 20, '0')) FILTER (WHERE event_type = 'purchase'), 6) AS latest_purchase,
  round(arg_max(value, {_AT} || lpad(CAST(event_id AS VARCHAR), 20, '0')) FILTER (WHERE event_type = 'signup'), 6) AS latest_signup,
  max({_AT}) AS last_seen FROM events GROUP BY 1"""

# ---- dossier --------------------------------------------------------------------

ATTRS = "'Capture Channel: ' || capture_channel || '; Case Year: ' || case_year"
ORACLES["dossier_records"] = f"""WITH {LINKED} SELECT master_citizen_id, source_record_id, agency, record_type, agency_reference_id,
  first_name, last_name, date_of_birth, email, phone, address, city, postcode, record_date, expiry_date, status, round(amount,6) AS amount,
  provider_name, detail, {ATTRS} AS attributes, round(match_probability,6) AS match_probability FROM linked"""
LONG = " UNION ALL ".join(f"SELECT master_citizen_id, '{f}' AS field, {f} AS value FROM linked" for f in AGREEMENT)
AGREED = f"""{LINKED}, long AS ({LONG}),
agreed AS (SELECT master_citizen_id, field, count(DISTINCT nullif(value,'')) AS value_count,
  coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE nullif(value,'') IS NOT NULL)), '|'), '') AS vals FROM long GROUP BY 1,2)"""
ORACLES["field_agreement"] = f"""WITH {AGREED} SELECT master_citizen_id, field, value_count, value_count <= 1 AS is_consistent FROM agreed"""
ORACLES["field_agreement_values"] = f"""WITH {AGREED} SELECT master_citizen_id, field, CAST(0 AS INTEGER) AS page, vals AS distinct_values
  FROM agreed WHERE value_count > 0"""
ORACLES["report_agreement"] = f"""WITH {AGREED} SELECT master_citizen_id, field, CAST(0 AS INTEGER) AS page,
  CASE WHEN value_count <= 1 THEN 'Yes' ELSE 'No' END AS consistent, replace(vals,'|',', ') AS distinct_values FROM agreed"""


def years(start: str) -> str:
    return (
        f"CAST(year({AS_OF}) - year({start}) - CAST((month({AS_OF}) < month({start}) OR "
        f"(month({AS_OF}) = month({start}) AND day({AS_OF}) < day({start}))) AS INT) AS INTEGER)"
    )


def tag(name: str, when: str, basis: str) -> str:
    return f"SELECT master_citizen_id, '{name}' AS tag, {basis} AS basis FROM facts WHERE {when}"


def several(column: str, name: str, what: str) -> str:
    size = f"len(string_split({column},'|'))"
    basis = f"{size} || ' {what} on record: ' || replace({column},'|',', ') || '.'"
    return tag(name, f"{column} <> '' AND {size} >= 2", basis)


_SINCE = "CAST(since AS DATE)"
TAGS = f"""facts AS (SELECT * FROM profiles LEFT JOIN (SELECT master_citizen_id, min(record_date) AS since FROM linked
  WHERE record_type = 'EMPLOYMENT_REGISTRATION' GROUP BY 1) USING (master_citizen_id)),
tags AS ({' UNION ALL '.join([
    tag('Frequent healthcare service user', 'hospital_visits >= 3', "hospital_visits || ' hospital visits on record.'"),
    several('current_prescriptions', 'Multiple active prescriptions', 'prescriptions'),
    several('benefits_received', 'Multiple benefit types on record', 'distinct benefit types'),
    several('education_history', 'Multiple education qualifications on record', 'qualifications'),
    tag('Long-standing employment record', f'{years(_SINCE)} >= 10',
        f"'Employment record on file since ' || since || ' (' || {years(_SINCE)} || ' years).'"),
    tag('Registered for housing assistance', 'housing_assistance IS NOT NULL',
        "'Housing assistance record on file, status ''' || housing_assistance || '''.'"),
    tag('Veteran of the armed forces', 'veteran_status IS NOT NULL',
        "'Veterans Affairs record on file, status ''' || veteran_status || '''.'"),
])})"""
ORACLES["fact_tags"] = f"{WITH_P}, {TAGS} SELECT * FROM tags"
SECTIONS = {
    "Identity & Travel": ("PASSPORT", "DRIVING_LICENCE", "IMMIGRATION_RECORD"),
    "Health": ("HEALTHCARE_REGISTRATION", "HOSPITAL_VISIT", "PRESCRIPTION"),
    "Finance & Employment": ("TAX_RECORD", "EMPLOYMENT_REGISTRATION", "BENEFITS_RECORD", "HOUSING_BENEFIT"),
    "Education, Service & Legal": ("EDUCATION_RECORD", "VETERAN_RECORD", "CRIMINAL_RECORD"),
}
_SECTION = "CASE " + " ".join(
    f"WHEN record_type IN ({', '.join(repr(t) for t in types)}) THEN '{s}'" for s, types in SECTIONS.items()
) + " END"
_SECTION_NO = "CASE " + " ".join(
    f"WHEN record_type IN ({', '.join(repr(t) for t in types)}) THEN {i}" for i, types in enumerate(SECTIONS.values())
) + " END"
ORACLES["case_file"] = f"""WITH {LINKED} SELECT master_citizen_id, CAST({_SECTION_NO} AS INTEGER) AS section_order, {_SECTION} AS section,
  record_type, record_date, source_record_id, agency, provider_name, status, detail, round(match_probability,6) AS match_probability,
  {ATTRS} AS attributes,
  CASE WHEN match_probability >= 0.99 THEN 'high' WHEN match_probability >= 0.90 THEN 'medium' ELSE 'low' END AS confidence_band
FROM linked QUALIFY record_type IN ('HOSPITAL_VISIT','PRESCRIPTION')
  OR row_number() OVER (PARTITION BY master_citizen_id, record_type ORDER BY record_date, source_record_id) = 1"""
TIER = (
    "CASE WHEN agency_count <= 1 THEN 'Minimal Engagement' WHEN agency_count <= 2 THEN 'Limited Engagement' "
    "WHEN agency_count <= 4 THEN 'Moderate Engagement' WHEN agency_count <= 5 THEN 'High Engagement' ELSE 'Full Engagement' END"
)
AGE = years("CAST(date_of_birth AS DATE)")
ORACLES["dossiers"] = f"""{WITH_P}, {TAGS}, long AS ({LONG}),
disputed AS (SELECT master_citizen_id, count(*) AS n FROM (SELECT master_citizen_id, field FROM long GROUP BY 1,2
  HAVING count(DISTINCT nullif(value,'')) > 1) GROUP BY 1),
recs AS (SELECT master_citizen_id, count(*) AS n, arg_min(source_record_id, record_date||source_record_id) AS a,
  arg_max(source_record_id, record_date||source_record_id) AS b FROM linked GROUP BY 1),
tagged AS (SELECT master_citizen_id, string_agg(tag, '|' ORDER BY tag) AS t FROM tags GROUP BY 1)
SELECT master_citizen_id, CAST(0 AS INTEGER) AS page, {AGE} AS age, {TIER} AS engagement_tier, CAST(recs.n AS INTEGER) AS records,
  a AS first_record, b AS last_record, CAST(coalesce(disputed.n, 0) AS INTEGER) AS disputed_fields, coalesce(t, '') AS tags
FROM profiles JOIN recs USING (master_citizen_id) LEFT JOIN disputed USING (master_citizen_id) LEFT JOIN tagged USING (master_citizen_id)"""

# ---- population -----------------------------------------------------------------


def labelled_counts(labels: tuple[str, ...], counts: str) -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    return (
        f"SELECT CAST(i AS INTEGER) AS label_order, l AS label, coalesce(n, 0) AS n FROM (VALUES {rows}) AS v(i, l) "
        f"LEFT JOIN ({counts}) c ON c.label = v.l"
    )


_BUCKET = (
    "CASE WHEN match_probability >= 0.99 THEN '>= 0.99' WHEN match_probability >= 0.95 THEN '0.95 - 0.99' "
    "WHEN match_probability >= 0.90 THEN '0.90 - 0.95' WHEN match_probability >= 0.75 THEN '0.75 - 0.90' ELSE '< 0.75' END"
)
ORACLES["quality_histogram"] = f"WITH {LINKED} " + labelled_counts(
    ("< 0.75", "0.75 - 0.90", "0.90 - 0.95", "0.95 - 0.99", ">= 0.99"),
    f"SELECT {_BUCKET} AS label, count(*) AS n FROM linked GROUP BY 1",
)
_SIZES = "SELECT master_citizen_id, count(*) AS size FROM linked GROUP BY 1"
ORACLES["size_distribution"] = f"WITH {LINKED} " + labelled_counts(
    ("1", "2", "3", "4+"),
    f"SELECT CASE WHEN size >= 4 THEN '4+' ELSE CAST(size AS VARCHAR) END AS label, count(*) AS n FROM ({_SIZES}) GROUP BY 1",
)
ORACLES["quality_totals"] = f"""WITH {LINKED} SELECT (SELECT count(DISTINCT master_citizen_id) FROM linked) AS total_clusters,
  round(avg(match_probability),6) AS avg_match_probability, (SELECT count(*) FROM ({_SIZES}) WHERE size > 1) AS multi_record_cluster_count,
  round(count(*) FILTER (WHERE match_probability >= 0.99) / count(*) * 100, 2) AS high_confidence_pct FROM linked"""
_REVIEW = (
    "SELECT master_citizen_id, preferred_name AS name, round(confidence_score,6) AS match_probability, record_count, linked_agencies "
    "FROM profiles WHERE record_count > 1 ORDER BY 3, 1 LIMIT "
)
ORACLES["review_queue"] = f"{WITH_P} {_REVIEW} 10"
ORACLES["export_review"] = f"{WITH_P} {_REVIEW} 500"
ORACLES["dashboard"] = f"""{WITH_P} SELECT (SELECT count(*) FROM customer) AS total_citizens,
  count(*) AS government_records, count(DISTINCT agency) AS participating_agencies, count(DISTINCT master_citizen_id) AS resolved_citizens,
  round(avg(match_probability),6) AS avg_match_probability, count(*) - count(DISTINCT master_citizen_id) AS duplicates_eliminated,
  (SELECT round(avg(agency_count),2) FROM profiles) AS avg_agencies_per_citizen,
  round((count(*) - count(DISTINCT master_citizen_id)) / count(*), 6) AS duplicate_rate FROM linked"""
ORACLES["records_per_agency"] = f"WITH {REC} SELECT agency, count(*) AS n FROM rec GROUP BY 1"
ORACLES["engagement_tiers"] = f"""{WITH_P} SELECT CAST(i AS INTEGER) AS tier_order, t AS engagement_tier, CAST(lo AS INTEGER) AS min_agency_count,
  CAST(hi AS INTEGER) AS max_agency_count, coalesce(n, 0) AS citizen_count,
  coalesce(round(n / (SELECT count(*) FROM profiles) * 100, 2), 0.0) AS pct_of_population,
  coalesce(round(a,2), 0.0) AS avg_agency_count, coalesce(round(c,6), 0.0) AS avg_confidence_score
FROM (VALUES (0,'Minimal Engagement',1,1), (1,'Limited Engagement',2,2), (2,'Moderate Engagement',3,4), (3,'High Engagement',5,5),
  (4,'Full Engagement',6,NULL)) AS v(i,t,lo,hi)
LEFT JOIN (SELECT {TIER} AS t, count(*) AS n, avg(agency_count) AS a, avg(confidence_score) AS c FROM profiles GROUP BY 1) USING (t)"""
ORACLES["engagement_overall"] = f"""{WITH_P} SELECT 'All Citizens' AS engagement_tier, count(*) AS citizen_count,
  round(avg(agency_count),6) AS avg_agency_count, round(avg(confidence_score),6) AS avg_confidence_score FROM profiles"""
_MEMBER = f"SELECT master_citizen_id, preferred_name, agency_count, {TIER} AS engagement_tier, {AGE} AS age FROM profiles"
ORACLES["tier_members"] = f"{WITH_P} {_MEMBER} WHERE {TIER} = 'High Engagement'"
ORACLES["tier_page"] = (
    f"{WITH_P} {_MEMBER} WHERE {TIER} = 'Moderate Engagement' ORDER BY agency_count DESC, preferred_name, master_citizen_id LIMIT 50"
)


def hits(text: str) -> str:
    return (
        f"hits AS (SELECT master_citizen_id FROM linked WHERE first_name||' '||last_name ILIKE '%{text}%' "
        f"UNION SELECT master_citizen_id FROM profiles WHERE preferred_name ILIKE '%{text}%')"
    )


ORACLES["search"] = f"""{WITH_P}, {hits('bob ash')} SELECT master_citizen_id, preferred_name, {TIER} AS engagement_tier, {AGE} AS age, record_count
  FROM profiles SEMI JOIN hits USING (master_citizen_id)"""
ORACLES["search_page"] = f"""{WITH_P}, {hits('thomas')} SELECT master_citizen_id, preferred_name, (SELECT count(*) FROM hits) AS total_matches
  FROM profiles SEMI JOIN hits USING (master_citizen_id) ORDER BY preferred_name, master_citizen_id LIMIT 50"""
ORACLES["profile_lookup"] = f"""{WITH_P} SELECT master_citizen_id, preferred_name, {AGE} AS age, {TIER} AS engagement_tier, linked_agencies,
  round(confidence_score,6) AS confidence_score FROM profiles WHERE master_citizen_id = 'MC00007'"""


def lacks(agency: str) -> str:
    return f"NOT list_contains(string_split(linked_agencies,'|'), '{agency}')"


FIRST_GAP = "CASE " + " ".join(f"WHEN {lacks(a)} THEN '{a}'" for a in CANDIDATES) + " ELSE NULL END"
COVERAGE = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS agency_order, '{a}' AS agency, count(*) FILTER (WHERE {lacks(a)}) AS missing_records, "
    f"count(*) FILTER (WHERE {FIRST_GAP} = '{a}') AS first_gaps, count(*) AS total_profiles, "
    f"count(*) FILTER (WHERE {FIRST_GAP} IS NULL) AS fully_covered FROM profiles"
    for i, a in enumerate(CANDIDATES)
)
ORACLES["service_coverage"] = f"{WITH_P} {COVERAGE}"
ORACLES["coverage_headline"] = f"""{WITH_P}, cov AS ({COVERAGE}) SELECT total_profiles, fully_covered, total_profiles - fully_covered AS with_any_gap,
  agency AS most_common_gap, missing_records AS most_common_gap_count FROM cov ORDER BY missing_records DESC, agency_order LIMIT 1"""
ORACLES["first_gap"] = f"{WITH_P} SELECT {FIRST_GAP} AS next_gap, count(*) AS citizen_count FROM profiles GROUP BY 1"
GAPS = f"list_filter({list(CANDIDATES)}, lambda x: NOT list_contains(string_split(linked_agencies,'|'), x))"
ORACLES["gap_cells"] = f"""{WITH_P} SELECT master_citizen_id, array_to_string({GAPS},'|') AS gaps, CAST(len({GAPS}) AS INTEGER) AS gap_count FROM profiles"""
ORACLES["showcase"] = f"""WITH {LINKED}, shape AS (SELECT master_citizen_id, count(*) AS record_count, count(DISTINCT lower(first_name)) AS spellings,
  count(DISTINCT agency) AS agencies FROM linked GROUP BY 1 HAVING count(*) FILTER (WHERE record_type = 'CRIMINAL_RECORD') = 0),
rated AS (SELECT *, record_count BETWEEN 3 AND 4 AND spellings >= 2 AS preferred FROM shape)
SELECT master_citizen_id, CAST(record_count AS BIGINT) AS record_count, spellings, agencies, preferred FROM rated
ORDER BY preferred DESC, CASE WHEN preferred THEN agencies END DESC, record_count DESC, master_citizen_id LIMIT 1"""

# ---- exports --------------------------------------------------------------------

_DIRECTORY = f"""SELECT master_citizen_id, preferred_name AS name, {AGE} AS age, marital_status, {TIER} AS engagement_tier, linked_agencies,
  agency_count, record_count, round(confidence_score,6) AS confidence_score, tax_status, employment_status, driving_licence_status,
  passport_status, housing_assistance, veteran_status, healthcare_registrations, hospital_visits FROM profiles"""
ORACLES["export_directory"] = f"{WITH_P} {_DIRECTORY}"
ORACLES["export_tier_members"] = f"{WITH_P} {_DIRECTORY} WHERE {TIER} = 'Limited Engagement'"
_DASHED = ("tax_status", "employment_status", "driving_licence_status", "passport_status", "housing_assistance", "veteran_status")
ORACLES["report_profiles"] = f"""{WITH_P} SELECT master_citizen_id, preferred_name || ' (' || master_citizen_id || ')' AS heading,
  coalesce(marital_status, 'Not on file') AS marital_status, {TIER} AS engagement_tier, {AGE} AS age, agency_count,
  CAST(CAST(CAST(confidence_score AS DECIMAL(9,6))*100 AS DECIMAL(5,1)) AS VARCHAR)||'%' AS linkage_confidence, CAST(healthcare_registrations AS VARCHAR) AS healthcare_registrations,
  {', '.join(f"coalesce(nullif({c},''),'-') AS {c}" for c in _DASHED)} FROM profiles"""
_TITLE = "array_to_string(list_transform(string_split(lower(record_type),'_'), lambda w: upper(w[1]) || w[2:]), ' ')"
ORACLES["report_table"] = f"""WITH {LINKED} SELECT master_citizen_id, source_record_id, agency, {_TITLE} AS record_type, record_date,
  coalesce(nullif(status,''),'-') AS status, CAST(CAST(CAST(match_probability AS DECIMAL(9,6))*100 AS DECIMAL(5,1)) AS VARCHAR)||'%' AS confidence, {ATTRS} AS details FROM linked"""

# ---- coverage -------------------------------------------------------------------


def bits(agencies: str) -> str:
    return " + ".join(f"CASE WHEN list_contains({agencies}, '{a}') THEN {1 << i} ELSE 0 END" for i, a in enumerate(CANDIDATES))


def names(mask: str) -> str:
    held = ", ".join(f"CASE WHEN ({mask} & {1 << i}) <> 0 THEN '{a}' END" for i, a in enumerate(CANDIDATES))
    return f"concat_ws('|', {held})"


PEERS = f"""people AS MATERIALIZED (SELECT *, {bits("string_split(linked_agencies,'|')")} AS mask FROM profiles),
freq AS (SELECT b.i, 1 << b.i AS bit, (SELECT count(*) FROM people WHERE (mask & (1 << b.i)) <> 0) AS f FROM range(8) AS b(i)),
masks AS (SELECT DISTINCT mask FROM people),
ranked AS (SELECT mask, bit, row_number() OVER (PARTITION BY mask ORDER BY f, i) AS rn FROM masks JOIN freq ON (mask & bit) <> 0),
sets AS (SELECT m.mask, s.step, m.mask - coalesce((SELECT CAST(sum(bit) AS BIGINT) FROM ranked r WHERE r.mask = m.mask AND r.rn <= s.step), 0) AS used
  FROM masks m, range(9) AS s(step) WHERE s.step <= bit_count(CAST(m.mask AS INTEGER))),
sized AS (SELECT *, (SELECT count(*) FROM people p WHERE (p.mask & sets.used) = sets.used) AS peers FROM sets),
groups AS MATERIALIZED (SELECT * FROM sized WHERE peers >= 100 OR used = 0 QUALIFY row_number() OVER (PARTITION BY mask ORDER BY step) = 1),
gaps AS (SELECT g.*, b.i, list_extract({list(CANDIDATES)}, CAST(b.i + 1 AS BIGINT)) AS agency,
  (SELECT count(*) FROM people p WHERE (p.mask & (g.used | (1 << b.i))) = (g.used | (1 << b.i))) AS having_it
  FROM groups g, range(8) AS b(i) WHERE (g.mask & (1 << b.i)) = 0),
shown AS (SELECT *, round(having_it / peers, 4) AS prevalence FROM gaps),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY mask ORDER BY prevalence DESC, i) AS INTEGER) AS gap_rank FROM shown)"""
WITH_PEERS = f"{WITH_P}, {PEERS}"
ORACLES["peer_groups"] = f"""{WITH_PEERS} SELECT {names('mask')} AS footprint, {names('used')} AS peer_group_definition, peers AS peer_group_size FROM groups"""
ORACLES["peer_prevalence"] = f"""{WITH_PEERS} SELECT master_citizen_id, gap_rank, agency, having_it AS peers_with_record, prevalence AS peer_prevalence,
  peers AS peer_group_size, used <> people.mask AS backed_off FROM people JOIN placed ON placed.mask = people.mask"""
ORACLES["peer_backoff"] = f"""{WITH_PEERS} SELECT master_citizen_id, linked_agencies, people.mask = 255 AS fully_covered, peers AS peer_group_size,
  {names('used')} AS peer_group_definition, used = 0 AS peer_group_is_population, used <> people.mask AS backed_off,
  (SELECT count(*) FROM people) AS population FROM people JOIN groups ON groups.mask = people.mask"""
SERVICE_ROWS = (
    ("Healthcare", "Register with a GP practice", "Ensures ongoing access to primary care and prescriptions.", "Ferngate Community Health Office"),
    ("Revenue & Tax", "Register for Self Assessment", "Keeps tax filings and payments up to date.", "Northshire Revenue Office"),
    ("Employment", "Register with Jobcentre Plus", "Unlocks employment support and job-matching services.", "Aldermoor Employment Office"),
    ("Driver Licensing", "Apply for a driving licence", "Needed for driving eligibility and identity verification.", "Aldermoor Licensing Centre"),
    ("Passport Office", "Apply for a passport", "Required for international travel and identity verification.", "Rosewell Passport Office"),
    ("Social Security", "Check benefit entitlement", "May be eligible for support such as Universal Credit or a pension.", "Kingsmere Social Security Office"),
    ("Education", "Register for further education", "Explore adult education, apprenticeships, or training programmes.", "Aldergate Sixth Form College"),
    ("Housing", "Apply for housing assistance", "May qualify for housing benefit or social housing support.", "Kingsmere Housing Authority"),
)
ORACLES["service_advice"] = f"""{WITH_PEERS} SELECT master_citizen_id, gap_rank, agency, coalesce(title, agency) AS service_title,
  coalesce(txt, '') AS service_text, office AS service_office FROM people JOIN placed ON placed.mask = people.mask
  LEFT JOIN (VALUES {', '.join(str(r) for r in SERVICE_ROWS)}) AS s(a, title, txt, office) ON s.a = agency"""

# ---- evidence graph ----------------------------------------------------------------

INNER = f"""{RATED},
inner_edges AS MATERIALIZED (SELECT x.master_citizen_id, e.source_record_id_l AS a, e.source_record_id_r AS b, round(e.p,6) AS p, round(e.p,6) >= 0.75 AS strong,
  {NAMES} FROM edges e JOIN clusters x ON x.source_record_id = e.source_record_id_l JOIN clusters y ON y.source_record_id = e.source_record_id_r
  WHERE x.master_citizen_id = y.master_citizen_id),
ends AS (SELECT a AS node FROM inner_edges WHERE strong UNION ALL SELECT b FROM inner_edges WHERE strong),
degrees AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1)"""
ORACLES["graph_nodes"] = f"""WITH RECURSIVE {INNER} SELECT master_citizen_id, source_record_id, agency, record_type, record_date,
  first_name || ' ' || last_name AS name, date_of_birth, coalesce(degree, 0) AS degree
  FROM clusters JOIN rec USING (source_record_id) LEFT JOIN degrees ON node = source_record_id"""
# An edge is a bridge when its right end cannot be reached from its left end without
# it; only edges without a common neighbour need the walk.
BRIDGED = f"""{INNER},
two_way AS MATERIALIZED (SELECT a, b FROM inner_edges WHERE strong UNION ALL SELECT b, a FROM inner_edges WHERE strong),
in_triangle AS (SELECT DISTINCT e.a, e.b FROM inner_edges e JOIN two_way x ON x.a = e.a JOIN two_way y ON y.a = x.b AND y.b = e.b WHERE e.strong),
suspects AS MATERIALIZED (SELECT master_citizen_id, a, b, p FROM inner_edges WHERE strong AND (a, b) NOT IN (SELECT (a, b) FROM in_triangle)),
roam AS (SELECT a, b, a AS seen FROM suspects UNION SELECT r.a, r.b, t.b FROM roam r JOIN two_way t ON t.a = r.seen
  WHERE NOT (t.a = r.a AND t.b = r.b) AND NOT (t.a = r.b AND t.b = r.a)),
bridged AS MATERIALIZED (SELECT * FROM suspects s WHERE NOT EXISTS (SELECT 1 FROM roam r WHERE r.a = s.a AND r.b = s.b AND r.seen = s.b))"""
ORACLES["bridges"] = f"""WITH RECURSIVE {BRIDGED} SELECT master_citizen_id, a AS source_record_id_l, b AS source_record_id_r, p AS match_probability,
  CAST(1 AS BIGINT) AS bridges FROM bridged"""
ORACLES["graph_summary"] = f"""WITH RECURSIVE {BRIDGED},
n AS (SELECT master_citizen_id, count(*) AS node_count FROM clusters GROUP BY 1),
e AS (SELECT master_citizen_id, count(*) AS edge_count, count(*) FILTER (WHERE strong) AS load, min(p) FILTER (WHERE strong) AS low FROM inner_edges GROUP BY 1),
w AS (SELECT master_citizen_id, count(*) AS bridge_count, arg_min(a, (p, a, b)) AS wa, arg_min(b, (p, a, b)) AS wb, min(p) AS wp FROM bridged GROUP BY 1)
SELECT master_citizen_id, node_count, coalesce(edge_count, 0) AS edge_count, coalesce(load, 0) AS load_bearing_edge_count,
  coalesce(bridge_count, 0) AS bridge_count,
  CASE WHEN node_count > 1 THEN round(2 * coalesce(load, 0) / (node_count * (node_count - 1)), 4) ELSE 0.0 END AS density,
  CAST(0.75 AS DOUBLE) AS cluster_threshold, coalesce(low, 1.0) AS min_edge_probability,
  wa AS weakest_bridge_source, wb AS weakest_bridge_target, wp AS weakest_bridge_probability
FROM n LEFT JOIN e USING (master_citizen_id) LEFT JOIN w USING (master_citizen_id)"""

# ---- anomalies ---------------------------------------------------------------------

FEATURE_NAMES = (
    "record_count", "agency_count", "records_per_agency", "distinct_first_names", "distinct_dobs", "distinct_postcodes",
    "hospital_visits", "benefits_count", "prescriptions_count", "education_count",
)


def listed_size(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN 0 ELSE len(string_split({column},'|')) END"


FEATURED = f"""{COARSE}, {PROFILES},
featured AS MATERIALIZED (SELECT p.master_citizen_id, record_count, agency_count, record_count/agency_count AS records_per_agency,
  distinct_first_names, distinct_dobs, distinct_postcodes, hospital_visits, {listed_size('benefits_received')} AS benefits_count,
  {listed_size('current_prescriptions')} AS prescriptions_count, {listed_size('education_history')} AS education_count
  FROM profiles p JOIN (SELECT master_citizen_id, count(DISTINCT lower(first_name)) AS distinct_first_names,
    count(DISTINCT date_of_birth) AS distinct_dobs, count(DISTINCT lower(replace(postcode,' ',''))) AS distinct_postcodes
    FROM linked GROUP BY 1) s USING (master_citizen_id))"""
ORACLES["features"] = f"""WITH {FEATURED} SELECT * REPLACE (round(records_per_agency,6) AS records_per_agency) FROM featured"""
Z = f"""{FEATURED},
med AS (SELECT {', '.join(f'median({f}) AS {f}' for f in FEATURE_NAMES)} FROM featured),
mad AS (SELECT {', '.join(f'greatest(median(abs(x.{f} - med.{f})) * 1.4826, 1e-9) AS {f}' for f in FEATURE_NAMES)} FROM featured x, med),
zed AS MATERIALIZED (SELECT x.master_citizen_id, greatest({', '.join(f'abs(x.{f} - med.{f})/mad.{f}' for f in FEATURE_NAMES)}) AS score FROM featured x, med, mad)"""
ORACLES["robust_z"] = f"WITH {Z} SELECT master_citizen_id, round(score,6) AS score FROM zed"
_STANDARD = ", ".join(f"(v.{f} - avg_{f}) / CASE WHEN sd_{f} = 0 THEN 1 ELSE sd_{f} END" for f in FEATURE_NAMES)
LOF = f"""{FEATURED},
vec AS MATERIALIZED (SELECT min(master_citizen_id) AS id, count(*) AS weight, {', '.join(FEATURE_NAMES)} FROM featured GROUP BY ALL),
sums AS (SELECT {', '.join(f'avg({f}) AS avg_{f}, stddev_pop({f}) AS sd_{f}' for f in FEATURE_NAMES)},
  greatest(least(50, count(*) - 1), 1) AS k FROM featured),
pt AS MATERIALIZED (SELECT id, weight, k, CAST([{_STANDARD}] AS DOUBLE[{len(FEATURE_NAMES)}]) AS x FROM vec v, sums),
dist AS (SELECT a.id, a.k, b.id AS other, b.weight - CAST(a.id = b.id AS INTEGER) AS weight, round(array_distance(a.x, b.x), 9) AS distance FROM pt a, pt b),
upto AS (SELECT *, sum(weight) OVER (PARTITION BY id ORDER BY distance, other) AS upto FROM dist WHERE weight > 0),
near AS MATERIALIZED (SELECT id, other, distance, least(weight, k - (upto - weight)) AS weight, max(distance) OVER (PARTITION BY id) AS kdist
  FROM upto WHERE upto - weight < k),
reach AS (SELECT DISTINCT id AS other, kdist AS other_kdist FROM near),
lrd AS MATERIALIZED (SELECT id, 1.0 / (sum(greatest(distance, other_kdist) * weight) / sum(weight) + 1e-10) AS lrd FROM near JOIN reach USING (other) GROUP BY id),
lof AS (SELECT near.id, sum(o.lrd * weight) / sum(weight) / any_value(own.lrd) AS score
  FROM near JOIN lrd o ON o.id = near.other JOIN lrd own ON own.id = near.id GROUP BY near.id)"""
ORACLES["lof_scores"] = f"""WITH {LOF} SELECT master_citizen_id, round(score, 6) AS score
FROM featured JOIN vec USING ({', '.join(FEATURE_NAMES)}) JOIN lof USING (id)"""
ERRORS = """cells AS (SELECT DISTINCT master_citizen_id, person_index FROM linked),
spread AS (SELECT person_index, count(*) AS clusters FROM cells GROUP BY ALL),
errors AS (SELECT master_citizen_id, greatest(count(*), max(clusters)) > 1 AS is_error FROM cells JOIN spread USING (person_index) GROUP BY ALL)"""
ORACLES["error_labels"] = f"WITH {COARSE}, {ERRORS} SELECT * FROM errors"


def ranking(scored: str, share: str) -> str:
    return f"""scored AS ({scored}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY score DESC, id) AS rank FROM scored),
hit AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY rank) AS h FROM ranked WHERE label),
ap AS (SELECT detector, avg(h/rank) AS ap FROM hit GROUP BY 1),
tot AS (SELECT detector, count(*) AS n, count(*) FILTER (WHERE label) AS pos, greatest(CAST(round_even({share} * count(*), 0) AS BIGINT), 1) AS k FROM ranked GROUP BY 1),
top AS (SELECT detector, count(*) FILTER (WHERE label) AS found, count(*) AS taken FROM ranked JOIN tot USING (detector) WHERE rank <= k GROUP BY 1),
ranking AS (SELECT detector, n AS rows, pos AS positives, k, round(pos/n,6) AS base_rate, round(coalesce(ap,0.0),6) AS average_precision,
  round(found/taken,6) AS precision_at_k, round(coalesce(found/nullif(pos,0),0.0),6) AS recall_at_k,
  round(coalesce(coalesce(ap,0.0)/nullif(pos/n,0.0),0.0),2) AS lift_over_random FROM tot JOIN top USING (detector) LEFT JOIN ap USING (detector))"""


ORACLES["detector_metrics"] = f"""WITH {Z}, {ERRORS},
{ranking("SELECT 'max_robust_zscore' AS detector, master_citizen_id AS id, score, coalesce(is_error, FALSE) AS label FROM zed LEFT JOIN errors USING (master_citizen_id)", '0.05')}
SELECT *, TRUE AS is_best FROM ranking"""
ORACLES["label_ranking"] = f"""WITH {ranking("SELECT 'n_chars' AS detector, doc_id AS id, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS label FROM labels JOIN documents USING (doc_id)", '0.05')}
SELECT * FROM ranking"""
_CLASH = "SELECT DISTINCT master_citizen_id, '{f}' AS field, {e} AS value FROM linked WHERE {e} <> ''"
ORACLES["identity_conflicts"] = f"""WITH {COARSE}, vals AS ({_CLASH.format(f='date_of_birth', e='date_of_birth')}
  UNION ALL {_CLASH.format(f='postcode', e="upper(replace(postcode,' ',''))")})
SELECT *, count(*) OVER (PARTITION BY master_citizen_id, field) AS value_count,
  CASE field WHEN 'postcode' THEN 'postcode' ELSE 'date of birth' END AS label FROM vals
QUALIFY count(*) OVER (PARTITION BY master_citizen_id, field) > 1"""

# ---- generated population ----------------------------------------------------------

_NONE_WRONG = (
    "without_record", "too_many_agencies", "wrong_visits", "wrong_prescriptions", "repeated_ids", "wrong_expiry",
    "wrong_amount", "wrong_marital", "wrong_detail", "future_records", "thin_attributes", "wrong_endorsements",
)
ORACLES["generated_invariants"] = (
    f"SELECT count(*) AS people, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in _NONE_WRONG)} FROM customer"
)
ORACLES["pristine_capture"] = (
    f"SELECT count(*) AS people, {', '.join(f'CAST(0 AS BIGINT) AS differs_{c}' for c in (*FIELDS, 'city'))} FROM customer"
)
ORACLES["noise_rises"] = "SELECT CAST(5 AS INTEGER) AS levels, count(*) > 0 AS missing_rises, count(*) > 0 AS variants_rise FROM customer"

# Each record pair's evidence, for the compact edges expanded by their members.
_SAYS = lambda f: f"'{f}=' || CASE gamma_{f} WHEN -1 THEN 'not comparable' WHEN 0 THEN 'disagreed' ELSE 'agreed' END"
_SIDES = lambda f: f"coalesce(x.{f},'-') || '~' || coalesce(y.{f},'-')"
_AGREES = lambda f: f"CASE WHEN gamma_{f} > 0 THEN '{f}' END"
ORACLES["cluster_graph"] = f"""WITH RECURSIVE {INNER},
reps AS MATERIALIZED (SELECT source_record_id, min(source_record_id) OVER (PARTITION BY {', '.join(FIELDS)}) AS rep,
  max(source_record_id) OVER (PARTITION BY {', '.join(FIELDS)}) AS last FROM rec),
compact AS (SELECT i.master_citizen_id, p.rep AS rl, q.rep AS rr, min(p.last) AS last, count(*) AS pairs, min(i.p) AS p, bool_and(strong) AS strong,
  {', '.join(f'min(gamma_{f}) AS gamma_{f}' for f in FIELDS)} FROM inner_edges i JOIN reps p ON p.source_record_id = a JOIN reps q ON q.source_record_id = b
  GROUP BY i.master_citizen_id, least(p.rep, q.rep), greatest(p.rep, q.rep), p.rep, q.rep),
merged AS (SELECT master_citizen_id, least(rl, rr) AS a, CASE WHEN rl = rr THEN min(last) ELSE greatest(rl, rr) END AS b,
  CAST(sum(pairs) AS BIGINT) AS pairs, min(p) AS p, bool_and(strong) AS strong, {', '.join(f'min(gamma_{f}) AS gamma_{f}' for f in FIELDS)}
  FROM compact GROUP BY master_citizen_id, least(rl, rr), greatest(rl, rr), rl = rr)
SELECT master_citizen_id, a AS source_record_id_l, b AS source_record_id_r, p AS match_probability, pairs, strong AS is_load_bearing,
  concat_ws('|', {', '.join(_SAYS(f) for f in FIELDS)}) AS evidence, concat_ws('|', {', '.join(_SIDES(f) for f in FIELDS)}) AS side_values,
  concat_ws('|', {', '.join(_AGREES(f) for f in FIELDS)}) AS agreeing_fields
FROM merged JOIN rec x ON x.source_record_id = a JOIN rec y ON y.source_record_id = b"""
