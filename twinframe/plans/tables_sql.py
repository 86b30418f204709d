"""DuckDB SQL for the queries of tables.py that SQL can express."""

from __future__ import annotations

from .. import vocab
from .tables import FILES, FOLDERS

W = r"regexp_extract_all(text, '[^ \n\t\r]+')"

ITEMS = f"""items AS (SELECT doc_id AS id, list_distinct({W}) AS tokens, sha256(text) AS body FROM documents),
tok AS (SELECT id, unnest(tokens) AS token FROM items),
dfs AS (SELECT token, count(*) AS df FROM tok GROUP BY token),
ix AS (SELECT * FROM items WHERE len(tokens) >= 4),
post AS (SELECT id, token FROM tok JOIN dfs USING (token) WHERE df > 1 AND df <= 16 AND id IN (SELECT id FROM ix)),
rare AS (SELECT x.id AS a, y.id AS b FROM post x JOIN post y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2),
ver AS (
  SELECT a, b, len(list_intersect(x.tokens, y.tokens)) / CAST(len(list_distinct(x.tokens || y.tokens)) AS DOUBLE) AS similarity
  FROM rare JOIN items x ON x.id = a JOIN items y ON y.id = b
),
good AS (SELECT * FROM ver WHERE similarity >= 0.55),
sides AS (SELECT a AS node, b AS other, similarity, a, b FROM good UNION ALL SELECT b, a, similarity, a, b FROM good),
placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY similarity DESC, other) AS place FROM sides),
edges AS (SELECT DISTINCT a, b, similarity FROM placed WHERE place <= 8)"""

EXACT = """firsts AS (SELECT id, body, row_number() OVER (PARTITION BY body ORDER BY id) AS n FROM {0}),
exact AS (SELECT x.id AS a, y.id AS b FROM firsts x JOIN firsts y ON x.body = y.body AND x.id < y.id WHERE x.n <= 16 AND y.n <= 16)"""

LINES = r"""units AS (SELECT doc_id AS unit, string_split(text, chr(10)) AS keys FROM documents),
flat AS (SELECT unit, unnest(keys) AS key, unnest(range(len(keys))) AS pos FROM units),
win AS (
  SELECT unit, pos AS start, list(key) OVER w AS ks FROM flat
  WINDOW w AS (PARTITION BY unit ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
),
wins AS (SELECT unit, start, sha256(array_to_string(ks, chr(31))) AS "window" FROM win WHERE len(ks) = 4),
rarew AS (SELECT "window", count(DISTINCT unit) AS df FROM wins GROUP BY 1 HAVING count(DISTINCT unit) BETWEEN 2 AND 8)"""

KEYS = """keys AS (
  SELECT p_brand AS cluster, unnest(['name:' || p_name, 'type:' || p_type, 'role:' || p_type || '|' || string_split(p_name, ' ')[1]]) AS key, p_partkey AS member FROM part
),
firsts AS (SELECT *, row_number() OVER (PARTITION BY cluster, key ORDER BY member) AS n FROM (SELECT DISTINCT * FROM keys)),
bp AS (SELECT DISTINCT x.cluster, x.member AS a, y.member AS b FROM firsts x JOIN firsts y ON x.cluster = y.cluster AND x.key = y.key AND x.member < y.member WHERE x.n <= 32 AND y.n <= 32)"""

JAC = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct({0} || {1})) AS DOUBLE) END"

TOPK = f"""{KEYS},
est AS (
  SELECT cluster, a, b, {JAC.format("list_distinct(string_split(x.p_name, ' '))", "list_distinct(string_split(y.p_name, ' '))")} AS estimate
  FROM bp JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b
),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY estimate DESC, a, b) AS n FROM est) WHERE n <= 400)"""

CONSTANTS = """c AS (
  SELECT p_partkey AS key, p_name || ' ' || p_brand AS name, list_sort(list_distinct([p_brand] || string_split(p_type, ' '))) AS items, 'f' || p_size AS file FROM part
),
ch AS (SELECT *, sha256(array_to_string(items, '|')) AS hash FROM c)"""


def listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


RECORDS = f"""f AS (SELECT p_partkey, {listed(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1] || '/' || replace(p_name, ' ', '/') || '/' || {listed(FILES)}[p_partkey % {len(FILES)} + 1] AS path FROM part),
g AS (SELECT *, string_split(lower(path), '/') AS parts, lower(string_split(path, '/')[-1]) AS name FROM f),
h AS (SELECT *, string_split(name, '.')[1] AS stem, string_split(name, '.')[-1] AS suffix, list_has_any(parts, {listed(vocab.FIXTURE_PARTS)}) AS fixture FROM g),
i AS (SELECT *, fixture OR list_has_any(parts, {listed(vocab.TEST_PARTS)}) OR starts_with(stem, 'test_') OR regexp_matches(stem, '_tests?$') OR regexp_matches(name, '\\.(test|spec)\\.') OR name IN ('conftest.py', 'tests.py') AS is_test FROM h)"""

PATH = r"regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)?', 1)"

SCORED = """m AS (
  SELECT l_partkey, count(*) AS members, count(DISTINCT l_suppkey) AS files, max(l_quantity) AS lines, max(l_discount) AS discount, max(l_tax) AS tax, count(*) FILTER (l_returnflag = 'R') AS returned
  FROM lineitem GROUP BY l_partkey
),
n AS (
  SELECT *, CASE WHEN members < 20 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (members - 19.0::DOUBLE) / 41.0::DOUBLE)) END AS r1,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (lines - 12.0::DOUBLE) / 108.0::DOUBLE)) AS r2,
    CASE WHEN files < 2 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (files - 1.0::DOUBLE) / 7.0::DOUBLE)) END AS r3,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, discount * 4)) AS risk0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, tax * 5)) AS cost0,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (members - 1.0::DOUBLE) / 39.0::DOUBLE)) AS stable,
    1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, files / 12.0::DOUBLE)) AS simple
  FROM m
),
scored AS (
  SELECT l_partkey, members, files, returned,
    floor(((CASE WHEN returned > 0 THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - ((1.0::DOUBLE - r1) * (1.0::DOUBLE - r2)) * (1.0::DOUBLE - r3)))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS payoff,
    floor(risk0 * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS risk, floor(cost0 * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS cost,
    floor(least(CASE WHEN cost0 >= 0.65::DOUBLE THEN 0.40::DOUBLE ELSE 1.0::DOUBLE END, greatest(0.35::DOUBLE, stable) * greatest(0.15::DOUBLE, simple) * greatest(0.20::DOUBLE, 1 - cost0)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS fit,
    floor((CASE WHEN returned >= 8 THEN 0.90::DOUBLE WHEN returned >= 4 THEN least(0.85::DOUBLE, 0.30::DOUBLE + 0.05::DOUBLE * returned) WHEN members >= 2 THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS detection
  FROM n
)"""

TIERED = f"""{SCORED},
tiered AS (
  SELECT *, CASE WHEN detection >= 0.75 THEN 'high' WHEN detection >= 0.45 THEN 'medium' WHEN detection > 0 THEN 'low' ELSE 'none' END AS detection_band,
    CASE WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.45 THEN 'medium' WHEN risk > 0 THEN 'low' ELSE 'none' END AS risk_band,
    CASE WHEN detection >= 0.75 AND payoff >= 0.45 AND risk < 0.30 THEN 'recommended_edit' WHEN detection >= 0.45 AND payoff >= 0.12 THEN 'review_candidate' WHEN detection > 0.18 THEN 'maintenance_note' ELSE 'observation' END AS tier,
    floor((detection * payoff * (1 - greatest(risk, cost))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score
  FROM scored
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY list_position(['recommended_edit', 'review_candidate', 'maintenance_note', 'observation'], tier), score DESC, l_partkey) AS rank FROM tiered
)"""


def one_of(key: str, names) -> str:
    return f"{listed(names)}[{key} % {len(names)} + 1]"


#: round() as Python's: printf rounds a double's exact value.
R4 = "CAST(printf('%.4f', {0}) AS DOUBLE)"

MEMBERS = ("declaration", "api", "interface", "trivial", "example", "test", "protocol", "constructor", "special")

DRAFTS = f"""m AS (
  SELECT l_partkey AS k, count(*) AS members, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_quantity) AS lines, count(DISTINCT l_suppkey % 7) AS files FROM lineitem GROUP BY 1
),
d AS (
  SELECT k, members % 8 AS member_count, CASE WHEN k % 5 = 0 THEN returned ELSE 0 END AS duplicate_pairs, CASE WHEN k % 5 = 1 THEN members ELSE 0 END AS blocks, CASE WHEN k % 5 = 2 AND returned % 2 = 0 THEN 1 ELSE 0 END AS constants,
    CASE WHEN k % 5 = 3 THEN members ELSE 0 END AS relation_pairs, CASE WHEN k % 10 = 0 THEN returned ELSE 0 END AS body_matches, k % 5 = 4 AS wrapped, (returned % 2 = 0)::INT + (returned % 3 = 0)::INT AS support,
    members % 2 = 0 AS parameter_use, members % 3 = 0 AS template, {one_of("returned", ("1.0", "0.9", "0.75", "0.85"))}::DOUBLE AS times, k % 7 = 0 AS skeleton, k % 6 = 0 AS clean, k % 3 = 1 AS analogous,
    returned / members::DOUBLE AS confidence, (members % 10) / 10::DOUBLE AS relatedness, (returned % 7) / 8::DOUBLE AS refactorability, (members % 8) / 8::DOUBLE AS tree, members % 6 AS stable, returned % 4 AS holes, members % 9 AS hole_size,
    (returned % 5) / 5::DOUBLE AS cost0, CASE WHEN k % 4 = 0 THEN 0::DOUBLE ELSE (members % 11) / 16::DOUBLE END AS risk0, returned % 3 AS risks, k % 2 AS shared, members % 2 AS declared, returned % 2 AS unresolved,
    (k % 8 = 0)::INT AS ambiguous, k % 9 = 0 AS divergent, lines + members AS line_span, members % 20 AS block_lines, members % 14 AS body_lines, files, k % 4 AS roles, returned AS same_role_pairs,
    CASE WHEN k % 13 = 9 THEN 0 ELSE members % 8 END AS covered, {', '.join(f"CASE WHEN k % 13 = {i} THEN members % 8 ELSE 0 END AS {n}_members" for i, n in enumerate(MEMBERS))},
    {one_of("k", vocab.TIERS)} AS tier, {one_of("members", ("consolidate_clone", "extract_small_helper", "reuse_existing_helper", "introduce_abstraction", "record_shared_concern", "inspect_shared_lifecycle"))} AS action, {one_of("returned", ("recommended", "cautious"))} AS status
  FROM m
)"""


def unit(x: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"


def bands(c: str, high: float, medium: float) -> str:
    return f"CASE WHEN {c} >= {high} THEN 'high' WHEN {c} >= {medium} THEN 'medium' WHEN {c} > 0 THEN 'low' ELSE 'none' END AS {c}_band"


ASSESSED = f"""{DRAFTS},
e AS (
  SELECT *, duplicate_pairs > 0 OR body_matches > 0 OR blocks > 0 OR constants > 0 AS exact, relation_pairs > 0 AS related, greatest(confidence, relatedness * 0.85::DOUBLE) AS base, {unit("(stable - 1) / 4::DOUBLE")} AS stable_ramp FROM d
),
f AS (
  SELECT *, CASE WHEN constants > 0 THEN 0.98::DOUBLE WHEN blocks > 0 OR duplicate_pairs > 0 THEN greatest(0.9::DOUBLE, confidence)
      WHEN related THEN least(0.85::DOUBLE, (CASE WHEN base = 0 THEN 0.3::DOUBLE ELSE base END) + support * 0.05::DOUBLE)
      WHEN wrapped THEN CASE WHEN parameter_use THEN 0.72::DOUBLE ELSE 0.58::DOUBLE END WHEN member_count >= 2 THEN 0.18::DOUBLE ELSE 0::DOUBLE END AS found,
    {unit("""greatest(refactorability, CASE WHEN body_matches > 0 THEN 0.95::DOUBLE ELSE 0 END, CASE WHEN blocks > 0 THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN constants > 0 THEN 0.85::DOUBLE ELSE 0 END, CASE WHEN duplicate_pairs > 0 THEN 0.9::DOUBLE ELSE 0 END,
      CASE WHEN related THEN greatest(0.65::DOUBLE, tree * 0.75::DOUBLE, relatedness * 0.8::DOUBLE) ELSE 0 END, CASE WHEN member_count >= 2 THEN 0.15::DOUBLE ELSE 0 END) + CASE WHEN shared > 0 AND related AND stable >= 2 THEN 0.05::DOUBLE ELSE 0 END""")} AS common,
    CASE WHEN skeleton THEN 0.85::DOUBLE WHEN NOT (holes > 0 OR hole_size > 0 OR template) AND related AND NOT exact THEN 0.55::DOUBLE
      ELSE least(1 - {unit("holes / 4::DOUBLE")}, 1 - {unit("hole_size / 8::DOUBLE")}) END AS simple,
    least(CASE WHEN cost0 >= 0.65::DOUBLE THEN 0.4::DOUBLE ELSE 1 END, CASE WHEN risk0 >= 0.35::DOUBLE THEN 0.45::DOUBLE WHEN risk0 > 0 THEN greatest(0.45::DOUBLE, 1 - risk0) ELSE 1 END, CASE WHEN stable <= 1 AND related AND NOT skeleton AND NOT exact THEN 0.35::DOUBLE ELSE 1 END) AS most,
    CASE WHEN risk0 > 0 THEN risk0 ELSE least(1::DOUBLE, 0.12::DOUBLE * (risks + analogous::INT)) END AS structural,
    greatest(least(1::DOUBLE, 0.18::DOUBLE * declared + 0.08::DOUBLE * unresolved + 0.12::DOUBLE * ambiguous), CASE WHEN divergent THEN 0.45::DOUBLE ELSE 0 END) AS semantic,
    CASE WHEN blocks > 0 OR duplicate_pairs > 0 THEN 1::DOUBLE WHEN related THEN 0.65::DOUBLE WHEN member_count >= 2 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS quality,
    CASE WHEN member_count < 2 THEN 0::DOUBLE ELSE {unit("(member_count - 1) / 5::DOUBLE")} END AS by_members, CASE WHEN files < 2 THEN 0::DOUBLE ELSE {unit("(files - 1) / 4::DOUBLE")} END AS by_files,
    greatest({unit("(line_span - 12) / 108::DOUBLE")}, {unit("(block_lines - 6) / 12::DOUBLE")}) AS by_volume, [0.7, 1.0, 0.45, 1.0][roles + 1]::DOUBLE AS exposure
  FROM e
),
g AS (
  SELECT *, CASE WHEN exact THEN greatest(common, stable_ramp) WHEN related THEN common * greatest(0.35::DOUBLE, stable_ramp) ELSE common END AS commonality, quality * {unit("1 - (1 - by_members) * (1 - by_volume) * (1 - by_files)")} * exposure AS worth FROM f
),
h AS (
  SELECT k AS l_partkey, {R4.format("least(1::DOUBLE, found * times)")} AS detection, {R4.format(unit("least(" + unit(unit("commonality") + " * " + unit("greatest(0.15::DOUBLE, simple)") + " * " + unit("greatest(0.2::DOUBLE, 1 - " + unit("cost0") + ")")) + ", most)"))} AS fit,
    {R4.format(unit("cost0"))} AS cost, {R4.format("greatest(structural, semantic)")} AS risk, {R4.format(unit("CASE WHEN roles = 3 THEN least(0.1::DOUBLE, worth) ELSE worth END"))} AS payoff
  FROM g
),
assessed AS (SELECT *, {bands("detection", 0.75, 0.45)}, {bands("fit", 0.75, 0.45)}, {bands("payoff", 0.75, 0.45)}, {bands("risk", 0.65, 0.30)} FROM h)"""

EDITS = "('consolidate_clone', 'extract_small_helper', 'reuse_existing_helper', 'introduce_abstraction')"
NOTES = "('record_shared_concern', 'inspect_shared_lifecycle')"

DECIDED = f"""{ASSESSED},
v AS (
  SELECT * EXCLUDE (tier, status, action), action AS asked, duplicate_pairs > 0 OR body_matches > 0 OR blocks > 0 OR constants > 0 AS exact, CASE WHEN blocks > 0 THEN block_lines ELSE body_lines END AS body,
    clean AND (body_matches > 0 OR tree >= 0.95) AND same_role_pairs >= CASE WHEN duplicate_pairs > 0 THEN duplicate_pairs ELSE relation_pairs END AS clone,
    (NOT clean)::INT + (NOT (body_matches > 0 OR tree >= 0.95))::INT + (same_role_pairs < CASE WHEN duplicate_pairs > 0 THEN duplicate_pairs ELSE relation_pairs END)::INT AS not_clone
  FROM assessed JOIN d ON k = l_partkey
),
w AS (SELECT *, blocks > 0 AND body >= 5 AS block, detection < 0.35 AS unsure FROM v),
x AS (
  SELECT *, asked IN {EDITS} AND NOT (payoff >= 0.12 OR block OR (asked = 'consolidate_clone' AND skeleton)) AS unpaid,
    CASE asked WHEN 'consolidate_clone' THEN not_clone + (risk > 0.3)::INT + (cost > 0.25)::INT
      WHEN 'extract_small_helper' THEN (blocks > 0 AND NOT block)::INT + 2 * (blocks = 0 AND NOT wrapped)::INT + (body NOT BETWEEN 1 AND 12)::INT + (cost > 0.25)::INT + (risk > 0.2)::INT
      WHEN 'reuse_existing_helper' THEN 4 * (NOT wrapped)::INT + (risk >= 0.65)::INT + (cost >= 0.65)::INT
      WHEN 'introduce_abstraction' THEN (stable < 2 AND constants = 0)::INT + (holes > 2)::INT + (hole_size > 3)::INT + (risk > 0.2)::INT + (cost > 0.45)::INT + analogous::INT
      ELSE (detection = 0)::INT END AS others
  FROM w
),
y AS (
  SELECT *, unsure::INT + unpaid::INT + others AS failed,
    CASE WHEN unsure::INT + unpaid::INT + others = 0 THEN asked WHEN unsure THEN 'observe' WHEN unpaid AND others = 0 THEN asked
      WHEN asked IN ('introduce_abstraction', 'extract_small_helper') THEN CASE WHEN detection > 0 THEN 'record_shared_concern' ELSE 'observe' END WHEN asked = 'consolidate_clone' THEN 'do_not_refactor' ELSE asked END AS action
  FROM x
),
z AS (SELECT *, CASE WHEN action IN {EDITS} THEN {R4.format("detection * fit * payoff * (1 - greatest(risk, cost))")} ELSE 0::DOUBLE END AS score FROM y),
aa AS (
  SELECT *, CASE WHEN action = 'do_not_refactor' THEN 'not_recommended' WHEN action = 'observe' OR action IN {NOTES} THEN 'cautious' WHEN risk >= 0.65 OR cost >= 0.65 THEN 'not_recommended' WHEN failed > 0 AND action = asked THEN 'cautious'
      WHEN action = 'consolidate_clone' AND (skeleton OR score >= 0.12) THEN 'recommended' WHEN action = 'introduce_abstraction' AND constants > 0 AND risk <= 0.2 AND cost <= 0.45 THEN 'recommended'
      WHEN action = 'extract_small_helper' AND block AND risk <= 0.2 AND cost <= 0.25 THEN 'recommended' WHEN score >= 0.42 AND risk < 0.3 THEN 'recommended' ELSE 'cautious' END AS status,
    action IN {EDITS} AS edit, action IN {NOTES} AS note, action = 'consolidate_clone' AND clone AS pure, action = 'extract_small_helper' AND blocks > 0 AS helper, action = 'reuse_existing_helper' AND wrapped AS reuse,
    detection_band IN ('high', 'medium') AS sure, payoff_band IN ('high', 'medium') AS pays, fit_band IN ('high', 'medium') AS fits
  FROM z
),
ab AS (SELECT *, note AND (exact OR relation_pairs > 0 OR wrapped) AND detection >= 0.75 AND payoff_band = 'high' AND (risk_band IN ('high', 'medium') OR cost >= 0.65) AS concern FROM aa),
ac AS (SELECT *, CASE WHEN reuse THEN greatest(0.12::DOUBLE, score) WHEN edit THEN score WHEN concern THEN {R4.format("detection * payoff * greatest(risk, cost)")} ELSE 0::DOUBLE END AS attention FROM ab),
decided AS (
  SELECT *, CASE WHEN edit AND status = 'recommended' AND (score >= 0.42 OR pure OR (helper AND body BETWEEN 5 AND 12)) AND (detection_band = 'high' OR pure) AND (pays OR pure) AND fits AND risk_band IN ('none', 'low') THEN 'recommended_edit'
      WHEN attention >= 0.12 AND ((edit AND sure AND risk_band <> 'high' AND (reuse OR ((pays OR pure) AND fits AND (pays OR status = 'recommended')))) OR concern) THEN 'review_candidate'
      WHEN (note AND sure) OR (action = 'do_not_refactor' AND detection_band = 'high' AND pays) OR (edit AND sure AND (helper OR fit_band = 'low' OR payoff_band = 'low')) THEN 'maintenance_note' ELSE 'observation' END AS tier
  FROM ac
)"""

CAPPED = f"""{DRAFTS},
r AS (
  SELECT *, greatest(member_count, 1) AS n, body_lines >= 8 AND stable >= 5 AND same_role_pairs >= relation_pairs AND files = 1 AS solid FROM d
),
s AS (
  SELECT *, CASE {' '.join(f"WHEN {when} THEN '{rule}'" for rule, when in (
    ("declaration", "declaration_members / n >= 0.8"), ("interface", "interface_members / n >= 0.8"), ("trivial_body", "trivial_members / n >= 0.8"), ("broad_parent", "relation_pairs > 0 AND covered / n < 0.8"), ("example", "example_members / n >= 0.8"),
    ("test", "test_members > 0 AND NOT (member_count = 2 AND test_members = 2 AND clean)"), ("protocol_or_api", "protocol_members / n >= 0.8 OR api_members / n >= 0.8"), ("constructor", "constructor_members / n >= 0.8"), ("special_method", "special_members / n >= 0.8")))} END AS rule FROM r
),
t AS (
  SELECT *, CASE rule WHEN 'declaration' THEN CASE WHEN api_members / n >= 0.8 THEN 'maintenance_note' ELSE 'observation' END WHEN 'interface' THEN 'observation' WHEN 'trivial_body' THEN 'maintenance_note' WHEN 'broad_parent' THEN 'maintenance_note'
    WHEN 'example' THEN 'observation' WHEN 'test' THEN 'review_candidate' WHEN 'protocol_or_api' THEN CASE WHEN solid THEN 'review_candidate' ELSE 'maintenance_note' END WHEN 'constructor' THEN 'review_candidate'
    WHEN 'special_method' THEN CASE WHEN body_lines <= 5 THEN 'maintenance_note' ELSE 'review_candidate' END ELSE 'recommended_edit' END AS most FROM s
),
u AS (SELECT *, list_position({listed(vocab.TIERS)}, tier) < list_position({listed(vocab.TIERS)}, most) AS lowered FROM t)"""

SETS = """sets AS (SELECT l_orderkey AS key, list_sort(list(DISTINCT CAST(CAST(l_quantity % 9 AS INTEGER) AS VARCHAR))) AS members FROM lineitem GROUP BY 1)"""

NAME = """CASE WHEN l = r THEN 1.0::DOUBLE
  WHEN abs(length(l) - length(r)) > greatest(length(l), length(r)) * 0.5 THEN 0.0::DOUBLE
  WHEN j = 0 THEN 0.0::DOUBLE
  WHEN j < 0.5 AND NOT (starts_with(l, r) OR starts_with(r, l) OR ends_with(l, r) OR ends_with(r, l)) THEN j
  ELSE 1.0::DOUBLE - levenshtein(l, r) / CAST(greatest(length(l), length(r)) AS DOUBLE) END"""

ROLES = "roles AS (SELECT conv_id, list(role ORDER BY turn, role) AS x FROM conversations GROUP BY conv_id), both_ AS (SELECT l.conv_id, l.x, r.x AS y FROM roles l JOIN roles r ON r.conv_id = l.conv_id + 1)"


def oracle_sql() -> dict[str, str]:
    same = "len(list_filter(range(1, least(len({0}), len({1})) + 1), lambda i: {0}[1:i] = {1}[1:i]))"
    return {
        "lines_as_statements": f"WITH {LINES} SELECT unit AS doc_id, pos, sha256(key) AS line_hash, row_number() OVER (PARTITION BY key ORDER BY unit, pos) AS ordinal FROM flat",
        "exact_body_groups": "SELECT sha256(text) AS body_hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "token_document_frequency": f"WITH {ITEMS} SELECT token, df FROM dfs",
        "rare_tokens": f"WITH {ITEMS} SELECT token, df FROM dfs WHERE df > 1 AND df <= 16",
        "content_edges": f"WITH {ITEMS} SELECT a AS left_id, b AS right_id, similarity FROM edges",
        "similarity_pairs": f"WITH {ITEMS} SELECT a AS left_id, b AS right_id, similarity FROM good",
        "top8_neighbours": f"WITH {ITEMS} SELECT node, other AS neighbour, similarity, place FROM placed WHERE place <= 8",
        "shared_windows": f'WITH {LINES} SELECT "window", df FROM rarew',
        "maximal_runs": f"""WITH {LINES},
hits AS (SELECT unit, start, "window" FROM wins JOIN rarew USING ("window")),
seeds AS (SELECT x.unit AS a, y.unit AS b, x.start AS s, x.start - y.start AS d FROM hits x JOIN hits y ON x."window" = y."window" AND x.unit < y.unit),
diag AS (SELECT DISTINCT a, b, d FROM seeds),
along AS (SELECT a, b, d, x.pos AS p FROM diag JOIN flat x ON x.unit = a JOIN flat y ON y.unit = b AND y.pos = x.pos - d AND y.key = x.key),
isl AS (SELECT *, p - row_number() OVER (PARTITION BY a, b, d ORDER BY p) AS i FROM along),
runs AS (SELECT a, b, d, min(p) AS s0, count(*) AS n FROM isl GROUP BY a, b, d, i)
SELECT DISTINCT runs.a AS left_id, runs.b AS right_id, s0 AS left_start, s0 - runs.d AS right_start, n AS length
FROM runs JOIN seeds ON seeds.a = runs.a AND seeds.b = runs.b AND seeds.d = runs.d AND s >= s0 AND s < s0 + n""",
        "connected_components": f"""WITH RECURSIVE {ITEMS},
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, root) AS (SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT node AS doc_id, min(root) AS component FROM reach GROUP BY node""",
        "bucket_pairs": f"WITH {KEYS} SELECT cluster, a AS left_id, b AS right_id FROM bp",
        "bucket_cut_counts": f"WITH {KEYS}, s AS (SELECT cluster, key, count(*) AS n FROM firsts GROUP BY 1, 2) SELECT cluster, CAST(sum(greatest(n - 32, 0)) AS BIGINT) AS cut FROM s GROUP BY cluster",
        "candidate_topk": f"WITH {TOPK} SELECT cluster, a AS left_id, b AS right_id, estimate FROM top",
        "name_similarity": f"""WITH names AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(p_name) FROM part),
p AS (SELECT x.name AS l, y.name AS r, {JAC.format("list_distinct(string_split(x.name, ' '))", "list_distinct(string_split(y.name, ' '))")} AS j FROM names x JOIN names y ON substr(x.name, 1, 1) = substr(y.name, 1, 1) AND x.name < y.name)
SELECT l AS left_name, r AS right_name, {NAME} AS similarity FROM p""",
        "identifier_tokens": r"""WITH both_ AS (
  SELECT p_partkey AS key, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', '') || '_' || replace(p_type, ' ', 'HTTP2x') AS identifier FROM part
  UNION ALL SELECT -c_custkey, c_name FROM customer
), t AS (
  SELECT key, identifier, list_transform(regexp_extract_all(replace(regexp_replace(regexp_replace(identifier, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), '[A-Za-z0-9]+'), lambda w: lower(w)) AS ws FROM both_
)
SELECT key, identifier, array_to_string(ws, ' ') AS normalized, len(ws) AS n_tokens FROM t""",
        "constant_identical": f"WITH {CONSTANTS} SELECT name AS symbols, count(*) AS members, count(DISTINCT file) AS files, count(*) AS line_span FROM ch GROUP BY name, hash HAVING count(*) > 1",
        "constant_drifted": f"""WITH {CONSTANTS},
per AS (SELECT name, count(DISTINCT hash) AS variants, count(DISTINCT file) AS files, min(len(items)) AS smallest FROM ch GROUP BY name HAVING count(DISTINCT hash) > 1 AND count(DISTINCT file) > 1),
it AS (SELECT DISTINCT name, hash, unnest(items) AS item FROM ch),
has AS (SELECT name, item, count(*) AS n FROM it GROUP BY 1, 2),
com AS (SELECT name, count(*) AS common FROM has JOIN per USING (name) WHERE n = variants GROUP BY name)
SELECT name AS symbols, variants, files, coalesce(common, 0) / CAST(smallest AS DOUBLE) AS overlap FROM per LEFT JOIN com USING (name) WHERE coalesce(common, 0) / CAST(smallest AS DOUBLE) >= 0.5""",
        "constant_scattered": f"WITH {CONSTANTS} SELECT array_to_string(list_sort(list(DISTINCT name)), ',') AS symbols, count(*) AS members FROM ch GROUP BY hash HAVING count(DISTINCT name) > 1",
        "file_records": f"""WITH {RECORDS} SELECT p_partkey, path,
CASE {' '.join(f"WHEN suffix = '{k}' THEN '{v}'" for k, v in vocab.LANGUAGES.items())} ELSE 'unknown' END AS language,
CASE WHEN list_has_any(parts, {listed(vocab.VENDOR_PARTS)}) THEN 'vendor' WHEN list_has_any(parts, {listed(vocab.BUILD_PARTS)}) THEN 'build_output'
WHEN list_has_any(parts, {listed(vocab.GENERATED_PARTS)}) OR contains(name, 'generated') THEN 'generated' WHEN fixture THEN 'fixture' WHEN is_test THEN 'test'
WHEN list_contains({listed(vocab.DOCUMENT_SUFFIXES)}, suffix) THEN 'documentation' WHEN list_contains({listed(vocab.CONFIG_NAMES)}, name) OR list_contains({listed(vocab.CONFIG_SUFFIXES)}, suffix) THEN 'configuration' ELSE 'source' END AS role,
is_test FROM i""",
        "lcs_lengths": f"""WITH RECURSIVE {ROLES}, d(conv_id, i, r) AS (
SELECT conv_id, 0, list_transform(range(0, len(y) + 1), lambda k: 0) FROM both_
UNION ALL SELECT d.conv_id, i + 1, [0] || list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN y[k] = x[i + 1] THEN r[k] + 1 ELSE r[k + 1] END))) FROM d JOIN both_ ON both_.conv_id = d.conv_id WHERE i < len(x))
SELECT d.conv_id, CAST(r[len(y) + 1] AS BIGINT) AS lcs FROM d JOIN both_ ON both_.conv_id = d.conv_id WHERE i = len(x)""",
        "multiset_similarity": """WITH bags AS (SELECT l_orderkey AS k, p_size % 5 AS cls, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
o AS (SELECT o_orderkey AS l, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
p AS (SELECT * FROM o WHERE r IS NOT NULL AND l IN (SELECT k FROM bags) AND r IN (SELECT k FROM bags)),
c AS (SELECT l, r, cls, n AS x, 0 AS y FROM p JOIN bags ON k = l UNION ALL SELECT l, r, cls, 0, n FROM p JOIN bags ON k = r),
g AS (SELECT l, r, cls, sum(x) AS x, sum(y) AS y FROM c GROUP BY 1, 2, 3)
SELECT l AS left_key, r AS right_key, CAST(sum(least(x, y)) AS DOUBLE) / CAST(sum(greatest(x, y)) AS DOUBLE) AS similarity FROM g GROUP BY 1, 2""",
        "mean_jaccard_by_key": """WITH e AS (SELECT DISTINCT user_id AS u, event_type AS t, strftime(ts, '%Y-%m-%d') AS d FROM events),
p AS (SELECT DISTINCT x.u FROM e x JOIN e y ON y.u = x.u + 1),
s AS (SELECT p.u, t, d, 1 AS l, 0 AS r FROM p JOIN e USING (u) UNION ALL SELECT p.u, t, d, 0, 1 FROM p JOIN e ON e.u = p.u + 1),
m AS (SELECT u, t, d, max(l) AS l, max(r) AS r FROM s GROUP BY 1, 2, 3),
j AS (SELECT u, t, CAST(sum(l * r) AS DOUBLE) / count(*) AS j FROM m GROUP BY 1, 2)
SELECT u AS user_id, sum(j) / count(*) AS similarity FROM j GROUP BY u""",
        "lcs_prefix_suffix": f"WITH {ROLES} SELECT conv_id, {same.format('x', 'y')} AS prefix, {same.format('list_reverse(x)', 'list_reverse(y)')} AS suffix FROM both_",
        "language_by_suffix": rf"WITH p AS (SELECT page_id, regexp_extract({PATH}, '\.([A-Za-z0-9]+)$', 1) AS suffix FROM pages) SELECT page_id, suffix, CASE suffix WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'html' THEN 'html' WHEN 'md' THEN 'markdown' ELSE 'other' END AS language FROM p",
        "role_ladder": rf"WITH p AS (SELECT page_id, string_split({PATH}, '/') AS s, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) SELECT page_id, CASE WHEN list_contains(s, 'fr') THEN 'vendor' WHEN list_contains(s, 'es') THEN 'generated' WHEN starts_with(host, 'blog.') THEN 'documentation' WHEN starts_with(host, 'm.') THEN 'test' ELSE 'source' END AS role FROM p",
        "path_roles": rf"SELECT page_id, array_to_string(list_sort(list_filter([CASE WHEN {PATH} LIKE '%/' THEN 'directory' END, CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN contains(url, '#') THEN 'anchor' END, CASE WHEN {PATH} LIKE '%.html' THEN 'file' END], lambda r: r IS NOT NULL)), ',') AS roles FROM pages",
        "file_selection": rf"WITH p AS (SELECT page_id, regexp_replace({PATH}, '^/', '') AS path FROM pages) SELECT page_id, path, (starts_with(path, 'en/') OR regexp_matches(path, '^de/[^/]*$') OR regexp_matches(path, '\.html$')) AND NOT (regexp_matches(path, '^(.*/)?1[^/]*$') OR regexp_matches(path, '^de/[^/]*\.html$')) AS selected FROM p",
        "role_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
        "zero_filled_counts": "SELECT label, count(doc_id) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it'), ('pt')) v(label) LEFT JOIN documents ON lang = label GROUP BY label",
        "lead_row_per_group": "SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) = 1",
        "group_structural_metrics": f"""WITH {ITEMS}, k AS (SELECT doc_id AS b, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1)
SELECT a AS doc_id, count(*) AS edges, count(*) FILTER (similarity = 1) AS exact, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled, max(similarity) AS strongest, min(edges.b) AS first_neighbour, max(edges.b) AS last_neighbour
FROM edges LEFT JOIN k ON k.b = edges.b GROUP BY a""",
        "noisy_or_payoff": f"WITH {ASSESSED} SELECT l_partkey, payoff, payoff_band FROM assessed",
        "ramp_scores": """WITH r AS (SELECT o_orderkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (o_totalprice - 50000.0::DOUBLE) / 150000.0::DOUBLE)) AS x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 400000.0::DOUBLE)) AS z FROM orders)
SELECT o_orderkey, floor(x * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS ramp, floor((1.0::DOUBLE - x) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS inverse, floor(z * 0.5::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS product FROM r""",
        "fit_score": f"WITH {ASSESSED} SELECT l_partkey, fit, cost, fit_band FROM assessed",
        "risk_score": f"WITH {ASSESSED} SELECT l_partkey, risk, risk_band FROM assessed",
        "detection_ladder": f"WITH {ASSESSED} SELECT l_partkey, detection, detection_band FROM assessed",
        "review_tier": f"WITH {DECIDED} SELECT l_partkey, detection_band, risk_band, CAST(failed AS BIGINT) AS failed, action, status, attention, tier FROM decided",
        "semantic_cap": f"""WITH {CAPPED} SELECT k AS l_partkey, rule, CASE WHEN lowered THEN most ELSE tier END AS tier,
CASE WHEN NOT lowered OR action IN ('record_shared_concern', 'inspect_shared_lifecycle') THEN action WHEN most = 'review_candidate' THEN CASE WHEN rule = 'constructor' THEN 'extract_small_helper' ELSE action END WHEN most = 'maintenance_note' THEN 'record_shared_concern' ELSE 'do_not_refactor' END AS action,
CASE WHEN lowered AND status = 'recommended' THEN 'cautious' ELSE status END AS status FROM u""",
        "summary_eligible": f"WITH {TIERED} SELECT tier, count(*) AS n, count(*) FILTER (members > 1 AND files > 1 AND risk < 0.65) AS eligible FROM tiered GROUP BY tier",
        "equivalence_dedupe": f"WITH {SETS} SELECT key, array_to_string(members, ',') AS members FROM sets JOIN orders ON o_orderkey = key QUALIFY row_number() OVER (PARTITION BY members ORDER BY o_totalprice DESC, key) = 1",
        "subsumed_anti_join": """WITH s AS (SELECT l_orderkey AS key, list(DISTINCT CAST(CAST(l_quantity % 9 AS INTEGER) AS VARCHAR)) AS members FROM lineitem GROUP BY 1),
f AS (SELECT key, members, o_custkey AS kind, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank FROM s JOIN orders ON o_orderkey = key)
SELECT key FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.kind = f.kind AND g.rank <= f.rank AND len(f.members) < len(g.members) AND list_has_all(g.members, f.members))""",
        "ranked_findings": f"WITH {TIERED} SELECT l_partkey, tier, score, rank FROM ranked",
        "surfaces": f"""WITH {TIERED} SELECT l_partkey % 500 AS target, l_partkey, CASE WHEN NOT score > 0 THEN NULL WHEN tier = 'recommended_edit' THEN 'edits' WHEN tier = 'review_candidate' THEN 'review' ELSE 'notes' END AS surface
FROM ranked QUALIFY row_number() OVER (PARTITION BY l_partkey % 500 ORDER BY rank) = 1""",
        "stable_ids": """WITH d AS (SELECT doc_id, substr(sha256(lang || chr(31) || source || chr(31) || n_chars), 1, 16) AS s FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS n FROM d)
SELECT doc_id, 'doc_' || s || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM n""",
        "semi_anti_pairs": f"WITH {ITEMS}, {EXACT.format('items')} SELECT a AS left_id, b AS right_id, similarity FROM edges ANTI JOIN exact USING (a, b)",
        "union_exact_rare": f"WITH {ITEMS.replace('WHERE len(tokens) >= 4', '')}, {EXACT.format('items')} SELECT a AS left_id, b AS right_id FROM rare UNION SELECT a, b FROM exact",
        "multiset_intersection": f"""WITH c AS (SELECT conv_id, role, unnest({W}) AS word FROM conversations), n AS (SELECT conv_id, word, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM c GROUP BY 1, 2)
SELECT conv_id, CAST(sum(least(u, a)) AS BIGINT) AS shared, CAST(sum(greatest(0, u - a)) AS BIGINT) AS user_more FROM n GROUP BY 1""",
        "coverage_summary": """WITH d AS (SELECT n_chars, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents), o AS (SELECT count(*) AS files, count(*) FILTER (l) AS covered, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(coalesce(sum(n_chars) FILTER (l), 0) AS BIGINT) AS covered_chars FROM d)
SELECT *, CASE WHEN files = 0 THEN 'none' WHEN covered = files THEN 'full' WHEN covered / CAST(files AS DOUBLE) >= 0.5 THEN 'most' WHEN covered > 0 THEN 'partial' ELSE 'none' END AS coverage FROM o""",
        "mirror_members": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type IN ('click', 'view')) = 2",
        "candidate_statistics": f"WITH {KEYS} SELECT count(DISTINCT cluster) AS clusters, count(DISTINCT (cluster, key)) AS buckets, count(DISTINCT member) AS members, (SELECT count(*) FROM bp) AS pairs FROM keys",
        "subcluster_scores": f"WITH {TOPK}, t AS (SELECT *, CASE WHEN estimate = 1 THEN 'same' WHEN estimate > 0 THEN 'part' ELSE 'none' END AS kind FROM top) SELECT cluster, kind, count(*) AS pairs, max(estimate) AS strongest, CAST(sum(floor(estimate * 1000 + 0.5)) AS BIGINT) AS thousandths FROM t GROUP BY 1, 2",
        "cluster_summary": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_brand, string_agg(p_name, ';' ORDER BY n) FILTER (n <= 5) AS first_names, CAST(sum(greatest(1, p_size)) AS BIGINT) AS total FROM p GROUP BY 1",
        "shape_groups": "WITH d AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS lines FROM documents) SELECT lines, count(*) AS members, count(DISTINCT lang) AS languages, min(doc_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lang) > 1",
        "top_clusters": f"WITH {KEYS} SELECT cluster, count(*) AS pairs FROM bp GROUP BY 1 ORDER BY pairs DESC, cluster LIMIT 5",
    }
