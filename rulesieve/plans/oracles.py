"""The registered queries as plain SQL, written independently of the operators.

The SQL is for a single-node engine over the same tables; it states each result
directly (cross products against the patterns, correlated conditions) and is
meant to be checked against, not to scale.
"""

from rulesieve import __version__, schema
from rulesieve.functions.text import COUNTS_LINE, OVERALL_MARKERS
from rulesieve.plans import pack
from rulesieve.plans.queries import BYTE_LIMIT, DIFF_BOUNDARY, LARGE_COUNT, ORDER_BYTES

CAP = schema.EVIDENCE_CAP


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def rank(expression: str, names) -> str:
    cases = " ".join(f"WHEN {lit(n)} THEN {i}" for i, n in enumerate(names))
    return f"CASE {expression} {cases} ELSE {len(names)} END"


def pick(names, number: str) -> str:
    return f"list_extract([{', '.join(lit(n) for n in names)}], CAST({number} % {len(names)} AS INTEGER) + 1)"


CATEGORY_RANK = rank("category", schema.CATEGORIES)
SEVERITY_RANK = rank("severity", schema.SEVERITIES)
BLOCKING = "behavior IN (" + ", ".join(lit(b) for b in schema.BLOCKING_BEHAVIORS) + ")"


def _quote(pattern: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " and ord(c) < 128 else c for c in pattern)


def alternation(kind: str) -> str:
    found = {p for r in pack.RULES if r["evidence_location"] == kind and not r.get("is_regex") for p in r["patterns"]}
    return "|".join(_quote(p) for p in sorted(found, key=lambda p: (-len(p), p)))


# --- shared table expressions ------------------------------------------------

RULES = values(
    "rules",
    ["id", "name", "category", "severity", "behavior", "description", "guidance_key"],
    [
        (r["id"], r["name"], r["category"], r["severity"], r.get("behavior", "unknown"), r["description"],
         r.get("guidance_key"))
        for r in pack.RULES
    ],
)
PATTERNS = values(
    "patterns",
    ["rule_id", "kind", "is_regex", "pattern_ord", "pattern"],
    [
        (r["id"], r["evidence_location"], r.get("is_regex", False), i, p)
        for r in pack.RULES
        for i, p in enumerate(r["patterns"])
    ],
)
GUIDANCE = values("guidance", ["guidance_key", "guidance"], pack.GUIDANCE)
COND = values("cond", ["rule_id", "row_no", "verdict", "detail"], [(r, n, v, d) for r, n, _, v, d in pack.CONDITIONS])
COND_FIELDS = values(
    "cond_fields",
    ["rule_id", "row_no", "field", "wanted"],
    [(r, n, k, v) for r, n, f, _, _ in pack.CONDITIONS for k, v in f.items()],
)

LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS value,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ordinal
  FROM documents)"""


def line_evidence(artifact: str = "doc_id", where: str = "TRUE") -> str:
    return f"""SELECT CAST({artifact} AS VARCHAR) AS artifact_id, 'dex_string' AS kind,
       CAST(doc_id AS VARCHAR) AS container, doc_id AS container_ord, ordinal, value
  FROM lines WHERE {where}"""


HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
URL_EVIDENCE = f"""SELECT {HOST} AS artifact_id, 'zip_entry' AS kind, url AS container,
       page_id AS container_ord, CAST(0 AS INTEGER) AS ordinal, url AS value FROM pages"""
LIBS = f"""libs AS (
  SELECT artifact_id, entry_ord, parts[2] AS abi, parts[3] AS filename, uncompressed_size
  FROM (SELECT {HOST} AS artifact_id, page_id AS entry_ord,
               string_split('lib/' || regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) || '.so', '/') AS parts,
               length(html) AS uncompressed_size
        FROM pages)
  WHERE len(parts) = 3)"""
LIB_EVIDENCE = """SELECT artifact_id, 'native_lib_name' AS kind, abi AS container, entry_ord AS container_ord,
       CAST(0 AS INTEGER) AS ordinal, filename AS value FROM libs"""
ITEM_TEXT = """'item part=' || l_partkey || ' qty=' || CAST(l_quantity AS BIGINT) || ' flag=' || l_returnflag || ' '"""
ORDER_HAY = f"""order_hay AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS artifact_id,
         string_agg({ITEM_TEXT}, '' ORDER BY l_linenumber, {ITEM_TEXT}) AS haystack
  FROM lineitem GROUP BY l_orderkey)"""
MANIFEST_EVIDENCE = """SELECT artifact_id, 'manifest' AS kind, 'manifest' AS container,
       CAST(0 AS BIGINT) AS container_ord, CAST(0 AS INTEGER) AS ordinal, haystack AS value FROM order_hay"""

MATCH_COLUMNS = "artifact_id, kind, container_ord, ordinal, match_pos, pattern, rule_id, pattern_ord"


def longest(source: str, kind: str) -> str:
    """Leftmost-longest matches: a longest-first alternation over the whole kind."""
    return f"""SELECT h.* EXCLUDE (found), p.rule_id, p.pattern_ord FROM (
    SELECT *, unnest(found) AS pattern,
           CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS match_pos
    FROM (SELECT *, regexp_extract_all(value, {lit(alternation(kind))}) AS found
          FROM {source} WHERE kind = {lit(kind)})) h
  JOIN patterns p ON p.kind = h.kind AND p.pattern = h.pattern AND NOT p.is_regex"""


def by_pattern(source: str, is_regex: bool, where: str = "TRUE") -> str:
    test = "regexp_matches(e.value, p.pattern)" if is_regex else "contains(e.value, p.pattern)"
    return f"""SELECT e.*, p.pattern, CAST(0 AS INTEGER) AS match_pos, p.rule_id, p.pattern_ord
  FROM {source} e JOIN patterns p ON p.kind = e.kind AND p.is_regex = {lit(is_regex)} AND {test}
  WHERE {where}"""


def findings_from(matches: str, name: str) -> str:
    """Findings of a table of matches that holds every kind."""
    return f"""{name}_capped AS (
  SELECT * FROM (
    SELECT *, min(turn) OVER (PARTITION BY artifact_id, rule_id) AS first_turn,
           row_number() OVER (PARTITION BY artifact_id, rule_id, turn
                              ORDER BY container_ord, ordinal, match_pos, pattern_ord) AS rn
    FROM (SELECT *, CASE WHEN kind = 'dex_string' THEN 0 ELSE pattern_ord END AS turn FROM {matches}))
  WHERE turn = first_turn AND rn <= {CAP}),
{name} AS (
  SELECT c.artifact_id, c.rule_id, r.name AS rule_name, r.category, r.severity, r.behavior, c.evidence,
         r.guidance_key
  FROM (SELECT artifact_id, rule_id, CASE any_value(kind)
          WHEN 'dex_string' THEN 'DEX string match: `' || string_agg(value, '`, `' ORDER BY rn) || '`'
          WHEN 'manifest' THEN 'Manifest match: `' || any_value(pattern) || '`'
          WHEN 'native_lib_name' THEN
            'Native lib: ' || string_agg('lib/' || container || '/' || value, ', ' ORDER BY rn)
          ELSE 'ZIP entry: ' || string_agg(value, ', ' ORDER BY rn) END AS evidence
        FROM {name}_capped GROUP BY artifact_id, rule_id) c
  JOIN rules r ON r.id = c.rule_id)"""


def line_findings(artifact: str = "doc_id", name: str = "findings", where: str = "TRUE") -> str:
    return f"""{name}_ev AS ({line_evidence(artifact, where)}),
{name}_m AS ({longest(f"{name}_ev", "dex_string")}
  UNION ALL BY NAME {by_pattern(f"{name}_ev", True)}),
{findings_from(f"{name}_m", name)}"""


def with_findings(select: str, artifact: str = "doc_id", extra: str = "") -> str:
    return f"WITH {RULES}, {PATTERNS}, {LINES}, {line_findings(artifact)}{extra} {select}"


PART_RULES = f"""part_rules AS (
  SELECT p_name || '/' || p_brand AS id, p_name AS name, {pick(schema.CATEGORIES, 'p_size')} AS category,
         {pick(schema.SEVERITIES, 'p_size')} AS severity, {pick(schema.BEHAVIORS, 'p_size')} AS behavior,
         'dex_string' AS evidence_location, string_split(p_name, ' ') AS patterns,
         p_brand || ' ' || p_type AS description, p_type AS guidance_key, p_partkey
  FROM part)"""
BENCHMARK_PATTERNS = """bench_lines AS (
  SELECT 'item-' || item_id AS rule_id, unnest(string_split(text, chr(10))) AS pattern,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM benchmark),
bench_patterns AS (
  SELECT 'dex_string' AS kind, rule_id, pattern,
         CAST(row_number() OVER (PARTITION BY rule_id ORDER BY line_no) - 1 AS INTEGER) AS pattern_ord
  FROM bench_lines WHERE pattern <> '')"""
CUSTOMER_ELEMENTS = """elements AS (
  SELECT CAST(o_custkey AS VARCHAR) AS artifact_id, o_orderkey AS elem_ord,
         CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END AS tag,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS name, o_orderstatus
  FROM orders)"""
HISTORY_ROWS = """hist AS (
  SELECT o_orderpriority AS label, 'order/' || o_orderkey AS path, o_orderstatus || ' ' || o_custkey AS report,
         epoch_us(o_orderdate) // 1000 AS created_at, o_orderkey AS seq, o_orderstatus AS status
  FROM orders)"""

# --- policy ------------------------------------------------------------------

PROFILES_LONG = f"""profile_fields AS (
  SELECT CAST(user_id AS VARCHAR) AS profile_id, event_type AS field,
         CASE WHEN count(*) >= 12 THEN sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) * 2 > count(*) END AS known
  FROM events WHERE event_type IN ({", ".join(lit(f) for f in pack.FIELDS)}) GROUP BY ALL),
profile_ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS profile_id FROM events)"""
PAIRS = """pairs AS (
  SELECT DISTINCT d.source AS artifact_id, CAST(e.user_id AS VARCHAR) AS profile_id
  FROM events e JOIN documents d ON d.doc_id = TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""
# The first condition row none of whose fields is unmet, per profile and rule.
DECIDED = """met AS (
  SELECT p.profile_id, c.rule_id, c.row_no, c.verdict, c.detail
  FROM profile_ids p CROSS JOIN cond c
  WHERE NOT EXISTS (
    SELECT 1 FROM cond_fields w LEFT JOIN profile_fields f ON f.profile_id = p.profile_id AND f.field = w.field
    WHERE w.rule_id = c.rule_id AND w.row_no = c.row_no AND coalesce(f.known <> w.wanted, TRUE))),
decided AS (
  SELECT profile_id, rule_id, arg_min(verdict, row_no) AS verdict, arg_min(detail, row_no) AS detail
  FROM met GROUP BY ALL)"""
NO_MATCH = """coalesce(d.verdict, 'unknown') AS verdict,
  CASE WHEN d.verdict IS NOT NULL THEN d.detail
       WHEN {rule} IN (SELECT rule_id FROM cond) THEN 'no condition row matches this profile'
       ELSE 'no conditions for this rule' END AS detail"""


# The same, unknown as a whole where the clicks are.
UNPROFILED = PROFILES_LONG.replace("profile_fields AS", "all_fields AS") + """,
profile_fields AS (SELECT * FROM all_fields WHERE profile_id IN
  (SELECT profile_id FROM all_fields WHERE field = 'click' AND known IS NOT NULL))"""


def with_verdicts(select: str, where: str = "TRUE", profiles: str = PROFILES_LONG) -> str:
    verdict = NO_MATCH.format(rule="f.rule_id")
    return f"""WITH {RULES}, {PATTERNS}, {LINES}, {line_findings("source")}, {COND}, {COND_FIELDS},
{profiles}, {PAIRS}, {DECIDED},
verdicts AS (
  SELECT f.*, p.profile_id, {verdict}
  FROM findings f JOIN pairs p ON p.artifact_id = f.artifact_id
  LEFT JOIN decided d ON d.profile_id = p.profile_id AND d.rule_id = f.rule_id
  WHERE {where}),
counted AS (
  SELECT p.artifact_id, p.profile_id,
         count(*) FILTER (verdict = 'triggered') AS n_triggered,
         count(*) FILTER (verdict = 'not_triggered') AS n_not_triggered,
         count(*) FILTER (verdict = 'unknown') AS n_unknown,
         count(verdict) AS n_total
  FROM pairs p LEFT JOIN verdicts v ON v.artifact_id = p.artifact_id AND v.profile_id = p.profile_id
  GROUP BY ALL),
overall AS (
  SELECT *, CASE WHEN n_total = 0 THEN 'no_blocking' WHEN n_triggered > 0 THEN 'fail'
                 WHEN n_unknown > 0 THEN 'inconclusive' ELSE 'pass' END AS overall
  FROM counted)
{select}"""


FIELD_JSON = " ".join(
    f"max(CASE WHEN field = {lit(f)} AND known IS NOT NULL THEN '\"{f}\":' || CAST(known AS VARCHAR) END) AS f_{f},"
    for f in pack.FIELDS
)
PROFILE_JSON = f"""profile_json AS (
  SELECT profile_id, '{{' || coalesce(list_aggregate([{", ".join("f_" + f for f in pack.FIELDS)}],
         'string_agg', ','), '') || '}}' AS profile
  FROM (SELECT p.profile_id, {FIELD_JSON} FROM profile_ids p LEFT JOIN profile_fields f USING (profile_id)
        GROUP BY p.profile_id))"""


def cases(column: str, markers) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, {lit(m)}) THEN {lit(v)}" for m, v in markers) + " END"


def two_findings(select: str) -> str:
    old = line_findings("lang", "old_f", f"source < '{DIFF_BOUNDARY}'")
    new = line_findings("lang", "new_f", f"source >= '{DIFF_BOUNDARY}'")
    return f"""WITH {RULES}, {PATTERNS}, {LINES}, {old}, {new}, {DIFF} {select}"""


DIFF = """changes AS (
  SELECT n.*, 'added' AS status FROM new_f n ANTI JOIN old_f o USING (artifact_id, rule_id, category)
  UNION ALL SELECT o.*, 'removed' FROM old_f o ANTI JOIN new_f n USING (artifact_id, rule_id, category)
  UNION ALL SELECT n.*, 'unchanged' FROM new_f n SEMI JOIN old_f o USING (artifact_id, rule_id, category))"""

ALL_EVIDENCE = f"""{LINES}, {LIBS}, {ORDER_HAY},
ev AS ({line_evidence()} UNION ALL {URL_EVIDENCE} UNION ALL {LIB_EVIDENCE} UNION ALL {MANIFEST_EVIDENCE}),
m AS ({longest("ev", "dex_string")} UNION ALL BY NAME {by_pattern("ev", False, "e.kind <> 'dex_string'")}
  UNION ALL BY NAME {by_pattern("ev", True)})"""
PAGE_EVIDENCE = f"{LIBS}, ev AS ({URL_EVIDENCE} UNION ALL {LIB_EVIDENCE})"
LINE_EVIDENCE = f"{LINES}, ev AS ({line_evidence()})"
SMALL = f"WITH {RULES}, {PATTERNS}, "


def budget(limit: int, cap: int) -> str:
    """Outcome per source: the first ``cap`` documents while their sizes fit."""
    return f"""WITH capped AS (
  SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= {cap}),
c AS (SELECT source, count(*) AS n, count(*) FILTER (used <= {limit}) AS kept FROM capped GROUP BY source)
SELECT source AS artifact_id, n AS n_containers, kept AS n_kept,
  CASE WHEN kept < n THEN 'partial' ELSE 'ok' END AS outcome,
  CASE WHEN kept < n THEN 'byte budget exceeded: ' || kept || ' of ' || n ||
    ' containers scanned (max_total_bytes={limit}, max_containers={cap})' END AS outcome_reason,
  n >= {cap} AS at_count_cap
FROM c"""


_HAY_TEXT = """tag || ' ' || 'status=' || o_orderstatus || ' ' ||
  CASE WHEN name IS NULL THEN '' ELSE 'name=' || name || ' name=' || o_orderstatus || ' ' END"""
_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY created_at
  ORDER BY CASE WHEN status = 'F' THEN 0 ELSE 1 END DESC, {order} DESC) AS rn FROM hist) WHERE rn = 1"""
_OVERALL_TEXT = {label: marker for marker, label in OVERALL_MARKERS}

ORACLES: dict[str, str] = {
    # sources and sinks
    "text_fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "event_minute_key": """SELECT event_id,
        sha256(event_type || ':' || CAST(epoch_us(ts) // 60000000 AS VARCHAR)) AS minute_key FROM events""",
    "catalogue_load": f"""WITH {PART_RULES} SELECT id, name, category, severity, behavior, evidence_location,
        array_to_string(patterns, '|') AS patterns, FALSE AS is_regex, description, guidance_key FROM part_rules""",
    "catalogue_violations": f"""WITH {PART_RULES}
        SELECT 'duplicate_id' AS "check", id AS subject, count(*) AS n FROM part_rules GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'empty_category', c, CAST(0 AS BIGINT) FROM
          (SELECT unnest([{", ".join(lit(c) for c in schema.CATEGORIES)}]) AS c)
          WHERE c NOT IN (SELECT category FROM part_rules)
        UNION ALL SELECT 'unclassified_behavior', id, CAST(1 AS BIGINT) FROM part_rules WHERE behavior = 'unknown'
        UNION ALL SELECT 'empty_pattern', id, CAST(1 AS BIGINT) FROM part_rules
          WHERE len(patterns) = 0 OR list_contains(patterns, '')""",
    "catalogue_condition_gaps": f"""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS id,
          {pick(schema.CATEGORIES, 'p_size')} AS category FROM part),
        c AS (SELECT DISTINCT l_partkey || CASE WHEN l_returnflag = 'R' THEN 'R' ELSE '' END AS id
              FROM lineitem)
        SELECT 'duplicate_id' AS "check", id AS subject, count(*) AS n FROM r GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'empty_category', c, CAST(0 AS BIGINT) FROM
          (SELECT unnest([{", ".join(lit(c) for c in schema.CATEGORIES)}]) AS c)
          WHERE c NOT IN (SELECT category FROM r)
        UNION ALL SELECT 'rule_without_condition', id, CAST(1 AS BIGINT) FROM r WHERE id NOT IN (SELECT id FROM c)
        UNION ALL SELECT 'condition_without_rule', id, CAST(1 AS BIGINT) FROM c WHERE id NOT IN (SELECT id FROM r)""",
    "catalogue_listing": f"""WITH {PART_RULES} SELECT id, '{{"id":"' || id || '","name":"' || name ||
        '","category":"' || category || '","severity":"' || severity || '","description":"' || description || '"}}'
        AS listing FROM part_rules""",
    "catalogue_by_category": f"""WITH {PART_RULES} SELECT id, name, category, severity FROM part_rules
        WHERE category = 'anti_hooking'""",
    "catalogue_by_id": f"""WITH {PART_RULES} SELECT id, category, behavior FROM part_rules WHERE id IN
        (SELECT r.id FROM part_rules r JOIN lineitem l ON l.l_partkey = r.p_partkey)""",
    "catalogue_patterns": f"""WITH {PART_RULES} SELECT 'dex_string' AS kind, pattern,
        count(DISTINCT id) AS n_rules, min(id) AS first_rule_id
        FROM (SELECT id, unnest(patterns) AS pattern FROM part_rules) GROUP BY pattern""",
    "catalogue_pattern_rules": f"""WITH {BENCHMARK_PATTERNS}
        SELECT kind, pattern, rule_id, pattern_ord FROM bench_patterns""",
    "findings_round_trip": with_findings("SELECT * FROM findings"),
    "findings_round_trip_json": with_findings("SELECT * FROM findings"),
    "history_upsert": f"""WITH {HISTORY_ROWS} SELECT label, path, report, created_at
        FROM ({_LATEST.format(order="seq")})""",
    "history_append": f"""WITH {HISTORY_ROWS} SELECT label, path, report, created_at
        FROM ({_LATEST.format(order="seq")})""",
    "history_cleared": """SELECT count(DISTINCT o_orderdate) AS rows_before, CAST(0 AS BIGINT) AS rows_after
        FROM orders""",
    "history_listing": """SELECT event_type AS label, 'event/' || event_id AS path, epoch_us(ts) // 1000 AS created_at,
        strftime(ts, '%Y-%m-%d %H:%M') AS created_minute,
        left(repeat(event_type || ' ' || props, 12), 200) AS preview FROM events""",
    # projections and filters
    "code_entries": """SELECT p_partkey, p_name AS name FROM part
        WHERE starts_with(p_name, 'small') AND ends_with(p_name, 'ring')""",
    "library_names": f"WITH {LIBS} SELECT artifact_id, entry_ord, abi, filename, uncompressed_size FROM libs",
    "order_haystack": f"WITH {ORDER_HAY} SELECT artifact_id, CAST(0 AS BIGINT) AS segment, haystack FROM order_hay",
    "customer_haystack_segments": f"""WITH {CUSTOMER_ELEMENTS}, seg AS (
          SELECT artifact_id, elem_ord // 4096 AS segment, string_agg({_HAY_TEXT}, '' ORDER BY elem_ord) AS hay
          FROM elements GROUP BY ALL)
        SELECT s.artifact_id, s.segment, any_value(s.hay) ||
          left(coalesce(string_agg(t.hay, '' ORDER BY t.segment), ''), 24) AS haystack
        FROM seg s LEFT JOIN seg t ON t.artifact_id = s.artifact_id AND t.segment > s.segment
        GROUP BY s.artifact_id, s.segment""",
    "first_attribute": f"""WITH {CUSTOMER_ELEMENTS} SELECT artifact_id, name AS value FROM elements
        QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY elem_ord) = 1""",
    "first_tagged_attribute": f"""WITH {CUSTOMER_ELEMENTS}, o AS (SELECT artifact_id, name FROM elements
        WHERE tag = 'open' QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY elem_ord) = 1)
        SELECT a.artifact_id, o.name AS value FROM (SELECT DISTINCT artifact_id FROM elements) a
        LEFT JOIN o ON o.artifact_id = a.artifact_id""",
    "attribute_values": f"""WITH {CUSTOMER_ELEMENTS} SELECT artifact_id, elem_ord, name AS value FROM elements
        WHERE tag = 'open' AND name IS NOT NULL""",
    "document_strings": f"WITH {LINES} SELECT doc_id, ordinal, value FROM lines",
    "evidence_union": f"""WITH {LINES}, {LIBS}, spoken AS (
          SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS value,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM conversations),
        ev AS ({line_evidence()} UNION ALL {URL_EVIDENCE} UNION ALL {LIB_EVIDENCE}
          UNION ALL SELECT CAST(conv_id AS VARCHAR), 'dex_string', CAST(turn AS VARCHAR), turn, ordinal, value
          FROM spoken)
        SELECT kind, container_ord, count(*) AS n, count(DISTINCT artifact_id) AS n_artifacts,
          CAST(sum(length(value)) AS BIGINT) AS n_chars, CAST(sum(ordinal) AS BIGINT) AS ordinals
        FROM ev GROUP BY kind, container_ord""",
    "customer_search": """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey IS NOT NULL
        AND (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')) ORDER BY lower(c_name)""",
    "part_search_blank": """SELECT p_partkey, p_name FROM part WHERE p_brand IS NOT NULL AND p_brand <> ''
        ORDER BY lower(p_name)""",
    "text_preview": """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END
        AS preview FROM documents""",
    "report_counts": f"""WITH c AS (SELECT o_custkey, count(*) AS t, count(*) FILTER (o_orderstatus = 'F') AS a,
          count(*) FILTER (o_orderstatus = 'O') AS b, count(*) FILTER (o_orderstatus = 'P') AS c
          FROM orders GROUP BY o_custkey),
        s AS (SELECT o_custkey, CASE WHEN c > 0 THEN '**Findings:** ' || t || ' total — ' || a || ' triggered, ' ||
          b || ' bypassed, ' || c || ' unknown' ELSE 'no counters' END AS report FROM c)
        SELECT o_custkey, {", ".join(
            f"TRY_CAST(nullif(regexp_extract(report, {lit(COUNTS_LINE)}, {i}), '') AS INTEGER) AS {n}"
            for i, n in ((1, "total"), (2, "triggered"), (3, "bypassed"), (4, "unknown")))}
        FROM s""",
    "license_marker": f"SELECT doc_id, {cases('text', pack.LICENSE_MARKERS)} AS license FROM documents",
    "overall_marker": with_verdicts(
        "SELECT artifact_id, profile_id, overall, n_total || ' checks.' AS explanation FROM overall", BLOCKING
    ),
    # matching
    "match_contains_documents": SMALL + f"""{LINE_EVIDENCE}, m AS ({by_pattern("ev", False)})
        SELECT {MATCH_COLUMNS}, value FROM m""",
    "match_longest_documents": SMALL + f"""{LINE_EVIDENCE}, m AS ({longest("ev", "dex_string")})
        SELECT {MATCH_COLUMNS}, value FROM m""",
    "match_longest_pages": SMALL + f"""{PAGE_EVIDENCE},
        m AS ({longest("ev", "zip_entry")} UNION ALL BY NAME {longest("ev", "native_lib_name")})
        SELECT {MATCH_COLUMNS} FROM m""",
    "match_page_markup": SMALL + f"""markup AS (SELECT {HOST} AS artifact_id, page_id,
          unnest(string_split(html, chr(10))) AS value,
          CAST(generate_subscripts(string_split(html, chr(10)), 1) - 1 AS INTEGER) AS ordinal FROM pages),
        ev AS (SELECT artifact_id, 'dex_string' AS kind, CAST(page_id AS VARCHAR) AS container,
          page_id AS container_ord, ordinal, value FROM markup),
        m AS ({longest("ev", "dex_string")}) SELECT {MATCH_COLUMNS} FROM m""",
    "match_regex_documents": SMALL + f"""{LINE_EVIDENCE}, m AS ({by_pattern("ev", True)})
        SELECT {MATCH_COLUMNS} FROM m""",
    "match_entry_names": SMALL + f"""{PAGE_EVIDENCE}, m AS ({by_pattern("ev", False, "e.kind = 'zip_entry'")})
        SELECT {MATCH_COLUMNS} FROM m""",
    "match_all_kinds": SMALL + f"{ALL_EVIDENCE} SELECT {MATCH_COLUMNS} FROM m",
    "match_shared_patterns": SMALL + f"""{LINE_EVIDENCE}, m AS ({longest("ev", "dex_string")})
        SELECT {MATCH_COLUMNS} FROM m WHERE pattern IN
          (SELECT pattern FROM patterns GROUP BY kind, is_regex, pattern HAVING count(DISTINCT rule_id) > 1)""",
    "match_benchmark_passages": f"""WITH {LINES}, {BENCHMARK_PATTERNS}
        SELECT CAST(doc_id AS VARCHAR) AS artifact_id, kind, doc_id AS container_ord, ordinal,
          CAST(0 AS INTEGER) AS match_pos, pattern, rule_id, pattern_ord
        FROM lines JOIN bench_patterns ON contains(value, pattern)""",
    "match_benchmark_openings": f"""WITH {LINES}, openings AS (
          SELECT DISTINCT 'item-' || item_id AS rule_id, '^' || word || '\\b' AS pattern FROM (
            SELECT item_id, regexp_extract(unnest(string_split(text, chr(10))), '^[A-Za-z]+ [A-Za-z]+') AS word
            FROM benchmark) WHERE word <> '')
        SELECT CAST(doc_id AS VARCHAR) AS artifact_id, doc_id AS container_ord, ordinal, pattern, rule_id
        FROM lines JOIN openings ON regexp_matches(value, pattern)""",
    "first_pattern_pages": SMALL + f"""{PAGE_EVIDENCE}, m AS ({by_pattern("ev", False)})
        SELECT {MATCH_COLUMNS} FROM m
        QUALIFY pattern_ord = min(pattern_ord) OVER (PARTITION BY artifact_id, rule_id)""",
    "capped_evidence": SMALL + f"""{LINES}, ev AS ({line_evidence("source")}), m AS ({longest("ev", "dex_string")})
        SELECT {MATCH_COLUMNS}, CAST(row_number() OVER w AS INTEGER) AS evidence_rank FROM m
        WINDOW w AS (PARTITION BY artifact_id, rule_id ORDER BY container_ord, ordinal, match_pos, pattern_ord)
        QUALIFY row_number() OVER w <= {CAP}""",
    "findings_by_document": with_findings("SELECT * FROM findings"),
    "findings_by_source": with_findings("SELECT * FROM findings", "source"),
    "findings_all_kinds": SMALL + f"{ALL_EVIDENCE}, {findings_from('m', 'findings')} SELECT * FROM findings",
    "clean_documents": with_findings("""SELECT CAST(doc_id AS VARCHAR) AS artifact_id FROM documents
        WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT artifact_id FROM findings)"""),
    # budgets
    "byte_budget_sources": f"""SELECT source AS artifact_id, doc_id AS container_ord, n_chars AS uncompressed_size,
        CAST(sum(n_chars) OVER w AS BIGINT) AS running_bytes FROM documents
        WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        QUALIFY sum(n_chars) OVER w <= {BYTE_LIMIT}""",
    "byte_budget_orders": f"""SELECT l_orderkey AS artifact_id, l_linenumber AS container_ord, l_partkey, l_suppkey,
        l_extendedprice, CAST(l_quantity AS BIGINT) AS uncompressed_size,
        CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS running_bytes FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        QUALIFY sum(CAST(l_quantity AS BIGINT)) OVER w <= {ORDER_BYTES}""",
    "first_orders": """SELECT o_custkey AS artifact_id, o_orderkey AS container_ord, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 10""",
    "first_orders_large": f"""SELECT o_orderstatus AS artifact_id, o_orderkey AS container_ord, o_custkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= {LARGE_COUNT}""",
    "scan_outcome": budget(BYTE_LIMIT, 40),
    "scan_outcome_defaults": budget(schema.MAX_TOTAL_BYTES, schema.MAX_CONTAINERS),
    "budgeted_findings": f"""WITH {RULES}, {PATTERNS},
        kept AS (SELECT doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
          FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
          WHERE rn <= 40) WHERE used <= {BYTE_LIMIT}),
        {LINES.replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT doc_id FROM kept)")},
        {line_findings("source")}, o AS ({budget(BYTE_LIMIT, 40)}),
        spine AS (SELECT source AS artifact_id FROM documents UNION SELECT lang FROM documents),
        n AS (SELECT artifact_id, count(*) AS n_findings, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids
              FROM findings GROUP BY artifact_id)
        SELECT s.artifact_id, coalesce(n_containers, 0) AS n_containers, coalesce(n_kept, 0) AS n_kept,
          coalesce(outcome, 'ok') AS outcome, outcome_reason, coalesce(at_count_cap, FALSE) AS at_count_cap,
          coalesce(n_findings, 0) AS n_findings, coalesce(rule_ids, '') AS rule_ids
        FROM spine s LEFT JOIN o USING (artifact_id) LEFT JOIN n USING (artifact_id)""",
    # report tables
    "document_summary": with_findings(f"""SELECT CAST(doc_id AS VARCHAR) AS artifact_id, n_chars AS size_bytes,
        (SELECT count(*) FROM findings f WHERE f.artifact_id = CAST(doc_id AS VARCHAR)) AS n_findings,
        CAST({len(pack.RULES)} AS BIGINT) AS rules_loaded FROM documents"""),
    "guided_findings": with_findings("""SELECT f.artifact_id, f.rule_id, f.guidance_key, r.description, g.guidance
        FROM findings f JOIN rules r ON r.id = f.rule_id LEFT JOIN guidance g ON g.guidance_key = f.guidance_key""",
        extra=", " + GUIDANCE),
    "ordered_findings": with_findings(f"""SELECT artifact_id, CAST(row_number() OVER (PARTITION BY artifact_id
        ORDER BY {CATEGORY_RANK}, {SEVERITY_RANK} DESC, rule_id) AS INTEGER) AS position,
        rule_id, category, severity FROM findings"""),
    "blocking_findings": with_findings(f"SELECT artifact_id, rule_id, behavior FROM findings WHERE {BLOCKING}"),
    "severe_findings": with_findings("""SELECT artifact_id, rule_id, severity FROM findings
        WHERE severity IN ('medium', 'high', 'critical')"""),
    "blocking_counts": with_findings(f"""SELECT CAST(doc_id AS VARCHAR) AS artifact_id, count(f.rule_id) AS total,
        count(f.rule_id) FILTER ({BLOCKING}) AS kept, count(f.rule_id) FILTER (NOT ({BLOCKING})) AS hidden
        FROM documents d LEFT JOIN findings f ON f.artifact_id = CAST(doc_id AS VARCHAR) GROUP BY doc_id"""),
    "rule_prevalence": with_findings("""SELECT r.id AS rule_id, count(DISTINCT f.artifact_id) AS n_artifacts,
        CAST(count(DISTINCT f.artifact_id) AS DOUBLE) / (SELECT count(*) FROM documents) AS share
        FROM rules r LEFT JOIN findings f ON f.rule_id = r.id GROUP BY r.id"""),
    # diff
    "latest_findings": with_findings("""SELECT d.lang, rule_id, category, d.doc_id AS seq, severity, evidence
        FROM findings f JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.artifact_id
        QUALIFY row_number() OVER (PARTITION BY d.lang, rule_id, category ORDER BY d.doc_id DESC) = 1"""),
    "findings_diff": two_findings("SELECT artifact_id, rule_id, category, status, severity, evidence FROM changes"),
    "diff_counts": two_findings("SELECT " + ", ".join(
        f"count(*) FILTER (status = {lit(s)}) AS n_{s}" for s in schema.DIFF_STATUSES) + " FROM changes"),
    "ordered_diff": two_findings(f"""SELECT status, category, rule_id, artifact_id, behavior FROM changes
        ORDER BY {rank("status", schema.DIFF_STATUSES)}, {CATEGORY_RANK}, rule_id, artifact_id"""),
    "host_diff": SMALL + f"""urls AS ({URL_EVIDENCE}),
        old_m AS ({by_pattern("urls", False, "starts_with(value, 'http://')")}),
        new_m AS ({by_pattern("urls", False, "NOT starts_with(value, 'http://')")}),
        {findings_from("old_m", "old_f")}, {findings_from("new_m", "new_f")}, {DIFF}
        SELECT artifact_id, rule_id, category, status, evidence FROM changes""",
    # policy
    "profiles_parsed": """WITH e AS (SELECT *, CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS flag FROM events)
        SELECT event_id, CASE event_type WHEN 'click' THEN '{click: ' || flag || '}' WHEN 'view' THEN props
          ELSE '{"click": ' || flag || ', "view": null, "other": true}' END AS profile_text,
          CASE WHEN event_type NOT IN ('click', 'view') THEN value > 20 END AS click,
          CAST(NULL AS BOOLEAN) AS error, CAST(NULL AS BOOLEAN) AS view,
          event_type IN ('click', 'view') AS rejected
        FROM e""",
    "profiles_written": f"WITH {PROFILES_LONG}, {PROFILE_JSON} SELECT profile_id, profile FROM profile_json",
    "verdicts": with_verdicts("SELECT artifact_id, profile_id, rule_id, verdict, detail FROM verdicts"),
    "unprofiled_verdicts": with_verdicts(
        "SELECT artifact_id, profile_id, rule_id, verdict FROM verdicts", profiles=UNPROFILED),
    "blocking_verdicts": with_verdicts("SELECT artifact_id, profile_id, rule_id, verdict FROM verdicts", BLOCKING),
    "catalogue_verdicts": f"""WITH {RULES}, {COND}, {COND_FIELDS}, {PROFILES_LONG}, {DECIDED}
        SELECT p.profile_id, r.id AS rule_id, {NO_MATCH.format(rule="r.id")}
        FROM profile_ids p CROSS JOIN rules r
        LEFT JOIN decided d ON d.profile_id = p.profile_id AND d.rule_id = r.id
        WHERE r.id IN (SELECT rule_id FROM cond) AND r.category NOT IN ('app_hardening', 'anti_tamper')""",
    "verdict_counts": with_verdicts("SELECT * FROM counted", BLOCKING),
    "overall_verdict": with_verdicts("SELECT artifact_id, profile_id, overall FROM overall", BLOCKING),
    "ordered_verdicts": with_verdicts(f"""SELECT artifact_id, profile_id, verdict, category, rule_id FROM verdicts
        ORDER BY artifact_id, profile_id, {rank("verdict", schema.VERDICTS)}, {CATEGORY_RANK}, rule_id""", BLOCKING),
}
_ROLLUP = f"""SELECT artifact_id, category, count(*) AS n_findings,
  list_extract([{", ".join(lit(s) for s in schema.SEVERITIES)}], max({SEVERITY_RANK}) + 1) AS highest_severity,
  CAST({CATEGORY_RANK} AS INTEGER) AS category_rank FROM findings GROUP BY artifact_id, category"""
ORACLES["category_rollup"] = with_findings(_ROLLUP)
ORACLES["category_rollup_sources"] = with_findings(_ROLLUP, "source")
ORACLES["match_benchmark_distributed"] = ORACLES["match_benchmark_passages"]
ORACLES["match_longest_distributed"] = SMALL + f"""{LINE_EVIDENCE}, m AS ({longest("ev", "dex_string")})
  SELECT {MATCH_COLUMNS} FROM m"""
_ENTRY = """'{"rule_id":"' || rule_id || '","rule_name":"' || rule_name || '","category":"' || category ||
  '","severity":"' || severity || '","evidence":' || CAST(to_json(evidence) AS VARCHAR) || ',"verdict":"' || verdict ||
  '","detail":"' || coalesce(detail, '') || '"}'"""
ORACLES["verdict_documents"] = with_verdicts(f""", {PROFILE_JSON},
  listed AS (SELECT artifact_id, profile_id, string_agg({_ENTRY}, ',' ORDER BY {CATEGORY_RANK}, {SEVERITY_RANK} DESC,
    rule_id) AS entries FROM verdicts GROUP BY ALL)
  SELECT c.artifact_id, c.profile_id, '{{"artifact":"' || c.artifact_id || '","profile":' || j.profile ||
    ',"engine_version":"{__version__}","summary":{{"triggered":' || n_triggered || ',"not_triggered":' ||
    n_not_triggered || ',"unknown":' || n_unknown || ',"total":' || n_total || '}},"entries":[' ||
    coalesce(l.entries, '') || ']}}' AS document
  FROM counted c JOIN profile_json j ON j.profile_id = c.profile_id
  LEFT JOIN listed l ON l.artifact_id = c.artifact_id AND l.profile_id = c.profile_id""", BLOCKING)
ORACLES["incremental_findings"] = ORACLES["findings_by_document"]
# Scanned again: documents that came, changed, or hold a pattern of a rule that came.
ORACLES["incremental_rescans"] = """SELECT CAST(doc_id AS VARCHAR) AS artifact_id,
    doc_id % 7 = 3 OR (doc_id % 5 = 1 AND length(text) > 400)
      OR coalesce(list_bool_or(list_transform(string_split(text, chr(10)),
           lambda l: contains(l, 'MIT License') OR contains(l, 'Released under'))), FALSE) AS scanned
  FROM documents"""
ORACLES["match_openings_distributed"] = ORACLES["match_benchmark_openings"]
ORACLES["events_as_of_orders"] = """WITH o AS (
    SELECT o_custkey, o_orderdate, max({'k': o_orderkey, 's': o_orderstatus}) AS last FROM orders GROUP BY ALL)
  SELECT event_id, user_id, last.k AS right_o_orderkey, last.s AS right_o_orderstatus
  FROM events ASOF LEFT JOIN o ON user_id = o_custkey AND ts - INTERVAL 27 YEAR >= o_orderdate"""
ORACLES["orders_open_together"] = """WITH p AS (
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS first, max(CAST(l_shipdate AS DATE)) AS last
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
    HAVING max(CAST(l_shipdate AS DATE)) >= CAST(o_orderdate AS DATE))
  SELECT a.o_custkey, a.o_orderkey AS left_o_orderkey, b.o_orderkey AS right_o_orderkey
  FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.first <= b.last AND b.first <= a.last"""
_RUNS = """SELECT source, rule_id, min(doc_id) AS first_scan, max(doc_id) AS last_scan, count(*) AS n_scans,
    bool_or(place = total) AS still_firing
  FROM (SELECT p.*, f.rule_id, place - row_number() OVER (PARTITION BY source, rule_id ORDER BY doc_id) AS island
        FROM (SELECT DISTINCT artifact_id, rule_id FROM findings) f
        JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place,
                     count(*) OVER (PARTITION BY source) AS total FROM documents) p
          ON CAST(p.doc_id AS VARCHAR) = f.artifact_id)
  GROUP BY source, rule_id, island"""
ORACLES["rule_runs"] = with_findings(_RUNS)
ORACLES["rule_flaps"] = with_findings(f"""SELECT source, rule_id, min(first_scan) AS first_seen,
    max(last_scan) AS last_seen, CAST(sum(n_scans) AS BIGINT) AS n_scans, count(*) - 1 AS flaps,
    max(n_scans) AS longest_run, bool_or(still_firing) AS still_firing
  FROM ({_RUNS}) GROUP BY source, rule_id""")
_DESCRIBED = """(SELECT f.*, d.source, d.lang, d.n_chars FROM findings f
  JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.artifact_id)"""
ORACLES["findings_cube"] = with_findings(f"""SELECT source, lang, category,
    CAST(GROUPING_ID(source, lang, category) AS BIGINT) AS level, count(*) AS n_findings,
    count(*) FILTER ({BLOCKING}) AS n_blocking, arg_max(severity, {SEVERITY_RANK}) AS highest_severity
  FROM {_DESCRIBED} GROUP BY CUBE (source, lang, category)""")
ORACLES["rule_reach_merged"] = with_findings("""SELECT rule_id, count(DISTINCT artifact_id) AS n_artifacts,
    TRUE AS within_error FROM findings GROUP BY rule_id""")
ORACLES["rule_sizes_merged"] = with_findings(f"""SELECT rule_id, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50,
    CAST(quantile_disc(n_chars, 0.9) AS BIGINT) AS p90, TRUE AS within_error
  FROM {_DESCRIBED} WHERE n_chars IS NOT NULL GROUP BY rule_id""")
_DAY, _HOUR = 86_400_000, 3_600_000


def _windows(slide: int) -> str:
    """Windows of a day that begin every ``slide`` milliseconds and end an hour before the last event or earlier."""
    return f"""WITH e AS (SELECT event_type, epoch_ms(ts) AS ms FROM events WHERE ts IS NOT NULL),
    w AS (SELECT event_type, unnest(range(0, {_DAY // slide})) * {slide} AS back, ms FROM e),
    placed AS (SELECT event_type, ms - ms % {slide} - back AS start_ms FROM w)
    SELECT event_type, CAST(start_ms AS BIGINT) AS start_ms, CAST(start_ms + {_DAY} AS BIGINT) AS end_ms, count(*) AS n
    FROM placed WHERE start_ms + {_DAY} <= (SELECT max(ms) FROM e) - {_HOUR} GROUP BY ALL"""


ORACLES["event_days_streamed"] = _windows(_DAY)
ORACLES["event_sliding_days_streamed"] = _windows(6 * _HOUR)
