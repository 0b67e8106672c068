"""Twins of the table queries."""

from __future__ import annotations

import re

from siftline import labels as L
from siftline.functions.text import SLUG_STOP_WORDS
from siftline.plans import driver_tables as D
from siftline.sources.boards import KINDS, OTHER_KINDS
from siftline.sources.landing import ORDER

from . import snippets as S
from .scalar import SECTOR, evaluated_ctes, iso
from .snippets import POSTINGS, R, lit

AS_OF = f"DATE '{D.AS_OF}'"
EV = evaluated_ctes()
P = f"WITH {POSTINGS}"

SECTOR_RANK = "CASE company_type " + " ".join(
    f"WHEN {lit(s)} THEN {i}" for i, s in enumerate(L.SECTOR_ORDER)) + f" ELSE {L.SECTOR_ORDER.index(L.OTHER)} END"


def shown_date(d: str) -> str:
    return f"coalesce(strftime({d}, '%d/%m/%Y'), {lit(L.UNKNOWN_DATE)})"


def greedy(src: str, out: str = "kept_ords") -> str:
    """The sequential rule, row by row: what was kept so far decides about the next row."""
    return f"""ranked AS MATERIALIZED (SELECT ord, key, alt_key, company_title, is_low,
    row_number() OVER (ORDER BY is_low, ord) AS rn FROM {src}),
greedy(rn, ks, als, cts, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
  UNION ALL
  SELECT n.rn, CASE WHEN ok THEN list_append(ks, key) ELSE ks END, CASE WHEN ok THEN list_append(als, alt_key) ELSE als END,
    CASE WHEN ok THEN list_append(cts, company_title) ELSE cts END, CASE WHEN ok THEN list_append(kept, ord) ELSE kept END
  FROM (SELECT r.*, g.ks, g.als, g.cts, g.kept, NOT list_contains(g.ks, r.key) AND NOT list_contains(g.als, r.alt_key)
      AND NOT (r.is_low AND list_contains(g.cts, r.company_title)) AS ok
    FROM greedy g JOIN ranked r ON r.rn = g.rn + 1) n),
{out} AS (SELECT unnest(kept) AS ord FROM (SELECT kept FROM greedy ORDER BY rn DESC LIMIT 1))"""


_PLACE = f"CASE WHEN ord % 4 = 0 THEN {lit(L.UNKNOWN_PLACE)} ELSE location END"
_DATE = "CASE WHEN ord % 6 <> 0 THEN DATE '2026-08-28' + CAST(ord % 25 AS INT) END"
STORED = f"""st0 AS (SELECT title, company, source, {_PLACE} AS location,
    CASE WHEN ord % 3 = 0 THEN '' ELSE '2 years' END AS experience, 'stored' AS reason, url, {_DATE} AS date_iso,
    {S.canonical('url')} AS key, DATE '2026-09-01' + CAST(ord % 5 AS INT) AS first_seen, DATE '2026-09-10' AS last_seen,
    CASE WHEN ord % 2 = 0 THEN '' ELSE {lit(L.MEDIA)} END AS company_type, ord
  FROM postings WHERE ord IN (SELECT doc_id FROM labels)),
stored AS (SELECT *, {shown_date('date_iso')} AS date_display,
    concat_ws('|', {S.company_key('company')}, {S.norm('title')}, {S.location_key('location')}) AS alt_key,
    concat_ws('|', {S.company_key('company')}, {S.norm('title')}) AS company_title
  FROM st0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1)"""

KEPT = f"""acc AS (SELECT ord, key, alt_key, company_title, is_low, title, CASE WHEN company = '' THEN {lit(L.UNKNOWN_COMPANY)}
    ELSE company END AS company, source, display AS location, experience, why AS reason, url, date_display, seen AS date_iso,
    listing_url FROM evaluated WHERE accepted),
{greedy('acc')},
kept AS (SELECT acc.* FROM acc JOIN kept_ords USING (ord))"""

BASE = f"WITH RECURSIVE {EV},\n{STORED},\n{KEPT}"


def _last(identity: str) -> str:
    return (f"(SELECT {identity} AS i, arg_max(key, {{'a': first_seen, 'b': ord, 'c': key}}) AS k FROM stored "
            f"GROUP BY {identity})")


MATCHED = f"""matched AS (SELECT kept.*, coalesce(m1.k, m2.k, CASE WHEN kept.is_low THEN m3.k END) AS stored_key FROM kept
  LEFT JOIN {_last('key')} m1 ON m1.i = kept.key LEFT JOIN {_last('alt_key')} m2 ON m2.i = kept.alt_key
  LEFT JOIN {_last('company_title')} m3 ON m3.i = kept.company_title)"""

UPSERTED = f"""{MATCHED},
upd AS (SELECT stored_key, max(date_iso) AS d,
    arg_min(location, {{'a': is_low, 'b': ord}}) FILTER (WHERE location <> {lit(L.UNKNOWN_PLACE)}) AS loc,
    arg_min(experience, {{'a': is_low, 'b': ord}}) FILTER (WHERE experience <> '') AS exp
  FROM matched WHERE stored_key IS NOT NULL GROUP BY stored_key),
upserted AS (SELECT key, title, company, source,
    CASE WHEN location = {lit(L.UNKNOWN_PLACE)} THEN coalesce(loc, location) ELSE location END AS location,
    CASE WHEN experience = '' THEN coalesce(exp, '') ELSE experience END AS experience, reason, url,
    CASE WHEN d IS NOT NULL AND (date_iso IS NULL OR d > date_iso) THEN {shown_date('d')} ELSE date_display END AS date_display,
    CASE WHEN d IS NOT NULL AND (date_iso IS NULL OR d > date_iso) THEN d ELSE date_iso END AS date_iso, alt_key,
    first_seen, CASE WHEN stored_key IS NOT NULL THEN {AS_OF} ELSE last_seen END AS last_seen, company_type, FALSE AS is_new,
    stored.ord
  FROM stored LEFT JOIN upd ON upd.stored_key = stored.key
  UNION ALL
  SELECT key, title, company, source, location, experience, reason, url, date_display, date_iso, alt_key, {AS_OF}, {AS_OF},
    '', TRUE, ord FROM matched WHERE stored_key IS NULL)"""

RETRACTIONS = f"""retr AS (SELECT key, CASE WHEN outcome = {lit(L.TOO_OLD)} THEN seen END AS seen_date FROM evaluated
  WHERE outcome IN ({lit(L.TOO_OLD)}, {lit(L.NO_KEYWORD)}) OR starts_with(outcome, {lit(L.PLACE_PREFIX)}))"""


def sector_of(src: str, name: str, industry: str, listing: str, description: str, keep: str) -> str:
    """Sub-select with ``x`` = 'sector|strength'."""
    return (f"(SELECT {keep}, {SECTOR} AS x FROM (SELECT *, lower(name) AS low, {S.norm('name')} AS plain FROM "
            f"(SELECT {keep}, {name} AS name, {industry} AS industry, {listing} AS listing_url, {description} AS description "
            f"FROM {src})))")


STRENGTH = "CASE split_part(x, '|', 2) " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in L.STRENGTH.items()) + " END"


def strongest(src: str, company: str = "company", industry: str = "''") -> str:
    inner = sector_of(src, company, industry, "listing_url || ' ' || url", "description",
                      "ord, is_low, company")
    return f"""(SELECT {S.company_key('company')} AS company_key, arg_max(split_part(x, '|', 1),
      {{'a': {STRENGTH}, 'b': NOT is_low, 'c': -ord}}) AS company_type FROM {inner} GROUP BY 1)"""


RUN = f"""{BASE},
{UPSERTED},
{RETRACTIONS},
remaining AS (SELECT * FROM upserted u WHERE NOT EXISTS (SELECT 1 FROM retr r WHERE r.key = u.key AND
    (r.seen_date IS NULL OR u.date_iso IS NULL OR r.seen_date >= u.date_iso))
  AND (date_iso IS NULL OR date_diff('day', date_iso, {AS_OF}) <= {R.fresh_days})),
types AS (SELECT * FROM {strongest("(SELECT e.* FROM evaluated e JOIN kept_ords USING (ord))")}),
typed AS (SELECT r.* EXCLUDE (company_type), CASE WHEN t.company_type IS NOT NULL THEN t.company_type
    WHEN r.company_type <> '' THEN r.company_type ELSE split_part(n.x, '|', 1) END AS company_type
  FROM upserted r LEFT JOIN types t ON t.company_key = {S.company_key('r.company')}
  JOIN {sector_of('upserted', 'company', "''", 'url', "''", 'key')} n USING (key)),
cur AS (SELECT * FROM typed WHERE key IN (SELECT key FROM remaining)),
new_jobs AS (SELECT * FROM typed WHERE is_new),
removed AS (SELECT (SELECT count(*) FROM upserted) - (SELECT count(*) FROM remaining) AS n),
reasons AS (SELECT outcome AS reason, count(*) AS n FROM evaluated GROUP BY 1
  UNION ALL SELECT {lit(L.DUPLICATE)}, (SELECT count(*) FROM acc) - (SELECT count(*) FROM kept)
  WHERE (SELECT count(*) FROM acc) > (SELECT count(*) FROM kept))"""

CURRENT = (f"key, title, company, source, location, experience, reason, url, date_display, "
           f"coalesce({iso('date_iso')}, '') AS date_iso, alt_key, {iso('first_seen')} AS first_seen, "
           f"{iso('last_seen')} AS last_seen")

STATUSES = f"""sources0 AS (SELECT DISTINCT source FROM documents),
statuses AS (SELECT 'https://' || source || '.example.com/' AS url, source AS site, 'list' AS method, {lit(L.OK)} AS status,
    '' AS error, -CAST(substr(source, 4) AS BIGINT) - 1 AS ord FROM sources0
  UNION ALL SELECT 'https://o.example.com/' || CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 9 = 0
      THEN 'Bing ' || o_orderpriority WHEN o_custkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END, 'search',
    CASE WHEN o_orderstatus = 'O' THEN {lit(L.OK)} WHEN o_orderstatus = 'F' THEN {lit(L.FAILED)}
      WHEN o_custkey % 3 = 0 THEN {lit(L.UNREACHABLE)} ELSE {lit(L.PARTIAL)} END,
    CASE WHEN o_orderstatus = 'P' THEN {lit(L.NOT_SCANNED)} ELSE '' END, o_orderkey FROM orders)"""

SITES = f"""(SELECT arg_min(site, ord) AS site FROM statuses WHERE status IN ({lit(L.OK)}, {lit(L.PARTIAL)}) AND site <> ''
  AND NOT starts_with(error, 'לא נסרק') AND NOT starts_with(site, 'Bing') AND NOT starts_with(site, 'גילוי')
  GROUP BY lower(site))"""

COUNTED = """counted AS (SELECT s.*, coalesce(k.n, 0) AS "count" FROM statuses s
  LEFT JOIN (SELECT listing_url, count(*) AS n FROM kept GROUP BY 1) k ON k.listing_url = s.url)"""

ABROAD = f"""abroad AS (SELECT location, count(*) AS n, min({{'a': is_low, 'b': ord}}) AS first FROM evaluated WHERE
    outcome IN ({lit(L.PLACE_PREFIX + L.PLACE_NOT_HOME)}, {lit(L.PLACE_PREFIX + L.PLACE_ABROAD)})
  GROUP BY 1 ORDER BY n DESC, min({{'a': is_low, 'b': ord}}))"""

SLUGS = f"""sl0 AS (SELECT replace(s_name, '#', ' ') AS company, s_suppkey AS ord, list_filter(string_split(
    lower(replace(s_name, '#', ' ')), ' '), lambda w: w <> '' AND NOT list_contains({S.arr(SLUG_STOP_WORDS)}, w)) AS ws
  FROM supplier),
sl1 AS (SELECT company, ord, [array_to_string(ws, ''), array_to_string(ws, '-'), ws[1]] AS cs FROM sl0),
sl2 AS (SELECT company, ord, list_filter(cs, lambda x, i: list_position(cs, x) = i AND length(x) BETWEEN 3 AND 40) AS cs FROM sl1),
slugs AS (SELECT company, ord, generate_subscripts(cs, 1) - 1 AS rank, unnest(cs) AS slug FROM sl2),
plan AS (SELECT * FROM slugs WHERE slug NOT IN (SELECT slug FROM slugs WHERE rank = 0 AND ord % 60 <= 30))"""

CANDIDATES = f"""cand AS (SELECT {S.cycle(KINDS + ('unknown',), 'c_custkey')} AS kind,
    CASE WHEN c_custkey % 2 = 0 THEN 'Board' ELSE 'board' END || CAST(c_custkey % 100 AS VARCHAR) AS slug, c_name AS company,
    'probe' AS via, c_custkey AS ord, 0 AS finder FROM customer
  UNION ALL SELECT 'lever', 'BOARD' || CAST(s_suppkey AS VARCHAR), '', 'search', s_suppkey, 1 FROM supplier)"""

ST_RETR = """sret AS (SELECT key, CASE WHEN source <> 'src7' THEN DATE '2026-09-08' END AS seen_date FROM stored),
srest AS (SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM sret r WHERE r.key = s.key AND
  (r.seen_date IS NULL OR s.date_iso IS NULL OR r.seen_date >= s.date_iso)))"""

FRESH = f"(date_iso IS NULL OR date_diff('day', date_iso, {AS_OF}) <= {R.fresh_days})"
_KINDS = ", ".join(lit(k) for k in KINDS + OTHER_KINDS)
_INDUSTRY = "CASE WHEN ord % 9 = 0 THEN 'retail' WHEN ord % 9 = 1 THEN 'banking' ELSE '' END"


def _totals() -> str:
    return """totals AS (SELECT 0 AS pos, 'raw' AS item, (SELECT count(*) FROM evaluated) AS n
  UNION ALL SELECT 1, 'accepted', (SELECT count(*) FROM kept) UNION ALL SELECT 2, 'new', (SELECT count(*) FROM new_jobs)
  UNION ALL SELECT 3, 'cumulative', (SELECT count(*) FROM cur) UNION ALL SELECT 4, 'removed', (SELECT n FROM removed)
  UNION ALL SELECT 5, 'links', (SELECT count(*) FROM statuses))"""


def _cells(table: str, columns: str, src: str) -> str:
    cells = ", ".join(f'coalesce(CAST("{c}" AS VARCHAR), \'\')' for c in columns.split())
    return f"SELECT {lit(table)} AS table_name, concat_ws(' ¦ ', {cells}) AS row_text FROM {src}"


_JOB = "title company_type company source location experience reason url date_display"

SQL = {
    "match_existing": f"{BASE}, {MATCHED} SELECT ord, coalesce(stored_key, '-') AS stored_key FROM matched",
    "retract_join": f"{P}, {STORED}, {ST_RETR} SELECT key, coalesce({iso('date_iso')}, '') AS date_iso FROM srest",
    "detail_join": """SELECT l_partkey, coalesce(p_type, 'missing') AS p_type, count(*) AS n FROM lineitem
      LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey GROUP BY 1, 2""",
    "probe_plan": f"WITH {SLUGS} SELECT company, rank, slug, unnest({S.arr(KINDS)}) AS kind FROM plan",
    "probe_rank_cap": f"WITH {SLUGS} SELECT company, rank, slug FROM plan ORDER BY rank, ord LIMIT 100",
    "probe_leftover": f"""WITH {SLUGS} SELECT DISTINCT slug FROM plan WHERE slug NOT IN
      (SELECT 'supplier-' || lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0') FROM customer)""",
    "union_boards": f"""WITH {CANDIDATES} SELECT via, kind, count(*) AS n, count(DISTINCT lower(slug)) AS slugs FROM cand
      GROUP BY 1, 2""",
    "boards_new": f"""WITH {CANDIDATES}, known AS (SELECT {S.cycle(KINDS, 'n_nationkey')} AS kind,
        'board' || CAST(n_nationkey AS VARCHAR) AS slug FROM nation)
      SELECT kind, slug, company, via FROM cand WHERE kind IN ({_KINDS}) AND NOT EXISTS (SELECT 1 FROM known
        WHERE known.kind = cand.kind AND known.slug = lower(cand.slug))
      QUALIFY row_number() OVER (PARTITION BY kind, lower(slug) ORDER BY finder, ord) = 1""",
    "board_names": f"""WITH {CANDIDATES}, x AS (SELECT cand.kind, cand.slug, CASE WHEN finder = 1 THEN coalesce(n_name, '')
        ELSE company END AS company, finder, ord FROM cand LEFT JOIN nation ON finder = 1 AND
        cand.slug = 'BOARD' || CAST(n_nationkey AS VARCHAR))
      SELECT kind, slug, company FROM x
      QUALIFY row_number() OVER (PARTITION BY kind, lower(slug) ORDER BY finder DESC, ord) = 1""",
    "status_counts": f'{BASE}, {STATUSES}, {COUNTED} SELECT url, status, "count" FROM counted',
    "only_sources": f"{P} SELECT ord, source FROM postings WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4')",
    "subscriber_only_split": f"""{P} SELECT 'open' AS part, url AS value FROM postings WHERE title <> 'Pilot'
      UNION ALL SELECT 'retracted', {S.canonical('url')} FROM postings WHERE title = 'Pilot'""",
    "drop_without_description": f"""{P} SELECT listing_url, count(*) FILTER (WHERE location <> '') AS kept,
      count(*) FILTER (WHERE location = '') AS missing FROM postings GROUP BY 1""",
    "link_status": f"""WITH log AS (SELECT 'https://l.example.com/' || CAST(l_orderkey AS VARCHAR) AS url,
        {S.cycle(('page', 'board', 'search', 'guarded'), 'l_orderkey')} AS family, l_linenumber AS page,
        CASE WHEN l_discount > 0.05 THEN CAST({S.cycle(('401', '403', '404', '500', '999'), 'l_partkey')} AS INT) ELSE 200 END
          AS code, l_tax < 0.075 AS in_time FROM lineitem),
      f AS (SELECT url, any_value(family) AS family, bool_and(in_time OR page > 1) AS in_time,
        min(code) FILTER (WHERE page = 1 AND code <> 200) AS head,
        min({{'p': page, 'c': CASE WHEN in_time THEN code ELSE 0 END}})
          FILTER (WHERE page > 1 AND (code <> 200 OR NOT in_time)) AS later FROM log GROUP BY url)
      SELECT url, CASE WHEN NOT in_time THEN {lit(L.PARTIAL)} WHEN head IS NOT NULL THEN CASE WHEN
          (family = 'page' AND head IN (401, 403, 404)) OR (family = 'board' AND head = 404)
          OR (family = 'search' AND head IN (403, 999)) OR (family = 'guarded' AND head IN (401, 403))
          THEN {lit(L.UNREACHABLE)} ELSE {lit(L.FAILED)} END
        WHEN later IS NOT NULL THEN {lit(L.PARTIAL)} ELSE {lit(L.OK)} END AS status,
      CASE WHEN NOT in_time THEN {lit(L.NOT_SCANNED)} WHEN head IS NOT NULL THEN 'HTTP ' || CAST(head AS VARCHAR)
        WHEN later IS NOT NULL THEN {lit(L.STOPPED_AT_PAGE + ' ')} || CAST(later.p AS VARCHAR) || ': ' ||
          CASE WHEN later.c = 0 THEN {lit(L.TIME_OVER)} ELSE 'HTTP ' || CAST(later.c AS VARCHAR) END ELSE '' END AS error FROM f""",
    "predetail_prune": f"""WITH {S.CUSTOMER_PLACES}, p2 AS (SELECT *, {S.cycle(D.TITLES, 'c_custkey')} || ' ' || c_mktsegment AS title FROM cp),
      {S.title_ctes('p2', key='c_custkey')}, {S.place_ctes('p2', 'FALSE', 'c_custkey')}
      SELECT c_custkey, title, location FROM p2 JOIN title_class USING (c_custkey) JOIN place USING (c_custkey)
      WHERE class <> 'excluded' AND decision <> 'foreign'""",
    "board_has_home_jobs": f"""WITH {S.CUSTOMER_PLACES}, {S.place_ctes('cp', 'FALSE', 'c_custkey')} SELECT 'lever' AS kind,
      lower(c_mktsegment) || '-' || CAST(c_custkey % 97 AS VARCHAR) AS slug,
      bool_or(decision = 'israel') AS has_home_jobs FROM place JOIN cp USING (c_custkey) GROUP BY 2""",
    "reason_counts": f"""WITH RECURSIVE {EV}, {KEPT} SELECT outcome AS reason, count(*) AS n FROM evaluated GROUP BY 1
      UNION ALL SELECT {lit(L.DUPLICATE)}, (SELECT count(*) FROM acc) - (SELECT count(*) FROM kept)
      WHERE (SELECT count(*) FROM acc) > (SELECT count(*) FROM kept)""",
    "foreign_location_audit": f"WITH {EV}, {ABROAD} SELECT location, n FROM abroad ORDER BY n DESC, first LIMIT 3",
    "strongest_company_type": f"""{P} SELECT company_key, company_type FROM
      {strongest('postings', industry=_INDUSTRY)}""",
    "apply_company_types": f"""{P}, {STORED}, types AS (SELECT * FROM {strongest('postings', industry=_INDUSTRY)})
      SELECT key, company, CASE WHEN t.company_type IS NOT NULL THEN t.company_type WHEN s.company_type <> ''
        THEN s.company_type ELSE split_part(n.x, '|', 1) END AS company_type
      FROM stored s LEFT JOIN types t ON t.company_key = {S.company_key('s.company')}
      JOIN {sector_of('stored', 'company', "''", 'url', "''", 'key')} n USING (key)""",
    "company_first_site": """SELECT 'user ' || CAST(user_id AS VARCHAR) AS company, arg_min(event_type, event_id) AS site
      FROM events WHERE user_id % 11 <> 0 GROUP BY 1""",
    "status_rollup": f"""WITH {STATUSES} SELECT count(*) FILTER (WHERE status = {lit(L.OK)}) AS ok,
      count(*) FILTER (WHERE status = {lit(L.PARTIAL)}) AS partial,
      count(*) FILTER (WHERE status NOT IN ({lit(L.OK)}, {lit(L.PARTIAL)})) AS failed FROM statuses""",
    "unique_sites": f"WITH {STATUSES} SELECT site FROM {SITES}",
    "status_notes": f"""WITH n0 AS (SELECT l_orderkey, l_linestatus || ' not read' AS note, min(l_linenumber) AS o FROM lineitem
        GROUP BY 1, 2),
      n AS (SELECT l_orderkey, left(string_agg(note, '; ' ORDER BY o, note), 500) AS notes FROM n0 GROUP BY 1),
      z AS (SELECT l_orderkey AS k, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
      SELECT CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderstatus = 'F' THEN {lit(L.FAILED)}
        WHEN notes IS NOT NULL THEN {lit(L.PARTIAL)} ELSE {lit(L.OK)} END AS status,
        CASE WHEN o_orderstatus = 'F' AND NOT coalesce(last > o_custkey % 7 + 1, false) THEN 'HTTP 500'
          ELSE coalesce(notes, '') END AS error
      FROM orders LEFT JOIN n ON l_orderkey = o_orderkey LEFT JOIN z ON k = o_orderkey""",
    "run_audit": f"""{RUN}, {STATUSES}, {ABROAD}, {_totals()}
      SELECT (SELECT n FROM totals WHERE item = 'raw') AS raw, (SELECT n FROM totals WHERE item = 'accepted') AS accepted,
        (SELECT n FROM totals WHERE item = 'new') AS new, (SELECT n FROM totals WHERE item = 'cumulative') AS cumulative,
        (SELECT n FROM totals WHERE item = 'removed') AS removed, (SELECT n FROM totals WHERE item = 'links') AS links,
        (SELECT string_agg(reason || '=' || CAST(n AS VARCHAR), '; ' ORDER BY reason) FROM reasons) AS reasons,
        (SELECT string_agg(location || '=' || CAST(n AS VARCHAR), '; ' ORDER BY location) FROM abroad) AS abroad""",
    "visit_once": f"{P} SELECT {S.canonical('url')} AS url_key, min(ord) AS ord FROM postings GROUP BY 1",
    "greedy_dedupe": f"WITH RECURSIVE {EV}, {KEPT} SELECT ord, key, alt_key FROM kept",
    "dedupe_postings": f"""WITH RECURSIVE {POSTINGS}, pk AS (SELECT ord, is_low, {S.canonical('url')} AS key,
        concat_ws('|', {S.company_key('company')}, {S.norm('title')}, {S.location_key('location')}) AS alt_key,
        concat_ws('|', {S.company_key('company')}, {S.norm('title')}) AS company_title FROM postings),
      {greedy('pk')} SELECT ord, key, alt_key FROM pk JOIN kept_ords USING (ord)""",
    "source_priority_order": f"{P} SELECT source, ord FROM postings ORDER BY is_low, ord",
    "newest_first": f"""{P}, {STORED} SELECT key, coalesce({iso('date_iso')}, '') AS date_iso, {iso('first_seen')}
      AS first_seen FROM stored ORDER BY stored.date_iso DESC NULLS LAST, stored.first_seen DESC, ord""",
    "report_order": f"""{P}, {STORED} SELECT key, company_type FROM stored ORDER BY {SECTOR_RANK}, date_iso DESC NULLS LAST,
      first_seen DESC, ord""",
    "history_tail": """WITH h AS (SELECT CAST(ts AS DATE) AS d, count(*) AS links, max(event_id) AS r FROM events GROUP BY 1),
      t AS (SELECT * FROM h ORDER BY d DESC, r DESC LIMIT 10) SELECT strftime(d, '%Y-%m-%d') AS run_date, links FROM t""",
    "union_sources": """SELECT 'documents' AS part, count(*) AS n, 0 AS without_url, count(*) AS ords FROM documents
      UNION ALL SELECT 'conversations', count(*), count(*), count(*) FROM conversations
      UNION ALL SELECT 'messages', count(*), count(*), count(DISTINCT (conv_id, turn)) FROM conversations WHERE (conv_id + turn) % 7 <> 0
      UNION ALL SELECT 'not read: messages', count(*), 0, 0 FROM conversations WHERE (conv_id + turn) % 7 = 0
      UNION ALL SELECT 'not read: lost', 0, 0, 0""",
    "upsert_cumulative": f"""{BASE}, {UPSERTED} SELECT {CURRENT}, CASE WHEN is_new THEN 'new' ELSE company_type END
      AS company_type FROM upserted""",
    "expire_cumulative": f"""{P}, {STORED} SELECT key, coalesce({iso('date_iso')}, '') AS date_iso FROM stored
      WHERE {FRESH.replace('date_iso', 'stored.date_iso')}""",
    "collect_retractions": f"""WITH {EV}, {RETRACTIONS} SELECT key, '' AS alt_key, coalesce({iso('seen_date')}, '') AS seen_date
      FROM retr""",
    "removed_count": f"""{P}, {STORED}, {ST_RETR} SELECT (SELECT count(*) FROM stored) -
      (SELECT count(*) FROM srest WHERE {FRESH}) AS removed""",
    "daily_cumulative": f"{RUN} SELECT {CURRENT}, company_type FROM cur",
    "daily_state": f"{RUN} SELECT {CURRENT}, company_type FROM cur",
    "run_ledger": """SELECT strftime(DATE '2026-09-24' + CAST(doc_id % 3 AS INT), '%Y-%m-%d') AS run_date, doc_id % 3 AS run_id, count(*) AS raw
      FROM documents WHERE doc_id % 3 > 0 GROUP BY 1, 2""",
    "src_state": f"""{P} SELECT ord, title, url, '' AS company_type, '' AS experience,
      CASE WHEN ord % 2 = 0 THEN '2026-09-01' ELSE '' END AS date_iso FROM postings""",
    "state_sink": f"""{P}, {STORED} SELECT key, coalesce({iso('date_iso')}, '') AS date_iso FROM stored
      WHERE {FRESH.replace('date_iso', 'stored.date_iso')}""",
    "report_tables": f"""{RUN}, {STATUSES}, {COUNTED} {_cells('new', _JOB, 'new_jobs')} UNION ALL
      {_cells('cumulative', _JOB, 'cur')} UNION ALL {_cells('sources', 'url site method status error count', 'counted')}
      UNION ALL {_cells('sites', 'site', SITES)}""",
    "report_verify": f"""{RUN}, {STATUSES} SELECT 'new' AS table_name, count(*) AS n FROM new_jobs UNION ALL
      SELECT 'cumulative', count(*) FROM cur UNION ALL SELECT 'sources', count(*) FROM statuses UNION ALL
      SELECT 'sites', count(*) FROM {SITES}""",
    "stream_visit_once": """SELECT DISTINCT 'https://example.com/u/' || CAST(user_id AS VARCHAR) AS url_key FROM events""",
    "summary_table": f"""{RUN}, {STATUSES}, {_totals()} SELECT 'total' AS section, item, n FROM totals
      UNION ALL SELECT 'reason', reason, n FROM reasons""",
}
# the stream starts from an empty table: everything kept is new
_EMPTY = STORED.replace("ORDER BY ord) = 1", "ORDER BY ord) = 0")
SQL["stream_upsert"] = RUN.replace(STORED, _EMPTY) + f" SELECT {CURRENT}, company_type FROM cur"

# the same run over landed postings: each kind of source answers with part of a posting
_KIND = S.cycle(D.LANDED_KINDS, "ord")
_FIRM = "'adamtotal.co.il'"
_TITLES = re.sub(r"\b(tc1|tc2|title_class)\b", r"landed_\1", S.title_ctes("landed1"))
LANDED = f"""{POSTINGS.replace("postings AS", "postings0 AS", 1)},
hints AS (SELECT 'lv-' || n_nationkey * 2 AS slug, upper(n_name[1]) || lower(n_name[2:]) AS hint FROM nation),
landed0 AS (SELECT p.*, {_KIND} AS kind, 'lv-' || ord // 500 AS team, 'wk-' || ord // 20 AS account FROM postings0 p),
accounts AS (SELECT account, max(company) AS name FROM landed0 WHERE kind = 'workable' AND ord % 40 = 1 GROUP BY 1),
landed1 AS (SELECT l.ord AS ord, kind, title, CASE kind
    WHEN 'greenhouse' THEN CASE WHEN l.ord % 12 = 0 THEN company ELSE 'Gh ' || l.ord END
    WHEN 'workable' THEN coalesce(name, 'Wk ' || l.ord // 20) WHEN 'lever' THEN coalesce(hint, 'Lv ' || l.ord // 500) ELSE company END AS company,
  CASE kind WHEN 'workable' THEN 'https://apply.workable.com/' || l.account || '/j/SC' || l.ord || '/'
    WHEN 'linkedin' THEN 'https://www.linkedin.com/jobs/view/' || l.ord WHEN 'adamtotal' THEN 'https://career.adamtotal.co.il/Jobs/' || l.ord
    ELSE url END AS url, description, location, source AS source0,
  CASE kind WHEN 'adamtotal' THEN '' WHEN 'lever' THEN CAST(1790000000000 - (l.ord % 40) * 86400000 AS VARCHAR) ELSE posted_raw END AS posted_raw,
  CASE WHEN kind IN ('greenhouse', 'page') THEN updated_raw ELSE '' END AS updated_raw,
  CASE kind WHEN 'greenhouse' THEN 'https://job-boards.greenhouse.io/gh-' || l.ord WHEN 'workable' THEN 'https://apply.workable.com/' || l.account || '/'
    WHEN 'linkedin' THEN 'https://www.linkedin.com/jobs-guest/search?start=' || l.ord // 60
    WHEN 'adamtotal' THEN 'https://career.adamtotal.co.il/c' || l.ord // 30 WHEN 'lever' THEN 'https://jobs.lever.co/' || team
    ELSE listing_url END AS listing_url, kind IN ('linkedin', 'adamtotal') AS home_context
  FROM landed0 l LEFT JOIN accounts ON accounts.account = l.account AND kind = 'workable' LEFT JOIN hints ON hints.slug = l.team AND kind = 'lever'
  WHERE kind <> 'workable' OR l.ord % 3 < 2),
{_TITLES},
landed2 AS (SELECT landed1.*, row_number() OVER (ORDER BY list_position({S.arr(ORDER)}, kind), ord) AS place FROM landed1
  JOIN landed_title_class USING (ord) WHERE kind = 'page' OR (class IS NOT NULL AND class <> 'excluded')),
landed3 AS (SELECT * FROM landed2 QUALIFY row_number() OVER (PARTITION BY {S.canonical('url')} ORDER BY place) = 1),
postings AS (SELECT * EXCLUDE (ord, place, source0), place AS ord, CASE kind WHEN 'linkedin' THEN 'LinkedIn' WHEN 'adamtotal' THEN {_FIRM}
    WHEN 'page' THEN source0 || '.example.com' ELSE company END AS source, kind = 'page' AND source0 = '{D.LOW_PRIORITY_SOURCE}' AS is_low
  FROM landed3)"""
SQL["landed_cumulative"] = (RUN.replace(S.place_ctes("postings", "FALSE"), S.place_ctes("postings", "home_context")).replace(
    STORED, STORED.replace("FROM postings", "FROM postings0")).replace(POSTINGS, LANDED) + f" SELECT {CURRENT}, company_type FROM cur")
