"""Twins of the source queries: what the landed text holds is known from the tables it was built from."""

from __future__ import annotations

from siftline import labels as L

from . import snippets as S
from .snippets import lit

O = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS cust, o_orderkey, o_custkey,
  o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""

LINKS = """links AS (SELECT 'f' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS path, page_id, unnest([
    {'line': 2, 'pos': 0, 'url': url}, {'line': 3, 'pos': 0, 'url': 'https://site' || page_id || '.co.il/careers'},
    {'line': 4, 'pos': 0, 'url': 'https://jobs.lever.co/x' || page_id % 7 || '?utm_source=1'},
    {'line': 4, 'pos': 1, 'url': 'https://www.max.co.il/' || page_id}]) AS l FROM pages)"""


def flat(slug: str, src: str = "o", where: str = "", **columns: str) -> str:
    names = ("board_name", "title", "url", "location", "description", "posted_raw", "updated_raw", "job_id")
    picked = ", ".join(f"{columns.get(n, lit(str()))} AS {n}" for n in names)
    return f"SELECT {slug} AS slug, {picked} FROM {src} {where}"


_MISSING = "SELECT {slug} AS slug, '' AS board_name, '' AS title, '' AS url, '' AS location, '' AS description, " \
           "'' AS posted_raw, '' AS updated_raw, CAST(count(*) AS VARCHAR) AS job_id FROM o WHERE o_orderstatus = 'F' GROUP BY 1"

NL = "chr(10)"
_OWN_NAME = "CASE WHEN o_custkey % 3 = 0 THEN 'Company ' || cust ELSE {} END"
_LEVER_PLACE = "CASE WHEN o_custkey % 2 = 0 THEN 'Haifa | Town ' || cust ELSE 'Single' END"
_ASHBY_PLACE = ("'Tel Aviv' || CASE WHEN o_custkey % 3 = 0 THEN ' | Remote Europe' ELSE '' END || "
                "CASE WHEN o_custkey % 2 = 0 THEN ', Israel' ELSE '' END")
_WORKABLE_PLACE = "CASE WHEN o_custkey % 2 = 0 THEN 'Haifa, Israel | France' ELSE 'Lod, Israel' END"

_LISTING = """lp AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS origin,
  regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS pth FROM pages)"""

_QUOTED = S.sub("term", r"([\\.^$|?*+()\[\]{}\-&#])", r"\\\1")
_WORDS = f"string_split({S.norm('text')}, ' ')"

SQL = {
    "terms_to_matcher": f"""WITH v0 AS (SELECT p_type AS list, unnest([p_name, p_name || ' & (' || p_brand || ')']) AS term FROM part
        UNION ALL SELECT 'all', p_name || ' ' || p_partkey FROM part),
      v AS (SELECT DISTINCT list, {S.norm('term')} AS term FROM v0),
      s AS (SELECT list, count(*) AS terms FROM v GROUP BY 1),
      c AS (SELECT list, term, CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % CAST(ceil(terms / 1000) AS BIGINT) AS chunk
        FROM v JOIN s USING (list))
      SELECT list, chunk, count(*) AS terms, {lit(f'(?<![{S.W}])(?:')} || string_agg({_QUOTED}, '|' ORDER BY length(term) DESC, term)
        || {lit(f')(?![{S.W}])')} AS pattern FROM c GROUP BY 1, 2""",
    "match_terms": f"""WITH b AS (SELECT {_WORDS} AS w FROM benchmark),
      v AS (SELECT DISTINCT 'word' AS list, term FROM (SELECT unnest(w) AS term FROM b) 
        UNION SELECT 'pair', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
      d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      r AS (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
        AS term FROM d)
      SELECT doc_id, list, term FROM r JOIN v USING (term)""",
    "src_link_list": f"WITH {LINKS} SELECT path, CAST(l.line AS BIGINT) AS line, CAST(l.pos AS BIGINT) AS pos, l.url AS url FROM links",
    "link_dedupe_by_site": f"""WITH {LINKS}, i AS (SELECT path, l.line AS line, l.pos AS pos, l.url AS url, CASE WHEN
        contains(l.url, 'lever.co') THEN {S.canonical('l.url')}
        ELSE {S.sub(S.authority('l.url'), r'^www\.', '', '')} END AS identity FROM links)
      SELECT identity, path, url FROM i QUALIFY row_number() OVER (PARTITION BY identity ORDER BY path, line, pos) = 1""",
    "flatten_payload_greenhouse": f"""WITH {O} {flat("'b' || cust", board_name=_OWN_NAME.format("'Board ' || cust"),
        title="'Analyst ' || o_orderpriority", url="'https://boards.greenhouse.io/b' || cust || '/jobs/' || k",
        location="'City ' || cust", description=f"'Order & ' || k || {NL} || 'prio ' || o_orderpriority", posted_raw="day",
        updated_raw="day || 'T10:00:00Z'", job_id="k")} UNION ALL {flat("'b' || cust", board_name=_OWN_NAME.format("'Board ' || cust"),
        title="'No place'", job_id="CAST(o_orderkey + 1000000 AS VARCHAR)")}""",
    "flatten_payload_lever": f"""WITH {O} {flat("'s' || cust", board_name="'s' || cust", title="'Analyst ' || k",
        url="'https://jobs.lever.co/s/' || k",
        location=f"{_LEVER_PLACE} || CASE WHEN o_orderstatus = 'O' THEN ', Israel' ELSE '' END",
        description=f"concat_ws({NL}, 'Plain start', 'Needs', 'SQL ' || k, 'more', 'The end')",
        posted_raw="CAST(o_orderkey * 1000 + 1790000000000 AS VARCHAR)", job_id="k")}""",
    "flatten_payload_ashby": f"""WITH {O} {flat("'s' || cust", board_name="'s' || cust", title="'Analyst ' || k",
        url="'https://jobs.ashbyhq.com/s/' || k", location=f"({_ASHBY_PLACE}) || CASE WHEN o_orderstatus <> 'F' AND "
        "o_custkey % 3 <> 0 THEN ' (Remote)' ELSE '' END",
        description="CASE WHEN o_orderstatus = 'O' THEN 'Plain ' ELSE 'Rich ' END || k", posted_raw="day", job_id="k")}""",
    "flatten_payload_workable": f"""WITH {O} {flat("'s' || cust", board_name=_OWN_NAME.format("'s' || cust"), title="'Analyst ' || k",
        url="'https://apply.workable.com/s' || cust || '/j/SC' || k || '/'",
        location=f"({_WORKABLE_PLACE}) || CASE WHEN o_orderstatus = 'P' THEN ' (Remote)' ELSE '' END",
        description=f"'About ' || k || {NL} || 'Perks'", posted_raw="day", job_id="'SC' || k",
        where="WHERE o_orderstatus <> 'F'")} UNION ALL {_MISSING.format(slug="'s' || cust")}""",
    "flatten_payload_smartrecruiters": f"""WITH {O} {flat("'s' || cust",
        board_name="CASE WHEN o_custkey % 2 = 0 THEN 'Company ' || cust ELSE 's' || cust END", title="'Analyst ' || k",
        url="'https://jobs.smartrecruiters.com/s' || cust || '/' || k",
        location="'Haifa, ' || CASE WHEN o_orderstatus = 'O' THEN 'Israel' ELSE 'fr' END",
        description=f"'Do ' || k || {NL} || 'SQL' || {NL}", posted_raw="day", job_id="k")}""",
    "flatten_payload_comeet": f"""WITH {O} {flat("'12.' || cust",
        board_name="CASE WHEN o_custkey % 3 = 0 THEN 'Own name' ELSE 'Comp ' || cust END", title="'Analyst ' || k",
        url="CASE WHEN o_custkey % 2 = 0 THEN 'https://www.comeet.com/jobs/a/12.345/' || k ELSE 'https://x.example.com/' || k END",
        location="CASE WHEN o_orderstatus = 'O' THEN 'Haifa, Israel' ELSE 'Office ' || cust END",
        description=f"'Do [' || k || ']; then more' || {NL} || 'SQL'", updated_raw="day", job_id="k",
        where="WHERE o_custkey % 2 = 0 OR o_orderstatus <> 'P'")}""",
    "flatten_payload_workday": f"""WITH {O} {flat("'https://t.wd3.myworkdayjobs.com/S' || cust", title="'Analyst ' || k",
        url="CASE WHEN o_custkey % 2 = 0 THEN 'https://ext.example.com/' || k ELSE "
            "'https://t.wd3.myworkdayjobs.com/S' || cust || '/job/' || k END", location="'Haifa, Israel'",
        description="'Text ' || k", posted_raw="CASE WHEN o_custkey % 3 = 0 THEN day ELSE 'Posted Today' END", job_id="k",
        where="WHERE o_orderstatus <> 'F'")} UNION ALL {_MISSING.format(slug="'https://t.wd3.myworkdayjobs.com/S' || cust")}""",
    "flatten_payload_drushim": f"""WITH {O}, x AS ({flat("'q'",
        board_name="CASE WHEN o_custkey % 3 = 0 THEN 'Comp ' || cust ELSE 'חברה' END", title="'Analyst ' || k",
        url="'https://www.drushim.co.il/job/' || k || '/'",
        location="CASE WHEN o_custkey % 2 = 0 THEN 'חיפה, לוד' ELSE 'מרכז / צפון' END", posted_raw="day",
        updated_raw="'2026-09-01'", job_id="k", where="WHERE o_orderstatus <> 'P'")})
      SELECT *, '3 שנים' AS experience_hint FROM x""",
    "flatten_embedded_state_json": f"""WITH {O} {flat("'q'", board_name="'Comp ' || cust",
        title="CASE WHEN o_custkey % 2 = 0 THEN 'Shown ' ELSE 'Analyst ' END || k",
        url="'https://il.indeed.com/viewjob?jk=' || k", location="'Haifa'", posted_raw="'3 days ago'", job_id="k")}""",
    "boards_in_page": """SELECT page_id, 'greenhouse' AS kind, 'co-' || page_id % 9 AS slug FROM pages
      UNION ALL SELECT page_id, 'greenhouse', 'emb' || page_id FROM pages
      UNION ALL SELECT page_id, 'lever', 'co-' || page_id % 5 FROM pages WHERE page_id % 3 = 0""",
    "comeet_refs": """SELECT page_id, 'api' AS kind, '8A.00' || page_id % 10 || '|' || lpad(to_hex(page_id + 1), 20, 'A') AS value
        FROM pages WHERE page_id % 4 = 0
      UNION ALL SELECT page_id, 'api', 'B3.00' || page_id % 10 || '|' || lpad(to_hex(page_id + 3), 20, 'A') FROM pages
        WHERE page_id % 4 = 1
      UNION ALL SELECT page_id, 'page', 'https://www.comeet.com/jobs/co' || page_id || '/1A.00' || page_id % 10 FROM pages
        WHERE page_id % 4 = 2""",
    "workday_home_facets": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'locationCountry' ELSE 'officeLocation' END AS facet,
      CASE c_custkey % 3 WHEN 0 THEN 'il' || c_custkey ELSE 'h' || c_custkey || ',t' || c_custkey END AS ids FROM customer
      WHERE c_custkey % 3 < 2""",
    "page_route": """SELECT page_id, ['board', 'comeet', 'workday', 'one_page', 'embedded', 'posting', 'listing'][page_id % 7 + 1]
      AS route FROM pages""",
    "extract_jsonld_posting": f"""SELECT page_id, 'Analyst & more ' || page_id AS title, 'Org ' || page_id % 13 AS company,
      'Do <b>SQL' || {NL} || page_id AS description, 'Haifa, Israel | Paris, France' AS location,
      '2026-09-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS posted, '' AS updated FROM pages WHERE page_id % 4 < 3""",
    "jsonld_location": """SELECT c_custkey, ['Town ' || k || ', R, Israel', 'Remote (United States)',
      'Remote (France, Spain ' || k || ')', 'Remote', '', 'Lod | Street ' || k || ' | IL, FR', 'Eilat'
      ][c_nationkey % 7 + 1] AS location FROM (SELECT *, c_mktsegment || ' ' || c_custkey AS k FROM customer)""",
    "labeled_fields": """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'Town ' || page_id % 11 ELSE '' END AS location,
      CASE WHEN page_id % 3 < 2 THEN (page_id % 20 + 1) || ' days ago' ELSE '' END AS posted FROM pages""",
    "extract_links": f"""WITH {_LISTING}
      SELECT page_id, origin || '/jobs/view-' || page_id || '/' AS href, 'Senior Kitchen Gardener' AS text FROM lp WHERE page_id % 3 = 0
      UNION ALL SELECT page_id, origin || regexp_replace(regexp_replace(pth, '[^/]*$', ''), '[^/]+/$', '') || 'careers/' || page_id
        || '12345?x=1&y=2', 'Rose Gardener' FROM lp WHERE page_id % 3 = 0
      UNION ALL SELECT page_id, 'https://jobs.lever.co/z' || page_id || '/12', 'Market Gardener' FROM lp WHERE page_id % 3 = 0""",
    "page_yield_status": f"""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN {lit(L.PARTIAL)} ELSE {lit(L.OK)} END AS status,
      CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN {lit(L.NO_RELEVANT_NOW)} ELSE {lit(L.NOT_READABLE)} END AS note FROM pages""",
    "extract_cards": f"""WITH {O}, b AS (SELECT *, {S.cycle(('linkedin', 'alljobs', 'secret', 'jobmaster', 'adamtotal'), 'o_orderkey')}
        AS board_name FROM o)
      SELECT k, board_name, CASE board_name WHEN 'secret' THEN 'https://s.example.com/job/' || k || '/' WHEN 'adamtotal' THEN '/Jobs/' || k
        ELSE k END AS job_id, 'Analyst ' || k AS title, CASE WHEN board_name = 'alljobs' THEN '' ELSE 'Comp ' || cust END AS company,
      CASE WHEN board_name = 'secret' THEN 'Lod & Haifa' ELSE 'Haifa' END AS location,
      CASE WHEN board_name IN ('linkedin', 'jobmaster') THEN day ELSE '' END AS date_text,
      CASE WHEN board_name = 'adamtotal' THEN 'Do SQL' ELSE '' END AS description,
      board_name = 'alljobs' AND o_orderstatus <> 'O' AS closed FROM b""",
    "extract_detail_page": f"""WITH {O} SELECT k, 'Do SQL ' || k || {NL} || 'More' AS description, '3 days ago' AS posted_rel,
      CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'Senior' END AS seniority, 'Banking' AS industry, 'Analyst ' || k AS title
      FROM o WHERE o_custkey % 5 <> 0""",
    "main_content_text": f"""WITH h AS (SELECT page_id, {S.sub('html', '(?s)<nav>.*?(?:</nav>|$)|<footer>.*?(?:</footer>|$)', chr(1))}
        AS html FROM pages),
      m AS (SELECT page_id, html, {S.html_lines(S.first('html', '(?s)<article>(.*?)(?:</article>|$)'))} AS a FROM h)
      SELECT page_id, CASE WHEN length(array_to_string(a, '')) > 200 THEN {S.sub("array_to_string(a, chr(10))", r"\n{2,}", chr(10))}
        ELSE {S.html_text(S.first('html', '(?s)<body>(.*)$'))} END AS main_text FROM m""",
    "posting_from_page": f"""SELECT doc_id, 'Analyst ' || doc_id AS title, 'Site ' || doc_id % 9 AS company,
      {S.sub(f"concat_ws({NL}, nullif({S.strip('text')}, ''), trim(repeat('filler ', 40)))", chr(10) + '{2,}', chr(10))}
      AS description, 'Haifa' AS location, '2026-09-20' AS posted_raw, '' AS updated_raw FROM documents""",
}
