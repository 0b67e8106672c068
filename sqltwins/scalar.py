"""Twins of the row-at-a-time queries."""

from __future__ import annotations

from siftline import labels as L
from siftline.functions.text import SLUG_STOP_WORDS
from siftline.functions.urls import SITE_NAMES
from siftline.plans import driver_tables as D
from siftline.plans.scalar_queries import _board_urls
from siftline.sources.boards import BOARD_URLS, KINDS

from . import snippets as S
from .snippets import POSTINGS, R, W, lit

P = f"WITH {POSTINGS}"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def evaluated_ctes() -> str:
    """CTEs up to evaluated(ord, accepted, outcome, seen, key, alt_key, why, ...)."""
    ok, reason = S.essence("class", "a", "e")
    posted, updated = S.parse_date("posted_raw"), S.parse_date("updated_raw")
    return f"""{POSTINGS},
{S.title_ctes('postings')},
{S.place_ctes('postings', 'FALSE')},
kw AS (SELECT ord, {S.keywords('k')} AS kws FROM (SELECT ord, {S.keyword_text('description')} AS k FROM postings)),
es0 AS (SELECT ord, class, {S.score('low', R.analytics)} AS a, {S.score('low', R.engineering)} AS e
  FROM (SELECT ord, class, lower(description) AS low FROM postings JOIN title_class USING (ord))),
es AS (SELECT ord, {ok} AS ok, {reason} AS reason FROM es0),
dd AS (SELECT ord, {S.relevant('p', 'u')} AS d FROM (SELECT ord, {posted} AS p, {updated} AS u FROM postings)),
ab AS (SELECT ord, {S.title_abroad('title')} AS abroad FROM postings),
ev0 AS (SELECT postings.*, class, kws, ok, es.reason AS essence, display, d,
  CASE WHEN abroad THEN 'foreign' ELSE decision END AS decision,
  CASE WHEN abroad THEN {lit(L.PLACE_TITLE_ABROAD)} ELSE note END AS note
  FROM postings JOIN title_class USING (ord) JOIN kw USING (ord) JOIN es USING (ord) JOIN dd USING (ord)
  JOIN ab USING (ord) JOIN place USING (ord)),
ev1 AS (SELECT *, CASE
  WHEN class IS NULL OR class = 'excluded' THEN {lit(L.TITLE_NOT_RELEVANT)}
  WHEN length(description) < {R.min_description} THEN {lit(L.NO_DESCRIPTION)}
  WHEN len(kws) = 0 THEN {lit(L.NO_KEYWORD)}
  WHEN NOT ok THEN essence
  WHEN decision IN ('excluded', 'foreign') THEN {lit(L.PLACE_PREFIX)} || CASE WHEN note = '' THEN decision ELSE note END
  WHEN d IS NOT NULL AND date_diff('day', d, DATE '{D.AS_OF}') > {R.fresh_days} THEN {lit(L.TOO_OLD)}
  ELSE {lit(L.ACCEPTED)} END AS outcome FROM ev0),
evaluated AS (SELECT ord, title, company, source, url, listing_url, is_low, description, location,
  outcome = {lit(L.ACCEPTED)} AS accepted, outcome,
  CASE WHEN outcome IN ({lit(L.ACCEPTED)}, {lit(L.TOO_OLD)}) THEN d END AS seen, {S.canonical('url')} AS key,
  display, essence, kws, note,
  CASE WHEN outcome = {lit(L.ACCEPTED)} THEN concat_ws('|', {S.company_key('company')}, {S.norm('title')},
    {S.location_key('display')}) END AS alt_key,
  CASE WHEN outcome = {lit(L.ACCEPTED)} THEN concat_ws('|', {S.company_key('company')}, {S.norm('title')}) END
    AS company_title,
  CASE WHEN outcome = {lit(L.ACCEPTED)} THEN essence || {lit(L.KEYWORDS_PREFIX)} || array_to_string(kws, ', ')
    || CASE WHEN note <> '' THEN '; ' || note ELSE '' END
    || CASE WHEN d IS NULL THEN {lit(L.DATE_UNKNOWN_SUFFIX)} ELSE '' END END AS why,
  CASE WHEN outcome = {lit(L.ACCEPTED)} THEN {S.experience('description', lit(''))} END AS experience,
  CASE WHEN outcome = {lit(L.ACCEPTED)} THEN coalesce(strftime(d, '%d/%m/%Y'), {lit(L.UNKNOWN_DATE)}) END AS date_display
  FROM ev1)"""


def _sector() -> str:
    """Sector and strength over sec(name, low, plain, industry, listing_url, description)."""
    def both(p: str) -> str:
        return f"({S.has('low', p)} OR {S.has('plain', p)})"

    def re2(pattern: str) -> str:
        return (pattern.replace(f"(?<![{W}])", rf"(?:^|[^{W}])").replace(f"(?![{W}])", rf"(?:$|[^{W}])")
                .replace("(?![a-z])", "(?:$|[^a-z])").replace("(?![א-ת])", "(?:$|[^א-ת])").replace("(?!t)", "(?:$|[^t])"))

    cases = [f"WHEN low = {lit(n)} THEN {lit(s + '|override')}" for n, s in R.sector_overrides]
    cases.append(f"WHEN {S.has('name', re2(R.hidden_pattern).replace('(?iu)', '(?i)'))} OR "
                 f"{S.has('name', re2(R.agency_pattern).replace('(?iu)', '(?i)'))} THEN {lit(L.AGENCY + '|hidden')}")
    cases += [f"WHEN {both(re2(p))} THEN {lit(s + '|name')}" for s, p in R.name_sectors]
    cases += [f"WHEN {S.has('industry', re2(p))} THEN {lit(s + '|industry')}" for s, p in R.industry_sectors]
    cases.append(f"WHEN {S.has('listing_url', R.tech_boards_pattern.replace('(?iu)', '(?i)'))} THEN "
                 f"{lit(L.HITECH + '|ats')}")
    words = " + ".join(f"CAST({S.has('lower(description)', re2(p))} AS INT)" for p in R.tech_words)
    cases.append(f"WHEN {words} >= 2 THEN {lit(L.HITECH + '|description')}")
    return "CASE " + " ".join(cases) + f" ELSE {lit(L.OTHER + '|none')} END"


SECTOR = _sector()


def _known_site(x: str) -> str:
    cases = " ".join(f"WHEN h = {lit(d)} OR ends_with(h, {lit('.' + d)}) THEN {lit(n)}" for d, n in SITE_NAMES.items())
    host = S.sub(S.authority(S.strip(x)), r":[^\]]*$", "", "")
    body = f"CASE {cases} ELSE {S.sub('h', r'^(?:www|careers|jobs|career)\.', '', '')} END"
    return f"(SELECT {body} FROM (SELECT {host} AS h))"


_BOARD = """CASE
  WHEN regexp_matches(u, '(?i)greenhouse\\.io/embed/job_board(?:/js)?\\?for=[\\p{L}\\p{N}_\\-]') THEN 'greenhouse'
  WHEN regexp_matches(u, '(?i)boards(?:\\.eu)?\\.greenhouse\\.io/[\\p{L}\\p{N}_\\-]') AND
    NOT regexp_matches(u, '(?i)greenhouse\\.io/(?:embed|v1)(?:$|[^\\p{L}\\p{N}_\\-])') THEN 'greenhouse'
  WHEN regexp_matches(u, '(?i)boards-api\\.greenhouse\\.io/v1/boards/') THEN 'greenhouse'
  WHEN regexp_matches(u, '(?i)jobs\\.lever\\.co/[\\p{L}\\p{N}_.\\-]') AND NOT regexp_matches(u, 'lever\\.co/api$') THEN 'lever'
  WHEN regexp_matches(u, '(?i)jobs\\.ashbyhq\\.com/') THEN 'ashby'
  WHEN regexp_matches(u, '(?i)apply\\.workable\\.com/') AND NOT regexp_matches(u, 'workable\\.com/j/') THEN 'workable'
  WHEN regexp_matches(u, '(?i)(?:careers|jobs)\\.smartrecruiters\\.com/') THEN 'smartrecruiters'
  ELSE '-' END"""


def _board_slug(sep: str = "") -> str:
    return (f"CASE WHEN kind = '-' THEN '-' ELSE coalesce(nullif(regexp_extract(u, 'for=(customer-[0-9]+)', 1), ''), "
            f"regexp_extract(u, 'customer-[0-9]+{sep}')) END")


_NAME = "lower(replace(c_name, '#', '-'))"


def _urls(forms) -> str:
    return f"replace({S.cycle(forms, 'c_nationkey')}, '{{}}', {_NAME})"


_SLUG_NAME = "lower(p_name || ' Cafe ' || p_brand || ' ')"

SQL = {
    "html_to_text": f"SELECT page_id, {S.html_text('html')} AS text FROM pages",
    "normalize_text": f"SELECT doc_id, {S.norm('text')} AS normal FROM documents",
    "fold_gender": f"WITH {S.HEADINGS} SELECT doc_id, pos, {S.fold_gender(chr(40) + 'title || ' + lit(' מנהל/ת פיננסית') + chr(41))} AS folded "
                   "FROM headings",
    "normalize_title": f"WITH {S.HEADINGS} SELECT doc_id, pos, {S.norm_title('title')} AS normal_title FROM headings",
    "fold_place_spelling": f"WITH {S.CUSTOMER_PLACES} SELECT c_custkey, {lit('קריית ')} || location || {lit(', בקרית גת')} AS folded FROM cp",
    "canonical_url": f"""WITH u AS (SELECT page_id, unnest([url, url || '&z=%D7%90%20b&a=1+2&blank=',
      'https://il.linkedin.com/jobs/view/x-' || CAST(page_id + 10000000 AS VARCHAR) || '?trk=1']) AS url FROM pages)
      SELECT page_id, url, {S.canonical('url')} AS canonical FROM u""",
    "split_locations": f"""WITH {S.CUSTOMER_PLACES}, s AS (SELECT c_custkey, {S.split_places("(location || ' | A / B or C; או')")} AS parts
      FROM cp) SELECT c_custkey, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS part FROM s""",
    "company_key": f"WITH {S.NAMES} SELECT p_partkey, {S.company_key('company')} AS company_key FROM names",
    "location_key": f"""WITH {S.CUSTOMER_PLACES} SELECT c_custkey, {S.location_key(
        "(location || CASE WHEN c_mktsegment = 'MACHINERY' THEN ' Tel Aviv District' ELSE '' END)")} AS location_key FROM cp""",
    "job_keys": f"""{P} SELECT ord, {S.canonical('url')} AS key, concat_ws('|', {S.company_key('company')},
      {S.norm('title')}, {S.location_key('location')}) AS alt_key,
      concat_ws('|', {S.company_key('company')}, {S.norm('title')}) AS company_title FROM postings""",
    "slug_candidates": f"""WITH w AS (SELECT p_partkey, list_filter(string_split_regex(
        regexp_replace({_SLUG_NAME}, '[^a-z0-9 \\-]', ' ', 'g'), '[ \\-]+'),
        lambda w: w <> '' AND NOT list_contains({S.arr(SLUG_STOP_WORDS)}, w)) AS ws FROM part),
      c AS (SELECT p_partkey, [array_to_string(ws, ''), array_to_string(ws, '-'), ws[1]] AS cs FROM w),
      f AS (SELECT p_partkey, list_filter(cs, lambda x, i: list_position(cs, x) = i AND length(x) BETWEEN 3 AND 40) AS cs
        FROM c)
      SELECT p_partkey, generate_subscripts(cs, 1) - 1 AS rank, unnest(cs) AS slug FROM f""",
    "extract_experience": f"""{P}, x AS (SELECT ord, CASE WHEN ord % 10 = 0 THEN ' 5+ yrs ' ELSE '' END AS hint,
      description || CASE WHEN ord % 3 = 0 THEN {lit(' עם 2 עונות בגינה.')} ELSE '' END AS body FROM postings)
      SELECT ord, {S.experience('body', 'hint')} AS experience FROM x""",
    "strip_sentences": f"{P} SELECT ord, {S.strip_sentences('description')} AS text FROM postings",
    "company_display_name": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS hint,
      lower(replace(c_name, '#', '-')) AS slug, c_name FROM customer)
      SELECT c_custkey, coalesce(hint, CASE WHEN c_custkey % 3 = 1 THEN c_name END,
        'Customer ' || substr(slug, 10)) AS company FROM c""",
    "parse_posting_date": f"""WITH {S.DATED_ORDERS} SELECT o_orderkey, {iso(S.parse_date('posted_raw'))} AS posted,
      {iso(S.parse_date('updated_raw'))} AS updated FROM dated""",
    "title_class": f"WITH {S.HEADINGS}, {S.title_ctes('headings', key='doc_id, pos')} "
                   "SELECT doc_id, pos, coalesce(class, '-') AS class FROM title_class",
    "is_potential": f"""WITH {S.HEADINGS}, {S.title_ctes('headings', key='doc_id, pos')}
      SELECT doc_id, pos, coalesce(class <> 'excluded', FALSE) AS potential FROM title_class""",
    "description_available": f"{P} SELECT ord, length(description) >= {R.min_description} AS available FROM postings",
    "find_keywords": f"""{P}, t AS (SELECT ord, {S.keyword_text('description')} AS k FROM postings)
      SELECT ord, array_to_string({S.keywords('k')}, ', ') AS keywords FROM t""",
    "signal_score": f"""{P}, t AS (SELECT ord, lower(description) AS low FROM postings)
      SELECT ord, {S.score('low', R.analytics)} AS analytics, {S.score('low', R.engineering)} AS engineering FROM t""",
    "classify_location": f"{P}, {S.place_ctes('postings', 'ord % 4 = 0')} SELECT ord, decision, display, note FROM place",
    "title_says_abroad": f"""WITH {S.HEADINGS}, t AS (SELECT doc_id, pos, title || CASE WHEN pos % 5 = 0 THEN ' (Tel Aviv)' ELSE '' END
      || CASE WHEN pos % 7 = 0 THEN ' Relocation' ELSE '' END AS title FROM headings)
      SELECT doc_id, pos, {S.title_abroad('title')} AS abroad FROM t""",
    "company_sector": f"""WITH c AS (SELECT c_custkey, {S.cycle(D.COMPANIES, 'c_custkey')} AS name,
      CASE WHEN c_nationkey % 4 = 0 THEN 'https://jobs.lever.co/x' ELSE 'https://x.example.com/' END AS listing_url,
      CASE WHEN c_nationkey % 3 = 0 THEN 'A SaaS startup, our platform is growing' ELSE 'We sell goods' END AS description,
      CASE WHEN c_nationkey % 2 = 0 THEN lower(c_mktsegment) ELSE '' END AS industry FROM customer),
      sec AS (SELECT *, lower(name) AS low, {S.norm('name')} AS plain FROM c),
      s AS (SELECT c_custkey, {SECTOR} AS x FROM sec)
      SELECT c_custkey, split_part(x, '|', 1) AS type, split_part(x, '|', 2) AS strength FROM s""",
    "board_url": "WITH s AS (SELECT s_suppkey, lower(s_name) AS slug, "
                 f"{S.cycle(KINDS + ('workday',), 's_suppkey')} AS kind FROM supplier) SELECT s_suppkey, CASE kind "
                 + " ".join(f"WHEN {lit(k)} THEN {lit(h)} || slug || {lit(t)}" for k, (h, t) in BOARD_URLS.items())
                 + " ELSE slug END AS board_url FROM s",
    "site_name": f"""WITH p AS (SELECT page_id, url, 'https://' || {S.cycle(('www', 'careers', 'il', 'a.b'), 'page_id')}
      || '.' || {S.cycle(tuple(SITE_NAMES) + ('example.com:8080',), 'page_id')} || '/x' AS known FROM pages)
      SELECT page_id, {_known_site('url')} AS site, {_known_site('known')} AS known_site FROM p""",
    "board_from_url": f"""WITH c AS (SELECT c_custkey, {_urls(_board_urls())} AS u FROM customer),
      k AS (SELECT c_custkey, u, {_BOARD} AS kind FROM c)
      SELECT c_custkey, kind, {_board_slug('(?:%20x)?')} AS slug FROM k""",
    "workday_base": f"""SELECT c_custkey, CASE c_nationkey % 4
      WHEN 0 THEN 'https://' || {_NAME} || '.wd3.myworkdayjobs.com/Careers'
      WHEN 1 THEN 'https://' || {_NAME} || '.wd5.myworkdayjobs.com/External' ELSE '-' END AS base
      FROM customer""",
    "jobvite_rewrite": f"""SELECT c_custkey, CASE c_nationkey % 3 WHEN 2 THEN 'https://x.example.com/' || {_NAME}
      ELSE 'https://jobs.jobvite.com/' || {_NAME} || '/jobs' END AS url
      FROM customer""",
    "home_context": """SELECT page_id, page_id % 3 = 0 AS by_host, page_id % 5 = 0 OR page_id % 3 = 0 AS home_context
      FROM pages""",
    "search_result_links": f"""WITH c AS (SELECT c_custkey, url_decode({_urls(
        _board_urls() + ('https://www.comeet.com/jobs/{}/12.34A?x=1',))}) AS u FROM customer),
      k AS (SELECT c_custkey, u, CASE WHEN contains(u, 'comeet.com') THEN 'comeet' ELSE {_BOARD} END AS kind FROM c)
      SELECT c_custkey, u AS target, kind, CASE WHEN kind = 'comeet' THEN split_part(u, '?', 1)
        ELSE {_board_slug()} END AS slug FROM k""",
    "local_today": """SELECT event_id, strftime(timezone('Asia/Jerusalem', timezone('UTC', ts)), '%Y-%m-%d') AS local_day
      FROM events""",
}

_DATED = f"""WITH {S.DATED_ORDERS}, pu AS (SELECT o_orderkey, {S.parse_date('posted_raw')} AS p,
    {S.parse_date('updated_raw')} AS u FROM dated),
  dd AS (SELECT o_orderkey, {S.relevant('p', 'u')} AS d FROM pu)"""
SQL["relevant_date"] = f"{_DATED} SELECT o_orderkey, {iso('d')} AS relevant FROM dd"
SQL["freshness"] = f"""{_DATED} SELECT o_orderkey, CASE WHEN d IS NULL THEN 'unknown'
  WHEN date_diff('day', d, DATE '{D.AS_OF}') <= {R.fresh_days} THEN 'fresh' ELSE 'old' END AS fresh FROM dd"""
SQL["date_display"] = f"{_DATED} SELECT o_orderkey, coalesce(strftime(d, '%d/%m/%Y'), {lit(L.UNKNOWN_DATE)}) AS shown FROM dd"

_OK, _REASON = S.essence("class", "a", "e")
SQL["role_essence"] = f"""{P}, {S.title_ctes('postings')},
  s AS (SELECT ord, class, {S.score('low', R.analytics)} AS a, {S.score('low', R.engineering)} AS e
    FROM (SELECT ord, class, lower(description) AS low FROM postings JOIN title_class USING (ord)))
  SELECT ord, {_OK} AS ok, {_REASON} AS reason FROM s"""
SQL["evaluate"] = f"""WITH {evaluated_ctes()} SELECT ord, accepted, outcome, {iso('seen')} AS seen, key,
  coalesce(alt_key, '') AS alt_key, coalesce(why, '') AS why, coalesce(experience, '') AS experience,
  coalesce(date_display, '') AS date_display FROM evaluated"""

