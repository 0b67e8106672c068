"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import built_once, extract, let, text_or_empty
from .text import strip

# Query parameters that only track where a visitor came from (matched by prefix).
TRACKING_PREFIXES = ("utm_", "ref", "refid", "trk", "tracking", "position", "pagenum", "gh_src", "source", "src",
                     "lever-", "fbclid", "gclid")

# Boards whose address is reduced to the posting's number:
# host suffix, pattern over path or query, canonical form.
NUMBERED_BOARDS = (("linkedin.com", r"([0-9]{8,})", r"currentJobId=([0-9]+)", "https://www.linkedin.com/jobs/view/"),)

# Display names by host suffix.
SITE_NAMES = {
    "linkedin.com": "LinkedIn", "indeed.com": "Indeed", "jobmaster.co.il": "JobMaster", "drushim.co.il": "Drushim",
    "alljobs.co.il": "AllJobs", "greenhouse.io": "Greenhouse", "lever.co": "Lever", "ashbyhq.com": "Ashby",
    "workable.com": "Workable", "smartrecruiters.com": "SmartRecruiters", "comeet.com": "Comeet",
    "comeet.co": "Comeet", "gotfriends.co.il": "GotFriends", "sqlink.com": "SQLink", "jobnet.co.il": "JobNet",
    "jobkarov.com": "JobKarov", "secrettelaviv.com": "Secret Tel Aviv", "bing.com": "Bing",
}

# Hosts that carry many companies, so the whole address is the identity.
SHARED_HOSTS = (r"comeet\.com|comeet\.co|greenhouse\.io|lever\.co|ashbyhq\.com|workable\.com|smartrecruiters\.com"
                r"|myworkdayjobs\.com|jobvite\.com|zohorecruit\.com|pinpointhq\.com")

# generic syntax of RFC 3986: scheme, authority, path, query (a regex, so odd characters do not fail the row)
_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def host(url: Column) -> Column:
    """Authority without the port."""
    return F.regexp_replace(authority(strip(text_or_empty(url))), r":[^\]]*$", "")


def site_host(url: Column) -> Column:
    """Authority without a leading 'www.'."""
    return F.regexp_replace(authority(strip(text_or_empty(url))), r"^www\.", "")


def decode_part(text: Column) -> Column:
    """Form decoding that leaves broken escapes alone."""
    return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))


def encode_part(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(text: Column) -> Column:
    """Parameters without blanks and tracking, decoded, sorted and encoded again."""
    pairs = F.filter(F.split(text, "&"), lambda p: p.rlike("=.") & ~p.startswith("="))
    decoded = F.transform(pairs, lambda p: F.struct(
        decode_part(F.substring_index(p, "=", 1)).alias("k"),
        decode_part(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    prefixes = "(?i)^(?:" + "|".join(TRACKING_PREFIXES) + ")"
    kept = F.array_sort(F.filter(decoded, lambda p: ~p["k"].rlike(prefixes)))
    return F.array_join(F.transform(kept, lambda p: F.concat(encode_part(p["k"]), F.lit("="), encode_part(p["v"]))), "&")


@built_once
def canonical_url(url: Column) -> Column:
    """One spelling per address: https, no www, no trailing slash, no fragment, no tracking parameters."""
    trimmed = strip(url)
    where = authority(trimmed)
    no_params = F.regexp_replace(path(trimmed), r";[^/]*$", "")
    short = F.regexp_replace(no_params, "/+$", "")
    parameters = F.when(query(trimmed) == "", "").otherwise(clean_query(query(trimmed)))
    generic = F.concat(
        F.lit("https://"), F.regexp_replace(where, r"^www\.", ""),
        F.when(short == "", "/").when(short.startswith("/"), short).otherwise(F.concat(F.lit("/"), short)),
        F.when(parameters == "", "").otherwise(F.concat(F.lit("?"), parameters)))
    result = F.when(where.contains("[") != where.contains("]"), url)
    for suffix, in_path, in_query, base in NUMBERED_BOARDS:
        number = F.coalesce(extract(no_params, in_path), extract(query(trimmed), in_query))
        result = result.when(where.endswith(suffix) & number.isNotNull(), F.concat(F.lit(base), number))
    return result.otherwise(generic)


@built_once
def site_name(url: Column) -> Column:
    """Display name of a site: a known suffix, else the host without its usual first label."""
    name = host(url)
    shown = None
    for suffix, label in SITE_NAMES.items():
        known = (name == suffix) | name.endswith("." + suffix)
        shown = F.when(known, label) if shown is None else shown.when(known, label)
    return shown.otherwise(F.regexp_replace(name, r"^(?:www|careers|jobs|career)\.", ""))


def link_identity(url: Column) -> Column:
    """What makes two links the same source: the site, or the whole address on shared hosts."""
    name = site_host(url)
    return F.when(name.rlike(SHARED_HOSTS), canonical_url(url)).otherwise(name)


@built_once
def resolve_url(base: Column, href: Column) -> Column:
    """``href`` of an anchor as an absolute address, fragment dropped."""
    link = F.regexp_replace(strip(href), "(?s)#.*$", "")
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, _SPLIT, 2))
    link_path, link_query = path(link), query(link)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    merged = F.when(link_path.startswith("/"), link_path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), link_path))
    walked = F.aggregate(
        F.split(merged, "/"), F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))))
    # a dot segment at the end leaves a folder
    tail = F.when(merged.rlike(r"/\.{1,2}$"), "/").otherwise("")
    relative = F.concat(
        origin, F.array_join(walked, "/"), tail,
        F.when(link_query == "", "").otherwise(F.concat(F.lit("?"), link_query)))
    same_page = F.concat(origin, path(base), F.when(
        link_query != "", F.concat(F.lit("?"), link_query)).when(
        query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(""))
    return (F.when(scheme(link) != "", link)
            .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
            .when(link_path == "", same_page)
            .otherwise(relative))


def search_result_target(href: Column) -> Column:
    """The address behind a search-result redirect (``u=a1`` + base64url), percent-decoded."""
    wrapped = extract(query(href), r"(?:^|&)u=([^&]*)")
    code = F.when(decode_part(wrapped).startswith("a1"),
                  F.regexp_replace(F.translate(F.regexp_replace(decode_part(wrapped), "^a1", ""), "-_", "+/"), "=+$", ""))
    valid = code.rlike("^[A-Za-z0-9+/]*$") & (F.length(code) % 4 != 1)
    target = F.when(code.isNull(), href).when(valid, F.unbase64(F.when(valid, code)).cast("string")).otherwise("")
    return let(target, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t))
