"""Text, company, title, date, id and URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.patterns import ascii_borders, plain_spaces

# Words, hints, formats and suffixes.
COMPANY_WORDS = r"\b(inc|incorporated|llc|ltd|limited|gmbh|s\.a\.|sa|ag|plc|co|corp|corporation|company|holdings|group|technologies|technology|tech|labs|studios|systems)\b\.?"
TITLE_WORDS = (
    r"\b(senior|sr|junior|jr|lead|principal|staff|associate|founding|head\s+of|vp|vice\s+president|cto|ceo|cfo|coo|director|manager|intern|mid|"
    r"mid-level|new\s+grad|new-grad|entry\s+level|early\s+career)\b"
)
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&hellip;": "…", "&bull;": "•", "&eacute;": "é", "&amp;": "&"}
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "dd/MM/yyyy", "MMMM d, yyyy", "yyyy-MM-dd"]
JOB_HINTS = ["/job/", "/jobs/", "/career/", "/careers/", "/posting/", "/postings/", "/opportunity/", "/opportunities/", "/role/", "/roles/", "/req/", "/requisition/", "/vacancy/", "/vacancies/", "/position/", "/positions/"]
SLUG_SUFFIXES = ["inc", "llc", "ltd", "corp", "co", "company", "labs", "technologies", "tech"]
ROLE_WORDS = "engineer developer scientist architect designer manager lead head director intern founding researcher analyst ops sre devops product frontend backend infrastructure platform data ml marketing sales support writer recruiter".split()
RELATED = [
    (r"(new\s*grad|graduate|entry[\s-]?level)", ["junior", "intern", "associate"]), (r"^junior$", ["new grad", "associate", "entry level"]),
    (r"(intern|internship|co-?op)", ["new grad", "junior", "early career"]), (r"^software$", ["software engineer", "developer", "engineer"]),
    (r"^(developer|dev|engineer)$", ["software engineer", "backend", "frontend"]), (r"(back[\s-]?end)", ["software engineer", "platform", "infrastructure"]),
    (r"(front[\s-]?end)", ["software engineer", "ui engineer", "web developer"]), (r"(full[\s-]?stack)", ["software engineer", "backend", "frontend"]),
    (r"(machine\s*learning|^ml$|^ai$)", ["data scientist", "research", "software engineer"]), (r"(data\s*scien|data\s*eng)", ["analytics", "machine learning", "engineer"]),
    (r"(devops|sre)", ["platform", "infrastructure", "cloud"]), (r"(security|infosec)", ["engineer", "platform"]), (r"(mobile|ios|android)", ["software engineer", "frontend"]),
    (r"(product\s*manager|^pm$)", ["product", "program manager"]), (r"(designer|design)", ["product designer", "ux", "ui"]),
]


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    out = F.regexp_replace(_empty(c), "<[^>]+>", " ")
    for name, sign in ENTITIES.items():
        if name != "&amp;":
            out = F.replace(out, F.lit(name), F.lit(sign))
    # Numeric entities last but for the ampersand, so that nothing is decoded twice.
    parts = F.split(out, r"(?=&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});)")
    code = lambda p: F.coalesce(F.conv(F.nullif(F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]+);", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(p, r"^&#([0-9]+);", 1), F.lit(""))).try_cast("long")
    # Characters beyond those of one byte come from their UTF-16 halves.
    unit = lambda n: F.lpad(F.hex(n), 4, "0")
    wide = lambda n: F.decode(F.unhex(F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000) % 1024)))), "UTF-16BE")
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    decoded = F.array_join(F.transform(parts, lambda p: F.when(F.coalesce(valid(code(p)), F.lit(False)), F.concat(wide(code(p)), F.regexp_replace(p, "^&#[^;]*;", ""))).otherwise(p)), "")
    out = F.when(out.contains("&#"), decoded).otherwise(out)
    return _collapsed(F.replace(out, F.lit("&amp;"), F.lit("&")))


def pretty_company(slug: Column) -> Column:
    s = F.translate(slug, "-_", "  ")
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.greatest(F.length(s), F.lit(1))))


def normalize_company(c: Column) -> Column:
    out = F.regexp_replace(F.lower(plain_spaces(_empty(c))), "[,.()]", " ")
    out = F.regexp_replace(out, ascii_borders(COMPANY_WORDS), " ")
    return _collapsed(F.regexp_replace(out, "[^a-z0-9 ]", " "))


def normalize_title(c: Column) -> Column:
    out = F.lower(plain_spaces(_empty(c)))
    for pattern in (r"\([^)]*\)", r"\[[^\]]*\]", r"[,./|\\:_-]", TITLE_WORDS, r"\s(?:[ivx]+|[1-9])\b", "[^a-z0-9 ]"):
        out = F.regexp_replace(out, ascii_borders(pattern), " ")
    return _collapsed(out)


def point_id(external_id: Column) -> Column:
    """The first 16 bytes of the SHA-256 as a UUID."""
    h = F.sha2(external_id, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def stable_key(*cs: Column) -> Column:
    return F.substring(F.sha2(first_non_empty(*cs), 256), 1, 16)


def embed_text(title: Column, company: Column, location: Column, description: Column, most: int = 3500) -> Column:
    return F.substring(F.concat_ws("\n", title, company, F.nullif(location, F.lit("")), F.nullif(description, F.lit(""))), 1, most)


def parse_posted_date(c: Column) -> Column:
    plain = F.regexp_replace(F.trim(c), r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s*", "")  # Spark formats have no day of the week
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS])


def parse_relative_date(c: Column, fetched_at: Column) -> Column:
    low = F.lower(c)
    days = F.when(low.contains("today"), 0).when(low.contains("yesterday"), 1).otherwise(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"))
    return F.when(days.isNotNull(), fetched_at - F.make_dt_interval(days))


def from_millis(c: Column) -> Column:
    """Epoch milliseconds; 0 is unknown."""
    return F.timestamp_millis(F.nullif(c.cast("bigint"), F.lit(0)))


def split_company_role(c: Column) -> Column:
    """struct(company, role): cut at the first colon, if something stands before it."""
    at = F.instr(c, ":")
    return F.struct(F.when(at > 1, F.trim(c.substr(F.lit(1), at - 1))).alias("company"), F.when(at > 1, F.trim(c.substr(at + 1, F.length(c)))).otherwise(c).alias("role"))


def location_hint(c: Column) -> Column:
    found = F.regexp_extract(F.substring(_empty(c), 1, 400), r"(?im)^\s*(?:location|city|based in|where)\s*:\s*(.+)$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def parse_pipe_header(c: Column) -> Column:
    """struct(company, role, location, remote) from a header of segments; null under 30 characters."""
    text = F.trim(c)
    cut = F.instr(text, "\n\n")
    header = F.when(cut > 1, text.substr(F.lit(1), cut - 1)).otherwise(F.substring(text, 1, 240))
    parts = F.filter(F.transform(F.split(header, r"\s*\|\s*|\s+[-–]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    rest = F.slice(parts, 2, 100)
    is_role = lambda p: F.lower(p).rlike("|".join(ROLE_WORDS))
    is_remote = lambda p: F.lower(p).rlike("remote|hybrid|onsite|on-site|in office") & ~F.lower(p).contains("no remote")
    remote = F.lower(F.try_element_at(F.filter(rest, is_remote), F.lit(1)))
    place = F.try_element_at(F.filter(rest, lambda p: ~is_role(p) & ~is_remote(p) & ~p.rlike("://")), F.lit(1))
    return F.when(
        F.length(text) >= 30,
        F.struct(
            F.try_element_at(parts, F.lit(1)).alias("company"), F.try_element_at(F.filter(rest, is_role), F.lit(1)).alias("role"), place.alias("location"),
            F.when(remote.contains("remote"), "remote").when(remote.contains("hybrid"), "hybrid").when(remote.isNotNull(), "onsite").otherwise("unknown").alias("remote"),
        ),
    )


def variant_text(value: Column, path: str = "$") -> Column:
    """The text of what stands at ``path`` of a VARIANT, numbers as text; null for objects, lists and what is not there."""
    told = F.try_variant_get(value, path, "string")
    return F.when(~F.schema_of_variant(F.try_variant_get(value, path, "variant")).rlike("^(OBJECT|ARRAY|VOID)"), told)


def variant_items(value: Column) -> Column:
    """The documents of a VARIANT: the members of a list or of ``@graph``, else the value itself."""
    listed = lambda path: F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(listed("$"), listed("$['@graph']"), F.array(value))


def is_typed(value: Column, kind: str) -> Column:
    """Whether ``@type`` is ``kind`` or a list that holds it."""
    path = "$['@type']"
    return F.coalesce(F.try_variant_get(value, path, "string") == kind, F.lit(False)) | F.coalesce(F.array_contains(F.try_variant_get(value, path, "array<string>"), kind), F.lit(False))


def _first(doc: Column, path: str) -> Column:
    """What stands at ``path``, of a list the first member."""
    return F.coalesce(F.try_variant_get(doc, path + "[0]", "variant"), F.try_variant_get(doc, path, "variant"))


def json_org_name(doc: Column, path: str = "$.hiringOrganization") -> Column:
    """An organisation of a VARIANT that is a text or an object with a name, or a list of such."""
    org = _first(doc, path)
    return F.coalesce(variant_text(org, "$.name"), variant_text(org))


def json_location(doc: Column, path: str = "$.jobLocation") -> Column:
    """``City, Region, Country`` of a place of a VARIANT that is an object or the first of a list; an address may be a text, a country an object."""
    place = _first(doc, path)
    part = lambda k: F.nullif(variant_text(place, f"$.address.{k}"), F.lit(""))
    land = F.coalesce(variant_text(place, "$.address.addressCountry.name"), part("addressCountry"))
    return F.coalesce(variant_text(place, "$.address"), F.concat_ws(", ", part("addressLocality"), part("addressRegion"), land))


def json_identifier(doc: Column, path: str = "$.identifier") -> Column:
    given = _first(doc, path)
    return F.coalesce(variant_text(given, "$.value"), variant_text(given))


def sanitize_id(c: Column) -> Column:
    return F.translate(F.trim(c), " /", "_-")


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cs])


def join_present(sep: str, *cs: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cs])


def slug_variants(name: Column) -> Column:
    """Ordered distinct slugs of a company name."""
    s = F.replace(F.replace(F.lower(F.trim(name)), F.lit("&"), F.lit("and")), F.lit("+"), F.lit("plus"))
    s = F.translate(s, "'.", "")
    flat = F.regexp_replace(s, "[^a-z0-9]+", "")
    hyphen = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = [flat, hyphen]
    for suffix in SLUG_SUFFIXES:
        fits = flat.endswith(suffix) & (F.length(flat) > len(suffix) + 2)
        out += [F.when(fits, F.regexp_replace(flat, f"{suffix}$", "")), F.when(fits, F.regexp_replace(hyphen, f"-{suffix}$", ""))]
    return F.array_distinct(F.filter(F.array(*out), lambda v: v.isNotNull() & (v != "")))


def extract_domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def site_label(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(domain, ".", 1)), "[^a-z0-9-]", "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def has_job_hint(url: Column) -> Column:
    return F.lower(url).rlike("|".join(JOB_HINTS))


def jsonld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def has_jobposting_jsonld(html: Column) -> Column:
    return F.exists(jsonld_blocks(_empty(html)), lambda b: b.rlike(r'"@type"\s*:\s*"JobPosting"'))


def normalize_query(q: Column) -> Column:
    return _collapsed(F.regexp_replace(F.lower(_empty(q)), r"[^\p{L}\p{N}\s+\-#.]", " "))


def query_cache_key(q: Column, expanded: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(q), r"[^\w\s+#./-]", " "), r"\s+"), lambda w: w != "")
    return F.concat(F.when(expanded, "x").otherwise("r"), F.lit(":"), F.array_join(F.array_sort(words), " "))


def suggest_related(q: Column) -> Column:
    low = F.lower(F.trim(q))
    out = F
    for pattern, words in RELATED:
        out = out.when(low.rlike(pattern), F.array(*[F.lit(w) for w in words]))
    return out.otherwise(F.array().cast("array<string>"))
