"""Normalisers: raw feed responses (source, tenant, fetched_at, body) to postings.

Each feed states the schema of its response, the list that holds its records, and what is particular about its fields; ids,
classification, pay and dates follow one way. Bodies or records that do not parse give no posting; ``quarantined`` lists the bodies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import location as loc
from hirelake.functions import pay, rules, text

POSTING_COLUMNS = [
    "external_id", "title", "company", "location", "country", "salary_min", "salary_max", "salary_currency", "salary_period", "salary_range", "remote_status",
    "experience_level", "industry", "job_family", "source", "source_url", "scraped_at", "posted_at", "description", "is_active",
]


def c(path: str) -> Column:
    return F.col(path)


def s(path: str) -> Column:
    return F.coalesce(F.col(path).cast("string"), F.lit(""))


@dataclass
class Feed:
    """How a feed's record ``j`` becomes a posting. ``salary``: texts to parse, in order; ``pay``: (min, max, currency, period) stated by the feed;
    ``open_pay``: one of its ends is enough, and it is shown in the style of stated pay."""

    schema: str
    records: str | None
    id: Callable[[], Column]
    title: Callable[[], Column]
    company: Callable[[], Column]
    location: Callable[[], Column]
    description: Callable[[], Column]
    posted: Callable[[], Column]
    url: Callable[[], Column]
    keep: Callable[[], Column] | None = None
    remote: Callable[[], Column] | None = None
    country: Callable[[], Column] | None = None
    level: Callable[[], Column] | None = None
    industry: Callable[[], Column] | None = None
    pay: Callable[[], tuple] | None = None
    open_pay: bool = False
    salary: Callable[[], list[Column]] | None = field(default=None)
    xml: bool = False
    cap: int | None = None


def _date(path: str) -> Callable[[], Column]:
    return lambda: text.parse_posted_date(F.col(path).cast("string"))


def _tenant() -> Column:
    return text.pretty_company(F.col("tenant"))


def _place(*parts: str) -> Column:
    return text.join_present(", ", *[F.col(p) for p in parts])


def _flag(flag: Column, otherwise: Column) -> Column:
    return F.when(flag, "remote").otherwise(otherwise)


def _free_text() -> Column:
    return loc.classify_remote(F.col("location"), F.col("description"))


def _keyword(path: str, vocabulary: dict | None = None) -> Callable[[], Column]:
    """The structured keyword if it tells, else free text."""
    return lambda: F.coalesce(F.nullif(loc.remote_from_keyword(F.col(path), vocabulary), F.lit("unknown")), _free_text())


# Field vocabularies of the feeds.
MUSE_LEVELS = [("intern", "intern"), ("entry", "junior"), ("mid", "mid"), ("senior", "senior"), ("manager", "manager"), ("management", "manager"), ("executive", "executive")]  # held in the label
PERSONIO_LEVELS = {
    "entry-level": "junior", "entry level": "junior", "junior": "junior", "experienced": "mid", "mid": "mid", "professional": "mid", "senior": "senior", "lead": "principal", "principal": "principal",
    "manager": "manager", "director": "director", "executive": "executive", "c-level": "executive", "intern": "intern", "internship": "intern", "student": "intern",
}
BAMBOO_PLACES = {"0": "onsite", "1": "remote", "2": "hybrid"}
PAY_CODES = {"PA": "annual", "PH": "hourly", "PD": "daily", "BW": "biweekly"}
PINPOINT_PERIODS = {"year": "annual", "month": "monthly", "week": "weekly", "day": "daily", "hour": "hourly"}
ADZUNA_CURRENCY = {"us": "USD", "gb": "GBP", "ca": "CAD", "au": "AUD", "in": "INR", "de": "EUR", "fr": "EUR", "nl": "EUR"}

FEEDS: dict[str, Feed] = {
    "greenhouse": Feed(
        "jobs array<struct<id bigint, title string, absolute_url string, content string, location struct<name string>, updated_at string, offices array<struct<name string, location string>>>>", "jobs",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=_tenant, location=lambda: F.coalesce(text.first_non_empty(c("j.location.name"), F.try_element_at("j.offices", F.lit(1))["name"]), F.lit("")),
        description=lambda: text.strip_html(text.strip_html(s("j.content"))), posted=_date("j.updated_at"), url=lambda: c("j.absolute_url"),
    ),
    "lever": Feed(
        "array<struct<id string, text string, hostedUrl string, categories struct<location string, team string, commitment string>, workplaceType string, descriptionPlain string, description string, additionalPlain string, createdAt bigint>>", None,
        id=lambda: s("j.id"), title=lambda: s("j.text"), company=_tenant, location=lambda: s("j.categories.location"), description=lambda: F.coalesce(text.first_non_empty(c("j.descriptionPlain"), text.strip_html(c("j.description"))), F.lit("")),
        posted=lambda: text.from_millis(c("j.createdAt")), url=lambda: c("j.hostedUrl"), remote=_keyword("j.workplaceType"), salary=lambda: [s("j.additionalPlain"), c("description")],
    ),
    "ashby": Feed(
        "jobs array<struct<id string, title string, locationName string, isRemote boolean, isListed boolean, jobUrl string, applyUrl string, descriptionPlain string, descriptionHtml string, publishedAt string>>", "jobs",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=_tenant, location=lambda: s("j.locationName"), description=lambda: F.coalesce(text.first_non_empty(c("j.descriptionPlain"), text.strip_html(c("j.descriptionHtml"))), F.lit("")),
        posted=_date("j.publishedAt"), url=lambda: text.first_non_empty(c("j.jobUrl"), c("j.applyUrl")), keep=lambda: c("j.isListed"), remote=lambda: _flag(c("j.isRemote"), _free_text()),
    ),
    "smartrecruiters": Feed(
        "content array<struct<id string, name string, applyUrl string, ref string, releasedDate string, location struct<city string, region string, country string, remote boolean>, department struct<label string>, function struct<label string>, company struct<name string>>>", "content",
        id=lambda: s("j.id"), title=lambda: s("j.name"), company=lambda: F.coalesce(text.first_non_empty(c("j.company.name")), _tenant()),
        location=lambda: F.when(c("j.location.remote"), text.join_present(" · ", F.lit("Remote"), F.upper("j.location.country"))).otherwise(text.join_present(", ", c("j.location.city"), F.when(c("j.location.region") != c("j.location.city"), c("j.location.region")), F.upper("j.location.country"))),
        description=lambda: text.join_present(" · ", c("j.department.label"), c("j.function.label")), posted=_date("j.releasedDate"), url=lambda: text.first_non_empty(c("j.applyUrl"), c("j.ref")),
        remote=lambda: _flag(c("j.location.remote"), F.when(c("location") != "", "onsite").otherwise("unknown")), country=lambda: F.upper("j.location.country"),
    ),
    "recruitee": Feed(
        "offers array<struct<id bigint, title string, department string, city string, country string, country_code string, location string, remote boolean, url string, careers_url string, description string, requirements string, created_at string, published_at string, status string>>", "offers",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=_tenant, location=lambda: F.coalesce(text.first_non_empty(c("j.location"), _place("j.city", "j.country")), F.lit("")),
        description=lambda: text.strip_html(text.join_present(" ", c("j.description"), c("j.requirements"))), posted=lambda: F.coalesce(text.parse_posted_date(c("j.published_at")), text.parse_posted_date(c("j.created_at"))),
        url=lambda: text.first_non_empty(c("j.careers_url"), c("j.url")), keep=lambda: s("j.status").isin("", "published"), remote=lambda: _flag(c("j.remote"), _free_text()), country=lambda: F.upper(F.nullif(c("j.country_code"), F.lit(""))),
    ),
    "workable": Feed(
        "results array<struct<id string, shortcode string, title string, description string, url string, application_url string, shortlink string, telecommuting boolean, remote boolean, location struct<country string, city string, region string>, published_on string, created string>>", "results",
        id=lambda: text.first_non_empty(c("j.shortcode"), c("j.id")), title=lambda: s("j.title"), company=_tenant, location=lambda: text.join_present(", ", c("j.location.city"), F.when(c("j.location.region") != c("j.location.city"), c("j.location.region")), c("j.location.country")),
        description=lambda: text.strip_html(s("j.description")), posted=lambda: F.coalesce(text.parse_posted_date(c("j.published_on")), text.parse_posted_date(c("j.created"))), url=lambda: text.first_non_empty(c("j.url"), c("j.shortlink"), c("j.application_url")),
        remote=lambda: _flag(F.coalesce(c("j.remote"), F.lit(False)) | F.coalesce(c("j.telecommuting"), F.lit(False)), _free_text()), salary=lambda: [],
    ),
    "breezy": Feed(
        "array<struct<id string, friendly_id string, name string, url string, published_date string, type struct<name string>, department string, salary string, company struct<name string>, location struct<name string, city string, is_remote boolean, country struct<id string>>, locations array<struct<name string, city string, is_remote boolean>>>>", None,
        id=lambda: text.first_non_empty(c("j.id"), c("j.friendly_id")), title=lambda: s("j.name"), company=lambda: F.coalesce(text.first_non_empty(c("j.company.name")), _tenant()),
        location=lambda: F.coalesce(text.first_non_empty(F.try_element_at(F.filter("j.locations", lambda l: F.coalesce(l["name"], F.lit("")) != ""), F.lit(1))["name"], c("j.location.name")), F.lit("")),
        description=lambda: text.join_present(" · ", c("j.department"), c("j.type.name"), c("location"), c("j.salary")), posted=_date("j.published_date"), url=lambda: c("j.url"), remote=lambda: _flag(c("j.location.is_remote"), _free_text()),
        country=lambda: F.upper(F.nullif(c("j.location.country.id"), F.lit(""))), salary=lambda: [s("j.salary"), c("description")],
    ),
    "pinpoint": Feed(
        "data array<struct<id string, title string, description string, key_responsibilities string, skills_knowledge_expertise string, benefits string, url string, workplace_type string, compensation_minimum double, compensation_maximum double, compensation_currency string, compensation_frequency string, location struct<city string, province string, name string>, job struct<published_at string>>>", "data",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=_tenant, location=lambda: F.coalesce(text.first_non_empty(_place("j.location.city", "j.location.province"), c("j.location.name")), F.lit("")),
        description=lambda: text.strip_html(text.join_present(" ", c("j.description"), c("j.key_responsibilities"), c("j.skills_knowledge_expertise"), c("j.benefits"))), posted=_date("j.job.published_at"), url=lambda: c("j.url"), remote=_keyword("j.workplace_type"),
        pay=lambda: (c("j.compensation_minimum"), c("j.compensation_maximum"), c("j.compensation_currency"), F.coalesce(pay.lookup(PINPOINT_PERIODS, F.lower("j.compensation_frequency")), F.lit("annual"))),
    ),
    "personio": Feed(
        "position array<struct<id string, subcompany string, office string, department string, name string, seniority string, createdAt string, jobDescriptions struct<jobDescription array<struct<name string, value string>>>>>", "position",
        id=lambda: s("j.id"), title=lambda: s("j.name"), company=lambda: F.coalesce(text.first_non_empty(c("j.subcompany")), _tenant()), location=lambda: s("j.office"),
        description=lambda: F.array_join(F.transform("j.jobDescriptions.jobDescription", lambda d: F.concat(text.strip_html(d["name"]), F.lit(": "), text.strip_html(d["value"]))), "\n\n"), posted=_date("j.createdAt"), url=lambda: F.concat(F.lit("https://"), F.col("tenant"), F.lit(".jobs.personio.de/job/"), s("j.id")),
        level=lambda: F.coalesce(pay.lookup(PERSONIO_LEVELS, F.lower(F.trim("j.seniority"))), rules.classify_title_or_body(c("title"), c("description"), c("industry"))), xml=True,
    ),
    "themuse": Feed(
        "results array<struct<id bigint, name string, contents string, publication_date string, levels array<struct<name string>>, locations array<struct<name string>>, refs struct<landing_page string>, company struct<name string>>>", "results",
        id=lambda: s("j.id"), title=lambda: s("j.name"), company=lambda: s("j.company.name"), location=lambda: F.coalesce(F.try_element_at("j.locations", F.lit(1))["name"], F.lit("")), description=lambda: text.strip_html(s("j.contents")), posted=_date("j.publication_date"),
        url=lambda: F.coalesce(c("j.refs.landing_page"), F.concat(F.lit("https://www.themuse.com/jobs/"), s("j.id"))), remote=lambda: _flag(F.lower("location").contains("flexible"), _free_text()),
        level=lambda: F.coalesce(*[F.when(F.lower(F.try_element_at("j.levels", F.lit(1))["name"]).contains(word), level) for word, level in MUSE_LEVELS], rules.classify_title_or_body(c("title"), c("description"), c("industry"))),
    ),
    "adzuna": Feed(
        "results array<struct<id string, title string, description string, created string, redirect_url string, salary_min double, salary_max double, salary_is_predicted string, company struct<display_name string>, location struct<display_name string>>>", "results",
        id=lambda: s("j.id"), title=lambda: text.strip_html(s("j.title")), company=lambda: s("j.company.display_name"), location=lambda: s("j.location.display_name"), description=lambda: text.strip_html(s("j.description")), posted=_date("j.created"), url=lambda: c("j.redirect_url"),
        country=lambda: F.upper("tenant"), pay=lambda: (F.when(c("j.salary_is_predicted") == "0", c("j.salary_min")), F.when(c("j.salary_is_predicted") == "0", c("j.salary_max")), F.coalesce(pay.lookup(ADZUNA_CURRENCY, F.lower("tenant")), F.lit("USD")), F.lit("annual")),
    ),
    "jooble": Feed(
        "jobs array<struct<id bigint, title string, location string, snippet string, salary string, source string, link string, company string, updated string>>", "jobs",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=lambda: F.coalesce(text.first_non_empty(c("j.company"), c("j.source")), F.lit("")), location=lambda: s("j.location"), description=lambda: text.strip_html(s("j.snippet")), posted=_date("j.updated"), url=lambda: c("j.link"),
        salary=lambda: [s("j.salary"), c("description")],
    ),
    "reed": Feed(
        "results array<struct<jobId bigint, employerName string, jobTitle string, locationName string, minimumSalary double, maximumSalary double, currency string, date string, jobDescription string, jobUrl string>>", "results",
        id=lambda: s("j.jobId"), title=lambda: s("j.jobTitle"), company=lambda: s("j.employerName"), location=lambda: s("j.locationName"), description=lambda: text.strip_html(s("j.jobDescription")), posted=_date("j.date"), url=lambda: c("j.jobUrl"), country=lambda: F.lit("GB"),
        pay=lambda: (c("j.minimumSalary"), c("j.maximumSalary"), F.coalesce(text.first_non_empty(c("j.currency")), F.lit("GBP")), F.lit("annual")),
    ),
    "careerjet": Feed(
        "jobs array<struct<title string, locations string, description string, date string, company string, salary string, url string>>", "jobs",
        id=lambda: F.coalesce(F.nullif(F.regexp_extract(s("j.url"), "([0-9a-f]{16,})", 1), F.lit("")), F.concat_ws("-", "tenant", c("pos").cast("string"))), title=lambda: s("j.title"), company=lambda: s("j.company"), location=lambda: s("j.locations"),
        description=lambda: text.strip_html(s("j.description")), posted=_date("j.date"), url=lambda: c("j.url"), country=lambda: F.nullif(F.regexp_extract("tenant", "_([A-Z]{2})$", 1), F.lit("")), salary=lambda: [s("j.salary"), c("description")],
    ),
    "remoteok": Feed(
        "array<struct<id string, slug string, company string, position string, tags array<string>, description string, location string, salary_min double, salary_max double, url string, apply_url string, date string, epoch bigint, legal string>>", None,
        id=lambda: text.sanitize_id(text.first_non_empty(c("j.id"), c("j.slug"))), title=lambda: s("j.position"), company=lambda: s("j.company"), location=lambda: F.coalesce(text.first_non_empty(c("j.location")), F.lit("Remote")),
        description=lambda: text.join_present(" ", text.strip_html(s("j.description")), F.when(F.size("j.tags") > 0, F.concat(F.lit("Tags: "), F.array_join("j.tags", ", ")))), posted=lambda: F.coalesce(text.parse_posted_date(c("j.date")), F.timestamp_seconds(c("j.epoch"))), url=lambda: text.first_non_empty(c("j.url"), c("j.apply_url")),
        keep=lambda: s("j.legal") == "", remote=lambda: F.lit("remote"), pay=lambda: (c("j.salary_min"), c("j.salary_max"), F.lit("USD"), F.lit("annual")), open_pay=True,
    ),
    "weworkremotely": Feed(
        "channel struct<item array<struct<title string, link string, guid string, pubDate string, region string, description string>>>", "channel.item",
        id=lambda: text.stable_key(c("j.guid"), c("j.link")), title=lambda: text.split_company_role(c("j.title"))["role"], company=lambda: F.coalesce(text.split_company_role(c("j.title"))["company"], F.lit("")), location=lambda: s("j.region"), description=lambda: text.strip_html(s("j.description")),
        posted=_date("j.pubDate"), url=lambda: c("j.link"), remote=lambda: F.lit("remote"), xml=True,
    ),
    "usajobs": Feed(
        "SearchResult struct<SearchResultItems array<struct<MatchedObjectId string, MatchedObjectDescriptor struct<PositionID string, PositionTitle string, PositionURI string, PositionLocation array<struct<LocationName string, CountryCode string>>, OrganizationName string, DepartmentName string, QualificationSummary string, PositionRemuneration array<struct<MinimumRange string, MaximumRange string, RateIntervalCode string>>, PublicationStartDate string, UserArea struct<Details struct<JobSummary string>>>>>>", "SearchResult.SearchResultItems",
        id=lambda: text.sanitize_id(text.first_non_empty(c("j.MatchedObjectId"), c("j.MatchedObjectDescriptor.PositionID"))), title=lambda: s("j.MatchedObjectDescriptor.PositionTitle"), company=lambda: F.coalesce(text.first_non_empty(c("j.MatchedObjectDescriptor.OrganizationName"), c("j.MatchedObjectDescriptor.DepartmentName")), F.lit("US Government")),
        location=lambda: F.coalesce(F.try_element_at("j.MatchedObjectDescriptor.PositionLocation", F.lit(1))["LocationName"], F.lit("")), description=lambda: text.join_present(" ", c("j.MatchedObjectDescriptor.UserArea.Details.JobSummary"), c("j.MatchedObjectDescriptor.QualificationSummary")),
        posted=_date("j.MatchedObjectDescriptor.PublicationStartDate"), url=lambda: c("j.MatchedObjectDescriptor.PositionURI"), industry=lambda: F.lit("government"), country=lambda: F.lit("US"),
        pay=lambda: tuple(f(F.try_element_at("j.MatchedObjectDescriptor.PositionRemuneration", F.lit(1))) for f in (lambda r: r["MinimumRange"].try_cast("double"), lambda r: r["MaximumRange"].try_cast("double"), lambda r: F.lit("USD"), lambda r: F.coalesce(pay.lookup(PAY_CODES, r["RateIntervalCode"]), F.lit("annual")))),
    ),
    "amazon": Feed(
        "jobs array<struct<id string, title string, job_path string, company_name string, description string, basic_qualifications string, preferred_qualifications string, responsibilities string, location string, normalized_location string, country_code string, posted_date string>>", "jobs",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=lambda: F.coalesce(text.first_non_empty(c("j.company_name")), F.lit("Amazon")), location=lambda: F.coalesce(text.first_non_empty(c("j.normalized_location"), c("j.location")), F.lit("")),
        description=lambda: text.strip_html(text.join_present(" ", c("j.description"), F.concat(F.lit("Responsibilities: "), c("j.responsibilities")), F.concat(F.lit("Basic Qualifications: "), c("j.basic_qualifications")), F.concat(F.lit("Preferred Qualifications: "), c("j.preferred_qualifications")))),
        posted=_date("j.posted_date"), url=lambda: F.concat(F.lit("https://www.amazon.jobs"), s("j.job_path")), country=lambda: F.when(F.length("j.country_code") == 2, F.upper("j.country_code")),
    ),
    "rss": Feed(
        "channel struct<title string, item array<struct<title string, link string, description string, category string, location string, pubDate string, guid string>>>", "channel.item",
        id=lambda: F.concat_ws(":", "tenant", text.stable_key(c("j.guid"), c("j.link"), c("j.title"))), title=lambda: s("j.title"), company=_tenant, location=lambda: F.coalesce(text.first_non_empty(c("j.location"), text.location_hint(c("j.description"))), F.lit("")),
        description=lambda: text.strip_html(s("j.description")), posted=_date("j.pubDate"), url=lambda: c("j.link"), xml=True,
    ),
    "hackernews": Feed(
        "id bigint, children array<struct<id bigint, author string, text string, created_at string, parent_id bigint, story_id bigint>>", "children",
        id=lambda: F.concat_ws(":", s("j.story_id"), s("j.id")), title=lambda: F.coalesce(text.parse_pipe_header(_paragraphs())["role"], F.lit("")), company=lambda: F.coalesce(text.parse_pipe_header(_paragraphs())["company"], F.lit("")),
        location=lambda: F.coalesce(text.parse_pipe_header(_paragraphs())["location"], F.lit("")), description=lambda: text.strip_html(s("j.text")), posted=_date("j.created_at"),
        url=lambda: F.coalesce(F.nullif(F.regexp_extract(s("j.text"), r'(https?://[^\s"<>]+)', 1), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), s("j.id"))),
        keep=lambda: c("j.text").isNotNull() & (c("j.parent_id") == c("j.story_id")), remote=lambda: F.coalesce(F.nullif(text.parse_pipe_header(_paragraphs())["remote"], F.lit("unknown")), _free_text()),
    ),
    "workatastartup": Feed(
        "props struct<jobs array<struct<id bigint, title string, jobType string, location string, salary string, companyName string, companyOneLiner string, applyUrl string>>>", "props.jobs",
        id=lambda: s("j.id"), title=lambda: s("j.title"), company=lambda: s("j.companyName"), location=lambda: s("j.location"), description=lambda: text.join_present(" · ", c("j.companyOneLiner"), c("j.jobType"), c("j.salary")), posted=lambda: F.lit(None).cast("timestamp"),
        url=lambda: c("j.applyUrl"), salary=lambda: [s("j.salary"), c("description")],
    ),
}


def _paragraphs() -> Column:
    """Comment html with paragraph breaks kept as blank lines."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(s("j.text"), "(?i)<p>", "\n\n"), F.lit("&#x2F;"), F.lit("/")), "<[^>]+>", " "))


def _parsed(raw: DataFrame, feed: Feed) -> DataFrame:
    """``raw`` with j (one record) and pos."""
    top = feed.schema if feed.records is None else f"struct<{_struct(feed.schema)}>"
    doc = F.from_xml("body", F.lit(feed.schema)) if feed.xml else F.from_json("body", top)
    rows = raw.withColumn("doc", doc)
    page = c("page") if "page" in raw.columns else F.lit(0)
    return rows.select("tenant", "fetched_at", page.alias("_page"), F.posexplode(F.col("doc") if feed.records is None else F.col(f"doc.{feed.records}")).alias("pos", "j"))


def _struct(ddl: str) -> str:
    """Top-level ``name type`` pairs as the fields of a struct type."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def to_postings(rows: DataFrame, source: str, feed: Feed, also: Sequence[str] = ()) -> DataFrame:
    """Records ``j`` to postings by the feed's fields, with the columns ``also`` of ``rows``; a record without an id or title is dropped."""
    if feed.keep:
        rows = rows.filter(F.coalesce(feed.keep(), F.lit(False)))
    rows = rows.withColumn("title", F.trim(feed.title())).withColumn("company", F.trim(feed.company())).withColumn("location", F.trim(feed.location())).withColumn("description", feed.description())
    key = feed.id()
    external = F.concat_ws(":", F.lit(source), "tenant", key) if source not in SINGLE_TENANT else F.concat_ws(":", F.lit(source), key)
    rows = rows.withColumn("external_id", F.when(F.trim(key) != "", external)).filter("external_id is not null and title <> ''")
    rows = rows.withColumn("industry", feed.industry() if feed.industry else rules.classify_industry(c("title"), c("description"))).withColumn("job_family", rules.classify_job_family(c("title"), c("description")))
    rows = rows.withColumn("experience_level", feed.level() if feed.level else rules.classify_title_or_body(c("title"), c("description"), c("industry")))
    rows = rows.withColumn("remote_status", feed.remote() if feed.remote else _free_text())
    named = loc.classify_country(c("location"))
    rows = rows.withColumn("country", F.coalesce(F.nullif(feed.country(), F.lit("")), named) if feed.country else named)
    texts = feed.salary() if feed.salary else [c("description")]
    kind = "struct<min:double,max:double,currency:string,period:string>"
    money = pay.parse_salary(*texts) if texts else F.lit(None).cast(kind)
    if feed.pay:
        low, high, currency, period = feed.pay()
        if feed.open_pay:
            given = lambda x: F.when(x >= 1, F.floor(x).cast("double"))
            stated = F.when(F.coalesce(given(low), given(high)).isNotNull(), F.struct(given(low).alias("min"), given(high).alias("max"), currency.alias("currency"), period.alias("period")))
        else:
            stated = F.when(high > 0, F.struct(F.coalesce(low, high).alias("min"), high.alias("max"), currency.alias("currency"), period.alias("period")))
        rows = rows.withColumn("_stated", stated.cast(kind))
        money = F.coalesce("_stated", money)
    rows = rows.withColumn("_pay", money)
    rows = rows.withColumn("salary_min", c("_pay.min")).withColumn("salary_max", c("_pay.max")).withColumn("salary_currency", c("_pay.currency")).withColumn("salary_period", c("_pay.period"))
    shown = pay.format_salary(c("salary_min"), c("salary_max"), c("salary_currency"), c("salary_period"))
    if feed.open_pay:
        shown = F.when(c("_stated").isNotNull(), pay.format_salary_range(c("salary_min"), c("salary_max"), c("salary_currency"))).otherwise(shown)
    rows = rows.withColumn("salary_range", shown)
    rows = rows.withColumn("posted_at", feed.posted()).withColumn("source_url", feed.url()).withColumn("source", F.lit(source)).withColumn("scraped_at", c("fetched_at")).withColumn("is_active", F.lit(True))
    return rows.select(*POSTING_COLUMNS, *also)


#: Where a record stood in its fetch.
PLACE = ["_page", "pos"]
#: Sources whose ids need no tenant.
SINGLE_TENANT = {"hackernews", "workatastartup", "themuse", "adzuna", "jooble", "reed", "careerjet", "remoteok", "weworkremotely", "usajobs", "amazon", "rss"}


def normalize(raw: DataFrame, source: str) -> DataFrame:
    """Postings of one source from its raw responses. Of an id that repeats, the record of the latest fetch stays; in one fetch that of the first page
    (column ``page``, if the responses have it), then the first on its page. ``fetched_at`` is the time of the fetch, not of each page."""
    feed = FEEDS[source]
    if source == "workatastartup":
        page = F.regexp_extract("body", 'data-page="([^"]*)"', 1)
        raw = raw.withColumn("body", F.when(page != "", F.replace(F.replace(page, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))).otherwise(c("body")))
    out = to_postings(_parsed(raw.filter(F.col("source") == source), feed), source, feed, PLACE)
    newest = Window.partitionBy("external_id").orderBy(F.col("scraped_at").desc(), *PLACE, "source_url")
    return out.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", *PLACE)


def quarantined(raw: DataFrame, source: str) -> DataFrame:
    """Responses that do not parse."""
    feed = FEEDS[source]
    if feed.xml:
        return raw.filter((F.col("source") == source) & ~F.coalesce(F.col("body").rlike(r"^\s*<"), F.lit(False)))
    return raw.filter((F.col("source") == source) & F.expr("try_parse_json(body) is null"))


WORKDAY_LIST = "jobPostings array<struct<title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>>>"
WORKDAY_DETAIL = "jobPostingInfo struct<title string, jobDescription string, location string, postedOn string, startDate string, externalUrl string, jobReqId string, id string, remoteType string>"
#: Postings taken from one tenant.
WORKDAY_CAP = 400


def normalize_workday(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Listing rows joined with their detail (tenant, path, body) by external path; a listing without detail is dropped."""
    rows = listing.withColumn("doc", F.from_json("body", WORKDAY_LIST)).select("tenant", "fetched_at", F.posexplode("doc.jobPostings").alias("pos", "l"))
    first = Window.partitionBy("tenant").orderBy("fetched_at", "pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= WORKDAY_CAP)
    info = detail.withColumn("d", F.from_json("body", WORKDAY_DETAIL)["jobPostingInfo"]).filter("d is not null").select("tenant", F.col("path"), "d")
    both = rows.join(info, (rows["tenant"] == info["tenant"]) & (rows["l.externalPath"] == info["path"])).drop(info["tenant"])
    feed = Feed(
        "", None, id=lambda: text.sanitize_id(text.first_non_empty(c("j.d.jobReqId"), c("j.d.id"), c("j.l.externalPath"))), title=lambda: F.coalesce(text.first_non_empty(c("j.d.title"), c("j.l.title")), F.lit("")), company=_tenant,
        location=lambda: F.coalesce(text.first_non_empty(c("j.d.location"), c("j.l.locationsText")), F.lit("")), description=lambda: text.strip_html(s("j.d.jobDescription")),
        posted=lambda: F.coalesce(text.parse_posted_date(c("j.d.startDate")), text.parse_relative_date(F.coalesce(c("j.d.postedOn"), c("j.l.postedOn")), c("fetched_at"))), url=lambda: c("j.d.externalUrl"), remote=_keyword("j.d.remoteType"),
    )
    return to_postings(both.select("tenant", "fetched_at", "pos", F.struct("l", "d").alias("j")), "workday", feed)


BAMBOO_LIST = "result array<struct<id string, jobOpeningName string, departmentLabel string, location struct<city string, state string>, locationType string>>"
BAMBOO_DETAIL = "result struct<jobOpening struct<jobOpeningShareUrl string, jobOpeningName string, location struct<city string, state string, addressCountry string>, description string, datePosted string>>"


def normalize_bamboohr(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Listing rows joined with their detail (tenant, id, body)."""
    rows = listing.withColumn("doc", F.from_json("body", BAMBOO_LIST)).select("tenant", "fetched_at", F.posexplode("doc.result").alias("pos", "l"))
    info = detail.withColumn("d", F.from_json("body", BAMBOO_DETAIL)["result"]["jobOpening"]).filter("d is not null").select("tenant", "id", "d")
    both = rows.join(info, (rows["tenant"] == info["tenant"]) & (rows["l.id"] == info["id"])).drop(info["tenant"])
    feed = Feed(
        "", None, id=lambda: s("j.l.id"), title=lambda: F.coalesce(text.first_non_empty(c("j.d.jobOpeningName"), c("j.l.jobOpeningName")), F.lit("")), company=_tenant, location=lambda: _place("j.d.location.city", "j.d.location.state", "j.d.location.addressCountry"),
        description=lambda: text.strip_html(s("j.d.description")), posted=_date("j.d.datePosted"), url=lambda: c("j.d.jobOpeningShareUrl"), remote=lambda: F.coalesce(pay.lookup(BAMBOO_PLACES, c("j.l.locationType")), _free_text()),
    )
    return to_postings(both.select("tenant", "fetched_at", "pos", F.struct("l", "d").alias("j")), "bamboohr", feed)


TEAMTAILOR = "struct<data: array<struct<id: string, attributes: map<string, string>, relationships: map<string, struct<data: struct<id: string, type: string>>>>>, included: array<struct<id: string, type: string, attributes: map<string, string>>>>"


def normalize_teamtailor(raw: DataFrame) -> DataFrame:
    """JSON:API pages; related resources are looked up within their page."""
    pages = raw.filter("source = 'teamtailor'").withColumn("doc", F.from_json("body", TEAMTAILOR))
    rows = pages.select("tenant", "fetched_at", F.posexplode("doc.data").alias("pos", "r"), F.col("doc.included").alias("included"))
    rel = c("r")["relationships"]["location"]["data"]
    place = F.try_element_at(F.filter("included", lambda x: (x["id"] == rel["id"]) & (x["type"] == rel["type"])), F.lit(1))["attributes"]
    at = lambda k: c("j.r")["attributes"][k]
    feed = Feed(
        "", None, id=lambda: s("j.r.id"), title=lambda: F.coalesce(at("title"), F.lit("")), company=_tenant, location=lambda: text.join_present(", ", c("j.place")["city"], c("j.place")["country"]), description=lambda: text.strip_html(text.join_present(" ", at("pitch"), at("body"))),
        posted=lambda: F.coalesce(text.parse_posted_date(at("created-at")), text.parse_posted_date(at("published-at"))), url=lambda: at("careersite-job-url"), remote=lambda: F.coalesce(F.nullif(loc.remote_from_keyword(at("remote-status"), loc.TEAMTAILOR_REMOTE), F.lit("unknown")), _free_text()),
    )
    return to_postings(rows.select("tenant", "fetched_at", "pos", F.struct("r", place.alias("place")).alias("j")), "teamtailor", feed)


def normalize_jsonld(pages: DataFrame) -> DataFrame:
    """Postings from the first JobPosting of html pages (tenant, fetched_at, url, html). A page may hold several blocks, a block one document, a list
    or an ``@graph``; each block is parsed once. Blocks that are no JSON are passed over."""
    parsed = F.array_compact(F.transform(text.jsonld_blocks(s("html")), F.try_parse_json))
    docs = F.filter(F.flatten(F.transform(parsed, text.variant_items)), lambda d: text.is_typed(d, "JobPosting"))
    rows = pages.withColumn("doc", F.explode(F.slice(docs, 1, 1))).withColumn("pos", F.lit(0)).withColumn("j", F.struct("doc", "url"))
    get = lambda k: F.coalesce(text.variant_text(c("j.doc"), f"$.{k}"), F.lit(""))
    feed = Feed(
        "", None, id=lambda: text.sanitize_id(text.first_non_empty(text.json_identifier(c("j.doc")), text.stable_key(c("j.url")))), title=lambda: get("title"), company=lambda: F.coalesce(text.first_non_empty(text.json_org_name(c("j.doc"))), _tenant()), location=lambda: text.json_location(c("j.doc")),
        description=lambda: text.strip_html(get("description")), posted=lambda: text.parse_posted_date(get("datePosted")), url=lambda: F.coalesce(text.first_non_empty(get("url")), c("j.url")), salary=lambda: [],
    )
    return to_postings(rows, "sitemap", feed).filter("company <> ''")


def expand_sitemaps(raw: DataFrame) -> DataFrame:
    """feed, url from landed sitemaps (feed, loc, body): url sets directly, indexes through at most two levels of children."""
    find = lambda tag: F.transform(F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}>.*?<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(F.trim(u), F.lit("&amp;"), F.lit("&")))
    maps = raw.select("feed", "loc", find("sitemap").alias("children"), find("url").alias("urls"))
    edges = maps.select("feed", "loc", F.explode("children").alias("child"))
    roots = maps.join(edges.select("feed", F.col("child").alias("loc")), ["feed", "loc"], "left_anti").select("feed", "loc")
    one = roots.join(edges, ["feed", "loc"]).select("feed", F.col("child").alias("loc"))
    two = one.join(edges, ["feed", "loc"]).select("feed", F.col("child").alias("loc"))
    reached = roots.unionByName(one).unionByName(two).distinct()
    return maps.join(reached, ["feed", "loc"], "left_semi").select("feed", F.explode("urls").alias("url")).distinct()


def sparql_companies(raw: DataFrame) -> DataFrame:
    """name, domain, website, id from SPARQL JSON results; rows without a domain are dropped, the first name of each domain stays."""
    schema = "results struct<bindings array<struct<companyLabel struct<value string>, website struct<value string>, company struct<value string>>>>"
    rows = raw.select(F.explode(F.from_json("body", schema)["results"]["bindings"]).alias("b")).select(c("b.companyLabel.value").alias("name"), text.extract_domain(c("b.website.value")).alias("domain"), c("b.website.value").alias("website"), text.last_segment(c("b.company.value")).alias("id"))
    best = rows.filter("domain <> ''").groupBy("domain").agg(F.min(F.struct(F.lower("name").alias("k"), "name", "website", "id")).alias("f"))
    return best.select("f.name", "domain", "f.website", "f.id")


def read_audit(raw: DataFrame) -> DataFrame:
    """ts, event, uid, ip from JSON lines; broken lines and those without ts or event are dropped."""
    return raw.select(F.from_json("value", "ts string, event string, uid string, ip string").alias("e")).select(F.try_to_timestamp("e.ts").alias("ts"), "e.event", "e.uid", "e.ip").filter("ts is not null and event is not null")
