"""Normalisers on small responses of their feeds, with a broken body each."""

import json

import pytest
from pyspark.sql import functions as F

from hirelake.functions import text
from hirelake.operators import ingest
from hirelake.sources import feeds

RAW = "source string, tenant string, fetched_at timestamp, body string"


def raw(spark, source, *bodies, tenant="acme-labs"):
    rows = [(source, tenant, b if isinstance(b, str) else json.dumps(b)) for b in bodies]
    return spark.createDataFrame(rows, "source string, tenant string, body string").withColumn("fetched_at", F.lit("2024-05-02 00:00:00").cast("timestamp"))


def one(df, *cols):
    rows = df.select(*cols).collect()
    assert len(rows) == 1
    return tuple(rows[0])


MUSE = [("Internship", "intern"), ("Entry Level", "junior"), ("Mid Level", "mid"), ("Senior Level", "senior"), ("management", "manager"), ("Executive", "executive")]
PERSONIO = [("entry-level", "junior"), ("Entry Level", "junior"), ("junior", "junior"), ("mid", "mid"), ("professional", "mid"), ("experienced", "mid"), ("senior", "senior"), (" lead ", "principal"), ("principal", "principal"), ("manager", "manager"), ("director", "director"), ("c-level", "executive"), ("internship", "intern"), ("student", "intern")]


def test_levels_that_feeds_state(spark):
    jobs = [{"id": i, "name": "Something", "levels": [{"name": label}]} for i, (label, _) in enumerate(MUSE)]
    got = {r.external_id: r.experience_level for r in feeds.normalize(raw(spark, "themuse", {"results": jobs}, "{broken"), "themuse").collect()}
    assert got == {f"themuse:{i}": level for i, (_, level) in enumerate(MUSE)}
    xml = "<w>" + "".join(f"<position><id>{i}</id><name>Something</name><seniority>{label}</seniority></position>" for i, (label, _) in enumerate(PERSONIO)) + "</w>"
    got = {r.external_id: r.experience_level for r in feeds.normalize(raw(spark, "personio", xml), "personio").collect()}
    assert got == {f"personio:acme-labs:{i}": level for i, (_, level) in enumerate(PERSONIO)}


@pytest.mark.parametrize(
    "source,body,cols,want",
    [
        ("lever", [{"id": "a", "text": "Engineer", "categories": {"location": "Berlin, DE"}, "workplaceType": "hybrid", "createdAt": 1714521600000, "additionalPlain": "Pay EUR 50k - 60k"}], ("external_id", "company", "remote_status", "salary_min", "salary_currency"), ("lever:acme-labs:a", "Acme labs", "hybrid", 50000.0, "EUR")),
        ("ashby", {"jobs": [{"id": "1", "title": "A", "isListed": False}, {"id": "2", "title": "B", "isListed": True, "isRemote": True, "publishedAt": "2024-05-01T00:00:00Z"}]}, ("external_id", "remote_status"), ("ashby:acme-labs:2", "remote")),
        ("smartrecruiters", {"content": [{"id": "1", "name": "A", "company": {"name": "Big"}, "location": {"city": "Paris", "region": "Paris", "country": "fr", "remote": True}}]}, ("company", "location", "country", "remote_status"), ("Big", "Remote · FR", "FR", "remote")),
        ("recruitee", {"offers": [{"id": 1, "title": "A", "status": "draft"}, {"id": 2, "title": "B", "city": "Lyon", "country": "France", "country_code": "fr"}]}, ("external_id", "location", "country"), ("recruitee:acme-labs:2", "Lyon, France", "FR")),
        ("breezy", [{"id": "1", "name": "A", "salary": "$40 - $50 per hour", "location": {"name": "Remote", "is_remote": True, "country": {"id": "us"}}}], ("location", "country", "remote_status", "salary_max", "salary_period"), ("Remote", "US", "remote", 50.0, "hourly")),
        ("pinpoint", {"data": [{"id": "1", "title": "A", "compensation_minimum": 10, "compensation_maximum": 20, "compensation_currency": "GBP", "compensation_frequency": "Hour", "workplace_type": "onsite"}]}, ("salary_min", "salary_currency", "salary_period", "remote_status"), (10.0, "GBP", "hourly", "onsite")),
        ("adzuna", {"results": [{"id": "1", "title": "A", "salary_min": 1, "salary_max": 2, "salary_is_predicted": "1"}]}, ("external_id", "salary_max"), ("adzuna:1", None)),
        ("reed", {"results": [{"jobId": 1, "jobTitle": "A", "minimumSalary": 30000, "maximumSalary": 40000}]}, ("country", "salary_currency", "salary_max"), ("GB", "GBP", 40000.0)),
        ("careerjet", {"jobs": [{"title": "A", "url": "https://c/0123456789abcdef01"}]}, ("external_id",), ("careerjet:0123456789abcdef01",)),
        ("remoteok", [{"legal": "terms"}, {"id": "7", "position": "A", "tags": ["x", "y"], "epoch": 1714521600, "salary_max": 9}], ("external_id", "description", "remote_status", "salary_currency"), ("remoteok:7", "Tags: x, y", "remote", "USD")),
        ("usajobs", {"SearchResult": {"SearchResultItems": [{"MatchedObjectId": "9", "MatchedObjectDescriptor": {"PositionTitle": "A", "DepartmentName": "Dept", "PositionRemuneration": [{"MinimumRange": "20", "MaximumRange": "30", "RateIntervalCode": "PH"}]}}]}}, ("company", "industry", "country", "salary_period"), ("Dept", "government", "US", "hourly")),
        ("amazon", {"jobs": [{"id": "1", "title": "A", "job_path": "/x", "country_code": "usa", "location": "US, WA, Seattle"}]}, ("company", "source_url", "location"), ("Amazon", "https://www.amazon.jobs/x", "US, WA, Seattle")),
        ("hackernews", {"id": 1, "children": [{"id": 2, "parent_id": 1, "story_id": 1, "text": "Acme | Senior Engineer | Berlin | Remote<p>We build things, see https://acme.example/jobs"}, {"id": 3, "parent_id": 2, "story_id": 1, "text": "a reply that is no posting at all, really"}]}, ("external_id", "company", "title", "location", "remote_status"), ("hackernews:1:2", "Acme", "Senior Engineer", "Berlin", "remote")),
        ("workatastartup", '<div data-page="{&quot;props&quot;:{&quot;jobs&quot;:[{&quot;id&quot;:5,&quot;title&quot;:&quot;R&amp;amp;D&quot;,&quot;companyName&quot;:&quot;Acme&quot;,&quot;salary&quot;:&quot;$100k - $120k&quot;}]}}"></div>', ("external_id", "company", "salary_max"), ("workatastartup:5", "Acme", 120000.0)),
        ("weworkremotely", "<rss><channel><item><title>Acme: Dev: Lead</title><guid>g</guid><region>Anywhere</region></item></channel></rss>", ("company", "title", "location", "remote_status"), ("Acme", "Dev: Lead", "Anywhere", "remote")),
        ("rss", "<rss><channel><item><title>Dev</title><link>l</link><description>Location: Oslo</description></item></channel></rss>", ("title", "location"), ("Dev", "Oslo")),
    ],
)
def test_fields_of_feeds(spark, source, body, cols, want):
    assert one(feeds.normalize(raw(spark, source, body, "{broken"), source), *cols) == want


def test_feeds_of_two_requests(spark):
    listing = raw(spark, "workday", {"jobPostings": [{"title": "A", "externalPath": "/job/1", "locationsText": "Austin, TX", "postedOn": "Posted Yesterday"}, {"title": "B", "externalPath": "/none"}]})
    detail = spark.createDataFrame([("acme-labs", "/job/1", json.dumps({"jobPostingInfo": {"jobReqId": "R 1", "jobDescription": "<p>x</p>", "remoteType": "Remote"}}))], "tenant string, path string, body string")
    assert one(feeds.normalize_workday(listing, detail), "external_id", "title", "location", "remote_status", F.to_date("posted_at").cast("string")) == ("workday:acme-labs:R_1", "A", "Austin, TX", "remote", "2024-05-01")
    listing = raw(spark, "bamboohr", {"result": [{"id": "3", "jobOpeningName": "A", "locationType": "2"}]})
    detail = spark.createDataFrame([("acme-labs", "3", json.dumps({"result": {"jobOpening": {"description": "d", "location": {"city": "Oslo", "addressCountry": "Norway"}}}}))], "tenant string, id string, body string")
    assert one(feeds.normalize_bamboohr(listing, detail), "title", "location", "remote_status") == ("A", "Oslo, Norway", "hybrid")
    page = {"data": [{"id": "1", "attributes": {"title": "A", "remote-status": "fully"}, "relationships": {"location": {"data": {"id": "9", "type": "locations"}}}}], "included": [{"id": "9", "type": "locations", "attributes": {"city": "Malmö", "country": "Sweden"}}]}
    assert one(feeds.normalize_teamtailor(raw(spark, "teamtailor", page)), "title", "location", "remote_status") == ("A", "Malmö, Sweden", "remote")


def test_pages_sitemaps_and_tables_of_companies(spark):
    doc = {"@type": "JobPosting", "title": "A", "identifier": {"value": "id 1"}, "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Bonn", "addressCountry": "DE"}}], "datePosted": "2024-05-01"}
    html = f'<script type="application/ld+json">{json.dumps(doc).replace(": ", ":")}</script>'
    pages = spark.createDataFrame([("t", "http://x/1", html), ("t", "http://x/2", "<p>none</p>"), ("t", "http://x/3", None)], "tenant string, url string, html string").withColumn("fetched_at", F.current_timestamp())
    assert one(feeds.normalize_jsonld(pages), "external_id", "company", "location") == ("sitemap:t:id_1", "Acme", "Bonn, DE")
    maps = [("f", "r", "<sitemap><loc>a</loc></sitemap>"), ("f", "a", "<sitemap><loc>b</loc></sitemap><url><loc> http://x/1?a=1&amp;b=2 </loc></url>"), ("f", "b", "<sitemap><loc>c</loc></sitemap><url><loc>http://x/2</loc></url>"), ("f", "c", "<url><loc>too deep</loc></url>")]
    assert sorted(r.url for r in feeds.expand_sitemaps(spark.createDataFrame(maps, "feed string, loc string, body string")).collect()) == ["http://x/1?a=1&b=2", "http://x/2"]
    rows = [{"companyLabel": {"value": n}, "website": {"value": w}, "company": {"value": "http://e/Q1"}} for n, w in (("Acme", "https://www.acme.com/x"), ("Zed", "http://acme.com"), ("No", ""))]
    got = feeds.sparql_companies(spark.createDataFrame([(json.dumps({"results": {"bindings": rows}}),)], "body string"))
    assert one(got, "name", "domain", "id") == ("Acme", "acme.com", "Q1")
    lines = spark.createDataFrame([('{"ts": "2024-01-01T00:00:00Z", "event": "login", "uid": "u"}',), ("{broken",), ('{"event": "x"}',)], "value string")
    assert one(feeds.read_audit(lines), "event", "uid") == ("login", "u")
    hits = spark.createDataFrame([('{"adapter": "lever", "slug": "acme", "jobs": 3}',), ("{",), ('{"adapter": "lever", "slug": ""}',)], "value string")
    assert one(ingest.read_probe_hits(hits), "adapter", "slug", "jobs") == ("lever", "acme", 3)


def test_numeric_entities(spark):
    df = spark.createDataFrame([("&#72;&#x69;&#x1F642; &amp;#65; &#0; &#xD800; &lt;b&gt; caf&#233;",)], "t string")
    assert one(df, text.strip_html(F.col("t"))) == ("Hi🙂 &#65; &#0; &#xD800; <b> café",)


def test_json_documents_of_any_shape(spark):
    rows = [
        ("a", '{"@type": "JobPosting", "title": "T", "hiringOrganization": "Acme", "identifier": 12, "jobLocation": [{"address": {"addressLocality": "Bonn", "addressCountry": {"name": "DE"}}}]}'),
        ("b", '[1, {"@type": ["Thing", "JobPosting"], "title": "T", "hiringOrganization": [{"name": "Acme"}], "identifier": {"value": "x 1"}, "jobLocation": {"address": "Bonn"}}]'),
        ("c", '{"@graph": [{"@type": "Org"}, {"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "Acme"}}, {"@type": "JobPosting", "title": "second"}]}'),
        ("d", '{"@type": "JobPosting", broken'), ("e", '{"@type": "Other", "note": "JobPosting"}'), ("f", ""), ("g", None), ("h", '"JobPosting"'), ("i", "null"),
    ]
    pages = spark.createDataFrame([(t, None if b is None else f'<script type="application/ld+json">{b}</script>') for t, b in rows], "tenant string, html string")
    pages = pages.withColumn("url", F.concat(F.lit("u/"), "tenant")).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    out = feeds.normalize_jsonld(pages)
    got = {r.source_url: (r.title, r.company, r.location) for r in out.collect()}
    assert got == {"u/a": ("T", "Acme", "Bonn, DE"), "u/b": ("T", "Acme", "Bonn"), "u/c": ("T", "Acme", "")}
    assert {r.external_id for r in out.collect() if r.source_url < "u/c"} == {"sitemap:a:12", "sitemap:b:x_1"}
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = feeds.normalize_jsonld(pages)._jdf.queryExecution().optimizedPlan().toString().lower()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("parsejson") + plan.count("parse_json") == 1, plan
