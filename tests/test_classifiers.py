import pytest
from pyspark.sql import functions as F

from hirelake.functions import location, pay, rules, text

c = F.col


def run(spark, rows, schema, column):
    return [r.out for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row int, " + schema).select("_row", column.alias("out")).orderBy("_row").collect()]


def test_country(spark):
    cases = {
        "Berlin, DE": "DE", "San Francisco, CA": "US", "Toronto, ON": "CA", "London, UK": "GB", "Indianapolis, IN": "US", "Mumbai, IN": "IN", "Bengaluru, India": "IN", "Kyiv, Ukraine": "UA",
        "Remote": None, "Worldwide": None, "": None, None: None, "Sausalito, CA": "US", "U.S.": "US", "Paris": "FR", "Remote - Canada": "CA", "Denver, CO": "US", "Wilmington, DE": "US",
        "Vancouver, BC": "CA", "SG": "SG", "Northern Ireland": "GB", "Dublin | Remote": "IE", "New Delhi": "IN", "São Paulo": "BR", "Bogotá, CO": "US",
    }
    assert run(spark, [(k,) for k in cases], "l string", location.classify_country(c("l"))) == list(cases.values())


def test_remote(spark):
    cases = [("Remote", "", "remote"), ("Remote office", "", "onsite"), ("", "fully remote", "remote"), ("Hybrid - Austin", "", "hybrid"), ("", "a hybrid team", "hybrid"), ("", "", "unknown"), (None, None, "unknown"), ("Oslo", "remote sensing", "onsite")]
    assert run(spark, [x[:2] for x in cases], "l string, d string", location.classify_remote(c("l"), c("d"))) == [x[2] for x in cases]


def test_industry_and_family(spark):
    cases = [
        ("Registered Nurse", "", "healthcare", "registered_nurse"), ("Senior Software Engineer", "", "tech", "software_engineering"), ("Meat Cutter", "Why do people love shopping in MD", "other", None),
        ("Line Cook", "", "food_service", "line_cook"), ("Deputy Sheriff", "", "government", "police_officer"), ("Truck Driver", None, "logistics", "truck_driver"), ("Jane, MD", "", "healthcare", None),
        ("Coordinator", "x" * 310 + " nurse", "other", None), ("", "", "other", None),
    ]
    df = [x[:2] for x in cases]
    assert run(spark, df, "t string, d string", rules.classify_industry(c("t"), c("d"))) == [x[2] for x in cases]
    assert run(spark, df, "t string, d string", rules.classify_job_family(c("t"), c("d"))) == [x[3] for x in cases]


def test_title_level(spark):
    cases = [
        ("VP of Engineering", "tech", "executive"), ("Senior Engineering Manager", "tech", "manager"), ("Staff Engineer", None, "staff"), ("Software Engineer III", "tech", "senior"), ("Software Engineer II", "tech", None),
        ("Software Engineer I", "tech", "junior"), ("Charge Nurse", "healthcare", "staff"), ("Associate Professor", "education", "senior"), ("Assistant Professor", "education", "junior"), ("Journeyman Electrician", "trades", "senior"),
        ("Summer Intern", None, "intern"), ("Cashier", "retail", "junior"), ("GS-13 Analyst", "government", "senior"), ("Lead Accountant", "finance", "senior"), ("  ", None, None), ("Engineer IV", "tech", "staff"),
    ]
    assert run(spark, [x[:2] for x in cases], "t string, i string", rules.classify_title_level(c("t"), c("i"))) == [x[2] for x in cases]


def test_body_level(spark):
    cases = [
        ("Minimum Qualifications: 5-7 years of engineering experience", "mid"), ("Requirements: 8+ years of software experience", "senior"), ("Requirements:\n- 1 year of experience", "junior"), ("Amazon has 25 years of experience serving customers", None),
        ("We hire new grads", "junior"), ("No experience required", "junior"), ("10+ years of professional experience", "senior"), ("3-5 years of relevant experience", "mid"), ("", None), (None, None),
        ("<h4>Qualifications</h4> - at least 4 years", "mid"), ("x " * 3000 + "entry level", None),
    ]
    assert run(spark, [(x[0],) for x in cases], "d string", rules.classify_body(c("d"))) == [x[1] for x in cases]


def test_title_or_body(spark):
    cases = [("Director of Engineering", "Requirements: 5 years of experience", "director"), ("Software Engineer", "Requirements: 5 years of experience", "mid"), ("Senior Engineer", "", "senior")]
    assert run(spark, [x[:2] for x in cases], "t string, d string", rules.classify_title_or_body(c("t"), c("d"), F.lit("tech"))) == [x[2] for x in cases]
    assert run(spark, [("senior",), ("manager",), ("intern",)], "l string", rules.levels_at_or_below(c("l"))) == [["intern", "junior", "mid", "senior"], ["manager"], ["intern"]]


@pytest.mark.parametrize(
    "given,want,shown",
    [
        ("Pay $120k - $150k.", (120000, 150000, "USD", "annual"), "$120k – $150k USD"), ("£40,000 to £50,000", (40000, 50000, "GBP", "annual"), "£40k – £50k GBP"), ("EUR 55k - 75k", (55000, 75000, "EUR", "annual"), "€55k – €75k EUR"),
        ("120,500 – 160,000 CAD", (120500, 160000, "CAD", "annual"), "$120,500 – $160k CAD"), ("$45 - $65 per hour", (45, 65, "USD", "hourly"), "$45 – $65 USD/hr"), ("$1 - $3", None, None), ("$200k - $100k", None, None), ("none", None, None), (None, None, None),
    ],
)
def test_salary(spark, given, want, shown):
    s = pay.parse_salary(c("t"))
    df = spark.createDataFrame([(given,)], "t string").select(s.alias("s"))
    r = df.select("s", pay.format_salary(c("s.min"), c("s.max"), c("s.currency"), c("s.period")).alias("shown")).first()
    assert (tuple(r.s) if r.s else None) == want and r.shown == shown


def test_usd_and_overlap(spark):
    cases = [(100.0, "USD", "hourly", 208000), (50000.0, "EUR", None, 54000), (100.0, None, "weekly", 5200), (100.0, "XXX", "fortnight", 100)]
    assert run(spark, [x[:3] for x in cases], "a double, c string, p string", pay.to_usd_annual(c("a"), c("c"), c("p"))) == [x[3] for x in cases]
    rows = [(90000.0, 120000.0), (None, 120000.0), (None, None), (10.0, 0.0)]
    hit = lambda lo, hi: run(spark, rows, "a double, b double", pay.salary_overlaps(c("a"), c("b"), F.lit("USD"), F.lit("annual"), lo, hi))
    assert hit(100_000, None) == [True, True, False, False] and hit(None, 100_000) == [True, False, False, False] and hit(None, None) == [True] * 4


def test_text_columns(spark):
    one = lambda value, f: run(spark, [(value,)], "v string", f(c("v")))[0]
    assert one("Senior Software Engineer II (Remote)", text.normalize_title) == "software engineer"
    assert one("Acme Technologies, Inc.", text.normalize_company) == "acme"
    assert one("<p>a&amp;b</p>\n <b>c</b>", text.strip_html) == "a&b c"
    assert one("speakeasy-api", text.pretty_company) == "Speakeasy api"
    assert one("Y Combinator", text.slug_variants) == ["ycombinator", "y-combinator"]
    assert one("Stripe Inc", text.slug_variants) == ["stripeinc", "stripe-inc", "stripe"]
    assert one("https://www.Example.com/jobs/1", text.extract_domain) == "example.com"
    assert one("https://x.io/careers/5", text.has_job_hint) is True
    assert one("Acme: Cook", lambda v: text.split_company_role(v)["role"]) == "Cook"
    assert one("Mon, 02 Jan 2006 15:04:05 +0000", lambda v: text.parse_posted_date(v).cast("string")) == "2006-01-02 15:04:05"
    assert one("12/11/2024", lambda v: text.parse_posted_date(v).cast("string")) == "2024-11-12 00:00:00"
    assert one("Posted 30+ Days Ago", lambda v: text.parse_relative_date(v, F.lit("2024-03-31").cast("timestamp")).cast("string")) == "2024-03-01 00:00:00"
    assert one("C++ / Node.js, \"x\"", text.normalize_query) == "c++ node.js x"
    assert one("engineer, Software", lambda v: text.query_cache_key(v, F.lit(True))) == "x:engineer software"
    assert one("junior", text.suggest_related) == ["new grad", "associate", "entry level"]


def test_borders_are_ascii_and_no_break_spaces_are_blanks(spark):
    import random
    import re

    from hirelake.functions import patterns, rules
    from hirelake.functions import text as texts

    rows = [("Software\u00a0Engineer", "tech"), ("Registered\u00a0Nurse", "healthcare"), ("éintern", "tech"), ("Senior\u00a0Engineer", "tech"), ("internship é", "tech")]
    df = spark.createDataFrame(rows, "title string, industry string")
    told = {r.title: (r.f, r.i, r.l, r.k) for r in df.select("title", rules.classify_job_family(F.col("title"), F.lit("")).alias("f"), rules.classify_industry(F.col("title"), F.lit(None)).alias("i"), rules.classify_title_level(F.col("title"), F.col("industry")).alias("l"), texts.normalize_title(F.col("title")).alias("k")).collect()}
    assert told["Software\u00a0Engineer"][:2] == ("software_engineering", "tech") and told["Registered\u00a0Nurse"][1] == "healthcare"
    assert told["éintern"][2] == "intern" and told["Senior\u00a0Engineer"][2:] == ("senior", "engineer")
    rng, alphabet = random.Random(1), ["a", "é", "_", " ", ".", "1", "x", "ñ"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(6))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i long, t string")
    for pattern in (r"\ba", r"a\b", r"\b(?:a|\.x)\b", r"\ba?x\b", r"x\b\.", r"\s\b1*", r"\bx\.a\.\b"):
        want = {i for i, t in enumerate(cases) if re.search(pattern, t, re.ASCII)}
        assert {r.i for r in df.filter(F.col("t").rlike(patterns.ascii_borders(pattern))).collect()} == want, pattern


def test_backfill_leaves_postings_without_a_title(spark):
    from hirelake.operators import ingest

    rows = [("", None, None), (None, "", None), ("Software Engineer", "", None), ("Software Engineer", "legal", "law"), ("zzz", None, "kept"), (" ", None, None)]
    df = spark.createDataFrame(rows, "title string, industry string, job_family string").withColumn("description", F.lit(""))
    got = [(r.industry, r.job_family is not None) for r in ingest.backfill_industry(df).collect()]
    assert got == [(None, False), ("", False), ("tech", True), ("legal", True), ("other", True), (None, False)]
    forced = [r.industry for r in ingest.backfill_industry(df, force=True).collect()]
    assert forced == [None, "", "tech", "tech", "other", None]
