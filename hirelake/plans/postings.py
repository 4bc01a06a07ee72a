"""Derived tables: job postings and what goes with them, by SQL that Spark and DuckDB both run on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Stands between the words of some titles; others begin with an accent. Rules have to see through both.
NO_BREAK_SPACE = "\u00a0"
AS_OF = "2001-08-02 00:00:00"

TITLES = [
    "Senior Software Engineer", "Registered Nurse", "Line Cook", "Data Engineer II", "Store Manager", "Software Engineer I (Remote)", "Deputy Sheriff",
    "Roving Coordinator", "VP of Engineering", "Journeyman Electrician", "Associate Professor of Physics", "Staff Accountant", "Summer Intern", "Charge Nurse",
    "Truck Driver", "Product Manager", "Principal Research Scientist", "Paralegal", "Cashier", "Lead Line Cook",
]
LOCATIONS = ["San Francisco, CA", "Berlin, DE", "Toronto, ON", "London, UK", "Remote", "Indianapolis, IN", "Mumbai, IN", "Remote office, Paris, France", "Hybrid - Austin, TX", "", "Kyiv, Ukraine"]
SOURCES = ["greenhouse", "workday", "themuse", "remoteok", "hackernews"]
DESCRIPTIONS = [
    "Minimum Qualifications: 5-7 years of engineering experience. Pay $120k - $150k.", "We are hiring new grads.", "",
    "Requirements: 8+ years of software experience. EUR 55k - 75k", "Work from home. Python, SQL and Kubernetes. $45 - $65 per hour.",
    "<p>Entry level role.</p> Hybrid schedule with React and TypeScript", "Company history: 25 years of experience serving customers. £40,000 to £50,000 per annum",
]


def _values(items: list[str]) -> str:
    quoted = (x.replace("'", "''") for x in items)
    return "VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(quoted))


def _case(key: str, options: list[str]) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


POSTINGS_SQL = f"""
SELECT concat(s.v, ':t', CAST(o.o_custkey % 50 AS VARCHAR(10)), ':', CAST(o.o_orderkey AS VARCHAR(20))) AS external_id, o.o_orderkey AS posting_key,
  CASE WHEN o.o_orderkey % 13 = 5 THEN replace(t.v, ' ', '{NO_BREAK_SPACE}') WHEN o.o_orderkey % 17 = 3 THEN concat('é', t.v) ELSE t.v END AS title,
  concat('Acme ', CAST(o.o_custkey % 97 AS VARCHAR(10)), CASE o.o_custkey % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ', LLC' ELSE '' END) AS company,
  l.v AS location, s.v AS source, b.v AS description,
  CASE WHEN o.o_orderkey % 4 = 3 THEN NULL ELSE floor(o.o_totalprice / 4) END AS salary_min,
  CASE WHEN o.o_orderkey % 4 = 3 THEN NULL ELSE floor(o.o_totalprice / 2) END AS salary_max,
  {_case('o.o_custkey', ["'USD'", "'EUR'", "'GBP'", "'INR'"])} AS salary_currency,
  {_case('o.o_orderkey', ["'annual'", "'annual'", "'monthly'", "'weekly'", "'annual'"])} AS salary_period,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderdate END AS posted_at, o.o_orderdate AS scraped_at,
  CASE o.o_orderkey % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_active
FROM orders o
JOIN ({_values(TITLES).replace('VALUES', 'SELECT * FROM (VALUES')}) AS q(i, v)) t ON t.i = o.o_orderkey % {len(TITLES)}
JOIN ({_values(LOCATIONS).replace('VALUES', 'SELECT * FROM (VALUES')}) AS q(i, v)) l ON l.i = o.o_custkey % {len(LOCATIONS)}
JOIN ({_values(SOURCES).replace('VALUES', 'SELECT * FROM (VALUES')}) AS q(i, v)) s ON s.i = o.o_orderkey % {len(SOURCES)}
JOIN ({_values(DESCRIPTIONS).replace('VALUES', 'SELECT * FROM (VALUES')}) AS q(i, v)) b ON b.i = o.o_custkey % {len(DESCRIPTIONS)}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived postings. Orders are spread over the session's shuffle partitions before texts are made of them, so that narrow rows move."""
    table(spark, sf_dir, "orders").repartition("o_orderkey").createOrReplaceTempView("orders")
    return spark.sql(POSTINGS_SQL)
