"""Indexes over words against plain patterns."""

import random
import re

from hirelake.operators import ingest, ranking, text_index
from pyspark.sql import functions as F

PARTS = ["c++", "c", "node", ".", ".net", "net", "node.js", "software", "engineer", "-", "  ", " ", "é", "nurse", "Nurse", "r&d", "+", "c#", "\n", "_x"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "-"]) for _ in range(rng.randrange(7))) for _ in range(n)]


def test_phrases_meet_where_a_pattern_would(spark):
    rows = [(f"p{i:03}", t) for i, t in enumerate(texts(400, 1))] + [("null", None)]
    df = spark.createDataFrame(rows, "external_id string, title string")
    index = spark.read.parquet(text_index.write_title_index(df))
    phrases = ["software engineer", "c++", ".net", "nurse", "node.js", "net", "r&d", "c#", "engineer-nurse", "-net", "c  c", "é", "_x", "nurse-"]
    phrases = [p for p in phrases if re.search(r"\w", p, re.ASCII)]
    got = {}
    for r in text_index.phrase_hits(index, phrases).collect():
        got.setdefault(phrases[r.token], set()).add(r.id)
    for p in phrases:
        pattern = re.compile(rf"(?<!\w){re.escape(p)}(?!\w)", re.ASCII)
        assert got.get(p, set()) == {i for i, t in rows if t and pattern.search(t.lower())}, p
    for keywords, limit in ((["Nurse", "software engineer", "x", "c++"], 30), (["--"], 5), ([], 5)):
        a = text_index.keyword_lookup(index, keywords, limit).collect()
        assert keywords == ["--"] or sorted(map(tuple, a)) == sorted(map(tuple, ranking.keyword_pass(df, keywords, limit).collect()))
    plan = text_index.phrase_hits(index, ["nurse"])._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "token" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_terms_are_found_as_whole_words(spark):
    rows = [(i, t, ["tech", "healthcare", None, "legal"][i % 4]) for i, t in enumerate(texts(300, 2))] + [(900, None, "tech"), (901, "", None)]
    terms = [("tech", k, t, "kind", t) for k, t in enumerate(["C++", "C", "Node.js", ".NET", "software engineer", "R&D", "C#", "engineer"])] + [("healthcare", 0, "Nurse", "kind", "nurse"), ("healthcare", 1, "Nurse", "a", "nurse-")]
    df, lexicon = spark.createDataFrame(rows, "id long, body string, industry string"), spark.createDataFrame(terms, "industry string, place int, name string, category string, term string")
    got = {(r.id, r.name, r.category, r.place) for r in ingest.extract_skills(df, "id", "body", F.col("industry"), lexicon).collect()}
    want = {}
    for i, body, industry in rows:
        for bank, place, name, category, term in terms:
            left = r"(?<!\w)"
            if bank == (industry if industry in ("tech", "healthcare") else "tech") and body and re.search(left + re.escape(term) + r"(?!\w)", body, re.I | re.A):
                old = want.get((i, name), (category, place))
                want[i, name] = (min(old[0], category), min(old[1], place))
    assert got == {(i, n, *v) for (i, n), v in want.items()} and len(got) > 200


def test_a_large_lexicon_is_joined_not_looped_over(spark):
    lexicon = spark.range(200_000).select(F.lit("tech").alias("industry"), F.col("id").cast("int").alias("place"), F.concat(F.lit("skill "), "id").alias("name"), F.lit("k").alias("category"), F.concat(F.lit("skill "), "id").alias("term"))
    df = spark.range(2_000).select("id", F.concat(F.lit("has skill "), F.col("id") * 50, F.lit(" and skill "), F.col("id")).alias("body"))
    found = ingest.extract_skills(df, "id", "body", F.lit("tech"), lexicon)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() == 2_000 * 2 - 1


def test_a_text_that_many_rows_share_is_looked_through_once(spark, monkeypatch):
    """1,000 rows of two texts and two industries: three pairs of them are cut into runs of words; an id with two texts has the skills of both once."""
    seen = []
    grams = text_index.phrase_grams
    monkeypatch.setattr(text_index, "phrase_grams", lambda df, *rest: (seen.append(df.count()), grams(df, *rest))[1])
    lexicon = spark.createDataFrame([("tech", 0, "SQL", "language", "sql"), ("tech", 1, "C++", "language", "c++"), ("legal", 0, "Law", "field", "law")], "industry string, place int, name string, category string, term string")
    df = spark.range(1_000).select((F.col("id") % 999).alias("id"), F.when(F.col("id") % 2 == 0, "SQL and C++").otherwise("law or sql").alias("body"), F.when(F.col("id") % 4 == 1, "legal").otherwise("tech").alias("industry"))
    df = df.unionByName(spark.createDataFrame([(5_000, None, "tech")], "id long, body string, industry string"))
    got = {(r.id, r.name) for r in ingest.extract_skills(df, "id", "body", F.col("industry"), lexicon).collect()}
    want = {(i % 999, n) for i in range(1_000) for n in (("SQL", "C++") if i % 2 == 0 else ("Law",) if i % 4 == 1 else ("SQL",))}
    assert seen == [3] and got == want


def test_longest_key_of_a_query(spark):
    banks = spark.createDataFrame([("tech", "data", "e1", ["a"]), ("tech", "data engineer", "e2", ["b"]), ("common", "big data engineer", "e3", ["c"]), ("legal", "big", "e4", [])], "bank string, key string, embed_text string, keywords array<string>")
    asked = spark.createDataFrame([("Big Data Engineer", "tech"), ("big  data", None), ("database engineer", "tech"), ("", None), (None, None)], "query string, industry string")
    expanded = ingest.expand_queries(asked, banks)
    got = {r.query: r.embed_text for r in expanded.collect()}
    assert got == {"Big Data Engineer": "e2", "big  data": "e1", "database engineer": None, "": None, None: None}
    assert "NestedLoop" not in expanded._jdf.queryExecution().toString()
