"""Embedding, match explanations, skill gaps and discovery tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions import text
from hirelake.operators import ingest, ranking
from hirelake.operators.filters import SearchFilter
from hirelake.operators.tables import kept

#: Texts handed to a model at once.
BATCH = 64
# Shapes of a job board's answer that prove a slug, by adapter.
PROOF_KEY = {"greenhouse": "jobs", "ashby": "jobs", "recruitee": "offers", "bamboohr": "result", "pinpoint": "data"}
PROOF_START = {"lever": "[{", "breezy": "[", "pinpoint": "["}
PROOF_COUNT = {"smartrecruiters": "totalFound"}
PROOF_BYTES = 4096
#: Job pages of a site that are looked at for a posting.
SAMPLES = 2


def hashed_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Signed feature hashing of words, normalised: a stand-in for a language model."""
    import zlib

    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            row[(h >> 1) % dim] += 1 if h & 1 else -1
        size = float(np.linalg.norm(row))
        if size:
            row /= size
    return out


def embed(df: DataFrame, id_col: str, column: str, model: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in ``keep``, vector. ``model`` maps a list of up to 64 texts to as many vectors of ``dim`` numbers; anything else fails the task."""
    run_model = model or (lambda texts: hashed_vectors(texts, dim))
    rows = df.select(F.col(id_col).alias("id"), F.col(column).alias("t"), *keep)
    fields = [rows.schema["id"], *[rows.schema[c] for c in keep], T.StructField("vector", T.ArrayType(T.FloatType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, vectors = [t or "" for t in batch.column(1).to_pylist()], []
            for a in range(0, len(texts), BATCH):
                part = np.asarray(run_model(texts[a : a + BATCH]))
                if part.shape != (len(texts[a : a + BATCH]), dim):
                    raise ValueError(f"the model gave {part.shape} for {len(texts[a : a + BATCH])} texts of dimension {dim}")
                vectors += part.astype(np.float32).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(vectors, pa.list_(pa.float32()))], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def explain_match(pairs: DataFrame, model: Callable | None = None, k: int = 4, dim: int = 64, limit: int = 25) -> DataFrame:
    """match, resume, job, score: the ``k`` best pairs of the first ``limit`` chunks of each (match, resume_text, job_text), every chunk in one pair at most."""
    sides = {}
    for side in ("resume", "job"):
        chunks = ingest.chunk_text(pairs, "match", f"{side}_text", limit=limit)
        told = embed(chunks, "match", "chunk", model, dim, ("pos", "chunk"))
        sides[side] = kept(told.select("match", F.col("pos").alias(side[0]), F.col("chunk").alias(side), F.col("vector").alias(side + "_vector")), side)
    cells = sides["resume"].select("match", "r", "resume_vector").join(sides["job"].select("match", "j", "job_vector"), "match")  # at most ``limit`` by ``limit`` chunks of one match
    scores = cells.select("match", F.col("r").alias("i"), "j", ranking.cosine(F.col("resume_vector"), F.col("job_vector")).alias("score"))
    best = ranking.greedy_pairs(scores, k).withColumnRenamed("i", "r")
    named = best.join(sides["resume"].select("match", "r", "resume"), ["match", "r"]).join(sides["job"].select("match", "j", "job"), ["match", "j"])
    return named.select("match", "resume", "job", "score")


def diff_skills(resume: DataFrame, job: DataFrame, key: str) -> DataFrame:
    """key, name, kind (matched, missing or extra) of two skill tables."""
    a, b = resume.select(key, "name").distinct().withColumn("r", F.lit(True)), job.select(key, "name").distinct().withColumn("j", F.lit(True))
    both = a.join(b, [key, "name"], "full")
    return both.select(key, "name", F.when(F.col("r") & F.col("j"), "matched").when(F.col("j"), "missing").otherwise("extra").alias("kind"))


def skill_gaps(profiles: DataFrame, postings: DataFrame, lexicon: DataFrame, as_of: str, k: int = 50, gaps: int = 12, confirmed: int = 8) -> DataFrame:
    """uid, kind (gap or confirmed), name, n: how often skills occur in a profile's ``k`` best postings, split by whether the résumé has them; the top of each.

    ``profiles``: uid, resume_text, industry, skill_vector; a stated set."""
    live = SearchFilter(max_age_days=45).apply(postings, as_of)
    top = kept(ranking.batch_topk(profiles, live, k, "uid", "skill_vector", "external_id"), "top")
    own = ingest.extract_skills(profiles, "uid", "resume_text", F.col("industry"), lexicon).select("uid", "name")
    wanted = live.join(top.select("external_id").distinct(), "external_id", "left_semi").withColumn("_all", F.concat_ws("\n", "title", "description"))
    asked = ingest.extract_skills(wanted, "external_id", "_all", F.col("industry"), lexicon).select("external_id", "name")
    rows = top.join(asked, "external_id").join(own.withColumn("has", F.lit(True)), ["uid", "name"], "left")
    counts = rows.groupBy("uid", F.when(F.col("has"), "confirmed").otherwise("gap").alias("kind"), "name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("uid", "kind").orderBy(F.col("n").desc(), "name"))
    return counts.withColumn("_p", place).filter((F.col("_p") <= F.when(F.col("kind") == "gap", gaps).otherwise(confirmed))).drop("_p")


def enrich_saved(saved: DataFrame, postings: DataFrame) -> DataFrame:
    out = saved.join(postings.select("external_id", "title", "company", "is_active"), "external_id", "left")
    return out.withColumn("missing", F.col("title").isNull())


def ranking_vector(requests: DataFrame) -> DataFrame:
    """The query's vector if the query has two characters, else the résumé's, else none."""
    typed = F.when(F.length(F.trim("query")) >= 2, F.col("query_vector"))
    return requests.withColumn("vector", F.coalesce(typed, "resume_vector")).withColumn("mode", F.when(typed.isNotNull(), "query").when(F.col("resume_vector").isNotNull(), "resume").otherwise("browse"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def curated_first(curated: DataFrame, discovered: DataFrame, key: str = "label") -> DataFrame:
    """Both lists; of equal keys (ignoring case) the curated row stays."""
    both = curated.withColumn("_from", F.lit(0)).unionByName(discovered.withColumn("_from", F.lit(1)), allowMissingColumns=True).withColumn("_key", F.lower(key))
    return ranking.first_per_key(both, ["_key"], [F.col("_from"), F.col(key)]).drop("_from", "_key")


def probe_plan(seeds: DataFrame, adapters: list[str]) -> DataFrame:
    """company, adapter, slug, variant for every seed (column seed), slug variant and adapter."""
    ways = F.array(*[F.lit(a) for a in adapters])
    return seeds.select(F.col("seed").alias("company"), F.explode(ways).alias("adapter"), text.slug_variants(F.col("seed")).alias("slugs")).select("company", "adapter", F.posexplode("slugs").alias("variant", "slug"))


def verify_hits(probed: DataFrame) -> DataFrame:
    """Of landed answers (company, adapter, slug, variant, body; status, if there is one, must be 200) those that prove a board, the first variant of
    each company and adapter. A proof is a key or a count above 0 in the first bytes, or the character that the body begins with."""
    head = F.decode(F.substring(F.encode(F.coalesce("body", F.lit("")), "UTF-8"), 1, PROOF_BYTES), "ISO-8859-1")
    ok = F.lit(False)
    for adapter, key in PROOF_KEY.items():
        ok = ok | ((F.col("adapter") == adapter) & head.contains(f'"{key}"'))
    for adapter, starts in PROOF_START.items():
        ok = ok | ((F.col("adapter") == adapter) & F.substring(head, 1, 1).isin(*starts))
    for adapter, key in PROOF_COUNT.items():  # the first place of the key decides
        ok = ok | ((F.col("adapter") == adapter) & F.regexp_extract(head, f'(?s)"{key}":[ \t]*(.)', 1).rlike("[1-9]"))
    if "status" in probed.columns:
        ok = ok & F.coalesce(F.col("status") == 200, F.lit(False))
    return ranking.first_per_key(probed.filter(ok), ["company", "adapter"], [F.col("variant"), F.col("slug")]).select("company", "adapter", "slug")


def hits_by_adapter(hits: DataFrame, adapters: list[str]) -> DataFrame:
    dim = hits.sparkSession.createDataFrame([(a,) for a in adapters], "adapter string")
    return dim.join(hits.groupBy("adapter").agg(F.count("*").alias("k")), "adapter", "left").select("adapter", F.coalesce("k", F.lit(0)).alias("n"))


def discover_feeds(pages: DataFrame) -> DataFrame:
    """site, pattern, pages of sites whose job pages carry a posting: (site, url, html; seq, if there is one, is the order of a site's URLs). Of each
    site the first two job pages are looked at."""
    from hirelake.operators.stats import derive_url_patterns

    hinted = pages.filter(text.has_job_hint(F.col("url")))
    order = [F.col(x) for x in ("seq", "url") if x in hinted.columns]
    samples = ranking.top_n_per_group(hinted, ["site"], order, SAMPLES)
    proven = samples.filter(text.has_jobposting_jsonld(F.col("html"))).select("site").distinct()
    urls = hinted.join(proven, "site", "left_semi")
    return derive_url_patterns(urls.select("site", "url")).join(urls.groupBy("site").agg(F.count("*").alias("pages")), "site")


def migrate_profiles(raw: DataFrame) -> DataFrame:
    """Profiles from JSON (uid, body): missing or wrongly typed parts become empty."""
    empty = lambda kind: F.array().cast(kind)
    p = F.from_json("body", "resumeText string, skillVector array<double>, savedJobs array<string>, savedSearches array<struct<id string, query string>>, applications array<struct<jobId string, status string, appliedAt bigint>>")
    rows = raw.withColumn("p", p)
    return rows.select(
        "uid", F.coalesce("p.resumeText", F.lit("")).alias("resume_text"), F.coalesce("p.skillVector", empty("array<double>")).alias("skill_vector"), F.coalesce("p.savedJobs", empty("array<string>")).alias("saved_jobs"),
        F.coalesce("p.savedSearches", empty("array<struct<id string, query string>>")).alias("saved_searches"), F.coalesce("p.applications", empty("array<struct<jobId string, status string, appliedAt bigint>>")).alias("applications"),
    )


def assign_centroid(df: DataFrame, centroids: DataFrame, label: str = "industry", column: str = "vector") -> DataFrame:
    """``df`` with the label of the nearest centroid where its own is ``other``. There is one centroid for each label."""
    near = [(r[label], r["centroid"]) for r in centroids.collect()]  # one row for each of a closed set of labels
    scores = F.array(*[F.struct(ranking.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in v])).alias("s"), F.lit(name).alias("name")) for name, v in sorted(near)])
    return df.withColumn(label, F.when(F.col(label) == "other", F.array_max(scores)["name"]).otherwise(F.col(label)))


def ingest_counters(outcomes: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum((F.col("outcome") == k).cast("long")), F.lit(0)).alias(k)
    return outcomes.agg(n("ingested"), n("skipped"), n("failed"))


def read_crawl_log(df: DataFrame) -> DataFrame:
    """seq, ts, line of the log lines (seq, value) that are not empty; ts is null where a line does not begin with a time."""
    stamp = F.regexp_extract("value", r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})", 1)
    return df.filter("value <> ''").select("seq", F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm:ss")).alias("ts"), F.col("value").alias("line"))
