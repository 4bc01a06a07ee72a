"""Windows, top-k, fusion and search over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import pay, rules
from hirelake.operators import nearest
from hirelake.operators.filters import SearchFilter, live_country
from hirelake.operators.tables import kept

#: Rank constant of reciprocal rank fusion, score of hits found by keyword alone.
RRF_K = 60
KEYWORD_SCORE = 0.55
SORTS = {"posted_desc": ("posted_at", False), "posted_asc": ("posted_at", True), "scraped_desc": ("scraped_at", False)}


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms; 0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Spark keeps only ``n`` rows of a key in each task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n_per_group(df, keys, order, 1)


def vector_topk(df: DataFrame, vector: list[float], k: int, column: str = "vector", id_col: str = "external_id") -> DataFrame:
    """The ``k`` rows nearest to ``vector``; ties by id. Each task keeps k rows before they meet."""
    return df.withColumn("score", cosine(F.col(column), _literal(vector))).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def batch_topk(queries: DataFrame, df: DataFrame, k: int, query_id: str, query_vector: str, id_col: str, column: str = "vector") -> DataFrame:
    """``k`` nearest rows for each of a stated set of queries with different ids; ties by id. Every query meets every different vector, in blocks. Rows
    with equal vectors have equal scores, so they are scored once, and no more than the ``k`` least ids of them are looked at."""
    c = F.col
    rows = df.select(c(id_col).alias("_id"), c(column).alias("vector"), nearest.class_of(df, column).alias("class"))
    members = kept(rows.select("class", "_id").withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy("_id"))).filter(c("_n") <= k), "members")
    classes = kept(rows.select("class", "vector").dropDuplicates(), "classes")
    asked = kept(queries.select(c(query_id).alias("query"), c(query_vector).alias("vector")), "asked")
    scores = nearest.best_classes(asked, classes, k).join(members.filter("_n = 1").select("class", c("_id").alias("_first")), "class")
    best = top_n_per_group(scores, ["query"], [c("score").desc(), c("_first")], k)
    found = top_n_per_group(best.select("query", "class", "score").join(members, "class"), ["query"], [c("score").desc(), c("_id")], k)
    return found.select(c("query").alias(query_id), c("_id").alias(id_col), "score")


def quantised_topk(df: DataFrame, vector: list[float], k: int, column: str = "vector", id_col: str = "external_id", oversample: float = 2.0, quantile: float = 0.99) -> DataFrame:
    """Top k by 8-bit dot product of unit vectors with oversampling, then rescored at full precision. The scale is set by the ``quantile`` of the absolute values; what exceeds it is clipped."""
    unit = F.transform(column, lambda x: x.cast("double") / F.greatest(F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))), F.lit(1e-300)))
    df = df.withColumn("_unit", unit)
    most = df.select(F.explode("_unit").alias("x")).agg(F.percentile_approx(F.abs("x"), F.lit(quantile), F.lit(10_000))).first()[0] or 1.0
    size = max(sum(x * x for x in vector) ** 0.5, 1e-300)
    scale = 127.0 / most
    small = F.transform("_unit", lambda x: F.round(F.greatest(F.lit(-most), F.least(F.lit(most), x)) * scale).cast("tinyint"))
    asked = F.array(*[F.lit(max(-127, min(127, round(x / size * scale)))) for x in vector])
    dot = F.aggregate(F.zip_with(small, asked, lambda a, b: a.cast("int") * b), F.lit(0).cast("long"), lambda s, x: s + x)
    pool = df.withColumn("_dot", dot).orderBy(F.col("_dot").desc(), F.col(id_col)).limit(int(k * oversample))
    return vector_topk(pool.drop("_dot", "_unit"), vector, k, column, id_col)


def rrf_fuse(a: DataFrame, b: DataFrame, id_col: str = "external_id", k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over two rankings (id, rank from 1)."""
    one = lambda d, name: d.select(id_col, F.col("rank").alias(name))
    both = one(a, "vector_rank").join(one(b, "keyword_rank"), id_col, "full")
    share = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("fused", share("vector_rank") + share("keyword_rank"))


def keyword_tokens(keywords: list[str]) -> list[str]:
    kept = dict.fromkeys(w for w in (k.strip().lower() for k in keywords) if len(w) >= 2)
    return sorted(kept, key=lambda w: -len(w))[:5]


def keyword_pass(df: DataFrame, keywords: list[str], limit: int, id_col: str = "external_id") -> DataFrame:
    """Postings whose title holds a keyword as a phrase; ranked by token (longest first), then id."""
    tokens = keyword_tokens(keywords)
    if not tokens:
        return df.limit(0).select(id_col).withColumn("rank", F.lit(0))
    each = max(20, -(-limit // len(tokens)))
    low, escape = F.lower("title"), lambda t: "".join(c if c.isalnum() or c == " " else "\\" + c for c in t)
    hits = F.filter(F.array(*[F.when(low.rlike(rf"(?<!\w){escape(t)}(?!\w)"), i) for i, t in enumerate(tokens)]), lambda x: x.isNotNull())
    found = df.select(id_col, F.explode(hits).alias("token"))
    kept = top_n_per_group(found, ["token"], [F.col(id_col)], each)
    first = kept.groupBy(id_col).agg(F.min("token").alias("token"))
    ranked = first.orderBy("token", id_col).limit(limit)  # at most five lists of ``each`` rows
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("token", id_col))).select(id_col, "rank")


def paginate(df: DataFrame, order: list[Column], k: int = 25, offset: int = 0) -> DataFrame:
    """One page with ``total``, the size of the whole set. The page is cut by an ordered limit, so only its rows are gathered."""
    page = df.orderBy(*order).offset(offset).limit(min(k, 200))
    return page.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def candidates(k: int, search: SearchFilter) -> int:
    """How many candidates each pass of a search takes: 5 k from 200 to 300 if a filter is applied after it, else 2 k from 100 to 200."""
    late = search.experience_level or search.country or search.location or search.company or search.require_salary or search.salary_min_usd is not None or search.salary_max_usd is not None or search.max_age_days is not None
    return min(300, max(5 * k, 200)) if late else min(200, max(2 * k, 100))


def hybrid_search(df: DataFrame, vector: list[float], keywords: list[str], search: SearchFilter, as_of: str, k: int = 25, offset: int = 0, pool: int | None = None) -> DataFrame:
    """Vector and keyword passes over the filtered postings, fused; quality is computed and country and level are told anew for the page alone (a country
    that the location does not tell stays as stored; a level that is not told is null). ``pool``: candidates of each pass."""
    pool = pool or candidates(k, search)
    base = search.apply(df, as_of)
    near = kept(vector_topk(base.select("external_id", "vector"), vector, pool).select("external_id", "score"), "near")  # read three times, found once
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "external_id")))  # ``pool`` rows
    fused = kept(rrf_fuse(ranked, keyword_pass(base, keywords, pool)).join(ranked.select("external_id", "score"), "external_id", "left"), "fused")
    page = paginate(fused.withColumn("score", F.coalesce("score", F.lit(KEYWORD_SCORE))), [F.col("fused").desc(), F.col("external_id")], k, offset)
    hits = page.join(base.drop("vector"), "external_id")
    told = rules.classify_title_or_body(F.col("title"), F.col("description"), F.col("industry"))
    hits = hits.withColumns({"country": live_country(), "experience_level": told})
    return pay.with_quality(hits, as_of).orderBy(F.col("fused").desc(), "external_id")


def _numbered(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """``df`` in the order of ``keys`` as a stored table with ``part`` and ``at``: its range of the order, and the row's place there from 0.
    Ranges are cut by rows, so equal leading keys are spread over as many ranges as they fill."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return kept(ordered, tag).withColumn("part", F.shiftright("_id", 33)).withColumn("at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def interleaved(df: DataFrame, stamp: Column, ascending: bool = False) -> DataFrame:
    """``df`` with ``place``, the position in browsing order: by day of ``stamp``, days without one last; within a day companies take turns, in the
    order in which they first appear (by stamp, then id). Ids are unique.

    Nothing is ranked in one task: rows are put in order by ranges, and a count for each range (and company of a day in it) is carried on to
    the ranges behind. First by day, company and stamp, which tells the turn of each row; then by day, turn and company, which tells its place."""
    c = F.col
    company = F.coalesce(F.nullif(c("company"), F.lit("")), F.lit("__unknown__"))
    sign = 1 if ascending else -1
    at = stamp.cast("timestamp")
    day = F.coalesce(sign * F.datediff(F.to_date(stamp), F.lit("1970-01-01").cast("date")), F.lit((1 << 31) - 1))
    rows = df.select("external_id", day.alias("day"), company.alias("company"), F.coalesce(sign * F.unix_micros(at), F.lit(0)).alias("stamp"))
    rows = kept(rows, "browsed")  # putting rows in order reads them twice
    ordered = _numbered(rows, ["day", "company", "stamp", "external_id"], "turns")
    heads = ordered.groupBy("day", "company", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"), F.min(F.struct("stamp", "external_id")).alias("head"))
    own = Window.partitionBy("day", "company").orderBy("part")  # one row for each range that a company's day reaches
    carried = heads.select("day", "company", "part", "low", F.first("head").over(own).alias("head"), (F.sum("n").over(own) - c("n")).alias("before"))
    turns = ordered.join(carried, ["day", "company", "part"]).select("external_id", "day", (c("at") - c("low") + c("before")).alias("turn"), c("head.stamp").alias("first"), c("head.external_id").alias("head"))
    placed = _numbered(turns, ["day", "turn", "first", "head"], "places")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    offset = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - c("n")).alias("offset"))  # one row for each range
    place = placed.join(offset, "part").select("external_id", (c("offset") + c("at") + 1).alias("place"))
    return df.join(place, "external_id").select(*df.columns, "place")


def browse(df: DataFrame, search: SearchFilter, as_of: str, sort: str = "posted_desc") -> DataFrame:
    """Filtered postings with their place in browsing order. A posting without a posted date stands at its scraped date."""
    column, ascending = SORTS[sort]
    return interleaved(search.apply(df, as_of), F.coalesce(column, "scraped_at"), ascending)


def greedy_pairs(scores: DataFrame, k: int = 4) -> DataFrame:
    """match, i, j, score: up to ``k`` pairs of each match by falling score, no i or j twice; ties by i, then j.

    At most k - 1 partners of an i or j are taken before it, so its pair is among its k best, by row and then by column. With k cells left
    to each, a pair taken rules out 2 k - 1 cells, so all k are among the best (k - 1)(2 k - 1) + 1 of the match: a short list that is walked once.
    """
    order = [F.col("score").desc(), F.col("i"), F.col("j")]
    cells = scores.filter("score is not null").groupBy("match", "i", "j").agg(F.max("score").alias("score"))
    for keys, n in ((["match", "i"], k), (["match", "j"], k), (["match"], (k - 1) * (2 * k - 1) + 1)):
        cells = top_n_per_group(cells, keys, order, n)
    cell = F.struct((-F.col("score")).alias("less"), "i", "j")
    listed = cells.groupBy("match").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    free = lambda taken, x: (F.size(taken) < k) & ~F.exists(taken, lambda t: (t["i"] == x["i"]) | (t["j"] == x["j"]))
    none = F.slice("cells", 1, 0)
    picked = F.aggregate("cells", none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return listed.select("match", F.explode(picked).alias("p")).select("match", "p.i", "p.j", F.round(-F.col("p.less"), 3).alias("score"))
