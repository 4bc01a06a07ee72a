"""Indexes over words: titles by token and position, and dictionaries of phrases that are joined with word n-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.operators.ranking import keyword_tokens, top_n_per_group
from hirelake.operators.tables import shared_path

#: Folders of an index.
BUCKETS = 64
#: A word, and what a text consists of: words and single other characters.
WORD, PIECE = r"\w+", r"\w+|\W"


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets))


def title_postings(df: DataFrame, id_col: str = "external_id", column: str = "title") -> DataFrame:
    """token, id, pos, before, after, first, last: one row for each word of a lower-case text, with what stands between it and its neighbours.
    A null text has no words."""
    low = F.lower(column)
    rows = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"), F.split(low, WORD, -1).alias("gaps"))
    each = rows.select("id", "gaps", F.size("words").alias("n"), F.posexplode("words").alias("pos", "token"))
    gap = lambda i: F.element_at("gaps", i)
    return each.select("token", "id", "pos", gap(F.col("pos") + 1).alias("before"), gap(F.col("pos") + 2).alias("after"), (F.col("pos") == 0).alias("first"), (F.col("pos") == F.col("n") - 1).alias("last"))


def write_title_index(df: DataFrame, path: str | None = None, id_col: str = "external_id", column: str = "title", buckets: int = BUCKETS) -> str:
    """Store the postings of all words by token: a folder for each hash of a token, sorted by token, so that a look-up reads the folders and row
    groups of its tokens. Adaptive execution evens out folders, so a frequent word is spread over several files. Returns the path."""
    path = path or shared_path(df.sparkSession, "titles")
    rows = title_postings(df, id_col, column).withColumn("bucket", _bucket(F.col("token"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").mode("overwrite").parquet(path)
    return path


def _phrase(text: str) -> tuple[list[str], list[str]] | None:
    """(words, gaps around and between them), or None for a phrase without a word."""
    words = re.findall(WORD, text, re.ASCII)
    return (words, re.split(WORD, text, flags=re.ASCII)) if words else None


def phrase_hits(index: DataFrame, phrases: list[str], buckets: int = BUCKETS) -> DataFrame:
    """token, id: index of each phrase in ``phrases`` (lower case) and the ids of the texts that hold it as whole words. Phrases have a word at least.

    The places of the words of a phrase meet at its first word's place; marks between, before and behind the words have to be the phrase's."""
    pos, steps = F.col("pos"), []
    for i, phrase in enumerate(phrases):
        words, gaps = _phrase(phrase)
        for j, word in enumerate(words):
            fits = F.col("token") == word
            if j:
                fits = fits & (F.col("before") == gaps[j])
            elif gaps[0]:
                fits = fits & F.col("before").endswith(gaps[0]) & ((F.length("before") > len(gaps[0])) | F.col("first"))
            if j == len(words) - 1 and gaps[-1]:
                fits = fits & F.col("after").startswith(gaps[-1]) & ((F.length("after") > len(gaps[-1])) | F.col("last"))
            steps.append(F.when(fits, F.struct(F.lit(i).alias("token"), (pos - j).alias("start"), F.lit(len(words)).alias("words"))))
    asked = sorted({w for p in phrases for w in _phrase(p)[0]})
    in_folder = F.lit(False)
    for word in asked:
        in_folder = in_folder | (F.col("bucket") == _bucket(F.lit(word), buckets))
    rows = index.filter(in_folder & F.col("token").isin(*asked))
    met = rows.select("id", F.explode(F.array_compact(F.array(*steps))).alias("s")).groupBy("id", "s.token", "s.start", "s.words").count()
    return met.filter(F.col("count") >= F.col("words")).select("token", "id").distinct()


def keyword_lookup(index: DataFrame, keywords: list[str], limit: int, id_col: str = "external_id", buckets: int = BUCKETS) -> DataFrame:
    """As :func:`ranking.keyword_pass`, from an index of titles: id and rank by token (longest first), then id. A keyword without a word finds nothing."""
    tokens = [t for t in keyword_tokens(keywords) if _phrase(t)]
    if not tokens:
        return index.select(F.col("id").alias(id_col), F.lit(0).alias("rank")).limit(0)
    each = max(20, -(-limit // len(keyword_tokens(keywords))))
    kept = top_n_per_group(phrase_hits(index, tokens, buckets), ["token"], [F.col("id")], each)
    first = kept.groupBy(F.col("id").alias(id_col)).agg(F.min("token").alias("token")).orderBy("token", id_col).limit(limit)  # at most five lists of ``each`` rows
    return first.withColumn("rank", F.row_number().over(Window.orderBy("token", id_col))).select(id_col, "rank")


def phrase_length(term: Column) -> Column:
    """Pieces of a lower-case phrase."""
    return F.size(F.regexp_extract_all(F.lower(term), F.lit(PIECE), F.lit(0)))


def phrase_grams(df: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """``df`` with ``gram``: one row for each different run of ``lengths`` pieces of the lower-case text. Runs begin and end where phrases can: not
    within a word, and marks at the rim of a run have no word character outside beside them."""
    pieces = F.regexp_extract_all(F.lower(column), F.lit(PIECE), F.lit(0))
    rows = df.withColumn("_p", pieces)
    word = lambda x: x.rlike(r"^\w")
    piece = lambda i: F.try_element_at("_p", i)

    def runs(n: int) -> Column:
        def run(i: Column) -> Column:
            at = i.cast("int")
            left = (at == 1) | word(piece(at)) | ~word(F.get("_p", at - 2))
            right = (at + n > F.size("_p")) | word(piece(at + n - 1)) | ~word(piece(at + n))
            return F.when(left & right, F.array_join(F.slice("_p", at, F.lit(n)), ""))

        return F.when(F.size("_p") >= n, F.transform(F.sequence(F.lit(1), F.size("_p") - n + 1), run)).otherwise(F.array().cast("array<string>"))

    if not lengths:
        return df.withColumn("gram", F.lit(None).cast("string")).limit(0)
    return rows.withColumn("gram", F.explode(F.array_distinct(F.array_compact(F.concat(*[runs(n) for n in lengths]))))).drop("_p")
