"""Exact dedup by deterministic block naming, in DataFrame functions only.

Each normalised text is cut into blocks of a fixed number of code points. Sorting the distinct blocks
turns each into an integer name, its rank: that in its range of the order, after all ranges before. Names depend on the blocks alone, not on how
Spark deals them out. Adjacent names are then paired, the distinct pairs sorted and named in the same way, and so on, until each text has
one name. Two texts with equally many blocks have the same name exactly if they are equal: no step relies on a hash.

Before the naming stands an index: a text whose length and 64-bit hash occur once equals no other text and is its own identity, so only texts
that share both go through the naming. That is sound whatever the hash does: it can only let extra texts in.

Hot texts: a name is found by grouping distinct blocks (combined before the shuffle), and the joins that
bring names back read staged tables on both sides, so adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.shared import discard, staged, staged_alone, text_or_empty

#: Fixed value: what is deleted before texts are compared, ASCII white space.
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BLOCK_CHARS = 512
#: Distinct blocks or pairs in a range that one task ranks.
RANGE_ROWS = 1_000_000


def normalised(col: str):
    out = text_or_empty(col)
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _named(parts: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """``parts`` with an integer ``name`` for each distinct value of ``keys``: its rank in the order of hash, then content."""
    distinct = staged(parts.select(*keys).distinct().withColumn("h", F.xxhash64(*keys)), "distinct")
    ranges = max(1, -(-distinct.count() // RANGE_ROWS))
    dealt = distinct.withColumn("range", F.floor((F.col("h") / 2.0**64 + 0.5) * ranges))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", *keys))
    names = staged(dealt.withColumn("rank", rank).join(starts, "range").select(*keys, (F.col("start") + F.col("rank")).alias("name")), tag)
    discard(distinct)
    on = [parts[k].eqNullSafe(names[k]) if k == "right" else parts[k] == names[k] for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return parts.join(names, cond).select(*[parts[c] for c in parts.columns if c not in keys], names["name"])


def text_names(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``texts``: key (any type, unique, not null), norm. Returns key, n_blocks, name.

    An empty text has one empty block. ``(n_blocks, name)`` identifies a text without collisions.
    """
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    )
    blocks = texts.select("key", cut.alias("blocks")).select(
        "key", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block")
    )
    level = staged(_named(blocks, ["block"], "block-names"), "level")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done = [level.filter("n_blocks = 1").select("key", "n_blocks", "name")]
    width = 1
    while width < most:
        pairs = (
            level.filter(F.col("n_blocks") > width)
            .groupBy("key", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
            )
        )
        level = staged(_named(staged(pairs, "pairs"), ["left", "right"], "pair-names"), "level")
        width *= 2
        done.append(level.filter((F.col("n_blocks") <= width) & (F.col("n_blocks") > width // 2)).select("key", "n_blocks", "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chars, copies.

    Null and empty texts count as equal. Of equal texts the one with the most code points before
    normalisation stays, then the smallest id (a null id sorts first). Rows that repeat both id
    and text are ``copies`` of each other, of which exactly one is kept. Ids may repeat or be null. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    norm = normalised(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.char_length(text_or_empty(text_col)).cast("long").alias("n_chars"), norm.alias("norm"))
    heads = staged(
        rows.select("id", "n_chars", F.length("norm").alias("n_norm"), F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha")),
        "heads",
    )
    repeated = staged(heads.groupBy("n_norm", "h").count().filter("count > 1").select("n_norm", "h"), "repeated")
    # A row is known by its id and its text's digest; rows alike in these and in length are counted.
    shared = staged(heads.join(repeated, ["n_norm", "h"], "left_semi"), "shared")
    alone = heads.join(repeated, ["n_norm", "h"], "left_anti")
    key = F.struct("id", "sha")
    # One row per distinct id and text; the dictionary of texts to name is read from the corpus again.
    texts = (
        rows.withColumn("h", F.xxhash64("norm")).withColumn("n_norm", F.length("norm"))
        .join(repeated, ["n_norm", "h"], "left_semi")
        .select(F.struct("id", F.sha2("norm", 256).alias("sha")).alias("key"), "norm")
    )
    names = text_names(texts, block_chars).distinct()
    counted = shared.groupBy("id", "sha", "n_chars").count().withColumn("key", key)
    members = staged(
        counted.join(names, "key").select("id", "sha", "n_chars", F.col("count").alias("copies"), "n_blocks", "name"), "members"
    )
    groups = staged(
        members.groupBy("n_blocks", "name").agg(
            F.sum("copies").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("less"), "id")).alias("best")
        ),
        "groups",
    )
    ranked = members.join(groups, ["n_blocks", "name"]).withColumn(
        "best_row", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.less"))
    )
    in_groups = ranked.select(
        "id", F.col("best.id").alias("keep_id"), "group_size", "best_row", F.col("sha").alias("text_sha256"), "n_chars", "copies",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).select("id", "keep_id", "group_size", (F.col("best_row") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chars", "copies")
    one = F.lit(1).cast("long")
    unique = alone.select("id", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars", one.alias("copies"))
    return unique.unionByName(in_groups).withColumnRenamed("id", id_col)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df`` that :func:`exact_groups` keeps, with their columns as they are.

    Of rows that repeat both id and text but differ in other columns, the first by its columns written as JSON stays.
    """
    # A null id is left out of the key, so it differs from all ids.
    key = lambda i, sha, n: F.concat_ws(":", sha, n.cast("string"), i.cast("string")).alias("key")
    chars = F.char_length(text_or_empty(text_col)).cast("long")
    rows = df.select(F.struct("*").alias("row"), key(F.col(id_col), F.sha2(normalised(text_col), 256), chars))

    def found():
        groups = exact_groups(df.select(id_col, text_col), id_col, text_col, block_chars).filter("group_size > 1")
        return groups.groupBy(key(F.col(id_col), F.col("text_sha256"), F.col("n_chars"))).agg(F.max(F.col("kept").cast("int")).alias("keep"), F.max("copies").alias("copies"))

    marks = staged_alone(df.sparkSession, found, "marks")
    # A merge join whatever the number of copies, so that the plan is the same at every size.
    joined = rows.hint("merge").join(marks, "key", "left").filter("keep is null or keep = 1")
    if marks.filter("keep = 1 and copies > 1").isEmpty():
        return joined.select("row.*")
    twins = joined.filter("copies > 1").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return joined.filter("copies is null or copies = 1").select("row.*").unionByName(twins.select("row.*"))
