"""Most recent posts per author, joined in time order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cache import cached

# Fixed value: separator placed between an author's posts.
POST_JOIN = " ||| "


def latest_posts(posts: DataFrame, n: int, author: str = "author", ts: str = "created_utc",
                 tiebreak: str | None = None) -> DataFrame:
    """The rows of each author's ``n`` most recent posts.

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so at most ``n`` rows per author leave each map task:
    a prolific author cannot flood one reducer."""
    keys = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(author).orderBy(*keys)
    return posts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def join_posts(posts: DataFrame, author: str = "author", ts: str = "created_utc", body: str = "body",
               tiebreak: str | None = None, out_col: str = "text") -> DataFrame:
    """(author, text, n_posts): each author's posts, oldest first, joined with
    ``" ||| "``; the caller bounds their number."""
    fields = [F.col(ts).alias("t")] + ([F.col(tiebreak).alias("k")] if tiebreak else []) + [F.col(body).alias("b")]
    grouped = posts.groupBy(author).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_p"),
        F.count(F.lit(1)).alias("n_posts"))
    return grouped.select(author, F.concat_ws(POST_JOIN, F.transform("_p", lambda s: s["b"])).alias(out_col),
                          "n_posts")


def recent_posts(posts: DataFrame, n: int = 100, author: str = "author", ts: str = "created_utc",
                 body: str = "body", tiebreak: str | None = None, out_col: str = "text") -> DataFrame:
    """Keep each author's ``n`` most recent posts and join them, oldest first,
    with ``" ||| "``.  Equal timestamps are ordered by ``tiebreak`` (descending
    for recency, ascending in the output).  The collected list is bounded by
    ``n``."""
    return join_posts(latest_posts(posts, n, author, ts, tiebreak), author, ts, body, tiebreak, out_col)


def recent_posts_cached(spark: SparkSession, posts: DataFrame, cache_path: str,
                        refresh: bool = False, **kw) -> DataFrame:
    """Read-through cache: reuse the Parquet result at ``cache_path`` unless
    ``refresh`` is set; otherwise compute, write and read it back."""
    if not refresh:
        try:
            return spark.read.parquet(cache_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    recent_posts(posts, **kw).write.mode("overwrite").parquet(cache_path)
    return spark.read.parquet(cache_path)


def recent_posts_versioned(spark: SparkSession, posts: DataFrame, root: str, n: int = 100, **kw) -> DataFrame:
    """``recent_posts`` through a cache keyed by the files that ``posts`` reads
    and by the parameters: a changed, added or removed file, or another ``n``, is
    computed anew, and an interrupted write is never read."""
    return cached(spark, root, {"posts": posts}, {"n": n, "columns": posts.columns, **kw}, lambda: recent_posts(posts, n, **kw))
