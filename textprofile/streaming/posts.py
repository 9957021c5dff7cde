"""The most recent posts of every author, kept up to date from a stream.

The state is a table of at most ``n`` posts an author, in versions numbered by
micro-batch.  A batch and the last version before it are cut to the ``n`` newest
posts an author (first in each task, before the shuffle, so a prolific author
floods none) and written as the version of the batch's number.  Posts may come
late and in any order: only their times count.

A replayed batch starts from the same earlier version and replaces its own, so
it changes nothing; a version counts once its write was committed.  Two versions
are kept, as only the last batch can be replayed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.posts import join_posts, latest_posts
from ..sources.readers import posts_stream


class RecentPostsState:
    """Versions of the state below ``root``.  Equal times are ordered by
    ``tiebreak`` and, without one, by the post's text."""

    def __init__(self, spark: SparkSession, root: str, n: int = 100, author: str = "author", ts: str = "created_utc",
                 body: str = "body", tiebreak: str | None = None):
        self.spark, self.root, self.n = spark, root.rstrip("/"), n
        self.author, self.ts, self.body, self.tiebreak = author, ts, body, tiebreak or body

    def _files(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        fs, root = self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(v[1:]) for v in found if v.startswith("v") and v[1:].isdigit() and fs.exists(path(f"{self.root}/{v}/_SUCCESS")))

    def _at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Write version ``batch_id``: the newest posts of the version before it
        and of the batch."""
        cols = list(dict.fromkeys([self.author, self.ts, self.tiebreak, self.body]))
        before = [v for v in self.versions() if v < batch_id]
        posts = batch.select(*cols)
        if before:
            posts = posts.unionByName(self._at(before[-1]))
        # one shuffle: each task cuts what it has read to n posts an author before it
        posts = self._latest(posts)
        posts.write.mode("overwrite").parquet(f"{self.root}/v{batch_id}")
        fs, _ = self._files()
        for v in before[:-1]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{v}"), True)

    def _latest(self, posts: DataFrame) -> DataFrame:
        return latest_posts(posts, self.n, self.author, self.ts, self.tiebreak)

    def posts(self) -> DataFrame | None:
        """The rows of the last version; None before the first batch."""
        v = self.versions()
        return self._at(v[-1]) if v else None

    def texts(self, out_col: str = "text") -> DataFrame:
        """(author, text, n_posts) of the last version."""
        posts = self.posts()
        if posts is None:
            raise ValueError(f"no batch has been merged below {self.root}")
        return join_posts(posts, self.author, self.ts, self.body, self.tiebreak, out_col)


def stream_recent_posts(spark: SparkSession, path: str, state: RecentPostsState, checkpoint: str, columns: Sequence[str] | None = None,
                        keep: Mapping[str, str] | None = None, ts_type: str = "decimal(38,9)", files_per_trigger: int = 64,
                        available_now: bool = True):
    """Feed the post log's CSV files below ``path`` to ``state``, new files as
    they arrive; with ``available_now`` those that are there, and stop."""
    posts = posts_stream(spark, path, columns, keep, ts_type, files_per_trigger)
    w = posts.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
    return q
