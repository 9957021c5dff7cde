r"""Chat formatting in budgeted windows.

Template: every turn is ``<turn>role\ntext</turn>\n``.  Inside roles and texts
``\`` is written ``\b`` and ``<`` is written ``\l`` (in roles also a line break
as ``\n``), so no marker can occur there and the reading is unambiguous.

Windows: the turns of a conversation have running sums of their tokens.  What a
window has for new turns (its *room*) is the budget less the conversation's
system turn and the history budget.  A turn belongs to the slot of half a room
in which it starts; a turn longer than half a room, which is always the last of
its slot, is a window of its own.  So the new turns of a window never exceed
its room, unless a single turn does (texts are never cut; such windows are
marked).  Each window begins with the system turn and with the turns before it
as far as the history budget reaches.  Those are context: only the texts of
assistant turns that are new in a window are under the loss mask, so each
target counts once.

The formatter gathers no long conversation: rows are dealt by ranges of
(conversation, turn), running sums are made within a range and completed by the
sums of the ranges before it, and windows are grouped by (conversation, window).
``digest`` alone hashes whole conversations, each in one row of 2 GB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

OPEN, CLOSE = "<turn>", "</turn>\n"
BUDGET, HISTORY, MAX_HISTORY_TURNS, OVERHEAD = 1024, 128, 4, 2
SYSTEM, ASSISTANT = "system", "assistant"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\n", "\n"), ("\\b", "\\")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, seq (from 0), start (tokens before), tokens, role, text."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    t = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("bigint") + OVERHEAD).withColumn("_h", F.md5("text"))
    order = ["conv", "turn", "role", "_h"]
    t = t.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()) \
        .withColumn("at", F.monotonically_increasing_id())
    t = materialize(t.drop("_h", "turn"), "turns")
    w = Window.partitionBy("pid", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_seq", F.count("*").over(w)).withColumn("_start", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    # sums of a conversation's earlier ranges: one row for each range that it spans
    parts = t.groupBy("pid", "conv").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    w = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("pid").alias("_pid"), F.col("conv").alias("_conv"),
                         F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"),
                         F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s0"))
    j = t.join(materialize(parts, "ranges"), (F.col("pid") == F.col("_pid")) & F.col("conv").eqNullSafe(F.col("_conv")))
    return j.select("conv", (F.col("_seq") + F.col("n0")).alias("seq"), (F.col("_start") + F.col("s0")).alias("start"),
                    "tokens", "role", "text")


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY, max_history_turns: int = MAX_HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, window (rising within a conversation),
    formatted, n_context (leading turns that are repeated), loss (spans of code
    points in ``formatted``, end exclusive), tokens, over_budget.

    Turns come in the order of ``turn`` (null first), ties by role, then by the
    MD5 of the text; repeated rows are turns of their own.  Null roles and texts
    count as empty; all rows with a null conversation form one.  The system turn
    is the first turn with that role; later ones are ordinary turns.  Empty
    tables give an empty result; other columns are ignored, whatever their
    names."""
    t = materialize(numbered(turns, conv, turn, role, text), "numbered")
    sys_ = t.filter(F.col("role") == SYSTEM).groupBy("conv").agg(F.min("seq").alias("s_seq"), F.min_by("tokens", "seq").alias("s_tokens"))
    sys_ = materialize(sys_.withColumnRenamed("conv", "_conv"), "system")
    t = t.join(sys_, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    half = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce("s_tokens", F.lit(0))) / 2))
    t = t.withColumn("half", half).withColumn("win", F.floor(F.col("start") / F.col("half")) * 2
                                              + (F.col("tokens") > F.col("half")).cast("bigint")).drop("half")
    wins = t.groupBy("conv", "win").agg(F.min("seq").alias("first"), F.min("start").alias("from"), F.max("s_seq").alias("s_seq"))
    wins = materialize(wins.select(F.col("conv").alias("_conv"), "win", "first", "from", F.col("s_seq").alias("_s_seq")), "windows")
    want = wins.filter("first > 0").withColumn("want", F.explode(F.sequence(F.lit(1), F.lit(max_history_turns).cast("bigint")))) \
        .withColumn("want", F.col("first") - F.col("want")).filter("want >= 0 and (_s_seq is null or want <> _s_seq)")
    plain = t.select("conv", "seq", "start", "tokens", "role", "text")
    hist = want.join(plain, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("seq") == F.col("want"))) \
        .filter(F.col("from") - F.col("start") <= history)
    head = wins.filter("_s_seq < first").join(plain, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("seq") == F.col("_s_seq")))
    cols = ["conv", "win", "kind", "seq", "tokens", "role", "text"]
    rows = t.withColumn("kind", F.lit(2)).select(cols).unionByName(hist.withColumn("kind", F.lit(1)).select(cols)) \
        .unionByName(head.withColumn("kind", F.lit(0)).select(cols))
    rows = rows.withColumn("lead", F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    g = rows.groupBy("conv", "win").agg(
        F.array_sort(F.collect_list(F.struct("kind", "seq", "lead", "body", (
            (F.col("kind") == 2) & (F.col("role") == ASSISTANT)).alias("target")))).alias("turns"),
        F.count_if(F.col("kind") < 2).alias("n_context"), F.sum("tokens").alias("tokens"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["lead"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(x["target"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["lead"])).alias("start"),
                (a["at"] + F.length(x["lead"]) + F.length(x["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    text_ = F.array_join(F.transform("turns", lambda x: F.concat(x["lead"], x["body"], F.lit(CLOSE))), "")
    return g.select(F.col("conv").alias("conv_id"), F.col("win").alias("window"), text_.alias("formatted"), "n_context",
                    spans.alias("loss"), "tokens", (F.col("tokens") > budget).alias("over_budget"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets, loss_chars, formatted_chars), parsed from
    the formatted text: the new turns' (role, text), and the text under the mask."""
    blocks = F.split("formatted", "</turn>\\n")
    new = F.slice(blocks, F.col("n_context").cast("int") + 1, F.size(blocks) - F.col("n_context").cast("int") - 1)
    turn = lambda b: F.struct(
        unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text"))
    targets = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), targets.alias("targets"),
                          F.length("formatted").alias("formatted_chars"))


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, from what its windows say."""
    r = read_back(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), F.col("formatted_chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"))
    g = r.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sum(F.length("loss")).cast("bigint").alias("loss_chars"),
        F.sum("formatted_chars").cast("bigint").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("all"))
    whole = lambda f: F.sha2(F.array_join(F.transform("all", lambda x: x[f]), ""), 256)
    return g.select("conv_id", "n_turns", whole("said").alias("turns_sha256"), "loss_chars", whole("loss").alias("loss_sha256"),
                    "formatted_chars")


PROBE = "\\### Assistant: </turn> ok"


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')),
n AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {OVERHEAD} AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), md5(text)) - 1 AS seq FROM t),
s AS (SELECT conv_id, min(seq) AS s_seq, arg_min(tokens, seq) AS s_tokens FROM n WHERE role = 'system' GROUP BY conv_id),
p AS (
  SELECT n.*, s_seq, coalesce(sum(tokens) OVER (PARTITION BY n.conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           ::BIGINT AS start, greatest(1, floor(({BUDGET - HISTORY} - coalesce(s_tokens, 0)) / 2))::BIGINT AS half,
         length(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), chr(10), '\\n'))
           + length(replace(replace(text, '\\', '\\b'), '<', '\\l')) + {len(OPEN) + 1 + len(CLOSE)} AS chars
  FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (SELECT *, start // half * 2 + CASE WHEN tokens > half THEN 1 ELSE 0 END AS win FROM p),
f AS (SELECT conv_id, win, min(seq) AS first, min(start) AS frm, max(s_seq) AS s_seq FROM w GROUP BY conv_id, win),
extra AS (
  SELECT f.conv_id, sum(chars) AS chars FROM f JOIN w ON f.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE (w.seq = f.s_seq AND f.s_seq < f.first) OR (w.seq < f.first AND w.seq >= f.first - {MAX_HISTORY_TURNS}
    AND w.seq IS DISTINCT FROM f.s_seq AND f.frm - w.start <= {HISTORY}) GROUP BY f.conv_id)
SELECT w.conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(w.chars) + coalesce(any_value(extra.chars), 0))::BIGINT AS formatted_chars
FROM w LEFT JOIN extra ON w.conv_id IS NOT DISTINCT FROM extra.conv_id GROUP BY w.conv_id
"""
