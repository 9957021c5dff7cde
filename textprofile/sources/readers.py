"""Readers for the corpora, lexicons, ARFF relations, attribute-named CSVs and
feature groups.  All reads are bulk DataFrame reads with explicit schemas; only
schema metadata (attribute lists, ARFF headers) is brought to the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import code_letter_flag, normalize_author_id, tokenize, yes_no_flag
from .writers import bucketed_name

# Trait columns of the two labelled corpora and the letters of
# the four-letter type code (position -> letter scored 1).
FIVE_TRAITS = ("EXT", "NEU", "AGR", "CON", "OPN")
FOUR_TRAITS = ("E", "N", "F", "J")
# Descriptive columns of the concept-affect lexicon, dropped.
AFFECT_DESCRIPTIVE = ("primary_mood", "secondary_mood", "polarity_label",
                      "semantics1", "semantics2", "semantics3", "semantics4", "semantics5")
CODE_LETTERS = (("E", 1), ("N", 2), ("F", 3), ("J", 4))

# One set of options for all CSV reads, the counterpart of ``writers.CSV_WRITE``:
# doubled quotes, quoted fields over several lines, no trimming.
_CSV = dict(header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_trait_corpus(spark: SparkSession, path: str, traits: Sequence[str] = FIVE_TRAITS) -> DataFrame:
    """Five-trait corpus: header skipped, columns by position (id, text, one
    ``y``/``n`` column per trait).  ``token_len`` is the whitespace token count.
    ``multiLine`` CSV files are read one task per file; a large corpus should
    be many files."""
    fields = [T.StructField("user", T.StringType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(f"_c_{t}", T.StringType()) for t in traits]
    df = spark.read.csv(path, schema=T.StructType(fields), **_CSV)
    return df.select("user", F.coalesce("text", F.lit("")).alias("text"),
                     F.size(tokenize(F.coalesce("text", F.lit("")))).alias("token_len"),
                     *[yes_no_flag(f"_c_{t}").alias(t) for t in traits])


def read_type_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Four-letter-type corpus: position 0 type code, 1 text, 3 user id."""
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("_unused", T.StringType()), T.StructField("user", T.StringType())])
    df = spark.read.csv(path, schema=schema, encoding="UTF-8", **_CSV)
    return df.select("user", F.coalesce("text", F.lit("")).alias("text"),
                     *[code_letter_flag("type", pos, letter).alias(letter) for letter, pos in CODE_LETTERS])


def read_posts(spark: SparkSession, path: str, ts_type: str = "decimal(38,9)", keep: Sequence[str] = ()) -> DataFrame:
    """Post log CSV with a header: ``author, body, created_utc`` (+ ``keep``
    columns, e.g. a post id for tie-breaking; other columns ignored).  Times
    are any numbers, whole or with a fraction, kept exactly."""
    df = spark.read.csv(path, **_CSV)
    return df.select("author", "body", F.col("created_utc").cast(ts_type).alias("created_utc"), *keep)


def posts_stream(spark: SparkSession, path: str, columns: Sequence[str] | None = None, keep: Mapping[str, str] | None = None,
                 ts_type: str = "decimal(38,9)", files_per_trigger: int = 64) -> DataFrame:
    """The post log's CSV files as a stream: ``author, body, created_utc`` and
    the ``keep`` columns (name -> type).  A stream needs its columns beforehand:
    ``columns`` in the files' order, or those in the header of what is there."""
    columns = list(columns or spark.read.csv(path, **_CSV).columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.readStream.schema(schema).options(**_CSV).option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return df.select("author", "body", F.col("created_utc").cast(ts_type).alias("created_utc"),
                     *[F.col(f"`{c}`").cast(t).alias(c) for c, t in (keep or {}).items()])


def read_lexicon(spark: SparkSession, path: str, fmt: str = "csv", key: str | None = None,
                 header: bool = True, key_out: str = "word") -> DataFrame:
    """Word lexicon: key column + numeric scores (strict cast under ANSI).

    ``fmt``: ``csv`` / ``tsv`` (header row; key column named ``key`` or the
    first column), ``csv_noheader`` (column 0 is the key, scores ``d0..dn``),
    ``parquet``."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        sep = "\t" if fmt == "tsv" else ","
        df = spark.read.csv(path, **{**_CSV, "sep": sep, "header": header and fmt != "csv_noheader"})
        if fmt == "csv_noheader":
            df = df.toDF("_key", *[f"d{i}" for i in range(len(df.columns) - 1)])
            key = "_key"
    key = key or df.columns[0]
    scores = [c for c in df.columns if c != key]
    return df.select(F.col(f"`{key}`").alias(key_out), *[F.col(f"`{c}`").cast("double").alias(c) for c in scores])


def read_concept_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Headerless concept-vector CSV -> ``(concept, vec array<double>)``."""
    lex = read_lexicon(spark, path, fmt="csv_noheader", key_out="concept")
    return lex.select("concept", F.array(*[c for c in lex.columns if c != "concept"]).alias("vec"))


def read_concept_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pre-processed corpus with text and concept bag (Parquet with
    ``#AUTHID string, TEXT string, concept_count array<struct<concept,count>>``)."""
    return spark.read.parquet(path).withColumnRenamed("#AUTHID", "author_id").withColumnRenamed("TEXT", "text")


def read_concept_affect(spark: SparkSession, path: str, fmt: str = "csv", key: str | None = None,
                        drop: Sequence[str] = AFFECT_DESCRIPTIVE) -> DataFrame:
    """Concept-affect lexicon ``(concept, affect values as double)``: the key is
    the column ``key`` or the first; the descriptive columns are dropped, the
    rest cast strictly."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, **_CSV)
    key = key or df.columns[0]
    return df.select(F.col(f"`{key}`").alias("concept"), *[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns
                                                          if c != key and c not in set(drop)])


# ---- ARFF ----------------------------------------------------------------------

def read_arff(spark: SparkSession, path: str, min_fields: int = 10, sort: bool = False) -> DataFrame:
    """ARFF relation -> ``idx bigint`` + one double column per attribute.

    Attribute names come from the ``@attribute`` lines (the type word stripped;
    a quoted name may hold spaces).  A folder may hold several relations: files
    that name attributes must name the same ones, and only the distinct headers
    reach the driver.  Data lines are every other line, but
    for ``%`` comments, with at least ``min_fields`` comma fields; the first field is an id such as
    ``'dir\\\\id_12'``; non-numeric cells become NULL."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    # headers stand at the files' starts: of later splits nothing is looked at
    head = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                        F.monotonically_increasing_id().alias("_no")) \
        .filter((F.col("_at") == 0) & F.lower(F.ltrim("value")).startswith("@attribute"))
    headers = head.groupBy("_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_no", "value"))),
                                                    lambda x: x["value"]).alias("h")).select("h").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"the relations in {path} name different attributes")
    names = [attribute_name(line.strip()[len("@attribute"):].strip()) for line in (headers[0]["h"] if headers else [])]
    if len(names) < 2:
        raise ValueError(f"no attributes found in {path}")
    fields = F.split("value", ",")
    data = lines.filter(~F.ltrim("value").rlike("^[@%]")).filter(F.size(fields) >= min_fields) \
        .select(fields.alias("_f"))
    cols = [normalize_author_id(F.col("_f")[0]).alias("idx")]
    cols += [F.trim(F.try_element_at("_f", F.lit(i + 1))).try_cast("double").alias(n)
             for i, n in enumerate(names) if i > 0]
    out = data.select(*cols)
    return out.orderBy("idx") if sort else out


# ---- headerless CSV named by an attribute list -------------------------------------

def attribute_name(declared: str) -> str:
    """The name in ``name type``; a quoted name may hold spaces."""
    for q in ("'", '"'):
        if declared.startswith(q) and q in declared[1:]:
            return declared[1:declared.index(q, 1)]
    return declared.split()[0]


def read_attribute_names(spark: SparkSession, attrs_path: str) -> list[tuple[str, str]]:
    """``name type`` lines -> [(name, type)]; a quoted name may hold spaces."""
    rows = spark.read.text(attrs_path).withColumn("_n", F.monotonically_increasing_id()) \
        .filter(F.trim("value") != "").orderBy("_n").collect()
    out = []
    for r in rows:
        line = r["value"].strip()
        out.append((attribute_name(line), line.rpartition(" ")[2].strip()))
    return out


def read_with_attributes(spark: SparkSession, data_path: str, attrs_path: str,
                         drop_attrs: Sequence[str] = (), drop_last: int = 0) -> DataFrame:
    """Headerless CSV whose columns are named by a separate attribute list.
    ``drop_attrs`` are removed from the list *and* from the data before
    naming (the data file does not hold them); then the last ``drop_last``
    columns are dropped.  ``string`` attributes stay text, others are double
    (invalid -> NULL)."""
    attrs = [(n, t) for n, t in read_attribute_names(spark, attrs_path) if n not in set(drop_attrs)]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(attrs))])
    raw = spark.read.csv(data_path, schema=schema, **{**_CSV, "header": False})
    cols = []
    for i, (n, t) in enumerate(attrs):
        c = F.col(f"_c{i}")
        cols.append((c if t == "string" else F.trim(c).try_cast("double")).alias(n))
    out = raw.select(*cols)
    if drop_last:
        out = out.select(*out.columns[:-drop_last])
    return out


# ---- feature groups --------------------------------------------------------------

def read_feature_group(spark: SparkSession, root: str, group: str, key: str = "author_id",
                       fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """One feature group written by ``write_features``; every non-key column
    is double.  Without ``multi_line`` a CSV file is read by many tasks; its ids
    then must hold no line break."""
    path = f"{root.rstrip('/')}/{group}"
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, **{**_CSV, "multiLine": multi_line})
    return df.select(F.col(f"`{key}`").alias("author_id"),
                     *[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns if c != key])


def load_feature_groups(spark: SparkSession, root: str, groups: Sequence[str], key: str = "author_id",
                        fmt: str = "csv", multi_line: bool = True) -> dict[str, DataFrame]:
    return {g: read_feature_group(spark, root, g, key, fmt, multi_line) for g in groups}


def open_bucketed(spark: SparkSession, root: str, groups: Sequence[str]) -> dict[str, DataFrame]:
    """Feature groups written by ``writers.write_bucketed``, by any session: the
    catalog learns their buckets from the line beside the data."""
    out = {}
    for g in groups:
        name = bucketed_name(root, g)
        if not spark.catalog.tableExists(name):
            said = spark.read.schema("buckets int, schema string").json(f"{root.rstrip('/')}/_{g}_buckets").first()
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(said["schema"])))
            place = f"{root.rstrip('/')}/{g}".replace("'", "\\'")
            spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (author_id) SORTED BY (author_id) "
                      f"INTO {said['buckets']} BUCKETS LOCATION '{place}'")
        out[g] = spark.table(name)
    return out


# ---- sub-document count lists ----------------------------------------------------

def read_count_list(spark: SparkSession, path: str, fmt: str = "lines") -> DataFrame:
    """Sub-document counts per document -> ``(doc_pos, n_chunks)``.

    ``lines``: text lines ``<first_doc_pos>\\t[c0, c1, ...]`` (a long list
    split over many lines/files with explicit offsets, read in parallel).
    ``single``: one bracketed list in one file (small corpora only: the whole
    list is one row)."""
    if fmt == "single":
        raw = spark.read.option("wholetext", "true").text(path)
        return raw.select(F.posexplode(F.from_json(F.trim("value"), "array<bigint>")).alias("doc_pos", "n_chunks")) \
            .select(F.col("doc_pos").cast("bigint"), "n_chunks")
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.split("value", "\t")
    rows = raw.select(parts[0].cast("bigint").alias("_off"), F.from_json(parts[1], "array<bigint>").alias("_c"))
    return rows.select(F.col("_off"), F.posexplode("_c").alias("_i", "n_chunks")) \
        .select((F.col("_off") + F.col("_i")).alias("doc_pos"), "n_chunks")
