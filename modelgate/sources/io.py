"""Readers and writers: raw files, snapshots, split tables, evaluation
tables, JSON records and hand-off packets.

Writes are parquet/JSON under a caller-given base path (shared storage on a
cluster). Reads are schema-on-read with explicit schemas, so no job ever
infers types from data.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.functions.text import strip_text
from modelgate.schema import CSV_NA_TOKENS, RAW_COLUMNS

MANIFEST_DDL = "name string, path string, record_count bigint, pulled_at timestamp, source string"


# ---------------------------------------------------------------------------
# A1/A3: raw delimited files
# ---------------------------------------------------------------------------
def na_to_null(c: Column) -> Column:
    """Tokens a delimited-file reader treats as missing ('', 'NA', 'n/a',
    'null', 'NaN', ...) become null."""
    return F.when(c.isin(CSV_NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", recursive: bool = True) -> DataFrame:
    """Raw transactions from every file under ``path`` (all strings).

    Unlike a "first file in the folder" reader this reads all files, so a
    dataset split into many parts is read whole. ``remaining_lease`` may be
    absent in the files; it is then absent in the result.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if fmt == "csv":
        df = reader.option("header", "true").option("emptyValue", "") \
            .option("mode", "PERMISSIVE").csv(path)
        df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    else:
        df = reader.format(fmt).load(path)
    present = [c for c in RAW_COLUMNS if c in df.columns]
    return df.select(*[na_to_null(F.col(c).cast("string")).alias(c) for c in present])


def write_raw_csv(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c).cast("string") for c in df.columns]).write.mode("overwrite").option("header", "true").csv(path)


# ---------------------------------------------------------------------------
# A2: snapshots with a manifest
# ---------------------------------------------------------------------------
def latest_snapshot(manifest: DataFrame, name: str) -> DataFrame:
    """Latest manifest row of ``name`` by ``pulled_at``."""
    return manifest.where(F.col("name") == name).groupBy("name").agg(
        F.max_by(F.struct("path", "record_count", "pulled_at", "source"), "pulled_at").alias("s")
    ).select("name", "s.*")


def materialize_snapshot(
    spark: SparkSession, raw: DataFrame, base: str, name: str, source: str, pulled_at: Column | None = None,
    force: bool = False,
) -> DataFrame:
    """Write ``raw`` as snapshot ``name`` and commit a manifest row whose
    ``record_count`` is read from the written data; reuse the latest
    existing snapshot unless ``force``. Returns the manifest row.

    A manifest row is written to a folder of its own under ``pending`` and
    then renamed into the manifest, so a reader sees the whole row or none. Rows
    are numbered per name: of two writers that saw the same newest number, the
    first to rename has the next one; the other finds the place taken and,
    unless ``force``, returns the winner's snapshot (with ``force`` it takes
    the number after it). Folders that lost or were torn are no part of the
    manifest."""
    manifest_path = os.path.join(base, "manifest")
    if not force:
        existing = latest_snapshot(read_manifest(spark, manifest_path), name)
        if existing.limit(1).count() > 0:
            return existing
    taken = _commits(spark, manifest_path, name)
    path = os.path.join(base, "snapshots", name, uuid.uuid4().hex)
    raw.write.mode("overwrite").parquet(path)
    count = spark.read.parquet(path).count()
    stamp = pulled_at if pulled_at is not None else F.current_timestamp()
    row = spark.range(1).select(
        F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(count).cast("bigint").alias("record_count"),
        stamp.cast("timestamp").alias("pulled_at"), F.lit(source).alias("source"),
    )
    pending = os.path.join(base, "pending", uuid.uuid4().hex)
    row.coalesce(1).write.parquet(pending)
    number = taken
    while not _rename_into(spark, pending, os.path.join(manifest_path, f"{_quoted_name(name)}-{number:08d}")):
        if not force:
            break
        number += 1
    return latest_snapshot(read_manifest(spark, manifest_path), name)


def read_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    """All committed manifest rows."""
    if not path_exists(spark, manifest_path):
        return spark.createDataFrame([], MANIFEST_DDL)
    return spark.read.schema(MANIFEST_DDL).option("recursiveFileLookup", "true").parquet(manifest_path)


def _quoted_name(name: str) -> str:
    """A snapshot's name as a folder name: one name for each, and no separators in it."""
    from urllib.parse import quote

    return quote(name, safe="").replace("-", "%2D").replace(".", "%2E").replace("_", "%5F")


def _commits(spark: SparkSession, manifest_path: str, name: str) -> int:
    """The number after the newest committed one of ``name``."""
    if not path_exists(spark, manifest_path):
        return 0
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(manifest_path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    own = [f.getPath().getName().rsplit("-", 1) for f in files]
    return max((int(n[1]) + 1 for n in own if len(n) == 2 and n[0] == _quoted_name(name)), default=0)


def _rename_into(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a place that must be free; False when it is taken.
    (A rename onto a folder would move the source into it, and a second writer
    can come between a test and the rename: the place is claimed by creating
    a file without overwriting, which one writer only can do.)"""
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    claim = jvm.org.apache.hadoop.fs.Path(os.path.join(os.path.dirname(os.path.dirname(target)), "claims", os.path.basename(target)))
    files = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.create(claim, False).close()
    except Exception:  # noqa: BLE001 - the claim exists (py4j wraps the file system's own error)
        if not files.exists(claim):
            raise
        return False
    files.mkdirs(dst.getParent())
    return files.rename(src, dst)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster's file system (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---------------------------------------------------------------------------
# A4/A5/A6: split and evaluation tables
# ---------------------------------------------------------------------------
def persist_splits(split_df: DataFrame, summary: DataFrame | None, path: str) -> dict[str, str]:
    """Rows partitioned by ``split`` (readers prune to one split) plus the
    summary as JSON; without one it is taken from the written rows, so that
    their source is read once."""
    from modelgate.operators.splits import split_summary

    rows = os.path.join(path, "rows")
    summ = os.path.join(path, "split_summary")
    split_df.write.mode("overwrite").partitionBy("split").parquet(rows)
    if summary is None:
        summary = split_summary(split_df.sparkSession.read.parquet(rows))
    summary.coalesce(1).write.mode("overwrite").json(summ)
    return {"rows": rows, "summary": summ}


def read_split(spark: SparkSession, rows_path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(rows_path)
    return df if split is None else df.where(F.col("split") == split)


#: Rows a file of the evaluation tables holds, about.
EVALUATION_FILE_ROWS = 5_000_000


def persist_evaluation(
    scored: DataFrame, overall: DataFrame, segments: DataFrame, path: str, file_rows: int = EVALUATION_FILE_ROWS
) -> dict[str, str]:
    """Scored rows, overall metrics and segment tables, laid out by size: rows
    are spread by ranges of (model, version, split) into files of about
    ``file_rows`` rows, sorted by these columns, so that a reader of one version
    skips the other files by their statistics. The number of files follows
    the rows: a fleet of many versions makes no more of them, and a version
    of many rows is spread over several (by a hash of its rows within the version)."""
    out = {}
    for name, df in (("scored", scored), ("overall", overall), ("segments", segments)):
        p = os.path.join(path, name)
        by = [F.col(c) for c in ("model_name", "model_version", "split") if c in df.columns]
        files = max(1, -(-df.count() // file_rows))
        spread = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
        ranged = df.withColumn("__spread", spread).repartitionByRange(files, *by, F.col("__spread")).drop("__spread")
        ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(p)
        out[name] = p
    return out


SEGMENT_TABLE_DDL = (
    "model_name string, model_version string, segment_column string, segment string, count bigint, "
    "rmse double, mae double, mean_actual double, mean_prediction double"
)


def load_segments(spark: SparkSession, path: str, segment_columns, required: bool = False) -> DataFrame:
    """Segment tables for the wanted columns. With ``required``, missing
    columns raise an error naming them (checked on the distinct column
    names only)."""
    df = spark.read.schema(SEGMENT_TABLE_DDL).parquet(path).where(F.col("segment_column").isin(list(segment_columns)))
    if required:
        present = {r[0] for r in df.select("segment_column").distinct().collect()}
        missing = [c for c in segment_columns if c not in present]
        if missing:
            raise ValueError(f"Required segment metrics are missing for: {', '.join(missing)}")
    return df


# ---------------------------------------------------------------------------
# A7/A8: rows <-> JSON records
# ---------------------------------------------------------------------------
def _json_safe(c: Column, kind: T.DataType, infinities: str) -> Column:
    """A value made JSON-safe at any depth: NaN -> null, infinities by choice, dates and times ->
    ISO text, map keys -> text."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bad = F.isnan(c) if infinities == "keep" else F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(~bad, c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # isoformat(): the fraction is printed only when it is not zero
        micros = F.date_format(c, "SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.StructType):
        fields = [_json_safe(c.getField(f.name), f.dataType, infinities).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _json_safe(x, kind.elementType, infinities))
    if isinstance(kind, T.MapType):
        texts = F.transform_keys(c, lambda k, _: _json_safe(k, kind.keyType, infinities).cast("string"))
        return F.transform_values(texts, lambda _, v: _json_safe(v, kind.valueType, infinities))
    return c


def json_safe(df: DataFrame, infinities: str = "null") -> list[Column]:
    """Columns made JSON-safe, structs, arrays and maps included. Strict JSON
    has no infinities, so by default they become null like NaN; ``"keep"``
    leaves them, and Spark writes the texts "Infinity" and "-Infinity", which
    its own reader takes back as numbers."""
    if infinities not in ("null", "keep"):
        raise ValueError(f"infinities must be 'null' or 'keep', not {infinities!r}")
    return [_json_safe(F.col(f"`{f.name}`"), f.dataType, infinities).alias(f.name) for f in df.schema.fields]


def rows_to_json(df: DataFrame, keep: list[str] | None = None, infinities: str = "null") -> DataFrame:
    """One JSON record per row (``record``), optionally keeping key columns."""
    keep = keep or []
    return df.select(*keep, F.to_json(F.struct(*json_safe(df, infinities)), {"ignoreNullFields": "false"}).alias("record"))


def json_to_rows(df: DataFrame, column: str, schema: str | T.DataType, keep: list[str] | None = None) -> DataFrame:
    """Parse JSON records (one object, or an array of objects) back to typed
    columns; unparseable records give null fields."""
    keep = keep or []
    dtype = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if isinstance(dtype, T.ArrayType):
        return df.select(*keep, F.inline(F.coalesce(F.from_json(F.col(column), dtype), F.array().cast(dtype))))
    return df.select(*keep, F.from_json(F.col(column), dtype).alias("__r")).select(*keep, "__r.*")


# ---------------------------------------------------------------------------
# A9/A10: hand-off packets
# ---------------------------------------------------------------------------
HANDOFF_SOURCE = "policy_gate"

#: Packets written before ``created_at`` and the fields after it existed have
#: none of them: they read as null.
HANDOFF_DDL = (
    "model_name string, model_version string, status string, "
    "created_at timestamp, source string, execution_id string, "
    "registration struct<model_name:string,model_version:string,run_id:string>, "
    "champion_info struct<has_champion:boolean,model_version:string,run_id:string,metrics:struct<rmse:double,mae:double>>, "
    "candidate_metrics struct<rmse:double,mae:double>, "
    "comparison struct<has_champion:boolean,champion_version:string,champion_metrics:struct<rmse:double,mae:double>,"
    "metric_deltas:map<string,double>>, "
    "drift_report struct<overall_drift_detected:boolean,column_results:array<struct<column:string,drift_type:string,"
    "statistic:double,threshold:double,p_value:double,is_drifted:boolean>>>, "
    "policy_verdict struct<decision:string,reasons:array<string>,checks_passed:array<string>,checks_failed:array<string>>"
)


def handoff_rows(
    verdicts: DataFrame, created_at: Column | None = None, source: str = HANDOFF_SOURCE, execution_id: str | None = None
) -> DataFrame:
    """One nested evidence row per gated version. Segment deltas and segment metrics travel
    as their own tables: their number is not bounded by configuration.
    ``run_id`` and ``champion_run_id`` are carried when ``verdicts`` has them."""
    given = lambda c: F.col(c) if c in verdicts.columns else F.lit(None).cast("string")
    champ = F.when(F.col("has_champion"), F.struct(F.col("champion_rmse").alias("rmse"), F.col("champion_mae").alias("mae")))
    deltas = F.when(
        F.col("has_champion"),
        F.create_map(F.lit("rmse_delta"), F.col("rmse_delta"), F.lit("rmse_delta_pct"), F.col("rmse_delta_pct"),
                     F.lit("mae_delta"), F.col("mae_delta"), F.lit("mae_delta_pct"), F.col("mae_delta_pct")),
    ).otherwise(F.create_map().cast("map<string,double>"))
    drift = F.when(F.coalesce(F.col("has_drift_report"), F.lit(False)),
                   F.struct(F.col("overall_drift_detected").alias("overall_drift_detected"), F.col("column_results").alias("column_results")))
    return verdicts.select(
        "model_name", "model_version", "status",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(source).alias("source"), F.lit(execution_id).cast("string").alias("execution_id"),
        F.struct("model_name", "model_version", given("run_id").alias("run_id")).alias("registration"),
        F.struct(F.col("has_champion").alias("has_champion"), F.col("champion_version").alias("model_version"),
                 given("champion_run_id").alias("run_id"), champ.alias("metrics")).alias("champion_info"),
        F.struct(F.col("rmse").alias("rmse"), F.col("mae").alias("mae")).alias("candidate_metrics"),
        F.struct(F.col("has_champion").alias("has_champion"), F.col("champion_version").alias("champion_version"),
                 champ.alias("champion_metrics"), deltas.alias("metric_deltas")).alias("comparison"),
        drift.alias("drift_report"),
        F.struct("decision", "reasons", "checks_passed", "checks_failed").alias("policy_verdict"),
    )


def write_handoff(
    verdicts: DataFrame, segment_deltas: DataFrame, path: str, segments: DataFrame | None = None, **about
) -> dict[str, str]:
    """Packets, segment deltas and (with ``segments``) the candidates' segment
    metrics as JSON tables; ``about`` goes to ``handoff_rows``."""
    paths = {"packets": os.path.join(path, "review_handoff"), "segment_deltas": os.path.join(path, "segment_deltas")}
    handoff_rows(verdicts, **about).write.mode("overwrite").json(paths["packets"])
    segment_deltas.drop("ord").write.mode("overwrite").json(paths["segment_deltas"])
    if segments is not None:
        paths["segment_metrics"] = os.path.join(path, "segment_metrics")
        own = segments.join(verdicts.select("model_name", "model_version").distinct(), ["model_name", "model_version"], "left_semi")
        own.write.mode("overwrite").json(paths["segment_metrics"])
    return paths


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """Typed hand-off rows by schema-on-read (no hand-written parsers); packets
    of older writers have nulls in the fields they lack."""
    return spark.read.schema(HANDOFF_DDL).json(path)


def read_handoff_checked(spark: SparkSession, path: str) -> DataFrame:
    """All packets under ``path``, the unusable ones too: the columns of
    ``read_handoff`` with model and version taken from the registration where
    the top level lacks them, and ``evidence_error``, which says what a packet is
    wrong in (null: nothing). A broken line is a row with an error, not a failed job."""
    schema = T._parse_datatype_string(HANDOFF_DDL).add("__corrupt", T.StringType())
    # parsed by the expression, not by the reader: that would leave out the fields
    # that a query does not select, and with them what is wrong in them
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    lines = spark.read.text(path).where(strip_text(F.col("value")) != "")
    rows = lines.select(F.from_json("value", schema, options).alias("packet")).select("packet.*")
    name = F.coalesce("model_name", "registration.model_name")
    version = F.coalesce("model_version", "registration.model_version")
    error = (
        F.when(F.col("__corrupt").isNotNull(), F.lit(PACKET_UNREADABLE))
        .when(name.isNull() | version.isNull(), F.lit(PACKET_WITHOUT_MODEL))
        .when(F.col("policy_verdict.decision").isNull(), F.lit(PACKET_WITHOUT_VERDICT))
    )
    fields = [f.name for f in schema.fields if f.name not in ("model_name", "model_version", "__corrupt")]
    return rows.select(name.alias("model_name"), version.alias("model_version"), *fields, error.alias("evidence_error"))


PACKET_UNREADABLE = "The hand-off packet is no readable JSON."
PACKET_WITHOUT_MODEL = "The hand-off packet names no registered model version."
PACKET_WITHOUT_VERDICT = "The hand-off packet holds no policy verdict."


# ---------------------------------------------------------------------------
# A11: flatten nested structs
# ---------------------------------------------------------------------------
def flatten_columns(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Dotted columns for every leaf of nested structs (maps and arrays stay
    whole)."""
    cols: list[Column] = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            cols.extend(flatten_columns(f.dataType, path))
        else:
            ref = ".".join(f"`{p}`" for p in path.split("."))
            cols.append(F.col(ref).alias(path))
    return cols


def flatten_struct(df: DataFrame) -> DataFrame:
    return df.select(*flatten_columns(df.schema))


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    from modelgate.session import scratch_folder

    return os.path.join(scratch_folder(spark), *parts, uuid.uuid4().hex)
