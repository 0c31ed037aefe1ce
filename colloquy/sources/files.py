"""Files in and out: partitioned runs, whole JSON documents, logs, reports, artifacts."""

from __future__ import annotations

import gzip
import json
import math
import os
import shutil
import subprocess
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_LOG = T.StructType([
    T.StructField("attempt_id", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("synthetic", T.BooleanType()), T.StructField("method", T.StringType()),
    T.StructField("endpoint", T.StringType()), T.StructField("url", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("retrieved_at_utc", T.TimestampType()),
    T.StructField("http_status", T.IntegerType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("bytes", T.LongType()), T.StructField("error", T.StringType()), T.StructField("raw_path", T.StringType()),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def export_table(df: DataFrame, path: str, fmt: str = "parquet", max_rows: int | None = None) -> dict:
    """Writes a table, optionally its first rows only, and returns the manifest entry."""
    out = df if max_rows is None else df.limit(max_rows)
    writer = out.write.option("header", True) if fmt == "csv" else out.write
    writer.format(fmt).save(path)
    return {"path": path, "format": fmt, "rows": df.sparkSession.read.format(fmt).options(header=True).load(path).count(), "columns": df.columns}


def export_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", max_rows: int | None = None) -> dict:
    """Each named table below ``root``, and a manifest of them all in ``root``/manifest, which is returned too."""
    entries = {name: export_table(df, f"{root}/{name}", fmt, max_rows) for name, df in tables.items()}
    manifest = {"created_at_utc": datetime.now(UTC).isoformat(), "tables": entries}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return manifest


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, n_rows) from footers alone."""
    df = spark.read.parquet(path)
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column string, type string").crossJoin(df.agg(F.count("*").alias("n_rows")))


def read_run(spark: SparkSession, root: str, subset: str, run_id: str) -> DataFrame:
    """One run of a curated table: only its partition is listed, and its id stays text ('001' is not 1)."""
    base = f"{root}/{subset}/run_id={run_id}"
    return spark.read.option("basePath", base).parquet(base).withColumn("run_id", F.lit(run_id))


def write_run(df: DataFrame, root: str, subset: str, run_id: str) -> None:
    """Partitions run_id=/dt= under the table; refuses where the run already holds files."""
    path = f"{root}/{subset}/run_id={run_id}"
    fs, at = _fs(df.sparkSession, path)
    if fs.exists(at) and any(s.getPath().getName().endswith(".parquet") or s.isDirectory() for s in fs.listStatus(at)):
        raise FileExistsError(f"{path} already holds a run")
    df.write.mode("append").partitionBy("dt").parquet(path)


def read_documents(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Whole JSON files: (path, json) of those that parse, and (path, error, sha256) of the others."""
    raw = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    ok = F.try_parse_json("json").isNotNull()
    bad = raw.where(~F.coalesce(ok, F.lit(False))).select("path", F.lit("not JSON").alias("error"), F.sha2("json", 256).alias("sha256"))
    return raw.where(ok), bad


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = REQUEST_LOG) -> DataFrame:
    """A log of one object a line; blank lines are skipped, a missing file is an empty table."""
    fs, at = _fs(spark, path)
    if not fs.globStatus(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.option("compression", compression) if compression else writer).json(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """One file with a header; report tables are small. Floats in fixed decimals if given."""
    fixed = {c: F.format_string(f"%.{decimals}f", c) for c, t in df.dtypes if t in ("double", "float")} if decimals is not None else {}
    df.withColumns(fixed).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A result table of an earlier run, or None to compute it anew."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def plain(value, infinities: str = "null"):
    """A value for JSON: NaN is null, infinities null or text, times ISO."""
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) or infinities == "null" else ("inf" if value > 0 else "-inf")
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v, infinities) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v, infinities) for v in value]
    return value


def summary_json(df: DataFrame, infinities: str = "null") -> str:
    """A one-row table as JSON text."""
    return json.dumps(plain(df.first().asDict(recursive=True), infinities), ensure_ascii=False, sort_keys=True)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON with nulls kept and NaN as null."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("json"))


def latex_rows(df: DataFrame) -> DataFrame:
    """Table lines: whole numbers with separators, others with two decimals, blanks for the rest."""
    def cell(c: str, t: str) -> Column:
        if t in ("bigint", "int", "smallint"):
            return F.coalesce(F.format_number(c, 0), F.lit(""))
        if t in ("double", "float"):
            return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.format_number(c, 2)), F.lit(""))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(F.concat(F.concat_ws(" & ", *(cell(c, t) for c, t in df.dtypes)), F.lit(" \\\\")).alias("line"))


def storage(spark: SparkSession, globs: dict[str, str]) -> DataFrame:
    """(component, files, bytes) without reading the files' content."""
    parts = [spark.read.format("binaryFile").load(g).select(F.lit(k).alias("component"), "length") for k, g in globs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("component").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def latest_artifact(spark: SparkSession, globs: list[str]) -> str | None:
    """The newest file under any of the patterns."""
    found = [s for g in globs for f, at in [_fs(spark, g)] for s in (f.globStatus(at) or [])]
    newest = max(found, key=lambda s: (s.getModificationTime(), s.getPath().toString()), default=None)
    return newest.getPath().toString() if newest else None


def ordered_payloads(spark: SparkSession, glob: str) -> DataFrame:
    """(path, position, item) of the list in every JSON file: the order that keep-first rules need."""
    from colloquy.functions.scalars import list_member

    docs, _ = read_documents(spark, glob)
    items = F.from_json(list_member(F.col("json"), ["posts", "data", "items", "results", "comments"]), "array<string>")
    return docs.select("path", F.posexplode(items).alias("position", "item"))


def provenance(run_id: str, repo: str | None = None, commands: list[list[str]] = (), **config) -> str:
    """A run's id, time and settings as JSON; with ``repo`` the commit and whether files differ from it, with ``commands`` their results."""

    def result(command: list[str], cwd: str | None = None) -> dict:
        try:
            r = subprocess.run(command, cwd=cwd, capture_output=True, text=True, timeout=60)
            return {"command": command, "returncode": r.returncode, "stdout": r.stdout.strip(), "stderr": r.stderr.strip()}
        except (OSError, subprocess.TimeoutExpired) as e:
            return {"command": command, "returncode": None, "stdout": "", "stderr": str(e)}

    more = {}
    if repo:
        commit, changed = result(["git", "rev-parse", "HEAD"], repo), result(["git", "status", "--porcelain"], repo)
        more["git"] = {"commit": commit["stdout"] or None, "changed": bool(changed["stdout"]) if changed["returncode"] == 0 else None}
    if commands:
        more["commands"] = [result(list(c)) for c in commands]
    return json.dumps(plain({"run_id": run_id, "created_at_utc": datetime.now(UTC), **more, **config}), sort_keys=True)


def gzip_files(folder: str, suffixes: tuple[str, ...] = (".json", ".jsonl")) -> dict:
    """Raw files of a collector's own folder as .gz of the same content and time; what is done already stays.

    A file is compressed to a temporary name, read back and compared, renamed, and only then removed.
    """
    done, before, after = 0, 0, 0
    for path in sorted(p for p in Path(folder).rglob("*") if p.is_file() and p.suffix in suffixes):
        to = path.with_name(path.name + ".gz")
        part = path.with_name(path.name + ".gz.part")
        with path.open("rb") as raw, part.open("wb") as out, gzip.GzipFile("", "wb", fileobj=out, mtime=0) as packed:
            shutil.copyfileobj(raw, packed)
        with gzip.open(part, "rb") as back, path.open("rb") as raw:
            while (x := raw.read(1 << 20)) or back.peek(1):
                if x != back.read(len(x) or 1):
                    raise OSError(f"{part} does not hold {path}")
        stat = path.stat()
        os.utime(part, ns=(stat.st_atime_ns, stat.st_mtime_ns))
        before, after, done = before + stat.st_size, after + part.stat().st_size, done + 1
        part.rename(to)
        path.unlink()
    return {"files": done, "bytes_before": before, "bytes_after": after}
