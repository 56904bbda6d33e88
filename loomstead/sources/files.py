"""Files around a corpus: JSON lines in folders and archives, optional metadata, logs, CSV with a header."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def corpus(spark: SparkSession, path: str, kind: str = "parquet", text_field: str = "text") -> DataFrame:
    """A corpus file or folder with its text column named ``text``."""
    return spark.read.format(kind).load(path).withColumnRenamed(text_field, "text")


def json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON-line files of a folder; ``file`` and ``line`` give their order by name."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").format("binaryFile").load(folder)
    return _lines(raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"), schema, zipped=False)


def json_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same of a zip archive's .jsonl members (not encrypted)."""
    return _lines(spark.read.format("binaryFile").load(path).select(F.lit("").alias("file"), "content"), schema, zipped=True)


def _lines(raw: DataFrame, schema: str, zipped: bool) -> DataFrame:
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"]):
                members = [(file, content)]
                if zipped:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [(n, z.read(n)) for n in sorted(z.namelist()) if n.endswith(".jsonl")]
                for name, data in members:
                    rows = [x for x in data.decode().split("\n") if x.strip()]
                    yield pd.DataFrame({"file": name, "line": range(len(rows)), "value": rows})

    lines = raw.mapInPandas(run, "file string, line long, value string")
    return lines.select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")


def first_source(candidates: list[str | None]) -> tuple[str | None, list[str]]:
    """The first of several places that exists, and what was wrong with those before it; repeats are tried once."""
    errors = []
    for c in dict.fromkeys(x for x in candidates if x):
        if os.path.exists(c):
            return c, errors
        errors.append(f"{c}: not found")
    return None, errors


def first_loaded(candidates: list[str | None], load) -> tuple[DataFrame, str]:
    """The first of several places that loads (its first row is read), and which; if none does, an error with what each said."""
    errors = []
    for c in dict.fromkeys(x for x in candidates if x):
        try:
            df = load(c)
            df.take(1)
            return df, c
        except Exception as error:
            errors.append(f"{c}: {str(error).splitlines()[0][:200]}")
    raise FileNotFoundError("no source loads: " + "; ".join(errors))


def choice_examples(spark: SparkSession, candidates: list[str | None], kind: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Multiple-choice examples from the first place that loads (local copies come first where there is no network), the first ``limit`` in order."""
    df, _ = first_loaded(candidates, lambda c: spark.read.format(kind).load(c))
    return df.orderBy(*order).limit(limit) if limit is not None else df


def read_meta(path: str) -> dict:
    """One JSON object; a missing file gives {}."""
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def write_json(path: str, value) -> None:
    """A small JSON file that appears whole."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(plain(value), f, indent=2)
    os.replace(f"{path}.tmp", path)


def plain(value):
    """Values that JSON has: tuples become lists, rows become objects, other things their text."""
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def append_log(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def log_table(spark: SparkSession, path: str, kind: str, schema: T.StructType | str) -> DataFrame:
    """The records of one type of a mixed log."""
    return spark.read.schema(schema).json(path).where(F.col("type") == kind)


def record_list(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON file that is a list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, also where there are no rows."""
    (df if df.take(1) else df.coalesce(1)).write.mode("overwrite").option("header", True).csv(folder)


def trim_log(spark: SparkSession, folder: str, last_step: int) -> dict:
    """Drop the records of a log folder that are later than a step; the first original is kept as ``.backup``.

    Lines that are no records stay as they are. Nothing is written if nothing goes.
    """
    from loomstead.operators import runlog

    rows = runlog.trimmed_lines(spark.read.text(folder), last_step)
    counts = runlog.trim_counts(rows).first().asDict()
    if counts["removed"]:
        rows.where("not removed").select("value").write.mode("overwrite").text(f"{folder}.trimmed")
        _replace(spark, folder)
    return counts


def _replace(spark: SparkSession, folder: str) -> None:
    """Put folder.trimmed in the place of folder; the first original is kept as folder.backup.

    The old log is moved aside, never deleted before the new one is in place: a stop in between leaves both.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    first = not fs.exists(path(f"{folder}.backup"))
    aside = path(f"{folder}.backup" if first else f"{folder}.old")
    fs.rename(path(folder), aside)
    fs.rename(path(f"{folder}.trimmed"), path(folder))
    if not first:
        fs.delete(aside, True)


def trim_list(spark: SparkSession, path: str, last_step: int) -> dict:
    """trim_log for a file that is one JSON list; it is written again, as a folder of one file, only if something goes."""
    from loomstead.operators import runlog

    rows = runlog.trimmed_list(spark.read.text(path, wholetext=True), last_step)
    done = rows.select("removed", F.col("n_kept").alias("kept"), "rewrite").first().asDict()
    if done.pop("rewrite"):
        rows.select(F.col("kept").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.trimmed")
        _replace(spark, path)
    return done | {"invalid_lines_kept": 0}


def trim_run(spark: SparkSession, folders: list[str], last_step: int, lists: list[str] = (), exposures: list[str] = ()) -> dict:
    """Trim the logs of a run (folders of JSON lines), its JSON lists and the exposure logs of its ranks; the totals."""
    total: dict[str, int] = {}
    counts = [*(trim_log(spark, f, last_step) for f in (*folders, *exposures)), *(trim_list(spark, p, last_step) for p in lists)]
    for count in counts:
        for k, n in count.items():
            total[k] = total.get(k, 0) + n
    return total
