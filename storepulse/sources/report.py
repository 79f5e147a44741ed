"""S4 ``write_report_bundle``: the data part of a PDF / XLSX export, written
as one folder of per-section datasets plus a summary.

Only non-empty sections are written.  The manifest keeps the spreadsheet name
of each section (31 characters, no slashes); the folder is named by the
section's position and whole title, so sections with similar titles never
share one.  The summary row holds the title,
the generation time ('%Y-%m-%d %H:%M:%S') and every section title joined by
', '.  The PDF form shows dates as '%Y-%m-%d' (``pdf_dates=True``).  Page
layout and charts are not built.

Each section's plan runs once: the executors write it straight to its folder
(``mode('overwrite')``, so a re-run after a failure rewrites it) and count the
rows on the way; nothing passes through the driver except the names and row
counts of the manifest.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

SHEET_NAME_LIMIT = 31


_SLASHES = str.maketrans({"/": "_", "\\": "_"})


def sheet_name(title: str) -> str:
    """Spreadsheet tab of a section."""
    return title[:SHEET_NAME_LIMIT].translate(_SLASHES)


def section_folder(position: int, title: str) -> str:
    slug = re.sub(r"[^0-9A-Za-z]+", "_", title).strip("_").lower() or "section"
    return f"{position:02d}_{slug}"


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dates_as_text(df: DataFrame) -> DataFrame:
    """Format date / timestamp columns as 'yyyy-MM-dd' (the PDF form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_report_bundle(spark: SparkSession, title: str, sections: dict[str, DataFrame], out_dir: str,
                        generated_on=None, fmt: str = "parquet", pdf_dates: bool = False) -> DataFrame:
    """Write every non-empty section under ``out_dir/<position>_<title>`` and a
    summary under ``out_dir/_summary``; returns the manifest
    (report_title, section, sheet_name, folder, row_count)."""
    generated_on = generated_on or _dt.datetime.now()
    if isinstance(generated_on, str):
        generated_on = _dt.datetime.fromisoformat(generated_on)
    manifest = []
    for position, (section, df) in enumerate(sections.items()):
        if df is None:
            continue
        folder = section_folder(position, section)
        rows = Observation()
        data = (dates_as_text(df) if pdf_dates else df).observe(rows, F.count(F.lit(1)).alias("n"))
        writer = data.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(f"{out_dir}/{folder}")
        else:
            writer.parquet(f"{out_dir}/{folder}")
        n = int(rows.get["n"])
        if n:
            manifest.append((title, section, sheet_name(section), folder, n))
        else:
            _remove(spark, f"{out_dir}/{folder}")
    summary = spark.createDataFrame(
        [(title, generated_on.strftime("%Y-%m-%d %H:%M:%S"), ", ".join(sections))],
        "report_title string, generated_on string, sections string")
    summary.write.mode("overwrite").parquet(f"{out_dir}/_summary")
    return spark.createDataFrame(
        manifest, "report_title string, section string, sheet_name string, folder string, row_count bigint")
