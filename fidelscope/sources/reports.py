"""Report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fidelscope.plans.analysis import Report


def write_report(report: Report, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the three report tables under ``path``.

    Rows of a request lie together within the files, so that readers of a single request skip
    the rest; folders per request would leave millions of small files.
    """

    def write(table: DataFrame, name: str) -> None:
        near = table.repartitionByRange("request_id").sortWithinPartitions("request_id")
        near.write.mode(mode).format(fmt).save(f"{path}/{name}")

    write(report.overview, "overview")
    write(report.summary, "summary")
    write(report.samples, "samples")
