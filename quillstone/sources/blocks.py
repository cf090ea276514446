"""Query sets as block files in the shared folder, which each task reads one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame

from quillstone.plans.shared import fresh_folder


def write_blocks(df: DataFrame, name: str) -> str:
    """Writes the rows, a file for each partition that has some, and gives the folder."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder


def read_blocks(folder: str, rows: int = 65536) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Inside a task: (file, batch) of all block files in the order of their names."""
    system, path = FileSystem.from_uri(folder)
    for f in sorted(f.path for f in system.get_file_info(FileSelector(path)) if f.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            for batch in ParquetFile(opened).iter_batches(rows):
                yield f, batch
