"""Files of the shared folder, on any filesystem that Arrow knows, from inside a task."""

from __future__ import annotations

import re
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_task_each(files: DataFrame, name: str) -> DataFrame:
    """A list of files with one row in each partition, so that they are read side by side. Left
    to itself Spark would put the few rows of a long list of large files into one task."""
    number = F.row_number().over(Window.orderBy(name)) - 1
    return files.withColumn("gl_task", number).repartitionById(max(1, files.count()), "gl_task").drop("gl_task")


def open_path(path: str, mode: str) -> BinaryIO:
    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)
    if mode == "wb":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_stream(inner, compression=None, buffer_size=1 << 20)


def open_random(path: str) -> BinaryIO:
    """A file that is read at any place."""
    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def rename(old: str, new: str) -> None:
    system, inner = fs.FileSystem.from_uri(old)
    system.move(inner, fs.FileSystem.from_uri(new)[1])
