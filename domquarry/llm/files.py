"""Files of an operator's own format in the shared folder, written and read in tasks.

``pyarrow.fs`` opens what the folder's URI names (file, hdfs, s3, gs).  A file
is written under a name of its own and moved into place when it is whole, so a
task that runs twice leaves one file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from domquarry.llm.common import new_folder


def new_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI in the shared folder."""
    folder = new_folder(spark, name)
    return folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"


@contextmanager
def published(folder: str, name: str):
    """(output stream, path) of ``name`` in ``folder``; it appears there on a clean exit."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own, path = f"{root}/.{uuid.uuid4().hex}", f"{root}/{name}"
    with store.open_output_stream(own, compression=None) as out:
        yield out, path
    try:
        store.move(own, path)
    except OSError:  # some stores do not replace: another attempt of the task was first
        if store.get_file_info(path).type != pafs.FileType.File:
            raise
        store.delete_file(own)


def spread(files: DataFrame, order: str) -> DataFrame:
    """About one row (a file) per task."""
    return files.repartitionByRange(max(1, files.count()), order)
