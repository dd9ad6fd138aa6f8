"""Very many small text files, one in each folder."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.sources.inventory import opened

#: folder of rows without a value, as Spark's own writers name it
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_name(key: str) -> Column:
    """`key=value` with the value encoded, as in a partitioned table."""
    text = F.nullif(F.col(key).cast("string"), F.lit(""))
    return F.concat(F.lit(f"{key}="), F.coalesce(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit(NO_VALUE)))


def write_folders(rows: DataFrame, root: str, file: str, key: str, *order: str) -> None:
    """Lines (`value`) of every `key` as the file `file` of its folder below `root`, in the given order; a null is an empty line.

    Each task writes the files of its keys straight to their places, one open at a time: no file is moved by the driver afterwards,
    and a task that runs again writes the same files. The root is a path or URI that pyarrow opens.
    """

    def write(lines: Iterator) -> None:
        store, path = opened(unquote(root))
        for folder, some in groupby(lines, key=lambda r: r[0]):
            store.create_dir(f"{path}/{folder}", recursive=True)
            with store.open_output_stream(f"{path}/{folder}/{file}", buffer_size=1 << 16) as out:
                for _, value in some:
                    out.write((value or "").encode() + b"\n")

    ready = rows.withColumn("_folder", folder_name(key))
    ready.repartition("_folder").sortWithinPartitions("_folder", *order).select("_folder", "value").foreachPartition(write)
