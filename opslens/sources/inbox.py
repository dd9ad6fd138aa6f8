"""An inbox of deliveries, read as a stream of small fetches, one or many in a trigger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from opslens.sources.inventory import opened

#: rows of a fetch
FETCH = 25


@dataclass
class Rows(InputPartition):
    """Rows `first` up to `last` of one file; the first of them is row `place` of fetch `fetch`."""

    path: str
    first: int
    last: int
    fetch: int
    place: int


class InboxReader(DataSourceStreamReader):
    """The offset is a number of rows in the order of deliveries and of their files, and the fetches they came in; a trigger admits `fetches` fetches more.

    Only the last fetch of a trigger may be short, and only where the inbox ends; what comes later begins a new one. The driver reads file
    footers only; tasks read the row groups and columns they need. `number` names a column that takes the fetch of a row.
    """

    def __init__(self, root: str, fetch: int, columns: Sequence[str], fetches: int = 1, number: str | None = None) -> None:
        self.root, self.fetch, self.fetches, self.number = root, fetch, fetches, number
        self.columns = [c for c in columns if c != number]
        self.names = list(columns)
        self.admitted: dict | None = None
        self.counts: dict[str, int] = {}

    def _taken(self, offset: dict) -> int:
        """Fetches up to an offset; those of a checkpoint from before they were counted were full."""
        return offset.get("fetches", -(-offset["rows"] // self.fetch))

    def _files(self) -> list[tuple[str, int]]:
        """Files of complete deliveries and their rows; a footer is read once."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = opened(self.root)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        complete = {f.path.rpartition("/")[0] for f in found if f.base_name == "_SUCCESS"}
        names = [f.path for f in found if f.base_name.endswith(".parquet") and f.path.rpartition("/")[0] in complete]
        names.sort(key=lambda p: (int(p.rpartition("/")[0].rpartition("=")[2]), p))
        for name in names:
            if name not in self.counts:
                self.counts[name] = pq.read_metadata(name, filesystem=store).num_rows
        return [(name, self.counts[name]) for name in names]

    def initialOffset(self) -> dict:
        return {"rows": 0, "fetches": 0}

    def latestOffset(self) -> dict:
        start = self.admitted or self.initialOffset()
        rows = max(start["rows"], min(start["rows"] + self.fetch * self.fetches, sum(n for _, n in self._files())))
        self.admitted = {"rows": rows, "fetches": self._taken(start) - (start["rows"] - rows) // self.fetch}
        return self.admitted

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """The rows between two offsets. A restarted query asks for its last batch first, which tells where it was."""
        if self.admitted is None or end["rows"] > self.admitted["rows"]:
            self.admitted = end
        asked, before = [], 0
        for path, count in self._files():
            first, last = max(start["rows"], before) - before, min(end["rows"], before + count) - before
            if first < last:
                number, place = divmod(before + first - start["rows"], self.fetch)
                asked.append(Rows(path, first, last, self._taken(start) + number, place))
            before += count
        return asked

    def read(self, partition: Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, _ = opened(self.root)
        with pq.ParquetFile(store.open_input_file(partition.path)) as file:
            before, done = 0, partition.place
            for group in range(file.num_row_groups):
                count = file.metadata.row_group(group).num_rows
                first, last = max(partition.first, before) - before, min(partition.last, before + count) - before
                if first < last:
                    rows = file.read_row_group(group, self.columns).slice(first, last - first)
                    if self.number:
                        numbers = partition.fetch + np.arange(done, done + rows.num_rows) // self.fetch
                        rows = rows.append_column(self.number, pa.array(numbers, pa.int64())).select(self.names)
                    yield from rows.to_batches()
                    done += rows.num_rows
                before += count


class Inbox(DataSource):
    """Rows of an inbox (`root`) in fetches of `fetch`, `fetches` of them in a trigger, oldest delivery first. The root is a path or URI that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        raise ValueError("give the schema of the inbox to readStream")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        asked = self.options
        return InboxReader(asked["root"], int(asked.get("fetch", FETCH)), schema.names, int(asked.get("fetches", 1)), asked.get("number"))


def deliver(messages: DataFrame, root: str, number: int) -> None:
    """Write wanted messages as delivery `number`, in order of time over all its files; later ones need greater numbers.

    What is wanted is decided before (`read_messages`, whose predicates reach the scan), so a fetch is full of wanted rows.
    """
    ordered = messages.repartitionByRange("sent_s", "message_id").sortWithinPartitions("sent_s", "message_id")
    ordered.write.mode("overwrite").parquet(f"{root}/delivery={number}")


def stream_messages(
    spark: SparkSession, root: str, schema: str | StructType, fetch: int = FETCH, fetches: int = 1, number: str | None = None
) -> DataFrame:
    """The inbox as a stream of fetches. A trigger takes `fetches` of them, an availableNow run too: drain with processing-time triggers.

    A trigger costs the same for one fetch as for many. With one, the batch is the fetch; with more, `number` names a BIGINT column of the
    schema that tells the fetch of a row, counted from 0.
    """
    if fetch < 1 or fetches < 1:
        raise ValueError("a fetch has at least one row, a trigger at least one fetch")
    spark.dataSource.register(Inbox)
    reader = spark.readStream.format("inbox").schema(schema).options(root=root, fetch=str(fetch), fetches=str(fetches))
    return (reader.option("number", number) if number else reader).load()
