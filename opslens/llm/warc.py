"""WARC archives written and read by Spark, and their index: sorted capture runs merged by a loser tree.

`write_archives` writes one record per page. `read_archives` reads the records back. `capture_history` sorts each task's
captures into a run, writes the runs, deals them out by key range and merges the runs of every range with a k-way loser
tree: the parts in order are one history ordered by URL key, capture time and id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import materialize, scratch_path

LEAST_SHARED = 100
FILE_BYTES = 8 << 20
RANGE_ROWS = 100_000
END = "\r\n\r\n"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def decide_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """`pages` with _payload, _digest (SHA-256), _bytes and _first: the smallest id with an equal payload, null for a response.

    Payloads under `least` bytes are never shared. Equal SHA-256 and length count as equal payloads. A null id is never
    a first; rows with a null id refer to the smallest id of their payload, and rows that repeat the first id are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.withColumn("_payload", payload).withColumns({"_digest": F.sha2(F.col("_payload").cast("binary"), 256), "_bytes": F.octet_length("_payload").cast("long")})
    firsts = rows.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.min(id_col).alias("_smallest"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(firsts.select("_digest", "_smallest"), "_digest", "left")
    return joined.withColumn("_first", F.when(~F.col(id_col).eqNullSafe(F.col("_smallest")), F.col("_smallest"))).drop("_smallest")


def one_line(value: Column) -> Column:
    """Header values must stay on their line: percent signs and control characters are percent-encoded."""
    text = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("%"), F.lit("%25"))
    for mark, code in (("\r", "%0D"), ("\n", "%0A"), ("\0", "%00")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def record(id_col: str, url_col: str, time_col: str) -> Column:
    """The record as text, without the blank lines that end it. A revisit has no block; the full length is kept in a header."""
    revisit = F.col("_first").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("_payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(time_col, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(F.col(url_col).isNotNull(), F.concat(F.lit("WARC-Target-URI: "), one_line(F.col(url_col)))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("_bytes").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes gzipped WARC files of about `file_bytes` of records each.

    Every record ends with two line breaks, which the text writer adds as its line separator, so the files are plain
    WARC and are committed like any Spark output. Without `time_col` page n counts as captured n seconds after EPOCH.
    Tasks write the records where the join left them, so payloads are shuffled once, and begin a new file after as many
    records as make up `file_bytes` on average.
    """
    decided = decide_records(pages, id_col, payload_col)
    seconds = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) + int(EPOCH.timestamp())
    timed = decided.withColumn("_time", F.col(time_col) if time_col else F.timestamp_seconds(seconds))
    size = pages.agg(F.avg(F.octet_length(F.coalesce(F.col(payload_col).cast("string"), F.lit("")))) + 500).first()[0] or file_bytes
    records = timed.select(record(id_col, url_col, "_time").alias("value"))
    writer = records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / size)))
    writer.text(path)


HEADER = re.compile(rb"([A-Za-z-]+): ([^\r]*)")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Header fields, and start and end of the block, of every record; the blocks are found by their declared length."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode("utf-8") for k, v in HEADER.findall(content[at:head_end])}
        start = head_end + 4
        end = start + int(fields["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it should")
        yield fields, start, end
        at = end + 4


CAPTURE = "url_key string, captured string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, checked boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record in the archives: its headers, its file and offset, and whether a response's block has the declared digest."""
    import hashlib
    import zlib
    from urllib.parse import unquote

    fields = CAPTURE.split(", ")
    names = [f.split()[0] for f in fields]

    def number(value: str | None) -> int | None:
        digits = re.search(r"-?\d+", value or "")
        return int(digits[0]) if digits else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = zlib.decompress(packed.as_buffer(), 31)
                rows = []
                for head, start, end in parse_archive(content):
                    url = head.get("warc-target-uri")
                    url = unquote(url) if url is not None else None
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    good = kind == "revisit" or hashlib.sha256(content[start:end]).hexdigest() == digest
                    rows.append((url_key(url), head["warc-date"], number(head["warc-record-id"]), url, kind, digest, int(head["x-payload-length"]), number(head.get("warc-refers-to")), name, start, good))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array(c, types[f.split()[1]]) for c, f in zip(columns, fields, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(work, CAPTURE)


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then `)` and the rest, all lower-case; empty for null."""
    if url is None:
        return ""
    host, slash, rest = url.partition("://")[2].partition("/")
    if not slash and not host:
        return url.lower()
    return (",".join(reversed(host.split("."))) + ")" + slash + rest).lower()


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the overall winner stands on top."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other == -1:  # an empty node holds the first to come until its match
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            winner = self.losers[0]
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


KEY = ["url_key", "captured", "page_id"]


def run_starts(run: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where a stretch of one sorted run begins: the run changes, or its places go back."""
    return np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] < place[:-1])]))


def capture_history(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order of URL key, time and id: ordered inside every part, and the parts among each other.

    `_run` and `_place` are written with each locally sorted run. The runs are dealt out in ranges of about `range_rows` captures
    however large the table is, and a task merges the stretches of runs that reach it, as they are, in memory of that size.
    Ranges are cut on the key, the run and the place, so a URL with any share of the captures, and rows alike in all key columns,
    spread over many parts. A null id sorts first; equal keys follow the runs. An empty table gives an empty history.
    """
    runs = captures.sortWithinPartitions(*KEY).withColumns({"_run": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    written = materialize(runs, "capture-runs")
    spark = captures.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // range_rows))
    dealt = written.repartitionByRange(parts, *KEY, "_run", "_place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        run, place = table.column("_run").to_numpy(), table.column("_place").to_numpy()
        keys, captured, ids = (table.column(c).to_pylist() for c in KEY)
        starts = run_starts(run, place)
        ends = np.append(starts[1:], len(run))

        def stretch(start: int, end: int) -> Iterator[tuple]:
            for i in range(start, end):
                yield keys[i].encode(), captured[i], -1 << 63 if ids[i] is None else ids[i], i

        # ties go to the earlier stretch: run by run, and by place within a run
        order = np.lexsort((place[starts], run[starts]))
        merged = iter(LoserTree([stretch(int(starts[x]), int(ends[x])) for x in order]))
        rest = table.drop_columns(["_run", "_place"])
        while some := [head[-1] for head in islice(merged, 10_000)]:
            yield from rest.take(pa.array(some)).to_batches()

    return dealt.mapInArrow(merge, captures.schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Writes the archives of `pages` to the shared folder, reads them back and returns their capture history.

    Null payloads are empty, null URLs have an empty key; repeated rows are records of their own; an empty table gives
    an empty history. Only the named columns are read. A payload whose bytes do not match its digest ends the job.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"), *([F.col(time_col).alias("_captured")] if time_col else []))
    write_archives(named, path, time_col="_captured" if time_col else None)
    history = capture_history(read_archives(spark, path))
    sound = F.when(F.col("checked"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload and digest differ")))
    return history.withColumn("payload_digest", sound).drop("checked")
