"""WARC archives written and read by Spark, and their merged capture index.

``write_archives`` gives every capture a record.  Of captures with equal payloads
of ``least_bytes`` or more, the one with the least id is a response and the
others are revisits that refer to it.  Records are text with their own line
ends, so Spark's text writer makes the files; readers get them through Spark's
binary-file source, so any store that Spark reads will do.

``read_archives`` walks each file by Content-Length and gives one index entry a
record: that file's run, sorted by URL key, time and id.  ``merge_index``
range-partitions the entries by that order into ranges of bounded size and merges
the runs of each with loser trees of bounded fan-in, so the partitions in their
order hold the capture histories of all URLs, globally ordered; a URL with very
many captures spans ranges.

Defined results: a null payload is read as empty; payloads under ``least_bytes``
are responses; captures that share the least id are all responses; a null id is
never the least unless all are null (then all are responses); line ends in URLs
are dropped and a null URL is written as "-"; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import fresh_path, written

#: What ends a WARC record, and separates lines in it.
RECORD_END, CRLF = "\r\n\r\n", "\r\n"
ID_PREFIX = "urn:capture:"

ENTRY = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def repeated_digests(sized: DataFrame, least_bytes: int) -> DataFrame:
    """(payload_digest, first) of the payloads of ``least_bytes`` or more that occur twice, with the least id."""
    large = sized.where(F.col("payload_bytes") >= least_bytes)
    # As a table of its own, so that a hot digest's partition may be split when captures are joined to it.
    return written(large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first"), "first-captures")


def with_record_types(sized: DataFrame, firsts: DataFrame, least_bytes: int) -> DataFrame:
    """``sized`` with record_type and refers_to."""
    joined = sized.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & F.coalesce(F.col("id") != F.col("first"), F.lit(True)) & (F.col("payload_bytes") >= least_bytes)
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def utc_stamp(at: str) -> Column:
    """The time in UTC whatever the session's zone: the epoch's seconds on a clock without a zone."""
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(at).cast("decimal(18,6)"))
    return F.concat(F.translate(F.substring(clock.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def record_text() -> Column:
    """One record, without its end: WARC headers, HTTP headers, and a response's payload."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    def urn(c: str) -> Column:
        return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", utc_stamp("at")),
        line("WARC-Target-URI", F.coalesce(F.translate("url", "\r\n", ""), F.lit("-"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit(CRLF),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


#: Bytes of payload that the first class of sizes ends at; each further class goes up to four times as many.
FIRST_CLASS = 16 << 10


def write_archives(captures: DataFrame, path: str, least_bytes: int = 100, file_bytes: int = 64 << 20) -> None:
    """Writes (id long, url string, at timestamp, payload string) as WARC files under ``path``.

    A file's payloads have ``file_bytes`` at most, or it holds one record: captures are written by class
    of payload size, as many to a file as fit if all had their class's greatest size.
    """
    payload = F.coalesce("payload", F.lit(""))
    whole = captures.select("id", "url", F.coalesce("at", F.timestamp_seconds(F.lit(0))).alias("at"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    size_class = F.greatest(F.ceil(F.log2(F.greatest(F.col("payload_bytes"), F.lit(1)) / FIRST_CLASS) / 2), F.lit(0)).cast("int")
    classes = sorted(r[0] for r in whole.select(size_class.alias("c")).distinct().collect()) or [0]
    sized = whole.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = repeated_digests(sized, least_bytes)
    for c in classes:
        records = with_record_types(sized.where(size_class == c), firsts, least_bytes).select(record_text().alias("value"))
        per_file = max(1, file_bytes // (FIRST_CLASS * 4**c))
        records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", per_file).text(f"{path}/class={c}")


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: what a site's captures share comes first."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    except ValueError:
        return f"){url}"


def records(data: bytes):
    """(headers, start, block start, end) of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:head].decode().split(CRLF)
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = head + 4
        end = block + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield headers, at, block, end
        at = end + 4


def _id(urn: str | None) -> int | None:
    value = urn[len(ID_PREFIX) + 1 : -1] if urn else "none"
    return None if value == "none" else int(value)


def entries(file: str, data: bytes) -> list[tuple]:
    """The index entries of one archive: a run in the order of the index."""
    out = []
    for headers, start, block, end in records(data):
        split = data.index(b"\r\n\r\n", block, end) + 4
        http = dict(x.split(": ", 1) for x in data[block : split - 4].decode().split(CRLF)[1:])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        intact = headers["WARC-Type"] == "revisit" or hashlib.sha256(data[split:end]).hexdigest() == digest and end - split == int(http["Content-Length"])
        stamp = "".join(c for c in headers["WARC-Date"] if c.isdigit())
        out.append((url_key(headers["WARC-Target-URI"]), stamp, _id(headers["WARC-Record-ID"]), headers["WARC-Type"], _id(headers.get("WARC-Refers-To")), int(http["Content-Length"]), digest, intact, file, start, end + 4 - start))
    out.sort(key=order_of)
    return out


def order_of(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[8], entry[9]


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner goes up.

    After a source's head is taken, only the matches on its path are played again.
    """

    def __init__(self, sources: list, key):
        self.sources = [iter(s) for s in sources]
        self.key = key
        k = len(sources)
        self.heads = [next(s, None) for s in self.sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, k)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else k - 1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        k = len(self.sources)
        while k and self.keys[self.winner] is not None:
            source = self.winner
            yield self.heads[source]
            head = self.heads[source] = next(self.sources[source], None)
            self.keys[source] = None if head is None else self.key(head)
            node = (source + k) >> 1
            while node:
                if self._before(self.losers[node], source):
                    self.losers[node], source = source, self.losers[node]
                node >>= 1
            self.winner = source


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=ENTRY.names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index entry for each record of the archives under ``path``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = entries(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                for at in range(0, len(found), 5000):
                    yield _batch(found[at : at + 5000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, ENTRY)


#: Runs that one loser tree merges; more go through passes.
FAN_IN = 64


def natural_runs(batches) -> list[list[pa.RecordBatch]]:
    """The batches cut into runs that ascend; a run's parts stay Arrow slices."""
    runs, last = [], None
    for batch in batches:
        keys = [order_of(r) for r in _rows([batch])]
        start = 0
        for i, key in enumerate(keys):
            if last is None or key < last:
                if i > start:
                    runs[-1].append(batch.slice(start, i - start))
                runs.append([])
                start = i
            last = key
        if len(keys) > start:
            runs[-1].append(batch.slice(start))
    return runs


def _rows(parts):
    for part in parts:
        for at in range(0, part.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in part.slice(at, 1024).columns), strict=True)


def _merged(runs: list[list[pa.RecordBatch]]):
    """One run of the given ones, as batches."""
    held = []
    for entry in LoserTree([_rows(p) for p in runs], order_of):
        held.append(entry)
        if len(held) == 5000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def merge_runs(runs: list[list[pa.RecordBatch]], fan_in: int = FAN_IN):
    """All runs merged, ``fan_in`` at a time in as many passes as it takes."""
    while len(runs) > fan_in:
        runs = [list(_merged(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    yield from _merged(runs)


def merge_index(index: DataFrame, ranges: int | None = None, rows_per_range: int = 100_000) -> DataFrame:
    """The entries in global order: partitions by range, runs merged within each.

    There are as many ranges as keep ``rows_per_range`` entries in each on average, and no fewer than the session's
    shuffle partitions.  The shuffle hands over what each
    task sent in its order, so the archives' runs need no sort: they are found where the order breaks.
    """
    ranges = ranges or max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // rows_per_range))
    placed = index.repartitionByRange(ranges, "url_key", "timestamp", "id", "file", "start")
    return placed.mapInArrow(lambda batches: merge_runs(natural_runs(batches)), ENTRY)


def captures_index(captures: DataFrame, least_bytes: int = 100, file_bytes: int = 64 << 20) -> DataFrame:
    """Archives of the captures in the shared folder, and their merged index."""
    spark = captures.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(captures, path, least_bytes, file_bytes)
    return merge_index(written(read_archives(spark, path), "capture-runs"))
