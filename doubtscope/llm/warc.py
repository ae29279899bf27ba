"""WARC archives of pages, read back, with an index merged from locally sorted runs.

Each page becomes a record; of equal payloads the page with the smallest id is a response and the
others revisit it. Archives are gzip files that Spark's text writer makes: a record is a header, an
empty line and a block, and ends in an empty line, so "CR LF CR LF" serves as the line separator both
ways. Reading goes by Content-Length, so payloads may hold separators or whole records.

The capture index is sorted within each written file: those files are the runs. They are dealt to
ranges of (URL key, time, page), and each range merges its pieces of the k runs with a loser tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtscope.llm.html import host_of
from doubtscope.session import fresh_path, stored

GAP = "\r\n\r\n"
VERSION = "WARC/1.1"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + GAP
#: Fixed value: the profile that names revisits of identical payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
EPOCH = 1_704_067_200  # captures of pages without a time are one second apart from here, by id


def classified(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload) with payload_bytes, payload_digest, record_type and refers_to."""
    sized = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    known = sized.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
    copied = known.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = stored(copied.select("payload_digest", "first_id"), "warc-copied")  # small where copies are few: then no page moves
    found = sized.join(copied, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame) -> Column:
    """The text of a classified page's record, without the separator after it."""
    revisit = F.col("record_type") == "revisit"
    when = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31)))
    date = F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    length = F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))

    return F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("refers_to")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length),
        F.lit(GAP + HTTP),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = 4096) -> None:
    """Write classified pages as gzipped WARC files of at most ``records_per_file`` records."""
    text = pages.select(records(pages).alias("value"))
    text.write.options(lineSep=GAP, compression="gzip", maxRecordsPerFile=records_per_file).text(path)


def _parse(pieces: Iterator[tuple[bytes, str]]) -> Iterator[dict]:
    """Records of the pieces between separators, file after file; the block is cut by its length."""
    gap = GAP.encode()
    offset, current = 0, None
    for piece, archive in pieces:
        if archive != current:
            current, offset = archive, 0
        start = offset
        offset += len(piece) + len(gap)
        head, *lines = piece.decode().split("\r\n")
        if head != VERSION:
            raise ValueError(f"{archive}: no record at {start}")
        fields = dict(line.split(": ", 1) for line in lines)
        want = int(fields["Content-Length"])
        block, have = [], -len(gap)
        while have < want:
            piece, _ = next(pieces)
            offset += len(piece) + len(gap)
            block.append(piece)
            have += len(gap) + len(piece)
        if have != want:
            raise ValueError(f"{archive}: block of {have} bytes instead of {want} at {start}")
        payload = gap.join(block)[len(HTTP) :]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(fields["X-Payload-Length"])
        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{archive}: payload does not fit its digest at {start}")
        yield {
            "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
            "url": fields.get("WARC-Target-URI"),
            "captured": fields["WARC-Date"],
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None,
            "archive": archive.rsplit("/", 1)[-1],
            "record_offset": start,
        }


CAPTURE = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64())]
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of gzipped WARC files; each file is read in order by one task, a record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                texts = batch.column(0).cast(pa.binary())
                for k in range(batch.num_rows):
                    yield texts[k].as_py(), batch.column(1)[k].as_py()

        rows = []
        for record in _parse(pieces()):
            rows.append(record)
            if len(rows) == 2048:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.option("lineSep", GAP).text(path).select("value", "_metadata.file_path").mapInArrow(run, CAPTURE)


def url_key(url: Column) -> Column:
    """Host reversed, then the rest in lower case, so that a site's captures stand together; '' for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|#.*$", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host_of(url), "\\."))), F.lit(")"), F.lower(rest))


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple]:
    """K-way merge of sorted runs with a loser tree: one comparison per level and row.

    Inner node i holds the run that lost there; the winner moves up from its leaf.
    """
    runs = [r for r in runs if r]
    k = len(runs)
    if not k:
        return
    heads = [0] * k
    key = [(0, r[0], n) for n, r in enumerate(runs)]  # (1,) once a run is used up
    losers = [-1] * k

    def play(n: int) -> int:
        """The winner after run n's leaf changed; fills inner nodes on the first passes."""
        node = (n + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = n
                return -1
            if key[losers[node]] < key[n]:
                losers[node], n = n, losers[node]
            node //= 2
        return n

    winner = -1
    for n in range(k):
        winner = max(winner, play(n))
    while key[winner][0] == 0:
        yield key[winner][1]
        heads[winner] += 1
        run = runs[winner]
        key[winner] = (0, run[heads[winner]], winner) if heads[winner] < len(run) else (1,)
        winner = play(winner)


def merged_index(captures: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """captures with urlkey, index_part and index_pos: in order of these two, the captures are in order
    of (urlkey, captured, page_id), nulls first.

    One URL with very many captures is cut by time like anything else; a range holds about
    ``rows_per_range`` rows, which is what a merging task keeps.
    """
    spark = captures.sparkSession
    order = ["urlkey", "captured", "page_id", "archive", "record_offset"]
    path = fresh_path(spark, "warc-runs")
    captures.withColumn("urlkey", url_key(F.col("url"))).sortWithinPartitions(*order).write.parquet(path)
    runs = spark.read.parquet(path)
    n = runs.count()
    ranges = max(1, -(-n // rows_per_range))
    run_id = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("run")
    dealt = runs.select("*", run_id).repartitionByRange(ranges, *order)
    names = captures.columns + ["urlkey"]
    schema = pa.schema([*_ARROW, ("urlkey", pa.string()), ("index_part", pa.int32()), ("index_pos", pa.int64())])
    place = [names.index(c) for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pieces: dict[int, list[tuple]] = {}
        for batch in batches:
            for row, which in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.columns[-1].to_pylist(), strict=True):
                key = tuple((row[p] is not None, row[p]) if row[p] is not None else (False,) for p in place)
                pieces.setdefault(which, []).append((key, row))
        for piece in pieces.values():
            if any(a[0] > b[0] for a, b in zip(piece, piece[1:])):  # a shuffle need not keep a run's order
                piece.sort(key=lambda r: r[0])
        rows = []
        for pos, (_, row) in enumerate(merge_runs(list(pieces.values()))):
            rows.append(dict(zip(names, row, strict=True)) | {"index_part": part, "index_pos": pos})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return dealt.select(*names, "run").mapInArrow(run, f"{CAPTURE}, urlkey string, index_part int, index_pos long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write pages as WARC archives, read them back and return the merged capture index, one row per row of pages.

    Null html is an empty payload; payloads under 100 bytes are always responses. A null id takes no
    part in choosing the response unless all have none; rows that repeat an id with the same payload
    are of the same type. A null url has an empty host in its key. An empty table gives an empty
    index. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")
    )
    path = path or fresh_path(pages.sparkSession, "warc-archives")
    write_archives(classified(rows), path)
    return merged_index(read_archives(pages.sparkSession, path))
