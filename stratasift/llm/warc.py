"""WARC archives: writing, reading and a merged capture index.

Archives are written and read with Spark's own file readers and writers, so
any store that Spark reaches will do.  Each record is a gzip member of its own
and can be read by its offset alone; archives are closed by their size.  Each
gives one locally sorted run of captures, and all runs are staged as files.
Key ranges, cut by samples and bounded in rows, then take their part of every
run, and a loser tree merges these without sorting again: capture histories in
one global order of URL key, timestamp and page.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_list, frees_memory, new_folder, plain_list, read_table, require, stage, task_count

#: Date of captures whose table has none.
DEFAULT_DATE = "2024-01-01T00:00:00Z"

#: Compressed bytes at which an archive is closed; one record more is the most that a task holds.
ARCHIVE_BYTES = 32 << 20

#: Captures in one key range of the merge, more or less.
RANGE_ROWS = 200_000

#: A gzip member without content.  It ends each archive, and its last byte is what Spark's
#: text writer adds to each row, so that an archive is one row.
_LAST_MEMBER = zlib.compress(b"", wbits=31)
_ROW_END = _LAST_MEMBER[-1:]

INDEX = (
    "run string, url_key string, warc_date string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, url string, record_offset long, record_length long"
)


def url_key(url: str) -> str:
    """Sort-friendly key: reversed host labels, then the rest, lower-cased, without scheme and fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))).lower() + ")" + rest[cut:].lower()


def payload_digests(pages: DataFrame) -> DataFrame:
    """Adds ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) to (page_id, url, date, html)."""

    def run(batches):
        for batch in batches:
            payloads = binary_list(batch, "html")
            digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(p) for p in payloads], pa.int64()), pa.array(digests)],
                names=[*batch.schema.names, "payload_bytes", "payload_digest"],
            )

    schema = T.StructType(list(pages.schema)).add("payload_bytes", "long").add("payload_digest", "string")
    return pages.mapInArrow(run, schema)


def with_record_types(digested: DataFrame, digests: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``: equal payloads revisit the smallest page."""
    first = (
        digests.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = digested.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select(
        *digested.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def _record_id(page: int | None) -> str:
    digest = hashlib.md5(f"page:{'null' if page is None else page}".encode()).hexdigest()
    return f"<urn:uuid:{uuid.UUID(digest)}>"


def record(page, url, date, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {date or DEFAULT_DATE}",
        f"WARC-Target-URI: {(url or '').replace('\r', '%0D').replace('\n', '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        payload = b""
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    lines += [
        f"X-Page: {'' if page is None else page}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def packed_archives(records: DataFrame) -> DataFrame:
    """(value): the bytes of one archive each, without the last."""
    names = ("page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def archive(members: list[bytes]) -> pa.RecordBatch:
        data = b"".join([*members, _LAST_MEMBER])
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.large_binary()).cast(pa.binary())], names=["value"])

    def run(batches):
        members, size = [], 0
        for batch in batches:
            columns = [plain_list(batch, c) for c in names]
            for (page, url, date, n, digest, kind, refers), payload in zip(
                zip(*columns, strict=True), binary_list(batch, "html"), strict=True
            ):
                members.append(zlib.compress(record(page, url, date, payload, n, digest, kind, refers), wbits=31))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive(members)
                    members, size = [], 0
        if members:
            yield archive(members)

    return records.select(*names, "html").mapInArrow(frees_memory(run), "value binary")


def write_archives(
    pages: DataFrame, folder: str, date_col: str | None = None, min_bytes: int = 0
) -> None:
    """Writes one WARC record for each row of ``pages`` (``page_id``, ``url``, ``html``) to gzip archives.

    A null ``html`` is an empty payload, a null ``url`` an empty target, a null
    date :data:`DEFAULT_DATE`.  Of rows with equal payloads of at least
    ``min_bytes`` bytes those with the smallest ``page_id`` are responses and
    the others revisits of it; rows with null ids revisit too, unless all ids
    are null.  Repeated rows give a record each.  Other columns are not stored.
    """
    require(pages, "page_id", "url", "html")
    date = F.col(f"`{date_col}`").cast("string") if date_col else F.lit(None).cast("string")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", date.alias("date"), "html")
    # The digests are a narrow table of their own, so that payloads are shuffled once.
    digested = payload_digests(source)
    digests = stage(digested.select("page_id", "payload_digest", "payload_bytes"), "digests")
    archives = packed_archives(with_record_types(digested, digests, min_bytes))
    # The text writer writes the bytes of a string as they are, and ends each row with the separator.
    text = archives.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", _ROW_END.decode()).option("maxRecordsPerFile", 1).text(folder)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    head_end = raw.find(b"\r\n\r\n")
    lines = raw[: max(head_end, 0)].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = head_end + 4
    end = start + int(headers["Content-Length"])
    if raw[end:] != b"\r\n\r\n":
        raise ValueError("the record has a wrong length")
    return headers, raw[start:end]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive; the bytes there are its gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts, end = zlib.decompressobj(wbits=31), [], at
        while not member.eof:
            if end >= len(view):
                raise ValueError(f"the archive breaks off in the record at byte {at}")
            parts.append(member.decompress(view[end : end + 65536]))
            end = min(end + 65536, len(view))
        end -= len(member.unused_data)
        if raw := b"".join(parts):
            yield *parse_record(raw), at, end - at
        at = end


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """All records of the archives in ``folder``, each archive sorted into one run; digests are checked."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    )
    fields = [f.strip().split(" ") for f in INDEX.split(",")] + [["payload", "binary"]] * with_payload
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            for path, content in zip(plain_list(batch, "path"), batch.column(1), strict=True):
                rows = []
                for headers, block, at, size in parse_archive(content.as_py()):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response":
                        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                            raise ValueError(f"{path}: the payload at byte {at} does not have its digest")
                    page, refers = headers["X-Page"], headers.get("X-Refers-To-Page")
                    url = headers["WARC-Target-URI"]
                    rows.append(
                        (
                            path.rsplit("/", 1)[-1],
                            url_key(url),
                            headers["WARC-Date"],
                            int(page) if page else None,
                            int(headers["X-Payload-Length"]),
                            digest,
                            headers["WARC-Type"],
                            int(refers) if refers else None,
                            url,
                            at,
                            size,
                        )
                        + (block,) * with_payload
                    )
                rows.sort(key=sort_key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)],
                    names=[n for n, _ in fields],
                )

    return files.mapInArrow(run, ", ".join(" ".join(f) for f in fields))


def sort_key(row: tuple) -> tuple:
    """Order of captures: URL key, timestamp, page (null first), place."""
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[9]


class LoserTree:
    """Merges sorted iterators; each step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterator], key=sort_key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.items: list = [None] * self.k
        self.heads: list[tuple] = [(1, ())] * self.k
        # tree[0] is the winner, the others hold the loser of their match.
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k - 1, -1, -1):
            self._pull(leaf)
            self._replay(leaf)

    def _pull(self, leaf: int) -> None:
        for item in self.runs[leaf]:
            self.items[leaf], self.heads[leaf] = item, (0, self.key(item))
            return
        self.items[leaf], self.heads[leaf] = None, (1, ())

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        winner = leaf
        while node:
            other = self.tree[node]
            if other < 0:
                # The first to arrive waits for its opponent.
                self.tree[node] = winner
                return
            if (self.heads[other], other) < (self.heads[winner], winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and not self.heads[w := self.tree[0]][0]:
            yield self.items[w]
            self._pull(w)
            self._replay(w)


def natural_runs(keys: list[tuple]) -> list[tuple[int, int]]:
    """(first, end) of the stretches of one run that are in order; a run that arrives in pieces is several."""
    cuts = [0] + [i for i in range(1, len(keys)) if keys[i][4] != keys[i - 1][4] or keys[i] < keys[i - 1]]
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True)) if keys else []


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures of sorted runs in one global order; partitions follow each other.

    Ranges are cut on the whole sort key, so a URL with very many captures
    spans as many of them as it needs, and their number follows from the rows,
    so that a task holds a bounded part of the runs, in Arrow's own format.
    """
    order = ["url_key", "warc_date", "page_id", "run", "record_offset"]
    ranges = max(task_count(runs), runs.count() // RANGE_ROWS + 1)
    ranged = runs.repartitionByRange(ranges, *order)

    def merge(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        columns = [table.column(c).to_pylist() for c in ("run", "url_key", "warc_date", "page_id", "record_offset")]
        keys = [
            (url, date, page is not None, page or 0, run, at) for run, url, date, page, at in zip(*columns, strict=True)
        ]
        tree = LoserTree([iter(range(a, b)) for a, b in natural_runs(keys)], key=keys.__getitem__)
        yield from table.take(pa.array(tree, pa.int64())).to_batches(max_chunksize=8192)

    def run(batches):
        for first in batches:
            yield from merge(chain([first], batches))

    return ranged.mapInArrow(frees_memory(run), runs.schema)


def capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """The merged index of all archives in ``folder``, in the order of :func:`sort_key`."""
    return merge_runs(stage(read_records(spark, folder), "runs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = new_folder(spark, "archives")
    write_archives(pages, folder)
    return capture_index(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "warc_date"
    )


# Base32 in SQL: each hex digit as four bits, then five bits for each letter.
_BITS = "".join(format(i, "04b") for i in range(16))
_SHA1_BITS = f"array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: substr('{_BITS}', CAST(('0x' || c)::INT * 4 + 1 AS BIGINT), 4)), '')"

ORACLE_SQL = f"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, {_SHA1_BITS} AS bits FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_page,
  split_part(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END, '#', 1) AS rest FROM b),
h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM m)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    substr(bits, i * 5 + 1, 1)::INT * 16 + substr(bits, i * 5 + 2, 1)::INT * 8 + substr(bits, i * 5 + 3, 1)::INT * 4 + substr(bits, i * 5 + 4, 1)::INT * 2
    + substr(bits, i * 5 + 5, 1)::INT + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to,
  lower(array_to_string(list_reverse(string_split(host, '.')), ',')) || ')' || lower(substr(rest, length(host) + 1)) AS url_key,
  '{DEFAULT_DATE}' AS warc_date FROM h
"""
