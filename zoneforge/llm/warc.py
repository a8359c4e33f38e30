"""WARC archives, and an index of captures merged from sorted runs."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneforge.functions.storage import new_path
from zoneforge.llm.common import configure, materialize, restored
from zoneforge.llm.common import NULL_ID
from zoneforge.llm.runs import merged, splitters

#: Bytes of a payload from which an equal one is a revisit.
LEAST = 1000
#: Groups of equal payloads that are broadcast (under 400 bytes each but for their URLs); more are joined.
GROUPS = 50_000
#: Entries that are sorted as one run, entries of a block, blocks merged at a time at least.
RUN, BLOCK, FAN = 1 << 16, 128, 64
#: Fixed values of the format: what begins a record, ends it, and the profile of a revisit.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_HOST = re.compile(r"^(?:([a-z][a-z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?(.*)$", re.S)


def url_key(url: str) -> str:
    """What captures of one page sort and meet by: the host's labels from the last, then path and query, in lower case.

    Scheme, a leading www, the scheme's own port and the fragment make no difference.
    """
    url = url.strip().lower()
    found = _HOST.match(url)
    if not found:
        return url.split("#")[0]
    scheme, host, port, rest = found.groups()
    host = re.sub(r"^www\d*\.", "", host.rstrip("."))
    labels = [host] if host.startswith("[") or re.fullmatch(r"[\d.]+", host) else host.split(".")[::-1]
    port = "" if not port or (scheme, port) in (("http", "80"), ("https", "443")) else f":{port}"
    rest = rest.split("#")[0]
    return ",".join(labels) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def _captures(pages: DataFrame) -> DataFrame:
    """page_id, url, captured, html, bytes and digests. Without a column ``captured`` (timestamp) a page is dated by its id, in seconds from 2020 on."""
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID))
    when = F.col("captured").cast("timestamp") if "captured" in pages.columns else F.lit(None).cast("timestamp")
    by_id = F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(page_id, F.lit(1 << 31)))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(page_id.alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), F.date_format(F.coalesce(when, by_id), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), html.alias("html"))
    return rows.select("*", F.octet_length("html").cast("long").alias("n_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


def _record_id(*columns) -> Column:
    """An urn that hangs on the capture alone, so a task that is run again writes the same record."""
    digest = F.md5(F.concat_ws("|", *columns).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _typed(rows: DataFrame, least: int, groups: int) -> DataFrame:
    """Captures with ``first``: of equal payloads of ``least`` bytes or more, the capture of the largest page_id, else null.

    A few groups are broadcast. More of them are joined, the largest (over a thousandth of all rows) still by broadcast; only then payloads
    are shuffled, and none that is shorter.
    """
    long = F.col("n_bytes") >= least
    known = materialize(
        rows.drop("html").where(long).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "url", "captured", "sha256")).alias("first")).where("copies > 1"), "payloads"
    )
    total, n = known.agg(F.sum("copies"), F.count(F.lit(1))).first()
    if n <= groups:
        return rows.join(F.broadcast(known.drop("copies")), "sha256", "left").withColumn("first", F.when(long, F.col("first")))
    hot, cold = (known.where(c).drop("copies") for c in (F.col("copies") > total / 1000, F.col("copies") <= total / 1000))
    some = rows.where(long)
    rest = some.join(F.broadcast(hot.select("sha256")), "sha256", "left_anti").join(cold, "sha256", "left")
    return some.join(F.broadcast(hot), "sha256").unionByName(rest).unionByName(rows.where(~long), allowMissingColumns=True)


def write(pages: DataFrame, path: str, least: int = LEAST, groups: int = GROUPS) -> None:
    """Write a record of each page to archives in ``path``, gzipped WARC files, one a task; revisits have no payload.

    The record is put together by column expressions and written by Spark, so a task that is lost leaves nothing. A file is one
    gzip stream: it is read from its start, by one task.
    """
    configure(pages.sparkSession)
    rows = _typed(_captures(pages), least, groups)
    again = F.coalesce(F.col("first.page_id") > F.col("page_id"), F.lit(False))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(F.lit(_HTTP), F.col("n_bytes").cast("string"), F.lit(END), F.when(again, F.lit("")).otherwise(F.col("html")))
    refers = F.concat(
        named("WARC-Profile", F.lit(PROFILE)), named("WARC-Refers-To", _record_id(*[F.col(f"first.{c}") for c in ("page_id", "captured", "sha256", "url")])),
        named("WARC-Refers-To-Target-URI", F.col("first.url")), named("WARC-Refers-To-Date", F.col("first.captured")),
    )
    record = F.concat(
        F.lit(VERSION), named("WARC-Type", F.when(again, "revisit").otherwise("response")), named("WARC-Record-ID", _record_id("page_id", "captured", "sha256", "url")), named("WARC-Date", F.col("captured")),
        named("WARC-Target-URI", F.col("url")), named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), named("WARC-Page-ID", F.col("page_id").cast("string")), F.when(again, refers).otherwise(F.lit("")),
        named("Content-Type", F.lit("application/http; msgtype=response")), named("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block",
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


_ENTRY = "url_key string, captured string, page_id long, url string, record_id string, record_type string, refers_id string, n_bytes long, digest string, file string, offset long, length long"
_FIELDS = [x.split(" ")[0] for x in _ENTRY.split(", ")]
_KINDS = pa.struct([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split(" ") for x in _ENTRY.split(", "))])
_STARTS = ("first_key", "first_captured", "first_id")
_BLOCKS = f"first_key string, first_captured string, first_id long, entries array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>"


def parsed(head: bytes, block: bytes) -> tuple[dict[str, str], bytes, str]:
    """Header fields of a record (names in lower case), its payload, and the payload's SHA-1 in hex."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    return fields, payload, hashlib.sha1(payload).hexdigest()


def records(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, int, bytes, bytes]]:
    """(file, offset, length, header, block) of records, from files that were cut wherever a record may begin.

    A payload may hold what begins a record: a block that is shorter than its Content-Length goes on in the next piece.
    """
    cut, file, at = (END + VERSION).encode(), None, 0
    pieces = iter(rows)
    for name, piece in pieces:
        if name != file:
            file, at = name, 0
            if not piece.startswith(VERSION.encode()):
                raise ValueError(f"{name} does not begin with a record")
            piece = piece[len(VERSION) :]
        head, _, block = piece.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        if size is None:
            raise ValueError(f"a record of {name} at {at} has no length")
        size, parts = int(size[1]), [block]
        have = len(block)
        while have < size:
            other, more = next(pieces, (None, b""))
            if other != name:
                raise ValueError(f"a record of {name} at {at} is cut off")
            parts += [cut, more]
            have += len(cut) + len(more)
        block = b"".join(parts)
        if block[size:] not in (b"", END.encode()):
            raise ValueError(f"a record of {name} at {at} is longer than it says")
        length = len(VERSION) + len(head) + len(END) + size
        yield name, at, length, head, block[:size]
        at += length + len(END)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Read archives: sorted runs of captures, in blocks. Payloads of responses are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sorted_run() -> pa.RecordBatch:
            held.sort(key=lambda e: e[:3])
            blocks = [held[k : k + BLOCK] for k in range(0, len(held), BLOCK)]
            first = [pa.array([b[0][k] for b in blocks], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            entries = pa.array([[dict(zip(_FIELDS, e, strict=True)) for e in b] for b in blocks], pa.list_(_KINDS))
            return pa.RecordBatch.from_arrays([*first, entries], [*_STARTS, "entries"])

        pieces = ((f, v) for batch in batches for f, v in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True))
        for file, at, length, head, block in records(pieces):
            fields, payload, found = parsed(head, block)
            kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind not in ("response", "revisit"):
                continue
            if kind == "response" and found != digest:
                raise ValueError(f"the payload of {fields.get('warc-record-id')} is not that of its digest")
            url = fields.get("warc-target-uri", "")
            refers = fields.get("warc-refers-to") if kind == "revisit" else None
            held.append((url_key(url), fields["warc-date"], int(fields["warc-page-id"]), url, fields["warc-record-id"], kind, refers, None if refers else len(payload), digest, file, at, length))
            if len(held) == RUN:
                yield sorted_run()
                held.clear()
        if held:
            yield sorted_run()

    text = spark.read.option("lineSep", END + VERSION).text(path)
    return text.select("_metadata.file_name", F.col("value").cast("binary")).mapInArrow(run, _BLOCKS)


def merge(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, place, entry): all captures in order of URL key, time and page_id, by part and place in it.

    Runs are cut at keys that part them evenly; a page of very many captures is cut like any other. Each part merges
    its pieces of all runs as they come in order of their first keys.
    """
    spark = blocks.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(blocks, _STARTS, parts)
    key = lambda e: (e["url_key"], e["captured"], e["page_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(part, list(own)) for block in batch.column(3).to_pylist() for part, own in groupby(block, lambda e: bisect_right(cuts, key(e)))]
            first = [pa.array(c, t) for c, t in zip(zip(*[key(own[0]) for _, own in out], strict=True) if out else [[]] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), *first, pa.array([own for _, own in out], pa.list_(_KINDS))], ["part", *_STARTS, "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((part, (key(block[0]), block)) for batch in batches for part, block in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True))
        for part, own in groupby(rows, lambda r: r[0]):
            place = 0
            for out in merged((x for _, x in own), key, FAN):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), pa.array(range(place, place + len(out)), pa.int64()), pa.array(out, _KINDS)], ["part", "place", "entry"])
                place += len(out)

    pieces = blocks.mapInArrow(cut, f"part int, {_BLOCKS}").repartition(parts, "part").sortWithinPartitions("part", *_STARTS)
    return pieces.mapInArrow(meet, f"part int, place long, entry struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>").select("part", "place", "entry.*")


def index(spark: SparkSession, path: str, parts: int | None = None) -> str:
    """Index the archives in ``path``/archives; the index is ``path``/index, in order of URL key, time and page_id."""
    blocks = materialize(runs(configure(spark), f"{path}/archives"), "runs")
    merge(blocks, parts).write.parquet(f"{path}/index")
    return f"{path}/index"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``position``, the place of each capture among all: parts are as many as the setting says, so their sizes are few."""
    own = spark.read.schema(f"part int, place long, {_ENTRY}").parquet(f"{path}/index")
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(F.broadcast(sizes.select("part", before.alias("base"))), "part").withColumn("position", F.col("base") + F.col("place")).drop("base")


def history(spark: SparkSession, path: str, url: str) -> DataFrame:
    """Captures of a page in order of time; the index's files are in order of key, so few of them are read."""
    own = spark.read.schema(f"part int, place long, {_ENTRY}").parquet(f"{path}/index").where(F.col("url_key") == url_key(url))
    return restored(own.orderBy("part", "place").drop("part", "place"), "page_id")


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures: a revisit's payload is that of the response it refers to.

    A response that very many refer to is met by broadcast (under 1000 of them); one that isn't there leaves null.
    """
    same = F.when(F.col("digest") == F.col("first_digest"), F.col("first_bytes")).when(F.col("first_digest").isNotNull(), F.raise_error(F.lit("a revisit refers to another payload")).cast("long"))
    refs = found.where("refers_id IS NOT NULL").select("page_id", "digest", "record_type", "refers_id")
    wanted = materialize(refs.groupBy("refers_id").agg(F.count(F.lit(1)).alias("times")), "wanted")
    total = wanted.agg(F.sum("times")).first()[0] or 0
    own = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("first_bytes"), F.col("digest").alias("first_digest"))
    targets = materialize(own.join(wanted, "refers_id").dropDuplicates(["refers_id"]), "targets")
    hot, cold = (targets.where(c).drop("times") for c in (F.col("times") > total / 1000, F.col("times") <= total / 1000))
    rest = refs.join(F.broadcast(hot.select("refers_id")), "refers_id", "left_anti").join(cold, "refers_id", "left")
    seen = refs.join(F.broadcast(hot), "refers_id").unionByName(rest)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = found.where("refers_id IS NULL").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return restored(whole.unionByName(seen.select("page_id", same.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")).select(*columns), "page_id", "refers_to")


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST, groups: int = GROUPS) -> DataFrame:
    """Write archives, read them back into an index, and give what it has of each page.

    A null payload is empty, a null url has no key. Rows that repeat the largest page_id of equal payloads are all responses; a null
    page_id is an id, the least. An empty table gives no rows; extra columns are ignored, but for ``captured``.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, f"{path}/archives", least, groups)
    index(spark, path)
    return resolved(captures(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
t AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""
