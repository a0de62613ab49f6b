"""Legacy archive converter: ARC records to WARC records, written as archives and read back.

An ARC archive opens with a version block whose second line names the version and whose third line
names the fields of every later header line. A record is its header line, then as many bytes as the
line declares. Versions 1 and 2 differ in their fields. The converter makes of each record the WARC
equivalents: an identifier from name and offset, a timestamp, a type and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import table
from taproom.session import checkpoint_dir

ARCHIVE_BYTES = 8 << 20  # an archive is closed at this size; a larger record has one of its own
# The field lists of the two ARC versions.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EMPTY_RUN = "19700101000000"


def arc_header(version: str, url: str, date: str, kind: str, length: int, code: str = "200", offset: int = 0, name: str = "-") -> bytes:
    """One header line of an ARC record in the fields of its version."""
    line = [url, "0.0.0.0", date, kind]
    if version == "2":
        line += [code, "-", "-", str(offset), name]
    return (" ".join([*line, str(length)]) + "\n").encode()


def arc_open(name: str, version: str = "1", date: str = EMPTY_RUN) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 taproom\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", date, "text/plain", len(body), name=name) + body + b"\n"


def arc_record(version: str, url: str, date: str, payload: bytes, headers: list[tuple[str, str]], offset: int = 0, name: str = "-") -> bytes:
    """An HTTP response as an ARC record: header line, HTTP head, payload, line end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("Content-Type", "text/html; charset=utf-8"), *headers])
    body = b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n" + payload
    # White space would end a field of the header line.
    address = "".join("%%%02X" % b if b <= 32 or b == 127 else chr(b) for b in (url or "-").encode()).encode("latin-1")
    line = arc_header(version, "\0", date, "text/html", len(body), offset=offset, name=name)
    return line.replace(b"\0", address) + body + b"\n"


def read_arc(data: bytes):
    """Records of an ARC archive: dicts of its fields plus `block` (bytes), `at` and `name`.

    The declared length alone ends a record, whatever its bytes hold. Header lines are read by the
    field list of the version block; URLs may hold spaces, so fields are counted from the end.
    """
    at, fields, name = 0, None, "-"
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].decode().rstrip("\r")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC archive opens with its version block")
            size = int(line.rsplit(" ", 1)[1])
            block = data[end + 1 : end + 1 + size].decode().split("\n")
            version = block[0].split(" ")[0]
            fields = (block[1] if len(block) > 1 and block[1] else ARC_FIELDS[version]).split(" ")
            if version not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[version].split(" ")):
                raise ValueError(f"unknown ARC version {version}")
            name = line.split(" ")[0].removeprefix("filedesc://")
        else:
            parts = line.rsplit(" ", len(fields) - 1)
            if len(parts) != len(fields) or not parts[-1].isdigit():
                raise ValueError(f"an ARC header line doesn't fit its version: {line[:80]}")
            size = int(parts[-1])
            if end + 1 + size > len(data):
                raise ValueError("an ARC record is shorter than it declares")
            yield dict(zip(fields, parts)) | {"block": data[end + 1 : end + 1 + size], "at": at, "name": name}
        at = end + 1 + size


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """What follows the HTTP head of a block, and the head's fields in lower case."""
    if not block.startswith(b"HTTP/"):
        return block, {}
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = [x.split(":", 1) for x in head.decode("latin-1").split("\r\n")[1:]]
    return payload, {x[0].strip().lower(): x[1].strip() for x in lines if len(x) == 2}


def sha1_name(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(archive: str, at: int) -> str:
    """A record identifier that only depends on where the legacy record lies."""
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"


def warc_record(arc: dict, refers_to: str | None = None, extra: list[tuple[str, str]] = ()) -> bytes:
    """The WARC equivalent of an ARC record; a revisit if it refers to another."""
    block = arc["block"]
    payload, _ = payload_of(block)
    date = arc["Archive-date"].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    is_http = block.startswith(b"HTTP/")
    kind = "revisit" if refers_to else "response" if is_http else "resource"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_name(arc["name"], arc["at"])),
        ("WARC-Date", stamp),
        ("WARC-Target-URI", arc["URL"]),
        ("WARC-IP-Address", arc["IP-address"]),
        ("WARC-Block-Digest", f"sha1:{sha1_name(block)}"),
        ("WARC-Payload-Digest", f"sha1:{sha1_name(payload)}"),
        ("Content-Type", "application/http; msgtype=response" if is_http else arc["Content-type"]),
    ]
    if refers_to:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Payload", refers_to),
        ]
    fields += [*extra, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes):
    """Records of a WARC archive: (fields in lower case, block), by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a WARC record opens with its version")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a WARC record is not as long as it declares")
        yield fields, block
        at = end + 8 + size


def _digests(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        payloads = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).digest() + hashlib.sha1(p).digest() for p in payloads], pa.binary()),
            ],
            ["page_id", "payload_bytes", "payload"],
        )


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload (its SHA-256) and refers_to for pages whose payload a larger page_id has too.

    Payloads are equal when SHA-256 and SHA-1 are; those under `least` bytes refer to none. Null html is
    empty. Rows that repeat the response's page_id are responses; so is every row without a page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string"))
    rows = rows.mapInArrow(_digests, "page_id long, payload_bytes long, payload binary")
    rows = rows.where(F.col("payload_bytes") >= least)
    groups = rows.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("payload", "refers_to")
    found = rows.join(groups, "payload").where("page_id <> refers_to")
    return found.select("page_id", F.substring("payload", 1, 32).alias("payload"), "refers_to").distinct()


def _convert(archive_bytes: int, arc_version: str):
    opened, legacy, parsed, made = arc_open, arc_record, read_arc, warc_record

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def archive(rows, number):
            name = f"part-{part:06d}-{number:06d}.arc"
            data, refers = [opened(name, arc_version)], []
            for page, url, html, target in rows:
                own = [("X-Page-Id", str(page))] if page is not None else []
                data.append(legacy(arc_version, url, "19700101000000", html, own, name=name))
                refers.append(target)
            out = [
                made(arc, None if target is None else str(target), [("WARC-Filename", f"{name}.warc")])
                for arc, target in zip(parsed(b"".join(data)), refers)
            ]
            return b"".join(out)[:-1]  # the writer of text lines adds the last line end

        def emit(value):
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary()).cast(pa.string())], ["value"])

        held, size = [], 0
        for batch in batches:
            pages, urls, _, targets = (c.to_pylist() for c in batch.columns)
            payloads = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for row in zip(pages, urls, payloads, targets):
                if held and size + len(row[2]) > archive_bytes:
                    yield emit(archive(held, number))
                    held, size, number = [], 0, number + 1
                held.append(row)
                size += len(row[2]) + 1000
        if held:
            yield emit(archive(held, number))

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, arc_version: str = "1", least: int = 0) -> None:
    """Write the pages as WARC archives (gzip files of bounded size) under a shared path.

    Each bounded run of pages becomes a legacy archive, which the converter reads back by its header
    lines and declared lengths. A page without an id has no X-Page-Id.
    """
    marks = revisits(pages, least)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    own = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    marked = rows.withColumn("payload", own).join(marks, ["page_id", "payload"], "left")
    marked = marked.select("page_id", "url", "html", "refers_to")
    (
        marked.mapInArrow(_convert(archive_bytes, arc_version), "value string")
        .write.option("maxRecordsPerFile", 1).option("zlib.compress.level", "BEST_SPEED")
        .option("compression", "gzip").text(path)
    )


def _parse(batches):
    import gzip

    import pyarrow as pa

    parsed, payload_in, digest = read_warc, payload_of, sha1_name

    for batch in batches:
        for data in batch.column(0).to_pylist():
            out = []
            for fields, block in parsed(gzip.decompress(data)):
                payload, head = payload_in(block)
                named = digest(payload)
                if fields["warc-payload-digest"] != f"sha1:{named}":
                    raise ValueError("a payload doesn't have the digest its record names")
                page, target = head.get("x-page-id"), fields.get("warc-refers-to-payload")
                out.append(
                    (
                        None if page is None else int(page), fields["warc-target-uri"], fields["warc-record-id"],
                        fields["warc-date"], fields["warc-type"], len(payload), named,
                        None if target is None else int(target), payload,
                    )
                )
            names = ("page_id", "url", "record_id", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
            kinds = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.binary())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under a path, with its payload; digests are checked on the way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(
        _parse,
        "page_id long, url string, record_id string, date string, record_type string, "
        "payload_bytes long, payload_digest string, refers_to long, payload binary",
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    import uuid

    pages = table(spark, sf_dir, "pages")
    path = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
