"""WARC derivatives: metadata and conversion records linked to their responses.

A record is a row: record_type, record_id, date, target_uri, content_type,
headers (a map of further named fields), block (bytes). ``responses`` makes
response records of a table of pages; ``derive`` turns response records from
anywhere into one metadata record and one plain-text conversion record each;
``read_warc`` reads WARC/1.0 and 1.1 files; ``write_warc`` stores records whose
blocks are UTF-8, as all derivatives are, as WARC/1.1 files.

Every step is one pass without a shuffle. Identifiers are name-based UUIDs of
what the record holds, so a job that runs again gives the same ones.
"""

from __future__ import annotations

import base64
import hashlib
import html as htmllib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_ROWS, batch_of, map_batches

RECORD = "record_type string, record_id string, date string, target_uri string, content_type string, headers map<string,string>, block binary"
SPACE = uuid.NAMESPACE_URL
#: Elements whose content is no text (``open`` is set where nothing closes one), the same where no ``>`` follows, and elements that end a line.
HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|(?P<open>\Z))|<!--.*?(?:-->|(?P<open_comment>\Z))|<![^>]*>|<\?[^>]*>")
HIDDEN_TAIL = re.compile(r"(?is)<(?:script|style|noscript|template)\b.*|<!--.*")
BREAKS = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul|title|body|head|html)\b[^>]*>")
TAG = re.compile(r"<[a-zA-Z/][^>]*>")
TITLE, TITLE_END = re.compile(r"(?i)<title[^>]*>"), re.compile(r"(?i)</title\s*>")
LINK = re.compile(r"(?i)<(a|area|link|img|script|iframe)\b")
TARGET = re.compile(r"""(?i)\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
#: Bytes that are unpacked at a time.
PIECE = 1 << 16
CHUNK_SIZE = re.compile(rb"[0-9a-fA-F]{1,15}")
VERSION, START = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"(?<=\r\n\r\n)WARC/1\.[01]\r\n")
LINE_ENDS = re.compile(r"[\r\n]+")
CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def urn(*parts: str | bytes) -> str:
    name = hashlib.sha256()
    for part in parts:
        raw = part.encode() if isinstance(part, str) else part
        name.update(str(len(raw)).encode() + b":" + raw)
    return f"<urn:uuid:{uuid.uuid5(SPACE, name.hexdigest())}>"


def in_closed(pattern: re.Pattern, new: str, text: str) -> str:
    """``pattern.sub`` up to the last ``>``: behind it no tag ends, and a pattern would read to the end from every ``<``."""
    end = text.rfind(">") + 1
    return pattern.sub(new, text[:end]) + text[end:]


def shown(markup: str) -> str:
    """The page without hidden elements; what nothing closes is hidden to the end."""
    end, left = markup.rfind(">") + 1, []

    def drop(m: re.Match) -> str:
        left.append(m["open"] is not None or m["open_comment"] is not None)
        return " "

    front = HIDDEN.sub(drop, markup[:end])
    return front if left and left[-1] else front + HIDDEN_TAIL.sub(" ", markup[end:])


def plain_text(markup: str) -> str:
    """The readable text of a page: hidden elements and tags removed, entities decoded, one line for each block. The time is linear in the page."""
    text = in_closed(TAG, "", in_closed(BREAKS, "\n", shown(markup)))
    lines = (" ".join(line.split()) for line in htmllib.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(markup: str) -> str:
    front = markup[: markup.rfind(">") + 1]
    start = TITLE.search(front)
    end = TITLE_END.search(front, start.end()) if start else None
    return " ".join(htmllib.unescape(front[start.end() : end.start()]).split()) if end else ""


def outlinks(markup: str) -> Iterator[tuple[str, str, str]]:
    """(tag, attribute, target) of the first target in each linking tag. The page is read forward once."""
    at, target = 0, TARGET.search(markup)
    while target and (tag := LINK.search(markup, at)):
        end = markup.find(">", tag.end())
        end = len(markup) if end < 0 else end
        if target.start() < tag.end():
            target = TARGET.search(markup, tag.end())
        if target and target.start() < end:
            yield tag[1].lower(), target[1].lower(), target[2] or target[3] or target[4] or ""
            at = target.end()
        else:
            at = end  # the tags before this end have no target either


def inflated(data: bytes, mode: int) -> tuple[bytes, int, bool]:
    """(what could be unpacked, where that ends in ``data``, whether all is sound); what comes before damage is kept."""
    stream, out = zlib.decompressobj(mode), []
    for at in range(0, len(data), PIECE):
        piece, before = data[at : at + PIECE], stream.copy()
        try:
            out.append(stream.decompress(piece))
        except zlib.error:
            for k in range(len(piece)):
                try:
                    out.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    return b"".join(out), at + k, False
        if stream.eof:
            return b"".join(out), at + len(piece) - len(stream.unused_data), True
    return b"".join(out), len(data), False


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message; without an empty line all is body."""
    front, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not front.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = front.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], body


def unchunked(body: bytes) -> bytes:
    """The body without the sizes of a chunked transfer; as it is, if it is not of that form."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not CHUNK_SIZE.fullmatch(size):
            return body
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2


def entity(body: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The body after its transfer and content encodings. Of a damaged body what comes before the damage is kept; one of which nothing can be read, or of an unknown encoding, is left as it is."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        body = unchunked(body)
    for coding in reversed([c.strip() for c in named.get("content-encoding", "").split(",")]):
        modes = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
        found = [inflated(body, mode) for mode in modes]
        best = next((x for x in found if x[2]), max(found, key=lambda x: len(x[0]), default=(b"", 0, False)))
        body = best[0] if best[2] or best[0] else body
    return body


def decoded(body: bytes, headers: list[tuple[str, str]]) -> tuple[str, str]:
    """The body's text and the character set used: that of the headers, then of the page, then UTF-8."""
    body = entity(body, headers)
    declared = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = CHARSET.search(declared) or CHARSET.search(body[:2048].decode("latin-1"))
    name = found[1] if found else "utf-8"
    try:
        return body.decode(name, "replace"), name.lower()
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace"), "utf-8"


def response_block(markup: str) -> bytes:
    body = markup.encode("utf-8", "surrogatepass")
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id") -> DataFrame:
    """(id, response record) of pages (id, url, html).

    A null page has an empty body; a null url an empty target; repeated rows
    give equal records; other columns are not read; no rows give none.
    """
    kind = dict(pages.dtypes)[id_col]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            uris, blocks, ids, heads = batch.column(1).to_pylist(), [], [], []
            for uri, markup in zip(uris, batch.column(2).to_pylist(), strict=True):
                block = response_block(markup)
                blocks.append(block)
                ids.append(urn("response", uri, date, block))
                heads.append([("WARC-Payload-Digest", digest(http_parts(block)[2])), ("WARC-Block-Digest", digest(block))])
            n = len(uris)
            return batch_of(batch.column(0), ["response"] * n, ids, [date] * n, uris, ["application/http; msgtype=response"] * n, pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary()))

        return step

    rows = pages.select(F.col(id_col), F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit("")))
    return map_batches(rows, make, f"{id_col} {kind}, {RECORD}")


def metadata_block(first: str, headers: list[tuple[str, str]], markup: str, charset: str, source: dict[str, str]) -> bytes:
    """application/warc-fields: what the source response said and what its page holds."""
    fields = [("http-status", first.split(" ")[1] if first.count(" ") else "")]
    fields += [(f"http-header-{k.lower()}", v) for k, v in headers]
    fields += [(f"source-{k.lower()}", v) for k, v in sorted(source.items()) if k.lower().endswith("digest")]
    fields += [("charset", charset), ("title", title_of(markup))]
    fields += [("outlink", f"{' '.join(htmllib.unescape(target).split())} {tag}/@{attr}") for tag, attr, target in outlinks(markup)]
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "surrogatepass")


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two records for each response of ``records``: metadata, then conversion.

    Both name the response in WARC-Refers-To, and its target and date; digests
    are those of the new blocks, and the metadata block keeps the source's
    HTTP headers and digests. Other record types are passed over; a response
    without a block is taken as an empty one; repeated rows are derived each.
    """
    kind = dict(records.dtypes)[id_col]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, types, ids, dates, uris, kinds, heads, blocks = [], [], [], [], [], [], [], []
            for k, r in enumerate(batch.to_pylist()):
                source = dict(r["headers"] or ())
                first, headers, body = http_parts(r["block"] or b"")
                markup, charset = decoded(body, headers)
                links = [("WARC-Refers-To", r["record_id"] or ""), ("WARC-Refers-To-Target-URI", r["target_uri"] or ""), ("WARC-Refers-To-Date", r["date"] or "")]
                made = (("metadata", "application/warc-fields", metadata_block(first, headers, markup, charset, source)), ("conversion", "text/plain; charset=utf-8", plain_text(markup).encode("utf-8", "surrogatepass")))
                for what, content_type, block in made:
                    rows.append(k)
                    types.append(what)
                    ids.append(urn(what, r["record_id"] or "", block))
                    dates.append(r["date"])
                    uris.append(r["target_uri"])
                    kinds.append(content_type)
                    own = digest(block)
                    heads.append([*links, ("WARC-Block-Digest", own), ("WARC-Payload-Digest", own), ("WARC-Source-Payload-Digest", source.get("WARC-Payload-Digest") or digest(body))])
                    blocks.append(block)
            text = pa.string()
            return batch_of(batch.column(0).take(pa.array(rows, pa.int64())), types, ids, pa.array(dates, text), pa.array(uris, text), kinds, pa.array(heads, pa.map_(text, text)), pa.array(blocks, pa.binary()))

        return step

    rows = records.where("record_type = 'response'").select(id_col, *[f.split()[0] for f in RECORD.split(", ")])
    return map_batches(rows, make, f"{id_col} {kind}, {RECORD}")


def record_bytes(row: dict) -> bytes:
    """A record as it stands in a file, without the two line ends after it. Line ends inside a field become spaces, so no value can add a field."""
    block = row["block"] or b""
    named = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), *dict(row["headers"] or ()).items(), ("Content-Type", row["content_type"]), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{LINE_ENDS.sub(' ', k)}: {LINE_ENDS.sub(' ', v)}\r\n" for k, v in named if v)).encode("utf-8", "surrogatepass") + b"\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write records whose blocks are UTF-8 as WARC files, one for each partition, compressed.

    A block that is not UTF-8 fails the job, as Spark's text writer would
    change it.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch_of(pa.array([record_bytes(r) for r in batch.to_pylist()], pa.binary()).cast(pa.string()))

        return step

    rows = records.select(*[f.split()[0] for f in RECORD.split(", ")])
    map_batches(rows, make, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def unpacked(data: bytes) -> bytes:
    """What a file holds: gzip members, one for each record or one for all, are joined; a broken member gives what can be read of it."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        body, n, sound = inflated(data[at:], 31)
        out.append(body)
        at += n
        if not sound:
            out.append(b"\r\n\r\n")  # the next record starts after an empty line
            nxt = data.find(b"\x1f\x8b\x08", max(at, 2))
            at = nxt if nxt >= 0 else len(data)
    return b"".join(out)


def records_of(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file (1.0 or 1.1), by their Content-Length.

    What cannot be read as a record, up to the next place where a record
    starts after an empty line, becomes one with the record type ``broken``.
    """
    at = 0
    while at < len(data):
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        gap = data.find(b"\r\n\r\n", at)
        front = data[at : gap if gap >= 0 else len(data)].decode("utf-8", "replace")
        named = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in front.split("\r\n")[1:] if ":" in line)]
        fields = {k.lower(): v for k, v in named}
        size = fields.get("content-length", "")
        start = gap + 4
        if VERSION.match(data, at) and gap >= 0 and size.isascii() and size.isdigit() and start + int(size) <= len(data):
            end = start + int(size)
            own = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "content-type", "content-length"}
            yield fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), fields.get("content-type"), [x for x in dict(named).items() if x[0].lower() not in own], data[start:end]
        else:
            found = START.search(data, at + 1)
            end = found.start() if found else len(data)
            yield "broken", fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), fields.get("content-type"), [], data[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files of any content, plain or gzip.

    Spark's binary reader gives a file to one task, so files should have the
    usual size of up to a gigabyte; the records go on in slices. An empty
    file has none; see ``records_of`` for damaged ones.
    """
    kind = T._parse_datatype_string(RECORD)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = records_of(unpacked(batch.column(0)[k].as_py() or b""))
                while part := [*islice(rows, SLICE_ROWS // 10)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, kind)
