"""Damaged and hostile input of the readers, and templates at several places."""

from __future__ import annotations

import gzip
import random
import re
import time
import zlib

from larkfield.llm import licenses, media_mpeg, warc


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_every_header_with_every_table_is_read():
    """Frames of all headers that a stream can have, with tables cut at any length, break nothing."""
    rng = random.Random(1)
    for second in range(0xE0, 0x100):
        for third in range(0, 256, 3):
            head = media_mpeg.parse_header(bytes([0xFF, second, third, 0]))
            if head is None:
                continue
            for name in (b"Xing", b"Info", b"VBRI"):
                frame = bytearray(head.size)
                frame[:4] = bytes([0xFF, second, third, 0])
                at = 36 if name == b"VBRI" else 4 + 2 * head.protected + head.side
                table = name + bytes(rng.choice([0, 1, 2, 7, 15, 255]) for _ in range(130))
                frame[at : at + len(table)] = table[: max(0, head.size - at)]
                del frame[head.size :]
                media_mpeg.read_audio(bytes(frame) * 2)
                media_mpeg.parse_table(bytes(frame[: rng.randrange(len(frame) + 1)]), head)
    small = media_mpeg.parse_header(bytes([0xFF, 0xF3, 0x14, 0xC0]))
    front = bytes([0xFF, 0xF3, 0x14, 0xC0]) + bytes(small.side) + b"Xing\0\0\0\x03"
    assert media_mpeg.parse_table((front + bytes(100))[: small.size], small)["name"] == "Xing"


def test_seek_table_of_the_other_kind():
    head = media_mpeg.parse_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    frame = bytes(36) + b"VBRI" + bytes([0, 1, 0, 0, 0, 0]) + (9000).to_bytes(4) + (40).to_bytes(4) + b"\0\3\0\2\0\2\0\x0d" + (10).to_bytes(2) + (20).to_bytes(2) + (30).to_bytes(2) + bytes(100)
    assert media_mpeg.parse_table(frame, head) == {"name": "VBRI", "frames": 40, "bytes": 9000, "per": 13, "entries": [20, 40, 60]}


LINK = re.compile(r"""(?is)<(a|area|link|img|script|iframe)\b[^>]*?\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>")
TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title\s*>")


def test_pages_are_read_as_by_patterns_over_the_whole():
    rng = random.Random(2)
    parts = ["<a ", "<a", "<area ", "<img ", "href=", "src = ", "'u'", '"v"', "w", " ", ">", "<", "<!--", "-->", "<script>", "</script>", "<style", "</style >", "<br>", "<p ", "text", "<!", "<?", "<title>", "</title>", "<title ", "&amp;", "\n", "x href"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [*warc.outlinks(page)] == [(t.lower(), k.lower(), a or b or c) for t, k, a, b, c in LINK.findall(page)], page
        text = warc.TAG.sub("", warc.BREAKS.sub("\n", HIDDEN.sub(" ", page)))
        assert warc.plain_text(page).split() == warc.htmllib.unescape(text).split(), page
        found = TITLE.search(page)
        assert warc.title_of(page) == (" ".join(warc.htmllib.unescape(found[1]).split()) if found else ""), page


def test_hostile_pages_take_linear_time():
    for part in ("<a ", "<", "<!", "<? ", "<br ", "<title>", "<title ", "<a href=", "<script", "<!--", "<a href='", "<p <!-- x -->"):
        page = part * (1_000_000 // len(part))
        began = time.time()
        warc.plain_text(page)
        warc.title_of(page)
        n = sum(1 for _ in warc.outlinks(page))
        assert time.time() - began < 8, (part, time.time() - began, n)


def test_damaged_members_give_what_comes_before():
    rng = random.Random(3)
    record = lambda name: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: " + name + b"\r\nContent-Length: 100000\r\n\r\n" + bytes(rng.randrange(97, 123) for _ in range(100_000)) + b"\r\n\r\n"
    one, two, three = record(b"one"), record(b"two"), record(b"three")
    flipped = bytearray(gzip.compress(two))
    flipped[len(flipped) // 2 : len(flipped) // 2 + 400] = bytes(400)
    got = warc.unpacked(gzip.compress(one) + bytes(flipped) + gzip.compress(three))
    kinds = [(r[0], r[1]) for r in warc.records_of(got)]
    assert got.startswith(one + two[:30_000]) and kinds[0] == ("response", "one") and kinds[-1] == ("response", "three") and kinds[1] in (("broken", "two"), ("response", "two"))
    wrong = gzip.compress(one)[:-8] + bytes(8)
    assert warc.unpacked(wrong).startswith(one)
    body = bytearray(zlib.compress(two))
    body[-2] ^= 1
    assert warc.entity(bytes(body), [("Content-Encoding", "deflate")]) == two
    assert warc.entity(b"plain", [("Content-Encoding", "gzip")]) == b"plain"


def test_values_add_no_fields():
    row = {"block": b"x", "record_type": "metadata", "record_id": "<urn:1>", "date": "d", "target_uri": "http://a\r\nWARC-Type: response\r\n\r\n", "headers": {"K": "a\nB: c"}, "content_type": "t"}
    read = [*warc.records_of(warc.record_bytes(row))]
    assert len(read) == 1 and read[0][0] == "metadata" and dict(read[0][5]) == {"K": "a B: c"}


def test_all_places_of_all_templates():
    index = licenses.TemplateIndex(licenses.TEMPLATES, 0.8, 1e-5, 128)

    def names(*parts: str) -> list[str]:
        text = " ".join(licenses.TEMPLATES.get(p) or p for p in parts)
        found = index.scan([licenses.shingle_hashes(licenses.license_words(text))])[0]
        kept = sorted(licenses.told_apart(found, index.sizes), key=lambda x: x[2])
        assert all(a[3] < b[2] for a, b in zip(kept, kept[1:], strict=False))
        return [index.names[t] for t, *_ in kept]

    for gap in (30, 150, 400, 3000):
        filler = words(gap, gap)
        assert names("BSD-3-Clause", filler, "BSD-2-Clause") == ["BSD-3-Clause", "BSD-2-Clause"], gap
        assert names("BSD-2-Clause", filler, "BSD-3-Clause") == ["BSD-2-Clause", "BSD-3-Clause"], gap
        assert names("MIT", filler, "MIT", filler, "ISC", filler, "MIT") == ["MIT", "MIT", "ISC", "MIT"], gap
        assert names("Apache-2.0-header", filler, "Apache-2.0-header") == ["Apache-2.0-header"] * 2, gap
