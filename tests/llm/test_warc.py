import base64
import gzip
import hashlib
import io
import os
import re
import time

from cytoloom.llm import warc
from cytoloom.llm.common import new_path

SCHEMA = "page_id long, url string, html string, path string"
PAGES = [(5, "http://a/1", "<p>é</p>", ""), (3, "http://a/2", "<p>é</p>", ""), (9, None, None, ""), (2, "u\r\nX: y", "", ""), (7, "http://a", "WARC/1.1\r\nfoo: bar\r\n\r\n" * 3, ""), (8, "http://b", "x" * 300_000, ""), (3, "http://a/2", "<p>é</p>", ""), (None, "n", "<p>é</p>", "")]


def test_round_trip(spark):
    rows = {repr(tuple(r)) for r in warc.op5_warc(spark.createDataFrame(PAGES, SCHEMA)).collect()}
    want = set()
    for page_id, _, html, _ in PAGES:
        payload = (html or "").encode()
        first = min(p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None)
        again = page_id != first
        want.add(repr((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None)))
    assert rows == want
    assert warc.op5_warc(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_are_valid_gzip_and_give_payloads_back(spark, monkeypatch):
    folder = new_path(spark, "test-warc")
    archives = warc.write(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), folder)
    [listed] = archives.collect() if archives.count() == 1 else [archives.first()]
    assert gzip.decompress(open(listed.path.removeprefix("file:"), "rb").read()).startswith(b"WARC/1.1\r\n")
    back = {r.page_id: bytes(r.html) for r in warc.read(spark, archives).where("record_type = 'response'").collect()}
    assert back == {p: (h or "").encode() for p, _, h, _ in PAGES if p in (3, 2, 7, 8)}


def records(n=6):
    return [warc.record(k, f"http://h/{k}", f"<p>{k}</p>".encode() * 200 + os.urandom(50), None) for k in range(n)]


def found(data):
    lost = []
    ids = [int(r.fields["x-page-id"]) for r in warc.salvage(io.BytesIO(data), lost)]
    return ids, lost


def test_salvage_of_damaged_members(monkeypatch):
    for block in (1 << 20, 37):
        monkeypatch.setattr(warc, "BLOCK", block)
        members = [warc.member(r) for r in records()]
        start = [sum(map(len, members[:k])) for k in range(7)]
        assert found(b"".join(members)) == (list(range(6)), [])
        data = bytearray(b"".join(members))
        data[start[2] + 30] ^= 255  # inside a member
        ids, lost = found(bytes(data))
        assert ids == [0, 1, 3, 4, 5] and [x[:2] for x in lost] == [(start[2], len(members[2]))]
        ids, lost = found(b"junk" + b"".join(members[:2]) + members[2][:20] + b"".join(members[3:]) + members[0][:40])
        assert ids == [0, 1, 3, 4, 5] and [x[1] for x in lost] == [4, 20, 40]
        wrong = warc.member(records()[1].replace(b"<p>1</p>", b"<p>9</p>"))  # a valid member whose digest differs
        assert found(members[0] + wrong + members[2])[0] == [0, 2]


def test_salvage_of_plain_archives(monkeypatch):
    for block in (1 << 20, 41):
        monkeypatch.setattr(warc, "BLOCK", block)
        plain = records()
        assert found(b"".join(plain)) == (list(range(6)), [])
        bad = plain[2].replace(b"<p>2</p>", b"<p>X</p>", 1)
        ids, lost = found(plain[0] + plain[1] + bad + b"??" + plain[3])
        assert ids == [0, 1, 3] and lost[0][:2] == (len(plain[0] + plain[1]), len(bad) + 2)
    assert found(b"") == ([], [])
    assert found(b"no archive at all" * 10)[0] == []


def test_reader_logs_gaps(spark, tmp_path):
    members = [warc.member(r) for r in records(3)]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"\x1f\x8b\x08broken" + members[1])
    out = warc.read(spark, spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")).collect()
    assert [r.page_id for r in out if r.gap_offset is None] == [0, 1]
    [gap] = [r for r in out if r.gap_offset is not None]
    assert (gap.gap_offset, gap.gap_bytes) == (len(members[0]), 9)


def test_a_plain_archive_with_wrong_lengths_is_read_in_bounded_memory_and_linear_time():
    """A length that is too small or too large by a little, far from the end of a long archive."""
    plain = records(9) * 4000
    for wrong in (b"Content-Length: 7\r\n", b"Content-Length: 1900\r\n"):
        data = b"".join([re.sub(rb"Content-Length: \d+\r\n", wrong, plain[0]), *plain[1:]])
        stream, lost, n = Counting(data), [], 0
        began = time.time()
        for r in warc.salvage(stream, lost):
            n += 1
            stream.most = max(stream.most, stream.given - stream.passed)
            stream.passed += r.end
        assert n in (len(plain) - 1, len(plain) - 2) and lost[0][0] == 0 and time.time() - began < 30
        assert stream.first < 4 * warc.BLOCK
    data = b"WARC/1.0\r\n" * 60_000 + plain[0]  # version lines without headers
    began = time.time()
    assert found(data)[0] == [0] and time.time() - began < 60


class Counting(io.BytesIO):
    """Counts the bytes that were read before the first record came."""

    given = passed = most = first = 0

    def read(self, n=-1):
        got = super().read(n)
        self.given += len(got)
        if not self.passed:
            self.first = self.given
        return got
