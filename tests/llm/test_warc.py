"""Archives round trip, revisits, and the merged index."""

import gzip
import hashlib
import re

import numpy as np
import pytest

from zoneforge.llm import warc
from zoneforge.llm.runs import LoserTree, merged

SCHEMA = "page_id long, url string, html string, part string, place int, first_key string, digest long"
LONG = "<html>" + "é page " * 300
BODIES = [None, "", "short", "short", LONG, LONG, LONG, LONG + "x", "a" * 999, "a" * 999, "b" * 1000, "b" * 1000, "\r\n", "\r", "x\r\n\r\nWARC/1.1\r\ny" * 120, "x\r\n\r\nWARC/1.1\r\ny" * 120, "\r\n\r\nWARC/1.1\r\n", "\r\n\r\n", "end\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello", "null\x00" * 300]
URLS = ["http://www.Example.com/a?b=1#x", "https://example.com:443/a?b=1", "http://example.org", None, "not a url", "ftp://h:21/x", "http://1.2.3.4:8080/", "http://e.com/\r\nWARC-Type: bad"]


def brute(rows):
    top = {}
    for page_id, body in rows:
        top[body] = max(top.get(body, -(1 << 63)), -(1 << 63) if page_id is None else page_id)
    out = []
    for page_id, body in rows:
        data = (body or "").encode()
        again = len(data) >= 1000 and top[body] > (-(1 << 63) if page_id is None else page_id)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[body] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    own = [(i, URLS[i % len(URLS)], b) for i, b in enumerate(BODIES)] + [(100 + i, URLS[0], LONG) for i in range(30)] + [(None, URLS[1], LONG), (None, None, None), (4, URLS[2], LONG), (129, URLS[3], LONG), (129, URLS[0], LONG)]
    return own + [(1000 + i, f"http://e.com/{i % 37}", f"{i}" * 20) for i in range(700)]


@pytest.mark.parametrize("groups", [warc.GROUPS, 0])
def test_round_trip_is_brute_force(spark, rows, groups, monkeypatch, tmp_path):
    for name, value in (("BLOCK", 8), ("FAN", 2)):
        monkeypatch.setattr(warc, name, value)
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(*r, "p", 1, "k", 2) for r in rows], SCHEMA).repartition(5)
    found = warc.round_trip(pages, path, groups=groups)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute([(r[0], r[2]) for r in rows])
    order = [(r.url_key, r.captured, r.page_id) for r in warc.captures(spark, path).orderBy("position").collect()]
    assert order == sorted(order) and len(order) == len(rows)
    assert [r["position"] for r in warc.captures(spark, path).orderBy("position").collect()] == list(range(len(rows)))
    seen = [r.captured for r in warc.history(spark, path, "https://E.com/5#top").collect()]
    assert len(seen) == len([i for i in range(700) if i % 37 == 5]) and seen == sorted(seen)


def test_archives_are_warc(spark, rows, tmp_path):
    """A reader that goes by lengths alone finds every record where the index says."""
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(*r, "p", 1, "k", 2) for r in rows], SCHEMA).coalesce(2), f"{path}/archives")
    warc.index(spark, path)
    at = {(r.file, r.offset): r for r in warc.captures(spark, path).collect()}
    for file in (tmp_path / "w/archives").glob("*.gz"):
        data, k = gzip.decompress(file.read_bytes()), 0
        while k < len(data):
            assert data.startswith(b"WARC/1.1\r\n", k)
            head, _, _ = data[k:].partition(b"\r\n\r\n")
            own = at.pop((file.name, k))
            size = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
            assert own.length == len(head) + 4 + size and f"WARC-Record-ID: {own.record_id}".encode() in head
            k += own.length + 4
            assert data[k - 4 : k] == b"\r\n\r\n"
    assert not at


def test_damage_is_an_error(spark, tmp_path):
    page = spark.createDataFrame([(1, "http://a.b/", "hello there")], "page_id long, url string, html string").coalesce(1)
    warc.write(page, f"file://{tmp_path}/archives")
    (file,) = (tmp_path / "archives").glob("*.gz")
    good = gzip.decompress(file.read_bytes())
    for bad, message in ((good.replace(b"hello", b"jello"), "digest"), (good[:-12], "cut off"), (good[3:], "does not begin"), (good.replace(b"there", b"there and more"), "longer")):
        (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match=message):
            warc.runs(spark, f"file://{tmp_path}/bad.warc.gz").collect()


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=1#x") == warc.url_key("https://example.com/a?B=1") == "com,example)/a?b=1"
    assert warc.url_key("http://u:p@a.b.c:8080?q") == "c,b,a:8080)/?q" and warc.url_key("http://1.2.3.4/") == "1.2.3.4)/" and warc.url_key("") == ""


def test_loser_tree_and_blocks_are_sorted():
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted(rng.integers(0, 30, int(n)).tolist()) for n in rng.integers(0, 40, k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)
        blocks = sorted(((r[i],), r[i : i + 4]) for r in runs for i in range(0, len(r), 4))
        out = list(merged([(f[0], b) for f, b in blocks], lambda x: x, fan=3))
        assert [x for o in out for x in o] == sorted(x for r in runs for x in r)


def test_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
