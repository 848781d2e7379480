import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import warc
from tarn.llm.common import shared_folder
from tarn.llm.warc import LoserTree, page_of, page_record, parsed, record

NASTY = "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, captured string, file long")


def brute(rows, least=0):
    found = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None and len(data) >= least]
        best = max(same, default=None)
        again = best is not None and (i is None or i < best)
        found.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(found, key=repr)


def rows_of(n=300):
    r = random.Random(5)
    texts = ["", NASTY, "é\U0001f600\x00", "a" * 200_000, *(f"<html>{k}</html>" for k in range(40))]
    rows = [(k, f"http://{r.choice(['a.example.org', 'B.example.org', 'example.org'])}/{r.randrange(5)}?q={r.randrange(3)}", r.choice(texts)) for k in range(n)]
    rows += [(n, "http://hot.net/", "<p>hot</p>") for _ in range(20)]  # one id, one payload
    rows += [(n + k, "http://hot.net/", "<p>hot</p>") for k in range(1, 100)]
    rows += [(None, None, None), (None, "no address", "<html>1</html>"), (None, "x://y", "only null ids"), (-5, "http://line\r\nWARC-Type: revisit/ b", "crlf"), (3, "http://h", "shared id")]
    r.shuffle(rows)
    return rows


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 20])
def test_against_plain_rows(spark, least):
    rows = rows_of()
    assert result(warc.archived(frame(spark, rows).repartition(3), F.timestamp_seconds("page_id"), least)) == brute(rows, least)


def test_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = rows_of(60)
    assert result(warc.archived(frame(spark, rows), F.timestamp_seconds("page_id"))) == brute(rows)


def test_empty_table(spark):
    pages = frame(spark, rows_of(5)).where("page_id > 999999")
    assert warc.archived(pages, F.timestamp_seconds("page_id")).collect() == []


def test_global_order_and_places(spark):
    rows = rows_of()
    folder = shared_folder(spark)
    captures = warc.write(frame(spark, rows).repartition(4), folder, F.timestamp_seconds(F.col("page_id") % 7), run=16, file_bytes=2000)
    runs = {}
    for c in captures.collect():
        runs.setdefault(c.run, []).append(c)
    assert len(runs) >= 20 and all(len(r) <= 16 for r in runs.values())
    for run in runs.values():
        run.sort(key=lambda c: c.seq)
        keys = [warc.order(tuple(c)) for c in run]
        assert keys == sorted(keys)
    index = warc.merge(captures, most=40).orderBy("part", "position").collect()
    assert len(index) == len(rows) and len({c.part for c in index}) > 5
    keys = [warc.order(tuple(c)) for c in index]
    assert keys == sorted(keys) and keys == sorted(warc.order(tuple(c)) for c in captures.collect())
    hot = [c for c in index if c.url_key == "net,hot)/"]
    assert len(hot) == 119 and len({c.part for c in hot}) > 1  # a frequent URL is on several ranges
    history = {r.url_key: r for r in warc.histories(warc.merge(captures)).collect()}
    assert history["net,hot)/"].captures == 119 and sum(r.captures for r in history.values()) == len(rows)
    read = warc.read(warc.merge(captures, most=40), folder, payload=True).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in read if r.record_type == "response" and r.page_id is not None) == sorted(
        (i, h or "") for i, _, h in rows if (i, len((h or "").encode()), "response") in {(b[0], b[1], b[3]) for b in brute(rows)} and i is not None)
    files = list({c.file for c in index})
    whole = gzip.decompress(open(f"{folder.removeprefix('file:')}/{files[0]}", "rb").read())  # members concatenate to a plain archive
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and len(files) > 3


def test_records_round_trip():
    for text in ("", NASTY, "a", "é"):
        for name in ("5", None, "", "a:b>c"):
            data, digest = page_record(name, "http://a/ \r\nb", "2000-01-01T00:00:00Z", text.encode(), None, False)
            assert page_of(data) == (name, len(text.encode()), digest, "response", None, text.encode())
            data, _ = page_record("1", None, "2000-01-01T00:00:00Z", text.encode(), name, True)
            assert page_of(data) == ("1", len(text.encode()), digest, "revisit", name, None)
    good = record("response", {"A": "b"}, b"xyz")
    assert parsed(good) == ({"WARC-Type": "response", "A": "b", "Content-Length": "3"}, b"xyz")
    for bad in (good[:-1], good + b"x", b"HTTP" + good):
        with pytest.raises(ValueError):
            parsed(bad)
    with pytest.raises(ValueError):
        page_of(page_record("1", None, "", b"payload", None, False)[0].replace(b"payload", b"pAyload"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(20) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(k)]
    pairs = [[(v, n) for v in run] for n, run in enumerate(runs)]
    assert list(LoserTree(pairs, lambda p: p[:1])) == sorted(p for run in pairs for p in run)  # equal keys by run
