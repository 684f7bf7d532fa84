import hashlib
import random

import pytest
import zstandard

from foldmark.llm import warc
from foldmark.session import scratch_path


def brute(rows, least=1000):
    groups = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            groups.setdefault(body, []).append(page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        ids = [i for i in groups.get(body, []) if i is not None]
        last = max(ids) if ids else None
        refers = last if body in groups and last != page and last is not None else None
        out.append((page, len(body), hashlib.sha1(body).hexdigest(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(5)
    words = ["<p>", "año", "the", "</p>\r\n\r\n", "x" * 30, "naïve", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 400, 900]))) for _ in range(40)]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)]
    rows += [(100 + i, "http://copy", texts[i % 5] + "c" * 1000) for i in range(60)]    # hot copies
    rows += [(None, None, None), (None, "a b\r\nc", texts[0] + "c" * 1000), (900, "http://same", "z" * 1000),
             (900, "http://same", "z" * 1000), (901, "u", "z" * 999), (902, "u", "z" * 999),
             (903, "u", ""), (None, "n", "q" * 2000), (None, "n", "q" * 2000),
             (904, "long", "long " * 400_000)]
    return rows


def test_archives_give_back_what_brute_force_expects(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "page_id long, url string, html string, _refers int, _same string")
    path = warc.write_archives(df.repartition(3), scratch_path(spark, "warc"), limit=20_000)
    got = warc.read_archives(spark, path)
    found = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                    for r in got.collect()], key=repr)
    assert found == brute(rows)
    bodies = {r.page_id: bytes(r.payload) for r in got.filter("page_id IS NOT NULL AND payload IS NOT NULL").collect()}
    assert all(bodies[p] == (h or "").encode() for p, _, h in rows if p in bodies)
    assert {r.url for r in got.filter("page_id IS NULL").collect()} == {None, "a%20b%0D%0Ac", "n"}


def test_large_lookups_give_the_same(spark, monkeypatch):
    from foldmark.operators import lookup
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_report(df)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)


def test_an_archive_opens_with_its_dictionary_and_damage_is_noticed():
    records = [warc.record(i, "http://x", (f"<p>{i} the same words again {i * i}</p>" * 40).encode(),
                           hashlib.sha1((f"<p>{i} the same words again {i * i}</p>" * 40).encode()).digest(),
                           None, "1970-01-01T00:00:00Z") for i in range(300)]
    data = warc.archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert list(warc.records_in(data)) == records
    assert len(data) < sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    alone = warc.archive(records[:1])
    assert list(warc.records_in(alone)) == records[:1]
    first = warc.frame_end(data, 0)
    broken = bytearray(data)
    broken[first + 30] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        [warc.parsed(r) for r in warc.records_in(bytes(broken))]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_in(data[:-3]))
    wrong = records[0].replace(b"the same words", b"the shame word")
    with pytest.raises(ValueError):
        warc.parsed(wrong)


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_report(df).count() == 0
