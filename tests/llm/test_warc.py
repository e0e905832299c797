import base64
import gzip
import hashlib
import random

import pytest

from tellmark.llm import warc


def rows():
    rng = random.Random(8)
    html = [f"<p>é{i}</p>" * rng.randrange(1, 50) for i in range(40)] + ["", None, "x" * 200_000]
    out = []
    for i in range(600):
        host = rng.choice(["www.example.com", "a.b.org:8080", "example.com", "hot.net"])
        url = rng.choice([f"https://{host}/p/{rng.randrange(30)}?q=ü {i % 3}", f"http://{host}", None, "odd\nurl", ""])
        out.append((i * 5, url, rng.choice(html) if rng.random() < 0.7 else f"own {i}"))
    return out + [(None, "http://x.y/", "null id"), (7, "http://x.y/", "twice"), (7, "http://x.y/", "twice")]


def plain(data, least=0):
    top = {}
    for i, _, h in data:
        h, i = h or "", -1 if i is None else i
        top[h] = max(top.get(h, -1), i)
    out = []
    for i, _, h in data:
        raw, n = (h or "").encode(), -1 if i is None else i
        again = len(raw) >= least and top[h or ""] > n
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    data = rows()
    df = spark.createDataFrame([(*r, "f", 3) for r in data], "page_id long, url string, html string, file string, offset int").repartition(6)
    got = sorted(map(tuple, warc.round_trip(df, min_bytes=least).collect()), key=str)
    assert got == plain(data, least)


def test_files_are_readable_without_the_index(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "a")).count()
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").iterdir())
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(data)
    payloads = [h for _, _, h in data if h and h.startswith("own")]
    assert all(p.encode() in text for p in payloads)


def test_lookup_finds_wanted_and_only_wanted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    captures = warc.write(df, str(tmp_path))
    parts = warc.build_index(captures, str(tmp_path))
    assert parts.agg({"blocks": "sum"}).first()[0] >= len(data) / 8
    wanted = spark.createDataFrame([("com,example)/", 5), ("a", 1), ("zz", 9), (warc.url_key(data[10][1]), data[10][0])], "surt string, capture long")
    got = warc.lookup(wanted, parts, str(tmp_path)).collect()
    keys = {tuple(r)[:2] for r in wanted.collect()}
    assert sorted((r["surt"], r["capture"]) for r in got) == sorted(
        (warc.url_key(u), i) for i, u, _ in data if (warc.url_key(u), i) in keys
    )


def test_keys():
    assert warc.url_key("http://WWW.Example.com:80/a b?c#d") == "com,example)/a%20b?c"
    assert warc.url_key("https://u@sub.Example.org:8443") == "org,example,sub:8443)/"
    assert warc.url_key(None) == "-" and warc.url_key("") == "-" and " " not in warc.url_key("no host\n")


def test_damage_is_noticed():
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    raw = warc.record(4, "http://a/", b"abc", digest, None)
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
