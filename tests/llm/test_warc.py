import hashlib
import io

from tessera.llm import warc as W


def test_archive_round_trip():
    records = [W.record(i, "http://a b/", (b"<html>%d" % i) * 50, 400, "0" * 64, None, "2024-01-01T00:00:00Z") for i in range(30)]
    out = io.BytesIO()
    W.write_archive(out, records, 2048, 3)
    assert out.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    assert list(W.read_archive(io.BytesIO(out.getvalue()), piece=37)) == records
    out = io.BytesIO()
    W.write_archive(out, [b"tiny"], 2048, 3)  # too little to train on
    assert list(W.read_archive(io.BytesIO(out.getvalue()))) == [b"tiny"]


def test_contract(spark):
    long = "<p>same é</p>" * 20
    rows = [(5, "u", long), (3, "u", long), (9, None, long), (4, "u", "x" * 99), (2, "u", "x" * 99), (7, "u", None), (8, "u", ""), (3, "u", long), (None, "u", long), (10, "u", "big " * 300_000), (11, "u", "a\r\n\r\nContent-Length: 5\r\n\r\nb" * 9)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = W.warc_round_trip(pages, archive_bytes=4096).collect()
    key = lambda r: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = raw == long.encode() and i not in (3, None)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(((r["row_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert W.warc_round_trip(pages.limit(0)).collect() == []


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<b>one</b>")], "page_id long, url string, html string")
    manifest = W.write_warc(pages, str(tmp_path / "w"))
    assert W.read_warc(manifest, str(tmp_path / "w"), with_payload=True).first()["payload"] == b"<b>one</b>"
    assert manifest.first()["n_records"] == 1


def test_record_ids_are_unique_and_referred_to(spark, tmp_path):
    import re

    long = "<p>words</p>" * 20
    rows = [("b", long), ("a b", long), ("c", "other " * 30), ("c", "other " * 30), ("d", "other " * 30), (None, long), (None, long), ("e", ""), ("e", "")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string").repartition(2)
    folder = str(tmp_path / "ids")
    manifest = W.write_warc(pages, folder)
    heads = []
    for r in manifest.collect():
        with open(r["path"], "rb") as f:
            heads += [x.partition(b"\r\n\r\n")[0].decode() for x in W.read_archive(f)]
    ids = [re.search("WARC-Record-ID: (.*)\r", h)[1] for h in heads]
    assert len(set(ids)) == len(rows)
    refers = [re.search("WARC-Refers-To: (.*)\r", h + "\r") for h in heads if "revisit" in h]
    assert len(refers) == 2 and sum(x is not None for x in refers) == 1  # "c" is there twice, so "d" has a row to refer to alone
    assert {x[1] for x in refers if x} <= set(ids)
    got = {(r["row_id"], r["record_type"], r["refers_to"]) for r in W.read_warc(manifest, folder, id_type="string").collect()}
    assert got == {("a b", "response", None), ("b", "revisit", "a b"), ("c", "response", None), ("d", "revisit", "c"), (None, "response", None), ("e", "response", None)}


def test_object_store_paths():
    assert W.open_store("file:///tmp/x")[1] == "/tmp/x" and W.open_store("/tmp/x")[1] == "/tmp/x"
