import gzip
import hashlib
import io

from pyspark.sql import functions as F

from gridtrace.llm import warc as Wa
from gridtrace.session import new_path, ship


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_members_with_and_without_their_length():
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "payload": b"x" * n, "payload_length": n, "target_uri": "a\r\nb%"} for i, n in enumerate((0, 10, 300_000))]
    own = b"".join(Wa.member(Wa.record(r)) for r in rows)
    plain = b"".join(gzip.compress(Wa.record(r)) for r in rows)
    assert gzip.decompress(own) == gzip.decompress(plain)
    for data in (own, plain):
        got = list(Wa.records(File(data), [], True))
        assert [len(r["payload"]) for r in got] == [0, 10, 300_000] and got[0]["target_uri"] == "a\r\nb%"
        some = list(Wa.records(File(data), [Wa.Test("payload_length", "ge", 10)], False))
        assert [(r["record_id"], r["payload"]) for r in some] == [("urn:page:1", None), ("urn:page:2", None)]


def want(rows):
    """page_id -> expected result, by plain comparison."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in data:
        same = [j for j, c in data if c == b and j is not None]
        whole = max(same) if same and len(b) >= 1000 and sum(c == b for _, c in data) > 1 else None
        revisit = whole is not None and i != whole
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", whole if revisit else None))
    return sorted(out, key=str)


def test_odd_rows(spark):
    ship(spark)
    big, huge = "é" * 700, "y" * 3_000_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", big), (9, "u", big), (None, "u", big), (5, "u", "short"), (6, "u", "short"), (7, "u\n", huge), (8, "v", huge)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")
    path = new_path(spark, "warc")
    Wa.write_pages(df, path)
    assert sorted((tuple(r) for r in Wa.read_pages(spark, path).collect()), key=str) == want(rows)
    empty = new_path(spark, "warc")
    Wa.write_pages(df.limit(0), empty)
    assert Wa.read_pages(spark, empty).collect() == []


def test_pushdown_and_manifests(spark):
    ship(spark)
    path = new_path(spark, "warc")
    df = spark.range(50).selectExpr("id AS page_id", "'http://h/' || id AS url", "repeat(string(id), 900) AS html")
    Wa.write_pages(df, path)
    with gzip.open(path.removeprefix("file://") + "/part-lost.warc.gz", "wb") as f:
        f.write(Wa.record({"record_id": "urn:page:99", "record_type": "response"}))
    all_ = Wa.read_records(spark, path)
    assert all_.count() == 50  # what a lost attempt left isn't listed
    some = all_.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h/4") & (F.col("payload_length") > 900))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert sorted(r.target_uri for r in some.collect()) == [f"http://h/{i}" for i in range(40, 50)]


def test_query_against_plain(spark):
    from conftest import SF_SMALL

    from gridtrace.llm.queries import op9_warc

    ship(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in op9_warc(spark, SF_SMALL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == want(rows)
