import hypothesis.strategies as st
from hypothesis import given, settings

from gridtrace.llm import secrets as S

AUTO = S.automaton()
PIECES = ["password", "passwd", "Secret", "TOKEN", "api_key", "APIKEY", "Key", "=", ": ", '"', "'", " ", "abc123", "deadbeef" * 3, "AKIA", "A1B2C3D4E5F6G7H8", "é", "İ", "\n", ".", "tokentoken=", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_as_by_plain_expressions(text):
    assert [x for x in S.scan(text, AUTO) if x[0] in S.BASE_KINDS] == S.base_spans_plain(text)


def test_checksums_decide():
    good = S.crc_token("ghp_", "Zq" * 15)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert S.scan(f"x {good} y", AUTO) == [("github", 2, 2 + len(good))]
    assert S.scan(f"x {bad} y", AUTO) == []
    jwt = "eyJhbGciOiJIUzI1NiJ9.e30.c2ln"
    assert S.scan(jwt, AUTO) == [("jwt", 0, len(jwt))]
    assert S.scan("eyJub3QganNvbg.e30.c2ln", AUTO) == []


def test_table_with_odd_rows(spark):
    long = "x " * 200_000 + "password=hunter22"
    rows = [(1, None, 9), (2, "", 9), (None, "token: abcdef", 9), (3, long, 9), (3, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(S.digest_columns(S.scan_secrets(df)).collect(), key=str)
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].n_assign == by[2].n_assign == 0 and by[1].base_sha256 == S.sha([])
    assert by[None].spans == "assign:0:13"
    assert by[3].base_sha256 == S.sha([("assign", 400_000, 400_017)])
    assert S.digest_columns(S.scan_secrets(df.limit(0))).collect() == []


def test_query_against_plain(spark):
    from conftest import SF_SMALL

    from gridtrace.llm.queries import op8_secret_scan

    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = op8_secret_scan(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    assert all(r.base_sha256 == S.sha(S.base_spans_plain(texts[r.doc_id])) for r in got)
