import datetime

import hypothesis.strategies as st
from hypothesis import given, settings

from gridtrace.llm import pii as P

F = P.Feistel(b"k")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**20), st.data())
def test_permutation_goes_back(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = F.permute(x, size, "t")
    assert 0 <= y < size and F.permute(y, size, "t", back=True) == x


def test_permutes_whole_ranges():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(F.permute(x, size, "t") for x in range(size)) == list(range(size))


def card(body):
    return body + P.luhn_digit(body)


def iban(country, rest):
    return country + P.iban_check(country, rest) + rest


VALUES = [
    ("email", "Jane.Doe_7@mail-2.Example.org"), ("card", card("411111111111111")), ("card", "4111 1111 1111 " + card("411111111111111")[-4:]),
    ("ipv4", "10.2.33.255"), ("date", "2021-02-28"), ("date", "31/12/1999"), ("date", "03/04/2001"), ("date", "12.11.2010"),
    ("ssn", "123-45-6789"), ("phone", "+1 (988) 555-2485"), ("phone", "(212) 555-0199"), ("iban", iban("DE", "370400440532013000")),
]


def test_each_kind_keeps_its_form_and_goes_back():
    for kind, value in VALUES:
        text = f"é {value}, end"
        ((k, s, e, new),) = P.find(text, F)
        assert (k, text[s:e]) == (kind, value) and new != value
        out = P.replace(text, [(k, s, e, new)])
        ((k2, _, _, old),) = P.find(out, F, back=True)
        assert (k2, old) == (kind, value)


def test_equal_values_stay_linked_across_forms():
    c = card("550000000000000")
    a = P.find(c, F)[0][3]
    b = P.find(" ".join(c[i : i + 4] for i in range(0, 16, 4)), F)[0][3]
    assert b.replace(" ", "") == a and P.luhn_digit(a[:-1]) == a[-1]


def test_invalid_values_stay():
    bad = "4111111111111112 1.2.3.456 2021-02-30 000-12-3456 DE00370400440532013000 12345 a@b version 4.0."
    assert P.find(bad, F) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([v for _, v in VALUES] + [" ", ", ", "x", "é", "1", "@", "-", "."]), max_size=8).map("".join))
def test_any_text_is_handled(text):
    found = P.find(text, F)
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))
    P.replace(text, found)


def test_dates_are_dates():
    for i in range(300):
        d = (datetime.date(1950, 1, 1) + datetime.timedelta(days=i * 37)).isoformat()
        datetime.date.fromisoformat(P.find(d, F)[0][3])


def test_table_with_odd_rows(spark):
    c = card("411111111111111")
    long = "word " * 100_000 + c
    rows = [(1, None, 5), (2, "", 5), (None, c, 5), (3, long, 5), (4, f"x {c}", 5), (4, f"x {c}", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = {r.doc_id: r for r in P.pseudonymize(df, key=b"k").collect()}
    new = got[None].text
    assert new != c and got[3].text.endswith(new) and got[4].text == f"x {new}" and got[1].text is None and got[2].text == ""
    assert all(r.kind == 5 for r in got.values()) and got[4].pii == "card:2:18"
    back = {r.doc_id: r.text for r in P.pseudonymize(P.pseudonymize(df, spans=None, key=b"k"), back=True, key=b"k").collect()}
    assert back == {r[0]: r[1] for r in rows}
    assert P.pseudonymize(df.limit(0), key=b"k").collect() == []


def test_query_is_whole(spark):
    from conftest import SF_SMALL

    from gridtrace.llm.queries import TEST_KEY, op5_pii_pseudonyms

    old = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = op5_pii_pseudonyms(spark, SF_SMALL).collect()
    f = P.Feistel(TEST_KEY.encode())
    assert len(got) == len(old) and any(r.pii for r in got)
    assert all(r.text == P.replace(old[r.doc_id], P.find(old[r.doc_id], f)) and (r.pii or r.text == old[r.doc_id]) for r in got)


def test_values_in_brackets_and_beside_words():
    de, at = iban("DE", "370400440532013000"), iban("AT", "1904300234573201")
    spaced = " ".join(at[i : i + 4] for i in range(0, 20, 4))
    cases = [(f"({v})", v) for _, v in VALUES if v[0] not in "(+"] + [("+" + VALUES[1][1], VALUES[1][1])]
    cases += [("(192.168.0.1)", "192.168.0.1"), ("(555-123-4567)", "555-123-4567"), ("at 2021-03-04T12:00:00Z", "2021-03-04")]
    cases += [(f"pay {spaced} EUR now", spaced), (f"pay {spaced} EURO", spaced), (f"{spaced} TO JOHN", spaced), (f"{de} EUR", de)]
    for text, value in cases:
        found = P.find(text, F)
        assert [text[s:e] for _, s, e, _ in found] == [value], text
        out = P.replace(text, found)
        assert out != text and P.replace(out, P.find(out, F, back=True)) == text
    for i in range(300):  # also where a longer run would be valid by chance
        v = iban("XX", f"{i:016d}")
        text = " ".join(v[j : j + 4] for j in range(0, 20, 4)) + " EUR"
        out = P.replace(text, P.find(text, F))
        assert out != text and P.replace(out, P.find(out, F, back=True)) == text


def test_a_key_is_needed(spark):
    import pytest

    df = spark.createDataFrame([(1, "mail jane@example.org")], "doc_id long, text string")
    with pytest.raises(ValueError, match=P.KEY):
        P.pseudonymize(df)
    spark.conf.set(P.KEY, "secret")
    try:
        assert P.pseudonymize(df).collect() == P.pseudonymize(df, key=b"secret").collect()
    finally:
        spark.conf.unset(P.KEY)


def test_addresses_with_leading_zeros_stay_and_dates_are_linked():
    assert P.find("010.001.002.003", F) == []
    (_, _, _, a), (_, _, _, b) = P.find("2021-03-04 and 04.03.2021", F)
    assert a == "-".join(reversed(b.split(".")))


def test_many_addresses_take_time_in_proportion():
    import time

    def seconds(n):
        text = " ".join(f"user{i}@example{i}.org 10.0.{i % 256}.7" for i in range(n))
        t = time.process_time()
        assert len(P.find(text, F)) == 2 * n
        return time.process_time() - t

    small = seconds(1000)
    assert seconds(16_000) < 16 * 4 * small + 1


def brute_values(text):
    """E-mail addresses, card numbers without gaps and ISO dates, by plain expressions and checks of their own."""
    import re

    out = [("email", *m.span()) for m in re.finditer(r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", text, re.ASCII)]
    for m in re.finditer(r"(?<![A-Za-z0-9])\d{16}(?![A-Za-z0-9])", text):
        doubled = [sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(m[0])]
        if sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"(?<![A-Za-z0-9])\d{4}-\d\d-\d\d(?![A-Za-z0-9])", text):
        try:
            if 1900 <= datetime.date.fromisoformat(m[0]).year < 2100:
                out.append(("date", *m.span()))
        except ValueError:
            pass
    return set(out)


def test_query_against_plain_expressions(spark):
    """Spans that expressions of their own find are replaced, by values of the same kind, equal ones alike; between spans nothing changes."""
    from conftest import SF_SMALL

    from gridtrace.llm.queries import op5_pii_pseudonyms

    old = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    link, n = {}, 0
    for r in op5_pii_pseudonyms(spark, SF_SMALL).collect():
        before = old[r.doc_id] or ""
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.pii.split(",") if x)]
        assert brute_values(before) <= set(spans)
        at = shift = 0
        for kind, s, e in spans:  # every pseudonym is as long as what it replaces, but for addresses of numbers
            assert (r.text or "")[at + shift : s + shift] == before[at:s]
            if kind == "ipv4":
                break
            new = r.text[s + shift : e + shift]
            assert link.setdefault((kind, before[s:e]), new) == new and len(new) == e - s
            if kind in ("email", "card", "date") and (kind, s, e) in brute_values(before):
                assert (kind, s, e) in brute_values(r.text)
            at, n = e, n + 1
    assert n
