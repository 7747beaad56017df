import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varistack.llm import secrets
from varistack.llm.secrets import ALL, RULES, Rule, redact, scan, trigram_query

TEXTS = [
    'é password = "abcdefghijkl" secret: token: abcdefghijklmnop TOKEN=shortone api_key:AAAABBBBCCCC',
    "AKIAABCDEFGHIJKLMN AKIASHORT xAKIA00000000000000Z",
    "0123456789abcdef 0123456789abcde deadbeefdeadbeef0 😀 ffffffffffffffff",
    "ghp_" + "a1" * 20 + " xoxb-123456789012 AIza" + "b" * 35 + " eyJab.eyJcd.ef_-",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    "token = token=0123456789abcdef0123",
    "nothing at all",
    "",
]


def brute(text):
    out = []
    for order, r in enumerate(RULES):
        for m in re.finditer(r.regex, text, re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), order, m.end(), r.kind))
    return sorted(out)


def test_spans_match_brute_force(spark):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert any(got.values())


def holds(query, text):
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "all" else any)(holds(q, text) for q in query[1:])


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_every_match_satisfies_its_query(data):
    rule = data.draw(st.sampled_from(RULES))
    match = data.draw(st.from_regex(re.compile(rule.regex, re.ASCII), fullmatch=True))
    assert holds(trigram_query(rule.regex), match.lower())


def test_queries():
    assert trigram_query("[0-9a-f]+") == ALL
    assert trigram_query("abcd(x|yz)?") == ("all", "abc", "bcd")
    assert trigram_query("(foo|bar)[0-9]+") == ("any", "bar", "foo")


def test_query_and_sql(spark, tmp_path):
    docs = spark.createDataFrame([*enumerate(TEXTS), (20, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, secrets.op4_secret_scan(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(secrets.ORACLE).fetchall())
    assert got[-1][4] == hashlib.sha256(b"").hexdigest()


def test_odd_rows_and_redaction(spark, odd, none):
    assert scan(odd).count() == odd.count() and scan(none).count() == 0
    assert scan(odd, (Rule("x", "[0-9]{2}"),)).where("doc_id = 8").first().spans[0].start == 0
    rows = [(1, TEXTS[5], 9), (1, TEXTS[5], 9), (None, TEXTS[2], 9), (2, None, 9), (3, "ffffffffffffffff", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 as spans", "2 as f_id")
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in redact(docs).collect()), key=str)
    assert got == sorted([(1, "[SECRET]", 8)] * 2 + [(None, "[SECRET] 0123456789abcde [SECRET] 😀 [SECRET]", 44), (2, None, 9), (3, "[SECRET]", 8)], key=str)
    assert redact(odd).columns == odd.columns and redact(odd).count() == odd.count() and redact(none).count() == 0


@pytest.mark.parametrize("text", TEXTS)
def test_least_length_in_the_regex_changes_nothing(text):
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
        short = pattern[:-1] + "{%d,}" % (least - (4 if kind == "access" else 0))
        assert [m.span() for m in re.finditer(pattern, text) if len(m.group()) >= least] == [m.span() for m in re.finditer(short, text)]
