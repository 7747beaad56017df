import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from varistack.llm import infilling

SF = "/root/testdata/sf0.001"


def by_hand(doc_id, text, percent=100, spm=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return n, "plain", text, None, None
    if h4 % 100 < spm:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    odd = ["", "\n", "\n\n\n", "a", "a\n", "\na", "x\r\ny\r\n", "$1 \\ $0\n{3}+\n", "<P", "P>\n<", "<<S>", "a<M>b", "<\nS>\n<M", "é漢😀\n😀\n", "no feed at all " * 9, None]
    made = ["".join(rng.choice("ab<PSM>\n\n$\\é😀 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [*odd, *made, "l\n" * 60_000, "w " * 400_000, "z" * 300_000 + "\n" + "y" * 300_000]


@pytest.mark.parametrize("percent", [100, 40])
def test_against_units_joined_by_hand(spark, percent):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in infilling.restore(infilling.infill(df, percent=percent)).collect()}
    forms = set()
    for i, text in rows:
        n, form, output, prefix, middle = by_hand(i, text, percent)
        r = got[i]
        assert (r.n, r.form, r.output, r.restored) == (n, form, output, text or ""), i
        assert (r.prefix is None, r.middle is None) == (prefix is None, middle is None)
        assert prefix is None or (len(r.prefix), len(r.middle)) == (prefix, middle)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in infilling.op11_fill_in_middle(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n, form, output, prefix, middle = by_hand(doc_id, text)
        r = got[doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(text or ""))


def test_query_matches_sql(spark):
    import duckdb

    want = duckdb.sql(infilling.ORACLE.replace("from documents", f"from '{SF}/documents.parquet'")).df().sort_values("doc_id")
    got = infilling.op11_fill_in_middle(spark, SF).toPandas().sort_values("doc_id")[list(want.columns)]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_odd_rows(spark, odd, odd_rows, none):
    extra = odd.withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).withColumn("output", F.lit(1)).withColumn("h1", F.lit(1)).withColumn("a", F.lit(1))
    got = infilling.restore(infilling.infill(extra))
    assert got.columns == ["doc_id", "n", "form", "output", "prefix", "middle", "suffix", "restored"]
    want = sorted((str(i), *by_hand(i, t)[:3], t or "") for i, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r.n, r.form, r.output, r.restored) for r in got.collect()) == want
    assert infilling.infill(none).collect() == []


def test_other_units(spark):
    """Sentences and characters count as units, too."""
    df = spark.createDataFrame([(i, "One. Two! Three\nstill three? Four" * i) for i in range(30)], "doc_id long, text string")
    for unit in ("[^.!?]*[.!?]|[^.!?]+", "(?s)."):
        rows = infilling.restore(infilling.infill(df, unit=unit, seed=11)).join(df, "doc_id").collect()
        assert all(r.restored == r.text for r in rows)
        for r in rows:
            assert r.n == len(re.findall(unit, r.text))
