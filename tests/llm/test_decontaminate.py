from varistack.llm import decontaminate as d

from .conftest import prose


def items(spark):
    rows = [(i, f"{prose(200 + i, 25)}. {prose(300 + i, 10)}.") for i in range(30)]
    rows += [(50, "Short one. Yes indeed."), (51, ""), (52, None), (0, rows[0][1])]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, bench):
    out = set()
    for doc, text in docs:
        words = d.words_of(text or "")
        held, joined = d._shingles(words), b" " + b" ".join(words) + b" "
        for item, own in bench:
            parts = [d._shingles(d.words_of(p)) for p in d.split_item(own or "")]
            if any(parts) and all(d._overlap(p, held, joined) >= 0.8 for p in parts):
                out.add((doc, item))
    return out


def corpus(bench):
    rows = [(i, prose(i, 80)) for i in range(20)]
    for i, text in [(r.item_id, r.text) for r in bench.collect() if r.text][:25]:
        rows.append((100 + i, f"{prose(i, 150)} {text.upper()} {prose(i + 1, 90)}"))
        rows.append((200 + i, f"{prose(i, 5)}\n{text.replace(' ', '!! ')}"))
        words = text.split()
        rows.append((300 + i, " ".join(words[: len(words) // 2])))
        rows.append((400 + i, " ".join([*words[:12], "changed", *words[13:]]) + " " + prose(i, 30)))
    rows += [(900, "well, short one: yes indeed"), (901, None), (902, "")]
    return rows


def test_matches_brute_force(spark):
    bench = items(spark)
    rows = corpus(bench)
    got = [(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), d.items_of(bench)).collect()]
    want = brute(rows, {(r.item_id, r.text) for r in bench.collect()})
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_shards_give_the_same(spark):
    bench = items(spark)
    docs = spark.createDataFrame(corpus(bench), "doc_id long, text string")
    one = {tuple(r) for r in d.contaminated(docs, d.items_of(bench)).collect()}
    many = {tuple(r) for r in d.contaminated(docs, d.items_of(bench), shard_bytes=1500).collect()}
    assert {r[:2] for r in one} == {r[:2] for r in many}
    assert max(abs(a[2] - b[2]) for a, b in zip(sorted(one), sorted(many))) < 1e-9


def test_filter_keeps_clean_rows_whole(spark, odd, none):
    bench = items(spark)
    found = d.items_of(bench)
    rows = corpus(bench)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = {r.doc_id for r in d.contaminated(docs, found).collect()}
    assert {r.doc_id for r in d.decontaminate(docs, found).collect()} == {i for i, _ in rows} - bad
    assert d.contaminated(odd, found).count() == 0
    kept = d.decontaminate(odd, found)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert d.decontaminate(none, found).count() == d.contaminated(none, found).count() == 0
    no_items = d.items_of(bench.limit(0))
    assert d.contaminated(docs, no_items).count() == 0 and d.decontaminate(docs, no_items).count() == docs.count()


def test_filter_by_shards(spark, odd):
    bench = items(spark)
    found = d.whole_items_of(bench)
    docs = spark.createDataFrame([*corpus(bench), (1, None), (1, "")], "doc_id long, text string")
    one, many = (sorted(map(str, d.decontaminate(docs, found, shard_bytes=size).collect())) for size in (1 << 20, 1500))
    assert one == many and len(one) < docs.count()
    assert d.decontaminate(odd, found, shard_bytes=1500).count() == odd.count()


def test_parts_of_any_length_at_any_distance(spark):
    """Questions and answers of 1 to 8 words, up to 5,000 words apart, in either order, whole and changed."""
    import random

    rng, bench, docs = random.Random(8), [], []
    for i in range(64):
        bench.append((i, prose(7000 + i, 1 + i % 8), prose(8000 + i, 1 + i // 8)))
        for k, gap in enumerate((0, 3, 40, 700, 5000)):
            parts = [bench[-1][1], bench[-1][2]]
            if k % 2:
                parts.reverse()
            if k == 3:
                words = parts[0].split()
                words[rng.randrange(len(words))] = "changed"
                parts[0] = " ".join(words)
            docs.append((i * 10 + k, f"{prose(i, 30)} {parts[0]} {prose(9000 + i * 10 + k, gap)} {parts[1]} {prose(i + 1, 20)}"))
        docs.append((i * 10 + 9, f"{prose(i, 300)} {bench[-1][1]}"))
    rows = [(*b, False) for b in bench]
    got = [(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, question string, answer string, whole boolean")).collect()]
    want = set()
    for doc, text in docs:
        words = d.words_of(text)
        held, joined = d._shingles(words), b" " + b" ".join(words) + b" "
        want |= {(doc, i) for i, q, a in bench if min(d._overlap(d._shingles(d.words_of(x)), held, joined) for x in (q, a)) >= 0.8}
    assert len(got) == len(set(got)) and set(got) == want
    assert {(i * 10 + k, i) for i in range(64) for k in (0, 1, 2, 4)} <= want


def test_thresholds_are_lower_bounds():
    """No text that holds 0.8 of an item's shingles scores under its threshold, repeated words and phrases included."""
    import random

    rng = random.Random(9)
    for trial in range(300):
        letters = "abcdefghijklm"[: rng.randint(2, 13)]
        q, a = ([rng.choice(letters) for _ in range(rng.randint(1, 30))] for _ in range(2))
        df = {w.encode(): rng.randint(1, 50) for w in letters}
        index = d.ItemIndex([(1, " ".join(q), " ".join(a), trial % 2 == 0)], df, 50, 20.0)
        text = q + ["zz"] + a
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(len(text))] = "zz"
        words = [w.encode() for w in text]
        held, joined = d._shingles(words), b" %b " % b" ".join(words)
        parts = [d._overlap(d._shingles(part), held, joined) for part in (*index.parts[0], index.parts[0][0] + index.parts[0][1])]
        fits = min(parts[:2]) >= 0.8 or (trial % 2 == 0 and parts[2] >= 0.8)
        assert bool(list(d.matches(index, [" ".join(text)]))) == fits
