"""Positional index against a scan of all windows, and the defined cases."""

import random
import re

import pyarrow.parquet as pq

from pregonero.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size, slop):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= names
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in rows), key=str)


def tables(spark, seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d1", "e", "ñandú", "g"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(99, None), (98, "..."), (3, text(4))]
    docs = [(i, text(rng.randint(0, 80))) for i in range(n)] + [(500, None), (501, ""), (502, items[5][1]), (502, items[5][1]), (None, items[6][1])]
    return docs, items


def test_equals_a_scan_of_all_windows(spark):
    docs, items = tables(spark)
    index = d.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block_words=400)
    assert index.count() > 3
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (3, 5):
        want = plain(docs, items, size, 2)
        assert sum(n > 0 for _, _, n, _ in want) > 20
        assert found(d.search(index, bench, size).collect()) == want
        assert found(d.search(index, bench, size, slice_chars=60).collect()) == want  # many slices, same hits


def test_near_hits(spark):
    docs = spark.createDataFrame([(1, "x one two and three four y"), (2, "four three two one"), (3, "one two three four"), (4, "one " + "z " * 9 + "two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "One, two; three four")], "item_id long, text string")
    got = {r.id: (list(r["items"]), list(r.near_items)) for r in d.search(d.build_index(docs), bench, 4, slop=1).collect()}
    assert got == {1: ([], ["7"]), 2: ([], []), 3: (["7"], ["7"]), 4: ([], [])}
    wide = {r.id: list(r.near_items) for r in d.search(d.build_index(docs), bench, 4, slop=6).collect()}
    assert wide[2] == ["7"] and wide[4] == []


def test_windows_do_not_run_from_one_document_into_the_next(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    assert all(not r.near_items for r in d.search(d.build_index(docs), bench, 4, slop=50).collect())


def test_dropping_keeps_clean_rows_columns_and_equal_ids(spark):
    rows = [(1, "the answer is forty two of course", "k"), (1, "nothing to see", "k"), (2, None, None), (None, "the answer is forty two of course", "x"), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEY string")
    bench = spark.createDataFrame([(1, "answer is forty two")], "item_id long, text string")
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "nothing to see"), (2, None), (3, "")]
    assert d.drop_contaminated(docs, bench.limit(0)).count() == 5
    assert d.drop_contaminated(docs.limit(0), bench).count() == 0


def test_long_document_with_repeated_passages(spark):
    passage = "this very passage has been repeated over and over again"
    docs = spark.createDataFrame([(1, ("filler word " * 30_000 + passage + " ") * 3)], "doc_id long, text string")
    row = d.search(d.build_index(docs, block_words=1000), spark.createDataFrame([(1, passage)], "item_id long, text string")).first()
    assert row.n_hit == 30 and row.n_words == 3 * 60_010


def test_items_without_id_count(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, passage + " eleven"), (7, passage), (8, None)], "item_id long, text string")
    found = {r.id: r for r in d.search(d.build_index(docs), items).collect()}
    assert found[1].n_hit == 10 and found[1]["items"] == ["7", None] and found[2].n_hit == 0
    assert d.drop_contaminated(docs, items.filter("item_id is null")).select("doc_id").collect() == [(2,)]


def test_no_row_group_of_the_index_holds_many_blocks(spark):
    """Readers and writers hold a row group at once, so it must not grow with the rows of a task."""
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', x * id))) AS text")
    index = d.build_index(docs, block_words=1000)
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == index.count() == 30 and max(groups) <= 4


def test_dropping_searches_an_index_of_small_row_groups(spark, monkeypatch):
    seen = []

    def drop(index):
        files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in index.inputFiles()]
        seen.extend(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups))

    monkeypatch.setattr(d, "drop_written", drop)
    monkeypatch.setattr(d, "build_index", lambda *a, build=d.build_index: build(*a, block_words=1000))
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', x * id))) AS text")
    bench = spark.createDataFrame([(1, "w7 w14 w21 w28")], "item_id long, text string")
    kept = d.drop_contaminated(docs, bench, size=4)
    assert sum(seen) == 30 and max(seen) <= 4 and kept.count() == 599
