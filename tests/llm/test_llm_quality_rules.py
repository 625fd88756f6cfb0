"""Quality rules against a plain version, and the defined cases."""

import random
import re

import pytest

from pregonero.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def random_text(rng):
    words = ["a", "bé", "c#", "ñ|", "dd", "e f", "g"]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\n\n"]) for _ in range(rng.randint(0, 60)))


def test_base_figures_match_a_plain_version():
    rng = random.Random(5)
    for text in [None, "", " \n ", "x", *(random_text(rng) for _ in range(300))]:
        assert q.judge_text(text)[:6] == base(text), text


@pytest.mark.parametrize(
    "line, fault",
    [
        ("Home | About | Contact | Help", "navigation"), ("it%%% was$$$ the&&& one***", "symbols"), ("BUY NOW, THIS IS THE BEST", "shouting"),
        ("it! is! the best", "exclamation"), ("spam spam spam spam and more", "repeat"), ("one one two two three three", "repeat"),
        ("Please enable JavaScript to go on.", "boilerplate"), (" ".join(f"w{i}" for i in range(45)), "unpunctuated"), ("A plain sentence, as people write it.", None),
        ("The.", None), ("I | me", None), ("USA and UN", None),
    ],
)
def test_line_rules(line, fault):
    assert q.line_fault(line, line.encode().split()) == fault


def test_rejects_what_loses_too_much_and_cleans_the_rest():
    good = "A first sentence that says something here. And a second one that goes on."
    text = f"{good}\nHome | About | Contact | Us\nThen comes something else, told in quite other words."
    row = dict(zip([n for n, _ in q.FIELDS], q.judge_text(text)))
    assert row["kept"] and row["n_failed_lines"] == 1 and row["cleaned"] == text.replace("Home | About | Contact | Us\n", "")
    junk = good + "\n" + "a | b | c | d | e | f | g | h\n" * 3
    assert not dict(zip([n for n, _ in q.FIELDS], q.judge_text(junk)))["kept"]


def test_columns_nulls_repeated_rows_and_empty_tables(spark):
    good = "one two three four five six seven eight nine ten eleven."
    rows = [(1, good, "x"), (1, good, "x"), (None, None, None), (2, "", "y"), (3, "short", "z"), (4, good + " w" * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    out = q.apply_rules(docs)
    assert out.columns[:3] == ["doc_id", "text", "KEPT"] and "_kept" in out.columns
    got = sorted((r.doc_id or -1, r.n_words, r["_kept"]) for r in out.collect())
    assert got == [(-1, 0, False), (1, 11, True), (1, 11, True), (2, 0, False), (3, 1, False), (4, 50_011, False)]
    cleaned = q.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == 2
    assert q.apply_rules(docs.limit(0)).count() == 0


def test_boilerplate_needs_whole_words_and_a_short_line():
    prose = " ".join(f"word{i}," for i in range(500)) + " where one can read more of the privacy policy. " + "And so on it goes. " * 3
    for line in ("We show the design in blue.", "They assign in turn.", "A blog in French.", "The catalog in print.", "A dialog in two parts.", prose):
        assert q.line_fault(line, line.encode().split()) is None, line
    for line in ("Sign in", "Log in | Read more", "(c) All rights reserved.", "Please read our Privacy Policy here."):
        assert q.line_fault(line, line.encode().split()) == "boilerplate", line
    assert q.judge_text(prose)[6] and q.judge_text(prose)[-1] == prose


def test_check_sql_says_the_same_of_phrases(spark, tmp_path):
    """Phrases inside words, in long lines, at line ends and next to marks, for the operator and its check SQL."""
    import duckdb

    from pregonero.llm.queries import CHECKS, QUERIES

    line = "the quick brown fox and other animals went out for a long walk today"
    texts = [
        f"{line}\nlog in now", f"{line}\nthe blog in question is new", f"{line}\nassign in order", f"{line}\n(read more)", f"{line}\nREAD MORE", f"{line}\nread more_",
        f"{line}\nñread more", f"{line}\nread more 3read more", f"{line} and then please read more of this paragraph that goes on",
        "read more " + "word other thing " * 4, "click here " * 6, f"{line}\nsign in", f"{line}\nsign\tin", None, "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["op2_quality_rules"](spark, str(tmp_path))
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({CHECKS['op2_quality_rules']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert {r.doc_id for r in found.collect() if "boilerplate" in r.failed_rules} >= {0, 3, 4, 11}
