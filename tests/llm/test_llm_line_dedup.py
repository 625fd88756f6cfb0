"""Line dedup: pieces, alignment against plain versions, and the defined cases."""

import itertools
import random

from pregonero.llm import line_dedup as ld

PASSAGE = (
    "Nine words make up this first sentence of it. The second one is a little longer than the first was.\n"
    "And so a third sentence follows on a line of its own here."
)


def cleaned(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in ld.dedup_lines(docs, **options).collect()}


def test_spans_cover_the_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "end. ", "x!", "\n", "\n\n", "ñ é ", "a b c d e f g h. "]) for _ in range(rng.randint(0, 30)))
        spans = ld.line_spans(text)
        assert "".join(text[a:b] for a, b, _ in spans) == text
        assert all(x[1] == y[0] for x, y in itertools.pairwise(spans))


def test_longest_run_against_all_subsequences():
    rng = random.Random(2)
    for _ in range(200):
        places = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        best = max(
            (len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if all(a < b for a, b in itertools.pairwise(c))),
            default=0,
        )
        run = ld.longest_run(places)
        assert len(run) == best and all(places[a] < places[b] and a < b for a, b in itertools.pairwise(run))


def test_passage_goes_from_all_but_the_first_document(spark):
    rows = [(i, f"Document {i} opens with words of its own only.\n{PASSAGE}\nDocument {i} closes with other words again.") for i in (5, 1, 9)]
    rows.append((20, f"In document {20} the passage begins within a line of at least eight words. {PASSAGE} And it ends within a line."))
    got = cleaned(spark, rows)
    assert got[1] == dict(rows)[1]
    for i in (5, 9):
        assert got[i] == f"Document {i} opens with words of its own only.\nDocument {i} closes with other words again."
    # the last sentence runs on in its line, so it is whole and goes with the passage
    assert got[20].startswith("In document 20 the passage begins within a line of at least eight words.")
    assert "Nine words" not in got[20] and "second one" not in got[20] and got[20].endswith("And it ends within a line.")


def test_short_common_lines_and_own_repeats_stay(spark):
    rows = [(i, f"The.\nYes.\nA line that only document number {i} has in it.\nThe end.") for i in range(30)]
    rows.append((100, "\n".join([PASSAGE] * 3)))
    assert cleaned(spark, rows) == dict(rows)


def test_order_matters_for_alignment(spark):
    a, b = "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "One two three four five six seven eight nine ten eleven."
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}")]
    assert cleaned(spark, rows, min_block_words=5)[2] == ""  # b crosses a and is found as moved
    rows = [(1, f"{a}\nin between\n{b}"), (2, f"{a}\n{b}")]
    assert cleaned(spark, rows, min_block_words=11) == {1: rows[0][1], 2: f"{a}\n"}  # two blocks of 10 and 11 words
    assert cleaned(spark, [(1, f"{a}\n{b}"), (2, f"{a}\n{b}")]) == {1: f"{a}\n{b}", 2: ""}


def test_edits_within_copies_leave_what_differs(spark):
    sentences = [f"Sentence number {i} of a text that has a good many of them." for i in range(12)]
    other = list(sentences)
    other[5] = "Something else entirely stands here in the copy now."
    got = cleaned(spark, [(1, " ".join(sentences)), (2, " ".join(other))])
    assert got[2].strip() == other[5]


def test_nulls_repeated_rows_large_groups_and_clashing_names(spark):
    rows = [(1, PASSAGE, 1), (1, PASSAGE, 1), (None, PASSAGE, 2), (2, None, 3), (3, "", 4), (4, " \n\n", 5)] + [(10 + i, PASSAGE, 6) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_BLOCKS int")
    out = ld.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "N_BLOCKS", "_n_blocks", "n_removed_words"]
    got = out.collect()
    assert [r.text for r in got if r.doc_id == 1] == [PASSAGE, PASSAGE]
    assert [r.text for r in got if r.doc_id is None] == [""]
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id in (2, 3, 4)) == [(2, None), (3, ""), (4, " \n\n")]
    assert all(r.text == "" and r.n_removed_words == len(PASSAGE.split()) for r in got if (r.doc_id or 0) >= 10)
    kept = ld.clean(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_very_long_document(spark):
    lines = [f"line number {i} has these words and the number {i * 7}" for i in range(20_000)]
    got = cleaned(spark, [(1, "\n".join(lines)), (2, "\n".join(["A beginning that stands only here, before the copy."] + lines[5:]))])
    assert got[2] == "A beginning that stands only here, before the copy.\n"




def test_no_long_shared_block_is_left(spark):
    rng = random.Random(7)
    pool = [" ".join(f"p{k}w{i}" for i in range(25)) + "." for k in range(15)]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {d} {j} and a few words more." for j in range(12))) for d in range(60)]
    got = cleaned(spark, rows)
    first = {}
    for d, text in rows:
        for line in text.split("\n"):
            first.setdefault(line, d)
    for d, text in rows:
        kept = got[d].split("\n")
        for line in set(text.split("\n")):
            if line.startswith("own"):
                assert line in kept  # clean lines stay
            elif first[line] == d:
                assert line in kept  # so does the first holder's line
            else:
                assert line not in kept


def test_block_goes_whole_where_its_lines_stand_apart_in_earlier_documents(spark):
    lines = [" ".join(f"s{k}w{i}" for i in range(15)) + "." for k in range(5)]
    apart = f"{lines[1]}\nAnother line stands between the two of them here.\n{lines[3]}"
    rows = [(0, apart)] + [(i, f"Only document {i} begins like this.\n" + "\n".join(lines) + f"\nOnly document {i} ends so.") for i in (1, 2, 3)]
    got = cleaned(spark, rows)
    assert got[0] == apart and got[1] == rows[1][1]
    for i in (2, 3):
        assert got[i] == f"Only document {i} begins like this.\nOnly document {i} ends so."


def test_windows_cover_every_run_of_enough_words():
    rng = random.Random(8)
    for _ in range(300):
        counts = [rng.choice([1, 2, 5, 9, 19, 20, 30]) for _ in range(rng.randint(1, 9))]
        text = "\n".join(" ".join(f"l{i}w{j}" for j in range(n)) for i, n in enumerate(counts))
        bounds = [w[1:3] for w in ld.line_windows(text)]
        for a, b in itertools.combinations_with_replacement(range(len(counts)), 2):
            inside = {p for x, y in bounds if a <= x and y <= b for p in range(x, y + 1)}
            assert inside == (set(range(a, b + 1)) if sum(counts[a : b + 1]) >= 20 else set())


def plain_diff(a, b):
    """Common runs of two lists of lines by plain patience diff: pairs of places."""

    def diff(x, y):
        once = [(i, y.index(t)) for i, t in enumerate(x) if t is not None and x.count(t) == 1 and y.count(t) == 1]
        best = [[p] for p in once]
        for k, p in enumerate(once):
            for j in range(k):
                if once[j][1] < p[1] and len(best[j]) >= len(best[k]):
                    best[k] = best[j] + [p]
        run = max(best, key=len, default=[])
        found = []
        for (i0, j0), (i1, j1) in itertools.pairwise([(-1, -1), *run, (len(x), len(y))]):
            if run:
                found += [(i0 + 1 + i, j0 + 1 + j) for i, j in diff(x[i0 + 1 : i1], y[j0 + 1 : j1])]
        return found + run

    return sorted(diff(a, b))


def test_patience_against_plain_diff():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 12))] for _ in range(2))
        shared = [
            {"place": i, "last": i, "spot": b.index(t), "repeated": b.count(t) > 1, "flags": ld.REPEATED * (a.count(t) > 1)}
            for i, t in enumerate(a) if t in b
        ]
        kept = [(shared[i]["place"], shared[i]["spot"]) for i in ld.patience(shared)]
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(kept))  # a common subsequence
        unique = {i for i, t in enumerate(a) if a.count(t) == 1 and b.count(t) == 1}
        if unique:  # of the unique lines as many are aligned as by the plain diff
            assert len(unique & {i for i, _ in kept}) == len(unique & {i for i, _ in plain_diff(a, b)})


def test_rising_runs_are_fewest():
    rng = random.Random(12)
    for _ in range(200):
        places = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        runs = ld.rising_runs(places)
        assert sorted(i for run in runs for i in run) == list(range(len(places)))
        assert all(i < j and places[i] < places[j] for run in runs for i, j in itertools.pairwise(run))
        falling = max(
            (len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if all(a >= b for a, b in itertools.pairwise(c))),
            default=0,
        )
        assert len(runs) == falling


def test_deletions_against_alignment_of_all_pairs(spark):
    """Every pair of documents compared: what stands in common runs of 20 words or more goes from the later one."""
    rng = random.Random(13)
    pool = [" ".join(f"p{k}w{i}" for i in range(rng.choice([6, 9, 14, 22]))) for k in range(40)]
    texts = []
    for d in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"line {j} of document {d} has words that are its own" for j in range(15)]
        if d and rng.random() < 0.5:
            other = texts[rng.randrange(d)]
            at = rng.randrange(12)
            lines[at : at + 3] = other[at // 2 : at // 2 + rng.randint(1, 6)]
        texts.append(lines)
    got = cleaned(spark, list(enumerate("\n".join(t) for t in texts)))
    for d, lines in enumerate(texts):
        gone = set()
        for other in texts[:d]:
            if other == lines:
                gone.update(range(len(lines)))
            for i, j in itertools.product(range(len(lines)), range(len(other))):
                n = 0
                while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n]:
                    n += 1
                if sum(len(x.split()) for x in lines[i : i + n]) >= 20:
                    gone.update(range(i, i + n))
        want = [x for i, x in enumerate(lines) if i not in gone]
        assert got[d].rstrip("\n").split("\n") == (want or [""]), d


def test_common_blocks_name_partner_and_lines(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(25)) + "." for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, c), (3, f"{b}\n{a}\nOnly here.\n{c}\n{a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in ld.common_blocks(docs).collect())
    assert [f[:6] for f in found if f[1] == 2] == [(3, 2, 3, 3, 0, 25)]
    # a is repeated in document 3, so b alone is aligned; both places of a cross it or repeat
    ones = [f for f in found if f[1] == 1]
    assert sorted((f[2], f[4]) for f in ones) == [(0, 1), (1, 0), (4, 0)]
    assert [f[2] for f in ones if not f[6]] == [0]
