"""Exact duplicates, near duplicates, repeated lines, decontamination: edge cases and brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_helpers import all_pairs

from gridloom.llm import blocknames, decontam, jaccard, linerepeats
from gridloom.llm.components import components
from gridloom.llm.jaccard import JaccardSettings


def test_exact_duplicates_edge_cases(frame, monkeypatch):
    monkeypatch.setattr(blocknames, "BLOCK_BYTES", 8)  # long texts take several rounds of pairing
    long = "abcdefg " * 40
    rows = [(5, "a\t\n b"), (2, "a b"), (9, None), (7, ""), (3, long), (1, long + "x"), (8, long), (None, "a b"), (4, "x"), (4, "x"), (6, " "), (10, long[8:])]
    got = sorted(blocknames.exact_duplicates(frame(rows)).collect(), key=str)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[2] == [(2, 3, True)] and by[5] == [(2, 3, False)] and by[None] == [(2, 3, False)]
    assert by[7] == [(7, 2, True)] and by[9] == [(7, 2, False)] and by[6] == [(6, 1, True)]
    assert by[3] == [(3, 2, True)] and by[8] == [(3, 2, False)] and by[1] == [(1, 1, True)] and by[10] == [(10, 1, True)]
    assert sorted(by[4]) == [(4, 2, False), (4, 2, True)]
    assert {r.text_sha256 for r in got if r.doc_id in (7, 9)} == {hashlib.sha256(b"").hexdigest()}
    assert blocknames.exact_duplicates(frame([])).count() == 0
    assert sorted(r.doc_id for r in blocknames.deduplicate(frame([(1, "q"), (2, "q"), (3, "r")])).collect()) == [1, 3]


def near_copies(seed, n=60):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6, 12])):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(n + i, " ".join(f"u{rnd.randrange(50)}" for _ in range(rnd.randrange(1, 9)))) for i in range(20)]
    return rows


@pytest.mark.parametrize("settings", [JaccardSettings(), JaccardSettings(words=3, percent=90, orders=4, common=1)])
def test_jaccard_components_of_a_large_group(frame, settings):
    rows = near_copies(settings.words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(frame(rows), settings).collect()}
    assert got == all_pairs(dict(rows), settings.words, settings.percent)


def test_jaccard_slot_counts_never_say_too_much():
    rnd = np.random.default_rng(5)
    for n in (1, 3, 200, 255, 257, 1000, 5000):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        for kept, new in ((n, 0), (n, n // 4 + 1), (n // 2, 0), (n // 2, n), (0, 3 * n)):
            b = np.concatenate([a[:kept], rnd.integers(0, 2**63, new).astype(np.uint64)])
            least = jaccard.least_difference(jaccard.slot_counts(a), jaccard.slot_counts(b))
            assert least <= n - kept + new
            assert least == jaccard.least_difference(jaccard.slot_counts(b), jaccard.slot_counts(a))
    assert jaccard.least_difference(jaccard.slot_counts(a), jaccard.slot_counts(a)) == 0


def test_jaccard_compares_few_sets_of_a_large_group(frame, monkeypatch):
    rows, sent, passed = near_copies(5, 200), [], []
    exact, write = jaccard.JaccardJoin._exact, jaccard.materialize

    def counted(join, pairs, sets):
        sent.append(pairs.count())
        return exact(join, pairs, sets)

    def written(df, label):
        out = write(df, label)
        passed.extend([out.count()] if label == "passed" else [])
        return out

    monkeypatch.setattr(jaccard.JaccardJoin, "_exact", counted)
    monkeypatch.setattr(jaccard, "materialize", written)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(frame(rows)).collect()}
    assert got == all_pairs(dict(rows), 5, 80)
    assert sum(sent) < sum(passed) and sent[0] < len(rows)


def test_jaccard_edge_cases(frame):
    same = "one two three four five six seven"
    rows = [(3, same), (1, same.upper() + "\n"), (2, None), (4, ""), (5, " \t"), (6, "one two"), (7, "One  TWO"), (None, same), (8, "x" * 300_000), (8, "x" * 300_000)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(frame(rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, 1), (1, 3, 1), (2, 0, 2), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (None, 3, None), (8, 1, 8), (8, 1, 8)], key=str)
    kept = jaccard.keep_one_of_each(frame(rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, 6, None, 8, 8], key=str)
    assert kept.columns == frame([]).columns
    assert jaccard.similarity_components(frame([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    chain = list(range(40))
    rnd.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 160)}}


def deleted(frame, rows, words=6):
    out = linerepeats.delete_repeats(frame(rows), min_words=words)
    return [(r.row.doc_id, r.row.text, r.deleted, r.sources, r.emptied) for r in out.collect()]


def test_repeated_runs_of_lines(frame):
    passage = "alpha beta gamma\ndelta epsilon\nzeta eta theta"  # eight words in three short lines
    rows = [
        (1, f"own first line\n{passage}\nanother tail"),
        (2, f"{passage}"),
        (3, f"before\n{passage}\nafter\nalpha beta gamma\nend"),
        (4, "alpha beta gamma\nown words"),  # three words are too few
        (5, None),
        (6, ""),
        (7, "\n\n\n\n\n\n\n\n"),
    ]
    got = {i: (text, n, sources, emptied) for i, text, n, sources, emptied in deleted(frame, rows)}
    assert got[1] == (rows[0][1], 0, [], False)
    assert got[2] == ("", 3, [1], True)
    assert got[3] == ("before\nafter\nalpha beta gamma\nend", 3, [1], False)
    assert got[4] == (rows[3][1], 0, [], False) and got[5] == (None, 0, [], False) and got[6] == ("", 0, [], False)
    assert got[7][3] is True or got[7][1] == 0
    assert deleted(frame, []) == []


def test_repeats_within_a_document_and_repeated_rows(frame):
    line = "one two three four five six seven"
    got = deleted(frame, [(1, "\n".join([line] * 5)), (None, line), (1, "\n".join([line] * 5)), (2, line + "\r\nx")])
    assert sorted((str(i), text, n) for i, text, n, _, _ in got) == [("1", line, 4), ("1", line, 4), ("2", line + "\r\nx", 0), ("None", "", 1)]


def test_a_run_whose_lines_stood_scattered_before_is_deleted_whole(frame):
    passage = [f"a{k} b{k}" for k in range(30)]  # sixty words
    scattered = "\n".join(f"{line}\nfiller of document zero number {k}" for k, line in enumerate(passage))
    run = "\n".join(passage)
    wide = "one two three four five six seven eight\nnine ten eleven"  # found from its last line
    rows = [(0, scattered), (1, f"own one\n{run}\nend one"), (2, f"own two\n{run}\nend two"), (3, f"x\n{wide}\ny"), (4, f"nine ten eleven\nu\n{wide}\nv")]
    got = {i: (text, n, sources) for i, text, n, sources, _ in deleted(frame, rows, 10)}
    assert got[0][1] == got[1][1] == got[3][1] == 0
    assert got[2][:2] == ("own two\nend two", 30) and 1 in got[2][2]
    assert got[4][0] == "nine ten eleven\nu\nv"


@pytest.mark.parametrize("words", [4, 7])
def test_every_window_that_stood_before_is_deleted(frame, words):
    rnd = random.Random(words)
    pool = [" ".join(f"t{k}" for _ in range(rnd.randrange(1, 6))) for k in range(5)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    got = {i: text for i, text, *_ in deleted(frame, rows, words)}
    seen = set()
    for i, text in rows:
        lines, here, gone = text.split("\n"), [], set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= words:
                    run = tuple(lines[a:b])
                    gone |= set(range(a, b)) if run in seen or run in here else set()
                    here.append(run)
        seen |= set(here)
        rest = iter(x for k, x in enumerate(lines) if k not in gone)
        assert all(any(x == y for y in rest) for x in (got[i].split("\n") if got[i] else []))


def test_a_run_of_just_enough_words_is_deleted_whatever_its_hashes(frame):
    rnd = random.Random(8)
    rows = []
    for k in range(40):
        run = "\n".join(f"w{rnd.random()} v{rnd.random()}" for _ in range(5))  # ten words
        rows += [(2 * k, f"a{k} b{k} c{k}\n{run}\nd{k} e{k} f{k}"), (2 * k + 1, f"g{k} h{k} i{k}\n{run}\nj{k} k{k} l{k}")]
    got = {i: n for i, _, n, _, _ in deleted(frame, rows, 10)}
    assert got == {i: 5 * (i % 2) for i in got}
    wide = linerepeats.delete_repeats(frame(rows), min_words=10, window=5)
    assert all(r.deleted <= got[r.row.doc_id] for r in wide.collect())


def mixed_documents(seed, distinct):
    rnd = random.Random(seed)
    pool = [" ".join(f"t{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 6))) + (f" p{k}" if distinct else "") for k in range(40)]
    if distinct:
        passages = [pool[8 * k : 8 * k + 8] for k in range(4)]
    else:
        passages = [[rnd.choice(pool) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(25):
        lines = [f"only {i} {k}" for k in range(rnd.randrange(4))]
        rows.append((i, "\n".join(lines + rnd.choice(passages) + [f"tail {i}"])))
    return rows, passages


@pytest.mark.parametrize("distinct", [True, False])
def test_deleted_lines_repeat_earlier_ones_and_copied_passages_go(frame, distinct):
    rows, passages = mixed_documents(4, distinct)
    seen, first = set(), set()
    for (i, text), (_, kept, _, _, _) in zip(rows, sorted(deleted(frame, rows))):
        lines, left = text.split("\n"), kept.split("\n")
        own = [x for x in lines if x.startswith(("only", "tail"))]
        assert own == [x for x in left if x.startswith(("only", "tail"))]
        assert all(x in seen or lines.count(x) > 1 for x in lines if x not in left)
        if distinct:  # a later copy of a passage keeps none of its lines, the first all of them
            passage = next(k for k, p in enumerate(passages) if p[0] in lines)
            assert left == (own if passage in first else lines)
            first.add(passage)
        seen |= set(lines)


def edit_distance(a, b):
    """Smallest distance of ``a`` to a substring of ``b``, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_myers_equals_the_table():
    rnd = random.Random(1)
    for _ in range(300):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 12)))
        b = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 30)))
        distance, end = decontam.myers(decontam.masks(a), len(a), b)
        assert distance == edit_distance(a, b) and distance == min(len(a), edit_distance(a, b[:end]))


def test_contaminations(spark, frame):
    rnd = random.Random(3)
    item = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20))  # 139 characters, 6 edits
    near = list(item)
    for at in (3, 40, 77, 100, 120, 138):
        near[at] = "Z"
    far = list(near)
    far[60] = "Z"
    filler = " ".join("".join(rnd.choice("ijklmnop") for _ in range(5)) for _ in range(50))
    rows = [
        (1, f"{filler} {item.upper()}\n{filler}"),
        (2, f"{filler} {''.join(near)}"),
        (3, f"{filler} {''.join(far)}"),
        (4, item.replace(" ", "\n\t ")),
        (5, item[1:70] + item[72:]),
        (6, None),
        (7, ""),
        (8, filler * 200),
        (1, item),
        (None, item),
    ]
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "short"), (14, item)], "item_id BIGINT, text STRING")
    five = decontam.MatchSettings(error_rate=0.05)
    found = decontam.contaminations(frame(rows), items, five)
    got = sorted(((r.doc_id, r.distance) for r in found.where("item_id = 10").collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 6), (4, 0), (5, 3), (None, 0)], key=str)
    assert found.where("item_id = 14").count() == len(got) and found.where("item_id in (11, 12, 13)").count() == 0
    small_blocks = decontam.contaminations(frame(rows), items, decontam.MatchSettings(error_rate=0.05, block_chars=100))
    assert sorted(map(str, small_blocks.collect())) == sorted(map(str, found.collect()))
    kept = decontam.without_contaminated(frame(rows[:8]), items, five)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8] and kept.columns == frame([]).columns
    assert decontam.contaminations(frame([]), items).count() == 0
    assert decontam.contaminations(frame(rows), items.where("false")).count() == 0


def test_rows_are_judged_by_their_own_text_and_short_items_as_words(spark, frame):
    item = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"so {item}"), (1, "clean"), (None, item), (None, "clean too"), (2, "An answer: Forty Two!"), (3, "forty twofold"), (4, "xforty two"), (5, None)]
    items = spark.createDataFrame([(10, item), (11, "forty two"), (12, "")], "item_id BIGINT, text STRING")
    found = decontam.contaminations(frame(rows), items.where("item_id > 10"))
    assert [(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in found.collect()] == [(2, 11, 0, 11, 20)]
    for blocks in (decontam.MatchSettings(), decontam.MatchSettings(block_chars=10)):
        kept = decontam.without_contaminated(frame(rows), items, blocks)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[k] for k in (1, 3, 5, 6, 7)], key=str)
        assert kept.schema == frame([]).schema


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_short_items_are_found_with_their_edits():
    rnd = random.Random(5)
    words = ["the", "fox", "of", "ten", "ab", "aab", "aba", "b", "fix"]
    matched = 0
    for _ in range(400):
        item = " ".join(rnd.choices(words, k=rnd.randint(1, 6)))[:19].strip()
        chars = list(item)
        for _ in range(rnd.randint(0, 2)):  # a damaged copy among other words
            at = rnd.randrange(len(chars))
            chars[at : at + 1] = rnd.choice([[], ["x"], [chars[at], "y"]])
            chars = chars or ["z"]
        text = decontam.normal(" ".join([*rnd.choices(words, k=3), "".join(chars), *rnd.choices(words, k=3)]))
        k = int(len(item) * 0.08)
        ends = [i for i in range(len(text) + 1) if decontam.whole_words(text, i, i)]
        want = min((plain_distance(item, text[a:b]) for a in ends for b in ends if a < b and abs(b - a - len(item)) <= k), default=99)
        found = decontam.Matcher([(7, item)], decontam.MatchSettings()).find(text)
        assert [(x[0], x[1]) for x in found] == ([(7, want)] if want <= k else []), (item, text)
        for _, distance, a, b in found:
            assert plain_distance(item, text[a:b]) == distance and a in ends and b in ends
        matched += bool(found) and found[0][1] > 0
    assert matched > 5
