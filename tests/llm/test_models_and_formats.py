"""Tokenizer, classifier, language mixture, URL tree, WARC, pseudonyms: edge cases and brute force."""

import base64
import hashlib
import io
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bytebpe, langmix, pseudonyms, subword, urltree, warc
from gridloom.llm.urltree import Rule
from gridloom.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# --- tokenizer ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    ranks = bytebpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return library, bytebpe.class_table(), bytebpe.Merger(ranks, *bytebpe.pair_table(ranks))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["'s", "'re", "'LL", "''", "  ", "\n", " a", "é", "19", "\u00a0", "\u2003"]), st.text(max_size=6))))
def test_slices_and_merges_equal_the_library(coder, parts):
    library, table, merger = coder
    text = "".join(parts)
    assert np.frombuffer(bytebpe.encode_text(text, table, merger), "<u4").tolist() == library.encode_ordinary(text)


def test_long_slices_and_cut_texts(coder, monkeypatch):
    library, table, merger = coder
    monkeypatch.setattr(bytebpe, "SCAN_BLOCK", 8)
    for text in ["a" * 3000, "Ab" * 900, " " * 700 + "x", "word " * 500, "it's " * 200, "\n \n" * 99]:
        want = library.encode_ordinary(text)
        assert np.frombuffer(bytebpe.encode_text(text, table, merger), "<u4").tolist() == want
        pieces = list(bytebpe.safe_pieces(text, 64))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in library.encode_ordinary(p)] == want


def test_classes_follow_the_library(coder):
    library, table, _ = coder
    probe = {bytes([c]): c for c in range(256)} | {b"a" + bytes([c]): 256 + c for c in range(256)}
    letters = tiktoken.Encoding("letters", pat_str=public_tokenizers.PATTERN, mergeable_ranks=probe, special_tokens={})
    for c in [*range(0x20, 0xD800, 7), *range(0xE000, 0x33000, 11), *range(0x1C80, 0x1C90)]:
        assert (letters.encode_ordinary("a" + chr(c))[0] >= 256) == (table[c] == bytebpe.LETTER), hex(c)


def test_bpe_edge_cases(spark, frame):
    rows = [(1, None), (2, ""), (3, "hello  world\n"), (3, "hello  world\n"), (None, "x"), (4, "é" * 200_000), (5, "\x00\ufffd")]
    got = bytebpe.digests(frame(rows), RANKS).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    assert {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert bytebpe.digests(frame([]), RANKS).count() == 0
    tables = bytebpe.tables_of(spark, RANKS)
    row = bytebpe.encode(frame([(1, "ab cd")]), tables, ["doc_id", "score"]).first()
    assert np.frombuffer(row.ends, "<u4")[-1] == 5 and row.score == "s"
    assert bytes(bytebpe.decode(bytebpe.encode(frame([(1, "ab cd")]), tables, ["doc_id"]), tables).first().decoded) == b"ab cd"


# --- quality classifier ------------------------------------------------------------------------------------


def labelled(n=240):
    rnd = random.Random(0)
    good = lambda: " ".join(rnd.choice(["the", "house", "river", "runs", "green", "old"]) for _ in range(30))
    bad = lambda: " ".join(rnd.choice(["BUY", "!!!", "$$$", "click"]) for _ in range(30))
    return [(i, good() if i % 2 else bad(), i % 2) for i in range(n)]


def test_quality_model(spark, frame):
    rows = labelled()
    marks = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id BIGINT, quality INT")
    docs = frame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "BUY !!!"), (902, "house " * 300_000)])
    s = subword.SubwordSettings(bits=12, sample_per_class=40)
    model = subword.fit_quality(docs, marks, s)
    again = subword.fit_quality(docs.repartition(7), marks, s)
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    got = subword.quality_scores(docs, model, s).collect()
    assert len(got) == len(rows) + 4
    truth = {i: q for i, _, q in rows}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and by[None].predicted == 0 and not by[None].held_out and by[902].predicted == 1
    kept = subword.keep_good(docs, model, s)
    assert kept.columns == docs.columns and kept.where("doc_id = 902").first().text == "house " * 300_000
    empty = subword.quality_scores(frame([]), model, s)
    assert empty.count() == 0


def test_quality_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    model = subword.fit_quality(frame([(1, "a")]), none, subword.SubwordSettings(bits=8))
    assert subword.quality_scores(frame([(1, "a")]), model, subword.SubwordSettings(bits=8)).first().score == 0.5


def test_features_of_a_long_text_do_not_depend_on_cuts(monkeypatch):
    s = subword.SubwordSettings(bits=16)
    rnd = random.Random(3)
    for words in (["a", "bb", "bb", "éé", "long" * 9], ["x" * 70]):
        text = ("".join(rnd.choice(words) + rnd.choice([" ", "\n ", " "]) for _ in range(40)) + "end").encode()
        data = np.frombuffer(text, np.uint8)
        want = sorted(np.concatenate([f for f, _ in subword.feature_streams(data, np.array([0, len(data)]), s)]).tolist())
        for size in (1, 5, 16, 33, len(text) - 1):
            monkeypatch.setattr(subword, "CHUNK_BYTES", size)
            assert sorted(np.concatenate(list(subword.row_features(data, s))).tolist()) == want


def test_features_of_a_word_do_not_depend_on_its_place():
    s = subword.SubwordSettings(bits=20)
    for text in (b"alpha beta alpha", b"xx alpha beta alpha yy", "é alpha beta alpha".encode()):
        data = np.frombuffer(text, np.uint8)
        words, _ = next(subword.feature_streams(data, np.array([0, len(data)]), s))
        at = text.split().index(b"alpha")
        assert words[at] == words[at + 2] != words[at + 1]
        first, _ = next(subword.feature_streams(np.frombuffer(b"alpha", np.uint8), np.array([0, 5]), s))
        assert first[0] == words[at]


def test_the_training_task_holds_a_few_bytes_for_each_feature():
    s = subword.SubwordSettings(epochs=1)
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(4000)) for _ in range(40)]
    rows = pa.RecordBatch.from_pydict({"label": [i % 2 for i in range(40)], "text": texts})
    bags = list(subword._bags(s)(iter([rows])))
    data = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    features = sum(len(np.unique(np.concatenate(list(subword.row_features(x, s))))) for x in data)
    tracemalloc.start()
    list(subword._trainer(s)(iter(bags)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert features > 1_500_000 and peak < 10 * features  # the model is about 4 of them


def test_counts_of_features_in_any_width():
    for counts in ([], [1], [255, 3], [256, 1], [70_000, 1, 2], [1 << 33]):
        packed = subword.pack_counts(np.array(counts, np.int64))
        assert subword.unpack_counts(packed, len(counts)).tolist() == counts
    assert len(subword.pack_counts(np.array([255, 3]))) == 2


# --- language mixture ---------------------------------------------------------------------------------------


def test_language_mixture(spark, frame):
    rnd = random.Random(1)
    vocabulary = {"aa": ["ba", "bab", "abba", "baab"], "bb": ["kiki", "ikik", "kik", "iki"], "cc": ["zuz", "uzu", "zzu", "uuz"]}
    def say(lang, n):
        return " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    train = spark.createDataFrame([(lang, say(lang, 40)) for lang in vocabulary for _ in range(10)] + [(None, "x"), ("aa", None)], "lang STRING, text STRING")
    model = langmix.learn(train)
    assert model[0] == ["aa", "bb", "cc"]
    rows = [(1, say("aa", 50)), (2, say("bb", 60) + " " + say("cc", 40)), (3, None), (4, ""), (5, "12 34 !!"), (6, "kiki"), (7, say("cc", 400_000)), (None, "zuz uzu")]
    got = {r.doc_id: r for r in langmix.predict(frame(rows), model, ["doc_id", "score"] if False else ["doc_id"]).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6, 7, None)] == ["aa", "bb", "und", "und", "und", "bb", "cc", "cc"]
    assert [m.lang for m in got[1].mixture] == ["aa"] and got[1].score == pytest.approx(1)
    assert [m.lang for m in got[2].mixture] == ["bb", "cc"] and got[2].score == pytest.approx(0.6, abs=0.03)
    assert got[3].score == 0 and got[3].mixture == []
    assert langmix.predict(frame([]), model, ["doc_id"]).count() == 0
    nothing = langmix.learn(train.where("false"))
    assert langmix.predict(frame([(1, "abba")]), nothing, ["doc_id"]).first().lang_pred == "und"


def test_language_evidence_does_not_depend_on_neighbours_or_cuts(monkeypatch):
    data = lambda x: np.frombuffer(x, np.uint8)
    alone = langmix.trigram_buckets(data(b"kiki"), np.array([0, 4]), 16)
    beside = langmix.trigram_buckets(data(b"zuzkikizuz"), np.array([0, 3, 7, 10]), 16)
    assert beside[3:7].tolist() == alone.tolist()
    table = np.random.default_rng(0).normal(size=(3, 1 << 16)) - 9
    rnd = random.Random(5)
    text = " ".join(rnd.choice(["ba", "Abba", "kiki", "zuz", "x" * 40]) for _ in range(60)).encode()
    whole = np.array([0, len(text)])
    s = langmix.MixtureSettings()
    likely, bounds = langmix.word_likelihoods(data(text), whole, table, 16)
    learned = lambda: next(langmix._counter(s)(iter([pa.record_batch({"l": ["aa"], "t": [text.decode()]})]))).column(2).to_pylist()
    want, counts = langmix.infer(likely, bounds, s), learned()
    for size in (7, 16, 50):
        monkeypatch.setattr(langmix, "CHUNK_BYTES", size)
        columns, n = langmix.long_row_likelihoods(data(text), table, 16)
        assert n.sum() == len(text.split())
        assert langmix.infer(columns, np.array([0, len(n)]), s, n) == pytest.approx(want)
        assert learned() == counts


# --- URL tree -------------------------------------------------------------------------------------------------


def test_rules_and_parsing(spark):
    rules = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block")]
    urls = ["HTTP://WWW.Example.com/en/1?x", "http://example.com", "https://badexample.com/en/", "no scheme", None, "", "x://a.org?b/c://d", "s://É.com/p#f", "http://h/a\nb"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[0], "x", "y")], "page_id BIGINT, url STRING, host STRING, template STRING")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltree.judge_urls(pages, rules).collect()}
    assert got[0] == ("www.example.com", "/en/1", "example.com/en/", "block") == got[None]
    assert got[1] == ("example.com", "", None, "allow") and got[2] == ("badexample.com", "/en/", "com/", "allow")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("a.org", "", None, "allow") and got[7] == ("É.com", "/p", "com/", "allow") and got[8][1] == "/a\nb"
    assert urltree.judge_urls(pages.where("false"), rules).count() == 0


def test_templates_carry_labels_to_variable_segments(spark):
    rows = [("h", f"/item/{i}", 1, 1) for i in range(20)] + [("h", f"/item/{i}", 0, 0) for i in range(20, 40)]
    rows += [("h", f"/about/{w}", 1, 0) for w in ("us", "you")] + [("h", "/about/them", 0, 0), ("g", "/item/77", 0, 0)]
    rows += [("h", "/a/b/c/d/e/f/g", 0, 0), ("h", "", 0, 0)]
    urls = spark.createDataFrame(rows, "host STRING, path STRING, labelled BIGINT, blocked BIGINT")
    got = {(r.host, r.path): r for r in urltree.learn_templates(urls).collect()}
    assert len(got) == len(rows)
    assert got["h", "/item/33"].reject and got["h", "/item/33"].template == got["h", "/item/3"].template
    assert not got["h", "/about/them"].reject and not got["g", "/item/77"].reject
    assert got["h", "/a/b/c/d/e/f/g"].template.endswith("/**") and not got["h", ""].reject


# --- WARC ---------------------------------------------------------------------------------------------------------


def record(n, body=b"payload"):
    return warc.record_bytes("response", f"urn:page:{n}:0", "http://x/é y", body, len(body), hashlib.sha1(body).digest(), None)


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def read(raw):
    return [(at, size, problem, r and r["headers"]["warc-record-id"]) for at, size, problem, r in warc.salvage(Source(raw), len(raw))]


def test_salvage_finds_later_records_and_logs_gaps():
    big = random.Random(0).randbytes(700_000)
    members = [warc.gzip_member(record(i, big if i == 3 else b"p%d" % i)) for i in range(6)]
    starts = np.cumsum([0] + [len(m) for m in members]).tolist()
    whole = b"".join(members)
    assert [r[3] for r in read(whole)] == [f"<urn:page:{i}:0>" for i in range(6)] and all(r[2] is None for r in read(whole))
    broken = bytearray(whole)
    broken[starts[1] + 30] ^= 255  # inside member 1
    for k in range(2000):
        broken[starts[3] + 300_000 + k] = 7  # inside member 3
    got = read(bytes(broken))
    assert [r[3] for r in got if r[2] is None] == [f"<urn:page:{i}:0>" for i in (0, 2, 4, 5)]
    assert [(r[0], r[0] + r[1]) for r in got if r[2]] == [(starts[1], starts[2]), (starts[3], starts[4])]
    junk = b"junk\x1f\x8b\x08WARC/1." + whole[:starts[2]] + b"tail"
    assert [(r[0], r[1]) for r in read(junk) if r[2]] == [(0, 14), (14 + starts[2], 4)]
    assert [r[3] for r in read(whole[: starts[5] + 9]) if r[2] is None] == [f"<urn:page:{i}:0>" for i in range(5)]
    assert read(b"") == [] and len(read(b"nothing here")) == 1


def test_salvage_of_uncompressed_records_and_digests():
    plain = [record(i, b"body %d" % i) for i in range(4)]
    bad = plain[1].replace(b"body 1", b"BODY 1")  # the digest no longer fits
    cut = plain[2][:-9]
    got = read(plain[0] + bad + cut + plain[3])
    assert [r[3] for r in got if r[2] is None] == ["<urn:page:0:0>", "<urn:page:3:0>"]
    assert [(r[0], r[1]) for r in got if r[2]] == [(len(plain[0]), len(bad) + len(cut))]


def test_salvage_of_members_with_several_records_and_old_versions():
    plain = [record(i, b"body %d" % i) for i in range(5)]
    bad = plain[2].replace(b"body 2", b"BODY 2")  # the digest no longer fits
    first = warc.gzip_member(plain[0] + plain[1] + bad + plain[3])
    raw = first + warc.gzip_member(plain[4]) + warc.gzip_member(b"no record")
    got = read(raw)
    assert [r[3] for r in got if r[2] is None] == [f"<urn:page:{i}:0>" for i in (0, 1, 3, 4)]
    assert [(r[0], r[1]) for r in got][:4] == [(0, len(first))] * 4 and got[2][2] and got[-1][2]
    old = plain[0].replace(b"WARC/1.1", b"WARC/0.18")
    assert [r[3] for r in read(old + plain[1])] == ["<urn:page:0:0>", "<urn:page:1:0>"]


def test_round_trip_edge_cases(spark):
    big = "é" * 800
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, "u", big), (3, "u", "s" * 999), (4, "u", "s" * 999), (5, "u", None), (6, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id BIGINT, url STRING, html STRING, payload STRING")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = [(1, 1600, "revisit", 2), (2, 1600, "response", None), (2, 1600, "revisit", 2), (3, 999, "response", None), (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None), (None, 1600, "revisit", 2)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archive_folders_with_and_without_a_scheme(spark, tmp_path):
    local = [warc.store_of("file:///home/x", p) for p in ("/a/b", "file:/a/b", "file:///a/b", "a/b")]
    assert [type(s).__name__ for s, _ in local] == ["LocalFileSystem"] * 4
    assert [p for _, p in local] == ["/a/b", "/a/b", "/a/b", "/home/x/a/b"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", "t" * i) for i in range(5)], "page_id BIGINT, url STRING, html STRING")
    for n, folder in enumerate((f"{tmp_path}/plain", f"file:{tmp_path}/short", f"file://{tmp_path}/long")):
        report = warc.write_archives(warc.decide_revisits(pages), folder)
        assert warc.records_of(warc.read_archives(report)).count() == 5
        assert any((tmp_path / ("plain", "short", "long")[n]).glob("part-*.warc.gz"))


def test_paths_without_a_scheme_go_to_the_default_store(monkeypatch):
    asked = []
    monkeypatch.setattr(warc.fs, "FileSystem", type("Stores", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))}))
    for path in ("/user/x/warc", "warc", "other://b/warc"):
        warc.store_of("hdfs://names:8020/user/y", path)
    assert asked == ["hdfs://names:8020/user/x/warc", "hdfs://names:8020/user/y/warc", "other://b/warc"]


def test_small_archives_and_gap_log(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"text {i} " * 30) for i in range(30)], "page_id BIGINT, url STRING, html STRING")
    report = warc.write_archives(warc.decide_revisits(pages), f"{tmp_path}/warc", limit=2000)
    paths = [r.path for r in report.collect()]
    assert len(paths) > 3 and report.agg(F.sum("records")).first()[0] == 30
    with open(paths[0], "r+b") as archive:  # damage the first member of one archive
        archive.seek(40)
        archive.write(b"\x00" * 20)
    found = warc.read_archives(report)
    assert warc.records_of(found).count() == 29
    gap = warc.gaps_of(found).collect()
    assert len(gap) == 1 and gap[0].path == paths[0] and gap[0].offset == 0


# --- pseudonyms -----------------------------------------------------------------------------------------------------


def luhn(number):
    digits = [int(c) for c in reversed(re.sub("[^0-9]", "", number))]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def test_feistel_is_a_permutation(spark):
    n, m = 13, 7
    pairs = spark.range(n * m).select((F.col("id") / m).cast("long").alias("a"), (F.col("id") % m).alias("b"))
    mixed = pairs.select(pseudonyms.feistel(F.col("a"), F.col("b"), F.lit(n), F.lit(m), "k", F.lit("t")).alias("x"))
    got = {(r.x.l, r.x.r) for r in mixed.collect()}
    assert got == {(a, b) for a in range(n) for b in range(m)}


def test_short_numbers_are_permuted_within_their_format(spark):
    one = pseudonyms.permute_text(F.format_string("%03d", F.col("id")), "k", "t")
    got = {r[0] for r in spark.range(1000).select(one).collect()}
    assert got == {f"{i:03d}" for i in range(1000)}
    days = spark.range(73_000).select(F.date_format(F.date_add(F.lit("1999-12-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")).where("d < '2001-01-01'")
    moved = [r[0] for r in days.select(pseudonyms.permute_date(F.col("d"), "k", "date_iso")).collect()]
    assert len(set(moved)) == len(moved) and all(re.fullmatch(r"\d{4}-\d\d-\d\d", x) for x in moved)


def test_pseudonyms(frame):
    card, bad, iban = "4111 1111-1111 1111", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00"
    rows = [
        (1, f"Ann.Lee9@mail.example.com paid {card}, not {bad}; {iban}. Born 2000-02-29, 31/12/1999, 30.02.2001"),
        (2, f"again {card} and Ann.Lee9@mail.example.com; 10.0.0.255 999.1.1.1 +1 (702) 555-4777 123-45-6789 000-45-6789"),
        (3, None), (4, ""), (5, "clean words, 3.5 and 12 of 7"), (6, "word " * 200_000 + card), (2, "repeat"), (None, card),
    ]
    got = {(r.row.doc_id, i): r for i, r in enumerate(pseudonyms.pseudonymise(frame(rows), "k").collect())}
    by = {k[0]: r for k, r in got.items() if r.row.text != "repeat"}
    one, two = by[1], by[2]
    kinds = lambda r: [x.kind for x in r.pii]
    assert kinds(one) == ["email", "card", "iban", "date_iso", "date_slash"] and kinds(two) == ["card", "email", "ipv4", "phone", "ssn"]
    value = {x.kind: x.value for x in [*one.pii, *two.pii]}
    assert one.pii[1].value == two.pii[0].value == by[None].row.text and one.pii[0].value == two.pii[1].value
    assert luhn(value["card"]) and re.fullmatch(r"4\d{3} \d{4}-\d{4} \d{4}", value["card"]) and card not in one.row.text
    assert bad in one.row.text and "30.02.2001" in one.row.text and "999.1.1.1" in two.row.text and "000-45-6789" in two.row.text
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail\.example\.com", value["email"])
    plain = value["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain.startswith("DE")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", value["phone"])
    for x in [*one.pii, *two.pii]:
        row = one if x in one.pii else two
        assert row.row.text[x.start : x.start + len(x.value)] == x.value
    assert by[3].row.text is None and by[4].row.text == "" and by[5].row.text == rows[4][1] and by[5].pii == []
    assert len(by[6].row.text) == len(rows[5][1]) and by[1].row.id == "x"
    other = pseudonyms.pseudonymise(frame(rows[:1]), "another").first()
    assert other.row.text != one.row.text
    assert pseudonyms.pseudonymise(frame([]), "k").count() == 0


def test_values_with_a_capital_or_digit_word_behind(frame):
    ibans = ["ES9121000418450200051332", "AT611904300234573201", "BE68539007547034", "ES91 2100 0418 4502 0005 1332", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]
    behind = ["EUR 500", "BIC", "I paid", "2024-01-05", "4111 1111 1111 1111", "12", "."]
    rows = [(k, f"{iban} {word}") for k, (iban, word) in enumerate((i, w) for i in ibans for w in behind)]
    rows.append((100, f"AB12 {ibans[0]}"))
    for r in pseudonyms.pseudonymise(frame(rows), "k").collect():
        old = dict(rows)[r.row.doc_id]
        new = next(x.value for x in r.pii if x.kind == "iban").replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1 and len(r.row.text) == len(old)
        assert not any(iban in r.row.text for iban in ibans)
        more = {"2024-01-05": "date_iso", "4111 1111 1111 1111": "card"}
        assert [x.kind for x in r.pii][1:] == [v for k, v in more.items() if old.endswith(k)]


def test_dates_with_the_month_first(spark, frame):
    rows = [(1, "on 12/31/1999 AT 5"), (2, "12/31/1999"), (3, "13/31/1999 and 02/30/2000"), (4, "02/29/2000 EUR"), (5, "04/05/2000")]
    by = {r.row.doc_id: r for r in pseudonyms.pseudonymise(frame(rows), "k").collect()}
    assert [x.kind for i in (1, 2, 4, 5) for x in by[i].pii] == ["date_month"] * 3 + ["date_slash"] and by[3].pii == []
    assert by[1].pii[0].value == by[2].row.text != "12/31/1999" and by[3].row.text == rows[2][1]
    first = spark.range(150_000).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12")
    value = F.date_format("d", "MM/dd/yyyy")
    moved = [r[0] for r in first.select(pseudonyms.permute_month_first(value, "k")).collect()]
    assert len(set(moved)) == len(moved) and all(int(x[3:5]) > 12 and int(x[:2]) <= 12 for x in moved)
    plain = spark.range(1, 2_000_000, 7).select("id", pseudonyms._late_date(F.col("id")).alias("d"))
    again = pseudonyms._late_days(F.year("d").cast("long") - 1) + F.dayofyear("d") - 12 * F.month("d") - 1
    assert plain.where((again != F.col("id")) | (F.day("d") <= 12)).count() == 0


def test_pseudonyms_of_very_long_candidates(frame):
    """Repeated groups are bounded: no text is too long for the pattern engine."""
    long_host = "x@" + "a." * 50_000 + "com"
    rows = [(1, "x@" + "a." * 3000 + "com"), (2, long_host), (3, "x@" + "a" * 100_000), (4, "1" * 5_000_000), (5, "y" * 1_000_000 + "@h.org"), (6, "me@" + "ab." * 100 + "com")]
    got = {r.row.doc_id: r for r in pseudonyms.pseudonymise(frame(rows), "k").collect()}
    assert all(got[i].row.text == dict(rows)[i] and got[i].pii == [] for i in (1, 3, 4, 5))
    # Within an endless chain of labels the end that looks like a host name is not taken for an address.
    assert got[2].row.text == long_host
    assert [x.kind for x in got[6].pii] == ["email"] and got[6].row.text != rows[5][1] and len(got[6].row.text) == len(rows[5][1])


def test_pseudonyms_of_dates_in_logs_and_year_first(frame):
    rows = [(1, "at 2024-01-05T10:00:00Z and 2024-01-05"), (2, "on 2024/01/05, not 2024/13/05 nor a/2024/01/05"), (3, "2024-01-05Tuesday")]
    got = {r.row.doc_id: r for r in pseudonyms.pseudonymise(frame(rows), "k").collect()}
    iso = [x.value for x in got[1].pii]
    assert len(iso) == 2 and iso[0] == iso[1] != "2024-01-05" and got[1].row.text == f"at {iso[0]}T10:00:00Z and {iso[0]}"
    assert [x.value for x in got[2].pii] == [iso[0].replace("-", "/")]
    assert got[2].row.text.endswith("not 2024/13/05 nor a/2024/01/05") and got[3].pii == []


def test_pseudonyms_of_many_values_in_a_document(frame):
    """Places of the values by running sums: 40,000 of them in one text."""
    days = [f"{1900 + k % 100}-{k % 12 + 1:02}-{k % 28 + 1:02}" for k in range(40_000)]
    text = "; ".join(f"{'x' * (k % 5)} {d}" for k, d in enumerate(days))
    (row,) = pseudonyms.pseudonymise(frame([(1, text)]), "k").collect()
    assert len(row.pii) == len(days) and len(row.row.text) == len(text)
    again = {}
    for old, x in zip(days, row.pii):
        assert row.row.text[x.start : x.start + 10] == x.value and again.setdefault(old, x.value) == x.value
