"""Registered queries: those with SQL against SQL, the others against brute force, over whole small tables."""

import base64
import hashlib
import re
import zlib

import oracle
import public_tokenizers
import pytest
import tiktoken
from test_llm_helpers import all_pairs

import __spark_entry__ as contract
from gridloom.llm import decontam
from gridloom.llm.registry import QUERIES, SQL


def test_one_query_per_operator_and_the_pipeline():
    for n in (*range(1, 14),):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(name, spark, small_dir, small_duck):
    assert oracle.compare(QUERIES[name](spark, small_dir), small_duck, SQL[name]) == []


def test_op1(spark, small_dir):
    got = {r.page_id: r for r in QUERIES["op1_url_filters"](spark, small_dir).collect()}
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    assert len(got) == len(pages)
    for page in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", page.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/"):])]
        rule = max(fits, key=len, default=None)
        row = got[page.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == rules[rule] if rule else row.verdict in ("allow", "block")


def test_op2(spark, small_dir):
    rows = QUERIES["op2_quality"](spark, small_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    assert len(rows) == len({r.doc_id for r in rows}) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op4(spark, small_dir, small_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op4_byte_bpe"](spark, small_dir).collect()
    assert {r.doc_id for r in rows} == set(small_docs)
    for r in rows:
        ids = library.encode_ordinary(small_docs[r.doc_id] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((small_docs[r.doc_id] or "").encode()).hexdigest()


def test_op5(spark, small_dir, small_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_ngram_jaccard"](spark, small_dir).collect()}
    assert got == all_pairs(small_docs, 3, 90)


def test_op6(spark, small_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    rows = QUERIES["op6_warc"](spark, small_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        body = pages[r.page_id]
        same = [i for i, x in pages.items() if x == body]
        revisit = len(body) >= 1000 and max(same) != r.page_id
        want = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_op8(spark, small_dir, small_docs):
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op8_decontamination"](spark, small_dir).collect()}
    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    masks = {i: decontam.masks(x) for i, x in items.items()}
    want = {}
    for doc, text in small_docs.items():
        text = decontam.normal(text)
        for i, item in items.items():
            if item in text:
                want[doc, i] = 0
            elif doc < 30:  # the plain dynamic programme over the whole text is slow
                distance, _ = decontam.myers(masks[i], len(item), text)
                if distance <= int(len(item) * decontam.MatchSettings().error_rate):
                    want[doc, i] = distance
    assert {k: v for k, v in got.items() if v == 0 or k[0] < 30} == want


def test_op9(spark, small_dir):
    rows = QUERIES["op9_language_id"](spark, small_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op10(spark, small_dir, small_docs):
    rows = QUERIES["op10_pii_pseudonyms"](spark, small_dir).collect()
    found = {r.doc_id: r for r in rows}
    address = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]*\w")
    for doc, text in small_docs.items():
        for value in address.findall(text or ""):
            assert doc in found and value not in found[doc].text
    for r in rows:
        assert len(r.text) == len(small_docs[r.doc_id]) or any(x.kind == "ipv4" for x in r.pii)
        assert r.n_values == len(r.pii) and all(r.text[x.start :].startswith(x.value) for x in r.pii)


def test_op10_returns_every_document(spark, small_dir, small_docs):
    rows = QUERIES["op10_pii_pseudonyms"](spark, small_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(small_docs)
    clean = [r for r in rows if r.n_values == 0]
    assert clean and all(r.pii == [] and r.text == small_docs[r.doc_id] for r in clean)
