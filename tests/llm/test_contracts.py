"""Queries against brute force on the smallest tables."""

import collections
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from requestlab.llm import queries as Q
from requestlab.llm import sharding

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in Q.table(spark, SF, "documents").collect()]


def run(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def test_language_id(spark, docs):
    lang = {i: x for i, _, x, _ in docs}
    got = run(spark, "op1_language_id")
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_suffixes(spark, docs):
    want = brute.repeats([(i, t) for i, t, *_ in docs])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op2_suffix_dedup")}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_topk(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in Q.table(spark, SF, "embeddings").collect()]
    ids = np.array([i for i, _ in rows])
    m = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    want = []
    for k in np.flatnonzero(ids % 50 == 0):
        s = m @ m[k]
        want += [(ids[k], n + 1, ids[j], s[j]) for n, j in enumerate([j for j in np.lexsort((ids, -s)) if j != k][:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in run(spark, "op3_exact_topk")) == sorted(want)


def test_decontamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in Q.table(spark, SF, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"], r["shared"], r["n_item"]) for r in run(spark, "op5_decontamination")}
    assert got == brute.contained([(i, t) for i, t, *_ in docs], items) and got


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t, *_ in docs}
    size = {i: len((t or "").encode()) for i, t, *_ in docs}
    for r in run(spark, "op9_token_counts"):
        n = len(ids[r["doc_id"]])
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, size[r["doc_id"]], n > 2048)
    got, at = {r["doc_id"]: r for r in run(spark, "op6_token_ids")}, 0
    for i in sorted(ids):
        own = ids[i] + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(own), brute.crc_ids(own))
        at += len(own)


def test_secrets(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op4_secret_scan")}
    assert got == {i: brute.secrets(t) for i, t, *_ in docs}  # the smallest table holds none; test_edges plants some


def test_mixing(spark, docs):
    size = {i: len(brute.WORD.findall(t or "")) for i, t, *_ in docs}
    src, total = {i: s for i, _, _, s in docs}, collections.Counter()
    for i, n in size.items():
        total[src[i]] += n
    names = sorted(total)
    want = dict(zip(names, brute.targets([total[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in run(spark, "op7_mixing"):
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[src[r["doc_id"]]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[src[r["doc_id"]]])
        taken[src[r["doc_id"]]] += r["taken"]
    longest = {s: max(size[i] for i in size if src[i] == s) for s in names}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in names)  # one document's size


def test_sharding(spark, docs):
    got = run(spark, "op8_sharding")
    text = {i: (t or "").encode() for i, t, *_ in docs}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]])) for r in got)
    # placement: the position of a row's number under the permutation
    place = {r["row"]: r for r in spark.range(len(got)).select(F.col("id").alias("row"), *[c.alias(n) for c, n in zip(sharding.locate(F.col("id"), len(got), 24), ("shard", "slot"), strict=True)]).collect()}
    assert all((r["shard"], r["slot"]) == (place[r["row"]]["shard"], place[r["row"]]["slot"]) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == len(docs) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_jaccard(spark, docs):
    want = brute.components([(i, t) for i, t, *_ in docs])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op10_jaccard_join")} == want


def test_search(spark, docs):
    items = [(r["item_id"], r["text"]) for r in Q.table(spark, SF, "benchmark").collect()]
    assert sorted(map(tuple, run(spark, "op11_lexical_search"))) == sorted(brute.ranked([(i, t) for i, t, *_ in docs], items))


def test_simhash(spark, docs):
    assert sorted(map(tuple, run(spark, "op12_simhash"))) == sorted(brute.classes_by_bits([(i, t) for i, t, *_ in docs]))


def test_merkle(spark):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in Q.table(spark, SF, "documents").collect()]
    got = run(spark, "op13_merkle_manifest")
    assert sorted(map(tuple, got)) == sorted(brute.merkle(rows)) and 0 < sum(not r["verified"] for r in got) < len(got) / 4
