"""The stages of the corpus pipeline against plain-Python versions, each on what the one before it kept."""

import collections
import random

import pytest

import corpus_pipeline
from requestlab.llm import queries as Q

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, doc string, h string"
EN = "the of and that which with from this have there their would about when people other could first after these where before because through between".split()
DE = "der die und nicht eine sich auch werden haben wird noch nach durch können zwischen über müssen schon immer wieder gegen während dass ich für".split()


def text(words, seed, n=90):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def rows():
    docs = [(i, text(EN if i % 2 else DE, i), "en" if i % 2 else "de", "abc"[i % 3] if i % 7 else None) for i in range(40)]
    one, two = docs[1][1], docs[2][1]
    item = " ".join(text(EN, 900).split()[:30])
    docs += [
        (40, None, "en", "a"), (41, "", "en", "b"), (42, "12 34 !", None, None), (None, text(EN, 77), None, "b"), (None, text(EN, 78), "en", None),
        (1, one, "en", "b"), (1, text(EN, 500), "en", "a"), (50, one + " more words here", "en", "a"), (51, one.upper(), "en", "c"), (52, two, None, None),
        (52, two, None, None), (None, two + " und", "de", "c"), (60, text(EN, 61, 40) + " " + item + " " + text(EN, 62, 40), "en", "a"), (61, text(EN, 63, 2000), "en", "b"),
    ]
    return [(i, t, x, s, 7, "key", "doc", "h") for i, t, x, s in docs], [(1, item), (2, None), (3, ""), (4, text(DE, 901))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables").as_uri()
    docs, items = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/none/benchmark.parquet")
    return path


def count(some):
    return collections.Counter(map(tuple, some))


def test_stages(spark, folder):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    kept = {"": list(map(tuple, docs.collect()))}
    last = ""
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        kept[name] = list(map(tuple, docs.collect()))
        if name != "token_ids":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]

        before, after = kept[last], kept[name]
        if name == "language_id":  # what holds no letter goes, what is plainly of one language stays
            assert count(after) == count(r for r in before if r[1] and any(map(str.isalpha, r[1])))
        elif name == "jaccard_join":  # one row of each class, by the smallest id, null last; rows without shingles are none
            classes = brute.components([(k, r[1]) for k, r in enumerate(before)])
            groups = collections.defaultdict(list)
            for k, r in enumerate(before):
                groups[classes[k][1]].append(r)
            least = [min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()]
            assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(least)
            assert not count(after) - count(before) and len(after) < len(before)
        elif name == "decontamination":
            hit = {k for k, *_ in brute.contained([(k, r[1]) for k, r in enumerate(before)], rows()[1])}
            assert hit and count(after) == count(r for k, r in enumerate(before) if k not in hit)
        elif name == "mixing":
            size = lambda r: len(brute.WORD.findall(r[1] or ""))
            names = sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
            total = [sum(size(r) for r in before if r[3] == s) for s in names]
            taken = [sum(size(r) for r in after if r[3] == s) for s in names]
            want = brute.targets(total, [1 + k % 3 for k in range(len(names))])
            longest = max(map(size, before))
            assert all(abs(t - w) <= min(longest, 0.05 * w) for t, w in zip(taken, want, strict=True))
            assert all(n <= 3 * count(before)[r] for r, n in count(after).items())
        elif name == "token_ids":
            from tokenizers import Tokenizer

            tok, at, want = Tokenizer.from_file(Q.vocabulary()), 0, []
            for r in sorted(before, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
                ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
                want.append((r[0], at, len(ids), brute.crc_ids(ids)))
                at += len(ids)
            assert count(after) == count(want)
        last = name
    assert list(stages) == ["language_id", "jaccard_join", "decontamination", "mixing", "token_ids"]
    assert count(corpus_pipeline.run(spark, folder).collect()) == count(kept["token_ids"])  # reruns agree


def test_empty(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
