"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, lexical, merkle, mixing, secrets, sharding, simhash, suffixes, tokens, topk, wavelet

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer's file; REQUESTLAB_TOKENIZERS overrides its folder."""
    folder = os.environ.get("REQUESTLAB_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_secret_scan(spark, sf_dir):
    return secrets.describe(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op5_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_ids(spark, sf_dir):
    return wavelet.token_ids(table(spark, sf_dir, "documents"), vocabulary())


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def op8_sharding(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op10_jaccard_join(spark, sf_dir):
    """The columns of the SQL twin; ``op10_jaccard_links`` has the number of links as well."""
    return op10_jaccard_links(spark, sf_dir).drop("n_links")


def op10_jaccard_links(spark, sf_dir):
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark, sf_dir):
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_suffix_dedup, op3_exact_topk, op4_secret_scan, op5_decontamination, op6_token_ids,
        op7_mixing, op8_sharding, op9_token_counts, op10_jaccard_join, op10_jaccard_links, op11_lexical_search, op12_simhash,
        op13_merkle_manifest,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(table_name: str, key: str) -> str:
    """Distinct five-word shingles of a table: ``key, g``; shorter texts are one shingle, their whole sequence."""
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM (SELECT {key}, {_WORDS} AS w FROM {table_name} WHERE text IS NOT NULL))"""


def _spans_sql() -> str:
    """Spans by cumulative lengths of the gaps between matches and of the matches."""

    def one(i: int, r: secrets.Rule) -> str:
        p = r.pattern.replace("'", "''")
        value = f"regexp_extract(hit, '{p}', {r.group})" if r.group else "hit"
        return f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, upto - length(hit) AS a, upto AS b FROM (SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS upto
  FROM (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL))) WHERE length({value}) >= {r.min_length}"""

    every = " UNION ALL ".join(one(i, r) for i, r in enumerate(secrets.RULES))
    joined = "coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, ord){}, '')"
    base = f"FILTER (WHERE ord < {len(secrets.BASE)})"
    counts = ", ".join(f"count(*) FILTER (WHERE ord = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""WITH s AS ({every}) SELECT d.doc_id, {counts}, sha256({joined.format(" " + base)}) AS base_sha256, {joined.format("")} AS spans, count(*) FILTER (WHERE ord >= {len(secrets.BASE)}) AS n_more
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def _search_sql() -> str:
    """Terms of both tables, document frequencies, and scores of the pairs that share a term."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {found} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), g),
i AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""


def _merkle_sql() -> str:
    """The tree level by level, one recursion for the langs and one for their roots; paths fold from the leaf up."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda n: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n, "text"))) + ")"
    bits = "list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    codes = "list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)))"
    crc = f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    level = "SELECT key, lv + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY key, lv, pos // 2, n"
    path = """SELECT o.key, o.pos, list(CASE WHEN s.node IS NULL THEN '' WHEN (o.pos >> o.lv) & 1 = 1 THEN 'L' || s.node ELSE 'R' || s.node END ORDER BY o.lv) AS path
  FROM (SELECT key, pos, unnest(range(CAST(ceil(log2(n)) AS BIGINT))) AS lv FROM {0} WHERE lv = 0) o LEFT JOIN {0} s ON s.key = o.key AND s.lv = o.lv AND s.pos = xor(o.pos >> o.lv, 1) GROUP BY 1, 2"""
    return f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: {bits}) AS t),
l AS (SELECT doc_id, coalesce('+' || lang, '') AS key, {leaf("n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS changed FROM documents, crc),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM l),
t AS (SELECT key, 0 AS lv, pos, leaf AS node, n FROM a UNION ALL {level.format("t")}), top AS (SELECT key AS lang, node, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS key, 0 AS lv, pos, node, n FROM top UNION ALL {level.format("u")}), root AS (SELECT node AS root FROM u WHERE n = 1),
p AS ({path.format("t")}), q AS ({path.format("u")}),
r AS (SELECT doc_id, leaf, changed, top.node AS subroot, root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path FROM a JOIN top ON top.lang = a.key LEFT JOIN p ON p.key = a.key AND p.pos = a.pos LEFT JOIN q ON q.pos = top.pos, root)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (SELECT *,
  list_reduce(list_prepend(coalesce(changed, leaf), path), lambda x, s: sha256(CASE WHEN s[1:1] = 'L' THEN s[2:] || x ELSE x || s[2:] END)) AS folded_root FROM r)"""


#: SQL twins; the others (learned, hashed or library-bound) are tested against brute force.
ORACLES: dict[str, str] = {
    "op11_lexical_search": _search_sql(),
    "op13_merkle_manifest": _merkle_sql(),
    "op4_secret_scan": _spans_sql(),
    "op3_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 5""",
    # items of fewer than five words do not occur in the tables
    "op5_decontamination": f"""WITH d AS {_shingles("documents", "doc_id")}, i AS {_shingles("benchmark", "item_id")}, n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1)
SELECT doc_id, item_id, shared, n_item, shared / n_item AS containment FROM (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (g) GROUP BY ALL) JOIN n USING (item_id) WHERE 100 * shared >= 80 * n_item""",
    "op10_jaccard_join": f"""WITH RECURSIVE d AS {_shingles("documents", "doc_id")}, n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT o.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents o LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)""",
}
