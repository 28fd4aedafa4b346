"""Queries and SQL of the training-data operators, one ``opN_<name>`` each."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxara.llm.common import load

#: Folder of the vocabulary files of public tokenizers.
TOKENIZERS = os.path.dirname(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.pieces import encode_documents, with_digests

    return with_digests(encode_documents(load(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")).drop("ids")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm import secrets

    return secrets.digest(secrets.find_secrets(load(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.licenses import scan_licenses

    return scan_licenses(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm import toxicity

    docs = load(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, load(spark, sf_dir, "labels"))).drop("n_words")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm import rules

    return rules.digest(rules.ledger(load(spark, sf_dir, "documents")))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to the whole of documents."""
    from voxara.llm import rules

    return rules.ablations(rules.ledger(load(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm import mixing

    return mixing.digest(mixing.mix(load(spark, sf_dir, "documents")))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.jaccard import jaccard_classes

    return jaccard_classes(load(spark, sf_dir, "documents"), num=85, den=100, words=4)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm import lines

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.digest(docs, lines.repeated_lines(docs))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.tokens import count_tokens

    return count_tokens(load(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.vectors import near_vectors

    return near_vectors(load(spark, sf_dir, "embeddings"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.neighbours import nearest

    return nearest(load(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.resampling import resample

    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxara.llm.divergence import audit

    return audit(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and "_" in k and k[2].isdigit()} | {"rule_ablations": rule_ablations}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {
    "op4_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
        c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON c.id = n.a
    """,
    "op9_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
        p AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM h WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM p GROUP BY 1),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        m AS (
            SELECT w.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words,
                length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_capitals
            FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id
        ),
        f AS (
            SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
                + 8 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 15 * n_words AS BIGINT)
                + 64 * CAST(100 * n_letters < 60 * word_chars AS BIGINT) + 128 * CAST(100 * n_capitals > 50 * n_letters AS BIGINT) AS failed
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
    """,
}

_RULES = "['few_words', 'repeated_words', 'many_symbols', 'repeated_lines', 'short_words', 'long_words', 'few_letters', 'capitals']"
SQL["rule_ablations"] = f"""
    WITH ledger AS ({SQL["op9_rules"]}),
    p(version, policy) AS (VALUES ('base', 3), ('v1', 255), ('v2', 79)),
    r AS (SELECT unnest({_RULES}) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit)
    SELECT version, rule, count(*) AS n_documents, count(*) FILTER (WHERE failed & policy <> 0) AS n_rejected,
        count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed & policy = bit) AS n_regained
    FROM ledger, p, r WHERE bit & policy <> 0 GROUP BY 1, 2
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of CRC-32 by its rule, and the sum over a word's bytes.
SQL["op12_resampling"] = rf"""
    WITH RECURSIVE step(i, k, v) AS (
        SELECT i, 0, i FROM (SELECT unnest(range(256))::UINTEGER AS i)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM step WHERE k < 8
    ),
    crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
    d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    f AS (SELECT doc_id, unnest(w) AS w FROM d),
    g AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    v AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION ALL SELECT w FROM g)),
    b AS (
        SELECT w, xor(list_reduce(list_transform(range(0, CAST(len(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS UINTEGER)),
            lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) % 10000 AS bucket FROM v, crc
    ),
    s AS (SELECT bucket, count(*) AS n FROM f JOIN b USING (w) GROUP BY 1),
    t AS (SELECT bucket, count(*) AS n FROM g JOIN b USING (w) GROUP BY 1),
    a AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM g) AS t),
    gain AS (
        SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket), a
    ),
    m AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (w) JOIN gain USING (bucket) GROUP BY 1),
    c AS (
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM d LEFT JOIN m ON d.doc_id = m.doc_id
    ),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
    SELECT c.*, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM c LEFT JOIN r ON c.doc_id = r.doc_id
"""
SQL["op13_divergence"] = rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
    w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_c FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(lang_c) AS lang_n FROM kept GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
    g AS (SELECT DISTINCT lang, source FROM d),
    p AS (
        SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (coalesce(n, 0) + 2 * v)::HUGEINT AS p,
            1 + 1000000000::HUGEINT * (lang_c + 2) // (lang_n + 2 * v)::HUGEINT AS q
        FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang LEFT JOIN n ON g.lang = n.lang AND g.source = n.source
        LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term
    ),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    r AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q
    ),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
    SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""
