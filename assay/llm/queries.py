"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, near_dup, packing, secret_scan, substring, token_count, token_store, topk
from .common import table

BYTE_TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(table(spark, sf_dir, "documents"), vocabulary(BYTE_TOKENIZER))
    return token_store.read(spark, path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents")).drop("blob")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_secret_scan, op3_exact_topk, op4_best_fit, op5_language_id, op6_decontaminate, op7_token_counts, op8_near_dup, op9_substring_dedup, op10_license_scan)}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Each rule's matches and the pieces between them give the places."""
    parts = []
    for rank, r in enumerate(secret_scan.RULES):
        p = _quoted(r.pattern)
        parts.append(f"""
        SELECT doc_id, '{r.kind}' AS kind, {rank} AS rnk, s AS "start", s + length(m[i]) AS "end" FROM (
          SELECT doc_id, i, m, own, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s FROM (
            SELECT doc_id, m, own, p, unnest(range(1, len(m) + 1)) AS i FROM (
              SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS own, string_split_regex(t, {p}) AS p FROM d WHERE regexp_matches(t, {p})))
        ) WHERE length(own[i]) >= {r.least}""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.BASE)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    text = "kind || ':' || \"start\" || ':' || \"end\""
    order = 'ORDER BY "start", rnk, "end"'
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), s AS ({union}),
    g AS (SELECT doc_id, {sums}, string_agg({text}, ',' {order}) FILTER (WHERE rnk < {len(secret_scan.BASE)}) AS base, string_agg({text}, ',' {order}) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _licenses_sql() -> str:
    known = "MAP {" + ", ".join(f"{_quoted(text)}: {_quoted(k)}" for text, k in licenses.known(licenses.SENTENCES, licenses.SPDX).items()) + "}"
    lowered = lambda s: f"translate({s}, '{licenses.UPPER}', '{licenses.LOWER}')"
    lines = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"
    lines = f"regexp_replace(regexp_replace({lines}, {_quoted('(?m)' + licenses.COMMENT)}, '', 'g'), {_quoted('(?m)' + licenses.MARK)}, chr(10) || chr(10), 'g')"
    cut = f"string_split_regex(regexp_replace({lines}, {_quoted(licenses.STOP)}, '\\1' || chr(12), 'g'), {_quoted(licenses.CUT)})"
    look = lambda s: f"(SELECT m FROM k)[trim(regexp_replace({lowered(s)}, '[^a-z0-9]+', ' ', 'g'))]"
    by_line = f"list_filter(list_transform(string_split(s, chr(10)), lambda l: {look('l')}), lambda x: x IS NOT NULL)"
    ids = f"flatten(list_transform({cut}, lambda s: CASE WHEN {look('s')} IS NOT NULL THEN [{look('s')}] WHEN contains(s, chr(10)) THEN {by_line} ELSE [] END))".replace("(SELECT m FROM k)", "m")
    rules = [*licenses.RULES, *((x, (f"spdx-{x.lower()}",)) for x in licenses.SPDX)]
    found = ", ".join(f"CASE WHEN contains(path, {_quoted(',' + ','.join(seq) + ',')}) THEN {_quoted(name)} END" for name, seq in rules)
    return f"""WITH k AS (SELECT {known} AS m)
    SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))), ',') AS licenses
    FROM (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS path FROM (SELECT doc_id, {ids} AS ids FROM documents, k))"""


DECONTAMINATE_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)),
    hit AS (SELECT doc_id, pos.n, i, item FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN it ON w.doc_id = it.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _secrets_sql(), "op3_exact_topk": TOPK_SQL, "op6_decontaminate": DECONTAMINATE_SQL, "op10_license_scan": _licenses_sql()}
