"""The queries of the operators over their whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html_extract, licenses, mixing, ngram_lm, pii, sharding, simhash, spelling, substrings, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_bytes", "n_words", "first_doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return sharding.shard(docs, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_copies(_table(spark, sf_dir, "documents"))
    return docs.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = decontaminate.hit_words("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 7, 2))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), one_in=199))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_toxicity, op4_uniform_shards, op5_exact_top_k, op6_source_mix, op7_simhash, op8_decontaminate, op9_ngram_lm, op10_main_text, op11_tokenizer_alignment, op12_personal_data, op13_spelling_variants)}

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_steps(half: int) -> int:
    """Four steps of CRC-32's division."""
    for _ in range(4):
        half = half >> 1 ^ (half & 1) * 0xEDB88320
    return half


_CRC = [_crc_steps(i) for i in range(16)]

ORACLE_SQL = {
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS p
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), grams AS (
            SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ), firsts AS (SELECT gram, min(doc_id) AS first_doc_id FROM grams GROUP BY gram HAVING min(doc_id) < max(doc_id)
        ), hits AS (SELECT doc_id, i, first_doc_id FROM grams JOIN firsts USING (gram) WHERE doc_id > first_doc_id
        ), begun AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= 50, true)::INT AS begins FROM hits
        ), numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM begun
        ), runs AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b, arg_min(first_doc_id, i) AS first_doc_id FROM numbered GROUP BY doc_id, run
        ), placed AS (
            SELECT doc_id, a, b, first_doc_id, list_sum(list_transform(p[1:a], lambda x: strlen(x)))::BIGINT - strlen(w[a]) AS start, list_sum(list_transform(p[1:b], lambda x: strlen(x)))::BIGINT AS stop
            FROM runs JOIN d USING (doc_id)
        )
        SELECT doc_id, start, stop - start AS n_bytes, (b - a + 1)::BIGINT AS n_words, first_doc_id FROM placed""",
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(text, '')) AS sum, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM by_source
        ), levels AS (
            SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * CAST(2 AS DOUBLE))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
        ), free AS (SELECT max(level) AS free FROM levels WHERE level * weight <= source_size * 2
        ), targets AS (SELECT source, source_size, CASE WHEN free * weight <= source_size * 2 THEN free * weight ELSE source_size * CAST(2 AS DOUBLE) END AS target FROM levels, free
        ), rated AS (
            SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || sum), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE) AS u
            FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM rated""",
    "op8_decontaminate": f"""
        WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark
        ), sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
        ), d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
        ), places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
        ), found AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows USING (n, gram)
        ), hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL
        ), bytes AS (
            SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs
        ), halves AS (
            SELECT run, n, list_transform([4294967295] || flatten(list_transform(b, lambda x: [x & 15, x >> 4])), lambda x: x::BIGINT) AS b FROM bytes
        ), hashed AS (
            SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 4, {_CRC}[(xor(c, x) & 15) + 1])), 4294967295) AS h FROM halves
        ), words AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
        ), lost AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM lost a JOIN lost b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT w.word, d.word, d.n FROM words w JOIN lost d ON d.rest = w.word
            UNION SELECT d.word, w.word, w.n FROM words w JOIN lost d ON d.rest = w.word
        ), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
        ), told AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), steps AS (
            SELECT word, word AS here, form AS ahead FROM told
            UNION ALL SELECT s.word, t.word, t.form FROM steps s JOIN told t ON t.word = s.ahead
        )
        SELECT word, form, here AS root, n, n_near, form_n FROM told JOIN (SELECT word, here FROM steps WHERE ahead IS NULL) USING (word)""",
}
