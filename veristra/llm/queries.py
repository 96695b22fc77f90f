"""The queries of the training-data operators: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.llm import ann, bestfit, licenses, manifest, middle, minhash, mixing, packing, quality, sharding, substring, toxicity, urls
from veristra.llm.common import read


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.plan_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: their folder is source, then language."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(docs.select("doc_id", "text", path.alias("path")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), toxicity.third)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.third(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(read(spark, sf_dir, "documents"))
    base = [F.col(f"measures.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return scored.select("doc_id", *base, "base_failed", "kept", F.col("quality").alias("posterior"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(read(spark, sf_dir, "documents"), 35)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mixture(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_file())


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(read(spark, sf_dir, "documents"), seed=7, rate=100, suffix_first=50)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key's checksum 7 divides are folded from a leaf with n_chars raised by 1."""
    docs = read(spark, sf_dir, "documents")
    leaf = lambda n_chars: manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.try_add("n_chars", F.lit(1)))).alias("given"))
    proved = manifest.manifest(leaves).withColumn("folded_root", manifest.folded(F.coalesce("given", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(read(spark, sf_dir, "documents"), tokenizer_file(), bestfit.Capacities())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_hash_forest": op2_hash_forest,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_minhash": op5_minhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring": op7_substring,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_middle": op11_middle,
    "op12_merkle": op12_merkle,
    "op13_best_fit": op13_best_fit,
}

WORDS_SQL = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

NEAR_SQL = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) AS i FROM worded)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
), component AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

REPEATS_SQL = f"""
WITH worded AS (
    SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents
), starts AS (
    SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS window_text
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM worded)
), repeated AS (
    SELECT doc_id, i FROM starts WHERE window_text IN (SELECT window_text FROM starts GROUP BY window_text HAVING count(*) > 1)
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM repeated
), single AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded
), rest AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept_text, count(*) AS n_kept
    FROM single ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM worded LEFT JOIN rest USING (doc_id)
"""

MIDDLE_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
    SELECT *, len(lines) AS n, [CAST('0x' || h[i : i + 7] AS BIGINT) FOR i IN [1, 9, 17, 25]] AS d FROM cut
), placed AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, array_to_string(lines[1 : a], '') AS p, array_to_string(lines[a + 1 : b], '') AS m, array_to_string(lines[b + 1 :], '') AS s FROM placed
), moved AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
), marked AS (
    SELECT *, strpos(output, '<P>') AS x, strpos(output, '<S>') AS y, strpos(output, '<M>') AS z FROM moved
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN substr(output, x + 3, y - x - 3) || substr(output, z + 3) || substr(output, y + 3, z - y - 3)
        ELSE substr(output, x + 3, z - x - 3) || substr(output, z + 3) || substr(output, y + 3, x - y - 3) END) AS restored_sha256
FROM marked
"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_field_sql(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: crc32 of a short text: bits from the last one up; each byte goes through eight steps of the reversed polynomial.
MERKLE_SQL = f"""
WITH RECURSIVE keyed AS (
    SELECT *, row_number() OVER () AS row_id FROM documents
), crc AS (
    SELECT row_id, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM keyed WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT row_id, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(CAST(doc_id AS VARCHAR)[i // 9 + 1])) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
    FROM crc JOIN keyed USING (row_id) WHERE i < 9 * length(CAST(doc_id AS VARCHAR))
), sums AS (
    SELECT row_id, xor(arg_max(c, i), 4294967295) AS crc FROM crc GROUP BY row_id
), leaves AS (
    SELECT row_id, doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS given
    FROM keyed LEFT JOIN sums USING (row_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), lower AS (
    SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM lower WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
    SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM lower WHERE n = 1
), upper AS (
    SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2
), top AS (
    SELECT level AS height, node AS root FROM upper WHERE n = 1
), paths AS (
    SELECT p.row_id, h.level, p.pos >> h.level AS place, s.node AS sibling
    FROM placed p JOIN (SELECT DISTINCT lang, level FROM lower WHERE n > 1) h ON h.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN lower s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = h.level AND s.pos = xor(p.pos >> h.level, 1)
    UNION ALL
    SELECT p.row_id, r.height + u.level, r.pos >> u.level, s.node
    FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) u ON TRUE
    LEFT JOIN upper s ON s.level = u.level AND s.pos = xor(r.pos >> u.level, 1)
), folds AS (
    SELECT row_id, 0 AS level, given AS node FROM placed
    UNION ALL
    SELECT row_id, level + 1, sha256(CASE WHEN place % 2 = 1 THEN coalesce(sibling, '') || node ELSE node || coalesce(sibling, '') END)
    FROM folds JOIN paths USING (row_id, level)
), ended AS (
    SELECT row_id, arg_max(node, level) AS folded_root FROM folds GROUP BY row_id
), proofs AS (
    SELECT row_id, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof FROM paths GROUP BY row_id
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots r ON r.lang IS NOT DISTINCT FROM placed.lang JOIN top ON TRUE JOIN ended USING (row_id) LEFT JOIN proofs USING (row_id)
"""

#: The other operators fit models, iterate to a fixed point or draw by hash; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_minhash": NEAR_SQL, "op7_substring": REPEATS_SQL, "op11_middle": MIDDLE_SQL, "op12_merkle": MERKLE_SQL}
