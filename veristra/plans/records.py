"""Queries of records, reports, text forms and session rules, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.checkpoints import cut_lineage
from veristra.functions import language as L
from veristra.functions import text as X
from veristra.functions import vectors as V
from veristra.operators import answer, corpus, evaluate, gates, latency, records, reports
from veristra.plans.queries import MATCHING, NORMAL
from veristra.plans.registry import query
from veristra.session import table
from veristra.streaming import sessions

K = "json_extract_string(props, '$.k')::BIGINT"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


# ---------------------------------------------------------------- fields and checks


@query("SELECT doc_id, length(text) AS n, source AS origin FROM documents")
def field_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Fields found by alias lists in whatever case the source has them."""
    docs = table(spark, d, "documents").withColumnsRenamed({"text": "Passage_Text", "source": "ORIGIN"})
    return docs.select("doc_id", F.length(records.resolve(docs, "text", "passage_text")).alias("n"), records.resolve(docs, "origin", "source").alias("origin"))


@query("""WITH r AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'hi-en' ELSE 'en' END AS language, CASE WHEN turn % 2 = 0 THEN text ELSE ' ' END AS english, CASE WHEN conv_id % 2 = 0 THEN text || ' t' END AS translated, text AS q FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN language LIKE 'hi%' THEN coalesce(trim(translated), nullif(trim(english), ''), trim(q)) ELSE coalesce(nullif(trim(english), ''), trim(q)) END) AS h, CASE WHEN language LIKE 'hi%' AND translated IS NOT NULL THEN 'translated_query' WHEN trim(english) <> '' THEN 'english_query' ELSE 'query' END AS query_field FROM r""")
def query_selection(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    made = t.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "hi").when(F.col("conv_id") % 3 == 1, "hi-en").otherwise("en").alias("language"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" ").alias("english_query"), F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" t"))).alias("translated_query"), F.col("text").alias("query"))
    return records.chosen_query(made).select("conv_id", "turn", F.sha2("query_text", 256).alias("h"), "query_field")


@query(f"SELECT fault, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT CASE WHEN v IS NULL THEN 'missing' WHEN v = 'x' OR v = 'NaN' THEN 'not_a_number' WHEN v::DOUBLE NOT BETWEEN 10 AND 60.5 THEN 'out_of_range' END AS fault, CASE WHEN v NOT IN ('x', 'NaN') AND v::DOUBLE BETWEEN 10 AND 60.5 THEN v::DOUBLE END AS value FROM (SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN 'NaN' ELSE ({K})::VARCHAR END AS v FROM events)) GROUP BY fault")
def typed_fields(spark: SparkSession, d: str) -> DataFrame:
    """A number out of text, with what is wrong with it."""
    raw = F.when(F.col("event_id") % 7 == 1, "x").when(F.col("event_id") % 7 == 2, "NaN").when(F.col("event_id") % 7 > 2, _k().cast("string"))
    found = table(spark, d, "events").select(records.number_field(raw, 10, 60.5).alias("f"))
    return found.groupBy("f.fault").agg(F.count("*").alias("n"), F.round(F.sum("f.value"), 4).alias("total"))


@query("SELECT fault, count(*) AS n FROM (SELECT CASE WHEN turn - 1 <= 0 THEN 'limit' WHEN conv_id % 2 = 0 THEN 'query' END AS fault FROM conversations) GROUP BY fault")
def search_inputs(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("conv_id") % 2 == 0, " \t").otherwise(F.col("text"))
    return table(spark, d, "conversations").groupBy(records.search_fault(said, F.col("turn") - 1).alias("fault")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def bounded_prefix(spark: SparkSession, d: str) -> DataFrame:
    return records.prefix(table(spark, d, "documents"), 100, "doc_id").select("doc_id", "n_chars")


@query("""SELECT array_to_string(list_sort(list_filter([CASE WHEN answer IS NOT NULL THEN 'evaluation_field:answer' END, CASE WHEN trim(text) = '' THEN 'no_text' END, CASE WHEN n > 1 THEN 'repeated_key' END, CASE WHEN n_chars IS NOT NULL THEN 'unknown_field:n_chars' END], lambda x: x IS NOT NULL)), ',') AS faults, count(*) AS n
FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'a' END AS answer, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) GROUP BY 1""")
def corpus_row_checks(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows keyed by content: repeated keys, blank texts, evaluation fields and fields beyond the whitelist."""
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("canonical_doc_id"), "text", "n_chars", F.when(F.col("doc_id") % 5 == 0, "a").alias("answer"))
    found = records.corpus_faults(rows, "canonical_doc_id", "text", ("canonical_doc_id", "text"), tuple(corpus.EVALUATION_KEYS))
    return found.groupBy(F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))


@query("""SELECT path, field, count(*) AS n FROM (
  SELECT 'kinds.' || event_type AS path, event_type AS field FROM events WHERE event_type IN ('click', 'error')
  UNION ALL SELECT 'kinds.' || event_type || '[0].note.k', 'k' FROM events WHERE json_extract(props, '$.k') IS NOT NULL
  UNION ALL SELECT 'kinds.' || event_type || '[1].note.deep[1].Value', 'value' FROM events WHERE value > 50) GROUP BY ALL""")
def leak_paths(spark: SparkSession, d: str) -> DataFrame:
    """Forbidden names as keys of maps, in JSON held as text, and in JSON within such JSON."""
    events = table(spark, d, "events")
    deep = F.when(F.col("value") > 50, F.to_json(F.struct(F.array(F.lit("x"), F.to_json(F.struct(F.col("value").alias("Value")))).alias("deep"))))
    nested = events.select("event_id", F.create_map("event_type", F.array(F.struct(F.col("props").alias("note")), F.struct(deep.alias("note")))).alias("kinds"))
    return records.leaks(nested, "event_id", ("click", "ERROR", "k", "value")).groupBy("path", "field").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS canonical_doc_id, sha256(text) AS parent_id, length(text) AS n, NULL::VARCHAR AS translation_model FROM documents")
def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("Canonical_Doc_Id"), F.sha2("text", 256).alias("parent_id"), F.col("text").alias("english_text"), "n_chars", "source")
    found = records.payload(rows, tuple(corpus.PAYLOAD))
    return found.select("canonical_doc_id", "parent_id", F.length("english_text").alias("n"), F.col("translation_model").cast("string").alias("translation_model"))


@query("SELECT n_regionkey AS n_regionkey, count(*) AS n, min(n_nationkey) AS low, max(n_nationkey) AS high, max(n_nationkey) - min(n_nationkey) + 1 = count(DISTINCT n_nationkey) AND count(DISTINCT n_nationkey) = count(*) AS contiguous, true AS header_ok FROM nation GROUP BY GROUPING SETS ((n_regionkey), ())")
def catalogue_checks(spark: SparkSession, d: str) -> DataFrame:
    """A numbered catalogue with a strict header: counts and contiguity of each group and of all."""
    rows = table(spark, d, "nation")
    return records.catalogue(rows, tuple(rows.columns), "n_nationkey", "n_regionkey")


SIDES = "halves AS (SELECT doc_id, sha256(" + MATCHING.format("text") + ") AS content, ('0x' || substr(sha256('sha256' || chr(0) || '2026' || chr(0) || sha256(" + MATCHING.format("text") + ")), 1, 13))::BIGINT / 4503599627370496.0 < 0.2 AS dev FROM documents)"


RULES = records.Rules(texts=("text", "source"), numbers=("n_chars",), values=(("lang", ("en", "de")),), unique=(("text",), ("source", "n_chars")), contiguous=("doc_id",))


@query("""SELECT doc_id, 'missing:text' AS fault FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT doc_id, 'missing:source' FROM documents WHERE trim(coalesce(source, '')) = ''
UNION ALL SELECT doc_id, 'number:n_chars' FROM documents WHERE coalesce(n_chars, 0) < 1 UNION ALL SELECT doc_id, 'value:lang' FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')
UNION ALL SELECT doc_id, 'repeated:text' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT doc_id, 'repeated:source+n_chars' FROM documents WHERE (source, n_chars) IN (SELECT (source, n_chars) FROM documents GROUP BY source, n_chars HAVING count(*) > 1)
UNION ALL SELECT NULL, 'gap:doc_id' FROM (SELECT max(doc_id) AS high, count(DISTINCT doc_id) FILTER (doc_id > 0) AS n FROM documents) WHERE high <> n""")
def catalogue_faults(spark: SparkSession, d: str) -> DataFrame:
    """What breaks the rules of a strict catalogue, row by row."""
    return records.catalogue_faults(table(spark, d, "documents"), "doc_id", RULES)


@query("WITH " + SIDES + """, parts AS (SELECT 'content' AS split, doc_id, 1 - dev::INT AS part FROM halves UNION ALL SELECT 'overlapping', doc_id, n FROM documents, (SELECT unnest([2, 3]) AS n) WHERE doc_id % n = 0),
k AS (SELECT split, doc_id, count(DISTINCT part) AS p FROM parts GROUP BY ALL)
SELECT split, (SELECT count(DISTINCT doc_id) FROM documents) AS whole, sum(p)::BIGINT AS parts, count(*) = (SELECT count(DISTINCT doc_id) FROM documents) AS covered, max(p) = 1 AS disjoint FROM k GROUP BY split""")
def split_covers(spark: SparkSession, d: str) -> DataFrame:
    """A split by content, and parts of ids divisible by two and by three."""
    docs = table(spark, d, "documents")
    halves = evaluate.hash_split(docs, "text", 0.2)
    parts = {"content": [halves.where(F.col("split") == s) for s in ("development", "final")], "overlapping": [docs.where(F.col("doc_id") % n == 0) for n in (2, 3)]}
    content, overlapping = (records.covers(docs, p, "doc_id").select(F.lit(name).alias("split"), "*") for name, p in parts.items())
    return content.unionByName(overlapping)


@query("WITH " + SIDES + """, tagged AS (SELECT 'content' AS split, doc_id, content, dev FROM halves UNION ALL SELECT 'id', doc_id, content, doc_id % 5 = 0 FROM halves WHERE doc_id % 7 > 0 UNION ALL SELECT 'id', doc_id, content, true FROM halves WHERE doc_id % 35 = 1),
ids AS (SELECT split, doc_id, count(*) FILTER (dev) AS a, count(*) FILTER (NOT dev) AS b FROM tagged GROUP BY ALL), contents AS (SELECT split, bool_or(a > 0 AND b > 0) AS both_ FROM (SELECT split, content, count(*) FILTER (dev) AS a, count(*) FILTER (NOT dev) AS b FROM tagged GROUP BY ALL) GROUP BY split),
m AS (SELECT split, sum(a) > 0 AS development_not_empty, sum(b) > 0 AS final_not_empty, NOT bool_or(a > 0 AND b > 0) AS ids_disjoint, count(*) = (SELECT count(DISTINCT doc_id) FROM documents) AS source_covered, max(greatest(a, b)) <= 1 AS ids_unique FROM ids GROUP BY split)
SELECT split, "check", passed FROM (SELECT *, NOT both_ AS contents_disjoint FROM m JOIN contents USING (split)) UNPIVOT (passed FOR "check" IN (development_not_empty, final_not_empty, ids_disjoint, contents_disjoint, source_covered, ids_unique))""")
def held_out_provenance(spark: SparkSession, d: str) -> DataFrame:
    """A split by content, which holds out, and one by id that leaves rows out, has some twice and parts equal contents."""
    docs = cut_lineage(table(spark, d, "documents").select("doc_id", evaluate.content_group(F.col("text")).alias("content")))
    halves = evaluate.hash_split(docs, "content", 0.2, hashed=True)
    kept = docs.where(F.col("doc_id") % 7 > 0)
    by_id = kept.where(F.col("doc_id") % 5 == 0).unionByName(docs.where(F.col("doc_id") % 35 == 1)), kept.where(F.col("doc_id") % 5 > 0)
    splits = {"content": [halves.where(F.col("split") == s) for s in ("development", "final")], "id": by_id}
    content, other = (reports.provenance(docs, *sides, "doc_id", "content", hashed=True).select(F.lit(name).alias("split"), "*") for name, sides in splits.items())
    return content.unionByName(other)


@query("SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'utc' WHEN 1 THEN 'other' WHEN 2 THEN 'other' ELSE 'utc' END AS kind FROM events) GROUP BY kind")
def utc_times(spark: SparkSession, d: str) -> DataFrame:
    """Times that say an offset of zero, beside others and none."""
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*[F.lit(x) for x in ("Z", "+05:30", "", "+00:00")]), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, d, "events").groupBy(F.when(records.utc_time(said).isNotNull(), "utc").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(greatest(0, gap * 1000 / 1000000.0::DOUBLE), 3) + 0 * gap AS ms FROM (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)")
def elapsed_times(spark: SparkSession, d: str) -> DataFrame:
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    before = F.lag(ns).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    found = table(spark, d, "events").select("event_id", F.when(before.isNotNull(), records.milliseconds(before, ns)).alias("ms"))
    return found.select("event_id", F.round("ms", 3).alias("ms"))


@query(f"SELECT user_id, k, event_id, place FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS place FROM (SELECT *, {K} AS k, row_number() OVER (PARTITION BY user_id, {K} ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) WHERE place <= 10")
def request_history(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest requests of each user, each once."""
    rows = table(spark, d, "events").withColumn("k", _k())
    return records.history(rows, "user_id", "k", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "k", "event_id", "place")


@query("""SELECT conv_id, turn, array_to_string(regexp_extract_all(replace(lower(array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(said, '[.!?।॥;\\n]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''),
  lambda s: regexp_replace(s, '^(?:according to (?:the )?(?:information|available information|provided information) (?:i|we) have,?\\s*|based on (?:the )?(?:information|available information|provided information) (?:i|we) have,?\\s*|in the provided information,?\\s*)', '', 'i')), ' ')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS claim
FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'According to the information we have, ' WHEN 1 THEN 'In the provided information, ' ELSE '' END || text AS said FROM conversations)""")
def claim_forms(spark: SparkSession, d: str) -> DataFrame:
    opening = F.when(F.col("conv_id") % 3 == 0, "According to the information we have, ").when(F.col("conv_id") % 3 == 1, "In the provided information, ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", records.claim_tokens(F.concat(opening, "text")).alias("claim"))


# ---------------------------------------------------------------- reports


@query("SELECT quality, count(*) AS n, round(count(*) FILTER (toxic = 1) / nullif(count(*) FILTER (toxic IN (0, 1)), 0), 6) AS ratio FROM labels GROUP BY quality")
def selected_ratios(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(reports.selected_ratio(F.col("toxic")), 6).alias("ratio"))


TOKENS = "(SELECT coalesce(sum(CASE WHEN regexp_matches(piece, '^[A-Za-z0-9_]+$') THEN ceil(length(piece) / 4.0) WHEN regexp_matches(piece, '^[\\p{L}\\p{N}_]+$') THEN ceil(length(piece) / 2.0) ELSE 1 END), 0)::BIGINT FROM (SELECT unnest(regexp_extract_all(" + NORMAL.format("text") + ", '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS piece))"


@query("SELECT lang, source, count(*) AS rows, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (trim(text) = '') AS blank, count(DISTINCT text) AS different, count(text) - count(DISTINCT text) AS surplus, min(length(text))::INT AS shortest, quantile_disc(length(text), 0.5)::INT AS median, max(length(text))::INT AS longest, sum(tokens)::BIGINT AS tokens FROM (SELECT *, " + TOKENS + " AS tokens FROM documents) GROUP BY lang, source")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """The audit of every (language, source), one row each."""
    return reports.audit(table(spark, d, "documents"), "lang", "source")


_FIGURES = lambda section, **named: ", ".join(f"{{'section': '{section}', 'name': '{name}', 'value': ({sql})::DOUBLE}}" for name, sql in named.items())
_CELLS = ", ".join("{'section': 'field', 'name': 'missing:%s', 'value': (count(*) FILTER (%s IS NULL))::DOUBLE}, {'section': 'field', 'name': 'empty:%s', 'value': (%s)::DOUBLE}" % (c, c, c, f"count(*) FILTER (trim({c}) = '')" if c in ("text", "lang", "source") else "0") for c in ("doc_id", "text", "lang", "source", "n_chars"))


@query("WITH m AS (SELECT *, length(text) AS n, " + TOKENS + " AS tokens FROM documents), t AS (SELECT lang, grouping(lang) = 1 AS whole, text, count(*) AS n, count(DISTINCT source) AS s FROM documents WHERE text IS NOT NULL GROUP BY GROUPING SETS ((lang, text), (text))), found AS (SELECT grouping(lang) = 1 AS whole, lang, ["
  + ", ".join((_FIGURES("rows", rows="count(*)"), _CELLS, _FIGURES("length", least="min(n)", p50="quantile_disc(n, 0.5)", p95="quantile_disc(n, 0.95)", greatest="max(n)", mean="avg(n)", short="count(*) FILTER (n < 20)"), _FIGURES("tokens", sum="sum(tokens)", greatest="max(tokens)")))
  + "] AS x FROM m GROUP BY GROUPING SETS ((lang), ()) UNION ALL SELECT whole, lang, [" + _FIGURES("copies", different="count(*)", surplus="sum(n - 1)", reused="count(*) FILTER (s > 1)") + "] FROM t GROUP BY whole, lang UNION ALL SELECT grouping(lang) = 1, lang, ["
  + _FIGURES("label", positive="count(*) FILTER (quality = 1)", negative="count(*) FILTER (quality = 0)", invalid="count(*) FILTER (quality IS NULL OR quality NOT IN (0, 1))", ratio="count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IN (0, 1)), 0)")
  + "] FROM labels JOIN (SELECT DISTINCT doc_id, lang FROM documents) USING (doc_id) GROUP BY GROUPING SETS ((lang), ())) SELECT whole, lang, u.section AS section, u.name AS name, round(u.value, 6) AS value FROM (SELECT whole, lang, unnest(x) AS u FROM found)")
def full_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows, cells, lengths, tokens, copies and labels of every language and of all, a row a figure."""
    found = reports.full_audit(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "lang", label="quality")
    return found.withColumn("value", F.round("value", 6))


@query("""WITH u AS (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 2 ELSE max((event_type = 'view')::INT) END::DOUBLE AS l, max((event_type = 'purchase' AND value > 60)::INT)::DOUBLE AS r, max(value) FILTER (event_type = 'click') AS t FROM events GROUP BY user_id),
s AS (SELECT count(*) AS requests, coalesce(sum(l), 0) AS launched, coalesce(sum(r), 0) AS reused, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS reported, count(*) FILTER (r > l) AS inconsistent, count(*) FILTER (NOT coalesce(l IN (0, 1) AND r IN (0, 1), false)) AS invalid, count(*) FILTER (l = 1 AND t IS NULL) AS without_duration FROM u)
SELECT *, round(reported / requests, 6) AS coverage, round(reused / launched, 6) AS reuse_rate, inconsistent = 0 AND invalid = 0 AND reused <= launched AS consistent, reported = requests AND inconsistent = 0 AND invalid = 0 AND reused <= launched AND without_duration = 0 AS qualified FROM s""")
def speculation_counters(spark: SparkSession, d: str) -> DataFrame:
    launched = F.when(F.col("user_id") % 11 == 0, None).when(F.col("user_id") % 13 == 0, 2.0).otherwise(F.max((F.col("event_type") == "view").cast("double")))
    users = table(spark, d, "events").groupBy("user_id").agg(launched.alias("l"), F.max(((F.col("event_type") == "purchase") & (F.col("value") > 60)).cast("double")).alias("r"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("t"))
    rows = users.select(F.map_from_arrays(F.array(*[F.lit(x) for x in ("speculative_launched", "speculative_reused", "speculative_retrieval")]), F.array("l", "r", "t")).alias("timings_ms"))
    return reports.speculation(rows).withColumns({c: F.round(c, 6) for c in ("coverage", "reuse_rate")})


@query("SELECT event_type, count(*) AS rows, count(s) AS compared, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS least_similarity, count(*) FILTER (s >= 0.8) AS matches, count(*) FILTER (s = 1) AS exact, round(count(s) / count(*), 6) AS coverage FROM (SELECT event_type, CASE WHEN event_id % 9 > 0 THEN least(1.0, value / 50) END AS s FROM events) GROUP BY event_type")
def transcript_quality(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_id") % 9 > 0, F.least(F.lit(1.0), F.col("value") / 50))
    rows = table(spark, d, "events").select("event_type", s.alias("similarity")).withColumns({"matches": F.col("similarity") >= 0.8, "exact": F.col("similarity") == 1})
    return reports.transcripts(rows, "event_type").withColumns({c: F.round(c, 6) for c in ("mean_similarity", "least_similarity", "coverage")})


@query("SELECT event_type, n >= 100 AND m < 60 AND b <= 500 AS qualified, CASE WHEN n < 100 THEN 'enough' WHEN m >= 60 THEN 'mean' WHEN b > 500 THEN 'largest' END AS failed FROM (SELECT event_type, count(*) AS n, avg(value) AS m, max(value) AS b FROM events GROUP BY event_type)")
def qualifications(spark: SparkSession, d: str) -> DataFrame:
    """Named checks in order; the first that fails names the status."""
    q = reports.qualification(enough=F.count("*") >= 100, mean=F.avg("value") < 60, largest=F.max("value") <= 500)
    return table(spark, d, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", "q.qualified", "q.failed")


@query("""SELECT name, CASE WHEN n IS NULL THEN 'missing' WHEN least_value < 0.02 THEN 'invalid' WHEN n >= 2000 THEN 'qualifying' ELSE 'insufficient' END AS status FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS name) LEFT JOIN (SELECT event_type AS name, count(*) AS n, min(value) AS least_value FROM events GROUP BY event_type) USING (name)""")
def evidence_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Which of the wanted reports are missing, invalid, insufficient or qualifying."""
    names = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "refund", "signup", "view")], "name string")
    found = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.min("value").alias("least_value"))
    return reports.roll_up(names, found, F.col("least_value") < 0.02, F.col("n") >= 2000)


CONFIG = {"strategy": "atomic", "dimension": 64, "languages": ["hi", "en"]}


@query("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS ids, sum(strlen(text))::BIGINT AS bytes, sum(('0x' || substr(sha256(text), 1, 8))::BIGINT)::BIGINT AS checksum, sha256('{\"dimension\":64,\"languages\":[\"hi\",\"en\"],\"strategy\":\"atomic\"}') AS config FROM documents")
def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    return reports.manifest(table(spark, d, "documents"), CONFIG, "doc_id")


@query("""WITH p AS (SELECT label, vec_id, embedding FROM embeddings WHERE label <> 3 OR vec_id % 7 > 0 UNION ALL SELECT label, vec_id, embedding FROM embeddings WHERE label = 4 AND vec_id % 3 = 0),
built AS (SELECT label, count(*) AS n FROM embeddings WHERE label BETWEEN 0 AND 4 GROUP BY label UNION ALL SELECT -1, 10),
f AS (SELECT b.label, n, CASE WHEN b.label = 2 THEN 32 ELSE 64 END AS dim, count(vec_id) AS points, count(DISTINCT vec_id) AS keys, count(*) FILTER (len(embedding) = CASE WHEN b.label = 2 THEN 32 ELSE 64 END) AS fitting FROM built b LEFT JOIN p USING (label) GROUP BY ALL)
SELECT label, points, keys, fitting, CASE WHEN points = 0 THEN 'empty' WHEN fitting <> points THEN 'wrong_dimension' WHEN keys <> points THEN 'repeated_keys' WHEN points <> n THEN 'incomplete' ELSE 'ready' END AS status FROM f""")
def index_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Six indexes beside what was built: two whole, one of another dimension, one with rows lost, one with rows twice, one empty."""
    rows = table(spark, d, "embeddings")
    built = {r["label"]: r["count"] for r in rows.where("label BETWEEN 0 AND 4").groupBy("label").count().collect()} | {-1: 10}
    stored = rows.where("label <> 3 OR vec_id % 7 > 0").unionByName(rows.where("label = 4 AND vec_id % 3 = 0"))
    found = [reports.readiness(stored.where(F.col("label") == label), n, 32 if label == 2 else 64, "embedding", "vec_id").select(F.lit(label).alias("label"), "points", "keys", "fitting", "status") for label, n in sorted(built.items())]
    return reduce(DataFrame.unionByName, found)


FROZEN = "SELECT count(*) AS queries, sha256('[' || string_agg(DISTINCT '\"' || item_id || '\"', ',' ORDER BY '\"' || item_id || '\"') || ']') AS ids, count(DISTINCT c) AS contents, sha256('[' || string_agg(DISTINCT '\"' || c || '\"', ',' ORDER BY '\"' || c || '\"') || ']') AS content_hash, 0.24::DOUBLE AS min_score, 0.015::DOUBLE AS min_margin, 0.05::DOUBLE AS min_agreement FROM (SELECT item_id, sha256(" + MATCHING.format("text") + ") AS c FROM benchmark)"


@query(FROZEN)
def frozen_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds bound to the queries that they were found on."""
    return reports.frozen(table(spark, d, "benchmark"), "item_id", "text", 0.24, 0.015, 0.05)


_frozen = lambda where="true", text="text", score="0.24": FROZEN.replace("0.24::DOUBLE", f"{score}::DOUBLE").replace("FROM benchmark", f"FROM (SELECT item_id, {text} AS text FROM benchmark WHERE {where})")
_FIELDS = ("queries", "ids", "contents", "content_hash", "min_score", "min_margin", "min_agreement")


@query("WITH held AS (" + FROZEN + "), now AS (SELECT 'same' AS name, * FROM (" + _frozen() + ") UNION ALL SELECT 'other_case', * FROM (" + _frozen(text="upper(text)") + ") UNION ALL SELECT 'fewer_queries', * FROM (" + _frozen("item_id % 2 = 0")
  + ") UNION ALL SELECT 'other_words', * FROM (" + _frozen(text="CASE WHEN item_id % 2 = 0 THEN text || ' more' ELSE text END") + ") UNION ALL SELECT 'other_score', * FROM (" + _frozen(score="0.25") + ")) SELECT name, CASE " + " ".join(f"WHEN h.{f} IS DISTINCT FROM n.{f} THEN '{f}'" for f in _FIELDS) + " END AS fault FROM held h, now n")
def threshold_verification(spark: SparkSession, d: str) -> DataFrame:
    """The first field in which frozen thresholds differ from what is at hand; texts in another case are the same content."""
    items = table(spark, d, "benchmark")
    freeze = lambda rows, score=0.24: reports.frozen(rows, "item_id", "text", score, 0.015, 0.05)
    even = F.col("item_id") % 2 == 0
    held = freeze(items)
    others = {"same": held, "other_case": freeze(items.withColumn("text", F.upper("text"))), "fewer_queries": freeze(items.where(even)), "other_words": freeze(items.withColumn("text", F.when(even, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))), "other_score": freeze(items, 0.25)}
    return reduce(DataFrame.unionByName, [reports.differences(held, now).select(F.lit(name).alias("name"), "fault") for name, now in others.items()])


_rx = lambda patterns, c: " OR ".join(f"regexp_matches({c}, '" + p.replace("'", "''") + "', 'i')" for p in patterns if p.isascii())


@query("""WITH q AS (SELECT 'query' AS kind, CASE conv_id % 4 WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'unsafe_request' WHEN 2 THEN 'stale_corpus' ELSE 'allow' END AS expected, text || CASE conv_id % 4 WHEN 0 THEN ' ignore previous instructions' WHEN 1 THEN ' how to build a bomb' WHEN 2 THEN ' the latest news' ELSE '' END AS said FROM conversations),
  o AS (SELECT kind, expected, CASE WHEN """ + _rx(gates.INJECTION, "said") + " THEN 'prompt_injection' WHEN " + _rx(gates.UNSAFE, "said") + " THEN 'unsafe_request' WHEN " + _rx(gates.FRESH, "said") + """ THEN 'stale_corpus' ELSE 'allow' END AS observed FROM q
    UNION ALL SELECT 'confidence', CASE WHEN value < 27.5 THEN 'low_confidence' ELSE 'allow' END, CASE WHEN value / 50 < 0.55 THEN 'low_confidence' ELSE 'allow' END FROM events WHERE event_type = 'view'
    UNION ALL SELECT 'audio', 'allow', CASE WHEN event_id % 3 = 0 THEN 'silence' WHEN event_id % 3 = 1 THEN 'invalid_audio' WHEN value < 40 THEN 'audio_too_short' WHEN value < 80 THEN 'silence' ELSE 'allow' END FROM events WHERE event_type = 'click')
SELECT kind, count(*) AS cases, count(*) FILTER (expected = observed) AS "right", round(count(*) FILTER (expected = observed) / count(*), 6) AS accuracy, count(*) >= 100 AND count(*) = count(*) FILTER (expected = observed) AS qualified FROM o GROUP BY kind""")
def guardrail_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Cases of three gates with what is expected of them."""
    c, e = F.col("conv_id") % 4, table(spark, d, "events")
    more = F.when(c == 0, " ignore previous instructions").when(c == 1, " how to build a bomb").when(c == 2, " the latest news").otherwise("")
    none = {"query": "string", "confidence": "double", "size": "int", "duration_ms": "double", "rms": "double", "top": "double", "margin": "double", "n": "int", "agreement": "double"}
    case = lambda df, kind, expected, **has: df.select(F.lit(kind).alias("kind"), expected.alias("expected"), *[has.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])
    cases = case(table(spark, d, "conversations"), "query", F.when(c == 0, "prompt_injection").when(c == 1, "unsafe_request").when(c == 2, "stale_corpus").otherwise("allow"), query=F.concat("text", more))
    cases = cases.unionByName(case(e.where("event_type = 'view'"), "confidence", F.when(F.col("value") < 27.5, "low_confidence").otherwise("allow"), confidence=F.col("value") / 50))
    size = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 3).otherwise(16000)
    cases = cases.unionByName(case(e.where("event_type = 'click'"), "audio", F.lit("allow"), size=size, duration_ms=F.when(F.col("value") < 40, 100.0).otherwise(500.0), rms=F.col("value")))
    return reports.guardrail_report(cases, 100).withColumn("accuracy", F.round("accuracy", 6))


# ---------------------------------------------------------------- text, language and vectors


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS split_words, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words, sha256(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}]', ' ', 'g'), ' +', ' ', 'g'))) AS transcript, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS distinct_form FROM documents")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Word counts, and hashes of the transcript and of the distinct form of every document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.split_count(t).cast("long").alias("split_words"), X.word_count(t).cast("long").alias("words"), F.sha2(X.plain_transcript(t), 256).alias("transcript"), F.sha2(X.distinct_form(t), 256).alias("distinct_form"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN lang = 'en' THEN 'en' ELSE 'unknown' END WHEN 1 THEN 'hi' WHEN 2 THEN 'ta' ELSE 'unknown' END AS language FROM documents")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.lit("-IN"))).when(F.col("doc_id") % 4 == 1, "HIN_Deva").when(F.col("doc_id") % 4 == 2, " tam ").otherwise("xx-YY")
    return table(spark, d, "documents").select("doc_id", L.language_of_tag(tag).alias("language"))


@query("SELECT conv_id, turn, contains(text, quote) OR contains(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(quote), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS quoted FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN substr(text, 3, 20) WHEN 1 THEN upper(substr(text, 1, 15)) ELSE substr(text, 1, 9) || ' zz' END AS quote FROM conversations)")
def exact_quotes(spark: SparkSession, d: str) -> DataFrame:
    quote = F.when(F.col("turn") % 3 == 0, F.substring("text", 3, 20)).when(F.col("turn") % 3 == 1, F.upper(F.substring("text", 1, 15))).otherwise(F.concat(F.substring("text", 1, 9), F.lit(" zz")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.exact_quote(quote, F.col("text")).alias("quoted"))


@query(f"SELECT event_id, {K} % 10 = {K} OR event_id % 2 = 0 AS backed FROM events")
def number_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of two numbers against quotes that hold one or both."""
    k = _k().cast("string")
    claim = F.concat(F.lit("from "), k, F.lit(" to "), (_k() % 10).cast("string"))
    quotes = F.concat(F.lit("<"), k, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("> <"), (_k() % 10).cast("string"))).otherwise(""), F.lit(">"))
    return table(spark, d, "events").select("event_id", X.numbers_supported(claim, F.when((_k() % 10 != _k()) & (F.col("event_id") % 2 == 1), F.regexp_replace(quotes, (_k() % 10).cast("string"), F.lit("#"))).otherwise(quotes)).alias("backed"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS size FROM embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(V.unit(v), 1), 6).alias("first"), F.round(V.norm(v), 4).alias("size"))


@query("SELECT vec_id, vec_id % 5 NOT IN (1, 2) AND 40 + vec_id % 7 < 45 AS valid FROM embeddings")
def sparse_validity(spark: SparkSession, d: str) -> DataFrame:
    """Index lists that repeat or fall, and ones that leave the space."""
    n = F.col("vec_id")
    indices = F.when(n % 5 == 1, F.array(F.lit(3), F.lit(3), F.lit(9))).when(n % 5 == 2, F.array(F.lit(9), F.lit(3), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(2), (40 + n % 7).cast("int")))
    return table(spark, d, "embeddings").select("vec_id", V.valid_sparse(indices, F.slice("embedding", 1, 3), 45).alias("valid"))


# ---------------------------------------------------------------- latency and sessions


@query("SELECT event_id, least(2000.0, 100 * 2 ** (event_id % 7))::DOUBLE AS wait_ms FROM events")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", latency.backoff(F.col("event_id") % 7, 100.0, 2000.0).alias("wait_ms"))


@query(f"SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN {K} % 10 = 9 THEN 'do_not_retry' WHEN {K} % 10 IN (0, 1) OR event_id % 20 = 3 THEN 'retry_with_backoff' WHEN {K} % 10 = 2 OR event_id % 20 = 4 THEN 'reconnect_new_session' ELSE 'do_not_retry' END AS disposition FROM events) GROUP BY disposition")
def retry_dispositions(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(_k() % 10 < 2, 1011).when(_k() % 10 == 2, 1008)
    status = F.when(F.col("event_id") % 20 == 3, 503).when(F.col("event_id") % 20 == 4, 408).otherwise(200)
    error = F.when(_k() % 10 == 9, "invalid_config").otherwise("")
    return table(spark, d, "events").groupBy(latency.retry(code, status, error).alias("disposition")).agg(F.count("*").alias("n"))


@query("SELECT user_id, round(CASE WHEN count(DISTINCT event_type) = 5 THEN sum(m) END, 4) AS core_ms FROM (SELECT user_id, event_type, max(value) AS m FROM events WHERE value < 120 GROUP BY ALL) GROUP BY user_id")
def core_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """The sum of five stages, for users with a timing of each."""
    kinds = ("view", "click", "purchase", "signup", "error")
    stages = [F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds]
    return table(spark, d, "events").where("value < 120").groupBy("user_id").agg(*stages).select("user_id", F.round(latency.subtotal(*[F.col(k) for k in kinds]), 4).alias("core_ms"))


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER w - 1 AS due, row_number() OVER w - 1 + (event_id % 97 = 0)::INT AS sequence, (value * 100)::INT AS size, sum((value * 100)::INT) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) FILTER (sequence <> due) AS out_of_order, count(*) FILTER (sequence = due AND size % 2 = 1) AS odd_bytes, count(*) FILTER (sequence = due AND size % 2 = 0 AND total > 1920000) AS too_long FROM c GROUP BY user_id""")
def audio_order(spark: SparkSession, d: str) -> DataFrame:
    """Faults of numbered audio pieces, by the state machine."""
    w = W.partitionBy("user_id").orderBy("event_id")
    pieces = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1 + (F.col("event_id") % 97 == 0).cast("int")).alias("sequence"), F.round(F.col("value") * 100).cast("int").alias("size"))
    found = sessions.batch(pieces, sessions.contiguous, "user_id", ["event_id"], "user_id long, sequence long, fault string")
    return found.groupBy("user_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("out_of_order", "odd_bytes", "too_long")])


@query("""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}]', ' ', 'g'), ' +', ' ', 'g')) AS form FROM conversations),
l AS (SELECT conv_id, arg_max(form, turn) AS last FROM f GROUP BY conv_id)
SELECT conv_id, coalesce(CASE WHEN conv_id % 2 = 0 THEN last ELSE form END = last, false) AS reuse FROM f JOIN l USING (conv_id) WHERE turn = 0""")
def speculative_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Finals that equal the newest stable partial, and others."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("generation"), X.plain_transcript(F.col("text")).alias("form"))
    last = turns.groupBy("session").agg(F.max_by("form", "generation").alias("last"))
    finals = turns.where("generation = 0").join(last, "session").select("session", F.when(F.col("session") % 2 == 0, F.col("last")).otherwise(F.col("form")).alias("form"))
    return sessions.speculative_reuse(finals, turns).select(F.col("session").alias("conv_id"), "reuse")


@query("""SELECT conv_id * 1000 + turn AS claim_id, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_evidence' WHEN 2 THEN 'inexact_quote' ELSE 'citations' END AS reason, turn % 4 = 0 AS valid FROM conversations WHERE length(text) > 20""")
def claim_validation(spark: SparkSession, d: str) -> DataFrame:
    """Claims with one citation of a turn's text: right, of unknown evidence, inexact, and without any."""
    turns = table(spark, d, "conversations").where("length(text) > 20").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    t = F.col("turn") % 4
    cite = F.struct(F.when(t == 1, F.lit("none")).otherwise(F.col("id").cast("string")).alias("chunk_id"), F.when(t == 2, F.concat(F.lit("zz~"), F.substring("text", 1, 9))).otherwise(F.substring("text", 1, 15)).alias("quote"))
    claims = turns.select(F.col("conv_id").alias("query_id"), F.col("id").alias("claim_id"), F.lit("plain claim").alias("claim"), F.when(t == 3, F.slice(F.array(cite), 1, 0)).otherwise(F.array(cite)).alias("citations"))
    found = answer.validate_claims(claims, turns.select(F.col("conv_id").alias("query_id"), F.col("id").cast("string").alias("chunk_id"), "text"))
    return found.select("claim_id", "reason", "valid")
