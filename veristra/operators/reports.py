"""Reports: audits, counters, roll-ups, qualification, manifests, readiness, thresholds and provenance, one aggregate each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veristra.functions import text as X
from veristra.operators import evaluate, gates


def selected_ratio(label: Column) -> Column:
    """Share of positive ones among valid labels; null if there are none."""
    positive, negative = F.count_if(label == 1), F.count_if(label == 0)
    return F.try_divide(positive, positive + negative)


def audit(docs: DataFrame, *by: str, text: str = "text", tokens=X.estimate_tokens) -> DataFrame:
    """One row a group: rows, missing and blank texts, different texts and surplus, lengths and estimated tokens.

    ``tokens``: a Column function that counts a text's tokens. Copies combine by hash before the distinct count.
    """
    t = F.col(text)
    measured = docs.select(*by, F.length(t).alias("length"), F.sha2(t, 256).alias("hash"), t.isNull().alias("null"), (F.trim(t) == "").alias("blank"), tokens(t).alias("tokens"))
    return measured.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if("null").alias("missing"), F.count_if("blank").alias("blank"), F.count_distinct("hash").alias("different"), (F.count("hash") - F.count_distinct("hash")).alias("surplus"),
        F.min("length").alias("shortest"), evaluate.nearest_rank("length", 50).alias("median"), F.max("length").alias("longest"), F.sum("tokens").alias("tokens"),
    )


def full_audit(docs: DataFrame, labels: DataFrame, key: str, by: str, text: str = "text", source: str = "source", label: str = "label", tokens=X.estimate_tokens, short: int = 20) -> DataFrame:
    """(whole, <by>, section, name, value): all that is known of a corpus, for each value of ``by`` and for the whole, a row a figure.

    Sections: rows; field (missing and empty cells of each column); length (of texts: least, median, p95, greatest, mean,
    and how many are under ``short``); tokens; copies (different texts, surplus, reused under several sources); label
    (positive, negative, invalid, ratio, of labelled rows of the corpus; a section only where there are some). labels: key
    and ``label``. Texts are measured once, copies combine by hash before any count of distinct values, labels are
    joined without the texts. A null of ``by`` is a value of its own; ``whole`` tells the total apart. No rows, no figures.
    """
    t, n = F.col(f"`{text}`"), F.count("*")
    blank = lambda f: F.count_if(F.trim(F.col(f"`{f.name}`")) == "") if isinstance(f.dataType, T.StringType) else F.lit(0)
    # named apart from the columns, which may be called anything
    measured = docs.withColumns({"__g": F.col(f"`{by}`"), "__length": F.length(t), "__tokens": tokens(t)})
    figures = {("rows", "rows"): n}
    for f in docs.schema.fields:
        figures[("field", f"missing:{f.name}")] = F.count_if(F.col(f"`{f.name}`").isNull())
        figures[("field", f"empty:{f.name}")] = blank(f)
    figures |= {("length", k): c for k, c in (("least", F.min("__length")), ("p50", evaluate.nearest_rank("__length", 50)), ("p95", evaluate.nearest_rank("__length", 95)), ("greatest", F.max("__length")), ("mean", F.avg("__length")), ("short", F.count_if(F.col("__length") < short)))}
    figures |= {("tokens", "sum"): F.sum("__tokens"), ("tokens", "greatest"): F.max("__tokens")}

    def long(df: DataFrame, found: dict[tuple[str, str], Column]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(name).alias("name"), c.cast("double").alias("value")) for (s, name), c in found.items()])
        return df.select("whole", "__g", F.explode(rows).alias("x")).select("whole", F.col("__g").alias(by), "x.section", "x.name", "x.value")

    def both(df: DataFrame, found: dict[tuple[str, str], Column]) -> DataFrame:
        """Figures of each group and of the whole."""
        named = {k: f"__{i}" for i, k in enumerate(found)}
        counted = df.groupingSets([[F.col("__g")], []], F.col("__g")).agg((F.grouping("__g") == 1).alias("whole"), *[c.alias(named[k]) for k, c in found.items()])
        return long(counted, {k: F.col(v) for k, v in named.items()})

    per = docs.where(t.isNotNull()).select(F.col(f"`{by}`").alias("__g"), F.sha2(t, 256).alias("h"), F.col(f"`{source}`").alias("s")).groupBy("__g", "h", "s").agg(n.alias("n"))
    texts = per.groupingSets([[F.col("__g"), F.col("h")], [F.col("h")]], F.col("__g"), F.col("h")).agg((F.grouping("__g") == 1).alias("whole"), F.sum("n").alias("n"), F.count_distinct("s").alias("s")).groupBy("whole", "__g").agg(n.alias("different"), F.sum(F.col("n") - 1).alias("surplus"), F.count_if(F.col("s") > 1).alias("reused"))
    copies = long(texts, {("copies", c): F.col(c) for c in ("different", "surplus", "reused")})
    of = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l")).join(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{by}`").alias("__g")).distinct(), "k")
    one, zero = F.count_if(F.col("l") == 1), F.count_if(F.col("l") == 0)
    classes = both(of, {("label", "positive"): one, ("label", "negative"): zero, ("label", "invalid"): n - one - zero, ("label", "ratio"): F.try_divide(one, one + zero)})
    return both(measured, figures).unionByName(copies).unionByName(classes)


def speculation(rows: DataFrame, timings: str = "timings_ms") -> DataFrame:
    """Counters of work begun early: totals, reuse rate, coverage and rows that contradict themselves. timings: map<string,double>."""
    get = lambda name: F.try_element_at(F.col(timings), F.lit(name))
    launched, reused = get("speculative_launched"), get("speculative_reused")
    both = launched.isNotNull() & reused.isNotNull()
    binary = F.coalesce(launched.isin(0.0, 1.0) & reused.isin(0.0, 1.0), F.lit(False))
    found = rows.agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(launched), F.lit(0.0)).alias("launched"), F.coalesce(F.sum(reused), F.lit(0.0)).alias("reused"), F.count_if(both).alias("reported"),
        F.count_if(both & (reused > launched)).alias("inconsistent"), F.count_if((launched.isNotNull() | reused.isNotNull()) & ~binary).alias("invalid"), F.count_if(both & (launched == 1.0) & get("speculative_retrieval").isNull()).alias("without_duration"),
    )
    consistent = (F.col("inconsistent") == 0) & (F.col("invalid") == 0) & (F.col("reused") <= F.col("launched"))
    return found.select("*", F.coalesce(F.try_divide("reported", "requests"), F.lit(0.0)).alias("coverage"), F.try_divide("reused", "launched").alias("reuse_rate"), consistent.alias("consistent"), ((F.col("requests") > 0) & (F.col("reported") == F.col("requests")) & consistent & (F.col("without_duration") == 0)).alias("qualified"))


def transcripts(rows: DataFrame, *by: str) -> DataFrame:
    """Similarity of transcripts to what was expected. rows: similarity (or null), matches, exact."""
    n = F.count("*")
    return rows.groupBy(*by).agg(n.alias("rows"), F.count("similarity").alias("compared"), F.avg("similarity").alias("mean_similarity"), F.min("similarity").alias("least_similarity"), F.count_if("matches").alias("matches"), F.count_if("exact").alias("exact"), F.try_divide(F.count("similarity"), n).alias("coverage"))


def qualification(**checks: Column) -> Column:
    """struct<qualified, failed>: whether all named checks hold, and the first that doesn't; null counts as not."""
    failed = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return F.struct(failed.isNull().alias("qualified"), failed.alias("failed"))


def roll_up(names: DataFrame, reports: DataFrame, invalid: Column, qualifies: Column) -> DataFrame:
    """(name, status): missing, invalid, insufficient or qualifying for each wanted name. reports: name and what the Columns read."""
    joined = names.join(reports.withColumn("__there", F.lit(True)), "name", "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.coalesce(invalid, F.lit(True)), "invalid").when(qualifies, "qualifying").otherwise("insufficient")
    return joined.select("name", status.alias("status"))


def canonical(config: dict) -> str:
    return json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def manifest(chunks: DataFrame, config: dict, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row: chunks, different ids, bytes, a checksum that no order changes, and the fingerprint of the configuration."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct(key).alias("ids"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("checksum")).withColumn("config", F.sha2(F.lit(canonical(config)), 256))


def readiness(points: DataFrame, expected: int, dimension: int, vector: str, key: str) -> DataFrame:
    """One row: whether an index holds exactly what was built, all of one dimension, each key once."""
    found = points.agg(F.count("*").alias("points"), F.count_distinct(key).alias("keys"), F.count_if(F.size(vector) == dimension).alias("fitting"))
    n = F.lit(expected)
    status = F.when(F.col("points") == 0, "empty").when(F.col("fitting") != F.col("points"), "wrong_dimension").when(F.col("keys") != F.col("points"), "repeated_keys").when(F.col("points") != n, "incomplete").otherwise("ready")
    return found.withColumn("status", status)


def frozen(development: DataFrame, key: str, text: str, score: float, margin: float, agreement: float) -> DataFrame:
    """One row that binds thresholds to the queries they were found on: counts and fingerprints of ids and contents."""
    group = evaluate.content_group(F.col(text))
    rows = development.select(F.col(key).alias("id"), group.alias("content"))
    ids = evaluate.set_fingerprint(rows, "id").select(F.col("fingerprint").alias("ids"))
    contents = evaluate.set_fingerprint(rows, "content").select(F.col("n").alias("contents"), F.col("fingerprint").alias("content_hash"))
    one = rows.agg(F.count("*").alias("queries")).join(ids, F.lit(True)).join(contents, F.lit(True))
    return one.select("*", F.lit(score).alias("min_score"), F.lit(margin).alias("min_margin"), F.lit(agreement).alias("min_agreement"))


def differences(held: DataFrame, now: DataFrame) -> DataFrame:
    """One row (fault): the first field of two one-row tables that differs, null if none does. Nulls equal nulls."""
    names = held.columns
    both = held.select(F.struct(*names).alias("a")).join(now.select(F.struct(*names).alias("b")), F.lit(True))
    return both.select(F.coalesce(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in names]).alias("fault"))


def provenance(source: DataFrame, development: DataFrame, final: DataFrame, key: str, text: str, hashed: bool = False) -> DataFrame:
    """(check, passed): that a held-out set is held out. Contents are compared by their matching form.

    Each table is read twice. ``hashed``: as ``evaluate.group_split`` takes it.
    """
    content = F.col(text) if hashed else evaluate.content_group(F.col(text))
    tag = lambda df, d, f, s: df.select(F.col(key).alias("id"), content.alias("content"), F.lit(d).alias("d"), F.lit(f).alias("f"), F.lit(s).alias("s"))
    rows = tag(development, 1, 0, 0).unionByName(tag(final, 0, 1, 0)).unionByName(tag(source, 0, 0, 1))
    sums = [F.sum(c).alias(c) for c in "dfs"]
    ids = rows.groupBy("id").agg(*sums).agg(F.count_if(F.expr("d > 0 and f > 0")).alias("shared_ids"), F.count_if(F.expr("(d + f > 0) <> (s > 0)")).alias("uncovered"), F.count_if(F.expr("d > 1 or f > 1")).alias("repeated"), F.sum("d").alias("dn"), F.sum("f").alias("fn"))
    contents = rows.groupBy("content").agg(*sums).agg(F.count_if(F.expr("d > 0 and f > 0")).alias("shared_contents"))
    checks = {"development_not_empty": "dn > 0", "final_not_empty": "fn > 0", "ids_disjoint": "shared_ids = 0", "contents_disjoint": "shared_contents = 0", "source_covered": "uncovered = 0", "ids_unique": "repeated = 0"}
    one = ids.join(contents, F.lit(True)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.expr(c), F.lit(False)).alias("passed")) for n, c in checks.items()])).alias("c"))
    return one.select("c.*")


def guardrail_cases(cases: DataFrame) -> DataFrame:
    """``cases`` with observed: the reason of the first gate that stops a case, or allow.

    cases: kind, and what its gate reads: query, confidence, size and duration_ms and rms (audio), top, margin and n
    (scores), agreement.
    """
    stats = F.struct(F.col("duration_ms"), F.col("rms"))
    by_kind = (
        F.when(F.col("kind") == "query", F.coalesce(gates.injection(F.col("query")), gates.unsafe(F.col("query")), gates.stale(F.col("query"))))
        .when(F.col("kind") == "confidence", gates.low_confidence(F.col("confidence")))
        .when(F.col("kind") == "audio", gates.audio(F.col("size"), stats))
        .when(F.col("kind") == "scores", gates.answerability(F.col("top"), F.col("margin"), F.col("n")))
        .when(F.col("kind") == "agreement", gates.disagreement(F.col("agreement")))
    )
    return cases.withColumn("observed", F.coalesce(by_kind, F.lit("allow")))


def guardrail_report(cases: DataFrame, least: int) -> DataFrame:
    """(kind, cases, right, accuracy, qualified): each kind needs ``least`` cases, all judged as expected."""
    found = guardrail_cases(cases).groupBy("kind").agg(F.count("*").alias("cases"), F.count_if(F.col("expected") == F.col("observed")).alias("right"))
    return found.select("*", (F.col("right") / F.col("cases")).alias("accuracy"), ((F.col("cases") >= least) & (F.col("right") == F.col("cases"))).alias("qualified"))
