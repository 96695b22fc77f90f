"""Records as they come in: field names, typed fields, checks with reasons, catalogues and partitions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.checkpoints import cut_lineage
from veristra.functions import text as X

# Which query field a preference reads first, and openings that say nothing.
QUERY_FIELDS = {"translated_query": ("translated_query",), "english_query": ("english_query", "query"), "query": ("query", "english_query")}
HINDI_FIELDS = ("translated_query", "english_query", "query")
OTHER_FIELDS = ("english_query", "query", "translated_query")
OPENING = "(?iu)^(?:according to (?:the )?(?:information|available information|provided information) (?:i|we) have,?\\s*|based on (?:the )?(?:information|available information|provided information) (?:i|we) have,?\\s*|in the provided information,?\\s*)"


def resolve(df: DataFrame, *names: str) -> Column:
    """The first of ``names`` that ``df`` has, whatever its case; null if it has none. Settled by the schema, without data."""
    held = {c.lower(): c for c in reversed(df.columns)}
    for name in names:
        if name.lower() in held:
            return F.col(f"`{held[name.lower()]}`")
    return F.lit(None)


def prefix(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that the data gives, so the same ones each time."""
    return df.orderBy(*order).limit(n)


def text_field(value: Column) -> Column:
    """Trimmed text, or null if there is none: a required text is missing then."""
    return F.nullif(F.trim(F.regexp_replace(value, f"^{X.SPACE}|{X.SPACE}$", "")), F.lit(""))


def number_field(value: Column, low: float, high: float) -> Column:
    """struct<value, fault>: missing, not_a_number or out_of_range, or the number."""
    number = value.cast("string").try_cast("double")
    fault = F.when(value.isNull(), "missing").when(number.isNull() | F.isnan(number), "not_a_number").when(~number.between(low, high), "out_of_range")
    return F.struct(F.when(fault.isNull(), number).alias("value"), fault.alias("fault"))


def boolean_field(value: Column) -> Column:
    """True or false for these words alone; anything else is missing."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word == "true", True).when(word == "false", False)


def search_fault(query: Column, limit: Column) -> Column:
    return F.when(F.coalesce(limit, F.lit(0)) <= 0, "limit").when(text_field(query).isNull(), "query")


def chosen_query(records: DataFrame, preferred: str = "auto") -> DataFrame:
    """``records`` with query_text and query_field: the first of the fields that has text, and its name.

    auto: by the column language; Hindi reads the translation first.
    """

    def first(fields: tuple[str, ...]) -> Column:
        have = [f for f in fields if f in records.columns]
        return F.coalesce(*[F.when(text_field(F.col(f)).isNotNull(), F.struct(text_field(F.col(f)).alias("t"), F.lit(f).alias("f"))) for f in have])

    if preferred == "auto":
        language = F.lower(F.trim(F.coalesce("language", F.lit(""))))
        found = F.when((language == "hi") | language.startswith("hi-") | (language == "hindi"), first(HINDI_FIELDS)).otherwise(first(OTHER_FIELDS))
    else:
        found = first(QUERY_FIELDS[preferred])
    return records.withColumn("__q", found).select(*records.columns, F.col("__q.t").alias("query_text"), F.col("__q.f").alias("query_field"))


def corpus_faults(rows: DataFrame, key: str, text: str, allowed: tuple[str, ...], forbidden: tuple[str, ...]) -> DataFrame:
    """(key, faults): sorted names of what is wrong with each row: no key, no text, a repeated key, fields of evaluation data
    or fields that aren't allowed and hold a value. Keys are counted before they are joined back, so a hot one costs little."""
    counted = rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__k"), F.lit(True).alias("__twice"))
    checks = {"no_key": F.col(key).isNull(), "no_text": text_field(F.col(text)).isNull(), "repeated_key": F.col("__twice").isNotNull()}
    checks |= {f"evaluation_field:{c}": F.col(c).isNotNull() for c in rows.columns if c.lower() in forbidden}
    checks |= {f"unknown_field:{c}": F.col(c).isNotNull() for c in rows.columns if c not in allowed and c.lower() not in forbidden}
    marked = rows.join(counted, rows[key] == counted["__k"], "left")
    return marked.select(key, F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("faults"))


def leaks(rows: DataFrame, key: str, forbidden: tuple[str, ...]) -> DataFrame:
    """(<key>, path, field): every field of a forbidden name (without case) at any depth of a row.

    Looks into structs, maps (by key), arrays, variants, and text that is a JSON object or array, in which more of the
    same may lie. Columns and fields of structs count if they hold a value, keys of maps and of JSON always. Text that
    begins like JSON and isn't valid is searched for quoted names followed by a colon; their path ends in ``~``. Paths
    are as in ``a.b[0].c``. A row without key comes with a null; repeated rows are told as often as they occur. Each
    level is one pass over the values that have something below them.
    """
    spark, names = rows.sparkSession, [f.lower() for f in forbidden]
    nothing = "__k string, path string, field string"
    node = F.parse_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    level = rows.select(F.col(f"`{key}`").cast("string").alias("__k"), F.lit("").alias("path"), node.alias("node"))
    found = [spark.createDataFrame([], nothing)]
    while True:
        children = spark.sql("SELECT __k, path, t.pos AS pos, t.key AS name, t.value AS value FROM {level}, LATERAL variant_explode(node) AS t", level=level)
        step = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name"))
        kind = F.schema_of_variant("value")
        text = F.when(kind == "STRING", F.ltrim(F.variant_get("value", "$", "string")))
        like = F.coalesce(text.startswith("{") | text.startswith("["), F.lit(False))
        below = F.when(like, F.try_parse_json(text)).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.col("value"))
        seen = cut_lineage(children.select("__k", step.alias("path"), "name", below.alias("node"), F.when(like & F.try_parse_json(text).isNull(), text).alias("broken")).where(F.col("node").isNotNull() | F.lower("name").isin(names) | F.col("broken").isNotNull()))
        found.append(seen.where(F.lower("name").isin(names)).select("__k", "path", F.lower("name").alias("field")))
        quoted = F.transform(F.regexp_extract_all("broken", F.lit('"([^"\\\\]*)\\\\*"\\s*:'), 1), F.lower)
        found.append(seen.where("broken IS NOT NULL").select("__k", F.concat("path", F.lit("~")).alias("path"), F.explode(F.array_intersect(quoted, F.array(*[F.lit(n) for n in names]))).alias("field")))
        level = seen.where("node IS NOT NULL").select("__k", "path", "node")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).withColumnRenamed("__k", key)


def payload(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Only these fields, in this order; a field that the rows lack is null."""
    return rows.select(*[resolve(rows, f).alias(f) for f in fields])


def catalogue(rows: DataFrame, header: tuple[str, ...], number: str, group: str) -> DataFrame:
    """(group, n, low, high, contiguous, header_ok): rows of each group of a numbered catalogue, and of all (group null)."""
    contiguous = (F.max(number) - F.min(number) + 1 == F.count_distinct(number)) & (F.count_distinct(number) == F.count("*"))
    found = rows.groupingSets([[F.col(group)], []], F.col(group)).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), contiguous.alias("contiguous"))
    return found.withColumn("header_ok", F.lit(tuple(rows.columns) == header))


@dataclass(frozen=True)
class Rules:
    """What a strict catalogue demands: texts that aren't blank, whole numbers from 1, values of a list, fields (or several together) that don't repeat, and numbers that leave no gap."""

    texts: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    values: tuple[tuple[str, tuple[str, ...]], ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    contiguous: tuple[str, ...] = ()


def catalogue_faults(rows: DataFrame, key: str, rules: Rules) -> DataFrame:
    """(<key>, fault): what breaks the rules, a row each: missing, number, value or repeated and the field, ``gap`` without key.

    Every row of a repeated value is told; nulls repeat nothing. Numbers may be text. A field without gaps has each number
    from 1 to its greatest; no rows have none. An empty table has no faults.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    # more digits may not fit into a long
    number = lambda c: F.when(F.trim(text(c)).rlike("^[0-9]{1,18}$"), F.trim(text(c)).cast("long"))
    broken = (
        [F.when(F.coalesce(F.trim(text(c)), F.lit("")) == "", f"missing:{c}") for c in rules.texts]
        + [F.when(F.coalesce(number(c), F.lit(0)) < 1, f"number:{c}") for c in rules.numbers]
        + [F.when(~F.coalesce(text(c).isin(*known), F.lit(False)), f"value:{c}") for c, known in rules.values]
    )
    found = rows.select(F.col(f"`{key}`").alias("__k"), F.explode(F.array_compact(F.array(*broken, F.lit(None).cast("string")))).alias("fault"))
    for fields in rules.unique:
        names = [f"__{i}" for i in range(len(fields))]
        values = rows.select(F.col(f"`{key}`").alias("__k"), *[F.col(f"`{f}`").alias(n) for f, n in zip(fields, names, strict=True)]).dropna(subset=names)
        twice = values.groupBy(*names).agg(F.count("*").alias("__n")).where("__n > 1")
        found = found.unionByName(values.join(twice, names, "left_semi").select("__k", F.lit("repeated:" + "+".join(fields)).alias("fault")))
    for c in rules.contiguous:
        whole = rows.select(number(c).alias("v")).agg(F.max("v").alias("high"), F.count_distinct(F.when(F.col("v") > 0, F.col("v"))).alias("n")).where("high <> n")
        found = found.unionByName(whole.select(F.lit(None).cast(rows.schema[key].dataType).alias("__k"), F.lit(f"gap:{c}").alias("fault")))
    return found.withColumnRenamed("__k", key)


def covers(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One row (whole, parts, covered, disjoint): whether the parts hold all keys of the whole, no others, and none twice."""
    tagged = whole.select(key).distinct().select(F.col(key).alias("k"), F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts:
        tagged = tagged.unionByName(part.select(key).distinct().select(F.col(key).alias("k"), F.lit(0).alias("w"), F.lit(1).alias("p")))
    per = tagged.groupBy("k").agg(F.sum("w").alias("w"), F.sum("p").alias("p"))
    return per.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("whole"), F.coalesce(F.sum("p"), F.lit(0)).alias("parts"), F.coalesce(F.bool_and((F.col("w") > 0) == (F.col("p") > 0)), F.lit(True)).alias("covered"), F.coalesce(F.bool_and(F.col("p") <= 1), F.lit(True)).alias("disjoint"))


def utc_time(value: Column) -> Column:
    """The time of a text that says an offset of zero; null for any other."""
    said = value.rlike("^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(?:\\.\\d{1,9})?(?:Z|[+-]00:?00)$")
    return F.when(said, value.try_cast("timestamp"))


def milliseconds(start_ns: Column, end_ns: Column) -> Column:
    """Elapsed milliseconds, never negative."""
    return F.greatest(F.lit(0.0), (end_ns - start_ns) / 1_000_000)


def claim_tokens(text: Column) -> Column:
    """Words of a claim, folded, with openings that say nothing taken off each sentence."""
    pieces = F.filter(F.transform(F.split(text, "[.!?।॥;\n]+"), lambda s: F.trim(F.regexp_replace(s, f"^{X.SPACE}|{X.SPACE}$", ""))), lambda s: s != "")
    merged = X.fold(F.array_join(F.transform(pieces, lambda s: F.regexp_replace(s, OPENING, "")), " "))
    return F.array_join(F.regexp_extract_all(merged, F.lit("[\\p{L}\\p{N}_]+"), 0), " ")


def history(rows: DataFrame, by: str, request: str, order: list[Column], n: int = 10) -> DataFrame:
    """The newest row of each request, then the n newest of each ``by`` with their place."""
    once = rows.withColumn("__n", F.row_number().over(W.partitionBy(by, request).orderBy(*order))).where("__n = 1").drop("__n")
    return once.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)
