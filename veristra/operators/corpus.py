"""From source rows to a corpus: candidates, canonical ids, deduplication, leak checks and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veristra.checkpoints import FEW, cut_lineage
from veristra.config import SETTINGS
from veristra.functions import text as X

# Keys of evaluation data, and the fields of a document's payload.
EVALUATION_KEYS = "answer answers answer_references eng_answer english_answer_references is_selected label labels relevant_canonical_ids relevant_ids split".split()
PAYLOAD = "canonical_doc_id parent_id english_text translated_text translation_language translation_model".split()


def three_valued(label: Column) -> Column:
    """Null stays null; numbers and booleans are true if not 0 (NaN too), text for 1, true or yes alone."""
    word = F.lower(F.trim(label.cast("string")))
    number = word.try_cast("double")
    return F.when(label.isNull(), F.lit(None).cast("boolean")).when(F.typeof(label) == "string", word.isin("1", "true", "yes")).when(F.typeof(label) == "boolean", word == "true").otherwise(number != 0)


def candidates(rows: DataFrame) -> DataFrame:
    """One row a passage of nested source rows: query_id, position, english, translated, is_selected. Empty passages go.

    Parallel lists must be of equal length; a row in which they aren't raises.
    """
    p = F.col("passages")
    same = (F.size(p["English_passages"]) == F.size(p["is_selected"])) & (p["Translated_passages"].isNull() | (F.size(p["Translated_passages"]) == F.size(p["English_passages"])))
    checked = F.when(same, F.arrays_zip(p["English_passages"].alias("english"), p["Translated_passages"].alias("translated"), p["is_selected"].alias("selected"))).otherwise(F.raise_error(F.lit("passage lists differ in length")))
    each = rows.select("query_id", F.posexplode(checked).alias("position", "c"))
    clean = each.select("query_id", "position", X.normalized(F.col("c.english")).alias("english"), F.nullif(X.normalized(F.col("c.translated")), F.lit("")).alias("translated"), three_valued(F.col("c.selected")).alias("is_selected"))
    return clean.where("english <> ''")


def documents(found: DataFrame) -> DataFrame:
    """Payload of each candidate; the canonical id is its own parent."""
    ident = F.sha2("english", 256)
    return found.select(ident.alias("canonical_doc_id"), ident.alias("parent_id"), F.col("english").alias("english_text"), F.col("translated").alias("translated_text"))


def fixtures(found: DataFrame) -> DataFrame:
    """(query_id, relevant_ids): the selected passages of each query, in order, each once."""
    wanted = found.where("is_selected").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.sha2("english", 256).alias("id")))).alias("x"))
    return wanted.select("query_id", F.array_distinct(F.transform("x", lambda v: v["id"])).alias("relevant_ids"))


def first_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key. Uses a struct minimum, which combines before the shuffle, so a hot key costs little."""
    names = df.columns
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*names), at).alias("row")).select("row.*")


def without_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def prohibited_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of evaluation keys at any depth of a schema."""
    out = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        if f.name.lower() in EVALUATION_KEYS:
            out.append(path)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += prohibited_paths(kind, f"{path}.")
    return out


def shuffled_order(key: Column, seed: int = SETTINGS.seed) -> Column:
    """A replayable random order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def until_target(rows: DataFrame, group: str, ident: str, target: int, seed: int = SETTINGS.seed) -> DataFrame:
    """Whole groups in shuffled order until ``target`` different ids are reached; the group that crosses it is kept.

    A group's order is its hash, so each id belongs to the first group that has it. Counts of new ids a group are
    summed over 4096 hash ranges first; only groups of the range in which the target falls are put in order.
    """
    placed = rows.withColumn("__o", shuffled_order(F.col(group), seed))
    firsts = placed.groupBy(ident).agg(F.min("__o").alias("__o")).groupBy("__o").agg(F.count("*").alias("new"))
    range_ = F.substring("__o", 1, 3)
    sums = sorted((r[0], r[1]) for r in firsts.groupBy(range_.alias("r")).agg(F.sum("new")).collect())
    total, at = 0, None
    for name, n in sums:
        if total + n >= target:
            at = name
            break
        total += n
    if at is None:
        return placed.drop("__o")
    inside = firsts.where(range_ == at).withColumn("before", F.sum("new").over(W.orderBy("__o")) - F.col("new"))
    last = inside.where(F.col("before") + total < target).agg(F.max("__o")).first()[0]
    return placed.where(F.col("__o") <= F.lit(last)).drop("__o")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


#: Passages without three words of their own that are looked for in every text: a broadcast list of at most so many.
MOST_SHORT = 10_000


def contained(docs: DataFrame, key: str, passages: DataFrame, item: str) -> DataFrame:
    """(key, item) of documents (key, text) that hold a passage (item, passage) as a substring.

    Candidates share one pair of neighbouring words with the passage, found by an equi-join. Of a passage's inner pairs
    (its first and last word may be parts of longer ones) the rarest among the documents is the key, so common pairs
    make no hot key. Passages without an inner pair are looked for in every text: they are counted, broadcast up to
    MOST_SHORT, and an error beyond. Empty passages and nulls are found nowhere.
    """
    words = F.split("text", " ")
    pairs = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    asked = passages.where("passage <> ''").withColumn("inner", F.array_distinct(F.array_compact(pairs(F.slice(F.split("passage", " "), 2, F.greatest(F.lit(0), F.size(F.split("passage", " ")) - 2))))))
    keys = asked.select(item, F.explode("inner").alias("pair"))
    wanted = cut_lineage(keys.select("pair").distinct())
    if wanted.limit(FEW + 1).count() <= FEW:
        wanted = F.broadcast(wanted)
    # pairs that no passage has are left where they are; the others are counted before they are joined
    spread = docs.select(key, F.explode(F.array_distinct(F.array_compact(pairs(words)))).alias("pair")).join(wanted, "pair", "left_semi")
    seen = spread.groupBy("pair").agg(F.count("*").alias("n"))
    rarest = keys.join(seen, "pair").groupBy(item).agg(F.min_by("pair", F.struct("n", "pair")).alias("pair"), F.count("*").alias("known")).join(asked.select(item, F.size("inner").alias("inner")), item).where(F.col("known") == F.col("inner"))
    found = spread.join(rarest.select(item, "pair"), "pair").select(key, item).distinct()
    both = found.join(docs.select(key, "text"), key).join(asked.select(item, "passage"), item)
    long_ = both.where(F.col("text").contains(F.col("passage"))).select(key, item)
    short = asked.where(F.size("inner") == 0).select(item, "passage")
    n = short.limit(MOST_SHORT + 1).count()
    if n > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} passages of under four words")
    return long_.unionByName(docs.join(F.broadcast(short), F.col("text").contains(F.col("passage"))).select(key, item)) if n else long_
