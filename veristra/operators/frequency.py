"""Document frequencies as a state that batches of documents are added to and taken out of, saved under a version."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.config import SETTINGS
from veristra.operators import retrieve
from veristra.sources.publish import Folder

VERSION = 1
NGRAMS = {"kind": "characters", "low": SETTINGS.ngram_low, "high": SETTINGS.ngram_high}


@dataclass(frozen=True)
class State:
    """(<feature>, df) of so many documents, and how features were made; only states made alike can be put together."""

    frequency: DataFrame
    documents: int
    settings: dict = field(default_factory=lambda: NGRAMS)
    feature: str = "feature"


def count(found: DataFrame, documents: int, key: str = "id", feature: str = "feature", settings: dict = NGRAMS) -> State:
    """State of (<key>, <feature>, ...) with a row a feature of a document; documents also counts those without features."""
    pairs = found.where(F.col(key).isNotNull() & F.col(feature).isNotNull()).select(key, feature).distinct()
    return State(pairs.groupBy(feature).agg(F.count("*").alias("df")), documents, settings, feature)


def of_texts(texts: DataFrame, key: str = "id", text: str = "form") -> State:
    """State of the n-grams of (<key>, <text>), as ``count`` of their features, where no key comes twice."""
    return State(retrieve.text_frequency(texts, key, text), texts.count())


def fold(state: State, batch: State, sign: int = 1) -> State:
    """``state`` with a batch's documents added (1) or taken out (-1).

    Features that no document has any more disappear. Taking out what isn't there fails: of documents at once, of
    features when the result is computed.
    """
    if sign not in (1, -1):
        raise ValueError("documents are added (1) or taken out (-1)")
    if (state.settings, state.feature) != (batch.settings, batch.feature):
        raise ValueError(f"features were made differently: {state.settings} and {batch.settings}")
    documents = state.documents + sign * batch.documents
    if documents < 0:
        raise ValueError("more documents are taken out than the state holds")
    name = state.feature
    both = state.frequency.select(name, "df").unionByName(batch.frequency.select(name, (sign * F.col("df")).alias("df")))
    summed = both.groupBy(name).agg(F.sum("df").alias("df"))
    sound = F.when((F.col("df") < 0) | (F.col("df") > documents), F.raise_error(F.concat(F.lit("the state doesn't hold what is taken out: "), F.col(name).cast("string")))).otherwise(F.col("df"))
    return State(summed.select(name, sound.cast("long").alias("df")).where("df > 0"), documents, state.settings, name)


def _checked(frequency: DataFrame, name: str) -> tuple[int, str]:
    """Features and a checksum that no order changes."""
    n, total = frequency.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(name, "df").cast("decimal(38,0)")), F.lit(0))).first()
    return n, hashlib.sha256(f"{n}:{total}".encode()).hexdigest()


def save(state: State, root: str) -> str:
    """Write a new version beside the old ones and point to it last; returns its name."""
    spark = state.frequency.sparkSession
    folder, version = Folder(spark, root), uuid.uuid4().hex
    path = folder.path(f"versions/{version}")
    state.frequency.select(state.feature, F.col("df").cast("long").alias("df")).write.parquet(path)
    features, total = _checked(spark.read.parquet(path), state.feature)
    header = {"version": VERSION, "documents": state.documents, "settings": state.settings, "feature": state.feature, "features": features, "checksum": total, "table": version}
    folder.replace_json("current", header)
    return version


def load(spark: SparkSession, root: str, settings: dict = NGRAMS) -> State:
    """The saved state; another version, other settings or a table that isn't what was saved are refused."""
    header = Folder(spark, root).read_json("current")
    if header is None:
        raise FileNotFoundError(f"no state was saved in {root}")
    if header.get("version") != VERSION:
        raise ValueError(f"state of version {header.get('version')}, {VERSION} is read")
    if header["settings"] != json.loads(json.dumps(settings)):
        raise ValueError(f"the state's features were made by {header['settings']}")
    frequency = spark.read.parquet(f"{root}/versions/{header['table']}")
    if _checked(frequency, header["feature"]) != (header["features"], header["checksum"]):
        raise ValueError("the state's table was changed after it was saved")
    return State(frequency, header["documents"], header["settings"], header["feature"])
