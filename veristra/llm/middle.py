"""Fill-in-the-middle: a text is cut at two of its units' ends, and its parts are put into another order behind signs.

The ``Split`` pre-tokenizer of the ``tokenizers`` library, which needs no training, isolates the matches of a unit
pattern and gives their offsets in code points. Their number is n; two ranks drawn from a hash of the document's key
choose the two ends. Python workers see a text once and return three numbers; slices and signs are Spark's own work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a line with its end, or what follows the last one. No match of a unit pattern may go past a line end.
LINE = "[^\\n]*\\n|[^\\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that the pre-tokenizer sees at once, up to the next line end: its offsets are Python objects.
STEP = 1 << 18


@cache
def isolating(pattern: str) -> object:
    """One pre-tokenizer a worker and pattern."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), "isolated")


def unit_ends(text: str, pattern: str = LINE, step: int = STEP) -> np.ndarray:
    """Where the units of a text end, in code points."""
    split, found, low = isolating(pattern), [], 0
    while low < len(text):
        high = text.find("\n", low + step) + 1 or len(text)
        got = split.pre_tokenize_str(text[low:high])
        found.append(np.fromiter((end for _, (_, end) in got), np.int64, len(got)) + low)
        low = high
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def unit_cuts(text: Column, one: Column, two: Column, pattern: str = LINE) -> Column:
    """(n, first, second): the number of units and the ends, in code points, after one % (n + 1) and two % (n + 1) units, the smaller first."""

    @F.arrow_udf("n long, first long, second long")
    def cuts(texts: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), np.int64)
        for i, (t, a, b) in enumerate(zip(texts, ones.to_pylist(), twos.to_pylist(), strict=True)):
            ends = np.concatenate(([0], unit_ends(t.as_py(), pattern)))
            first, second = sorted((a % len(ends), b % len(ends)))
            out[:, i] = len(ends) - 1, ends[first], ends[second]
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "first", "second"])

    return cuts(text, one, two)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from SHA-256 of the seed, a colon and the key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, unit: str = LINE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row a document.

    rate and suffix_first are shares in percent: of texts that are cut, and of form ``spm`` among these. A text that is
    empty or holds one of the signs stays as it is (``plain``, without lengths), so ``restored`` can always undo the
    rest. A null text counts as empty, a null key as an empty one; repeated rows come out alike, other columns are
    dropped, an empty table gives no rows. Cuts depend on key and seed alone.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    drawn = docs.select(F.col(f"`{key}`").alias("doc_id"), whole.alias("text"), F.array(*draws(F.col(f"`{key}`"), seed)).alias("h"))
    cut = drawn.withColumn("cut", unit_cuts(F.col("text"), F.col("h")[0], F.col("h")[1], unit))
    t, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    signed = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | signed | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    shaped = cut.withColumn("form", form)
    part = lambda low, high: F.substr(t, (low + 1).cast("int"), (high - low).cast("int"))
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), F.substr(t, (second + 1).cast("int"))
    moved: Callable[..., Column] = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", moved(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)).otherwise(moved(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    moves = F.col("form") != "plain"
    return shaped.select("doc_id", F.col("cut.n").alias("n"), "form", F.when(moves, first).alias("prefix_chars"), F.when(moves, second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone.

    The text holds none of the signs and a sign starts with a character that it holds only once, so the signs in the
    output are exactly those that were put there.
    """
    between = lambda low, high: F.substring_index(F.substring_index(output, high, 1), low, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
