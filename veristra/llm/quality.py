"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good or bad on a document, or abstains. Expectation-maximisation treats the true quality as hidden:
for either class each rule has its own rates of the three, and the classes have shares. What a rule is worth, also
whether its silence tells anything, follows from how it agrees with the others; no rule's rates are set by hand. As
agreement is all there is to learn from, each kind of junk is seen by rules from several sides: junk of signs by the
share of signs from a list, of all signs, and of words that end in one. The fit runs on the counts of vote patterns, of
which there are at most 3 ** len(RULES) whatever the input, so the driver sees a bounded table while the counts cover every
document. The posterior of being good then is a logistic of a sum of literals, one a rule and vote, and
replaces the demand that all rules pass: a lone bad vote of a careless rule is outvoted, and documents that many
rules are doubtful about can go without any bad vote.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.functions.text import let
from veristra.llm.common import WHITE, WORD, cut_lineage, fresh

WINDOW = 8
#: A character of a word that is no letter, mark or digit.
SIGN = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{WHITE}]"
LEAST_WORDS = 20
MOST_REPEATED = 30
THRESHOLD = 0.5
ROUNDS = 100
#: Each rule's votes of either class start with so many of each kind, so that no rate is 0.
SMOOTH = 1.0
#: Where the fit starts: how likely a document with no, one, and more bad votes is bad.
START = (0.02, 0.3, 0.95)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims", "n_stutters", "n_signs", "n_tails", "n_distinct"]


def _repeated_words(ws: Column) -> Column:
    """Words in windows of 8 words that occur twice or more in the text. Windows are compared by 64-bit hash."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
            near = F.arrays_zip(s.alias("s"), F.concat(none, s).alias("p"), F.concat(F.slice(s, 2, F.size(s)), none).alias("n"))
            same = F.filter(near, lambda x: x["s"].isNotNull() & (x["s"]["h"].eqNullSafe(x["p"]["h"]) | x["s"]["h"].eqNullSafe(x["n"]["h"])))
            return F.array_sort(F.transform(same, lambda x: x["s"]["i"]))

        def length(p: Column) -> Column:
            steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return let(placed, lambda s: let(starts(s), length))

    # hashes of 1, 2, 4 and 8 words, each from two of half the length; those that run over the end are cut off
    double = lambda h, n: F.zip_with(h, F.slice(h, n + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    single = F.transform(ws, lambda w: F.xxhash64(w))
    of_eight = let(single, lambda h: let(double(h, 1), lambda h: let(double(h, 2), lambda h: double(h, 4))))
    windows = F.slice(of_eight, 1, F.size(ws) - (WINDOW - 1))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(ws) > WINDOW, found).otherwise(F.lit(0))


def measures_of(text: str) -> Column:
    """Struct of MEASURES of a text column. A null text has none of anything.

    n_symbols: characters of the list. n_lines: lines with a word. n_stutters: words equal to the word before.
    n_signs: characters in words that are no letters, marks or digits. n_tails: words that end in one. n_distinct: different words.
    """
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(content, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(WORD))
    ws = F.array_remove(F.split(content, f"[{WHITE}]+"), "")

    def of_words(ws: Column) -> Column:
        next_to = F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: a == b)
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeated_words(ws).cast("long").alias("n_repeat_words"),
            F.when(F.size(ws) > 1, F.size(F.filter(next_to, lambda x: x))).otherwise(0).cast("long").alias("n_stutters"), F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
        )

    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    signs = {"n_symbols": count("[#*$%&|<>]"), "n_capitals": count("[A-Z]"), "n_exclaims": count("!"), "n_signs": count(SIGN), "n_tails": count(f"{SIGN}(?=[{WHITE}]|\\z)")}
    parts = F.struct(let(ws, of_words).alias("a"), of_lines.alias("b"), *[v.alias(k) for k, v in signs.items()])
    place = {m: "a" for m in ("n_words", "word_chars", "n_repeat_words", "n_stutters", "n_distinct")} | {"n_lines": "b", "n_dup_lines": "b"}
    return let(parts, lambda p: F.struct(*[(p[place[m]][m] if m in place else p[m]).alias(m) for m in MEASURES]))


def votes(of: Column) -> dict[str, Column]:
    """-1 (bad), 1 (good) or, to abstain, 0 of each rule, over a struct of measures. Texts without words: all but one abstain."""
    m = {x: of[x] for x in MEASURES}
    n, some = m["n_words"], m["n_words"] > 0
    vote = lambda bad, good, when=some: F.when(when & bad, -1).when(when & good, 1).otherwise(0)
    share = lambda x, by, bad, good: vote(m[x] > bad * m[by], m[x] <= good * m[by])
    return {
        "length": vote(n < 10, n >= 50, F.lit(True)),
        "symbols": share("n_symbols", "n_words", 0.1, 0.02),
        "signs": share("n_signs", "word_chars", 0.1, 0.08),
        "tails": share("n_tails", "n_words", 0.4, 0.3),
        "capitals": share("n_capitals", "word_chars", 0.5, 0.2),
        "exclaims": share("n_exclaims", "n_words", 0.2, 0.05),
        "stutters": share("n_stutters", "n_words", 0.2, 0.05),
        "windows": share("n_repeat_words", "n_words", 0.3, 0.1),
        "variety": vote(m["n_distinct"] < 2 * F.sqrt(n), m["n_distinct"] >= 3 * F.sqrt(n), n >= 20),
        "lines": vote(m["n_dup_lines"] > 0.3 * m["n_lines"], m["n_dup_lines"] <= 0.1 * m["n_lines"], m["n_lines"] > 1),
    }


RULES = ("length", "symbols", "signs", "tails", "capitals", "exclaims", "stutters", "windows", "variety", "lines")


@dataclass(frozen=True)
class LabelModel:
    """Share of bad documents, and each rule's log odds of bad against good for a vote of -1, 0 and 1."""

    bad: float
    odds: dict[str, tuple[float, float, float]]

    def posterior(self, of: Column) -> Column:
        """Probability that a document of these measures is good."""
        total = F.lit(math.log(self.bad / (1 - self.bad)))
        for name, vote in votes(of).items():
            against, silent, for_ = self.odds[name]
            total = total + F.when(vote == -1, against).when(vote == 1, for_).otherwise(silent)
        return 1 / (1 + F.exp(total))


def patterns(of: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in votes(of).items()])


def maximise(cases: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns (-1, 0 or 1 a rule) and their counts; none give a model that knows nothing."""
    total = sum(n for _, n in cases)
    belief = [START[min(2, sum(x == -1 for x in v))] for v, _ in cases]
    bad, odds = 0.5, {name: (0.0, 0.0, 0.0) for name in RULES}
    for _ in range(rounds if cases else 0):
        weight = [(n * q, n * (1 - q)) for (_, n), q in zip(cases, belief, strict=True)]
        sums = [sum(w[side] for w in weight) for side in (0, 1)]
        bad = (sums[0] + SMOOTH) / (total + 2 * SMOOTH)
        for j, name in enumerate(RULES):
            rates = []
            for side in (0, 1):
                seen = {-1: SMOOTH, 0: SMOOTH, 1: SMOOTH}
                for (v, _), w in zip(cases, weight, strict=True):
                    seen[v[j]] += w[side]
                rates.append([seen[x] / (sums[side] + 3 * SMOOTH) for x in (-1, 0, 1)])
            odds[name] = tuple(math.log(b / g) for b, g in zip(*rates, strict=True))
        start = math.log(bad / (1 - bad))
        margins = [start + sum(odds[name][x + 1] for name, x in zip(RULES, v, strict=True)) for v, _ in cases]
        belief = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in margins]
    return LabelModel(bad, dict(odds))


def fit(voted: DataFrame) -> LabelModel:
    """The label model of a column ``votes`` of patterns."""
    counted = voted.groupBy("votes").count().collect()
    return maximise(sorted((tuple(r["votes"][x] for x in RULES), r["count"]) for r in counted))


def verdict(of: Column, model: LabelModel, threshold: float = THRESHOLD) -> Column:
    """struct<quality, base_failed, kept>: the posterior, whether the base rules fail, and what follows."""
    failed = (of["n_words"] < LEAST_WORDS) | (100 * of["n_repeat_words"] > MOST_REPEATED * of["n_words"])
    quality = model.posterior(of)
    return F.struct(quality.alias("quality"), failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"))


def score_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less its text, with measures, quality, base_failed and kept. Texts are read once.

    Columns of ``docs`` with one of these names are replaced. A null or empty text has no words and fails the base;
    repeated rows are judged alike and count as often. An empty table gives no rows.
    """
    new = ("measures", "quality", "base_failed", "kept")
    kept = [c for c in docs.columns if c.lower() != text.lower() and c.lower() not in new]
    measured = cut_lineage(docs.select(*[F.col(f"`{c}`") for c in kept], measures_of(text).alias("measures")))
    model = fit(measured.select(patterns(F.col("measures")).alias("votes")))
    (found,) = fresh(measured, "found")
    judged = measured.withColumn(found, verdict(F.col("measures"), model))
    return judged.select(*[F.col(f"`{c}`") for c in measured.columns], f"{found}.*")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; null and empty texts go, repeated rows share their fate.

    Texts are measured once to fit and once to filter, and never shuffled or stored. Votes and verdict are bound to
    one evaluation of the measures.
    """
    model = fit(docs.select(let(measures_of(text), patterns).alias("votes")))
    return docs.where(let(measures_of(text), lambda m: verdict(m, model)["kept"]))
