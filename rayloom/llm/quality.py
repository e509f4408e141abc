"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a column expression over the whole text; no user function runs. A rule is a
row of `RULES`: a metric, its least and largest allowed value, and the number of words or
lines from which it applies (ratios over a handful of words say nothing).

Defined results: a null or empty text has no words, all counts 0, fails the base rule and is
not kept. Very long texts are taken whole. Repeated rows give repeated results; columns that
are called like a metric are no obstacle, because metrics live in a struct column of their own.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, words

#: Frequent function words of the four languages (compared in lower case, whole words only).
STOP_WORDS = (
    "the of and to a in is it for on with are that this was at by from or an be as have not "
    "der die und das den von ist mit sich des im ein eine für auf nicht dem zu als "
    "le la les de et des un une que qui dans du en pour par sur au est pas avec "
    "el los las y se del por con para una lo como más su al"
).split()


@dataclass(frozen=True)
class Rule:
    metric: str
    low: float | None = None
    high: float | None = None
    over: str = "n_words"
    at_least: int = 1


#: The production thresholds.
RULES = (
    Rule("n_words", low=10, at_least=0),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.01, at_least=60),
    Rule("stop_ratio", low=0.03, at_least=200),
    Rule("dup_line_ratio", high=0.3, over="n_lines", at_least=4),
)


def measure(df: DataFrame, text: str = "text", into: str = "quality", window: int = 5) -> DataFrame:
    """Add the struct column `into` with all counts and ratios of the text.

    `n_repeat_words` are the words inside `window`-word windows that are found twice or more in
    the text, the first one included. Windows are compared by a 64-bit hash within one text.
    Only texts with a repeated hash are sorted: neighbours in the sorted (hash, position) list
    show which positions repeat; a fold over these adds up the words that they cover.

    Steps are plain columns, one above the other, so that each is evaluated once.
    """
    kept, own = df.columns, lambda k: f"__{into}_{k}"
    col = lambda k: F.col(own(k))
    none = F.array().cast("array<bigint>")
    df = df.withColumns({own("t"): F.coalesce(F.col(text), F.lit(""))})
    df = df.withColumns({own("w"): words(col("t")), own("lines"): F.filter(F.split(col("t"), "\n", -1), lambda x: x.rlike(WORD))})
    last = F.size(col("w")) - window
    df = df.withColumn(own("h"), F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(col("w"), i + k) for k in range(window)]))).otherwise(none))
    # (hash, position) in order, where some hash repeats
    pair = F.transform(col("h"), lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    df = df.withColumn(own("order"), F.when(F.size(F.array_distinct(col("h"))) < F.size(col("h")), F.sort_array(pair)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    n = F.size(col("order"))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), F.slice(col("order"), 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(col("order"), 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,p:int>")))
    near = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    places = F.zip_with(col("order"), near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["p"]))
    df = df.withColumn(own("places"), F.when(n > 0, F.sort_array(F.array_compact(places))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(
        col("places"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(p, a["end"])).alias("n")),
    )["n"]
    counts = {
        "n_words": F.size(col("w")),
        "word_chars": F.char_length(F.regexp_replace(col("t"), SPACE_CLASS, "")),
        "n_symbols": F.char_length(col("t")) - F.char_length(F.translate(col("t"), "#*$%&|<>", "")),
        "n_lines": F.size(col("lines")),
        "n_dup_lines": F.size(col("lines")) - F.size(F.array_distinct(col("lines"))),
        "n_repeat_words": covered,
        "n_stop_words": F.size(F.filter(col("w"), lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))),
    }
    df = df.withColumns({own(k): v.cast("long") for k, v in counts.items()})
    ratio = lambda a, b: F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))
    measured = F.struct(
        *[col(k).alias(k) for k in counts],
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ((col("n_words") < 10) | (100 * col("n_repeat_words") > 20 * col("n_words"))).alias("base_failed"),
    )
    return df.select(*[c for c in kept if c != into], measured.alias(into))


def verdict(rules: tuple[Rule, ...] = RULES, of: str = "quality") -> Column:
    """All rules as one boolean expression."""
    q = F.col(of)

    def holds(r: Rule) -> Column:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (q[r.metric] >= r.low)
        if r.high is not None:
            ok = ok & (q[r.metric] <= r.high)
        return (q[r.over] < r.at_least) | ok

    return reduce(lambda a, b: a & b, map(holds, rules)) & ~q["base_failed"]


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """The rows with their metrics and `kept` inside the struct column `into`."""
    df = measure(df, text, into)
    return df.withColumn(into, F.col(into).withField("kept", verdict(rules, into)))


def passing(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `df` that pass.

    The optimizer would push the filter below the steps of `measure`, writing each of them out in
    full inside the next; a row number that the filter looks at keeps it above them.
    """
    out = quality_rules(df, rules, text, "__verdict").withColumn("__row", F.monotonically_increasing_id())
    return out.where((F.col("__row") >= 0) & F.col("__verdict.kept")).select(*df.columns)
