"""Quality rules: a threshold table compiled into one projection of text ratios.

Each rule is a ratio with bounds. ``features`` computes the counts that the ratios need, ``compile_rules``
turns the whole table into the columns of a single projection, and ``judge`` applies it. Only built-in
functions are used: no user function, no shuffle, nothing between rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated words are those in 8-word windows that are found twice or more
in the text. Windows are compared by 64-bit hashes of their words, within one text only.

Defined cases: a null or empty text has no words, fails the base rules and isn't kept; ratios over nothing
are 0; rows are kept one to one, so ties and repeated rows get equal verdicts; empty tables stay empty;
columns named as the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were which with "
    "au aux avec ce ces dans de des du elle en est et il la le les mais ou par pas pour que qui sur un une "
    "auf aus bei das dem den der des die ein eine einer für im in ist mit nicht sich sie und von zu zum "
    "al como con del el ella en es la las lo los más no para pero por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two features (over nothing: 0) that must lie within bounds; ``scale`` for whole numbers."""

    name: str
    over: str
    under: str | None = None
    low: float | None = None
    high: float | None = None


#: The default table.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.15),
    Rule("upper_ratio", "n_upper", "word_chars", high=0.40),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.04),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.50),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", high=0.90),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", high=0.30),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


def _count(condition: Column) -> Column:
    return F.size(condition).cast("long")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of ``COUNTS`` (long) for each row."""
    own = [c for c in df.columns if c.lower() not in COUNTS]
    # The row is one column, so that no column of it can clash with those made here.
    df = df.select(F.struct(*own).alias("__row"), F.col(text).alias("__text"))
    body = F.coalesce(F.col("__text"), F.lit(""))
    bare = F.btrim(body, F.lit(_SPACE))
    # Arrays that several counts use are columns of their own, so that each is made once a row.
    cut = df.select(
        "__row",
        "__text",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP)).alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("__lines"),
    )
    hashed = cut.select(
        "*",
        F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("__hashes"),
    )
    # Texts without a repeated window, nearly all, end here; others sort (hash, place).
    order = hashed.select(
        "*",
        F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("__order"),
    )
    places = order.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter("__order", lambda x, k: (x["h"] == F.get("__order", k - 1)["h"]) | (x["h"] == F.get("__order", k + 1)["h"])),
                lambda x: x["i"],
            )
        ).alias("__places"),
    )
    stop = [w for w in dict.fromkeys(STOP_WORDS)]
    counts = places.select(
        "__row",
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.coalesce("__text", F.lit("")), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(F.coalesce("__text", F.lit("")), r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            _count(F.filter("__words", lambda w: F.lower(w).isin(stop))).alias("n_stop_words"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            _count(F.filter("__lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))).alias("n_bullet_lines"),
            _count(F.filter("__lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis_lines"),
            F.coalesce(
                F.aggregate(
                    F.transform("__places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", k + 1) - p, F.lit(WINDOW)))).cast("array<bigint>"),
                    F.lit(0).cast("bigint"),
                    lambda a, x: a + x,
                ),
                F.lit(0),
            ).alias("n_repeat_words"),
            # Not a function of the row alone: so no filter on a count is pushed below this projection, where
            # each array would be written out anew for every use of it.
            F.monotonically_increasing_id().alias("once"),
        ).alias("__counts"),
    )
    return counts.select("__row.*", *[F.col("__counts")[c].alias(c) for c in COUNTS])


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 of 100 words in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """The table as columns of one projection: ``failed_rules`` (names, in order) and ``kept``."""
    tests = []
    for r in rules:
        value = F.col(r.over).cast("double")
        if r.under is not None:
            value = F.when(F.col(r.under) > 0, value / F.col(r.under)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (value > F.lit(float(r.high)))
        tests.append((r.name, bad))
    any_bad = base_failed()
    for _, bad in tests:
        any_bad = any_bad | bad
    names = F.array_compact(F.array(F.when(base_failed(), F.lit("base")), *[F.when(bad, F.lit(name)) for name, bad in tests]))
    return [base_failed().alias("base_failed"), names.alias("failed_rules"), (~any_bad).alias("kept")]


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with all counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    counted = features(df, text)
    own = [c for c in counted.columns if c.lower() not in ("base_failed", "failed_rules", "kept")]
    return counted.select(*own, *compile_rules(rules))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``df`` that pass, with its own columns."""
    inner = df.select(F.struct(*df.columns).alias("__row"), F.col(text).alias("__text"))
    return judge(inner, "__text", rules).where("kept").select("__row.*")
