"""Line dedup by winnowing: later copies of repeated runs of lines are deleted. Built-in functions only.

Lines are hashed (trimmed, 128 bits). From each line on, the shortest run of lines with at least
``min_words`` words is a window; of each window the line with the least hash is a fingerprint (ties: the
last). Equal runs of ``min_words`` words begin with equal windows, so they are certain to share a
fingerprint; a line that long is its own window.

Fingerprints found at several positions are shared. Windows around them are joined with the first occurrence of
the same lines, which gives pairs of positions, here and at one earlier place (by document id and line). A match is
extended both ways by the windows on to its end and back to its start: the shortest runs of ``min_words`` words
from a line on, and those up to a line, cover every longer run and lie in it. What is deleted is every line of a run
of at least ``min_words`` words that stands, line for line, at one earlier place. First occurrences always stay.

No list of occurrences is ever made: each window is held against the first occurrence of its hash (128 bits of
its lines), which a partial aggregation finds, so a passage that a third of all documents share costs one row a
task there, and the joins are one to many with the many side split by adaptive execution.

Defined cases: null texts stay null and have no lines; lines of white space are kept and belong to no run;
ties of equal ids are ordered by a hash of the row; rows equal in id and text count as one document and are
treated alike; null ids sort first; empty tables stay empty; columns named as the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import checkpointed, release

_SPACE = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50

_ROW = ["k1", "k2"]
_LINE = ["h", "g"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """128 bits that name a row."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("k2")]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each line with a word: row key, id, place among all and among such lines, hash, words."""
    cut = F.filter(
        F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(_SPACE)).alias("body"))),
        lambda s: s["body"] != "",
    )
    return (
        docs.where(F.col(text).isNotNull())
        .select(*_keyed(docs, doc_id, text), F.col(doc_id).alias("doc"), F.posexplode(cut).alias("pos", "s"))
        .select(
            *_ROW,
            "doc",
            "pos",
            F.col("s.line").alias("line"),
            F.xxhash64("s.body").alias("h"),
            F.xxhash64(F.lit(1), "s.body").alias("g"),
            F.size(F.split("s.body", _GAP)).alias("words"),
        )
        .dropDuplicates([*_ROW, "pos"])
    )


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """Winnowed lines: the least hash of every window, the last one of ties."""
    within = Window.partitionBy(*_ROW).orderBy("pos")
    counted = lines.select(
        *_ROW,
        *_LINE,
        "pos",
        (F.sum("words").over(within) - F.col("words")).alias("before"),
        F.sum("words").over(Window.partitionBy(*_ROW)).alias("total"),
    )
    window = Window.partitionBy(*_ROW).orderBy("before").rangeBetween(0, min_words - 1)
    least = counted.select(*_ROW, "before", "total", F.min(F.struct("h", "g", (-F.col("pos")).alias("late"))).over(window).alias("f"))
    return least.where(F.col("total") - F.col("before") >= min_words).select(*_ROW, "f.h", "f.g", "f.late").distinct()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: ``k1, k2`` (row key) and ``line`` (index in the split text), with their words."""
    lines = checkpointed(_lines(docs, doc_id, text))
    marks = fingerprints(lines, min_words)
    shared = checkpointed(marks.groupBy(*_LINE).agg(F.count("*").alias("n")).where("n > 1").select(*_LINE))
    taking_part = marks.join(shared, _LINE).select(*_ROW).distinct()
    lines = checkpointed(lines.join(taking_part, _ROW, "left_semi"))

    # Only what stands around a shared fingerprint can repeat; each window there meets its first occurrence.
    windows = checkpointed(_windows(lines, min_words).join(shared, _LINE, "left_semi").drop(*_LINE))
    first = windows.groupBy("kind", "wh", "wg").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(first, ["kind", "wh", "wg"]).where(F.col("first") < F.col("place"))
    edges = again.groupBy(*_ROW, F.col("place.pos").alias("pos")).agg(F.max(F.when(F.col("kind") == 0, F.col("edge"))).alias("to"), F.min(F.when(F.col("kind") == 1, F.col("edge"))).alias("since"))
    within = Window.partitionBy(*_ROW).orderBy("pos")
    reached = lines.join(edges, [*_ROW, "pos"], "left").select(
        *_ROW,
        "pos",
        "line",
        "words",
        F.max("to").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("to"),
        F.min("since").over(Window.partitionBy(*_ROW).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)).alias("since"),
    )
    return reached.where((F.col("to") >= F.col("pos")) | (F.col("since") <= F.col("pos"))).select(*_ROW, "line", "words")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from each line on (kind 0) and up to it (1).

    Of each the place, a hash of all its lines, its other edge, and its fingerprint's line. A run up to a line holds
    the one from its first line on and goes by that one's fingerprint.
    """
    counted = lines.select(
        *_ROW,
        *_LINE,
        "doc",
        "pos",
        "words",
        F.sum("words").over(Window.partitionBy(*_ROW).orderBy("pos")).alias("past"),
        F.sum("words").over(Window.partitionBy(*_ROW)).alias("total"),
    ).withColumn("before", F.col("past") - F.col("words"))
    on = Window.partitionBy(*_ROW).orderBy("before").rangeBetween(0, min_words - 1)
    upto = Window.partitionBy(*_ROW).orderBy("past").rangeBetween(1 - min_words, 0)
    ahead = counted.select(
        "*",
        (F.col("total") - F.col("before") >= min_words).alias("on"),
        *[F.xxhash64(F.collect_list(n).over(on)).alias(f"{n}0") for n in _LINE],
        (F.col("pos") + F.count("*").over(on) - 1).alias("to"),
        F.min(F.struct(*_LINE)).over(on).alias("f0"),
    )
    listed = ahead.select(
        "*",
        F.struct("doc", *_ROW, "pos").alias("place"),
        (F.col("past") >= min_words).alias("upto"),
        *[F.xxhash64(F.collect_list(n).over(upto)).alias(f"{n}1") for n in _LINE],
        (F.col("pos") - F.count("*").over(upto) + 1).alias("since"),
        F.first("f0").over(upto).alias("f1"),
    )

    def side(kind: int, whole: str, edge: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(f"h{kind}").alias("wh"), F.col(f"g{kind}").alias("wg"), F.col(edge).cast("int").alias("edge"), F.col(whole).alias("whole"), F.col(f"f{kind}").alias("f"))

    both = F.array(side(0, "on", "to"), side(1, "upto", "since"))
    return listed.select(*_ROW, "place", F.explode(both).alias("w")).where("w.whole").select(*_ROW, "place", "w.kind", "w.wh", "w.wg", "w.edge", "w.f.h", "w.f.g")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs gone from ``text``, and ``removed_lines``, ``removed_words`` (long)."""
    # A row for each document that loses lines; what led to it goes before the texts are moved.
    gone = checkpointed(
        repeated_lines(docs, doc_id, text, min_words)
        .groupBy(*_ROW)
        .agg(F.collect_list("line").alias("__gone"), F.sum("words").alias("__words"))
    )
    release(docs.sparkSession, 3, 0.3)
    own = [c for c in docs.columns if c.lower() not in ("removed_lines", "removed_words")]
    # The row is one column, so that no column of it can clash with those made here.
    keyed = docs.select(F.struct(*own).alias("__row"), F.col(text).alias("__text"), *[k.alias(f"__{n}") for n, k in zip(_ROW, _keyed(docs, doc_id, text), strict=True)])
    both = keyed.join(gone.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")
    # The split text is a column of its own, so that it is made once a row.
    both = both.withColumn("__cut", F.when(F.col("__gone").isNotNull(), F.split("__text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), F.col("__gone"))
    rest = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__cut"), i)), "\n"))
    return both.select(
        *[rest.alias(c) if c.lower() == text.lower() else F.col("__row")[c].alias(c) for c in own],
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("removed_lines"),
        F.coalesce("__words", F.lit(0)).cast("long").alias("removed_words"),
    )
