"""Quality rules: repetition and length within a document, and line frequency across the documents of a host.

Built-in functions only. Each document is read once: its own figures and the hashes of its normalised lines are written as a narrow table,
and the cross-document counts, which are partial aggregates over (host, line), run on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, ascii_lower, internal, let, written

#: Bits of a packed value that hold a word's position; a text with more words takes the path without packing.
POSITION_BITS = 24


def _adjacent(values: Column, same, keep) -> Column:
    """keep(x) of the elements of a sorted array that equal a neighbour under same()."""
    marked = F.transform(values, lambda x, i: F.when((F.coalesce(same(x, F.get(values, i - 1)), F.lit(False))) | (F.coalesce(same(x, F.get(values, i + 1)), F.lit(False))), keep(x)))
    return F.filter(marked, lambda x: x.isNotNull())


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words of the array stand in windows of `width` words that occur twice or more.

    The windows' hashes are sorted with their positions packed into the low bits, as plain longs. Neighbours that agree in the high bits
    are candidates; they are sorted again with their full 64-bit hashes, and the positions left are merged into covered words.
    """
    low = (1 << POSITION_BITS) - 1
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    def candidates(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(~low) + i))
        few = let(packed, lambda p: _adjacent(p, lambda x, y: x.bitwiseAND(~low) == y.bitwiseAND(~low), lambda x: x.bitwiseAND(low).cast("int")))
        return F.when(F.size(h) <= low, few).otherwise(F.sequence(F.lit(0), F.size(h) - 1))

    def positions(h: Column) -> Column:
        pairs = let(candidates(h), lambda c: F.array_sort(F.transform(c, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p")))))
        return F.sort_array(let(pairs, lambda s: _adjacent(s, lambda x, y: x["h"] == y["h"], lambda x: x["p"])))

    def covered(p: Column) -> Column:
        gaps = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(gaps)

    count = let(words, lambda w: F.when(F.size(w) < width + 1, F.lit(0).cast("long")).otherwise(let(hashes(w), lambda h: let(positions(h), covered))))
    return count


def _normal(line: Column) -> Column:
    return ascii_lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def document_figures(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, row_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines: array of (h, words, n) of the distinct normalised lines.

    A normalised line is lower-cased (A-Z), its blanks collapsed and trimmed; n is how often it occurs in the document. row_key is a hash of
    doc_id, host and text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))

    def line_figures(ls: Column) -> Column:
        hashed = F.array_sort(F.transform(ls, lambda x: let(_normal(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.regexp_count(y, F.lit(WORD)).cast("long").alias("words")))))
        # runs of equal elements: the position of each run's first element gives its length
        firsts = lambda s: F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        counted = let(hashed, lambda s: let(firsts(s), lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i)["h"].alias("h"), F.get(s, i)["words"].alias("words"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).cast("long").alias("n")))))
        return F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"), counted.alias("lines"))

    word_figures = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep")))
    rows = rows.select(
        "doc_id", "host", F.xxhash64("doc_id", "host", "text").alias("row_key"), word_figures.alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, line_figures).alias("l"),
    )
    return rows.select("doc_id", "host", "row_key", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.lines").alias("lines"))


def _frequent_lines(figures: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """rid, row_key, h, words, n of the lines of each document that are above their host's limits."""
    lines = figures.select("rid", "row_key", "host", F.explode("lines").alias("l")).select("rid", "row_key", "host", "l.h", "l.words", "l.n")
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > line_docs)
    hosts = figures.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "host_h")
    frequent = counts.join(hosts, counts["host"].eqNullSafe(hosts["host_h"])).where(F.col("docs") > line_share * F.col("host_docs"))
    frequent = frequent.select(F.xxhash64("host", "h").alias("key"), F.col("host").alias("f_host"), F.col("h").alias("f_h"))
    hit = lines.withColumn("key", F.xxhash64("host", "h")).join(frequent, "key").where(F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h")))
    return hit.select("rid", "row_key", "h", "words", "n")


def _judged(docs: DataFrame, host_col: str, min_words: int, max_repeat_percent: int, line_docs: int, line_share: float, min_left: float) -> tuple[DataFrame, DataFrame]:
    """The figures with base_failed, kept and what is removed, and the frequent lines."""
    figures = document_figures(docs, host_col).withColumn("rid", F.monotonically_increasing_id())
    figures = written(figures, "quality-figures")  # rid is fixed from here on
    hit = _frequent_lines(figures, line_docs, line_share)
    removed = hit.groupBy("rid").agg(F.sum(F.col("words") * F.col("n")).alias("n_removed_words"), F.sum("n").alias("n_removed_lines"))
    zero = F.lit(0).cast("long")
    out = figures.drop("lines").join(removed, "rid", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_removed_words", "n_removed_lines")})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("n_removed_words") > 0) & (F.col("n_words") - F.col("n_removed_words") < min_left * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted}), hit


def quality_rules(
    docs: DataFrame,
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_docs: int = 20,
    line_share: float = 0.01,
    min_left: float = 0.2,
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words, n_removed_lines.

    A line is removed if it stands in more documents of its host than both line_docs and line_share of the host's documents. A document
    is depleted, and rejected, if less than min_left of its words is left; a document without removed lines never is. base_failed: fewer
    than min_words words, or more than max_repeat_percent of them repeated.

    Null texts count as empty (base_failed); null hosts are one host; null doc_ids are carried. Texts of any length are read whole. Repeated
    rows are documents of their own in counts and results. An empty table gives an empty result. Other columns are ignored, whatever their
    names.
    """
    out, _ = _judged(docs, host_col, min_words, max_repeat_percent, line_docs, line_share, min_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines")


def clean_documents(
    docs: DataFrame,
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_docs: int = 20,
    line_share: float = 0.01,
    min_left: float = 0.2,
) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; their texts come without the frequent lines, the other lines as they are.

    Rows alike in doc_id, host and text share their verdict. Rejected are null and empty texts, as there. An empty table gives an empty result.
    """
    out, hit = _judged(docs, host_col, min_words, max_repeat_percent, line_docs, line_share, min_left)
    out = written(out.select("rid", "row_key", "kept"), "quality-verdicts")
    kept = out.where("kept").select(F.col("row_key").alias(internal("kept"))).distinct()
    gone = hit.groupBy(F.col("row_key").alias(internal("gone"))).agg(F.collect_set("h").alias(internal("lines")))  # no more than a document's own lines
    host, text = F.col(f"`{host_col}`"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(internal("key"), F.xxhash64(F.col("doc_id"), host, text))
    rows = rows.join(kept, F.col(internal("key")) == F.col(internal("kept"))).join(gone, F.col(internal("key")) == F.col(internal("gone")), "left")
    left = F.filter(F.split(F.col("text"), "\n", -1), lambda x: ~F.array_contains(F.col(internal("lines")), F.xxhash64(_normal(x))))
    clean = F.when(F.col(internal("lines")).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select(*((clean if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns))
