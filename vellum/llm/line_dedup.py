"""Line dedup: range-partitioned line hashes, first occurrences, keep bitmaps. DataFrame functions only.

Every line's key (blanks stripped at both ends, A-Z lower-cased) becomes a 128-bit hash. The rows
``(hash, document, line number)`` are range-partitioned by hash with a secondary sort by document and
line number; a window streams over each hash and carries its first document along. A row of a later
document is a dropped line. No text is moved for that: the dropped line numbers become 64-bit words,
equal neighbouring words become runs, and a document's answer is a short list of runs.

Hot lines: a mergeable frequency sketch (``approx_top_k``, at most ``TOP`` entries) names the hashes
that hold more than one in ``SHARE`` rows. Their first documents come from a map-side minimum and go to
every task (at most ``TOP`` rows), so a hot line is compared where it stands and never meets in one task.
The sketch only chooses the way: results do not depend on it.

Defined cases: a null or empty text is one empty line; rows with one doc_id (null ids too, which sort
last) are one document for the rule, so a key in two rows of one id is not repeated; each row gets its
own answer, equal rows equal ones; an empty table gives no rows. Other columns are not read, whatever
their names. Keys are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import require_columns, scratch_path

LEAST = 10  # code points of a key that counts
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP, SHARE = 512, 4096
TRACKED = 1 << 15  # counters of the sketch: its error is below rows / SHARE
RUN = "struct<n:int,bits:bigint>"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(h1, h2, doc, row, pos)``: one row for each line whose key has ``least`` code points or more.
    ``doc`` is a struct that sorts null ids last, ``row`` a hash of the text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("row"), _lines(body).alias("lines"))
    rows = src.select("id", "row", F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("id", "row", "pos", line_key(F.col("line")).alias("key"))
    rows = rows.filter(F.length("key") >= least)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "row", "pos")


def dropped_lines(hashes: DataFrame) -> DataFrame:
    """``(id, row, pos)`` of the lines whose hash also stands in a smaller document."""
    top = hashes.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {TOP}, {TRACKED})").alias("top"))
    hot = (top.select("n", F.explode("top").alias("t")).filter(F.col("t.count") * SHARE > F.col("n"))
           .select(F.col("t.item").alias("h1")))
    # at most TOP rows in both broadcasts: the sketch holds no more (two keys on one h1 aside)
    firsts = hashes.join(F.broadcast(hot), "h1").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.lit(True).alias("hot"))
    rows = hashes.join(F.broadcast(firsts), ["h1", "h2"], "left")
    frequent = rows.filter("hot").select("id", "row", "pos", "first")
    place = (Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), F.col("row"), F.col("pos"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    other = (rows.filter("hot IS NULL").select("h1", "h2", "id", "row", "pos").repartitionByRange("h1", "h2")
             .select("id", "row", "pos", F.first("id").over(place).alias("first")))
    return frequent.unionByName(other).filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "row", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """``(id, row, runs)``: the dropped lines of a document as a run-length coded bitmap. ``runs`` lists
    ``(n, bits)``: ``n`` equal 64-bit words, a set bit is a dropped line; lines past the last run stay."""
    mine = dropped.repartition("id", "row")  # all steps below keep this partitioning
    words = (mine.groupBy("id", "row", F.expr("CAST(pos DIV 64 AS INT)").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")).alias("bits")))
    near = Window.partitionBy("id", "row", "bits").orderBy("word")
    words = words.withColumn("island", F.col("word") - F.row_number().over(near))
    runs = (words.groupBy("id", "row", "bits", "island")
            .agg(F.min("word").alias("at"), F.count(F.lit(1)).cast("int").alias("n")))
    found = runs.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "bits"))).alias("r"))
    gaps = """transform(r, (x, i) -> array(
        named_struct('n', x.at - if(i = 0, 0, get(r, i - 1).at + get(r, i - 1).n), 'bits', 0L),
        named_struct('n', x.n, 'bits', x.bits)))"""
    return found.select("id", "row", F.expr(f"filter(flatten({gaps}), x -> x.n > 0)").cast(f"array<{RUN}>").alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that ``runs`` leaves, joined by newlines; the whole text where ``runs`` is null."""
    words = F.flatten(F.transform(runs, lambda r: F.array_repeat(r["bits"], r["n"])))

    def keep(both: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            word = F.coalesce(F.get(both["words"], F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
            return F.getbit(word, F.pmod(i, F.lit(64))) == 0
        return F.array_join(F.filter(both["lines"], stays), "\n")

    # lines and words are made once, as the one element that the lambda is bound to
    both = F.array(F.struct(_lines(text).alias("lines"), words.alias("words")))
    return F.when(runs.isNull(), text).otherwise(F.transform(both, keep)[0])


def n_dropped(runs: Column) -> Column:
    """Lines that ``runs`` drops."""
    each = F.transform(runs, lambda r: r["n"].cast("long") * F.bit_count(r["bits"]))
    return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def dedup_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The keep bitmaps of all documents that lose a line: ``(id, row, runs)``."""
    require_columns(docs, doc_id, text, what="documents")
    path = scratch_path(docs.sparkSession, "line-hashes")
    line_hashes(docs, doc_id, text, least).write.parquet(path)
    return keep_bitmaps(dropped_lines(docs.sparkSession.read.parquet(path)))


def with_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, text, runs)`` of every row, null texts as empty; ``runs`` is null where all lines stay."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    mine = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    found = dedup_bitmaps(docs, doc_id, text, least)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("row"))
    return mine.join(found, same, "left").select("doc_id", "text", "runs")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    found = with_bitmaps(docs)
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return found.select("doc_id", (newlines + 1).cast("long").alias("n_lines"), n_dropped(F.col("runs")).alias("n_dropped"),
                        F.sha2(kept_text(F.col("text"), F.col("runs")).cast("binary"), 256).alias("kept_sha256"))
