"""Lines that repeat across documents: exploded, hashed, counted by document, dropped, and the rest put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hot_join import join_one
from tidemark.sources.scratch import written

#: ASCII white space, which a line's key doesn't begin or end with.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, least_documents: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each text without the lines that at least `least_documents` documents have.

    Lines are split at \\n and compared by their keys. A key of at least least_chars code points that is in so many
    documents loses all its lines but those of the document of smallest id that has it. What stays is joined by \\n;
    n_lines counts the lines before.

    A null or empty text is one empty line. Rows that share an id are one document, and each row's text is cut by itself.
    A row of null id is no known document: it keeps its lines and counts for no other. Extra columns are ignored. An
    empty table gives an empty result. Texts are whole, whatever their length; equal rows give equal rows.

    Only hashes (128 bits), ids and places of lines are counted and joined; a hot line is pre-aggregated before the
    shuffle and joined by broadcast. Texts are shuffled once, to meet the places of what goes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.select("id", F.xxhash64("text").alias("version"), F.split("text", "\n").alias("lines"))
    known = cut.where("id is not null")
    keyed = known.select("id", "version", F.posexplode("lines").alias("at", "line")).withColumn("key", line_key(F.col("line")))
    hashes = [F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")]
    lines = written(keyed.where(F.char_length("key") >= least_chars).select("id", "version", "at", *hashes), "line-hashes")

    in_documents = lines.groupBy("a", "b", "id").agg(F.count("*").alias("n"))
    counts = in_documents.groupBy("a", "b").agg(F.count("*").alias("documents"), F.sum("n").alias("n"), F.min("id").alias("first"))
    repeated = written(counts.where(F.col("documents") >= least_documents).select("a", "b", "n", "first"), "repeated-lines")
    found = join_one(lines, repeated, ["a", "b"], "n", lines.count()).where("id <> first")
    gone = found.groupBy("id", "version").agg(F.collect_set("at").alias("gone"))  # a row that is repeated names its places again

    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    joined = known.join(gone, ["id", "version"], "left")
    places = joined.withColumn("kept", F.when(F.col("gone").isNull(), numbers).otherwise(F.array_except(numbers, F.col("gone"))))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform("kept", lambda i: F.get("lines", i))), "\n")
    n_lines = F.size("lines").cast("long")
    cleaned = places.select(F.col("id").alias(id_col), text.alias("text"), n_lines.alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
    unknown = cut.where("id is null").select(F.col("id").alias(id_col), F.array_join("lines", "\n").alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return cleaned.unionByName(unknown)
