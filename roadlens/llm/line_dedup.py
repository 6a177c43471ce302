"""Line dedup over content-defined chunks of lines (DataFrame functions only).

A text is cut into lines, each line is hashed, and a rolling hash runs over neighbouring line
hashes.  A chunk begins where the rolling hash is a local minimum, so boundaries depend on a few
lines around them and lie alike wherever a passage is shifted to; chunks have two lines or more
(a text of one line is one chunk and is left alone).  A chunk found more than once in the corpus
stays at its first place only, in order of id and position; the other places lose it, after the
bytes of all finds have been compared: finds under one digest count as repeats only if they are
one and the same byte string.

Passages seldom begin and end at boundaries, and short ones may hold no whole chunk.  So what chunks
leave is looked at line by line: two neighbouring lines go where an earlier place has the two together as
well (128 bits of their SHA-256).  Those inside a chunk that goes need no look: they go with it, and their first place is
not there.  Passages of two lines or more thus go whole, edges included.

Shuffles: chunk and pair digests (small), chunk texts once (for the comparison; equal texts are combined
before the shuffle, so a chunk that a third of all rows share is no hot group) and the documents
once, to the list of what each one loses.

Defined cases: null text has no lines and stays null; blank chunks and pairs are left alone; a passage that
repeats inside one text keeps its first place; rows that repeat an id are told apart by their
text, rows equal in both lose the same lines; a text that loses everything becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hash_bits, stored

#: Base of the rolling hash over two line hashes of 32 bits.
BASE = 31
LAST_ID = (1 << 63) - 1


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"), F.xxhash64("text").alias("__th")]


def _cut(docs: DataFrame) -> DataFrame:
    """docs + __lines and __starts (first line of every chunk, from 0)."""
    docs = docs.withColumn("__lines", F.split("text", "\n", -1))
    docs = docs.withColumn("__hashes", F.transform("__lines", lambda x: hash_bits(x, 8)))
    docs = docs.withColumn("__rolling", F.transform("__hashes", lambda h, i: h * BASE + F.coalesce(F.get("__hashes", i + 1), F.lit(0))))
    at = lambda i: F.get("__rolling", i)
    inner = F.when(F.size("__lines") > 3, F.sequence(F.lit(2), F.size("__lines") - 2)).otherwise(F.array().cast("array<int>"))
    minima = F.filter(inner, lambda i: (at(i) < at(i - 1)) & (at(i) <= at(i + 1)))
    return docs.withColumn("__starts", F.concat(F.array(F.lit(0)), minima)).drop("__hashes", "__rolling")


def _chunk_lines(k: Column) -> Column:
    start, end = F.get("__starts", k), F.coalesce(F.get("__starts", k + 1), F.size("__lines"))
    return F.slice("__lines", start + 1, end - start)


def chunks(docs: DataFrame) -> DataFrame:
    """(__id, __th, __no, __start, n_lines, body, __next): the chunks of all texts with two lines or more, and the line after each."""
    cut = _cut(docs.select("doc_id", "text").filter("text IS NOT NULL")).filter(F.size("__lines") > 1)
    rows = cut.select(*_row_key(), "__lines", "__starts", F.explode(F.sequence(F.lit(0), F.size("__starts") - 1)).alias("__no"))
    following = F.get("__lines", F.get("__starts", F.col("__no") + 1))
    rows = rows.select("__id", "__th", "__no", F.get("__starts", F.col("__no")).alias("__start"), _chunk_lines(F.col("__no")).alias("__l"), following.alias("__next"))
    return rows.select("__id", "__th", "__no", "__start", F.size("__l").alias("n_lines"), "__l", F.array_join("__l", "\n").alias("body"), "__next")


def _digest(body: Column) -> Column:
    """128 bits of SHA-256; null for a body without a word."""
    return F.when(body.rlike(WORD), F.unhex(F.substring(F.sha2(body, 256), 1, 32)))


def _marks(docs: DataFrame) -> DataFrame:
    """(__id, __th, __no, __start, n_lines, __digest, __pairs): each chunk with its digest (null if blank or of one line) and the
    digests of the pairs that begin in it; the last of these reaches into the next chunk."""
    l = F.concat(F.col("__l"), F.when(F.col("__next").isNull(), F.array().cast("array<string>")).otherwise(F.array("__next")))  # noqa: E741
    pair = lambda i: _digest(F.concat(F.get("__l", i), F.lit("\n"), F.get("__l", i + 1)))
    found = chunks(docs).withColumn("__digest", F.when(F.col("n_lines") > 1, _digest(F.col("body")))).withColumn("__l", l)
    pairs = F.when(F.size("__l") > 1, F.transform(F.sequence(F.lit(0), F.size("__l") - 2), pair)).otherwise(F.array().cast("array<binary>"))
    return found.select("__id", "__th", "__no", "__start", "n_lines", "__digest", pairs.alias("__pairs"))


def _later(places: DataFrame, *order: str) -> DataFrame:
    """The places (with ``__digest``) that do not come first among those of their digest."""
    first = places.groupBy("__digest").agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first")).filter("__n > 1")
    return places.join(first.drop("__n"), "__digest").filter(F.struct(*order) != F.col("__first")).drop("__first")


def repeated_chunks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(__id, __th, __no, __start, n_lines): every place that loses its chunk."""
    lost = _later(marks.select("__id", "__th", "__no", "__start", "n_lines", "__digest").filter("__digest IS NOT NULL"), "__id", "__th", "__no")
    found = chunks(docs).filter("n_lines > 1").select(_digest(F.col("body")).alias("__digest"), "body").filter("__digest IS NOT NULL")
    texts = found.groupBy("__digest", "body").agg(F.count("*").alias("__n")).groupBy("__digest").agg(F.count("*").alias("__texts"), F.sum("__n").alias("__finds"))
    same = texts.filter("__texts = 1 AND __finds > 1").select("__digest")
    return lost.join(same, "__digest", "left_semi").select("__id", "__th", "__no", "__start", "n_lines").distinct()


def repeated_pairs(marks: DataFrame, lost: DataFrame) -> DataFrame:
    """(__id, __th, __start): every place that loses a pair of lines which no lost chunk holds."""
    rows = marks.join(lost.select("__id", "__th", "__no", F.lit(True).alias("__gone")), ["__id", "__th", "__no"], "left")
    rows = rows.select("__id", "__th", "__start", "n_lines", "__gone", F.posexplode("__pairs").alias("__k", "__digest"))
    rows = rows.filter(F.col("__digest").isNotNull() & (F.col("__gone").isNull() | (F.col("__k") == F.col("n_lines") - 1)))
    pairs = stored(rows.select("__id", "__th", (F.col("__start") + F.col("__k")).alias("__start"), "__digest"), "pairs")
    return _later(pairs, "__id", "__th", "__start").select("__id", "__th", "__start")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with ``text`` freed of repeated chunks and of what else repeats of two lines or more, + ``n_lines, n_removed_lines,
    n_removed_chunks, n_removed_passages`` (long): chunks that went whole, and runs of lines that went."""
    made = {"n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_passages"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    columns = docs.columns
    marks = stored(_marks(docs), "chunks")
    chunks_lost = stored(repeated_chunks(docs, marks), "lost-chunks")
    lost = chunks_lost.select("__id", "__th", F.struct("__start", "n_lines", F.lit(True).alias("__whole")).alias("__x"))
    lost = lost.unionAll(repeated_pairs(marks, chunks_lost).select("__id", "__th", F.struct("__start", F.lit(2).alias("n_lines"), F.lit(False).alias("__whole")).alias("__x")))
    # a place may be listed twice (rows that repeat): collect_set; one text's lines at most
    lost = lost.groupBy(F.col("__id").alias("__li"), F.col("__th").alias("__lt")).agg(F.collect_set("__x").alias("__lost"))
    rows = docs.select("*", *_row_key()).join(lost, (F.col("__id") == F.col("__li")) & (F.col("__th") == F.col("__lt")), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n", -1))
    rows = rows.withColumn("__gone", F.array_distinct(F.flatten(F.transform("__lost", lambda x: F.sequence(x["__start"], x["__start"] + x["n_lines"] - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    count = lambda c: F.when(F.col("__lost").isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    rows = rows.withColumn("__text", F.when(F.col("__lost").isNull(), F.col("text")).otherwise(left))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long"))
    rows = rows.withColumn("n_removed_lines", count(F.col("__gone")))
    rows = rows.withColumn("n_removed_chunks", count(F.filter("__lost", lambda x: x["__whole"])))
    rows = rows.withColumn("n_removed_passages", count(F.array_except("__gone", F.transform("__gone", lambda i: i + 1))))
    made = ["n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_passages"]
    return rows.withColumn("text", F.col("__text")).select(*[F.col(f"`{c}`") for c in columns], *made)


def _pairs(docs: DataFrame) -> DataFrame:
    """(__id, __th, __no, __digest): every two neighbouring lines with a word, by the number of the first."""
    lined = docs.select("doc_id", "text").filter("text IS NOT NULL").select(*_row_key(), F.split("text", "\n", -1).alias("__lines")).filter(F.size("__lines") > 1)
    body = lambda i: F.concat(F.get("__lines", i), F.lit("\n"), F.get("__lines", i + 1))
    digest = lambda i: F.when(body(i).rlike(WORD), F.unhex(F.substring(F.sha2(body(i), 256), 1, 32)))
    digests = F.transform(F.sequence(F.lit(0), F.size("__lines") - 2), digest)
    return lined.select("__id", "__th", F.posexplode(digests).alias("__no", "__digest")).filter("__digest IS NOT NULL")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs with ``text`` freed of every run of two or more lines that an earlier place has, + ``n_lines,
    n_removed_lines, n_removed_passages`` (long).

    A line goes if it and a neighbour, with a word in them, stand together at an earlier place (id, then
    line) as well, whatever surrounds them; so passages of any length go whole, edges included, and every
    line's own first place stays.  Two lines are equal if 128 bits of their SHA-256 are."""
    made = {"n_lines", "n_removed_lines", "n_removed_passages"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    columns = docs.columns
    places = stored(_pairs(docs), "pairs")
    twice = places.groupBy("__digest").agg(F.count("*").alias("__n"), F.min(F.struct("__id", "__th", "__no")).alias("__first")).filter("__n > 1")
    lost = places.join(twice, "__digest").filter(F.struct("__id", "__th", "__no") != F.col("__first"))
    lost = lost.groupBy(F.col("__id").alias("__li"), F.col("__th").alias("__lt")).agg(F.collect_set("__no").alias("__lost"))
    rows = docs.select("*", *_row_key()).join(lost, (F.col("__id") == F.col("__li")) & (F.col("__th") == F.col("__lt")), "left")
    rows = rows.withColumn("__lines", F.split("text", "\n", -1))
    rows = rows.withColumn("__gone", F.array_union("__lost", F.transform("__lost", lambda i: i + 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    count = lambda c: F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    rows = rows.withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long"))
    rows = rows.withColumn("n_removed_lines", count(F.col("__gone")))
    rows = rows.withColumn("n_removed_passages", count(F.array_except("__gone", F.transform("__gone", lambda i: i + 1))))
    return rows.withColumn("text", F.col("__text")).select(*[F.col(f"`{c}`") for c in columns], "n_lines", "n_removed_lines", "n_removed_passages")
