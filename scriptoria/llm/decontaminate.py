"""Benchmark decontamination with a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before lower-casing: any run of other than the ASCII characters that are no letter or digit.
#: They are listed one by one, as the JVM then looks a character up in one bit set; ranges are tried one after another.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: Rows, or words in them, up to which a table made of test items is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST = 200_000
#: Alignments of a document that are compared in one row, beside its words.
CHUNK = 1000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and nothing else."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _lean(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def postings(docs: DataFrame, terms: DataFrame, n_terms: int, found_in: Callable[[Column], Column] = words) -> DataFrame:
    """The index: one row (term, key, pos) for each place of a term of ``terms`` (word, term) in ``docs`` (key, text).

    It is laid out by document, as the scan gives it: a document's postings are
    made by one task and need no shuffle. By default its words are
    those of the exact comparison; what ``found_in`` does to a word must not depend on the text around it.
    """
    found = docs.select("key", F.posexplode(found_in(F.col("text"))).alias("pos", "word"))
    return found.join(_lean(terms, n_terms), "word").select("term", "key", "pos")


def test_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``items`` (item_id, text): each usable item (item, words); each different window once (phrase, item, begin, length, words), in the first
    item and place that has it; and the items of each (phrase, item_id)."""
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    rows = named.withColumn("words", words(F.col("text"))).where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "words")
    rows = stored(rows, "items")
    length = F.least(F.size("words"), F.lit(window))
    cut = rows.select("item", "item_id", length.alias("length"), "words", F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("begin"))
    cut = cut.select("item", "item_id", "begin", "length", F.slice("words", F.col("begin") + 1, F.col("length")).alias("words"))
    first = cut.groupBy("words").agg(F.min(F.struct("item", "begin", "length")).alias("at")).withColumn("phrase", F.monotonically_increasing_id())
    first = stored(first.select("phrase", "at.*", "words"), "phrases")
    owners = cut.join(first.select("phrase", "words"), "words").select("phrase", "item_id").distinct()
    return rows.select("item", "words"), first, stored(owners, "owners")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(key, phrase, first, length): every occurrence in ``docs`` (key, text) of a window of the items, from word ``first`` on; and the
    items of each phrase (phrase, item_id). ``key`` may be of any type that joins.

    1. The rarest two places of every different window are found from the counts of the
       test terms in ``docs``. 2. Postings of those terms alone are stored. 3. Each
       posting less its place in the item gives an alignment of item and document;
       lists are intersected by counting the distinct places that agree on an alignment (two, or one
       where an item has a window of one word). 4. On the documents that remain, words are compared
       one by one along the alignment, and a window counts if all of its words agree. A document's alignments are
       dealt to rows of CHUNK, each of which has the document's words once; what leaves it is as long as the item.
    """
    rows, phrases, owners = test_windows(items, window)
    places = phrases.select("phrase", "item", "begin", "length", F.posexplode("words").alias("within", "word"))
    vocabulary = stored(places.select("word").distinct(), "vocabulary")
    n_terms = vocabulary.count()
    counts = postings(docs, vocabulary.withColumn("term", F.col("word")), n_terms).groupBy("term").agg(F.count("*").alias("n"))
    counts = stored(vocabulary.join(_lean(counts, n_terms), F.col("word") == F.col("term"), "left").select("word", F.coalesce("n", F.lit(0)).alias("count")), "counts")
    ranked = places.join(_lean(counts, n_terms), "word")
    rarest = Window.partitionBy("phrase").orderBy("count", "word", "within")
    # a window with a word that the documents do not have occurs nowhere
    dead = F.min("count").over(Window.partitionBy("phrase")) == 0
    picked = ranked.withColumn("dead", dead).withColumn("rank", F.row_number().over(rarest)).where("rank <= 2 and not dead")
    picked = picked.groupBy("item", (F.col("begin") + F.col("within")).alias("at"), "word").agg(F.min(F.least(F.lit(2), F.col("length"))).alias("need"))
    picked = stored(picked, "picked")
    n_picked = picked.count()
    terms = stored(picked.select("word").distinct().withColumn("term", F.xxhash64("word")), "terms")
    index = stored(postings(docs, terms, n_picked), "postings")
    asked = picked.select("item", "at", "need", F.xxhash64("word").alias("term"))
    aligned = index.join(_lean(asked, n_picked), "term").select("key", "item", (F.col("pos") - F.col("at")).alias("shift"), "at", "need")
    aligned = aligned.groupBy("key", "item", "shift").agg(F.count_distinct("at").alias("agree"), F.min("need").alias("need")).where("agree >= need")
    aligned = stored(aligned.select("key", "item", "shift"), "aligned")
    begins = phrases.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("begin", "phrase"))).alias("begins"))
    named = stored(rows.join(aligned.select("item").distinct(), "item", "left_semi").join(begins, "item"), "named")
    n_words = named.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    per_key = aligned.groupBy("key").agg(F.count("*").alias("n"))
    lengths = named.select("item", F.size("words").alias("length"))
    dealt = aligned.join(_lean(lengths, n_words), "item").join(per_key, "key").withColumn("chunk", F.expr(f"pmod(xxhash64(item, shift), (n + {CHUNK - 1}) div {CHUNK})"))
    dealt = dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct("item", "shift", "length")).alias("places"))
    found = docs.join(per_key.select("key"), "key", "left_semi").select("key", words(F.col("text")).alias("doc")).dropDuplicates(["key"])
    along = lambda p: F.struct(p["item"].alias("item"), p["shift"].alias("shift"), F.slice("doc", F.greatest(p["shift"], F.lit(0)) + 1, p["length"] + F.least(p["shift"], F.lit(0))).alias("part"))
    cut = dealt.join(found, "key").select("key", F.explode(F.transform("places", along)).alias("p")).select("key", "p.*")
    tested = cut.join(_lean(named, n_words), "item")
    agree = F.transform("words", lambda w, i: F.coalesce(F.get("part", i + F.least(F.col("shift"), F.lit(0))) == w, F.lit(False)))
    length = F.least(F.size("words"), F.lit(window))
    hit = F.filter("begins", lambda b: ~F.exists(F.slice("agree", b["begin"] + 1, length), lambda x: ~x))
    tested = tested.withColumn("agree", agree).select("key", "shift", length.alias("length"), F.explode(hit).alias("b"))
    return tested.select("key", "b.phrase", (F.col("b.begin") + F.col("shift")).alias("first"), "length"), owners


def row_key(doc_id: Column, text: Column) -> Column:
    """One value for rows equal in doc_id and text; others share one only if their doc_id is the same and 64-bit hashes of their texts collide."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("digest"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, n_hit, n_items, items_sha256 and contaminated; other columns of ``docs`` are left out.

    A window has ``window`` consecutive words of an item, or all of them if it has
    fewer; a document's word is hit if it lies inside any occurrence of a window. Items
    without an id or without words are ignored; rows with the same item_id are one
    item. Null and empty texts have no words and are clean; rows equal in doc_id
    and text have equal results; a null doc_id is kept as it is. An empty table on either side is fine. A text is one row with
    an array of its words, so a very long one takes that memory in a task; its alignments and hits are rows of their own.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    matches, owners = phrase_matches(keyed.select("key", "text"), items, window)
    matches = stored(matches, "matches")
    hits = matches.select("key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = matches.select("key", "phrase").distinct().join(owners, "phrase").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_doc = stored(hits.join(named, "key"), "hits")
    counted = keyed.select("doc_id", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    out = counted.join(per_doc, "key", "left")
    none = F.array().cast("array<string>")
    names = F.coalesce("items", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def proximity_matches(docs: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """(key, first_pos, second_pos) where ``second`` begins at most ``within`` words from ``first``, either way, in ``docs`` (key, text).

    The two terms' postings meet by document; each is dealt to blocks of ``within``
    words, so that a pair is formed only from neighbouring blocks.
    """
    spark = docs.sparkSession
    terms = spark.createDataFrame([(t,) for t in {first.lower(), second.lower()}], "word string").withColumn("term", F.col("word"))
    index = postings(docs, terms, 2, lambda text: F.transform(words(text), lambda w: F.lower(w)))
    step = F.lit(max(1, within))
    a = index.where(F.col("term") == first.lower()).select("key", F.col("pos").alias("first_pos"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.col("pos") / step))).alias("block"))
    b = index.where(F.col("term") == second.lower()).select("key", F.col("pos").alias("second_pos"), F.floor(F.col("pos") / step).alias("block"))
    return a.join(b, ["key", "block"]).where(f"abs(first_pos - second_pos) between 1 and {int(within)}").select("key", "first_pos", "second_pos")


def op3_query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hash(doc_id, text) k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) n, unnest(list_transform(range(0, len(w) - least(10, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(10, len(w))], ' '))) phrase FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, unnest(range(0, len(w) - n + 1)) pos, unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) phrase FROM (SELECT DISTINCT doc_id, k, w FROM d), lens WHERE len(w) >= n),
m AS (SELECT k, item_id, pos, dw.n FROM dw JOIN (SELECT DISTINCT item_id, n, phrase FROM bw) t ON dw.n = t.n AND dw.phrase = t.phrase),
h AS (SELECT k, count(DISTINCT p) n_hit FROM (SELECT k, unnest(range(pos, pos + n)) p FROM m) GROUP BY k),
i AS (SELECT k, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) names FROM m GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN i USING (k)
"""
