"""Benchmark decontamination with DataFrame functions only.

A hash set of the benchmark's normalised word windows is broadcast (behind a count; beyond the limit Spark
shuffles both sides on the window instead), the windows of the documents are probed against it by the whole
normalised string, so that a hit is verified by equality, and hit documents or hit words can be removed.

Defined cases: null or wordless documents have no words and no hits; benchmark rows without words
are ignored, and those with a null id have windows, but are no item that is named or counted; each of several equal rows gets its own result; columns other than the id and
the text are not read; an empty benchmark or an empty table gives zero hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import ascii_lower, let, sized, stored

#: A run of letters, digits and characters beyond ASCII, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows that may be broadcast: at about 200 bytes each, half a gigabyte.
MAX_BROADCAST = 2_000_000


def words(text: Column) -> Column:
    """The normalised words; of null, none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(found, ascii_lower)


def _windows(found: Column, length: Column | int) -> Column:
    """array<struct<gram, start, width>> of all windows of the given length; start counts words from 0."""
    last = F.size(found) - length
    each = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.array_join(F.slice(found, i + 1, length), " ").alias("gram"),
            i.alias("start"),
            F.lit(length).cast("int").alias("width") if isinstance(length, int) else length.alias("width"),
        ),
    )
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<gram:string,start:int,width:int>>"))


def benchmark_windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(gram, width, items): every window with the ids of the items that hold it; a shorter item is one window."""
    rows = benchmark.select(
        F.col(item).alias("item"),
        F.explode(
            let(
                words(F.col(text)),
                lambda w: let(
                    F.least(F.size(w), F.lit(window)),
                    lambda n: F.when(n > 0, _windows(w, n)).otherwise(F.array().cast("array<struct<gram:string,start:int,width:int>>")),
                ),
            )
        ).alias("w"),
    )
    return rows.groupBy(F.col("w.gram").alias("gram"), F.col("w.width").alias("width")).agg(F.collect_set("item").alias("items"))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(doc, text_hash, n_words, hit_words, items) for every row of docs.

    hit_words: sorted positions, from 0, of the words that lie in an occurrence of a window; items: the ids of
    the items with such windows. text_hash tells rows of one id with different texts apart.
    """
    grams = stored(benchmark_windows(benchmark, item=item, text=item_text, window=window), "grams")
    sizes = {r["width"]: r["n"] for r in grams.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    row = F.col("row")

    def probes(w: Column) -> Column:
        # the first entry holds the number of words; its key has a character that no word has
        total = F.array(F.struct(F.concat(F.lit("#"), row.cast("string")).alias("gram"), F.size(w).alias("start"), F.lit(0).alias("width")))
        return F.concat(total, *[_windows(w, n) for n in sorted(sizes)])

    keyed = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    probed = keyed.select("doc", "text_hash", "row", F.explode(let(words(F.col("text")), probes)).alias("p")).select("doc", "text_hash", "row", "p.*")
    table = grams.select("gram", "items")
    if sum(sizes.values()) <= max_broadcast:
        table = F.broadcast(table)
    hits = probed.join(table, "gram", "left").where(F.col("items").isNotNull() | (F.col("width") == 0))
    hit = F.col("items").isNotNull()
    return (
        hits.groupBy("doc", "text_hash", "row")
        .agg(
            F.max(F.when(F.col("width") == 0, F.col("start"))).cast("long").alias("n_words"),
            F.collect_list(F.when(hit, F.sequence(F.col("start"), F.col("start") + F.col("width") - 1))).alias("spans"),
            F.collect_list("items").alias("item_lists"),
        )
        .select(
            "doc",
            "text_hash",
            "n_words",
            F.array_sort(F.array_distinct(F.flatten("spans"))).alias("hit_words"),
            F.array_distinct(F.flatten("item_lists")).alias("items"),
        )
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns of docs stay."""
    bad = sized(scan(docs, benchmark, doc=doc, text=text, **options).where(F.size("hit_words") > 0).select("doc", "text_hash").distinct())
    same = docs[doc].eqNullSafe(bad["doc"]) & (F.xxhash64(docs[text]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the hit words taken out of the text; what stands between words stays."""
    bad = (
        scan(docs, benchmark, doc=doc, text=text, **options)
        .where(F.size("hit_words") > 0)
        .select("doc", "text_hash", "hit_words")
        .dropDuplicates(["doc", "text_hash"])
    )
    same = docs[doc].eqNullSafe(bad["doc"]) & (F.xxhash64(docs[text]) == bad["text_hash"])
    kept = let(
        F.regexp_extract_all(docs[text], F.lit(f"({WORD})"), F.lit(1)),
        lambda w: F.array_join(
            F.transform(
                F.arrays_zip(F.split(docs[text], WORD, -1).alias("gap"), w.alias("word")),
                lambda z, i: F.concat(
                    F.coalesce(z["gap"], F.lit("")),
                    F.when(F.array_contains(bad["hit_words"], i), F.lit("")).otherwise(F.coalesce(z["word"], F.lit(""))),
                ),
            ),
            "",
        ),
    )
    cut = F.when(bad["hit_words"].isNull(), docs[text]).otherwise(kept)
    return docs.join(bad, same, "left").select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    from trailspark.llm.common import table

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS u,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM g),
p AS (
  SELECT u, i, l, array_to_string(w[i:i + l - 1], ' ') AS gram
  FROM (SELECT u, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, lens WHERE len(w) >= l)),
h AS (SELECT u, i, p.l, item_id FROM p JOIN g ON p.gram = g.gram),
hw AS (SELECT u, count(DISTINCT pos) AS n_hit FROM (SELECT u, unnest(generate_series(i, i + l - 1)) AS pos FROM h) GROUP BY u),
hi AS (SELECT u, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT u, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.u = hw.u LEFT JOIN hi ON d.u = hi.u
"""
