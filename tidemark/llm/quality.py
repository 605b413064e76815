"""Quality rules: simple counts, and a log-likelihood ratio of hashed n-grams.

All of it is DataFrame functions. A text's tokens (runs of letters and digits, runs of other signs) and pairs of
tokens are hashed into `BUCKETS` buckets. Two smoothed multinomials over the buckets are counted, one of the
trusted target (labelled good), one of the raw corpus (every document). A document's score is the mean of
log(target / raw) over its n-grams, so its length does not matter; the ratios are rounded to multiples of
1 / SCALE first, so sums are of integers and the verdict does not depend on the order of adding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Buckets of the hashed n-grams; units of the rounded log ratios; the target holds at most TRUSTED labelled documents.
BUCKETS, SCALE, TRUSTED = 1 << 14, 1 << 16, 20_000
#: Least mean log ratio of a document that stays.
THRESHOLD = -0.25
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def plain(text: Column) -> Column:
    """The text with each separator of words as a space: replacing signs one by one looks at bytes, where a pattern would look at characters."""
    return reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit(" ")), SPACES[1:], text)


def words(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def windows(hashes: Column, size: int = WINDOW) -> Column:
    """A hash for each window of values in order, as many as `hashes` has: the last ones have fewer values, so they are like no other."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, size))))


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order.

    Sorting (hash, place) brings equal windows together; each repeated window then adds the words up to the next one's begin.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(places: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(places, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(places, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")
        )

    one = F.transform(F.array(placed), again)  # an array of one value binds it, so it is not computed again
    return F.get(F.transform(one, covered), F.lit(0))


def base_counts(df: DataFrame, text: Column) -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of `text`."""
    told = df.withColumn("_plain", plain(text)).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    told = told.withColumn("_hashes", F.transform(words(F.col("_plain")), lambda w: F.xxhash64(w))).withColumn("_windows", windows(F.col("_hashes")))
    told = told.select(
        *df.columns,
        F.size("_hashes").cast("long").alias("n_words"),
        F.length(F.replace("_plain", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(repeated_words(F.col("_windows"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return told.withColumn("base_failed", failed)


def buckets(text: Column) -> Column:
    """Buckets of all single tokens and pairs of tokens of a text."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("short")
    pairs = lambda t: F.concat(F.transform(t, lambda x: bucket(x)), F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: bucket(F.get(t, i), x)))
    return F.get(F.transform(F.array(tokens), pairs), F.lit(0))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of at most `most` documents labelled good, those of the smallest hashes: a sample of bounded size."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, `ratios`: the rounded log(target / raw) of every bucket, by bucket, for documents as their buckets (_doc, _grams).

    Counts of the raw corpus cover every row of `df`. They are summed in each task before the shuffle, so at most BUCKETS rows
    leave a task. Without any trusted document the ratios are 0.
    """
    # a plain explode would be given a filter on the size of its array, for which the buckets are computed once more
    rows = df.join(F.broadcast(trusted_ids(labels).select(F.col("doc_id").alias("_doc"), F.lit(1).alias("_good"))), "_doc", "left")
    grams = rows.select("_good", F.explode_outer("_grams").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good"))
    every = df.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(F.broadcast(counts), "bucket", "left").na.fill(0)  # leaves out the null of texts without n-grams
    # one row of BUCKETS counts, whatever the size of the corpus
    all_ = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    ratio = lambda x: F.log((x["good"] + 1) / (F.col("n_good") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("n_raw") + BUCKETS))
    return all_.select(F.transform("c", lambda x: F.when(F.col("n_good") == 0, 0).otherwise(F.round(ratio(x) * SCALE)).cast("int")).alias("ratios"))


def scored(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: list[str] | None = None, store: bool = True) -> DataFrame:
    """(row, verdict) for every row of `df` (doc_id, text, ...): all of the row or its `columns`, and its base counts, score and kept, as structs.

    A null text counts as empty: it fails the base rules. score is null for a text without n-grams, which no verdict of the method
    rejects. Repeated rows and null ids are judged like others; other columns may have any names. An empty table has an empty result.

    With `store` texts are read and split once: rows, base counts and buckets, two bytes each, are kept in the shared folder for the corpus counts and for the
    scores. Without it, for rows that are large, nothing is kept: the corpus counts and the scores each read the texts.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in columns or df.columns))
    own = df.select(row.alias("row"), F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    grams = buckets(F.col("_text")).alias("_grams")
    if store:
        told = checkpointed(base_counts(own, F.col("_text")).select("*", grams).drop("_text"))
        ratios = log_ratios(told, labels)
    else:
        told = base_counts(own, F.col("_text")).select("*", grams)
        ratios = log_ratios(own.select("_doc", grams), labels)
    both = told.crossJoin(F.broadcast(ratios))  # a single row of BUCKETS numbers
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, b: a + F.get("ratios", b))
    both = both.withColumn("score", total / F.nullif(F.size("_grams"), F.lit(0)) / SCALE)
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    # an explode of one row: a filter on the verdict stays above it, instead of being pushed down with the counts written out in it again and again
    return both.select("row", F.explode(F.array(F.struct(*names, kept.alias("kept")))).alias("verdict"))


def passing(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that the rules keep, with all their columns; a null text counts as empty, which no rule keeps, and ids may be null or repeat."""
    return scored(df, labels, threshold, store=False).filter("verdict.kept").select("row.*")
