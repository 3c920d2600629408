"""Document fingerprints by spot signatures, on built-in functions only.

A text is lower-cased and reduced to its words. Common words are anchors; a
signature is an anchor with the content words that follow it, up to ``CHAIN``
words, and a longer run of content words goes on in further chains of that
length. The fingerprint is the set of distinct signatures, each as 12 hex
digits of its md5, in ascending order. Fingerprints are likened by Jaccard.

Results by case: null text counts as empty; the empty text has the empty
fingerprint, like only to itself; a text without any chain of two words has one
signature, the whole text; equal texts have equal fingerprints. In the order by
descending id, null ids come last and rows that share an id stand by their
text's hash; a single row is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHAIN = 4
# Anchors: articles, prepositions and other common words of the four languages.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it its not of on or that the their they this to was were which with you "
    "als an auf auch das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al con como del el ella es esta este las lo los más me mi no para pero por se si sin su una y"
).split()
ANCHOR_PATTERN = " (" + "|".join(sorted(set(ANCHORS))) + ") "
PIECE_PATTERN = r"[^ \n]+(?: [^ \n]+){0,%d}" % (CHAIN - 1)


def signatures(text: Column) -> Column:
    """Sorted distinct signatures of a text, as an array of strings."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    # every word between blanks of its own, so that anchors in a row are all found
    spaced = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(spaced, ANCHOR_PATTERN, "\n$1 "), " +", " ")
    chains = F.filter(F.regexp_extract_all(marked, F.lit(PIECE_PATTERN), F.lit(0)), lambda p: F.instr(p, " ") > 0)
    # bound once by the outer transform
    choose = lambda c: F.when(F.size(c) > 0, c).when(text == "", F.slice(c, 1, 0)).otherwise(F.array(F.concat(F.lit("\n"), text)))
    chosen = F.transform(F.array(chains), choose)
    hashed = F.transform(chosen, lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda s: F.substring(F.md5(s.cast("binary")), 1, 12)))))
    return hashed[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def length_partition(size: Column, threshold: float) -> Column:
    """Sets whose partitions differ by more than one cannot reach the threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """id, signatures and length partition of every row."""
    d = docs.select(F.col(f"`{id_col}`").alias(id_col), signatures(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("signatures"))
    return d.withColumn("length_partition", length_partition(F.size("signatures"), threshold))


def matches(prints: DataFrame, id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with Jaccard of at least ``threshold``: (a, b, likeness), named by a least id each.

    The smaller id is ``a``. Two different fingerprints under one id are a pair
    of that id with itself; one known only by rows without id is named null,
    in ``b`` if the other has an id.

    Equal fingerprints are one class. A set's rarest signatures (as many as
    leave less than the threshold's share) are its keys: two sets that match
    share a key, lie in the same or neighbouring length partitions and have
    sizes within the threshold of each other.
    """
    one = prints.filter(F.size("signatures") > 0).groupBy("signatures", "length_partition").agg(F.min(id_col).alias("id"))
    # a class is told by its set, as ids may repeat or be null
    one = one.select("id", F.md5(F.concat_ws(",", "signatures").cast("binary")).alias("class"), "signatures", "length_partition", F.size("signatures").alias("n"))
    each = one.select("class", "n", "length_partition", F.explode("signatures").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("f"))
    ranked = each.join(often, "s").withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("f", "s")))
    keys = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    keys = keys.withColumn("f", F.col("f")).filter("f > 1").select("class", "n", "length_partition", "s")
    left = keys.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("length_partition").alias("pa"), "s", F.explode(F.array(F.col("length_partition") - 1, "length_partition", F.col("length_partition") + 1)).alias("p"))
    right = keys.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("length_partition").alias("p"), "s")
    pairs = left.join(right, ["s", "p"]).filter("a < b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9).select("a", "b").distinct()
    x = one.select(F.col("class").alias("a"), F.col("id").alias("i"), F.col("signatures").alias("x"))
    y = one.select(F.col("class").alias("b"), F.col("id").alias("j"), F.col("signatures").alias("y"))
    greater = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), F.greatest("i", "j"))
    alike = likeness(F.col("x"), F.col("y")).alias("likeness")
    return pairs.join(x, "a").join(y, "b").select(F.least("i", "j").alias("a"), greater.alias("b"), alike).filter(F.col("likeness") >= threshold)


def _longs(values: list) -> Column:
    return F.expr("array(" + ", ".join("cast(null as bigint)" if v is None else f"cast('{v}' as bigint)" for v in values) + ")")


def _count_up_to(bounds: list[int], col: str) -> Column:
    """How many of the ascending bounds are at most the column (0 for null), searched on two
    levels: the cost per row grows with the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    coarse = F.size(F.filter(_longs([p[0] for p in parts[1:]] or [None]), lambda b: b <= F.col(col)))
    nested = F.array(*[_longs(p) for p in parts])
    fine = F.size(F.filter(F.get(nested, coarse), lambda b: b <= F.col(col)))
    return F.when(F.col(col).isNull(), 0).otherwise(coarse * step + fine)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sigs and those of the next row by descending id (after the last, the first): next_text, next_sigs.

    Ids are cut into ranges at approximate quantiles; each range is one sorted
    group, which also gets the first row of the range below it. Texts are
    shuffled once; the driver holds one bound and one id per range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    bounds = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    bucket = _count_up_to(bounds, "doc_id")
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    if not heads:
        return d.select("doc_id", "text", signatures(F.col("text")).alias("sigs"), F.col("text").alias("next_text")).withColumn("next_sigs", F.col("sigs"))
    # the head of each range also closes the range above it; the topmost head closes the lowest range
    first: list = [None] * (len(bounds) + 1)
    above: list = [None] * (len(bounds) + 1)
    for k, h in enumerate(heads):
        first[h.bucket], above[h.bucket] = h.head, heads[(k + 1) % len(heads)].bucket
    d = d.withColumn("bucket", bucket)
    head, goes = F.get(_longs(first), F.col("bucket")), F.get(_longs(above), F.col("bucket")).cast("int")
    homes = F.when(
        F.col("doc_id").eqNullSafe(head), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("extra")), F.struct(goes.alias("b"), F.lit(True).alias("extra")))
    ).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("extra"))))
    d = d.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", F.col("home.b").alias("bucket"), F.col("home.extra").alias("extra"))
    d = d.repartition(parts, "bucket").withColumn("sigs", signatures(F.col("text")))
    order = W.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    d = d.select("doc_id", "text", "sigs", "extra", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs"))
    return d.filter("not extra").drop("extra")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced from the next one, and their likeness."""
    d = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substring("next_text", F.lit(1), k)))
    d = d.withColumn("edited_sigs", signatures(F.col("edited")))
    return d.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.concat_ws("", "sigs").alias("fingerprint"),
        F.concat_ws("", "edited_sigs").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
