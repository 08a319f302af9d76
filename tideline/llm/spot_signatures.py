"""Document fingerprints by spot signatures, with DataFrame functions only (operator 2).

Wherever a common word stands, the chain of the next two content words (with the common words
between them) is a signature: prose has many, navigation and tables few. A document's fingerprint is
its set of signatures. Where spots are rare (fewer than one for every `RARE` words), single words join
the set, so that tables and lists can be told apart too.

Sets are compared by Jaccard similarity. The similarity join partitions sets by length: sets whose
lengths differ by more than the threshold's factor can't reach it, and of the others only those meet
that share one of their rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "als auch auf das dem den der des die ein eine er es für im ist mit nicht sie sich und von war wie zu "
    "au aux avec ce dans de du elle en et il la le les par pas pour que qui se sur un une "
    "al como con del el los las más no para por su una y"
).split()
RARE = 8
_ANCHOR = "(?:" + "|".join(sorted(set(COMMON_WORDS), key=lambda w: (-len(w), w))) + ")"
_SPOT = f"(?<= ){_ANCHOR} (?=((?:{_ANCHOR} )*+[^ ]+ (?:{_ANCHOR} )*+[^ ]+ ))"
BIN_ROWS, MOST_BINS, BUCKET_ROWS = 256, 1 << 20, 512


def signatures(text: Column) -> Column:
    """The distinct spot signatures of a text as sorted 64-bit numbers; null counts as empty, a text without words has none."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.transform(F.array(plain), _of_plain)[0]


def _of_plain(plain: Column) -> Column:
    spots = F.regexp_extract_all(plain, F.lit(_SPOT), 1)
    return F.transform(F.array(F.struct(spots.alias("spots"), F.split(F.trim(plain), " ").alias("words"))), _of_parts)[0]


def _of_parts(parts: Column) -> Column:
    words = F.filter(parts["words"], lambda w: w != "")
    rare = F.size(parts["spots"]) * RARE < F.size(parts["words"])
    short = F.size(parts["words"]) < 3
    chosen = F.when(rare | short, F.concat(parts["spots"], words)).otherwise(parts["spots"])
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda s: F.xxhash64(s))))


def as_text(signature: Column) -> Column:
    """A set of signatures as text: 16 hex digits each."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets without repetitions; 1 for two empty ones. Lengths alone decide where one is empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (total - both))


def binned(rows: DataFrame) -> DataFrame:
    """Adds bin: the smallest id that belongs to the row's bin of neighbouring ids, some BIN_ROWS rows (more in tables beyond MOST_BINS bins).

    Bins have one width at first; those that hold far more rows than others, as where a few ids lie far
    from the rest, are cut again between their own first and last id. A null id is in the last bin.
    """
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    bins = max(1, min(MOST_BINS, n // BIN_ROWS))
    held = max(BIN_ROWS, n // bins)
    width = -(-(hi - lo + 1) // bins)
    own = F.coalesce("doc_id", F.lit(hi))
    if bins == 1:
        return rows.withColumn("bin", F.lit(lo).cast("long"))
    rows = rows.withColumn("bin", own - F.pmod(F.pmod(own, F.lit(width)) - lo % width, F.lit(width)))
    for _ in range(4):
        filled = rows.groupBy("bin").agg(F.count("*").alias("n"), F.min(own).alias("a"), F.max(own).alias("b")).where(f"n > {16 * held} AND b > a")
        step = F.ceil((F.col("b").cast("double") - F.col("a").cast("double") + 1) / (F.col("n") / held)).cast("long")
        heavy = filled.select("bin", "a", F.greatest(step, F.lit(1)).alias("step"))
        if not heavy.limit(1).count():
            break
        # at most MOST_BINS / 16 bins hold 16 times the mean
        cut = F.when(F.col("a").isNotNull(), own - F.pmod(own - F.col("a"), F.col("step"))).otherwise(F.col("bin"))
        rows = rows.join(F.broadcast(heavy), "bin", "left").withColumn("bin", cut).drop("a", "step")
    return rows


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by ascending id (ties: by text; null ids last; after the last row the first).

    Bins of neighbouring ids are put together to buckets of some hundred rows, and the first row of
    each bucket is also sent to the bucket before: one shuffle, no global sort.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = binned(rows)
    hi = rows.agg(F.max("doc_id")).first()[0] or 0
    filled = rows.groupBy("bin").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(hi))).alias("head"))
    before = F.sum("n").over(Window.orderBy("bin")) - F.col("n")
    to_bucket = filled.select("bin", "head", F.floor(before / BUCKET_ROWS).alias("bucket"))
    heads = to_bucket.groupBy("bucket").agg(F.min("head").alias("head"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("head").alias("head_id"), F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(order)).alias("also"))
    # bins are at most some MOST_BINS rows, whatever the table's size
    dealt = rows.join(F.broadcast(to_bucket.select("bin", "bucket")), "bin").join(F.broadcast(heads), F.col("doc_id") == F.col("head_id"), "left")
    places = F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("bucket"), F.lit(1).alias("guest")))
    dealt = dealt.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())).alias("p"))
    return dealt.select("doc_id", "text", F.col("p.bucket").alias("bucket"), F.col("p.guest").alias("guest")).repartition("bucket")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all)
    of the next document's. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    A null text is an empty one; a text without letters and digits has an empty fingerprint, alike (1)
    only to another empty one; null ids come last in the order, rows with equal ids are ordered by
    text; a single row is its own next; an empty table gives an empty table; other columns are not read.
    """
    rows = with_next(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("own", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.withColumns({"next": F.lead("text").over(order), "next_own": F.lead("own").over(order)}).where("guest = 0")
    q = F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - q), F.substring(F.col("next"), F.lit(1), q)))
    rows = rows.withColumn("edited_own", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def similar_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of different fingerprints a < b with their similarity of at least threshold, and each document's fingerprint's representative.

    Documents with equal fingerprints are one class, named by its smallest id, and not paired with each
    other. A set's signatures are ordered from the rarest; sets that reach the threshold share one of
    the first n - ceil(threshold * n) + 1 of both. Lengths are partitioned by powers of 1 / threshold
    and only equal or neighbouring parts meet. Empty fingerprints, null texts and null ids are in no
    pair; empty tables give empty results.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), signatures(F.col(f"`{text_col}`").cast("string")).alias("own"))
    rows = rows.where("size(own) > 0 AND doc_id IS NOT NULL")
    classes = rows.groupBy("own").agg(F.min("doc_id").alias("rep"))
    members = rows.join(classes, "own").select("doc_id", "rep")
    part = F.floor(F.log(F.size("own").cast("double")) / math.log(1 / threshold) + 1e-9)
    sets = classes.select("rep", "own", F.size("own").alias("n"), part.alias("part"))
    spread = sets.select("rep", "n", "part", F.explode("own").alias("signature"))
    common = spread.groupBy("signature").agg(F.count("*").alias("df"))
    ranked = spread.join(common, "signature").groupBy("rep", "n", "part").agg(F.array_sort(F.collect_list(F.struct("df", "signature"))).alias("ranked"))
    prefix = F.slice("ranked", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    heads = ranked.select("rep", "n", "part", F.explode(prefix["signature"]).alias("signature"))
    x = heads.select(F.col("rep").alias("a"), F.col("n").alias("na"), "signature", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("meet"))
    y = heads.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "signature", F.col("part").alias("meet"))
    fits = (F.col("nb") >= F.col("na")) & (F.col("na") >= threshold * F.col("nb")) & ((F.col("nb") > F.col("na")) | (F.col("b") > F.col("a")))
    met = x.join(y, ["signature", "meet"]).where(fits).select("a", "b").distinct()
    full = sets.select("rep", "own")
    joined = met.join(full.withColumnsRenamed({"rep": "a", "own": "oa"}), "a").join(full.withColumnsRenamed({"rep": "b", "own": "ob"}), "b")
    pairs = joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("oa"), F.col("ob")).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold), members
