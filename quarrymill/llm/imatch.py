"""I-Match document fingerprints, in DataFrame functions only.

Terms are runs of letters and digits, lower case, told apart by 62 bits of their hash. A term's document frequency is counted exactly, over all documents. A document
keeps its distinct terms within a band of inverse document frequencies: those that at least two documents have and at most a given share of all. Without any, it
keeps those below the band too; without these too, all its terms.

The kept terms, sorted, are hashed within randomised lexicon subsets. On level l the lexicon falls into 64 * 4 ** l parts at random, of which 64 are subsets that
are hashed. A document is on the level at which a subset has about one of its terms, and has the hashes of the subsets of its level and of the next finer one: so
documents whose numbers of terms are within a factor of four have a level in common. Two documents are alike by the share of equal hashes among the subsets of that
level in which either has a term. Only terms within a document's subsets, about 64 at most, are kept from step to step.

No term is sent to the documents that have it. Terms above the band are few (fewer than a document's mean number of terms / most_share) and part of the plan; a
term below it is in one document, which the count names, so a document gets the list of its own; all others are in the band. Only words that the edit of a text makes
at its seams are looked up.

The next document in order of ids is found within ranges of ids, so neither a global sort in one task nor a second shuffle of
the texts is needed: each range gets, as a last row, the first document of the range that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Bits of a term's hash, subsets of a level, levels.
BITS, SUBSETS, LEVELS = 62, 64, 5


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.transform(found, lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - BITS)))


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, n, one): how many rows of (digest, text) have the term, and the digest of one of them."""
    return rows.select("digest", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.min("digest").alias("one"))


def level_of(found: Column) -> Column:
    """The first level at which a subset has no more than one of found on average, or the last."""
    return F.coalesce(*(F.when(F.size(found) <= SUBSETS << 2 * i, i) for i in range(LEVELS - 1)), F.lit(LEVELS - 1))


def within(level: str, found: str) -> Column:
    """found without the terms that are in none of the level's subsets."""
    return F.expr(f"filter({found}, h -> h < shiftleft({SUBSETS}L, {BITS - 6} - 2 * {level}))")


def signatures(df: DataFrame, level: str, kept: str, name: str) -> DataFrame:
    """df with the column name, struct<level, coarse, fine> of the terms within the level's subsets in the column kept, in place of both. 0 in coarse and fine: no term there."""
    for part in ("coarse", "fine"):
        shift = f"({BITS - 6 - 2 * (part == 'fine')} - 2 * {level})"
        # the subsets' lower bounds among their terms: a subset is what lies between two of them
        df = df.withColumn("_bounds", F.expr(f"transform(sequence(0L, {SUBSETS}L), v -> shiftleft(v, {shift}))"))
        df = df.withColumn("_all", F.expr(f"array_sort(concat(filter({kept}, h -> h < shiftleft({SUBSETS}L, {shift})), _bounds))"))
        df = df.withColumn("_places", F.expr("transform(_bounds, b -> int(array_position(_all, b)))"))
        hashes = f"transform(sequence(0, {SUBSETS - 1}), v -> if(_places[v + 1] > _places[v] + 1, pmod(hash(slice(_all, _places[v] + 1, _places[v + 1] - _places[v] - 1)), 65535) + 1, 0))"
        df = df.withColumn(f"_{part}", F.expr(hashes))
    made = F.struct(F.col(level).alias("level"), F.col("_coarse").alias("coarse"), F.col("_fine").alias("fine"))
    return df.withColumn(name, made).drop(kept, level, "_bounds", "_all", "_places", "_coarse", "_fine")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal hashes throughout; else the equal ones among those that either has on the finer of the two levels, 0 without any."""
    top = F.greatest(a["level"], b["level"])
    x, y = (F.when(s["level"] == top, s["coarse"]).when(s["level"] == top - 1, s["fine"]) for s in (a, b))
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != 0)), lambda z: z))
    some = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != 0) | (q != 0)), lambda z: z))
    return F.when(a == b, 1.0).otherwise(F.when(x.isNotNull() & y.isNotNull() & (some > 0), same / some).otherwise(0.0))


def shown(signs: Column) -> Column:
    """The level, then the hashes of the subsets in 4 hex digits each."""
    parts = F.transform(F.concat(signs["coarse"], signs["fine"]), lambda x: F.lpad(F.hex(x.cast("long")), 4, "0"))
    return F.lower(F.concat(signs["level"].cast("string"), F.array_join(parts, "")))


def _range(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below key, by a search in two steps; 0 for null."""
    if not bounds:
        return F.lit(0)
    step = 64
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, bounds[step - 1 :: step])) or str(max(bounds))), ",").cast("array<bigint>")
    if len(bounds) < step:
        return F.coalesce(F.size(F.filter(listed, lambda b: b < key)), F.lit(0))
    blocks = F.size(F.filter(coarse, lambda b: b < key))
    return F.coalesce(blocks * step + F.size(F.filter(F.slice(listed, blocks * step + 1, F.lit(step)), lambda b: b < key)), F.lit(0))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (key, text, digest) with next_text: the text of the next row in descending order of keys, nulls last, equal ones by text; of the first row for the last."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("key", shares, 100_000).alias("b")).first()["b"] if shares else None
    rows = rows.withColumn("range", _range(F.col("key"), sorted(set(found or []))))
    # the first document of each range, a copy of which ends the range before it in descending order
    tops = rows.groupBy("range").agg(F.max("key").alias("top"))
    heads = rows.join(F.broadcast(tops), ["range"]).where(F.col("key").eqNullSafe(F.col("top"))).groupBy("range").agg(F.min("text").alias("text"))
    around = Window.orderBy("range")  # one row for each range
    ghosts = heads.select(F.coalesce(F.lead("range").over(around), F.min("range").over(Window.partitionBy())).alias("range"), "text").select(F.lit(None).cast("long").alias("key"), "text", "range", F.lit(True).alias("ghost"))
    all_rows = rows.select("key", "text", "range", F.lit(False).alias("ghost")).union(ghosts)
    order = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("key"), "text")
    return all_rows.withColumn("next_text", F.lead("text").over(order)).where(~F.col("ghost"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", most_share: float = 0.02) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in
    descending order of keys, after the last one the first; equal keys order by text, null keys come last. A null text counts as empty; texts without terms have
    no hashes and are alike. Equal texts have equal fingerprints. Other columns are ignored, whatever their names. Very long texts are cut into terms whole. An empty table gives an empty one.
    The texts are shuffled once, then their terms' hashes once. Texts are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    counts = scratch.save(frequencies(rows), "terms")
    most = most_share * docs.count()
    common = [r["term"] for r in counts.where(F.col("n") > most).select("term").collect()]
    in_band = lambda found: F.filter(found, lambda h: ~h.isin(common)) if common else found
    kept = F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))")
    edited = F.concat(kept, F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    placed = _placed(rows).withColumn("edited", edited)
    for name, of in (("t", "text"), ("e", "edited"), ("n", "next_text")):
        placed = placed.withColumn(f"{name}_all", terms(F.col(of)))
    placed = placed.select("key", "text", "edited", "next_text", "t_all", "e_all", "n_all", in_band(F.col("t_all")).alias("t"), in_band(F.col("e_all")).alias("e"))
    for name in ("t", "e"):
        placed = placed.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.col(f"{name}_all"))).withColumn(f"{name}_level", level_of(F.col(name)))
    placed = placed.select(
        "key", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("digest"), F.xxhash64("next_text").alias("next"), "t_level", "e_level",
        within("t_level", "t").alias("t"), within("e_level", "e").alias("e"), F.array_except(within("e_level", "e"), F.array_union("t_all", "n_all")).alias("seam"),
    )
    placed = scratch.save(placed, "placed")
    scratch.release(spark)
    # what lies below the band: words that one document alone has, and those at the seams that aren't in two
    pairs = placed.select("digest", "next").distinct()
    rare = counts.where("n = 1").select(F.col("one").alias("of"), "term")
    rare = pairs.join(rare, F.col("digest") == F.col("of")).select("digest", "next", "term").union(pairs.join(rare, F.col("next") == F.col("of")).select("digest", "next", "term"))
    seams = placed.select("digest", "next", F.explode("seam").alias("term")).distinct().join(counts.where("n > 1").select("term"), "term", "left_anti")
    gone = rare.union(seams.select("digest", "next", "term")).groupBy("digest", "next").agg(F.collect_list("term").alias("gone"))
    met = placed.drop("seam").join(gone, ["digest", "next"], "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<bigint>)")))
    for name in ("t", "e"):
        met = met.withColumn(f"{name}_in", F.array_except(name, "gone")).withColumn(name, F.when(F.size(f"{name}_in") > 0, F.col(f"{name}_in")).otherwise(F.col(name))).drop(f"{name}_in")
    met = signatures(signatures(met.drop("gone"), "t_level", "t", "signs"), "e_level", "e", "edited_signs")
    signed = scratch.save(met, "signatures")
    scratch.drop(placed, counts)
    of_next = signed.groupBy(F.col("digest").alias("next")).agg(F.first("signs").alias("next_signs"))
    out = signed.join(of_next, "next")
    return out.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", shown(F.col("signs")).alias("fingerprint"), shown(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
