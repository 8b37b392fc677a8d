import random

from pyspark.sql import functions as F

from quarrymill.llm import scratch, simhash


def test_near_copies_come_from_the_grid_of_fingerprints(spark):
    """Without any class, texts are linked by fingerprints and verified sets: long ones with a word changed are, those of far fingerprints or of few common shingles aren't."""
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(600)] for _ in range(12)]
    texts = [" ".join(b) for b in bases]
    texts += [" ".join([*b[:k], "changed", *b[k + 1 :]]) for b in bases for k in (100, 300, 500)]
    docs = scratch.save(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "docs")
    place = docs.metadataColumn("_metadata")
    rows = docs.select(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"), "text")
    marks = [(*simhash._marks(r["text"], 5), r["file"], r["row"]) for r in rows.collect()]
    distinct = spark.createDataFrame([(*m[:3], [], *m[4:]) for m in marks], "id long, size long, print long, bands array<long>, file long, row long")
    got = {r["id"]: r["root"] for r in simhash.similar(rows, scratch.save(distinct, "distinct")).collect()}
    # by hand: links of near fingerprints and of similar sets
    sets = [set(simhash.shingles(simhash._words(t), 5).tolist()) for t in texts]
    near = lambda i, j: ((marks[i][2] ^ marks[j][2]) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = list(range(len(texts)))
    for _ in texts:
        for i in root:
            for j in range(len(texts)):
                if near(i, j):
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(marks[i][0])
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g} and len(got) > 20
