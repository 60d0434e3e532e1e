"""What the near-copy join leaves on disk, and the order and bounds that keep its candidates few."""
import glob
import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from test_models import components_brute, key

from chatsieve.llm import jaccard_join
from chatsieve.llm.common import id_and_text, write_and_read
from chatsieve.session import ensure_checkpoint_dir


def shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return {b for b in blocks.split(",") if b.startswith("shuffle_")}


def near_copies(n=60):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(900)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(900)}"
        rows.append((i if i % 11 else None, " ".join(w)))
    return rows


def test_only_what_the_result_reads_stays_written(spark):
    rows = near_copies()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 4, 5)
    kinds = sorted(d.rsplit("-", 1)[0] for d in set(os.listdir(folder)) - before if glob.glob(f"{folder}/{d}/*.parquet"))
    assert kinds == ["jaccard-labels", "jaccard-names", "jaccard-rows"]
    assert key(out.collect()) == key(components_brute(rows, 1, 4, 5))


def test_shuffle_files_go_with_their_query(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_blocks(spark), spark.conf.get(setting)
    kept = spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
    written = write_and_read(kept, "test-shuffle")
    for _ in range(50):
        if shuffle_blocks(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_blocks(spark) <= before and spark.conf.get(setting) == was
    assert written.count() == kept.count() == 97


def test_common_words_seldom_make_regions(spark):
    """Unrelated texts share most of their word pairs, but not those of their rare words."""
    rnd = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(400):
        w = [rnd.choice(common) for _ in range(60)]
        for k in range(8):
            w[7 * k + 3] = f"rare{i}x{k}"
        rows.append((i, " ".join(w)))
    join = jaccard_join._Join(id_and_text(spark.createDataFrame(rows, "doc_id long, text string")), 2, 4, 5)
    assert join.regions().count() < 40


def test_slots_of_odd_count_differ_by_the_members_of_one_set_at_most(spark):
    rnd = random.Random(6)
    pairs = []
    for n in [1, 2, 31, 32, 33, 60, 64, 65, 400, 1000, 1024, 1025]:
        a = {rnd.getrandbits(62) for _ in range(n)}
        for share in (0, 0.03, 0.2):
            gone = set(rnd.sample(sorted(a), int(share * n)))
            b = (a - gone) | {rnd.getrandbits(62) for _ in range(rnd.choice((0, 1, len(gone))))}
            pairs.append((a, b))
    slots = [[[int(x) for x in jaccard_join.odd_slots(np.array(sorted(s), dtype=np.int64))] for s in p] for p in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(slots)], "i int, o1 array<long>, o2 array<long>")
    for r in df.select("i", jaccard_join._differing("o1", "o2").alias("d")).collect():
        a, b = pairs[r["i"]]
        assert r["d"] <= len(a ^ b) and (len(a ^ b) < 0.3 * len(a) or r["d"] > 0.4 * len(a ^ b)), (len(a), len(b), r["d"])


def test_listed_shingles_stay_within_their_bound(spark, monkeypatch):
    rows = [(" ".join(f"p{k}" for k in range(200 * (i % 7)))) + f" own{i} end{i}" for i in range(140)]
    sample = spark.createDataFrame([(t,) for t in rows], "text string")
    words = jaccard_join.word_levels(sample)
    whole = jaccard_join.frequent_shingles(sample, 3, words)
    assert len(whole[0]) > 1000 and list(whole[0]) == sorted(whole[0])
    for bound in (0, 1, 150, 300, 700, 1000):
        monkeypatch.setattr(jaccard_join, "FREQUENT", bound)
        codes, levels = jaccard_join.frequent_shingles(sample, 3, words)
        assert len(codes) <= bound and len(codes) == len(levels) and set(codes) <= set(whole[0])
    assert len(codes) > 500
