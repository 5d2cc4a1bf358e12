"""What the operators share: hashes of words, and the folders of work tables."""

import random
import threading
import zlib

import numpy as np
from pyspark.sql import functions as F

from seriesforge.llm import arrays, common, jaccard, packing, passages
from seriesforge.llm.tokens import Encoder, vocabulary


def colliding_words(n):
    """Pairs of words of 16 visible letters on which mix(h ^ lane), taken eight bytes at a time, gives one hash."""
    rng, out = random.Random(3), []
    visible = range(33, 127)
    pair = {x: [(a, a ^ x) for a in visible if a ^ x in visible] for x in range(128)}
    seed = arrays.mix(np.array([16], np.uint64) * arrays._M1)
    lane = lambda w: np.frombuffer(w, "<u8")
    while len(out) < n:
        a, b = (bytes(rng.choices(visible, k=8)) for _ in range(2))
        apart = (arrays.mix(seed ^ lane(a)) ^ arrays.mix(seed ^ lane(b))).tobytes()
        if all(x < 128 and pair[x] for x in apart):
            ends = [rng.choice(pair[x]) for x in apart]
            one, two = a + bytes(x for x, _ in ends), b + bytes(y for _, y in ends)
            assert (arrays.mix(arrays.mix(seed ^ lane(one[:8])) ^ lane(one[8:])) == arrays.mix(arrays.mix(seed ^ lane(two[:8])) ^ lane(two[8:]))).all()
            out.append((one.decode(), two.decode()))
    return out


def test_words_that_an_unkeyed_mixer_confuses(spark):
    """They are distinct words everywhere: ids are the tokenizer's, nothing is removed, and the documents don't link."""
    pairs = colliding_words(30)
    texts = [" ".join(a for a, _ in pairs), " ".join(b for _, b in pairs)]
    _, _, h = arrays.words(" ".join(texts).encode(), key=arrays.secret())
    assert len(set(h.tolist())) == 60
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    plain = Encoder.of(vocabulary()).tokenizer
    for r in packing.pack(docs).collect():
        ids = np.array([*plain.encode(texts[r["doc_id"] - 1], add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert {r["n_removed"] for r in passages.remove_passages(docs).collect()} == {0}
    assert {r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1, 2}


def test_word_hashes_depend_on_the_key():
    """Words up to the longest, by pieces of every length: equal words agree, others don't, and keys give unrelated hashes."""
    rng = random.Random(1)
    known = ["".join(rng.choices("abé", k=n)) for n in [*range(1, 40), 255, 256, 257, 511, 512, 513, 900] for _ in range(4)]
    known += [w + "\x00" for w in known[:40]] + ["\x00" * n for n in range(1, 20)]
    text = " ".join(known * 2).encode()
    one, two = (arrays.words(text, key=k)[2] for k in (arrays.secret(), arrays.secret()))
    n = len(known)
    assert (one[:n] == one[n:]).all() and len(set(one.tolist())) == len(set(known)) == len(set(two.tolist()))
    assert not set(one.tolist()) & set(two.tolist())
    # half of the bits differ, in either half of the hash
    for half in (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)):
        flips = [bin(int((a ^ b) & half)).count("1") for a, b in zip(one[: n - 1], one[1:n], strict=True)]
        assert 14 < np.mean(flips) < 18
    low = arrays.words(b"ABc abC", lower=True, key=arrays.secret())[2]
    assert low[0] == low[1]


def test_scratch_folders_belong_to_their_thread(spark):
    """Two queries side by side: the one that ends first leaves the other's tables alone; kept folders go with the outer scope."""
    made, ready, done = {}, threading.Barrier(2), threading.Event()

    def first():
        with common.scratch(spark):
            made["first"] = common.stored(spark.range(5), "one")
            ready.wait(60)
        done.set()

    def second():
        with common.scratch(spark):
            made["second"] = common.stored(spark.range(7), "two")
            ready.wait(60)
            done.wait(60)
            made["count"] = made["second"].count()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert made["count"] == 7
    exists = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df.folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df.folder))
    assert not exists(made["first"]) and not exists(made["second"])
    with common.scratch(spark):
        with common.scratch(spark) as keep:
            inner = common.stored(spark.range(3), "three")
            keep.add(inner.folder)
        assert exists(inner) and inner.agg(F.count("*")).first()[0] == 3
    assert not exists(inner)


def test_buckets_follow_the_text_and_not_its_files(spark, tmp_path):
    """40 MB of text in a small file: two buckets and more."""
    spark.range(40).select("id", F.expr("repeat('many words of one kind ', 45600)").alias("text")).write.option("compression", "zstd").parquet(f"{tmp_path}/d")
    docs, before = spark.read.parquet(f"{tmp_path}/d"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert common.text_width(docs) == common.text_bytes(docs) // common.TEXT_BYTES == 2
        assert common.text_width(docs.limit(0)) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
