import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import (arrays, doubling, flac, jaccard, media, mixing, ordering, packing, passages, quality_rules, substrings,
                             url_filter, weak_labels)
from seriesforge.llm.tokens import Encoder, vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, periodic, repeated and near-equal texts; columns whose names operators use inside."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base, shared = text(300), text(45)
    texts = [None, "", "one", "a b c d", "A b C d", "of " * 90, "ab " * 40, base, base, base.replace(" ", "  ", 1), base + " end of it",
             text(20_000), shared + "\n" + text(60), text(70) + "\n" + shared, text(30) + " " + shared + " " + text(30), "\n\n", "x\x85y　z " * 30]
    texts += [" ".join(w if rng.random() > 0.03 else "edit" for w in base.split()) for _ in range(12)]
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, None, "b", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.fixture(scope="session")
def hard(spark):
    """Null doc_ids, repeated rows, words on which polynomial hashes collide, nested passages, and names used inside."""
    rng = random.Random(23)
    t, swap = thue_morse(2048), str.maketrans("ab", "ba")
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = [t, t.translate(swap), t, " ".join(t), " ".join(t.translate(swap)), "z" * 3000, "z" * 3001]
    for _ in range(8):
        head = words(60)
        texts += [" ".join(head), *[" ".join(words(5) + head[20 : 20 + n] + words(5)) for n in (20, 29, 29)], " ".join(words(9) + head[7:] + words(9))]
    rows = [(i, x, f"s{i % 4}", 1, "k", 2, "p") for i, x in enumerate(texts)]
    rows += [(3, texts[3], "s3", 1, "k", 2, "p"), (12, texts[12], None, 1, "k", 2, "p"), (12, "another text of twelve", None, 1, "k", 2, "p")]
    rows += [(None, texts[9], "s1", 1, "k", 2, "p"), (None, None, None, 1, "k", 2, "p"), (None, "no id here", "s2", 1, "k", 2, "p")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int, _rest string, chunk int, _copy string").cache()


def ordered_texts(df):
    """(doc_id, text) by doc_id, nulls first, then text."""
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()))


def test_quality_rules(odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    for i, t in texts_of(odd):
        w = WORD.findall(t)
        g = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often, cover = Counter(g), set()
        for j, x in enumerate(g):
            cover |= {j, j + 1, j + 2} if often[x] > 1 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/x?y", "https://a.example.com/en/", "http://b.net/es/1", "http://net/fr/", "http://x.org/en/", None, "nothing", "http://example.com/EN/", "http://badexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, url_filter.default_rules(spark)).collect()}
    assert [got[i][1:] for i in range(9)] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"),
        (None, "allow"), (None, "allow"), ("com/", "allow"), ("com/", "allow")]
    wide = url_filter.url_filter(pages, url_filter.default_rules(spark), filter_bytes=0)
    assert {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in wide.collect()} == got
    accent = spark.createDataFrame([("block", "ÉA.Com", "/")], "verdict string, host string, path string")
    more = spark.createDataFrame([(1, "http://x.Éa.com/y"), (2, "http://x.éa.com/y")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_filter(more, accent).collect()} == {1: "block", 2: "allow"}
    assert url_filter.url_filter(pages.limit(0), accent).count() == 0
    # Repeated rows, null ids, one host of most pages.
    hot = spark.createDataFrame([(i if i % 7 else None, f"http://a.net/es/{i}" if i % 3 else "http://b.org/") for i in range(4000)], "page_id long, url string")
    judged = url_filter.url_filter(hot.unionAll(hot), url_filter.default_rules(spark))
    assert judged.count() == 8000 and judged.filter("verdict = 'block'").count() == 2 * sum(1 for i in range(4000) if i % 3)
    none = url_filter.default_rules(spark).limit(0)
    assert {r["verdict"] for r in url_filter.url_filter(pages, none).collect()} == {"allow"}


def test_packing(odd, empty):
    plain = Encoder.of(vocabulary()).tokenizer
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in texts_of(odd)}
    rows = packing.pack(odd).collect()
    back = {i: [0] * len(x) for i, x in ids.items()}
    sequences = {}
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and len(ids[r["doc_id"]]) == r["doc_tokens"]
        for j in range(r["start"], r["start"] + r["length"]):
            back[r["doc_id"]][j] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(x == 1 for c in back.values() for x in c)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty).count() == 0
    steps = {}  # the groups of one partition hold nearly the same
    for r in rows:
        own = steps.setdefault(r["step_id"] >> 36, Counter())
        own[r["step_id"]] += r["length"]
    assert all(max(c.values()) <= 1.1 * min(c.values()) for c in steps.values())


def test_packing_of_hard_rows(hard):
    """Words on which polynomial hashes collide, null doc_ids and repeated rows get the tokenizer's ids."""
    plain = Encoder.of(vocabulary()).tokenizer
    want = Counter()
    for i, t in ordered_texts(hard):
        want.update(((i, j, x) for j, x in enumerate([*plain.encode(t, add_special_tokens=False).ids, 1])))
    rows = packing.pack(hard).collect()
    length = Counter()
    for r in rows:
        length[r["doc_id"]] += r["length"]
    assert sum(length.values()) == sum(want.values())
    for i, t in enumerate([thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)


def without_phrases(rows):
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t)
        off = bytearray(len(w))
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            if x in seen:
                off[j : j + 20] = b"\1" * 20
            seen.add(x)
        out.append((i, len(w), sum(off), hashlib.sha256(" ".join(x for x, o in zip(w, off) if not o).encode()).hexdigest()))
    return Counter(out)


@pytest.fixture
def width(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passages(odd, hard, empty):
    for df in (odd, hard):
        assert Counter(map(tuple, passages.remove_passages(df).collect())) == without_phrases(ordered_texts(df))
    assert passages.remove_passages(empty).count() == 0


@pytest.mark.parametrize("width", [1, 2, 16, 64], indirect=True)
def test_passages_do_not_depend_on_the_buckets(spark, hard, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, hard):
        assert Counter(map(tuple, passages.remove_passages(df).collect())) == without_phrases(ordered_texts(df))


def test_passages_first_inside_longer_runs(spark):
    """A passage stands first in the middle of a document, then at the start of later ones: the first stays."""
    rng = random.Random(11)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for _ in range(12):
        header = text(60)
        docs += [text(50) + header + text(50), *[header + text(30) for _ in range(5)], text(20) + header[5:50] + text(20)]
    seen, want = set(), {}
    for i, w in enumerate(docs):
        off = bytearray(len(w))
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            if x in seen:
                off[j : j + 20] = b"\1" * 20
            seen.add(x)
        want[i] = (len(w), sum(off), hashlib.sha256(" ".join(x for x, o in zip(w, off) if not o).encode()).hexdigest())
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in passages.remove_passages(df).collect()} == want


def without_substrings(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256): strings count if a smaller doc_id (null: least) has them."""
    least, out = {}, []
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - length + 1):
            least.setdefault(b[j : j + length], i)
    for i, t in rows:
        b = t.encode()
        off = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if least[b[j : j + length]] != i:
                off[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if off[j] and not (j and off[j - 1]))
        out.append((i, len(b), sum(off), spans, hashlib.sha256(bytes(c for c, o in zip(b, off) if not o)).hexdigest()))
    return Counter(out)


def test_substrings(odd, hard, empty):
    for df in (odd, hard):
        assert Counter(map(tuple, substrings.remove_substrings(df).collect())) == without_substrings(ordered_texts(df))
    assert substrings.remove_substrings(empty).count() == 0
    assert substrings.dedup_substrings(empty).count() == 0
    assert substrings.dedup_substrings(odd).columns == odd.columns
    left = substrings.dedup_substrings(hard)
    assert left.columns == hard.columns and left.filter("doc_id IS NULL").count() == 2
    assert {r["p"] if "p" in r else r["_copy"] for r in left.collect()} == {"p"}


@pytest.mark.parametrize("width", [1, 3, 40], indirect=True)
def test_substrings_do_not_depend_on_the_buckets(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ordered_texts(docs)
    assert Counter(map(tuple, substrings.remove_substrings(docs).collect())) == without_substrings(rows)


@pytest.mark.parametrize("length", [28, 32, 33, 50, 70])
def test_doubling_by_brute_force(spark, length):
    """Many strings that share 16 or 32 bytes and differ later; pieces of several documents and buckets."""
    rng = random.Random(length)
    parts = ["".join(rng.choices("ab", k=16)) for _ in range(6)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 12)))[rng.randint(0, 9) :]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, substrings.remove_substrings(docs, length, gram=min(20, length - 8)).collect()))
    assert got == without_substrings(rows, length)
    with pytest.raises(ValueError):
        doubling.steps(15)


def test_doubling_in_turns(spark, monkeypatch):
    """The pairs of a few tasks at a time, of which few lie on disk together; the result is the same."""
    assert [doubling.turns(n << 20, 500 << 20, 40) for n in (0, 50, 51, 200, 10_000)] == [1, 1, 2, 4, 40]
    monkeypatch.setattr(doubling, "turns", lambda text, most, width: 4)
    tables, real = [], doubling.stored
    monkeypatch.setattr(doubling, "stored", lambda df, name: tables.append(name) or real(df, name))
    test_doubling_by_brute_force(spark, 50)
    made = Counter(x for x in tables if x.startswith(("told", "rank")))
    assert made == {"told-16": 4, **{f"{t}-{n}": 2 for t, n in (("rank", 16), ("told", 32), ("rank", 32), ("told", 50), ("rank", 50))}}


@pytest.mark.parametrize("gram", [27, 28])
def test_passages_without_a_common_window_are_not_doubled(spark, monkeypatch, gram):
    """49 bytes in common are too few; with the key's gram and a half of the rest to a side, all windows are found."""
    rng, sent, real = random.Random(gram), [], doubling.repeated
    noise = lambda n: "".join(rng.choices("abcdefgh", k=n))
    monkeypatch.setattr(doubling, "repeated", lambda state, *a: sent.append(state.agg(F.sum(F.length("text"))).first()[0] or 0) or real(state, *a))

    def run(size, often):
        rows = []
        for i in range(often):
            common = noise(size)
            rows += [(2 * i + j, noise(30 + i % 50) + common + noise(60)) for j in range(2)]
        got = substrings.remove_substrings(spark.createDataFrame(rows, "doc_id long, text string"), gram=gram)
        assert Counter(map(tuple, got.collect())) == without_substrings(rows)

    run(36, 100)
    assert sent.pop() == 0  # the gram and 8 bytes
    run(50, 200)
    run(51, 200)
    assert all(sent)


def test_bytes_without_ranges():
    rng = random.Random(1)
    for n in range(200):
        raw = bytes(rng.randrange(256) for _ in range(n % 40))
        first = [rng.randint(0, len(raw) - 1) for _ in range(n % 6)] if raw else []
        end = [min(len(raw), x + rng.randint(1, 9)) for x in first]
        off = [any(a <= i < b for a, b in zip(first, end, strict=True)) for i in range(len(raw))]
        spans = sum(1 for i, x in enumerate(off) if x and not (i and off[i - 1]))
        assert substrings.without(raw, first, end) == (bytes(c for c, x in zip(raw, off, strict=True) if not x), sum(off), spans)


def test_equal_hashes_of_unequal_pairs(monkeypatch):
    monkeypatch.setattr(arrays, "mix", lambda h: h * np.uint64(0))
    a, b = np.array([1, 2, 1, 2, 1], np.uint64), np.array([7, 7, 7, 7, 8], np.uint64)
    order, new, _ = doubling.grouped(a, b << np.uint64(60) & np.uint64(0) | b, 3)
    groups = np.cumsum(new) - 1
    name = dict(zip(order.tolist(), groups.tolist()))
    assert name[0] == name[2] != name[1] == name[3] and len({name[0], name[1], name[4]}) == 3


@pytest.mark.parametrize("local", [2, 2048])
def test_jaccard(odd, empty, local, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL_ROWS", local)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts_of(odd):
        w = WORD.findall(t.translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}
    if local > 2:
        assert jaccard.keep_representatives(odd).columns == odd.columns
        assert {r["doc_id"] for r in jaccard.keep_representatives(odd).collect()} == {i for i in label if label[i] == i}
        assert jaccard.keep_representatives(empty).count() == 0
        assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_odd_rows(hard):
    """Colliding polynomial hashes link nothing; rows without doc_id are part of nothing; repeated rows stay."""
    got = Counter(map(tuple, jaccard.jaccard_components(hard).collect()))
    first = {}
    want = Counter()
    for i, t in ordered_texts(hard):
        w = WORD.findall(t)
        s = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
        if i is not None and s:
            first[s] = min(first.get(s, i), i)
    rows = [(i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
            for i, t in ordered_texts(hard) for w in [WORD.findall(t)]]
    sets = [s for s in first]
    label = {s: first[s] for s in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(a & b) >= 75 * len(a | b):
                    label[a] = label[b] = min(label[a], label[b])
    # one doc_id may have rows of several sets; each row is a node of its own set
    for i, s in rows:
        want[(i, len(s), None if i is None else label[s] if s else i)] += 1
    assert got == want
    kept = jaccard.keep_representatives(hard)
    assert kept.columns == hard.columns and kept.filter("doc_id IS NULL").count() == 3


@pytest.fixture(scope="session")
def chains():
    """Families of texts whose links form chains: each is the one before with some words changed."""
    rng = random.Random(5)
    out = []
    for family in range(40):
        words = [f"w{family}x{i}" for i in range(104)]
        own = [list(words)]
        for _ in range(5):
            nxt = list(rng.choice(own))
            for j in rng.sample(range(100), rng.randint(1, 3)):
                nxt[j] = f"n{rng.random()}"
            if rng.random() < 0.5:  # a larger set: it may be no core document
                nxt += [f"m{rng.random()}" for _ in range(rng.randint(3, 25))]
            own.append(nxt)
        rng.shuffle(own)
        out += [" ".join(x) for x in own]
    return out


def shingles(text):
    w = text.split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def labels_of(sets):
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


@pytest.mark.parametrize("local", [2, 2048])
def test_jaccard_chains(spark, chains, local, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL_ROWS", local)
    p = [f"w{i}" for i in range(104)]
    one, more = list(p), [f"m{i}" for i in range(30)]
    one[50] = "edit"  # p and l link; x holds all of l, links to l, and not to p
    texts = [*chains, " ".join(p), " ".join(one), " ".join(one + more)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == labels_of(sets)


def test_jaccard_rounds(spark, monkeypatch):
    """Regions of documents that share a phrase and are far apart end after a few pivots; what is left is joined block by block."""
    monkeypatch.setattr(jaccard, "LOCAL_ROWS", 8)
    rounds, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: (rounds.append(name), stored(df, name))[1])
    rng = random.Random(3)
    phrases = [[f"p{i}x{j}" for j in range(20)] for i in range(24)]
    texts = [a + b for i, a in enumerate(phrases) for b in phrases[i + 1 :]]
    texts += [x[:-1] + [f"n{i}"] for i, x in enumerate(rng.sample(texts, 60))]
    rng.shuffle(texts)
    texts = [" ".join(x) for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == labels_of({i: shingles(t) for i, t in enumerate(texts)})
    assert 3 <= rounds.count("members") <= 7


@pytest.mark.parametrize("core_x", [False, True])
def test_carve_tests_ended_core_documents(core_x):
    """The middle link of the chain 1 - 3 - 4 - 2, and one from a core document to another."""
    at = [0, 30, 10, 20]  # ids 1, 2, 3, 4: places in a sliding window; 10 apart is a distance of 0.18
    sets = [np.arange(x, x + 100, dtype=np.uint64) for x in at]
    edges = jaccard.carve(np.array([1, 2, 3, 4]), sets, np.array([True, core_x, True, True]))
    label = {i: i for i in range(1, 5)}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert set(label.values()) == {1}


def test_mixing(odd, empty):
    rows = mixing.mix_documents(odd).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_documents(odd).collect()))
    sizes = {i: len(WORD.findall(t)) for i, t in texts_of(odd)}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    target = {}
    for r in rows:
        target.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    assert sum(t for t, _ in target) == pytest.approx(sum(sizes.values()))
    assert all(t <= 3 * s + 1e-6 for t, s in target)
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.take_mix(odd).columns == odd.columns
    assert mixing.take_mix(empty).count() == 0


def targets_of(sizes, weights=(1, 2, 3), most=3):
    """By rounds: targets above `most` times the size stop there, the excess goes to the others by weight."""
    names = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, {s for s in names if sizes[s]}, float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else share * weight[s]
        left -= sum(most * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return target


@pytest.mark.parametrize("sizes", [{"a": 20_000, "b": 10, "c": 5}, {"a": 20, "b": 10, "c": 5}, {"a": 1, "b": 1, "c": 3000, "d": 700, "e": 64, "f": 65}])
def test_mixing_meets_its_targets(spark, sizes):
    """Each source is within a block of its target, counted word by word; targets by a model of their own."""
    rows, rng = [], random.Random(4)
    for s, n in sizes.items():
        while n:
            k = min(n, rng.randint(1, 400))
            rows.append((len(rows), " ".join(["w"] * k), s))
            n -= k
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want, taken = targets_of(sizes), Counter()
    for r in got:
        s = rows[r["doc_id"]][2]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"]
        assert (r["first_shard"] is None) == (r["taken"] == 0)
    assert all(abs(taken[s] - want[s]) <= 64 for s in sizes), (taken, want)


def test_mixing_by_a_model_of_the_slots(spark):
    """taken, recomputed from the slots; every slot once, shards full but for the last, draws spread over them."""
    mix = mixing.Mix(block=4, shard=16)
    rows = [(i, " ".join(["w"] * (1 + 7 * i % 23)), f"s{i % 4}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix_documents(docs, mix).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    wanted = spark.createDataFrame([("0" + s, n, got[int(s[1:])]["target"]) for s, n in sizes.items()], "skey string, source_size long, target double")
    slots = mixing.mixed_slots(mixing.allotted(wanted, mix), mix, 4).collect()
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    assert all(r["shard"] == r["slot"] // 16 for r in slots)
    times = Counter((r["skey"], r["block"]) for r in slots)
    for s, n in sizes.items():
        blocks = -(-n // 4)
        own = [times["0" + s, b] for b in range(blocks)]
        assert max(own) - min(own) <= 1 and sum(x for (k, _), x in times.items() if k == "0" + s) == sum(own)
        # words taken of the source: each block's words as often as its slots
        words = sum(c * (4 if b < blocks - 1 else n - 4 * (blocks - 1)) for b, c in enumerate(own))
        assert words == sum(r["taken"] for i, r in got.items() if rows[i][2] == s)
    assert len({r["shard"] for r in slots if r["skey"] == "0s1"}) > len(slots) // 32


def test_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        assert sorted(ordering.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
        got = spark.range(n).select(F.lit(n).cast("long").alias("n"), F.col("id").alias("k"), F.lit(5).cast("long").alias("key"))
        assert sorted(r[0] for r in got.select(mixing.permuted("k", "n", "key", 12)).collect()) == list(range(n))


def test_ordering(odd, hard, empty):
    spec = ordering.Order(vocabulary(), stride=16, shard_slots=64)
    rows = ordering.slot_digests(odd, spec).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    plain = Encoder.of(vocabulary()).tokenizer
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in texts_of(odd)}
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["byte_offset"] == 32 * (r["slot"] % 64)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    made = ordering.shards(*ordering.in_training_order(odd, spec), spec)
    assert [r["slot"] for r in ordering.resume(made, 70, spec).collect()] == list(range(70, len(rows)))
    assert ordering.slot_digests(empty, spec).count() == 0
    # The order is that of the documents' contents, not of files, splits or buckets.
    assert sorted(map(tuple, ordering.slot_digests(odd.repartition(3, "text"), spec).collect())) == sorted(map(tuple, rows))
    again = ordering.slot_digests(hard, spec).collect()
    want = Counter()
    for i, t in ordered_texts(hard):
        own = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.update((i, s, len(own[s : s + 16]), zlib.crc32(own[s : s + 16].tobytes())) for s in range(0, len(own), 16))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in again) == want
    assert ordering.resume(made, len(rows), spec).count() == 0


def test_flac_round_trip_and_damage():
    rng = random.Random(3)
    tone = bytes(int(128 + 100 * np.sin(i * 1.3)) for i in range(9000))
    cases = [b"a" * 64, bytes(64), bytes(range(256)), rng.randbytes(9000), tone, bytes(5000) + b"\xff" + bytes(100), b"x", "née ".encode() * 90,
             bytes([0, 255] * 3000), bytes(4096) + b"a"]
    s = flac.encode(cases)
    pcm = flac.decode(s.data, s.start)
    assert pcm.payloads() == cases and (pcm.kind >= 32).any() and (pcm.kind == 0).any() and (pcm.kind == 1).any()
    for i, c in enumerate(cases):
        one = s.data[s.start[i] : s.start[i + 1]]
        for sample in {0, len(c) // 2, len(c) - 1}:
            first, block = flac.read_block(one, sample)
            assert first == sample // flac.BLOCK * flac.BLOCK and block == c[first : first + flac.BLOCK]
        with pytest.raises(ValueError):
            flac.read_block(one, len(c))
    for at in (3, 30, 50, 60, 100, 3000, len(s.data) - 4):
        bad = bytearray(s.data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode(bytes(bad), s.start)
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20, (1 << 31) - 1):
        assert flac.read_utf8_number(flac.utf8_number(n), 0) == (n, len(flac.utf8_number(n)))


def plain_flac(data):
    """A FLAC reader of its own, bit by bit: samples as bytes, and the kinds of the frames."""
    info, at = int.from_bytes(data[18:26], "big") & ((1 << 36) - 1), 4
    while True:
        last, at = data[at] >> 7, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        if last:
            break
    bits = "".join(f"{b:08b}" for b in data[at:])
    p, out, kinds = 0, [], []

    def take(n):
        nonlocal p
        p += n
        return int(bits[p - n : p], 2) if n else 0

    signed = lambda n: (lambda v: v - (1 << n) if v >> (n - 1) else v)(take(n))
    while len(out) < info:
        assert take(16) == 0xFFF8 and take(16) == 0x7002
        first = take(8)
        while first & 0x80 and first & 0x40:
            first = (first << 1) & 0xFF
            take(8)
        n = take(16) + 1
        take(8)
        kind = take(8) >> 1
        kinds.append(kind)
        if kind == 0:
            x = [signed(8)] * n
        elif kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(order)]
            c, shift = [(), (1,), (2, -1)][order] if kind < 32 else (), 0
            if kind >= 32:
                precision = take(4) + 1
                shift = signed(5)
                c = [signed(precision) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            while len(x) < n:
                q = bits.index("1", p) - p
                p += q + 1
                u = q << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        p = -(-p // 8) * 8 + 16
        out += x
    return bytes(v + 128 for v in out), kinds


def test_media(odd, hard, empty):
    for df in (odd, hard):
        want = Counter()
        for i, t in ordered_texts(df):
            p, n = media.payload(t)
            s = flac.encode([p])
            back, kinds = plain_flac(s.data)
            assert back == p
            x = [b - 128 for b in p]
            of = "/".join(str(sum(1 for k in kinds if a <= k < b)) for a, b in ((0, 1), (1, 2), (8, 32), (32, 64)))
            turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
            want[(i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(s.data), hashlib.sha256(s.data).hexdigest(),
                  f"frames={of};min={min(x)};max={max(x)};sum={sum(x)};energy={sum(v * v for v in x)};turns={turns}")] += 1
        assert Counter(map(tuple, media.media_digests(df).collect())) == want
    assert media.media_digests(empty).count() == 0 and media.media_blocks(media.encode_media(empty)).count() == 0
    stream = media.encode_media(odd.filter("doc_id = 11"))
    blocks = sorted(media.media_blocks(stream).collect(), key=lambda r: r["sample_offset"])
    p, whole = media.payload(dict(texts_of(odd))[11])[0], stream.first()["media"]
    assert b"".join(r["pcm"] for r in blocks) == p and len(blocks) > 10
    assert all(flac.read_block(whole, r["sample_offset"]) == (r["sample_offset"], r["pcm"]) for r in blocks)


def test_weak_labels(spark, odd, empty):
    assert weak_labels.classify(odd).count() == odd.count()
    assert weak_labels.classify(empty).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = weak_labels.classify(docs).join(labels, "doc_id").toPandas()
    assert ((m.score > 0.5) == (m.quality == 1)).mean() > 0.93
    assert m[(m.quality == 1) & (m.toxic == 0)].kept.mean() > 0.97


def test_toxicity_is_learned_in_every_language(spark, odd, empty):
    """Learns from the labels of even documents; judged on odd ones. One such word in clean text rejects nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    more = spark.createDataFrame([(-1, " ".join(["the best of all that is and was in this place"] * 3))], "doc_id long, text string")
    clean = docs.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").filter("lang = 'en' AND length(text) > 3000").orderBy("doc_id").limit(20)
    mention = clean.selectExpr("-2 - doc_id AS doc_id", "concat('trash ', text) AS text")
    both = docs.select("doc_id", "text").unionByName(more).unionByName(mention)
    got = weak_labels.classify(both, labels=labels.filter("doc_id % 2 = 0")).cache()
    m = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    caught = (m[m.toxic == 1].toxicity > 0.5).groupby(m.lang).mean()
    print(caught.to_dict(), (m[m.toxic == 0].toxicity > 0.5).groupby(m.lang).mean().to_dict())
    assert len(caught) == 4 and caught.min() > 0.4, caught
    assert not m[(m.toxic == 1) & (m.toxicity > 0.5)].kept.any()
    assert m[(m.quality == 1) & (m.toxic == 0)].kept.mean() > 0.95
    assert got.filter("doc_id < -1 AND kept").count() > 15
    assert got.filter("toxicity IS NULL").count() == 0
    assert weak_labels.classify(odd, labels=labels.filter("toxic = 0")).filter("toxicity IS NOT NULL").count() == 0
    assert weak_labels.classify(empty, labels=labels).count() == 0


def test_hashes_and_packing_of_numbers():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64))
    assert (arrays.unpack_ascending(arrays.pack_ascending(x), 100) == x).all()
    start, end, h = arrays.words("a  bé\tab ab\n".encode())
    assert [(s, e) for s, e in zip(start, end)] == [(0, 1), (3, 6), (7, 9), (10, 12)] and h[2] == h[3]


def test_estimation_by_a_model_document_by_document():
    """The same expectation-maximisation in plain loops over documents, without counting patterns."""
    rng = random.Random(8)
    docs = []
    for _ in range(400):
        good = rng.random() < 0.7
        docs.append(tuple(2 if rng.random() < 0.3 else int(good if rng.random() < right else not good) for right in (0.95, 0.8, 0.7, 0.6)))
    post = {d: 0.2 if 2 * d.count(0) >= d.count(1) else 0.9 for d in docs}
    for _ in range(60):
        prior = (sum(post[d] for d in docs) + 1) / (len(docs) + 2)
        right = {}
        for j in range(4):
            for label in (0, 1):
                weight = [(post[d] if label else 1 - post[d], d[j]) for d in docs if d[j] != 2]
                right[j, label] = (sum(w for w, v in weight if v == label) + 1) / (sum(w for w, _ in weight) + 2)
        new = {}
        for d in set(docs):
            p = [1 - prior, prior]
            for j, v in enumerate(d):
                for label in (0, 1):
                    if v != 2:
                        p[label] *= right[j, label] if v == label else 1 - right[j, label]
            new[d] = p[1] / (p[0] + p[1])
        post = new
    counts = Counter("".join(map(str, d)) for d in docs)
    names = sorted(counts)
    got, accuracy, share = weak_labels.estimate(names, [counts[n] for n in names])
    assert got == pytest.approx([post[tuple(map(int, n))] for n in names], abs=1e-9) and share == pytest.approx(prior)
    assert all(accuracy[j, label] == pytest.approx(right[j, label]) for j in range(4) for label in (0, 1)) and accuracy[0].mean() > accuracy[3].mean()


def test_classifier_on_hard_rows(spark, hard):
    """Repeated rows and null doc_ids are scored each; a doc_id of hundreds of rows doesn't swell the sample."""
    many = spark.createDataFrame([(5, f"the text number {i} of the one document")  for i in range(300)], "doc_id long, text string")
    docs = hard.select("doc_id", "text").unionByName(many)
    assert weak_labels.classify(docs, weak_labels.Training(sample=50)).count() == docs.count()
    sample = weak_labels._sampled(docs, docs.count(), 50)
    assert len(sample) == 50 and sorted(map(str, sample)) == sorted(map(str, weak_labels._sampled(docs.repartition(3), docs.count(), 50)))


def test_stage_functions_on_hard_rows(spark, hard, empty):
    for stage in (quality_rules.keep_good, jaccard.keep_representatives, substrings.dedup_substrings, mixing.take_mix):
        assert stage(hard).columns == hard.columns and stage(empty).count() == 0
    filler = [("the" if i % 9 == 4 else f"w{i * i % 997}") for i in range(80)]
    rows = [(None, " ".join(filler), 1), (7, " ".join(filler), 2), (7, " ".join(filler), 2), (8, " ".join(filler[:40]), 3), (9, None, 4), (10, " ".join(filler[:5] * 16), 5)]
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, kept int"))
    assert Counter((r["doc_id"], r["kept"]) for r in kept.collect()) == {(None, 1): 1, (7, 2): 2}
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.take_mix(hard).collect())
    assert all(n <= 3 * 2 and i is not None for (i, _), n in mixed.items())  # repeated rows: three times each at most
