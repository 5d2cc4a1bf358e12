import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from seriesforge.llm import mixing
from seriesforge.llm.quality_rules import STOP_WORDS
from seriesforge.llm.tokens import Encoder, vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus():
    """Chains of near copies, passages inside other texts, and texts for each quality rule."""
    rng = random.Random(17)
    fresh = lambda n: [("the" if i % 9 == 4 else f"w{rng.randrange(10**5)}") for i in range(n)]
    out = []
    for _ in range(36):
        family = [fresh(104)]
        for _ in range(5):
            nxt = list(rng.choice(family))
            for j in rng.sample(range(100), rng.randint(1, 3)):
                nxt[j] = f"n{rng.randrange(10**6)}"
            family.append(nxt + fresh(rng.choice((0, rng.randint(3, 25)))))
        out += [" ".join(x) for x in family]
        out.append(" ".join(fresh(40) + family[0][20:50] + fresh(40)))
    good = fresh(80)
    out += [None, "", "too short", " ".join(good[:5] * 16), " ".join(x + " # *" for x in good), " ".join(x for x in good if x != "the"),
            "\n".join([" ".join(good), *["the same line"] * 9]), " ".join(x * 12 for x in good), "é ".join(good), "é ".join(good) + " end"]
    rng.shuffle(out)
    return [(i, t, None, f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]


def good(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    often = Counter(grams)
    repeated = {j + k for j, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = max(len(w), 1)
    return (len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 2 <= sum(map(len, w)) / n <= 25
            and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.25 and sum(x in STOP_WORDS for x in w) / n >= 0.01
            and (len(lines) - len(set(lines))) / max(len(lines), 1) <= 0.6)


def representatives(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = {tuple(x.lower() for x in w[j : j + 5]) for j in range(len(w) - 4)}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i for i in sets if label[i] == i}


def without_earlier(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = t.encode()
        own = [b[j : j + 50] for j in range(len(b) - 49)]
        off = bytearray(len(b))
        for j, x in enumerate(own):
            if x in seen:
                off[j : j + 50] = b"\1" * 50
        seen.update(own)
        if left := bytes(c for c, o in zip(b, off) if not o).decode(errors="ignore"):
            out[i] = left
    return out


def test_stages_by_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made, keep = {}, corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: made.setdefault(name, keep(df, name)))
    gone = []
    monkeypatch.setattr(corpus_pipeline, "forget", lambda *tables: gone.extend(tables))  # the stages are read below
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, df in made.items()}
    assert gone == list(made.values())[:-1]  # each stage but the last goes once the next is there
    texts = {i: t for i, t, *_ in rows}
    kept = dict(got["quality-rules"])
    assert sorted(got["quality-rules"]) == sorted((i, t) for i, t in texts.items() if good(t))
    apart = dict(got["n-gram-Jaccard-join"])
    assert sorted(got["n-gram-Jaccard-join"]) == sorted((i, kept[i]) for i in representatives(kept)) and len(apart) < len(kept)
    left = dict(got["suffix-array-dedup"])
    assert sorted(got["suffix-array-dedup"]) == sorted(without_earlier(apart).items()) and left != apart
    assert all(r["n_chars"] == len(r["text"]) for r in made["suffix-array-dedup"].collect())
    # Mixing: rows unchanged, each as often as taken / size, rounded down or up (its draw is a hash).
    copies = Counter(got["mixing-sources"])
    share = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix_documents(made["suffix-array-dedup"]).collect()}
    assert set(copies) <= set(left.items())
    assert all(np.floor(s) <= copies[i, left[i]] <= np.ceil(s) for i, s in share.items())
    # Packing: every token of every copy stands in one piece.
    plain = Encoder.of(vocabulary()).tokenizer
    want = Counter()
    for (i, t), n in copies.items():
        want.update({(i, j): n for j in range(len(plain.encode(t, add_special_tokens=False).ids) + 1)})
    assert Counter((r["doc_id"], j) for r in packed for j in range(r["start"], r["start"] + r["length"])) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
