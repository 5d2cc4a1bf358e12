"""N-gram Jaccard join: a metric-space join of documents by their distinct word 5-grams.

Jaccard distance is a metric, but almost all documents are at distance 1 from any pivot, where
Voronoi regions tell nothing apart. So regions grow only around pivots that a document shares a
prefix shingle with: shingles are ordered by how many documents have them (rare first). Two
documents that link share one of the first n - ceil(0.75 n) + 1 of the larger and of the first
m - ceil(6 m / 7) + 1 of the smaller set (the prefix filter; 2 * 0.75 / 1.75 = 6 / 7). All documents
of one such shingle share its pivot, the least doc_id; those that hold it in the short prefix are
the region's core, and each link has an end there. In a region, distances to the
pivot are exact; documents within 0.25 link to it and so to each other's component. Core documents
among them are compared with those beyond 0.25 in their triangle window and leave; by the triangle
inequality only documents in the window around the rest's distances go on with the rest of the
core, which is joined recursively with a new pivot until nothing is left. Regions of more than
LOCAL_ROWS rows take a round over all data for each pivot, so only pivots that take many core
documents along get one: see ended(). Each round's links are written, so that plans do not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import arrays as A
from seriesforge.llm import recurrence as R
from seriesforge.llm.common import NO_ID, bucketed, join_split, runs, scratch, text_width, stored

U64 = np.uint64
WORDS = 5
#: Links are 100 * intersection >= SHARE * union.
SHARE = 75
#: Regions of at most so many rows are finished in one task.
LOCAL_ROWS = 2048
#: A larger region gets pivots until so many of them took fewer core documents than half of LOCAL_ROWS out of it.
MISSES = 4


def shingle_sets(texts: pa.Array, words: int = WORDS, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Per text its distinct shingles' hashes, ascending, one text after another; and the bounds."""
    values, sizes = [], []
    for low, high in runs(texts, 2 << 20):
        raw = [(x or "").encode() for x in texts.slice(low, high - low).to_pylist()]
        start, _, h = A.words(b"\n".join(raw), lower=True, key=key)
        edge = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in raw]))
        count = np.diff(edge)
        free = np.maximum(count - words + 1, 0)
        g = A.mix(A.grams(h, words))[A.ranges(edge[:-1], free)]
        doc = np.repeat(np.arange(len(raw)), free)
        short = [(i, A.mix(A.grams(h[edge[i] : edge[i + 1]], int(count[i])) + U64(count[i]))) for i in np.flatnonzero((count > 0) & (count < words)).tolist()]
        if short:
            g = np.concatenate((g, *[x for _, x in short]))
            doc = np.concatenate((doc, [i for i, _ in short]))
        order = np.argsort(g)
        order = order[A.by_small(doc[order], len(raw))]
        g, doc = g[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        values.append(g[new])
        sizes.append(np.bincount(doc[new], minlength=len(raw)))
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(values) if values else np.zeros(0, U64)), bounds.astype(np.int64)


KEYS = "kb int, bucket int, n long, keys binary, often binary"


def _count_keys(bucket: int, values: np.ndarray, width: int) -> pa.Table:
    key, often = np.unique(values >> A.key_shift(width), return_counts=True)
    to = (key % U64(width)).astype(np.int64)
    order = A.by_small(to, width)  # keys ascend already
    key, to, often = key[order], to[order], np.minimum(often[order], 255).astype(np.uint8)
    return R.table([(int(to[a]), bucket, b - a, A.pack_ascending(key[a:b] // U64(width)), often[a:b].tobytes()) for a, b in A.equal_runs(to)], KEYS)


def _judge_keys(sent: pa.Table) -> pa.Table:
    """Tell each bucket which of its shingles two documents or more have, and in how many (log2)."""
    rows = sent.to_pylist()
    key = np.concatenate([A.unpack_ascending(x["keys"], x["n"]) for x in rows])
    often = np.concatenate([np.frombuffer(x["often"], np.uint8) for x in rows])
    _, which = np.unique(key, return_inverse=True)
    total = np.bincount(which, often)[which]
    level = np.log2(total).astype(np.uint8)
    out, at = [], 0
    for x in rows:
        own = slice(at, at + x["n"])
        at += x["n"]
        on = total[own] > 1
        if on.any():
            out.append((x["kb"], x["bucket"], int(on.sum()), A.pack_ascending(key[own][on]), level[own][on].tobytes()))
    return R.table(out, KEYS)


FOUND = "doc_id long, n_shingles long, digest long, digest2 long, small long, prefix binary, items binary"
#: Equal sets: of equal size and digests.
SAME = ["digest", "digest2", "n_shingles"]


def _describe(group: pa.Table, replies: pa.Table, width: int, key: bytes) -> pa.Table:
    """Every document's set size and digest; prefix and set only where the prefix has a shared shingle."""
    if not group.num_rows:
        return R.table([], FOUND)
    ids, texts = R.in_order(group)
    values, bounds = shingle_sets(texts, key=key)
    parts = replies.to_pylist()
    known = [A.unpack_ascending(x["keys"], x["n"]) * U64(width) + U64(x["kb"]) for x in parts]
    known = np.concatenate(known) if known else np.zeros(0, U64)
    level = np.concatenate([np.frombuffer(x["often"], np.uint8) for x in parts]) if parts else np.zeros(0, np.uint8)
    order = np.argsort(known)
    known, level = known[order], level[order]
    at, shared = A.places(known, values >> A.key_shift(width))
    rank = np.where(shared, level[at] + 1 if len(level) else 0, 0)
    n = np.diff(bounds)
    digest, digest2 = (A.pieces(A.mix(values + U64(salt)), bounds[:-1], bounds[1:]).view(np.int64) for salt in (0, R.SALT))
    lone = np.concatenate(([0], np.cumsum(~shared)))
    lone = lone[bounds[1:]] - lone[bounds[:-1]]
    prefix = n - (SHARE * n + 99) // 100 + 1
    near = (n > 0) & (lone < prefix)
    rows = []
    for i in range(len(ids)):
        first = items = small = None
        if near[i]:
            s = values[bounds[i] : bounds[i + 1]]
            r = rank[bounds[i] : bounds[i + 1]]
            head = np.lexsort((s, s >> A.key_shift(width), r))[: prefix[i]]
            first, items = s[head][r[head] > 0].tobytes(), s.tobytes()
            small = max(0, int(n[i]) - (6 * int(n[i]) + 6) // 7 + 1 - int(lone[i]))
        rows.append((int(ids[i]), int(n[i]), int(digest[i]), int(digest2[i]), small, first, items))
    return R.table(rows, FOUND)


def describe(docs: DataFrame) -> DataFrame:
    """FOUND rows, one for each row of docs: NO_ID stands for a null doc_id, null texts have no shingles, repeated
    rows stay, an empty table gives none."""
    width, key = text_width(docs), A.secret()
    own = bucketed(docs, width, "text")

    def ask(group: pa.Table) -> pa.Table:
        return _count_keys(group.column("bucket")[0].as_py(), shingle_sets(R.in_order(group)[1], key=key)[0], width)

    replies = own.groupBy("bucket").applyInArrow(A.on_group(ask), KEYS).groupBy("kb").applyInArrow(A.on_group(_judge_keys), KEYS)
    return own.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(A.on_groups(lambda a, b: _describe(a, b, width, key)), FOUND)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in lists])),
             pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)),
             pa.array(np.concatenate([np.arange(len(x)) < n for x, n in zip(lists, batch.column("small").to_pylist(), strict=True)])
                      if lists else np.zeros(0, bool))], ["doc_id", "key", "core"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of documents to their pivots, from their sets."""
    for batch in batches:
        mine, theirs = batch.column("items").to_pylist(), batch.column("pivot_items").to_pylist()
        union, both = [], []
        for a, b in zip(mine, theirs, strict=True):
            x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
            n = int(A.places(y, x)[1].sum())
            both.append(n)
            union.append(len(x) + len(y) - n)
        keep = ["region", "doc_id", "core", "pivot"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(both, pa.int64()), pa.array(union, pa.int64())], [*keep, "shared", "either"])


EDGES = "a long, b long"
REACH = (100 - SHARE) / 100


def _shared(y: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How many shingles of y each of the sets holds."""
    hit = A.places(y, np.concatenate(sets))[1]
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)


def bridge(ids: np.ndarray, sets: list[np.ndarray], d: np.ndarray, star: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Links of what is linked to one pivot (star) with others, one for each of the others at most.

    star and others: places in ids, sets and d, the distances to the pivot.
    """
    edges = []
    sizes = np.array([len(x) for x in sets])
    for i in star.tolist():
        if not len(others):
            break
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        near = others[(np.abs(d[others] - d[i]) <= REACH + 1e-9) & (100 * low >= SHARE * high)]
        if not len(near):
            continue
        both = _shared(sets[i], [sets[j] for j in near.tolist()], sizes[near])
        on = near[100 * both >= SHARE * (sizes[near] + sizes[i] - both)]
        edges += [(int(ids[i]), int(ids[j])) for j in on]
        others = np.setdiff1d(others, on)
    return edges


def carve(ids: np.ndarray, sets: list[np.ndarray], core: np.ndarray) -> list[tuple[int, int]]:
    """Links among core documents and between core and others, enough to connect each component.

    The first core document is the pivot. Core documents that link to it are compared with all that
    do not and leave with it. Others stay only if their distance is in the triangle window of the
    core that is left. Then the next pivot.
    """
    edges = []
    while core.any():
        pivot = int(np.flatnonzero(core)[0])
        y = sets[pivot]
        sizes = np.array([len(x) for x in sets])
        both = _shared(y, sets, sizes)
        either = sizes + len(y) - both
        linked = 100 * both >= SHARE * either
        linked[pivot] = False
        edges += [(int(ids[pivot]), int(ids[i])) for i in np.flatnonzero(linked)]
        d = 1 - both / either
        unlinked = ~linked
        unlinked[pivot] = False
        edges += bridge(ids, sets, d, np.flatnonzero(core & linked), np.flatnonzero(unlinked))
        left = core & unlinked
        if not left.any():
            break
        slack = REACH + 1e-9
        stay = left | (~core & (d >= d[left].min() - slack) & (d <= d[left].max() + slack))
        at = np.flatnonzero(stay)
        ids, sets, core = ids[at], [sets[i] for i in at.tolist()], left[at]
    return edges


def _finish(group: pa.Table) -> pa.Table:
    group = group.sort_by("doc_id")
    sets = [np.frombuffer(x, U64) for x in group.column("items").to_pylist()]
    edges = carve(group.column("doc_id").to_numpy(), sets, group.column("core").to_numpy(zero_copy_only=False))
    return R.table(edges, EDGES)


def _bridged(group: pa.Table) -> pa.Table:
    group = group.sort_by("doc_id")
    sets = [np.frombuffer(x, U64) for x in group.column("items").to_pylist()]
    star = group.column("star").to_numpy(zero_copy_only=False)
    return R.table(bridge(group.column("doc_id").to_numpy(), sets, group.column("d").to_numpy(), np.flatnonzero(star), np.flatnonzero(~star)), EDGES)


def bridges(measured: DataFrame, items: DataFrame) -> DataFrame:
    """Links of core documents that are linked to their region's pivot with documents that are not.

    measured: region, doc_id, core, linked and d. Both sides are dealt into blocks, and each pair of
    blocks is compared in one task.
    """
    half = max(1, LOCAL_ROWS // 2)
    star = measured.filter("core AND linked")
    reach = star.groupBy("region").agg(F.max("d").alias("high"), F.ceil(F.count("*") / half).alias("n_star"))
    others = measured.filter("NOT linked").join(reach, "region").filter(F.col("d") <= F.col("high") + REACH + 1e-9)
    blocks = others.groupBy("region").agg(F.max("n_star").alias("n_star"), F.ceil(F.count("*") / half).alias("n_others"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        return side.select("region", "doc_id", "d").join(blocks, "region").select(
            "region", "doc_id", "d", F.lit(own == "star").alias("star"), F.pmod(F.xxhash64("doc_id"), f"n_{own}").alias(f"b_{own}"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(f"b_{other}"),
        )

    both = dealt(star, "star", "others").unionByName(dealt(others, "others", "star"))
    return both.join(items, "doc_id").groupBy("region", "b_star", "b_others").applyInArrow(A.on_group(_bridged), EDGES)


def ended(members: DataFrame, items: DataFrame) -> DataFrame:
    """Links of regions that need no further round: small ones, those of a small core, and those whose pivots take few with them.

    members: region, doc_id, core, n and n_core. Regions of more than LOCAL_ROWS rows are dealt into blocks of core documents and of
    others; a task joins a block of core documents with another block. Each link has an end in the core, so some task has both ends.
    """
    half = max(1, LOCAL_ROWS // 2)
    whole, core, others = f"n <= {LOCAL_ROWS}", f"ceil(n_core / {half})", f"ceil((n - n_core) / {half})"
    blocks = members.selectExpr("region", "doc_id", "core", f"if({whole}, 1L, {core}) AS cores", f"if({whole}, 1L, {core} + {others}) AS blocks")
    own = F.when(F.col("blocks") == 1, 0).when(F.col("core"), F.pmod(F.xxhash64("doc_id"), "cores")).otherwise(
        F.col("cores") + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.col("blocks") - F.col("cores"))))
    pairs = blocks.select("region", "doc_id", "core", "blocks", own.alias("own"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.when(F.col("core"), F.col("blocks")).otherwise(F.col("cores")) - 1)).alias("met"))
    return pairs.filter("own <> met OR blocks = 1").select(
        "region", "doc_id", "core", F.least("own", "met").alias("b_core"), F.greatest("own", "met").alias("b_other")
    ).join(items, "doc_id").groupBy("region", "b_core", "b_other").applyInArrow(A.on_group(_finish), EDGES)


def links(found: DataFrame) -> DataFrame:
    """(a, b): linked representatives of unequal sets, enough to connect every component.

    Rows without doc_id and without shingles take no part; of equal sets the least doc_id stands for all.
    """
    near = found.filter(F.col("items").isNotNull() & (F.col("doc_id") != NO_ID))
    reps = near.groupBy(*SAME).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    near = stored(near.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "small", "prefix", "items"), "near")
    keys = near.select("doc_id", "small", "prefix").mapInArrow(A.on_batches(_listed), "doc_id long, key long, core boolean")
    pivots = keys.groupBy("key").agg(
        F.min("doc_id").alias("region"), F.count("*").alias("n"), F.max("core").alias("any")
    ).filter("n > 1 AND any").select("key", "region", "n")
    prefixes = near.agg(F.sum(F.expr("octet_length(prefix) div 8"))).first()[0] or 0
    members = join_split(keys, pivots, ["key"], "n", prefixes).groupBy("region", "doc_id").agg(F.max("core").alias("core"))
    items = near.select("doc_id", "items")
    members = members.select("*", F.lit(None).cast("long").alias("before"), F.lit(0).alias("missed"))
    folders = []
    while True:
        members = stored(members, "members")
        half = max(1, LOCAL_ROWS // 2)
        sizes = members.groupBy("region").agg(
            F.count("*").alias("n"), F.count_if("core").alias("n_core"), F.min(F.when(F.col("core"), F.col("doc_id"))).alias("pivot"),
            (F.max("missed") + F.when(F.max("before") - F.count_if("core") < half, 1).otherwise(0)).alias("missed"),
        ).filter("pivot IS NOT NULL AND n > 1").withColumn(
            "ends", F.expr(f"n <= {LOCAL_ROWS} OR n_core <= {half} OR missed >= {MISSES}"))
        edges = ended(members.join(sizes.filter("ends").drop("pivot", "missed", "ends"), "region"), items)
        going = sizes.filter("NOT ends").select("region", "pivot", F.col("n_core").alias("before"), "missed")
        if going.isEmpty():
            folders.append(stored(edges, "links").folder)
            return found.sparkSession.read.schema(EDGES).parquet(*folders).distinct()
        large = members.drop("before", "missed").join(going.select("region", "pivot"), "region")
        measured = stored(large.filter("doc_id <> pivot").join(items, "doc_id").join(
            items.select(F.col("doc_id").alias("pivot"), F.col("items").alias("pivot_items")), "pivot"
        ).mapInArrow(A.on_batches(_measured), "region long, doc_id long, core boolean, pivot long, shared long, either long"), "measured")
        measured = measured.withColumn("linked", F.expr(f"100 * shared >= {SHARE} * either")).withColumn("d", F.expr("1 - shared / either"))
        edges = edges.unionByName(measured.filter("linked").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        folders.append(stored(edges.unionByName(bridges(measured, items)), "links").folder)
        rest = measured.filter("NOT (core AND linked)")
        window = rest.filter("core").groupBy("region").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        members = rest.join(window, "region").filter(
            F.col("core") | F.col("d").between(F.col("low") - REACH - 1e-9, F.col("high") + REACH + 1e-9)
        ).select("region", "doc_id", "core").join(going.select("region", "before", "missed"), "region")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): the least doc_id that each node of the edges reaches.

    Labels take the least of their neighbours' labels, then of their label's label, until none
    changes; each round is written to the shared folder.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("v", "u").distinct(), "edges")
    label = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), "labels")
    while True:
        of = label.select(F.col("v").alias("u"), F.col("c").alias("cu"))
        near = both.join(of, "u").groupBy("v").agg(F.min("cu").alias("m"))
        step = label.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = of.select(F.col("u").alias("c"), F.col("cu").alias("cc"))
        label = stored(step.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        if label.filter("c <> old").isEmpty():
            out = label.select(F.col("v").alias("doc_id"), F.col("c").alias("component"))
            out.folder = label.folder
            return out
        label = label.select("v", "c")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A document's set: its distinct 5-word shingles, A-Z lower-cased; with fewer words the whole
    sequence. Documents link when 100 * intersection >= 75 * union; component_id is the least
    doc_id reachable by links. Documents without words (null and empty texts among them) have 0
    shingles and link with nothing. Equal sets are one node of the join. Rows without doc_id link
    with nothing and have no component; repeated rows stay; an empty table gives none. Shingles are
    told apart by 64-bit hashes under a key drawn for the query, equal sets by 128 bits of digest and their size.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        found = stored(describe(docs), "sets")
        of = components(links(found))
        keep |= {found.folder, of.folder}
    classes = found.filter(F.col("doc_id") != NO_ID).filter("n_shingles > 0").groupBy(*SAME).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    labelled = classes.join(of.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*SAME, "n", F.coalesce("component", "rep").alias("component"))
    every = join_split(found.select("doc_id", *SAME), labelled, SAME, "n", found.count(), "left")
    return every.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the least doc_id's; columns stay as they are.

    Rows without doc_id stay, and so do documents without words. Of repeated rows of a kept doc_id all stay.
    """
    gone = jaccard_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(docs.columns)
