"""Near duplicates of texts by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words (a shorter text is one shingle). A shingle weighs its count in the text times the mean inverse
document frequency of its words. Word frequencies are counted over all documents into ``BUCKETS`` hashed counters, a table of
fixed size that is broadcast. (Frequencies of whole shingles would give the shingles of a copied text a low weight just
because it has copies, so that large groups of near copies would fall below the threshold.)

Steps: texts with equal words are one class, found by a 128-bit hash. ``BANDS`` x ``ROWS`` samples of each class give
band keys. In a bucket every member is compared with the least id; members that are not near it (far ones) are compared with
all members of the bucket, in blocks inside the tasks. Pairs whose 2-bit samples or total weights exclude the threshold are not verified,
nor pairs within one known component, since they change no result. Every other candidate pair is verified by the exact weighted
Jaccard similarity of the whole texts. Links make components. A pair at the threshold is found with probability 0.995, above it
more; nothing is capped.

Texts are read for the frequencies, for the samples, and for the texts of documents that share a bucket; only these are
shuffled on (see ``common.among``).

Null texts and rows without an id link with nothing. Texts without any word link with equal texts only. Repeated
rows are copies. Rows that share an id but not the text are nodes of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import among, groups, local_roots, prepare, slices, staged
from ludograph.llm.components import components
from ludograph.llm.words import gram_hashes, mix, word_hashes

WORDS = 5
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
DIFFERENT = 16  # of SAMPLES 2-bit samples: at similarity 0.8 more differ with probability 2e-5
BLOCK = 1 << 15
CHUNK, CHUNK_WEIGHT = 300, 5e6  # texts, and their total weight (about 700,000 words), in one part of a unit of work


def buckets_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The inverse document frequency of each word bucket. Tasks sum what they read; the driver gets ``BUCKETS`` sums."""
    prepare(docs.sparkSession)

    def count(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in slices(batches):
            words, first = word_hashes(batch.column(0))
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(first))
            pairs = np.unique((owner << BUCKET_BITS) | buckets_of(words))
            total[:BUCKETS] += np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS)
            total[BUCKETS] += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": used.astype(np.int32), "n": total[used]})

    sums = docs.select(text).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return (1 + np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS]))).astype(np.float32)


def weighted_shingles(words: np.ndarray, first: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order of hash, their weights, and each text's first place."""
    grams, place = gram_hashes(words, first, WORDS, short=True)
    runs = np.diff(place)
    owner = np.repeat(np.arange(len(runs)), runs)
    start = first[:-1][owner] + np.arange(len(grams)) - place[:-1][owner]
    stop = np.minimum(start + WORDS, first[1:][owner])
    sums = np.concatenate([[0.0], np.cumsum(idf[buckets_of(words)], dtype=np.float64)])
    weight = (sums[stop] - sums[start]) / np.maximum(stop - start, 1)
    order = np.lexsort((grams, owner))
    grams, owner, weight = grams[order], owner[order], weight[order]
    head = np.ones(len(grams), bool)
    head[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(head)
    counts = np.diff(np.append(at, len(grams)))
    # Rounded, so that equal shingles weigh the same whatever sums they were cut from.
    return grams[at], np.round(weight[at], 4).astype(np.float32) * counts.astype(np.float32), np.searchsorted(owner[at], np.arange(len(runs) + 1))


def samples(grams: np.ndarray, weights: np.ndarray, place: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """Consistent weighted samples: one row a text, ``count`` 64-bit marks of (shingle, level). Two texts agree in a
    mark with the probability of their weighted Jaccard similarity."""
    docs = len(place) - 1
    best = np.full((count, docs), np.inf, np.float32)
    out = np.zeros((count, docs), np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(place))
    low, scale = np.uint64(0xFFFFFF), np.float32(2.0**-24)
    for a in range(0, len(grams), BLOCK):
        h, who = grams[a : a + BLOCK], owner[a : a + BLOCK]
        log_w = np.log(weights[a : a + BLOCK])
        heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        sizes, seen = np.diff(np.append(heads, len(who))), who[heads]
        for j in range(count):
            u = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            v = mix(u + np.uint64(0xD1B54A32D192ED03))
            uniform = [((x >> np.uint64(s)) & low).astype(np.float32) * scale + scale / 2 for x, s in ((u, 40), (u, 16), (v, 40), (v, 16))]
            r, c = -np.log(uniform[0] * uniform[1]) + np.float32(1e-7), -np.log(uniform[2] * uniform[3]) + np.float32(1e-12)
            beta = (u & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
            level = np.floor(log_w / r + beta)
            log_a = np.log(c) - r * (level - beta) - r
            least = np.minimum.reduceat(log_a, heads)
            hits = np.flatnonzero(log_a == np.repeat(least, sizes))[::-1]
            at = np.zeros(docs, np.int64)
            at[who[hits]] = hits
            better = least < best[j, seen]
            won = seen[better]
            best[j, won] = least[better]
            out[j, won] = mix(h[at[won]] ^ mix(level[at[won]].astype(np.int64).view(np.uint64) + np.uint64(j)))
    return out.T


def sequence_hash(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    terms = mix(words + mix(place + np.uint64(seed)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def signatures(docs: DataFrame, idf: np.ndarray, key: str, text: str) -> DataFrame:
    """For each row with an id and a text: id, a hash of the text, the class (two longs), the total weight, two planes
    of bits of the samples, and the band keys (none without words)."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(idf)

    def sign(batches):
        for batch in slices(batches):
            texts = batch.column(2)
            words, first = word_hashes(texts)
            grams, weights, place = weighted_shingles(words, first, shared.value)
            marks = samples(grams, weights, place)
            total = np.add.reduceat(np.append(weights, 0).astype(np.float64), place[:-1]) if len(texts) else np.zeros(0)
            hashes = [sequence_hash(words, first, s).view(np.int64) for s in (1, 2)]
            bits = np.uint64(1) << np.arange(SAMPLES, dtype=np.uint64)
            planes = [(((marks >> np.uint64(s)) & np.uint64(1)) * bits).sum(axis=1, dtype=np.uint64).view(np.int64) for s in (0, 1)]
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands + marks[:, k::ROWS])
            empty = np.diff(first) == 0
            for d in np.flatnonzero(empty):
                raw = hashlib.blake2b((texts[d].as_py() or "").encode(), digest_size=16).digest()
                hashes[0][d], hashes[1][d] = np.frombuffer(raw, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]), pa.int32()), pa.array(bands[~empty].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, hashes), pa.array(np.where(empty, 0, total)), *map(pa.array, planes), lists],
                names=["id", "tx", "c1", "c2", "w", "p1", "p2", "bands"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tx"), F.col(text).alias("text")).mapInArrow(
        sign, "id long, tx long, c1 long, c2 long, w double, p1 long, p2 long, bands array<long>")


def _may_be_near(a: str, b: str, threshold: float) -> Column:
    """What the samples and the total weights tell: false for pairs below the threshold (but for a chance of 2e-5)."""
    bits = F.bit_count(F.expr(f"({a}.p1 ^ {b}.p1) | ({a}.p2 ^ {b}.p2)"))
    w = [F.col(f"{x}.w") for x in (a, b)]
    return (F.least(*w) >= F.greatest(*w) * (threshold - 1e-6)) & (bits <= DIFFERENT)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b: structs of id and tx) whose whole texts have the similarity; adds ``similarity``."""
    shared = prepare(pairs.sparkSession).sparkContext.broadcast(idf)

    def compare(batches):
        for batch in slices(batches, 64):
            grams, weights, place = weighted_shingles(*word_hashes(pa.concat_arrays([batch.column(4), batch.column(5)])), shared.value)
            n, out = batch.num_rows, []
            for i in range(n):
                x, y = slice(place[i], place[i + 1]), slice(place[n + i], place[n + i + 1])
                _, p, q = np.intersect1d(grams[x], grams[y], assume_unique=True, return_indices=True)
                both = float(np.minimum(weights[x][p], weights[y][q]).sum(dtype=np.float64))
                out.append(both / max(float(weights[x].sum(dtype=np.float64) + weights[y].sum(dtype=np.float64)) - both, 1e-12))
            similar = pa.array(np.array(out) >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.float64())], names=["a", "atx", "b", "btx", "similarity"]).filter(similar)

    flat = pairs.select(F.col("a.id").alias("a"), F.col("a.tx").alias("atx"), F.col("b.id").alias("b"), F.col("b.tx").alias("btx"))
    left, right = (texts.select(F.col("id").alias(c), F.col("tx").alias(f"{c}tx"), F.col("text").alias(f"{c}text")) for c in "ab")
    wide = flat.join(left, ["a", "atx"]).join(right, ["b", "btx"]).select("a", "atx", "b", "btx", "atext", "btext")
    return wide.mapInArrow(compare, "a long, atx long, b long, btx long, similarity double")


def numbered_nodes(signed: DataFrame) -> DataFrame | None:
    """Where an id has several texts: a number ``node`` for every id and text hash, in order of both. None where ids tell
    the texts apart, and serve as numbers themselves."""
    several = signed.groupBy("id").agg(F.min("tx").alias("low"), F.max("tx").alias("high")).where("low < high")
    if several.isEmpty():
        return None
    ranges = signed.select("id", "tx").distinct().repartitionByRange("id", "tx").sortWithinPartitions("id", "tx")
    return staged(ranges.withColumn("node", F.monotonically_increasing_id()))


def dedup_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, hashed: bool = False) -> DataFrame:
    """One row a row of ``docs``: ``key``, ``class_id`` (least id of the texts with equal words), ``component_id``
    (least id reachable by links), ``kept`` (the row is its component's least, or it links with nothing) and, if
    ``hashed``, ``tx`` (xxhash64 of the text), which tells rows apart that share an id."""
    idf = inverse_frequencies(docs, text)
    signed = staged(signatures(docs, idf, key, text))
    nodes = numbered_nodes(signed)

    def as_nodes(df: DataFrame) -> DataFrame:
        return df if nodes is None else df.join(nodes, ["id", "tx"]).withColumn("id", F.col("node")).drop("node")

    if nodes is not None:
        signed = staged(as_nodes(signed))
    whole = F.struct("id", "tx", "w", "p1", "p2", "bands")
    reps = staged(signed.groupBy("c1", "c2").agg(F.min(whole).alias("r")))
    members = reps.select(F.struct("r.id", "r.tx", "r.w", "r.p1", "r.p2").alias("m"), F.posexplode("r.bands").alias("band", "bucket"))
    leads = members.groupBy("band", "bucket").agg(F.min("m").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    grouped = staged(members.join(leads, ["band", "bucket"]))
    in_buckets = grouped.select(F.col("m.id").alias("id"), F.col("m.tx").alias("tx")).distinct()
    if nodes is not None:
        in_buckets = in_buckets.withColumnRenamed("id", "node").join(nodes, ["node", "tx"]).select("id", "tx")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tx"), F.col(text).alias("text"))
    texts, _ = among(texts.where("id is not null and text is not null"), staged(in_buckets), ["id", "tx"])
    texts = staged(as_nodes(texts.dropDuplicates(["id", "tx"])))

    star = grouped.where("m.id != lead.id or m.tx != lead.tx").withColumn("near", _may_be_near("m", "lead", threshold))
    pairs = star.where("near").select(F.struct("lead.id", "lead.tx").alias("a"), F.struct("m.id", "m.tx").alias("b")).distinct()
    links = staged(verified(pairs, texts, idf, threshold).select("a", "atx", "b", "btx"))
    roots = components(links.select("a", "b"))

    # Members that are not near their bucket's least id: against all others of the bucket.
    known = links.select(F.struct(F.col("a").alias("id"), F.col("atx").alias("tx")).alias("l"), F.struct(F.col("b").alias("id"), F.col("btx").alias("tx")).alias("k"))
    star = star.withColumn("l", F.struct("lead.id", "lead.tx")).withColumn("k", F.struct("m.id", "m.tx"))
    others = star.join(known.withColumn("linked", F.lit(True)), ["l", "k"], "left")
    others = others.select("band", "bucket", "m.*", F.col("linked").isNull().alias("far"), F.col("m.id").alias("node"))
    others = others.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    further = _further_links(staged(others), texts, idf, threshold)
    roots = components(links.select("a", "b").unionByName(further))

    classes = signed.select("id", "tx", "c1", "c2").distinct().join(reps.select("c1", "c2", F.col("r.id").alias("class_id")), ["c1", "c2"])
    classes = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    classes = classes.select("id", "tx", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    classes = classes.withColumn("own", F.col("id") == F.col("component_id"))
    if nodes is not None:
        for name in ("class_id", "component_id", "id"):
            of = nodes.select(F.col("node").alias(name), F.col("id").alias("_id"))
            classes = classes.join(of, name).withColumn(name, F.col("_id")).drop("_id")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tx"), F.col(text).isNotNull().alias("told"))
    found = rows.join(classes.withColumn("told", F.lit(True)), ["id", "tx", "told"], "left")
    return found.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"),
                        F.coalesce("component_id", "id").alias("component_id"), F.coalesce("own", F.lit(True)).alias("kept"),
                        *(["tx"] if hashed else []))


UNIT = ["band", "bucket", "kind", "i", "j"]
FAR, MIXED = 0, 1  # kinds of units: of two chunks of far members, or of a chunk of far members and one of the others


def work_units(others: DataFrame) -> DataFrame:
    """The members of buckets with far members, once for each unit of work they belong to. Far members and the others are
    cut into chunks of bounded size apart: every two chunks of far members are a unit, and every chunk of far members
    with every chunk of others. So a bucket of many near copies with a stray one costs its size, not its square."""
    def chunks(of: Column) -> Column:
        count, weight = (F.sum(F.when(of, v).otherwise(0)) for v in (F.lit(1), F.col("w")))
        return F.greatest(F.ceil(count / CHUNK), F.ceil(weight / CHUNK_WEIGHT)).cast("long")

    sizes = others.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), chunks(F.col("far")).alias("fars"), chunks(~F.col("far")).alias("rests"))
    cut = others.join(sizes.where("n > 1 and fars > 0").drop("n"), ["band", "bucket"])
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id", "tx"), F.when(F.col("far"), F.col("fars")).otherwise(F.col("rests"))))

    def unit(kind: int, i: str, j: str) -> str:
        return f"named_struct('kind', {kind}, 'i', {i}, 'j', {j})"

    two = f"transform(sequence(0L, fars - 1L), x -> {unit(FAR, 'least(mine, x)', 'greatest(mine, x)')})"
    mixed = f"if(rests > 0, transform(sequence(0L, greatest(rests, 1L) - 1L), x -> {unit(MIXED, 'mine', 'x')}), array())"
    met = f"transform(sequence(0L, fars - 1L), x -> {unit(MIXED, 'x', 'mine')})"
    units = cut.withColumn("u", F.explode(F.expr(f"if(far, concat({two}, {mixed}), {met})")))
    return units.select("band", "bucket", "u.kind", "u.i", "u.j", "id", "tx", "far", "root", "w", "p1", "p2")


def _further_links(others: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (``a``, ``b``) between members of a bucket of which one is ``far`` from the bucket's least id, and which are not
    in one component yet. In each unit of work (see ``work_units``) the samples tell first which members can have a
    partner at all, then those members' whole texts are compared, all at once. Only local roots leave a unit, never its
    pairs."""
    shared = prepare(others.sparkSession).sparkContext.broadcast(idf)

    def possible(batches):
        for t in groups(batches, UNIT):
            far, root, w, p1, p2 = (t[c].to_numpy() for c in ("far", "root", "w", "p1", "p2"))
            x = np.flatnonzero(far)
            y = x if t["kind"][0].as_py() == FAR else np.flatnonzero(~far)
            differ = np.bitwise_count(((p1[x][:, None] ^ p1[y][None, :]) | (p2[x][:, None] ^ p2[y][None, :])).view(np.uint64))
            near = (differ <= DIFFERENT) & (root[x][:, None] != root[y][None, :])
            near &= np.minimum(w[x][:, None], w[y][None, :]) >= np.maximum(w[x][:, None], w[y][None, :]) * (threshold - 1e-6)
            wanted = np.zeros(len(far), bool)
            wanted[x[near.any(axis=1)]] = True
            wanted[y[near.any(axis=0)]] = True
            yield from t.select([*UNIT, "id", "tx"]).filter(pa.array(wanted)).combine_chunks().to_batches()

    def compare(batches):
        for t in groups(batches, UNIT):
            grams, weights, place = weighted_shingles(*word_hashes(t["text"].combine_chunks()), shared.value)
            at, root = local_roots(t["id"].to_numpy(), similarities(grams, weights, place) >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(t["id"].to_numpy()[at]), pa.array(root)], names=["a", "b"])

    narrow = work_units(others).repartition(*UNIT).sortWithinPartitions(*UNIT)
    wanted = staged(narrow.mapInArrow(possible, "band int, bucket long, kind int, i long, j long, id long, tx long"))
    wide = wanted.join(texts, ["id", "tx"]).select(*UNIT, "id", "text").repartition(*UNIT).sortWithinPartitions(*UNIT, "id")
    return staged(wide.mapInArrow(compare, "a long, b long"))


def similarities(grams: np.ndarray, weights: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarities of all texts with each other. The common weight is a product of two matrices:
    a column for each level of weight that a shingle has in some texts."""
    n = len(place) - 1
    owner = np.repeat(np.arange(n), np.diff(place))
    order = np.lexsort((weights, grams))
    g, w, o = grams[order], weights[order].astype(np.float64), owner[order]
    head = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    run = np.cumsum(head) - 1
    begins = np.append(np.flatnonzero(head), len(g))
    level = head.copy()
    level[1:] |= w[1:] != w[:-1]
    levels = np.flatnonzero(level & (np.diff(begins)[run] > 1 if len(g) else head))  # shingles of one text have no part
    step = np.where(head[levels], w[levels], w[levels] - w[levels - 1])
    common = np.zeros((n, n))
    for a in range(0, len(levels), 2048):
        some = levels[a : a + 2048]
        ends = begins[run[some] + 1]  # texts from this level's place to the shingle's end weigh at least this much
        column = np.repeat(np.arange(len(some)), ends - some)
        row = o[np.repeat(some, ends - some) + np.arange(len(column)) - np.repeat(np.cumsum(ends - some) - (ends - some), ends - some)]
        x = np.zeros((n, len(some)))
        x[row, column] = 1.0
        common += (x * step[a : a + 2048]) @ x.T
    total = np.bincount(owner, weights=weights.astype(np.float64), minlength=n)
    out = common / np.maximum(total[:, None] + total[None, :] - common, 1e-12)
    np.fill_diagonal(out, 0)
    return out
