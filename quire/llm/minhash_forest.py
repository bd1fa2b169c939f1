"""Near-duplicate detection with an LSH forest over MinHash signatures.

Texts with equal shingle sets are one class, so groups of copies cost one row. A class's
signature has ``TREES * DEPTH`` minima; tree t reads them in the order that starts at place
``t * DEPTH`` and runs round. Sorting the classes by a tree's order puts those with the longest
common prefix side by side: a run with the same first DEPTH minima is a region, and its members
are candidates for each other. Two sets with similarity 0.8 share a region of at least one of
the 24 trees with probability 1 - 3e-6.

Links are found in passes, as only the components matter:

1. neighbours in the sorted orders: every class offers the neighbour with the highest estimate,
   and these pairs are confirmed on their full sets;
2. within regions, pairs of classes in different components whose estimate is not more than five
   deviations under the threshold join their components into families; the full sets of a family
   meet, and every pair of its classes in different components is checked. A region of over REGION
   classes is read deeper here, each part of it at the depth where it has so few;
3. what is left of large regions: those with classes of more than one component still are compared
   in full, cut into blocks. Components of one family have met in full and don't meet again.

A group with more than REGION classes or FAMILY_BYTES of text is cut into blocks that meet in
pairs. A component with more classes than a block has blocks of its own, which need not meet each
other; so no pair of different components is dropped, no task holds more than about two blocks,
and the texts of a large component go out once for each block of other components, not of its own.

Equal sets are known by 128 bits of every shingle; links are confirmed on the words themselves
(numbered by what they are), never on hashes.

Defined results: null, empty and blank texts have an empty set and no link; a null id is linked
with nothing and stays (component_id null); rows that share an id are judged each by its own
text; ids are integers, others raise a ValueError; an empty table gives an empty result; other
columns are not looked at, whatever their names. Long texts are read whole, in pieces.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, arrow_session, blocks, fresh, integral, settings, spread, stage, text_bytes
from .components import components
from .texthash import _splitmix, mix, numbered_sets, shingle_sets

TREES, DEPTH = 24, 4
MINIMA = TREES * DEPTH
#: Classes of a group that are compared with each other in one task, and bytes of their texts.
REGION, FAMILY_BYTES = 1024, 8 << 20
_A = (_splitmix(MINIMA, 101) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = (_splitmix(MINIMA, 202) >> np.uint64(32)).astype(np.uint32)[:, None]
SIGNED = "q_id long, n long, class binary, sig binary"
REGIONS = "prefix long, tail binary, rep long, marks binary"


def signature(shingles: np.ndarray) -> np.ndarray:
    """MINIMA least values of the set under as many permutations of 32-bit values."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (x[None, at : at + 4096] * _A + _B).min(axis=1), out=out)
    return out


def _sign(batches, words: int):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        n, ids, sigs = [], [], []
        for a, b in blocks(offsets):
            for s, other in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes() + other.to_bytes(8, "little"), digest_size=24).digest())
                sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["q_id", "n", "class", "sig"])


def _prefixes(batches):
    """A row for each class and tree: the tree's first DEPTH minima with its number, as one 64-bit key."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, TREES, DEPTH).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2]).copy()
        for d in range(DEPTH):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d])
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES)
        tree = np.tile(np.arange(TREES, dtype=np.int32), len(sig))
        for at in range(0, len(ids), 20_000):
            part = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(tree[part]), pa.array(key.reshape(-1)[part].view(np.int64))], names=["rep", "tree", "prefix"])


def _places(batches):
    """Rows (prefix, tree, rep, sig) with what the tree's order holds after its first DEPTH minima, and the low bytes of all minima."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, MINIMA, 4)
        at = (batch.column(1).to_numpy()[:, None] + 1) * DEPTH + np.arange(DEPTH)
        tails = np.take_along_axis(sig, (at % MINIMA)[:, :, None], axis=1).reshape(batch.num_rows, 4 * DEPTH)
        fixed = lambda rows: pa.array([x.tobytes() for x in np.ascontiguousarray(rows)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), fixed(tails), batch.column(2), fixed(sig[:, :, 0])], names=["prefix", "tail", "rep", "marks"])


def _estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from the low bytes of the minima, without the 1/256 that agree by chance."""
    return ((one == many).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _marks(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), MINIMA)


def _neighbours(batches, least: float):
    """Sorted rows (prefix, tail, rep, marks) of one task: each row with the one before it, if they share a region."""
    last = None
    for batch in batches:
        prefix, rep, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _marks(batch.column(3))
        if last:
            prefix, rep, marks = (np.concatenate(x) for x in ((last[0], prefix), (last[1], rep), (last[2], marks)))
        last = prefix[-1:], rep[-1:], marks[-1:]
        near = np.flatnonzero((prefix[1:] == prefix[:-1]) & (rep[1:] != rep[:-1]))
        score = _estimate(marks[near], marks[near + 1])
        good = score >= least
        a, b = rep[near][good], rep[near + 1][good]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score[good])], names=["a", "b", "score"])


def _groups(batches):
    """Consecutive rows with an equal first column, as lists of batches' slices."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _joined(labels: np.ndarray):
    """Union-find over the labels of a group: root of a place, and a join of two places."""
    names, at = np.unique(labels, return_inverse=True)
    parent = np.arange(len(names))

    def roots() -> np.ndarray:
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up
        return parent[at]

    def join(i: int, j: int) -> None:
        r = roots()
        parent[max(r[i], r[j])] = min(r[i], r[j])

    return roots, join


def _candidates(batches, least: float):
    """Sorted rows (key, rep, label, marks, apart, side) of regions: pairs of labels, as few as join all that have a pair of classes of different apart with a good estimate. side: -1, or the block of a cut region."""
    for g in _groups(batches):
        label, apart = g.column(2).to_numpy(), g.column(4).to_numpy()
        if (apart == apart[0]).all():
            continue
        marks, side = _marks(g.column(3)), g.column(5).to_numpy()
        roots, join = _joined(label)
        root, a, b = roots(), [], []
        for i in range(len(label) - 1):
            j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (apart[i + 1 :] != apart[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0)))
            if len(j):
                j = j[_estimate(marks[i], marks[j]) >= least]
                _, first = np.unique(root[j], return_index=True)
                for k in j[first]:
                    a.append(label[i])
                    b.append(label[k])
                    join(i, int(k))
                if len(j):
                    root = roots()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


#: Bytes of the bit matrix that is worked on at once.
BITS = 32 << 20


def _shared(sets: list[np.ndarray]):
    """Rows of bits over the shingles that more than one set has, in parts of at most BITS bytes."""
    every = np.concatenate(sets)
    names, count = np.unique(every, return_counts=True)
    names = names[count > 1]
    step = max(64, BITS * 8 // len(sets) // 64 * 64)
    for at in range(0, len(names), step):
        some = names[at : at + step]
        bits = np.zeros((len(sets), -(-len(some) // 64) * 64), bool)
        for k, s in enumerate(sets):
            place = np.minimum(np.searchsorted(some, s), len(some) - 1)
            bits[k, place[some[place] == s]] = True
        yield np.packbits(bits, axis=1).view(np.uint64)


def _family_links(batches, words: int, percent: int):
    """Sorted rows (key, rep, label, text, side) of families: links between classes of different labels, as few as join all that are similar."""
    for g in _groups(batches):
        rep, label, side = g.column(1).to_numpy(), g.column(2).to_numpy(), g.column(4).to_numpy()
        if (label == label[0]).all():
            continue
        sets = numbered_sets(*text_bytes(g.column(3)), words)
        size = np.array([len(s) for s in sets])
        parts = list(_shared(sets)) if len(sets) * size.sum() < 8 * BITS else None
        both = None if parts is not None else np.zeros((len(sets), len(sets)), np.int32)
        meets = lambda i: i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0)))  # noqa: E731, B023
        for bits in _shared(sets) if parts is None else ():
            for i in range(len(sets) - 1):
                if len(j := meets(i)):
                    both[i, j] += np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int32)
        roots, join = _joined(label)
        root, a, b = roots(), [], []
        for i in range(len(sets) - 1):
            j = meets(i)
            j = j[root[j] != root[i]]
            if not len(j):
                continue
            common = both[i, j] if parts is None else sum(np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) for bits in parts)
            j = j[(common > 0) & (100 * common >= percent * (size[i] + size[j] - common))]
            _, first = np.unique(root[j], return_index=True)
            for k in j[first]:
                a.append(rep[i])
                b.append(rep[k])
                join(i, int(k))
            if len(j):
                root = roots()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def _confirm(batches, words: int, percent: int):
    """Rows (a, b, text of a, text of b): the pairs whose full sets are similar enough, as the words have it."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        (x, xo), (y, yo) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
        for a, b in blocks(xo + yo):
            data = np.concatenate([x[xo[a] : xo[b]], y[yo[a] : yo[b]]])
            offsets = np.concatenate([xo[a : b + 1] - xo[a], yo[a + 1 : b + 1] - yo[a] + xo[b] - xo[a]])
            sets = numbered_sets(data, offsets, words)
            for k, (s, t) in enumerate(zip(sets[: b - a], sets[b - a :], strict=True)):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[a + k] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])


def _labelled(links: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """rows with their label: the component's root so far, or the class itself."""
    return rows.join(links.select(F.col("node").alias(id_col), "root"), id_col, "left").withColumn("label", F.coalesce("root", id_col)).drop("root")


def _blocked(rows: DataFrame, *keep: str, apart: str = "label") -> DataFrame:
    """Rows (key, rep, label, size, keep) to rows (key, rep, label, keep, side): large groups cut into blocks of about half a group that meet in pairs, with a key for each pair.

    A label with more than a block has blocks of its own; the others share blocks, each label in one. Two blocks meet unless both are of one label, or of labels that have one value of apart; groups with one such value are left out. side tells the blocks of a pair apart, -1 stands for a group or block whose rows all meet."""
    half, whole = REGION // 2, F.lit(float(FAMILY_BYTES))
    labels = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min(apart).alias("apart"))
    labels = labels.withColumn("need", F.greatest(F.col("n") / half, F.col("bytes") * 2 / whole))
    own = F.collect_list(F.when(F.col("need") > 1, F.struct("label", "apart", F.ceil("need").cast("int").alias("nb"))))
    groups = labels.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("apart").alias("l0"), F.max("apart").alias("l1"), F.sum(F.when(F.col("need") <= 1, F.col("need")).otherwise(0)).alias("shared"), own.alias("own"))
    groups = groups.filter("l0 <> l1").withColumn("large", (F.col("n") > REGION) | (F.col("bytes") > whole))
    groups = stage(groups.select("key", "large", F.ceil("shared").cast("int").alias("shared"), "own"), "mh-groups")
    small = rows.join(groups.filter("not large").select("key"), "key").select("key", "rep", "label", *keep, F.lit(-1).alias("side"))
    big = groups.filter("large")
    if big.isEmpty():
        return small
    numbered = lambda name, of, nb: F.transform(F.sequence(F.lit(1), nb), lambda k: F.struct(of.alias("of"), F.concat_ws(":", name, k - 1).alias("block")))
    shared = F.when(F.col("shared") > 0, numbered(F.lit("shared"), F.lit(None).cast("long"), F.col("shared"))).otherwise(F.array())
    every = big.select("key", F.concat(shared, F.flatten(F.transform("own", lambda o: numbered(o["label"].cast("string"), o["apart"], o["nb"])))).alias("blocks"))
    meet = every.select("key", "blocks", F.explode("blocks").alias("x")).select("key", "x", F.explode("blocks").alias("y"))
    meet = meet.filter("x.block <= y.block and (x.of is null or y.of is null or x.of <> y.of)").select("key", F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    meet = stage(meet.withColumn("pair", F.xxhash64("key", "x", "y")), "mh-meet")
    sides = meet.select("key", F.col("x").alias("block"), "pair", F.when(F.col("x") == F.col("y"), -1).otherwise(0).alias("side"))
    sides = sides.unionByName(meet.filter("x <> y").select("key", F.col("y").alias("block"), "pair", F.lit(1).alias("side")))
    dealt = rows.join(big.select("key", "shared"), "key").join(big.select("key", F.inline("own")).drop("apart"), ["key", "label"], "left")
    number = F.coalesce(F.pmod(F.xxhash64("rep"), "nb"), F.pmod(F.xxhash64("label"), F.greatest("shared", F.lit(1))))
    dealt = dealt.withColumn("block", F.concat_ws(":", F.when(F.col("nb").isNotNull(), F.col("label").cast("string")).otherwise(F.lit("shared")), number))
    large = dealt.join(sides, ["key", "block"]).select(F.col("pair").alias("key"), "rep", "label", *keep, "side")
    return small.unionByName(large)


def _deeper(rows: DataFrame, big: DataFrame) -> DataFrame:
    """Rows (key, tail, ...) of regions with over REGION classes, by the key of the least depth at which their part of the region has so few; parts that are larger at every depth are left out."""
    rest, done = rows.join(big.select("key"), "key"), None
    for d in range(1, DEPTH + 1):
        rest = rest.withColumn("deep", F.xxhash64("key", F.substring("tail", 1, 4 * d)))
        sizes = rest.groupBy("deep").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("deep", "m")
        rest = stage(rest.join(sizes, "deep"), "mh-deeper")
        part = rest.filter(F.col("m") <= REGION).drop("m").withColumn("key", F.col("deep")).drop("deep")
        done = part if done is None else done.unionByName(part)
        rest = rest.filter(F.col("m") > REGION).drop("m", "deep")
        if rest.isEmpty():
            break
    return done


def _links(rows: DataFrame, texts: DataFrame, roots: DataFrame, touched: DataFrame, words: int, percent: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the components of classes that meet in rows (key, rep, label, marks, apart, side): candidates by estimate, their families, and these confirmed on full sets. Also the families (label, key): labels of one have met in full."""
    rows = rows.repartition("key").sortWithinPartitions("key")
    pairs = stage(rows.mapInArrow(partial(_candidates, least=least), "a long, b long"), "mh-candidates")
    if pairs.isEmpty():
        return pairs, pairs.toDF("label", "key")
    family = components(pairs, "a", "b", roots=True).select(F.col("node").alias("label"), F.col("root").alias("key"))
    members = stage(_labelled(roots, touched, "rep").join(family, "label").select("key", "rep", "label", "size"), "mh-members")
    rows = _blocked(members).join(texts, "rep").select("key", "rep", "label", "q_text", "side").repartition("key").sortWithinPartitions("key")
    return stage(rows.mapInArrow(partial(_family_links, words=words, percent=percent), "a long, b long"), "mh-links"), family


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Signed rows (q_id, n, class, rep, root): rep is the least id of the row's class, root that of its component."""
    spark = docs.sparkSession
    integral(docs, id_col)
    arrow_session(spark)
    least = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / MINIMA)
    source = docs.select(F.col(id_col).cast("long").alias("q_id"), F.col(text_col).alias("q_text"))
    signed = stage(spread(source).mapInArrow(partial(_sign, words=words), SIGNED), "mh-signed")
    members = signed.filter("n > 0 and q_id is not null")
    classes = stage(members.groupBy("class").agg(F.min("q_id").alias("rep"), F.max("sig").alias("sig")), "mh-classes")  # a class has one signature

    prefixes = stage(classes.select("rep", "sig").mapInArrow(_prefixes, "rep long, tree int, prefix long"), "mh-prefixes")
    shared = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("prefix")
    places = prefixes.join(shared, "prefix")
    regions = stage(places.join(classes.select("rep", "sig"), "rep").select("prefix", "tree", "rep", "sig").mapInArrow(_places, REGIONS), "mh-regions")

    order = ["prefix", "tail", "rep"]
    near = regions.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_neighbours, least=least), "a long, b long, score double")
    offers = near.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "score")
    first = stage(offers.groupBy("x").agg(F.max(F.struct("score", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "mh-near")

    seen = stage(regions.select("rep").distinct(), "mh-touched")
    with settings(spark, BLOOM):
        found = source.join(seen, F.col("q_id") == F.col("rep")).select("rep", "q_text").withColumn("q_digest", F.sha2("q_text", 256))
        texts = stage(found.dropDuplicates(["rep", "q_digest"]).drop("q_digest"), "mh-texts")
    touched = texts.select("rep", F.coalesce(F.octet_length("q_text"), F.lit(0)).cast("long").alias("size"))

    one = texts.select(F.col("rep").alias("a"), F.col("q_text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("q_text").alias("tb"))
    both = first.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    links = stage(both.mapInArrow(partial(_confirm, words=words, percent=percent), "a long, b long"), "mh-links")
    roots = components(links, "a", "b")

    labelled = stage(_labelled(roots, regions, "rep").withColumnRenamed("prefix", "key"), "mh-labelled")
    sizes = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    sizes = stage(sizes.filter("l0 <> l1").select("key", "m"), "mh-sizes")
    big = sizes.filter(F.col("m") > REGION)
    flat = lambda t: t.select("key", "rep", "label", "marks", F.col("label").alias("apart"), F.lit(-1).alias("side"))
    rows, large = flat(labelled.join(sizes.filter(F.col("m") <= REGION).select("key"), "key")), not big.isEmpty()
    if large:
        rows = rows.unionByName(flat(_deeper(labelled, big)))
    more, family = _links(rows, texts, roots, touched, words, percent, least)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links, "a", "b")
    if large:
        left = _labelled(roots, regions.withColumnRenamed("prefix", "key").join(big.select("key"), "key"), "rep").withColumn("size", F.lit(0))
        left = left.join(family.withColumnRenamed("key", "apart"), "label", "left").withColumn("apart", F.coalesce("apart", "label"))
        more, _ = _links(_blocked(stage(left, "mh-labelled"), "marks", "apart", apart="apart"), texts, roots, touched, words, percent, least)
        if not more.isEmpty():
            roots = components(links.unionByName(more), "a", "b")
    known = classes.select("class", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("class", "rep", F.coalesce("root", "rep").alias("root"))
    return signed.select("q_id", "n", "class").join(known, "class", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (least id reachable), kept."""
    linked = link(docs, id_col, text_col, words, percent)
    component = F.when(F.col("q_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("root", "q_id")).otherwise(F.col("q_id")))
    out = linked.select(F.col("q_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: one of each component, and all without an id. Rows that share the id of one that goes, go."""
    name = fresh(docs, "q_gone")
    gone = near_duplicates(docs, id_col, text_col, words, percent).filter("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
