"""Near-duplicate documents (operator 4) by Order MinHash, verified by banded alignment.

A document's k-mers are its five-word shingles, each labelled with how many equal ones came before it. A hash function
picks the few smallest labelled shingles, and their order in the text becomes part of the sketch: texts with the same
words in another order differ. Documents that share a sketch are candidates; an alignment of their shingle sequences inside the
band that the similarity allows decides.

Similarity of two texts: with a shingles in one, b in the other and m pairs in the best order-preserving alignment of
labelled shingles, m / (a + b - m). It equals the Jaccard similarity of the shingle bags where nothing is moved.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, stash, table
from .graph import components
from .words import U, mix, texts_hashed

SHINGLE = 5
SIMILARITY = 0.8
#: Hash functions, and smallest shingles that make the wide and the narrow key of each.
HASHES, WIDE, NARROW = 16, 3, 6
#: Texts, and shingles, of one block of a bucket; larger buckets are compared block by block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * U(0xD1342543DE82EF95))


def shingles(words: np.ndarray) -> np.ndarray:
    """Labelled five-word shingles in text order; fewer words make one shingle; none make none."""
    n = len(words)
    if not n:
        return words
    k = min(SHINGLE, n)
    plain = np.full(n - k + 1, U(k), np.uint64)
    for i in range(k):
        plain = mix(plain * U(0x2545F4914F6CDD1D) + words[i : n - k + 1 + i])
    order = np.argsort(plain, kind="stable")
    ordered = plain[order]
    again = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    if not again.any():
        return plain
    place = np.arange(len(plain))
    count = np.empty(len(plain), np.uint64)
    count[order] = place - np.maximum.accumulate(np.where(again, 0, place))
    return np.where(count > 0, mix(plain + count * U(0xA24BAED4963EE407)), plain)


def sketch(labelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wide and the narrow key for each hash function."""
    values = mix(labelled[None, :] ^ _SEEDS[:, None])
    most = min(NARROW, len(labelled))
    if most < len(labelled):
        least = np.argpartition(values, most - 1, axis=1)[:, :most]
        least = np.take_along_axis(least, np.argsort(np.take_along_axis(values, least, 1), axis=1), 1)
    else:
        least = np.argsort(values, axis=1)
    keys = []
    for k, size in enumerate((WIDE, NARROW)):
        chosen = np.sort(least[:, :size], axis=1)  # text order
        key = _SEEDS + U(k)
        for i in range(chosen.shape[1]):
            key = mix(key * U(0x2545F4914F6CDD1D) + labelled[chosen[:, i]])
        keys.append(key)
    return keys[0], keys[1]


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the similarity is reached. A pair of that similarity has at least `least` aligned shingles, so it leaves at
    most len - least of either text out and no match lies further off the diagonal: only that band is aligned. Labelled
    shingles are unique in a text, so the alignment is the longest increasing run of places, found in n log n."""
    least = ceil(similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9)
    if not least or least > min(len(a), len(b)):
        return False
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    off = at_a - at_b
    band = (off <= len(a) - least) & (off >= least - len(b))
    at_a, at_b = at_a[band], at_b[band]
    if len(at_a) < least:
        return False
    places = at_b[np.argsort(at_a)]
    if (places[1:] > places[:-1]).all():
        return True
    tails: list[int] = []
    for place in places.tolist():
        i = bisect_left(tails, place)
        tails[i : i + 1] = [place]
    return len(tails) >= least


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes = [], []
        for words in texts_hashed(batch.column("text")):
            labelled = shingles(words)
            sizes.append(len(labelled))
            keys.append(np.concatenate(sketch(labelled)).astype(np.int64) if len(labelled) else np.empty(0, np.int64))
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), lists, pa.array(sizes, pa.int32())], names=["doc_id", "tid", "keys", "size"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
    for batch in batches:
        keep = []
        names = batch.column("a").to_pylist()
        left, right = texts_hashed(batch.column("text_a")), texts_hashed(batch.column("text_b"))
        for name, a, b in zip(names, left, right, strict=True):
            if last[0] != name:
                last = (name, shingles(a))
            keep.append(aligned(last[1], shingles(b)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shared(labelled: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each two texts have in common, in whatever order."""
    n = len(labelled)
    _, which, count = np.unique(np.concatenate(labelled), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(n), [len(x) for x in labelled])
    common = count > 1
    text, which = text[common[which]], (np.cumsum(common) - 1)[which[common[which]]]
    order = np.argsort(which, kind="stable")
    text, which = text[order], which[order]
    out, wide = np.zeros((n, n), np.float32), 4096
    for at in range(0, int(common.sum()), wide):
        part = slice(*np.searchsorted(which, [at, at + wide]))
        has = np.zeros((n, wide), np.float32)
        has[text[part], which[part] - at] = 1
        out += has @ has.T
    return out


def _block_links(rows: pa.Table) -> list[tuple[bytes, bytes]]:
    """Links between components among the texts of one block or pair of blocks: enough of them to connect all that are similar.

    Compared are all pairs of different components and of different sides (-1: all) that share no earlier key, where another
    bucket compares them. Lengths and shared shingles rule out what can't reach the similarity; pairs that links found here
    connect already need no comparison."""
    side, size = rows.column("side").to_numpy(), rows.column("size").to_numpy().astype(np.int64)
    keys = np.array(rows.column("keys").to_pylist(), np.int64).reshape(len(side), HASHES)
    part = np.unique(np.array([x.hex() for x in rows.column("component").to_pylist()]), return_inverse=True)[1]
    place = int(np.flatnonzero(keys[0] == rows.column("key")[0].as_py())[0])
    u, v = np.triu_indices(len(side), 1)

    def only(some: np.ndarray) -> None:
        nonlocal u, v
        u, v = u[some], v[some]

    only((part[u] != part[v]) & ((side[u] != side[v]) | (side[u] < 0)))
    least = lambda: SIMILARITY / (1 + SIMILARITY) * (size[u] + size[v]) - 1e-9
    only(np.minimum(size[u], size[v]) >= least())
    for k in range(place):
        only(keys[u, k] != keys[v, k])
    if not len(u):
        return []
    used, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    labelled = [shingles(x) for x in texts_hashed(rows.column("text").take(pa.array(used)).combine_chunks())]
    a, b = at[: len(u)], at[len(u) :]
    if len(u) > 2 * len(used):
        some = _shared(labelled)[a, b] >= least()
        a, b = a[some], b[some]
        only(some)
    names, root, out = rows.column("tid").to_pylist(), list(range(int(part.max()) + 1)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j, x, y in zip(u.tolist(), v.tolist(), a.tolist(), b.tolist(), strict=True):
        p, q = top(part[i]), top(part[j])
        if p != q and aligned(labelled[x], labelled[y]):
            root[p] = q
            out.append((names[i], names[j]))
    return out


def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task follow each other."""
    names = ["a", "b"]
    held: list[pa.RecordBatch] = []

    def links() -> pa.RecordBatch:
        found = _block_links(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in range(2)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        tasks = np.array(batch.column("task").to_pylist())
        bounds = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if held and held[0].column("task")[0].as_py() != tasks[start]:
                yield links()
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield links()


def _centred(nodes: DataFrame) -> DataFrame:
    """(tid, component, low, high): each text under each of its keys beside the two centres, of smallest and of largest hash; keys of one
    text have none. From (tid, keys, component). Centres are the same texts under every key."""
    spread = nodes.select("tid", "component", F.explode("keys").alias("key")).repartition(F.col("key"))
    ranked = F.struct(F.xxhash64("tid").alias("rank"), F.col("tid"), F.col("component"))
    centres = spread.groupBy("key").agg(F.min(ranked).alias("low"), F.max(ranked).alias("high")).where("low.tid <> high.tid")
    return spread.join(centres, "key").select("tid", "component", "low", "high")


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b), each once, of a text and its centres (tid, component, low, high) that lie in other components."""
    pairs = met.select("tid", "component", F.explode(F.array("low", "high")).alias("centre")).where("component <> centre.component")
    return pairs.select(F.least("tid", "centre.tid").alias("a"), F.greatest("tid", "centre.tid").alias("b")).distinct()


def _own(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("own")


def _texts(rows: DataFrame, firsts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, text) of the wanted tids. Of a text with many copies only the rows of its first id are dealt to one place; the others are
    spread by their ids and end there."""
    # the same plan at every size: a broadcast of the wanted would grow with the corpus
    asked = wanted.join(firsts, "tid").select("tid", "own")
    texts = rows.select("tid", _own(), "text").join(asked.hint("merge"), ["own", "tid"], "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    return scratch.stash(texts, "candidate-texts")


def _linked(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs whose texts are similar."""
    texts = _texts(rows, firsts, pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), scratch)
    both = pairs.join(texts.withColumnRenamed("tid", "a").withColumnRenamed("text", "text_a"), "a")
    both = both.join(texts.withColumnRenamed("tid", "b").withColumnRenamed("text", "text_b"), "b")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(_verified, "a binary, b binary")


def _tasks(nodes: DataFrame) -> DataFrame:
    """What is left to compare: (task, key, side, tid, component, keys, size), the texts of each task. From (tid, keys, size, component).

    Buckets with one component are done. Others are one task, or, where they are large, their largest component and the rest are
    parted into blocks, and each block of the rest meets each block of either: tasks are bounded, and what is connected
    already isn't compared with itself. A narrow key is shared only with the wide key of its function, so wide keys do."""
    wide = nodes.withColumn("keys", F.slice("keys", 1, HASHES))
    spread = wide.select("tid", "component", "size", F.explode("keys").alias("key")).repartition(F.col("key"))
    counted = spread.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "size", "component"))
    buckets = counted.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("total"), most.alias("main")).where("parts > 1")
    blocks = lambda n, size: f"cast(greatest(ceil(({n}) / {BLOCK}), ceil(({size}) / {BLOCK_SHINGLES})) as int)"
    buckets = buckets.selectExpr(
        "key", "parts", "main.component AS main", f"{blocks('n', 'total')} AS whole",
        f"{blocks('main.n', 'main.size')} AS of_main", f"{blocks('n - main.n', 'total - main.size')} AS of_rest",
    )
    member = spread.join(buckets, "key").selectExpr("*", "component = main AS is_main", "cast(pmod(xxhash64(tid, key), if(component = main, of_main, of_rest)) as int) AS own")
    place = lambda kind, i, j, side: f"named_struct('kind', '{kind}', 'i', {i}, 'j', {j}, 'side', {side})"
    with_rest = f"transform(sequence(0, of_rest - 1), x -> {place('rest', 'least(own, x)', 'greatest(own, x)', 'if(own = x, -1, if(own < x, 0, 1))')})"
    with_main = f"transform(sequence(0, of_main - 1), x -> {place('main', 'x', 'own', '1')})"
    places = (
        f"CASE WHEN whole = 1 THEN array({place('all', '0', '0', '-1')}) "
        f"WHEN is_main THEN transform(sequence(0, of_rest - 1), x -> {place('main', 'own', 'x', '0')}) "
        f"WHEN parts = 2 THEN {with_main} ELSE concat({with_main}, {with_rest}) END"
    )
    member = member.selectExpr("key", "tid", f"explode({places}) AS place")
    member = member.selectExpr("concat_ws(':', key, place.kind, place.i, place.j) AS task", "key", "place.side AS side", "tid")
    return member.join(wide.select("tid", "component", "keys", "size"), "tid")


def _compared(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs whose texts are similar, written; what is written on the way is removed."""
    own = Scratch()
    links = scratch.stash(_linked(rows, firsts, own.stash(pairs, "candidates"), own), "links-found")
    own.drop()
    return links


def _labelled(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, keys, size, component) of all nodes."""
    parts = components(links, scratch.stash)
    return nodes.join(parts, F.col("tid") == F.col("node"), "left").select("tid", "keys", "size", F.coalesce("component", "tid").alias("component"))


def _rest_linked(rows: DataFrame, firsts: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that connect all components with similar texts under one key."""
    tasks = scratch.stash(_tasks(nodes), "tasks")
    texts = _texts(rows, firsts, tasks.select("tid").distinct(), scratch)
    dealt = tasks.join(texts, "tid").repartition(F.col("task")).sortWithinPartitions("task")
    return dealt.select("task", "key", "side", "tid", "component", "keys", "size", "text").mapInArrow(_blocks_linked, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tid, copies_of, class_id, kept: one row for each input row.

    tid is the text's md5; copies_of the smallest doc_id with an equal text; class_id the smallest doc_id of all texts
    that links connect to it; kept says whether the row is the one that stays. Null texts equal each other and the empty
    text; texts without words are linked to equal ones only. Repeated rows fall into one class, each with a row here. A null
    doc_id is never the smallest unless all of a class are null; such a class has a null class_id. kept is true for the rows
    of the one text that leads the class. An empty table gives no rows.

    Equal texts are one node. A sketch key gathers any number of nodes. Each is compared with two centres first, those of
    smallest and of largest hash among all that its keys have, which are two comparisons a row at most; then with the
    two of each key, under both keys of all hash functions, that it isn't connected with yet. Centres are the same nodes under every
    key, so members of one family meet the same few, and most of a family is connected by comparisons that grow with the number of rows.
    Then every pair that shares a key and isn't in one component yet is compared, in blocks, none is left out; that grows
    with the square of the part of a bucket that the centres didn't connect. Whether texts share a key is a matter of chance:
    a pair of similarity 0.8 shares a wide key of 16 with one of 0.99999.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tid"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = stash(rows.mapInArrow(_sketched, f"doc_id {kind}, tid binary, keys array<long>, size int"), "sketches")
    nodes = sketches.groupBy("tid").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.min("doc_id").alias("copies_of"))
    scratch = Scratch()
    nodes = scratch.stash(nodes, "nodes")
    firsts = nodes.select("tid", _own("copies_of"))
    # a text's outermost centres of all its keys first; then those under each key, as far as they aren't connected yet
    alone = nodes.select("tid", "keys", F.col("tid").alias("component"))
    outermost = _centred(alone).groupBy("tid").agg(F.first("component").alias("component"), F.min("low").alias("low"), F.max("high").alias("high"))
    links = _compared(rows, firsts, _pairs(outermost), scratch)
    links = links.unionByName(_compared(rows, firsts, _pairs(_centred(_labelled(nodes, links, scratch))), scratch))
    labelled = _labelled(nodes, links, scratch)
    rest = scratch.stash(_rest_linked(rows, firsts, labelled, scratch), "links-found")
    parts = components(links.unionByName(rest), scratch.stash)
    named = nodes.select("tid", "copies_of").join(parts, F.col("tid") == F.col("node"), "left")
    named = named.select("tid", "copies_of", F.coalesce("component", "tid").alias("component"))
    first = F.min(F.struct(F.col("copies_of").isNull(), F.col("copies_of"), F.col("tid")))
    classes = named.groupBy("component").agg(first.alias("first"))
    named = named.join(classes, "component").select("tid", "copies_of", F.col("first.copies_of").alias("class_id"), (F.col("first.tid") == F.col("tid")).alias("leads"))
    # written, so that the last join is a plain one, whose partition of a text with very many copies Spark can split
    named = stash(named, "classes")
    scratch.drop()
    kept = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return sketches.select("doc_id", "tid").join(named, "tid").select("doc_id", "tid", "copies_of", "class_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without near duplicates: of each class one row with the smallest doc_id stays."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_id")
    found = near_duplicates(docs, id_col, text_col).where("kept").select(name(F.col("doc_id")), F.col("tid").alias("_tid")).distinct()
    tid = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    packed = docs.select(F.struct("*").alias("row"), name(F.col(id_col)), tid.alias("_tid"))
    return packed.join(found, ["_id", "_tid"], "left_semi").dropDuplicates(["_id", "_tid"]).select("row.*")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copies_of", "class_id", "kept")


QUERIES = {"op4_order_minhash": op4_order_minhash}
ORACLES: dict[str, str] = {}
