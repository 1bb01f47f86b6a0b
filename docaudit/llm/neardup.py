"""Near-duplicate documents (operator 6): MinHash with an inverted join over signature coordinates.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set holds its distinct
shingles of five words (of all its words, if it has fewer; nothing without words). Two documents are linked
if 100 * intersection >= 75 * union, confirmed on the full sets; a component is what links join.

1. One pass over the texts gives each row the size of its set, a 64-bit digest of the set (its node: rows
   with equal sets share it, so copies cost nothing further) and a signature of ``K`` coordinates.
2. Each node is posted under its K (coordinate, value) keys and the postings of each key are counted.
3. A link of similarity 0.75 agrees in at least ``T`` of K coordinates (all but about 2 links in a million
   do). So in any order of keys that all nodes use, two linked nodes share a key among their first
   K - T + 1: the prefix. With rare keys first, keys of very common passages fall outside; long lists are
   skipped, and nodes with too few shared keys leave altogether.
4. The prefix lists that begin with the same node are merged into one group, so a node that shares most of its
   keys with the same others goes there once. Within a group collisions are counted from inverted lists with
   skipping: a node's T - 1 longest lists are left out, the others merged, and only the nodes met there are looked up
   in the long ones. Pairs that collide in T coordinates are confirmed on the full sets; pairs that links already join are left
   out, and only the links that join something are emitted, so no pair is ever a row.
5. A group of over ``BLOCK`` nodes is dealt out: each block is searched by itself, together with the group's first
   node. Mostly that joins all of it. Where it does not, the nodes outside its largest component are searched for links with
   each block, and with each other. What links join are the components.

Defined results: empty texts, null texts and texts of white space have an empty set, are linked with nothing
and are kept. A row without doc_id takes no part: component_id null, kept. Rows that repeat a doc_id each come
back (a doc_id that is no whole number is an error); the texts of all of them count. Ties do not arise. Other columns are ignored. The nodes' 64-bit digests
may meet by chance: one wrong pair is expected among six billion different sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.llm.common import BoundedCache, table, written
from docaudit.llm.graph import components

WIDTH = 5
K, T = 64, 32
PERCENT = 75
BLOCK = 256
FILTER_BITS = 1 << 26

_rng = np.random.RandomState(20240229)
_FACTORS = (_rng.randint(0, 2**63, WIDTH, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ODD = (_rng.randint(0, 2**63, K, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_MASK = _rng.randint(0, 2**63, K, dtype=np.int64).astype(np.uint64)
_hashes = BoundedCache(xxhash.xxh64_digest)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)] if words else [], dtype=np.uint64)
    raw = b"".join(_hashes.all(words))
    h = np.frombuffer(raw, dtype=">u8").astype(np.uint64)
    n = len(h) - WIDTH + 1
    mixed = h[:n] * _FACTORS[0]
    for i in range(1, WIDTH):
        mixed += h[i : n + i] * _FACTORS[i]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(found: np.ndarray) -> np.ndarray:
    """K coordinates: the least value of the set under K hash functions."""
    least = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 2048):
        part = found[start : start + 2048]
        np.minimum(least, ((part[None, :] ^ _MASK[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    return least.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """k (doc_id), n (size of the set), node and sig of every row; node and sig are null for empty sets and rows without doc_id."""
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, sigs = [], [], []
            for k, t in zip(batch.column(0), batch.column(1)):
                found = shingles(t.as_py())
                n.append(len(found))
                part = len(found) and k.is_valid
                nodes.append(node_of(found) if part else None)
                sigs.append(signature(found) if part else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, schema.field("sig").type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t")).mapInArrow(run, "k long, n long, node long, sig array<long>")


def groups(nodes: DataFrame) -> DataFrame:
    """(first, node, m): the nodes of each group, and how many they are."""
    posted = nodes.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("key"))
    counted = written(posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
    shared = posted.join(counted, "key")
    by_node = Window.partitionBy("node")
    ranked = shared.select("node", "key", F.row_number().over(by_node.orderBy("m", "key")).alias("rank"), F.count("*").over(by_node).alias("c"))
    # the K - c keys that a node shares with nobody come first in its order
    kept = written(ranked.where(F.col("rank") <= F.col("c") - F.lit(T - 1)).select("node", "key"), "prefix")
    lists = kept.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1").select("key", "first")
    members = written(kept.join(written(lists, "lists"), "key").select("first", "node").distinct(), "members")
    sizes = written(members.groupBy("first").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    return members.join(sizes, "first")


class Postings:
    """Inverted lists over the (coordinate, value) pairs of some signatures."""

    def __init__(self, sig: np.ndarray):
        self.sig = sig
        code = np.stack([np.unique(c, return_inverse=True)[1] for c in sig.T], axis=1) if len(sig) else sig
        self.code = code + np.concatenate([[0], np.cumsum(code.max(axis=0) + 1)[:-1]]) if len(sig) else code
        flat = self.code.ravel()
        self.rows = np.argsort(flat, kind="stable") // K
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(flat))]) if len(sig) else np.zeros(1, dtype=np.int64)

    def colliding(self, x: int) -> np.ndarray:
        """Rows that agree with row x in ``T`` coordinates or more; whoever does is in one of x's K - T + 1 shortest lists."""
        begin, end = self.begin[self.code[x]], self.begin[self.code[x] + 1]
        short = np.argsort(end - begin, kind="stable")[: K - T + 1]
        met = np.unique(np.concatenate([self.rows[begin[i] : end[i]] for i in short]))
        return met[(self.sig[met] == self.sig[x]).sum(axis=1) >= T]


def links_within(node: np.ndarray, block: np.ndarray, label: np.ndarray, sig: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """Links that join nodes of a group with different labels (in two blocks of one, then across them only)."""
    sets = [shingles(t) for t in texts]
    good = np.array([node_of(s) == k for s, k in zip(sets, node)])  # a repeated doc_id may bring another text
    node, block, label, sig, sets = node[good], block[good], label[good].copy(), sig[good], [s for s, g in zip(sets, good) if g]
    if not len(sets):
        return []
    apart = len(np.unique(block)) > 1
    size = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(size)[:-1])
    postings = Postings(sig)
    mark, out = np.zeros(len(values), dtype=bool), []
    for x in range(len(sets) - 1):
        if (label[x + 1 :] == label[x]).all():
            continue
        y = postings.colliding(x)
        y = y[(y > x) & (label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x]))]
        if apart:
            y = y[block[y] != block[x]]
        if not len(y):
            continue
        mark[codes[x]] = True
        both = np.add.reduceat(mark[np.concatenate([codes[i] for i in y])].astype(np.int64), np.concatenate([[0], np.cumsum(size[y])[:-1]]))
        mark[codes[x]] = False
        for i in y[100 * both >= PERCENT * (size[x] + size[y] - both)]:
            if label[i] != label[x]:
                label[label == label[i]] = label[x]
                out.append((int(node[x]), int(node[i])))
    return out


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose k may be in ``wanted``: a bitmap over ``FILTER_BITS`` hashed places (8 MB, whatever the corpus) is broadcast, so that most texts that the join would drop are not shuffled for it. It lets all wanted rows pass; where very many are wanted it lets all rows pass."""
    place = F.pmod(F.xxhash64("k"), F.lit(FILTER_BITS)) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    tested = docs.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(written(bits, "bits")), "bucket")
    return tested.where(F.getbit(byte, at % 8) == 1).select(*docs.columns)


def confirmed(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) within each group (first, i, j) of ``rows``, which also hold own (the block), node and label. ``full``: node, sig and text."""
    rows = rows.join(full, "node").select("first", "i", "j", "own", "node", "label", "sig", "text")
    rows = rows.repartition("first", "i", "j").sortWithinPartitions("first", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def close() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            sig = part.column(6).combine_chunks().flatten().to_numpy().reshape(part.num_rows, K)
            found = links_within(part.column(4).to_numpy(), part.column(3).to_numpy(), part.column(5).to_numpy(), sig, part.column(7).to_pylist())
            return pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            begins = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(begins, begins[1:]):
                if held and last != tuple(keys[:, lo]):
                    yield close()
                    held.clear()
                last = tuple(keys[:, lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close()

    return written(rows.mapInArrow(run, "a long, b long").distinct(), "links")


def links(members: DataFrame, nodes: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b), confirmed on the full sets of the texts, that join whatever links join. ``firsts``: node and a doc_id that has it."""
    wanted = written(firsts.join(members.select("node").distinct(), "node").select("node", "k"), "wanted")
    texts = likely(docs.select(F.col("doc_id").cast("long").alias("k"), "text"), wanted).join(wanted, "k").select("node", "text")
    full = written(texts.join(nodes.select("node", "sig"), "node"), "texts")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = written(members.select("first", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")), "dealt")
    # the first node goes to every block of its group
    own = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = dealt.select("first", "node", F.explode(own).alias("own"))
    found = confirmed(rows.select("first", F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", F.col("node").alias("label")), full)
    split = dealt.where("blocks > 1")
    if split.isEmpty():
        return found
    roots = components(found)
    split = split.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    split = written(split, "split")
    return found.unionByName(confirmed(strangers(split), full))


def strangers(split: DataFrame) -> DataFrame:
    """Rows (first, i, j, own, node, label) of what is left to be searched in groups whose blocks links have not joined altogether.

    Nodes outside a group's largest component, its strangers, are dealt out over blocks of their own. Each of these is searched with
    each block of the group and with each block of strangers, so a node of the component is sent once for ``BLOCK`` strangers, whatever the
    size of the group, and a stranger once for ``BLOCK`` nodes. ``split``: first, node, blocks, own, label.
    """
    sizes = split.groupBy("first", "label").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("first").agg(F.max(F.struct("c", "label"))["label"].alias("main"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
    sizes = written(sizes.select("first", "main", F.ceil(F.col("others") / BLOCK).cast("int").alias("extra")), "open")
    rows = split.join(sizes, "first")
    other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("extra")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    inside = rows.where(F.col("label") == F.col("main")).select("first", F.col("own").alias("i"), F.explode(upto(F.col("extra"))).alias("j"), "own", "node", "label")
    outside = rows.where(F.col("label") != F.col("main")).withColumn("other", other)
    # blocks of strangers are numbered behind those of the group
    own = (F.col("blocks") + F.col("other")).alias("own")
    with_group = outside.select("first", F.explode(upto(F.col("blocks"))).alias("i"), F.col("other").alias("j"), own, "node", "label")
    with_others = outside.select("first", own, "blocks", "other", F.explode(upto(F.col("extra"))).alias("to"), "node", "label")
    low, high = (F.col("blocks") + f("other", "to") for f in (F.least, F.greatest))
    with_others = with_others.select("first", low.alias("i"), high.alias("j"), "own", "node", "label")
    return inside.unionByName(with_group).unionByName(with_others)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept of every row."""
    kind = docs.schema["doc_id"].dataType
    rows = written(sketch(docs), "sketches")
    firsts = rows.where("node is not null").groupBy("node").agg(F.min("k").alias("k"), F.count("*").alias("copies"))
    firsts = written(firsts, "nodes")
    nodes = written(rows.where("node is not null").select("node", "n", "sig").dropDuplicates(["node"]), "signatures")
    labels = components(links(groups(nodes), nodes, firsts, docs))
    linked = labels.join(firsts, "node")
    least = linked.groupBy("root").agg(F.min("k").alias("component"))
    linked = linked.select("node", "root").join(least, "root").select("node", "component")
    target = firsts.join(linked, "node", "left").where("component is not null or copies > 1").select("node", F.coalesce("component", "k").alias("component"))
    out = rows.select("k", "n", "node").join(written(target, "targets"), "node", "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "k"))
    out = out.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.select(F.col("doc_id").cast(kind), "n_shingles", F.col("component_id").cast(kind), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
