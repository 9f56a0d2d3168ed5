"""Operator 4: SimHash near-duplicates, linked through BK-trees of shards.

Fingerprint: over the words of the text in lower case (A-Z only), the 64-bit XXH64 (seed 42) of every shingle, repeats
included; a bit is set where over half of the hashes have it. Two fingerprints link at `radius` or fewer differing bits.

Links: equal fingerprints are one node. A shard holds the nodes that agree in one key; for op4 the keys are radius + 1
blocks that make up the 64 bits: two fingerprints within the radius agree in one at least, so every link is found.
(`nearcopies` has other keys for larger radii.) In a shard a BK-tree is built over its nodes, children keyed by their
Hamming distance to the parent, and a search follows only the edges whose key is within the radius of the query's
distance. A search reports links of a spanning forest, never all pairs.

Trees are built where the nodes of their shard meet, not on the driver: all trees together are as large as all distinct
fingerprints. A shard of up to MAX_TREE nodes is asked where it is built. In a larger shard about MAX_TREE of its nodes,
drawn by hash, make a tree that goes to every chunk of the shard, whose other nodes ask it (stars). Only nodes that this has not connected with the largest class of their shard then ask the trees of all
pieces of the shard (rest), so a large group of copies costs work in proportion to its size.

Classes: random contraction. In each round every node moves to the neighbour, or itself, with the least hash for that
round; the links are rewritten and repeated ones dropped. The number of nodes falls by a constant factor each round.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows are each returned; a
null doc_id takes part and its class has the smallest doc_id that is not null (null if there is none); empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import KEY_ROWS, further, parts, split_join, stored
from siltstone.sources.tables import table

#: Bytes of text that are cut into words at a time, and hashes whose bits are counted at a time.
PART, BITS = 1 << 20, 1 << 16
#: Nodes of one BK-tree, about.
MAX_TREE = 2048
#: Rounds of contraction at most; the number of nodes falls to a half or so in each.
ROUNDS = 60
#: Links that one task joins at most.
FEW = 10_000
#: Rows about hot shards that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Nodes of a large shard that ask one copy of its drawn tree, in units of that tree's size; trees up to SMALL nodes are
#: searched node by node.
CHUNK, SMALL = 8, 48


def bit_counts(hashes: np.ndarray, number: int = 0) -> np.ndarray:
    """How many of the hashes number `number` have each of their 64 bits set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS):
        part = further(hashes[i : i + BITS], number).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return counts


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash fingerprint of a text as an unsigned number of 64 bits."""
    digest, counts, total, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in parts((text or "").encode("utf-8", "surrogatepass").lower(), PART):
        words = carry + part
        if len(words) >= shingle:
            buffer = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
            counts += bit_counts(np.fromiter([digest(buffer[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64, len(starts)))
            total += len(starts)
        carry = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total and carry:
        counts, total = bit_counts(np.array([digest(b" ".join(carry), 42)], np.uint64)), 1
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little") if total else 0


def add_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of its text column as the (signed) long column `out`, which replaces one of that name."""
    schema = docs.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(fingerprint(x.as_py(), shingle).to_bytes(8, "little") for x in batch.column(text))
            columns = {name: batch.column(name) for name in batch.schema.names} | {out: pa.array(np.frombuffer(data, "<i8"))}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)


class BKTree:
    """A BK-tree over fingerprints of one or more 64-bit words each, (nodes, words)."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.children = prints, []
        data, size = prints.astype("<u8").tobytes(), 8 * prints.shape[1]
        self.values: list[int] = []
        for i in range(0, len(data), size):
            self.add(int.from_bytes(data[i : i + size], "little"))

    def add(self, value: int) -> None:
        at, number = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while number:
            d = (self.values[at] ^ value).bit_count()
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = number
                return
            at = below

    def near(self, value: int, radius: int) -> Iterator[int]:
        """The nodes within the radius of one value."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            todo += [child for edge, child in self.children[node].items() if abs(d - edge) <= radius]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within the radius of it). All queries go down the tree together."""
        todo = [(0, np.arange(len(queries)))] if len(self.prints) else []
        while todo:
            node, mine = todo.pop()
            d = np.bitwise_count(queries[mine] ^ self.prints[node]).sum(axis=1, dtype=np.int16)
            if len(near := mine[d <= radius]):
                yield node, near
            for edge, child in self.children[node].items():
                if len(below := mine[np.abs(d - edge) <= radius]):
                    todo.append((child, below))


def _shard_links(radius: int, width: int):
    """For rows (shard, piece, is_query, node, p0, p1, ...) in this order: links (a, b) of a spanning forest for each
    tree. p0, p1, ...: the words of the node's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, names, labels, out = None, [], None, [], None, []

        def flush() -> pa.RecordBatch:
            made = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(made[:, 0]), "b": pa.array(made[:, 1])})

        def ask(nodes: np.ndarray, prints: np.ndarray, mine: np.ndarray) -> None:
            """Links that join two components only. mine: the components of the queries, labels those of the tree."""
            for at, near in tree.search(prints, radius):
                near = near[mine[near] != labels[at]]
                while len(near):
                    out.append((names[at], int(nodes[near[0]])))
                    old = mine[near[0]]
                    labels[labels == old] = labels[at]
                    mine[mine == old] = labels[at]
                    near = near[mine[near] != labels[at]]

        def small(nodes: list[int], prints: np.ndarray) -> None:
            """The links of a small shard: each node asks the tree of those before it and is added to it."""
            asked, parent = BKTree(prints[:1]), list(range(len(nodes)))
            data, size = prints.astype("<u8").tobytes(), 8 * width
            for i in range(1, len(nodes)):
                value = int.from_bytes(data[i * size : i * size + size], "little")
                for j in asked.near(value, radius):
                    if parent[j] != parent[i]:
                        out.append((nodes[j], nodes[i]))
                        old = parent[i]
                        parent = [parent[j] if x == old else x for x in parent]
                asked.add(value)

        def planted() -> None:
            """The tree of the nodes so far, asked for its own nodes."""
            nonlocal tree, names, labels
            nodes, prints = (np.concatenate(x) for x in zip(*held))
            tree, names, labels = BKTree(prints), nodes.tolist(), np.arange(len(nodes))
            if len(nodes) > 1:
                ask(nodes, prints, labels)

        def done() -> None:
            if tree is None and (n := sum(len(x) for x, _ in held)) > 1:
                if n <= SMALL:
                    nodes, prints = (np.concatenate(x) for x in zip(*held))
                    small(nodes.tolist(), prints)
                else:
                    planted()

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, piece, query, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "piece", "is_query", "node"))
            prints = np.stack([batch.column(f"p{i}").to_numpy().view(np.uint64) for i in range(width)], axis=1)
            edge = (np.diff(shard) != 0) | (np.diff(piece) != 0)
            cut = np.flatnonzero(edge | (np.diff(query) != 0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(node)]))
            # shards of one node that begin and end inside the batch have no link
            alone = (ends - starts == 1) & (starts > 0) & (ends < len(node))
            alone[1:-1] &= edge[starts[1:-1] - 1] & edge[np.minimum(ends[1:-1], len(node) - 1) - 1]
            for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist()):
                if key != (shard[a], piece[a]):
                    done()
                    key, held, tree = (shard[a], piece[a]), [], None
                if not query[a]:
                    held.append((node[a:b], prints[a:b]))
                elif held:
                    if tree is None:
                        planted()
                    ask(node[a:b], prints[a:b], np.arange(len(names), len(names) + b - a))
            if len(out) > 10_000:
                yield flush()
        done()
        if out:
            yield flush()

    return run


def blocks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks of the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def block_keys(fingerprint: Column, radius: int) -> Column:
    """An array of longs: fingerprints (longs) within the radius of each other have one in common."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.xxhash64(F.lit(i), fingerprint.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(blocks(radius))])


def sized(rows: DataFrame, key: str = "shard") -> DataFrame:
    """(key, n) of the keys that more than one row has."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _drawn(limit: int) -> Column:
    """Whether a node is among the about `limit` nodes of its shard that make the tree which all others ask."""
    return F.pmod(F.xxhash64("node", "shard"), F.col("n")) < limit


def whole_rows(rows: DataFrame) -> DataFrame:
    """Rows (shard, node, ...) of small shards with the columns piece and is_query: one piece each."""
    return rows.withColumns({"piece": F.lit(0), "is_query": F.lit(False)})


def star_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (shard, n, node, ...) of large shards with piece and is_query: the drawn nodes stand in every piece, the others
    ask them in one."""
    pieces = F.ceil(F.col("n") / (CHUNK * limit)).cast("int")
    where = F.when(_drawn(limit), F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), pieces).cast("int")))
    return rows.withColumn("is_query", ~_drawn(limit)).withColumn("piece", F.explode(where))


def rest_rows(rows: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Rows (shard, n, node, ...) of large shards with piece and is_query: every node stands in a piece of its own shard,
    and those that are neither drawn nor in the shard's largest class (roots: node, root) ask all others."""
    labelled = stored(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    count = labelled.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("c"))
    most = count.groupBy("shard").agg(F.max(F.struct("c", "root"))["root"].alias("most"))
    outside = (F.col("root") != F.col("most")) & ~_drawn(limit)
    told = labelled.join(F.broadcast(most) if most.count() <= BROADCAST_ROWS else most, "shard").withColumn("outside", outside)
    open_shards = stored(told.filter("outside").select("shard").distinct(), "open-shards")
    told = told.join(F.broadcast(open_shards) if open_shards.count() <= BROADCAST_ROWS else open_shards, "shard", "left_semi")
    pieces, own = F.ceil(F.col("n") / limit).cast("int"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / limit)).cast("int")
    place = lambda piece, query: F.struct(piece.alias("piece"), F.lit(query).alias("is_query"))
    others = F.transform(F.filter(F.sequence(F.lit(0), pieces - 1), lambda p: p != own), lambda p: place(p, True))
    where = F.concat(F.array(place(own, False)), F.when(F.col("outside"), others).otherwise(F.array().cast("array<struct<piece:int,is_query:boolean>>")))
    return told.withColumn("x", F.explode(where)).drop("root", "most", "outside").withColumns({"piece": F.col("x.piece"), "is_query": F.col("x.is_query")}).drop("x")


def near_links(nodes: DataFrame, radius: int = 2, max_tree: int = MAX_TREE, width: int = 1) -> DataFrame:
    """Links (a, b) that connect the fingerprints within the radius of each other that share a key. nodes: distinct longs
    `node`, the words p0, p1, ... of their fingerprints, and `keys`, an array of longs that name shards."""
    words = [f"p{i}" for i in range(width)]
    dealt = nodes.select("node", *words, F.explode("keys").alias("shard"))
    hot = stored(sized(nodes.select(F.explode("keys").alias("shard"))).filter(F.col("n") > max_tree), "hot-shards")

    def links(rows: DataFrame) -> DataFrame:
        placed = rows.select("shard", "piece", "is_query", "node", *words).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "is_query", "node")
        return placed.mapInArrow(_shard_links(radius, width), "a long, b long")

    if hot.isEmpty():
        return links(whole_rows(dealt))
    named = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    large = stored(dealt.join(named, "shard"), "hot-nodes")
    first = stored(links(whole_rows(dealt.join(named, "shard", "left_anti"))).unionByName(links(star_rows(large, max_tree))), "first-links")
    return first.unionByName(links(rest_rows(large, connected(first), max_tree)))


def _few_roots(key: tuple, links: pa.Table) -> pa.Table:
    """(a, to) for the nodes of at most FEW links: the smallest node of each one's class."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return pa.table({"a": pa.array(list(parent), pa.int64()), "to": pa.array([root(x) for x in list(parent)], pa.int64())})


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; nodes of one class have one root. Links are contracted round by round;
    the last FEW of them at most are joined in one task."""
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    for number in range(ROUNDS):
        n = links.count()
        if not n:
            break
        both = links.select("a", "b").union(links.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)), F.col(c).alias("to"))
        if n <= FEW:
            moved = stored(links.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_few_roots, "a long, to long"), "moved")
        else:
            moved = stored(both.groupBy("a").agg(F.least(F.min(order("b")), order("a"))["to"].alias("to")), "moved")
        if labels is None:
            labels = moved.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            labels = split_join(labels, moved.select(F.col("a").alias("root"), "to"), ["root"], "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = stored(labels, "labels")
        if n <= FEW:
            break
        ends = split_join(links, moved.withColumnRenamed("to", "x"), ["a"])
        ends = split_join(stored(ends, "ends") if n > KEY_ROWS else ends, moved.select(F.col("a").alias("b"), F.col("to").alias("y")), ["b"])
        links = stored(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("the links did not contract")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, max_tree: int = MAX_TREE) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id, the smallest doc_id that links reach."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(add_fingerprint(rows, "text", shingle).select("doc_id", "fingerprint"), "prints")
    nodes = stored(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(near_links(nodes.select("node", F.col("node").alias("p0"), block_keys(F.col("node"), radius).alias("keys")), radius, max_tree))
    rooted = stored(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(split_join(rooted, least, ["root"]).select(F.col("node").alias("fingerprint"), "component_id"), "classes")
    return split_join(prints, classes, ["fingerprint"]).select("doc_id", "fingerprint", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document: shingles of 3 words, links at 2 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
