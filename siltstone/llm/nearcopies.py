"""Near copies by the exact similarity of shingle sets, with candidates from SimHash fingerprints in BK-trees.

Two texts are near copies if their sets of shingles have a Jaccard similarity of at least SIMILARITY. A class is what
such pairs connect; no other link makes one.

Fingerprints: each of 64 * WIDTH hashed signs is summed over a text's shingle *set* (repeats count once, as they do in the
similarity); the signs of the sums are the fingerprint. Two sets at the similarity differ in at most the share WORST of
the bits on average (sets of 4 and 5 shingles; 0.152 for long texts); RADIUS is 4 standard deviations above that, 5.9
above the mean of long texts.

Shards: at such a radius a BK-tree over all nodes prunes little, so trees are small and a node is in several of them.
The sums are turned by fixed random matrices and cut into blocks; place and sign of the strongest entry of a few blocks
name a shard. Two sets at the similarity have a cosine of 8/9 or more, which gives the chance that they share such a name
(`chance`); `choices` takes blocks so large that a shard has about SHARD_NODES unrelated nodes, whatever their number,
and so many names that a pair at the similarity shares none in MISS of cases. The number of names grows with the
logarithm of the number of documents. The links of the trees are only used to put texts that may be near copies into one
group, so what their forests drop loses nothing.

Verification: the texts of a group of up to `piece` are compared by their shingle sets, through an index of who holds each
shingle; of the pairs at the similarity those are kept that connect what is not connected yet. In a larger group about STARS of its texts are compared
with all others first; then the texts that are still outside the largest class of their group are compared with all of it,
piece by piece.

Defined cases: texts that are equal are one; a null text is one text; texts without words are near copies of each other
only; rows that share a doc_id and differ in text are different documents; a null doc_id takes part and comes after all
others; an empty table gives an empty result. Texts and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import WordHashes, parts, split_join, stored, window_hashes
from siltstone.llm.simhash import BROADCAST_ROWS, MAX_TREE, PART, bit_counts, connected, near_links, rest_rows, sized, star_rows, whole_rows

SHINGLE, SIMILARITY, WIDTH = 5, 0.8, 4
WORST, MISS, SHARD_NODES = 3 / 16, 2e-3, 4
RADIUS = math.ceil(64 * WIDTH * WORST + 4 * math.sqrt(64 * WIDTH * WORST * (1 - WORST)))
#: The cosine of two sets at the similarity, less the standard error that sums over 64 * WIDTH signs have of it.
COSINE = 8 / 9 - (1 - (8 / 9) ** 2) / math.sqrt(64 * WIDTH)
#: Texts of a group that a task holds at most, and texts of a large group that all others are compared with first.
PIECE, STARS = 1024, 256
#: Texts whose names are found at a time.
TOGETHER = 256
WORDS = [f"p{i}" for i in range(WIDTH)]


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text with words is one shingle."""
    found, carry = [], np.zeros(0, np.uint64)
    for part in parts((text or "").encode("utf-8", "surrogatepass").lower(), PART):
        words = np.concatenate((carry, hashes.array(part)))
        found.append(window_hashes(words, SHINGLE))
        carry = words[max(0, len(words) - SHINGLE + 1) :]
    if len(carry) and not sum(map(len, found)):
        found.append(window_hashes(carry, len(carry)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sign_sums(hashes: np.ndarray) -> np.ndarray:
    """The sums of 64 * WIDTH hashed signs over a shingle set."""
    return 2 * np.concatenate([bit_counts(hashes, w) for w in range(WIDTH)]) - len(hashes)


@cache
def chance(block: int, cosine: float = COSINE) -> float:
    """How often two vectors of this cosine have their strongest of `block` random entries in one place, with one sign;
    by 20,000 draws that are always the same."""
    rng = np.random.default_rng(block)
    a = rng.standard_normal((20_000, block))
    b = cosine * a + math.sqrt(1 - cosine * cosine) * rng.standard_normal((20_000, block))
    i, j, row = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1), np.arange(len(a))
    return float(((i == j) & ((a[row, i] > 0) == (b[row, j] > 0))).mean())


def choices(nodes: int) -> tuple[int, int, int]:
    """(names, blocks of each name, entries of a block) for so many documents: as few names as do."""
    need = math.log2(max(nodes, 256) / SHARD_NODES)
    able = [(k, d) for k in range(1, 9) for d in (16, 32, 64, 128, 256) if k * (1 + math.log2(d)) >= need]
    return min((math.ceil(math.log(MISS) / math.log1p(-(chance(d) ** k))), k, d) for k, d in able)


def _turned(names: int, blocks: int, entries: int) -> np.ndarray:
    """The matrix that gives the entries of all blocks of all names; always the same one."""
    return np.random.default_rng(64 * WIDTH).standard_normal((64 * WIDTH, names * blocks * entries)).astype(np.float32)


def shard_names(sums: np.ndarray, names: int, blocks: int, entries: int, turn: np.ndarray) -> np.ndarray:
    """The names (texts, names), as longs, of the shards of texts with these sign sums."""
    turned = (sums.astype(np.float32) @ turn).reshape(len(sums), names, blocks, entries)
    at = np.abs(turned).argmax(axis=3)
    code = 2 * at + (np.take_along_axis(turned, at[..., None], axis=3)[..., 0] > 0)
    name = np.broadcast_to(np.arange(names), code.shape[:2]).astype(np.int64)
    for b in range(blocks):
        name = name * (2 * entries) + code[:, :, b]
    return name


def _prints(how: tuple[int, int, int]):
    """doc_id, member, the words of the fingerprint and the keys of the shards of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, turn = WordHashes(), _turned(*how)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                sums = np.array([sign_sums(shingle_set(x.as_py(), hashes)) for x in batch.column("text")], np.int64).reshape(-1, 64 * WIDTH)
                prints = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8")
                keys = shard_names(sums, *how, turn)
                columns = {"doc_id": batch.column("doc_id"), "member": batch.column("member")} | {n: pa.array(prints[:, i]) for i, n in enumerate(WORDS)}
                columns["keys"] = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * how[0]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


class Sets:
    """The shingle sets of one piece, and an index of who holds each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owner = owner[order]
        self.keys, self.starts = np.unique(hashes[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(hashes))

    def similar(self, found: np.ndarray) -> np.ndarray:
        """The texts whose sets have the similarity to this one; empty sets have it to each other."""
        if not len(found):
            return np.flatnonzero(self.sizes == 0)
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        at = at[self.keys[at] == found] if len(self.keys) else at[:0]
        n = self.ends[at] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((common >= SIMILARITY * (self.sizes + len(found) - common)) & (common > 0))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (shard, piece, is_query, node, text) in this order: verified links (a, b) that connect all near copies among
    the rows of a piece, and between them and its queries."""
    key, names, sets, index, component, links, hashes = None, [], [], None, np.zeros(0, np.int64), [], WordHashes()

    def join(name: int, mine: int, near: np.ndarray) -> None:
        """Links of one text to the texts near it, one to each component."""
        while len(near):
            links.append((names[near[0]], name))
            component[component == component[near[0]]] = mine
            near = near[component[near] != mine]

    def indexed() -> None:
        """The index of the texts so far, and their own links."""
        nonlocal index, component
        index, component = Sets(sets), np.arange(len(sets))
        for i in range(1, len(sets)):
            near = index.similar(sets[i])
            near = near[near < i]
            join(names[i], int(component[i]), near[component[near] != component[i]])

    for batch in batches:
        shard, piece, query, node = (batch.column(c).to_pylist() for c in ("shard", "piece", "is_query", "node"))
        for i, text in enumerate(batch.column("text")):
            if key != (shard[i], piece[i]):
                if index is None and len(sets) > 1:
                    indexed()
                key, names, sets, index = (shard[i], piece[i]), [], [], None
            found = shingle_set(text.as_py(), hashes)
            if not query[i]:
                names.append(node[i])
                sets.append(found)
            elif sets:
                if index is None:
                    indexed()
                join(node[i], -1 - i, index.similar(found))
        made = np.array(links, np.int64).reshape(-1, 2)
        links.clear()
        yield pa.RecordBatch.from_pydict({"a": pa.array(made[:, 0]), "b": pa.array(made[:, 1])})
    if index is None and len(sets) > 1:
        indexed()
    made = np.array(links, np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_pydict({"a": pa.array(made[:, 0]), "b": pa.array(made[:, 1])})


def verified_links(rows: DataFrame, members: DataFrame, piece: int = PIECE, stars: int = STARS) -> DataFrame:
    """Links (a, b) between near copies of one group. rows: (node, text), repeats allowed; members: one row for each
    distinct text `node` with its group `shard` and the group's size `n`."""
    wanted = stored(members.select("node"), "wanted")
    texts = stored(rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "node", "left_semi").dropDuplicates(["node"]), "group-texts")

    def links(placed: DataFrame) -> DataFrame:
        dealt = placed.select("shard", "piece", "is_query", "node").join(texts, "node").select("shard", "piece", "is_query", "node", "text")
        return dealt.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "is_query", "node").mapInArrow(_verified, "a long, b long")

    found = links(whole_rows(members.filter(F.col("n") <= piece)))
    large = stored(members.filter(F.col("n") > piece), "large-groups")
    if large.isEmpty():
        return found
    first = stored(found.unionByName(links(star_rows(large, min(piece, stars)))), "verified")
    return first.unionByName(links(rest_rows(large, connected(first), piece)))


def near_copies(docs: DataFrame, max_tree: int = MAX_TREE, piece: int = PIECE, stars: int = STARS) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, member (the hash of its text), and the first document of its class:
    component_id, the smallest doc_id, and component_member, of its texts the one with the smallest hash."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("member"))
    how = choices(rows.count())
    made = rows.mapInArrow(_prints(how), ", ".join(["doc_id long, member long", *(f"{w} long" for w in WORDS), "keys array<long>"]))
    prints = stored(made.withColumn("node", F.xxhash64(*WORDS)), "prints")
    nodes = stored(prints.groupBy("node").agg(*[F.first(c).alias(c) for c in (*WORDS, "keys")]), "nodes")
    groups = connected(near_links(nodes, RADIUS, max_tree, WIDTH))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "member")
    members = stored(prints.groupBy("member").agg(F.min(order).alias("first"), *[F.min(c).alias(c) for c in ("node", *WORDS)]), "members")
    grouped = stored(split_join(members, groups, ["node"], "left").select(F.col("member").alias("node"), "first", *WORDS, F.coalesce("root", "node").alias("shard")), "grouped")
    roots = connected(verified_links(rows.select(F.col("member").alias("node"), "text"), grouped.join(sized(grouped), "shard"), piece, stars))
    rooted = stored(grouped.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = stored(split_join(rooted, least, ["root"]).select(F.col("node").alias("member"), F.col("least.doc_id").alias("component_id"), F.col("least.member").alias("component_member")), "classes")
    return split_join(prints.select("doc_id", "member"), classes, ["member"])
