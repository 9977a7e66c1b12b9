"""SimHash near-duplicates found with sharded BK-trees.

A document's fingerprint has a bit set where more than half of the hashes of
its word shingles have it set.  Documents are linked when their fingerprints
differ in at most ``radius`` bits, and a group is a connected component.

Copies first collapse to distinct fingerprints.  Those are dealt to shards so
that each pair within the radius meets in at least one: the 64 bits are cut
into ``blocks`` runs, and of any two such fingerprints at least
``blocks - radius`` runs agree, so there is a shard for each choice of that many
runs and each value of them.  A shard's fingerprints form a BK-tree, whose
children are keyed by their integer Hamming distance to the parent; a search
follows only the edges within the radius.  A node also knows whether all below
it already belong to one group, and a search passes over what its own group
holds, so a shard of many near copies costs little more than one of as many
strangers.  A shard emits a forest of links (fewer than its nodes), never all
its pairs.  Shards over ``shard_limit`` fingerprints are cut into parts and
each pair of parts is a shard of its own, so no task holds an unbounded one.

Near copies (``deduplicate``) are similar in the five-word sense but may differ in
too many bits of one fingerprint for exact sharding.  They are searched by a
longer fingerprint of shorter shingles, which an edit disturbs less: PRINTS
words of 64 bits of two-word shingles, cut into bands of BAND bits.  Texts meet
where a band agrees, in a BK-tree over their first two words.  A group found so
only says who is compared: a document goes if the Jaccard similarity of its own
five-word shingles with a document that stays is LEAST or more, and stays
otherwise.

Trees are not broadcast, as their total grows with the corpus: queries and
tree meet by the shard's key instead, and a shard's size is bounded.

The input of ``deduplicate`` must be a table read from files (or written by
``durable``), so that its rows come in the same order each time they are read.

Cases: null counts as empty; texts without words have fingerprint zero and are
linked like any other; texts with fewer words than a shingle have one shingle;
rows of a repeated or null doc_id are rows like others (a component whose ids
are all null has the id null); an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import LOWER, fresh
from loomframe.llm.components import components
from loomframe.session import durable, release

SEED = 42
BITS = 64
#: Fingerprints of a shard before it is cut into parts.
SHARD_LIMIT = 4096
#: Runs beyond the radius.  With two, each fingerprint has comb(radius + 2, 2) shards, of which there
#: are about 2**20; a third run suits tables of over a hundred million distinct fingerprints.
SPARE = 2
#: One in so many fingerprints is counted to find large shards.
SAMPLED = 16
#: Near copies: words of the shingles that are fingerprinted, 64-bit words of a fingerprint, bits of a band,
#: and how far the first two words may differ.  A band is agreed on by one in 1 / 0.9**BAND of the pairs just similar
#: enough; there should be more values of a band than documents, so a corpus of billions takes wider bands and more prints.
CANDIDATE_WORDS, PRINTS, BAND, RADIUS = 2, 8, 20, 22
#: Least similarity of a near copy; leaders of a round, at first and at most; rows that share one copy of the leaders.
LEAST, LEADERS, MOST_LEADERS, PER_SALT = 0.8, 8, 64, 512
#: Shingles hashed before their bits are added up.
STEP = 1 << 15


def other_hash(h: np.ndarray) -> np.ndarray:
    """Another hash from a hash (the finaliser of splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included, in blocks joined in order; none without words."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, words: int, prints: int = 1) -> list[int]:
    """SimHashes of the text's word shingles as unsigned integers; the first is of XXH64 itself."""
    hashes = shingles(text, words)
    if not len(hashes):
        return [0] * prints
    ones = np.zeros(prints * BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        h = [hashes[at : at + STEP]]
        while len(h) < prints:
            h.append(other_hash(h[-1]))
        bits = np.unpackbits(np.stack(h, 1).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)  # a step has fewer rows than 2**16
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").tolist()


class Tree:
    """BK-tree over the fingerprints of a shard that links each new one to its group.

    Nodes are lists [fingerprint, index, children, uniform, name]; ``uniform`` is
    an index whose group holds everything below the node, or -1.
    """

    def __init__(self, radius: int):
        self.radius, self.root, self.parent = radius, None, []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, value: int, name: int = 0) -> list[int]:
        """Insert and return the names of the nodes, one for each other group, that it links to."""
        me = len(self.parent)
        self.parent.append(me)
        if self.root is None:
            self.root = [value, me, {}, me, name]
            return []
        radius, found, group = self.radius, [], me
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[3] >= 0 and self.find(node[3]) == group:
                continue
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                other = self.find(node[1])
                if other != group:
                    self.parent[group] = other
                    group = other
                    found.append(node[4])
            for edge, child in node[2].items():
                if -radius <= edge - d <= radius:
                    todo.append(child)
        node, path = self.root, []
        while True:
            path.append(node)
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, me, {}, me, name]
                break
            node = child
        for node in path:
            if node[3] >= 0 and self.find(node[3]) != group:
                node[3] = -1
        for node in reversed(path):
            if node[3] < 0 and len(node[2]) < 8:
                self.settle(node)
        return found

    def settle(self, node: list) -> None:
        group = self.find(node[1])
        if all(c[3] >= 0 and self.find(c[3]) == group for c in node[2].values()):
            node[3] = group


def runs_of(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of the runs that the 64 bits are cut into."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choices(radius: int, spare: int = SPARE) -> list[int]:
    """Masks of the runs that may agree: of fingerprints within the radius, one choice of ``spare`` runs does."""
    return [sum(((1 << w) - 1) << s for s, w in chosen) for chosen in combinations(runs_of(radius + spare), spare)]


def bands(prints: int, width: int) -> list[tuple[int, int, int]]:
    """(first word, shift in it, width) of the successive bands of a fingerprint of several words."""
    return [(at // BITS, at % BITS, width) for at in range(0, prints * BITS - width + 1, width)]


def _word(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64)


def exact_shards(prints: DataFrame, radius: int, spare: int = SPARE) -> DataFrame:
    """(shard, bits, a, b, node) of each fingerprint p0 in each of its shards: every pair within the radius meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _word(batch, "p0")
            for number, mask in enumerate(choices(radius, spare)):
                yield _shard_batch(number, fp & np.uint64(mask), fp, np.zeros(len(fp), np.uint64), batch)

    return prints.select("node", "p0").mapInArrow(run, SHARD_SCHEMA)


def band_shards(prints: DataFrame, count: int, width: int) -> DataFrame:
    """(shard, bits, a, b, node) of each fingerprint of ``count`` words in the shard of each of its bands.

    a and b are its first two words, which the trees compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_word(batch, n) for n in _columns(count)]
            for number, (at, shift, size) in enumerate(bands(count, width)):
                bits = words[at] >> np.uint64(shift)
                if shift + size > BITS:
                    bits = bits | words[at + 1] << np.uint64(BITS - shift)
                yield _shard_batch(number, bits & np.uint64((1 << size) - 1), words[0], words[1], batch)

    return prints.select("node", *_columns(count)).mapInArrow(run, SHARD_SCHEMA)


SHARD_SCHEMA = "shard int, bits long, a long, b long, node long"


def _shard_batch(number: int, bits: np.ndarray, a: np.ndarray, b: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    node = batch.column(batch.schema.get_field_index("node"))
    columns = [pa.array(np.full(len(bits), number, np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (bits, a, b)), node]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "bits", "a", "b", "node"])


def _columns(count: int) -> list[str]:
    return [f"p{k}" for k in range(count)]


def _forest(radius: int):
    """Links of each run of rows with one key, in a partition sorted by key."""

    def links(values: np.ndarray, out: list[tuple[int, int]]) -> None:
        if len(values) == 2:
            (a, x, u), (b, y, v) = values.tolist()
            if (a ^ b).bit_count() + (x ^ y).bit_count() <= radius:
                out.append((u, v))
            return
        tree = Tree(radius)
        for a, x, u in values.tolist():
            out.extend((u, v) for v in tree.add(a | x << BITS, u))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = None, None
        out: list[tuple[int, int]] = []
        for batch in batches:
            k, v = (np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in own], 1) for own in ((0, 1, 2), (3, 4, 5)))
            v = v.view(np.uint64)
            if keys is not None:
                k, v = np.concatenate([keys, k]), np.concatenate([held, v])
            if not len(v):
                continue
            edges = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            starts = np.concatenate([[0], edges])
            ends = np.concatenate([edges, [len(v)]])
            for i in np.flatnonzero(ends[:-1] - starts[:-1] > 1):
                links(v[starts[i] : ends[i]], out)
            keys, held = k[starts[-1] :], v[starts[-1] :]
            if len(out) > 1 << 16:
                yield as_batch(out)
                out = []
        if held is not None and len(held) > 1:
            links(held, out)
        if out:
            yield as_batch(out)

    def as_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(out, dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    return run


def links(prints: DataFrame, sharded, radius: int, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(u, v) pairs of nodes that connect whatever lies within the radius and meets in a shard.

    ``sharded`` makes the shard rows of such a table.  Large shards are found by
    counting one in SAMPLED nodes; that only plans how a shard is cut, and every
    node meets every other of its shard whether it is cut or not.
    """
    sampled = sharded(prints.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SAMPLED)) == 0))
    # a cut shard has many sampled rows, so this table is a small part of the sample
    large = sampled.groupBy("shard", "bits").agg((F.count(F.lit(1)) * SAMPLED).alias("n")).where(F.col("n") > shard_limit)
    large = large.select("shard", "bits", F.ceil(F.col("n") / shard_limit).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, mine) * F.col("parts") + F.greatest(o, mine))
    rows = sharded(prints).join(large, ["shard", "bits"], "left")
    dealt = rows.select("shard", "bits", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(pair)).alias("part"), "a", "b", "node")
    key = ["shard", "bits", "part"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_forest(radius), "u long, v long")


def fingerprints(docs: DataFrame, words: int, count: int = 1) -> DataFrame:
    """row_id, doc_id and the fingerprints p0, p1, ... of every row."""
    names = _columns(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py() or b"", words, count) for t in batch.column(2)], np.uint64).reshape(-1, count).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, k]) for k in range(count))], names=["row_id", "doc_id", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "row_id long, doc_id long, " + ", ".join(f"{n} long" for n in names))


def groups(docs: DataFrame, words: int = 4, radius: int = 4, spare: int = SPARE, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, p0 and component_id (the group's smallest doc_id) of every row; a node is a distinct fingerprint."""
    rows = durable(fingerprints(docs, words), "simhash")
    prints = durable(rows.groupBy(F.col("p0").alias("node"), "p0").agg(F.min("doc_id").alias("first")), "prints")
    roots = durable(components(links(prints, lambda p: exact_shards(p, radius, spare), radius, shard_limit)), "roots")
    # only nodes with a link are in roots; the others are groups of their own.  Tables that are joined on a key
    # that may be hot are written first, so that the join deals out both sides and can split a hot key's rows.
    linked = roots.join(prints.select("node", "first"), "node")
    least = durable(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = linked.select("node", "root").join(least, "root")
    by_node = prints.select("node", "first").join(named, "node", "left")
    by_node = durable(by_node.select("node", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")), "by-node")
    for done in (prints, roots, least):
        release(done)
    return rows.join(by_node, rows["p0"] == by_node["node"]).select("doc_id", "p0", "component_id")


def mark(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    found = groups(docs, words, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(docs: DataFrame, words: int = CANDIDATE_WORDS, count: int = PRINTS, width: int = BAND, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(row_id, doc_id, root) of the rows that share a group of near fingerprints with another row."""
    names = _columns(count)
    rows = durable(fingerprints(docs, words, count), "simhash")
    # a node is a distinct fingerprint, named by one of its rows
    prints = durable(rows.groupBy(*names).agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("n")), "prints")
    roots = durable(components(links(prints, lambda p: band_shards(p, count, width), radius, shard_limit)), "roots")
    several = prints.join(roots, "node", "left").where("root is not null or n > 1").select(*names, F.coalesce("root", "node").alias("root"))
    found = durable(rows.join(durable(several, "several"), names).select("row_id", "doc_id", "root"), "grouped")
    for done in (rows, prints, roots):
        release(done)
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both)


def _settle(words: int, least: float):
    """Settle the rows of each (root, salt), of which the leaders come first and in order.

    A row is a copy if it is similar to a leader that stays; a leader is compared
    with the leaders before it.  ``state`` becomes 1 for rows that stay, 2 for
    copies and 0 for rows that no leader settles, whose texts are passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stay = None, []
        for batch in batches:
            state, texts = [], []
            for root, salt, place, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(5), strict=True):
                if (root, salt) != key:
                    key, stay = (root, salt), []
                data = text.as_py() or b""
                own = np.unique(shingles(data, words))
                copy = any(min(len(own), len(x)) >= least * max(len(own), len(x)) and similarity(own, x) >= least for x in stay)
                if place >= 0 and not copy:
                    stay.append(own)
                state.append(2 if copy else 1 if place >= 0 else 0)
                texts.append(data if state[-1] == 0 else None)
            columns = [batch.column(0), batch.column(3), batch.column(4), pa.array(state, pa.int32()), pa.array(texts, pa.binary())]
            keep = pa.array([p < 0 or s == 0 for p, s in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays(columns, names=["root", "row_id", "doc_id", "state", "text"]).filter(keep)

    return run


def copies(docs: DataFrame, grouped: DataFrame, words: int = 5, least: float = LEAST, leaders: int = LEADERS, per_salt: int = PER_SALT) -> DataFrame:
    """row_id of the rows that are similar to an earlier row of their group which stays.

    Rows of a group are taken in order (doc_id, null last, then row_id), and a
    row stays unless its shingles have a Jaccard similarity of ``least`` or more
    with a row that stays before it.  A round settles a group's first
    ``leaders`` rows among themselves and compares all others with those that
    stay; a large group's rows are salted, with its leaders in each salt.  Each
    round has twice the leaders of the one before, up to MOST_LEADERS.
    """
    body = F.col("text").cast("string").cast("binary").alias("text")
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), body)
    pending = durable(texts.join(grouped, "row_id").select("root", "row_id", "doc_id", "text"), "near-pending")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    gone = None
    while True:
        sizes = pending.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        first = pending.select("root", "row_id", "doc_id").withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order)) - 1).where(F.col("place") < leaders)
        first = durable(first.select("row_id", "place"), "near-leaders")
        # written, so that the join deals both sides anew and a large group's rows can be split
        sizes = durable(sizes.select("root", F.ceil(F.col("n") / per_salt).cast("int").alias("salts")), "near-sizes")
        rows = pending.join(sizes, "root").join(first, "row_id", "left").withColumn("place", F.coalesce("place", F.lit(-1)))
        salt = F.when(F.col("place") >= 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int")))
        dealt = rows.select("root", F.explode(salt).alias("salt"), "place", "row_id", "doc_id", "text")
        last = F.when(F.col("place") < 0, leaders).otherwise(F.col("place"))
        sorted_ = dealt.repartition("root", "salt").sortWithinPartitions("root", "salt", last)
        after = durable(sorted_.mapInArrow(_settle(words, least), "root long, row_id long, doc_id long, state int, text binary"), "near-settled")
        for done in (pending, first, sizes):
            release(done)
        found = after.where("state = 2").select("row_id")
        gone = found if gone is None else gone.unionByName(found)
        pending = after.where("state = 0").select("root", "row_id", "doc_id", "text")
        if pending.isEmpty():
            return gone
        leaders = min(2 * leaders, MOST_LEADERS)


def deduplicate(docs: DataFrame, words: int = 5, least: float = LEAST, **search) -> DataFrame:
    """The rows that stay, with all their columns: no near copy of an earlier row of their group that stays."""
    grouped = candidates(docs, **search)
    row = fresh(docs, "row_id")
    gone = copies(docs, grouped, words, least).withColumnRenamed("row_id", row)
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)
