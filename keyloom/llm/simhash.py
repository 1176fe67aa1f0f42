"""SimHash near-duplicate detection: fingerprints, pigeonhole blocks, verified Hamming links, components.

Fingerprints are computed where the text is read, so only (doc_id, 64 bits) moves. Equal fingerprints collapse to one
row before any blocking, and every join on a key that many rows can share deals these rows over ``SALTS`` tasks. Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks``
blocks, so keys made of every choice of that many blocks put each close pair into some common bucket. A bucket is never
expanded into pairs: it yields the edges of a spanning forest found by search over verified Hamming distances, at most
one per member. A bucket over ``CELL`` members is dealt into cells holding two chunks each, every pair of chunks once, so
no task holds a whole hot bucket and no link is lost. Components come from alternating star contractions in Spark.

The pipeline's stage has rules of its own: it links documents whose sets of five-word shingles have a Jaccard similarity of
``STAGE_SIMILARITY`` or more. Such prints differ in some ten of 64 bits, too many for blocks of one print, so its prints are wide:
the first word is the SimHash of the set, the others are SimHashes of the same shingles under other hashes, and give ``KEYS`` blocks
each. Documents that share a block and differ in ``STAGE_RADIUS`` or fewer bits of the first word are candidates, and a link is verified
on the shingle sets themselves. A pair at 0.8 is missed with probability 0.001, one at 0.85 with 4e-5, by the angle between large sets.
The first few blocks are linked before the others, and of these only buckets that hold more than one component are looked at, so a
large group of copies crosses the network a few times and not once a block.

Nulls and empty texts have no words: fingerprint zero, linked like any other. A null doc_id keeps its row; it does not
take part in the minimum that names a component. Repeated rows are returned as often as they occur; ties do not arise, as ids
name components. An empty table gives no rows. Texts of any length are hashed whole. Columns beside the two that are read do
not matter, also where their names differ from these only in case. In the pipeline's stage rows are known by two hashes over
all their columns: of rows that are equal in id and text but not in another column one stays, of equal rows too.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import discard, materialize

from .common import map_texts, released

SHINGLE = 4
RADIUS = 4
#: Blocks of a fingerprint. Seven give 35 keys of some 27 bits: of 10^10 different prints, some 75 share a bucket by chance.
#: The result is the same for any number over the radius.
BLOCKS = 7
#: Members of one chunk of a hot bucket.
CELL = 16_384
#: Tasks among which the rows of one key are dealt.
SALTS = 8
#: Hashes whose bits are counted at once.
_CHUNK = 65_536
#: The pipeline's stage: words of a shingle, and the least similarity of a link.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Words of a wide print behind the first, blocks of a word, bits of a block, and the blocks that are linked first.
WIDE, KEYS, KEY_BITS, FIRST_KEYS = 64, 3, 20, 24
#: Most bits of the first word in which candidates differ. Unrelated sets are within it with probability 0.002.
STAGE_RADIUS = 20
#: Members of one chunk of a hot bucket of shingle sets, hashes whose bits are counted at once (in octets), and rows of a bucket
#: that are compared pair by pair before pivots take over.
SET_CELL, _WIDE_CHUNK, _PAIRS = 1_024, 255, 32


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hash of each shingle of one text given as UTF-8; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()  # bytes.lower and bytes.split are the ASCII rules asked for
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a + 1 : b], seed) for a, b in zip(ends, ends[width:])), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """64-bit SimHash of one text given as UTF-8."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, **cols: str) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def rows(batch: list[bytes]) -> list[list]:
        prints = np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64)
        return [prints.view(np.int64)]

    return map_texts(docs, "fp long", rows, **cols)


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bucket keys: every choice of ``blocks - radius`` of the blocks."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_edges(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of each component of more than one print; the root is its smallest print."""
    left = np.unique(prints.astype(np.int64))
    members, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                members.append(found)
                roots.append(np.full(len(found), root))
    none = np.empty(0, np.int64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (none, none)


def _merged(df: DataFrame) -> DataFrame:
    """A side of a sort-merge join. It grows with the input, and the size Spark broadcasts by knows nothing of salts or compression."""
    return df.hint("merge")


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows of one key get different salts, by another column."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _for_all(df: DataFrame) -> DataFrame:
    """A row for each salt, to be joined with dealt rows."""
    return _merged(df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def _cells(member: str, cell: int) -> F.Column:
    """Cells of a bucket of ``n`` members that one member is dealt to: its chunk with every chunk."""
    chunks = F.ceil(F.col("n") / cell).cast("int")
    chunk = F.pmod(F.xxhash64(member), chunks).cast("int")
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(j, chunk).alias("a"), F.greatest(j, chunk).alias("b")))


def close_edges(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Distinct (u, v), u > v: within each bucket, a spanning forest of the links at ``radius`` or fewer bits.

    ``prints`` has distinct longs ``fp``.
    """
    masks = block_masks(blocks, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("key")).select("key.k", "key.bits", "fp")
    crowded = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
    dealt = _dealt(keyed, "fp").join(_for_all(crowded), ["k", "bits", "salt"]).select("k", "bits", "fp", F.explode(_cells("fp", cell)).alias("cell"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = dealt.repartition(parts, "k", "bits", "cell").groupBy("k", "bits", "cell").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            found = [spanning_edges(flat[a:b], radius) for a, b in zip(offsets, offsets[1:])]
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return lists.mapInArrow(released(run), "u long, v long").distinct()


def components(edges: DataFrame, few: bool = False) -> DataFrame:
    """(u, root) for every node that is not the smallest of its component, by alternating large and small stars.

    A hub's neighbours are never gathered: minima are partial aggregates, joined back to edges that are salted by their
    other end, so a hub's edges spread over ``SALTS`` tasks. Each round's edges are written to the shared folder, so a
    lost executor costs one round at most. ``few``: in few files.
    """

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())

    now = materialize(edges, "edges", few)
    mark = signature(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _dealt(both, "v").join(_for_all(least), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _dealt(large, "v").join(_for_all(small_least), ["u", "salt"])
        after = (
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).distinct()
        )
        before, now = now, materialize(after, "edges", few)
        was, mark = mark, signature(now)
        discard(before)
        if mark == was:
            break
    return now.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, **cols: str) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document."""
    prints = materialize(fingerprints(docs, shingle, **cols), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    roots = components(close_edges(distinct.select("fp"), radius, blocks))
    named = distinct.join(_merged(roots), distinct["fp"] == roots["u"], "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    # A print that one document has and no other is near to names its document's component by itself.
    classes = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("members")).where("members > 1")
    shared = _dealt(named.select("fp", "root"), "fp").join(_for_all(classes), ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("shared"))
    # By position, as a null id has no hash of its own to spread a hot print's rows.
    spread = prints.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = spread.join(_for_all(shared), ["fp", "salt"], "left")
    component = F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def shingle_set(text: bytes, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, shingle))


@cache
def _salts() -> np.ndarray:
    """What is added to a hash for each word of a wide print behind the first."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(b"simhash", i) for i in range(1, WIDE + 1)], np.uint64)


def wide_print(members: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes, and ``WIDE`` more under other hashes; none of an empty set."""
    if not len(members):
        return np.empty(0, np.int64)
    set_bits = np.zeros(64 * (WIDE + 1), np.int64)
    for at in range(0, len(members), _WIDE_CHUNK):
        part = members[at : at + _WIDE_CHUNK, None]
        mixed = part + _salts()
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(odd)
        mixed ^= mixed >> np.uint64(31)
        octets = np.concatenate([part, mixed], axis=1).view(np.uint8)
        set_bits += np.unpackbits(octets.ravel(), bitorder="little").reshape(len(part), -1).sum(axis=0, dtype=np.uint8)
    return np.packbits(set_bits * 2 > len(members), bitorder="little").view(np.int64)


def candidates(bucket: np.ndarray, size: np.ndarray, first: np.ndarray, similarity: float, radius: int = STAGE_RADIUS) -> np.ndarray:
    """Which rows, ordered by bucket and size, have another one in their bucket of a fitting size and ``radius`` or fewer bits away."""
    share = Fraction(str(similarity))
    fits = lambda less, more: size[less] * share.denominator >= size[more] * share.numerator
    near = lambda i, j: np.bitwise_count((first[i] ^ first[j]).view(np.uint64)) <= radius
    found = np.zeros(len(bucket), bool)
    at = np.arange(len(bucket))
    for step in range(1, _PAIRS + 1):
        at = at[at + step < len(bucket)]
        at = at[(bucket[at] == bucket[at + step]) & fits(at, at + step)]
        if not len(at):
            return found
        close = at[near(at, at + step)]
        found[close] = found[close + step] = True
    # What is left starts runs of more rows than that. A row that is found needs no look of its own.
    starts = np.unique(np.searchsorted(bucket, bucket[at]))
    for a, b in zip(starts, np.searchsorted(bucket, bucket[starts], "right")):
        for i in range(a, b):
            if found[i]:
                continue
            low = a + np.searchsorted(size[a:b] * share.denominator, size[i] * share.numerator)
            high = a + np.searchsorted(size[a:b] * share.numerator, size[i] * share.denominator, "right")
            close = low + np.flatnonzero(near(np.arange(low, high), i))
            if len(close) > 1:  # the row itself is one
                found[close] = True
    return found


def close_members(distinct: DataFrame, similarity: float) -> DataFrame:
    """(key, node): the members of each block's buckets that have a candidate there. ``distinct`` has (node, words, n)."""
    mask = (1 << KEY_BITS) - 1
    words = distinct.select("node", "n", F.col("words")[0].alias("first"), F.posexplode(F.slice("words", 2, WIDE)).alias("at", "word"))
    block = lambda j: F.shiftleft((F.col("at") * KEYS + j).cast("long"), KEY_BITS) + F.shiftrightunsigned("word", KEY_BITS * j).bitwiseAND(mask)
    # Sizes are the low half of a key, so that a bucket's rows are ordered by them.
    keys = F.explode(F.array(*[F.shiftleft(block(j), 32) + F.col("n") for j in range(KEYS)]))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.select(keys.alias("key"), "node", "first").repartition(parts, F.shiftright("key", 32)).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            key, node, first = (np.concatenate(x) for x in zip(*held))
            some = candidates(key >> 32, key & 0xFFFFFFFF, first, similarity)
            return pa.RecordBatch.from_arrays([pa.array(key[some] >> 32), pa.array(node[some])], names=["key", "node"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).copy() for c in batch.columns]
            bucket = columns[0] >> 32
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if held and held[-1][0][-1] >> 32 != bucket[0]:
                yield found()
                held = []
            if last:
                held.append([c[:last] for c in columns])
                yield found()
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield found()

    return ordered.mapInArrow(released(run), "key long, node long")


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of a spanning forest of the pairs of sets with this Jaccard similarity or more; roots are smallest."""
    share = Fraction(str(similarity))
    order = np.unique(nodes, return_index=True)[1]
    nodes, sets = nodes[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(nodes))
    members, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            one = sets[queue.pop()]
            some = sizes[left]
            fits = left[(np.minimum(some, len(one)) * share.denominator >= np.maximum(some, len(one)) * share.numerator)]
            if not len(fits):
                continue
            flat = np.concatenate([sets[i] for i in fits])
            at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
            starts = np.concatenate([[0], np.cumsum(sizes[fits])[:-1]])
            both = np.add.reduceat((one[at] == flat).astype(np.int64), starts)
            found = fits[both * share.denominator >= (sizes[fits] + len(one) - both) * share.numerator]
            if len(found):
                left = left[~np.isin(left, found)]
                queue.extend(found)
                members.append(nodes[found])
                roots.append(np.full(len(found), nodes[root]))
    none = np.empty(0, np.int64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (none, none)


def similar_edges(buckets: DataFrame, sets: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Distinct (u, v), u > v: within each bucket, a spanning forest of the links at ``similarity`` or more.

    ``buckets`` has (key, node, n), ``sets`` has (node, members). A bucket's rows follow each other and are held one
    cell at a time.
    """
    dealt = buckets.select("key", "node", F.explode(_cells("node", cell)).alias("cell")).join(_merged(sets), "node").select("key", "cell.a", "cell.b", "node", "members")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> pa.RecordBatch:
            u, v = similar_links(np.array(nodes, np.int64), held, similarity)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        now, nodes, held = None, [], []
        for batch in batches:
            lists = batch.column(4)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()  # sorted as such
            names = batch.column(3).to_numpy(zero_copy_only=False)
            for i, at in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if at != now:
                    if len(nodes) > 1:
                        yield edges()
                    now, nodes, held = at, [], []
                nodes.append(names[i])
                held.append(flat[offsets[i] : offsets[i + 1]].copy())
        if len(nodes) > 1:
            yield edges()

    return ordered.mapInArrow(released(run), "u long, v long").distinct()


def _similar_roots(small: DataFrame, prints: DataFrame, shingle: int, similarity: float, cell: int) -> DataFrame:
    """(u, root) of the nodes (different shingle sets) that are linked to a smaller one."""
    known = [F.first("words").alias("words"), F.first("n").alias("n"), F.min("key").alias("key")]
    distinct = materialize(prints.groupBy("node").agg(*known), "distinct", few=True)
    close = materialize(close_members(distinct, similarity), "close", few=True)
    near = close.select("node").distinct()
    wanted = distinct.select("node", "key").join(_merged(near), "node", "left_semi").select("key.a", "key.b", "node")
    chosen = small.select("doc_id.key.a", "doc_id.key.b", "text").join(_merged(wanted), ["a", "b"])
    # Rows that are equal in id and text have the same node: one of them is enough. The join has dealt them by what they share.
    chosen = chosen.dropDuplicates(["a", "b"]).select(F.col("node").alias("doc_id"), "text")

    def members(batch: list[bytes]) -> list[list]:
        return [[shingle_set(t, shingle).view(np.int64) for t in batch]]

    sets = materialize(map_texts(chosen, "members array<long>", members).withColumnRenamed("doc_id", "node"), "sets", few=True)
    first = close.where(F.col("key") < FIRST_KEYS << KEY_BITS)
    full = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    edges = materialize(similar_edges(first.join(_merged(full), "key"), sets, similarity, cell), "links", few=True)
    roots = materialize(components(edges, few=True), "roots", few=True)
    rest = close.where(F.col("key") >= FIRST_KEYS << KEY_BITS).join(_merged(roots), F.col("node") == F.col("u"), "left")
    rest = rest.select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "n")
    more = similar_edges(rest.select("key", "node").join(_merged(mixed), "key"), sets, similarity, cell)
    return components(roots.select("u", F.col("root").alias("v")).union(more).distinct(), few=True)


def _row_key(docs: DataFrame) -> F.Column:
    """Two hashes over all columns that can be hashed."""
    known = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.struct(F.xxhash64(*known).alias("a"), F.xxhash64(F.lit("twin"), *known[::-1]).alias("b"))


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, cell: int = SET_CELL) -> DataFrame:
    """The rows of ``docs``, all columns, of one document a component: that with the smallest id, null ids last.

    Documents are linked if their shingle sets have ``similarity`` or more.
    """
    import xxhash

    taken = {c.lower() for c in docs.columns}
    a, b = [name for i in range(len(taken) + 2) if (name := f"key{i}") not in taken][:2]
    key = _row_key(docs)
    keyed = docs.withColumns({a: key["a"], b: key["b"]})
    small = docs.select(F.struct(F.col("doc_id").alias("id"), key.alias("key")).alias("doc_id"), "text")

    def rows(batch: list[bytes]) -> list[list]:
        sets = [shingle_set(t, shingle) for t in batch]
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        return [nodes, [len(x) for x in sets], [wide_print(x) for x in sets]]

    made = map_texts(small, "node long, n long, words array<long>", rows)
    prints = materialize(made.select("doc_id.id", "doc_id.key", "node", "n", "words"), "prints", few=True)
    roots = _similar_roots(small, prints, shingle, similarity, cell)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    # Copies share a node: the first of each is found before nodes meet their roots.
    of_nodes = prints.groupBy("node").agg(first.alias("first"))
    firsts = of_nodes.join(_merged(roots), F.col("node") == F.col("u"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = firsts.select(F.col("first.key.a").alias(a), F.col("first.key.b").alias(b))
    found = keyed.join(_merged(kept), [a, b], "left_semi").select(*keyed.columns)
    # What is left of equal rows is equal, so it does not matter which one stays. The join has dealt them by the same key: texts move once.
    return found.dropDuplicates([a, b]).drop(a, b)
