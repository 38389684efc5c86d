"""Near-dedup of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Similar sets A and B differ in at most (|A| + |B|) / 9 shingles. That makes the similarity a Hamming
distance with a bound, to which the pigeonring filter of ``simhash`` applies: the parities of the
shingles in SEGMENTS pieces are a vector in which no more bits can differ than shingles do, so around
the ring there is a piece from which every chain of pieces stays within its share of the bound. Candidates
must have such a piece, then pass the whole Hamming check, and are settled by the sets themselves: no
link is lost or made up. The vector has as many places as the set has shingles, or more, as in one much
shorter any two sets differ in less than the bound; of two widths, the wider is folded to the other.

Candidates share a shingle of their prefixes. All shingles stand in one order; of a set of n, the first
n - ceil(0.8 n) + 1 are its prefix, and two sets as similar as asked share a shingle of both. Of the first
that they share, as much must follow in each as they need in common, so a key gives no pair of which one
has it too late: if they are similar, an earlier key gives them. The order
is by the number of documents of a sample that hold the shingle, then by hash, so passages that many
documents share come last. Any order is exact; the sample only makes keys rare, and tells which keys
aren't: those are never dealt to one task.

Equal sets are one node from the start. A key of up to HOT nodes gives its pairs in one pass over sorted
rows. The nodes of a larger one are held against each other in arrays, in blocks of BLOCK nodes, and no pair
is put out that the filters reject. Of what passes, a node of a crowd is first settled with one other of each key,
the first in an order that all nodes share: that joins the copies of one document with as many pairs as
there are copies. What passes and is still in different components then is settled as well, so this is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import simhash
from tidelog.llm import textkit as tk
from tidelog.llm.simhash import has_chain

SHINGLE, HOT, BLOCK, SEGMENTS, BLOCK_BYTES = 5, 64, 2048, 16, 8 << 20
#: Pieces of a chain in the filter, at most; and pairs that are held against each other at once.
CHAIN, AT_ONCE = 4, 1 << 16
#: Documents from which the order of the shingles is taken, about; and the share of them that makes a key a crowd.
SAMPLE, CROWD = 4_000, 1 / 256


def shingles_of(batch: tk.Batch, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in order, and where each text's begin; a text of fewer words has one of all of them."""
    batch.words(tk.SPACE_NOT)
    hashes = batch.word_hashes(data=tk.LOWER[batch.data])
    n_docs, counts = len(batch.counts), batch.counts
    full = np.flatnonzero(tk.windows_inside(batch.at, shingle))
    keys, doc = [tk.window_hashes(hashes, shingle)[full]], [batch.doc_of_word()[full]]
    for width in range(1, shingle):
        short = np.flatnonzero(counts == width)
        if len(short):
            keys.append(tk.mix(tk.window_hashes(hashes, width)[batch.at[short]] + np.uint64(width)))
            doc.append(short)
    key, doc = np.concatenate(keys).view(np.int64), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    at = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        key[a:b].sort()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(n_docs + 1))


def node_of(own: np.ndarray) -> int:
    """The name of a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    return n - (4 * n + 4) // 5 + (n > 0)


def parities_of(key: np.ndarray, at: np.ndarray, words: int = SEGMENTS) -> np.ndarray:
    """``words`` longs for each set; a bit says whether an odd number of the shingles falls there."""
    n, width = len(at) - 1, 64 * words
    place = ((key.view(np.uint64) >> np.uint64(20)) % np.uint64(width)).astype(np.int64)
    flags = np.bincount(np.repeat(np.arange(n), np.diff(at)) * width + place, minlength=n * width) & 1
    return np.packbits(flags.astype(np.uint8)).view(np.int64).reshape(n, words)


def vectors_of(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each set, in SEGMENTS longs or twice, four times ... as many, so that it has a bit a shingle; and where each set's begin."""
    sizes = np.diff(at)
    words = SEGMENTS << np.ceil(np.log2(np.maximum(sizes / (64 * SEGMENTS), 1))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    out = np.empty(ends[-1], np.int64)
    for wide in np.unique(words).tolist():
        some = np.flatnonzero(words == wide)
        own = key[np.repeat(at[:-1][some], sizes[some]) + tk.counted(sizes[some])]
        out[ends[:-1][some][:, None] + np.arange(wide)] = parities_of(own, np.concatenate([[0], np.cumsum(sizes[some])]), wide)
    return out, ends


class Vectors:
    """Parities of sets, from a column of lists."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.values, self.words = column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.words) - self.words
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the sets, and rows of those that have ``words`` longs or more, as parities in so many."""
        if words not in self.made:
            row, rows, n = np.zeros(len(self.words), np.int64), [], 0
            for wide in np.unique(self.words[self.words >= words]).tolist():
                some = np.flatnonzero(self.words == wide)
                parts = self.values[self.first[some][:, None] + np.arange(wide)].reshape(len(some), wide // words, words)
                rows.append(np.bitwise_xor.reduce(parts, axis=1))
                row[some] = n + np.arange(len(some))
                n += len(some)
            self.made[words] = row, np.concatenate(rows)
        return self.made[words]


class Order:
    """Shingles that several documents of a sample hold, sorted, with how many do; all others come before them."""

    def __init__(self, common: np.ndarray, times: np.ndarray, crowd: int):
        self.common, self.times, self.crowd = common, times, crowd

    def times_of(self, key: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.common, key), len(self.common) - 1)
        return np.where(self.common[at] == key, self.times[at], 0)

    def prefixes(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of the prefixes, where each set's begin, and flags of those that are known to be a crowd's."""
        times, sizes = self.times_of(key), np.diff(at)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # within a document shingles are in order already
        order = np.argsort(doc * (int(times.max(initial=0)) + 1) + times, kind="stable")
        place = np.arange(len(key)) - np.repeat(at[:-1], sizes)
        order = order[place < np.repeat(prefix_size(sizes), sizes)]
        return key[order], np.concatenate([[0], np.cumsum(prefix_size(sizes))]), times[order] >= self.crowd


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))


def _row_hashes(docs: DataFrame) -> list[Column]:
    every = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    return [F.xxhash64(*every).alias("r1"), F.xxhash64(F.lit(1), *every).alias("r2")]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the whole row, the text, its hash and its bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", *_row_hashes(docs), text.alias("__text"), F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("size"))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and ``own``, its shingles, for each row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.lean(batches):
            for _, _, x in tk.batches(b.column("__text")):
                key, at = shingles_of(x, shingle)
                nodes = [node_of(key[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(key, at)], ["node", "own"])

    return texts.select("__text").mapInArrow(work, "node long, own array<long>")


def _order(rows: DataFrame, shingle: int, sample: int) -> Order:
    """From the distinct texts of a sample; the table that is collected has at most a million rows."""
    every = max(1, rows.count() // sample)
    some = _sets(rows.where(F.pmod(F.xxhash64("hash"), F.lit(every)) == 0), shingle).dropDuplicates(["node"])
    found = some.select(F.explode("own").alias("s")).groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(1_000_000).toPandas().sort_values("s")
    return Order(found["s"].to_numpy(np.int64), found["count"].to_numpy(np.int64), max(2, int(sample * CROWD)))


def prints_of(rows: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, r1, r2, size (bytes of the text), node, n (its shingles), ``prefix`` and ``crowd`` (the prefix in two lists), and ``bits``, its parities."""
    shared = rows.sparkSession.sparkContext.broadcast(_order(rows, shingle, sample))
    same = ("doc_id", "r1", "r2", "size")
    schema = rows.select(*same).schema.add("node", "long").add("n", "integer")
    for c in ("prefix", "crowd", "bits"):
        schema = schema.add(c, T.ArrayType(T.LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.lean(batches):
            for i, j, x in tk.batches(b.column("__text")):
                key, at = shingles_of(x, shingle)
                nodes = [node_of(key[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]
                prefix, ends, crowd = shared.value.prefixes(key, at)
                some = np.concatenate([[0], np.cumsum(crowd)])[ends]
                out = [_lists(prefix[~crowd], ends - some), _lists(prefix[crowd], some), _lists(*vectors_of(key, at))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in same), pa.array(nodes, pa.int64()), pa.array(np.diff(at), pa.int32()), *out], schema.names)

    return rows.mapInArrow(work, schema)


def _placed(place: Column) -> Column:
    """n, and above it the key's place in the order of the set."""
    return F.shiftleft(place.cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("n")


def _parts(placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n, and how many shingles there are from the key on."""
    n = placed & 0xFFFFFFFF
    return n, n - (placed >> 32)


def enough(n: np.ndarray, rest: np.ndarray, m: np.ndarray, rest_m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m can be similar if they share none before the last ``rest`` of each."""
    return 9 * np.minimum(rest, rest_m) >= 4 * (n + m)


class _Runs:
    """Pairs and crowds of rows that come sorted by key; a run of over ``hot`` rows goes on as it comes. n is as ``_placed`` gives it."""

    def __init__(self, hot: int):
        self.hot = hot
        self.key, self.node, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.large: list[int] = []  # the key of a run that is already known to be a crowd

    def take(self, key: np.ndarray, node: np.ndarray, n: np.ndarray, last: bool = False) -> pa.RecordBatch:
        key, node, n = (np.concatenate(x) for x in ((self.key, key), (self.node, node), (self.n, n)))
        starts, ends = tk.runs(key)
        out = [np.zeros((3, 0), np.int64)]
        keep, large = len(key), self.large
        if len(starts) and not last:  # the last run may go on
            keep = starts[-1]
            if ends[-1] - starts[-1] > self.hot or key[-1] in large:
                self.large, keep = [int(key[-1])], len(key)
        self.key, self.node, self.n = key[keep:], node[keep:], n[keep:]
        sizes = np.minimum(ends, keep) - starts
        crowd = (sizes > self.hot) | np.isin(key[starts], [*large, *self.large])
        some = np.flatnonzero(np.repeat(crowd, np.maximum(sizes, 0)))
        crowds = np.stack([key[some], node[some], n[some]])
        few = np.flatnonzero((sizes > 1) & ~crowd)
        for back in range(1, int(sizes[few].max(initial=1))):
            # every row of a run with the one ``back`` rows before it
            long = few[sizes[few] > back]
            where = np.repeat(starts[long] + back, sizes[long] - back) + tk.counted(sizes[long] - back)
            u, v = node[where], node[where - back]
            good = enough(*_parts(n[where]), *_parts(n[where - back]))
            out.append(np.stack([np.zeros(int(good.sum()), np.int64), np.maximum(u, v)[good], np.minimum(u, v)[good]]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        kind = np.concatenate([np.zeros(pairs.shape[1], np.int8), np.ones(crowds.shape[1], np.int8)])
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(c) for c in np.concatenate([pairs, crowds], axis=1))], ["kind", "key", "a", "b"])


def candidates(prints: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of nodes that share a key of up to ``hot`` nodes, and (key, node, rest) of the others, from node, n, prefix and crowd; ``rest``: shingles from the key on."""
    once = prints.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("n", "prefix")))
    keyed = once.select(F.posexplode("prefix").alias("place", "key"), "node", "n").select("key", "node", _placed(F.col("place"))).repartition("key").sortWithinPartitions("key", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(hot)
        for b in tk.lean(batches):
            yield runs.take(*(b.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "n")))
        yield runs.take(*[np.zeros(0, np.int64)] * 3, last=True)

    found = tk.written(keyed.mapInArrow(work, "kind byte, key long, a long, b long"), "runs")
    # in the order of a set, the keys of crowds follow the others of its prefix
    known = prints.where(F.size("crowd") > 0).select(F.posexplode("crowd").alias("place", "key"), "node", "n", F.size("prefix").alias("before"))
    known = known.select("key", "node", (F.col("n") - F.col("before") - F.col("place")).cast("long").alias("rest")).distinct()
    rest = F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)) - F.shiftright("b", 32)
    crowds = found.where("kind = 1").select("key", F.col("a").alias("node"), rest.alias("rest")).unionByName(known)
    return found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), crowds


def passing(one: Vectors, two: Vectors, p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets p and q pass the pigeonring filter and then the whole Hamming check, and how surely: 0 well within the bound, else 1."""
    most, words = (n + m) // 9, np.minimum(one.words[p], two.words[q])
    differ = np.empty((len(p), SEGMENTS), np.int32)
    for wide in np.unique(words).tolist():
        some, (row, x), (row_2, y) = np.flatnonzero(words == wide), one.folded(wide), two.folded(wide)
        step = max(1, AT_ONCE * SEGMENTS // wide)
        for at in range(0, len(some), step):
            k = some[at : at + step]
            apart = np.bitwise_count(x[row[p[k]]] ^ y[row_2[q[k]]])
            differ[k] = apart if wide == SEGMENTS else apart.reshape(len(k), SEGMENTS, -1).sum(axis=2, dtype=np.int32)
    keep = np.flatnonzero(has_chain(differ, most, CHAIN))
    total = differ[keep].sum(axis=1, dtype=np.int64)
    good = total <= most[keep]
    return keep[good], (4 * total[good] > 3 * most[keep[good]]).astype(np.int8)


PAIRS = "u long, v long"


def _pruned(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs that pass the filters."""
    a, b = (distinct.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")) for end in ("u", "v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in tk.lean(batches):
            every = np.arange(x.num_rows)
            keep, _ = passing(*(Vectors(x.column(f"bits_{c}")) for c in "uv"), every, every, *(x.column(f"n_{c}").to_numpy().astype(np.int64) for c in "uv"))
            yield pa.RecordBatch.from_arrays([x.column(c).take(pa.array(keep)) for c in "uv"], ["u", "v"])

    return pairs.join(a, "u").join(b, "v").mapInArrow(work, PAIRS)


def _crowded(rows: DataFrame, leads: bool, block: int) -> DataFrame:
    """(u, v) of nodes of different roots that share a key and pass the filters, from key, node, rest, n, bits and root.

    ``leads``: for each node of a key only the first of its partners, the surer ones before others, in an order
    that all nodes share. A key's nodes are dealt to blocks, and each pair of blocks is a task's.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def work(group: tuple, t: pa.Table) -> pa.Table:
        node, n, rest, root, mine = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "rest", "root", "mine"))
        bits, i, j = Vectors(t.column("bits")), group[1].as_py(), group[2].as_py()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found = [np.zeros((3, 0), np.int64)]
        for at in range(0, len(left), max(1, AT_ONCE // max(len(right), 1))):
            rows_ = left[at : at + max(1, AT_ONCE // max(len(right), 1))]
            apart = (root[rows_, None] != root[right]) & enough(n[rows_, None], rest[rows_, None], n[right], rest[right])
            if i == j:
                apart &= node[rows_, None] > node[right]
            p, q = np.nonzero(apart)
            p, q = rows_[p], right[q]
            keep, doubt = passing(bits, bits, p, q, n[p], n[q])
            found.append(np.stack([p[keep], q[keep], doubt.astype(np.int64)]))
        p, q, doubt = np.concatenate(found, axis=1)
        if leads:
            rank = tk.mix(node.view(np.uint64))
            a, b, d = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([doubt, doubt])
            order = np.lexsort((rank[b], d, a))
            first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
            p, q = a[first], b[first]
        return pa.table({"u": np.maximum(node[p], node[q]), "v": np.minimum(node[p], node[q])})

    return dealt.select("key", "i", "j", "mine", "node", "n", "rest", "root", "bits").groupBy("key", "i", "j").applyInArrow(work, PAIRS)


def _settled(rows: DataFrame, distinct: DataFrame, pairs: DataFrame, shingle: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (u, v) that join what the pairs (u, v), a written table, with a similarity of 0.8 or more join: 9 times the common
    shingles are at least 4 times all of both.

    A node's place is that of the first of it and its partners, in an order that all nodes share, so copies of
    one document mostly have the same; a place is dealt to blocks of about ``block_bytes`` of text. A task has the
    texts of two blocks, each once however many pairs it is in: only those that a pair of the two asks for.
    Texts travel and not sets, which take several times the room.
    """
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("other")))
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
    nodes = ends.groupBy("node").agg(F.min(rank("other")).alias("lead")).select("node", F.least(rank("node"), F.col("lead")).getField("node").alias("part"))
    nodes = tk.written(nodes.join(distinct.select("node", "size", F.col("first.r1").alias("r1"), F.col("first.r2").alias("r2")), "node"), "nodes")
    blocks = nodes.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / block_bytes)).alias("blocks"))
    placed = nodes.join(blocks, "part").select("node", F.struct("part", F.pmod(F.xxhash64("node"), "blocks").alias("block")).alias("place"))
    a, b = (placed.select(F.col("node").alias(end), F.col("place").alias(f"place_{end}")) for end in ("u", "v"))
    low, high = F.least("place_u", "place_v"), F.greatest("place_u", "place_v")
    where = [low["part"].alias("a"), low["block"].alias("i"), high["part"].alias("b"), high["block"].alias("j")]
    cut = tk.written(pairs.join(a, "u").join(b, "v").select(*where, "u", "v"), "cut")
    # rows alike in all columns all come, and one of them goes on
    texts = rows.select("r1", "r2", "__text").join(tk.small(nodes.select("node", "r1", "r2")), ["r1", "r2"]).groupBy("node").agg(F.any_value("__text").alias("__text"))
    asked = cut.select(*(F.col(c).alias(f"its_{c}") for c in "aibj"), F.explode(F.array("u", "v")).alias("node")).distinct()

    def work(key: tuple, t: pa.Table, p: pa.Table) -> pa.Table:
        node, sets = t.column("node").to_numpy(), []
        for _, _, batch in tk.batches(t.column("__text")):
            keys, at = shingles_of(batch, shingle)
            sets += np.split(keys, at[1:-1])
        order = np.argsort(node)
        ends = [order[np.searchsorted(node, p.column(c).to_numpy(), sorter=order)].tolist() for c in ("u", "v")]
        parent, edges = list(range(len(node))), []

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for x, y in zip(*ends, strict=True):
            i, j = top(x), top(y)
            if i != j and 9 * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= 4 * (len(sets[x]) + len(sets[y])):
                parent[i] = j
                edges.append((x, y))
        both = node[np.array(edges, np.int64).reshape(-1, 2)]
        return pa.table({"u": both[:, 0], "v": both[:, 1]})

    return tk.written(asked.join(texts, "node").groupBy(*(f"its_{c}" for c in "aibj")).cogroup(cut.groupBy(*"aibj")).applyInArrow(work, "u long, v long"), "near")


def roots_of(rows: DataFrame, prints: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(node, root) of all nodes in links: the components of all pairs as similar as asked."""
    pairs, crowds = candidates(prints, hot)
    pruned = tk.written(_pruned(pairs, distinct), "pruned")
    crowds = tk.written(crowds.join(distinct.select("node", "n", "bits"), "node"), "crowds")
    crowded = not crowds.isEmpty()

    led = pruned.unionByName(_crowded(crowds.withColumn("root", F.col("node")), True, block)).distinct() if crowded else pruned
    tested = tk.written(led, "tested")
    edges = _settled(rows, distinct, tested, shingle)
    if not crowded:
        return simhash.components(edges)
    roots = tk.written(simhash.components(edges), "roots")

    def rooted(df: DataFrame, end: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(end), F.col("root").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))

    apart = rooted(crowds, "node", "root")
    unlike = apart.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    apart = tk.written(apart.join(unlike, "key", "left_semi"), "apart")
    if apart.isEmpty():
        return roots
    rest = tk.written(_crowded(apart, False, block).distinct().join(tested, ["u", "v"], "left_anti"), "rest")
    if rest.isEmpty():
        return roots
    return simhash.components(edges.unionByName(_settled(rows, distinct, rest, shingle)))


def grouped(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """doc_id, r1 and r2 (hashes of the row) and ``leader``, the first (unknown, doc_id, r1, r2) of its component."""
    rows = _rows(docs)
    prints = tk.written(prints_of(rows, shingle, sample), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "r1", "r2")
    distinct = tk.written(prints.groupBy("node").agg(F.min(first).alias("first"), *(F.any_value(c).alias(c) for c in ("n", "size", "bits"))), "distinct")
    roots = roots_of(rows, prints, distinct, shingle, hot, block)
    rooted = distinct.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("leader"))
    # copies share a node, so a node may have any share of the rows: AQE splits its partition
    return prints.select("doc_id", "r1", "r2", "node").join(rooted.join(least, "root").select("node", "leader"), "node").drop("node")


def groups(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id and component_id, one row per row of (doc_id, text).

    Null, empty and blank texts have no words: they are copies of each other and of nothing else. A
    null doc_id is never a component_id unless its component has no other. An empty table gives no rows.
    """
    return grouped(docs, **options).select("doc_id", F.col("leader.doc_id").alias("component_id"))


def leaders(docs: DataFrame, **options: object) -> DataFrame:
    """One row of each component, with its columns, whatever their names: the smallest doc_id's, a null one last; of rows
    that share it, that with the smallest hash of all columns; of rows alike in all columns, any.

    Rows that differ in other columns alone are copies and go like others. (Columns of maps are no part of the hash.)
    """
    with tk.scratch(docs.sparkSession):
        found = tk.written(grouped(docs, **options), "groups")
        same = (F.col("r1") == F.col("leader.r1")) & (F.col("r2") == F.col("leader.r2")) & F.col("doc_id").eqNullSafe(F.col("leader.doc_id"))
        gone = found.where(~same).select("r1", "r2")
        again = tk.written(found.where(same).groupBy("r1", "r2").count().where("count > 1").select("r1", "r2"), "again", keep=True)
        some = tk.written(gone.unionByName(again).distinct(), "gone", keep=True)
    names = docs.columns
    plain = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), *_row_hashes(docs))
    kept = plain.join(tk.small(some), ["r1", "r2"], "left_anti").select("row")
    if not again.isEmpty():
        kept = kept.unionByName(plain.join(tk.small(again), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("row"))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
