"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of five-word shingles. Each of ``TREES`` trees gives a set a
signature of ``DEPTH`` MinHash values; the signatures of a tree, sorted, are its
prefix trie: neighbours in the order that agree in their first d values are
under one node of depth d. Sets under a common node of the longest prefixes are
candidates first, and every candidate is verified exactly on whole shingle sets.
The similarities of the links found so far tell how many links such prefixes
miss; matched prefixes are shortened by so many values that the target recall is
reached, and the sets that this brings together are verified in turn, until the
recall measured on all verified links is the target. No prefix is shorter than
the one at which even pairs at the threshold meet with the target recall.

Exact copies (equal shingle sets) are one node throughout. Candidates that hang
together form a component; a component is verified in blocks of about ``BLOCK``
shingles, every pair of blocks being a group of its own, so no task holds a whole
component. A block pair returns link counts, similarities and a spanning forest
of its links, never its pairs. What was verified with longer prefixes isn't
compared again.

Defined results: words are lower-cased runs of letters, digits and non-ASCII
characters; a text of fewer than five words is one shingle; texts without words
are linked only to equal texts (null counts as empty); repeated rows are
copies; rows of equal id may have different texts; a row without an id is
linked like any other; empty tables give empty results; columns other than the
id and the text are ignored whatever their names are. Shingles and nodes are
64-bit hashes, the values of a signature ``VALUE_BITS`` bits.
"""

from __future__ import annotations

import contextlib
import contextvars
import itertools
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, fresh, local, map_rows, table

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.997
TREES = 20
#: Values of a tree's signature; each is ``VALUE_BITS`` bits, half of them in either of two numbers.
DEPTH = 10
VALUE_BITS = 12
#: Shingles of the texts that a block holds on average, and what a text counts beside its own.
BLOCK, TEXT_WEIGHT = 200_000, 512
#: Bins of the similarities, from the threshold to 1.
BINS = 50
#: Word hashes that a worker remembers.
MEMORY = 300_000

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(c if c >= 0x80 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def meeting(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that two sets agree in their first ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with probability ``recall``: none is shortened below it."""
    return next((d for d in range(depth, 1, -1) if meeting(threshold, d, trees) >= recall), 1)


def measured_recall(found: np.ndarray, depth: int, at: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """Share of all links that prefixes of length ``at`` find, from the similarities of those that ``depth`` found.

    ``found`` counts links in equal bins of similarity from the threshold to 1.
    A bin's links stand for the more, the likelier prefixes of ``depth`` miss
    such a link. One more link at the threshold is assumed, so that a few links
    are no proof.
    """
    low = threshold + (1 - threshold) * np.arange(len(found)) / len(found)
    every = found / meeting(low, depth, trees)
    every[0] += 1
    return float((every * meeting(low, at, trees)).sum() / every.sum())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts, as sorted arrays of 64-bit hashes."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self.known: dict[bytes, int] = {}
        self.power = np.array([pow(int(_MIX) | 1, k + 1, 1 << 64) for k in range(size)], dtype=np.uint64)

    def _hash(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= MEMORY:
            self.known.clear()
        h = self.known[word] = xxhash.xxh64_intdigest(word)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
        get, own = self.known.get, self._hash
        h = np.fromiter((get(w) or own(w) for w in words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - self.size + 1)
        if not words:
            return h
        out = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.size, len(words))):
            out += h[k : k + n] * self.power[k]
        return np.unique(_mixed(out))


class Forest:
    """Signatures of a shingle set: two numbers per tree, the first and the second half of its values, first values highest."""

    def __init__(self, trees: int = TREES, seed: int = 11) -> None:
        self.trees = trees
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, trees * DEPTH, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * DEPTH, dtype=np.uint32)
        self.weight = np.array([1 << VALUE_BITS * k for k in reversed(range(DEPTH // 2))], dtype=np.int64)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(16)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(least, (low[at : at + 1024, None] * self.a + self.b).min(axis=0), out=least)
        return least

    def signatures(self, shingles: np.ndarray) -> list[int]:
        if not len(shingles):
            return []
        v = _mixed(self.values(shingles).astype(np.uint64)) >> np.uint64(64 - VALUE_BITS)
        return (v.astype(np.int64).reshape(2 * self.trees, DEPTH // 2) @ self.weight).tolist()


def _depths(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Common values at the head of signatures and the ones before, from the bits in which they differ."""
    half = DEPTH // 2
    out = np.zeros(len(first), dtype=np.int64)
    for d in range(1, half + 1):
        out += (first >> (VALUE_BITS * (half - d))) == 0
    whole = first == 0
    for d in range(1, half + 1):
        out += whole & ((second >> (VALUE_BITS * (half - d))) == 0)
    return out


def tries(nodes: DataFrame, floor: int, scratch: Scratch) -> DataFrame:
    """(a, b, depth): nodes under a common trie node, each with the first node there, for every depth from ``floor``.

    The signatures of all trees are sorted by range, so a prefix that many sets
    share is spread over tasks; the ends of neighbouring ranges (two rows a
    range) are matched afterwards.
    """
    import pyarrow as pa

    spark = nodes.sparkSession
    each = F.transform(F.sequence(F.lit(0), (F.size("signatures") / 2 - 1).cast("int")), lambda k: F.struct(k.alias("tree"), F.element_at("signatures", 2 * k + 1).alias("x"), F.element_at("signatures", 2 * k + 2).alias("y")))
    rows = nodes.where(F.size("signatures") > 0).select("node", F.explode(each).alias("s")).select("s.tree", "s.x", "s.y", "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "x", "y", "node"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    levels = list(range(DEPTH, floor - 1, -1))
    names = ["a", "b", "depth", "part", "tree", "x", "y"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, heads = None, {}

        def batch_of(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        def end(row):  # the first or the last row of the range
            return batch_of([[row[3]], [None], [None], [part], [row[0]], [row[1]], [row[2]]])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, x, y, node = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if last is None:
                yield end((tree[0], x[0], y[0], node[0]))
                last = (-1, 0, 0, 0)
            common = _depths(x ^ np.concatenate([[last[1]], x[:-1]]), y ^ np.concatenate([[last[2]], y[:-1]]))
            common[tree != np.concatenate([[last[0]], tree[:-1]])] = 0
            a, b, depth = [], [], []
            said = np.full(len(node), -1, dtype=np.int64)  # the head that a longer prefix gave
            at = np.arange(len(node))
            for d in levels:
                begin = common < d
                place = np.maximum.accumulate(np.where(begin, at, -1))
                head = np.where(place >= 0, node[place], heads.get(d, 0))
                new = (head != node) & (head != said)
                a.append(node[new])
                b.append(head[new])
                depth.append(np.full(int(new.sum()), d, dtype=np.int64))
                said = np.where(head != node, head, said)
                heads[d] = int(head[-1])
            last = tuple(int(c[-1]) for c in (tree, x, y, node))
            n = sum(map(len, a))
            if n:
                cols = [np.concatenate(c) for c in (a, b, depth)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *(pa.nulls(n, pa.int64()) for _ in range(4))], names=names)
        if last is not None:
            yield end(last)

    found = scratch.keep(rows.select(*order).mapInArrow(run, ", ".join(f"{c} long" for c in names)))
    ends = sorted((r["part"], r["tree"], r["x"], r["y"], r["a"]) for r in found.where("part is not null").collect())  # two rows a range
    seams = []
    for k, l in zip(ends, ends[1:], strict=False):
        if k[0] != l[0] and k[1] == l[1] and k[4] != l[4]:
            d = int(_depths(np.array([k[2] ^ l[2]]), np.array([k[3] ^ l[3]]))[0])
            if d >= floor:
                seams.append((l[4], k[4], d))
    edges = found.where("part is null").select("a", "b", "depth")
    edges = edges.union(local(spark, seams, edges.schema))
    return edges.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max("depth").alias("depth"))


def node_of(text: str | None, shingles: np.ndarray) -> int:
    """Number of a shingle set; of the text itself if it has no words."""
    import xxhash

    raw = shingles.tobytes() if len(shingles) else b"\0" + (text or "").encode("utf-8", "replace")
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))


#: Tables written within temporary().
_HELD: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("held", default=None)


@contextlib.contextmanager
def temporary():
    """What operators write within goes at the end, so the result must have been written elsewhere by then."""
    held: list[Scratch] = []
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)
        for s in held:
            s.clear()


class Scratch:
    """Written tables in the folder that executors share (spark.checkpoint.dir), which cut the lineage."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = os.path.join(tempfile.gettempdir(), "statloom")  # one process, as in tests
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = itertools.count()
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        held = _HELD.get()
        if held is not None:
            held.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{next(self.count)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        for t in tables:
            self._delete(self.paths.pop(id(t))[1])

    def drop_others(self, *tables: DataFrame, but: tuple[int, ...] = ()) -> None:
        """Delete all kept tables but these, and but those kept before (keys of ``paths``)."""
        stay = {*but, *(id(t) for t in tables)}
        self.drop(*(t for k, (t, _) in list(self.paths.items()) if k not in stay))

    def clear(self) -> None:
        """Delete all kept tables."""
        self.paths.clear()
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of an undirected edge table (a, b): the least node of its component.

    Alternates large and small stars; each round is a grouped minimum, which
    combines before the shuffle, and an equi-join back.
    """
    cur = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        # large star: every larger neighbour of u points to the least node around u
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large)
        # small star: u and its smaller neighbours point to the least of them
        low = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.keep(small)
        shape = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(cur, least, large, low)
        cur = new
        if shape == last:
            break
        last = shape
    else:
        raise RuntimeError(f"components unfinished after {rounds} rounds")
    ends = cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = ends.select(F.col("root").alias("node")).distinct()
    return ends.union(roots.select("node", F.col("node").alias("root")))


def _joined(sets: list[np.ndarray], copies: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """Links between two lists of places: texts and documents linked with each place, a spanning forest, and the links' similarities in bins.

    Places of one group were compared before and are left out.
    """
    _, ids = np.unique(np.concatenate([sets[i] for i in right] + [sets[i] for i in left]), return_inverse=True)
    sizes = np.array([len(sets[i]) for i in right])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    table_ = ids[: ends[-1]]
    flag = np.zeros(ids.max() + 1, dtype=np.int32)
    num, den = round(threshold * 1000), 1000
    texts, documents = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    bins = np.zeros(BINS, dtype=np.int64)
    part = np.arange(len(sets))
    forest = []
    at = ends[-1]
    for k, i in enumerate(left):
        own = ids[at : at + len(sets[i])]
        at += len(sets[i])
        flag[own] = 1
        common = np.add.reduceat(flag[table_], starts).astype(np.int64)
        flag[own] = 0
        hit = ((den + num) * common >= num * (sizes + len(own))) & (group[right] != group[i])
        if same:
            hit[: k + 1] = False
        r = right[hit]
        if not len(r):
            continue
        texts[i] += len(r)
        documents[i] += copies[r].sum()
        texts[r] += 1
        documents[r] += copies[i]
        share = common[hit] / (sizes[hit] + len(own) - common[hit])
        bins += np.bincount(np.clip(((share - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
        fresh_, first = np.unique(part[r], return_index=True)
        for p, f in zip(fresh_, first, strict=True):
            if p != part[i]:
                forest.append((i, r[f]))
        part[np.isin(part, fresh_)] = part[i]
    return texts, documents, forest, bins


def _rows(batches):
    """Rows of Arrow batches as tuples, ``SLICE_ROWS`` of them Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True)


def _verify(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """Rows (comp, p, q, block, node, copies, group, text), sorted by (comp, p, q), to counts (kind 0), forest edges (1) and bins of similarities (2)."""
    import pyarrow as pa

    names = ["kind", "node", "texts", "documents", "other"]

    def run(batches):
        shingler = Shingler(size)
        held: list[tuple] = []
        key = None

        def flush():
            block = np.array([h[0] for h in held])
            left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            if len(held) < 2 or not len(left) or not len(right):
                return None
            node = np.array([h[1] for h in held], dtype=np.int64)
            texts, documents, forest, bins = _joined([h[4] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held]), left, right, key[1] == key[2], threshold)
            some, seen = np.flatnonzero(texts), np.flatnonzero(bins)
            out = [(0, node[i], texts[i], documents[i], None) for i in some]
            out += [(1, node[i], None, None, node[j]) for i, j in forest]
            out += [(2, k, bins[k], None, None) for k in seen]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names) if out else None

        for row in _rows(batches):
            if row[:3] != key:
                if key is not None and (made := flush()) is not None:
                    yield made
                key, held = row[:3], []
            held.append((*row[3:7], shingler.shingles(row[7])))
        if key is not None and (made := flush()) is not None:
            yield made

    return rows.select("comp", "p", "q", "block", "node", "copies", "group", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _block_pairs(sized: DataFrame, rows: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Rows (comp, p, q, block, node, copies, group, text) of the pairs of blocks that hold texts of different groups.

    A group of more than a block's shingles has blocks of its own; smaller ones
    share blocks. Components of a single group were verified before.
    """
    groups = scratch.keep(sized.groupBy("comp", "group").agg(F.sum(F.col("n") + TEXT_WEIGHT).alias("size")))
    large, own = F.col("size") >= block, F.ceil(F.col("size") / block).cast("int")
    comps = groups.groupBy("comp").agg(F.count("*").alias("groups"), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("size"))) / block).cast("int").alias("pool"), F.sum(F.when(large, own).otherwise(0)).cast("int").alias("rest"))
    comps = scratch.keep(comps.where("groups > 1").drop("groups"))
    before = Window.partitionBy("comp").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row per group larger than a block
    alone = groups.where(large).select("comp", "group", own.alias("own"), F.coalesce(F.sum(own).over(before), F.lit(0)).cast("int").alias("offset"))
    placed = sized.join(comps.hint("merge"), "comp").join(alone.hint("merge"), ["comp", "group"], "left")
    spread = F.xxhash64("node", F.lit(3))
    begin = F.col("pool") + F.col("offset")
    placed = placed.withColumn("block", F.when(F.col("own").isNull(), F.pmod(spread, F.greatest("pool", F.lit(1)))).otherwise(begin + F.pmod(spread, F.col("own"))).cast("int"))
    placed = scratch.keep(placed.select("comp", "group", "node", "copies", "row", "pool", "rest", "block", begin.alias("begin"), (begin + F.col("own")).alias("end")))
    texts = rows.select("row", "text").join(placed.hint("merge"), "row")
    others = F.filter(F.sequence(F.lit(0), F.col("pool") + F.col("rest") - 1), lambda k: F.col("end").isNull() | (k < F.col("begin")) | (k >= F.col("end")))
    pairs = texts.withColumn("other", F.explode(others))
    pairs = pairs.select("comp", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "copies", "group", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "comp", "p", "q").sortWithinPartitions("comp", "p", "q", "node")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, block: int = BLOCK, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least id of the documents that links connect), n_links (documents linked, copies included), n_texts (different texts linked) and node of every document."""
    scratch = Scratch(docs.sparkSession, "near")
    # kept, so that a row has the same key whenever it is read
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))
    out = _linked(rows, scratch, threshold, size, block, trees, recall).drop("row", "class_node")
    scratch.drop(rows)
    return out


def _linked(rows: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, size: int = SHINGLE, block: int = BLOCK, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The result of join() for kept rows (doc_id, text, row), with row and class_node, the same number for all rows of a class."""
    # merge hints: these joins grow with the corpus, so they take the same way at every size
    kind = rows.schema["doc_id"].dataType.simpleString()
    earlier_tables = tuple(scratch.paths)

    def make():
        shingler, forest = Shingler(size), Forest(trees)

        def row(doc_id, text, key):
            s = shingler.shingles(text)
            return doc_id, key, node_of(text, s), len(s), forest.signatures(s)

        return row

    signed = scratch.keep(map_rows(rows, make, f"doc_id {kind}, row long, node long, n long, signatures array<long>"))
    nodes = scratch.keep(signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("signatures").alias("signatures")))
    floor = prefix_length(threshold, recall, trees)
    edges = scratch.keep(tries(nodes.select("node", "signatures"), floor, scratch))
    found, similar, depth, comp = None, np.zeros(BINS), DEPTH, None
    while True:
        before, comp = comp, scratch.keep(components(edges.where(F.col("depth") >= depth).select("a", "b"), scratch).withColumnRenamed("root", "comp"))
        if before is None:
            grouped = comp.withColumn("group", F.col("node"))
        else:
            earlier = before.withColumnRenamed("comp", "group")
            grouped = comp.join(earlier.hint("merge"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        sized = scratch.keep(grouped.join(nodes.select("node", "copies", "row", "n").hint("merge"), "node"))
        new = scratch.keep(_verify(_block_pairs(sized, rows, block, scratch), size, threshold))
        found = new if found is None else found.union(new)
        for r in new.where("kind = 2").groupBy("node").agg(F.sum("texts").alias("links")).collect():  # a row per bin
            similar[r["node"]] += r["links"]
        if depth == floor or measured_recall(similar, depth, depth, threshold, trees) >= recall:
            break
        depth = next((d for d in range(depth - 1, floor, -1) if measured_recall(similar, depth, d, threshold, trees) >= recall), floor)

    counts = found.where("kind = 0").groupBy("node").agg(F.sum("texts").alias("n_texts"), F.sum("documents").alias("n_docs"))
    roots = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    linked = scratch.keep(roots.join(counts, "node", "left").join(nodes.select("node", "least_id"), "node"))
    least = scratch.keep(linked.groupBy("root").agg(F.min("least_id").alias("class_id")))
    linked = scratch.keep(linked.join(least, "root").select("node", "root", "class_id", "n_texts", "n_docs"))
    info = scratch.keep(nodes.select("node", "copies", "least_id").join(linked.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("class_node"), F.coalesce("class_id", "least_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts")))
    out = scratch.keep(signed.select("doc_id", "row", "node").join(info.hint("merge"), "node").select("doc_id", "class_id", "n_links", "n_texts", "node", "row", "class_node"))
    scratch.drop_others(out, but=earlier_tables)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class one row, that of the least id.

    Rows without an id come after those with one; among rows of equal id the
    least node stays, and of copies the first row.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    (key,) = fresh(docs, "_row")
    keyed = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()))
    rows = keyed.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(key).alias("row"))
    found = scratch.keep(_linked(rows, scratch, **options).where("n_links > 0").select("class_node", "row", F.struct(F.col("doc_id").isNull(), "doc_id", "node", "row").alias("place")))
    least = scratch.keep(found.groupBy("class_node").agg(F.min("place").alias("least")).select("class_node", F.col("least.row").alias("first")))
    gone = scratch.keep(found.join(least.hint("merge"), "class_node").where("row <> first").select(F.col("row").alias(key)))
    scratch.drop_others(keyed, gone)
    return keyed.join(gone.hint("merge"), key, "left_anti").select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("node")
