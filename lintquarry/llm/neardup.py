"""Near duplicates by Order MinHash and banded alignment.

A document is its sequence of words, where characters of scripts without spaces count as words; its k-mers are runs of two words, each labelled with its occurrence number. Under each
of ``sketches`` hash functions the ``length`` least labelled k-mers are taken and hashed *in text order*, so two documents
agree on a sketch when they share k-mers in the same order: agreement follows edit similarity, not only shared content
(Marcais et al. 2019). Documents that agree on a sketch are candidates; a banded bit-parallel alignment of their words
verifies each: edit similarity 1 - distance / longer length of at least 0.8.

Pairs of documents of up to ``short_words`` words have too few k-mers for that and are found exactly instead: an allowance of e
edits leaves one of e + 1 pieces of the longer document unchanged in the shorter one, not far from its place (Li et al. 2011,
PassJoin). Its pieces and the places of the shorter one where they may lie are keys, which are sketches to all that follows.

Exact copies (equal words) are one node from the start. Then

1. each node is compared with one other: the one that is first in most of the node's buckets; the links give components;
2. each node is compared with every first of its buckets that is in another component: stars, not all pairs;
3. buckets that still hold several components are settled exactly: nodes of different components that agree on any sketch
   are compared, however large the bucket, block by block: a bucket is cut into classes of length and those into blocks of
   bounded text, and a pair is looked at in one bucket only. No pair becomes a row but a verified one;
4. the components of all links are the classes.

Every intermediate table lies in the shared folder; nothing of it comes to the driver but counts.

Defined results: a class is named by the least doc_id in it; a null text is a class of its own row; texts without words are
copies only of byte-equal texts; documents of fewer than five words have no allowance and are copies only; repeated rows fall in one
class; a null doc_id is kept, its class named by the others of the class or null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import within
from .common import Shared, mix64, ship, span_hashes, words_of


@dataclass(frozen=True)
class Params:
    k: int = 2
    length: int = 3
    sketches: int = 64
    similarity: float = 0.8
    #: Pairs whose longer document has up to so many words are found exactly.
    short_words: int = 30
    #: Numbers of nodes (eight bytes each) up to which they are sent to every worker instead of shuffling words to them.
    broadcast_rows: int = 1_000_000
    #: Words of one block of a bucket; a bucket of more is compared block by block.
    block_words: int = 400_000
    #: Pairs of buckets of so many nodes are rows; larger ones are compared in one place.
    few_nodes: int = 32
    #: Blocks of one class of length that a task compares with all that they must meet.
    blocks_a_task: int = 8
    seed: int = 17


#: How many of the session's shuffle partitions, counted for whole texts, go into one file of a table of sketches or words, and of a
#: table of pairs or labels.
MIDDLING, NARROW = 4, 16


# ---------------------------------------------------------------- one document


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-mer and of how often it has occurred before, in text order."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, n - k + 1))
    h = span_hashes(words, at, np.minimum(at + k, n))
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return mix64(h)
    first = np.maximum.accumulate(np.where(new, at, 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = at - first
    return mix64(h + occurrence * np.uint64(0xD6E8FEB86659FD93))


def _functions(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 1 << 63, p.sketches, np.uint64), rng.integers(0, 1 << 63, p.sketches, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(words: np.ndarray, p: Params) -> np.ndarray:
    """The Order MinHash sketches of a document, each a signed 64-bit number; none for a document without words."""
    kmers = labelled_kmers(words, p.k)
    n = len(kmers)
    if not n:
        return np.zeros(0, np.int64)
    salt, factor = _functions(p)
    out = np.zeros(p.sketches, np.uint64)
    step = max(1, (1 << 18) // n)  # bounds the table of hashes, whatever the document's length
    for s in range(0, p.sketches, step):
        h = (kmers ^ salt[s : s + step, None]) * factor[s : s + step, None]
        if n > p.length:
            least = np.empty((len(h), p.length), np.int64)
            for k in range(p.length):
                least[:, k] = h.argmin(axis=1)
                h[np.arange(len(h)), least[:, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at = np.sort(least, axis=1)
        else:
            at = np.broadcast_to(np.arange(n), (len(h), n))
        total = np.arange(s, s + len(h)).astype(np.uint64)
        for column in at.T:
            total = mix64(total * np.uint64(0x9FB21C651E98DF25) + kmers[column])
        out[s : s + step] = total
    return out.view(np.int64)


def allowance(n, p: Params):
    """How many edits a pair may have whose longer document has n words."""
    return np.int64((1 - p.similarity) * n + 1e-9)


def piece_keys(words: np.ndarray, p: Params) -> np.ndarray:
    """The keys of a short document, one of which at least it shares with every near one of up to p.short_words words.

    For each length m of the longer document and each piece i of its e + 1, the places where the piece may lie here: no more than i
    edits come before it, and no more than e - i after.
    """
    n = len(words)
    starts, sizes, names = [], [], []
    for m in range(n, p.short_words + 1):
        e = int(allowance(m, p))
        if not e:
            continue
        if m - n > e:
            break
        cut = [m * i // (e + 1) for i in range(e + 2)]
        for i in range(e + 1):
            size = cut[i + 1] - cut[i]
            lo, hi = max(0, cut[i] - i, cut[i] + n - m - (e - i)), min(n - size, cut[i] + i, cut[i] + n - m + (e - i))
            for at in range(lo, hi + 1):
                starts.append(at)
                sizes.append(size)
                names.append(m * 1000 + i + 1)
    if not starts:
        return np.zeros(0, np.int64)
    at = np.array(starts)
    h = span_hashes(words, at, at + np.array(sizes))
    return np.unique(mix64(h + np.array(names, np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def candidate_keys(words: np.ndarray, p: Params) -> np.ndarray:
    """What a document is a candidate by: sketches if it may be near to one of more than p.short_words words, and pieces if it has no
    more itself."""
    n = len(words)
    if n > p.short_words:
        return sketch(words, p)
    longer = np.arange(p.short_words + 1, int(n / p.similarity) + 2)
    reaches = bool((longer - n <= allowance(longer, p)).any())
    return np.concatenate([piece_keys(words, p), sketch(words, p)]) if reaches else piece_keys(words, p)


def text_key(text: str, words: np.ndarray) -> bytes:
    """Equal for documents of equal words."""
    return hashlib.md5(words.tobytes() if len(words) else b"text:" + text.encode("utf-8", "replace")).digest()


# ---------------------------------------------------------------- graph


def _far(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast, however small it seems: pairs, labels and components of all documents don't go
    through the driver, and the plan is the same at every size."""
    return df.hint("merge")


def components(shared: Shared, edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node of the edges (a, b).

    Labels start as the least neighbour; each round takes the neighbours' least label and then the label's own
    label, until none changes. Rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared.table(both, NARROW)
    label = shared.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), NARROW)
    while True:
        near = both.join(_far(label.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = label.join(_far(near), "node", "left").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        after = lower.join(_far(jump), "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("comp"), "was")
        after = shared.table(after, NARROW)
        changed = after.filter(F.col("comp") != F.col("was")).limit(1).count()
        shared.drop(label)
        label = after
        if not changed:
            shared.drop(both)
            return label.select("node", "comp")


def _bounded(df: DataFrame, p: Params) -> DataFrame:
    """Numbers of nodes, to join with: sent to every worker while few, else met by a shuffle."""
    return F.broadcast(df) if df.count() <= p.broadcast_rows else _far(df)


def aligned(shared: Shared, pairs: DataFrame, words: DataFrame, p: Params, column: str = "words") -> DataFrame:
    """Those of the pairs (a, b) whose words align: edit similarity of at least p.similarity. Only words of nodes in pairs are moved.

    With column "codes" the words' shorter codes are compared, half as long: equal words have equal codes, so that no pair which
    aligns is lost, and few that don't are kept.
    """

    def check(batches):
        for batch in batches:
            a, b = _arrays(batch.column(2), column), _arrays(batch.column(3), column)
            keep = []
            for x, y in zip(a, b, strict=True):
                most = int((1 - p.similarity) * max(len(x), len(y)) + 1e-9)
                keep.append(within(x, y, most) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    nodes = shared.table(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), NARROW)
    own = words.select("rid", column).join(_bounded(nodes, p), "rid", "left_semi")
    wa = own.select(F.col("rid").alias("a"), F.col(column).alias("wa"))
    wb = own.select(F.col("rid").alias("b"), F.col(column).alias("wb"))
    met = pairs.select("a", "b").join(_far(wa), "a").join(_far(wb), "b").select("a", "b", "wa", "wb")
    out = shared.table(met.mapInArrow(check, "a bigint, b bigint"), NARROW, even=True)
    shared.drop(nodes)
    return out


def verified(shared: Shared, pairs: DataFrame, words: DataFrame, p: Params, few: bool) -> DataFrame:
    """Those of the pairs (a, b) that are near. few: most pairs aren't, so that their codes are compared first."""
    if not few:
        return aligned(shared, pairs, words, p)
    close = aligned(shared, pairs, words, p, "codes")
    out = aligned(shared, close, words, p)
    shared.drop(close)
    return out


def word_codes(column: str):
    """Two bytes for each word."""

    @F.arrow_udf("binary")
    def codes(words: pa.Array) -> pa.Array:
        return pa.array([w.astype(np.uint16).tobytes() for w in _arrays(words, "words")], pa.binary())

    return codes(column)


def _arrays(column, kind: str) -> list[np.ndarray]:
    """Words or codes of each row."""
    if kind == "codes":
        return [np.frombuffer(c.as_buffer(), np.uint16) for c in column]
    return [w.values.to_numpy(zero_copy_only=False) for w in column]


def settled(shared: Shared, buckets: DataFrame, label: DataFrame, tried: DataFrame, words: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between components that the stars left apart: step 3 above.

    A pair belongs to the least of its common sketches. In a bucket of few nodes its pairs are rows; a larger one is compared whole
    in one task if its texts are bounded, else block by block.
    """
    own = buckets.select("sig", "node", "n").join(_far(label), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("size")).filter("lo < hi")
    mixed = shared.table(mixed.select("sig", "nodes", "size"), NARROW)
    met = shared.table(own.join(_far(mixed), "sig"), NARROW)
    # a node's sketches in mixed buckets: no more than it has sketches
    of = met.groupBy("node").agg(F.sort_array(F.collect_set("sig")).alias("sigs"))
    own = shared.table(met.join(_far(of), "node"), NARROW)
    shared.drop(met, mixed)

    few = own.filter(F.col("nodes") <= p.few_nodes)
    x, y = few.alias("x"), _far(few).alias("y")
    common = F.array_intersect("x.sigs", "y.sigs")
    near = F.least(F.col("x.n"), F.col("y.n")) >= F.greatest(F.col("x.n"), F.col("y.n")) * p.similarity
    ours = F.array_min(common) == F.col("x.sig")
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & near & ours)
    pairs = shared.table(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).join(_far(tried), ["a", "b"], "left_anti"), NARROW)
    found = aligned(shared, pairs, words, p, "codes")
    shared.drop(pairs)

    many = own.filter(F.col("nodes") > p.few_nodes)
    if many.limit(1).count():
        many = many.join(_far(words.select(F.col("rid").alias("node"), "codes")), "node").withColumn("m", F.struct("node", "comp", "sigs", "codes"))
        whole = many.filter(F.col("size") <= p.block_words).groupBy("sig").agg(F.collect_list("m").alias("xs"))
        whole = whole.select("sig", F.lit(True).alias("itself"), "xs", F.array().cast(whole.schema["xs"].dataType).alias("ys"))
        met = _within_buckets(whole, p)
        large = many.filter(F.col("size") > p.block_words)
        if own.filter(F.col("nodes") > p.few_nodes).filter(F.col("size") > p.block_words).limit(1).count():
            met = met.unionByName(_within_buckets(_blocks(shared, large, p), p))
        found = found.unionByName(shared.table(met, NARROW, even=True))
    out = aligned(shared, found, words, p)
    shared.drop(own)
    return out


def _within_buckets(met: DataFrame, p: Params) -> DataFrame:
    """The links (a, b) that rows (sig, itself, xs, ys) of blocks hold, by their words' codes."""

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                links = _between(batch.column(0)[k].as_py(), _members(batch.column(2)[k]), None if batch.column(1)[k].as_py() else _members(batch.column(3)[k]), p)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return met.mapInArrow(compare, "a bigint, b bigint")


def _blocks(shared: Shared, many: DataFrame, p: Params) -> DataFrame:
    """The pairs of blocks to compare within buckets too large for one task, as rows (sig, itself, xs, ys).

    A bucket is cut into classes of length, so that near texts lie in one class or in two neighbours, and a class into blocks of
    bounded text. A task takes a few blocks and meets them with those that follow in their class and those of the next
    class: the blocks that come to them are dealt over as many tasks as a class has groups of blocks.
    """
    step = float(np.log(1 / p.similarity * 1.0001))
    many = many.withColumn("cls", F.floor(F.log("n") / step).cast("int"))
    sizes = many.groupBy("sig", "cls").agg(F.ceil(F.sum("n") / p.block_words).cast("int").alias("blocks"))
    sizes = shared.table(sizes, NARROW)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = many.join(_far(sizes), ["sig", "cls"]).select("sig", "cls", block.alias("block"), "m")
    rows = shared.table(rows.groupBy("sig", "cls", "block").agg(F.collect_list("m").alias("ms")), MIDDLING)
    groups = sizes.select("sig", F.col("cls").alias("to"), F.ceil(F.col("blocks") / p.blocks_a_task).cast("int").alias("groups"))
    x = rows.select("sig", F.col("cls").alias("to"), F.floor(F.col("block") / p.blocks_a_task).cast("int").alias("group"), F.col("block").alias("i"), F.col("ms").alias("xs"))
    # a block is met by its own class and by the one below
    meets = sizes.select("sig", "cls", F.explode(F.array(F.col("cls"), F.col("cls") - 1)).alias("to")).join(_far(groups), ["sig", "to"])
    meets = meets.select("sig", "cls", "to", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    y = rows.join(_far(meets), ["sig", "cls"]).select("sig", "to", "group", (F.col("cls") == F.col("to")).alias("same"), F.col("block").alias("j"), F.col("ms").alias("ys"))
    met = x.join(_far(y), ["sig", "to", "group"]).filter("not same or i <= j")
    return met.select("sig", (F.col("same") & (F.col("i") == F.col("j"))).alias("itself"), "xs", "ys")


def _members(rows) -> tuple[list[int], list[int], list[set], list[np.ndarray]]:
    """Nodes, components, sketches and codes of a block."""
    ms = rows.values
    return ms.field("node").to_pylist(), ms.field("comp").to_pylist(), [set(s.as_py()) for s in ms.field("sigs")], _arrays(ms.field("codes"), "codes")


def _bags(words: list[np.ndarray]) -> np.ndarray:
    """Counts of hashed words; sums of least counts bound what two documents share from above."""
    return np.stack([np.bincount(w & 1023, minlength=1024) for w in words]).astype(np.int32)


def _between(sig: int, xs, ys, p: Params) -> list[tuple[int, int]]:
    """The links between two blocks of a bucket (ys None: within one), of pairs of different components whose least common
    sketch is the bucket's. Pairs that links found here connect already are passed over."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    node_x, comp_x, sig_x, word_x = xs
    node_y, comp_y, sig_y, word_y = ys or xs
    bag_x, size_x = _bags(word_x), np.array([len(w) for w in word_x])
    bag_y, size_y = (_bags(word_y), np.array([len(w) for w in word_y])) if ys else (bag_x, size_x)
    out = []
    for i in range(len(node_x)):
        longer = np.maximum(size_x[i], size_y)
        most = ((1 - p.similarity) * longer + 1e-9).astype(np.int64)
        j = np.flatnonzero(longer - np.minimum(size_x[i], size_y) <= most)
        if ys is None:
            j = j[j > i]
        j = np.array([k for k in j.tolist() if comp_x[i] != comp_y[k]], np.int64)
        if not len(j):
            continue
        # words that the longer one doesn't share cost an edit each
        j = j[longer[j] - np.minimum(bag_x[i], bag_y[j]).sum(axis=1) <= most[j]]
        for k in j.tolist():
            if find(comp_x[i]) == find(comp_y[k]):
                continue
            common = sig_x[i] & sig_y[k]
            if min(common) == sig and within(word_x[i], word_y[k], int(most[k])) <= most[k]:
                out.append((min(node_x[i], node_y[k]), max(node_x[i], node_y[k])))
                root[find(comp_x[i])] = find(comp_y[k])
    return out


# ---------------------------------------------------------------- operator


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """For every document: doc_id, class_id (the least doc_id of its class), class_size and rid, a number of the row.

    The row with rid = class_rid is the one of its class to keep.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, "neardup")

    @F.arrow_udf("struct<key:binary,n:int,words:array<int>>")
    def prepare(texts: pa.Array) -> pa.Array:
        keys, n, words = [], [], []
        for k in range(0, len(texts), 256):
            part = texts[k : k + 256].to_pylist()
            for t, w in zip(part, words_of(part), strict=True):
                keys.append(None if t is None else text_key(t, w))
                n.append(len(w))
                words.append((w >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(words, pa.list_(pa.int32()))], ["key", "n", "words"])

    @F.arrow_udf("array<bigint>")
    def candidates(words: pa.Array) -> pa.Array:
        return pa.array([candidate_keys(w.view(np.uint32).astype(np.uint64), p) for w in _arrays(words, "words")], pa.list_(pa.int64()))

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), prepare("text").alias("d")).select("doc_id", "rid", "d.*")
    rows = shared.table(rows.withColumn("key", F.coalesce("key", F.encode(F.concat(F.lit("null:"), F.col("rid").cast("string")), "utf-8"))))
    nodes = shared.table(rows.groupBy("key").agg(F.min("rid").alias("node"), F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")), MIDDLING)
    sizes, words = rows.select("rid", "n"), rows.select("rid", "words")

    first = nodes.select(F.col("node").alias("rid"))
    sketches = shared.table(rows.filter("n > 0").select("rid", "n", candidates("words").alias("sigs")).join(_far(first), "rid", "left_semi"), MIDDLING)
    buckets = sketches.select(F.col("rid").alias("node"), "n", F.explode("sigs").alias("sig"))
    firsts = buckets.groupBy("sig").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("sig", "a")
    # written before the join: a hot sketch's rows can be split over tasks only if both sides come straight from a shuffle
    firsts = shared.table(firsts.join(_far(sizes.select(F.col("rid").alias("a"), F.col("n").alias("na"))), "a"), MIDDLING)
    buckets = shared.table(buckets.join(_far(firsts), "sig"), MIDDLING)  # nodes that share a sketch with another, with their bucket's first
    shared.drop(sketches, firsts)
    # the words of nodes that share a sketch with another: all that is ever aligned
    sharing = shared.table(buckets.select(F.col("node").alias("rid")).distinct(), NARROW)
    words = shared.table(words.join(_bounded(sharing, p), "rid", "left_semi").withColumn("codes", word_codes("words")), MIDDLING)
    wide, rows = rows, shared.table(rows.select("doc_id", "rid", "key"), NARROW)
    shared.drop(wide)
    # texts of too different lengths can't align: their words needn't meet
    near = F.greatest("n", "na") - F.least("n", "na") <= F.greatest("n", "na") * (1 - p.similarity) + 1e-9
    pairs = buckets.filter(near & (F.col("node") != F.col("a"))).groupBy("a", F.col("node").alias("b")).agg((-F.count(F.lit(1))).alias("rank"))
    best = pairs.groupBy("b").agg(F.min(F.struct("rank", "a")).alias("best")).select("best.a", "b")
    best = shared.table(best, NARROW)
    links = verified(shared, best, words, p, few=False)
    label = components(shared, links)
    la, lb = (label.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    pairs = pairs.select("a", "b").join(_far(la), "a", "left").join(_far(lb), "b", "left").filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b"))
    stars = shared.table(pairs.select("a", "b").join(_far(best), ["a", "b"], "left_anti"), NARROW)
    if stars.limit(1).count():
        links = links.unionByName(verified(shared, stars, words, p, few=True))
        label = components(shared, links)
    pairs = best.unionByName(stars)

    more = settled(shared, buckets, label, pairs, words, p)
    shared.drop(buckets, words)
    if more.limit(1).count():
        label = components(shared, links.unionByName(more))

    named = nodes.join(_far(label), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of = named.groupBy("comp").agg(F.min("doc").alias("class_id"), F.min("node").alias("class_rid"), F.sum("copies").alias("class_size"))
    of = shared.table(of, MIDDLING)  # as above: one class may hold a third of all nodes
    named = named.select("key", "comp").join(_far(of), "comp").drop("comp")
    return rows.select("doc_id", "rid", "key").join(_far(named), "key").select("doc_id", "class_id", "class_size", "rid", "class_rid")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, class_id and class_size of every document."""
    return classes(docs, p).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each class, with its columns: the first row as the table is stored.

    The rows are written first, each with its number, so that the classes and the texts speak of the same rows.
    """
    shared = Shared(docs.sparkSession, "neardup-rows")
    numbered = shared.table(docs.withColumn("__lintquarry_rid", F.monotonically_increasing_id()))
    got = classes(numbered.select(F.col("__lintquarry_rid").alias("doc_id"), "text"), p)
    kept = got.filter("doc_id = class_id").select(F.col("doc_id").alias("__lintquarry_rid"))
    return numbered.join(kept, "__lintquarry_rid", "left_semi").drop("__lintquarry_rid")
