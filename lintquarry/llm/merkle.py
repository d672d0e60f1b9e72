"""A Merkle manifest of a dataset: one digest for all rows, one for each group, and a proof for each row.

A row's leaf is the digest of its fields, each with its length before it. Within a group (a source) the leaves stand in order; every 16
nodes that follow one another become one of the level above, until one is left; the groups' last nodes, in the groups' order, give the
root in the same way.

The nodes live in a store in the shared folder, never in memory: a folder of Parquet files for each level, with a node's coordinate
(group, place in its level). Leaves get their coordinates from sorted runs: rows are range-partitioned by group and order, each partition is
sorted and written as it stands, and a row's place is its group's rows in the runs before plus its place in its own run, so a group with a third of
all rows is spread over many tasks. Each level reads the one before and nothing else. Proofs are made by blocks of 256 neighbours: the nodes of
two levels over a block and the way from the block's top to the root, all found by coordinate, are merged in one task, and the way itself comes
from the blocks above in the same manner. Nothing but counts and the root goes through the driver, and no task holds more than a block.

Defined results: null fields give ``-``; a null group is the first; within a group rows with a null doc_id come first, and rows of the same doc_id go
by their leaves, so that equal rows have neighbouring places and their proofs are given in either order; an empty text is a value of
length 0; very long texts are digested whole where they lie; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Shared, ship

#: A node's children, as a power of two; a block's levels.
BITS, LEVELS = 4, 2
BLOCK = BITS * LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: So few runs and groups are sent to every task; more are met by a shuffle.
FEW_RUNS = 100_000

WAY = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def group_key(c: Column) -> Column:
    """A group's name that is never null and keeps the order: null first, then by bytes."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), c))


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


def with_places(shared: Shared, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a column ``grp``) and their place in their group by ``order`` (``pos``), with the group's size (``n``)."""
    order = ["grp", *order]
    parts = int(shared.spark.conf.get("spark.sql.shuffle.partitions"))
    # the last key deals out equal rows too
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    runs = rows.repartitionByRange(parts, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    runs = shared.table(runs.withColumn("_at", F.monotonically_increasing_id())).withColumn("_run", F.shiftright("_at", 33))
    sizes = runs.groupBy("grp", "_run").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    own = Window.partitionBy("grp").orderBy("_run")
    sizes = sizes.select("grp", "_run", (F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    sizes = shared.table(sizes, 4)
    near = F.broadcast(sizes) if sizes.count() <= FEW_RUNS else sizes.hint("merge")
    return runs.join(near, ["grp", "_run"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")


class Store:
    """The nodes over the leaves (grp, pos, n, node), level by level, each a table (grp, pos, n, node) read from the one before."""

    def __init__(self, shared: Shared, leaves: DataFrame):
        self.shared = shared
        self.levels = [leaves.select("grp", "pos", "n", "node")]
        most = self.levels[0].agg(F.max("n")).first()[0] or 0
        while most > 1 << (BITS * (len(self.levels) - 1)):
            self.levels.append(shared.table(self._over(len(self.levels) - 1), 4 if len(self.levels) == 1 else 16))

    def _over(self, k: int) -> DataFrame:
        """The level above k; a group whose level k has one node ends there."""
        several = self.levels[k].filter(F.col("n") > 1 << (BITS * k))
        runs = several.groupBy("grp", F.shiftright("pos", BITS).alias("pos")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: hex_of(x["node"])), "")
        return runs.select("grp", "pos", "n", F.unhex(F.sha2(joined.cast("binary"), 256)).alias("node"))

    def tops(self) -> DataFrame:
        """grp, n, node: each group's last node."""
        out = None
        for k, level in enumerate(self.levels):
            last = F.col("n") <= 1 << (BITS * k)
            if k:
                last &= F.col("n") > 1 << (BITS * (k - 1))
            level = level.filter(last).select("grp", "n", "node")
            out = level if out is None else out.unionByName(level)
        return out

    def ways(self, tops: DataFrame, bottom: DataFrame, make, schema: str) -> DataFrame:
        """What ``make`` gives for the leaves of each block.

        tops: grp, n, top (hexadecimal), way (of the group's last node to the root). bottom: the leaves (grp, pos, n, node) with further columns.
        make(table of a block's leaves, their ways, the group's top): a table of the schema.
        """
        over = lambda level: F.col("n") > 1 << (BITS * level)  # noqa: E731  groups that have several nodes in this level
        above = None
        for tier in range(max(1, -(-(len(self.levels) - 1) // LEVELS)) - 1, -1, -1):
            # from the upper blocks down: the way of a block's top is its own group's, or comes from the tier above
            base = tier * LEVELS
            heads = tops.withColumn("pos", F.lit(0).cast("bigint"))
            if above is not None:
                heads = heads.filter(~over(base + LEVELS)).unionByName(above)
            if tier:
                heads = heads.filter(over(base))
            nodes = F.shiftright(F.col("n") + ((1 << BITS * base) - 1), BITS * base)
            blocks = heads.select("grp", F.col("pos").alias("block"), F.lit(-1).alias("level"), "pos", nodes.alias("nodes"), "n", "top", "way")
            for k in range(min(LEVELS, len(self.levels) - base)):
                level = bottom if base + k == 0 else self.levels[base + k].filter(over(base + k))
                level = level.withColumns({"block": F.shiftright("pos", BLOCK - BITS * k), "level": F.lit(k)})
                blocks = blocks.unionByName(level, allowMissingColumns=True)
            work, out = (_upper, f"grp string, n bigint, top string, way {WAY}, pos bigint") if tier else (make, schema)
            done = blocks.groupBy("grp", "block").applyInArrow(_by_block(work), out)
            above = self.shared.table(done, 16) if tier else done
        return above


def _by_block(make):
    def work(table: pa.Table) -> pa.Table:
        level = table.column("level").to_numpy()
        head = table.filter(pa.array(level == -1))
        nodes = []
        for k in range(LEVELS):
            own = table.filter(pa.array(level == k))
            nodes.append({p: d.hex() for p, d in zip(own.column("pos").to_pylist(), own.column("node").to_pylist(), strict=True)})
        rest = [(x["before"], x["after"]) for x in head.column("way")[0].as_py()]
        total, memo = head.column("nodes")[0].as_py(), {}
        leaves = table.filter(pa.array(level == 0))
        ways = [way_up(p, nodes, total, memo) + rest for p in leaves.column("pos").to_pylist()]
        return make(leaves, ways, head.column("top")[0].as_py())

    return work


def way_up(pos: int, nodes: list[dict[int, str]], n: int, memo: dict) -> list[tuple[str, str]]:
    """The steps from a block's bottom node to its top: what stands before and after it in its run, level by level. n: nodes of the
    bottom level in the group."""
    out = []
    for k in range(LEVELS):
        if n <= 1:
            break
        if (k, pos) not in memo:
            first = pos >> BITS << BITS
            run = range(first, min(first + (1 << BITS), n))
            memo[k, pos] = "".join(nodes[k][i] for i in run if i < pos), "".join(nodes[k][i] for i in run if i > pos)
        out.append(memo[k, pos])
        pos, n = pos >> BITS, -(-n >> BITS)
    return out


WAY_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _way_column(ways: list) -> pa.Array:
    return pa.array([[{"before": b, "after": a} for b, a in w] for w in ways], WAY_ARROW)


def _upper(nodes: pa.Table, ways: list, top: str) -> pa.Table:
    return nodes.select(["grp", "n"]).append_column("top", pa.array([top] * len(ways), pa.string())).append_column("way", _way_column(ways)).append_column("pos", nodes.column("pos"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(node: str, way: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, after in way:
        node = sha(before + node + after)
    return node


def _group_ways(leaves: pa.Table, ways: list, top: str) -> pa.Table:
    return pa.table({"grp": leaves.column("name"), "root": pa.array([top] * len(ways), pa.string()), "way": _way_column(ways)})


def _proofs(leaves: pa.Table, ways: list, top: str) -> pa.Table:
    own = [d.hex() for d in leaves.column("node").to_pylist()]
    forged = [d.hex() if d is not None else None for d in leaves.column("forged").to_pylist()]
    root = leaves.column("root").to_pylist()
    digests, folded, memo = [], [], {}
    for node, bad, way, pos in zip(own, forged, ways, leaves.column("pos").to_pylist(), strict=True):
        digests.append(sha("".join(b + a for b, a in way)))
        if not way:
            folded.append(bad or node)
            continue
        # neighbours that are untampered meet in the level above
        key = pos >> BITS, fold(bad or node, way[:1])
        if key not in memo:
            memo[key] = fold(key[1], way[1:])
        folded.append(memo[key])
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": pa.array(own, pa.string()), "subroot": pa.array([top] * len(own), pa.string()), "root": leaves.column("root"),
        "proof_sha256": pa.array(digests, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == r for f, r in zip(folded, root, strict=True)], pa.bool_()),
    })


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """Each row's leaf, the roots over it, its proof's digest, and whether its text, or the ``forged`` text where that isn't null, folds up to the root."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, "merkle")
    own = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if forged is None else F.when(forged.isNotNull(), leaf([*own[:-1], forged]))
    rows = docs.select("doc_id", group_key(F.col("source")).alias("grp"), leaf(own).alias("node"), other.alias("forged"))
    # written first: sorting looks at its rows twice, and texts are to be digested once
    rows = shared.table(rows)
    leaves = shared.table(with_places(shared, rows, ["doc_id", "node"]))
    store = Store(shared, leaves)
    tops = store.tops()
    names = shared.table(with_places(shared, tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"]), 16)
    roots = Store(shared, names)
    root = roots.tops().select(hex_of(F.col("node")).alias("root")).first()
    no_way = F.array().cast(WAY)
    whole = roots.tops().select("grp", "n", hex_of(F.col("node")).alias("top"), no_way.alias("way"))
    ways = roots.ways(whole, names, _group_ways, f"grp string, root string, way {WAY}")
    tops = shared.table(tops.join(ways.hint("merge"), "grp").select("grp", "n", hex_of(F.col("node")).alias("top"), "way"), 16)
    return store.ways(tops, leaves.withColumn("root", F.lit(root[0] if root else None).cast("string")), _proofs, PROOFS)


def manifest_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with every row whose doc_id's checksum 5 divides tampered: its text in lower case (A to Z)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, *, coalesce('s' || source, '') AS grp, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
    coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: z::UBIGINT)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)),
      4294967295::UBIGINT) % 5 = 0, false) AS tampered
  FROM documents
), hashed AS (
  SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM docs
), leaves AS (
  SELECT rid, doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(text) || ':' || lower_text, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS start
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), up(grp, k, pos, h, n) AS (
  SELECT grp, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT grp, k + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value(n) FROM up WHERE n > 16 ** k GROUP BY grp, k, pos // 16
), subroots AS (
  SELECT grp, k AS depth, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT * FROM up QUALIFY k = max(k) OVER (PARTITION BY grp))
), top(k, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT k + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value(n) FROM top WHERE n > 16 ** k GROUP BY k, pos // 16
), whole AS (
  SELECT h AS root, k AS depth FROM top QUALIFY k = max(k) OVER ()
), steps AS (
  SELECT rid, up.k AS step, coalesce(string_agg(up.h, '' ORDER BY up.pos) FILTER (WHERE up.pos < p.pos // (16 ** up.k)::BIGINT), '') AS before,
    coalesce(string_agg(up.h, '' ORDER BY up.pos) FILTER (WHERE up.pos > p.pos // (16 ** up.k)::BIGINT), '') AS after
  FROM placed p JOIN subroots s USING (grp) JOIN up ON up.grp = p.grp AND up.k < s.depth AND up.pos // 16 = p.pos // (16 ** (up.k + 1))::BIGINT GROUP BY rid, up.k
  UNION ALL
  SELECT rid, s.depth + top.k, coalesce(string_agg(top.h, '' ORDER BY top.pos) FILTER (WHERE top.pos < s.pos // (16 ** top.k)::BIGINT), ''),
    coalesce(string_agg(top.h, '' ORDER BY top.pos) FILTER (WHERE top.pos > s.pos // (16 ** top.k)::BIGINT), '')
  FROM placed p JOIN subroots s USING (grp), whole, top WHERE top.k < whole.depth AND top.pos // 16 = s.pos // (16 ** (top.k + 1))::BIGINT GROUP BY rid, s.depth, top.k
), folds(rid, step, node) AS (
  SELECT rid, 0, start FROM placed
  UNION ALL
  SELECT rid, f.step + 1, sha256(before || node || after) FROM folds f JOIN steps USING (rid, step)
), folded AS (
  SELECT rid, node AS folded_root FROM folds QUALIFY step = max(step) OVER (PARTITION BY rid)
), proofs AS (
  SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (grp) JOIN folded USING (rid) LEFT JOIN proofs USING (rid), whole
"""
