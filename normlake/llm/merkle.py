"""Merkle manifest of a table: leaves hashed in place, runs of eight rolled up as nested structs, proofs by transform and explode.

A leaf's rank among its group's is split into octal digits. Within a block of ``8 ** DIGITS`` ranks the digits are grouped away one after
the other, the lowest first: what had one struct for each value of a digit becomes the array of these structs beside their hash, so a block
ends as one row that nests its whole subtree. The blocks' roots are the next level's leaves, 512 times fewer. Proofs come back down the
same way: a block's row is grouped with the path of its root, and one transform and explode gives each of its leaves the runs it passes.
Only hashes are shuffled, never texts, and no row holds more than one block, whatever share of the table a group holds.

Nulls are written as ``-`` and so differ from empty values; rows without an id come first. Repeated rows are leaves of their own, equal ids
are ordered by their hash. An empty table has no proofs. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizes import broadcast_if_small
from .staging import stage

FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS
_ITEM = "struct<doc_id:bigint,tampered:string>"
_PATH = "array<struct<at:int,run:array<string>>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """A row's hash: of each value its length in bytes, a colon and the value, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Staged ``rows`` with ``rank`` (from 0) within ``group`` by ``order``, and the group's size ``n``.

    Rows are dealt by ranges of (group, order), so a group of any size is spread; what comes before a range is summed from one row for
    each range and group in it.
    """
    keys, parts = [group, *order], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = stage(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = held.groupBy(F.col(group).alias("_g"), F.col("part").alias("_p")).agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    whole = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("_g", "_p", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p"))
    return held.join(broadcast_if_small(placed), same).withColumn("rank", F.col("at") - F.col("_first") + F.col("_before")).drop("part", "at", "_g", "_p", "_first", "_before")


def blocks(nodes: DataFrame) -> DataFrame:
    """Blocks ``grp, block, n, root, run, kids`` of ``grp, rank, n, hash, item``: digits grouped away, child structs nested.

    A level of a group that has a single node isn't hashed again.
    """
    digit = lambda k: F.shiftright("rank", 3 * k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{k}")
    at = nodes.select("grp", F.shiftright("rank", 3 * DIGITS).alias("block"), "n", *map(digit, range(DIGITS)), "hash", "item")
    at = at.repartition("grp", "block")  # all groupings below are finer than this
    held = ["hash", "item"]
    for k in range(DIGITS):
        keys = ["grp", "block", *[f"d{j}" for j in range(DIGITS - 1, k, -1)]]
        grouped = at.groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(f"d{k}", *held))).alias("kids"))
        run = F.transform("kids", lambda x: x["hash"])
        several = F.ceil(F.col("n") / FAN**k) > 1
        at = grouped.select(*keys, "n", F.when(several, digest(F.array_join(run, ""))).otherwise(run[0]).alias("hash"), run.alias("run"), "kids")
        held = ["hash", "run", "kids"]
    return at.withColumnRenamed("hash", "root")


def _paths(tree: DataFrame, above: DataFrame) -> DataFrame:
    """``grp, rank, hash, item, path, subroot, root`` of every node of the blocks ``tree``; ``above`` has the paths of their roots (``grp, block, path, subroot, root``)."""
    carried = ["path", "subroot", "root"]
    mine = tree.select("grp", "block", F.struct("n", "run", "kids").alias("tree"), *[F.lit(None).cast(t).alias(c) for c, t in zip(carried, (_PATH, "string", "string"))])
    theirs = above.select("grp", "block", F.lit(None).cast(mine.schema["tree"].dataType).alias("tree"), *carried)
    met = mine.unionByName(theirs).groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("tree", *carried)])

    def below(kids: Column, run: Column, k: int, passed: list[Column], rank: Column) -> Column:
        """The nodes below ``kids`` of digit ``k``, with the steps from the lowest up."""

        def one(x: Column) -> Column:
            here = rank + F.shiftleft(x[f"d{k}"].cast("long"), 3 * k)
            steps = [F.when(F.ceil(F.col("tree.n") / FAN**k) > 1, F.struct(x[f"d{k}"].alias("at"), run.alias("run"))), *passed]
            if k:
                return below(x["kids"], x["run"], k - 1, steps, here)
            return F.struct(here.alias("rank"), x["hash"].alias("hash"), x["item"].alias("item"), F.array_compact(F.array(*steps)).cast(_PATH).alias("path"))

        return F.flatten(F.transform(kids, one)) if k else F.transform(kids, one)

    nodes = below(F.col("tree.kids"), F.col("tree.run"), DIGITS - 1, [], F.col("block") * BLOCK)
    each = met.select("grp", F.explode(nodes).alias("x"), *carried)
    return each.select("grp", "x.rank", "x.hash", "x.item", F.concat("x.path", "path").alias("path"), "subroot", "root")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of nodes, blocks of their roots and so on, until every group is one block; each staged."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tables = []
    while True:
        tables.append(stage(blocks(nodes)))
        most = -(-most // BLOCK)
        if most <= 1:
            return tables
        nodes = tables[-1].select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("hash"), F.lit(None).cast(_ITEM).alias("item"))


def _down(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the lowest nodes of :func:`_levels`, from those of the uppermost blocks."""
    found = _paths(tables[-1], above)
    for tree in reversed(tables[:-1]):
        found = _paths(tree, found.select("grp", F.col("rank").alias("block"), "path", "subroot", "root"))
    return found


def siblings(path: Column) -> Column:
    """The hashes that a verifier needs, one after the other: each run without the node itself, from the leaf's up."""
    others = lambda p: F.array_join(F.filter(p["run"], lambda h, i: i != p["at"]), "")
    return F.aggregate(path, F.lit(""), lambda s, p: F.concat(s, others(p)))


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's hash and the siblings on its path."""
    run = lambda h, p: F.array_join(F.transform(p["run"], lambda x, i: F.when(i == p["at"], h).otherwise(x)), "")
    return F.aggregate(path, start, lambda h, p: F.sha2(run(h, p), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, lang, leaf, rank, path, subroot, root`` of every row of documents: a tree for each language, and one over their roots.

    ``path`` has for each level that was hashed the node's place ``at`` and its whole ``run``. ``tampered`` is the hash of what a row may
    have become since (default: its leaf); it is carried along for :func:`fold`.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hashed = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*fields).alias("hash"), (leaf(*fields) if tampered is None else tampered).alias("tampered"))
    leaves = ranked(hashed, "grp", ["doc_id", "hash"])
    trees = _levels(leaves.select("grp", "rank", "n", "hash", F.struct("doc_id", "tampered").alias("item")))
    roots = trees[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("lang"), F.col("root").alias("hash"))
    over = ranked(roots, "grp", ["lang"])
    # The language goes where a leaf has its tampered hash: it is what its proofs are grouped by below.
    top = _levels(over.select("grp", "rank", "n", "hash", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("lang").alias("tampered")).alias("item")))
    proved = _down(top, top[-1].select("grp", "block", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), "root"))
    above = proved.select(F.col("item.tampered").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("hash").alias("subroot"), "root")
    found = _down(trees, above)
    return found.select("item.doc_id", F.col("grp").alias("lang"), F.col("hash").alias("leaf"), "rank", "path", "subroot", "root", "item.tampered")


def verify(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked after tampering with those whose id's CRC-32 3 divides: A to Z in their texts become a to z.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; a row whose text has no such letter stays verified.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = leaf(*fields, F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text")))
    found = manifest(docs, changed)
    folded = fold(F.col("tampered"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
