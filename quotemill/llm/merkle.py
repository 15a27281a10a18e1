"""Merkle dataset manifest: a content-addressed tree over the rows of a table, and proofs of single rows.

A row's leaf is the SHA-256 of its columns, each as its UTF-8 length, a colon and its value, or ``-`` if null. Within a group
the leaves ascend by key; each run of ``fan`` nodes becomes the SHA-256 of their digests until one is left, the group's subroot. The
subroots, in order of their groups, are the leaves of the tree above, whose last node is the root.

The manifest stores records from a digest to the digests of its children, a table for each height. Requests for leaves
descend from the root: at each height the distinct prefixes of their ranks look up the record of the node they
have reached, take the child that the rank's digit selects, and collect the children before and after it. Turned round, the
segments of the path are the proof. Prefixes, not leaves, descend, so no record is met by more rows than it has children.

Defined cases: null keys come first; rows with equal keys ascend by their leaf; equal rows are leaves of their own; a single
leaf is the subroot, and a single subroot the root; an empty table has no root, and gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle
from .ranks import ranked

PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(columns: list[Column]) -> Column:
    """Each column as length, colon, value; ``-`` if null."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(*map(field, columns))


def group_key(group: Column) -> Column:
    """A text without nulls that sorts as the group does: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def _grow(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """``nodes``: tree, pos, n (nodes of the tree), digest. Records (digest, children) by height from 1, and the roots of all
    trees: tree, digest, height."""
    records: list[DataFrame] = []
    tops = [nodes.filter("n = 1").select("tree", "digest", F.lit(0).alias("height"))]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        runs = nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {fan}").alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        level = settle(runs.agg(children.alias("children")).withColumn("digest", digest(F.array_join("children", ""))))
        records.append(settle(level.select("digest", "children").dropDuplicates(["digest"])))  # equal runs have one record
        tops.append(level.filter("n = 1").select("tree", "digest", F.lit(len(records)).alias("height")))
        nodes = level.select("tree", "pos", "n", "digest")
    return records, reduce(DataFrame.union, tops)


@dataclass
class Manifest:
    """``leaves``: tree (the group's key), pos, n (the tree's leaves), key, digest and what was handed on; ``subroots``: tree, pos, n, digest, height;
    ``records`` of the groups' trees and ``upper`` of the tree over the subroots, by height from 1; ``root``: one row, or none."""

    leaves: DataFrame
    subroots: DataFrame
    records: list[DataFrame]
    upper: list[DataFrame]
    root: DataFrame
    fan: int


def build(rows: DataFrame, *, group: str, key: str, columns: list[str], handed_on: dict[str, Column] | None = None, fan: int = 16) -> Manifest:
    """The manifest of ``rows``; ``handed_on`` are further columns of the leaves, by expressions over ``rows``."""
    leaf = leaf_of([F.col(f"`{c}`") for c in columns])
    leaves = settle(rows.select(group_key(F.col(f"`{group}`")).alias("tree"), F.col(f"`{key}`").alias("key"), leaf.alias("digest"), *[c.alias(k) for k, c in (handed_on or {}).items()]))
    found = settle(ranked(leaves, "tree", [F.col("key"), F.col("digest")]))
    discard(leaves)
    records, tops = _grow(found.select("tree", "pos", "n", "digest"), fan)
    subroots = settle(ranked(settle(tops.withColumn("all", F.lit("all"))), "all", [F.col("tree")]))
    upper, root = _grow(subroots.select(F.col("all").alias("tree"), "pos", "n", "digest"), fan)
    return Manifest(found, subroots, records, upper, settle(root), fan)


def _descend(requests: DataFrame, starts: DataFrame, records: list[DataFrame], fan: int) -> DataFrame:
    """``requests``: tree, pos, n and others. ``starts``: tree, digest, height, path (root first). The requests with ``reached``, the digest
    that their ranks lead to, ``top``, that at which they began, and ``path``.

    ``here`` are the nodes that prefixes of requested ranks have reached; the longer prefixes go on from there.
    """
    begin = lambda height: starts.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("at"), "digest", F.col("digest").alias("top"), "path")
    prefixes = {0: requests.filter("n > 1").withColumn("at", F.col("pos"))}
    if len(records) > 1:
        prefixes[1] = settle(prefixes[0].select("tree", F.expr(f"at div {fan}").alias("at")).distinct())
    for height in range(2, len(records)):
        prefixes[height] = prefixes[height - 1].select("tree", F.expr(f"at div {fan}").alias("at")).distinct()
    segment = F.struct(F.array_join(F.slice("__children", 1, F.col("__digit")), "").alias("before"), F.array_join(F.slice("__children", F.col("__digit") + 2, fan), "").alias("after"))
    ending = [F.element_at("__children", F.col("__digit") + 1).alias("reached"), F.col("__top").alias("top"), F.concat("__path", F.array(segment)).alias("path")]
    here = begin(len(records))
    for height in range(len(records) - 1, -1, -1):
        record = records[height].select(F.col("digest").alias("__of"), F.col("children").alias("__children"))
        node = here.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), F.col("digest").alias("__digest"), F.col("top").alias("__top"), F.col("path").alias("__path"))
        node = node.join(record, F.col("__digest") == F.col("__of"))
        wanted = prefixes[height].withColumn("__up", F.expr(f"at div {fan}")).withColumn("__digit", (F.col("at") % fan).cast("int"))
        met = wanted.join(node, (F.col("tree") == F.col("__tree")) & (F.col("__up") == F.col("__at")))
        if height:
            here = met.select("tree", "at", ending[0].alias("digest"), *ending[1:]).unionByName(begin(height))
        else:
            here = met.select(*requests.columns, *ending)
    alone = begin(0).select(F.col("tree").alias("__tree"), F.col("digest").alias("reached"), "top", "path")
    alone = requests.filter("n = 1").join(alone, F.col("tree") == F.col("__tree")).select(*requests.columns, "reached", "top", "path")
    return here.union(alone) if records else alone


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``requests`` (rows of the manifest's leaves; all if None) with ``subroot``, ``reached`` (the digest found for them) and ``path``: the segments of
    their siblings, those of the leaf's own run first."""
    groups = manifest.subroots if requests is None else manifest.subroots.join(requests.select("tree").distinct(), "tree", "left_semi")
    top = manifest.root.select("tree", "digest", "height", F.array().cast(PATH).alias("path"))
    groups = groups.select(F.col("all").alias("tree"), "pos", "n", F.col("tree").alias("name"), "height")
    starts = _descend(groups, top, manifest.upper, manifest.fan).select(F.col("name").alias("tree"), F.col("reached").alias("digest"), "height", "path")
    found = _descend(manifest.leaves if requests is None else requests, settle(starts), manifest.records, manifest.fan)
    return found.withColumn("path", F.reverse("path")).withColumnRenamed("top", "subroot")


def proof_sha256(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of its path."""
    return F.aggregate(path, leaf, lambda x, s: digest(s["before"], x, s["after"]))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` where there is nothing else than ASCII."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def verify(rows: DataFrame, *, group: str = "source", key: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, hit: Column | None = None, fan: int = 16) -> DataFrame:
    """Per row: key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    Rows for which ``hit`` holds are folded from their leaf with the columns of ``tampered`` in place of the given ones.
    """
    changed = F.lit(None).cast("string") if hit is None else F.when(hit, leaf_of([(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]))
    manifest = build(rows, group=group, key=key, columns=list(columns), handed_on={"changed": changed}, fan=fan)
    root = manifest.root.first()
    found = prove(manifest).select(
        F.col("key").alias(key), F.col("reached").alias("leaf"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root"), proof_sha256(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "reached"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
