"""Merkle manifest of a dataset: a tree of digests over its rows, and for each row a proof that it belongs to it.

A row's leaf is the SHA-256 of its fields. Leaves of one group (a language) stand in the order of a key; every
`ARITY` neighbours become the digest of their digests until one is left, the group's root; the groups' roots, in
the order of their names, become the dataset's root in the same way. A proof lists, from the leaf up, what stands left
and right of the node in its run.

Leaves are numbered by a range shuffle and counts of its partitions, and cut into aligned blocks of `BLOCK` leaves.
Blocks' roots are numbered already and are blocked again, until a group has one node: a few rounds, each
`BLOCK` times smaller than the last. Proofs are written from the top down. Within a block they come from
fractal traversal (Jakobsson, Leighton, Micali and Szydlo, 2003): for each level one existing run of nodes, that above
the present leaf, and one desired run, the next of its level, which grows by a leaf at each step and takes the place
of the existing one when the traversal gets there. So no more than `BLOCK_LEVELS` existing and as many desired runs
are held beside the block's leaves, and a block's task sees `BLOCK` leaves at most, however large a group is. The
proof of the block's root, made before, is appended to each path.

Null fields count as `-`, and a null group or key comes first. Rows with equal keys stand in the order of their
leaves; repeated rows each have a leaf. An empty table has no rows and no root. Columns that aren't asked for are not
read, whatever their names. Very long texts are hashed in the JVM and never leave the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garim.llm.shared import discard, saved

ARITY = 8
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: `monotonically_increasing_id` keeps the row's number in its partition in so many bits.
_ROW_BITS = 33


# --- the tree within a block -------------------------------------------------------------------


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def digest(run: list[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


class Growing:
    """The run of `level` nodes over the leaves from `first` on, built from one leaf at a time. Lower levels hold only
    the nodes whose run is not full yet."""

    def __init__(self, leaves: list[bytes], level: int, first: int):
        self.leaves, self.level, self.at = leaves, level, first
        self.end = min(first + ARITY ** (level + 1), len(leaves))
        self.runs: list[list[bytes]] = [[] for _ in range(level + 1)]

    def grow(self) -> None:
        if self.at >= self.end:
            return
        self.runs[0].append(self.leaves[self.at])
        self.at += 1
        for k in range(self.level):
            if len(self.runs[k]) < ARITY:
                break
            self._raise(k)

    def _raise(self, k: int) -> None:
        self.runs[k + 1].append(digest(self.runs[k]))
        self.runs[k] = []

    def nodes(self) -> list[bytes]:
        """The run, where all its leaves have been seen; what was left open at its end is closed."""
        while self.at < self.end:
            self.grow()
        for k in range(self.level):
            if self.runs[k]:
                self._raise(k)
        return self.runs[self.level]


def block_root(leaves: list[bytes], levels: int) -> bytes:
    return digest(Growing(leaves, levels - 1, 0).nodes()) if levels else leaves[0]


def traversal(leaves: list[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf in turn what stands left and right of its path, from the leaf's own run up."""
    existing = [Growing(leaves, k, 0).nodes() for k in range(levels)]
    desired = [Growing(leaves, k, ARITY ** (k + 1)) for k in range(levels - 1)]
    for i in range(len(leaves)):
        path = []
        for k, run in enumerate(existing):
            j = i // ARITY**k % ARITY
            path.append((b"".join(run[:j]), b"".join(run[j + 1 :])))
        yield path
        for k, run in enumerate(desired):
            run.grow()
            if (i + 1) % ARITY ** (k + 1) == 0:
                existing[k] = run.nodes()
                desired[k] = Growing(leaves, k, i + 1 + ARITY ** (k + 1))


def _leaves(block: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    block = block.sort_by("pos")
    leaves = [x.hex().encode() for x in block.column("digest").to_pylist()]
    return block, leaves, min(BLOCK_LEVELS, depth(block.column("total")[0].as_py()))


# --- numbering ---------------------------------------------------------------------------------


def ranked(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """df with each row's place in its group (pos, from 0) and the group's rows (total); a written table. Rows equal in
    all keys stand in the order of the input. df should be a table that was written: it is read twice."""
    dealt = df.withColumn("_nth", F.monotonically_increasing_id())
    keys = [group, *by, "_nth"]
    at = F.monotonically_increasing_id()
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    dealt = saved(dealt.select(*df.columns, F.shiftright("_at", _ROW_BITS).alias("_part"), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row")), "dealt")
    # A row for each partition and group in it.
    counts = dealt.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    counts = counts.select(
        "_part", group, "_first", F.sum("_n").over(whole).alias("total"),
        (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    out = saved(dealt.join(counts, ["_part", group]).select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("pos"), "total"), "ranked")
    discard(dealt)
    return out


# --- trees over all blocks ---------------------------------------------------------------------


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def _raised(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks, as nodes of the next round; a written table."""

    def root(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block, leaves, levels = _leaves(block)
        total = -(-block.column("total")[0].as_py() // BLOCK)
        made = bytes.fromhex(block_root(leaves, levels).decode())
        return pa.table({"name": [key[0].as_py()], "pos": [key[1].as_py()], "total": [total], "digest": [made]})

    blocks = _in_blocks(nodes.select("name", "pos", "total", "digest"))
    return saved(blocks.groupBy("name", "block").applyInArrow(root, "name string, pos long, total long, digest binary"), "nodes")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (name, pos, total, digest) and, round by round, the roots of their blocks, until each name has one."""
    found = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        found.append(_raised(found[-1]))
        most = -(-most // BLOCK)
    return found


def _proved(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes with their proofs; `upper` holds (name, pos, proof, subroot, root) of the blocks."""
    kept = [f for f in nodes.schema.fields if f.name not in ("total",)]
    names = [f.name for f in kept]

    def prove(key: tuple[pa.Scalar, ...], block: pa.Table, above: pa.Table) -> pa.Table:
        block, leaves, levels = _leaves(block)
        top = above.column("proof")[0].as_py()
        lefts, rights, offsets = [], [], [0]
        for path in traversal(leaves, levels):
            lefts += [x.decode() for x, _ in path] + [x["left"] for x in top]
            rights += [y.decode() for _, y in path] + [x["right"] for x in top]
            offsets.append(len(lefts))
        proof = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
        )
        out = {n: block.column(n) for n in names} | {"proof": proof}
        return pa.table(out | {n: pa.array([above.column(n)[0].as_py()] * len(leaves), pa.binary()) for n in ("subroot", "root")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", proof {PROOF}, subroot binary, root binary"
    blocks, above = _in_blocks(nodes), upper.withColumnRenamed("pos", "block")
    return blocks.groupBy("name", "block").cogroup(above.groupBy("name", "block")).applyInArrow(prove, schema)


def _down(found: list[DataFrame], top: DataFrame) -> DataFrame:
    """Proofs of the first round's nodes; `top` holds those of the last round's."""
    upper = top
    for nodes in reversed(found[:-1]):
        if nodes is not found[0]:
            upper = saved(_proved(nodes, upper).select("name", "pos", "proof", "subroot", "root"), "proofs")
        else:
            upper = _proved(nodes, upper)
    if len(found) == 1:  # a single node each
        upper = found[0].drop("total").join(top.drop("pos"), "name")
    return upper


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Leaves (a group, a key, `leaf` in hex, other columns) with (proof, subroot, root), digests in hex. Groups are
    named by strings; the order of strings is that of their bytes."""
    carried = [c for c in leaves.columns if c != "leaf"]
    # A null group has a name of its own, before all others.
    name = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))
    slim = leaves.select(name.alias("name"), F.unhex("leaf").alias("digest"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carried)])
    slim = saved(slim, "leaves")
    nodes = ranked(slim, "name", [f"c_{carried.index(order)}", "digest"])
    discard(slim)
    found = rounds(nodes)

    groups = saved(found[-1].select(F.lit("").alias("name"), F.col("name").alias("of"), "digest"), "groups")
    over = rounds(ranked(groups, "name", ["of"]))
    root = over[-1].select("name", "pos", F.lit(None).cast(PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    root = root.withColumn("proof", F.coalesce("proof", F.expr(f"cast(array() as {PROOF})")))
    tops = saved(_down(over, root).select(F.col("of").alias("name"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root"), "tops")
    discard(groups)

    proved = _down(found, tops)
    hexed = lambda c: F.lower(F.hex(c)).alias(c if c != "digest" else "leaf")
    return proved.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carried)], hexed("digest"), "proof", hexed("subroot"), hexed("root"))


# --- leaves and checks as expressions ----------------------------------------------------------


def leaf(*fields: Column) -> Column:
    """A row's leaf in hex: each field's bytes after their count, `-` where it is null."""

    def told(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Of all siblings from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def op11(docs: DataFrame) -> DataFrame:
    """Every row's proof, and what comes of it where a third of the texts are tampered with. A null doc_id is in no third."""
    fields = [F.col(c) for c in FIELDS]
    other = leaf(*fields[:-1], lowered(fields[-1]))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf(*fields).alias("leaf"), F.when(chosen, F.unhex(other)).alias("tampered"))
    proved = manifest(leaves)
    start = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    proved = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(start, F.col("proof")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([i::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), told as (
  select row_number() over () as r, doc_id, coalesce('1' || lang, '0') as name,
    {" || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS[:-1])} as head,
    coalesce(strlen(text) || ':' || text, '-') as body,
    coalesce(strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-') as other,
    xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 as chosen
  from documents, crc
), leaves as (
  select r, doc_id, name, sha256(head || body) as leaf, case when chosen then sha256(head || other) else sha256(head || body) end as start from told
), placed as (
  select *, row_number() over (partition by name order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by name) as n from leaves
), up as (
  select name, 0 as level, pos, n, leaf as h from placed
  union all
  select name, level + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by name, level, pos // {ARITY}, n
), runs as (
  select name, level, pos // {ARITY} as run, list(h order by pos) as hs from up where n > 1 group by name, level, pos // {ARITY}
), subroots as (
  select name, h as subroot, row_number() over (order by name) - 1 as nth, count(*) over () as names from up where n = 1
), over_names as (
  select 0 as level, nth as pos, names as n, subroot as h from subroots
  union all
  select level + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' order by pos)) from over_names where n > 1 group by level, pos // {ARITY}, n
), runs_of_names as (
  select level, pos // {ARITY} as run, list(h order by pos) as hs from over_names where n > 1 group by level, pos // {ARITY}
), climb as (
  select r, name, 0 as level, pos as place, start as h, '' as seen from placed
  union all
  select r, name, level + 1, place // {ARITY}, sha256(array_to_string(hs[: place % {ARITY}], '') || h || array_to_string(hs[place % {ARITY} + 2 :], '')),
    seen || array_to_string(hs[: place % {ARITY}], '') || array_to_string(hs[place % {ARITY} + 2 :], '')
  from climb join runs using (name, level) where run = place // {ARITY}
), arrived as (
  select r, nth as place, arg_max(h, level) as h, arg_max(seen, level) as seen from climb join subroots using (name) group by r, nth
), on_top as (
  select r, 0 as level, place, h, seen from arrived
  union all
  select r, level + 1, place // {ARITY}, sha256(array_to_string(hs[: place % {ARITY}], '') || h || array_to_string(hs[place % {ARITY} + 2 :], '')),
    seen || array_to_string(hs[: place % {ARITY}], '') || array_to_string(hs[place % {ARITY} + 2 :], '')
  from on_top join runs_of_names using (level) where run = place // {ARITY}
), ends as (select r, arg_max(h, level) as folded_root, arg_max(seen, level) as seen from on_top group by r)
select doc_id, leaf, subroot, root, sha256(seen) as proof_sha256, folded_root, folded_root = root as verified
from placed join subroots using (name) join ends using (r), (select h as root from over_names where n = 1)
"""
