"""Trie of the turns that rebuilt conversations have in common at their beginnings.

A conversation is rebuilt from the first ``head`` turns of another one and its own turns behind its
first ``head``.  Nothing is rebuilt as text:

* The fingerprint of a run of turns is an element (length, value) of a monoid: the value is a
  polynomial in a base, modulo a prime, and running two runs on is ``(m + n, v * base**n + w)``.
  Each conversation's running products are made once (``scans``), over its stored turns.
* A prefix of a rebuilt conversation is a head of one conversation and a run of another.  Its
  fingerprint is put together from three running products, whatever the texts are.
* Turns have a reference: place of the first stored turn of the same role and text (SHA-256).
  Conversations of equal depth and fingerprint are a node.  The node is checked: all its members
  must refer to the same last turn.  Equal value and equal last turn mean an equal value before,
  so by induction all turns are the same.  If a node fails, two prefixes share a value, and all
  is done again with the next modulus and base of ``KEYS``.

Sums over subtrees need no walk from level to level.  Along the path of a conversation the smallest
members only grow, so the nodes of one smallest member are a chain, and the trie is a tree of
chains.  Totals of chains are added up by doubling (each round reaches twice as far), in as many
rounds as the logarithm of the number of chains on a path; along a chain they are running sums.

A conversation may hold a third of all turns, a turn or a prefix may be in a third of all
conversations: running products and sums are made over sorted blocks, all else by aggregates that
sum up before the shuffle and by joins on written tables.  Only the digest of the conversations that
end in a node reads them in one task, in order, as SHA-256 must; it keeps one batch of ids.

Order and nulls: turns go by ``turn`` (null first), equal ones by SHA-256 of role and text.  Null
roles and texts are empty.  Rows of a null conv_id are no conversation and left out.  Repeated rows
are turns of their own.  Ids must be integers; the remainder of a negative one is negative, as in
SQL.  A rebuilt conversation can be without turns; it is a member of the root, which is there
unless the table is empty.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import stage
from creditloom.llm.scans import running_products
from creditloom.session import configure

#: Conversations of one base: c and c - c % GROUP.
GROUP = 100
#: Turns of a head: the crc32 of the id modulo this.
HEADS = 6


@dataclass(frozen=True)
class Key:
    """Modulus (a prime of at most 127 bits) and base of the fingerprints."""

    modulus: int
    base: int

    def power(self, n: int) -> int:
        return pow(self.base, n, self.modulus)

    @staticmethod
    def number(digest: bytes) -> int:
        """Value of one turn, from its SHA-256."""
        return int.from_bytes(digest[:16])

    def split(self, value: int) -> tuple[int, int]:
        """Two numbers of 64 bits with sign."""
        return (value >> 64) - (1 << 62), (value & (1 << 64) - 1) - (1 << 63)

    def join(self, high: int, low: int) -> int:
        return (high + (1 << 62) << 64) + low + (1 << 63)

    def combine(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
        v = self.join(*a[1:]) * self.power(b[0]) + self.join(*b[1:])
        return (a[0] + b[0], *self.split(v % self.modulus))

    def element(self, digest: bytes) -> tuple[int, int, int]:
        return (1, *self.split(self.number(digest) % self.modulus))


#: A Mersenne prime and bases of no meaning; the next one is taken if prefixes collide.
KEYS = [Key(2**127 - 1, int(hashlib.sha256(b"base %d" % i).hexdigest()[:31], 16)) for i in range(4)]


def default_base(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def default_head(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and n_chars of each turn; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("bigint").alias("n_chars"),
    )


def _with_references(turns: DataFrame) -> DataFrame:
    """``ref_conv`` and ``ref_turn``: where the first stored turn of the same digest stands."""
    again = (
        turns.groupBy("digest")
        .agg(F.min(F.struct("conv_id", "upto")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    return turns.join(again, "digest", "left").select(
        *turns.columns,
        F.coalesce("first.conv_id", "conv_id").alias("ref_conv"),
        F.coalesce("first.upto", "upto").alias("ref_turn"),
    )


def _plans(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """How each conversation is rebuilt: its own and its base's first ``most`` turns at hand."""
    early = F.when(
        F.col("upto") <= most, F.struct("upto", "a", "b", "ref_conv", "ref_turn", "n_chars")
    )
    own = stage(
        turns.groupBy("conv_id").agg(
            F.max("upto").alias("n"), F.sort_array(F.collect_list(early)).alias("early")
        ),
        "first-turns",
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("early").alias("heads"))
    joined = own.withColumns({"base": base, "head": head}).join(bases, "base", "left")
    taken = F.slice(F.coalesce("heads", F.array().cast(own.schema["early"].dataType)), F.lit(1), F.col("head"))
    before = F.when((F.col("head") > 0) & (F.col("n") > F.col("head")), F.get("early", F.col("head") - 1))
    return joined.select(
        "conv_id",
        "n",
        "head",
        taken.alias("heads"),
        F.size(taken).alias("k"),
        F.get(taken, F.size(taken) - 1).alias("tail"),  # running product of the head
        before.alias("before"),  # of the own turns that are left out
        (F.size(taken) + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("length"),
    )


_PREFIX = "conv_id bigint, depth bigint, a bigint, b bigint, pa bigint, pb bigint, ref_conv bigint, ref_turn bigint, n_chars bigint, last boolean"


def _composer(key: Key):
    """Rows of own turns with their plan -> prefixes that end with them."""
    inverse = pow(key.base, -1, key.modulus)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict[int, int] = {}
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in batch.schema.names}
            fingerprints, above = [], []
            for i, m in enumerate(c["m"]):
                value = key.join(c["a"][i], c["b"][i])
                shift = 0
                if c["ta"][i] is not None:
                    shift += key.join(c["ta"][i], c["tb"][i])
                if c["ba"][i] is not None:
                    shift -= key.join(c["ba"][i], c["bb"][i])
                if shift:
                    if m not in powers:
                        if len(powers) > 100_000:
                            powers.clear()
                        powers[m] = key.power(m)
                    value += shift * powers[m]
                value %= key.modulus
                fingerprints.append(key.split(value))
                above.append(key.split((value - key.number(c["digest"][i])) * inverse % key.modulus))
            out = {x: batch.column(x) for x in ("conv_id", "depth", "ref_conv", "ref_turn", "n_chars", "last")}
            for names, pairs in ((("a", "b"), fingerprints), (("pa", "pb"), above)):
                for x, numbers in zip(names, zip(*pairs) if pairs else ((), ())):
                    out[x] = pa.array(numbers, pa.int64())
            order = ["conv_id", "depth", "a", "b", "pa", "pb", "ref_conv", "ref_turn", "n_chars", "last"]
            yield pa.RecordBatch.from_pydict({x: out[x] for x in order})

    return compose


def _prefixes(turns: DataFrame, plans: DataFrame, key: Key) -> DataFrame:
    """One row per rebuilt conversation and depth from 1: fingerprint, the one above, last turn."""
    zero = [F.lit(x).cast("bigint") for x in key.split(0)]
    above = F.col("i") - 1
    heads = plans.select("conv_id", "length", "heads", F.posexplode("heads").alias("i", "at")).select(
        "conv_id",
        (F.col("i") + 1).cast("bigint").alias("depth"),
        "at.a",
        "at.b",
        F.when(F.col("i") == 0, zero[0]).otherwise(F.get("heads", above)["a"]).alias("pa"),
        F.when(F.col("i") == 0, zero[1]).otherwise(F.get("heads", above)["b"]).alias("pb"),
        "at.ref_conv",
        "at.ref_turn",
        "at.n_chars",
        (F.col("i") + 1 == F.col("length")).alias("last"),
    )
    plan = plans.where(F.col("n") > F.col("head")).select(
        "conv_id", "n", "head", "k", F.col("tail.a").alias("ta"), F.col("tail.b").alias("tb"),
        F.col("before.a").alias("ba"), F.col("before.b").alias("bb"),
    )
    own = (
        turns.join(plan, "conv_id")
        .where(F.col("upto") > F.col("head"))
        .withColumn("m", F.col("upto") - F.col("head"))
        .withColumns({"depth": F.col("k") + F.col("m"), "last": F.col("upto") == F.col("n")})
        .drop("turn", "upto", "n", "head", "k")
        .mapInArrow(_composer(key), _PREFIX)
    )
    return heads.unionByName(own)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in each node, ascending."""
    node = ["depth", "a", "b"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for at, members in groupby(rows, key=itemgetter(0, 1, 2)):
            digest, between = hashlib.sha256(), b""
            for *_, conv in members:
                digest.update(between + b"%d" % conv)
                between = b","
            out.append((*at, digest.hexdigest()))
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip([*node, "ends"], r)) for r in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([*node, "ends"], r)) for r in out])

    together = ends.select(*node, "conv_id").repartition(*node).sortWithinPartitions(*node, "conv_id")
    return together.mapInArrow(hashed, "depth bigint, a bigint, b bigint, ends string")


def _nodes(prefixes: DataFrame, plans: DataFrame, key: Key) -> DataFrame:
    """Depth, fingerprint, smallest member and members of each node; ``clash`` where they differ."""
    zero = [F.lit(x).cast("bigint") for x in key.split(0)]
    groups = prefixes.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.min("ref_conv").alias("ref_conv"),
        F.min("ref_turn").alias("ref_turn"),
        F.max("n_chars").alias("n_chars"),
        (
            (F.min("ref_conv") != F.max("ref_conv")) | (F.min("ref_turn") != F.max("ref_turn"))
        ).alias("clash"),
    )
    root = (
        plans.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        .where("n_convs > 0")
        .withColumns(
            {
                "depth": F.lit(0).cast("bigint"),
                "a": zero[0],
                "b": zero[1],
                "n_chars": F.lit(0).cast("bigint"),
                "clash": F.lit(False),
            }
        )
    )
    return groups.unionByName(root, allowMissingColumns=True)


def _chain_totals(chains: DataFrame, root: int) -> DataFrame:
    """``chains`` (chain, up, leaves, saved) with the totals of all chains that hang below."""
    state = stage(chains, "chains")
    while state.where(F.col("up").isNotNull()).limit(1).count():
        added = (
            state.where(F.col("up").isNotNull())
            .groupBy(F.col("up").alias("chain"))
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        )
        # above the root's chain there is none, so what hangs on it needs no look-up
        deep = state.where(F.col("up") != root).select("chain", "up")
        further = deep.join(
            state.select(F.col("chain").alias("up"), F.col("up").alias("next")), "up"
        ).select("chain", "next")
        state = stage(
            state.join(added, "chain", "left")
            .join(further, "chain", "left")
            .select(
                "chain",
                F.col("next").alias("up"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "chains",
        )
    return state.select("chain", "leaves", "saved")


def _add(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x + y for x, y in zip(a, b))


def _with_subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id, n_children, n_leaves and saved_tokens."""
    top = nodes.where("depth = 0").select("conv_id").first()
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    linked = stage(
        nodes.join(above, ["depth", "pa", "pb"], "left").select(
            "depth",
            "a",
            "b",
            "conv_id",
            "parent_conv_id",
            "n_convs",
            "ref_conv",
            "ref_turn",
            ((F.col("n_convs") - 1) * F.col("n_chars")).alias("own"),
        ),
        "linked",
    )
    if top is None:  # no conversation at all
        none = F.lit(0).cast("bigint")
        return linked.withColumns({"n_children": none, "n_leaves": none, "saved_tokens": none})
    hung = linked.where(F.col("parent_conv_id") != F.col("conv_id")).select(
        F.col("conv_id").alias("chain"),
        F.col("parent_conv_id").alias("up"),
        (F.col("depth") - 1).alias("at"),
    )
    with_hung = hung.select(F.col("up").alias("chain"), F.col("at").alias("end")).distinct()
    lengths = linked.groupBy(F.col("conv_id").alias("chain")).agg(
        F.max("depth").alias("end"), F.sum("own").alias("saved")
    )
    # the last node of a chain is childless unless another chain hangs there
    bare = with_hung.withColumn("hung", F.lit(True))
    chains = stage(
        lengths.join(bare, ["chain", "end"], "left")
        .withColumn("leaves", F.when(F.col("hung"), 0).otherwise(1).cast("bigint"))
        .join(hung, "chain", "left")
        .select("chain", "up", "at", "end", "leaves", "saved"),
        "own-chains",
    )
    totals = _chain_totals(chains.select("chain", "up", "leaves", "saved"), top["conv_id"])
    hanging = (
        chains.where(F.col("up").isNotNull())
        .select("chain", "up", "at")
        .join(totals, "chain")
        .groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
        .agg(
            F.count("*").alias("hung"),
            F.sum("leaves").alias("hung_leaves"),
            F.sum("saved").alias("hung_saved"),
        )
    )
    ends = chains.select(
        F.col("chain").alias("conv_id"), F.col("end").alias("depth"), F.col("leaves").alias("leaf")
    )
    zero = F.lit(0)
    weighed = (
        linked.join(hanging, ["conv_id", "depth"], "left")
        .join(ends, ["conv_id", "depth"], "left")
        .select(
            *linked.columns,
            F.negative("depth").alias("_from_end"),
            # the next node of the same chain, and chains that hang here
            (F.col("leaf").isNull().cast("bigint") + F.coalesce("hung", zero)).alias("n_children"),
            (F.coalesce("leaf", zero) + F.coalesce("hung_leaves", zero)).alias("_leaves"),
            (F.col("own") + F.coalesce("hung_saved", zero)).alias("_saved"),
        )
    )
    return running_products(
        weighed,
        "conv_id",
        ["_from_end"],
        ["_leaves", "_saved"],
        ["n_leaves", "saved_tokens"],
        lambda leaves, saved: (leaves, saved),
        _add,
        "subtrees",
    )


def prefix_trie(
    conversations: DataFrame,
    base: Column | None = None,
    head: Column | None = None,
    most: int = HEADS - 1,
    keys: list[Key] = KEYS,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and ref_conv_id and ref_turn, the stored turn (counted
    from 1) that holds the node's last text.

    ``base`` and ``head`` say, as columns over conv_id, from which conversation how many first
    turns are taken (at most ``most``).
    """
    configure(conversations.sparkSession)
    base = default_base(F.col("conv_id")) if base is None else base
    head = default_head(F.col("conv_id")) if head is None else head
    stored = _turns(conversations)
    for key in keys:
        turns = stage(
            _with_references(
                running_products(
                    stored, "conv_id", ["turn", "digest"], ["digest"], ["upto", "a", "b"],
                    key.element, key.combine, "turns",
                )
            ),
            "referred",
        )
        plans = stage(_plans(turns, base, head, most), "plans")
        prefixes = stage(_prefixes(turns, plans, key), "prefixes")
        nodes = stage(_nodes(prefixes, plans, key), "nodes")
        if not nodes.where("clash").limit(1).count():
            break
    else:
        raise RuntimeError("prefixes collide under every key")
    zero = [F.lit(x).cast("bigint") for x in key.split(0)]
    turnless = plans.where("length = 0").select(
        F.lit(0).cast("bigint").alias("depth"), zero[0].alias("a"), zero[1].alias("b"), "conv_id"
    )
    ends = prefixes.where("last").select("depth", "a", "b", "conv_id").unionByName(turnless)
    none = hashlib.sha256(b"").hexdigest()
    return (
        _with_subtrees(nodes)
        .join(_digests(ends), ["depth", "a", "b"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
            F.col("ref_conv").alias("ref_conv_id"),
            "ref_turn",
        )
    )
