"""Merkle manifest of a dataset: a tree of digests per source, and one tree over the sources' roots.

Every run of three consecutive nodes becomes the digest of their digests. Nodes of one tree carry a gapless
position, so a node of level j stands at a row whose position is a multiple of 3 ** j and its siblings stand
at fixed offsets: lag and lead by 3 ** j and 2 * 3 ** j rows, masked by the node's slot in its run and by the
run's length, give the siblings, and the row of the first child hashes the parent.

A tree of any size is cut into chunks of 3 ** LEVELS positions, which are whole subtrees. One shuffle by (tree,
chunk) serves LEVELS levels; the chunks' nodes are the leaves of the next round. So a source with a third of
all rows is spread over as many tasks as its chunks. The rounds are written to the shared folder as the ledger
of the tree. Proofs go the other way: inside a chunk the last node at or before a row is its ancestor, and
a chunk's rows get the rest of the path by a join on (tree, chunk).

Leaves of a source ascend by ``doc_id`` (null first, ties by leaf digest: equal rows are interchangeable);
sources ascend bytewise, null first. Null columns have their own mark in a leaf. A source of one row is its
own root. An empty table has no rows and no root. Columns that are not part of a leaf are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import durable
from tessera.operators.sequence import ordered_index

ARITY = 3
#: Levels of one round: a chunk has at most 3 ** LEVELS rows.
LEVELS = 7
CHUNK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    fields = fields or {}
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _positions(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with tree, pos and n; sources with tree and n). A tree is a source's place in their order."""
    # the sampling of the range shuffle reads the small written table, not the texts
    ranged = durable(leaves.repartitionByRange("source", "doc_id", "leaf").withColumn("part", F.spark_partition_id()), "leaves")
    chunks = ranged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("size"))
    sources = ordered_index(chunks.groupBy("source").agg(F.sum("size").alias("n")), [], ["source"], "tree")
    sources = durable(sources.select("source", "tree", "n"), "sources")
    before = F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    here = sources.withColumnRenamed("source", "s")
    starts = (chunks.withColumn("start", F.coalesce(before, F.lit(0)))
              .join(here, F.col("source").eqNullSafe(F.col("s"))).select(F.col("part").alias("p"), "s", "start", "tree", "n"))
    place = F.row_number().over(Window.partitionBy("part", "source").orderBy("doc_id", "leaf")) - 1
    rows = (ranged.withColumn("place", place)
            .join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
            .withColumn("pos", F.col("start") + F.col("place")))
    return rows.drop("part", "p", "s", "source", "start", "place"), sources


def _round(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, n, digest, ...) with LEVELS levels built above them: ``side_j`` (left and right siblings of
    the level-j node that starts at the row) and ``node``, the chunk's digest at its first row."""
    inside = Window.partitionBy("tree", "chunk").orderBy("pos")
    df = nodes.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).withColumn("node", F.col("digest"))
    for j in range(LEVELS):
        step = ARITY ** j
        slot = F.floor(F.col("pos") / step) % ARITY
        stands = (F.col("pos") % step == 0) & (F.col("n") > step)
        names = []
        for ahead in range(-(ARITY - 1), ARITY):
            if not ahead:
                continue
            at = F.lag("node", -ahead * step).over(inside) if ahead < 0 else F.lead("node", ahead * step).over(inside)
            in_run = (slot + ahead >= 0) & (slot + ahead < ARITY) & (F.col("pos") + ahead * step < F.col("n"))
            names.append(f"at_{ahead + ARITY}")
            df = df.withColumn(names[-1], F.when(stands & in_run, at))
        text = [F.coalesce(F.col(c), F.lit("")) for c in names]
        left, right = F.concat(*text[: ARITY - 1]), F.concat(*text[ARITY - 1:])
        df = df.withColumn(f"side_{j}", F.when(stands, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.sha2(F.concat("node", f"side_{j}.right").cast("binary"), 256)
        df = df.withColumn("node", F.when(F.col("pos") % (step * ARITY) == 0, F.when(stands, parent).otherwise(F.col("node")))).drop(*names)
    return df


def _build(nodes: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(the ledgers of the rounds from the leaves up, (tree, digest) of every tree's root)."""
    ledgers = []
    while True:
        ledgers.append(durable(_round(nodes), name))
        up = ledgers[-1].where("node is not null")
        nodes = up.select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / CHUNK).alias("n"), F.col("node").alias("digest"))
        largest = -(-largest // CHUNK)
        if largest <= 1:
            return ledgers, nodes.select("tree", "digest")


def _paths(ledger: DataFrame, above: DataFrame | None, carry: list[str]) -> DataFrame:
    """The ledger's rows with ``path``, their siblings of all levels from the row up to the root; ``above``: (tree, chunk, path)."""
    so_far = Window.partitionBy("tree", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sides = [F.last(f"side_{j}", ignorenulls=True).over(so_far).alias(f"side_{j}") for j in range(LEVELS)]
    rows = ledger.drop("digest", "node").select(*[c for c in ledger.columns if c not in ("digest", "node") and not c.startswith("side_")], *sides)
    if above is not None:
        above = above.select(F.col("tree").alias("t"), F.col("chunk").alias("c"), F.col("path").alias("upper"), *carry)
        rows = rows.join(above, (F.col("tree") == F.col("t")) & (F.col("chunk") == F.col("c"))).drop("t", "c")
    # levels above a tree's root have no siblings recorded
    own = F.filter(F.array(*[f"side_{j}" for j in range(LEVELS)]), lambda s: s.isNotNull())
    path = F.concat(own, "upper") if above is not None else own
    return rows.withColumn("path", path).drop("upper", *[f"side_{j}" for j in range(LEVELS)])


def proof_text(path: str = "path") -> Column:
    """All siblings of a path, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(start: Column, path: str = "path") -> Column:
    """The root that a leaf digest and the siblings of its path give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, ``other`` (a second leaf digest to be folded, or null), subroot, root and path."""
    leaves = docs.select(*FIELDS).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("leaf"),
        (F.lit(None) if other is None else other).cast("string").alias("other"))
    rows, sources = _positions(durable(leaves, "digests"))
    count, largest = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    ledgers, subroots = _build(rows.withColumn("digest", F.col("leaf")), largest or 0, "ledger")
    tops, roots = _build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"),
                                         "digest", F.col("digest").alias("subroot")), count, "top")
    root = roots.select("digest").first()
    above = None
    for ledger in reversed(tops):
        above = _paths(ledger, above and above.select("tree", F.col("pos").alias("chunk"), "path"), [])
    # a source's tree hangs below its place in the tree of sources
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("chunk"), "path", "subroot")
    for ledger in reversed(ledgers):
        below = _paths(ledger, above, ["subroot"])
        above = below.select("tree", F.col("pos").alias("chunk"), "path", "subroot")
    return below.select("doc_id", "leaf", "other", "subroot", F.lit(root and root[0]).cast("string").alias("root"), "path")


def oracle(levels: int = 14, top_levels: int = 6) -> str:
    """The manifest query as DuckDB SQL: every level written out, for sources of up to 3 ** ``levels`` rows."""
    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    digest = "sha256(" + " || ".join(part.format(c) for c in FIELDS) + ")"
    torn = digest.replace("text::VARCHAR", "replace(text, chr(10), '')")
    # CRC-32 of the decimal id, eight shifts a character, as a fold over [character, 0, 0, ...]
    bits = "list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}::BIGINT[], lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    ctes = [f"""base AS MATERIALIZED (SELECT doc_id, source, {digest} AS leaf, coalesce({crc} % 2 = 0, false) AS bad, {torn} AS torn FROM documents)""",
            """a0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, leaf AS h, * FROM base)"""]

    def build(name: str, count: int) -> None:
        for j in range(count):
            ctes.append(f"""{name}{j + 1} AS MATERIALIZED (SELECT s, p // 3 AS p, (n + 2) // 3 AS n,
                 CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {name}{j} GROUP BY s, p // 3, n)""")
            ctes.append(f"""{name}side{j} AS MATERIALIZED (SELECT x.s, x.p, x.n, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), '') AS l,
                 coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), '') AS r
                 FROM {name}{j} x LEFT JOIN {name}{j} y ON x.s = y.s AND x.p // 3 = y.p // 3 AND x.p <> y.p WHERE x.n > 1 GROUP BY x.s, x.p, x.n)""")

    build("a", levels)
    ctes.append(f"b0 AS MATERIALIZED (SELECT 0 AS s, s AS p, count(*) OVER () AS n, h FROM a{levels})")
    build("b", top_levels)
    ctes.append("f0 AS MATERIALIZED (SELECT s, p, doc_id, leaf, CASE WHEN bad THEN torn ELSE leaf END AS f, '' AS proof FROM a0)")
    for j in range(levels + top_levels):
        side = f"aside{j}" if j < levels else f"bside{j - levels}"
        on = f"x.s = y.s AND x.p // {ARITY ** j} = y.p" if j < levels else f"x.s // {ARITY ** (j - levels)} = y.p"
        ctes.append(f"""f{j + 1} AS MATERIALIZED (SELECT x.s, x.p, x.doc_id, x.leaf,
             CASE WHEN y.n IS NULL THEN x.f ELSE sha256(y.l || x.f || y.r) END AS f, x.proof || coalesce(y.l || y.r, '') AS proof
             FROM f{j} x LEFT JOIN {side} y ON {on})""")
    return f"""WITH {', '.join(ctes)}
        SELECT x.doc_id, x.leaf, t.h AS subroot, r.h AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = r.h AS verified
        FROM f{levels + top_levels} x JOIN a{levels} t ON t.s = x.s CROSS JOIN b{top_levels} r"""
