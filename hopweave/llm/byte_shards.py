"""Shards of near equal bytes by histogram sort: find the splitters by counting, then exchange once.

The sort key is a 60-bit hash of the text, so equal texts are neighbours and stay together, except that a group of
copies larger than ``group_fraction`` of a shard goes on by doc_id inside and may be cut. With before(k) the bytes of
all smaller keys, a key belongs to shard floor(shards * before(k) / total).

Splitters come from rounds of exact counts: each round sums bytes in cells between probe boundaries (a factor of 1024
finer than the last, only inside the cells that still hold a splitter), until a splitter's cell holds one key or at
most ``tolerance`` of a shard's bytes. A round returns at most 1024 cells for each splitter, whatever the input. The
rows are then exchanged once, in cells of bounded size, and numbered from exact counts of the cells before them.

A null text counts as empty. Slots of a shard follow the key; cells of more than 2 * CELL_ROWS rows are cut by a hash of
the row's plain columns, so that a group of copies is numbered by several tasks (rows equal in all of these stay in one).
A null doc_id sorts first. Columns of the caller go along under any name, but for size, shard and slot, which are
replaced. Where doc_ids span more than 61 bits, a cut inside a group of copies may fall up to
three ids beside its place. An empty table gives an empty one. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from hopweave.llm.columns import as_row, quoted
from hopweave.llm.scratch import Scratch

SHARDS, KEY_BITS, STEP_BITS, OVERHEAD = 24, 60, 10, 8
CELL_ROWS = 50_000
BROADCAST_CELLS = 1 << 20  # cells, of 16 bytes each


def key_of(text: str) -> Column:
    return F.expr(f"cast(conv(substr(md5(coalesce({text}, '')), 1, 15), 16, 10) AS bigint)")


def size_of(text: str) -> Column:
    return F.expr(f"cast(octet_length(coalesce({text}, '')) + {OVERHEAD} AS bigint)")


def _refine(rows: DataFrame, value: str, bits: int, wanted: dict[int, int], tolerance: int) -> dict[int, tuple[int, int, int]]:
    """wanted: splitter -> bytes at or past which it lies. Returns splitter -> (last value before it, bytes up to and
    with that value, bytes of that value's cell). ``value`` is a non-negative long below 2 ** bits."""
    found: dict[int, tuple[int, int, int]] = {}
    width = bits
    open_cells: dict[int, tuple[int, dict[int, int]]] = {0: (0, dict(wanted))} if wanted else {}  # cell -> bytes before it, splitters inside
    while open_cells and width >= 0:
        narrower = max(0, width - STEP_BITS)
        inside = F.expr(f"shiftright({value}, {width})").isin(*open_cells) if width < 63 else F.lit(True)
        counted = rows.where(inside).groupBy(F.expr(f"shiftright({value}, {narrower})").alias("cell")).agg(
            F.sum("size").alias("bytes"), F.min(value).alias("least"), F.max(value).alias("most")
        ).collect()  # at most 2 ** STEP_BITS cells for each open one
        by: dict[int, list] = {}
        for r in counted:
            by.setdefault(r["cell"] >> (width - narrower), []).append(r)
        nxt: dict[int, tuple[int, dict[int, int]]] = {}
        for prefix, (before, splitters) in open_cells.items():
            for r in sorted(by[prefix], key=lambda r: r["cell"]):
                inside_now = {s: t for s, t in splitters.items() if before < t <= before + r["bytes"]}
                for s in inside_now:
                    if r["least"] == r["most"] or r["bytes"] <= tolerance or narrower == 0:
                        found[s] = (r["most"], before + r["bytes"], r["bytes"])
                left = {s: t for s, t in inside_now.items() if s not in found}
                if left:
                    nxt[r["cell"]] = (before, left)
                before += r["bytes"]
        open_cells, width = nxt, narrower
    return found


def assign(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, group_fraction: float = 0.05, tolerance: float = 0.0, text: str = "text") -> DataFrame:
    """docs with size, shard and slot (from 0 in each shard); replaces columns of those names."""
    rest = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    plain = [F.col(quoted(f.name)) for f in docs.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    keyed = as_row(docs, F.col("doc_id"), size_of(quoted(text)).alias("size"), key_of(quoted(text)).alias("_key"), F.xxhash64(*plain).alias("_salt"))
    thin = scratch.keep(keyed.select("doc_id", "size", "_key"))
    total, count, least, most = thin.agg(F.sum("size"), F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    total, least, most = total or 0, least or 0, most or 0
    # Ids as small positive numbers in their order; where they span more than 62 bits, four neighbours share one.
    drop = 0 if most - least < 1 << 61 else 2
    place = f"coalesce(shiftright(doc_id, {drop}) - ({least >> drop}L) + 1L, 0L)"
    least, most = least >> drop, most >> drop
    limit = group_fraction * total / shards
    hot = [r["_key"] for r in thin.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > limit) & (F.col("n") > 1)).select("_key").collect()] if total else []  # at most shards / group_fraction
    allowed = int(tolerance * total / shards)
    # Splitter s: the first key whose bytes before it reach s * total / shards.
    wanted = {s: -(-s * total // shards) for s in range(1, shards)} if total else {}
    found = _refine(thin, "_key", KEY_BITS, wanted, allowed)
    borders: dict[int, tuple[int, int | None]] = {s: (key, None) for s, (key, _, _) in found.items()}
    bits = max(1, int(most - least + 1).bit_length())
    for key in sorted({k for k, _, _ in found.values()} & set(hot)):
        inner = {s: wanted[s] - (upto - size) for s, (k, upto, size) in found.items() if k == key}
        group = thin.where(F.col("_key") == key).select("size", F.expr(place).alias("_inner"))
        for s, (value, _, _) in _refine(group, "_inner", bits + 1, inner, allowed).items():
            borders[s] = (key, value)
    hot_sql = f"_key IN ({', '.join(map(str, hot))})" if hot else "false"
    past = [f"int(_key > {k} OR (_key = {k} AND _inner > {v}))" if v is not None else f"int(_key > {k})" for k, v in borders.values()]
    pieces = max(1, count // CELL_ROWS)
    cell = F.expr(f"shiftright(_key, {max(0, KEY_BITS - (pieces - 1).bit_length())})")
    split = keyed.withColumn("_inner", F.expr(f"CASE WHEN {hot_sql} THEN {place} ELSE 0L END")).withColumn("_cell", cell)
    split = split.withColumn("shard", F.expr(" + ".join(past) or "0"))
    # Cells with many rows, for copies or by chance, are cut further by a hash of the whole row; at most one for each CELL_ROWS rows.
    full = scratch.keep(thin.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CELL_ROWS).select("_cell", F.expr(f"n div {CELL_ROWS} + 1").alias("_steps")))
    full = F.broadcast(full) if count // CELL_ROWS <= BROADCAST_CELLS else full
    split = split.join(full, "_cell", "left").withColumn("_step", F.expr("coalesce(pmod(_salt, _steps), 0L)"))
    return _numbered(split, rest, scratch)


def _numbered(split: DataFrame, rest: list[str], scratch: Scratch) -> DataFrame:
    """Order in a shard: cell and step, inside them key and doc_id."""
    where = ["shard", "_cell", "_step"]
    counts = scratch.keep(split.groupBy(*where).agg(F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy("shard").orderBy("_cell", "_step").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*where, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    numbered = split.withColumn("_row", F.row_number().over(Window.partitionBy(*where).orderBy("_key", "_inner", "doc_id")))
    slot = (F.col("_base") + F.col("_row") - 1).alias("slot")
    return numbered.join(bases, where).select(*[F.col("row")[c].alias(c) for c in rest], "size", "shard", slot)
