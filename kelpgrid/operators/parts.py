"""Assignment of grid cells to balanced parts, halos and zones."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions.ordering import attach_row, long_table, with_row_number, with_running
from kelpgrid.operators.components import connected_components
from kelpgrid.operators.grid import AXES, both_directions, cube_almost_contains, cube_contains_point
from kelpgrid.session import discard, materialize

MORTON_BITS = 21  # three coordinates in the 63 bits of a long
NO_PART = -(1 << 63)  # a missing part
# Links, counted in both directions, that one task holds: a graph of at most LOCAL_LINKS is refined inside one task, more in blocks.
LOCAL_LINKS = 1_000_000
BLOCK_LINKS = 500_000
MERGED_EDGES = 4_000_000  # edges under the cap that merge_adjacent finishes inside one task
SCANNED = 64  # neighbours of a group that are looked through without a heap


def round_robin_parts(hist: DataFrame, k: int) -> DataFrame:
    return hist.withColumn("part", F.pmod(F.col("cell_id") - 1, F.lit(k)))


def morton_code(cx: str = "cx", cy: str = "cy", ct: str = "ct") -> Column:
    """Interleaved bits of three cell coordinates from 0 to 2**21 - 1; others end the job."""
    out = F.lit(0).cast("long")
    for i in range(MORTON_BITS):
        for j, c in enumerate((cx, cy, ct)):
            bit = F.shiftright(F.col(c), i).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, 3 * i + j))
    fits = (F.least(cx, cy, ct) >= 0) & (F.greatest(cx, cy, ct) < 1 << MORTON_BITS)
    return F.when(fits, out).otherwise(F.raise_error(F.lit("cell coordinate outside the Morton code")).cast("long"))


def pack_cells(hist: DataFrame, k: int) -> DataFrame:
    """Parts of nearly equal load whose cells are close: cut the Morton order in k."""
    total = hist.agg(F.sum("n").alias("total"))
    coded = hist.withColumn("z", morton_code())
    run = with_running(coded, [], ["z", "cell_id"], {"before": ("sum", "n")}, exclusive=True)
    part = F.floor(F.lit(k) * F.col("before") / F.col("total"))
    return attach_row(run, total).withColumn("part", part).drop("before", "total", "z")


def part_loads(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("part").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("load"))


def load_bounds(hist: DataFrame, k: int, alpha: float) -> DataFrame:
    """One row: mean load (integer division), upper and lower bound."""
    return (hist.agg(F.sum("n").alias("total")).withColumn("base", F.floor(F.col("total") / k))
            .withColumn("max_load", (F.col("base") * F.lit(1.0 + alpha)).cast("long"))
            .withColumn("min_load", (F.col("base") * F.lit(1.0 - alpha)).cast("long")))


def _labelled(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Both directions of every edge with the parts of its ends."""
    part = assigned.select("cell_id", "part")
    return (both_directions(edges)
            .join(part.select(F.col("cell_id").alias("src"), F.col("part").alias("src_part")), "src")
            .join(part.select(F.col("cell_id").alias("dst"), F.col("part").alias("dst_part")), "dst"))


def graph_totals(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per part: internal weight (both directions); with vertex count, total weight and cost."""
    inner = F.when(F.col("src_part") == F.col("dst_part"), F.col("w")).otherwise(0.0)
    per_part = _labelled(edges, assigned).groupBy(F.col("src_part").alias("part")).agg(
        F.sum(inner).alias("internal"), F.sum("w").alias("touching"))
    per_part = assigned.groupBy("part").agg(F.count(F.lit(1)).alias("cells")).join(per_part, "part", "left").fillna(
        0.0, ["internal", "touching"])
    sums = per_part.agg(F.sum("cells").alias("vertices"), F.sum("touching").alias("total"),
                        (2 * F.sum("internal") - F.sum("touching")).alias("cost"))
    return attach_row(per_part.select("part", "internal"), sums)


def move_gain(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per cell and neighbouring part: weight to that part minus weight to the own part."""
    to = _labelled(edges, assigned).groupBy(F.col("src").alias("cell_id"), F.col("src_part").alias("part"),
                                            F.col("dst_part").alias("target")).agg(F.sum("w").alias("w"))
    own = to.filter("part = target").select("cell_id", F.col("w").alias("own"))
    return (to.filter("part <> target").join(own, "cell_id", "left")
            .select("cell_id", "part", "target", (F.col("w") - F.coalesce("own", F.lit(0.0))).alias("gain")))


def swap_gain(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Change of internal weight if two adjacent cells of different parts trade places."""
    g = move_gain(edges, assigned)
    cut = _labelled(edges, assigned).filter("src < dst and src_part <> dst_part")
    a = g.select(F.col("cell_id").alias("src"), F.col("target").alias("dst_part"), F.col("gain").alias("gain_a"))
    b = g.select(F.col("cell_id").alias("dst"), F.col("target").alias("src_part"), F.col("gain").alias("gain_b"))
    return (cut.join(a, ["src", "dst_part"]).join(b, ["dst", "src_part"])
            .select("src", "dst", (F.col("gain_a") + F.col("gain_b") - 2 * F.col("w")).alias("gain")))


def _nine_digits(x: np.ndarray) -> np.ndarray:
    """``F.round(x, 9)``: halves of the shortest decimal form go up."""
    scaled = np.abs(x) * 1e9
    out = np.where(scaled < 2.0 ** 52, np.copysign(np.rint(scaled) / 1e9, x), x)
    close = (scaled < 2.0 ** 52) & (np.abs(scaled - np.floor(scaled) - 0.5) <= 2 * np.spacing(scaled))
    out[close] = [float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in x[close].tolist()]
    return out


def _best_moves(src: np.ndarray, dst: np.ndarray, w: np.ndarray, part: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Target and gain of every cell from its links; gain 0 if no move gains.  Equal gains go to the smaller part."""
    names, code = np.unique(part, return_inverse=True)
    key = src.astype(np.int64) * len(names) + code[dst]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight, cell, to = np.add.reduceat(w[order], start), key[start] // len(names), key[start] % len(names)
    own = np.zeros(len(part), np.int64)
    stays = to == code[cell]
    own[cell[stays]] = weight[stays]
    known = names != NO_PART
    move = np.flatnonzero(~stays & known[to] & known[code[cell]])
    target, gain = np.full(len(part), NO_PART), np.zeros(len(part))
    if len(move):
        cell, to, more = cell[move], to[move], weight[move] - own[cell[move]]
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        top = np.repeat(np.maximum.reduceat(more, start), np.diff(np.r_[start, len(cell)]))
        best = np.flatnonzero(more == top)
        best = best[np.r_[True, cell[best][1:] != cell[best][:-1]]]
        target[cell[best]], gain[cell[best]] = names[to[best]], _nine_digits(more[best] * unit)
    return target, np.where(gain > 1e-9, gain, 0.0)


def _unbeaten(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Which cells move: a gain, and no better mover at the other end of a link."""
    out = gain > 0
    ours, theirs = gain[src], gain[dst]
    out[src[(theirs > ours) | ((theirs == ours) & (ids[dst] < ids[src]))]] = False
    return out


def _refined_locally(max_load: int, unit: float):
    """All rounds of ``refine_parts`` over the links of a bounded graph: ``(cell_id, part)`` of the cells that moved.

    Rows without ``src`` hold the loads of the parts.
    """
    def run(batches):
        t = pa.Table.from_batches(batches)
        is_load = t["src"].is_null().to_numpy()
        col = lambda c, rows: t[c].filter(pa.array(rows)).to_numpy()
        names, load = col("src_part", is_load), col("src_n", is_load)
        order = np.argsort(names)
        names, load = names[order], load[order]
        ids, first, src = np.unique(col("src", ~is_load), return_index=True, return_inverse=True)
        dst = np.searchsorted(ids, col("dst", ~is_load))
        w, start, n = col("w", ~is_load), col("src_part", ~is_load)[first], col("src_n", ~is_load)[first]
        part = start.copy()
        while True:
            target, gain = _best_moves(src, dst, w, part, unit)
            movers = np.flatnonzero(_unbeaten(ids, src, dst, gain))
            movers = movers[np.lexsort((ids[movers], -gain[movers], target[movers]))]
            to, run = np.searchsorted(names, target[movers]), np.cumsum(n[movers])
            begin = np.searchsorted(to, to)
            ok = load[to] + run - (run - n[movers])[begin] <= max_load
            if not ok.any():
                break
            movers, to = movers[ok], to[ok]
            np.subtract.at(load, np.searchsorted(names, part[movers]), n[movers])
            np.add.at(load, to, n[movers])
            part[movers] = names[to]
        moved = part != start
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(part[moved])], ["cell_id", "part"])

    return run


PACKED = {"ids": np.int64, "start": np.int64, "n": np.int64, "own": np.bool_, "src": np.int32, "dst": np.int32, "w": np.int64}


def _pack(links: pa.Table) -> pa.Table:
    """The links of a block as one row of arrays; cells are numbered by their place in ``ids``."""
    col = lambda c: links[c].to_numpy()
    ids, at = np.unique(np.concatenate([col("src"), col("dst")]), return_inverse=True)
    src, dst = at[:len(links)], at[len(links):]
    cells = {"ids": ids, "start": np.empty(len(ids), np.int64), "n": np.zeros(len(ids), np.int64), "own": np.zeros(len(ids), np.bool_)}
    cells["start"][dst], cells["start"][src], cells["n"][src], cells["own"][src] = col("dst_part"), col("src_part"), col("src_n"), col("own")
    order = np.argsort(src, kind="stable")
    arrays = cells | {"src": src[order], "dst": dst[order], "w": col("w")[order]}
    return pa.table({"block": links["block"][:1], **{c: pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in PACKED.items()}})


def _block_movers(unit: float):
    """Movers among a block's own cells; ``moved`` holds the cells of the block that left the part they began in."""
    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                at = {c: np.frombuffer(t[c][i].as_buffer(), kind) for c, kind in PACKED.items()}
                part, moved = at["start"].copy(), t["moved"][i]
                if moved.is_valid:
                    place = np.searchsorted(at["ids"], moved.values.field("cell_id").to_numpy())
                    part[place] = moved.values.field("part").to_numpy()
                target, gain = _best_moves(at["src"], at["dst"], at["w"], part, unit)
                m = np.flatnonzero(_unbeaten(at["ids"], at["src"], at["dst"], gain) & at["own"])
                yield pa.RecordBatch.from_pydict({"block": pa.repeat(t["block"][i], len(m)), "cell_id": at["ids"][m], "n": at["n"][m], "start": at["start"][m],
                                                  "part": target[m], "gain": gain[m]})

    return run


def _in_blocks(links: DataFrame, state: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of cells that are close, and the cells other blocks look at: ``(cell_id, block)``.

    A block has the links of its own cells and of their neighbours, so with the parts at their ends it knows who moves.
    """
    fits = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit((1 << MORTON_BITS) - 1)).cast("long")
    close = state.withColumns({c: fits(c) for c in ("cx", "cy", "ct")}).withColumn("z", morton_code()) if {"cx", "cy", "ct"} <= set(state.columns) else state.withColumn("z", F.lit(0))
    ranked = materialize(with_row_number(close.filter("cell_id is not null").select("z", "cell_id"), [], ["z", "cell_id"], "rn"))
    total = ranked.agg(F.max("rn").alias("total"))
    home = materialize(attach_row(ranked, total).select("cell_id", F.floor((F.col("rn") - 1) * F.lit(blocks) / F.col("total")).alias("block")))
    both = links.join(long_table(home.select(F.col("cell_id").alias("src"), F.col("block").alias("home"))), "src")
    both = both.join(long_table(home.select(F.col("cell_id").alias("dst"), F.col("block").alias("beside"))), "dst")
    both = materialize(both)
    # A cell's links go to its own block and to those of its neighbours.
    seen = both.select("src", F.col("beside").alias("block")).unionByName(both.select("src", F.col("home").alias("block"))).distinct()
    held = materialize(both.join(long_table(seen), "src").withColumn("own", F.col("home") == F.col("block")))
    packed = held.select("block", "own", "src", "dst", "w", "src_part", "dst_part", "src_n").groupBy("block").applyInArrow(
        _pack, "block long, " + ", ".join(f"{c} binary" for c in PACKED))
    packed = materialize(packed.repartitionByRange(blocks, "block"))
    others = held.select(F.col("dst").alias("cell_id"), F.col("beside").alias("home"), "block").unionByName(held.select(F.col("src").alias("cell_id"), "home", "block"))
    others = materialize(others.filter("home <> block").select("cell_id", "block").distinct())
    for old in (ranked, home, both, held):
        discard(old)
    return packed, others


def refine_parts(edges: DataFrame, assigned: DataFrame, max_load: int, local_links: int = LOCAL_LINKS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Rounds of moves that raise the internal weight and keep every load <= cap, until none is left.

    Per round each cell names its best part; of two adjacent movers only the
    better one moves, so the gains add up; arrivals are accepted by gain until
    the target is full.  Every round raises the internal weight, so the rounds end.

    The edges are joined with the parts once.  Weights are whole multiples of a unit, so sums stay exact.
    At most ``local_links`` links (a checked count) are finished in one task.  More are dealt to blocks, and a
    round is one job: each block names its movers from the parts as they are, a window over each target
    accepts them, and the cells moved so far are written.  Movers have no mover beside them, so they are few.
    """
    state = materialize(assigned)
    known = state.withColumn("part", F.struct(F.coalesce(F.col("part").cast("long"), F.lit(NO_PART)).alias("part"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n")))
    whole = materialize(_labelled(edges, known))
    top = whole.groupBy("src").agg(F.sum(F.abs("w")).alias("w")).agg(F.max("w")).first()[0]
    if not top:
        return state
    bits = 61 - math.ceil(math.log2(top))
    links = whole.select("src", "dst", F.coalesce(F.round(F.col("w") * F.lit(2.0 ** bits)).cast("long"), F.lit(0)).alias("w"),
                         F.col("src_part.part").alias("src_part"), F.col("dst_part.part").alias("dst_part"), F.col("src_part.n").alias("src_n"))
    links = links.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})
    loads = known.groupBy("part.part").agg(F.sum("part.n").alias("n"))
    count = whole.count()
    if count <= local_links:
        none = {c: F.lit(None).cast("long") for c in ("src", "dst", "w", "dst_part")}
        rows = links.unionByName(loads.select(F.col("part").alias("src_part"), F.col("n").alias("src_n")).withColumns(none))
        moved = materialize(rows.coalesce(1).mapInArrow(_refined_locally(max_load, 2.0 ** -bits), "cell_id long, part long"))
    else:
        moved = _refined_in_blocks(*_in_blocks(links, state, math.ceil(count / block_links)), materialize(loads), max_load, 2.0 ** -bits)
    discard(whole)
    to = moved.select("cell_id", F.col("part").cast(state.schema["part"].dataType).alias("__to"))
    return state.join(to, "cell_id", "left").withColumn("part", F.coalesce("__to", "part")).select(*assigned.columns)


def _refined_in_blocks(blocks: DataFrame, others: DataFrame, loads: DataFrame, max_load: int, unit: float) -> DataFrame:
    """The rounds of ``refine_parts`` over blocks: the cells that left the part they began in, with their part."""
    moved = blocks.limit(0).select("block", *[F.lit(0).cast("long").alias(c) for c in ("cell_id", "n", "start", "part")], F.lit(True).alias("new"))
    moved = materialize(moved)
    while True:
        # Each block hears of its own cells and of the others it looks at.
        dealt = moved.select("block", "cell_id", "part").unionByName(moved.select("cell_id", "part").join(others, "cell_id"))
        dealt = dealt.groupBy("block").agg(F.collect_list(F.struct("cell_id", "part")).alias("moved"))
        movers = blocks.join(dealt, "block", "left").mapInArrow(_block_movers(unit), "block long, cell_id long, n long, start long, part long, gain double")
        now = loads.unionByName(moved.select("part", "n")).unionByName(moved.select(F.col("start").alias("part"), (-F.col("n")).alias("n")))
        now = now.groupBy("part").agg(F.sum("n").alias("n"))
        # The load comes before the movers, so the running sum is the load after each of them.
        rows = movers.unionByName(now, allowMissingColumns=True)
        arriving = Window.partitionBy("part").orderBy(F.col("gain").desc_nulls_first(), "cell_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ok = rows.withColumn("load", F.sum("n").over(arriving)).filter((F.col("load") <= F.lit(max_load)) & F.col("cell_id").isNotNull())
        ok = ok.select("block", "cell_id", "n", "start", "part", F.lit(True).alias("new"))
        both = moved.withColumn("new", F.lit(False)).unionByName(ok)
        after = materialize(both.groupBy("cell_id").agg(*[F.max_by(c, "new").alias(c) for c in ("block", "n", "start", "part")], F.max("new").alias("new")))
        if after.filter("new").isEmpty():
            return after
        discard(moved)
        moved = after


def _merge_locally(cap: int):
    """The rounds of ``merge_adjacent`` over a bounded graph: ``(part, into)`` for the groups that are absorbed, ``into`` the last one.

    Rows are edges ``(src, dst, w, sa, sb)`` with src < dst.  A round looks again only at the groups that merged, at those whose
    best neighbour is gone or too large, and at those beside a group whose edge rose: edges never fall and sizes only grow,
    so a best neighbour that still fits is held against the risen ones alone.  Groups with many neighbours keep a heap of them,
    best first, whose outdated entries are dropped when they come up.
    """
    def run(batches):
        t = [b for b in batches if len(b)]
        if not t:
            return
        t = pd.concat(t, ignore_index=True)
        names, at = np.unique(np.concatenate([t["src"].to_numpy(), t["dst"].to_numpy()]), return_inverse=True)
        first, second, w = at[:len(t)], at[len(t):], t["w"].to_numpy(np.float64)
        sizes = np.zeros(len(names), np.int64)
        sizes[first], sizes[second] = t["sa"].to_numpy(), t["sb"].to_numpy()
        size, groups = sizes.tolist(), list(range(len(names)))
        near: list[dict[int, float] | None] = [{} for _ in groups]
        for i in range(0, len(w), 100_000):
            for a, b, x in zip(first[i:i + 100_000].tolist(), second[i:i + 100_000].tolist(), w[i:i + 100_000].tolist()):
                a, b = groups[a], groups[b]  # one object for each number
                near[a][b] = near[b][a] = x
        del t, at, first, second, w
        label, heap, gone = groups.copy(), {}, {}
        target: list[int | None] = [None] * len(groups)
        wanted_by, widest = defaultdict(set), defaultdict(int)

        def best(g):
            mine, room = near[g], cap - size[g]
            if g not in heap:
                fits = [(-round(x, 9), label[o], o) for o, x in mine.items() if size[o] <= room]
                if len(mine) <= SCANNED:
                    return min(fits)[2] if fits else None
                heapq.heapify(fits)
                heap[g] = fits
            h = heap[g]
            while h:
                x, name, o = h[0]
                if o in mine and size[o] <= room and label[o] == name and -round(mine[o], 9) == x:
                    return o
                heapq.heappop(h)
            return None

        def aim(g, to):
            if target[g] is not None:
                wanted_by[target[g]].discard(g)
            target[g] = to
            if to is not None:
                wanted_by[to].add(g)
                widest[to] = max(widest[to], size[g])

        for g in groups:
            aim(g, best(g))
        changed = groups
        while True:
            pairs = {(min(g, to), max(g, to)) for g in changed if (to := target[g]) is not None and target[to] == g}
            if not pairs:
                break
            again, risen = set(), defaultdict(list)
            for a, b in pairs:
                if len(near[a]) < len(near[b]):
                    a, b = b, a
                # a keeps its neighbours and takes those of b; the smaller number names the group.
                renamed = label[b] < label[a]
                gone[max(label[a], label[b])] = min(label[a], label[b])
                label[a] = min(label[a], label[b])
                size[a] += size[b]
                mine, theirs, near[b] = near[a], near[b], None
                heap.pop(b, None)
                for o, x in theirs.items():
                    del near[o][b]
                    if o != a:
                        mine[o] = near[o][a] = x = mine.get(o, 0.0) + x
                        risen[o].append(a)
                        if a in heap:
                            heapq.heappush(heap[a], (-round(x, 9), label[o], o))
                        if o in heap:
                            heapq.heappush(heap[o], (-round(x, 9), label[a], a))
                if renamed:
                    for o in mine:
                        if target[o] != a:
                            risen[o].append(a)
                        if o in heap:
                            heapq.heappush(heap[o], (-round(mine[o], 9), label[a], a))
                aim(a, None)
                aim(b, None)
                left = wanted_by.pop(b, set())
                if size[a] + widest[a] > cap:
                    left |= {o for o in wanted_by[a] if size[a] + size[o] > cap}
                    widest[a] = max((size[o] for o in wanted_by[a] - left), default=0)
                for o in left:
                    wanted_by[a].discard(o)
                    target[o] = None
                again |= left
                again.add(a)
            changed = {g for g in again if near[g] is not None}
            for g in changed:
                aim(g, best(g))
            for g, others in risen.items():
                to = target[g]
                if near[g] is None or g in again or to is None:
                    continue
                key = -round(near[g][to], 9), label[to]
                for o in others:
                    if o != to and size[g] + size[o] <= cap and (other := (-round(near[g][o], 9), label[o])) < key:
                        key, to = other, o
                if to != target[g]:
                    aim(g, to)
                    changed.add(g)
        for g in sorted(gone):  # a group is absorbed by a smaller one
            gone[g] = gone.get(gone[g], gone[g])
        yield pd.DataFrame({"part": names[list(gone)], "into": names[list(gone.values())]}, dtype="int64")

    return run


def merge_adjacent(hist: DataFrame, edges: DataFrame, cap: int, local_edges: int = MERGED_EDGES) -> DataFrame:
    """Contract mutually best neighbouring groups while the joint count stays <= cap.

    The best of all edges is mutual and every round lowers the number of groups, so the rounds end.
    A large group takes one neighbour a round, so there may be as many rounds as cells: the graph is
    contracted with its groups, and once at most ``local_edges`` edges under the cap are left (a
    checked count) one task finishes the rounds.
    """
    size = materialize(hist.groupBy(F.col("cell_id").alias("part")).agg(F.sum("n").cast("long").alias("size")))
    merges = []
    g = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").filter("src <> dst")
    while True:
        # Sizes only grow, so groups over the cap together stay over it, and so does whatever absorbs them: their edge is dropped.
        g = g.groupBy("src", "dst").agg(F.sum("w").alias("w"))
        g = materialize(g.join(size.select(F.col("part").alias("src"), F.col("size").alias("sa")), "src")
                        .join(size.select(F.col("part").alias("dst"), F.col("size").alias("sb")), "dst").filter(F.col("sa") + F.col("sb") <= cap))
        left = g.count()
        if left == 0:
            break
        if left <= local_edges:
            merges.append(materialize(g.coalesce(1).mapInPandas(_merge_locally(cap), "part long, into long")))
            break
        rank = F.struct(F.round("w", 9), -F.col("src"), -F.col("dst"))
        both = g.select("src", "dst", rank.alias("rank")).unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), rank.alias("rank")))
        best = both.groupBy("src").agg(F.max_by("dst", "rank").alias("best"))
        mutual = best.join(long_table(best.select(F.col("src").alias("best"), F.col("best").alias("back"))), "best").filter(
            "back = src and best < src").select(F.col("src").alias("part"), F.col("best").alias("into"))
        merges.append(materialize(mutual))
        if merges[-1].isEmpty():
            break
        size = materialize(_renamed(size, merges[-1], "part").groupBy("part").agg(F.sum("size").alias("size")))
        for end in ("src", "dst"):
            g = _renamed(g, merges[-1], end)
        g = g.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").filter("src <> dst")
    if not merges:
        return hist.withColumn("part", F.col("cell_id"))
    # The group a cell ends in: every absorbed group leads to a smaller one, to the end of the chain.
    links = reduce(DataFrame.unionByName, merges)
    ends = connected_components(links.select(F.col("part").alias("src"), F.col("into").alias("dst")))
    return hist.join(ends.select(F.col("node").alias("cell_id"), F.col("root").alias("part")), "cell_id", "left").withColumn("part", F.coalesce("part", "cell_id"))


def _renamed(df: DataFrame, merged: DataFrame, col: str) -> DataFrame:
    """``df`` with the groups in ``col`` replaced by those that absorbed them."""
    names = merged.select(F.col("part").alias(col), F.col("into").alias("__into"))
    return df.join(long_table(names), col, "left").withColumn(col, F.coalesce("__into", col)).drop("__into")


def seed_grow(hist: DataFrame, edges: DataFrame, cap: int, max_rounds: int = 200) -> DataFrame:
    """Stars of cells: a seed absorbs unvisited neighbours, lightest edge first, until the cap.

    All unvisited cells whose hash is the smallest among their unvisited
    neighbours are seeds of a round; a wanted cell goes to one seed.
    """
    edges = materialize(both_directions(edges))
    done = None
    left = materialize(hist.select("cell_id", "n"))
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        pr = left.select("cell_id", F.struct(F.xxhash64("cell_id"), F.col("cell_id")).alias("pr"))
        near = (edges.join(pr.select(F.col("cell_id").alias("src"), F.col("pr").alias("mine")), "src")
                .join(pr.select(F.col("cell_id").alias("dst"), F.col("pr").alias("theirs")), "dst"))
        beaten = near.filter("theirs < mine").select(F.col("src").alias("cell_id"))
        seeds = left.join(beaten, "cell_id", "left_anti")
        claim = (near.join(seeds.select(F.col("cell_id").alias("src"), F.col("n").alias("seed_n")), "src")
                 .groupBy("dst").agg(F.min_by(F.struct("src", "seed_n", "w"), F.struct("w", "src")).alias("c"))
                 .select(F.col("dst").alias("cell_id"), F.col("c.src").alias("seed"), "c.seed_n", "c.w"))
        claim = materialize(claim.join(left, "cell_id"))
        run = with_running(claim, ["seed"], ["w", "cell_id"], {"prior": ("sum", "n")}, exclusive=True)
        taken = run.filter(F.col("seed_n") + F.col("prior") < cap).select("cell_id", F.col("seed").alias("part"))
        grown = materialize(taken.unionByName(seeds.select("cell_id", F.col("cell_id").alias("part"))))
        done = grown if done is None else materialize(done.unionByName(grown))
        left = materialize(left.join(grown, "cell_id", "left_anti"))
    else:
        raise RuntimeError("cells left without a part")
    return hist.join(done, "cell_id") if done is not None else hist.withColumn("part", F.col("cell_id"))


def split_parts(assigned: DataFrame, max_load: int | DataFrame) -> DataFrame:
    """Cut parts with load >= max into ceil(load/max) chunks of equally many cells."""
    stats = part_loads(assigned)
    bound = attach_row(stats, max_load) if isinstance(max_load, DataFrame) else stats.withColumn("max_load", F.lit(max_load))
    chunks = F.when(F.col("load") >= F.col("max_load"), F.ceil(F.col("load") / F.col("max_load"))).otherwise(F.lit(1).cast("long"))
    bound = bound.withColumn("size", F.ceil(F.col("cells") / chunks)).select("part", "size")
    numbered = with_row_number(assigned, ["part"], ["cell_id"], "rn")
    return numbered.join(bound, "part").withColumn("chunk", F.floor((F.col("rn") - 1) / F.col("size"))).drop("rn", "size")


def merge_parts(loads: DataFrame, min_load: int | DataFrame) -> DataFrame:
    """Collect small parts (load <= min) in order until min is reached; the rest is one part.

    One row per part, of which there are k: a fold over an array of k structs.
    Returns ``(part, load, merged)``: the number of the merged group, null for
    parts that stay as they are.
    """
    df = attach_row(loads, min_load) if isinstance(min_load, DataFrame) else loads.withColumn("min_load", F.lit(min_load))
    small = df.filter("load <= min_load").agg(
        F.sort_array(F.collect_list(F.struct("part", "load", "min_load"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("grp"),
                     F.array().cast("array<struct<part:bigint,merged:bigint>>").alias("out"))

    def step(acc, e):
        total = acc["sum"] + e["load"]
        full = total >= e["min_load"]
        row = F.struct(e["part"].cast("long").alias("part"), acc["grp"].alias("merged"))
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"),
                        F.when(full, acc["grp"] + 1).otherwise(acc["grp"]).alias("grp"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    folded = small.select(F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("o.part", "o.merged")
    return df.drop("min_load").join(folded, "part", "left")


def halo_assign(points: DataFrame, cubes: DataFrame, corner: DataFrame, cell: tuple[float, float, float],
                eps_s: float, eps_t: float) -> DataFrame:
    """One copy of a point for every part owning a cell whose cube, expanded by the radii, holds it.

    ``cubes`` is the assigned histogram with cube bounds.  Candidate cells come
    from the point's coordinates; the join with the cells is an equi join.
    Every non-empty cell is assigned, so each point has at least its own part.
    """
    reach = {"x": eps_s, "y": eps_s, "t": eps_t}
    out = attach_row(points, corner.select(*[F.col(f"{a}0").alias(f"__{a}") for a in AXES]))
    for a, size in zip(AXES, cell):
        low = F.ceil((F.col(a) - reach[a] - F.col(f"__{a}")) / size) - 2
        high = F.floor((F.col(a) + reach[a] - F.col(f"__{a}")) / size) + 1
        out = out.select("*", F.explode(F.sequence(low, high)).alias(f"c{a}"))
        lo = F.col(f"__{a}") + F.col(f"c{a}") * F.lit(size)
        out = out.filter((lo - reach[a] <= F.col(a)) & (F.col(a) <= lo + F.lit(size) + reach[a]))
    hit = out.join(cubes.select("cx", "cy", "ct", "part"), ["cx", "cy", "ct"])
    return hit.select("part", "id", "x", "y", "t").distinct()


def point_zone(points: DataFrame, cubes: DataFrame, corner: DataFrame, cell: tuple[float, float, float],
               eps_s: float, eps_t: float) -> DataFrame:
    """Zone of each copy in its part: inner (inside a cube shrunk by the radii), margin, or halo."""
    reach = {"x": eps_s, "y": eps_s, "t": eps_t}
    out = attach_row(points, corner.select(*[F.col(f"{a}0").alias(f"__{a}") for a in AXES]))
    for a, size in zip(AXES, cell):
        low = F.ceil((F.col(a) - reach[a] - F.col(f"__{a}")) / size) - 2
        high = F.floor((F.col(a) + reach[a] - F.col(f"__{a}")) / size) + 1
        out = out.select("*", F.explode(F.sequence(low, high)).alias(f"c{a}"))
        lo = F.col(f"__{a}") + F.col(f"c{a}") * F.lit(size)
        out = out.filter((lo - reach[a] <= F.col(a)) & (F.col(a) <= lo + F.lit(size) + reach[a]))
    hit = out.join(cubes.select("cx", "cy", "ct", "part", *[f"{a}{e}" for a in AXES for e in "01"]), ["cx", "cy", "ct"])
    inset = hit.withColumns({f"i{a}0": F.col(f"{a}0") + reach[a] for a in AXES}
                            | {f"i{a}1": F.col(f"{a}1") - reach[a] for a in AXES})
    level = (F.when(cube_almost_contains("i"), 2).when(cube_contains_point(), 1).otherwise(0))
    best = inset.groupBy("part", "id").agg(F.max(level).alias("z"))
    return best.select("part", "id", F.when(F.col("z") == 2, "inner").when(F.col("z") == 1, "margin").otherwise("halo").alias("zone"))
