"""Exact k nearest neighbours between two sets of vectors.

Both sides are dealt into blocks of nearby rows: the leaves of a k-d tree over a bounded sample, a crowded
leaf cut by a hash.  A task takes bounded many blocks of candidates and, one after the other, blocks of
queries; the pairs of tasks come from a cartesian product in which every block travels to a task once and which
shuffles nothing.  In a task, the boxes of the blocks leave out what lies beyond a row's k-th distance, a matrix product
with a bound on its rounding error picks the pairs that can matter, and only these get an exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.session import stage, unstage

SAMPLE_ROWS = 4_096
BLOCK_ROWS = 2_048
FILE_BLOCKS = 64
# Candidates of one task, which holds them in memory.
TASK_BYTES = 64 << 20
DISTANCE_DIGITS = 6
_SLACK = 10.0**-DISTANCE_DIGITS
_CHUNK_NUMBERS = 4_000_000
_CHUNK_ROWS = 512
# Numbers up to this size can be squared and added up in single precision.
_PLAIN = 1e15
_ROW = "block int, id bigint, single boolean, data binary"
_BLOCK = "block int, dims int, single boolean, vecs binary, ids binary, copies binary"
_FOUND = "l_block int, at int, left_id bigint, found array<struct<distance:double,right_id:bigint>>"


def _tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``dim, cut, kids, share`` of a k-d tree with about so many leaves; a leaf has dim -1 and its number as kid."""
    dims, cuts, kids, share = [], [], [], []
    todo = [(points, leaves, -1, 0)]
    while todo:
        rows, quota, parent, side = todo.pop()
        node = len(dims)
        if parent >= 0:
            kids[parent][side] = node
        spread = np.ptp(rows, axis=0) if quota > 1 and len(rows) > 1 else np.zeros(1)
        if not spread.max(initial=0.0) > 0:
            dims.append(-1)
            cuts.append(0.0)
            kids.append([len(share)] * 2)
            share.append(len(rows) / max(1, len(points)))
            continue
        dim = int(spread.argmax())
        values = np.sort(rows[:, dim])
        cut = values[(len(values) - 1) // 2]
        cut = cut if cut < values[-1] else values[values < cut][-1]
        below = rows[:, dim] <= cut
        mine = min(quota - 1, max(1, round(quota * below.mean())))
        dims.append(dim)
        cuts.append(cut)
        kids.append([0, 0])
        todo += [(rows[~below], quota - mine, node, 1), (rows[below], mine, node, 0)]
    return np.array(dims), np.array(cuts), np.array(kids), np.array(share)


def _leaves(rows: np.ndarray, tree: tuple) -> np.ndarray:
    dims, cuts, kids, _ = tree
    node = np.zeros(len(rows), np.int64)
    while (inner := np.flatnonzero(dims[node] >= 0)).size:
        at = node[inner]
        node[inner] = kids[at, (rows[inner, dims[at]] > cuts[at]).astype(int)]
    return kids[node, 0]


def _alike(rows: np.ndarray) -> np.ndarray:
    """The same number for equal rows, another for each of the others."""
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    return np.unique(keys, return_inverse=True)[1].ravel()


def _hashes(rows: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(rows).view(np.uint64)
    odd = np.random.default_rng(1).integers(1, 1 << 63, bits.shape[1], dtype=np.uint64) | np.uint64(1)
    mixed = (bits ^ (bits >> np.uint64(29))) * odd
    return (mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64) >> np.uint64(16)


def _first_copies(ids: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The rows of each group's smallest ids, ordered by group and id."""
    order = np.lexsort((ids, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < most]


def _matrix(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a row without a vector has no distances")
    # Adding 0 makes -0 the same as 0.
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float) + 0.0


def _joined(data: pa.Array, single: np.ndarray) -> np.ndarray:
    """The rows of packed vectors, some of them in single precision."""
    data = np.array(data.to_pylist(), dtype=object)
    parts = [(flags, np.frombuffer(b"".join(data[flags]), kind).reshape(flags.sum(), -1)) for flags, kind in ((single, "<f4"), (~single, "<f8")) if flags.any()]
    rows = np.empty((len(data), parts[0][1].shape[1]), parts[-1][1].dtype)
    for flags, some in parts:
        rows[flags] = some
    return rows


def _in_blocks(df: DataFrame, need: int | None, leaves: int | None, block_rows: int, name: str) -> DataFrame:
    """Stored blocks of nearby rows, of about ``block_rows`` rows; of the copies of a vector the ``need`` smallest ids.

    A bounded sample in hash order is the only data that comes to the driver as vectors.  With ``need`` a crowded leaf is
    cut by vector, so that copies meet; without it all rows stay and it is cut by id, so that copies do not fill a block.
    """
    size = df.count()
    chosen = df.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").collect()
    points = np.array([r.vec for r in chosen if r.vec is not None], dtype=float)
    points = points[np.isfinite(points).all(axis=1)] if len(points) else np.zeros((0, 1))
    tree = _tree(points, leaves or max(1, min(len(points) // 4, math.ceil(size / block_rows))))
    parts = np.maximum(1, np.ceil(tree[3] * size / block_rows)).astype(np.int64)
    first = np.cumsum(parts) - parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if need is not None:
                kept = _first_copies(ids, _alike(rows), need)
                ids, rows = ids[kept], rows[kept]
            key = _hashes(rows if need is not None else ids.reshape(-1, 1))
            leaf = _leaves(rows, tree)
            block = first[leaf] + (key % parts[leaf].astype(np.uint64)).astype(np.int64)
            with np.errstate(over="ignore"):
                short = rows.astype("<f4")
            single = bool((short == rows).all())
            data = [r.tobytes() for r in (short if single else rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int32()), pa.array(ids), pa.array([single] * len(ids)), pa.array(data, pa.binary())], ["block", "id", "single", "data"]
            )

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        rows = _joined(table.column("data"), table.column("single").to_numpy())
        copies = np.ones(len(ids), "<i4")
        if need is not None:
            group = _alike(rows)
            kept = _first_copies(ids, group, need)
            copies = np.bincount(group[kept]).astype("<i4")
            ids, rows = ids[kept], rows[kept][np.cumsum(copies) - copies]
        row = [table.column("block")[0].as_py(), rows.shape[1], rows.itemsize == 4, rows.tobytes(), ids.astype("<i8").tobytes(), copies.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    dealt = df.select("id", "vec").mapInArrow(deal, _ROW)
    if need is None:
        # The files of the queries become the tasks of the search: not fewer than there is work for.
        wanted = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(parts.sum() / FILE_BLOCKS))
        dealt = dealt.repartition(min(wanted, int(parts.sum())), "block")
    return stage(dealt.groupBy("block").applyInArrow(pack, _BLOCK), name)


class _Block:
    """Candidates of one block: the rows, their box, and the rows about their mean in single precision beside their squared lengths."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        self.rows, self.ids, self.copies = rows, ids, copies
        self.starts = np.cumsum(copies) - copies
        self.plain = bool((np.abs(rows) <= _PLAIN).all())
        width = rows.shape[1]
        self.low, self.high = (rows.min(axis=0).astype(float), rows.max(axis=0).astype(float)) if self.plain else (np.full(width, -np.inf), np.full(width, np.inf))
        self.centre = rows.mean(axis=0, dtype=float) if self.plain else np.zeros(width)
        self.form = self.made(np.float32) if self.plain else None

    def apart(self, rows: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the box."""
        gaps = np.maximum(0.0, np.maximum(self.low - rows, rows - self.high))
        return np.einsum("ij,ij->i", gaps, gaps)

    def made(self, kind: type) -> np.ndarray:
        gaps = self.rows - self.centre
        squares = np.einsum("ij,ij->i", gaps, gaps)
        self.reach = math.sqrt(squares.max())
        # Filled up to a multiple of eight with rows that are infinitely far.
        form = np.zeros((-len(gaps) % 8 + len(gaps), gaps.shape[1] + 1), kind)
        form[: len(gaps)] = np.column_stack([gaps, squares])
        form[len(gaps) :, -1] = np.inf
        return form


def _pairs(rows: np.ndarray, block: _Block, bound: np.ndarray, need: int, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row, candidate)`` whose squared distance may lie within the row's bound, or among its ``need`` smallest.

    For a query x and a candidate y about the block's mean, ``y.y - 2 x.y`` is the squared distance less ``x.x``.
    """
    gaps = rows - block.centre
    own = np.einsum("ij,ij->i", gaps, gaps)
    size, width = len(block.rows), rows.shape[1]
    if not (own <= _PLAIN**2).all():
        return tuple(x.ravel() for x in np.indices((len(rows), size)))
    for kind in (np.float32, np.float64):
        # What rounding can do to the sums of products, the numbers themselves and the squares, with a half to spare.
        error = 1.5 * (width + 8) * np.finfo(kind).eps * (block.reach**2 + 2 * np.sqrt(own) * block.reach)
        form = block.form if kind is np.float32 else block.made(kind)
        sums = scratch[: len(gaps) * len(form)].reshape(len(gaps), -1) if kind is np.float32 else None
        sums = np.matmul(np.column_stack([-2 * gaps, np.ones(len(gaps))]).astype(kind), form.T, out=sums)
        limit = bound - own
        unknown = np.flatnonzero(np.isinf(limit))
        if unknown.size and size > need:
            last = np.partition(sums[unknown], need - 1, axis=1)[:, need - 1] + error[unknown] + own[unknown]
            limit[unknown] = _bound(np.sqrt(np.maximum(0.0, last))) - own[unknown]
        with np.errstate(over="ignore"):
            last = np.nextafter((limit + error).astype(kind), kind(np.inf))
        # Eight candidates at a time: few of them have a hit.
        inside = (sums <= last[:, None]).reshape(-1, 8)
        eights = np.flatnonzero(inside.view(np.uint64))
        one, spot = np.nonzero(inside[eights])
        hits = eights[one] * 8 + spot
        if hits.size <= 4 * need * len(rows):
            break
    i, j = hits // len(form), hits % len(form)
    return (i, j) if len(form) == size else (i[j < size], j[j < size])


def _bound(distance: np.ndarray) -> np.ndarray:
    """Squared distances that could round to a given one lie below it."""
    return (distance + _SLACK) ** 2 * (1 + 1e-9)


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded Euclidean distances of pairs of rows."""
    out, step = np.empty(len(i)), max(1, _CHUNK_NUMBERS // a.shape[1])
    for at in range(0, len(i), step):
        gaps = a[i[at : at + step]] - b[j[at : at + step]].astype(float)
        out[at : at + step] = np.round(np.sqrt(np.einsum("ij,ij->i", gaps, gaps)), DISTANCE_DIGITS)
    return out


def _nearest(rows: np.ndarray, blocks: list[_Block], need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, block and place in it of the ``need`` nearest candidates of every row; block -1 where there are fewer.

    Ties go to the smaller id; unknown distances come last.
    """
    n = len(rows)
    best = np.full((n, need), np.inf)
    names, where, place = (np.full((n, need), v, np.int64) for v in (0, -1, 0))
    bound = np.full(n, np.inf)
    scratch = np.empty(n * max(len(b.form) if b.plain else 0 for b in blocks), np.float32)
    plain = bool((np.abs(rows) <= _PLAIN).all())
    low, high = (np.array([getattr(b, c) for b in blocks]) for c in ("low", "high"))
    apart = np.maximum(0.0, np.maximum(low - rows.max(axis=0), rows.min(axis=0) - high)) if plain else np.zeros(low.shape)
    apart = np.einsum("ij,ij->i", apart, apart)
    centres = np.array([b.centre for b in blocks]) - rows.mean(axis=0)
    for at in np.lexsort((np.einsum("ij,ij->i", centres, centres), apart)):
        if apart[at] > bound.max():
            break
        block = blocks[at]
        near = np.arange(n)
        if plain and block.plain:
            # Where none of some rows lies too far, the others are not looked at one by one.
            if not (block.apart(rows[::16]) <= bound[::16]).all():
                near = np.flatnonzero(block.apart(rows) <= bound)
            if not near.size:
                continue
            i, j = _pairs(rows[near], block, bound[near], need, scratch)
        else:
            i, j = (x.ravel() for x in np.indices((n, len(block.rows))))
        if not len(i):
            continue
        i = near[i]
        hit = np.unique(i)
        kept_at, kept = np.nonzero(where[hit] >= 0)
        old = hit[kept_at], kept
        row = np.r_[i, old[0]]
        far = np.r_[_distances(rows, block.rows, i, j), best[old]]
        name = np.r_[block.ids[block.starts[j]], names[old]]
        source, spot = np.r_[np.full(len(j), at), where[old]], np.r_[j, place[old]]
        order = np.lexsort((name, far, row))
        row = row[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        order, row, rank = (x[rank < need] for x in (order, row, rank))
        for table, values in ((best, far), (names, name), (where, source), (place, spot)):
            table[row, rank] = values[order]
        full = hit[where[hit, -1] >= 0]
        bound[full] = np.nan_to_num(_bound(best[full, -1]), nan=np.inf)
    return best, where, place


def _search(need: int):
    """For each block of queries, the ``need`` first entries by distance and id among the candidates of the task.

    The first rows hold a block of candidates each and the first block of queries, the others a block of queries each.
    """

    def solved(number: int, rows: np.ndarray, ids: np.ndarray, blocks: list[_Block]) -> pa.RecordBatch:
        group = _alike(rows)
        order = np.argsort(group, kind="stable")
        rows = rows[order[np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])]]
        wild = ~(np.abs(rows) <= _PLAIN).all(axis=1)
        best, where, place = np.empty((len(rows), need)), *(np.empty((len(rows), need), np.int64) for _ in range(2))
        for some in (np.flatnonzero(~wild), np.flatnonzero(wild)):
            for at in range(0, len(some), _CHUNK_ROWS):
                part = some[at : at + _CHUNK_ROWS]
                best[part], where[part], place[part] = _nearest(rows[part].astype(float), blocks, need)
        # A candidate stands for its copies: all their entries, cut to the first of them.
        row, column = np.nonzero(where >= 0)
        offset = np.cumsum([0, *(len(b.rows) for b in blocks)])
        starts = np.concatenate([b.starts + k for b, k in zip(blocks, np.cumsum([0, *(len(b.ids) for b in blocks)]))])
        copies, names = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("copies", "ids"))
        one = offset[where[row, column]] + place[row, column]
        times = copies[one]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, far, name = np.repeat(row, times), np.repeat(best[row, column], times), names[np.repeat(starts[one], times) + within]
        kept = np.lexsort((name, far, row))
        row, far, name = row[kept], far[kept], name[kept]
        sizes = np.bincount(row, minlength=len(rows))
        taken = np.minimum(sizes, need)
        # The entries of each query: those of its distinct vector.
        begins = (np.cumsum(sizes) - sizes)[group]
        counts = taken[group]
        ends = np.cumsum(counts)
        pick = np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1])
        entries = pa.StructArray.from_arrays([pa.array(far[pick]), pa.array(name[pick])], ["distance", "right_id"])
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), entries)
        columns = [pa.array([number] * len(ids), pa.int32()), pa.array(range(len(ids)), pa.int32()), pa.array(ids), found]
        return pa.RecordBatch.from_arrays(columns, ["l_block", "at", "left_id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, waiting = [], None
        for batch in batches:
            for number, dims, l_single, l_vecs, l_ids, r_single, r_vecs, r_ids, copies in zip(*(batch.column(c) for c in range(batch.num_columns))):
                width = dims.as_py()
                if r_vecs.is_valid:
                    vecs = np.frombuffer(r_vecs.as_py(), "<f4" if r_single.as_py() else "<f8").reshape(-1, width)
                    blocks.append(_Block(vecs, np.frombuffer(r_ids.as_py(), "<i8"), np.frombuffer(copies.as_py(), "<i4")))
                if l_vecs.is_valid:
                    # All candidates came with the first queries.
                    if waiting:
                        yield solved(*waiting, blocks)
                    vecs = np.frombuffer(l_vecs.as_py(), "<f4" if l_single.as_py() else "<f8").reshape(-1, width)
                    waiting = number.as_py(), vecs, np.frombuffer(l_ids.as_py(), "<i8")
        if waiting:
            yield solved(*waiting, blocks)

    return run


def join_knn(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    id_col: str = "id",
    vec_col: str = "vec",
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of ``right`` for every row of ``left``.

    Returns ``left_id, right_id, distance, rank``.  Distances are rounded to six
    decimals and ties go to the smaller id.  With ``exclude_self`` a row is not its own
    neighbour.  ``pivots`` sets the number of leaves a side is cut into.

    Copies of a vector are searched once: each distinct vector stands for its copies with
    the few smallest of their ids, which is all that can appear in a result.  The result is stored.
    """
    named = [
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
        for df in (left, right)
    ]
    need = k + (1 if exclude_self else 0)
    queries = _in_blocks(named[0], None, pivots, block_rows, "left")
    candidates = _in_blocks(named[1], need, pivots, block_rows, "right")
    tasks = max(1, math.ceil((candidates.agg(F.sum(F.length("vecs"))).first()[0] or 0) / TASK_BYTES))

    # A row's number within its partition stands in the low bits.
    first = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) == 0
    x = queries.select(F.col("block").alias("number"), F.col("single").alias("l_single"), F.col("vecs").alias("l_vecs"), F.col("ids").alias("l_ids"), first.alias("l_first"))
    y = candidates.coalesce(tasks).select("dims", F.col("single").alias("r_single"), F.col("vecs").alias("r_vecs"), F.col("ids").alias("r_ids"), "copies", first.alias("r_first"))
    met = x.join(y.hint("shuffle_replicate_nl"), F.col("l_first") | F.col("r_first"))
    once = met.select(
        "number", "dims", "l_single", *[F.when(F.col("r_first"), F.col(c)).alias(c) for c in ("l_vecs", "l_ids")],
        "r_single", *[F.when(F.col("l_first"), F.col(c)).alias(c) for c in ("r_vecs", "r_ids", "copies")],
    )
    answers = once.mapInArrow(_search(need), _FOUND)
    if tasks > 1:
        # At most `need` entries per task that holds candidates, cut to the first need of them.
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, need)
        answers = answers.groupBy("l_block", "at", "left_id").agg(merged.alias("found"))
    kept = F.filter("found", lambda e: e["right_id"] != F.col("left_id")) if exclude_self else F.col("found")
    listed = answers.select("left_id", F.posexplode(F.slice(kept, 1, k)).alias("_at", "_e"))
    result = stage(listed.select("left_id", "_e.right_id", "_e.distance", (F.col("_at") + 1).alias("rank")), "nearest")
    unstage(queries, candidates)
    return result
