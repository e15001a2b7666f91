"""Hard negatives by exact maximum inner products over lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster and a block of rows, every row x gets one bound for all
members: |x| cos(max(0, angle(x, centre) - widest)), widest being the largest angle of a member. A member a
meets nobody beyond a place of the list sorted by that bound with more than |a| times the bound there, so
each member walks the list until its k-th best is certain. Blocks are walked apart and their first k merged.

Scores are integers and exact: a block whose products stay below 2^53 is multiplied as doubles, any other
with Python's integers. Bounds are doubles, raised by a margin beyond their rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Every so many ids an anchor; every so many ids a row whose label is the next one.
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Positives of an anchor, negatives of a pair, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors a cluster takes on average; a larger cluster is dealt to several lists.
CLUSTER = 256
#: Anchors the centres are fitted on at most (a sample), rounds of fitting, and centres at most. They decide speed alone.
FIT_ROWS, FIT_ROUNDS, CENTRES = 20_000, 8, 512
#: Rows of a block.
BLOCK = 8192
#: Rows of a list met in one step of its walk.
STEP = 256
#: Scale of a component.
SCALE = 256.0


# ---------------------------------------------------------------- rows


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, their components scaled and floored."""
    for batch in batches:
        lists = batch.column(3)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        value = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64))
        row = np.repeat(np.arange(len(lists)), size)
        keep = batch.column(2).is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
        keep[row[~np.isfinite(value)]] = False  # a null component has become NaN
        value = value[keep[row]]
        offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
        out = batch.filter(pa.array(keep))
        vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))
        yield pa.record_batch([*out.columns[:3], vectors], ["uid", "vec_id", "label", "v"])


def participants(rows: DataFrame) -> DataFrame:
    """(uid, vec_id, label, v) of the rows of ``rows`` (vec_id, embedding, label) that take part, in a written table."""
    own = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.mapInArrow(_whole, "uid long, vec_id long, label long, v array<double>")
    moved = F.pmod(F.col("label") + 1, F.lit(LABELS))
    return written(own.withColumn("label", F.when(F.col("vec_id") % RELABEL_EVERY == 0, moved).otherwise(F.col("label"))), "vectors")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled with zeros."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.hstack([a, np.zeros((len(a), width - a.shape[1]))])


# ---------------------------------------------------------------- clusters


def _directions(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, unit vectors); a zero vector's direction is zero. Scaled first, so that no square overflows."""
    top = np.abs(a).max(axis=1, initial=0)
    safe = np.where(top > 0, top, 1)
    b = a / safe[:, None]
    size = np.sqrt((b * b).sum(axis=1))
    return size * top, b / np.where(size > 0, size, 1)[:, None]


def centres(anchors: DataFrame, count: int) -> np.ndarray:
    """Unit centres of the anchors' directions, from at most ``FIT_ROWS`` of them; no result depends on them."""
    share = FIT_ROWS / max(count, 1)
    picked = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1).limit(FIT_ROWS)
    table = picked.select("v").toArrow()
    _, unit = _directions(matrix(table.column("v")))
    unit = unit[np.abs(unit).sum(axis=1) > 0]
    k = max(1, min(CENTRES, -(-count // CLUSTER), len(unit)))
    if not len(unit):
        return np.zeros((1, unit.shape[1]))
    found = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(FIT_ROUNDS):
        own = (unit @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, own, unit)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        found = np.where(size > 0, total / np.where(size > 0, size, 1), found)
    return found


def clustered(anchors: DataFrame) -> tuple[DataFrame, int, int]:
    """(``anchors`` with their list, the number of lists, the number of anchors).

    A list serves one cluster, or a hashed share of a cluster of over twice ``CLUSTER``."""
    count = anchors.count()
    if not count:
        return anchors.withColumn("list", F.lit(0).cast("long")), 0, 0
    found = centres(anchors, count)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, unit = _directions(matrix(pa.chunked_array([batch.column(batch.schema.get_field_index("v"))])))
            width = max(unit.shape[1], found.shape[1])
            own = (_widened(unit, width) @ _widened(found, width).T).argmax(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int64))], [*batch.schema.names, "cluster"])

    near = written(anchors.mapInArrow(nearest, "uid long, vec_id long, label long, v array<double>, cluster long"), "anchors")
    first, shares = 0, []
    for row in near.groupBy("cluster").count().orderBy("cluster").collect():  # a row a centre
        n = -(-row["count"] // (2 * CLUSTER))
        shares.append((row["cluster"], first, n))
        first += n
    dealt = near.sparkSession.createDataFrame(shares, "cluster long, first long, shares long")
    lists = near.join(F.broadcast(dealt), "cluster").withColumn("list", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("shares")))
    return lists.select("uid", "vec_id", "label", "v", "list"), first, count


# ---------------------------------------------------------------- walking a list


class SharedList:
    """Rows of a block in the order of their bound for one cluster."""

    def __init__(self, members: np.ndarray, rows: np.ndarray):
        width = max(members.shape[1], rows.shape[1])
        self.members, rows = _widened(members, width), _widened(rows, width)
        self.size, unit = _directions(self.members)
        length, direction = _directions(rows)
        centre = unit.sum(axis=0)
        reach = math.sqrt(float(centre @ centre))
        centre = centre / reach if reach > 0 else centre
        angle = np.arccos(np.clip(unit @ centre, -1, 1))
        widest = math.pi if reach == 0 else float(angle[self.size > 0].max(initial=0))
        bound = length * np.cos(np.maximum(0, np.arccos(np.clip(direction @ centre, -1, 1)) - widest))
        bound += 1e-6 * length  # beyond what angles and products are rounded by
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.rows = rows[self.order]
        top = float(self.size.max(initial=0)) * float(length.max(initial=0))
        self.exact = top < 2.0**52 and max(np.abs(self.members).max(initial=0), np.abs(rows).max(initial=0)) < 2.0**52

    def scores(self, who: np.ndarray, a: int, b: int) -> np.ndarray:
        if self.exact:
            return (self.members[who] @ self.rows[a:b].T).astype(np.int64)
        mine = [[int(x) for x in row] for row in self.members[who].tolist()]
        theirs = [[int(x) for x in row] for row in self.rows[a:b].tolist()]
        return np.array([[sum(x * y for x, y in zip(m, t, strict=True)) for t in theirs] for m in mine], object).reshape(len(mine), len(theirs))

    def walk(self, wanted: int, fits, least: list[int | None], ties: np.ndarray, owner: np.ndarray | None = None):
        """For each seeker the first ``wanted`` rows by score and then by ``ties`` (an order of the block's rows).

        ``owner``: the member each seeker is (one member may seek several things). ``fits(seekers, rows,
        scores)`` says which count; ``least``: what a seeker's score has to reach at least (None: anything).
        A seeker stops when no further row can enter its list, or reach ``least``. Returns a list of
        [(score, row)] a seeker.
        """
        owner = np.arange(len(self.members)) if owner is None else owner
        best: list[list[tuple[int, int, int]]] = [[] for _ in owner]
        open_ = np.arange(len(owner))
        for a in range(0, len(self.rows), STEP):
            if not len(open_):
                break
            b = min(a + STEP, len(self.rows))
            mine, where = np.unique(owner[open_], return_inverse=True)
            score = self.scores(mine, a, b)[where]
            row = self.order[a:b]
            good = fits(open_, row, score)
            for k in np.flatnonzero(good.any(axis=1)).tolist():
                seeker, cols = open_[k], np.flatnonzero(good[k])
                held = best[seeker] + [(-int(s), int(ties[r]), int(r)) for s, r in zip(score[k, cols], row[cols], strict=True)]
                best[seeker] = sorted(held)[:wanted]
            if b == len(self.rows):
                break
            limit = self.size[owner[open_]] * self.bound[b]
            floor = np.array([max(-best[s][-1][0] if len(best[s]) == wanted else -math.inf, -math.inf if least[s] is None else least[s] - 1) for s in open_], float)
            open_ = open_[limit >= floor - 1e-6 * np.abs(floor)]
        return [[(-s, r) for s, _, r in found] for found in best]


# ---------------------------------------------------------------- lists against blocks


def _met(anchors: DataFrame, lists: int, rows: DataFrame, kernel, schema: str, blocks: int) -> DataFrame:
    """``kernel`` over every list and every block: the stated anchors against all rows."""
    each = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = rows.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))))
    return each.groupBy("list", "block").cogroup(dealt.groupBy("list", "block")).applyInArrow(kernel, schema)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _ties(ids: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Places in the order of ids, unknown ones (NaN) last, then of uids."""
    order = np.lexsort((uids, ids))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def _ids(table: pa.Table) -> tuple[np.ndarray, list[int | None]]:
    """(an order of the ids with nulls last, the ids)."""
    ids = table.column("vec_id").to_pylist()
    known = sorted({i for i in ids if i is not None})
    place = {i: k for k, i in enumerate(known)}
    return np.array([len(known) if i is None else place[i] for i in ids], np.int64), ids


def _long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


FOUND = "anchor long, anchor_id long, positive long, positive_id long, positive_score decimal(38,0), row long, row_id long, score decimal(38,0)"
_FOUND = pa.schema([(c, pa.decimal128(38, 0) if c.endswith("score") else pa.int64()) for c in ("anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "row_id", "score")])


def _table(rows: list[tuple]) -> pa.Table:
    from decimal import Decimal

    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FOUND)
    cells = [pa.array([None if x is None else Decimal(x) for x in c] if pa.types.is_decimal(f.type) else c, f.type) for c, f in zip(columns, _FOUND, strict=True)]
    return pa.table(cells, schema=_FOUND)


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    if not anchors.num_rows or not rows.num_rows:
        return _FOUND.empty_table()
    label, uid = _array(rows, "label"), _array(rows, "uid")
    own_label, own = _array(anchors, "label"), _array(anchors, "uid")
    order, ids = _ids(rows)
    shared = SharedList(matrix(anchors.column("v")), matrix(rows.column("v")))
    fits = lambda who, at, _: (own_label[who][:, None] == label[at]) & (own[who][:, None] != uid[at])
    best = shared.walk(POSITIVES, fits, [None] * len(own), _ties(order, uid))
    names = anchors.column("vec_id").to_pylist()
    return _table([(int(own[k]), names[k], None, None, None, int(uid[r]), ids[r], s) for k, found in enumerate(best) for s, r in found])


def _negatives(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    if not pairs.num_rows or not rows.num_rows:
        return _FOUND.empty_table()
    label, uid = _array(rows, "label"), _array(rows, "uid")
    order, ids = _ids(rows)
    names, partners = pairs.column("vec_id").to_pylist(), pairs.column("positive_id").to_pylist()
    own, positive = _array(pairs, "uid"), _array(pairs, "positive")
    scores = [int(s) for s in pairs.column("positive_score").to_pylist()]
    _, first, owner = np.unique(own, return_index=True, return_inverse=True)
    shared = SharedList(matrix(pairs.column("v").take(pa.array(first))), matrix(rows.column("v")))
    own_label = _array(pairs, "label")
    kind = np.int64 if shared.exact and all(abs(s) < 2**55 for s in scores) else object
    hundred = np.array([s for s in scores], kind)

    def fits(who: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        score = 100 * score.astype(kind)
        mine = hundred[who][:, None]
        return ((own_label[who][:, None] != label[at]) & (LOW * mine <= score) & (score <= HIGH * mine)).astype(bool)

    least = [-(-LOW * s // 100) for s in scores]
    best = shared.walk(NEGATIVES, fits, least, _ties(order, uid), owner)
    return _table([(int(own[k]), names[k], int(positive[k]), partners[k], scores[k], int(uid[r]), ids[r], s) for k, found in enumerate(best) for s, r in found])


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("row_id"), F.asc("row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= count)


NAMES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, embedding, label).

    Null labels, null vectors and vectors with a null or non-finite component take no part. Rows with a null
    id are no anchors and come last among equal scores. Rows with equal ids are rows of their own: each
    is an anchor with lists of its own, and a positive of its copies. Vectors of different lengths count as
    filled with zeros. Scores beyond a long are compared exactly up to 38 digits and returned as the nearest long.
    An empty table, or one without anchors, gives no rows. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    own = participants(rows)
    anchors, lists, count = clustered(own.where(F.col("vec_id") % ANCHOR_EVERY == 0))
    if not count:
        return spark.createDataFrame([], NAMES)
    anchors = written(anchors, "lists")
    blocks = max(1, -(-own.count() // BLOCK))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("long"))
    positives = _first(_met(anchors, lists, dealt, _positives, FOUND, blocks), ["anchor"], POSITIVES)
    positives = positives.select(F.col("anchor").alias("uid"), F.col("row").alias("positive"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = written(anchors.join(positives.where("positive_score >= 0"), "uid"), "positives")
    found = _first(_met(pairs, lists, dealt, _negatives, FOUND, blocks), ["anchor", "positive"], NEGATIVES)
    long = lambda c: F.least(F.greatest(F.col(c), F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias(c)
    found = found.withColumnRenamed("row_id", "negative_id").withColumnRenamed("score", "negative_score")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", long("positive_score"), long("negative_score"))


#: Fixed SQL of the contract.
SQL = """
with e as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, b.vec_id as row_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
    from e as a join e as b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
    select anchor_id, row_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5),
n as (
    select p.anchor_id, positive_id, row_id as negative_id, positive_score, score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by score desc, row_id) as rank
    from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
