"""Nearest neighbours by inner product: balanced posting lists, a graph of their centres, pruning by distance ratio."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: The lists are fitted on a sample of so many vectors and bytes at most; every vector is indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 32 << 20
#: Lists are as many as the root of the number of vectors, this many at most, with so many vectors of the sample each at least.
MOST_LISTS, LEAST_SAMPLED = 4096, 8
#: A vector is also put into the lists whose centres are at most this much farther than the nearest one, so many lists in all.
BOUNDARY, REPLICAS = 1.1, 2
#: Links of a centre in the graph, and centres where a walk can start.
LINKS, ENTRIES = 16, 32
#: A walk goes on over centres so much farther than those that are asked for.
SLACK = 1.06
#: The ratio that prunes is the least one that keeps this share of the neighbours of so many vectors of the sample.
KEPT, TRIED = 0.96, 256
#: So many lists of a query's hits are merged at once.
MERGED = 64
#: Vectors and queries that meet in one task at a time, and queries of one product of matrices.
SHELF, QUERIES, CHUNK = 4096, 2048, 256


class Index(NamedTuple):
    """Centres in the order of the tree that balanced them, their graph, and the ratio of pruning."""

    centres: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    ratio: float
    scale: float


# in tasks and, for the sample, in the driver


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def lifted(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Vectors on the unit sphere of one dimension more, so that the nearest one is that of the largest inner product."""
    x = vectors / scale
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))]).astype(np.float32)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Queries as points of the same sphere. Their length doesn't matter for the order."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] + (centres * centres).sum(1) - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def balanced_centres(points: np.ndarray, lists: int) -> np.ndarray:
    """Centres of lists of equal sizes, by cutting in two along the line between two means, again and again."""
    rng = np.random.default_rng(1)
    todo, centres = [(np.arange(len(points)), lists)], []
    while todo:
        own, n = todo.pop()
        part = points[own]
        if n == 1:
            centres.append(part.mean(0))
            continue
        cut = len(own) * (n // 2) // n
        one, other = part[rng.choice(len(own), 2, replace=False)]
        for _ in range(5):
            order = np.argsort(part @ (other - one), kind="stable")
            one, other = part[order[:cut]].mean(0), part[order[cut:]].mean(0)
        todo += [(own[order[cut:]], n - n // 2), (own[order[:cut]], n // 2)]
    return np.array(centres, np.float32)


def linked(centres: np.ndarray) -> np.ndarray:
    """For each centre the nearest ones, some of those that it is a nearest one of, and its neighbours in the tree's order, which hold the graph together."""
    n = len(centres)
    near = min(LINKS, n - 1)
    links = np.repeat(np.arange(n)[:, None], 2 * near + 2, 1)
    for start in range(0, n if near else 0, 1024):
        away = distances(centres[start : start + 1024], centres)
        away[np.arange(len(away)), np.arange(start, start + len(away))] = np.inf
        links[start : start + 1024, :near] = np.argpartition(away, near - 1, 1)[:, :near]
    order = np.argsort(links[:, :near], axis=None, kind="stable")
    to, place = links[:, :near].ravel()[order], np.arange(n * near)
    place -= np.searchsorted(to, to)
    links[to[place < near], near + place[place < near]] = order[place < near] // max(near, 1)
    links[:, -2], links[:, -1] = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    return links


def walked(points: np.ndarray, index: Index, ratio: float) -> np.ndarray:
    """Distances of points to the centres that a walk over the graph reaches, infinite to others.

    Each walk goes downhill from the best entry; from there and from the near entries it spreads over all centres within the ratio.
    """
    centres, links = index.centres, index.links
    rows = np.arange(len(points))
    start = distances(points, centres[index.entries])
    here, best = index.entries[start.argmin(1)], start.min(1)
    moving = rows
    while len(moving):
        around = links[here[moving]]
        away = np.sqrt(((centres[around] - points[moving, None]) ** 2).sum(2))
        nearest = away.argmin(1)
        away = away[np.arange(len(moving)), nearest]
        better = away < best[moving]
        moving, step = moving[better], around[np.arange(len(moving)), nearest][better]
        here[moving], best[moving] = step, away[better]
    reached = np.full((len(points), len(centres)), np.inf, np.float32)
    reached[:, index.entries] = start
    reached[rows, here] = best
    spread = SLACK * ratio
    at, node = np.nonzero(reached <= spread * best[:, None])
    while len(at):
        at, node = np.repeat(at, links.shape[1]), links[node].ravel()
        new = np.unique((at * len(centres) + node)[np.isinf(reached[at, node])])
        at, node = np.divmod(new, len(centres))
        away = np.empty(len(at), np.float32)
        for k in range(0, len(at), 65_536):
            part = slice(k, k + 65_536)
            away[part] = np.sqrt(((centres[node[part]] - points[at[part]]) ** 2).sum(1))
        reached[at, node] = away
        np.minimum.at(best, at, away)
        near = away <= spread * best[at]
        at, node = at[near], node[near]
    return reached


def homes(points: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each point, the nearest one first, and which of them count."""
    away = walked(points, index, 1.0)
    order = np.argsort(away, 1, kind="stable")[:, :REPLICAS]
    own = np.take_along_axis(away, order, 1)
    return order, own <= BOUNDARY * own[:, :1]


def chosen(points: np.ndarray, index: Index, sizes: np.ndarray, least: int) -> np.ndarray:
    """The lists that each query visits: those within the ratio, and the nearest ones until they hold so many vectors."""
    away = walked(points, index, index.ratio)
    lost = np.where(np.isinf(away), 0, sizes).sum(1) < min(least, sizes.sum())
    if lost.any():
        away[lost] = distances(points[lost], index.centres)
    order = np.argsort(away, 1, kind="stable")
    held = np.cumsum(sizes[order], 1) - sizes[order]
    needed = np.zeros(away.shape, bool)
    np.put_along_axis(needed, order, held < least, 1)
    return (needed | (away <= index.ratio * away.min(1, keepdims=True))) & ~np.isinf(away)


def fitted(sample: np.ndarray, lists: int, scale: float, top: int) -> Index:
    """The index of a sample, with the ratio that keeps enough of its own neighbours."""
    points = lifted(sample, scale)
    centres = balanced_centres(points, lists)
    entries = np.unique(np.linspace(0, lists - 1, min(lists, ENTRIES)).astype(int))
    index = Index(centres, linked(centres), entries, 1.0, scale)
    held = np.zeros((len(points), lists), bool)
    for k in range(0, len(points), 1024):
        own, count = homes(points[k : k + 1024], index)
        np.put_along_axis(held[k : k + 1024], own, count, 1)
    asked = np.random.default_rng(2).permutation(len(points))[:TRIED]
    away = distances(directions(sample[asked]), centres)
    away /= np.maximum(away.min(1, keepdims=True), 1e-6)
    alike = sample[asked] @ sample.T
    alike[np.arange(len(asked)), asked] = -np.inf
    most = min(top, len(points) - 1)
    nearest = np.argpartition(-alike, most - 1, 1)[:, :most] if most else np.empty((len(asked), 0), int)
    needed = np.where(held[nearest], away[:, None, :], np.inf).min(2) if nearest.size else np.ones(1)
    return index._replace(ratio=float(max(1.0, np.quantile(needed, KEPT, method="higher"))))


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components, so that equal vectors score equally everywhere."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total += queries[:, k] * vectors[:, k]
    return total


def best_of_shelf(visits: pa.Table, postings: pa.Table, dim: int, top: int) -> pa.Table:
    """The best vectors of some lists for some queries, each query on the lists that it visits."""
    queries = matrix(visits["vec"].combine_chunks(), dim)
    _, first, same = np.unique(np.asarray(postings["id"]), return_index=True, return_inverse=True)
    held = matrix(postings["vec"].combine_chunks(), dim)
    vectors, lists = held[first], np.asarray(postings["list"])
    wanted = visits["lists"].combine_chunks()
    asked = np.asarray(wanted.flatten())
    asking = np.repeat(np.arange(len(queries)), np.diff(np.asarray(wanted.offsets)))
    floor = np.full(len(queries), -np.inf)
    size = np.sqrt((vectors * vectors).sum(1).max(initial=0) * (queries * queries).sum(1))
    rows, hits, scores = [], [], []
    for one in np.unique(lists):
        members = same[lists == one]
        all_rows = asking[asked == one]
        for k in range(0, len(all_rows), CHUNK):
            part = all_rows[k : k + CHUNK]
            alike = queries[part] @ vectors[members].T
            if len(members) > top:
                floor[part] = np.maximum(floor[part], np.partition(alike, len(members) - top, 1)[:, len(members) - top])
            at, hit = np.nonzero(alike >= (floor[part] - 1e-9 * size[part])[:, None])
            rows.append(part[at])
            hits.append(members[hit])
            scores.append(alike[at, hit])
    at, hit, score = (np.concatenate([*x, np.empty(0, t)]) for x, t in ((rows, int), (hits, int), (scores, float)))
    good = score >= floor[at] - 1e-9 * size[at]
    at, hit = np.divmod(np.unique(at[good] * len(vectors) + hit[good]), len(vectors))
    score = np.concatenate([exact_scores(queries[at[k : k + 65_536]], vectors[hit[k : k + 65_536]]) for k in range(0, len(at), 65_536)] or [np.empty(0)])
    order = np.lexsort((hit, -score, at))
    at, hit, score = at[order], hit[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    at, hit, score = at[place < top], hit[place < top], score[place < top]
    found = postings.take(pa.array(first[hit]))
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, int)
    asked_by = visits.take(pa.array(at[new]))
    hits = pa.StructArray.from_arrays([pa.array(-score), *(found[c].combine_chunks() for c in ("id", "ids"))], names=["minus", "id", "ids"])
    ends = pa.array(np.r_[new, len(at)].astype(np.int32))
    return pa.table({"k1": asked_by["k1"], "k2": asked_by["k2"], "unit": asked_by["unit"], "hits": pa.ListArray.from_arrays(ends, hits)})


# on Spark


def usable(vec: Column) -> Column:
    """Whether a vector has components, all of them finite, not all of them zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def with_row_ids(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """Rows with rid, which orders as vec_id does (null last) and doesn't repeat, and whether that is another number than vec_id."""
    if vectors.groupBy("vec_id").count().filter("count > 1 OR vec_id IS NULL").isEmpty():
        return vectors.withColumn("rid", F.col("vec_id").cast("long")), False
    return written(vectors.orderBy(F.asc_nulls_last("vec_id"), "vec").withColumn("rid", F.monotonically_increasing_id())), True


def shelved(sizes: np.ndarray) -> np.ndarray:
    """The shelf of each list: neighbours in the tree's order, up to SHELF vectors. A longer list has a shelf of its own."""
    shelves, shelf, filled = [], 0, 0
    for n in sizes.tolist():
        if filled and filled + n > SHELF:
            shelf, filled = shelf + 1, 0
        shelves.append(shelf)
        filled += n
    return np.asarray(shelves, np.int32)


def search_nearest(embeddings: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """The top vectors of the largest inner product for each row whose vec_id is divisible by every.

    embeddings has vec_id and embedding (an array of numbers). The result has query_id, rank (from
    1), vec_id and score, the inner product in double precision; ties go to the smaller vec_id.
    Candidates are all rows but the query's own, so a query finds its copies, and min(top, rows - 1)
    rows in any case. Vectors that are null, empty or zero, hold a null, a NaN or an infinity, or
    have another length than most (the longer one at a tie) take no part. Rows that share a vec_id
    are rows of their own, as queries, too; a null vec_id is found, last among ties, but doesn't
    query. Other columns are ignored, an empty table gives no rows.

    Inner products become distances on a sphere of one dimension more. Centres of lists come from a
    sample that is cut in two again and again at equal sizes. Every vector goes to its nearest list
    and, near a boundary, to a second one; a query visits the lists of which the centre is not farther
    than the nearest one by more than a ratio, which is fitted on the sample's own neighbours; both
    find lists by walks over a graph of the centres. The search isn't exact: it finds about the share
    KEPT of the neighbours.

    Equal vectors are one entry with its smallest ids, which suffice, so copies, however many, cost
    nothing. Lists that lie next to each other share a shelf; shelves and their queries are cut into
    blocks of bounded size that meet in pairs, so neither a long list nor a popular one is one task.
    """
    spark = embeddings.sparkSession
    plain = embeddings.select("vec_id", F.col("embedding").alias("vec")).filter(usable(F.col("vec")))
    size = F.size("vec")
    largest = F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))
    lengths = plain.groupBy(size.alias("size")).agg(F.count("*").alias("n"), largest.alias("most"))
    shape = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if shape is None:
        return plain.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim = shape.size
    own_ids, other_ids = with_row_ids(plain.filter(size == dim))
    rows = own_ids.withColumns({
        "k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec"), "asks": F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    })
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + (x.cast("double") / F.lit(shape.most)) ** 2)
    ordered = Window.partitionBy("k1", "k2").orderBy("rid")
    few = rows.withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= top + 1)
    distinct = written(few.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("rid")).alias("ids")))
    total, longest = distinct.agg(F.count("*"), F.max(square)).first()
    scale = shape.most * longest**0.5
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, 0.9 * most / total) if total > most else 1.0
    sampled = distinct.filter(F.pmod("k1", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("k1", "k2").limit(most).select("vec").toArrow()
    sample = matrix(sampled["vec"].combine_chunks(), dim)
    lists = max(1, min(round(total**0.5), MOST_LISTS, len(sample) // LEAST_SAMPLED))
    index = spark.sparkContext.broadcast(fitted(sample, lists, scale, top))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                own, count = homes(lifted(matrix(part["vec"], dim), scale), index.value)
                at, copy = np.nonzero(count)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at, copy].astype(np.int32)), pa.array(copy == 0), *(taken[c] for c in ("k1", "vec", "ids"))],
                    names=["list", "home", "k1", "vec", "ids"],
                )

    kind = rows.schema["vec"].dataType.simpleString()
    postings = written(distinct.mapInArrow(stored, f"list int, home boolean, k1 long, vec {kind}, ids array<bigint>"))
    counted = np.zeros((lists, 2), np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("own")).collect():
        counted[r.list] = r.n, r.own
    shelf_of = shelved(counted[:, 0])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                at, one = np.nonzero(chosen(directions(matrix(part["vec"], dim)), index.value, counted[:, 1], top + 1))
                shelf = shelf_of[one]
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (shelf[1:] != shelf[:-1])]) if len(at) else np.empty(0, int)
                taken = part.take(pa.array(at[new]))
                runs = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array(one.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shelf[new]), runs, *(taken[c] for c in ("k1", "k2", "vec"))], names=["shelf", "lists", "k1", "k2", "vec"]
                )

    asking = rows.filter("asks").groupBy("k1", "k2").agg(F.first("vec").alias("vec"))
    visits = written(asking.mapInArrow(visiting, f"shelf int, lists array<int>, k1 long, k2 long, vec {kind}"))
    asked = {r.shelf: r["count"] for r in visits.groupBy("shelf").count().collect()}
    held = np.bincount(shelf_of, counted[:, 0])
    # one row for each shelf, of which there are no more than lists
    blocks = np.maximum(1, -(-held // SHELF)).astype(int)
    units = np.cumsum(blocks) - blocks
    parts = [(s, int(blocks[s]), -(-n // QUERIES), int(units[s])) for s, n in asked.items()]
    cut = F.broadcast(spark.createDataFrame(parts, "shelf int, blocks int, asking int, unit long"))
    shelves = F.broadcast(spark.createDataFrame([(k, int(s)) for k, s in enumerate(shelf_of.tolist())], "list int, shelf int"))
    left = visits.join(cut, "shelf").select(
        "shelf", F.pmod("k1", F.col("asking")).cast("int").alias("q"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"), "unit", "lists", "k1", "k2", "vec"
    ).withColumn("unit", F.col("unit") + F.col("b"))
    right = postings.join(shelves, "list").join(cut, "shelf").select(
        "shelf", F.explode(F.expr("sequence(0, asking - 1)")).alias("q"), F.pmod("k1", F.col("blocks")).cast("int").alias("b"), "list",
        F.col("ids")[0].alias("id"), "vec", "ids"
    )

    def met(visiting: pa.Table, stored: pa.Table) -> pa.Table:
        return best_of_shelf(visiting, stored, dim, top + 1)

    keys = ("shelf", "q", "b")
    hit = "struct<minus: double, id: bigint, ids: array<bigint>>"
    answers = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, f"k1 long, k2 long, unit long, hits array<{hit}>")
    width = int(blocks.sum()) + 1
    while width > 1:
        first = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, REPLICAS * (top + 1))  # a vector is in so many lists at most
        answers = answers.groupBy("k1", "k2", F.expr(f"unit div {MERGED}").alias("unit")).agg(F.slice(F.array_distinct(first), 1, top + 1).alias("hits"))
        width = -(-width // MERGED)
    scored = F.flatten(F.transform("hits", lambda v: F.transform(v["ids"], lambda i: F.struct(v["minus"].alias("minus"), i.alias("rid")))))
    answers = answers.select("k1", "k2", F.slice(F.array_sort(scored), 1, top + 1).alias("best"))
    own = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("rid").alias("own"), "k1", "k2")
    others = own.join(answers, ["k1", "k2"]).select(
        "query_id", F.posexplode(F.slice(F.filter("best", lambda v: v["rid"] != F.col("own")), 1, top)).alias("place", "hit")
    )
    ranked = others.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.rid").alias("rid"), (0.0 - F.col("hit.minus")).alias("score")
    )
    if other_ids:
        return ranked.join(rows.select("rid", "vec_id"), "rid").select("query_id", "rank", "vec_id", "score")
    return ranked.select("query_id", "rank", F.col("rid").alias("vec_id"), "score")
