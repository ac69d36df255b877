"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector of integer term weights, a query one of integer term values w; the score
is their inner product.  Only terms of the queries can add to it, so documents are projected on these.

1. *Vectors.*  Texts are cut into terms; the number of all terms and the occurrences of the queries' terms are
   kept.  The counts N, L and df come from all documents, in one aggregation over these rows.
2. *Trees.*  Each task cuts its documents into forests of at most ``CHUNK_ROWS`` documents and builds a ball tree over each:
   a node is split between the two members that lie far apart, until ``LEAF_ROWS`` are left or all are equal.
   A node keeps its sparse centroid, its radii (rounded up) and its smallest doc_id.  Geometry is that of
   w * weight, where a query is the same for all its terms: rare terms then stretch space most.
   A ball over all terms would bound little, since a query has few of them.  The terms are therefore split into
   groups, those of few items by their first item, the others singly, and a node has a radius for each.
3. *Search.*  ``q . centroid`` plus the sum of ``|q| * radius`` over the groups bounds every score below a node; with
   the rounding of doubles added it is safe.  First each query takes the ``TRIES`` best leaves of each tree only.
   The k-th best score of all these is a floor for every tree.  Then each tree is searched best-first: a subtree is
   left out once its bound is below the floor, or equal with no smaller doc_id.  Leaves are scored in 64-bit integers.
4. *Merge.*  k rows a query and tree are ranked in two rounds.

Queries are taken in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` distinct terms; each block is one pass over the
documents.  (An item with more terms than that is a block of its own.)  Only a block goes through the driver.

Null and empty texts have no terms; such documents count for nothing and such items find nothing.  Rows without
a doc_id or an item_id take no part.  Rows that repeat a doc_id are documents of their own; rows that
repeat an item_id are queries of their own.  Equal scores go by doc_id.  Other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import binary_column, dropped, small_batches, table, written

K = 10
BLOCK_ITEMS, BLOCK_TERMS = 2048, 1 << 17
CHUNK_ROWS, CHUNK_TERMS = 2048, 1 << 19
LEAF_ROWS = 32
#: Leaves of each tree that are scored for the floor.
TRIES = 2
#: A term in more items than this is a group of its own.
FEW_ITEMS = 4
#: A child holds at least one in so many of its parent's rows.
SHARE = 16
#: Relative error allowed for sums of doubles; their true error is far below.
SAFE = 1e-9
MIX = 64

# A term is a run of ASCII letters, digits and non-ASCII characters; only A-Z change.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Queries(NamedTuple):
    """A block of queries: their places, ids and term numbers; the terms' numbers and values."""

    items: list[tuple[int, list[int]]]
    terms: dict[bytes, int]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """Items in the order of (item_id, text), as blocks of bounded size."""
    order = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    held: list[tuple[int, list[int]]] = []
    terms: dict[bytes, int] = {}
    for r in order.toLocalIterator():
        own = sorted(set(terms_of((r["text"] or "").encode())))
        new = sum(t not in terms for t in own)
        if held and (len(held) >= BLOCK_ITEMS or len(terms) + new > BLOCK_TERMS):
            yield Queries(held, terms)
            held, terms = [], {}
        if own:
            held.append((r["item_id"], [terms.setdefault(t, len(terms)) for t in own]))
    if held:
        yield Queries(held, terms)


def vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and number and occurrences of each term of the block; written."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            n, at, tf, sizes = [], [], [], [0]
            for text in binary_column(b):
                every = terms_of(text) if text else []
                found = Counter(filter(number.__contains__, every))
                n.append(len(every))
                own = sorted((number[t], c) for t, c in found.items())
                at += [t for t, _ in own]
                tf += [c for _, c in own]
                sizes.append(len(at))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (tf, pa.int64()))]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "at", "tf"])
            yield out.filter(pa.array(np.array(n) > 0))

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return written(some.mapInArrow(run, "doc_id bigint, n bigint, at array<int>, tf array<bigint>"), "lexical-vectors")


def values_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    """w of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def weights_of(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer weight of each occurrence count in documents of n terms; exact also where 64 bits would not do."""
    wide = 90 * int(n.max(initial=0)) * n_docs >= 1 << 62
    m = 10 + np.array([90 * x * n_docs // n_terms for x in n.tolist()], object) if wide else 10 + 90 * n * n_docs // max(n_terms, 1)
    out = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    return out.astype(np.int64)


class Tree(NamedTuple):
    """A ball tree over documents in leaf order, as flat arrays."""

    ids: np.ndarray  # doc_id of each row
    row: np.ndarray  # where each row's terms begin, and the end
    at: np.ndarray  # term numbers
    weight: np.ndarray  # integer weights, below 2**31
    lo: np.ndarray  # first row of each node
    hi: np.ndarray
    left: np.ndarray  # children, -1 for leaves
    right: np.ndarray
    least: np.ndarray  # smallest doc_id below
    r_row: np.ndarray  # where each node's radii begin
    r_group: np.ndarray
    r_value: np.ndarray
    c_row: np.ndarray  # where each centroid's terms begin
    c_at: np.ndarray
    c_value: np.ndarray


def _rows(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the terms of some rows, the place of their row among them)."""
    size = start[rows + 1] - start[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[rows], size), owner


def groups_of(asked: Queries) -> np.ndarray:
    """The group of each term: its first item where few items have it, else one of its own."""
    n = np.bincount([t for _, own in asked.items for t in own], minlength=len(asked.terms))
    out = len(asked.items) + np.arange(len(asked.terms))
    for q, (_, own) in reversed(list(enumerate(asked.items))):
        for t in own:
            if n[t] <= FEW_ITEMS:
                out[t] = q
    return out


def build_tree(ids: np.ndarray, start: np.ndarray, at: np.ndarray, weight: np.ndarray, scale: np.ndarray, group: np.ndarray) -> Tree:
    """A ball tree over sparse rows; geometry is that of weight * scale[term], with a radius for each group of terms."""
    owner = np.repeat(np.arange(len(ids)), np.diff(start))
    by_group = np.lexsort((group[at], owner))
    at, weight = at[by_group], weight[by_group]
    used, local = np.unique(at, return_inverse=True)
    used_group, own_group = np.unique(group[used], return_inverse=True)
    y = weight * scale[at].astype(float)
    square = np.bincount(owner, y * y, len(ids))
    order = np.arange(len(ids))
    nodes: list[list] = []
    centroids: list[tuple[np.ndarray, np.ndarray]] = []
    radii: list[tuple[np.ndarray, np.ndarray]] = []

    def distances(rows: np.ndarray, point: np.ndarray, norm: float) -> np.ndarray:
        k, owner = _rows(start, rows)
        return np.maximum(square[rows] + norm - 2 * np.bincount(owner, y[k] * point[local[k]], len(rows)), 0)

    def node(lo: int, hi: int) -> int:
        rows = order[lo:hi]
        k, owner = _rows(start, rows)
        here = local[k]
        centre = np.bincount(here, y[k], len(used)) / len(rows)
        norms = np.bincount(own_group, centre * centre, len(used_group))
        # of each row and group: how far the row is from the centroid there, less the centroid's own square
        g = own_group[here]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])]))
        part = np.add.reduceat(y[k] * (y[k] - 2 * centre[here]), new)
        size = np.add.reduceat(y[k] * y[k], new)
        g = g[new]
        lacking = np.bincount(g, minlength=len(used_group)) < len(rows)
        most = np.where(lacking, 0.0, -np.inf)
        np.maximum.at(most, g, part)
        large = np.zeros(len(used_group))
        np.maximum.at(large, g, size)
        # the squares cancel in the difference: their rounding is added to it
        radius = np.sqrt((np.maximum(most + norms, 0) + SAFE * (large + norms)) * (1 + SAFE))
        some = np.flatnonzero(radius)
        radii.append((used_group[some], radius[some]))
        some = np.flatnonzero(centre)
        centroids.append((used[some], centre[some]))
        nodes.append([lo, hi, -1, -1, int(ids[rows].min())])
        if hi - lo <= LEAF_ROWS:
            return -1
        return int(distances(rows, centre, float(centre @ centre)).argmax())

    stack = [(len(nodes), node(0, len(ids)))]
    while stack:
        me, first = stack.pop()
        if first < 0:
            continue
        lo, hi = nodes[me][:2]
        rows = order[lo:hi]
        pivot = np.zeros(len(used))
        k, _ = _rows(start, rows[[first]])
        pivot[local[k]] = y[k]
        a = distances(rows, pivot, float(square[rows[first]]))
        if a.max() <= SAFE * square[rows].max(initial=0):
            continue  # all equal
        second = int(a.argmax())
        pivot[:] = 0
        k, _ = _rows(start, rows[[second]])
        pivot[local[k]] = y[k]
        nearer = a - distances(rows, pivot, float(square[rows[second]]))
        # a few lone rows take some others along, so that the tree stays shallow
        few = len(rows) // SHARE + 1
        cut = lo + min(max(int((nearer < 0).sum()), few), len(rows) - few)
        order[lo:hi] = rows[np.argsort(nearer, kind="stable")]
        for side, (x, z) in enumerate(((lo, cut), (cut, hi))):
            nodes[me][2 + side] = len(nodes)
            stack.append((len(nodes), node(x, z)))
    k, _ = _rows(start, order)
    lo, hi, left, right = (np.array([x[i] for x in nodes], np.int32) for i in range(4))
    sparse = [x for rows in (radii, centroids) for x in (np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]), np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]))]
    starts = np.concatenate([[0], np.cumsum((start[1:] - start[:-1])[order])])
    return Tree(ids[order], starts, at[k], weight[k], lo, hi, left, right, np.array([x[4] for x in nodes], np.int64), *sparse)


def leaf_scores(tree: Tree, node: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc_ids, exact integer scores) of a leaf; ``value`` holds w of the query's terms, else 0."""
    lo, hi = int(tree.lo[node]), int(tree.hi[node])
    a, b = int(tree.row[lo]), int(tree.row[hi])
    total = np.concatenate([[0], np.cumsum(value[tree.at[a:b]] * tree.weight[a:b])])
    cut = tree.row[lo : hi + 1] - a
    return tree.ids[lo:hi], total[cut[1:]] - total[cut[:-1]]


def bound(tree: Tree, node: int, asked: np.ndarray, pull: np.ndarray) -> float:
    """No score below ``node`` is larger; ``asked`` is 1 at the query's terms, ``pull`` its length in each group."""
    part = slice(tree.c_row[node], tree.c_row[node + 1])
    inner = float(tree.c_value[part][asked[tree.c_at[part]]].sum())
    part = slice(tree.r_row[node], tree.r_row[node + 1])
    return (inner + float((tree.r_value[part] * pull[tree.r_group[part]]).sum())) * (1 + SAFE) + 1


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best with a score above 0, ties to smaller ids."""
    some = np.flatnonzero(scores > 0)
    some = some[np.lexsort((ids[some], -scores[some]))[:k]]
    return ids[some], scores[some]


def search(tree: Tree, asked: np.ndarray, value: np.ndarray, pull: np.ndarray, k: int, floor: int, tries: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(doc_ids, scores, documents scored) of the best k that may be among the best of all trees.

    ``tries`` ends the search after so many leaves; what is found then is exact, but not all.
    """
    ids, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    heap = [(-bound(tree, 0, asked, pull), 0)]
    while heap and tries:
        most, node = heapq.heappop(heap)
        most = math.floor(-most)  # scores are integers
        if most < max(floor, 1):
            break
        if len(ids) >= k:
            if most < scores[-1]:
                break
            if most == scores[-1] and tree.least[node] > ids[-1]:
                continue
        if tree.left[node] >= 0:
            for x in (int(tree.left[node]), int(tree.right[node])):
                heapq.heappush(heap, (-bound(tree, x, asked, pull), x))
            continue
        new_ids, new = leaf_scores(tree, node, value)
        seen += len(new)
        tries -= 1
        ids, scores = best_of(np.concatenate([ids, new_ids]), np.concatenate([scores, new]), k)
    return ids, scores, seen


_KINDS = {"ids": "<i8", "row": "<i4", "at": "<i4", "weight": "<i4", "lo": "<i4", "hi": "<i4", "left": "<i4", "right": "<i4", "least": "<i8", "r_row": "<i4", "r_group": "<i4", "r_value": "<f8", "c_row": "<i4", "c_at": "<i4", "c_value": "<f8"}


def trees(rows: DataFrame, scale: np.ndarray, group: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """One row a ball tree; written."""
    sent = rows.sparkSession.sparkContext.broadcast((scale, group))

    def build(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts).combine_chunks()
        ids, n = held["doc_id"].to_numpy(), held["n"].to_numpy()
        lists, counts = (held[c].combine_chunks() for c in ("at", "tf"))
        at, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
        start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        weight = weights_of(tf, np.repeat(n, np.diff(start)), n_docs, n_terms)
        tree = build_tree(ids, start, at, weight, *sent.value)
        return pa.RecordBatch.from_arrays([pa.array([getattr(tree, c).astype(kind).tobytes()], pa.binary()) for c, kind in _KINDS.items()], names=list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                held.append(part)
                n += part.num_rows
                size += int(np.diff(part.column("at").offsets.to_numpy()).sum())
                if n >= CHUNK_ROWS or size >= CHUNK_TERMS:
                    yield build(held)
                    held, n, size = [], 0, 0
        if n:
            yield build(held)

    some = rows.where(F.size("at") > 0)
    return written(some.mapInArrow(run, ", ".join(f"{c} binary" for c in _KINDS)), "lexical-trees")


def searched(forest: DataFrame, asked: Queries, values: np.ndarray, group: np.ndarray, k: int, floors: np.ndarray, tries: int) -> DataFrame:
    """query (its place), doc_id, score and scored (documents of the tree whose score was taken)."""
    sent = forest.sparkSession.sparkContext.broadcast((asked.items, values, group, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w, group, least = sent.value
        mask, value, pull = np.zeros(len(w), bool), np.zeros(len(w), np.int64), np.zeros(int(group.max()) + 1)
        for b in batches:
            for i in range(b.num_rows):
                tree = Tree(*(np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in _KINDS.items()))
                out: list[tuple[np.ndarray, np.ndarray, int]] = []
                for (_, own), floor in zip(items, least, strict=True):
                    mask[own], value[own] = True, w[own]
                    # in the geometry of w * weight every term of the query counts 1
                    some, n = np.unique(group[own], return_counts=True)
                    pull[some] = np.sqrt(n) * (1 + SAFE)
                    out.append(search(tree, mask, value, pull, k, int(floor), tries))
                    mask[own], value[own], pull[some] = False, 0, 0
                sizes = [len(x) for x, _, _ in out]
                columns = [np.repeat(np.arange(len(out), dtype=np.int32), sizes), np.concatenate([x for x, _, _ in out]), np.concatenate([x for _, x, _ in out]), np.repeat([x for _, _, x in out], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "doc_id", "score", "scored"])

    return forest.mapInArrow(run, "query int, doc_id bigint, score bigint, scored bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    best = [F.col("score").desc(), F.col("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(MIX))
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("query", salt).orderBy(*best))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k).drop("r")


def search_block(docs: DataFrame, asked: Queries, k: int) -> DataFrame:
    """item_id, rank, doc_id and score for one block of queries."""
    spark = docs.sparkSession
    rows = vectors(docs, asked.terms)
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(asked.terms), np.int64)
    for r in rows.select(F.explode("at").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most BLOCK_TERMS rows
        df[r["t"]] = r["df"]
    values = values_of(df, n_docs)
    group = groups_of(asked)
    forest = trees(rows, values, group, n_docs, n_terms)
    dropped(rows)
    floors = np.zeros(len(asked.items), np.int64)
    for r in ranked(searched(forest, asked, values, group, k, floors, TRIES), k).where(F.col("rank") == k).select("query", "score").collect():  # a row a query of the block
        floors[r["query"]] = r["score"]
    out = ranked(searched(forest, asked, values, group, k, floors, -1), k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked.items)], "query int, item_id long")
    done = written(out.join(names, "query").select("item_id", "rank", "doc_id", "score"), "lexical-ranked")
    dropped(forest)
    return done


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    small_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in query_blocks(items):
        out = out.unionByName(search_block(docs, block, k))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH cut AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), term) AS t FROM documents, cut WHERE doc_id IS NOT NULL),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), upper, lower), term)) AS t FROM benchmark, cut WHERE item_id IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
qt AS (SELECT q, item_id, unnest(t) AS t FROM q),
tf AS (SELECT d, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT d, doc_id, len(t)::BIGINT AS n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, s.n),
c AS (SELECT qt.q, qt.item_id, tf.d, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * s.n) // s.l))))::BIGINT AS score
      FROM qt JOIN tf ON tf.t = qt.t JOIN w ON w.t = qt.t, s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
