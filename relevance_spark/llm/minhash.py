"""Near-duplicate documents by bottom-k sketches of their shingle sets.

1. Each text becomes its set of hashed word shingles; equal sets are one class, whose smallest doc_id stands for it.
2. The k smallest hashes of a set, from one hash function, are its sketch. Retained values key inverted lists, the
   rarest first: with sketches that share at least o of their values, the rarest ``values - o + 1`` of each hold a
   common one, so the other, frequent values need no list. For sets whose union fits the sketch o is exact; else it is
   what k values of the union share but for a chance of MISS. Lists with the same members are looked at once.
3. Within a list the similarity of sketches of the union is estimated; links of a spanning forest of what passes a
   limit five standard deviations lower make candidate groups.
4. Full sets meet once per candidate group, and exact Jaccard similarity decides every link there.

Lists and groups are never capped. A large one is looked at in blocks; then its components' representatives meet, and
what is still apart from the largest component meets all others, so a group of copies costs one pass over its members.

Rows with a null doc_id, and texts without words, are linked with nothing: a null id keeps a null component and is
kept; an empty text is its own component. Rows that repeat a doc_id are the same document.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays
from relevance_spark.llm.arrays import U
from relevance_spark.llm.components import components
from relevance_spark.llm.shared import Workspace, maybe_broadcast, text_or_empty, word_count

#: Retained values, and the chance that so few of them are shared that a link is not looked at.
KEEP, MISS = 64, 1e-7
#: Members of a list that meet in one place, about, and shingles of candidate texts that do (twice as many where two
#: blocks meet): some 10 and some 50 MB of a worker's memory.
LIST_BLOCK, TEXT_BLOCK = 8_192, 1_000_000


def estimate_limit(percent: int) -> float:
    """Five standard deviations of KEEP values below the threshold."""
    t = percent / 100
    return max(0.0, t - 5 * math.sqrt(t * (1 - t) / KEEP))


@cache
def surely_shared(percent: int) -> int:
    """The largest number that KEEP values of a union share, at the threshold, but for a chance of MISS."""
    t, below = percent / 100, 0.0
    for o in range(KEEP + 1):
        below += math.comb(KEEP, o) * t**o * (1 - t) ** (KEEP - o)
        if below > MISS:
            return max(1, o)
    return KEEP


def least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    """How many retained values a set of each size shares with any similar one: all that are common where sketches are whole."""
    common = -(-size * percent // 100)
    return np.maximum(1, np.where(100 * size <= KEEP * percent, common, np.minimum(common, surely_shared(percent))))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a text with fewer words is one shingle, without words none."""
    h, at = arrays.hash_words(texts, fold=True)
    windows = arrays.window_hashes(h, width)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        else:
            out.append(arrays.window_hashes(h[a:b], b - a) if b > a else np.empty(0, U))
    return out


def _sketcher(width: int):
    import xxhash

    def run(batches):
        for batch in arrays.pieces(batches):
            sets = shingle_sets(arrays.encode_texts(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([(s[:KEEP] >> U(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "sketch"])

    return run


def _postings(percent: int):
    """A row per retained value, with the number of values that are surely shared."""

    def run(batches):
        for batch in batches:
            found = [np.unique(np.frombuffer(x, np.uint32)) for x in batch.column("sketch").to_pylist()]
            n = [len(x) for x in found]
            need = least_shared(batch.column("n_shingles").to_numpy(), percent).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int32)), pa.array(np.repeat(batch.column("rep").to_numpy(), n), pa.int64()), pa.array(np.repeat(need, n))], ["value", "rep", "need"])

    return run


def _rare_postings(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rep): of each sketch the rarest values, one more than may be missing in a similar one.

    Values that one class alone holds come first in that order and are in no list.
    """
    postings = classes.select("rep", "n_shingles", "sketch").mapInArrow(_postings(percent), "value int, rep long, need int")
    often = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = postings.join(often, "value").groupBy("rep", "need").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    return held.select("rep", F.explode(F.slice("held", F.lit(1), F.greatest(F.lit(0), F.size("held") - F.col("need") + 1))).alias("p")).select("p.value", "rep")


def estimated(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of a sketch with each row of others (padded with the largest value) from the union's sketch."""
    both = np.concatenate([np.broadcast_to(one, others.shape), others], axis=1)
    both.sort(axis=1)
    last = np.iinfo(both.dtype).max
    twin = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != last)
    fresh = np.concatenate([np.ones((len(both), 1), bool), ~twin], axis=1) & (both != last)
    rank = np.cumsum(fresh, axis=1)
    size = np.minimum(rank[:, -1], KEEP)
    shared = (twin & (rank[:, 1:] <= KEEP)).sum(axis=1)
    return shared / np.maximum(size, 1)


def _grouped(batches, columns, of_group):
    """Calls of_group(table slice) for each run of equal ``unit`` in sorted batches; a run may span batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        unit = table.column("unit").to_numpy()
        start, size = arrays.runs(unit)
        for a, n in zip(start[:-1], size[:-1], strict=True):
            yield of_group(table.slice(a, n))
        rest = table.slice(start[-1])
    if rest is not None and rest.num_rows:
        yield of_group(rest)


def _edge_batch(pairs) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def forest(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a spanning forest: near(i, rest) tells which of rest are linked with i.

    Every member asks about those that no group has yet; a group that has taken all leaves nothing to ask.
    """
    left = np.arange(n)
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            new = left[hit]
            left = left[~hit]
            queue.extend(new)
            a.append(np.full(len(new), i))
            b.append(new)
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest as edges from the smallest id of each tree: lists that share members then give equal edges."""
    root = np.arange(len(ids))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[y] = root[x]
    low = ids.copy()
    np.minimum.at(low, root, ids)
    centre = low[root]
    out = centre != ids
    return centre[out], ids[out]


def _candidates(percent: int):
    limit = estimate_limit(percent)

    def of_group(table: pa.Table):
        ids = table.column("rep").to_numpy()
        n = len(ids)
        m = np.full((n, KEEP), np.iinfo(np.uint32).max, np.uint32)
        for i, s in enumerate(table.column("sketch").to_pylist()):
            v = np.frombuffer(s, np.uint32)
            m[i, : len(v)] = v
        sizes = table.column("n_shingles").to_numpy()

        def near(i, rest):
            fit = 100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])
            out = np.zeros(len(rest), bool)
            if fit.any():
                out[fit] = estimated(m[i], m[rest[fit]]) >= limit
            return out

        a, b = forest(n, near)
        return stars(ids, a, b)

    def run(batches):
        pairs, n = [], 0
        for p in _grouped(batches, None, of_group):
            pairs.append(p)
            n += len(p[0])
            if n > 10_000:
                yield _edge_batch(pairs)
                pairs, n = [], 0
        yield _edge_batch(pairs)

    return run


def exact_links(sets: list[np.ndarray], percent: int):
    """Spanning forest of the sets with 100 * intersection >= percent * union, by posting lists of the shingles."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, posting = values[order], owner[order]
    start, length = arrays.runs(values)
    keys = values[start]

    def near(i, rest):
        at = np.searchsorted(keys, sets[i])
        common = np.bincount(posting[arrays.ragged(start[at], length[at])], minlength=n)[rest]
        return 100 * common >= percent * (sizes[rest] + sizes[i] - common)

    return forest(n, near)


def _verifier(width: int, percent: int):
    def of_group(table: pa.Table):
        ids = table.column("rep").to_numpy()
        sets = shingle_sets(arrays.encode_texts(table.column("text")), width)
        a, b = exact_links(sets, percent)
        return stars(ids, a, b)

    def run(batches):
        for p in _grouped(batches, None, of_group):
            yield _edge_batch([p])

    return run


def links_within(members: DataFrame, meet, ws: Workspace, name: str) -> DataFrame:
    """Edges (a, b) that hold together what is linked within each group of members (g, rep, blocks).

    meet(units) looks at rows (unit, rep) of one unit together. A group that needs several blocks meets in these; then
    one member of each of its components; last, what is not in its largest component and all others, block by block.
    Members of one component need not meet, so nothing is lost.
    """
    block = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n)
    units = members.select(F.when(F.col("blocks") == 1, F.xxhash64("g")).otherwise(F.xxhash64("g", block(F.col("blocks"), 7))).alias("unit"), "rep")
    edges = ws.save(fewer_links(meet(units)), f"{name}_blocks")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return edges

    def labelled(edges: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
        """Members of large groups with their component c; and of groups that have several how many, and the largest."""
        found = components(edges, ws, f"{name}_{step}")
        rows = ws.save(large.join(found, large.rep == found.node, "left").select("g", "blocks", "rep", F.coalesce("component", "rep").alias("c")), f"{name}_{step}_rows")
        sizes = rows.groupBy("g", "blocks", "c").agg(F.count("*").alias("k")).groupBy("g", "blocks")
        parts = sizes.agg(F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("n")).where("parts > 1")
        return rows, ws.save(parts.select("g", "parts", "n", F.col("most.c").alias("major"), (F.col("n") - F.col("most.k")).alias("apart")), f"{name}_{step}_parts")

    share = lambda k: F.ceil(F.col("blocks") * F.col(k) / F.col("n")).cast("long")
    rows, several = labelled(edges, "first")
    heads = rows.join(several, "g").groupBy("g", "c", share("parts").alias("of")).agg(F.min("rep").alias("rep"))
    edges = edges.union(ws.save(fewer_links(meet(heads.select(F.xxhash64("g", F.lit(1), block(F.col("of"), 8)).alias("unit"), "rep"))), f"{name}_heads"))
    rows, several = labelled(edges, "second")
    if several.isEmpty():
        return edges
    tied = rows.join(several, "g").withColumn("of", share("apart"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    apart = tied.where("c <> major").select("g", "rep", block(F.col("of"), 9).alias("i"), every("blocks").alias("j"))
    others = tied.select("g", "rep", every("of").alias("i"), block(F.col("blocks"), 10).alias("j"))
    return edges.union(ws.save(fewer_links(meet(apart.union(others).select(F.xxhash64("g", "i", "j").alias("unit"), "rep").distinct())), f"{name}_rest"))


def fewer_links(links: DataFrame) -> DataFrame:
    """Distinct edges with the same components: each node's lowest neighbour is tied to it and to its other ones.

    A node has an edge at most per list that it is in; stars of lists that share members become one.
    """
    low = links.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("l"))
    ends = F.transform("l", lambda x, i: F.when(i == 0, F.col("b")).otherwise(x))
    return low.select(F.col("l")[0].alias("a"), F.explode(ends).alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, n_shingles, component_id, kept), one row per row of docs.

    A link at or above the threshold is looked at but for a chance of about MISS.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = ws.save(texts.mapInArrow(_sketcher(width), "doc_id long, n_shingles long, digest binary, sketch binary"), "rows")
    classes = ws.save(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes"
    )
    # Classes of one doc_id (rows that repeat it with other texts) are one node.
    keys = ws.save(_rare_postings(classes, percent), "keys")
    lists = keys.groupBy("value").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("s2")).where("n > 1")
    lists = lists.groupBy("n", "s", "s2").agg(F.min("value").alias("value")).select("value", "n")
    members = ws.save(keys.join(lists, "value").select(F.col("value").cast("long").alias("g"), "rep", F.ceil(F.col("n") / F.lit(LIST_BLOCK)).cast("long").alias("blocks")), "members")

    def look(units: DataFrame) -> DataFrame:
        sketched = units.join(classes.select("rep", "n_shingles", "sketch"), "rep").select("unit", "rep", "n_shingles", "sketch")
        return sketched.repartition("unit").sortWithinPartitions("unit").mapInArrow(_candidates(percent), "a long, b long")

    groups = components(links_within(members, look, ws, "lists"), ws, "groups")
    sizes = classes.groupBy("rep").agg(F.sum("n_shingles").alias("n"))
    grouped = ws.save(groups.join(sizes, groups.node == sizes.rep).select(F.col("component").alias("g"), "rep", "n"), "groups")
    sized = ws.save(grouped.join(grouped.groupBy("g").agg(F.ceil(F.sum("n") / F.lit(TEXT_BLOCK)).cast("long").alias("blocks")), "g").select("g", "rep", "blocks"), "sized")

    def verify(units: DataFrame) -> DataFrame:
        # One text for each representative, and that of the class: another text of the same doc_id is looked at as well.
        units = ws.save(units, f"units_{next(step)}")
        wanted = texts.join(maybe_broadcast(units, units.count()), texts.doc_id == units.rep).select("unit", "rep", "text").dropDuplicates(["unit", "rep", "text"])
        return wanted.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verifier(width, percent), "a long, b long")

    step = count()
    links = links_within(sized, verify, ws, "exact")
    # Rows of one doc_id in several classes tie these together, as do equal sets of several doc_ids.
    same = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    ties = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    found = components(ws.save(links.union(ties), "links"), ws, "found")
    node = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    mine = node.join(found, node.rep == found.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles").join(mine, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with the columns of docs.

    Rows of a repeated doc_id have one verdict, that of the rows with words; of those that stay one row a doc_id is kept
    (the smallest of all columns in order, one with words before those without), rows without an id all.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    rows = near_duplicates(docs, width, percent, ws).where("doc_id IS NOT NULL")
    verdict = ws.save(rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("kept").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"), "verdict")
    few = verdict.count()
    of = docs["doc_id"].cast("long") == F.col("_id")
    once = docs.join(maybe_broadcast(verdict.select("_id"), few), of, "left_anti")
    again = docs.join(maybe_broadcast(verdict.where("stays").select("_id"), few), of, "left_semi")
    row = F.struct((word_count(text_or_empty()) == 0).alias("empty"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = again.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(row)["row"].alias("row"))
    return once.unionByName(first.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
