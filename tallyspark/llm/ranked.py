"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are counted once, for the terms of the items only. Every task makes impact lists of its documents, a list for
each term, highest impact first, a shard of them at a time, and answers all items. An item's lists are read side by side;
each document met is at once scored in full, by direct access to its row, which also marks its positions in the item's
other lists as seen. A list's best position is the last of those seen without a gap from its head, so it may lie far
beyond the last one read. No document that is still unmet scores more than the sum of the impacts at the best positions:
once that sum is below the kth score, the shard is done. What a task found in earlier shards counts in its kth score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import Staged, ship, table

#: What separates terms; all other characters belong to one.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings at which a shard ends, positions that are read of each list at first, bytes of item texts answered at once.
SHARD, STEP, ITEM_BYTES = 1 << 21, 32, 8 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = bytes(b if b > 127 or chr(b).isdigit() else (b | 32 if chr(b).isalpha() else 32) for b in range(256))


def _counted(numbers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the number of its terms, and the items' terms in it with their occurrences; at last, of the task,
    the documents with terms, their terms, and of each of the items' terms the documents that hold it."""
    number = numbers.value
    held, docs, total = np.zeros(len(number), np.int64), 0, 0
    names = ["key", "n", "terms", "times", "df_terms", "df"]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    for batch in batches:
        many, ids, times, sizes = [], [], [], [0]
        for text in batch.column("text").cast(pa.binary()):  # one text at a time
            words = (text.as_py() or b"").translate(_SPLIT).split()
            many.append(len(words))
            found = [(number[w], n) for w, n in Counter(words).items() if w in number]
            ids.extend(i for i, _ in found)
            times.extend(n for _, n in found)
            sizes.append(len(ids))
        flat, offsets = np.array(ids, np.int32), pa.array(sizes, pa.int32())
        held += np.bincount(flat, minlength=len(held))
        docs, total = docs + sum(n > 0 for n in many), total + sum(many)
        columns = [batch.column("key"), pa.array(many, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(batch), ints), pa.nulls(len(batch), longs)], names)
    some = np.flatnonzero(held)
    # -1 and -2 stand for the documents with terms and for all their terms.
    tally = [pa.array([[-1, -2, *some.tolist()]], ints), pa.array([[docs, total, *held[some].tolist()]], longs)]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.int64(), ints, longs)] + tally, names)


class Shard:
    """Impact lists of some documents, and the documents' rows for direct access."""

    def __init__(self, weight: np.ndarray, keys: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray):
        self.keys, self.ends = keys, np.cumsum(sizes)
        self.begins, self.terms = self.ends - sizes, terms
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.impact = weight[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[of]))
        order = np.lexsort((of, -self.impact, terms))
        self.document, self.value = of[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)  # of each posting of a row, its place among the lists
        self.place[order] = np.arange(len(order))
        self.list = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.seen = np.zeros(len(order), bool)
        self.met = np.zeros(len(sizes), bool)
        self.wanted = np.zeros(len(weight), bool)

    def direct(self, docs: np.ndarray) -> np.ndarray:
        """Scores of documents under the wanted terms; marks their positions as seen."""
        size = self.ends[docs] - self.begins[docs]
        ends = np.cumsum(size)
        row = np.repeat(self.begins[docs] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        own = np.repeat(np.arange(len(docs)), size)
        hit = self.wanted[self.terms[row]]
        row, own = row[hit], own[hit]
        self.seen[self.place[row]] = True
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, own, self.impact[row])
        return out

    def best(self, terms: np.ndarray, k: int, scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the given scores (with their keys) and those of this shard's documents for an item's terms."""
        begin, end = self.list[terms], self.list[terms + 1]
        begin, end = begin[begin < end], end[begin < end]
        self.wanted[terms] = True
        touched, depth, step = [], 0, STEP
        position = begin.copy()  # the first place of each list that is not seen without a gap
        while len(begin):
            # What stands at the best positions bounds all that is unmet; nothing is unmet beyond a list's end.
            at = np.where(position > begin, position - 1, begin)
            bound = int(self.value[at][position < end].sum())
            if (len(scores) >= k and bound < int(scores[k - 1])) or bound == 0:
                break
            low, high = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            size = high - low
            ends = np.cumsum(size)
            read = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
            docs = np.unique(self.document[read])
            docs = docs[~self.met[docs]]
            self.met[docs] = True
            touched.append(docs)
            found = self.direct(docs)
            ahead = found > 0 if len(scores) < k else found >= scores[k - 1]
            scores, keys = _top(k, np.concatenate([scores, found[ahead]]), np.concatenate([keys, self.keys[docs[ahead]]]))
            for i, (p, e) in enumerate(zip(position.tolist(), end.tolist(), strict=True)):
                while p < e:
                    gap = self.seen[p : p + 256]
                    ahead_ = int(gap.argmin())
                    if not gap[ahead_]:
                        p += ahead_
                        break
                    p += len(gap)
                position[i] = min(p, e)
            depth, step = depth + step, min(2 * step, 1 << 12)
            if depth >= int((end - begin).max()):
                break
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            self.seen[b:e] = False
        for docs in touched:
            self.met[docs] = False
        self.wanted[terms] = False
        return scores, keys


def _top(k: int, scores: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, -scores))[:k]
    return scores[order], keys[order]


#: Stands for a null key, which so comes after all others.
_NULL = np.iinfo(np.int64).max


def _searched(told, k: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best documents of the task for each item."""
    weight, items = told.value
    none = np.zeros(0, np.int64)
    found = [(none, none)] * len(items)
    waiting: list[list[np.ndarray]] = []
    size = 0

    def settle() -> None:
        nonlocal size
        if size:
            shard = Shard(weight, *[np.concatenate(x) for x in zip(*waiting, strict=True)])
            for i, terms in enumerate(items):
                found[i] = shard.best(terms, k, *found[i])
        waiting.clear()
        size = 0

    for batch in batches:
        terms, times = batch.column("terms"), batch.column("times")
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        keys, m = batch.column("key").fill_null(_NULL).to_numpy(), batch.column("m").to_numpy(zero_copy_only=False)
        flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, times)]
        some, ends = sizes > 0, np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            begin = int(ends[at] - sizes[at])
            stop = max(at + 1, int(np.searchsorted(ends, begin + most - size, side="right")))
            part = slice(begin, int(ends[stop - 1]))
            pick = some[at:stop]
            waiting.append([keys[at:stop][pick], m[at:stop][pick], sizes[at:stop][pick], flat[0][part], flat[1][part]])
            size += int(ends[stop - 1]) - begin
            at = stop
            if size >= most:
                settle()
    settle()
    for i, (scores, keys) in enumerate(found):
        if len(scores):
            columns = [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys, pa.int64(), mask=keys == _NULL), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "key", "score"])


def terms_of(text: F.Column) -> F.Column:
    """The distinct terms of a text, A-Z in lower case; none for a null."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_distinct(F.filter(F.split(lower, BREAK), lambda w: w != F.lit("")))


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """item, rank (from 1), key and score of the k best documents of each item, scores above 0 only.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))), and a document's score the sum of its terms' weights times
    1e9 tf div (1000 tf + 20 m), m = 50 + 50 n N div L; see the module on how the lists are read. Equal scores go by
    ascending key, null keys last. Documents that repeat a key are each ranked. Items of equal ids are one, with all their
    terms; an item without terms, or a null text, finds nothing, and empty tables give an empty result. A long text takes
    memory in proportion to itself. Items are answered in blocks of so many bytes of text, each against all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = items.groupBy(F.col(item).alias("item")).agg(F.array_distinct(F.flatten(F.collect_list(terms_of(F.col(query))))).alias("terms"))
    wanted = Staged(wanted, "items").df
    size = int(wanted.agg(F.sum(F.octet_length(F.concat_ws(" ", "terms")).cast("long"))).first()[0] or 0)
    blocks = -(-size // ITEM_BYTES) or 1
    block = F.pmod(F.xxhash64(F.col("item")), F.lit(blocks))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = [_answers(rows, [(r["item"], r["terms"]) for r in wanted.filter(block == b).orderBy("item").collect()], k, wanted.schema["item"].dataType) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _answers(rows: DataFrame, items: list[tuple], k: int, kind) -> DataFrame:
    """The best documents for one block of items."""
    spark = rows.sparkSession
    number = {w.encode(): i for i, w in enumerate(sorted({w for _, terms in items for w in terms}))}
    numbers = spark.sparkContext.broadcast(number)  # ITEM_BYTES of terms, or one item's
    schema = "key long, n long, terms array<int>, times array<long>, df_terms array<int>, df array<long>"
    counted = Staged(rows.mapInArrow(lambda b: _counted(numbers, b), schema), "counted").df
    pairs = counted.filter("df IS NOT NULL").select(F.explode(F.arrays_zip("df_terms", "df")).alias("x"))
    df = {r["t"]: r["n"] for r in pairs.groupBy(F.col("x.df_terms").alias("t")).agg(F.sum("x.df").alias("n")).collect()}  # a row for each term at most
    n, total = df.get(-1, 0), df.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(number))], np.int64)
    told = spark.sparkContext.broadcast((weight, [np.array([number[w.encode()] for w in terms], np.int64) for _, terms in items]))
    m = F.expr(f"50 + (50L * n * {n}L) div {max(total, 1)}L")
    scored = counted.filter("n IS NOT NULL AND size(terms) > 0").select("key", m.alias("m"), "terms", "times")
    most = SHARD
    found = scored.mapInArrow(lambda b: _searched(told, k, most, b), "item int, key long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # tasks keep k rows of each item
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"nth int, name {kind.simpleString()}")
    joined = best.join(F.broadcast(names), F.col("item") == F.col("nth"))
    return joined.select(F.col("name").alias("item"), "rank", "key", "score")


def op12_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS r
  FROM documents
), size AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d),
al AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t
  FROM benchmark
), p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, al),
i AS (SELECT p.r, p.t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS impact FROM p JOIN wt USING (t) JOIN size USING (r), al),
s AS (SELECT item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY item_id, r HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN size USING (r) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
