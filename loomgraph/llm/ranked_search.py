"""Ranked lexical search by TPUT over postings that are partitioned by term.

Documents are tokenised once; what they hold of the queries' terms is written as a forward table (a row for each document) and as postings (term, impact, document), dealt by ranges of term, impact and document, so that each list lies in order
and a list of any length spreads over as many files as it needs. Then, for all queries at once:

1. the heads of all lists (their k highest impacts) give documents, whose scores are looked up: a query's k-th highest is a lower bound of its k-th score, and a list's first posting is the most that it can give;
2. one threshold for all lists of a query follows from both: a document that reaches the bound reaches the threshold in some list. All postings from there on are fetched, their sums raise the bound, and what
   a document may still hold below the threshold gives an upper bound; documents whose upper bound is lower than the raised bound go;
3. the exact scores of those left are looked up in the forward table.

The terms of the queries go to all tasks as a dictionary, and which query asks for which term as a table; the bytes of both are counted first, and queries with more than that are searched in blocks. So postings and documents meet the queries where they lie,
and what each posting gives to each query is summed there, whatever Spark makes of the sizes of either side.

Defined cases: null and empty texts have no terms and don't count as documents; texts of any length are read whole; every row is a document, so repeated rows are ranked one by one; equal scores go by ascending doc_id, a null doc_id
first; items without terms have no result, repeated items one each; an empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.tables import spread

from .common import ascii_lower, map_arrow, written
from .decontaminate import words

#: Bytes of terms, of what a dictionary takes for each, and of pairs of query and term, that go to all tasks at once.
BLOCK_BYTES, TERM_BYTES, PAIR_BYTES = 64 << 20, 130, 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def forward(docs: DataFrame, terms: list[str]) -> DataFrame:
    """row (unique), doc_id, n (terms of the document, repeats included), tids and tfs: places in `terms` of those that it holds, and how often."""
    number = {t.encode(): i for i, t in enumerate(terms)}

    def run(batches):
        for b in batches:
            n, at, tids, tfs = [], [0], [], []
            for x in b.column(2):
                found = words((x.as_py() or "").encode())
                n.append(len(found))
                held = Counter(map(number.get, found, repeat(-1)))
                held.pop(-1, None)
                tids += held.keys()
                tfs += held.values()
                at.append(len(tids))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v in (tids, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *lists], ["row", "doc_id", "n", "tids", "tfs"])

    rows = spread(docs.select(F.col("doc_id").cast("long"), "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_arrow(rows, run, "row long, doc_id long, n long, tids array<int>, tfs array<int>")


def impact(tf: Column, m: Column) -> Column:
    """What a document gains from a term that occurs tf times, for each unit of the term's weight: integers throughout."""
    return F.call_function("div", tf.cast("long") * 1_000_000_000, tf.cast("long") * 1000 + m * 8)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring documents of every item (item_id, text), scores above 0."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(_TERM), F.lit(0))
    queries = items.select("item_id", found.alias("w")).where("size(w) > 0")
    queries = written(queries.withColumn("qid", F.monotonically_increasing_id()), "queries")
    asked = queries.select("qid", F.explode("w").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    cost = F.sum(F.octet_length("term") + TERM_BYTES + F.col("pairs") * PAIR_BYTES)
    total = asked.groupBy("term").agg(F.count("*").alias("pairs")).agg(cost).first()[0] or 0
    blocks, count = -(-total // block_bytes) or 1, queries.count()
    block = lambda: F.pmod(F.xxhash64("qid"), F.lit(blocks))
    while 1 < blocks < 2 * count:  # the largest block is checked, and all are made smaller until it fits; a single item is one block at least
        largest = asked.groupBy(block().alias("b"), "term").agg(F.count("*").alias("pairs")).groupBy("b").agg(cost.alias("c")).agg(F.max("c")).first()[0]
        if largest <= block_bytes:
            break
        blocks *= 2
    parts = [_block(docs, asked.where(block() == i) if blocks > 1 else asked, k) for i in range(blocks)]
    ranked = reduce(DataFrame.unionByName, parts)
    return ranked.join(queries.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted(r.term for r in asked.select("term").distinct().collect())  # bounded by block_bytes
    lists = asked.join(spark.createDataFrame(list(enumerate(terms)), "tid int, term string"), "term").select("qid", "tid", "times")
    docs = written(forward(docs, terms), "forward")
    held, of = docs.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    m = F.lit(25).cast("long") + F.call_function("div", F.col("n") * (75 * (held or 0)), F.lit(of or 1).cast("long"))
    gains = docs.select("row", m.alias("m"), F.explode(F.arrays_zip("tids", "tfs")).alias("p")).select("row", F.col("p.tids").alias("tid"), impact(F.col("p.tfs"), F.col("m")).cast("int").alias("impact"))
    down = [F.col("tid"), F.desc("impact"), F.col("row")]
    postings = written(gains.repartitionByRange(*down).sortWithinPartitions(*down), "postings")

    weight = F.floor(F.log(F.lit(2.0 * (held or 0) + 2) / (F.col("df") * 2 + 1).cast("double")) * 1000).cast("long")
    weights = postings.groupBy("tid").agg(F.count("*").alias("df"), F.max("impact").alias("top")).select("tid", "top", weight.alias("w")).where("w > 0 AND top > 0")
    lists = written(lists.join(weights, "tid").select("qid", "tid", (F.col("times") * F.col("w")).alias("w"), "top"), "lists")

    # 1: heads; the exact scores of their documents, and of these the k-th highest of each query.
    of_list = Window.partitionBy("tid").orderBy(F.desc("impact"), "row")
    heads = postings.withColumn("at", F.row_number().over(of_list)).where(F.col("at") <= k).drop("at")
    heads = heads.join(F.broadcast(lists), "tid").select("qid", "row").distinct()
    lists = written(_thresholds(lists, _kth(_scores(heads, docs, m, lists), k)), "thresholds")

    # 2: all postings from the thresholds on; postings that no query wants go first.
    wanted = postings.join(F.broadcast(lists.groupBy("tid").agg(F.min("least").alias("lowest"))), "tid").where("impact >= lowest").select("tid", "impact", "row")
    # Dealt by row while they are postings, before each meets every query of its list: the pairs of query and row are then summed where they arise.
    seen = wanted.repartition("row").join(F.broadcast(lists), "tid").where("impact >= least").groupBy("qid", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score"), F.sum("unseen").alias("not_unseen"))
    seen = written(seen, "partial-sums")
    most = lists.groupBy("qid").agg(F.sum("unseen").alias("unseen"), F.max("bound").alias("first")).join(_kth(seen, k), "qid", "left")
    left = seen.join(F.broadcast(most), "qid").where("score + unseen - not_unseen >= greatest(first, coalesce(bound, 0))").select("qid", "row")

    # 3: exact scores of those left.
    scores = _scores(left, docs, m, lists).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "row"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def _scores(pairs: DataFrame, docs: DataFrame, m: Column, lists: DataFrame) -> DataFrame:
    """pairs (qid, row) with doc_id and the exact score, looked up in the forward table."""
    full = pairs.join(docs, "row").select("qid", "row", "doc_id", m.alias("m"), F.explode(F.arrays_zip("tids", "tfs")).alias("p"))
    full = full.select("qid", "row", "doc_id", F.col("p.tids").alias("tid"), impact(F.col("p.tfs"), F.col("m")).alias("impact")).join(F.broadcast(lists.select("qid", "tid", "w")), ["qid", "tid"])
    return full.groupBy("qid", "row", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def _thresholds(lists: DataFrame, bounds: DataFrame) -> DataFrame:
    """lists (qid, tid, w, top) with `bound`, `least`, the lowest impact that is fetched, and `unseen`, the most that a document may hold of a list below that. A query's threshold is the highest for which a document that stays below it in every list, and within each
    list's maximum, stays below the query's bound: lists of small maxima, such as those of very common words, count by these and leave more to the others."""
    most = F.col("w") * F.col("top")
    by_most = Window.partitionBy("qid").orderBy("most", "tid")
    rows = lists.withColumn("most", most).join(bounds, "qid", "left").withColumns({"i": F.row_number().over(by_most), "n": F.count("*").over(Window.partitionBy("qid")), "below": F.sum("most").over(by_most) - most})
    rest = F.call_function("div", F.col("bound") - 1 - F.col("below"), F.col("n") - F.col("i") + 1)
    fits = rows.withColumn("rest", rest).where("rest <= most").groupBy("qid").agg(F.min_by("rest", "i").alias("below"))
    below = F.greatest(F.coalesce("below", F.lit(0)), F.lit(0))
    least = F.call_function("div", F.col("below") + F.col("w"), F.col("w"))
    found = lists.join(fits, "qid", "left").join(bounds, "qid", "left")
    return found.select("qid", "tid", "w", F.coalesce("bound", F.lit(0)).alias("bound"), least.alias("least"), F.least(most, below).alias("unseen"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """qid and its k-th highest score, of queries that have as many."""
    ranked = scores.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("at") <= k)
    return ranked.groupBy("qid").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "bound")
