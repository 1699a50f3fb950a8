"""Term weights, sparse similarity, rank fusion and as-of lookup over DataFrames."""

from __future__ import annotations

import math
import re
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import algebra as A
from loomgraph.functions import text as T
from loomgraph.sources.tables import stored

K1, B = 1.5, 0.75
_TERM, _STOP = re.compile(rb"[a-z]{2,}"), frozenset(t.encode() for t in T.STOPWORDS)  # of T.terms, in bytes whose ASCII letters are lower-cased


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df: documents that hold it. Repeats go within the row, so partial counts are all that is shuffled."""
    return docs.select(F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each document that has terms: key, dl (its terms), terms (each once) and counts. Documents of one Arrow batch share a chunk, whose own row (dl: null) has the terms of all of them, and in how many each occurs. A row is a document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # texts may be of any length

    def run(batches):
        task = TaskContext.get().partitionId() << 33
        for i, b in enumerate(batches):
            keys, lengths, at, terms, counts, held = [], [], [0], [], [], Counter()
            for k, x in enumerate(b.column(1)):
                found = Counter(_TERM.findall((x.as_py() or "").encode().lower()))
                for t in _STOP & found.keys():
                    del found[t]
                if found:
                    keys.append(k)
                    lengths.append(found.total())
                    terms += found.keys()
                    counts += found.values()
                    at.append(len(terms))
                    held.update(found.keys())
            terms += held.keys()
            counts += held.values()
            at.append(len(terms))
            names = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()))
            numbers = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(counts, pa.int64()))
            chunk = pa.array([task + i] * len(at[1:]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([*keys, None], pa.int64())), chunk, pa.array([*lengths, None], pa.int32()), names, numbers], [key, "chunk", "dl", "terms", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk long, dl int, terms array<string>, counts array<long>")


def document_weights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dl, terms, counts, idf: a row for each document, its terms side by side with their idf. Documents are read once for their terms, which are stored. Frequencies are summed from the chunks' terms, and come back to each chunk, where its documents
    look them up: a term goes over the network twice for a chunk and not for each document that holds it, and no key has more rows than there are chunks. Only two totals reach the driver."""
    rows = stored(term_counts(docs, key, text), "terms")
    of_chunks = rows.where("dl IS NULL").select("chunk", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("chunk", F.col("x.terms").alias("term"), F.col("x.counts").alias("c"))
    df = F.sum("c").over(Window.partitionBy("term"))
    idf = F.greatest(F.lit(0.0), F.ln((F.lit(float(docs.count())) - df + 0.5) / (df + 0.5) + 1.0))
    known = of_chunks.select("chunk", "term", idf.alias("idf"))

    def looked_up(ours: pa.Table, known: pa.Table) -> pa.Table:
        terms = ours["terms"].combine_chunks()
        idf = known["idf"].combine_chunks().take(pc.index_in(terms.flatten(), value_set=known["term"].combine_chunks()))
        ends = pc.cumulative_sum(pc.list_value_length(terms))
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())]), idf)
        return pa.table([ours[key], ours["dl"], ours["terms"], ours["counts"], lists], [key, "dl", "terms", "counts", "idf"])

    kind = docs.schema[key].dataType.simpleString()
    ours = rows.where("dl IS NOT NULL")
    found = ours.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(looked_up, f"`{key}` {kind}, dl int, terms array<string>, counts array<long>, idf array<double>")
    words, n = ours.agg(F.sum("dl"), F.lit(docs.count())).first()
    return found.withColumn("mean", F.lit(float(Decimal((words or 0) / n if n else 0).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)) or 1.0))


def _weight(idf: Column, f: Column) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("mean"))
    return A.round6(idf * f * F.lit(K1 + 1) / (f + norm))


def bm25(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, weight: one row per document and term of a positive weight."""
    rows = document_weights(docs, key, text).select(key, "dl", "mean", F.explode(F.arrays_zip("terms", "counts", "idf")).alias("x"))
    return rows.select(key, F.col("x.terms").alias("term"), _weight(F.col("x.idf"), F.col("x.counts")).alias("weight")).where("weight > 0")


def bm25_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same weights as one row per document: key, terms, weights."""
    weights = F.zip_with("idf", "counts", _weight)
    return document_weights(docs, key, text).select(key, "terms", weights.alias("weights"))


def term_claims(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """vectors (key, term, weight, or key, terms, weights: a row each) to key, term, and weights as shares of the largest of their document. Vectors of a row each are sorted by document as they are, and fall into terms after that."""
    of_document = Window.partitionBy(key)
    if "term" in vectors.columns:
        rows = vectors.withColumn("_top", F.max("weight").over(of_document))
    else:
        rows = vectors.withColumn("_top", F.max(F.array_max("weights")).over(of_document)).select(key, "_top", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
        rows = rows.select(key, "_top", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight")).where("weight > 0")
    return rows.select(key, "term", A.round6(F.col("weight") / F.col("_top")).alias("weight"))


def sparse_cosine(vectors: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """vectors (key, term, weight, or key, terms, weights: a row each), pairs (a, b) to (a, b, cosine), zero where no term is shared. A vector is brought together once, goes to the pairs that it stands first in, and those to their second, where the terms of
    both are compared."""
    if "term" in vectors.columns:
        parts = vectors.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("_p")).select(key, F.col("_p.term").alias("terms"), F.col("_p.weight").alias("weights"))
    else:
        parts = vectors
    whole = parts.groupBy(key).agg(F.collect_list(F.struct("terms", "weights")).alias("v"))  # one exchange, that both joins read
    both = pairs.join(whole.select(F.col(key).alias("a"), F.col("v").alias("x")), "a", "left").join(whole.select(F.col(key).alias("b"), F.col("v").alias("y")), "b", "left").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                dot = norms = 0.0
                if x.is_valid and y.is_valid:
                    (s, m), (t, n) = _summed(x), _summed(y)
                    if len(s) > len(t):
                        s, t = t, s
                    dot, norms = math.fsum(w * t[term] for term, w in s.items() if term in t), m * n
                out.append(dot / norms if norms else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "cosine"])

    kind = pairs.schema
    found = both.mapInArrow(run, f"a {kind['a'].dataType.simpleString()}, b {kind['b'].dataType.simpleString()}, cosine double")
    return found.select("a", "b", A.round6(F.col("cosine")).alias("cosine"))


def _summed(vector: pa.ListScalar) -> tuple[dict[str, float], float]:
    """The weights of a vector by term, and its norm."""
    terms, weights = (vector.values.field(i).flatten().to_pylist() for i in (0, 1))
    by = dict(zip(terms, weights, strict=True))
    if len(by) < len(terms):  # several rows of one key
        by = dict.fromkeys(by, 0.0)
        for t, w in zip(terms, weights, strict=True):
            by[t] += w
    return by, math.sqrt(math.fsum(w * w for w in weights))


def reciprocal_rank_fusion(scores: DataFrame, by: str, item: str, signals: list[str], constant: int = 60) -> DataFrame:
    """by, item, fused, place: sum over the signals with a positive score of 1 / (constant + rank), in millionths; ties by item."""
    total = F.lit(0).cast("long")
    for s in signals:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.when(F.col(s) > 0, F.col(s))), item))
        total = total + F.when(F.col(s) > 0, A.to_fixed(1 / (rank + constant))).otherwise(0)
    fused = scores.select(by, item, total.alias("fused"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("fused"), item)).cast("long"))


def mean_reciprocal_rank(ranked: DataFrame, query: str, by: str, rank: str, relevant: Column) -> DataFrame:
    """by, queries, mrr (millionths): the reciprocal of the first relevant rank of each query, zero without one."""
    first = ranked.groupBy(by, query).agg(F.min(F.when(relevant, F.col(rank))).alias("r"))
    total = first.groupBy(by).agg(F.count("*").alias("queries"), F.sum(A.to_fixed(F.coalesce(1 / F.col("r"), F.lit(0.0)))).alias("t"))
    return total.select(by, "queries", A.fixed_mean(F.col("t"), F.col("queries")).alias("mrr"))


def signature_overlap(sets: DataFrame, pairs: DataFrame, key: str, element: str) -> DataFrame:
    """pairs (a, b) to (a, b, shared, jaccard): common elements over all elements of the two sets."""
    sets = sets.select(F.col(key).alias("k"), F.col(element).alias("e")).distinct()
    sizes = sets.groupBy("k").agg(F.count("*").alias("size"))
    common = pairs.join(sets.withColumnRenamed("k", "a"), "a").join(sets.withColumnRenamed("k", "b"), ["b", "e"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    rows = pairs.join(sizes.select(F.col("k").alias("a"), F.col("size").alias("m")), "a").join(sizes.select(F.col("k").alias("b"), F.col("size").alias("n")), "b").join(common, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    return rows.select("a", "b", shared.alias("shared"), A.round6(shared / (F.col("m") + F.col("n") - shared)).alias("jaccard"))


def enclosing(rows: DataFrame, by: str, at: str, heading: str) -> DataFrame:
    """Each row with the last heading (NULL: none) of its document that stands strictly before it: one shuffle, no join."""
    before = Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("unit", F.last(heading, ignorenulls=True).over(before))


def resolve_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """refs (ref_id, ref: canonical or NULL, and if known source_text, the text of the whole source, and expected_digest), entries (ref, text, and if known digest) to (ref_id, ref, status, text): ok, unknown,
    malformed, or span_mismatch where the text of the entry has not the length of its span, is not what the source has there, or has not the expected digest. Nothing is dropped."""
    known = entries.select("ref", "text", *["digest"] * ("digest" in entries.columns), F.lit(True).alias("known"))
    start, end = (F.regexp_extract("ref", r"#(\d+)-(\d+)$", i).cast("long") for i in (1, 2))
    wrong = F.length("text") != end - start
    if "source_text" in refs.columns:
        wrong = wrong | F.coalesce(F.substr(F.col("source_text"), (start + 1).cast("int"), (end - start).cast("int")) != F.col("text"), F.lit(False))
    if "expected_digest" in refs.columns and "digest" in entries.columns:
        wrong = wrong | F.coalesce(F.col("expected_digest") != F.col("digest"), F.lit(False))
    status = F.when(F.col("ref").isNull(), "malformed").when(F.col("known").isNull(), "unknown").when(F.coalesce(wrong, F.lit(True)), "span_mismatch").otherwise("ok")
    return refs.join(known, "ref", "left").select("ref_id", "ref", status.alias("status"), "text")


class SpanReferenceError(ValueError):
    """A reference to a span that can't be followed."""


class MalformedReferenceError(SpanReferenceError):
    """It has none of the known forms."""


class ResolutionError(SpanReferenceError):
    """It has a known form, but leads nowhere."""


class MissingStoreError(ResolutionError):
    """There are no entries to look it up in."""


class UnknownReferenceError(ResolutionError):
    """No entry has its source and span."""


class SpanMismatchError(ResolutionError):
    """The entry's text is not that of the span."""


STATUS_ERRORS = {"malformed": MalformedReferenceError, "unknown": UnknownReferenceError, "span_mismatch": SpanMismatchError}


def resolved_or_raise(refs: DataFrame, entries: DataFrame | None) -> DataFrame:
    """resolve_references where every reference must lead to its span: the worst status found is raised, with one reference that has it. Only one row reaches the driver."""
    if entries is None:
        raise MissingStoreError("no entries")
    found = stored(resolve_references(refs, entries), "resolved")
    worst = found.where("status <> 'ok'").orderBy("status", "ref_id").limit(1).collect()
    if worst:
        raise STATUS_ERRORS[worst[0]["status"]](f"{worst[0]['ref_id']}: {worst[0]['ref']}")
    return found
