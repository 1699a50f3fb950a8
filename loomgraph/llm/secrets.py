r"""Secret scan with multipart credential linking, in DataFrame operations only.

Base kinds are found leftmost and non-overlapping by Java regular expressions: assign (a keyword, a separator and a value of 12 characters), access
(AKIA identifiers of 18) and hex (runs of 16). Weak kinds are reported only in company: ident (a login or account), blob (40 characters or
more that mix cases and digits) and endpoint (a URL). Each part has a class: identifier (access, ident), secret (assign, hex, blob) or endpoint. An interval join within a
scope of SCOPE code points keeps a weak candidate if a complementary part co-occurs: a blob needs an identifier or an endpoint, an ident or an endpoint needs
a secret. The join is by document and bins as wide as the scope, so a bin holds no more parts than fit into its width, and it is a semi-join: no
pairs are made. Places are counted in code points from the lengths of matches and of what stands between them.

Defined cases: a null text counts as empty; repeated rows (same doc_id and text) each get the same result; a null doc_id is allowed; text without matches has zero
counts, the digest of the empty string and empty spans; an empty table gives an empty one; further columns are ignored. A text may be as long as a row may be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Code points between two parts of one credential at most.
SCOPE = 200
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""(?i)(user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{4,})"""
BLOB = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(https?|ftps?|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
#: Order of kinds that start at one place: (kind, pattern, class).
KINDS = [("assign", ASSIGN, "secret"), ("access", ACCESS, "identifier"), ("hex", HEX, "secret"), ("ident", IDENT, "identifier"), ("blob", BLOB, "secret"), ("endpoint", ENDPOINT, "endpoint")]
BASE = 3


def parts(keyed: DataFrame) -> DataFrame:
    """keyed (key, t) to one row per match that passes its kind's test: key, k (place in KINDS), start, end."""
    hits = keyed.select("key", "t", *(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"h{k}") for k, (_, p, _) in enumerate(KINDS)))
    hits = hits.where(" OR ".join(f"size(h{k}) > 0" for k in range(len(KINDS))))
    of = [F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.when(F.size(f"h{k}") > 0, F.split("t", p, -1)).alias("gaps")) for k, (_, p, _) in enumerate(KINDS)]
    kinds = hits.select("key", F.explode(F.array(*of)).alias("x")).where("size(x.hits) > 0")
    rows = kinds.select("key", "x.k", F.posexplode(F.arrays_zip("x.hits", "x.gaps")).alias("i", "y"))
    rows = rows.select("key", "k", "i", F.col("y.hits").alias("hit"), F.length("y.gaps").cast("long").alias("gap")).where("hit IS NOT NULL")
    # Repeated rows give the same matches again: they go within each task before any is shuffled, then by match, so no task holds all copies of a row.
    rows = rows.dropDuplicates(["key", "k", "i"])
    before = Window.partitionBy("key", "k").orderBy("i")
    n = F.length("hit").cast("long")
    rows = rows.select("key", "k", "hit", (F.sum(F.col("gap") + n).over(before)).alias("end"), n.alias("n"))
    value = F.regexp_extract("hit", ASSIGN, 2)
    mixed = F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]")
    good = F.when(F.col("k") == 0, F.length(value) >= 12).when(F.col("k") == 1, F.col("n") >= 18).when(F.col("k") == 4, mixed).otherwise(True)
    return rows.where(good).select("key", "k", (F.col("end") - F.col("n")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """The rows of parts that are reported: all base ones, and weak ones with a complementary part within the scope."""
    names = F.array(*(F.lit(c) for _, _, c in KINDS))
    classed = found.withColumn("c", F.element_at(names, F.col("k") + 1))
    weak = classed.where(F.col("k") >= BASE).withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))))
    other = classed.select("key", F.col("c").alias("oc"), F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor((F.col("end") - 1) / SCOPE))).alias("bin"))
    w, o = weak.alias("w"), other.alias("o")
    near = (F.col("o.a") <= F.col("w.end") + SCOPE) & (F.col("o.b") >= F.col("w.start") - SCOPE)
    fits = F.when(F.col("w.c") == "secret", F.col("o.oc") != "secret").otherwise(F.col("o.oc") == "secret")
    kept = w.join(o, (F.col("w.key") == F.col("o.key")) & (F.col("w.bin") == F.col("o.bin")) & near & fits, "left_semi")
    return found.where(F.col("k") < BASE).unionByName(kept.select("key", "k", "start", "end").distinct())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (array of kind, start, end), spans (the same, weak ones too) for every row."""
    t = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", t.alias("t"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), t).cast("binary")).alias("key"))
    spans = linked(written(parts(keyed.select("key", "t")), "parts"))  # three readers, one scan
    by_doc = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("s"))
    names = F.array(*(F.lit(n) for n, _, _ in KINDS))
    rows = keyed.select("doc_id", "key").join(by_doc, "key", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<start:bigint,k:int,end:bigint>>)")))
    named = F.transform("s", lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.filter(named, lambda x: x["kind"].isin("assign", "access", "hex"))
    count = [F.expr(f"cast(size(filter(s, x -> x.k = {k})) as bigint)").alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    return rows.select("doc_id", *count, base.alias("base"), named.alias("spans"))


def written_out(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
