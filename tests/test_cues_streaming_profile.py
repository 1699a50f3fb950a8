import datetime
import random
import re

import pytest

from loomgraph import profile
from loomgraph.functions import algebra as A
from loomgraph.functions import cues
from loomgraph.streaming import staleness


def test_cues(spark):
    rows = [("Where needed, within 3 days after the period referred to in paragraph 2",), ("‘consent’ of the data subject means any risk due to IF",), (None,), ("",), ("automated means within the Union",)]
    df = cues.cue_counts(spark.createDataFrame(rows, "t string"), "t")
    assert [tuple(r[d] for d in A.DIMENSIONS) for r in df.collect()] == [(1, 1, 0, 3, 0), (1, 3, 0, 0, 1), (0,) * 5, (0,) * 5, (0,) * 5]
    first = df.select(*cues.contributions()).first()
    assert first.asDict() == {"structural": 1.0, "causal": 1.0, "intentional": 0.0, "temporal": 3.0, "relational": 0.0}


def test_cues_of_whole_documents(spark, tmp_path):
    import __spark_entry__

    r = random.Random(3)
    words = "if where leads to risk within 3 days after the period before purpose of in order to ensure referred to in paragraph 2 Chapter IV means any controller right to between gear stall".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randrange(1, 80))) for i in range(30)] + [(40, text(3000)), (41, None), (42, ""), (43, text(50))] + [(43, "due to")] * 2 + [(None, "IF if")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")

    def count(t, d):  # stretches of overlapping matches, joined pair by pair
        found = []
        for a, z in {m.span() for p in cues.CUES[d] for m in re.finditer(p, t or "", re.IGNORECASE)}:
            touched = [s for s in found if s[0] < z and a < s[1]]
            found = [s for s in found if s not in touched] + [(min([a, *(s[0] for s in touched)]), max([z, *(s[1] for s in touched)]))]
        return len(found)

    want = []
    for i, t in rows:
        n = {d: count(t, d) for d in A.DIMENSIONS}
        others = sum(n.values()) - n["relational"]
        want.append((i, *(int(n[d] * 1e6 / (1 + others if d == "relational" else 1) + 0.5) for d in A.DIMENSIONS)))
    found = [tuple(x[c] for c in ("doc_id", *A.DIMENSIONS)) for x in __spark_entry__.queries()["text_cue_documents"](spark, f"file://{tmp_path}").collect()]
    near = lambda x, y: x[0] == y[0] and all(abs(p - q) <= 1 for p, q in zip(x[1:], y[1:], strict=True))
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert len(found) == len(want) and all(near(x, y) for x, y in zip(sorted(found, key=order), sorted(want, key=order), strict=True))
    assert max(x[4] for x in found) > 100_000_000


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_debounce_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[("a", at(s)) for s in (0, 1, 2)] + [("b", at(0))], [("a", at(s)) for s in (3, 4, 50)], [("a", at(100)), ("b", at(500))], [("c", at(9000))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "node string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/batch={i}"))
    events = spark.readStream.schema("node string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = _run(spark, staleness.debounce_stream(events, 10.0, 5), "debounced")
    told = sorted((r.node, int((r.at - at(0)).total_seconds()), r.events) for r in found)
    assert told == [("a", 0, 5), ("a", 50, 1), ("a", 100, 1), ("b", 0, 1), ("b", 500, 1)]
    with pytest.raises(ValueError):
        staleness.debounce_stream(events, 10.0, 0)


def test_windowed_contributions(spark, tmp_path):
    at = lambda h: datetime.datetime(2026, 1, 1, h)
    spark.createDataFrame([("a", "causal", at(1)), ("a", "causal", at(1)), ("b", "temporal", at(2))], "node string, dim string, ts timestamp").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("node string, dim string, ts timestamp").parquet(str(tmp_path / "in"))
    found = _run(spark, staleness.windowed_contributions(events), "windowed", "update")
    assert sorted((r.node, r.dim, r.start.hour, r.n) for r in found) == [("a", "causal", 1, 2), ("b", "temporal", 2, 1)]


def test_profiles():
    assert profile.profile_violations({"profile_id": "p"}) == [] and profile.profile_violations([]) == ["a profile is a mapping"]
    assert profile.profile_violations({}) == ["profile_id must be a text"]
    assert profile.profile_digest({"profile_id": "p"}) == profile.profile_digest({"profile_id": "p", "k": 5.0, "xref_resolver": "article-v1"}) != profile.profile_digest({"profile_id": "p", "k": 6})
    bad = profile.profile_violations({"profile_id": "p", "k": True, "r": 0, "x": 1, "d_blend_weights": {"links": 0, "nesting": 0}, "match_blend_weights": {"term": 1}, "confidence_floor": 2, "point_saturation": 2.5, "tiebreak_salt": "", "xref_resolver": "v3"})
    assert len(bad) == 9
    assert profile.profile_violations({"profile_id": "p", "d_blend_weights": {"links": 1e308, "nesting": 1e308}})
