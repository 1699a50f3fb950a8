import random

import pytest

from loomgraph.llm import repeats


def brute(rows):
    """rows: (doc_id, text), unique ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = [k for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])]
        out[i] = (len(raw), sum(gone), len(spans), bytes(b for b, g in zip(raw, gone) if not g))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randrange(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    passages, rows = [line(30) for _ in range(6)], []
    for i in range(120):
        parts = [line(r.randrange(1, 40)) if r.random() < 0.5 else r.choice(passages) for _ in range(r.randrange(1, 5))]
        t = "\n".join(parts)
        if r.random() < 0.3 and rows:
            t = list(r.choice(rows)[1] or "")
            if t and r.random() < 0.7:
                t[r.randrange(len(t))] = "X"
            t = "".join(t)
        rows.append((i * 3, t))
    return rows + [(None, passages[0]), (1, None), (2, ""), (4, "a" * 700), (5, "b" + "a" * 300), (7, "ab" * 300), (8, "x" * 99), (10, "x" * 100), (11, "x" * 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    found = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df).collect()}
    want = brute(rows)
    assert {k: (found[k][:3], want[k][:3]) for k in want if found[k] != want[k]} == {} and len(found) == len(want)


def test_repeated_rows_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(260)) + "end"
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    found = sorted((r.doc_id, len(r.spans)) for r in repeats.remove_repeats(df).collect())
    assert [x[0] for x in found] == [1, 1, 2] and found[2][1] == 1 and found[0] == found[1]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_rows_lose_nothing_to_each_other(spark, parts):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    first, alone, none = text(600), text(400), text(300)
    near = first[:250] + "X" + first[251:]  # its contexts differ from those of first under the same anchors
    rows = [(1, first), (2, near), (3, alone), (4, alone[:250] + text(90)), (None, none)]
    df = spark.createDataFrame([x for x in rows for _ in range(3)], "doc_id long, text string")
    df = df.coalesce(1) if parts == 1 else df.repartition(parts)
    found, want = repeats.remove_repeats(df).collect(), brute(rows)
    assert len(found) == 3 * len(rows)
    for x in found:
        assert (x.n_bytes, sum(z.end - z.start for z in x.spans), len(x.spans), bytes(x.kept)) == want[x.doc_id]
    assert [want[i][1] for i in (1, 3, None)] == [0, 0, 0] and want[2][1] and want[4][1]


@pytest.mark.parametrize("seed", range(5))
def test_run_index_spells_and_orders(seed):
    r = random.Random(seed)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(50)]
    marked = repeats.RunIndex(texts, 8).stream(texts, 8)
    seen = set()
    for t, m in zip(texts, marked, strict=True):
        for k in range(len(t) - 7):
            assert bool(m[k]) == (t[k : k + 8] in seen)
            seen.add(t[k : k + 8])


@pytest.mark.parametrize(("parts", "side"), [(1, 10_000), (5, 10_000), (3, 1)])
def test_small_bounds_change_nothing(spark, parts, side):
    """Anchors of many contexts, texts in many pieces, flushes after few contexts and crowded sides take other ways to the same result."""
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df, most=60, hot_from=2, piece=130, side_from=side).collect()}
    want = brute(rows)
    assert {k: (found[k][:3], want[k][:3]) for k in want if found[k] != want[k]} == {} and len(found) == len(want)


def test_very_long_runs_and_a_hot_passage(spark):
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = line(150)
    rows = [(1, "a" * 2_000_000), (2, "b" * 99 + "a" * 300_000)] + [(i, line(40) + passage[: 120 + i % 30] + line(40)) for i in range(3, 1500)]
    found = {x.doc_id: sum(s.end - s.start for s in x.spans) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert found[1] == 1_999_999 and found[2] == 300_000  # all but the first letter: the string at 1 is the string at 0
    want = brute(rows[2:])
    assert {i: n for i, n in found.items() if i > 2} == {i: w[1] for i, w in want.items()}


def test_documents_without_id_are_told_apart(spark):
    """Rows without doc_id are documents of their own: what the third repeats of the others goes, wherever they stand in the order."""
    r = random.Random(21)
    a, b, mid = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (300, 400, 50))
    rows = [(None, a), (None, b), (None, b + mid + a), (None, a), (5, b), (-(2**61), a)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {(x.doc_id, x.n_bytes): sum(y.end - y.start for y in x.spans) for x in got}
    assert gone[5, 400] == 400 and gone[-(2**61), 300] == 300
    own = sum(n for (i, _), n in gone.items() if i is None)
    assert own == 700 and len(got) == 6  # of both strings one copy stays, and repeated rows are one document
