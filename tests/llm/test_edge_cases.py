"""Very long texts, columns that clash, rows without ids, and near duplicates whose min-hashes are crowded."""

import hashlib
import random

from loomgraph.llm import decontaminate, exact_dedup, interleave, near_duplicates, secrets, simhash

LONG = " ".join(f"w{i * i % 7919}" for i in range(60_000))


def test_exact_dedup_of_long_texts_with_clashing_columns(spark):
    rows = [(1, LONG, "x", 9, True), (2, LONG.upper(), "y", 9, False), (3, LONG + ".", "z", 9, True), (None, LONG, "n", 9, True), (4, None, "e", 9, True)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id string, group_size int, kept boolean"), keep="max")
    assert sorted(found.columns) == sorted(["doc_id", "text", "text_sha256", "keep_id", "group_size", "kept"])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), None: (2, 3, False), 4: (4, 1, True)}
    assert {r.text_sha256 for r in found.where("doc_id = 2").collect()} == {hashlib.sha256(LONG.encode()).hexdigest()}


def test_interleave_of_equal_rows_without_ids(spark):
    rows = [(None, "same", "a")] * 200 + [(i, LONG if i == 3 else f"t{i}", "ab"[i % 2]) for i in range(100)]
    got = interleave.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=7).collect()
    sizes = [sorted(r.slot for r in got if r.shard == k) for k in range(7)]
    assert len(got) == 300 and all(s == list(range(len(s))) for s in sizes) and {len(s) for s in sizes} <= {42, 43}
    assert [r.size for r in got if r.doc_id == 3] == [len(LONG) + 16]
    of = [sum(r.source == "a" for r in got if r.shard == k) for k in range(7)]
    assert max(of) - min(of) <= 1


def test_decontamination_of_a_long_document(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, LONG + " " + item.upper() + " " + LONG), (2, LONG), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (11, ["7"]), 2: (0, []), 3: (0, [])}


def test_credentials_of_many_documents(spark):
    """Identifiers, keys and endpoints are linked in some of 600 documents, far apart or alone in the others, and in a long one."""
    blob = "aB3" * 14
    far = "pad " * 100
    rows = []
    for i in range(600):
        k = i % 5
        rows.append((i, [f"user: name{i} token=abcdefghijkl{i:04}", f"{blob} https://api.example.org/{i}", f"user: name{i} {far} token=abcdefghijkl{i:04}", f"{blob} {far} https://h.example/{i}", f"plain {i}"][k]))
    rows.append((600, LONG + f" {blob} https://api.example.org/z " + LONG))
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [["ident", "assign"], ["blob", "endpoint"], ["assign"], [], []]
    assert all(got[i] == want[i % 5] for i in range(600)) and got[600] == ["blob", "endpoint"]


def test_simhash_with_clashing_columns_and_long_texts(spark):
    near = LONG.replace("w100 ", "other ", 1)
    rows = [(5, LONG, 1, "n", 2), (3, near, 1, "n", 2), (9, "apart from all", 1, "n", 2), (None, LONG, 1, "n", 2)]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp int, node string, component_id int"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(5, 3), (3, 3), (9, 9), (None, 3)}


def test_crowded_min_hashes_keep_their_recall(spark):
    """All texts share one of two passages, so most of their min-hashes are crowded at this bound."""
    rnd = random.Random(5)
    word = lambda: f"v{rnd.randrange(4000)}"
    passages = [[word() for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(250):
        own = [word() for _ in range(rnd.randrange(60, 200))]
        cut = rnd.randrange(len(own))
        base = own[:cut] + passages[i % 2] + own[cut:]
        rows += [" ".join(base), " ".join(word() if rnd.random() < 0.015 else w for w in base)]
    sets = [set(near_duplicates.shingles(t.encode(), 5).tolist()) for t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(rows)), "row long, text string")
    for hot, least in ((5, 0.97), (4_000, 0.99)):
        label = {r.row: r.label for r in near_duplicates.near_duplicates(df, hot=hot).collect()}
        assert sum(label[i] == label[j] for i, j in alike) >= least * len(alike) and len(alike) > 150
        assert len(set(label.values())) >= 250  # a shared passage alone links nothing


def test_crowded_min_hashes_lose_no_link(spark):
    """Pairs whose shared min-hashes are all crowded: found by prefixes, also where a prefix is crowded itself."""
    rnd = random.Random(8)
    word = lambda: f"v{rnd.randrange(4000)}"
    passage, rows = [word() for _ in range(100)], []
    for _ in range(300):
        base = passage + [word() for _ in range(rnd.randrange(40, 80))]
        rows += [" ".join(base), " ".join(word() if rnd.random() < 0.018 else w for w in base)]
    rows += [" ".join(passage + [word() for _ in range(5)]) for _ in range(30)]  # all alike
    sets = [set(near_duplicates.shingles(t.encode(), 5).tolist()) for t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(rows)), "row long, text string")
    label = {r.row: r.label for r in near_duplicates.near_duplicates(df, hot=10).collect()}
    assert len(alike) > 600 and all(label[i] == label[j] for i, j in alike)
    assert len(set(label.values())) >= 300
