import hashlib
import random
import zlib
from itertools import combinations

import pytest
import xxhash

from loomgraph.llm import decontaminate, exact_dedup, interleave, simhash

SCHEMA = "doc_id long, text string, source string, n_words string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


CASES = [(1, "Ab c", "a"), (2, "aB C", "a"), (3, None, None), (4, "", "b"), (5, "É", "b"), (6, "é", "b"), (6, "é", "b"), (None, "ab c", "a"), (9, "x" * 300_000, "a"), (8, "x" * 300_000, "a")]


def plain(rows):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for _, t, _ in rows]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep):
    found = exact_dedup.exact_dedup(docs(spark, CASES).drop("keep_id"), keep).collect()
    texts = plain(CASES)
    want = []
    for (i, _, _), t in zip(CASES, texts, strict=True):
        ids = [j for (j, _, _), u in zip(CASES, texts, strict=True) if u == t]
        best = (min if keep == "min" else max)([j for j in ids if j is not None])
        want.append((i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in found)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, []).drop("keep_id")).count() == 0


def test_trie_spills_and_counts():
    trie, seen, r = exact_dedup.PatriciaTrie("max"), {}, random.Random(1)
    for i in range(3000):
        key = bytes(r.choice(b"ab") for _ in range(r.randrange(9)))
        trie.insert(key, i)
        o, c = seen.get(key, (i, 0))
        seen[key] = (max(o, i), c + 1)
    assert {k: (o, c) for k, o, c in trie.items()} == seen and trie.n == len(seen)


def brute_print(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\r\x0b\x0c"}).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    rows = []
    for i in range(200):
        w = r.choice(base).split()
        if r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(["other", "Alpha"])
        rows.append((i, " ".join(w), "s"))
    rows += [(300, None, "s"), (301, " \n", "s"), (302, "\x85one two", "s"), (None, base[0], "s"), (303, base[0], "s"), (303, base[0], "s")]
    found = {(x.doc_id, x.fp & (2**64 - 1), x.component_id) for x in simhash.simhash_components(docs(spark, rows)).collect()}
    fps = [brute_print(t or "") for _, t, _ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            up[top(i)] = top(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    assert found == {(d, fps[i], least[top(i)]) for i, (d, _, _) in enumerate(rows)}


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_masks_cover_all_pairs_within_the_radius(blocks):
    r = random.Random(blocks)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randrange(5)):
            y ^= 1 << b
        assert any(x & m == y & m for m in simhash.masks(4, blocks))


def test_bk_tree_components_equal_brute_force():
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(5)]
    values = {r.choice(centres) ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(500)} | {r.getrandbits(64) for _ in range(100)}
    tree, values = simhash.BKTree(4), sorted(values)
    for v in values:
        tree.add(v)
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 4:
            up[top(i)] = top(j)
    ours, theirs = {}, {}
    for i in range(len(values)):
        ours.setdefault(tree.find(i), set()).add(i)
        theirs.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    assert sorted(values[i] for i in tree.within(centres[0])) == [v for v in values if (v ^ centres[0]).bit_count() <= 4]


def test_simhash_empty(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, None), (4, "..."), (None, "without id"), (2, "Zwölf")]


@pytest.mark.parametrize("block_bytes", [16 << 20, 30])
def test_decontaminate(spark, block_bytes):
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, source string")
    rows = [(1, "x one two, three four five six seven eight nine TEN eleven. twelve", "a"), (2, "one two three four five six seven eight nine", "a"), (3, None, "a"), (4, "", "a"), (5, "a short item without id", None), (None, "zwölf", "a"), (7, "clean", "a"), (7, "clean", "a")]
    found = decontaminate.decontaminate(docs(spark, rows), bench, block_bytes=block_bytes)
    got = sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated, r.keep_id)) for r in found.collect())
    want = [(1, 13, 11, ["1"], True), (2, 9, 0, [], False), (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 5, 4, ["2"], True), (None, 1, 1, ["2"], True), (7, 1, 0, [], False), (7, 1, 0, [], False)]
    assert got == sorted(repr((*w, "y")) for w in want)


def test_clean(spark):
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    d = docs(spark, [(1, "a Short, item; b", "s"), (2, "fine", "s"), (3, None, "s")])
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [2, 3]
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(d, bench, remove="spans").collect()) == [(1, "a ; b"), (2, "fine"), (3, None)]
    assert decontaminate.decontaminate(d, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("n", [0, 17, 2503])
def test_interleave(spark, n):
    r = random.Random(4)
    rows = [(i if r.random() < 0.95 else None, r.choice([None, "", "é" * r.randrange(5)]), r.choices(["hot", "b", None], [90, 9, 1])[0]) for i in range(n)]
    found = interleave.interleave(docs(spark, rows), 40).collect()
    assert len(found) == n
    slots = {}
    for x in found:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted((x.size, x.text_crc32) for x in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    for s in ("hot", "b"):
        share = sum(1 for _, _, y in rows if y == s) / max(n, 1)
        assert all(abs(sum(1 for x in found if x.shard == k and x.source == s) - share * sizes[k]) < 2.01 for k in range(40))


def test_owner_tries_hold_many_strings():
    keys = [b"abc", b"abd", b"ab", b"xyz" * 50, b"", b"abc"]
    rows = sorted((len(k), hashlib.sha256(k).hexdigest(), k, i, 1) for i, k in enumerate(keys))
    for limit, least, most in ((1 << 20, 1, 1), (2, 2, 4)):
        found = list(exact_dedup.tries(rows, "max", limit))
        assert least <= len(found) <= most
        assert sorted(x for t in found for x in t.items()) == sorted([(b"", 4, 1), (b"ab", 2, 1), (b"abc", 5, 2), (b"abd", 1, 1), (b"xyz" * 50, 3, 1)])


def test_crowded_simhash_shards_are_dealt_on(spark):
    r = random.Random(31)
    centre = r.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for _ in range(300)} | {r.getrandbits(64) for _ in range(40)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")

    def groups(pairs):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[top(a)] = top(b)
        out = {}
        for x in list(up):
            out.setdefault(top(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    mixed = {v: ((v * simhash.MIX) & (2**64 - 1)) for v in values}
    mixed = {v: m - (1 << 64) if m >> 63 else m for v, m in mixed.items()}
    want = groups((mixed[a], mixed[b]) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4)
    for hot in (200_000, 5):
        assert groups(tuple(x) for x in simhash.links(nodes, 4, 6, hot).collect()) == want


def test_long_items_are_cut_and_blocks_are_scanned_in_turn(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 80)))) for i in range(12)] + [(20, "solo")]
    texts = [" ".join([*r.choices(words, k=5), *t.split()[a : a + r.randrange(8, 30)], *r.choices(words, k=3)]) for _, t in items for a in (0, 3, 11)] + ["w1 " * 30_000 + items[3][1], ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        w, hit, found = t.split(), set(), set()
        for k, item in items:
            v = item.split()
            n = min(10, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    found.add(str(k))
        want.append((i, len(w), len(hit), sorted(found)))
    for size in (192 << 20, 6000):
        got = decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
        assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got.collect()) == want
    assert decontaminate.decontaminate(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_trie_spills_by_subtree():
    r, trie, want, got = random.Random(8), exact_dedup.PatriciaTrie("min"), {}, {}
    limit = 40 * exact_dedup.NODE_BYTES

    def take(items):
        for k, o, c in items:
            a, b = got.get(k, (o, 0))
            got[k] = (min(a, o), b + c)

    for i in range(4000):
        key = bytes(r.choice(b"abcd") for _ in range(r.randrange(7)))
        trie.insert(key, i)
        o, c = want.get(key, (i, 0))
        want[key] = (min(o, i), c + 1)
        if trie.size > limit:
            take(trie.spill(limit // 2))
            assert trie.size <= limit // 2 and trie.n == len(list(trie.items())) and trie.size == sum(trie.weights.values())
    take(trie.items())
    assert got == want
