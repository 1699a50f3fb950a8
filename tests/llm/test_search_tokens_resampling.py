"""Brute-force versions of ranked search and importance resampling, and token files against the tokenizers library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import ranked_search, resample, token_orc

WORDS = "anda bere Ciro dola emi fo gar hu ist jot ka lo mur na Ost pi qu ra so tu ulm vo wi xen yo zu éa ßü 中文 12 7".split()


def made(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS[: rnd.choice((5, 31))]) for _ in range(rnd.randrange(0, 60))) + rnd.choice(["", ".", " \n", "-x", "'S"])) for i in range(n)]
    copies = [(n + i, rows[7][1]) for i in range(n // 3)]
    return [*rows, *copies, (None, "anda bere"), (None, "anda bere"), (5, rows[5][1]), (5, "ka lo mur ka"), (9_000, None), (9_001, ""), (9_002, "?!"), (9_003, "na Ost " * 9_000)]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def searched(docs, items, k=10):
    terms = [split(t) for _, t in docs]
    held, total, df = sum(1 for t in terms if t), sum(map(len, terms)), Counter(t for ts in terms for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), ts in zip(docs, terms, strict=True):
            tf, m = Counter(ts), 25 + (75 * len(ts) * held) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in split(text) if tf[t])
            scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [ranked_search.BLOCK_BYTES, 300])
def test_ranked_search_equals_brute_force(spark, block_bytes):
    docs = made(1, 120)
    items = [(1, "anda bere Ciro"), (2, "éa 中文 中文 lo"), (2, "ulm"), (3, ""), (4, None), (5, "nowhere"), (None, "12 7 xen Yo"), (6, " ".join(WORDS)), (7, docs[7][1]), (8, "ka ka ka lo")]
    rows = table(spark, [(*d, 1, "q") for d in docs], "doc_id long, text string, row int, qid string")
    got = found(ranked_search.search(rows, table(spark, items, "item_id long, text string"), block_bytes=block_bytes))
    assert got == searched(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, none = table(spark, made(2, 10)), table(spark, [])
    assert found(ranked_search.search(docs, none.withColumnRenamed("doc_id", "item_id"))) == []
    assert found(ranked_search.search(none, table(spark, [(1, "anda")], "item_id long, text string"))) == []


def test_thresholds_leave_no_document_out(spark):
    """Lists whose heads hold none of the best documents: these are middling in many lists."""
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices(WORDS[:12], [rnd.random() ** 3 for _ in range(12)], k=rnd.randrange(5, 80)))) for i in range(300)] + [(1000 + i, " ".join(WORDS[:12] * 2)) for i in range(14)]
    items = [(i, " ".join(rnd.sample(WORDS[:12], 2 + i % 10))) for i in range(20)]
    for k in (1, 3, 10):
        assert found(ranked_search.search(table(spark, docs), table(spark, items, "item_id long, text string"), k)) == searched(docs, items, k)


def resampled(docs, target, percent=5, least=20):
    def features(text):
        w = split(text)
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    held = [(doc, *features(t)) for doc, t in docs]
    source, aim = Counter(b for _, _, f in held for b in f), Counter(b for t in target for b in features(t)[1])
    n, m = sum(source.values()), sum(aim.values())
    out = []
    for doc, w, f in held:
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (n + 10_000) / ((source[b] + 1) * (m + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = [i + 1 if i < percent * len(fit) // 100 else None for i in range(len(fit))]
    return sorted([(*x[:4], r) for x, r in zip(fit, rank, strict=True)] + [(*x[:4], None) for x in out if not x[4]], key=repr)


@pytest.mark.parametrize("percent", [5, 60])
def test_resampling_equals_brute_force(spark, percent):
    docs, target = made(4, 150), ["anda bere Ciro dola emi", None, "éa ßü 中文", "lo lo lo"]
    rows = table(spark, [(*d, 1, "w", 2) for d in docs], "doc_id long, text string, row int, weight string, copies int")
    got = resample.resample(rows, table(spark, [(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(docs, target, percent)


def test_resampling_of_empty_tables(spark):
    docs, none = made(5, 20), table(spark, [])
    assert resample.resample(none, none).collect() == []
    assert sorted(map(tuple, resample.resample(table(spark, docs), none).collect()), key=repr) == resampled(docs, [])


PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["ÀÖØöøÿß Straße. ciónosó×÷ª µ º È'S", "ŉ ĳ Ħ ſ", "İstanbul ΑΣ ΑΣ. ǅ", "á é́ ́x", "x y z w\x1cv\x1du\x85t", "it's IT'S 'tis don't''s", "<|endoftext|>a <|startoftext|><|endoftext|> <|endof text|>", "3.14159 12a34 ٣٤ Ⅷ", "🙂🙂 👩‍👩‍👧 ∑∆", "\t\r\n \x0b\x0c", "한국어 텍스트 ㄱㅏ", "ﬁ ſ ẞ", "a" * 5000, "!" * 3000]


def test_tokens_equal_the_library_and_lie_in_order(spark, tmp_path):
    docs = made(6, 60) + [(20_000 + i, t) for i, t in enumerate(HARD)] + [(30_000, " ".join(HARD))]
    token_orc.write(table(spark, [(*d, 1, 2) for d in docs], "doc_id long, text string, start int, ids int"), f"{tmp_path}/t", PATH)
    library = Tokenizer.from_file(PATH)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    rows = sorted(token_orc.read(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    at, wanted = 0, defaultdict(list)
    for d, t in docs:
        wanted[d].append(ids(t))
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        wanted[r.doc_id].remove(r.ids)
        at += r.n_tokens
    assert not any(wanted.values())
    import struct

    sums = {(r.start, r.ids_crc32) for r in token_orc.checksums(token_orc.read(spark, f"{tmp_path}/t")).collect()}
    assert sums == {(r.start, zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) for r in rows}


def test_token_files_are_pruned_by_doc_id(spark, tmp_path):
    token_orc.write(table(spark, [(i * 2, f"anda bere {i}") for i in range(6000)]), f"{tmp_path}/t", PATH)
    one = token_orc.read(spark, f"{tmp_path}/t").where("doc_id = 4000")
    assert "EqualTo(doc_id,4000)" in one._jdf.queryExecution().executedPlan().toString()
    library = Tokenizer.from_file(PATH)
    assert [(r.doc_id, r.ids) for r in one.collect()] == [(4000, [*library.encode("anda bere 2000", add_special_tokens=False).ids, 2])]
    assert token_orc.read(spark, f"{tmp_path}/t").where("doc_id = 4001").collect() == []
    files = sorted((tmp_path / "t/tokens").glob("*.orc"))
    assert len(files) > 1
    last = -1
    for f in files:
        ids = pyarrow.orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).toString()
    assert "BLOOM_FILTER" in streams and "ROW_INDEX" in streams


def test_no_documents_no_tokens(spark, tmp_path):
    token_orc.write(table(spark, []), f"{tmp_path}/t", PATH)
    assert token_orc.checksums(token_orc.read(spark, f"{tmp_path}/t")).collect() == []


def test_another_vocabulary_is_refused(spark):
    with pytest.raises(ValueError, match="cross white space"):
        token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_remembered_pieces_stay_within_their_bytes(monkeypatch):
    monkeypatch.setattr(token_orc, "PIECE_BYTES", 20_000)
    monkeypatch.setattr(token_orc, "WORD_BYTES", 20_000)
    own = token_orc.Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    for i in range(300):
        text = f"w{chr(97 + i % 26) * (i % 30)} x{i % 7} {'y' * (i % 90)}" + (" ∑" if i % 2 else "")
        assert own.encode(text) == b"".join(x.to_bytes(4, "little") for x in library.encode(text, add_special_tokens=False).ids)
        assert own.pieces.bytes <= 10_000 and own.words.bytes <= 10_000
