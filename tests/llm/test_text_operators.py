import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, ctw, harmonic, idfile, jaccard, lyndon, phrases, repeats, toxicity
from ledgerlight.llm.common import components, saved
from ledgerlight.llm.tokens import encoder, vocabulary

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def texts_of(df):
    return {r.doc_id: (r.text or "") for r in df.where("doc_id IS NOT NULL").collect()}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# toxicity


@pytest.fixture(scope="module")
def insults(spark):
    rows, labels = [], []
    for k in range(300):
        y = int(k % 5 == 0)
        words = [f"w{(k * 31 + j * 17) % 50}" for j in range(30)]
        if y:
            words[k % 30] = ("idiot", "vile" + "abcdefgh"[k % 8])[k // 5 % 2]
        words[10] += "."
        rows.append((k, " ".join(words)))
        labels.append((k, 1, y))
    rows += [(900, None), (901, ""), (None, "idiot")]
    labels += [(900, None, None), (1234, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_sentences(insults):
    docs, labels = insults
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 302
    for k in range(300):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= got[k].score <= 1 and got[k].predicted == int(got[k].score >= 0.5)
    held = [k for k in range(300) if got[k].held_out]
    assert np.mean([got[k].predicted == int(k % 5 == 0) for k in held]) > 0.97
    assert got[900].n_sentences == 0 and got[901].worst_start is None and got[901].score < 0.5
    text = {r.doc_id: r.text for r in docs.collect()}
    worst = text[5].encode()[got[5].worst_start : got[5].worst_end].decode()
    assert "idiot" in worst or "vile" in worst


def test_toxicity_without_labels_or_documents(insults):
    docs, labels = insults
    prior = toxicity.classify(docs, labels.where("toxic > 5")).select("predicted").distinct().collect()
    assert [r[0] for r in prior] == [0]
    assert toxicity.classify(docs.where("doc_id < 0"), labels).count() == 0


# language model


def test_ctw_baseline_and_gain(spark, corpus):
    docs = corpus.where("doc_id IS NOT NULL")
    words = {d: t.encode().translate(LOWER).split() for d, t in texts_of(docs).items()}
    counts = collections.Counter()
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    got = ctw.score(corpus).collect()
    assert len(got) == len(words)
    for r in got:
        w = [*words[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and r.n_bytes == len(b" ".join(words[r.doc_id])) + 1
    assert ctw.score(docs.where("doc_id < 0")).count() == 0


def brute_ctw(train: list[bytes], depth: int):
    """Counts, then the recursion from the definition, for one context tree per place in the byte's tree."""
    n = collections.defaultdict(lambda: [0, 0])
    for t in train:
        t = b"\0" * depth + t
        for i in range(depth, len(t)):
            for j in range(8):
                place = (1 << j) | (t[i] >> (8 - j))
                for d in range(depth + 1):
                    n[t[i - d : i], place][t[i] >> (7 - j) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below = collections.defaultdict(float)
    pw = {}
    for s, place in sorted(n, key=lambda x: -len(x[0])):
        pe = kt(*n[s, place])
        pw[s, place] = pe if len(s) == depth else float(np.logaddexp(math.log(0.5) + pe, math.log(0.5) + below[s, place]))
        if s:
            below[s[1:], place] += pw[s, place]

    def bit(s, place):
        if (s, place) not in n:
            return 0.5
        a, b = n[s, place]
        own = (b + 0.5) / (a + b + 1)
        if len(s) == depth:
            return own
        w = math.exp(math.log(0.5) + kt(a, b) - pw[s, place])
        deeper = bit(HISTORY[0][len(HISTORY[0]) - len(s) - 1 :], place)
        return w * own + (1 - w) * deeper

    HISTORY = [b""]

    def log10(t: bytes) -> float:
        t, out = b"\0" * depth + t, 0.0
        for i in range(depth, len(t)):
            HISTORY[0] = t[i - depth : i]
            for j in range(8):
                p = bit(b"", (1 << j) | (t[i] >> (8 - j)))
                out += math.log10(p if t[i] >> (7 - j) & 1 else 1 - p)
        return out

    return log10


def test_ctw_is_the_recursion(spark, monkeypatch):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "zzz the mat", "dog log cat", "on the cat", "mat", "", "the cats sat on a matter"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    normal = [(b" ".join(t.encode().split()) + b"\n") for t in texts]
    model = brute_ctw([x for k, x in enumerate(normal) if zlib.crc32(str(k).encode()) % 7 != 2], ctw.DEPTH)
    want = {k: model(x) for k, x in enumerate(normal)}
    for size in (10**9, 7):
        monkeypatch.setattr(ctw, "BLOCK", size)
        assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-6) for r in ctw.score(df).collect())


def test_ctw_does_not_depend_on_partitions(spark, corpus):
    one, other = (sorted(tuple(r) for r in ctw.score(x).collect()) for x in (corpus.repartition(1), corpus.repartition(7, "text")))
    assert one == other


def test_ctw_adds_rows_of_one_document(spark):
    texts = ["some words here", "more words", "some words here"]
    twice = {r.doc_id: r for r in ctw.score(spark.createDataFrame([(1, texts[0]), (1, texts[1]), (5, texts[2])], "doc_id long, text string")).collect()}
    assert twice[1].n_tokens == 7 and twice[5].n_tokens == 4 and twice[1].train_tokens == sum(t.n_tokens for t in twice.values() if not t.held_out)


def test_ctw_without_training(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = ctw.score(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, 8 * 5 * math.log10(0.5), rel_tol=1e-6)


# substring removal


def brute_words(texts: dict, window: int) -> dict:
    seen, out = set(), {}
    for d in sorted(texts):
        w = texts[d].encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), sha(b" ".join(kept)))
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_phrases(corpus, empty, crowd, monkeypatch):
    monkeypatch.setattr(phrases, "CROWD", crowd)
    want = brute_words(texts_of(corpus), 20)
    got = phrases.remove(corpus, with_text=True, carried=("lang", "place")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and sum(x[1] for x in want.values()) > 300
    assert all(r.lang == "en" for r in got) and all(r.kept == t for r in got for t in [texts_of(corpus)[r.doc_id]] if not r.n_removed)
    assert phrases.remove(empty).count() == 0
    twice = corpus.where("doc_id = 0")
    assert [r.n_removed for r in phrases.remove(twice.union(twice)).collect()] == [0, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1), st.integers(0, 3), st.integers(0, 3)), max_size=30), st.lists(st.integers(0, 30), max_size=4), st.booleans())
def test_recurring_windows_over_batches(rows, cuts, keep_first):
    import pyarrow as pa

    rows = sorted(rows)
    cuts = sorted({0, *(c for c in cuts if c < len(rows)), len(rows)})
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in range(4)], names=["h1", "h2", "doc_id", "at"]) for a, b in zip(cuts[:-1], cuts[1:])]
    got = sorted((d, p >> 24) for b in repeats.recurring(keep_first)(iter(batches)) for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    places = collections.defaultdict(set)
    for a, b, d, x in rows:
        places[a, b].add((d, x))
    want = sorted(p for v in places.values() if len(v) > 1 for p in (sorted(v)[1:] if keep_first else v))
    assert sorted(set(got)) == sorted(set(want))


def test_phrases_in_many_automata(corpus, monkeypatch):
    import pyarrow as pa

    texts = texts_of(corpus)
    rows, unit = [], repeats.Words
    for d, t in sorted(texts.items()):
        data = np.frombuffer(t.encode(), np.uint8)
        symbols, first, starts, ends = unit.symbols(data, np.array([0, len(data)]))
        for row, place, n, dist, anchor, content in zip(*repeats.segments(symbols, first, 20, 8)):
            rows.append((int(anchor.astype(np.int64)), d, int(repeats.packed(place, n, dist)), data[starts[place] : ends[place + n + 18]].tobytes()))
    table = pa.table({"anchor": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "place": [r[2] for r in rows], "what": [1] * len(rows), "text": pa.array([r[3] for r in rows], pa.binary())})
    one = set(phrases.shard(table, 20))
    monkeypatch.setattr(phrases, "PATTERNS", 50)
    many = set(phrases.shard(table, 20))

    def windows(found):
        return {(d, s) for d, p in found for at, n, _ in [repeats.unpacked(np.int64(p))] for s in range(at, at + n)}

    assert windows(one) == windows(many) and one


def brute_bytes(texts: dict, window: int) -> dict:
    raw = {d: t.encode() for d, t in texts.items()}
    count = collections.Counter(b[i : i + window] for b in raw.values() for i in range(len(b) - window + 1))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out[d] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("window,gram", [(400, 200), (60, 20)])
@pytest.mark.parametrize("crowd", [4096, 1])
def test_lyndon_remove(corpus, empty, window, gram, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    docs = corpus
    got = lyndon.remove(docs, window, gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(texts_of(docs), window)
    assert lyndon.remove(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert lyndon.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_first_least(values, width):
    x = np.array(values)
    got = repeats.first_least(x, width) if len(x) >= width else np.zeros(0)
    assert list(got) == [i + int(x[i : i + width].argmin()) for i in range(len(x) - width + 1)]


# similarity


def shingles(text: str) -> frozenset:
    w = text.encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(sets: dict) -> dict:
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("shard", [2048, 2])
def test_jaccard(corpus, empty, shard):
    sets = {d: shingles(t) for d, t in texts_of(corpus).items()}
    want = brute_groups(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(corpus, shard=shard).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets} and len(set(want.values())) < len(want) - 3
    if shard > 2:
        assert jaccard.similar(empty).count() == 0


@pytest.mark.parametrize("shard", [2048, 2])
def test_jaccard_counts_links(corpus, empty, shard):
    sets = {d: shingles(t) for d, t in texts_of(corpus).items()}
    want = {d: sum(d != e and bool(s and t) and 4 * len(s & t) >= 3 * len(s | t) for e, t in sets.items()) for d, s in sets.items()}
    got = {r.doc_id: r.n_links for r in jaccard.similar(corpus, shard=shard, links=True).collect()}
    assert got == want and max(want.values()) > 2
    if shard > 2:
        assert jaccard.similar(empty, links=True).count() == 0


def test_jaccard_counts_links_of_rows(spark):
    """Rows of one doc_id count apart; the text of one is another document's."""
    a, near, b = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("a", 59), ("b", 60)))
    rows = [(3, a), (5, a), (5, b), (5, b), (7, near), (8, b), (9, None)]
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect())
    assert got == sorted([(3, 3, 2), (5, 3, 2), (5, 3, 2), (5, 3, 2), (7, 3, 2), (8, 3, 2), (9, 9, 0)])


def test_jaccard_at_the_threshold(spark):
    # 3 of 4 shingles is a link, 2 of 3 is not
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "q r s t u v w"), (4, "q r s t u v"), (5, "A  B C D E F G H"), (6, "x"), (7, "X")]
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 6}


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_signature_tree_loses_nothing(seed):
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for k in range(80):
        b = base[k % 6]
        keep = b[r.random(len(b)) < r.uniform(0.6, 1)]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, r.integers(0, 12), dtype=np.uint64)])))
    sizes, keys = np.array([len(s) for s in sets]), np.array([jaccard.sort_keys(s) for s in sets])
    tree = jaccard.SignatureTree(sizes, np.array([jaccard.bitmap(s, 4) for s in sets]), np.lexsort((keys[:, 1], keys[:, 0])), fan=4)
    got = {tuple(sorted((int(a), int(b)))) for i, j in tree.pairs(75) for a, b in zip(i, j)}
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if jaccard.overlap_linked(sets, np.array([a]), np.array([b]), 75)[0]}
    left, right = (np.array(x) for x in zip(*((a, b) for a in range(80) for b in range(a + 1, 80))))
    brute = [4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b])) for a, b in zip(left, right)]
    assert jaccard.overlap_linked(sets, left, right, 75).tolist() == brute
    assert want <= got


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


# tokens


def test_encoder_equals_library(corpus):
    e = encoder(vocabulary("byte_bpe_50k.json"))
    texts = [*texts_of(corpus).values(), "\n\n\nx", "a.\nB,\n", " a", "a ", "a  b   c", "a \nb\n c", "\0x y", "<|endoftext|> a", "'s 't x's", "é à x", "x. y.. z?!\nA\n"]
    for got, want in zip(e.encode(texts), e.whole(texts)):
        assert np.array_equal(got, want)


def test_packing(corpus, empty):
    e = encoder(vocabulary("byte_bpe_50k.json"))
    ids = {d: np.append(x, np.uint32(0)) for (d, t) in texts_of(corpus).items() for x in e.whole([t])}
    rows = [r.asDict() for r in harmonic.pack(corpus, with_ids=True).collect()]
    for d, want in ids.items():
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert np.array_equal(np.concatenate([r["ids"] for r in own]), want)
        assert all(r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in b] == list(np.cumsum([0, *(r["length"] for r in b)])[:-1])
        assert sum(r["length"] for r in b) <= 1024
    assert harmonic.pack(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_bins(sizes):
    bins, full = harmonic.Bins(1024), []
    for n in sizes:
        assert sum(harmonic.cuts(n)) == n
        for m in harmonic.cuts(n):
            if b := bins.put(m, None):
                assert len(b) == 1024 // b[0][0]
                full.append(b)
    full += bins.close()
    assert sum(x for b in full for x, _ in b) == sum(sizes) and all(sum(x for x, _ in b) <= 1024 for b in full)


def test_id_files(spark, corpus, empty):
    e = encoder(vocabulary("byte_bpe_50k.json"))
    folder = idfile.write(corpus.union(corpus.where("doc_id = 0")))
    got = sorted(idfile.read(spark, folder, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start))
    texts, start = texts_of(corpus), 0
    for r, d in zip(got, sorted([*texts, 0])):
        want = np.append(e.whole([texts[d]])[0], np.uint32(0))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (d, start, len(want), zlib.crc32(want.tobytes()), want.tolist())
        start += len(want)
    assert idfile.read(spark, idfile.write(empty)).count() == 0


def test_id_file_finds_one_document(tmp_path):
    w = idfile.Writer(f"{tmp_path}/x.ids", b"", 4)
    for d in (3, 5, 9):
        w.add(d, np.arange(d, dtype="<u4"))
    w.close()
    r = idfile.Reader(f"{tmp_path}/x.ids", b"")
    assert r.find(5).tolist() == [0, 1, 2, 3, 4] and r.find(4) is None
    with pytest.raises(ValueError):
        idfile.Reader(f"{tmp_path}/x.ids", b"another")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_bpe(corpus, empty, library):
    for r in bpe.code(corpus, with_output=True).collect():
        ids = library.encode(texts_of(corpus)[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == text and r.n_tokens == len(ids)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))
    assert bpe.code(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200))
def test_bpe_any_text(text):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    if not hasattr(test_bpe_any_text, "t"):
        test_bpe_any_text.t = Tokenizer.from_file(path)
    ids = test_bpe_any_text.t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.coder(path).code([text])[0][0], "<u4").tolist() == ids


def test_bpe_every_character(library):
    """Each character between marks and between letters, those of later Unicode versions included."""
    coder = bpe.Coder(vocabulary("word_bpe_49k.json"))
    for a in range(1, 0x110000, 1 << 15):
        texts = [x + chr(c) + x for c in range(a, min(a + (1 << 15), 0x110000)) if not 0xD800 <= c < 0xE000 for x in (":", "a")]
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [t for t, (ids, _), w in zip(texts, coder.code(texts), want) if np.frombuffer(ids, "<u4").tolist() != w.ids] == []


def test_bpe_later_characters_are_looked_up():
    """The quick pattern leaves none out, and assigned characters cost a look-up each: 2^20 took a second before."""
    import time

    coder = bpe.Coder(vocabulary("word_bpe_49k.json"))
    assert [c for c in range(0x110000) if coder.later(chr(c)) != bool(coder.unassigned.match(chr(c)))] == []
    begin = time.process_time()
    assert not coder.later("naïve 日本語 žluťoučký " * (1 << 16))
    assert time.process_time() - begin < 0.5


def test_bpe_words_and_ids_take_the_machines(monkeypatch, library):
    """Every symbol of every new word enters a transducer, and decoded texts come out of a decoder fed with the ids."""
    fed, decoded = [], []
    feed, decode = bpe.Transducer.feed, bpe.Decoder.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, symbols: (fed.append(len(symbols)), feed(self, symbols))[1])
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, ids, final=False: (decoded.append(list(ids)), decode(self, ids, final))[1])
    texts = ["short words don't differ </w> x</w>", "naïve 日本語 <|endoftext|> x", "", "ab" * 20000 + " tail " + "q" * 700]
    got = bpe.Coder(vocabulary("word_bpe_49k.json")).code(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == want == decoded
    assert [text.decode() for _, text in got] == [library.decode(i, skip_special_tokens=False) for i in want]
    words = set("short words don 't differ </ w > x naïve 日本語 tail".split()) | {"ab" * 20000, "q" * 700}
    assert sum(fed) >= sum(len(w.encode()) for w in words)


def test_bpe_long_texts_in_slices(monkeypatch, library):
    monkeypatch.setattr(bpe.Coder, "SLICE", 50)
    c = bpe.Coder(vocabulary("word_bpe_49k.json"))
    texts = ["Some words é e\u0301 x\n\n y <|endoftext|> and  more don't we'll " * 9, "q" * 300, "ab cd", "", "日本 " * 60 + "ΑΣ σ Σ a b " * 20]
    for t, (n, a, b, ids, text) in zip(texts, c.coded(texts, True)):
        want = library.encode(t, add_special_tokens=False).ids
        assert (n, np.frombuffer(ids, "<u4").tolist(), text.decode()) == (len(want), want, library.decode(want, skip_special_tokens=False))
        assert (a, b) == (sha(ids), sha(text))


def test_bpe_repeated_rows(spark):
    got = bpe.code(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 2]


def naive(symbols: list[int], rules: list[tuple[int, int, int]]) -> list[int]:
    ids = list(symbols)
    rank = {(a, b): k for k, (a, b, _) in reversed(list(enumerate(rules)))}
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
        if found is None:
            return ids
        ids[found[1] : found[1] + 2] = [rules[found[0]][2]]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_transducer_emits_final_tokens(data):
    """Random merge lists: what is emitted early equals the whole text's tokens, with the lookahead computed."""
    length, rules = {0: 1, 1: 1, 2: 1}, []
    for c in range(3, 3 + data.draw(st.integers(1, 10))):
        a, b = data.draw(st.sampled_from(sorted(length))), data.draw(st.sampled_from(sorted(length)))
        if any(r[:2] == (a, b) for r in rules):
            continue
        rules.append((a, b, c))
        length[c] = length[a] + length[b]
    m = bpe.Merges(rules, length)
    size = np.array([length.get(k, 1) for k in range(max(length) + 1)])
    text = data.draw(st.lists(st.integers(0, 2), max_size=120))
    machine = bpe.Transducer(m, size, block=2)
    out = [x for part in machine.feed(np.array(text, np.int64)) for x in part.tolist()] + machine.finish().tolist()
    assert out == naive(text, rules)


def test_decoder_over_calls(library):
    t = encoder(vocabulary("byte_bpe_50k.json")).library
    text = "naïve 日本語 😀"
    ids = t.encode(text, add_special_tokens=False).ids
    names = [t.id_to_token(k) for k in range(t.get_vocab_size())]
    d = bpe.Decoder(names, byte_level=True)
    assert "".join(d.feed([i]) for i in ids) + d.feed([], True) == text
    w = library.encode("two words", add_special_tokens=False).ids
    d = bpe.Decoder([library.id_to_token(k) for k in range(library.get_vocab_size())])
    assert "".join(d.feed([i]) for i in w) == library.decode(w)


def test_saved_is_shared(spark):
    df = saved(spark.range(3))
    assert df.count() == 3 and df.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir"))
