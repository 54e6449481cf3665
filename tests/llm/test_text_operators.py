"""Operators 3, 5, 6, 7, 8 and 9 on small awkward tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, spans string, node string, words int, c0 string"


def _texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "the", "the", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, line = say(60), say(36)
    out = {}
    for i in range(40):
        out[i] = say(rng.randrange(0, 120))
    for i in range(40, 50):
        out[i] = say(30) + " " + shared + "\n" + say(rng.randrange(3, 40))
    out |= {50: line, 51: line + " x", 52: "y " + line, 53: out[3], 54: "", 55: None, 56: " \n\t ", 57: "a " * 300, 58: "a " * 36, 59: "b c " * 50}
    base = say(200).split()
    for i in range(60, 70):
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        out[i] = " ".join(w)
    out[70] = "\x00odd\x1f one two three"
    out[71] = "one two three"
    out[72] = "one two three"
    out[73] = ("long text " + say(5)) * 3000
    out[74] = "\x0bone\x0ctwo\rthree four five six seven"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None, "s", None, 1, "x", "n", 2, "c") for k, t in _texts().items()]
    rows.append((3, _texts()[3], "fr", None, 7, 1, "x", "n", 2, "c"))  # a repeated row but for other columns
    rows.append((None, _texts()[60], None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_substring_dedup_equals_brute_force(docs):
    from quire.llm.substrings import removal

    rows = [(i, WORD.findall(t or "")) for i, t in _rows(docs)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in removal(docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(0 < r[2] < r[1] for r in want)


@pytest.mark.parametrize("window", [2, 5, 20])
def test_substring_anchors_for_any_window(spark, window):
    from quire.llm.substrings import removal

    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    words = [(i, t.split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    want = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want[i] = sum(gone)
    got = {r["doc_id"]: r["n_removed"] for r in removal(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()}
    assert got == want


def test_substring_dedup_keeps_columns_and_clean_rows(docs):
    from quire.llm.substrings import dedup

    out = dedup(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.where("doc_id is not null and doc_id <> 3").collect()}
    assert rows[5]["text"] == _texts()[5] and rows[55]["text"] is None and rows[56]["text"] == " \n\t "
    assert rows[50]["text"] == "" and rows[51]["text"] == "x" and rows[52]["text"] == "y"
    assert rows[5]["spans"] == "x" and rows[5]["c0"] == "c"


def _jaccard_links(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-12:
                links[i].add(j)
                links[j].add(i)
    return links


def test_jaccard_classes_equal_brute_force(docs):
    from quire.llm.neardup import classes

    rows = _rows(docs)
    links = _jaccard_links(rows)
    group = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(links):
            for j in js:
                group[i] = group[j] = min(group[i], group[j])
    least = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, 10**9), rows[i][0])
    want = [(rows[i][0], least.get(g, rows[i][0]), len(links[i])) for i, g in enumerate(group)]
    got = [tuple(r)[:3] for r in classes(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(n >= 9 for _, _, n in want)


def test_jaccard_keeps_one_of_each(docs):
    from quire.llm.neardup import keep_one

    out = keep_one(docs)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert all(n == 1 for n in ids.values())
    assert {54, 55, 56} <= set(ids), "texts without words stay"
    assert len({60, 61, 62, 63, 64, 65, 66, 67, 68, 69, None} & set(ids)) == 1
    assert 71 in ids and 72 not in ids and 3 in ids and 53 not in ids


def test_jaccard_tiles_of_a_large_group(spark, monkeypatch):
    from quire.llm import neardup

    monkeypatch.setattr(neardup, "CHUNK_MEMBERS", 7)
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:50], f"e{i}", *base[51:]])) for i in range(40)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {39} and {r["n_texts"] for r in got} == {39}


def test_bayesian_pruning_thresholds():
    from quire.llm.neardup import least_matches

    least = least_matches(0.8, 1e-9)
    assert list(least) == [32, 64, 96, 128] and 0 < least[32] < 0.8 * 32 and least[128] < 0.8 * 128
    assert least[128] / 128 > least[32] / 32


def test_minhash_agreement_follows_similarity():
    from quire.llm.neardup import signatures

    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        b = np.concatenate([a[: int(2000 * share)], rng.integers(0, 2**63, 2000 - int(2000 * share)).astype(np.uint64)])
        s = signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]))
        true = share / (2 - share)
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_components_of_long_chains(spark):
    from quire.llm.neardup import components

    rng = random.Random(1)
    names = [bytes([rng.randrange(256) for _ in range(16)]) for _ in range(60)]
    edges = [(names[i], names[i + 1]) for i in range(39)] + [(names[40], names[i]) for i in range(41, 60)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in components(spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert {got[n] for n in names[:40]} == {min(names[:40])} and {got[n] for n in names[40:]} == {min(names[40:])}


ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_decontamination_equals_brute_force(spark, docs, monkeypatch):
    from quire.llm import decontaminate

    texts = _texts()
    items = [(1, texts[5]), (2, "W1 w2, the"), (2, "the É"), (3, ""), (None, "one TWO three"), (4, None), (5, texts[40]), (10, "... !"), (6, "a " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ITEM.findall(_low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    want = []
    for i, t in _rows(docs):
        w = ITEM.findall(_low(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        want.append((i, len(w), sum(hit), tuple(sorted(found))))

    def got(**kind):
        rows = decontaminate.find(docs, bench, **kind).collect()
        return [(r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), tuple(r["items"])) for r in rows]

    assert sorted(got(), key=str) == sorted(want, key=str)
    assert sorted(got(shard_bytes=500), key=str) == sorted(want, key=str), "many shards"
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 2)
    blocks = decontaminate.blocks_of
    monkeypatch.setattr(decontaminate, "blocks_of", lambda b: blocks(b, limit=300))
    assert sorted(got(), key=str) == sorted(want, key=str), "many blocks of the benchmark"


def test_suffix_order_and_index():
    from quire.llm.decontaminate import FMIndex, suffix_order

    rng = np.random.default_rng(2)
    for top, n in ((1, 60), (2, 300), (3, 400), (900, 500)):
        text = rng.integers(0, top + 1, n).astype(np.int64)
        text[-1] = 0
        key = lambda i: [(0, int(p)) if text[p] == 0 else (1, int(text[p])) for p in range(i, next(p for p in range(i, n) if text[p] == 0) + 1)]  # noqa: E731, B023
        assert suffix_order(text, top).tolist() == sorted(range(n), key=key)
        index = FMIndex(text, top)
        starts = [i for i in range(n - 2) if (text[i : i + 2] > 0).all()]
        if starts:
            pattern = text[starts[0] : starts[0] + 2][None, :]
            live, lo, hi = index.search(pattern)
            places = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert places == [i for i in starts if (text[i : i + 2] == pattern[0]).all()]


def test_decontamination_cuts_spans_only(spark, docs):
    from quire.llm.decontaminate import clean

    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    out = clean(docs, bench)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.where("doc_id > 3").collect()}
    assert rows[70] == "\x00odd\x1f " and rows[71] == "" and rows[5] == _texts()[5] and rows[55] is None and rows[74] == "\x0b four five six seven"


def test_token_counts_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quire.llm import counts

    pieces = counts.load_vocabulary(counts.default_vocabulary())
    ref = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = [(i, len(ref.encode(t or "").ids)) for i, t in _rows(docs)]
    got = [(r["doc_id"], r["n_tokens"]) for r in counts.count_tokens(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_token_counts_tie_rules():
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quire.llm.counts import Automaton, Counter

    rng = random.Random(9)
    for _ in range(20):
        names = {"".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 4))) for _ in range(9)}
        names = sorted(x for x in names if "▁" not in x[1:])
        pieces = [(x, float(-rng.randrange(0, 3))) for x in names]
        ref = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
        ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        mine = Counter(None, pieces)
        mine.automaton.unknown = Automaton([("<unk>", 0.0), *pieces]).unknown
        texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 90))) for _ in range(30)]
        assert mine(pa.array(texts))[0].tolist() == [len(ref.encode(t).ids) for t in texts]


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quire.llm.packing import pack

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack(docs).collect()
    pool = {}
    for i, t in _rows(docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pool.setdefault(i, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(pool)
    for i, ids in pool.items():
        assert sum(r["length"] for r in by_doc[i]) == sum(map(len, ids))
        for r in by_doc[i]:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    partitions = docs.rdd.getNumPartitions()
    assert len(by_seq) * 1024 - sum(r["length"] for r in rows) < 1024 * partitions


def test_packing_takes_the_cheapest_sequence_with_room():
    from quire.llm.packing import balance

    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(1, 64) for _ in range(rng.randrange(1, 60))]
        got = balance(sizes, 64, 1.0, 1 / 64)
        n = -(-sum(sizes) // 64)
        cost, room = [0.0] * n, [64] * n
        for _, _, length, seq, offset, after in got:
            open_ = [s for s in range(n) if room[s] >= length]
            assert cost[seq] == min(cost[s] for s in open_) and offset == 64 - room[seq]
            cost[seq] += length + length * length / 64
            room[seq] -= length
            assert after == cost[seq]
        covered = Counter()
        for i, start, length, *_ in got:
            covered[i] += length
            assert start + length <= sizes[i]
        assert covered == Counter(dict(enumerate(sizes)))


def test_packing_special_string_and_long_runs():
    from quire.llm.packing import Encoder, default_vocabulary

    encode = Encoder(default_vocabulary())
    for t in ("<|endoftext|>a<|endoftext|>", " " * 200_000 + "x", "a" * 100_000, "\n\n \t é日", ""):
        assert encode(t).tolist() == encode.exact(t)


def test_packing_segments_give_the_same_ids():
    from quire.llm import packing

    encode = packing.Encoder(packing.default_vocabulary())
    rng = random.Random(8)
    for _ in range(40):
        t = "".join(rng.choice(["a", "b", " ", " ", "the", " cat sat", "'s", "'", "é", "1", "\n", ".", "<|endoftext|>", "日"]) for _ in range(400))
        parts = list(packing.segments(t, 7))
        assert "".join(parts) == t and len(parts) > 3
        assert [i for x in parts for i in encode.exact(x)] == encode.exact(t)


def test_packing_ids_of_any_type(spark):
    from quire.llm.packing import pack

    rows = pack(spark.createDataFrame([("a-1", "x y"), ("a-1", "x y"), (None, None)], "doc_id string, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["None", "a-1", "a-1"] and sorted(r["doc_tokens"] for r in rows) == [1, 3, 3]


def test_quality_learns_and_scores_whole_texts(spark):
    from quire.llm import quality

    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "walked", "under", "green"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###", "win%%"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    rows += [(900, "calm " * 6000 + bad() * 40 + " calm" * 100), (901, ""), (902, None), (903, "x"), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score long, held_out long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 1), (5, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, max_rows=80)
    out = quality.score(docs, model).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by)
    held = [i for i in range(300) if by[i]["held_out"]]
    assert held and np.mean([by[i]["predicted"] == i % 2 for i in held]) > 0.95
    assert by[901]["score"] == by[902]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert by[900]["score"] < quality.score(docs.limit(0).unionByName(spark.createDataFrame([(1, "calm " * 6000, 1, 2)], docs.schema)), model).first()["score"], "junk far behind counts"
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None and quality.score(docs, None).first()["score"] == 0.5


def test_quality_learns_from_long_texts(spark):
    """All labelled texts beyond MAX_TEXT, and more labels without a row than the sample has places."""
    from quire.llm import quality

    texts = [(i, ("calm plain words here " if i % 2 else "BUY now $$$ click!! ") * 1200) for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert min(len(t) for _, t in texts) > quality.MAX_TEXT
    labels = spark.createDataFrame([(i, i % 2) for i in range(20000)], "doc_id long, quality int")
    model = quality.train(docs, labels, max_rows=40)
    assert model is not None
    out = quality.score(docs, model).collect()
    assert len(out) == 240 and all(r["predicted"] == r["doc_id"] % 2 for r in out)
    assert quality.keep(docs, model).count() == 120


def test_quality_windows_spread_over_the_text(spark):
    from quire.llm import quality

    parts, window = 16, 64
    text = "".join(chr(ord("a") + k) * 1000 for k in range(parts))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) as text")
    got = [bytes(r[0]).decode() for r in df.select(quality._windows("doc_id", "text", window)).collect()]
    assert got == ["".join(chr(ord("a") + k) * window for k in range(parts))] * 2
    off = np.array([0, 100, 356])
    assert quality._seams(np.array([0, 128]), off, np.array([0, 128])).tolist() == [*range(249, 256), *range(377, 384)]


def test_quality_segments_change_nothing(monkeypatch):
    from quire.llm import quality

    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=(256, 8)), rng.normal(size=(8, 8, 16)), rng.normal(size=16), rng.normal(size=32), 0.1)
    tables = model.tables()
    sizes = [0, 1, 7, 8, 63, 64, 65, 1000, 5000]
    data = rng.integers(0, 256, sum(sizes)).astype(np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    whole = quality.score_bytes(data, off, model, tables)
    monkeypatch.setattr(quality, "SEGMENT", 128)
    assert np.allclose(quality.score_bytes(data, off, model, tables), whole)
    single = [quality.score_bytes(data[a:b], np.array([0, b - a]), model, tables)[0] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert np.allclose(single, whole)


def test_empty_tables(spark, empty, docs):
    from quire.llm import counts, decontaminate, neardup, packing, quality, substrings

    bench = spark.createDataFrame([], "item_id long, text string")
    assert substrings.removal(empty).count() == 0 and substrings.dedup(empty).count() == 0
    assert neardup.classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    assert counts.count_tokens(empty).count() == 0 and packing.pack(empty).count() == 0
    assert quality.score(empty, None).count() == 0
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench).where(F.size("items") > 0).count() == 0
    assert decontaminate.clean(docs, bench).exceptAll(docs).count() == 0


def _thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_arithmetic_confuses(spark):
    """Two words of 1,024 letters that sum up alike modulo powers of two, whatever the base, are different words."""
    from quire.llm import counts, decontaminate, neardup, substrings

    one = _thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    line = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{line} {one}"), (2, f"{line} {two}"), (3, one), (4, two)], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in substrings.removal(docs).collect())
    assert {r["doc_id"]: r["n_links"] for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    bench = spark.createDataFrame([(7, two)], "item_id long, text string")
    assert {r["doc_id"]: len(r["items"]) for r in decontaminate.find(docs, bench).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    pieces = [("▁a", -1.0), ("a", -2.0), ("b", -2.0), ("abba", -3.0), ("ba", -2.5), ("baabab", -3.5)]
    both = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(docs.where("doc_id > 2"), pieces=pieces).collect()}
    apart = {i: counts.count_tokens(docs.where(f"doc_id = {i}"), pieces=pieces).first()["n_tokens"] for i in (3, 4)}
    assert both == apart


def test_sequences_that_arithmetic_confuses(spark):
    """The same with words in place of letters, over whole texts and long stretches."""
    from quire.llm import neardup, substrings

    one = _thue_morse(4096)
    texts = [" ".join(one), " ".join(one.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, WORD.findall(t)) for i, t in enumerate(texts)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    for r in substrings.removal(docs).collect():
        w, gone = rows[r["doc_id"]][1], set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        assert r["n_removed"] == len(gone)
    assert {r["n_texts"] for r in neardup.classes(docs).collect()} == {1}, "equal sets of shingles, different texts"


def test_scores_do_not_depend_on_neighbours(spark):
    from quire.llm.counts import count_tokens

    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(["river", "stone", "walked", "x9", "é"]) for _ in range(rng.randrange(5, 900)))
    same = say()
    docs = spark.createDataFrame([(i, same if i % 7 == 0 else say()) for i in range(200)], "doc_id long, text string").coalesce(1)
    assert len({r["score"] for r in count_tokens(docs).collect() if r["doc_id"] % 7 == 0}) == 1


@pytest.mark.parametrize("limit", [60, 1000])
def test_parts_of_long_texts_change_nothing(monkeypatch, limit):
    """Every text in many parts gives what it gives in one."""
    from quire.llm import common, counts, decontaminate, neardup, substrings

    whole = pa.array([" ".join(t for i, t in _texts().items() if t and i != 73) + "  é" * 40 + " " + "z" * 3000 + " end"])
    for overlap in (0, 4, 34):
        words, seen = [], 0
        full = next(common.parts(whole, common.SPACED, 0, 1 << 40))
        for p in common.parts(whole, common.SPACED, overlap, limit):
            text = p.data.tobytes()
            mine = [text[a:b] for a, b in zip(p.s.tolist(), p.e.tolist())]
            assert int(p.base[0]) == seen and len(mine) - int(p.own[0]) <= overlap
            words, seen = [*words[:seen], *mine], seen + int(p.own[0])
        raw = full.data.tobytes()
        assert words == [raw[a:b] for a, b in zip(full.s.tolist(), full.e.tolist())]
    one = pa.RecordBatch.from_arrays([pa.array([b"r"]), whole], ["rid", "text"])
    bench, vocabulary = [("i", "w1 w2"), ("j", _texts()[5])], decontaminate.Vocabulary()
    phrases = decontaminate.phrases(bench, vocabulary)

    class Shipped:
        def __init__(self, value):
            self.value = value

    def all_of(limit_):
        monkeypatch.setattr(substrings, "parts", lambda col, inside, overlap=0: common.parts(col, inside, overlap, limit_))
        for module in (neardup, counts):
            monkeypatch.setattr(module, "parts", substrings.parts)
        monkeypatch.setattr(decontaminate, "parts", lambda col, inside, overlap, _: common.parts(col, inside, overlap, limit_))
        node = next(neardup._nodes(iter([one]))).to_pydict()
        windows = sorted(w for b in substrings._window_rows(35)(iter([pa.RecordBatch.from_arrays([*one.columns, pa.array([[{"a": 3, "n": 700}, {"a": 900, "n": 80}]])], ["rid", "text", "ranges"])])) for w in zip(*[c.to_pylist() for c in b.columns]))
        covered = set()
        for b in substrings._anchor_rows(35)(iter([one])):
            for r in b.to_pylist():
                covered |= {(r["key"], k) for k in range(r["a"], r["a"] + r["n"])}
        spans = [{"a": 2, "b": 60}, {"a": 100, "b": 135}, {"a": 1000, "b": 1500}]
        gone = [(row, g.tolist(), [bytes(raw[x:y]) for x, y in zip(s, e)]) for row, g, raw, s, e in substrings._pieces(pa.RecordBatch.from_arrays([whole, pa.array([spans])], ["text", "spans"]), "text", "spans")]
        gone = [x for _, g, w in gone for x in zip(g, w)]
        tokens = [int(v[0]) for v in counts.Counter(counts.default_vocabulary())(whole)[:2]]
        found = decontaminate._pass(Shipped(vocabulary), [Shipped(phrases)], True, "cut", 1 << 30, 10, ["text", "n_words", "spans", "items"])
        empty = [pa.array([0]), pa.array([[]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([[]], pa.list_(pa.string()))]
        found = next(found(iter([pa.RecordBatch.from_arrays([whole, *empty], ["text", "n_words", "spans", "items"])]))).to_pydict()
        return node, windows, covered, gone, tokens, found

    assert all_of(limit) == all_of(1 << 40)


def test_memory_of_a_very_long_text():
    """A text of 48 MB takes a few times its bytes, not sixty."""
    import subprocess
    import sys

    code = """
import resource, sys
import pyarrow as pa
from quire.llm import neardup, substrings
text = "".join(f"w{i % 9973} and then x{i * 7 % 131} " for i in range(2_400_000))
b = pa.RecordBatch.from_arrays([pa.array([b"r"]), pa.array([text], pa.large_string())], ["rid", "text"])
n = len(text)
del text
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(x.num_rows for x in substrings._anchor_rows(35)(iter([b])))
words = next(neardup._nodes(iter([b]))).column(2)[0].as_py()
print(n, rows, words, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=True)
    n, rows, words, grown = map(int, out.stdout.split())
    assert n > 43 << 20 and rows and words == 4 * 2_400_000
    assert grown < 400 << 10, "kilobytes"
