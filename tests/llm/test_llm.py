"""Operators on training text against brute-force versions, on odd rows and on supplied tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.llm import ann, bpe, common, decision_list, neardup, packing, quality, sharding, suffix_tree, text_stats, token_counts, toxicity

from ..conftest import SF_ORACLE, SF_SMALL

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "The same words here"), (5, "the SAME\twords here"), (6, "x" * 5000),
       (7, "İstanbul ΣΑΣ don't \x1c ﬁ 🙂<|endoftext|>abc 日本 H̱"), (7, "İstanbul ΣΑΣ don't \x1c ﬁ 🙂<|endoftext|>abc 日本 H̱"),
       (8, "word " * 3000), (9, "a b c d e f g h i a b c d e f g h"), (None, "no id at all")]


@pytest.fixture(scope="module")
def odd(spark):
    common.table(spark, SF_SMALL, "documents")  # lets workers find the package
    rows = [(i, t, "en", "s", 0, "x", i, 0.0) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + ", score string, row long, n double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF_SMALL, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_library(spark, docs, odd, library):
    for df in (docs, odd):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))] += 1
        got = bpe.encode_documents(df)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
        again = bpe.decode_ids(got)
        assert collections.Counter((r.doc_id, r.text) for r in again.collect()) == collections.Counter((i, t) for i, _, t in want.elements())


def test_bpe_random_words(library):
    rng, coder = random.Random(1), bpe.WordBpe(bpe.default_path())
    letters = [chr(c) for c in range(0x20, 0x24F)] + [chr(c) for c in range(0x250, 0x3000)] + list("aeiouth ing' ") * 300
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(40))
        words = coder.words(t)
        coder.learn([words])
        assert " ".join(coder.cache[w][1] for w in words) == " ".join(map(str, library.encode(t, add_special_tokens=False).ids)), t


def test_bpe_texts_at_once(library, monkeypatch):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x20, 0x24F)] + [chr(c) for c in range(0x250, 0x3000)] + list("aeiouth ing' ,. ") * 300
    odd = ["J\u030c", "\x00", "<|endoftext|>", "<|startoftext|>", "<|", "'s,", "\u3000", "\x1c", "...", ",,,", "A."] * 20
    for room in (bpe._IDS, 40, 1):
        monkeypatch.setattr(bpe, "_IDS", room)
        coder = bpe.WordBpe(bpe.default_path())
        for _ in range(10):
            texts = ["".join(rng.choice(letters + odd) for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(25)]
            ids, counts = coder.encode_texts([t.encode() for t in texts])
            stops = np.cumsum(counts)
            assert stops[-1] == len(ids)
            for t, stop, n in zip(texts, stops, counts, strict=True):
                assert ids[stop - n:stop].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_bpe_learns_a_word_once_whatever_sign_ends_it(monkeypatch):
    coder, learnt = bpe.WordBpe(bpe.default_path()), []
    plain = coder.encode_pretokens
    monkeypatch.setattr(coder, "encode_pretokens", lambda p: learnt.extend(p) or plain(p))
    for texts in ([b"wombatry, wombatry. wombatry", b"wombatry."], [b"wombatry,\nwombatry"]):
        coder.encode_texts(texts)
    assert sorted(learnt) == [b",", b".", b"wombatry"]
    held = sum(v.nbytes for v in vars(coder.ids).values() if isinstance(v, np.ndarray))
    assert held <= 64 * coder.ids.room  # a str, its ids as bytes and their place in a dict took some 200


def test_tasks_give_memory_back(spark, monkeypatch):
    class Frame:
        repartition = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, task, schema):  # noqa: N802
            return task

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("task"))
    assert list(neardup._sorted_map(Frame(), "node", lambda batches: iter([1, 2]), "x long")(iter([]))) == [1, 2] and calls == ["task"]
    monkeypatch.setattr(bpe, "give_back", lambda: calls.append("tables"))
    monkeypatch.setattr(bpe, "_loaded", {})
    bpe.loaded(bpe.default_path())
    assert calls == ["task", "tables", "tables"]


def test_op10_digests(spark, docs, texts, library):
    from kindling.llm.queries import QUERIES

    for r in QUERIES["op10_bpe"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_differencing_keeps_all_and_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 512, 700)
    way = packing.difference_partition(sizes, 40)
    sums = np.bincount(way, sizes, minlength=40)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 512
    way = packing.pack_sizes(sizes, 4096)
    assert np.bincount(way, sizes).max() <= 4096 and way.max() + 1 <= -(-sizes.sum() // 4096) + 2
    assert packing.pack_sizes(np.zeros(0, np.int64), 8).tolist() == []
    best = min(max(sum(s for s, w in zip((8, 7, 6, 5, 4), ways, strict=True) if w == k) for k in (0, 1)) for ways in itertools.product((0, 1), repeat=5))
    assert np.bincount(packing.difference_partition(np.array([8, 7, 6, 5, 4]), 2), (8, 7, 6, 5, 4)).max() <= best + 1


def test_packing(spark, docs, odd, empty, library):
    for df in (docs, odd):
        rows = [r.asDict() for r in packing.pack_documents(df).collect()]
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            want[(r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (2,))] += 1
        by_seq, length = collections.defaultdict(list), collections.Counter()
        for r in rows:
            by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
            length[r["doc_id"]] += r["length"]
        for parts in by_seq.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 4096
        assert length == collections.Counter({i: sum(len(ids) * n for (j, ids), n in want.items() if j == i) for i, _ in want})
        crcs = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        of = collections.defaultdict(list)
        for (i, ids), n in want.items():
            of[i].append((ids, n))
        for (i, start, n, crc), times in crcs.items():
            assert any(zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()) == crc and k == times for ids, k in of[i])
    assert packing.pack_documents(empty).count() == 0
    full = packing.pack_documents(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.avg("n")).first()[0]
    assert full > 0.97 * 4096


def _cut(word, pieces, unknown):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        size = len(word[j - 1].encode())
        found = [(best[j - 1][0] + size * unknown, best[j - 1][1] + size)]
        found += [(best[i][0] + pieces[word[i:j]], best[i][1] + 1) for i in range(j) if word[i:j] in pieces]
        top = max(x for x, _ in found)
        best.append((top, min(n for x, n in found if x == top)))
    return best[-1]


def test_token_counts(spark, docs, odd, empty):
    pieces = token_counts.ranked_pieces(token_counts.default_path())
    counter = token_counts.TrieCounter(pieces)
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrstßé日🙂,.") for _ in range(rng.randint(1, 25))) for _ in range(400)] + ["the", "a", "thea"]
    tokens, score, nodes = counter.count(words)
    want = [_cut("▁" + w, pieces, counter.unknown) for w in words]
    assert tokens.tolist() == [n for _, n in want] and np.allclose(score, [x for x, _ in want], atol=0)
    assert nodes < 1 + sum(len(w) + 1 for w in words)  # prefixes are shared
    got = token_counts.count_tokens(odd).collect()
    known = {w: _cut("▁" + w, pieces, counter.unknown)[1] for _, t in ODD for w in set((t or "").split())}
    assert collections.Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in got) == collections.Counter(
        (i, len((t or "").split()), sum(known[w] for w in (t or "").split())) for i, t in ODD)
    assert token_counts.count_tokens(empty).count() == 0


def _components(rows, k, percent):
    sets, having = {}, collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[a:a + n]) for a in range(len(w) - n + 1)} if w else set()
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    both = collections.Counter(p for v in having.values() for p in itertools.combinations(sorted(v), 2))
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("leaf,shingle,percent", [(2000, 3, 85), (3, 5, 80)])
def test_neardup(spark, docs, texts, monkeypatch, leaf, shingle, percent):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "DEPTH", 5)
    want = _components(texts.items(), shingle, percent)
    got = neardup.near_duplicates(docs, shingle=shingle, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_neardup_odd_rows(odd, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    want = _components([x for x in ODD if x[0] is not None], 3, 85)
    assert got == collections.Counter([(i, *want[i], want[i][1] == i) for i, _ in ODD if i is not None] + [(None, 2, None, True)])
    assert neardup.near_duplicates(empty).count() == 0


def test_similar_counts_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = neardup.similar(sets, 40)
    for i, j in itertools.combinations(range(40), 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert got[i, j] == (100 * len(a & b) >= 40 * len(a | b))


def test_text_stats(spark, docs, odd, texts):
    def brute(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (docs, odd):
        want = collections.Counter((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())
        assert collections.Counter((r.doc_id, *[r[n] for n in names]) for r in decision_list.document_stats(df).collect()) == want


def test_runs_of_words_at_their_bounds(spark):
    """Texts of 0 to 20 words around the run's length, by counting; runs are hashed from halves, not word by word."""
    words = "a b c d e f g h".split()
    texts = [" ".join((words * 3)[:n]) for n in range(21)] + ["x " + " ".join(words) + " y " + " ".join(words), "a " * 9, " \t", "Ä#A\x0bä$ \x1c|", None]
    got = text_stats.with_text_stats(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    for r in got.collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", texts[r.i] or "") if x]
        runs = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        inside = {k + j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(8)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(inside), sum(map(len, w))), texts[r.i]
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_decision_list(spark, odd, empty):
    labels = common.table(spark, SF_ORACLE, "labels")
    stats = decision_list.document_stats(common.table(spark, SF_ORACLE, "documents")).cache()
    rules = decision_list.learn(decision_list.labelled_stats(stats, labels))
    assert rules.rules and "reject if" in str(rules)
    got = decision_list.apply_rules(stats, rules).join(labels, "doc_id")
    wrong = got.where(~F.col("base_failed") & (F.col("kept") != (F.col("quality") == 1))).count()
    assert wrong <= 0.03 * got.count()
    # the CASE WHEN against the same conditions row by row
    for r in decision_list.apply_rules(stats, rules).select("*", *[c.alias("_" + n) for n, c in decision_list.ratios().items()]).collect():
        holds = [k for k, rule in enumerate(rules.rules, 1) if all((r["_" + c.name] > c.threshold) == c.above for c in rule)]
        assert r.rule == (holds[0] if holds else None)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed and not holds)
    assert decision_list.learn(decision_list.labelled_stats(stats, labels.limit(0))).rules == []
    assert decision_list.apply_rules(decision_list.document_stats(empty), rules).count() == 0
    assert decision_list.apply_rules(decision_list.document_stats(odd), rules).count() == len(ODD)


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        hits = [(i, rng.choice([1.0, 2.0, 5.0])) for i in sorted(rng.sample(range(60), rng.randint(1, 12)))]
        scores = [-0.7] * 60
        for i, s in hits:
            scores[i] = s
        got = toxicity.maximal_segments(hits, 0.7)
        sums = list(itertools.accumulate(scores, initial=0.0))
        best = max(sums[b] - sums[a] for a in range(60) for b in range(a + 1, 61))
        assert max(s for _, _, s in got) == pytest.approx(best)
        assert all(s == pytest.approx(sums[b + 1] - sums[a]) and s > 0 for a, b, s in got)
        assert all(x[1] < y[0] for x, y in itertools.pairwise(got)) and {i for i, _ in hits} <= {k for a, b, _ in got for k in range(a, b + 1)}


def test_toxicity(spark, docs, odd, empty):
    big, labels = common.table(spark, SF_ORACLE, "documents"), common.table(spark, SF_ORACLE, "labels")
    model = toxicity.fit(toxicity.documents_of(big), labels)
    got = toxicity.score_texts(big, model).join(labels, "doc_id").where(toxicity.held_out("doc_id"))
    right = got.where((F.col("score") >= 0.5).cast("int") == F.col("toxic")).count() / got.count()
    assert right > 0.95
    # labels of held-out rows change nothing
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(toxicity.documents_of(big), turned).lexicon == model.lexicon
    scored = toxicity.score_texts(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored) and all(not r.passages for r in scored if r.doc_id in (0, 1, 2))
    assert toxicity.score_texts(empty, model).count() == 0
    assert toxicity.fit(toxicity.documents_of(empty), labels).lexicon == {}
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_label_model_recovers_accuracies():
    rng, patterns = random.Random(4), collections.Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.2
        patterns[tuple(-1 if rng.random() < (p if bad else 0.001) else 0 for p in (0.6, 0.5, 0.3))] += 1
    model = quality.estimate(dict(patterns))
    assert model.good == pytest.approx(0.8, abs=0.05)
    assert [v[-1][0] for v in model.votes] == pytest.approx([0.6, 0.5, 0.3], abs=0.08)
    assert model.posterior((-1, -1, 0)) < 0.1 < 0.8 < model.posterior((0, 0, 0))
    assert quality.estimate({}).good == 0.5


def test_quality(spark, odd, empty):
    docs, labels = common.table(spark, SF_ORACLE, "documents"), common.table(spark, SF_ORACLE, "labels")
    model = quality.fit(docs)
    got = quality.scored_rows(docs, model).join(labels, "doc_id")
    assert got.where(F.col("kept").cast("int") == F.col("quality")).count() >= 0.95 * got.count()
    assert quality.scored_rows(odd, model).select("row.*").columns == odd.columns
    assert quality.scored_rows(odd, model).count() == len(ODD)
    assert quality.scored_rows(empty, quality.fit(empty)).count() == 0


def _law(rows, n):
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards.get(j, ())) for j in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(shards) <= set(range(n))


def test_sharding(spark, docs, odd, empty, texts):
    rows = sharding.shard_documents(docs).collect()
    _law(rows, 40)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    copies = collections.defaultdict(set)
    for r in rows:
        copies[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) - 1 for s in copies.values()) <= 3
    got = sharding.shard_documents(odd).collect()
    _law(got, 40)
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in ODD)
    assert sharding.shard_documents(empty).count() == 0
    # half of the rows are copies of one text
    hot = spark.range(800).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 300)).alias("text"))
    rows = sharding.shard_documents(hot, shards=8).collect()
    _law(rows, 8)
    units = {(r.unit, r.shard) for r in rows if r.doc_id < 400 and r.unit is not None}
    assert len(units) <= len({u for u, _ in units}) + 8


def test_accepted_shares_keep_quota():
    load, wished = [100, 100, 100], {(0, 1): 60, (1, 2): 10, (2, 1): 30, (0, 2): 20}
    share = sharding.accepted_shares(load, wished, 110)
    for j in range(3):
        after = load[j] + sum(n * share[m] * ((m[1] == j) - (m[0] == j)) for m, n in wished.items())
        assert after <= 110 * 1.01


def test_ann(spark):
    rng = np.random.default_rng(0)
    v = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((900, 16)))]
    v += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, v[3][1]), (1004, [None] * 16), (None, v[5][1]), (1050, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, "e") for i, x in v], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df.where(F.col("vec_id") % 50 == 0)).collect()
    plain = {i: np.array(x) / np.linalg.norm(x) for i, x in v if i is not None and (i < 900 or i == 1003)}
    found = total = 0
    for q in range(0, 900, 50):
        want = sorted((-(plain[q] @ x), i) for i, x in plain.items() if i != q)[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - plain[q] @ plain[i]) < 1e-12 for _, i, s in own)
        found, total = found + len({i for _, i in want} & {i for _, i, _ in own}), total + 5
    assert found >= 0.9 * total and not [r for r in got if r.query_id >= 1000]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def _plain_differencing(sizes, ways):
    """Ways of the sizes, every partial partition holding a (sum, members) of all ways."""
    heap = [(-s, i, [(s, [i])] + [(0, [])] * (ways - 1)) for i, s in enumerate(sizes)]
    for tie in range(len(heap), 2 * len(heap) - 1):
        (_, _, a), (_, _, b), *heap = sorted(heap, key=lambda h: h[:2])
        both = sorted(((s + t, x + y) for (s, x), (t, y) in zip(a, b[::-1], strict=True)), key=lambda p: -p[0])
        both = [(s - both[-1][0], x) for s, x in both]
        heap.append((-both[0][0], tie, both))
    return {i: w for w, (_, members) in enumerate(heap[0][2]) for i in members}


def test_differencing_lists_ways_that_are_not_empty(monkeypatch):
    rng, sort, calls = np.random.default_rng(8), np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    for n, ways in ((1, 5), (7, 9), (60, 7), (200, 30), (90, 2)):
        sizes = rng.integers(1, 40, n)
        assert dict(enumerate(packing.difference_partition(sizes, ways).tolist())) == _plain_differencing(sizes.tolist(), ways)
    calls.clear()
    packing.difference_partition(rng.integers(1, 513, 1024), 64)
    assert len(calls) < 100  # most steps add one part to an incomplete partition


def test_suffix_tree(spark, docs, texts, odd, empty):
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = collections.Counter(w for t in train.values() for w in [*t.encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    from kindling.llm.queries import QUERIES

    rows = QUERIES["op1_suffix_tree"](spark, SF_SMALL).collect()
    for r in rows:
        words = [*texts[r.doc_id].encode().lower().split(), b" "]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert r.held_out == (r.doc_id not in train)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    got = suffix_tree.score_documents(odd, docs).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert suffix_tree.score_documents(empty, docs).count() == 0
    assert {r.score for r in suffix_tree.score_documents(odd, empty).collect()} == {0.0}


def test_suffix_tree_against_plain_tree(spark, docs, texts):
    """Contexts, their distributions and the scores, from a tree kept in plain dictionaries."""
    scratch = common.Scratch(spark, "test")
    tree, _ = suffix_tree.fit(docs.select("doc_id", "text"), scratch)
    key = {w: suffix_tree.word_key(w) for t in texts.values() for w in t.encode().lower().split()} | {b" ": suffix_tree.END}
    place = tree.indexed()
    number = {w: place[k] for w, k in key.items() if k in place}
    pairs = collections.Counter()
    for t in texts.values():
        w = [*t.encode().lower().split(), b" "]
        pairs.update(zip(w, w[1:], strict=False))
    want = {(number[a] << 20 | number[b]): c for (a, b), c in pairs.items() if c >= tree.least() and a in number and b in number and number[a] < tree.contexts}
    assert dict(zip(tree.pairs.keys.tolist(), tree.pairs.counts.tolist(), strict=True)) == want
    for c in np.flatnonzero(tree.pairs.kept)[:5]:  # a context's distribution sums to 1
        words = np.arange(len(tree.words))
        own = 10 ** tree.after_word(np.full(len(words), c), words, tree.root)
        assert own.sum() + 10 ** tree.pairs.rest[c] * (1 - (10 ** tree.root).sum()) == pytest.approx(1)


def _plain_tree(train):
    """Score of a text by the tree of all strings of up to three words seen twice or more, in plain dictionaries."""
    docs = [[*t.encode().lower().split(), b" "] for t in train]
    count = [collections.Counter(tuple(d[i:i + k]) for d in docs for i in range(len(d) - k + 1)) for k in (1, 2, 3)]
    total, once, twice = sum(count[0].values()), *(sum(c == k for c in count[0].values()) for k in (1, 2))
    d, v = min(0.5, once / (once + 2 * twice)), len(count[0])
    after, states = collections.defaultdict(list), {}
    for strings in count[1:]:
        for s, c in strings.items():
            if c >= 2:
                after[s[:-1]].append((s[-1], c))

    def log_p(context, w):
        if not context:
            c = count[0][w,]
            return math.log((c - d) / total) if c else math.log(d * v / total / (v + 1))
        if context not in states:
            return log_p(context[1:], w)
        rest, own = states[context]
        return own[w] if w in own else rest + log_p(context[1:], w)

    for context in sorted(after, key=len):
        n = count[len(context) - 1][context]
        own = {w: math.log((c - 0.5) / n) for w, c in after[context]}
        lower = {w: log_p(context[1:], w) for w in own}
        left = 1 - sum(map(math.exp, own.values()))
        rest = math.log(max(left, 1e-12) / max(1 - sum(map(math.exp, lower.values())), 1e-12))
        if n * (sum(math.exp(p) * (p - lower[w]) for w, p in own.items()) + max(left, 0) * rest) > 10 + len(own):
            states[context] = rest, own

    def score(text):
        words = [*text.encode().lower().split(), b" "]
        return sum(log_p(tuple(words[max(0, i - 2):i]), w) for i, w in enumerate(words)) / math.log(10)

    return score


def test_suffix_tree_keeps_strings_of_small_share(spark, docs, texts, monkeypatch):
    """In a large corpus strings seen a few times count as they do in a small one, in the tasks or by the join."""
    monkeypatch.setattr(suffix_tree, "HOT", 150, raising=False)
    rare = ["qa qb qc", "qa qb qd", "qe qa qb qc"]
    more = [*rare, "one filler of many words " * 250_000]
    schema = "doc_id long, text string"
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], schema).repartition(4))
    plain = _plain_tree([*texts.values(), *more])
    asked = [*rare, "qb qa", "qa qb never", "zz zz", "", *list(texts.values())[:150]]
    got = suffix_tree.score_documents(spark.createDataFrame(list(enumerate(asked)), schema).repartition(3), df).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: plain(t) for i, t in enumerate(asked)})


def test_suffix_tree_moves_strings_packed(spark, docs, monkeypatch):
    """What is stored has a row for each chunk, or for each chunk and part, and not one for each string; shuffles go with their job."""
    write, stored = common.Scratch.write, []

    def counted(self, df, name, **kept):
        stored.append(kept | {"name": name, "rows": (out := write(self, df, name, **kept)).count()})
        return out

    monkeypatch.setattr(common.Scratch, "write", counted)
    rows = suffix_tree.score_documents(docs, docs).count()
    assert rows == docs.count() and sum(s["rows"] for s in stored if s["name"] != "scores") < rows  # each text has dozens of strings
    assert not any(s["keep_shuffles"] for s in stored)


def test_suffix_tree_of_many_chunks_and_parts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_tree, "_PART", 700)  # and so all steps are taken
    plain = _plain_tree(list(texts.values()))
    few = docs.select("doc_id", "text").repartition(7)
    got = suffix_tree.score_documents(few, few).collect()
    asked = dict(list(texts.items())[:60])
    assert {r.doc_id: r.score for r in got if r.doc_id in asked} == pytest.approx({i: plain(t) for i, t in asked.items()})


def test_suffix_tree_packs_and_orders_longs():
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.integers(0, 2**63 - 1, 2000), np.repeat(rng.integers(0, 2**63 - 1, 50), 20), (7 << 40) + rng.integers(0, 30, 500)])  # of the last the upper bits agree
    rng.shuffle(keys)
    order, k, new = suffix_tree._grouped(keys)
    assert (order == np.argsort(keys, kind="stable")).all() and (k == np.sort(keys)).all() and new.sum() == len(set(keys.tolist()))
    arrays = [np.sort(keys), np.array([-0.5, np.nan, 1e300]), np.zeros(5, np.int64), np.zeros(0, np.int64), np.array([True, False]), np.array([-3, 2**62])]
    got = suffix_tree._unpack(suffix_tree._pack(*arrays))
    assert all(np.array_equal(g.view(a.dtype) if a.dtype.itemsize == 8 else g, a, equal_nan=a.dtype == float) for g, a in zip(got, arrays, strict=True))
    assert np.array_equal(suffix_tree._risen(*suffix_tree._rising(np.sort(keys))), np.sort(keys)) and len(suffix_tree._risen(*suffix_tree._rising(keys[:0]))) == 0


def test_suffix_tree_string_keys_are_sparks(spark):
    keys = [0, 1, -1, 2**62, 123456789012345, 2**63 - 1]
    rows = spark.createDataFrame(list(itertools.product(keys, keys)), "context long, suffix long").withColumn("key", suffix_tree._string_key("context", "suffix")).collect()
    assert suffix_tree.string_key(*(np.array([r[k] for r in rows], np.int64) for k in (0, 1))).tolist() == [r.key for r in rows]
    some = suffix_tree.KeySet(spark.createDataFrame([(r.key,) for r in rows], "key long"))
    assert some.has(np.array([r.key for r in rows])).all() and not some.has(np.array([r.key + 1 for r in rows])).all()


def test_ranked_is_gapless(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("p"))
    got = common.ranked(df, ["p"], ["id"], "r", 5000, per_bucket=100).collect()
    for p in range(3):
        own = sorted(r.r for r in got if r.p == p)
        assert own == list(range(len(own)))


def _heap(spark, rng, size, own, strays, away, words=200):
    """``size`` texts that each add ``own`` words to one text, and ``strays`` that add ``away``."""
    rows = []
    for i in rng.permutation(size + strays).tolist():
        text = [f"w{k}" for k in range(words)] + [f"x{i}y{k}" for k in range(own if i < size else away)]
        rows.append((i, " ".join(text), "en", "s", 0))
    rows.sort()
    return spark.createDataFrame(rows, DOCS).repartition(4), [np.unique([int.from_bytes(hashlib.md5(w.encode()).digest()[:7], "big") for w in r[1].split()]) for r in rows]


def _parts(sets, percent):
    linked = neardup.similar(sets, percent)
    return {i: min(c) for c in neardup._clusters(len(sets), lambda i, others: linked[i, others]) for i in c}


def test_neardup_heap_larger_than_a_leaf(spark, monkeypatch):
    """Documents near the threshold find a heap of different near copies that no leaf holds."""
    monkeypatch.setattr(neardup, "LEAF", 80)
    df, sets = _heap(spark, np.random.default_rng(5), 1200, 3, 100, 31)
    want = _parts(sets, 85)
    assert len(set(want.values())) == 1
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle=1).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.998 * len(want)


def test_neardup_trees_and_branches_follow_the_threshold(spark, monkeypatch):
    assert neardup.rounds(85) == neardup.ROUNDS
    for percent in (80, 70, 50):
        assert 0.15 ** sum(neardup.ROUNDS) >= (1 - percent / 100) ** sum(neardup.rounds(percent))
        assert (1 + neardup.second_branch(percent) / 1000) * percent / 100 == pytest.approx(1)
    # pairs at 0.8 in nodes above a leaf: texts of one passage, which is half of each
    monkeypatch.setattr(neardup, "LEAF", 30)
    rows = []
    for i in range(300):
        for k in range(2):
            rows.append((2 * i + k, " ".join([*(f"w{j}" for j in range(60)), *(f"x{i}y{j}" for j in range(60)), *(f"z{i}k{k}y{j}" for j in range(15))]), "en", "s", 0))
    sets = [np.unique([int.from_bytes(hashlib.md5(w.encode()).digest()[:7], "big") for w in r[1].split()]) for r in rows]
    want = _parts(sets, 80)
    assert len(set(want.values())) == 300
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4), shingle=1, percent=80).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_decision_list_finds_rare_faults(spark):
    """A fault of 2 % of the rejected rows, beyond all kept rows in one statistic, beside a common one."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(9000):
        kind = "common" if i < 3000 else "rare" if i < 3060 else "good"
        symbols = 900 + int(rng.integers(0, 50)) if kind == "rare" else int(rng.integers(0, 800))
        lines = int(rng.integers(50, 99)) if kind == "common" else int(rng.integers(0, 40))
        rows.append((i, 100, 1000, symbols, int(rng.integers(0, 300)), 0, 80, lines, int(kind != "good"), bool(i % 3), kind))
    df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_upper long, n_repeat_words long, "
                                     "n_distinct long, n_dup_lines long, reject int, grow boolean, kind string")
    got = df.withColumn("rule", decision_list.learn(df).column()).groupBy("kind").agg(F.count("rule").alias("rejected"), F.count("*").alias("n"))
    assert {r.kind: (r.rejected, r.n) for r in got.collect()} == {"common": (3000, 3000), "rare": (60, 60), "good": (0, 5940)}


def test_neardup_ids_with_several_texts(spark, monkeypatch):
    """Texts of one id are of one component, and link what equals either; by joins as well as at once."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "b"), (9, "c"), (9, "d"), (5, "d"), (7, "e"), (7, "e"), (8, "f")]
    df = spark.createDataFrame([(i, text(c), "en", "s", 0) for i, c in rows], DOCS).repartition(3)
    for at_once in (neardup.LINKS_AT_ONCE, 0):
        monkeypatch.setattr(neardup, "LINKS_AT_ONCE", at_once)
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 5), (5, 5), (7, 7), (8, 8)}


def test_components_at_once_equal_those_by_joins(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1200)]
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long").repartition(3)
    a, b = ({(r.rep, r.component) for r in f.collect()} for f in (neardup._joined_at_once(links), neardup.components(links, common.Scratch(spark, "t"))))
    assert a == b and (1200, 1000) in a
    assert neardup._joined_at_once(links.limit(0)).count() == 0


def test_suffix_tree_scores_every_row_behind_a_shuffle(spark, docs):
    """Rows come out of a shuffle in other orders for each use; every one is scored, and as without the shuffle."""
    plain = {(r.doc_id, r.n_tokens): r.score for r in suffix_tree.score_documents(docs, docs).collect()}
    got = suffix_tree.score_documents(docs.repartition("doc_id"), docs).collect()
    assert len(got) == docs.count() and all(abs(plain[r.doc_id, r.n_tokens] - r.score) < 1e-6 for r in got)


def test_suffix_tree_rates_prose_above_nonsense(spark, docs):
    rng = random.Random(13)
    words = max((r.text for r in docs.where("lang = 'en'").select("text").collect() if r.text), key=len).split()[:100]
    shuffled = rng.sample(words, len(words))
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in words]
    df = spark.createDataFrame([(1, " ".join(words), "", "", 0), (2, " ".join(shuffled), "", "", 0), (3, " ".join(letters), "", "", 0)], DOCS)
    score = {r.doc_id: r.score for r in suffix_tree.score_documents(df, docs).collect()}
    assert score[1] >= score[2] > score[3]
    few = spark.createDataFrame([(1, "a b c d", "", "", 0)], DOCS)
    score = {r.doc_id: r.score for r in suffix_tree.score_documents(spark.createDataFrame([(1, "a b c d", "", "", 0), (2, "zz zz zz zz", "", "", 0), (3, "", "", "", 0)], DOCS), few).collect()}
    assert all(s is not None and s < 0 for s in score.values()) and score[1] > score[2] and len(set(score.values())) == 3


def test_pipeline_keeps_columns_named_like_its_key(spark, docs):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "one two three four five six", "k1"), (2, "one two three four five six", "k2"), (3, "other words are in this text here", "k3")], "doc_id long, text string, _key string")
    got = {(r.doc_id, r._key) for r in corpus_pipeline.drop_near_copies(spark, df, SF_SMALL).collect()}
    assert got == {(1, "k1"), (3, "k3")}


def test_tidied_tasks_give_their_memory_back(monkeypatch):
    """Whatever a task yields comes through; its own frame is gone when the memory is given back."""
    told = []

    class Held:
        def __del__(self):
            told.append("freed")

    def task():
        held = Held()
        yield from (1, 2, 3)
        assert held

    monkeypatch.setattr(common, "give_back", lambda: told.append("given back"))
    assert list(common.tidied(task())) == [1, 2, 3] and told == ["freed", "given back"]
    assert list(common.tidied(iter(()))) == [] and told[-1] == "given back"


def test_ends_of_tasks_do_not_walk_the_modules(spark):
    import gc

    import pyarrow as pa

    common.table(spark, SF_SMALL, "documents")  # lets workers find the package

    def walked(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(gc.get_objects())]), pa.array([gc.get_freeze_count()])], names=["walked", "aside"])

    rows = spark.range(4, numPartitions=4).mapInArrow(lambda b: common.tidied(walked(b)), "walked long, aside long").collect()
    assert len(rows) == 4 and all(10 * r.walked < r.aside for r in rows)


def test_small_partitions_share_tasks(spark):
    import pyarrow as pa

    def runs(batches):
        groups = [(key, len(rows)) for key, rows in neardup._groups(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in groups], pa.int64()) for k in (0, 1)], names=["key", "n"])

    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000, numPartitions=7).select((F.col("id") % 500).alias("key"))
        got = neardup._sorted_map(rows, "key", runs, "key long, n long", 3).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.key, r.n) for r in got) == [(k, 6) for k in range(500)]  # each key's rows at once
        assert {r.task for r in got} <= {0, 1, 2}
        assert common.most_tasks(spark) == common.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_texts_come_in_small_batches(spark):
    import pyarrow as pa

    common.table(spark, SF_SMALL, "documents")
    texts = spark.range(3000, numPartitions=1).select(F.expr("repeat(cast(id % 10 as string), 4000)").alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"]) for b in batches), "n long, bytes long").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.bytes for r in sizes) <= 5 << 20


def test_packing_gives_memory_back_between_chunks(monkeypatch):
    import pyarrow as pa

    texts = [f"words of text {i} " * 20 + f"rare{i}" for i in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    whole = pa.Table.from_batches(packing._pieces([rows], bpe.default_path(), 64, 2)).to_pylist()
    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(packing, "CHUNK_BYTES", 4 * 1500)  # some three texts a chunk
    monkeypatch.setattr(bpe, "_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "_loaded", {})
    parts = list(packing._pieces([rows], bpe.default_path(), 64, 2))
    assert len(parts) > 8 and len(calls) == -(-len(parts) // 4)
    assert pa.Table.from_batches(parts).to_pylist() == whole
