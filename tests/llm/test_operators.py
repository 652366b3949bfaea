"""Operators against brute force, and the cases every operator must survive."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ohmloom.llm import compact_windows, decontamination, line_dedup, mixing, near_dedup, quality, suffix_dedup, token_counts, token_planes, topk
from ohmloom.llm.common import materialise, words_of
from ohmloom.llm.tokens import PieceEncoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blk int, words string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(25)]
    passage = prose(rng, 70)
    texts = base + [base[0]] * 4 + [passage + " " + prose(rng, 90), prose(rng, 40) + " " + passage] + [None, "", "\n\n", "!?", "x", "ab\nab\nab", prose(rng, 6000)]
    edited = base[1].split()
    edited[20] = "zzz"
    texts += [" ".join(edited)] + ["Common Line\n" + prose(rng, 12) for _ in range(12)]
    out = [(i, t, "en", ["s1", None, "s2"][i % 3], len(t or ""), 1, "w") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "no id here", None, None, 3, 0, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, rows, nothing):
    item = " ".join((rows[2][1] or "").split()[10:30])
    bench = spark.createDataFrame([(1, item.upper()), (2, None), (3, ""), (4, "x"), (5, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(docs, bench).collect()}
    assert got[2].n_hit == 20 and got[2].item_ids == ["1", "5"]
    a, b = got[2].byte_starts[0], got[2].byte_ends[-1]
    assert rows[2][1].encode()[a:b].decode() == item
    assert sum(r.n_hit > 0 for r in got.values()) == 1 + ("x" in rows[35][1].split())
    assert decontamination.scan(nothing, bench).count() == 0
    assert decontamination.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    many = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.scan(unique, bench, block_nodes=64).collect()}
    assert many == {d: (r.n_words, r.n_hit, r.item_ids) for d, r in got.items() if d is not None}


def test_decontamination_blocks_with_null_and_repeated_ids(spark, docs, rows):
    bench = spark.createDataFrame([(i, " ".join(rows[i][1].split()[10:30])) for i in range(6)] + [(7, "no id here")], "item_id long, text string")
    plain = lambda **how: sorted(map(str, decontamination.scan(docs, bench, **how).collect()))
    whole = plain()
    assert plain(block_nodes=64) == whole and len(whole) == len(rows)
    assert plain(block_nodes=64, keep=("doc_id", "text", "source")) == plain(keep=("doc_id", "text", "source"))
    assert any("doc_id=None" in r and "'7'" in r for r in whole)


def test_suffix_dedup(docs, rows, nothing):
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for d, t, *_ in order:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = {}
    for d, t, *_ in order:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] != d:
                gone[i : i + 50] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        want[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = suffix_dedup.mark(docs, suffix_dedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert suffix_dedup.dedup_substrings(nothing).count() == 0


def test_near_dedup(docs, rows, nothing):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    copies = [i for i, r in enumerate(rows[:-3]) if r[1] == rows[0][1]]
    assert {got[i] for i in copies} == {0}
    near = next(i for i, r in enumerate(rows) if r[1] and " zzz " in r[1])
    assert got[near] == got[1] == 1 and got[None] is None
    assert got[5] == 5 and got[31] == 31
    assert near_dedup.classes(nothing).count() == 0


def test_near_dedup_against_all_pairs(spark):
    """Every pair that shares a key is aligned by a plain table; classes are the components of the alike ones."""
    rng = random.Random(21)
    words = [prose(rng, 1) + str(i) for i in range(800)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        texts.append(base)
        for share in (0.0, 0.05, 0.1, 0.3, 0.6):
            texts.append([rng.choice(words) if rng.random() < share else w for w in base])
    texts += [[], ["x"], ["x"], ["y", "z"]]
    rng.shuffle(texts)
    n, own = len(texts), list(range(len(texts)))
    keys = []
    for t in texts:
        raw = " ".join(t).encode()
        kmers, at = near_dedup.shingle_hashes(*near_dedup.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), near_dedup.SHINGLE)
        keys.append(set(near_dedup.order_min_hash(kmers, at)[0].tolist()) if t else set())
    for i in range(n):
        for j in range(i):
            if texts[i] != texts[j] and not keys[i] & keys[j]:
                continue
            most = near_dedup.allowed(max(len(texts[i]), len(texts[j])))
            if abs(len(texts[i]) - len(texts[j])) <= most and near_dedup._plain(texts[i], texts[j], most) <= most and (texts[i] or texts[i] == texts[j]):
                a, b = own[i], own[j]
                own = [min(a, b) if o in (a, b) else o for o in own]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == dict(enumerate(own))


@pytest.mark.parametrize("length", [60, 200, 1000])
def test_pairs_at_the_threshold_share_a_key(length):
    """Words replaced all over: the share of pairs that meet in some sketch, by edits."""
    rng = np.random.default_rng(length)
    new = lambda *shape: rng.integers(0, 1 << 60, shape).astype(np.uint64)
    n, met = 150, {}
    for share in (0.02, 0.05, 0.1, 0.15, 0.2):
        first = new(n, length)
        second = first.copy()
        for row in second:
            row[rng.choice(length, int(share * length), False)] = new(int(share * length))
        kmers, at = near_dedup.shingle_hashes(np.concatenate([first.ravel(), second.ravel()]), np.arange(2 * n + 1) * length, near_dedup.SHINGLE)
        keys = near_dedup.order_min_hash(kmers, at)
        met[share] = float((keys[:n] == keys[n:]).any(1).mean())
    print(length, met)
    assert met[0.2] >= 0.7 and met[0.15] >= 0.95 and min(met[s] for s in (0.02, 0.05, 0.1)) >= 0.99


def test_order_counts():
    """The same k-mers in another order give another key."""
    a, b = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), None
    b = np.concatenate([a[20:], a[:20]])
    both = near_dedup.order_min_hash(np.concatenate([a, b]), np.array([0, 40, 80]))
    same = float((both[0] == both[1]).mean())
    assert 0.3 < same < 0.7
    one = near_dedup.order_min_hash(np.array([5], np.uint64), np.array([0, 1]))
    assert (one == near_dedup.order_min_hash(np.array([5, 9], np.uint64), np.array([0, 1, 2]))[:1]).all()


def test_long_texts_are_aligned_in_bounded_memory():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 40, 30_000).tolist()
    b = a[:10_000] + rng.integers(0, 1 << 40, 50).tolist() + a[10_030:]
    assert near_dedup.banded_distance(a, b, 6000) == 50
    few = rng.integers(0, 3, 4000).tolist()
    assert near_dedup.banded_distance(few, few[:2000] + few[2001:], 800) == 1


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))] if rng.random() < 0.3 else [x for x in a if rng.random() > 0.1]
        k = rng.randint(0, 10)
        assert near_dedup.banded_distance(a, b, k) == near_dedup._plain(a, b, k)


def test_line_dedup(docs, rows, nothing):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    common = [r for r in got.values() if r.n_dropped]
    assert len(common) == 12 and all("common line" not in r.kept.lower() for r in common)
    assert all(len(r.keep_runs) and sum(r.keep_runs) == r.n_lines for r in got.values())
    assert got[33].kept == "\n\n" and line_dedup.dedup_lines(nothing).count() == 0


def test_quality(spark, docs, nothing):
    rng = random.Random(1)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [prose(rng, 80).upper().replace(" ", "!! ") for _ in range(60)]
    texts = [x for pair in zip(good, bad) for x in pair]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(len(texts))], "doc_id long, quality int")
    model = quality.train(table, labels)
    held = {r.doc_id: r.score for r in quality.score(table, model).collect() if quality.fold(r.doc_id) == 2}
    assert np.mean([(s >= 0.7) == ((i + 1) % 2 == 1) for i, s in held.items()]) > 0.9
    scores = quality.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in scores) and quality.score(nothing, model).count() == 0
    long = np.frombuffer((good[0] * 4000).encode(), np.uint8)[: 4 * quality.SCORE_BYTES + 777]
    ids, starts = quality.padded(long, np.array([0, len(long)]))
    assert model._long(long) == pytest.approx(float(model.forward(ids, starts)[0]), abs=1e-4)
    assert quality.train(table, labels.limit(0)).share == 0.5


def test_pieces_equal_the_library():
    texts = ["Hello  world", " lead", "trail ", "a\n b", "tabs\t\tand  \n\n x", "it's 123's “quoted”  nb", "x" * 300 + " y", "", "  wide  ", "<|endoftext|> ok<|endoftext|>", "a \n b \r\n c"]
    encoder = PieceEncoder(default_path())
    rng = random.Random(9)
    signs = ["a", "B", " ", " ", "\n", "\t", "'s", "1", "é", "!", "\r", "\x85", "\x1c", "\u3000", "<|endoftext|>", None]
    texts += [None] + ["".join(rng.choice(signs[:-1]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for some in (encoder, PieceEncoder(default_path(), most=50)):
        ids, counts = some.encode(pa.array(texts, pa.string()))
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_with_signs_equal_the_library():
    encoder, rng = PieceEncoder(default_path()), random.Random(10)
    signs = "aZéßÿĊĠŉǅɏ×÷ªµɐ09²'’s._!-~`\x7f\xad"
    piece = lambda: "".join(rng.choice(signs[:12] if rng.random() < 0.7 else signs) for _ in range(rng.randint(0, 6))) + rng.choice(["", ",", "'s", "'", "...", "!?"])
    texts = [rng.choice([" ", "\n", "  "]).join(piece() for _ in range(rng.randint(1, 4))) for _ in range(20000)]
    ids, counts = encoder.encode(pa.array(texts))
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(w.ids == g.tolist() for w, g in zip(want, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
    # signs are no reason to ask the library for a word again
    seen, learn = [], encoder._learn
    encoder._learn = lambda pieces: (seen.extend(pieces), learn(pieces))
    encoder.encode(pa.array(["x newword newword, newword. Newword newword;"]))
    assert seen.count(" newword") == 1 and " newword," not in seen


def test_frequent_pieces_are_not_forgotten(monkeypatch):
    encoder, seen = PieceEncoder(default_path(), most=300), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda pieces: (seen.extend(pieces), learn(pieces)))
    for step in range(40):
        text = " ".join(f"often{i} rare{step}x{i}" for i in range(50))
        ids, counts = encoder.encode(pa.array([text]))
        assert ids[: counts[0]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and len(encoder.known) <= 300
    assert all(seen.count(f" often{i}") == 1 for i in range(1, 50))


def test_token_planes(docs, rows, nothing):
    got = token_planes.read_files(token_planes.write_files(docs, shard_ids=500)).orderBy("start").collect()
    tokenizer = PieceEncoder(default_path()).tokenizer
    at = 0
    for r, (d, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_planes.read_files(token_planes.write_files(nothing)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_shard_round_trip(bits):
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 1 << 17, n).astype("<u4") for n in (0, 1, 7, 1000, 3)]
    shard = token_planes.Shard(token_planes.write_shard([5, None, 7, 8, 9], np.concatenate(ids), [len(x) for x in ids], bits, chunk_ids=64))
    back = list(shard.documents())
    assert [d for d, _, _ in back] == [5, None, 7, 8, 9] and all((a == b[2]).all() for a, b in zip(ids, back))
    assert (shard.ids(3, 900) == np.concatenate(ids)[3:900]).all()


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    sizes = {}
    for d, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, size in sizes.items():
        taken = sum(r.taken for r in got if r.source == s)
        assert targets[s] <= 2 * size + 1e-6 and abs(taken - targets[s]) <= mixing.BLOCK_WORDS
    assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == len(rows)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got)) and mixing.mix(nothing).count() == 0


def highest_quotients(votes, seats):
    best = sorted(((-v / (2 * k - 1), i) for i, v in enumerate(votes) for k in range(1, seats + 2) if v > 0))[:seats]
    return [sum(j == i for _, j in best) for i in range(len(votes))]


def test_apportionment_gives_the_highest_quotients(spark):
    rng = random.Random(2)
    cases = [([rng.choice([0, 1, 5, rng.randint(0, 400)]) for _ in range(rng.randint(1, 30))], rng.randint(0, 60)) for _ in range(40)]
    cases = [(v, n if any(v) else 0) for v, n in cases] + [([7] * 10, 5), ([1000] + [1] * 20, 37), ([3], 9)]
    rows = [(i, c, v, n) for i, (votes, n) in enumerate(cases) for c, v in enumerate(votes)]
    got = mixing.apportion(spark.createDataFrame(rows, "node int, child int, votes long, blocks long"), ("node",), "child").collect()
    seats = {(r.node, r.child): r.seats for r in got}
    for i, (votes, n) in enumerate(cases):
        assert [seats[i, c] for c in range(len(votes))] == highest_quotients(votes, n), (votes, n)


def test_mixing_of_many_shards(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 30, 200])), "ab"[i % 7 == 0]) for i in range(900)] + [(None, None, "c"), (5, "one two", None)]
    docs = spark.createDataFrame([(d, t, s, 7, "x") for d, t, s in rows], "doc_id long, text string, source string, size int, shard string")
    got = mixing.mix(docs, shard_words=64, block_words=4, fan=8)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "shard", "size", "source_size", "target", "taken"])
    got = got.collect()
    assert len(got) == len(rows) and all(r.shard == "x" and 0 <= r.taken <= 2 * r.size for r in got)
    targets = {r.source: r.target for r in got}
    for s, target in targets.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= 4 + 0.02 * target
    assert mixing.mix(docs, shard_words=64, block_words=4, fan=8, text=False).columns[:3] == ["doc_id", "source", "shard"]


def own_counts(rows, tokenizer=None):
    out = {}
    for _, t, lang, source, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) if tokenizer else len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        s = out.setdefault((source, lang), [0, 0, 0])
        s[0], s[1], s[2] = s[0] + 1, s[1] + n, s[2] + len(t or "")
    return {k: tuple(v) for k, v in out.items()}


def test_token_counts(spark, docs, rows, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    held = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}
    counts = token_counts.count_words(docs)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_counts.inserts(counts)) and not rollup.commit("a", token_counts.inserts(counts))
    assert held() == own_counts(rows)
    rollup.commit("b", token_counts.revisions(counts, token_counts.count_bpe(docs)))
    assert held() == own_counts(rows, PieceEncoder(default_path()).tokenizer)
    rollup.compact()
    assert not rollup.commit("b", counts) and {r.tokenizer for r in rollup.totals().collect()} == {"byte_bpe_50k-1"}
    assert held() == own_counts(rows, PieceEncoder(default_path()).tokenizer)
    rollup.commit("c", token_counts.revisions(token_counts.count_bpe(docs), counts))
    assert held() == own_counts(rows)
    some = [r for r in rows if r[0] is not None and r[0] < 9]
    rollup.commit("d", token_counts.deletes(token_counts.count_words(spark.createDataFrame(some, SCHEMA))))
    rest = own_counts([r for r in rows if r[0] is None or r[0] >= 9])
    assert held() == rest
    rollup.commit("e", token_counts.deletes(counts))
    rollup.commit("f", token_counts.inserts(token_counts.count_words(spark.createDataFrame(some, SCHEMA))))
    assert rollup.totals().count() == 0


def test_token_counts_survive_a_stop_anywhere(spark, tmp_path, monkeypatch):
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    delta = token_counts.inserts(token_counts.count_words(docs))
    total = lambda: [r.n_tokens for r in rollup.totals().collect()]
    names = ("one", "two", "three")
    for n in names[:2]:
        rollup.commit(n, delta)
    # an attempt that was not finished, and a second one that was
    (tmp_path / "r" / "batch=three" / "0").mkdir(parents=True)
    assert total() == [4] and rollup.commit("three", delta)
    delta.coalesce(1).write.parquet(f"file://{tmp_path}/r/batch=three/zz")
    assert total() == [6]

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    # before the new base counts
    with monkeypatch.context() as m:
        m.setattr(token_counts.TokenRollup, "_sums", stop)
        with pytest.raises(Stop):
            rollup.compact()
    assert total() == [6] and not any(rollup.commit(n, delta) for n in names)
    # after it counts, before anything is removed
    with monkeypatch.context() as m:
        real, calls = token_counts.TokenRollup._open, []
        m.setattr(token_counts.TokenRollup, "_open", lambda self, base: real(self, base) if not calls and not calls.append(1) else stop())
        with pytest.raises(Stop):
            rollup.compact()
    assert total() == [6] and not any(rollup.commit(n, delta) for n in names)
    rollup.compact()
    assert total() == [6] and not any(rollup.commit(n, delta) for n in names) and rollup._names() == ["base=0"]
    rollup.commit("four", delta)
    rollup.compact()
    assert total() == [8] and rollup._names() == ["base=1"]


def test_topk(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.2, (230, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (600, [float("nan")] * 8), (700, [None] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    data = topk.vectors(table.union(table.limit(3)))
    got = {(r.query_id, r.rank): (r.id, r.score) for r in topk.top_k(data, data.where("id % 100 = 0"), n_pivots=8, group_queries=2).collect()}
    ints = np.floor(1024 * v.astype(float)).astype(int)
    want = {}
    for q in (0, 100, 200):
        best = sorted((-int(ints[q] @ ints[j]), j) for j in range(230) if j != q)[:10]
        want |= {(q, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
    assert topk.top_k(data.limit(0), data.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100_000, 500_000_000])
def test_topk_scores_are_exact_integers(spark, size):
    rng = np.random.default_rng(7)
    v = rng.integers(-size, size, (120, 64))
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in topk.top_k(data, data.where("id % 40 = 0"), n_pivots=6).collect()}
    whole = v.astype(object)
    for q in (0, 40, 80):
        best = sorted((-int(whole[q] @ whole[j]), j) for j in range(120) if j != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(j, -s) for s, j in best]


def test_topk_moves_little_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(20, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    v = np.floor(1024 * (centre[np.arange(3000) % 20] + rng.normal(0, 0.01, (3000, 16)))).astype(int)
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    queries = data.where("id % 100 < 20")
    cells, asked, pivots, bounds = topk._plan(data, queries, 10, 64, 2048)
    sent = topk.needed(cells, pivots, bounds).select("needs").collect()
    pairs = sum(sum(bin(b).count("1") for b in r.needs) for r in sent)
    assert len(sent) <= 3000 and pairs < 0.1 * 3000 * len(bounds.groups)
    got = {}
    for r in topk.top_k(data, queries, group_queries=100).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    scores = v @ v.T
    for q in range(3000):
        if q % 100 < 20:
            best = sorted((-int(scores[q, j]), j) for j in range(3000) if j != q)[:10]
            assert [got[q][k + 1] for k in range(10)] == [(j, -s) for s, j in best]


def test_compact_windows(docs, rows, nothing):
    got = {r.doc_id: r for r in compact_windows.find_passages(docs).collect()}
    first, second = 29, 30
    assert got[second].class_id == got[first].class_id and got[second].n_dup_words >= 68
    assert got[5].n_links == 0 and got[5].n_dup_words == 0
    assert compact_windows.find_passages(nothing).count() == 0


def test_compact_windows_are_all_and_widest(monkeypatch):
    rng = random.Random(4)
    for _ in range(150):
        monkeypatch.setattr(compact_windows, "STEP", rng.choice([16, 64, 1 << 15]))
        n, span, seed = rng.randint(0, 200), rng.choice([5, 10, 46]), np.uint64(rng.randrange(1 << 63))
        tokens = np.array([rng.randint(0, rng.choice([5, 1000000])) for _ in range(n)], np.uint64)
        starts = np.array([0, *sorted(rng.randint(0, n) for _ in range(rng.randint(0, 4))), n])
        c, value = compact_windows.wide_tokens(tokens, starts, seed, span)
        every = ((tokens * (seed | np.uint64(1))) >> np.uint64(1)).view(np.int64) & ~compact_windows._POS
        want = {i + int(np.argmin(every[i : i + span])) for a, b in zip(starts[:-1], starts[1:]) for i in range(a, b - span + 1)}
        assert c.tolist() == sorted(want)
        for p, l, r in zip(c, *compact_windows.windows(c, value, starts)):
            text = np.searchsorted(starts, p, side="right") - 1
            first, last = p, p
            while first > starts[text] and every[first - 1] > every[p]:
                first -= 1
            while last + 1 < starts[text + 1] and every[last + 1] >= every[p]:
                last += 1
            assert (l, r) == (first, last)


def test_interval_join_sweeps_all_groups():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 40)
        g = np.sort([rng.randint(0, 3) for _ in range(n)])
        l = np.array([rng.randint(0, 120) for _ in range(n)])
        r, k = l + np.array([rng.randint(1, 90) for _ in range(n)]), np.array([rng.randint(0, 3) for _ in range(n)])
        want = []
        for x in range(4):
            inside = [len({int(kk) for gg, ll, rr, kk in zip(g, l, r, k) if gg == x and ll <= p < rr}) >= 2 for p in range(220)] + [False]
            begins = [p for p in range(220) if inside[p] and (p == 0 or not inside[p - 1])]
            want += [(x, p, inside.index(False, p)) for p in begins if inside.index(False, p) - p >= 50]
        assert list(zip(*(v.tolist() for v in compact_windows._overlaps(g, l, r, k)))) == want


def test_shared_runs():
    rng = random.Random(5)
    for _ in range(300):
        base = [rng.choice([1, 2, 3, 3, 3]) for _ in range(rng.randint(5, 20))]
        p = base + [rng.choice([3, 4]) for _ in range(rng.randint(0, 20))]
        q = [rng.choice([3, 5]) for _ in range(rng.randint(5, 20))] + base
        same = {(i, j) for i in range(len(p) - 4) for j in range(len(q) - 4) if p[i : i + 5] == q[j : j + 5]}
        want = set()
        for i, j in same:
            if (i - 1, j - 1) not in same:
                n = next(n for n in range(1, 99) if (i + n, j + n) not in same)
                want.add((i, i + n + 4, j - i))
        got = set(zip(*(v.tolist() for v in compact_windows._runs(np.array(p, np.uint64), np.array(q, np.uint64)))))
        # of one word repeated in both, only the diagonals on which the starts or the ends meet
        assert got <= want and all(len(set(p[a:b])) == 1 for a, b, _ in want - got)


def test_furthest_alignments():
    rng = random.Random(1)
    for _ in range(200):
        p, q = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        i, j = rng.randint(0, len(p)), rng.randint(0, len(q))
        for way, a, b in ((1, p[i:], q[j:]), (-1, p[:i][::-1], q[:j][::-1])):
            for e, (x, y) in enumerate(compact_windows._far(p, q, i - (way < 0), j - (way < 0), way, 4)):
                assert near_dedup._plain(a[:x], b[:y], 99) <= e
                assert x == max(k for k in range(len(a) + 1) if any(near_dedup._plain(a[:k], b[:m], 99) <= e for m in range(len(b) + 1)))


def test_compact_windows_side_by_side(spark):
    rng = random.Random(11)
    p, q, r = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    texts = [" ".join([p, prose(rng, 300), q, prose(rng, 30), r]), f"{p} {q}", f"{r} {p}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in compact_windows.find_passages(docs).collect()}
    assert all(got[i].n_dup_words == 120 and got[i].class_id == 0 for i in (1, 2))
    hashes = lambda text: np.array([hash(w) & (1 << 62) - 1 for w in text.split()], np.uint64)
    assert compact_windows.passages(hashes(f"{p} {q}"), hashes(" ".join([q, prose(rng, 300), p]))) == [(0, 60), (60, 120)]
    assert compact_windows.passages(np.full(300, 7, np.uint64), np.full(200, 7, np.uint64)) == [(0, 300)]
    # words replaced all over: what is found is alike, and nearly all of it is found
    for alike, step in ((0.95, 20), (0.9, 10), (0.85, 7)):
        near = p.split()
        near[3::step] = ["zz"] * len(near[3::step])
        mine, theirs = hashes(" ".join([prose(rng, 40), *near, prose(rng, 40)])), hashes(" ".join([prose(rng, 30), p, prose(rng, 30)]))
        [(a, b)] = compact_windows.passages(mine, theirs)
        assert 38 <= a <= 45 and 95 <= b <= 102, (alike, a, b)


def test_compact_windows_near_copies(spark):
    rng = random.Random(12)
    texts, words = {}, [prose(rng, 1) + str(i) for i in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    for i in range(40):
        p = some(60)
        near = list(p)
        for k in rng.sample(range(60), 11):
            near[k] = some(1)[0]
        texts |= {i: some(80) + p + some(80), 100 + i: some(60) + near + some(70)}
        # most of the passage stands in a still earlier text, but not enough of it for that text to be a copy
        q = some(60)
        texts |= {1000 + i: some(80) + q[:45] + some(80), 1100 + i: some(70) + q + some(60), 1200 + i: some(50) + q + some(90)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {(r.m, r.lead) for r in compact_windows.near_passages(docs).collect()}
    assert sum((100 + i, i) in got for i in range(40)) >= 38
    assert sum((1200 + i, 1100 + i) in got for i in range(40)) >= 39


def test_quality_trains_on_the_whole_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.ByteCNN, "fit", lambda self, texts, labels: seen.append((texts, labels)) or self)
    docs = spark.createDataFrame([(i, "a" * 20000 + "b" * 60000 + "c" * 20000) for i in (1, 2, 3)] + [(4, None), (5, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int")
    quality.train(docs, labels)
    quality.train(docs.repartition(3), labels)
    assert seen[0] == seen[1]
    long = [t for t in seen[0][0] if len(t) > 1]
    assert long and all(len(t) == quality.EPOCHS and {len(c) for c in t} == {quality.TRAIN_BYTES} and set(b"".join(t)) == set(b"abc") for t in long)


def test_words_are_those_of_the_contract():
    text = "Ünï A-b C3 d_e 中文\x7f.z"
    assert [w.decode() for w in words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_pipeline_keeps_whole_classes(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {}
    for name, stage in c.STAGES:
        docs = c.materialise(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        out[name] = docs
    once = out["MinHash near-dedup"]
    assert 0 < once.count() <= out["quality classifier"].count() and once.select("text").distinct().count() == once.count()
    assert docs.count() == out["mixing sources to target weights"].count()
    assert all(list(d.columns) == list(once.columns) for n, d in out.items() if n != c.STAGES[-1][0])


CLASHING = ("score", "runs", "__runs", "n_words", "n_hit", "item_ids", "size", "taken", "target", "shard", "rest", "first", "blk", "words", "id", "key", "class_id", "__text")


def test_pipeline_carries_clashing_columns(spark):
    import corpus_pipeline as c

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = base.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    twice = base.limit(2).withColumn("text", F.concat("text", F.lit(" and more words of another text here")))
    plain = base.unionByName(more).unionByName(twice).unionByName(base.limit(1)).withColumn("text", F.when(F.col("doc_id") % 50 != 7, F.col("text")))
    wide = plain.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in CLASHING])
    for name, stage in c.STAGES:
        a, b = (c.materialise(stage(spark, d, "/root/testdata/sf0.001"), "test") for d in (plain, wide))
        key = lambda d: sorted(map(str, d.select(*plain.columns).collect()))
        if name == c.STAGES[-1][0]:
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
            continue
        assert b.columns == wide.columns and key(a) == key(b), name
        for n in CLASHING:
            assert b.where(F.col(f"`{n}`") != F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).count() == 0, (name, n)


def test_pipeline_stages_against_plain_ones(spark):
    """What each stage keeps, worked out again without Spark from the rows it was given."""
    import collections

    import corpus_pipeline as c
    from ohmloom.llm.common import word_hashes

    sf = "/root/testdata/sf0.001"
    tokenizer = PieceEncoder(default_path()).tokenizer
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in c.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = c.materialise(stage(spark, docs, sf), "test")
        if name == "token-ID / binary output":
            at = 0
            for r, (d, t, _) in zip(docs.orderBy("start").collect(), sorted(before)):
                ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
                assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
                at += len(ids)
            continue
        after = collections.Counter((r.doc_id, r.text, r.source) for r in docs.collect())
        if name == "quality classifier":
            model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            for row in before:
                raw = np.frombuffer((row[1] or "").encode(), np.uint8)
                p = float(model.scores(raw, np.array([0, len(raw)]))[0])
                assert abs(p - 0.5) < 1e-5 or (after[row] == 1) == (p >= 0.5)
        elif name == "MinHash near-dedup":
            # all pairs, whether they share a key or not: on this table none of the alike ones is missed
            rows = sorted(before)
            seqs = [word_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for _, t, _ in rows]
            own = list(range(len(rows)))
            for i in range(len(rows)):
                for j in range(i):
                    if own[i] != own[j] and (near_dedup.alike(seqs[i], seqs[j]) if len(seqs[i]) and len(seqs[j]) else rows[i][1] == rows[j][1]):
                        a, b = own[i], own[j]
                        own = [min(a, b) if o in (a, b) else o for o in own]
            assert after == collections.Counter(r for i, r in enumerate(rows) if own[i] == i)
        elif name == "benchmark decontamination":
            cut = lambda t: [w.decode() for w in words_of(t.encode())]
            windows = {tuple(w[i : i + 13]) for w in map(cut, benchmark) if w for i in range(max(1, len(w) - 12))}
            for row in before:
                w = cut(row[1] or "")
                hit = {k for p in windows for i in range(len(w) - len(p) + 1) if w[i] == p[0] and tuple(w[i : i + len(p)]) == p for k in range(i, i + len(p))}
                assert (after[row] == 0) == (bool(hit) and 20 * len(hit) >= len(w))
        else:
            taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, source string")).collect()}
            assert all(after[row] == (int(taken[row[0]][0] / taken[row[0]][1] + 0.5) if taken[row[0]][1] else 0) for row in before)


def test_lower_bound_of_distance():
    rng = random.Random(8)
    for _ in range(400):
        a = np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 200))], np.uint64)
        b = np.array([x if rng.random() > 0.2 else rng.randint(0, 30) for x in a if rng.random() > 0.1] or [1], np.uint64)
        label = near_dedup.labelled(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = [np.frombuffer(near_dedup.word_bits(x).tobytes(), np.uint64) for x in (label[: len(a)], label[len(a) :])]
        assert near_dedup.flips(*bits) + abs(len(a) - len(b)) <= 2 * near_dedup._plain(a.tolist(), b.tolist(), 999)


def test_labels_do_not_depend_on_the_texts_beside():
    alone = near_dedup.labelled(np.array([1, 2, 3], np.uint64), np.array([0, 3]))
    beside = near_dedup.labelled(np.array([1, 2, 3, 4, 4], np.uint64), np.array([0, 3, 5]))
    assert (alone == beside[:3]).all() and beside[3] != beside[4]


def test_compact_windows_fetch_few_stretches_of_a_leader(spark, monkeypatch):
    rng, seen = random.Random(12), {}
    keep = compact_windows.materialise
    monkeypatch.setattr(compact_windows, "materialise", lambda df, name, **how: seen.setdefault(name, keep(df, name, **how)))
    leader = prose(rng, 400).split()
    texts = [(0, " ".join(leader))]
    for i in range(1, 150):
        at, n = rng.randrange(300), rng.randrange(60, 100)
        texts.append((i, " ".join([prose(rng, rng.randrange(5, 60)), *leader[at : at + n], prose(rng, 30)])))
    got = {r.m for r in compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).where("lead = 0").collect()}
    assert len(got) >= 147
    spans = seen["windows-candidates"].where("lead = 0").select("x", "y").distinct().collect()
    assert len(spans) <= 36 and all(r.x % compact_windows.EDGE == r.y % compact_windows.EDGE == 0 for r in spans)


def test_shuffled_rows_go_with_the_write(spark):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    for release in (True, False):
        rows = materialise(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "released", release=release)
        assert (files() > before) != release and rows.count() == 10


def test_near_dedup_and_pipeline_keep_no_shuffled_rows(spark, docs, monkeypatch):
    """Every table that is written frees the shuffled rows that led to it: none wait for the driver's garbage collection."""
    import corpus_pipeline as c

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = held()
    near_dedup.classes(docs)
    assert not held() - before
    monkeypatch.setattr(c, "STAGES", [("all", lambda spark, docs, sf_dir: docs.repartition(3, "doc_id"))])
    monkeypatch.setattr(c, "table", lambda spark, sf_dir, name: docs)
    c.run(spark, "")
    assert not held() - before


def test_compact_windows_meet_later_documents_too(spark, monkeypatch):
    """A passage whose every signature stands in still earlier texts links the two later ones that hold all of it; a text has a
    link to each other one, equal texts to their first only."""
    monkeypatch.setattr(compact_windows, "PAIRS", 50, raising=False)
    rng, texts = random.Random(21), {}
    for i in range(0, 200, 10):
        q = prose(rng, 60).split()
        for k in range(4):
            texts |= {i + 2 * k: " ".join([prose(rng, 60), *q[:34], prose(rng, 60)]), i + 2 * k + 1: " ".join([prose(rng, 60), *q[26:], prose(rng, 60)])}
        texts |= {i + 8: " ".join([prose(rng, 70), *q, prose(rng, 50)]), i + 9: " ".join([prose(rng, 40), *q, prose(rng, 80)])}
    p = prose(rng, 80)
    texts |= {1000 + i: f"{prose(rng, 40)} {p} {prose(rng, 30)}" for i in range(6)}
    texts |= {2000: texts[1000], 2001: texts[1000], 2002: "short", 2003: "short"}
    got = {r.doc_id: r for r in compact_windows.find_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(got[i + 9].class_id == i + 8 and got[i + 9].n_dup_words >= 60 for i in range(0, 200, 10))
    assert all(got[i + k].n_links == 0 for i in range(0, 200, 10) for k in range(8))
    assert [got[1000 + i].n_links for i in range(6)] == [7, 5, 5, 5, 5, 5] and got[2000].n_links == got[2001].n_links == 1
    assert got[2001].n_dup_words == len(texts[1000].split()) and got[2003].class_id == 2003


def test_compact_windows_reject_as_the_shared_words_do():
    rng = np.random.default_rng(3)
    for _ in range(300):
        theirs = rng.integers(0, 40, rng.integers(60, 160)).astype(np.uint64)
        pieces = []
        for _ in range(rng.integers(1, 6)):
            mine = rng.integers(0, 40, rng.integers(50, 140)).astype(np.uint64)
            n = int(rng.integers(0, min(len(mine), len(theirs))))
            mine[:n] = np.where(rng.random(n) < rng.choice([0.1, 0.2, 0.3]), rng.integers(0, 40, n).astype(np.uint64), theirs[:n])
            pieces.append(mine)
        size = np.array([len(x) for x in pieces])
        codes, there = [compact_windows._pairs_of_words(x) for x in pieces], set(compact_windows._pairs_of_words(theirs)[:-1].tolist())
        may = compact_windows._may_agree(np.isin(np.concatenate(codes), list(there)), np.cumsum(size) - size, size)
        for x, code, possible in zip(pieces, codes, may):
            worth = np.append(0, np.cumsum([2 if w in there else -3 for w in code[:-1].tolist()]))
            assert possible == any(worth[j] >= worth[i] - 2 for i in range(len(worth)) for j in range(i + 49, len(worth)))
            assert possible or not compact_windows.passages(x, theirs)


def test_compact_windows_send_words_of_few_candidates_of_a_common_line(spark, monkeypatch):
    """Texts that share no more than a line are candidates of each other, but no words are sent for them; those that share a
    passage around it are all found."""
    rng, seen = random.Random(31), {}
    keep = compact_windows.materialise
    monkeypatch.setattr(compact_windows, "materialise", lambda df, name, **how: seen.setdefault(name, keep(df, name, **how)))
    line, passage = prose(rng, 18), prose(rng, 45)
    texts = [(i, f"{prose(rng, 60)} {line} {prose(rng, 60)}") for i in range(80)] + [(100 + i, f"{prose(rng, 60)} {line} {passage} {prose(rng, 60)}") for i in range(8)]
    found = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).select("m", "lead").distinct().collect()
    assert {(r.m, r.lead) for r in found} == {(100 + i, 100 + k) for i in range(8) for k in range(i)}
    # the last table of candidates is the one that words are sent for
    pairs = [df.select("m", "lead").distinct().count() for df in seen.values() if {"m", "lead", "x", "y"} <= set(df.columns)]
    assert pairs[0] > 1000 and 28 <= pairs[-1] < 50


def test_compact_windows_lose_nothing_to_the_sets_of_pairs():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    for _ in range(40):
        theirs, mine = [rng.choice(words, 150).tolist() for _ in range(2)], [rng.choice(words, 200).tolist() for _ in range(3)]
        for x in mine:
            at = int(rng.integers(0, 80))
            x[at : at + 60] = np.where(rng.random(60) < rng.choice([0.05, 0.15, 0.25]), rng.choice(words, 60), theirs[int(rng.integers(2))][40:100])
        docs = pa.table({"doc_id": pa.array([10, 11, 12], pa.int64()), "text": [" ".join(x) for x in mine]})
        earlier = pa.table({"doc_id": pa.array([1, 1], pa.int64()), "text": [" ".join(x) for x in theirs]})  # two rows of one doc_id
        one = {"blk": 0, "lead": 1, "x": 0, "y": 150}
        rows = [one | {"m": 10 + t, "t": t, "a": 0, "b": 200, "theirs": None} for t in range(3)]
        spans = pa.table({"lead": pa.array([1], pa.int64()), "dest": pa.array([0], pa.int32()), "x": [0], "y": [150]})
        schema = pa.schema([("blk", pa.int32()), ("m", pa.int64()), ("t", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("lead", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("theirs", pa.binary())])
        beside = lambda some, fetch: pa.Table.from_pylist(some + fetch(earlier, spans).to_pylist(), schema)
        left = compact_windows._reject(docs, beside(rows, compact_windows._fetch_pairs)).to_pylist()
        whole, rest = [compact_windows._verify(docs, beside(some, compact_windows._fetch)).to_pylist() for some in (rows, left)]
        assert whole == rest and all("theirs" not in r for r in left)


def test_a_worker_keeps_the_tables_of_one_operator_only():
    """The encoder's pieces go when the automaton is needed, and the other way round; asked again, the same one is given."""
    import weakref

    from ohmloom.llm import common, tokens

    one = weakref.ref(tokens.encoder(default_path()))
    assert tokens.encoder(default_path()) is one()
    scan = weakref.ref(common.held(("scanner", b"k"), lambda: decontamination.Scanner([("a", b"one two three")])))
    assert one() is None and scan() is not None
    tokens.encoder(default_path())
    assert scan() is None
