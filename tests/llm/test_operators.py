"""Each operator against brute force or a library, with the odd cases: nulls, empty and long texts, repeats, no rows, clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import common, decontaminate, exact_dedup, id_coder, jaccard_join, kn_lm, license_scan, pu_quality, queries, sentencepiece_trie, sharding, token_file, url_filter

SCHEMA = "doc_id bigint, text string, _id string, size int, kept string, key string, score double"
rng = random.Random(4)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(rng.choice(WORDS) for _ in range(20_000))
TEXTS = ["", None, "One two.", "one two. ", "don't  stop\n\nmy é 日本 x̂!!", "MIT License here. Licensed under the Apache License, Version 2.0.", "licensed undr the apache license, version 2.O ok", LONG, "One two.", None]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "x", 1, "k", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1] if rows else [], SCHEMA)


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_all_odd_cases(spark, texts):
    docs = frame(spark, texts)
    n = docs.count()
    items = spark.createDataFrame([(1, None), (2, "w1 w2"), (2, "w1 w2")], "item_id bigint, text string")
    sp, bpe = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("byte_bpe_50k.json")
    labels = spark.createDataFrame([(0, 1), (0, 1), (99, 1), (3, 0), (None, 1)], "doc_id bigint, quality int")
    scorer = pu_quality.fit(docs, labels, queries.fold(4) != 2)
    scores = pu_quality.score(docs, scorer).collect()
    assert len(scores) == n and all(0 <= r["score"] <= 1 for r in scores)
    assert pu_quality.keep_good(docs, scorer, 0.0).count() == n
    assert decontaminate.contaminated(docs, items).count() >= 0
    groups = exact_dedup.exact_groups(docs, digest_all=True).collect()
    assert len(groups) == n
    assert exact_dedup.keep_one(docs).columns == docs.columns
    assert exact_dedup.keep_one(docs).count() == len({t or "" for t in texts})
    assert jaccard_join.jaccard_classes(docs)[0].count() == n
    model = kn_lm.fit(docs)
    lm = kn_lm.score(docs, model).collect()
    assert len(lm) == n and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in lm)
    folder = token_file.write(docs, bpe, end_id=2)
    assert token_file.read(spark, folder).count() == n
    encoded = sentencepiece_trie.encode(docs, sp)
    assert encoded.where("decoded_equal").count() == n
    assert {r["_id"]: r["text"] for r in sentencepiece_trie.decode(encoded, sp).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert license_scan.scan(docs).count() == n
    shards = sharding.shard(docs, 4).collect()
    assert len(shards) == n
    for s in range(4):
        own = sorted(r["slot"] for r in shards if r["shard"] == s)
        assert own == list(range(len(own)))


def test_exact_dedup_keeps_the_largest_id(spark):
    kept = {r["doc_id"] for r in exact_dedup.keep_one(frame(spark)).collect()}
    assert kept == {3, 4, 5, 6, 7, 8, 9}


def test_libraries_agree():
    import sentencepiece
    from tokenizers import Tokenizer

    odd = ["".join(rng.choice("ab'sltrevmd  \n.!1é ▁日") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    f = queries.tokenizer_file("byte_bpe_50k.json")
    own, lib = token_file.Tokens(f), Tokenizer.from_file(f)
    for i, j, buf, off in common.chunks(pa.array(odd), 2000):
        ids, first = own(buf, off, None)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in odd[i:j]]
    f = queries.tokenizer_file("piece_bpe_32k.model")
    own, lib = sentencepiece_trie.Encoder(f), sentencepiece.SentencePieceProcessor(model_file=f)
    for i, j, buf, off in common.chunks(pa.array([t.replace("▁", " ") for t in odd]), 2000):
        ids, first = own.encode(buf, off)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [lib.encode(t) for t in odd[i:j]]


def test_unigram_walk_is_the_best_sum():
    e = sentencepiece_trie.Encoder(queries.tokenizer_file("piece_bpe_32k.model"), unigram=True)

    def best(w):
        top = [(0.0)] + [None] * len(w)
        for i in range(1, len(w) + 1):
            top[i] = max(top[j] + e.score[w[j:i]] for j in range(i) if w[j:i] in e.score and top[j] is not None)
        return top[-1]

    words = sorted({"▁the", "▁there", "▁therein", "▁thing", "ending", "end"})
    names = {v: k for k, v in e.ids.items()}
    for w, ids in zip(words, e.walk(words)):
        pieces = [names[i] for i in ids]
        assert "".join(pieces) == w and sum(e.score[p] for p in pieces) == pytest.approx(best(w))


@pytest.mark.parametrize("n", [0, 1, 7, 255, 5000, 70_000])
def test_id_coder_round_trip(n, monkeypatch):
    monkeypatch.setattr(id_coder, "BLOCK", 30_000)
    ids = np.array([rng.choice([0, 1, 2, 1023, 1024, 50_256, 2**32 - 1, rng.randrange(3000)]) for _ in range(n)], np.uint32)
    blocks = list(id_coder.encode_blocks(ids))
    assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *map(id_coder.decode_block, blocks)]), ids)
    if n > 300:
        b = blocks[0]
        with pytest.raises(ValueError):
            id_coder.decode_block((b[0], b[1] ^ 1, *b[2:]))
        damaged = bytearray(b[4])
        damaged[len(damaged) // 2] ^= 4
        with pytest.raises(ValueError):
            id_coder.decode_block((*b[:4], bytes(damaged)))
        with pytest.raises(ValueError):
            id_coder.decode_block((*b[:4], b[4][:-2]))


def test_id_coder_with_more_ids_than_shares(monkeypatch):
    monkeypatch.setattr(id_coder, "SEEN", 100)
    ids = np.array([rng.randrange(400) for _ in range(20_000)], np.uint32)
    assert np.array_equal(id_coder.decode_block(id_coder.encode_block(ids)), ids)


def adaptive_order0(ids):
    """Bits of an adaptive order-0 count that starts from one for each id of the block."""
    n = len(set(ids.tolist()))
    count, bits = dict.fromkeys(ids.tolist(), 1), 0.0
    for k, i in enumerate(ids.tolist()):
        bits -= np.log2(count[i] / (n + k))
        count[i] += 1
    return bits


def test_id_coder_beats_order_0():
    r = np.random.default_rng(3)
    follow = r.integers(0, 500, (500, 3))
    ids = [0]
    for _ in range(60_000):
        ids.append(int(follow[ids[-1], r.integers(3)]) if r.random() < 0.8 else int(r.integers(500)))
    ids = np.array(ids, np.uint32)
    b = id_coder.encode_block(ids)
    assert 8 * (len(b[3]) + len(b[4])) < adaptive_order0(ids)
    same = id_coder.encode_block(np.full(60_000, 9, np.uint32))
    assert len(same[3]) + len(same[4]) < 4000


def thue_morse(n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_no_arithmetic_pattern_meets_another_words_hash():
    words = [*thue_morse(1024), *thue_morse(4096), "a" * 8, "a" * 9, "a" * 2048, "a" * 2049, "b" + "a" * 2048, "abcdefg", "abcdefgh"]
    (_, _, buf, off), = common.chunks(pa.array(words))
    assert len(set(common.hash_spans(buf, off[:-1], off[1:]).tolist())) == len(words)


@pytest.mark.parametrize("bits", [0, 3])
def test_tokens_equal_the_libraries_when_hashes_are_equal(monkeypatch, bits):
    import sentencepiece
    from tokenizers import Tokenizer

    whole = common.hash_pieces
    monkeypatch.setattr(common, "hash_pieces", lambda *a: (whole(*a)[0] & np.uint64(2**bits - 1), whole(*a)[1]))
    texts = [*thue_morse(1024), "the thing of a something, otherwise nothing", "a b  c the thing", "über straße", *thue_morse(64), "x" * 5000]
    f = queries.tokenizer_file("byte_bpe_50k.json")
    own, lib = token_file.Tokens(f), Tokenizer.from_file(f)
    piece, ref = sentencepiece_trie.Encoder(queries.tokenizer_file("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    for _ in range(2):
        for _, _, buf, off in common.chunks(pa.array(texts)):
            ids, first = own(buf, off, None)
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
            ids, first = piece.encode(buf, off)
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ref.encode(t) for t in texts]


def test_token_file_order(spark):
    docs = frame(spark, TEXTS[:7])
    rows = sorted(token_file.read(spark, token_file.write(docs, queries.tokenizer_file("byte_bpe_50k.json"), end_id=2), with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids"][-1] == 2 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        at += r["n_tokens"]
    assert [r["_id"] for r in rows] == sorted(r["_id"] for r in rows)


def test_jaccard_against_brute_force(spark):
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(200)] = "new"
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8 and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    got = {r["_id"]: r["class_id"] for r in jaccard_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))[0].collect()}
    wrong = sum(got[i] != top(i) for i in range(len(texts)))
    assert wrong <= 2  # the target recall is 0.995


def test_decontamination_finds_every_copy(spark):
    items = [(i, f"{' '.join(rng.choice(WORDS) for _ in range(rng.randint(12, 50)))}. {' '.join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))}.") for i in range(40)]
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    planted = {(i, i % 40) for i in range(0, 60, 3)}
    texts = [(i, f"{t[: len(t) // 2]} {items[i % 40][1].upper()} {t[len(t) // 2 :]}" if i % 3 == 0 else t) for i, t in texts]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == planted


def test_license_edits_and_spans():
    data = b"x licensed undr the apache licence, version 2.0 y".lower()
    found = license_scan.Scanner().fuzzy(data, np.array([0, len(data)]))
    assert [(f[3], f[4]) for f in found] == [("apache", 2)] and data[found[0][1] : found[0][2]].startswith(b"licensed")
    assert not license_scan.Scanner().fuzzy(b"a licensed driver under the age of twenty", np.array([0, 41]))


def test_url_rules(spark):
    urls = ["https://A.Example.com/en/7x?q", "http://b.com/en/", "http://notcom/en/", "ftp://x.net/de/8", "http://example.net/de/81", None, "nothing", "http://o.org/es/#f", "http://o.org/fr/"]
    out = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string"), url_filter.rules_frame(spark, queries.RULES)).collect()
    assert [r["_verdict"] for r in sorted(out, key=lambda r: r["page_id"])] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert {r["_rule"] for r in out if r["page_id"] in (0, 3)} == {"example.com/en/7", "net/de/"}


def test_op6_gives_the_word_of_each_rule_in_the_contract(spark, tmp_path):
    urls = {"http://a.com/en/": ("com/en/", "block"), "http://a.example.com/en/7x": ("example.com/en/7", "allow"), "http://a.net/de/": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://o.org/es/": ("org/es/", "block")}
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op6_url_filter(spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == dict(enumerate(urls.values()))


def test_differencing_is_tighter_than_dealing():
    sizes = [np.array([rng.randrange(1, 1000), 0, 0]) for _ in range(60)]
    total, place = sharding.differencing(sizes, 3)
    assert [sum(int(s[0]) for s, p in zip(sizes, place) if p[0] == k) for k in range(3)] == total.tolist() and total.max() - total.min() <= 5


def test_pu_risk_learns():
    r = np.random.default_rng(0)
    pos, neg = r.normal(1, 1, (800, 4)), r.normal(-1, 1, (400, 4))
    unl = np.concatenate([r.normal(1, 1, (800, 4)), neg])
    prior = pu_quality.estimate_prior(pos, unl)
    s = pu_quality.fit_risk(pos, unl, prior)
    assert 0.5 < prior < 0.85 and (s(pos) > 0.5).mean() > 0.9 and (s(neg) < 0.5).mean() > 0.9


def test_word_hashes_tell_words_apart():
    text = "The the a\tb\x0bthe " + "é" * 3
    (_, _, buf, off), = common.chunks(pa.array([text]))
    start, end, _ = common.spans(buf, off, common.SPACE_WORDS)
    h = common.hash_spans(buf, start, end)
    words = re.findall(r"[^\x20\x09-\x0D]+", text.replace("T", "t"))
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))


def test_word_cache_forgets_and_expands():
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(200)]
    cache = common.WordCache(np.int32, 40)
    ids_of = lambda w, m: [len(w), m] * (ord(w[0]) % 3)
    for n in [1, 5, 30, 60, 1, 25, 90, 3] * 4:  # more at once than the cache keeps, too
        drawn = [r.choice(words) for _ in range(n)]
        mark = np.array([r.random() < 0.5 for _ in range(n)])
        (_, _, buf, off), = common.chunks(pa.array(drawn))

        def encode(at, drawn=drawn, mark=mark):
            ids = [ids_of(drawn[i], int(mark[i])) for i in at]
            return np.array([x for own in ids for x in own], np.int32), np.array([len(own) for own in ids])

        flat, at = cache.expand(common.pieces_of(buf), off[:-1], np.diff(off), mark, encode)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids_of(w, int(m)) for w, m in zip(drawn, mark, strict=True)]
        assert cache.n <= 40 + 90


def test_jaccard_links_members_that_leave_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 20)  # the group is above it at every level
    r = random.Random(8)
    base = [f"b{i}" for i in range(200)]

    def edited(words, n):
        out = list(words)
        for i in r.sample(range(len(out)), n):
            out[i] = f"e{r.random()}"
        return out

    members = [edited(base, 1) for _ in range(300)]
    texts = [" ".join(t) for t in members + [edited(members[k], 4) for k in range(60)]]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    linked = {i for i in range(300, 360) if any(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for j, s in enumerate(sets) if j != i)}
    assert len(linked) > 50
    rows, _ = jaccard_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {row["_id"]: row["class_id"] for row in rows.collect()}
    assert all(got[i] == 0 for i in linked) and all(got[i] == i for i in range(300, 360) if i not in linked)


def test_jaccard_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "STEP", 3000)  # several blocks
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(80):
        t = list(base[: r.randint(80, 120)])
        for i in r.sample(range(len(t)), r.randint(0, 3)):
            t[i] = f"e{r.random()}"
        texts.append(" ".join(t))
    texts.append(texts[5])
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    node = [sets.index(s) for s in sets]
    links = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in set(node) for i in set(node) if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    rows, found = jaccard_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {(x["a"], x["b"]): pytest.approx(x["jaccard"]) for x in found.collect()} == links
    assert {x["_id"]: x["n_links"] for x in rows.collect()} == {i: sum(node[i] in pair for pair in links) for i in range(len(texts))}


@pytest.mark.parametrize(
    ("text", "label", "edits"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc", 0),
        ("licensd under CC-BY-4.0", "cc", 1),
        ("This work is licensed under the GNU General Public Licence, version 3.", "gpl", 1),
        ("This work is licensed under the GNU Generl Public License, version 3.", "gpl", 1),
        ("the GNU Generl Public License", "gpl", 1),
        ("an Apache Licence", "apache", 1),
        ("the MIT Licence", "mit", 1),
        ("released under themit license", "mit", 1),
        ("released under the bsd license", None, 0),
        ("released under the permit license", None, 0),
        ("released under the mat license", None, 0),
        ("mit Lizenz, submit licenses", None, 0),
    ],
)
def test_license_short_forms_and_names(text, label, edits):
    data = f"x. {text} y".lower().encode()
    found = license_scan.Scanner().fuzzy(data, np.array([0, len(data)]))
    assert [(f[3], f[4]) for f in found] == ([(label, edits)] if label else [])


def test_license_names_end_with_their_text():
    data = b"xmit licence" + b"licensed under cc by" + b"e"
    found = license_scan.Scanner().fuzzy(data, np.array([0, 1, 12, 32, 33]))
    assert sorted((f[0], f[3]) for f in found) == [(1, "mit"), (2, "cc")]
    assert not license_scan.Scanner().fuzzy(b"llicensed  under cc bye", np.array([0, 23]))


def test_decontamination_verifies_every_passage(spark):
    r = random.Random(5)
    item = [f"q{i}" for i in range(20)]
    scattered = r.sample(item, 20)
    text = " ".join(scattered) + " " + " ".join(f"f{i}" for i in range(100)) + " " + " ".join(item)
    items = [(1, " ".join(item[:15]) + ". " + " ".join(item[15:]) + ".")] + [(k, " ".join(f"i{k}x{i}" for i in range(20)) + ".") for k in range(2, 12)]
    docs, bench = spark.createDataFrame([(7, text), (8, " ".join(scattered))], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert [(x["_id"], x["item_id"], x["question_share"], x["answer_share"]) for x in decontaminate.contaminated(docs, bench).collect()] == [(7, 1, 1.0, 1.0)]


def test_decontamination_weighs_by_all_items(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, " ".join(r.choice(WORDS[: 20 + 10 * i]) for _ in range(r.randint(8, 30))) + ".") for i in range(25)] + [(25, "w1 w2 w3 w4 u5 u6.")]
    texts = [(i, " ".join(r.sample(t.split(), len(t.split())) if i % 2 else t.split()[3:])) for i, t in items]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)

    def hits():
        return {(x["_id"], x["item_id"]): pytest.approx(x["score"]) for x in decontaminate.contaminated(docs, bench, threshold=0.3, question=0.0, answer=0.0).collect()}

    whole = hits()
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 5)
    assert len(whole) > 25 and hits() == whole


def test_jaccard_runs_follow_the_depth_reached(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 10)
    calls = []
    start = jaccard_join._start
    monkeypatch.setattr(jaccard_join, "_start", lambda *a: calls.append(a) or start(*a))
    r = np.random.default_rng(2)
    same = r.integers(0, 2**32, 64, dtype=np.uint32)
    rows = [(2 * i, bytearray(np.where(r.random(64) < 0.3, r.integers(0, 2**32, 64, dtype=np.uint32), same).astype(np.uint32).tobytes())) for i in range(60)]
    jaccard_join.candidates(spark.createDataFrame(rows, jaccard_join.TOKENS), 0.8, 0.9, depth=1)
    assert len(calls) > 1 and [c[0] for c in calls] == [0] + [c[1] for c in calls[:-1]]
    assert calls[0][1] == jaccard_join.runs_for(0.9, 1) < calls[-1][1]


def brute_kneser_ney(train, texts):
    """Plain interpolated modified Kneser-Ney: (score, known tokens, base score) of each text."""
    from collections import Counter, defaultdict
    from math import log10

    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    pairs, uni = Counter(), Counter()
    for t in train:
        w = split(t)
        uni.update(w)
        pairs.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    after, cont = defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        after[a][min(c, 3)] += 1
        after[a]["sum"] += c
        cont[b] += 1
    d_high = kn_lm.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    d_low = kn_lm.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    less = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    g_low = sum(d_low[min(c, 3) - 1] for c in cont.values()) / len(pairs)
    out = []
    for t in texts:
        w = split(t)
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            low = less(cont[b], d_low) / len(pairs) + g_low / (v + 1)
            x = after[a]
            p = (less(pairs[a, b], d_high) + sum(d_high[k - 1] * x[k] for k in (1, 2, 3)) * low) / x["sum"] if x["sum"] else low
            score += log10(p)
        out.append((score, sum(uni[b] > 0 for b in w), sum(log10((uni[b] + 0.1) / (n + 0.1 * (v + 1))) for b in w)))
    return out


def test_kneser_ney_against_brute_force_with_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(kn_lm, "RANGE_BYTES", 400)
    monkeypatch.setattr(kn_lm, "OPEN_RANGES", 2)
    r = random.Random(12)
    texts = [" ".join(r.choice(WORDS[: r.choice([3, 30, 300])]) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["", None, "The THE the é", " ".join(thue_morse(1024))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = kn_lm.fit(docs, where=queries.fold(10) != 0)
    assert model.ranges > 10
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    want = brute_kneser_ney([t for t, h in zip(texts, held) if not h], texts)
    got = sorted(kn_lm.score(docs, model).collect(), key=lambda x: x["_id"])
    for g, (score, known, base) in zip(got, want, strict=True):
        assert (g["score"], g["n_known"], g["base_score"]) == (pytest.approx(score), known, pytest.approx(base))


def test_language_model_maps_few_files(tmp_path, monkeypatch):
    import os

    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    for b, s in kn_lm._dealt(keys, 4096):
        common.write_file(f"{tmp_path}/x-{b}.keys.npy", keys[s])
        common.write_file(f"{tmp_path}/x-{b}.v.npy", np.ones(s.stop - s.start, np.uint8))
    own = kn_lm.Ranges(str(tmp_path), "x", "v", 4096)
    before = len(os.listdir("/proc/self/fd"))
    assert own.get(keys, np.zeros(len(keys), np.int64)).all()
    assert len(os.listdir("/proc/self/fd")) - before <= 3 * kn_lm.OPEN_RANGES


def test_unigram_ids_equal_the_librarys(tmp_path):
    """The public model as a unigram one.  Its piece of score -1e9 gets a usual score: next to it the library's 32-bit sums can't tell paths apart that differ by less than 64."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    for p in m.pieces:
        p.score = max(p.score, -40_000.0)
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    own, lib = sentencepiece_trie.Encoder(str(tmp_path / "u.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["the hest lere. where, on the other hand", "über straße 日本", "a  b   c", "", *(" ".join(rng.choice(["the", "there", "nothing", "est", "ere", "x1", "é"]) for _ in range(40)) for _ in range(50))]
    (_, _, buf, off), = common.chunks(pa.array(texts))
    ids, first = own.encode(buf, off)
    assert own.unigram and [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [lib.encode(t) for t in texts]


@pytest.mark.parametrize("run", [3, 1 << 15])
def test_components_of_chains_and_dense_groups(spark, monkeypatch, run):
    monkeypatch.setattr(jaccard_join, "CONTRACT", run)
    r = random.Random(14)
    links = [(i, i + 1) for i in range(100, 140)] + [(a, b) for a in range(12) for b in range(a)] + [(900, 800), (800, 900), (2**61, 7)]
    r.shuffle(links)
    got = {x["node"]: x["component"] for x in jaccard_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 0 for i in range(12)}, 2**61: 0, 800: 800, 900: 800}
    assert jaccard_join.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
