"""Each registered query, and the pipeline, on a small folder of odd tables, against plain Python or the libraries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from loomspark.llm import jaccard_join, queries

R = random.Random(21)
GOOD = [f"{a}{b}" for a in ("wa", "ne", "thi", "sor", "mel") for b in ("ter", "ving", "nd", "lo", "st", "rin")]
RARE = [f"r{i}x" for i in range(900)]
ITEMS = [(i, " ".join(R.sample(RARE, R.randint(10, 30))).capitalize() + "? " + " ".join(R.sample(RARE, R.randint(2, 5))) + ".") for i in range(20)] + [(20, None), (21, ""), (3, "Again one. Two words.")]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]


def prose(n):
    return ". ".join(" ".join(R.choice(GOOD + RARE[:200]) for _ in range(9)).capitalize() for _ in range(max(1, n // 9))) + "."


def junk(n):
    return "".join(R.choice("#$%&*@!0123456789ABC \n") for _ in range(n * 6))


def texts():
    out = [(i, prose(R.randint(5, 120))) for i in range(140)]
    out += [(200 + i, junk(R.randint(5, 80))) for i in range(110)]
    out += [(400 + i, out[i][1]) for i in range(12)] + [(430 + i, out[3][1]) for i in range(20)]  # copies, a large group
    for i in range(20):  # near copies
        w = out[20 + i][1].split(" ")
        w[len(w) // 2] = "changed"
        out.append((500 + i, " ".join(w)))
    for i in range(10):  # benchmark passages, upper-cased and amid prose
        out.append((600 + i, f"{prose(60)} {ITEMS[i][1].upper()} {prose(40)}"))
    out += [(700 + i, f"{prose(30)} {x} {prose(9)}") for i, x in enumerate(("The MIT License, Apache\nLicense; GNU General Public License", "licensed undr the Apache Licence, version 2.0", "mit mit license license", "Licensed under CC BY-SA 4.0"))]
    out += [(800, None), (801, ""), (802, " \n\t "), (803, "é"), (804, "a" * 3000), (805, prose(6000)), (806, "▁ ▁x don't  I'll"), (0, out[0][1]), (2**62 + 5, prose(30)), (-4, "")]
    return out


DOCS = texts()
LABELS = [(i, 1, 0) for i in range(0, 140, 2)] + [(200 + i, 0, 1) for i in range(0, 110, 2)] + [(0, 1, 0), (99_999, 1, 0), (None, 1, 0)]
URLS = ["https://A.Example.com/en/7x?q", "http://b.com/en/", "http://notcom/en/", "ftp://x.net/de/8", "http://example.net/de/81", None, "nothing", "http://o.org/es/#f", "http://o.org/fr/", "http://com/en/", "://", "http://a." + "b." * 300 + "com/en/9"] + ["http://b.com/en/hot"] * 40
UDF = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text string, key string, size int, node bigint, text_sha256 string, digest string, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "xx", "web", len(t or ""), "i", "t", "k", 1, 2, "s", "d", 0.1) for i, t in DOCS], UDF).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, u, None, 1, "h", "p", "b") for i, u in enumerate([*URLS, URLS[0]])], "page_id bigint, url string, html string, _best int, _host string, _path string, _rule string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


NAMES = list(queries.queries())
fold = lambda i, n: zlib.crc32(str(i).encode()) % n


def found(spark, folder, name):
    return driver.queries()[name](spark, folder).collect()


def keyed(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_empty_tables_give_no_rows(spark, empty, name):
    assert found(spark, empty, name) == []


def test_op1(spark, folder):
    rows = found(spark, folder, "op1_pu_quality")
    assert keyed(rows, "doc_id", "held_out", "predicted") == sorted(((r["doc_id"], fold(r["doc_id"], 4) == 2, int(r["score"] >= 0.7)) for r in rows), key=repr)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in DOCS) and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    of_text = {}
    for i, t in DOCS:
        assert of_text.setdefault(t or "", score[i]) == score[i]  # nothing but the text counts
    held = [(i < 200, score[i] >= 0.7) for i in [*range(140), *range(200, 310)] if fold(i, 4) == 2]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
spaced = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contaminated(docs, items, threshold=0.5, least=0.5):
    """{(doc, item): score} by BM25 over all windows and items, without an index."""
    items = [(i, alnum(t), [alnum(p) for p in halves(t)]) for i, t in items if t and alnum(t)]
    n, mean = len(items), sum(len(w) for _, w, _ in items) / len(items)
    df = Counter(x for _, w, _ in items for x in set(w))
    window = max(32, 2 * max(len(w) for _, w, _ in items))
    step = window // 2

    def impacts(w):
        s = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in Counter(w).items()}
        return {x: v / sum(s.values()) for x, v in s.items()}

    def grams(w, k):
        return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()

    weighed = [(i, impacts(w), parts) for i, w, parts in items]
    out = {}
    for d, t in docs:
        w = alnum(t)
        for lo in range(0, max(len(w), 1), step):
            seen, near = set(w[lo : lo + window]), w[max(0, lo - step) : lo + window + step]
            for i, own, parts in weighed:
                s = sum(v for x, v in own.items() if x in seen)
                if s >= threshold - 1e-9 and s > out.get((d, i), -1):
                    shares = []
                    for p in parts:
                        g = grams(p, min(5, len(p)))
                        shares.append(len(g & grams(near, min(5, len(p)))) / len(g) if g else 1.0)
                    if min(shares) >= least:
                        out[d, i] = s
    return out


def halves(text):
    parts = [p for p in re.split(r"(?<=[?.!])", text) if p.strip()]
    if len(parts) > 1:
        return "".join(parts[:-1]), parts[-1]
    w = text.split()
    n = max(1, len(w) // 3)
    return " ".join(w[:-n]), " ".join(w[-n:])


def test_op2(spark, folder):
    want = brute_contaminated(DOCS, ITEMS)
    got = {}
    for r in found(spark, folder, "op2_decontamination"):
        got[r["doc_id"], r["item_id"]] = max(r["score"], got.get((r["doc_id"], r["item_id"]), 0))
    assert {(600 + i, i) for i in range(10)} <= set(got)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op6_url_filter"])
def test_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(driver.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert keyed(found(spark, folder, name), *cols) == sorted(want.fetchall(), key=repr)


def grams5(t):
    w = spaced(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(docs):
    """class and links of each row, by all pairs of different sets."""
    sets = sorted({grams5(t) for _, t in docs} - {frozenset()}, key=lambda s: sorted(s))
    up, links = list(range(len(sets))), Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                up[top(a)] = top(b)
                links[a] += 1
                links[b] += 1
    at = {s: k for k, s in enumerate(sets)}
    least = {}
    for i, t in docs:
        if grams5(t):
            c = top(at[grams5(t)])
            least[c] = min(i, least.get(c, i))
    return [(i, least[top(at[grams5(t)])], links[at[grams5(t)]]) if grams5(t) else (i, i, 0) for i, t in docs]


def test_op4(spark, folder):
    assert keyed(found(spark, folder, "op4_jaccard_join"), "doc_id", "class_id", "n_links") == sorted(classes(DOCS), key=repr)


def test_op4_with_one_id_for_several_texts_and_none(spark):
    a, b = prose(60), prose(60)
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, ""), (4, prose(40)), (2**63 - 1, b + " z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["_id"], r["class_no"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs)[0].collect()]
    assert sorted((i for i, _, _ in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    members = Counter(c for _, c, _ in got if c is not None)
    assert sorted(members.values()) == [1, 3, 3]  # a with its copies; b, its copy and the near one; the other text
    assert sorted(n for _, _, n in got) == [0] * 5 + [1] * 3
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(docs).collect()]
    assert {1, 4, None} == {i for i, _ in kept} and (1, a) in kept and (1, b) in kept


def test_op5(spark, folder):
    from test_operators import brute_kneser_ney

    want = brute_kneser_ney([t for i, t in DOCS if fold(i, 10) != 0], [t for _, t in DOCS])
    total = sum(len(spaced(t)) + 1 for i, t in DOCS if fold(i, 10) != 0)
    want = sorted(((i, fold(i, 10) == 0, len(spaced(t)) + 1, known, total, round(base, 6), round(score, 6)) for (i, t), (score, known, base) in zip(DOCS, want, strict=True)), key=repr)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found(spark, folder, "op5_kneser_ney")]
    for a, b in zip(sorted(got, key=repr), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_op7(spark, folder):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    at, want = 0, []
    for i, t in sorted(DOCS, key=lambda x: x[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(keyed(found(spark, folder, "op7_token_file"), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1]) == want


def pieces(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    ids = [(i, lib.encode(t or "")) for i, t in docs]
    return sorted(((i, len(x), zlib.crc32(np.array(x, "<i4").tobytes())) for i, x in ids), key=repr)


def test_op8(spark, folder):
    rows = found(spark, folder, "op8_sentencepiece")
    assert keyed(rows, "doc_id", "n_ids", "ids_crc32") == pieces(DOCS) and all(r["decoded_equal"] for r in rows)


def test_op9(spark, folder):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = {}
    for i, t in DOCS:
        w = alnum(t)
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[i] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
    rows = found(spark, folder, "op9_license_scan")
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows} == want and len(rows) == len(DOCS)
    for r in rows:
        own, more = set(filter(None, r["base_labels"].split(","))), set(filter(None, r["labels"].split(",")))
        assert more == own | set(r["span_labels"]) and 0 <= r["score"] <= 1 and bool(more) == (r["score"] > 0)
        text = re.sub("[A-Z]", lambda m: m[0].lower(), dict(DOCS)[r["doc_id"]] or "").encode()
        assert all(0 <= a < b <= len(text) for a, b in zip(r["span_starts"], r["span_ends"], strict=True))
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert (labels[701], labels[703]) == ("apache", "cc")


def test_op10(spark, folder):
    rows = found(spark, folder, "op10_sharding")
    raw = lambda t: (t or "").encode()
    assert keyed(rows, "doc_id", "size", "text_crc32") == sorted(((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in DOCS), key=repr)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    total, slots, of_group, group = Counter(), {}, {}, Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
        of_group.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        group[r["size"], r["text_crc32"]] += r["size"]
    assert all(len(s) == 1 for s in of_group.values()) and set(total) == set(range(40))
    for own in slots.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own))) and [i for _, i in sorted(own)] == sorted(i for _, i in own)
    share = sum(total.values()) / 40
    large = {s for g, n in group.items() if n > share for s in of_group[g]}
    rest = [n for s, n in total.items() if s not in large]
    assert max(rest) - min(rest) <= 0.05 * max(rest)  # some seven groups a shard


def test_pipeline(spark, folder):
    score = {r["doc_id"]: r["score"] for r in found(spark, folder, "op1_pu_quality")}
    docs = [(i, t) for i, t in DOCS if score[i] >= 0.7]
    best = {}
    for i, t in docs:
        best[t or ""] = max(i, best.get(t or "", i))
    docs = sorted({(i, t) for i, t in docs if best[t or ""] == i}, key=repr)
    docs = [(i, t) for (i, t), (_, c, _) in zip(docs, classes(docs), strict=True) if i == c]
    bad = {d for d, _ in brute_contaminated(docs, ITEMS)}
    docs = [(i, t) for i, t in docs if i not in bad]
    assert len(docs) > 60 and keyed(corpus_pipeline.run(spark, folder).collect(), "doc_id", "n_ids", "ids_crc32") == pieces(docs)
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == columns
