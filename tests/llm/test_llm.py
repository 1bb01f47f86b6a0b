"""Operators for training data against brute force, the tokenizer library, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docaudit.llm import ann, bpe, common, graph, licenses, mixing, neardup, pii, quality, tokens, topk, warc
from docaudit.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "a b c d e", "É <|endoftext|> ΑΣ İ ½ 日本", "x" * 3000, "word " * 4000, " \x00\x1c", "'LL it's 12345"]


def docs_of(spark, texts, ids=None, extra=True):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"score": F.lit(1), "node": F.lit("x"), "row": F.lit(0), "k": F.lit(2), "n": F.lit(3)}) if extra else df


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


# 1
def brute_warc(rows):
    first, out = {}, []
    for k, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        same = first.setdefault(d, k) == k
        out.append((k, len(b), d, "response" if same else "revisit", None if same else first[d]))
    return sorted(out, key=repr)


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = queries()["op1_warc_revisits"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute_warc(rows)


def test_warc_odd_payloads(spark, tmp_path):
    html = ["a", "a", None, "", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "end\r\n", "end\r\n\r\n", "\r\n\r\n", "é" * 5, "a", "end\r\n"] + ["hot"] * 40
    df = spark.createDataFrame([(100 - i, f"http://x.org/{i}\n" if i % 3 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    warc.write_archives(warc.page_records(df.repartition(3)), a)
    back = warc.read_archives(spark, a, payload=True).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in back) == sorted((100 - i, (h or "").encode()) for i, h in enumerate(html))
    warc.dedup_archives(spark, a, b)
    got = warc.resolve_revisits(spark, b).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute_warc([(100 - i, h) for i, h in enumerate(html)])


# 2 and 5
def test_tokens_match_the_library(spark, library):
    texts = ODD + [r["text"] for r in documents(spark).limit(60).collect()]
    df = docs_of(spark, texts)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r["doc_id"]: r for r in bpe.token_digests(df, bpe.vocabulary()).collect()}
    for i, ids in enumerate(want):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counted = {r["doc_id"]: r for r in tokens.count_tokens(df, bpe.vocabulary(), limit=50).collect()}
    assert all(counted[i]["n_tokens"] == len(ids) and counted[i]["over_limit"] == (len(ids) > 50) and counted[i]["n_bytes"] == len((texts[i] or "").encode()) for i, ids in enumerate(want))
    coded = {r["doc_id"]: r for r in bpe.encode_texts(df, bpe.vocabulary()).collect()}
    assert all(coded[i]["ids"] == ids for i, ids in enumerate(want))


def test_every_code_point_is_encoded_as_the_library_does(library):
    """Each code point as letter, number, mark or symbol, in upper case, and before and after combining marks."""
    own = bpe.loaded(bpe.vocabulary())
    texts = [f"a{c}1 {c}b \u0301{c}\u0327{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for start in range(0, len(texts), 50_000):
        part = texts[start : start + 50_000]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want.ids, text


def test_tokens_of_odd_tables(spark):
    df = docs_of(spark, ["one two", "one two", None], [4, 4, None])
    assert sorted((r["n_tokens"] for r in tokens.count_tokens(df, bpe.vocabulary()).collect())) == [0, 2, 2]
    assert sorted((r["n_tokens"] for r in bpe.token_digests(df, bpe.vocabulary()).collect())) == [0, 2, 2]
    assert tokens.count_tokens(df.where("false"), bpe.vocabulary()).count() == bpe.token_digests(df.where("false"), bpe.vocabulary()).count() == 0


def test_caches_stay_within_their_bytes():
    made = []
    cache = common.BoundedCache(lambda k: made.append(k) or k.upper(), budget=2000)
    assert cache.all(["a", "b", "a"]) == ["A", "B", "A"] and made == ["a", "b"]
    assert cache.all(["x" * 65, "x" * 65]) == ["X" * 65] * 2 and "x" * 65 not in cache.held
    cache.all([str(i) for i in range(100)])
    assert cache.used <= 2000 and len(cache.held) < 20


@pytest.mark.parametrize("length", [1, 2, 47, 48, 49, 400])
def test_short_and_long_words_merge_alike(library, length):
    random.seed(length)
    word = "".join(random.choice("thaneriouz") for _ in range(length))
    assert bpe.loaded(bpe.vocabulary()).merge(word) == library.encode(word, add_special_tokens=False).ids


# 3
def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = queries()["op3_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() == 1000 and (scored["predicted"] == scored["quality"]).mean() >= 0.85
    assert ((scored["predicted"] == 0) & (scored["quality"] == 1)).sum() == 0


def test_quality_catches_bad_rows_of_unseen_words(spark):
    """Texts in which one word comes again and again share no word with those learnt from."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries()["op3_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").groupBy("quality", "predicted").count().collect()
    n = {(r["quality"], r["predicted"]): r["count"] for r in got}
    assert n[0, 0] >= 0.9 * (n[0, 0] + n.get((0, 1), 0)) and n.get((1, 0), 0) <= 0.01 * n[1, 1]


def test_quality_odd_rows(spark):
    df = docs_of(spark, ODD, extra=False)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit(df, labels)
    got = quality.score(df, weights).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in quality.accepted(df, weights).collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert {r["score"] for r in quality.score(df, quality.fit(df, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality.score(df.where("false"), weights).count() == 0


def brute_ftrl(rows, epochs=quality.EPOCHS):
    """FTRL-proximal over {place: value} rows, coordinate by coordinate; the bias is place 2 ** BITS."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def brute_features(text):
    """{place: value} of the words and pairs of a text."""
    words = [int.from_bytes(xxhash.xxh64_digest(w.encode()), "little") for w in re.findall(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", text or "")]
    pairs = [((a * int(quality.MIX) % 2**64) ^ (b >> 7)) * int(quality.MIX) % 2**64 for a, b in zip(words, words[1:])]
    runs = [words[i : i + quality.WINDOW] for i in range(len(words) - quality.WINDOW + 1)]
    codes = [int("1" + "".join(str(int(run[j] == run[i])) for j in range(len(run)) for i in range(j)), 2) for run in runs]
    places = Counter(h >> (64 - quality.BITS) for h in words + pairs + [c * int(quality.MIX) ** 2 % 2**64 for c in codes])
    return {i: quality.SCALE * math.sqrt(c / sum(places.values())) for i, c in places.items()}


def test_quality_steps_and_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARDS", 1)
    texts = [" ".join(random.Random(i).choices(["good", "fine", "text", "%%%", "$$$ x1", "a_b"], k=5 + i)) for i in range(24)] + ["", None]
    df = docs_of(spark, texts + ["good good"], [*range(26), 3])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(26)], "doc_id long, quality int")
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    # doc_id 3 stands twice and is learnt with its least text
    texts[3] = min(texts[3], "good good")
    model = brute_ftrl([(brute_features(texts[i]) | {1 << quality.BITS: 1.0}, int(i % 3 > 0)) for i in order])
    weights = quality.fit(df, labels)
    assert all(abs(weights[i] - model.get(i, 0.0)) < 1e-9 for i in set(np.flatnonzero(weights)) | set(model))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(spark, texts), weights).collect()}
    for i, t in enumerate(texts):
        total = sum(model.get(p, 0.0) * v for p, v in brute_features(t).items()) + model[1 << quality.BITS]
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9


# 4 and 8
def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clean(rows):
    return [(k, np.array(v, dtype=np.float32).astype(float)) for k, v, _ in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]


def odd_vectors(seed=1):
    rng = np.random.RandomState(seed)
    rows = [(i, [float(x) for x in rng.randn(8)], 0) for i in range(150)]
    rows += [(200 + i, rows[3][1], 0) for i in range(40)]
    return rows + [(300, None, 0), (301, [0.0] * 8, 0), (302, [None] + [1.0] * 7, 0), (303, [math.nan] * 8, 0), (304, [math.inf] * 8, 0), (None, [1.0] * 8, 0), (305, [1.0] * 3, 0)]


def test_ann_recall_and_ties(spark):
    rows = odd_vectors()
    good = [(k, v) for k, v in clean(rows) if len(v) == 8 and v.any()]
    got = ann.nearest(vectors_of(spark, rows), every=10, k=5).collect()
    hit = total = 0
    for k, v in good:
        if k % 10:
            continue
        want = sorted(((-round(float(v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w), 12), o) for o, w in good if o != k))[:5]
        mine = sorted((r for r in got if r["query_id"] == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        hit += len({o for _, o in want} & {r["vec_id"] for r in mine})
        total += len(want)
    assert hit / total >= 0.9
    assert ann.nearest(vectors_of(spark, []), every=10).count() == 0
    assert ann.nearest(vectors_of(spark, rows[:2]), every=1).count() == 2


def test_ann_recall_on_ten_thousand_vectors(spark):
    """Vectors around 300 centres with much noise, and 2,000 copies of one of them."""
    rng = np.random.RandomState(7)
    x = (rng.randn(300, 32)[rng.randint(0, 300, 10_000)] + 0.7 * rng.randn(10_000, 32)).astype(np.float32)
    x[3000:5000] = x[17]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = ann.nearest(vectors_of(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]), every=100).collect()
    assert len(got) == 500
    hit = 0
    for q in range(0, 10_000, 100):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        mine = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert all(abs(u[k] @ u[q] - score) < 1e-12 for k, score in mine)
        hit += len({k for k, _ in mine} & set(np.lexsort((np.arange(10_000), -s))[:5]))
    assert hit / 500 >= 0.9


@pytest.mark.parametrize("spread", [3e-5, 0.3, 1e150])
def test_ann_misses_nothing_whatever_the_rows(spark, spread):
    """Groups of 800 vectors closer together than looked-up scores can tell, of 64 loose ones, and sizes whose squares overflow or vanish."""
    rng = np.random.RandomState(11)
    if spread == 1e150:
        x = rng.randn(600, 16) * 10.0 ** rng.choice([-200, 0, 200], 600)[:, None]
    else:
        x = (rng.randn(4 if spread < 0.1 else 50, 64)[np.arange(3200) % (4 if spread < 0.1 else 50)] + spread * rng.randn(3200, 64)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, every=50).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, len(x), 50))
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(s[k] - score) < 1e-14 for k, score in found.values())
        assert np.allclose([found[r][1] for r in range(1, 6)], np.sort(s)[:-6:-1], rtol=0, atol=1e-14)


def test_ann_bounds_lie_above_all_cosines():
    rng = np.random.RandomState(3)
    for spread in (1.0, 0.1, 1e-4):
        x = ann.unit(rng.randn(3, 24)[rng.randint(0, 3, 1500)] + spread * rng.randn(1500, 24))
        books = ann.fit(x[:300].astype(np.float32))
        codes = ann.encode(x.astype(np.float32), books)
        norm, cosine, sine = (c.astype(np.float32) for c in ann.fits(x, codes, books))
        near = sum(np.take(x[:50].astype(np.float32) @ book.T, codes[:, i], axis=1) for i, book in enumerate(books)) / norm
        most = ann.bounds(near, np.float32(1e-4), cosine, sine)
        assert (most >= x[:50] @ x.T).all()
        assert spread < 1 or (most < 1).mean() > 0.5


def test_vector_searches_on_odd_rows(spark):
    """Repeated ids, columns with clashing names, vectors of two lengths."""
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 2.0], 0), (3, [1.0], 0), (20, [2.0], 0), (21, [-1.0], 0)]
    df = vectors_of(spark, rows).withColumns({"v": F.lit(1), "h": F.lit("h"), "score": F.lit(0), "query_id": F.lit(9), "a.b": F.lit(1)})
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, every=20).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (20, 1): 3, (20, 2): 21}
    top = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_inner_products(df, every=20, k=3).collect())
    assert top == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 0), (20, 1, 3, 8192), (20, 2, 21, -8192)]
    assert topk.top_inner_products(df.where("false")).count() == ann.nearest(df.where("false")).count() == 0


@pytest.mark.parametrize("k", [3, 500])
def test_top_k_is_exact(spark, k):
    rows = odd_vectors(2)
    good = [(i, np.floor(64 * v).astype(int)) for i, v in clean(rows) if len(v) == 8]
    want = []
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-int(v @ w), o) for o, w in good if o != i)[:k]
            want += [(i, n, o, -s) for n, (s, o) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.top_inner_products(vectors_of(spark, rows), k=k).collect())) == sorted(want)


def test_top_k_query_against_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries()["op8_exact_top_k"](spark, SF)
    want = duckdb.sql(oracle_sql()["op8_exact_top_k"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# 6
def brute_components(pairs):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(pairs))


def test_near_duplicates_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = queries()["op6_minhash_near_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_near_duplicates_dense_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(90):
        t = list(base)
        for _ in range(i % 8):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [texts[5].upper()] * 20 + ODD + [" ".join(base[:60] + [f"u{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(20)]
    ids = [1000 - i for i in range(len(texts))]
    got = neardup.near_duplicates(docs_of(spark, texts, ids)).collect()
    assert sorted(map(tuple, got)) == brute_components(list(zip(ids, texts)))


def test_near_duplicates_odd_rows(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 7, 7, None])
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True)], key=repr)
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 500)], "a long, b long")
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and roots[500] == roots[501] != roots[0]


# 7
def brute_private(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


PRIVATE = ["a@b.c_d@e.f x@y.z, mail: j.d+x@mail.example.com.", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.004", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111", "+1 (123) 555-4567 +1 2 +44 20 7946 0958 +", "😀 é@x.y a@b.co 😀😀 10.0.0.1",
           "write to joe (at) mail (dot) com or call (123) 555-4567", None, "", " ".join(map(str, range(3000))), "9" * 5000, "a" * 20000, "1.2.3.4 " * 700, "+1 555 010 9999\n" * 300]


def test_private_base_spans(spark):
    texts = PRIVATE + [r["text"] for r in documents(spark).collect()]
    for r in pii.find_private(docs_of(spark, texts)).collect():
        spans = brute_private(texts[r["doc_id"]] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), r
        assert r["n_spans"] == (r["spans"].count(",") + 1 if r["spans"] else 0) >= len(spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_private_redaction(spark):
    df = docs_of(spark, PRIVATE)
    out = pii.redacted(df)
    assert out.schema.names == df.schema.names
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(PRIVATE) and got[6]["text"] is None and got[10]["text"] == PRIVATE[10]
    assert got[4]["text"] == "😀 é@x.y [EMAIL] 😀😀 [IP]" and got[11]["text"] == "[IP] " * 700
    assert pii.find_private(df.where("false")).count() == 0


# 9
def test_license_base(spark):
    texts = [None, "", "Under the MIT license. under  THE mit-license under the mitlicense", "Apache License, Version 2.0 and CC BY-NC 4.0", "cc by nc " * 50, *[f"{t} indeed" for t, _ in licenses.NOTICES.values()], "permission is hereby granted", "é" * 9]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((s, label) for p, label in licenses.PHRASES.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert [got[5 + i]["labels"] for i in range(len(licenses.NOTICES))] == list(licenses.NOTICES)
    assert got[len(texts) - 2]["labels"] == ""


def test_license_with_words_put_in(spark):
    """Words within a notice, but not within a key phrase, neither hide it nor its key phrases."""
    mit = licenses.NOTICES["mit"][0].replace("free of charge,", "free of charge, kindly and gladly,").replace("to deal in", "all of them, to deal in")
    texts = [mit, "x " * 4000 + mit + " y" * 4000, mit.replace("without restriction", "with restriction"), "", None]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "mit", "", "", ""] and got[0]["score"] == 1.0
    assert licenses.scan_licenses(docs_of(spark, texts).where("false")).count() == 0
    own = licenses.templates(spark.createDataFrame([("own", "Use this as you like but name its makers", ["name its makers"])], "label string, text string, keys array<string>"))
    assert licenses.scan_licenses(docs_of(spark, ["now use this as you like but name its makers"]), {}, own).first()["labels"] == "own"


OTHER_FORMS = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the GNU GPL.": "gpl", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "// SPDX-License-Identifier: MIT": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted.": "bsd", "This file is distributed under the BSD 3-Clause License, see LICENSE": "bsd", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "It is available under the Eclipse Public License v2": "epl", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa,cc-by-nc", "under the terms of the GNU Lesser General Public License": "lgpl", "covered by the zlib/libpng License": "zlib",
    "You should have got a copy of the GNU Affero General Public License along with this program": "agpl", "released under the Unlicense": "unlicense", "licensed under the Boost Software License, Version 1.0": "boost",
    "the general public license of no one": "", "GNU is not a licence": "", "We licensed the software under a deal": "", "a public domain book": "", "permitted forms of redistribution and use": "",
}


def test_license_forms_that_are_no_templates(spark):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, [*OTHER_FORMS, *["some common words"] * 30])).collect()}
    for i, (text, labels) in enumerate(OTHER_FORMS.items()):
        assert got[i]["labels"] == ",".join(sorted(filter(None, labels.split(",")))), text
    assert len(licenses.NAMES) >= 30 and len({label for label, _, _ in licenses.known_forms()}) >= 30


def test_license_labels_of_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").join(licenses.op9_license_scan(spark, d), "doc_id").select("text", "labels", "base_labels").collect()
    said = [r for r in rows if "licensed under the gnu general public license" in r["text"].lower()]
    assert said and all("gpl" in r["labels"].split(",") for r in said)
    # no text without a word of licences gets a label
    assert not [r for r in rows if r["labels"] and not re.search("licen[sc]e|redistribution|permission|cc.by", r["text"], re.I)]


def test_license_repeated_rows(spark):
    docs = docs_of(spark, ["under the MIT license", "x"])
    got = licenses.scan_licenses(docs.unionAll(docs)).collect()
    assert len(got) == 4 and len(set(map(tuple, got))) == 2


def test_license_all_notices_in_one_text(spark):
    """A long text of all notices, each with as many words replaced as COVER allows, amid stray words of other notices."""
    stray = " " + " ".join(sorted(w.decode() for w in licenses.vocabulary({}, licenses.NOTICES))) + " "
    cut = []
    for text, keys in licenses.NOTICES.values():
        words = [w.decode() for w in licenses.words_of(text)]
        held = {i for k in keys for n in [k.split()] for s in range(len(words)) if words[s : s + len(n)] == n for i in range(s, s + len(n))}
        for i in [i for i in range(len(words)) if i not in held][: licenses.lacking(len(words))]:
            words[i] = "x"
        cut.append(" ".join(words))
    texts = [stray.join(["", *(t for t, _ in licenses.NOTICES.values()), ""]), stray.join(["", *cut, ""]), stray]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs_of(spark, texts + ["common words"] * 5)).collect()}
    assert got[0] == got[1] == ",".join(sorted(licenses.NOTICES)) and got[2] == ""


# 10
def windows(weights, name, j):
    """Release and deadline of a block, from the weights as given."""
    share = Fraction(str(weights[name])) / sum(Fraction(str(w)) for w in weights.values())
    return math.floor(j / share), math.ceil((j + 1) / share)


@pytest.mark.parametrize("weights, blocks, frame", [({"a": 0.999, "b": 0.001}, 3, 512), ({"a": 0.9, "b": 0.05, "c": 0.03, "d": 0.02}, 90, 64), ({f"s{i}": 1 + i % 50 for i in range(600)}, 2, 512)])
def test_schedule_follows_the_given_weights(spark, weights, blocks, frame):
    """Every block lies in its window, no two share a slot: each source is always less than one block away from its exact share, across frames too."""
    got = mixing.schedule(spark, [(n, w, blocks) for n, w in mixing.whole(weights).items()], frame).collect()
    assert len(got) == blocks * len(weights) == len({r["slot"] for r in got})
    for r in got:
        assert (r["release"], r["deadline"]) == windows(weights, r["name"], r["block"])
        assert r["release"] <= r["slot"] < r["deadline"]


def test_schedule_leaves_no_slot_empty(spark):
    """While every source has blocks, the share given so far differs from the weights by less than one block at each slot."""
    weights = {"a": 3, "b": 7, "c": 11, "d": 1}
    slots = {r["slot"]: r["name"] for r in mixing.schedule(spark, [(n, w, 40 * w) for n, w in weights.items()], 32).collect()}
    had = dict.fromkeys(weights, 0)
    for t in range(40 * 22):
        had[slots[t]] += 1
        assert all(abs(had[n] - Fraction(w * (t + 1), 22)) < 1 for n, w in weights.items())


def test_mixing_stays_within_a_block(spark):
    rows = [(i, None, "en", "hot" if i % 3 else f"s{i % 4}", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"hot": 0.5, "s0": 0.25, "s1": 0.15, "s2": 0.07, "s3": 0.03}
    got = mixing.positions(df, weights, block=4, frame=100).collect()
    assert len(got) == 6000 and all(r["release"] <= r["slot"] < r["deadline"] and (r["release"], r["deadline"]) == windows(weights, r["source"], r["block"]) for r in got)
    blocks = {(r["source"], r["block"]): r["slot"] for r in got}
    assert len(set(blocks.values())) == len(blocks)


def test_mixing_odd_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, None), (1, None, None, "", None), (2, "b", None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"slot": F.lit(1), "name": F.lit("n"), "shard": F.lit("s"), "a.b": F.lit(0)})
    assert mixing.positions(df).count() == 4
    out = mixing.interleaved(df)
    assert out.schema.names == df.schema.names and out.count() == 4
    assert mixing.positions(df.where("false")).count() == 0
    assert {r["slot"] for r in mixing.positions(df, {"x": 1.0}).where("source <> 'x' or source is null").collect()} == {None}


def test_mixing_query_against_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(oracle_sql()["op10_mix_to_weights"])
    got = queries()["op10_mix_to_weights"](spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.fetchall()))


# pipeline
def test_pipeline(spark, library):
    docs, seen = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema.names == before.schema.names
    kept = {r["doc_id"] for r in seen["quality classifier"].collect()}
    weights = quality.learnt(documents(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r["doc_id"] for r in quality.score(documents(spark), weights).collect() if r["predicted"]}
    want = [k for k, _, _, keep in brute_components([(r["doc_id"], r["text"]) for r in seen["quality classifier"].collect()]) if keep]
    assert sorted(r["doc_id"] for r in seen["MinHash near-dedup"].collect()) == want
    assert not any(brute_private(r["text"]) for r in seen["PII"].collect())
    mixed = seen["mixing sources to target weights"]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, seen["PII"].collect()))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in docs.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def brute_mix(docs):
    """{doc_id: (slot, at_source)} by a slot after slot schedule."""
    queues = {}
    for k, s in sorted(docs, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        queues.setdefault("" if s is None else "=" + s, []).append(k)
    names = sorted(queues)
    w = [round(math.sqrt(len(queues[n]))) for n in names]
    done, out, slot = [0] * len(names), {}, 0
    while len(out) < len(docs):
        _, i = min((-(-(done[i] + 1) * sum(w) // w[i]), i) for i in range(len(names)) if done[i] * sum(w) < (slot + 1) * w[i])
        at = done[i] * mixing.BLOCK
        out |= {k: (slot, at + j) for j, k in enumerate(queues[names[i]][at : at + mixing.BLOCK])}
        done[i] += 1
        slot += 1
    return out


def test_pipeline_shows_the_mix(spark):
    rows = [(i, f"text {i}", "en", [None, "a", "a", "a", "b", "b"][i % 6] if i % 97 else "c", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.encode_tokens(spark, corpus_pipeline.written(corpus_pipeline.mix_sources(spark, df, SF), "test-mix"), SF)
    assert {r["doc_id"]: (r["slot"], r["at_source"]) for r in got.collect()} == brute_mix([(r[0], r[3]) for r in rows])


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls, repeated rows, empty tables and columns whose names clash or hold a dot."""
    base = docs_of(spark, ODD + ODD[3:5], [None, 1, 2, 3, 4, 5, None, 7, 8, 9, 3, 4], extra=False)
    extra = {c: F.lit(c) for c in ("a.b", "row", "carried", "slot", "name", "k", "n", "stays", "node", "cands", "score")}
    df = base.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, df, SF)
        assert stage(spark, df.where("false"), SF).count() == 0
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.count() == df.count()
            continue
        assert out.schema.names == df.schema.names
        assert all(r["a.b"] == "a.b" and r["carried"] == "carried" for r in out.select("`a.b`", "carried").collect())
        assert out.count() == df.count() - (2 if "near" in name else 0)
    assert corpus_pipeline.keep_good(spark, df, SF).schema.names == df.schema.names


def test_pipeline_near_duplicates_by_row(spark):
    """Repeated and missing doc_ids: one document of each component stays, and each text of its own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a + " more"), (5, b), (7, c), (7, c), (None, d), (None, d), (None, d + " more"), (9, None), (9, None), (None, ""), (None, a)]
    df = docs_of(spark, [t for _, t in rows], [k for k, _ in rows])
    out = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert out.schema.names == df.schema.names
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    left = [r for r in got if r[0] is not None or r[1] == ""]
    assert sorted(left, key=repr) == sorted([(1, a), (5, b), (7, c), (9, None), (9, None), (None, "")], key=repr)
    assert len(got) == len(left) + 1 and (set(got) - set(left)).pop() in {(None, d), (None, d + " more")}
    assert corpus_pipeline.drop_near_duplicates(spark, df.where("false"), SF).count() == 0
