"""Queries that SQL can't express, against plain Python over whole tables, and operators on small inputs."""

import math
import re
from collections import Counter, deque

import pytest
import regex
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import combine as C
from docaudit.operators import lint as L
from docaudit.operators import segment as S
from docaudit.plans import registry
from docaudit.sources import io

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def query(spark, name):
    return registry.queries()[name](spark, SF).collect()


def masked(text):
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: m[0][0] + "•••@" + m[0].partition("@")[2], text)
    text = re.sub(r"(?<!\d)(?:\d[ -]?){15}\d(?!\d)", "•" * 16, text)
    text = re.sub(r"(?<!\d)(?:\+7|8)[\s(]*\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}(?!\d)", lambda m: m[0][0] + "•" * 10, text)
    text = re.sub(r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{3}[ -]?\d{2}(?!\d)", "•" * 11, text)
    return re.sub(r"(?<!\d)\d{10}(?:\d{2})?(?!\d)", "•" * 10, text)


@pytest.mark.parametrize("name, source, key, column", [("mask_pii", "documents", "doc_id", "text"), ("mask_pii_html", "pages", "page_id", "html")])
def test_masks(spark, name, source, key, column):
    want = {r[key]: masked(r[column]) for r in rows(spark, source)}
    assert {r[key]: r["masked"] for r in query(spark, name)} == want


def test_masks_of_numbers(spark):
    texts = ["11223344595", "112 233 445 95", "8  (495)  123 45 67", "+7(495)123-45-67", "41 11 1111 1111 1111", "4111 1111 1111 1111", "1234567890 123456789012 12345678901", "a@b.co, x.y+z@mail.example.org", "no 123", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.mask_pii(F.col("text")).alias("m"))
    got = {r["text"]: r["m"] for r in df.collect()}
    assert got == {t: masked(t) for t in texts}
    assert not any(re.search(r"\d{5}", m) for m in got.values())


def words_of(text):
    return re.findall(r"[0-9a-zа-я]+", text.lower().replace("ё", "е"))


def stem_of(token):
    if len(token) <= 5:
        return None
    return next((token[: -len(s)] for s in T.SUFFIXES if token.endswith(s) and len(token) - len(s) >= 3), None)


def test_stems(spark):
    words = {t for r in rows(spark, "documents") for t in words_of(r["text"])}
    tokens = words | {t + T.SUFFIXES[len(t) % len(T.SUFFIXES)] for t in words} | {t + "ами" for t in words}
    assert stem_of("documents") is None and stem_of("таблицами") == "таблиц"
    want = Counter(s for s in map(stem_of, tokens) if s)
    assert {r["stem"]: r["forms"] for r in query(spark, "stems")} == {s: n for s, n in want.items() if n > 1}
    made = spark.createDataFrame([(t,) for t in ("исправление", "исправлений", "исправить", "таблицами", "поле", "новому")], "t string").select("t", T.stem(F.col("t")).alias("s"))
    assert all(r["s"] == stem_of(r["t"]) for r in made.collect())


def sentences_of(line):
    out, at = [], 0
    for m in regex.finditer(S.SENTENCE_END, line):
        out.append(line[at : m.start()])
        at = m.end()
    return [*out, line[at:]]


def test_sentences_and_their_lengths(spark):
    made = {(r["doc_id"], n): sentences_of(line) for r in rows(spark, "documents") for n, line in enumerate(r["text"].split("\n"), 1)}
    per_doc = {}
    for (k, _), s in made.items():
        per_doc.setdefault(k, []).extend(s)
    assert {r["doc_id"]: (r["n_sentences"], r["longest"]) for r in query(spark, "sentences")} == {k: (len(s), max(map(len, s))) for k, s in per_doc.items()}
    word = re.compile(r"(?<![^\W_])[^\W\d_](?:[^\W_]|[_-])*")
    long = {(k, line, i, len(word.findall(s))) for (k, line), found in made.items() for i, s in enumerate(found, 1)}
    assert {tuple(r) for r in query(spark, "sentence_length")} == {x for x in long if x[3] > 25}


def test_lexical_score(spark):
    def terms(text):
        words = words_of(text)
        return Counter(words + [s for s in map(stem_of, words) if s])

    passages = [(r["conv_id"] * 1000 + r["turn"], r["text"] or "") for r in rows(spark, "conversations")][:40]
    items = [(str(r["item_id"]), r["text"], [r["text"][:9]]) for r in rows(spark, "benchmark")][:30]
    from docaudit.operators import retrieve

    p = spark.createDataFrame(passages, "chunk long, text string")
    r = spark.createDataFrame(items, "rule string, text string, bad_examples array<string>")
    want = {}
    for c, text in passages:
        q = terms(text)
        for rule, body, bad in items:
            t = terms(body)
            s = sum((q & t).values()) / max(1.0, math.sqrt(sum(q.values())) * math.sqrt(sum(t.values())))
            s += any(len(b) >= 3 and b.lower() in text.lower() and words_of(b)[0] in q for b in bad)
            if s:
                want[c, rule] = round(s, 6)
    assert {(x["chunk"], x["rule"]): round(x["lexical"], 6) for x in retrieve.lexical_score(p, r).collect()} == want


def test_reachable_pages(spark):
    from docaudit.sources import html as H

    links = H.extract_links(spark.read.parquet(f"{SF}/pages.parquet"))
    edges = {}
    for r in links.select("src", "dst").collect():
        edges.setdefault(r["src"], set()).add(r["dst"])
    start = [r["url"] for r in links.select(F.col("src").alias("url")).orderBy("url").limit(3).collect()]
    level, queue = {u: 0 for u in start}, deque(start)
    while queue:
        u = queue.popleft()
        for v in edges.get(u, ()):
            if v not in level:
                level[v] = level[u] + 1
                queue.append(v)
    want = sorted((n, u) for u, n in level.items())[:200]
    assert sorted((r["level"], r["url"]) for r in query(spark, "reachable_pages")) == want


def test_stream_finds_what_a_batch_finds(spark):
    batch = registry.queries()["existence_rules"](spark, SF).groupBy("rule").count()
    assert {(r["rule"], r["n"]) for r in query(spark, "findings_stream")} == {(r["rule"], r["count"]) for r in batch.collect()}


def test_pack_by_chars_keeps_every_word(spark):
    text = " ".join(f"w{i}" for i in range(900))
    df = spark.createDataFrame([(1, 0, text), (1, 1, "tail"), (2, 0, "x" * 9000), (3, 0, "")], "doc_id long, block_index int, plain string")
    got = {}
    for r in S.pack_by_chars(df).orderBy("doc_id", "part").collect():
        assert len(r["text"]) <= 3500
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert set(" ".join(got[1]).split()) == set(text.split()) | {"tail"}
    assert "".join(got[2]) == "x" * 9000


READINGS = "doc_id long, line int, sentence int, pos int, word string, rank int, lemma string, part string, number string, grammatical_case string, gender string"


def test_agreement(spark):
    def at(sentence, pos, word, part, number, case="nomn", gender="masc", lemma=None):
        return (1, 1, sentence, pos, word, 0, lemma or word, part, number, case, gender)

    data = [
        at(1, 0, "новый", "ADJF", "sing"), at(1, 1, "дом", "NOUN", "sing"), at(2, 0, "новая", "ADJF", "sing", gender="femn"), at(2, 1, "дом", "NOUN", "sing"), at(3, 0, "новый", "ADJF", "sing"), at(3, 2, "дома", "NOUN", "plur"),
        at(4, 0, "файлы", "NOUN", "plur"), at(4, 3, "открывается", "VERB", "sing"), at(5, 0, "файлы", "NOUN", "plur"), at(5, 5, "открывается", "VERB", "sing"), at(6, 0, "файлы", "NOUN", "plur"), at(6, 1, "экран", "NOUN", "sing"), at(6, 2, "открывает", "VERB", "sing"),
        at(7, 0, "был", "VERB", "sing", lemma="быть"), at(7, 1, "открыт", "PRTS", "sing"), at(8, 0, "был", "VERB", "sing", lemma="быть"), at(8, 1, "дом", "NOUN", "sing"),
    ]
    df = spark.createDataFrame(data, READINGS)
    assert [(r["sentence"], r["a_word"], r["b_word"]) for r in L.disagreement(df, "ADJF", "NOUN").collect()] == [(2, "новая", "дом")]
    assert [(r["sentence"], r["word"]) for r in L.subject_verb_disagreement(df).collect()] == [(4, "открывается")]
    assert [(r["sentence"], r["word"]) for r in L.passive_voice(df).collect()] == [(7, "был")]


def test_near_pair_takes_the_nearest(spark):
    tokens = spark.createDataFrame([(1, 1, 1, i, w) for i, w in enumerate("система думает и хочет а система потом не очень быстро хочет".split())], "doc_id long, line int, sentence int, pos int, word string")
    one, two = spark.createDataFrame([("система",)], "word string"), spark.createDataFrame([("думает",), ("хочет",)], "word string")
    assert [(r["at"], r["verb_at"], r["verb"]) for r in L.near_pair(tokens, one, two).collect()] == [(0, 1, "думает")]


def test_post_filter(spark):
    data = [("Slash_Words", "Мбит/с", 0), ("Slash_Words", "и/или", 1), ("UITerms_Click", "откликнулся", 0), ("UITerms_Click", "кликните", 1), ("LetterYo", "Её", 0), ("LetterYo", "ещё", 1), ("Quotes_LatinInQuotes", "«HTTP2»", 0), ("Quotes_LatinInQuotes", "«Http»", 1), ("Dash_EmDash", "её", 1)]
    df = spark.createDataFrame(data, "rule string, text string, stays int")
    assert {(r["rule"], r["text"]) for r in L.post_filter(df).collect()} == {(r, t) for r, t, stays in data if stays}


def test_spans_of_very_many_matches(spark):
    text = "ab, " * 20_000 + "é!!"
    lines = spark.createDataFrame([(1, 1, text), (2, 1, "none"), (3, 1, None)], "doc_id long, line int, text string")
    got = L.existence(lines, L.Rule("r", "a|é", "m")).orderBy("column").collect()
    assert [r["column"] for r in got] == [4 * i + 1 for i in range(20_000)] + [80_001]


def test_cycles_longer_than_twenty_steps(spark):
    ring = [(i, (i + 1) % 30) for i in range(30)] + [(100, 0), (5, 200), (300, 300), (400, 401), (401, 400), (401, 400)]
    got = {r["start"]: r["length"] for r in C.reference_cycles(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(30), 30), 300: 1, 400: 2, 401: 2}
    assert C.reference_cycles(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0


def shortest_rounds(edges):
    out = {}
    for start in {a for a, _ in edges}:
        front, length = {b for a, b in edges if a == start}, 1
        seen = set(front)
        while front and start not in seen:
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            length += 1
        if start in seen:
            out[start] = length
    return out


def test_cycles_of_random_graphs_and_long_rings(spark):
    import random

    rng = random.Random(7)
    edges = set()
    for g in range(12):
        n = rng.randint(2, 9)
        edges |= {(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.randint(n, 2 * n))}
        # chains between nodes of the graph, side by side with its edges
        for c in range(2):
            chain = [100 * g + rng.randrange(n), *(100 * g + 20 + 10 * c + i for i in range(rng.randint(1, 8))), 100 * g + rng.randrange(n)]
            edges |= set(zip(chain, chain[1:]))
    ring = {(10_000 + i, 10_000 + (i + 1) % 2000) for i in range(2000)}
    path = {(20_000 + i, 20_001 + i) for i in range(1500)}
    got = {r["start"]: r["length"] for r in C.reference_cycles(spark.createDataFrame([*edges, *ring, *path, (None, 1)], "src long, dst long")).collect()}
    assert got == shortest_rounds(edges) | dict.fromkeys(range(10_000, 12_000), 2000)


def test_rule_ids_stay_unique(spark):
    ids = ["a", "a", "a_2", "a", "a_3", "a_3", None, "b", "a_2"]
    df = spark.createDataFrame([(i, r, f"T {i}") for i, r in enumerate(ids)], "seq int, rule string, title string")
    got = [r["rule"] for r in C.unique_rule_ids(df).orderBy("seq").collect()]
    assert len(set(got)) == len(ids) and [got[i] for i in (0, 2, 4, 7)] == ["a", "a_2", "a_3", "b"] and got[1].startswith("a_")


def test_retention(spark):
    log = spark.createDataFrame([(f"u{i % 3}", i, "x") for i in range(500)], "user string, at long, what string")
    assert sorted(r["at"] for r in io.latest_audit(log, "at", 20).collect()) == list(range(480, 500))
    kept = io.latest_history(log, "user", "at").groupBy("user").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    assert {(r["user"], r["n"]) for r in kept} == {("u0", 50), ("u1", 50), ("u2", 50)} and min(r["first"] for r in kept) >= 350


def test_own_detectors(spark, monkeypatch):
    monkeypatch.setattr(L, "DETECTORS", {})
    L.register_detector("shout", lambda lines: L.existence(lines, L.Rule("Shout", "[A-Z]{3,}", "Loud")))
    lines = spark.createDataFrame([(1, 1, "so LOUD here")], "doc_id long, line int, text string")
    assert [(r["text"], r["column"], r["source"]) for r in L.detect(lines).collect()] == [("LOUD", 4, "shout")]


def precedence(rule):
    scope = {"all": 0, "document": 1, "section": 2, "sentence": 3, "token": 4}[rule["scope"]]
    return (-max(0, min(100, 50 if rule["priority"] is None else rule["priority"])), -scope, not rule["machine_verifiable"], rule["rule"])


def retrieved(passages, rules, k, lexical, vectors):
    def unit(v):
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    weights = {"identity": 0.25, "policy": 0.45, "examples": 0.30}
    out = {}
    for chunk, _, task, category, v in passages:
        hit = any(c == chunk for c, _ in lexical)
        mode = "hybrid" if v and vectors else "lexical_only" if hit else "fallback"
        scored = []
        for r in rules:
            boost = (50 if r["priority"] is None else r["priority"]) / 1000 + 0.12 * (task in r["tasks"]) + 0.10 * (category in r["categories"]) + 0.06 * (r["scope"] in ("all", "document")) + 0.02 * r["machine_verifiable"]
            near = sum(weights[f] * sum(a * b for a, b in zip(unit(v), unit(w))) for n, f, w in vectors if n == r["rule"]) if mode == "hybrid" else 0
            scored.append((0.0 if mode == "fallback" else 0.55 * lexical.get((chunk, r["rule"]), 0) + 0.45 * near + boost, r))
        scored.sort(key=lambda x: (not x[1]["mandatory"], 0 if x[1]["mandatory"] else -round(x[0], 9), precedence(x[1])))
        keep = len(rules) if mode == "fallback" else max(k, sum(r["mandatory"] for r in rules))
        out |= {(chunk, r["rule"]): (round(s, 6), i, mode) for i, (s, r) in enumerate(scored[:keep], 1)}
    return out


@pytest.mark.parametrize("with_vectors", [False, True])
@pytest.mark.parametrize("k", [1, 4])
def test_retrieve_scores_like_all_pairs(spark, with_vectors, k):
    from docaudit.operators import retrieve as R

    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rules = [
        dict(rule=f"r{i:02}", title="t", text=f"{words[i % 8]} {words[i * 3 % 8]}", bad_examples=[words[i % 8]] if i % 5 == 0 else [], mandatory=i % 9 == 0, priority=None if i % 7 == 0 else i * 5 % 11, scope=("all", "document", "section", "token")[i % 4], machine_verifiable=i % 2 == 0, tasks=["guide"] if i % 3 else [], categories=["style"] if i % 2 else ["terms"])
        for i in range(20)
    ]
    passages = [(1, "alpha beta", "guide", "style", [1.0, 0.0]), (2, "nothing here", "guide", "terms", None), (3, "", None, None, [0.5, -1.0]), (4, "zeta zeta alpha", None, "style", None), (5, "nothing here", "guide", "style", [0.0, 0.0])]
    vectors = [(f"r{i:02}", f, [math.cos(i + n), math.sin(i * n)]) for i in range(18) for n, f in enumerate(("identity", "policy", "examples"))] if with_vectors else []
    rs = spark.createDataFrame(rules, "rule string, title string, text string, bad_examples array<string>, mandatory boolean, priority int, scope string, machine_verifiable boolean, tasks array<string>, categories array<string>")
    ps = spark.createDataFrame(passages, "chunk long, text string, task string, category string, v array<double>")
    lexical = {(r["chunk"], r["rule"]): r["lexical"] for r in R.lexical_score(ps, rs).collect()}
    vs = spark.createDataFrame(vectors, "rule string, field string, v array<double>") if with_vectors else None
    got = R.retrieve(ps, rs, k, vs).collect()
    assert {(r["chunk"], r["rule"]): (round(r["score"], 6), r["rank"], r["mode"]) for r in got} == retrieved(passages, rules, k, lexical, vectors)
    assert {r["mode"] for r in got} >= ({"hybrid", "fallback", "lexical_only"} if with_vectors else {"fallback", "lexical_only"})
    assert R.retrieve(ps.limit(0), rs, k, vs).count() == 0


def tokens_of(spark):
    """Words of the sentences of ``documents``: {(doc_id, line, sentence): words}."""
    word = re.compile(r"[^\W\d_](?:[^\W_]|[_-])*")
    return {(r["doc_id"], n, i): word.findall(s) for r in rows(spark, "documents") for n, line in enumerate(r["text"].split("\n"), 1) for i, s in enumerate(sentences_of(line), 1)}


def test_words_of_sentences(spark):
    sentences = tokens_of(spark)
    forms = {"The": "the", "Of": "of", "Die": "die", "La": "la"}
    assert {tuple(r) for r in query(spark, "formal_you")} == {(*at, i, w, forms[w]) for at, ws in sentences.items() for i, w in enumerate(ws) if i and w in forms}
    near = {(*at, i, w, j, ws[j]) for at, ws in sentences.items() for i, w in enumerate(ws) if w in ("the", "la", "der") for j in [next((j for j in range(i + 1, min(i + 5, len(ws))) if ws[j] in ("is", "was", "est", "den")), None)] if j}
    assert {tuple(r) for r in query(spark, "anthropomorphism")} == near
    from docaudit.plans.findings import _morph

    table = {r["form"]: r for r in _morph(spark).collect()}
    read = {at: [table.get(w.lower()) for w in ws] for at, ws in sentences.items()}
    assert {(r["lemma"], r["part"]): r["n"] for r in query(spark, "morph_lookup")} == Counter((m["lemma"], m["pos"]) for ms in read.values() for m in ms if m)
    passive = {(*at, sentences[at][known[i][0]]) for at, ms in read.items() for known in [[(p, m) for p, m in enumerate(ms) if m]] for i in range(len(known) - 1) if known[i][1]["lemma"] == "be" and known[i + 1][1]["pos"] == "PRTS"}
    assert {(r["doc_id"], r["line"], r["sentence"], r["word"]) for r in query(spark, "passive_voice")} == passive
    apart = set()
    for at, ms in read.items():
        for i, (a, b) in enumerate(zip(ms, ms[1:])):
            agree = a and b and a["number"] == b["number"] and a["grammatical_case"] == b["grammatical_case"] and (a["number"] != "sing" or a["gender"] == b["gender"])
            if a and b and a["pos"] == "ADJ" and b["pos"] == "NOUN" and not agree:
                apart.add((*at, i))
    assert {(r["doc_id"], r["line"], r["sentence"], r["a_pos"]) for r in query(spark, "adj_noun_agreement")} == apart
    lone = set()
    for at, ms in read.items():
        for i, m in enumerate(ms):
            before = [x["number"] for x in ms[max(0, i - 4) : i] if x and x["pos"] == "NOUN" and x["grammatical_case"] == "nomn"]
            if m and m["pos"] == "VERB" and m["number"] == "sing" and "plur" in before and "sing" not in before:
                lone.add((*at, i))
    assert {(r["doc_id"], r["line"], r["sentence"], r["pos"]) for r in query(spark, "subject_verb_agreement")} == lone


def test_chunk_window_context(spark):
    plain = {(r["conv_id"], r["turn"]): r["text"] for r in rows(spark, "conversations")}
    want = {}
    for c in query(spark, "chunk_blocks"):
        ids = c["block_ids"]
        near = [i for i in range(min(ids) - 2, max(ids) + 3) if i not in ids and (c["doc_id"], i) in plain]
        if near:
            want[c["doc_id"], c["chunk_index"]] = "\n".join(f"[{i}] {plain[c['doc_id'], i]}" for i in near)
    assert {(r["doc_id"], r["chunk_index"]): r["context"] for r in query(spark, "chunk_window_context")} == want


def test_snapshot_quality(spark):
    from docaudit.sources import html as H

    def problem(html):
        shown = " ".join(H.parsed(html).lines)
        if len(re.sub(r"\s+", " ", shown).strip()) < 24:
            return "too short"
        login = re.search(r"(?i)<input[^>]+type\s*=\s*[\"']?password", html) and re.search("(?i)log ?in|sign in|войти|вход", shown)
        return "login page" if login else None

    want = {(r["page_id"], login): problem("<p>Sign in</p><input type=password>" * login + r["html"]) for r in rows(spark, "pages") for login in (False, True)}
    assert {(r["page_id"], r["login"]): r["problem"] for r in query(spark, "snapshot_quality")} == want


def test_technical_terms_in_context(spark):
    data = [
        ("API", None, 1), ("«Эндпоинт»,", None, 1), ("кибербезопасность", None, 1), ("гео", None, 0), ("геодан", None, 0), ("геоданные", None, 1), ("многопоточный", None, 1), ("финтеху", None, 1), ("дом", None, 0), ("...", None, 0), ("", None, 0),
        ("и/или", None, 1), ("x_y", None, 1), ("3", None, 1), ("шардировать", None, 0), ("шардировать", "Запрос к серверу", 1), ("стол", "Запрос к серверу", 0), ("прокси-1", None, 1),
    ]
    df = spark.createDataFrame(data, "w string, c string, want int")
    assert not [tuple(r) for r in df.select("w", "c", "want", T.technical_term(F.col("w"), F.col("c")).cast("int").alias("got")).where("got is null or got <> want").collect()]
    assert df.limit(1).select(T.technical_term(F.lit("вебхуки"), None, F.lit("вебхук")).alias("x")).first()["x"]


def test_rules_of_the_catalogue(spark):
    from docaudit.operators import catalogue

    data = {
        "Файл отчет.PDF": {"FileFormats_ExtensionCase"}, "в формате pdf здесь": {"FileFormats_FormatCase"}, "Вам следует подождать": {"Imperative"}, "Подождите, Пожалуйста": {"Please"}, "файл/папка": {"Slash_Words"}, "10 Мбит/с": {"Slash_Words"},
        "кликните тут": {"UITerms_Click"}, "откликнитесь тут": set(), "установите и включите флажок": {"UITerms_CheckboxVerbs"}, "откройте вкладку": {"UITerms_Tab"}, "10 MB": {"Units_International"}, "10 мин. ждать": {"Units_Period"},
        "ip-адрес": {"IPAddress"}, "IP-адрес": set(), "Чекбокс": {"UITerms_Checkbox"}, "сдвиньте бегунок": {"UITerms_Slider"}, "ОЗУ": set(), "АБВГ": {"Abbreviations"}, "она — тут": {"Dash_EmDash"},
    }
    lines = spark.createDataFrame([(i, 1, t) for i, t in enumerate(data)], "doc_id long, line int, text string")
    found = L.lint(lines, catalogue.RULES).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["rule"])
    assert {t: got.get(i, set()) for i, t in enumerate(data)} == data
    assert {r["text"]: r["replacement"] for r in found if r["rule"] in ("IPAddress", "UITerms_Checkbox")} == {"ip-адрес": "IP-адрес", "Чекбокс": "флажок"}
    assert {r["text"] for r in L.post_filter(L.lint(lines, catalogue.RULES).where("rule = 'Slash_Words'")).collect()} == {"файл/папка"}
