"""Behaviour of operators on small inputs."""


import pytest
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import combine as C
from docaudit.operators import lint as L
from docaudit.operators import review as V
from docaudit.operators import segment as S
from docaudit.operators import watch as W
from docaudit.sources import html as H


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first()[0]


def test_normalize_spaces(spark):
    assert one(spark, " a  b­ c , d ", T.normalize_spaces) == "a b c, d"


def test_markdown_to_plain(spark):
    assert one(spark, "# Title\n\nSee [here](http://x) and **bold** `code`.\n- item", T.markdown_to_plain) == "Title\n\nSee here and bold code.\nitem"


def test_mask_pii_is_idempotent(spark):
    masked = one(spark, "jane@x.org 4111111111111111 +7 (912) 345-67-89", T.mask_pii)
    assert "jane" not in masked and "4111" not in masked and "345" not in masked
    assert one(spark, masked, T.mask_pii) == masked


def test_mask_volatile_ignores_dates(spark):
    assert one(spark, "News 12.03.2024 10:15 text", T.mask_volatile) == one(spark, "News 13.03.2024 11:20 text", T.mask_volatile)


def test_offsets_give_back_the_match(spark):
    lines = spark.createDataFrame([(1, 1, 'каша "один" и "два" x')], "doc_id long, line int, text string")
    rows = L.lint(lines).where("rule = 'Quotes_Straight'").orderBy("column").collect()
    text = 'каша "один" и "два" x'
    assert [text[r["column"] - 1 : r["end_column"] - 1] for r in rows] == [r["text"] for r in rows] == ['"один"', '"два"']


def test_words_rule_needs_whole_words(spark):
    lines = spark.createDataFrame([(1, 1, "Кот котлета КОТ")], "doc_id long, line int, text string")
    assert [r["column"] for r in L.existence(lines, L.words_rule("Cat", ("кот",), "m")).orderBy("column").collect()] == [1, 13]


def test_unsafe_user_rules_are_skipped():
    # nested repeats are followed in linear time; back references can't be
    assert [r.rule for r in L.usable_user_rules([{"id": "ok", "pattern": "ab"}, {"id": "ok", "pattern": "(a+)+"}, {"pattern": r"(a+)+\1"}, {"pattern": "("}, {"pattern": "x*"}, {"pattern": "a" * 501}])] == ["ok", "ok"]


def blocks(spark, kinds, texts=None):
    rows = [(1, i, k, 1, (texts or {}).get(i, f"b{i}")) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "doc_id long, block_index int, type string, level int, plain string")


def test_chunks_keep_units_together(spark):
    b = blocks(spark, ["paragraph", "paragraph", "list_item", "list_item", "paragraph"], {1: "list:"})
    got = S.chunk_blocks(S.semantic_units(b), 2, 0).orderBy("chunk_index").collect()
    assert [r["block_ids"] for r in got] == [[0], [1, 2, 3], [4]]


def test_chunks_overlap(spark):
    got = S.chunk_blocks(S.semantic_units(blocks(spark, ["paragraph"] * 6)), 3, 1).orderBy("chunk_index").collect()
    assert [r["block_ids"] for r in got] == [[0, 1, 2], [2, 3, 4], [4, 5]]


def test_text_blocks(spark):
    docs = spark.createDataFrame([(1, "One\ntwo\n\n- a\n  - b\n1. c\nend")], "doc_id long, text string")
    got = S.text_blocks(docs).orderBy("block_index").collect()
    assert [(r["type"], r["list_kind"], r["list_depth"], r["plain"]) for r in got] == [("paragraph", None, None, "One two"), ("list_item", "bullet", 0, "a"), ("list_item", "bullet", 1, "b"), ("list_item", "ordered", 0, "c"), ("paragraph", None, None, "end")]


def test_heading_path(spark):
    rows = [(1, 0, "heading", 1, "A"), (1, 1, "heading", 2, "B"), (1, 2, "paragraph", None, "x"), (1, 3, "heading", 1, "C"), (1, 4, "paragraph", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, block_index int, type string, level int, plain string")
    assert [r["path"] for r in S.heading_path(df).orderBy("block_index").collect()] == [["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]


def test_dedupe_is_idempotent(spark):
    f = spark.createDataFrame([(1, 1, 1, "Ab", "r", "m", "style"), (1, 1, 1, "ab", "r", "m", "user"), (1, 1, 1, "AB", "s", "m", "spelling")], "doc_id long, line int, column int, text string, rule string, message string, source string")
    once = C.dedupe_findings(f)
    assert [(r["source"], r["text"]) for r in once.collect()] == [("style", "Ab")]
    assert C.dedupe_findings(once).collect() == once.collect()


def test_reference_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 5)], "src int, dst int")
    assert {r["start"]: r["length"] for r in C.reference_cycles(e).collect()} == {1: 2, 2: 2, 5: 1}


def test_folder_paths_end_in_cycles(spark):
    f = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 4), (4, "d", 3)], "id int, name string, parent_id int")
    assert {r["id"]: r["path"] for r in C.folder_paths(f, 5).where("id < 3").collect()} == {1: "a", 2: "a / b"}


def test_resolve_conflicts(spark):
    c = spark.createDataFrame([(1, 0, 0, "base", "x"), (1, 0, 1, "special", "y"), (1, 1, 0, "base", "z"), (1, 2, 0, "p", "1"), (1, 2, 1, "q", "2")], "doc_id long, block_index int, pos int, rule string, suggestion string")
    r = spark.createDataFrame([("base", 50, None, []), ("special", 50, None, ["base"]), ("p", 50, "f", []), ("q", 50, "f", [])], "rule string, priority int, conflict_family string, over array<string>")
    got = {(x["block_index"], x["rule"]): x["unresolved"] for x in V.resolve_conflicts(c, r).collect()}
    assert got == {(0, "special"): False, (1, "base"): False, (2, "p"): False}


def conflicts_by_hand(items, rules):
    """The rows of a block that stay, every pair looked at."""
    rank = {"all": 0, "document": 1, "section": 2, "sentence": 3, "token": 4}
    blank = dict(mandatory=False, priority=50, scope="all", machine_verifiable=False, family=None, over=(), conflicts=())
    key = lambda n: (lambda r: (not r["mandatory"], -r["priority"], -rank[r["scope"]], not r["machine_verifiable"], n))(rules.get(n, blank))
    gone, left_open = set(), set()
    for i, (a, text) in enumerate(items):
        for j, (b, other) in enumerate(items):
            if j <= i or i in gone or j in gone:
                continue
            p, q = rules.get(a, blank), rules.get(b, blank)
            if b in p["over"]:
                gone.add(j)
            elif a in q["over"]:
                gone.add(i)
            elif (b in p["conflicts"] or a in q["conflicts"] or (p["family"] and p["family"] == q["family"])) and text != other:
                if key(a) == key(b):
                    left_open |= {i, j}
                else:
                    gone.add(j if key(a) < key(b) else i)
    return [(i, i in left_open) for i in range(len(items)) if i not in gone]


def test_conflicts_by_whole_precedence(spark):
    import random

    rng = random.Random(11)
    names = [f"r{i}" for i in range(9)]
    rules = {
        n: dict(mandatory=rng.random() < 0.3, priority=rng.choice([10, 50]), scope=rng.choice(["all", "section", "token"]), machine_verifiable=rng.random() < 0.5, family=rng.choice([None, None, "f", "g"]),
                over=tuple(rng.sample(names, rng.choice([0, 0, 1]))), conflicts=tuple(rng.sample(names, rng.choice([0, 0, 1]))))
        for n in names
    }
    blocks = [[(rng.choice([*names, "unknown"]), rng.choice("xyz")) for _ in range(rng.randint(1, 9))] for _ in range(80)]
    want = {(k, i): o for k, items in enumerate(blocks) for i, o in conflicts_by_hand(items, rules)}
    c = spark.createDataFrame([(1, k, i, n, t) for k, items in enumerate(blocks) for i, (n, t) in enumerate(items)], "doc_id long, block_index int, pos int, rule string, suggestion string")
    r = spark.createDataFrame([(n, x["mandatory"], x["priority"], x["scope"], x["machine_verifiable"], x["family"], list(x["over"]), list(x["conflicts"])) for n, x in rules.items()], "rule string, mandatory boolean, priority int, scope string, machine_verifiable boolean, conflict_family string, over array<string>, conflicts array<string>")
    assert {(x["block_index"], x["pos"]): x["unresolved"] for x in V.resolve_conflicts(c, r).collect()} == want and any(want.values())


def test_parse_model_response(spark):
    body = '{"issues": [{"block_index": 1, "rule": "r", "description": "d"}]}'
    rows = [("a", body), ("b", "<think>{x}</think>```json\n" + body + "\n```"), ("c", "Sure: " + body + " done"), ("d", "nothing")]
    got = V.parse_model_response(spark.createDataFrame(rows, "request_key string, response string")).collect()
    assert sorted((r["request_key"], r["rule"], r["block_index"]) for r in got) == [("a", "r", 1), ("b", "r", 1), ("c", "r", 1)]


def test_failing_model_call_is_a_row(spark):
    def call(text):
        raise ValueError("no")

    got = V.run_model_pass(spark.createDataFrame([("k", "t")], "request_key string, text string"), call).first()
    assert got["response"] is None and "ValueError" in got["error"]


PAGE = "<html><body><nav><a href='/n'>N</a></nav><h1>T</h1><p>One <b>two</b><p>Three<ul><li>a<li>b</ul><div style='display: none'>gone</div></body></html>"


def test_html_blocks_and_text(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a/b", PAGE)], "page_id long, url string, html string")
    assert [(r["type"], r["plain"]) for r in H.html_blocks(pages).orderBy("block_index").collect()] == [("heading", "T"), ("paragraph", "One two"), ("paragraph", "Three"), ("list_item", "a"), ("list_item", "b")]
    assert [r["text"] for r in H.visible_text(pages).orderBy("line").collect()] == ["T", "One two", "Three", "a", "b"]
    assert H.extract_links(pages).first()["dst"] == "http://x.org/n"


def test_diff_of_equal_versions_is_empty(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    nodes = H.dom_nodes(pages)
    assert W.diff_nodes(nodes, nodes).count() == 0


@pytest.mark.parametrize("new, kinds", [(PAGE.replace("Three", "Four"), {"text"}), (PAGE.replace("<h1>T</h1>", ""), {"removed"}), (PAGE.replace("</ul>", "<li>c</ul>"), {"added"})])
def test_node_events(spark, new, kinds):
    old, now = (H.dom_nodes(spark.createDataFrame([(1, p)], "page_id long, html string")) for p in (PAGE, new))
    assert {r["kind"] for r in W.diff_nodes(old, now).collect()} == kinds


def test_status_after_an_error(spark):
    rows = [(1, 1, "a", "s", None), (1, 2, None, None, "timeout"), (1, 3, "a", "s", None), (1, 4, "a", "s", None), (1, 5, "b", "s", None)]
    df = spark.createDataFrame(rows, "page_id long, checked_at int, content_hash string, struct_hash string, error string")
    assert [r["status"] for r in W.change_status(df).orderBy("checked_at").collect()] == ["same", "error", "changed", "same", "changed"]
    assert [r["status"] for r in W.change_status(df, skip_errors=True).orderBy("checked_at").collect()] == ["same", "error", "same", "same", "changed"]


def test_text_hunks(spark):
    old, new = "a\nthe quick fox\nz", "a\nthe slow fox\nz"
    got = W.text_hunks(spark.createDataFrame([(1, old, new)], "page_id long, old string, new string")).orderBy("hunk").collect()
    assert [r["op"] for r in got] == ["eq", "del", "add", "eq"]
    assert got[2]["same"] == [True, False, True]


