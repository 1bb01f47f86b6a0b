from docaudit.operators import catalogue
from docaudit.operators import lint as L
from docaudit.sources import io

CASES = {
    "Dash_EmDash": ("Это — тест", "Это – тест"), "Dash_NoSpace": ("один–два", "один – два"), "Grammar_BezGerund": ("без делая", "без дела"), "UITerms_Menu": ("Откройте всплывающее меню", "Откройте меню"),
    "Quotes_LatinInQuotes": ("«Save»", "«Сохранить»"), "Possessives": ("Наша система", "Система"), "Spacing_Double": ("два  пробела", "один пробел"), "Abbreviations": ("СССР", "Союз"), "Formatting_SoftHyphen": ("пере­нос", "перенос"),
    "Currency_FromAmount": ("от100", "от 100"), "UITerms_WindowMove": ("Перетащите окно", "Переместите"), "Terminology_WebPrefix": ("web-сайт", "веб-сайт"),
}

def test_catalogue(spark):

    lines = spark.createDataFrame([(2 * i + j, 1, t) for i, pair in enumerate(CASES.values()) for j, t in enumerate(pair)], "doc_id long, line int, text string")

    found = {(r["doc_id"], r["rule"]) for r in L.lint(lines, catalogue.RULES).collect()}
    for i, rule in enumerate(CASES):
        assert (2 * i, rule) in found and (2 * i + 1, rule) not in found, rule

def test_rule_files(spark, tmp_path):
    (tmp_path / "Glossary.yml").write_text("extends: substitution\nmessage: Use\nlevel: error\nignorecase: true\nswap:\n  e-mail: email\n", encoding="utf-8")
    (tmp_path / "Words.yml").write_text("extends: existence\nmessage: m\ntokens:\n- just\n- simply\nexceptions:\n- simply\nraw:\n- 'a{3}'\n", encoding="utf-8")
    rules = io.read_rules(spark, str(tmp_path))
    lines = spark.createDataFrame([(1, 1, "E-mail just simply aaa adjust")], "doc_id long, line int, text string")
    got = sorted((r["rule"], r["text"], r["replacement"]) for r in L.lint(lines, tuple(rules)).collect())
    assert got == [("Glossary", "E-mail", "email"), ("Words", "aaa", None), ("Words", "just", None)]

def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# h é".encode())
    (tmp_path / "b.txt").write_bytes(b"x\xffy")
    (tmp_path / "c.bin").write_bytes(b"z")
    good, bad = io.read_documents(spark, str(tmp_path))
    assert {(r["format"], r["text"]) for r in good.collect()} == {("md", "# h é"), ("txt", "x�y")}
    assert [r["format"] for r in bad.collect()] == ["bin"]

def test_user_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "a", "pattern": "x+y"}, {"id": "b", "pattern": "("}]')
    assert [r.rule for r in io.read_user_rules(spark, str(tmp_path / "r.json"))] == ["a"]
