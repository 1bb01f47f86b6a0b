"""Rules for Russian interface texts that are patterns or some dozen words each. Vocabularies are given as rule files (``docaudit.sources.io.read_rules``)."""

from __future__ import annotations

from dataclasses import replace

from docaudit.operators.rules import Rule, swap_rule

#: Names, patterns and levels.
RUSSIAN = (
    ("Apostrophe_CyrillicEnding", r"[A-Za-z0-9]+[’'](?:[а-яё]+)", "warning"),
    ("Content_PlaceholderText", r"(?m)^текст$", "error"),
    ("Currency_FromAmount", r"(?U)\b[Оо]т(?=\d)", "error"),
    ("Dash_EmDash", r"—", "error"),
    ("Dash_HyphenSpace", r"(?U)\w\s+-\s+\w", "warning"),
    ("Dash_NoSpace", r"[а-яА-ЯёЁ]–|–[а-яА-ЯёЁ]", "error"),
    ("DearUser", r"(?U)[Уу]важаем\w+\s+\w+", "error"),
    ("FileFormats_ExtensionCase", r"(?U)\.(TXT|PDF|JSON|CSV|YAML|PNG|JPG|JPEG|SVG|ZIP|SQL|MD|SH|PY|HTML|XML)\b", "error"),
    ("FileFormats_FormatCase", r"(?U)формат\w*\s+(txt|pdf|json|csv|yaml|png|jpg|jpeg|svg|zip|sql|md|sh|py|html|xml)\b", "error"),
    ("Formatting_LineSeparator", "\\u2028", "error"),
    ("Formatting_SoftHyphen", "\\u00ad", "error"),
    ("Grammar_BezGerund", r"(?iU)\bбез\s+[а-яё]+(?:ая|яя)\b", "error"),
    ("HomogeneousMembers", r"(?U)\w+,\s+\w+,\s+\w+,\s+\w+,", "warning"),
    ("Imperative", r"(?U)[Вв]ам\s+(следует|необходимо|нужно|стоит|надо|придется|требуется)|[Вв]ы\s+должны|[Сс]ледует\s+\w+ть|[Нн]еобходимо\s+\w+ть|[Тт]ребуется\s+\w+ть", "warning"),
    ("LetterYo", r"(?U)\b\w*[ёЁ]\w*\b", "warning"),
    ("Parentheses", r"\([^)]{25,}\)", "suggestion"),
    ("Please", r"(?iU)\bпожалуйста\b", "warning"),
    ("Possessives", r"(?U)\b[Нн]аш[аеиу]?\w*\s+\w+", "warning"),
    ("Quotes_LatinInQuotes", r"[«„\"][A-Za-z][^»\"„]*[»\"]", "error"),
    ("Quotes_Straight", r"\"[^\"]*\"", "error"),
    ("Slash_Words", r"(?U)\b(?:[а-яА-ЯёЁ]+/[а-яА-ЯёЁ]+|[A-Z]{2,}/[A-Z]{2,})\b", "warning"),
    ("Spacing_Double", r"[^\n ] {2,}[^\n ]", "error"),
    ("Terminology_WebPrefix", r"(?iU)\bweb-[А-Яа-яЁё]+", "error"),
    ("UITerms_CheckboxVerbs", r"(?iU)(выставит\w*|включит\w*|выключит\w*|отключит\w*|поставит\w*|отметит\w*|выделит\w*)\s+флажок", "error"),
    ("UITerms_Click", r"(?iU)\b(?:клик[а-яё]*\.?|проклик[а-яё]*\.?)\b", "error"),
    ("UITerms_DoubleClick", r"(?iU)дважды\s+клик\w+", "error"),
    ("UITerms_Field", r"(?iU)определ\w+\s+значени\w+", "error"),
    ("UITerms_List", r"(?iU)(?:позици\w+|строк\w+|пункт\w+)\s+списк\w+", "warning"),
    ("UITerms_Menu", r"(?iU)(?:динамическ\w+|всплывающ\w+)\s+меню", "error"),
    ("UITerms_RightClick", r"(?iU)щелкн\w+\s+правой\s+кнопкой", "error"),
    ("UITerms_SettingsGroup", r"(?iU)групп\w+\s+параметр\w*", "error"),
    ("UITerms_Tab", r"(?iU)(активизир\w+|откройте|перейдите\s+на)\s+вкладк\w+", "error"),
    ("UITerms_WindowMove", r"(?iU)(?:перетащ\w+|передвин\w+)\s+окн\w+", "error"),
    ("UITerms_WindowResize", r"(?iU)(?:раздвин\w+|расшир\w+|суз\w+)\s+окн\w+", "error"),
    ("Units_International", r"(?U)\b(MB|GB|TB|KB|Mbit|Gbit|kbit|MHz|GHz|kHz|THz)\b", "error"),
    ("Units_Period", r"(?U)(байт|бит|мин|сек|Гц|Вт|МБ|ГБ|КБ|ТБ|Мбит|Гбит|кбит|кГц|МГц|ГГц)\.\s", "error"),
    ("Abbreviations", r"(?U)\b[А-ЯЁ]{2,}\b", "suggestion"),
)

#: Abbreviations that need no explanation.
KNOWN_ABBREVIATIONS = (
    "IP URL HTTP HTTPS API DNS DDoS SMS HTML CSS PDF SQL USB ПО ОС БД МБ ГБ ТБ КБ ИТ ЦП ОЗУ ПЗУ ЛВС ВМ РФ ЕС США СНГ ФИО СМИ ООО АО ФСТЭК SOC SLA WAF CDN ML GDPR PoP"
).split()

#: Words to replace, and whether their case counts.
SWAPS = (
    ("IPAddress", True, {"ip-адрес": "IP-адрес", "ip адрес": "IP-адрес", "Ip-адрес": "IP-адрес", "Ip адрес": "IP-адрес", "IP адрес": "IP-адрес", "ip-адреса": "IP-адреса", "ip-адресов": "IP-адресов"}),
    ("UITerms_Checkbox", False, {"флаг": "флажок", "галочка": "флажок", "галка": "флажок", "чекбокс": "флажок"}),
    ("UITerms_Slider", False, {"бегунок": "ползунок", "бегунка": "ползунка"}),
)

EXCEPTIONS = {"Abbreviations": tuple(KNOWN_ABBREVIATIONS)}
RULES = tuple(Rule(name, pattern, name.replace("_", " "), level, exceptions=EXCEPTIONS.get(name, ())) for name, pattern, level in RUSSIAN) + tuple(
    swap_rule(name, swap, name.replace("_", " "), "error", ignorecase=not cased) for name, cased, swap in SWAPS
)


def named(name: str, literal: str) -> Rule:
    """A rule of the catalogue; lines without ``literal`` need not be tried."""
    return replace(next(r for r in RULES if r.rule == name), literal=literal)


#: Rules over any script: four of the catalogue and three of this library.
DEFAULT_RULES = (
    named("Quotes_Straight", '"'), named("HomogeneousMembers", ","), named("Spacing_Double", "  "), named("Parentheses", "("),
    Rule("Digits_Long", r"[0-9]{16}", "Long run of digits", "suggestion"),
    Rule("Email_Address", r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++", "Personal address", "suggestion", literal="@"),
    Rule("Exclamation_Double", r"!{2,}", "One exclamation mark is enough", "warning", literal="!!", replacement="!"),
)
