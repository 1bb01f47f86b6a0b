"""Personal data (operator 7), with DataFrame and SQL functions only: no Python runs on the executors.

Base spans follow fixed patterns and checks (email; ip with parts of at most 255; card of 12 to 19 digits that
pass Luhn; phone of 9 to 15 digits). The method is weak supervision: every base match, passed or failed, and
every match of looser patterns is a candidate; four labelers (the pattern check, gazetteers, words of the
context, isolation) vote yes, no or nothing on it. The votes of all candidates of all documents are counted
by vote pattern (a bounded number of rows, with partial sums before the shuffle), expectation-maximisation
over the counts estimates the labelers' reliabilities, and the posteriors train the final span classifier, a
logistic regression over span features. It adds the loose candidates that it puts at ``ADD_AT`` or more and that
overlap no base span; base spans always stay. Candidates are worked out once and written. Both are SQL folds over the counts in one job; only the classifier's weights come to the driver.

Positions are code points, ends exclusive. Patterns are written with possessive quantifiers, so very long
runs neither overflow a stack nor take quadratic time.

Defined results: null and empty texts have no spans (the digest of an empty string); rows without doc_id, repeated
rows and ties come back as they are; other columns are ignored; without candidates the classifier adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
ADD_AT = 0.9
CONTEXT_CHARS = 40
EM_STEPS, FIT_STEPS, RATE, DECAY = 8, 14, 0.5, 0.01

#: A match of any of these starts where a run starts or where the match before it ended: that is leftmost, without trying each place of a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9\-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
}
HINT = {
    ("base", "email"): "text LIKE '%@%'", ("base", "ip"): r"text RLIKE '[0-9]\\.[0-9]'", ("base", "card"): "text RLIKE '[0-9][ \\\\-]?[0-9]'", ("base", "phone"): r"text RLIKE '\\+[0-9]'",
    ("loose", "email"): r"text RLIKE '[\\[(] ?at ?[\\])]'", ("loose", "ip"): "text RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'", ("loose", "phone"): r"text RLIKE '[0-9]{3}[ .\\-][0-9]{4}'",
}
TLDS = "com|net|org|edu|gov|info|io|de|fr|es|uk|eu|example"
CUES = r"(?i)\b(?:e-?mail|mail|courriel|correo|contact|kontakt|contacto|write to|tel|phone|fon|telefon|téléphone|teléfono|mobile|handy|call|fax|card|carte|karte|tarjeta|visa|ip|host|address|adresse|dirección)\b[^\n]{0,12}$"
COUNTER_CUES = r"(?i)\b(?:isbn|issn|order|invoice|version|section|figure|table|token|build|ticket|rechnung|facture|factura|id|nr|no)\b[ .:=#\"]{0,6}$"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(pattern: str, hint: str) -> Column:
    """array<struct<start, end, value>> of the leftmost, non-overlapping matches in ``text``.

    Between the pieces that a split leaves stand the matches, so both have their places by running lengths. Those are
    summed in groups of 256, so that a text with very many matches is not copied again and again.
    """
    spans = "array<struct<start: int, end: int, value: string>>"
    zipped = f"arrays_zip(regexp_extract_all(text, {_sql(pattern)}, 0), split(text, {_sql(pattern)}, -1))"
    step = """(s, m) -> named_struct('pos', s.pos + length(m.`1`) + length(m.`0`), 'out', concat(s.out, array(named_struct(
        'start', s.pos + length(m.`1`), 'end', s.pos + length(m.`1`) + length(m.`0`), 'value', m.`0`))))"""
    group = f"aggregate(slice(z, c, least(256, size(z) - c)), named_struct('pos', t.pos, 'out', cast(array() as {spans})), {step})"
    groups = f"""aggregate(sequence(1, greatest(1, size(z) - 1), 256), named_struct('pos', 0, 'out', cast(array() as array<{spans}>)),
        (t, c) -> element_at(transform(array({group}), g -> named_struct('pos', g.pos, 'out', concat(t.out, array(g.out)))), 1), t -> flatten(t.out))"""
    # z and g are bound by one-element transforms, so that each is worked out once
    return F.expr(f"CASE WHEN {hint} THEN element_at(transform(array({zipped}), z -> {groups}), 1) ELSE cast(array() as {spans}) END")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda s, i: s + F.coalesce(worth(i), F.lit(0))) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _candidate(i: int, kind: str, base: bool, m: Column) -> Column:
    """A candidate with its votes (-1, 0, 1) and features (0 or 1)."""
    before = F.col("text").substr(F.greatest(m["start"] + 1 - CONTEXT_CHARS, F.lit(1)), F.least(m["start"], F.lit(CONTEXT_CHARS)))
    left, right = F.right(before, F.lit(1)), F.col("text").substr(m["end"] + 1, F.lit(1))
    ok = passes(kind, m["value"]) if base else F.lit(False)
    shape = F.when(ok, 1).otherwise(-1 if base else 0)
    if kind == "email":
        known = F.when(m["value"].rlike(rf"(?i)[.)\] ](?:{TLDS})$"), 1).otherwise(-1)
    elif kind == "card":
        known = F.when(m["value"].rlike("^[3-6]"), 1).otherwise(-1)
    elif kind == "ip":
        known = F.when(m["value"].rlike(r"^(?:0|127|25[0-9])\."), -1).otherwise(1)
    else:
        known = F.when(m["value"].rlike(r"^(?:\+(?:1|33|34|44|49)\b|\()"), 1).otherwise(0)
    cue = F.when(before.rlike(COUNTER_CUES), -1).when(before.rlike(CUES), 1).otherwise(0)
    alone = F.when(left.rlike(r"[\p{L}\p{N}_.@]") | right.rlike(r"[\p{L}\p{N}_@]"), -1).otherwise(1)
    digits = F.length(F.regexp_replace(m["value"], "[^0-9]", ""))
    return F.struct(
        m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), ok.alias("base"), F.lit(not base).alias("loose"),
        *(v.cast("int").alias(f"v{j}") for j, v in enumerate((shape, known, cue, alone))),
        F.when(digits.between(9, 16), 1).otherwise(0).alias("f_digits"), F.when(m["value"].rlike("[ ()\\-]"), 1).otherwise(0).alias("f_parted"),
    )


def _as_candidate(i: int, kind: str, base: bool) -> Callable[[Column], Column]:
    return lambda m: _candidate(i, kind, base, m)


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == i


def _clear_of(c: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``cands``: matches of the base patterns, and those of the loose ones that overlap no base span."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    tight = [F.transform(matches(BASE[k], HINT["base", k]), _as_candidate(i, k, True)) for i, k in enumerate(KINDS)]
    loose = [F.transform(matches(LOOSE[k], HINT["loose", k]), _as_candidate(i, k, False)) for i, k in enumerate(KINDS) if k in LOOSE]
    docs = docs.withColumn("cands", F.concat(*tight)).withColumn("base", F.array_sort(F.filter("cands", lambda c: c["base"])))
    return docs.withColumn("cands", F.concat("cands", F.filter(F.concat(*loose), lambda c: _clear_of(c, F.col("base")))))


VOTES = [f"v{j}" for j in range(4)]
FEATURES = ["f_one", *(f"f_kind{i}" for i in range(len(KINDS))), "f_loose", "f_digits", "f_parted", *(f"f_v{j}_{'yes' if u > 0 else 'no'}" for j in range(4) for u in (1, -1))]


def _feature(c: Column, name: str) -> Column:
    if name == "f_one":
        return F.lit(1)
    if name.startswith("f_kind"):
        return (c["kind"] == int(name[6:])).cast("int")
    if name == "f_loose":
        return c["loose"].cast("int")
    if name.startswith("f_v"):
        return (c[name[2:4]] == (1 if name.endswith("yes") else -1)).cast("int")
    return c[name]


def vote_patterns(cands: DataFrame) -> DataFrame:
    """How often each combination of votes and features occurs: some thousand rows at most, whatever the corpus."""
    names = ["kind", "loose", *VOTES, "f_digits", "f_parted"]
    rows = cands.where(F.size("cands") > 0).select(F.explode("cands").alias("c")).select("c.*")
    return written(rows.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "votes")


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _total(items: str, term: str) -> str:
    return f"aggregate({items}, 0D, (s, x) -> s + {term})"


def reliabilities() -> str:
    """Expectation-maximisation over ``ps`` (votes v, number n) as one SQL fold; gives ``share``, the share of private candidates, and ``t``, each labeler's chance of each vote
    given the class: place 12 * class + 3 * labeler + vote + 1. The pattern check starts as the most reliable labeler."""
    start = [(0.8, 0.5) if u == y else (0.05, 0.2) if u == -y else (0.15, 0.3) for y in (-1, 1) for u in (-1, 0, 1)]
    t = ", ".join(f"{start[3 * y + u][0 if j == 0 else 1]}D" for y in range(2) for j in range(4) for u in range(3))
    odds = " + ".join(f"ln(m.t[12 + {3 * j + 1} + p.v[{j}]] / m.t[{3 * j + 1} + p.v[{j}]])" for j in range(4))
    expected = f"transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'w', p.n / (1 + exp(-(ln(m.share / (1 - m.share)) + {odds})))))"
    yes, whole = _total("q", "x.w"), _total("q", "x.n")
    voted = _total("q", "CASE WHEN x.v[cast(floor((k % 12) / 3) AS int)] = k % 3 - 1 THEN CASE WHEN k >= 12 THEN x.w ELSE x.n - x.w END ELSE 0D END")
    chances = f"transform(sequence(0, 23), k -> ({voted} + 1) / (CASE WHEN k >= 12 THEN {yes} ELSE {whole} - {yes} END + 3))"
    step = _bound(expected, "q", f"named_struct('share', least(0.95D, greatest(0.05D, {yes} / {whole})), 't', {chances})")
    return f"aggregate(sequence(1, {EM_STEPS}), named_struct('share', 0.6D, 't', array({t})), (m, i) -> {step})"


def classifier(patterns: DataFrame) -> dict[str, float]:
    """Weights of the span classifier, fitted to the posteriors by damped steps over the counted patterns. Both folds run in one small job."""
    c = F.struct(*patterns.columns)
    p = F.struct(F.array(*VOTES).alias("v"), F.col("n"), F.array(*(_feature(c, f).cast("double") for f in FEATURES)).alias("f"))
    one = patterns.agg(F.array_sort(F.collect_list(p)).alias("ps")).where("size(ps) > 0").withColumn("m", F.expr(reliabilities()))
    odds = " + ".join(f"ln(m.t[12 + {3 * j + 1} + p.v[{j}]] / m.t[{3 * j + 1} + p.v[{j}]])" for j in range(4))
    one = one.withColumn("ps", F.expr(f"transform(ps, p -> named_struct('f', p.f, 'n', p.n, 'p', 1 / (1 + exp(-(ln(m.share / (1 - m.share)) + {odds})))))"))
    linear = "aggregate(zip_with(p.f, w, (a, b) -> a * b), 0D, (s, x) -> s + x)"
    errors = "transform(ps, p -> " + _bound(f"1 / (1 + exp(-{linear}))", "z", "named_struct('f', p.f, 'n', p.n, 'e', p.n * (p.p - z), 'h', p.n * z * (1 - z))") + ")"
    whole = _total("q", "x.n")
    moved = f"transform(w, (wk, k) -> wk + {RATE}D * ({_total('q', 'x.e * x.f[k]')} / {whole} - {DECAY}D * wk) / ({_total('q', 'x.h * x.f[k]')} / {whole} + {DECAY}D))"
    fold = f"aggregate(sequence(1, {FIT_STEPS}), array_repeat(0D, {len(FEATURES)}), (w, i) -> {_bound(errors, 'q', moved)})"
    got = one.select(F.expr(fold).alias("w")).first()
    # without candidates nothing is added
    return dict(zip(FEATURES, got["w"])) if got else dict.fromkeys(FEATURES, 0.0) | {"f_one": -35.0}


def with_spans(found: DataFrame) -> DataFrame:
    """Adds ``base`` and ``spans`` to rows with their candidates: sorted arrays of struct<start, kind, end, ...>, kind as a place in ``KINDS``. ``found`` should be a written table, as it is read twice."""
    weights = classifier(vote_patterns(found.select("cands")))

    def adds(c: Column) -> Column:
        linear = sum((_feature(c, f) * w for f, w in weights.items()), F.lit(0.0))
        return c["base"] | (c["loose"] & (1 / (1 + F.exp(-linear)) >= ADD_AT))

    return found.withColumn("spans", F.array_sort(F.filter("cands", adds))).drop("cands")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and n_chars to match if there is such a column. Overlapping spans give one mark."""
    columns = docs.columns
    inner = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    found = with_spans(written(with_candidates(inner).select("row", "cands"), "candidates")).withColumn("text", F.coalesce("row.text", F.lit("")))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        fresh = F.concat(s["out"], F.array(F.col("text").substr(s["pos"] + 1, m["start"] - s["pos"]), names[m["kind"]]))
        return F.struct(F.greatest(s["pos"], m["end"]).alias("pos"), F.when(m["start"] >= s["pos"], fresh).otherwise(s["out"]).alias("out"))

    text = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.col("text").substr(s["pos"] + 1, F.length("text"))))
    found = found.withColumn("clean", F.when(F.size("spans") > 0, text).otherwise(F.col("row.text")))
    out = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars").cast("long"))} if "n_chars" in columns else {"text": F.col("clean")}
    return found.select(*(out.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in columns))


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and n_spans (all spans, those that the classifier adds too) of every row."""
    found = with_spans(written(with_candidates(docs.select("doc_id", "text")).select("doc_id", "base", "cands"), "candidates"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
