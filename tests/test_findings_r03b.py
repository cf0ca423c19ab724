"""What a review of larger tables found, third pass."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import geocode, search
from waymark.plans import search as search_plans

DATA = "/root/testdata/sf0.001"


def test_index_of_classes_has_the_weights_of_all_documents(spark):
    """Rarities and mean lengths count the documents that a class stands for, not the classes."""
    docs = spark.range(90).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("_id"), F.when(F.col("id") % 9 == 0, "old stone bridge").when(F.col("id") % 3 == 0, "bridge").otherwise("stone house").alias("name"))
    fields = {"name.default": text.tokenize(F.col("name"))}
    rows = lambda i: {(r._id, r.token, round(r.weight, 9)) for r in i.weights.collect()}
    found = search.classes(docs, ["name"])
    kept = {r._id for r in found.collect()}
    assert len(kept) == 3
    assert rows(geocode.build(found, fields, members="members")) == {r for r in rows(geocode.build(docs, fields)) if r[0] in kept}


@pytest.mark.parametrize("name", ["p29", "r21", "r4"])
def test_pairs_are_scored_once_for_equal_queries_and_documents(spark, monkeypatch, name):
    """The documents that are scored are the classes', not all of them."""
    sizes, one = [], geocode.build
    monkeypatch.setattr(geocode, "build", lambda t, *a, **k: sizes.append((t.count(), k.get("members"))) or one(t, *a, **k))
    assert getattr(search_plans, name)(spark, DATA).count() > 0
    assert sizes == [(search_plans.docs(spark, DATA).select(*search_plans._SEARCHED).distinct().count(), "members")]


def test_stable_characters_need_no_normal_form():
    """A text of stable characters is in NFKC: none of them is changed, moved or drawn to the one before it."""
    import re
    import sys
    import unicodedata

    stable = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), text.STABLE) + "]")
    every = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    drawn = {chr(int(d.split()[-1], 16)) for c in every if (d := unicodedata.decomposition(c)) and not d.startswith("<") and " " in d} | {chr(k) for k in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    found = [c for c in every if stable.match(c)]
    assert len(found) > 30_000 and not [c for c in found if unicodedata.combining(c) or c in drawn or unicodedata.normalize("NFKC", c) != c]


def test_normal_form_of_pieces(monkeypatch):
    """Pieces of any size, nulls and empty texts give what each text by itself gives."""
    import unicodedata

    import pyarrow as pa

    texts = ["ﬁne e\u0301tat", None, "", " ", "ab  ﬃ", "½ x\u00a0y ", None, "plain"] * 3
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    sizes, one = [], text._normal_words
    monkeypatch.setattr(text, "_normal_words", lambda c: sizes.append(len(c)) or one(c))
    for piece in (1, 20, 1 << 20):
        monkeypatch.setattr(text, "PIECE", piece)
        assert text._normal(pa.array(texts).slice(1)).to_pylist() == want[1:]
    assert len(sizes) > 3 and text._normal(pa.array([], pa.string())).to_pylist() == []


def _stepwise(df):
    """The same normal form, step by step on whole texts."""
    steps = (text.strip_diacritics, text.strip_tatweel, text.fold_alef, text.fold_alef_maqsura, text.fold_hamza, text.fold_persian, text.fold_kurdish, text.fix_spellings)
    out = text.nfkc(df.withColumn("now", F.coalesce("text", F.lit(""))), "now").withColumn("now", F.regexp_replace("now", f"^{text.SPACE}+|{text.SPACE}+$", "")).withColumn("script", text.detect_script(F.coalesce("text", F.lit(""))))
    rules = F.array().cast("array<string>")
    for name, step in zip([r for r, _ in text.ARABIC_FOLDS] + ["normalize_iraqi_spellings", "lowercase", "arabic_digits_to_latin", "arabic_punctuation"], (*steps, F.lower, text.latin_digits, text.latin_punctuation)):
        next_ = F.when(F.col("script").isin("arabic", "mixed"), step(F.col("now"))).otherwise(F.col("now")) if step in steps else step(F.col("now"))
        noted = F.lit(True) if name == "lowercase" else next_ != F.col("now")
        out = out.withColumn("rules", F.when(noted, F.array_append(F.col("rules") if "rules" in out.columns else rules, F.lit(name))).otherwise(F.col("rules") if "rules" in out.columns else rules)).withColumn("now", next_)
    kept = F.regexp_replace("now", r"[^\p{L}\p{N}\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}.,;?!_-]+", " ")
    return out.withColumn("now", F.regexp_replace(F.regexp_replace(kept, f"{text.SPACE}+", " "), f"^{text.SPACE}+|{text.SPACE}+$", ""))


def test_normalize_in_one_pass_equals_its_steps(spark):
    import random

    some, rng = "abZÉé İ09.,;?!_-\u00a0\u3000\t\n\u0085\u200b'\"ﬁ½" + "إأآٱاىؤئگکیڪێـًٌّٰٟ٠۵،؛؟٪٫كرادهحلةو", random.Random(5)
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["كراده حِله", "كـراده", "٢ abc", "x، y", None, "", "plain text", "  both "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.normalized, r.applied_rules) for r in text.normalize(df).select("id", "normalized", "applied_rules").collect()}
    want = {r.id: (r.now, r.rules) for r in _stepwise(df).select("id", "now", "rules").collect()}
    assert {k: (texts[k], got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_parts_grow_with_the_table(spark, tmp_path):
    """A table has as many parts as its rows need, and each touched part is written by a task of its own."""
    from waymark.operators import sync

    assert sync.parts_for(1000) == 8 and sync.parts_for(216_000_000) == 432
    table = sync.PartTable(spark, f"file://{tmp_path}/t", parts=20)
    rows = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("_id"), F.col("id").alias("v"))
    table.upsert(rows, F.col("v"))
    table.upsert(rows.where("v < 900").withColumn("v", F.col("v") + 5000), F.col("v"))
    files = [f for f in (tmp_path / "t").rglob("*.parquet")]
    tasks = {}
    for f in files:
        tasks.setdefault((f.parent.parent.name, f.name.split("-")[1]), set()).add(f.parent.name)
    assert len(files) == 40 and all(len(parts) == 1 for parts in tasks.values())
    got = {r._id: r.v for r in table.read().collect()}
    assert len(got) == 2000 and all(v == (int(k[1:]) + 5000 if int(k[1:]) < 900 else int(k[1:])) for k, v in got.items())


def test_aliases_are_brought_to_their_form_once(spark):
    """Equal aliases meet before their form is made; a doubtful one stays where it is named, in any spelling."""
    from waymark.operators import intent

    rows = spark.createDataFrame([("a", "Place"), ("a", "place"), ("b", "place"), ("a", "Q12"), ("b", " Q12 "), ("a", "x"), ("a", "Cafe"), ("b", "CAFE")], "category_id string, alias string")
    manual = spark.createDataFrame([("a", "PLACE"), ("b", "q12"), ("b", "not given")], "category_id string, alias string")
    out = intent.safe_aliases(rows, manual)
    assert {tuple(r) for r in out.collect()} == {("a", "place"), ("b", "q12"), ("a", "cafe"), ("b", "cafe")} and out.count() == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 3


def test_few_terms_go_to_the_postings(spark, monkeypatch):
    """Terms that are few make no exchange by token or query, and the scores are those of the shuffled way."""
    q = spark.range(6).select(F.col("id").alias("query_id"), F.array(F.array(F.lit("a"), F.concat(F.lit("t"), F.col("id") % 3)), F.array(F.lit("b"))).alias("tt"))
    w = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 40).alias("_id"), F.when(F.col("id") < 120, "x").otherwise("y").alias("field"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("t0"), F.lit("t1"), F.lit("t2")), (F.col("id") / 40).cast("int") + 1).alias("token"), (F.col("id") % 7 + 1.0).alias("weight"))
    for operator in ("or", "and"):
        got = search.text_match(search.terms(q, "tt"), w, operator)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(query_id" not in plan and "hashpartitioning(token" not in plan
        rows = {(r.query_id, r._id, round(r.score, 9)) for r in got.collect()}
        monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
        assert rows == {(r.query_id, r._id, round(r.score, 9)) for r in search.text_match(search.terms(q, "tt"), w, operator).collect()} and rows
        monkeypatch.undo()


def test_postings_split_a_text_once(spark):
    """Lengths are made below the explode, not for each token of it."""
    docs = spark.createDataFrame([("a", "x y x"), ("b", "")], "_id string, t string")
    out = search.postings(docs, {"text": text.tokenize(F.lower("t"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("size(") and "lower" not in plan[: plan.index("Generate")]
    assert {(r.token, r.tf, r.length) for r in out.collect()} == {("x", 2, 3), ("y", 1, 3)}
