"""Queries over text columns: whole documents, and the same documents spelt in Arabic letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from . import base

LATIN, SPELT = "abcdefghijklmnopqrstuvwxyz", "اأىؤئگکیڪێٱبكرهحلهـًٌ٠۵،؟٪"
_SPELT = f"spelt AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{SPELT}') AS t FROM documents)"
_S = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def spelt(spark, d):
    return base.read(spark, d, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, SPELT).alias("t"))


def _step(f):
    return lambda spark, d: spelt(spark, d).select("doc_id", F.md5(f(F.col("t"))).alias("digest"))


def _normal(df, column, lang=None):
    out = text.normalize(df, column, lang)
    return out.select("doc_id", F.md5("normalized").alias("digest"), F.size("tokens").alias("n_tokens"), "detected_script")


def x1(spark, d):
    return _normal(base.read(spark, d, "documents"), "text")


def x1_arabic(spark, d):
    return _normal(spelt(spark, d), "t")


def x9(spark, d):
    return spelt(spark, d).select("doc_id", text.detect_script(F.col("t")).alias("arabic"), text.detect_script(F.concat(F.substring("t", 1, 3), F.lit("z"))).alias("mixed"), text.detect_script(F.lit("12")).alias("none"))


def x10(spark, d):
    return text.normalize(spelt(spark, d), "t").select("doc_id", F.array_join("applied_rules", ",").alias("rules"))


def x13(spark, d):
    out = base.read(spark, d, "documents").select("doc_id", F.explode(text.tokenize(text.clean(F.lower("text")))).alias("token"))
    return out.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def x23(spark, d):
    a = base.read(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"))
    b = F.concat("a", F.when(F.col("p_partkey") % 3 == 0, " shop").when(F.col("p_partkey") % 3 == 1, "").otherwise(""))
    other = F.when(F.col("p_partkey") % 3 == 2, F.reverse("a")).otherwise(b)
    return a.select("p_partkey", text.names_similar(F.col("a"), other).alias("similar"))


def x14(spark, d):
    p = base.places(spark, d)
    return p.select("_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(33.3152), F.lit(44.3661)), 6).alias("m"), geo.round2(F.col("lat") * 100 / 7).alias("r2"), geo.grid_key(F.col("lon"), F.col("lat")).alias("grid"), F.round(geo.meters_to_units(F.col("lon"), 4326), 9).alias("units"))


def x18(spark, d):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    p = base.places(spark, d).select("_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return p.select("_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_H = base.sql_haversine("lat", "lon", "33.3152::DOUBLE", "44.3661::DOUBLE")


def r15(spark, d):
    m = geo.haversine(F.col("lat"), F.col("lon"), F.lit(33.3152), F.lit(44.3661))
    return base.places(spark, d).select("_id", F.round(geo.gauss(m, 3000.0, 200.0), 6).alias("decay"), geo.steps(m).alias("ring"))


def _one(sql: str) -> str:
    return f"WITH {_SPELT} SELECT doc_id, md5({sql}) AS digest FROM spelt"


def _fixed(x: str) -> str:
    for a, b in text.SPELLINGS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _tr(x: str, a: str, b: str) -> str:
    return f"translate({x}, '{a}', '{b}')"


_DIA = "regexp_replace({0}, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g')"
_TRIM = "regexp_replace(regexp_replace({0}, '^[" + _S.replace("{", "{{").replace("}", "}}") + "]+', ''), '[" + _S.replace("{", "{{").replace("}", "}}") + "]+$', '')"
_CLEAN = _TRIM.format("regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}" + _S.replace("{", "{{").replace("}", "}}") + ".,;?!_-]+', ' ', 'g'), '[" + _S.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g')").replace("{{", "{").replace("}}", "}")
_CLEAN = _CLEAN.replace("{0}", "<X>")
_FOLDS = [("remove_diacritics", lambda x: _DIA.format(x)), ("remove_tatweel", lambda x: f"replace({x}, 'ـ', '')"), ("normalize_alef", lambda x: _tr(x, text.ALEF, "اااا")), ("normalize_alef_maqsura", lambda x: _tr(x, "ى", "ي")), ("normalize_hamza_carriers", lambda x: _tr(x, "ؤئ", "وي")),
    ("normalize_persian_chars", lambda x: _tr(x, "گکی", "ككي")), ("normalize_kurdish_kaf_yaa", lambda x: _tr(x, "ڪێ", "كي")), ("normalize_iraqi_spellings", _fixed)]
_LATER = [("arabic_digits_to_latin", lambda x: _tr(x, text.DIGITS, text.LATIN_DIGITS)), ("arabic_punctuation", lambda x: _tr(x, "،؛؟٪٫", ",;?%."))]


def _chain(source: str, arabic: bool) -> tuple[str, list[str]]:
    ctes, rules, last = [f"s0 AS (SELECT doc_id, {_TRIM.format('t')} AS t, [] AS rules FROM {source})"], [], "s0"
    steps = (_FOLDS if arabic else []) + [("lowercase", lambda x: f"lower({x})")] + _LATER
    for n, (rule, f) in enumerate(steps, 1):
        note = f"list_append(rules, '{rule}')" if rule == "lowercase" else f"CASE WHEN {f('t')} <> t THEN list_append(rules, '{rule}') ELSE rules END"
        ctes.append(f"s{n} AS MATERIALIZED (SELECT doc_id, {f('t')} AS t, {note} AS rules FROM {last})")
        last = f"s{n}"
    return last, ctes


_last, _ctes = _chain("spelt", True)
_AR = f"WITH {_SPELT}, {', '.join(_ctes)}, f AS (SELECT doc_id, {_CLEAN.replace('<X>', 't')} AS n, rules FROM {_last})"
_last2, _ctes2 = _chain("(SELECT doc_id, text AS t FROM documents)", False)
_LA = f"WITH {', '.join(_ctes2)}, f AS (SELECT doc_id, {_CLEAN.replace('<X>', 't')} AS n FROM {_last2})"
_COUNT = "CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END::INT AS n_tokens"
_INDEX = _tr(_tr(_tr(_tr("replace(" + _DIA.format(_TRIM.format("t")) + ", 'ـ', '')", text.ALEF, "اااا"), "ىؤئ", "يوي"), "کڪیێ", "ككيي"), text.DIGITS, text.LATIN_DIGITS)

QUERIES = {
    "x1_normalize_text": (x1, f"{_LA} SELECT doc_id, md5(n) AS digest, {_COUNT}, CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 'latin' ELSE 'unknown' END AS detected_script FROM f JOIN documents USING (doc_id)"),
    "x1_normalize_arabic": (x1_arabic, f"{_AR} SELECT doc_id, md5(n) AS digest, {_COUNT}, CASE WHEN regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'arabic' ELSE 'unknown' END AS detected_script FROM f JOIN spelt USING (doc_id)"),
    "x2_strip_diacritics": (_step(text.strip_diacritics), _one(_DIA.format("t"))),
    "x3_strip_tatweel": (_step(text.strip_tatweel), _one("replace(t, 'ـ', '')")),
    "x4_fold_alef_hamza": (_step(lambda c: text.fold_hamza(text.fold_alef_maqsura(text.fold_alef(c)))), _one(_tr(_tr("t", text.ALEF, "اااا"), "ىؤئ", "يوي"))),
    "x5_fold_persian_kurdish": (_step(lambda c: text.fold_kurdish(text.fold_persian(c))), _one(_tr("t", "گکیڪێ", "ككيكي"))),
    "x6_spelling_fixes": (_step(text.fix_spellings), _one(_fixed("t"))),
    "x7_digits_to_latin": (_step(text.latin_digits), _one(_tr("t", text.DIGITS, text.LATIN_DIGITS))),
    "x8_arabic_punctuation": (_step(text.latin_punctuation), _one(_tr("t", "،؛؟٪٫", ",;?%."))),
    "x9_detect_script": (x9, f"WITH {_SPELT} SELECT doc_id, CASE WHEN regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'arabic' ELSE 'unknown' END AS arabic, CASE WHEN regexp_matches(left(t, 3), '[\\x{{0600}}-\\x{{06FF}}]') THEN 'mixed' ELSE 'latin' END AS mixed, 'unknown' AS none FROM spelt"),
    "x10_applied_rules": (x10, f"{_AR} SELECT doc_id, array_to_string(rules, ',') AS rules FROM f"),
    "x11_index_term_normalize": (_step(text.index_term), _one(f"regexp_replace(lower({_INDEX}), '[{_S}]+', ' ', 'g')")),
    "x12_alias_normalize": (_step(text.alias_form), _one("regexp_replace(" + _tr(_tr("replace(" + _DIA.format("lower(" + _TRIM.format("t") + ")") + ", 'ـ', '')", text.ALEF, "اااا"), "ى", "ي") + f", '[{_S}]+', ' ', 'g')")),
    "x13_tokenize": (x13, "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(" + _CLEAN.replace("<X>", "lower(text)") + ", ' ')) AS token FROM documents) WHERE token <> '' GROUP BY 1"),
    "x14_to_x17_geo_scalars": (x14, base.sql(f"SELECT _id, round({_H}, 6) AS m, floor(lat * 100 / 7 * 100 + 0.5) / 100 AS r2, printf('%.5f:%.5f', lon, lat) AS grid, round(lon / 111000.0, 9) AS units FROM places", "places")),
    "x18_mercator": (x18, base.sql("SELECT _id, round(radians(lon) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places", "places")),
    "x23_names_similar": (x23, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN lower(p_name) = reverse(lower(p_name)) ELSE p_partkey % 3 = 1 OR length(p_name) > 3 END AS similar FROM part"),
    "r15_r16_decay_rings": (r15, base.sql(f"SELECT _id, round(exp(-pow(greatest(0.0, m - 200), 2) * ln(2) / pow(3000, 2)), 6) AS decay, ((CASE WHEN m <= 5000 THEN 40 ELSE 0 END) + (CASE WHEN m <= 25000 THEN 15 ELSE 0 END) + (CASE WHEN m <= 100000 THEN 5 ELSE 0 END))::DOUBLE AS ring FROM (SELECT _id, {_H} AS m FROM places)", "places")),
}
