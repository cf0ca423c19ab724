"""Multilingual text columns: three normal forms, script detection, tokens.

All steps are JVM expressions but NFKC, which Spark lacks: `nfkc` sends only the rows that hold a character
which a normal form may change to an Arrow function.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character folds and spellings that results must share with existing indexes.
ALEF = "إأآٱ"
PERSIAN = {"گ": "ك", "ک": "ك", "ی": "ي"}
KURDISH = {"ڪ": "ك", "ێ": "ي"}
SPELLINGS = {
    "كراده": "كرادة",
    "حارثيه": "حارثية",
    "منطقه": "منطقة",
    "مدينه": "مدينة",
    "جامعه": "جامعة",
    "بصره": "بصرة",
    "ناصريه": "ناصرية",
    "ديوانيه": "ديوانية",
    "سماوه": "سماوة",
    "عماره": "عمارة",
    "كوفه": "كوفة",
    "حله": "حلة",
}
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "01234567890123456789"
PUNCTUATION = {"،": ",", "؛": ";", "؟": "?", "٪": "%", "٫": "."}
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


#: Characters that no normal form changes and that compose with nothing before them: a text of these alone is in NFKC.
STABLE = r"\x00-\x7F\x{00BF}-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{0391}-\x{03A1}\x{03A3}-\x{03CE}\x{0400}-\x{0482}\x{060C}\x{061B}\x{061F}-\x{064A}\x{0660}-\x{066F}\x{0671}-\x{0674}\x{0679}-\x{06D3}\x{06F0}-\x{06F9}\x{2018}-\x{201D}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
#: Bytes of texts that a Python task takes apart at once.
PIECE = 1 << 20


def _normal(column: pa.Array) -> pa.Array:
    """NFKC of strings, each distinct word of a piece of PIECE bytes once, so that memory follows the batch and not its
    words. A blank is a character that no other one composes with, so a text's normal form is that of its words."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_numpy()
    parts, start = [], 0
    while start < len(column):
        stop = max(start + 1, int(ends.searchsorted((ends[start - 1] if start else 0) + PIECE, "right")))
        parts.append(_normal_words(column.slice(start, stop - start)))
        start = stop
    return pa.concat_arrays(parts) if parts else column


def _normal_words(column: pa.Array) -> pa.Array:
    split = pc.split_pattern(column, " ")
    words = split.flatten().dictionary_encode()
    known = pa.array([w if w.isascii() else unicodedata.normalize("NFKC", w) for w in words.dictionary.to_pylist()], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(split.offsets, known.take(words.indices), mask=split.is_null()), " ")


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """Bring a column to NFKC, in one pass: texts of stable characters stay in the JVM, the others go by as Arrow batches."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return _normal(texts)

    beyond = F.col(column).rlike(rf"(?=[^\x00-\x7F])[^{STABLE}]")  # most characters are passed over by the first class
    return df.withColumn(column, F.coalesce(normal(F.when(beyond, F.col(column))), F.col(column)))


def _folded(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def trim_space(c: Column) -> Column:
    """Without spaces at its ends. Only a text that has one there is searched; a line's end may follow the last one."""
    at_end = F.substring(c, 1, 1).rlike(SPACE) | F.substring(c, -1, 1).rlike(f"{SPACE}|\\x{{0085}}")
    return F.when(at_end, F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{064B}-\x{065F}\x{0670}]", "")


def strip_tatweel(c: Column) -> Column:
    return F.translate(c, "ـ", "")


def fold_alef(c: Column) -> Column:
    return F.translate(c, ALEF, "ا" * len(ALEF))


def fold_alef_maqsura(c: Column) -> Column:
    return F.translate(c, "ى", "ي")


def fold_hamza(c: Column) -> Column:
    return F.translate(c, "ؤئ", "وي")


def fold_persian(c: Column) -> Column:
    return _folded(c, PERSIAN)


def fold_kurdish(c: Column) -> Column:
    return _folded(c, KURDISH)


def fix_spellings(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), SPELLINGS.items(), c)


def latin_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, LATIN_DIGITS)


def latin_punctuation(c: Column) -> Column:
    return _folded(c, PUNCTUATION)


def detect_script(c: Column) -> Column:
    arabic, latin = c.rlike(ARABIC), c.rlike("[a-zA-Z]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").otherwise("unknown")


def clean(c: Column) -> Column:
    """Letters, digits, spaces and . , ; ? ! _ - stay; the rest becomes a space; spaces are single. So a run of anything
    else, spaces included, becomes one blank, and a run that is one blank is passed over."""
    kept = r"\p{L}\p{N}.,;?!_-"
    return F.trim(F.regexp_replace(c, f"(?![a-z])[^ {kept}][^{kept}]*| [^{kept}]+", " "))


#: Steps that replace or drop single characters, in order: rule, and what becomes of each character.
ARABIC_FOLDS = (
    ("remove_diacritics", {chr(k): "" for k in (*range(0x064B, 0x0660), 0x0670)}),
    ("remove_tatweel", {"ـ": ""}),
    ("normalize_alef", dict.fromkeys(ALEF, "ا")),
    ("normalize_alef_maqsura", {"ى": "ي"}),
    ("normalize_hamza_carriers", {"ؤ": "و", "ئ": "ي"}),
    ("normalize_persian_chars", PERSIAN),
    ("normalize_kurdish_kaf_yaa", KURDISH),
)
LATIN_FOLDS = (("arabic_digits_to_latin", dict(zip(DIGITS, LATIN_DIGITS))), ("arabic_punctuation", PUNCTUATION))


def _composed(steps: tuple[tuple[str, dict[str, str]], ...]) -> tuple[dict[str, str], dict[str, str]]:
    """What all steps together make of each character, and the characters of a text that make each step change it."""
    now, changed = {c: c for _, table in steps for c in table}, {}
    for rule, table in steps:
        changed[rule] = "".join(c for c, v in now.items() if table.get(v, v) != v)
        now = {c: table.get(v, v) for c, v in now.items()}
    return now, changed


def _in_one(c: Column, steps: tuple[tuple[str, dict[str, str]], ...]) -> Column:
    """A text after all steps, in one pass: characters that are dropped stand last, where translate has nothing for them."""
    table, _ = _composed(steps)
    kept = {k: v for k, v in table.items() if v}
    return F.translate(c, "".join(kept) + "".join(k for k, v in table.items() if not v), "".join(kept.values()))


def _rules(c: Column, steps: tuple[tuple[str, dict[str, str]], ...]) -> list[Column]:
    """Each step's rule where it changes the text, else null."""
    return [F.when(c.rlike(f"[{chars}]"), rule) for rule, chars in _composed(steps)[1].items()]


def normalize(df: DataFrame, text: str = "text", lang: str | None = None, to_nfkc: bool = True) -> DataFrame:
    """Adds normalized, tokens, detected_script, applied_rules for a text column (and a language column). Steps that
    change single characters are one pass; a rule is noted where the text has a character that its step changes."""
    source = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("detected_script", detect_script(source)).withColumn("__now", source)
    if to_nfkc:
        out = nfkc(out, "__now")
    out = out.withColumn("__now", trim_space(F.col("__now")))
    code = F.lower(F.coalesce(F.col(lang), F.lit(""))) if lang else F.lit("")
    is_arabic = code.startswith("ar") | code.startswith("ku") | (code == "ckb") | F.col("detected_script").isin("arabic", "mixed")
    # Texts without any character of the folds' block are passed over.
    out = out.withColumn("__block", F.col("__now").rlike(r"[\x{0600}-\x{06FF}]")).withColumn("__arabic", is_arabic & F.col("__block"))
    none = F.lit(None).cast("string")
    when = lambda flag, found, steps: [F.when(F.col(flag), r).otherwise(none) for r in _rules(found, steps)]
    # Each step is its own projection, so that the next one does not repeat its expression.
    out = out.withColumn("__first", F.array(*when("__arabic", F.col("__now"), ARABIC_FOLDS)))
    out = out.withColumn("__now", F.when(F.col("__arabic"), _in_one(F.col("__now"), ARABIC_FOLDS)).otherwise(F.col("__now")))
    out = out.withColumn("__next", F.when(F.col("__arabic"), fix_spellings(F.col("__now"))).otherwise(F.col("__now")))
    out = out.withColumn("__first", F.array_append("__first", F.when(F.col("__next") != F.col("__now"), "normalize_iraqi_spellings").otherwise(none)))
    out = out.withColumn("__now", F.lower("__next"))
    noted = F.concat("__first", F.array(F.lit("lowercase"), *when("__block", F.col("__now"), LATIN_FOLDS)))
    out = out.withColumn("applied_rules", F.array_compact(noted))
    out = out.withColumn("__now", F.when(F.col("__block"), _in_one(F.col("__now"), LATIN_FOLDS)).otherwise(F.col("__now")))
    out = out.withColumn("normalized", clean(F.col("__now")))
    return out.withColumn("tokens", tokenize(F.col("normalized"))).drop("__now", "__next", "__first", "__block", "__arabic")


def tokenize(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def index_term(c: Column) -> Column:
    """The index's form of a term: folds and lower case, punctuation kept, گ kept. NFKC comes before, by `nfkc`."""
    c = strip_tatweel(strip_diacritics(trim_space(c)))
    c = fold_hamza(fold_alef_maqsura(fold_alef(c)))
    c = latin_digits(_folded(c, {"ک": "ك", "ڪ": "ك", "ی": "ي", "ێ": "ي"}))
    return F.regexp_replace(F.lower(c), f"{SPACE}+", " ")


def alias_form(c: Column) -> Column:
    """The lighter form of aliases: lower case first, then only the folds of alef and alef maqsura."""
    c = fold_alef_maqsura(fold_alef(strip_tatweel(strip_diacritics(F.lower(trim_space(c))))))
    return F.regexp_replace(c, f"{SPACE}+", " ")


def names_similar(a: Column, b: Column) -> Column:
    """Equal, or both longer than 3 characters and one inside the other. For normalised names."""
    long = (F.length(a) > 3) & (F.length(b) > 3)
    return (a != "") & (b != "") & ((a == b) | (long & (a.contains(b) | b.contains(a))))
