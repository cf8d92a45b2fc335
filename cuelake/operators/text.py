"""Row-level cleaning and classification: flags, clocks, keys, addresses, errors, languages, glossaries."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Fixed values that results must share.
TRUE_WORDS, FALSE_WORDS, STYLES = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n", "none", "null", ""), ("clean", "faithful")
PRIMERS = ("he", "en")
LANGUAGES = [("en", "English", False), ("he", "Hebrew", True), ("ar", "Arabic", True), ("es", "Spanish", False), ("fr", "French", False), ("de", "German", False), ("it", "Italian", False), ("pt", "Portuguese", False), ("ru", "Russian", False), ("ja", "Japanese", False), ("ko", "Korean", False), ("zh", "Chinese", False), ("tr", "Turkish", False)]


def parse_flag(value: Column, default: bool = False) -> Column:
    """Tolerant boolean; what isn't understood is the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*TRUE_WORDS), True).when(v.isin(*FALSE_WORDS), False).otherwise(default)


def _unparsed(flag: str) -> Column:
    return F.coalesce(~F.lower(F.trim(flag)).isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(False))


def normalise_flags(meta: DataFrame, flags: list[str], style: str | None = None, numbers: dict[str, float] | None = None) -> DataFrame:
    """``meta`` with its flags as booleans, its style as a known one, its ``numbers`` (with their defaults) as doubles, and ``unparsed``: how many flags weren't understood."""
    bad = F.lit(0)
    for f in flags:
        bad = bad + _unparsed(f).cast("int")
    out = meta.withColumn("unparsed", bad)
    for f in flags:
        out = out.withColumn(f, parse_flag(F.col(f)))
    for n, default in (numbers or {}).items():
        out = out.withColumn(n, F.coalesce(F.trim(n).try_cast("double"), F.lit(float(default))))
    if style:
        s = F.lower(F.trim(style))
        out = out.withColumn(style, F.when(s.isin(*STYLES), s).otherwise(STYLES[0]))
    return out


def unparsed_by_flag(meta: DataFrame, flags: list[str], style: str | None = None, numbers: list[str] = ()) -> DataFrame:
    """(flag, given, unparsed): how many values of each column are there, and how many of them fall back to the default."""
    bad = {f: _unparsed(f) for f in flags}
    bad |= {n: (F.trim(n) != "") & F.trim(n).try_cast("double").isNull() for n in numbers}
    if style:
        bad[style] = (F.trim(style) != "") & ~F.lower(F.trim(style)).isin(*STYLES)
    counts = meta.agg(*(F.struct(F.count(c).alias("given"), F.count_if(x).alias("unparsed")).alias(c) for c, x in bad.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("flag"), F.col(f"{c}.given").alias("given"), F.col(f"{c}.unparsed").alias("unparsed")) for c in bad))).alias("x")).select("x.*")


def range_check(df: DataFrame, col: str, default: int, low: int, high: int) -> DataFrame:
    """Integer of a text column and its error; what is out of range becomes the default, not the bound."""
    v = F.trim(col).try_cast("int")
    low_, high_ = v < low, v > high
    error = F.when(F.col(col).isNull(), None).when(v.isNull(), F.concat(F.lit("Invalid integer value: "), col)).when(low_, F.concat(F.lit("Value "), v.cast("string"), F.lit(f" is below minimum {low}"))).when(high_, F.concat(F.lit("Value "), v.cast("string"), F.lit(f" exceeds maximum {high}")))
    return df.withColumn("value", F.when(v.isNull() | low_ | high_, default).otherwise(v)).withColumn("error", error)


def range_report(df: DataFrame, rules: list[tuple[str, int, int]]) -> DataFrame:
    """(rule, given, not_integer, below, above) of each rule (column, low, high), in one pass; a null is not given."""
    made = []
    for name, low, high in rules:
        v = F.trim(name).try_cast("int")
        made.append(F.struct(F.count(name).alias("given"), F.count_if(F.col(name).isNotNull() & v.isNull()).alias("not_integer"), F.count_if(v < low).alias("below"), F.count_if(v > high).alias("above")).alias(name))
    cells = [F.struct(F.lit(f"{n} in {low}..{high}").alias("rule"), F.col(n)["given"].alias("given"), F.col(n)["not_integer"].alias("not_integer"), F.col(n)["below"].alias("below"), F.col(n)["above"].alias("above")) for n, low, high in rules]
    return df.agg(*made).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _clock(col: str, lenient: bool) -> tuple[Column, Column]:
    """(seconds, reason) of a clock column."""
    text = F.trim(col)
    parts = F.transform(F.split(text, ":"), lambda x: F.trim(x).try_cast("double" if lenient else "int"))
    broken = F.exists(parts, lambda x: x.isNull())
    late = F.lit(False) if lenient else F.exists(F.slice(parts, 2, 2), lambda x: x > 59)
    reason = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.size(parts) > 3, "format").when(broken, "number").when(late, "range")
    seconds = F.aggregate(parts, F.lit(0).cast("double" if lenient else "bigint"), lambda s, x: s * 60 + x)
    return F.when(reason.isNull(), seconds), reason


def parse_clock(df: DataFrame, col: str, lenient: bool = False) -> DataFrame:
    """Seconds of SS, MM:SS or HH:MM:SS with parts of 0 to 59 after the first, else null and a reason.

    ``lenient``: parts may be fractions and of any size, and seconds are a double.
    """
    seconds, reason = _clock(col, lenient)
    return df.withColumn("reason", reason).withColumn("seconds", seconds)


def parse_clock_columns(df: DataFrame, key: str, cols: list[str], lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(values, rejects): ``df`` with its clock columns in seconds, null where they are none; and (key, column, value, reason) of those."""
    read = {c: _clock(c, lenient) for c in cols}
    values = df.select(*(read[c][0].alias(c) if c in read else F.col(c) for c in df.columns))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), read[c][1].alias("reason")) for c in cols]
    rejects = df.select(F.col(key).alias("key"), F.explode(F.array(*cells)).alias("x")).where("x.reason is not null")
    return values, rejects.select("key", "x.*")


def clean_key(name: Column) -> Column:
    """ASCII slug of at most 100 characters; an empty one is ``video``."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_\s.-]", "_"), r"[\s_]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "video").otherwise(F.rtrim(F.substring(s, 1, 100), F.lit("_")))


MOST_NAME = 255


def safe_file_name(name: Column) -> Column:
    """The second policy: unsafe characters become ``_``, dots and blanks at the ends go, at most 255 characters with the extension kept."""
    s = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    dot = F.length(s) - F.instr(F.reverse(s), F.lit(".")) + 1  # place of the last dot, past the end if there is none
    stem, extension = F.substring(s, F.lit(1), dot - 1), F.substring(s, dot + 1, F.lit(MOST_NAME * 1000))
    room = MOST_NAME - F.length(extension) - 1
    cut = F.concat(F.substring(stem, F.lit(1), F.when(room >= 0, room).otherwise(F.greatest(F.lit(0), F.length(stem) + room))), F.lit("."), extension)
    return F.when(F.length(s) <= MOST_NAME, s).when(F.instr(s, ".") == 0, F.substring(s, 1, MOST_NAME)).otherwise(cut)


def allowed_extension(name: Column, allowed: list[str]) -> Column:
    """Whether what follows the last dot, in lower case, is one of ``allowed``; a name without a dot has none."""
    return F.coalesce((F.instr(name, ".") > 0) & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*allowed), F.lit(False))


def key_collisions(df: DataFrame, col: str, policy=clean_key) -> DataFrame:
    """Keys that several names share under a policy: the key, how many names, and the smallest."""
    keyed = df.select(F.col(col).alias("name")).distinct().withColumn("key", policy(F.col("name")))
    return keyed.groupBy("key").agg(F.count("*").alias("names"), F.min("name").alias("first_name")).where("names > 1")


def check_urls(df: DataFrame, allowed: list[str], watch_hosts: list[str], short_hosts: list[str]) -> DataFrame:
    """Verdict on an address by its host and path, its cache key (the ``v`` parameter, or the last path part), and which video of a playlist it means."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    v = F.regexp_extract("url", r"[?&]v=([^&#]*)", 1)
    ok = F.when(~host.isin(*allowed), False).when(host.isin(*watch_hosts), path.contains("/watch") | (v != "") | path.contains("/shorts/")).when(host.isin(*short_hosts), F.length(path) >= 2).otherwise(True)
    key = F.when(host.isin(*short_hosts), F.element_at(F.split(path, "/"), -1)).when(v != "", v).otherwise(F.col("url"))
    playlist = F.when(F.col("url").contains("list=") & F.col("url").contains("&index="), "selected").when(F.col("url").contains("list="), "one")
    return df.withColumn("host", host).withColumn("allowed", ok).withColumn("cache_key", key).withColumn("playlist", playlist)


def classify_errors(df: DataFrame, col: str) -> DataFrame:
    """Code of a message by the first rule that fits, the resolver's reason, and whether a retry may help."""
    m = F.lower(F.col(col))
    has = lambda *words: m.rlike("|".join(words))
    code = F.when(has("sign in to confirm", "bot"), "bot").when(has("private", "unavailable", "404", "not found"), "access").when(has("network", "timeout", "connection"), "network").otherwise("other")
    reason = F.when(has("log in", "logged-in", "cookies", "account"), "needs_login").when(has("unsupported url", "unable to extract", "no video"), "no_video").otherwise("unavailable")
    return df.withColumn("code", code).withColumn("reason", reason).withColumn("retryable", has("429", "5[0-9][0-9]", "timeout", "connection"))


def base_code(code: Column) -> Column:
    """The language of ``xx-YY`` or ``xx_YY``."""
    return F.element_at(F.split(F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-")), "-"), 1)


def same_language(a: Column, b: Column) -> Column:
    """Whether two codes name one known language; ``auto``, null and unknown codes match nothing."""
    return F.coalesce((base_code(a) == base_code(b)) & base_code(a).isin(*(x for x, _, _ in LANGUAGES)), F.lit(False))


def primer_language(code: Column) -> Column:
    """The language of the punctuation primer: the code's own if there is one, else English."""
    base = base_code(code)
    return F.when(base.isin(*PRIMERS), base).otherwise("en")


def language_profile(df: DataFrame, col: str) -> DataFrame:
    """Base code, English name and direction of a language code; unknown codes have no name and run left to right."""
    base = base_code(F.col(col))
    names = df.sparkSession.createDataFrame(LANGUAGES, "base string, language string, rtl boolean")
    return df.withColumn("base", base).join(F.broadcast(names), "base", "left").withColumn("rtl", F.coalesce("rtl", F.lit(False)))


def preferred_language(header: Column, supported: list[str], default: str = "en") -> Column:
    """The supported code of greatest quality in an Accept-Language header, the first on ties."""

    def one(x: Column, i: Column) -> Column:
        x = F.trim(x)
        q = F.when(x.contains(";q="), F.coalesce(F.element_at(F.split(x, ";q="), 2).try_cast("double"), F.lit(1.0))).otherwise(1.0)
        return F.struct((-q).alias("q"), i.alias("i"), F.lower(F.element_at(F.split(F.element_at(F.split(x, ";q="), 1), "-"), 1)).alias("code"))

    found = F.array_min(F.filter(F.transform(F.split(header, ","), one), lambda x: x["code"].isin(*supported)))
    return F.coalesce(found["code"], F.lit(default))


def content_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, copies, first_id) of contents that are there more than once; only digests are shuffled."""
    digests = df.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))
    return digests.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


#: terms that one automaton holds; a larger glossary is dealt over several, each with a pass over the cues
MOST_TERMS = 50_000


def _found_terms(cues: DataFrame, terms: list[tuple[str, str, str, str]]) -> DataFrame:
    """(video_id, cue_id, term, rendering) of the terms (folded term, folded rendering, term, rendering) that a cue holds and its translation does not render."""
    shared = cues.sparkSession.sparkContext.broadcast(terms)
    schema = StructType([cues.schema["video_id"], cues.schema["cue_id"], StructField("term", StringType()), StructField("rendering", StringType())])
    out = to_arrow_schema(schema)

    def run(batches):
        import ahocorasick

        by_key: dict[str, list] = {}
        for key, need, term, rendering in shared.value:
            by_key.setdefault(key, []).append((need, term, rendering))
        automaton = ahocorasick.Automaton()
        for key in by_key:
            automaton.add_word(key, key)
        automaton.make_automaton()
        for b in batches:
            rows = []
            for k, (text, said) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if by_key and text and said is not None:
                    for key in {key for _, key in automaton.iter(text)}:
                        rows += [(k, term, rendering) for need, term, rendering in by_key[key] if need not in said]
            at = pa.array([k for k, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([t for _, t, _ in rows], pa.string()), pa.array([r for _, _, r in rows], pa.string())], schema=out)

    return cues.select("video_id", "cue_id", F.lower("text").alias("t"), F.lower("translated_text").alias("s")).mapInArrow(run, schema)


def glossary_check(cues: DataFrame, glossary: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(video_id, cue_id, term, rendering): cues whose source holds a term, inside words too, but whose translation lacks its rendering.

    Case is folded.  Terms (term, rendering) that are null or empty, and cues without a text or a translation, give nothing.  An Aho-Corasick automaton,
    built once a task from a broadcast of bounded size, finds all terms in one walk over a text; cues are not shuffled.
    """
    terms = glossary.select(F.lower("term").alias("key"), F.lower("rendering").alias("need"), "term", "rendering").where("key <> '' and need is not null").distinct()
    blocks = max(1, -(-terms.count() // most))
    found = []
    for k in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).limit(4 * most + 1).collect()
        if len(own) > 4 * most:
            raise ValueError("too many renderings of one term for a broadcast")
        found.append(_found_terms(cues, [tuple(r) for r in own]))
    return functools.reduce(DataFrame.unionByName, found)


def token_estimates(df: DataFrame, col: str, rate: float = 0.15) -> DataFrame:
    """Estimated input and output tokens and cost in dollars of a text."""
    words = F.regexp_count(F.col(col), F.lit(r"\S+"))
    tokens = F.floor(words * 13 / 10)
    return df.withColumn("tokens_in", tokens).withColumn("tokens_out", F.least(F.floor(tokens * 8 / 10) + 200, tokens + 500)).withColumn("cost_usd", F.round((F.col("tokens_in") + 4 * F.col("tokens_out")) * rate / 1_000_000, 9))


def punctuation_health(segments: DataFrame) -> DataFrame:
    """Per video: stops, commas, capitals and characters of its text, and whether it has no stop."""
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p))).alias
    return segments.groupBy("video_id").agg(n("[.!?]")("stops"), n(",")("commas"), n("[A-Z]")("capitals"), F.sum(F.length("text")).alias("chars")).withColumn("unpunctuated", F.col("stops") == 0)


# The letters and marks of Hebrew typography and the shapes they act on.
HEBREW, PREFIX_LETTERS, SOUND_LETTERS, ACRONYM_MARK, SOUND_MARK = "\u05d0-\u05ea\u05ef-\u05f2", "בהוכלמש", "גזצץ", "״", "׳"
# what is quoted reaches to the next mark and is looked at twice at most, whether it has a Hebrew letter or is never closed
QUOTATION = rf'(?<![{HEBREW}\p{{L}}\p{{N}}_])([{PREFIX_LETTERS}]?)["{ACRONYM_MARK}](?=[^"{ACRONYM_MARK}\n{HEBREW}]*+[{HEBREW}])([^"{ACRONYM_MARK}\n]*+)["{ACRONYM_MARK}](?![{HEBREW}])'
ACRONYM, SOUND = rf'(?<=[{HEBREW}])"(?=[{HEBREW}])', rf"(?<=[{SOUND_LETTERS}])['’]"


def _repaired(text: Column, marks: str, rule: str, mark: str) -> tuple[Column, Column]:
    """(text after a rule, how often it was met); texts without any of the rule's marks are not searched."""
    maybe = functools.reduce(lambda x, y: x | y, (text.contains(m) for m in marks))
    met = F.when(maybe, F.regexp_count(text, F.lit(rule))).when(text.isNotNull(), 0)
    return F.when(maybe, F.regexp_replace(text, rule, mark)).otherwise(text), met


def repair_typography(df: DataFrame, col: str) -> DataFrame:
    """Hebrew typography: the same mark at both ends of a quoted Hebrew phrase, acronym marks between two letters, marks of
    foreign sounds; ``quotes``, ``acronyms`` and ``sounds`` count what each rule met."""
    quoted, quotes = _repaired(F.col(col), '"' + ACRONYM_MARK, QUOTATION, f"$1{ACRONYM_MARK}$2{ACRONYM_MARK}")
    df = df.withColumns({"quotes": quotes, col: quoted})
    acronym, acronyms = _repaired(F.col(col), '"', ACRONYM, ACRONYM_MARK)
    df = df.withColumns({"acronyms": acronyms, col: acronym})
    sound, sounds = _repaired(F.col(col), "'’", SOUND, SOUND_MARK)
    return df.withColumns({"sounds": sounds, col: sound})


#: a run: numeric signs, then from a left-to-right letter or digit to the last one before a right-to-left letter, then numeric signs
_RUN = re.compile("T*A(?:[^R]*A)?T*")
_SYMBOLS = {"R": "R", "AL": "R", "L": "A", "EN": "A", "AN": "A", "ET": "T"}
#: blocks that hold every right-to-left letter; which of a row's characters are is asked of the Unicode tables
MAY_BE_RTL = "[\u0590-\u08ff\u200f\ufb1d-\ufdff\ufe70-\ufeff\\x{10800}-\\x{10fff}\\x{1e800}-\\x{1efff}]"


def isolated(line: str) -> str:
    """A line with a right-to-left letter within an isolate, and each left-to-right run of it in its own."""
    kinds = "".join(_SYMBOLS.get(unicodedata.bidirectional(c), "N") for c in line)
    if "R" not in kinds:
        return line
    out, at = [], 0
    for m in _RUN.finditer(kinds):
        out += [line[at : m.start()], "⁦", line[m.start() : m.end()], "⁩"]
        at = m.end()
    return f"⁧{''.join(out)}{line[at:]}⁩"


@F.pandas_udf(StringType())
def _isolated(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "\n".join(map(isolated, t.split("\n"))))


def isolate_bidi(df: DataFrame, col: str) -> DataFrame:
    """Each right-to-left line within isolates, and each maximal run of other letters or digits in it in its own.

    Bidirectional categories are those of the Unicode tables; only texts that may hold such a letter go through Python.
    """
    maybe = F.col(col).rlike(MAY_BE_RTL)
    return df.withColumn(col, F.when(maybe, _isolated(F.when(maybe, F.col(col)))).otherwise(F.col(col)))


_OLD_MARKS = frozenset("\u202a\u202b\u202c\u202d\u202e\u200e\u200f")
#: white space of the Unicode tables and the four separators
_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("rtl", BooleanType()), StructField("ltr", BooleanType())]))
def _composed(text: pd.Series) -> pd.DataFrame:
    """The composed form of each text, and whether it has strong letters of either direction, old marks aside."""
    forms, rtl, ltr = [], [], []
    for t in text:
        kinds = set() if t is None else set(map(unicodedata.bidirectional, set(t) - _OLD_MARKS))
        forms.append(None if t is None else unicodedata.normalize("NFC", t))
        rtl.append(bool(kinds & {"R", "AL"}))
        ltr.append("L" in kinds)
    return pd.DataFrame({"text": forms, "rtl": rtl, "ltr": ltr})


def mark_rtl(df: DataFrame, col: str) -> DataFrame:
    """Legacy marks: white space folded, composed form, paired quotes as Hebrew marks, Arabic vowel signs and old marks gone.

    A text with a right-to-left letter or mark is then embedded right to left; in one that also has left-to-right letters, runs
    of two Latin letters or digits and more are embedded left to right; a mark goes between a Hebrew letter and the stop
    behind it, and inside parentheses.  Only texts with characters beyond ASCII go through Python.
    """
    # each step is a column of its own, so none is done again for the next
    df = df.withColumn("__raw", F.trim(F.regexp_replace(col, _SPACES, " "))).withColumn("__beyond", F.col("__raw").rlike(r"[^\x00-\x7F]"))
    df = df.withColumn("__c", _composed(F.when(F.col("__beyond"), F.col("__raw"))))
    df = df.withColumn("__text", F.when(F.col("__beyond"), F.col("__c.text")).otherwise(F.col("__raw")))
    for mark, pair in (('"', "״$1״"), ("'", "׳$1׳")):
        df = df.withColumn("__text", F.when(F.col("__text").contains(mark), F.regexp_replace("__text", f"{mark}([^{mark}]*+){mark}", pair)).otherwise(F.col("__text")))
    df = df.withColumn("__text", F.regexp_replace("__text", "[\u064b-\u0652\u202a-\u202e\u200e\u200f]", ""))
    bare = F.col("__text")
    rtl = F.coalesce(F.col("__c.rtl"), F.lit(False)) | bare.rlike("[״׳]")
    ltr = F.coalesce(F.col("__c.ltr"), F.lit(False)) | bare.rlike("[A-Za-z]")
    runs = F.regexp_replace(bare, r"[a-zA-Z0-9][a-zA-Z0-9\s\-_.,]*[a-zA-Z0-9]", "\u202a$0\u202c\u200e")
    whole = F.concat(F.lit("\u202b"), F.when(ltr, runs).otherwise(bare), F.lit("\u202c"))
    sticky = F.regexp_replace(whole, "([א-ת])([.!?:;,])", "$1\u200f$2")
    inside = F.regexp_replace(sticky, r"\(([^)]*+)\)", "(\u200f$1\u200f)")
    return df.withColumn(col, F.when((bare != "") & rtl, inside).otherwise(bare)).drop("__raw", "__beyond", "__c", "__text")
