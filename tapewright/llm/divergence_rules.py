"""Quality rules by the distance of a document's histograms from those of languages, in DataFrame functions only.

Two histograms are taken of a text: its characters by class, and its common words (with all other words as one bin). Each is
compared with the same histogram of whole languages, summed over all documents marked with the language, by the
Jensen-Shannon distance (base 2, its square root); the nearest language counts, so a wrong or missing mark does no harm. A
text fails if it is far from every language. Short texts scatter, so a histogram counts from a least length on.

Base rules stand beside them: too few words, or too many words in repeated three-word windows.

Defined results: a null or empty text has no words and fails the base rule. A language without documents is no reference;
without any reference no histogram counts. Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import rows

#: Frequent function words of the languages that have a reference.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "a"),
    "de": ("der", "die", "und", "das", "ist", "ein", "zu", "den"),
    "fr": ("de", "la", "le", "et", "les", "des", "que", "en"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del"),
}
LANGUAGES = tuple(COMMON_WORDS)
VOCABULARY = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"
DIGITS = "0123456789"


@dataclass(frozen=True)
class Settings:
    least_words: int = 50
    most_repeated_percent: int = 50
    #: Characters and words from which on the two histograms count.
    least_characters: int = 200
    least_for_words: int = 80
    #: Largest distances from the nearest language.
    most_character_distance: float = 0.27
    most_word_distance: float = 0.28


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(_without(text, characters))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, counts of the base rules' inputs short of repeats, and the two histograms."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"))
    # Runs of small letters are most of a text: everything else is counted on what is left without them.
    base = base.withColumn("rest", F.regexp_replace("text", "[a-zß-ÿ]+", ""))
    base = base.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    capitals = F.length(F.regexp_replace("rest", "[^A-ZÀ-Þ]+", "")).cast("long")
    white, symbols = _count(F.col("rest"), WHITE), _count(F.col("rest"), SYMBOLS)
    lines = F.filter(F.split("text", "\n"), lambda x: _without(x, WHITE) != "")
    counted = base.select(
        "doc_id", "lang", "words", F.size("words").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_characters"),
        (F.length("text") - F.length("rest")).cast("long").alias("small"), capitals.alias("capitals"), white.alias("white"),
        symbols.alias("n_symbols"), _count(F.col("rest"), MARKS).alias("marks"), _count(F.col("rest"), DIGITS).alias("digits"),
        lines.alias("lines"), F.filter("words", lambda w: w.isin(*VOCABULARY)).alias("common"))
    other = F.col("n_characters") - F.col("small") - F.col("capitals") - F.col("white") - F.col("n_symbols") - F.col("marks") - F.col("digits")
    word_bins = [(F.size("common") - F.size(F.array_remove("common", w))).cast("long") for w in VOCABULARY]
    return counted.select(
        "doc_id", "lang", "words", "n_words", "n_characters", "n_symbols", (F.col("n_characters") - F.col("white")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array("small", "capitals", "white", "n_symbols", "marks", "digits", other).alias("characters"),
        F.array(*word_bins, F.col("n_words") - F.size("common")).alias("word_bins"))


def with_repeats(found: DataFrame) -> DataFrame:
    """Adds n_repeat_words: places inside three-word windows that occur twice or more, first occurrences included.

    Windows are compared by 64-bit hashes inside one row. A row without equal hashes, the common case, needs no more; else
    windows are sorted with their places, equal neighbours flagged, and the places they cover counted.
    """
    last = F.col("n_words").cast("int") - 3
    windows = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    hashed = found.withColumn("windows", windows)
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn("ordered", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))

    def equals_neighbour(e, i):
        return ((i > 0) & (F.get("ordered", i - 1)["h"] == e["h"])) | F.coalesce(F.get("ordered", i + 1)["h"] == e["h"], F.lit(False))

    placed = ordered.withColumn("places", F.sort_array(F.transform(F.filter("ordered", equals_neighbour), lambda e: e["at"])))
    steps = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return placed.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("windows", "ordered", "places", "words")


def references(found: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of each language over all of its documents: one row a language, at most as many as are listed."""
    sums = [F.sum(F.get("characters", F.lit(i))).alias(f"c{i}") for i in range(7)]
    sums += [F.sum(F.get("word_bins", F.lit(i))).alias(f"w{i}") for i in range(len(VOCABULARY) + 1)]
    out = {}
    for row in found.where(F.col("lang").isin(*LANGUAGES)).groupBy("lang").agg(*sums).collect():
        bins = [float(x) for x in row[1:]]
        characters, words = bins[:7], bins[7:]
        if sum(characters) and sum(words):
            out[row.lang] = ([x / sum(characters) for x in characters], [x / sum(words) for x in words])
    return out


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts from a reference, between 0 and 1."""

    def part(p, q):
        middle = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)

    parts = F.zip_with(counts, F.array(*map(F.lit, reference)), lambda n, q: part(n / total, q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def judged(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    settings = settings or Settings()
    found = measured(docs)
    known = references(found)

    def nearest(bins: str, total: str, which: int) -> Column:
        away = [distance(F.col(bins), F.col(total), known[lang][which]) for lang in sorted(known)]
        return F.least(*away) if len(away) > 1 else away[0] if away else F.lit(0.0)

    scored = with_repeats(found)
    scored = scored.withColumns({
        "character_distance": F.when(F.col("n_characters") >= settings.least_characters, nearest("characters", "n_characters", 0)),
        "word_distance": F.when(F.col("n_words") >= settings.least_for_words, nearest("word_bins", "n_words", 1))})
    failed = (F.col("n_words") < settings.least_words) | (100 * F.col("n_repeat_words") > settings.most_repeated_percent * F.col("n_words"))
    near = (F.coalesce(F.col("character_distance") <= settings.most_character_distance, F.lit(True))
            & F.coalesce(F.col("word_distance") <= settings.most_word_distance, F.lit(True)))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"),
        "character_distance", "word_distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query."""
    return judged(rows.documents(spark, sf_dir)).drop("character_distance", "word_distance")


def _sql_counts(text: str, characters: str) -> str:
    quoted = "".join(f"chr({ord(c)}) || " for c in characters) + "''"
    return f"(length({text}) - length(translate({text}, {quoted}, '')))"


def oracle_sql(settings: Settings | None = None) -> str:
    s = settings or Settings()
    chars = "['small', 'capitals', 'white', 'n_symbols', 'marks', 'digits', 'other']"
    words = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + ", '*other']"
    langs = ", ".join(f"'{x}'" for x in LANGUAGES)
    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[a-zß-ÿ]+', '', 'g') AS rest,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
counted AS (
  SELECT doc_id, lang, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_characters,
         length(text) - length(rest) AS small, length(regexp_replace(rest, '[^A-ZÀ-Þ]+', '', 'g')) AS capitals,
         {_sql_counts('rest', WHITE)} AS white, {_sql_counts('rest', SYMBOLS)} AS n_symbols,
         {_sql_counts('rest', MARKS)} AS marks, {_sql_counts('rest', DIGITS)} AS digits,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM base),
histograms AS (
  SELECT *, [small, capitals, white, n_symbols, marks, digits, n_characters - small - capitals - white - n_symbols - marks - digits] AS characters
  FROM counted),
tokens AS (SELECT doc_id, lang, n_words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM counted),
character_bins AS (SELECT doc_id, lang, n_characters AS total, unnest({chars}) AS bin, unnest(characters) AS n FROM histograms),
word_found AS (
  SELECT doc_id, CASE WHEN list_contains({words}, word) THEN word ELSE '*other' END AS bin, count(*) AS n FROM tokens GROUP BY ALL),
word_bins AS (
  SELECT d.doc_id, d.lang, d.n_words AS total, d.bin, coalesce(f.n, 0) AS n
  FROM (SELECT doc_id, lang, n_words, unnest({words}) AS bin FROM counted) d LEFT JOIN word_found f USING (doc_id, bin)),
character_reference AS (
  SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM character_bins WHERE lang IN ({langs}) GROUP BY lang, bin),
word_reference AS (
  SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM word_bins WHERE lang IN ({langs}) GROUP BY lang, bin),
terms AS (
  SELECT doc_id, 'c' AS kind, r.lang, n / total AS p, q FROM character_bins JOIN character_reference r USING (bin) WHERE total >= {s.least_characters}
  UNION ALL
  SELECT doc_id, 'w', r.lang, n / total, q FROM word_bins JOIN word_reference r USING (bin) WHERE total >= {s.least_for_words}),
distances AS (
  SELECT doc_id, kind, lang, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS away
  FROM terms GROUP BY doc_id, kind, lang),
far AS (
  SELECT doc_id, bool_or(away > CASE kind WHEN 'c' THEN {s.most_character_distance} ELSE {s.most_word_distance} END) AS far
  FROM (SELECT doc_id, kind, min(away) AS away FROM distances GROUP BY doc_id, kind) GROUP BY doc_id),
windows AS (
  SELECT doc_id, place, word AS a, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
repeated AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place + step) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS step) GROUP BY doc_id)
SELECT h.doc_id, n_words, CAST(n_characters - white AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
       n_words < {s.least_words} OR 100 * coalesce(n_repeat_words, 0) > {s.most_repeated_percent} * n_words AS base_failed,
       NOT (n_words < {s.least_words} OR 100 * coalesce(n_repeat_words, 0) > {s.most_repeated_percent} * n_words) AND NOT coalesce(far, false) AS kept
FROM histograms h LEFT JOIN covered USING (doc_id) LEFT JOIN far USING (doc_id)
"""
