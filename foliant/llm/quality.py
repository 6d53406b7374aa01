"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is a row of `RULES`: a ratio's name, its least and its largest allowed value, and the least
number of words from which it is judged. `measures()` gives the ratios, `verdict()` compiles the table
into one boolean expression.

Defined results: a null text counts as empty and fails for having too few words; ties and repeated rows
are judged alike and independently; an empty table gives an empty table; columns whose names clash with
the measures are replaced in `rated()` and left alone in `accepted()`, which returns the input's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._cluster import column

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of the corpus languages.
STOP_WORDS = tuple(
    "the of and to in is that it for was on are as with be at this have from or by an not but which a "
    "de la le et les des en un une du que est pour qui dans par sur pas au avec ce il plus ne se "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "el los las y por con para su al lo como más pero sus o este si sobre".split()
)


@dataclass(frozen=True)
class Rule:
    """Texts of at least min_words words need least <= measure <= most."""

    measure: str
    least: float | None
    most: float | None
    min_words: int = 0


RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.02, None, 30),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _windows(words: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), make)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows that the text holds twice or more.

    Most texts have no two windows with equal hashes, which one pass over a hash set shows. Only the others
    sort their windows themselves, so hash collisions cannot change the count.
    """
    keyed = F.array_sort(_windows(words, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    same = lambda a, b: F.coalesce(F.get(a, b)["w"], F.lit(""))
    # a left fold over sorted windows would copy; neighbours are compared by index instead
    hits = lambda s: F.filter(s, lambda x, k: (x["w"] == same(s, k - 1)) | (x["w"] == same(s, k + 1)))
    starts = F.array_sort(F.transform(hits(F.col("_sorted")), lambda x: x["i"]))
    gaps = lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    return keyed, starts, gaps


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "mean_word_chars", "symbols_per_word", "dup_line_ratio", "stop_word_ratio", "base_failed")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the rules' ratios, which replace columns of these names."""
    t = F.coalesce(column(docs, text), F.lit(""))
    df = docs.select(F.struct(*(column(docs, c) for c in docs.columns)).alias("_row"), t.alias("_text")).withColumn("_words", _words(F.col("_text")))
    df = df.withColumn("_hashes", F.when(F.size("_words") > WINDOW, _windows(F.col("_words"), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(WINDOW)]))))
    keyed, starts, gaps = _repeat_words(F.col("_words"), F.col("_hashes"))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), keyed))
    df = df.withColumn("_starts", starts)
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    long = lambda c: c.cast("long")
    df = df.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": long(F.length(F.translate("_text", SPACE, ""))),
            "n_symbols": long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_stop_words": long(F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))),
            "n_repeat_words": long(F.coalesce(gaps(F.col("_starts")), F.lit(0))),
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    df = df.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbols_per_word": ratio("n_symbols", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    return df.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in MEASURES), *MEASURES)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    ok = F.lit(True)
    for r in rules:
        c, good = F.col(r.measure), F.lit(True)
        if r.least is not None:
            good = good & (c >= F.lit(float(r.least)))
        if r.most is not None:
            good = good & (c <= F.lit(float(r.most)))
        ok = ok & ((F.col("n_words") < r.min_words) | good)
    return ok


def rated(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the measures and kept, false for texts that the base rule or a row of the table rejects."""
    return measures(docs, text).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    given = docs.withColumn("_row", F.struct(*[column(docs, c) for c in docs.columns])).select("_row", column(docs, text).alias("text"))
    # a filter on kept would be pushed below the measures, and carry a copy of them for each time it names one
    row = F.explode_outer(F.when(F.col("kept"), F.array("_row")))
    return rated(given, rules).select(row.alias("_row")).where("_row IS NOT NULL").select("_row.*")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rated(docs).select(*RESULT)


_RULE_SQL = " AND ".join(
    f"(n_words < {r.min_words} OR ({' AND '.join(([f'{r.measure} >= {r.least}'] if r.least is not None else []) + ([f'{r.measure} <= {r.most}'] if r.most is not None else []))}))" for r in RULES
)
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: A WITH list that ends in rated, one row for each row of documents with the text's columns.
RATED_SQL = f"""
docs0 AS (SELECT *, coalesce(text, '') AS t FROM documents),
docs1 AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs0),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS w
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM docs1 WHERE len(words) > 5)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
docs2 AS (SELECT d.*, len(words)::BIGINT AS n_words,
       length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       len(lines)::BIGINT AS n_lines,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       len(list_filter(words, lambda w: lower(w) IN ({_STOP_SQL})))::BIGINT AS n_stop_words,
       coalesce(rep.n, 0)::BIGINT AS n_repeat_words
       FROM docs1 d LEFT JOIN rep USING (doc_id)),
docs3 AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
       CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbols_per_word,
       CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
       CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END AS stop_word_ratio FROM docs2),
rated AS (SELECT *, NOT base_failed AND {_RULE_SQL} AS kept FROM docs3)"""

SQL = f"WITH {RATED_SQL} SELECT {', '.join(RESULT)} FROM rated"
