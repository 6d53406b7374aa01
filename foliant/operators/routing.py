"""What a message asks for: corpus questions, documents it names, languages. All batched: messages join documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T

# Patterns of messages. File names are of ASCII characters, so that Java's and RE2's engines agree.
LIST_DOCS = (
    r"(?i)\b(how many (docs?|documents?|pdfs?|files?)|list (the )?(docs?|documents?|pdfs?|files?)|"
    r"what (docs?|documents?|pdfs?|files?) (are|do you have|in (the )?db|in (the )?database)|"
    r"(docs?|documents?|pdfs?|files?) (do you have|in (the )?db|in (the )?database))\b"
)
CONTENT = r"(?i)\b(contain|have|mention|include|about|with)\b"
LANGUAGE = (
    r"(?i)\b(which|what|are (any|the)).*\b(docs?|documents?|pdfs?|files?|one|ones)\b"
    r".*\b(language|french|english|german|spanish|arabic|chinese|japanese|italian"
    r"|portuguese|dutch|russian|korean|turkish)\b"
    r"|\b(what language|in what language|written in)\b"
)
ABOUT_FILE = r"(?i)\b(what is|what'?s|tell me about|summaris[ez]|describe|explain|overview of|about)\b.{0,60}?([A-Za-z0-9_\-]+\.pdf)"
SUMMARISE = r"(?i)\b(summaris[ez]|summarize|give me a summary of|what is|what'?s|tell me about|overview of)\b.{0,40}?\b(doc(?:ument)?)\s*([0-9]+|[A-Za-z0-9_\-]+\.pdf)"
UI_LIST = (
    r"(?i)\b(how many|combien)\b.*\b(doc|document|fichier|pdf|file)s?\b"
    r"|\b(list|liste|quels?|which|what)\b.*\b(doc|document|fichier|pdf|file)s?\b"
    r"|\b(doc|document|fichier|pdf|file)s?\b.*\b(do you have|y a-t-il|disponibles?)\b"
)
UI_CONTENT = r"(?i)\b(about|contain|mention|sur|parle|contient|à propos)\b"
FILE_NAME = r"(?i)\b([A-Za-z0-9_\-]+\.pdf)\b"
ALL_DOCS = (
    r"(?i)\b(each|every|all|chaque|tous|toutes)\b.{0,30}\b(doc|document|fichier|pdf|file)s?\b"
    r"|\b(doc|document|fichier|pdf|file)s?\b.{0,30}\b(each|every|all|chacun)\b"
)
# Frequent words of languages, by which texts are told apart; of equal counts the first language wins.
LANGUAGES = {
    "French": "en tant que|je veux|afin de|livreur|livraison|commande|parcourir|panier|client|produits|haute|basse|priorit[eé]|qualit[eé]|souhaite|disponibles|laisser|ameliorer|necesaire|necesit|avec|pour|dans|est|sont|les|des|une|qui|que|sur|par",
    "English": "the|and|for|that|this|with|have|from|are|will|been|their|were|which|they|more|also|than|when|would|about|there|could|other",
    "German": "und|die|der|das|ist|von|mit|dem|für|sich|auf|den|eine|nicht|auch|werden|oder|über|bei|aus|nach",
    "Spanish": "el|la|los|las|de|que|en|un|una|por|con|más|pero|como|del|este|esta|para|sobre|entre|también",
}


def intent(message: Column) -> Column:
    """language, listing, about_file, summarise or question: the first that a message is."""
    own = F.regexp_replace(message, r"(?i)\bdo you have\b", "")
    return (
        F.when(message.rlike(LANGUAGE), "language").when(message.rlike(LIST_DOCS) & ~own.rlike(CONTENT), "listing").when(message.rlike(ABOUT_FILE), "about_file").when(message.rlike(SUMMARISE), "summarise").otherwise("question")
    )


def ui_intent(message: Column) -> Column:
    """listing or question, in English and French."""
    return F.when(message.rlike(UI_LIST) & ~message.rlike(UI_CONTENT), "listing").otherwise("question")


def wants_all(message: Column) -> Column:
    return message.rlike(ALL_DOCS)


def asked_language(message: Column) -> Column:
    """The first known language named in a message."""
    out = F.lit(None).cast("string")
    for name in reversed(LANGUAGES):
        out = F.when(F.contains(F.lower(message), F.lit(name.lower())), name).otherwise(out)
    return out


def language(sample: Column) -> Column:
    """The language with the most of its frequent words in a sample; Unknown without any."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(sample), r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))
    counts = {name: F.size(F.split(padded, f" ({words.replace(' ', '  ')}) ")) - 1 for name, words in LANGUAGES.items()}
    best = F.greatest(*counts.values())
    out = F.lit("Unknown")
    for name in reversed(LANGUAGES):
        out = F.when((counts[name] == best) & (best > 0), name).otherwise(out)
    return out


def detected_languages(chunks: DataFrame, n: int = 5, chars: int = 2000) -> DataFrame:
    """(document_id, language) from the start of each document's first chunks (document_id, chunk_id, text)."""
    first = chunks.withColumn("nth", F.row_number().over(W.partitionBy("document_id").orderBy("chunk_id"))).where(F.col("nth") <= n)
    sample = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " "), 1, chars)
    return first.groupBy("document_id").agg(sample.alias("sample")).select("document_id", language(F.col("sample")).alias("language"))


def found_documents(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """(ref, document_id) of refs that are a document's id, or its filename in any case; of several, the least id."""
    number = F.expr("try_cast(ref AS bigint)")
    by_id = refs.where(F.col("ref").rlike("^-*[0-9]+$")).select("ref", number.alias("document_id")).join(documents.select("document_id"), "document_id", "left_semi")
    names = documents.groupBy(F.lower("filename").alias("name")).agg(F.min("document_id").alias("document_id"))
    by_name = refs.where(~F.col("ref").rlike("^-*[0-9]+$")).withColumn("name", F.lower("ref")).join(names, "name")
    return by_id.select("ref", "document_id").unionByName(by_name.select("ref", "document_id")).distinct()


def stem(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.pdf$", "")


def _parts(text: Column, lengths: Column) -> Column:
    """The distinct parts of a short text that have one of some lengths."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), at)))


def _lengths(df: DataFrame, text: str) -> DataFrame:
    """One row of the lengths that texts have; null and empty ones aside."""
    return F.broadcast(df.where(F.length(text) > 0).agg(F.collect_set(F.length(text)).alias("lengths")))


def matched_documents(names: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, document_id) of names that match one document: by the name itself, else the start of its stem, else a part of it, either way.

    File names are short, so their parts are spelt out, those of a length that can match, and all joins have an equality. Documents
    are counted by part before they are joined, so a part that many share is a row. Both sides of a join grow with the input, and
    spelt-out rows are many more than Spark reckons with, so none is broadcast.
    """
    own = names.select("name").distinct().select("name", F.lower("name").alias("low"), stem(F.col("name")).alias("own")).where("own <> ''")
    docs = documents.select("document_id", F.lower("filename").alias("file"), stem(F.col("filename")).alias("stem"))
    counted = [F.count("*").alias("n"), F.min("document_id").alias("document_id")]
    stage = lambda whole: F.when(F.startswith(whole, F.col("part")), 1).otherwise(2).alias("stage")
    files, stems = docs.groupBy("file").agg(*counted), docs.groupBy(F.col("stem").alias("part")).agg(*counted)
    same = own.join(files.hint("merge"), own.low == files.file).select("name", F.lit(0).alias("stage"), "n", "document_id")
    in_doc = docs.join(_lengths(own, "own")).select("document_id", "stem", F.explode(_parts(F.col("stem"), F.col("lengths"))).alias("part"))
    in_doc = in_doc.groupBy("part", stage(F.col("stem"))).agg(*counted)
    in_doc = own.select("name", F.col("own").alias("part")).join(in_doc.hint("merge"), "part").select("name", "stage", "n", "document_id")
    # a whole name is among the documents' parts already
    in_name = own.join(_lengths(docs, "stem")).select("name", "own", F.explode(_parts(F.col("own"), F.col("lengths"))).alias("part")).where("part <> own")
    in_name = in_name.join(stems.hint("merge"), "part").select("name", stage(F.col("own")), "n", "document_id")
    best = same.unionByName(in_doc).unionByName(in_name).groupBy("name", "stage").agg(F.sum("n").alias("n"), F.min("document_id").alias("document_id"))
    first = best.groupBy("name").agg(F.min(F.struct("stage", "n", "document_id")).alias("b"))
    return first.where("b.stage = 0 OR b.n = 1").select("name", "b.document_id")


def scope(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """messages (message_id, text) with the document that their first file name means, or the name if it means none."""
    named = messages.withColumn("name", F.nullif(F.regexp_extract("text", FILE_NAME, 1), F.lit("")))
    found = matched_documents(named.where("name IS NOT NULL").select("name"), documents)
    return named.join(found.hint("merge"), "name", "left").select("message_id", "document_id", F.when(F.col("document_id").isNull(), F.col("name")).alias("unknown_name"))


def routed(messages: DataFrame, documents: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(message_id, document_id) of messages that hold a document's file name, or match a rule (pattern, file name); the least id, the first rule.

    File names are looked up among a message's own words that end like one, so the join has an equality.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s,;:!?\"'()]+\.[a-z0-9]+)"), F.lit(1))
    # a name can begin anywhere in a word
    tails = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.length(w)))))
    said = messages.select("message_id", F.explode(F.array_distinct(tails)).alias("file"))
    by_name = said.join(documents.select(F.lower("filename").alias("file"), "document_id"), "file").groupBy("message_id").agg(F.min("document_id").alias("document_id"))
    out = messages.select("message_id", "text").join(by_name, "message_id", "left")
    for number, (pattern, target) in enumerate(rules):
        known = documents.where(F.lower("filename") == target.lower()).agg(F.min("document_id").alias(f"rule_{number}"))
        out = out.join(F.broadcast(known)).withColumn("document_id", F.coalesce("document_id", F.when(F.col("text").rlike(f"(?i){pattern}"), F.col(f"rule_{number}"))))
    return out.where("document_id IS NOT NULL").select("message_id", "document_id")


def summary_ref(message: Column) -> Column:
    """The document that a message asks to sum up: a file name, else a number."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(message, ABOUT_FILE, 2)), F.lit("")), F.nullif(F.lower(F.regexp_extract(message, SUMMARISE, 3)), F.lit("")))


def variants(text: Column) -> Column:
    """A model's lines without bullets, numbers and quotes, without repeats in any case, in order."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: T.stripped(F.regexp_replace(F.regexp_replace(T.stripped(x), r"^(?:[-*•]|[0-9]+[.)])\s*", ""), r"^[\"']+|[\"']+$", "")))
    kept = F.filter(lines, lambda x: x != "")
    return F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)
