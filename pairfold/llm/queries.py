"""Queries opN_<name> over the whole corpus tables, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.llm import decontaminate, embeddings, jaccard, language, licences, lm, mixing, quality, substrings, tokens
from pairfold.llm.common import crc_mod, table
from pairfold.llm.substrings import without_spans

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted-interpolation scores of every whole text, learned from six sevenths of them."""
    held_out = crc_mod("doc_id", 7) == 2
    got = lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole texts under links of 75 % Jaccard similarity of 5-word shingles."""
    return jaccard.similar(table(spark, sf_dir, "documents"), percent=75, shingle=5)


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are on the driver; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under piece_bpe_32k.model."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that stand in windows of 10 words of the benchmark."""
    got = decontaminate.with_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=10)
    hit = decontaminate.n_hit()
    items = F.col("__overlap.items")
    return got.select("doc_id", F.col("__overlap.n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    known = language.learn(docs.where(~held_out))
    return language.identify(docs, known).withColumn("held_out", held_out)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text, learned from two thirds of the labelled rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    got = quality.classify(docs, quality.learn(docs, labels.where(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every whole text."""
    got = licences.scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "licence", F.array_join("licences", ",").alias("licences"))


def _licence_oracle() -> str:
    """The scan line by line: a line is blank or sheds its comment signs, sentences are looked for between the marks that this leaves.

    Marks stand twice, as DuckDB's expressions cannot look ahead: one ends a sentence, the other begins the next one.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known, patterns = {}, []
    for text, name in licences.all_sentences().items():
        parts = re.findall(r"([a-z0-9]+)([^a-z0-9]*)", text.lower())
        known[" ".join(w for w, _ in parts)] = name
        gaps = ["[ LS]+" if re.search(r"[.;:!?]\s", gap) else "[ L]+" for _, gap in parts[:-1]]
        patterns.append("".join(w + g for (w, _), g in zip(parts, [*gaps, ""])))
    patterns.sort(key=lambda p: (-p.count("]+"), p))
    pairs = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in known.items())
    rules = ", ".join(f"({k}, {quoted(name)}, {quoted(',' + ','.join(run) + ',')})" for k, (name, run) in enumerate(licences.RULES))
    blank, signs = r"[^a-z0-9]*((rem|dnl)[ \t]*)?", r"^[^a-z0-9]*((rem|dnl|[a-z0-9]{1,2}\))[ \t]+[^a-z0-9]*)?"
    return f"""
WITH known(sentence, name) AS (VALUES {pairs}),
rules(k, licence, run) AS (VALUES {rules}),
l AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), E'\r\n?', E'\n', 'g'), E'\n') AS lines FROM documents),
m AS (SELECT doc_id, list_aggregate(list_transform(lines, lambda x: CASE WHEN regexp_full_match(x, '{blank}') THEN 'P' ELSE 'L' || regexp_replace(x, '{signs}', '') END), 'string_agg', '') || 'L' AS marked FROM l),
t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(marked, '[.;:!?][ \tL]+', 'S', 'g'), '[^a-z0-9LPS]+', ' ', 'g'), '([LPS])', '\\1\\1', 'g') AS marked FROM m),
c AS (SELECT doc_id, list_transform(regexp_extract_all(marked, '[LPS] ?({"|".join(patterns)}) ?[LPS]', 1), lambda x: regexp_replace(x, '[ LS]+', ' ', 'g')) AS cut FROM t),
e AS (SELECT doc_id, unnest(cut) AS sentence, generate_subscripts(cut, 1) AS place FROM c),
n AS (SELECT doc_id, place, name FROM e JOIN known USING (sentence)),
i AS (SELECT doc_id, count(*) AS n_sentences, string_agg(name, ',' ORDER BY place) AS ids FROM n GROUP BY doc_id),
r AS (SELECT doc_id, licence, min(k) AS k FROM i JOIN rules ON contains(',' || ids || ',', run) GROUP BY ALL),
o AS (SELECT doc_id, arg_min(licence, k) AS licence, string_agg(licence, ',' ORDER BY k) AS licences FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, licence, coalesce(licences, '') AS licences
FROM documents LEFT JOIN i USING (doc_id) LEFT JOIN o USING (doc_id)
"""


ORACLES["op6_licence_scan"] = _licence_oracle()


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources at 150 % of all words."""
    got = mixing.systematic_copies(table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the 50-byte strings of documents before it."""

    def digest(body: bytes | None, starts, ends) -> tuple:
        body = body or b""
        kept = without_spans(body, starts, ends)
        return len(body), len(body) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()

    got = substrings.repeats(table(spark, sf_dir, "documents"), digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return got.withColumnRenamed("key", "doc_id")


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label at a cosine of 0.98 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


ORACLES["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)] AS weight, 2 * source_size AS most FROM s),
o AS (SELECT *, most / weight AS full_at FROM w),
r AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
    (sum(weight) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left,
    (sum(source_size) OVER ())::BIGINT AS everything FROM o),
l AS (SELECT *, (everything * 1.5::DOUBLE - spent) / weight_left AS level FROM r),
f AS (SELECT arg_min(level, full_at) AS level FROM l WHERE most > weight * level),
t AS (
  SELECT source, source_size, least(weight * coalesce((SELECT level FROM f), 'inf'::DOUBLE), most::DOUBLE) AS target,
    ('0x' || substr(md5('mix:' || coalesce('=' || source, '')), 1, 4))::BIGINT / 65536 AS u FROM l),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(u + rate * place) - floor(u + rate * (place - 1)), 2)::BIGINT * size)::BIGINT AS taken FROM k
"""
