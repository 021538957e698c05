"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import articles, contamination, dialogues, jaccard, language, lines, merkle, mixing, phrases, records, secrets, toxicity, urls
from plumbline.llm.shared import held_out, shared_folder, table

QUERIES = {}
ORACLES: dict[str, str] = {}

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in record files, read back: where each starts, how many it has and their checksum."""
    index = records.write_records(table(spark, sf_dir, "documents"), shared_folder(spark, "records"), tokenizer_path(), END_ID, keep=True)
    return records.read_records(index).select("doc_id", "start", "n_tokens", "ids_crc32")


TOXIC = 0.7


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))


@query
def op2_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by classifiers that learned from confirmed toxic and unlabelled text of two folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.scored(docs, toxicity_model(spark, docs, sf_dir))
    score = F.col("toxicity.score")
    return rated.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"), (score >= TOXIC).cast("int").alias("predicted"))


# Target weights in units; each source that is not named has an equal part of OTHER_UNITS as its own weight.
SOURCE_UNITS = {"src0": 15, "src1": 8, "src2": 8, "src3": 8, "src4": 8, "src5": 6, "src6": 6, "src7": 6, "src8": 6, "src9": 6}
OTHER_UNITS = mixing.Divided(23)
BLOCK_DOCS = 16


@query
def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document when blocks of the sources are interleaved by target weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, SOURCE_UNITS, BLOCK_DOCS, OTHER_UNITS)


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 80 % of five-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def contaminated(into: str = "contamination"):
    return (F.col(f"{into}.n_hit") > 0) & (20 * F.col(f"{into}.n_hit") >= F.col(f"{into}.n_words"))


@query
def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op3_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's url by its rule, else by the class of urls it is linked with."""
    return urls.url_verdicts(table(spark, sf_dir, "pages"), RULES)


@query
def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document keeps without later copies of line runs of 50 words, and a digest of what is left."""
    kept = lines.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by prototypes from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    rated = language.identified(docs.select("doc_id", "text"), language.fit(docs, ~held_out("doc_id", 4, 2)))
    return rated.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query
def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edited version, how alike they are and which paragraphs differ."""
    made = merkle.fingerprinted_with_edits(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits")


@query
def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by fixed patterns and by character models that the patterns' matches train."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secrets(docs, secrets.fit(docs))
    many = [(F.size(f"secrets.{k}") / 2).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(
        "doc_id", *many, F.sha2(secrets.listed("secrets", secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.listed("secrets", secrets.KINDS).alias("spans")
    )


@query
def op11_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return articles.extracted(pages).select("page_id", "url", F.col("article.text").alias("text"), F.col("article.n_chars").alias("n_chars"))


@query
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and the cheapest repair of it."""
    return dialogues.audited(dialogues.damaged(table(spark, sf_dir, "conversations")))


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language by how much their parts keep together."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrase_collocations"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k AS size, phrase, f AS a, unnest(range(1, k)) AS place, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.place, l.f AS l, r.f AS r, ((c.a::HUGEINT * 2000000) // (l.f + r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.place], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.place + 1:c.size], ' ')
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1
), inside AS (
  SELECT DISTINCT lang, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, size - m + 2)]) AS phrase, a
  FROM (SELECT lang, size, a, w, unnest(range(2, size)) AS m FROM cuts WHERE place = 1 AND size > 2)
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.most IS NULL OR 100 * g.most < 80 * s.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
