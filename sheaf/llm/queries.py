"""The registered queries of the numbered operators, at production parameters,
over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import chat, collocations, langid, lm, mixing, neardup, packing, passages, quality, sharding, simhash, toxicity, whitening
from sheaf.llm.tables import documents, keep, part_of
from sheaf.sources.tables import table



def tokenizers_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted target: documents that ``labels`` marks as of quality 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.rate(documents(spark, sf_dir), trusted)


@query("op2_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.85 or more."""
    return neardup.near_duplicates(documents(spark, sf_dir))


@query("op3_deleted_interpolation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents with crc32(doc_id) mod 7 other than 2."""
    held_out = part_of(F.col("doc_id"), 7) == 2
    scored = lm.score_corpus(documents(spark, sf_dir).select("doc_id", "text", (~held_out).alias("train")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OWN_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS body,
         regexp_replace(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS head
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + CASE WHEN role = 'assistant' THEN 9 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op4_chat_formatting", CHAT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(OWN_CONVERSATION, "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(given.unionByName(own))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 3, 1, 2, repeating; 150 % of all words; at most 2 copies."""
    return mixing.draw(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens of the 49k word vocabulary."""
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizers_path("word_bpe_49k.json")))


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: rows within Hamming distance 14, for every doc_id divisible by
    50 (the query set of the search); null elsewhere."""
    rows = keep(simhash.edited(documents(spark, sf_dir)), "fingerprints")
    asked = rows.where("doc_id % 50 = 0").select("doc_id", "fingerprint")
    return rows.join(simhash.near(rows.select("fingerprint"), asked).distinct(), "doc_id", "left")


@query("op8_minimax_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts into 16 shards of near equal bytes."""
    return sharding.shard(documents(spark, sf_dir)).select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of documents with crc32(doc_id) mod 5 other than 0."""
    docs = documents(spark, sf_dir)
    held_out = part_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_shared_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 40 words or more that a document shares with one of smaller
    doc_id, up to one word in five different."""
    return passages.passages(documents(spark, sf_dir))


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents with crc32(doc_id) mod 5 other than 0."""
    docs = documents(spark, sf_dir)
    held_out = part_of(F.col("doc_id"), 5) == 0
    return langid.predict(docs, langid.fit(docs.where(~held_out)), {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 components of x = floor(64 * entry) + 1000000."""
    return whitening.components(table(spark, sf_dir, "embeddings"))


PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM said), range(1, 5) AS s(k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM counted WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, cut,
         (2000000 * CAST(c.f AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM often WHERE k > 1) c
  JOIN often x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN often y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k)) AS i FROM often WHERE k > 2), range(2, 4) AS s(m) WHERE m < k AND i + m - 1 <= k),
around AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.f IS NULL OR 100 * o.f < 80 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


@query("op13_collocations", PHRASE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 4 words said 30 times or more."""
    return collocations.collocations(documents(spark, sf_dir))
