"""Registry of the queries over the given tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import TOKEN_PATTERN, WORD_PATTERN
from tokenloom.operators.tokens import tokens_from_text
from tokenloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SENTENCE = ["doc_id", "line"]
TOKEN = [*SENTENCE, "token_index"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def sql_round(value: str, digits: int = 6) -> str:
    return f"(round(CAST({value} AS DOUBLE), {digits}) + 0.0)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- text tables: one sentence per line of a document, tokens by the raw-text pattern, language as the label


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with enough partitions for per-row text work."""
    return spread(table(spark, folder, "documents"), "doc_id")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    documents = text_documents(spark, folder)
    return documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens_from_text(lines(spark, folder), label="lang")


def text_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence table of the documents: token structs built inside each line, without a shuffle."""
    from tokenloom.functions.text import is_word, tokenize

    forms = lines(spark, folder).withColumn("_forms", tokenize("text"))
    token = lambda form, index: F.struct(
        (index + 1).cast("string").alias("ID"),
        form.alias("FORM"),
        F.lower(form).alias("LEMMA"),
        F.when(is_word(form), F.lit("X")).otherwise(F.lit("PUNCT")).alias("UPOS"),
        F.col("lang").alias("SEMCLASS"),
        index.alias("token_index"),
    )
    return forms.select(
        "doc_id",
        "line",
        "lang",
        "source",
        F.transform("_forms", token).alias("tokens"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents)"""
TOKENS = f"""{LINES}, tokens AS (
  SELECT doc_id, line, lang, source, token_index, FORM, lower(FORM) AS LEMMA,
         regexp_matches(FORM, '[\\p{{L}}\\p{{N}}]') AS is_word
  FROM (SELECT doc_id, line, lang, source,
               unnest(regexp_extract_all(text, {_quoted(TOKEN_PATTERN)})) AS FORM,
               generate_subscripts(regexp_extract_all(text, {_quoted(TOKEN_PATTERN)}), 1) - 1 AS token_index
        FROM lines) AS t)"""
TERMS = f"""{TOKENS}, terms AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY token_index) AS pos
  FROM tokens WHERE is_word)"""
GRAMS = f"""{TERMS}, grams AS (
  SELECT doc_id, line, lang, source, token_index, LEMMA AS w1,
         lead(LEMMA, 1) OVER s AS w2, lead(LEMMA, 2) OVER s AS w3,
         lead(token_index, 1) OVER s AS t2, lead(token_index, 2) OVER s AS t3
  FROM terms WINDOW s AS (PARTITION BY doc_id, line ORDER BY token_index))"""


# --- cluster columns that SQL can compute too


def text_cluster(run: int = 1) -> Column:
    """Cluster of a text token from its form and place; -1 (noise) occurs."""
    mixed = F.length("FORM") * 3 + F.col("token_index") + F.col("doc_id") * run
    return (F.pmod(mixed, F.lit(11 + run)) - 1).cast("bigint")


def text_cluster_sql(run: int = 1) -> str:
    return f"CAST((length(FORM) * 3 + token_index + doc_id * {run}) % {11 + run} - 1 AS BIGINT)"


def vector_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as clustered tokens: forms and lemmas from the id, label and cluster from the label."""
    rows = table(spark, folder, "embeddings")
    vec = F.col("vec_id")
    form = F.concat(F.when(vec % 3 == 0, F.lit("W")).otherwise(F.lit("w")), (vec % 50).cast("string"))
    return rows.select(
        "vec_id",
        F.floor(vec / 10).cast("bigint").alias("sentence_index"),
        (vec % 10).alias("token_index"),
        form.alias("FORM"),
        F.concat(F.lit("l"), (vec % 20).cast("string")).alias("LEMMA"),
        F.when(vec % 13 == 0, F.lit("_")).otherwise(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("SEMCLASS"),
        F.concat(F.lit("context "), vec.cast("string")).alias("context_text"),
        F.when(vec % 17 == 0, F.lit(-1)).otherwise((F.col("label") + vec % 2) % 7).cast("bigint").alias("cluster"),
        "embedding",
    )


VECTORS = """vt AS (
  SELECT vec_id, CAST(vec_id // 10 AS BIGINT) AS sentence_index, vec_id % 10 AS token_index,
         (CASE WHEN vec_id % 3 = 0 THEN 'W' ELSE 'w' END) || (vec_id % 50) AS FORM,
         'l' || (vec_id % 20) AS LEMMA,
         CASE WHEN vec_id % 13 = 0 THEN '_' ELSE 'L' || label END AS SEMCLASS,
         'context ' || vec_id AS context_text,
         CAST(CASE WHEN vec_id % 17 = 0 THEN -1 ELSE (label + vec_id % 2) % 7 END AS BIGINT) AS cluster,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)"""
UNIT = "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))"


# --- hierarchy region > nation > customer, and orders as its labelled tokens


def market_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    region, nation, customer = (table(spark, folder, name) for name in ("region", "nation", "customer"))
    return (
        region.select(
            F.concat(F.lit("r"), "r_regionkey").alias("class_id"),
            F.lit(None).cast("string").alias("parent_id"),
            F.lit(0).alias("depth"),
            F.col("r_name").alias("class_name"),
        )
        .unionByName(
            nation.select(
                F.concat(F.lit("n"), "n_nationkey").alias("class_id"),
                F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
                F.lit(1).alias("depth"),
                F.col("n_name").alias("class_name"),
            )
        )
        .unionByName(
            customer.select(
                F.concat(F.lit("c"), "c_custkey").alias("class_id"),
                F.concat(F.lit("n"), "c_nationkey").alias("parent_id"),
                F.lit(2).alias("depth"),
                F.col("c_name").alias("class_name"),
            )
        )
    )


def order_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as labelled tokens: the customer name is the label, status and priority make the cluster."""
    name = F.when(F.col("o_custkey") % 10 == 0, F.lit("_")).otherwise(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    )
    priority = F.substring("o_orderpriority", 1, 1).cast("bigint")
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 5).otherwise(10)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        name.alias("SEMCLASS"),
        F.when(F.col("o_orderkey") % 19 == 0, F.lit(-1)).otherwise(priority + status).cast("bigint").alias("cluster"),
    )


ORDERS = """ot AS (
  SELECT o_orderkey,
         CASE WHEN o_custkey % 10 = 0 THEN '_' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS SEMCLASS,
         CAST(CASE WHEN o_orderkey % 19 = 0 THEN -1
              ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT)
                   + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 5 ELSE 10 END END AS BIGINT) AS cluster
  FROM orders)"""
HIERARCHY = """h AS (
  SELECT 'r' || r_regionkey AS class_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth, r_name AS class_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, c_name FROM customer)"""
ANCESTORS = f"""{HIERARCHY}, depths AS (SELECT unnest([0, 1, 2]) AS want), climb AS (
  SELECT c.class_name, want, c.class_id, c.parent_id, c.depth, c.class_name AS here, 0 AS step FROM h c, depths
  UNION ALL
  SELECT k.class_name, k.want, p.class_id, p.parent_id, p.depth, p.class_name, k.step + 1
  FROM climb k JOIN h p ON p.class_id = k.parent_id WHERE k.depth > k.want),
 ancestors AS (SELECT class_name, want AS depth, arg_max(here, step) AS ancestor FROM climb GROUP BY 1, 2)"""

WORDS_PATTERN_SQL = _quoted(WORD_PATTERN)
