"""Registered queries over the text tables: tokens, contexts, label statistics, collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import labels as lb
from tokenloom.functions import text as tx
from tokenloom.operators import collocate, contexts, occurrences, tokens
from tokenloom.operators import labels as label_ops
from tokenloom.plans.registry import (
    GRAMS,
    LINES,
    SENTENCE,
    TERMS,
    TOKEN,
    TOKENS,
    lines,
    query,
    rounded,
    sql_round,
    table,
    text_cluster,
    text_cluster_sql,
    text_documents,
    text_sentences,
    text_tokens,
)
from tokenloom.session import materialize


def documents_of(spark: SparkSession, folder: str, bases: tuple[str, ...] = ("lemma",), lowercase: bool = True) -> DataFrame:
    return tokens.sentence_terms(
        text_sentences(spark, folder), bases=list(bases), lowercase=lowercase, drop_empty=False
    )


@query(
    "token_flags",
    f"""WITH {TOKENS} SELECT is_punctuation, is_empty_node, is_multiword_token, has_semclass, is_surface_token,
      count(*) AS n FROM (
      SELECT NOT is_word AS is_punctuation, contains(FORM, '.') AS is_empty_node, contains(FORM, '-') AS is_multiword_token,
        lang NOT IN ('', '_') AS has_semclass, NOT contains(FORM, '.') AND NOT contains(FORM, '-') AS is_surface_token
      FROM tokens) AS f GROUP BY ALL""",
)
def token_flags(spark: SparkSession, folder: str) -> DataFrame:
    # The form stands in for the id, so that range and empty-node rows occur.
    rows = lb.with_token_flags(text_tokens(spark, folder).withColumn("ID", F.col("FORM")))
    flags = ["is_punctuation", "is_empty_node", "is_multiword_token", "has_semclass", "is_surface_token"]
    return rows.groupBy(*flags).agg(F.count("*").alias("n"))


_KEEP = {
    "default": "is_word AND NOT contains(FORM, '.') AND NOT contains(FORM, '-')",
    "with_punctuation": "NOT contains(FORM, '.') AND NOT contains(FORM, '-')",
    "with_empty": "is_word",
    "all": "true",
}


@query(
    "target_tokens",
    f"WITH {TOKENS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS policy, lang, count(*) AS n FROM tokens WHERE {rule} GROUP BY lang" for name, rule in _KEEP.items()
    ),
)
def target_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = text_tokens(spark, folder).withColumn("ID", F.col("FORM"))
    parts = []
    for policy, punctuation, empty in (
        ("default", False, False),
        ("with_punctuation", True, False),
        ("with_empty", False, True),
        ("all", True, True),
    ):
        kept = tokens.keep_tokens(rows, include_punctuation=punctuation, include_empty=empty)
        parts.append(kept.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(policy).alias("policy"), "lang", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "sentence_text",
    f"""WITH {TOKENS} SELECT doc_id, line, string_agg(FORM, ' ' ORDER BY token_index) AS sentence_text,
      coalesce(string_agg(FORM, ' ' ORDER BY token_index) FILTER (WHERE is_word), '') AS context_text
      FROM tokens GROUP BY doc_id, line""",
)
def sentence_text(spark: SparkSession, folder: str) -> DataFrame:
    sentences = text_sentences(spark, folder).filter(F.size("tokens") > 0)
    return sentences.select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        tokens.sentence_text(sentences).alias("sentence_text"),
        tokens.context_text(sentences, include_punctuation=False).alias("context_text"),
    )


@query(
    "assembled_sentences",
    f"""WITH {TOKENS} SELECT doc_id, line, count(*) AS n_tokens, string_agg(FORM, ' ' ORDER BY token_index) AS sentence_text
      FROM tokens GROUP BY doc_id, line""",
)
def assembled_sentences(spark: SparkSession, folder: str) -> DataFrame:
    # Every column given is gathered with its token, so the report gives those alone that it reads.
    grouped = tokens.assemble_sentences(text_tokens(spark, folder).select(*TOKEN, "ID", "FORM", "UPOS"), SENTENCE)
    return grouped.select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        tokens.surface_text(F.col("tokens")).alias("sentence_text"),
    )


@query(
    "valid_labels",
    """SELECT source, count(*) FILTER (WHERE coalesce(l, 'None') NOT IN ('', '_', 'nan', 'None')) AS scored,
      count(*) FILTER (WHERE coalesce(l, 'nan') NOT IN ('', '_', 'nan')) AS shown, count(*) AS n
      FROM (SELECT source, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 5 = 1 THEN 'None'
        WHEN n_chars % 7 = 2 THEN '_' WHEN n_chars % 7 = 3 THEN '' ELSE lang END AS l FROM documents) AS t GROUP BY source""",
)
def valid_labels(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("n_chars")
    label = (
        F.when(size % 5 == 1, F.lit("None")).when((size % 5 != 0) & (size % 7 == 2), F.lit("_"))
        .when((size % 5 != 0) & (size % 7 == 3), F.lit("")).when(size % 5 != 0, F.col("lang"))
    )
    return (
        table(spark, folder, "documents")
        .withColumn("label", label)
        .groupBy("source")
        .agg(
            F.count_if(lb.has_valid_label("label")).alias("scored"),
            F.count_if(lb.has_valid_text("label")).alias("shown"),
            F.count("*").alias("n"),
        )
    )


@query(
    "term_texts",
    f"WITH {TOKENS} SELECT LEMMA AS term, count(*) AS n FROM tokens WHERE FORM NOT IN ('', '_') GROUP BY LEMMA",
)
def term_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = text_tokens(spark, folder).select(lb.term_text("FORM").alias("term"))
    return rows.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


@query(
    "casefolded_forms",
    f"""WITH {TOKENS} SELECT replace(replace(lower(FORM), 'ß', 'ss'), 'ς', 'σ') AS folded, count(*) AS n,
      count(DISTINCT FORM) AS n_forms FROM tokens WHERE is_word GROUP BY 1""",
)
def casefolded_forms(spark: SparkSession, folder: str) -> DataFrame:
    counts = text_tokens(spark, folder).filter("UPOS <> 'PUNCT'").groupBy("FORM").agg(F.count("*").alias("m"))
    return counts.groupBy(tx.casefold("FORM").alias("folded")).agg(
        F.sum("m").alias("n"), F.count("*").alias("n_forms")
    )


@query(
    "raw_tokens",
    f"""WITH {TOKENS}, per_line AS (SELECT doc_id, line, count(*) AS n, count(*) FILTER (WHERE is_word) AS w,
        md5(string_agg(FORM, ' ' ORDER BY token_index)) AS digest FROM tokens GROUP BY doc_id, line)
      SELECT doc_id, line, n AS n_tokens, w AS n_words, digest FROM per_line""",
)
def raw_tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = lines(spark, folder).select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        tx.tokenize("text").alias("tokens"),
        F.size(tx.words_only("text")).cast("bigint").alias("n_words"),
    )
    return found.filter(F.size("tokens") > 0).select(
        "doc_id",
        "line",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        "n_words",
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query(
    "clean_cells",
    """SELECT doc_id, md5(CASE WHEN text = '' THEN '_' ELSE translate(text, chr(9) || chr(10) || chr(13), '   ') END) AS cell,
      coalesce(translate(source, chr(9), ' '), '') AS name, CASE WHEN lang IN ('', '_', 'nan') THEN '' ELSE lang END AS header
      FROM documents""",
)
def clean_cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(tx.clean_cell("text")).alias("cell"),
        tx.clean_name("source").alias("name"),
        tx.clean_optional("lang").alias("header"),
    )


@query(
    "term_documents",
    f"""WITH {TERMS} SELECT doc_id, line, count(*) AS n_terms, md5(string_agg(LEMMA, ' ' ORDER BY token_index)) AS digest
      FROM terms GROUP BY doc_id, line""",
)
def term_documents(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.sentence_terms(text_sentences(spark, folder)).select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("terms", " ")).alias("digest"),
    )


def _chunk_sql(unit: str, key: str, max_tokens: int, max_words: int) -> str:
    """Chunk starts by recursion over ``unit(key…, p, word, FORM)``: the next start is the earlier of both limits."""
    keys = [name.strip() for name in key.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{name} = {b}.{name}" for name in keys)
    select = lambda a: ", ".join(f"{a}.{name}" for name in keys)
    return f"""ranked AS (
  SELECT *, sum(word) OVER (PARTITION BY {key} ORDER BY p ROWS UNBOUNDED PRECEDING) - word AS before,
         count(*) OVER (PARTITION BY {key}) AS size FROM {unit}),
 word_at AS (SELECT {key}, before AS nth, p AS word_p FROM ranked WHERE word = 1),
 starts AS (
  SELECT {key}, p, before, size, 0 AS step FROM ranked WHERE p = 0
  UNION ALL
  SELECT {select('r')}, r.p, r.before, r.size, s.step + 1
  FROM starts s LEFT JOIN word_at w ON {on('w', 's')} AND w.nth = s.before + {max_words}
  JOIN ranked r ON {on('r', 's')} AND r.p = least(s.p + {max_tokens}, coalesce(w.word_p, s.size))),
 spans AS (SELECT {key}, p AS lo, coalesce(lead(p) OVER (PARTITION BY {key} ORDER BY p), size) AS hi, step FROM starts),
 chunks AS (
  SELECT {select('s')}, s.step, count(*) AS n_tokens, sum(r.word) AS n_targets, min(r.before) AS words_before,
         string_agg(r.FORM, ' ' ORDER BY r.p) AS tokens
  FROM spans s JOIN ranked r ON {on('r', 's')} AND r.p >= s.lo AND r.p < s.hi GROUP BY {select('s')}, s.step)"""


_DOC_UNITS = f"""{LINES.replace('lines AS', 'unused_lines AS')}, flat AS (
  SELECT doc_id, unnest(list) AS FORM, generate_subscripts(list, 1) - 1 AS p
  FROM (SELECT doc_id, regexp_extract_all(text, {{pattern}}) AS list FROM documents) AS d), units AS (
  SELECT doc_id AS document_index, p, FORM,
         CASE WHEN regexp_matches(FORM, '[\\p{{{{L}}}}\\p{{{{N}}}}]') THEN 1 ELSE 0 END AS word FROM flat)"""


def _units_sql() -> str:
    from tokenloom.plans.registry import _quoted

    return _DOC_UNITS.replace("{pattern}", _quoted(tx.TOKEN_PATTERN)).replace("{{", "{").replace("}}", "}")


_CHUNKS = f"WITH RECURSIVE {_units_sql()}, {_chunk_sql('units', 'document_index', 192, 128)}"
_CHUNK_ROWS = f"""{_CHUNKS} SELECT document_index, CAST(step AS BIGINT) AS chunk_index, n_tokens,
  CAST(n_targets AS BIGINT) AS n_targets, md5(tokens) AS digest FROM chunks WHERE n_targets > 0"""


def _chunk_report(found: DataFrame) -> DataFrame:
    return found.select(
        "document_index",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size("target_indices").cast("bigint").alias("n_targets"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query("text_chunks", _CHUNK_ROWS)
def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_report(contexts.chunk_raw_text(text_documents(spark, folder), document_index="doc_id"))


_SENTENCE_CHUNKS = f"""WITH RECURSIVE {TOKENS}, units AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY token_index) - 1 AS p, FORM,
         CASE WHEN is_word THEN 1 ELSE 0 END AS word FROM tokens),
 numbers AS (SELECT doc_id, line, row_number() OVER (ORDER BY doc_id, line) - 1 AS document_index
             FROM (SELECT DISTINCT doc_id, line FROM units) AS d), {_chunk_sql('units', 'doc_id, line', 16, 10)}
 SELECT document_index, row_number() OVER (ORDER BY document_index, step) - 1 AS chunk_index, n_tokens,
   CAST(n_targets AS BIGINT) AS n_targets, md5(tokens) AS digest
 FROM chunks JOIN numbers USING (doc_id, line) WHERE n_targets > 0"""


@query("sentence_chunks", _SENTENCE_CHUNKS)
def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = contexts.chunk_sentences(
        text_sentences(spark, folder), order=SENTENCE, max_context_tokens=16, max_context_word_tokens=10
    )
    return _chunk_report(found)


@query(
    "target_budget",
    f"""{_CHUNKS}, kept AS (
      SELECT document_index, step, n_targets, tokens,
        sum(n_targets) OVER (ORDER BY document_index, step ROWS UNBOUNDED PRECEDING) - n_targets AS before FROM chunks WHERE n_targets > 0),
     budget AS (SELECT sum(n_targets) // 2 + 1 AS b FROM kept)
     SELECT document_index, CAST(step AS BIGINT) AS chunk_index, CAST(least(n_targets, b - before) AS BIGINT) AS n_targets
     FROM kept, budget WHERE before < b""",
)
def target_budget(spark: SparkSession, folder: str) -> DataFrame:
    found = contexts.chunk_raw_text(text_documents(spark, folder), document_index="doc_id")
    total = found.agg(F.sum(F.size("target_indices"))).first()[0]
    kept = contexts.take_target_budget(found, total // 2 + 1)
    return _chunk_report(kept).select("document_index", "chunk_index", "n_targets")


@query(
    "first_documents",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n
       FROM documents) AS t WHERE r <= n // 3 + 1""",
)
def first_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    return contexts.first_documents(documents, ["doc_id"], documents.count() // 3 + 1)


# A part number and the room used in it fold into one number: the words hold fewer than 10,000 pieces each.
@query(
    "piece_safe_chunks",
    f"""{_CHUNKS}, words AS (SELECT document_index, step, n_targets, string_split(tokens, ' ') AS w FROM chunks WHERE n_targets > 0),
      room AS (SELECT greatest(66, max(list_max(list_transform(w, lambda x: length(x))))) - 2 AS room FROM words)
      SELECT document_index, CAST(step AS BIGINT) AS chunk_index,
        CAST(len(list_distinct(list_filter(list_transform(list_zip(w, folded[2:]),
          lambda z: CASE WHEN regexp_matches(z[1], '[\\p{{L}}\\p{{N}}]') THEN z[2] // 10000 END), lambda part: part IS NOT NULL))) AS BIGINT) AS n_parts,
        CAST(n_targets AS BIGINT) AS n_targets
      FROM (SELECT *, list_reduce(list_transform(w, lambda x: (length(x) + 3) // 4), lambda held, x: list_append(held,
        CASE WHEN held[-1] % 10000 + x > room THEN (held[-1] // 10000 + 1) * 10000 + x ELSE held[-1] + x END), [0]) AS folded
        FROM words, room) AS f""",
)
def piece_safe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = contexts.chunk_raw_text(text_documents(spark, folder), document_index="doc_id")
    longest = found.agg(F.max(F.array_max(F.transform("tokens", F.length)))).first()[0]
    pieces = lambda words: [-(-len(word) // 4) for word in words]
    split = contexts.split_by_pieces(found, pieces, max_length=max(66, longest), special_tokens=2)
    return split.groupBy("document_index", "chunk_index").agg(
        F.count("*").alias("n_parts"), F.sum(F.size("target_indices")).alias("n_targets")
    )


@query(
    "corpus_counts",
    f"""WITH {TOKENS} SELECT count(DISTINCT (doc_id, line)) AS sentence_count, count(*) AS token_row_count,
      count(*) FILTER (WHERE is_word) AS target_count FROM tokens""",
)
def corpus_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.corpus_counts(text_tokens(spark, folder), SENTENCE)


# --- label statistics


@query("label_frequencies", f"WITH {TOKENS} SELECT lang AS semclass, count(*) AS token_count FROM tokens WHERE is_word GROUP BY lang")
def label_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return label_ops.label_counts(tokens.keep_tokens(text_tokens(spark, folder)), order=TOKEN)


_THRESHOLDS = """SELECT CAST(t AS INTEGER) AS minimum_occurrences,
  CASE WHEN t = 1 THEN 'semantic classes observed at least 1 time'
       ELSE 'semantic classes present at least ' || t || ' times' END AS description,
  count(n) AS semclass_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS labeled_token_count,
  CAST((SELECT count(DISTINCT source) FROM documents) AS INTEGER) AS existing_semclass_count
 FROM range(1, 16) AS r(t) LEFT JOIN counts ON n >= t GROUP BY t"""


@query(
    "label_thresholds",
    f"WITH {TERMS}, counts AS (SELECT LEMMA, count(*) AS n FROM terms GROUP BY LEMMA) {_THRESHOLDS}",
)
def label_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    # The lemma stands in for the label, so that rare labels occur.
    rows = tokens.keep_tokens(text_tokens(spark, folder)).withColumn("SEMCLASS", F.col("LEMMA"))
    existing = table(spark, folder, "documents").select("source").distinct().count()
    return label_ops.threshold_table(label_ops.label_counts(rows), existing_semclass_count=existing)


@query(
    "value_count_texts",
    f"""WITH {TERMS}, counts AS (SELECT lang, LEMMA, count(*) AS n, min((doc_id, line, token_index)) AS f FROM terms GROUP BY ALL),
      top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS r FROM counts)
      SELECT lang, string_agg(LEMMA || ': ' || n, chr(10) ORDER BY r) AS top_lemmas FROM top WHERE r <= 8 GROUP BY lang""",
)
def value_count_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.keep_tokens(text_tokens(spark, folder))
    return label_ops.value_counts_text(rows, ["lang"], "LEMMA", order=TOKEN, name="top_lemmas", top_n=8)


# --- collocations


_SETS = f"""{GRAMS}, n AS (SELECT count(*) AS total FROM terms),
 u AS (SELECT LEMMA AS w, count(*) AS c FROM terms GROUP BY 1),
 b AS (SELECT w1, w2, count(*) AS c FROM grams WHERE w2 IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT w1, w3, count(*) AS c FROM grams WHERE w3 IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT w1, w2, w3, count(*) AS c FROM grams WHERE w3 IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "gram_counts",
    f"""WITH {_SETS} SELECT '1' AS kind, w AS w1, NULL AS w2, NULL AS w3, c AS n FROM u
      UNION ALL SELECT '2', w1, w2, NULL, c FROM b UNION ALL SELECT 's', w1, NULL, w3, c FROM s
      UNION ALL SELECT '3', w1, w2, w3, c FROM t""",
)
def gram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return collocate.gram_counts(documents_of(spark, folder))


_DIGITS = {"raw_freq": 9, "pmi": 6, "likelihood_ratio": 3, "student_t": 6, "chi_sq": 3}


def _bigram_sql(basis: str = "") -> str:
    return f"""SELECT {basis} CAST(2 AS INTEGER) AS ngram_size, w1 || ' ' || w2 AS ngram, c AS frequency,
  {sql_round('f / n', 9)} AS raw_freq, {sql_round('log2(f * n) - log2(c1 * c2)', 6)} AS pmi,
  {sql_round("2 * (ii * ln(ii / (c1 * c2 / n + 1e-20) + 1e-20) + io * ln(io / (c1 * (n - c2) / n + 1e-20) + 1e-20)"
             " + oi * ln(oi / ((n - c1) * c2 / n + 1e-20) + 1e-20) + oo * ln(oo / ((n - c1) * (n - c2) / n + 1e-20) + 1e-20))", 3)} AS likelihood_ratio,
  {sql_round('(f - c1 * c2 / n) / sqrt(f + 1e-20)', 6)} AS student_t,
  {sql_round('n * (ii * oo - io * oi) * (ii * oo - io * oi) / ((ii + io) * (ii + oi) * (io + oo) * (oi + oo))', 3)} AS chi_sq
 FROM (SELECT b.w1, b.w2, b.c, CAST(b.c AS DOUBLE) AS f, CAST(total AS DOUBLE) AS n, CAST(x.c AS DOUBLE) AS c1, CAST(y.c AS DOUBLE) AS c2,
    CAST(b.c AS DOUBLE) AS ii, CAST(x.c - b.c AS DOUBLE) AS io, CAST(y.c - b.c AS DOUBLE) AS oi,
    CAST(total - x.c - y.c + b.c AS DOUBLE) AS oo
  FROM b, n, u AS x, u AS y WHERE b.c >= {{floor}} AND x.w = b.w1 AND y.w = b.w2) AS q"""


def _trigram_sql() -> str:
    cells = {
        "iii": ("f", "c1 * c2 * c3"),
        "iio": ("c12 - f", "c1 * c2 * (n - c3)"),
        "ioi": ("c13 - f", "c1 * (n - c2) * c3"),
        "oii": ("c23 - f", "(n - c1) * c2 * c3"),
        "ioo": ("c1 - c12 - c13 + f", "c1 * (n - c2) * (n - c3)"),
        "oio": ("c2 - c12 - c23 + f", "(n - c1) * c2 * (n - c3)"),
        "ooi": ("c3 - c13 - c23 + f", "(n - c1) * (n - c2) * c3"),
        "ooo": ("n - c1 - c2 - c3 + c12 + c13 + c23 - f", "(n - c1) * (n - c2) * (n - c3)"),
    }
    likelihood = " + ".join(f"({seen}) * ln(({seen}) / ({due} / (n * n) + 1e-20) + 1e-20)" for seen, due in cells.values())
    chi = " + ".join(
        f"(({seen}) - {due} / (n * n)) * (({seen}) - {due} / (n * n)) / ({due} / (n * n) + 1e-20)" for seen, due in cells.values()
    )
    return f"""SELECT CAST(3 AS INTEGER) AS ngram_size, w1 || ' ' || w2 || ' ' || w3 AS ngram, c AS frequency,
  {sql_round('f / n', 9)} AS raw_freq, {sql_round('log2(f * (n * n)) - log2(c1 * c2 * c3)', 6)} AS pmi,
  {sql_round(f'2 * ({likelihood})', 3)} AS likelihood_ratio,
  {sql_round('(f - c1 * c2 * c3 / (n * n)) / sqrt(f + 1e-20)', 6)} AS student_t, {sql_round(chi, 3)} AS chi_sq
 FROM (SELECT t.w1, t.w2, t.w3, t.c, CAST(t.c AS DOUBLE) AS f, CAST(total AS DOUBLE) AS n,
    CAST(x.c AS DOUBLE) AS c1, CAST(y.c AS DOUBLE) AS c2, CAST(z.c AS DOUBLE) AS c3,
    CAST(p.c AS DOUBLE) AS c12, CAST(q.c AS DOUBLE) AS c23, CAST(r.c AS DOUBLE) AS c13
  FROM t, n, u AS x, u AS y, u AS z, b AS p, b AS q, s AS r
  WHERE t.c >= {{floor}} AND x.w = t.w1 AND y.w = t.w2 AND z.w = t.w3 AND p.w1 = t.w1 AND p.w2 = t.w2
    AND q.w1 = t.w2 AND q.w2 = t.w3 AND r.w1 = t.w1 AND r.w3 = t.w3) AS q"""


def _scored(found: DataFrame) -> DataFrame:
    return found.select(
        *[name for name in ("table_name", "token_basis") if name in found.columns],
        "ngram_size",
        "ngram",
        "frequency",
        *[rounded(name, digits).alias(name) for name, digits in _DIGITS.items()],
    )


@query("collocation_bigrams", f"WITH {_SETS} {_bigram_sql().format(floor=3)}")
def collocation_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(collocate.collocation_table(documents_of(spark, folder), ngram_size=2))


@query("collocation_trigrams", f"WITH {_SETS} {_trigram_sql().format(floor=3)}")
def collocation_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(collocate.collocation_table(documents_of(spark, folder), ngram_size=3, sort_by="likelihood_ratio"))


@query(
    "collocation_top_frequency",
    f"WITH {_SETS} SELECT w1 || ' ' || w2 AS ngram, c AS frequency FROM b WHERE c >= 3 ORDER BY c DESC, ngram LIMIT 50",
)
def collocation_top_frequency(spark: SparkSession, folder: str) -> DataFrame:
    top = collocate.collocation_table(documents_of(spark, folder), ngram_size=2, sort_by="frequency", max_rows=50)
    return top.select("ngram", "frequency")


def _both_bases() -> str:
    per_form = GRAMS.replace("LEMMA AS w1", "FORM AS w1").replace("lead(LEMMA", "lead(FORM")
    form = f"""WITH {per_form}, n AS (SELECT count(*) AS total FROM terms),
 u AS (SELECT FORM AS w, count(*) AS c FROM terms GROUP BY 1),
 b AS (SELECT w1, w2, count(*) AS c FROM grams WHERE w2 IS NOT NULL GROUP BY 1, 2)
 {_bigram_sql("'form_bigrams' AS table_name,").format(floor=5)}"""
    lemma = f"WITH {_SETS} {_bigram_sql(chr(39) + 'lemma_bigrams' + chr(39) + ' AS table_name,').format(floor=5)}"
    lemma3 = f"WITH {_SETS} SELECT 'lemma_trigrams' AS table_name, * FROM ({_trigram_sql().format(floor=5)}) AS x"
    form3 = lemma3.replace("LEMMA AS w1", "FORM AS w1").replace("lead(LEMMA", "lead(FORM").replace(
        "SELECT LEMMA AS w,", "SELECT FORM AS w,").replace("lemma_trigrams", "form_trigrams")
    return " UNION ALL ".join(f"SELECT * FROM ({part}) AS p{i}" for i, part in enumerate((form, lemma, form3, lemma3)))


@query("collocation_tables", _both_bases())
def collocation_tables(spark: SparkSession, folder: str) -> DataFrame:
    documents = documents_of(spark, folder, ("lemma", "form"), lowercase=False)
    return _scored(collocate.collocation_tables(documents, min_freq=5)).drop("token_basis")


def _metadata_sql() -> str:
    return f"""WITH {_SETS} SELECT * FROM (
 SELECT 'min_freq' AS key, '5' AS value UNION ALL
 SELECT 'sentence_count', CAST(count(*) AS VARCHAR) FROM lines UNION ALL
 SELECT 'lemma_token_count', CAST(count(*) AS VARCHAR) FROM terms UNION ALL
 SELECT 'lemma_bigrams_rows', CAST(count(*) AS VARCHAR) FROM b WHERE c >= 5 UNION ALL
 SELECT 'lemma_trigrams_rows', CAST(count(*) AS VARCHAR) FROM t WHERE c >= 5) AS m"""


@query("collocation_metadata", _metadata_sql())
def collocation_metadata(spark: SparkSession, folder: str) -> DataFrame:
    sentences = text_sentences(spark, folder)
    documents = documents_of(spark, folder)
    found = collocate.collocation_tables(documents, token_bases=("lemma",), min_freq=5)
    return collocate.collocation_metadata(sentences, documents, found, {"min_freq": 5})


FLOOR = 8
_CHOSEN = f"""{_SETS}, scored AS (
  SELECT 2 AS size, w1 || ' ' || w2 AS ngram, w1, w2, CAST(NULL AS VARCHAR) AS w3, c FROM b WHERE c >= {FLOOR}
  UNION ALL SELECT 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, c FROM t WHERE c >= {FLOOR}),
 inside AS (SELECT w1 || ' ' || w2 AS ngram FROM scored WHERE size = 3 UNION SELECT w2 || ' ' || w3 FROM scored WHERE size = 3),
 placed AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY c DESC, ngram) AS source_rank FROM scored),
 chosen AS (SELECT * FROM placed WHERE size = 3 OR ngram NOT IN (SELECT ngram FROM inside))"""


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = documents_of(spark, folder)
    found = materialize(
        collocate.collocation_tables(documents, token_bases=("lemma",), min_freq=FLOOR, sort_by="frequency"), "tables"
    )
    return documents, found, collocate.select_for_clusters(found, sort_by="frequency")


@query(
    "cluster_collocations",
    f"""WITH {_CHOSEN} SELECT CAST(size AS INTEGER) AS ngram_size, ngram, c AS frequency,
      CASE size WHEN 2 THEN 'lemma_bigrams' ELSE 'lemma_trigrams' END AS source_sheet, source_rank FROM chosen""",
)
def cluster_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)[2].select("ngram_size", "ngram", "frequency", "source_sheet", "source_rank")


def _runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("run_1",), ("run_2",)], "run_id string")


def _found(documents: DataFrame, found: DataFrame) -> DataFrame:
    # The reports need the places of the tokens only; whole token structs would travel with every occurrence.
    places = occurrences.token_places(documents, SENTENCE)
    return occurrences.occurrences(places, found, sentence_key=SENTENCE, selected_rows=found.count())


_OCCURRENCES = f"""{_CHOSEN}, occ AS (
  SELECT 2 AS size, g.w1 || ' ' || g.w2 AS ngram, doc_id, line, token_index AS k1, t2 AS k2, CAST(NULL AS BIGINT) AS k3
  FROM grams g JOIN (SELECT w1, w2 FROM scored WHERE size = 2) AS x ON g.w1 = x.w1 AND g.w2 = x.w2
  UNION ALL
  SELECT 3, g.w1 || ' ' || g.w2 || ' ' || g.w3, doc_id, line, token_index, t2, t3
  FROM grams g JOIN (SELECT w1, w2, w3 FROM scored WHERE size = 3) AS x ON g.w1 = x.w1 AND g.w2 = x.w2 AND g.w3 = x.w3)"""


@query(
    "collocation_occurrences",
    f"""WITH {_OCCURRENCES} SELECT CAST(size AS INTEGER) AS ngram_size, ngram, doc_id, line, k1 AS start,
      k1 || ',' || k2 || coalesce(',' || k3, '') AS places FROM occ""",
)
def collocation_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _found(*_tables(spark, folder)[:2])
    places = F.array_join(F.transform("part_tokens", lambda token: token["token_index"].cast("string")), ",")
    return rows.select(
        "ngram_size",
        "ngram",
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        F.col("start").cast("bigint").alias("start"),
        places.alias("places"),
    )


@query(
    "occurrence_index",
    f"WITH {_OCCURRENCES} SELECT CAST(size AS INTEGER) AS ngram_size, ngram, count(*) AS n_occurrences FROM occ GROUP BY ALL",
)
def occurrence_index(spark: SparkSession, folder: str) -> DataFrame:
    index = occurrences.occurrence_index(materialize(_found(*_tables(spark, folder)[:2]), "occurrences"), segment=64)
    return index.groupBy("ngram_size", "ngram").agg(F.sum(F.size("occurrence_ids")).alias("n_occurrences"))


def annotated_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Word tokens of the documents with the clusters of two runs."""
    words = tokens.keep_tokens(text_tokens(spark, folder)).drop("ID", "UPOS", "source", "lang")
    run = lambda number: F.struct(
        F.lit(f"run_{number}").alias("run_id"),
        text_cluster(number).alias("cluster"),
        F.concat(F.lit("cluster_"), text_cluster(number).cast("string")).alias("AUTO_SEMCLASS"),
    )
    return words.select("*", F.inline(F.array(run(1), run(2))))


def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The annotated runs as a stored artifact, for reports that read them several times."""
    return materialize(annotated_runs(spark, folder), "annotated")


_ANNOTATED = "annotated AS (" + " UNION ALL ".join(
    f"SELECT 'run_{run}' AS run_id, doc_id, line, token_index, FORM, LEMMA, lang AS SEMCLASS, {text_cluster_sql(run)} AS cluster FROM terms"
    for run in (1, 2)
) + ")"
_TERM_TABLES = f"""{_ANNOTATED},
 tc AS (SELECT run_id, LEMMA AS term, cluster, count(*) AS n FROM annotated GROUP BY ALL),
 tl AS (SELECT run_id, LEMMA AS term, SEMCLASS AS value, count(*) AS n, min((doc_id, line, token_index)) AS f FROM annotated GROUP BY ALL)"""


@query("term_cluster_counts", f"WITH {TERMS}, {_TERM_TABLES} SELECT run_id, term, cluster, n FROM tc")
def term_cluster_counts(spark: SparkSession, folder: str) -> DataFrame:
    return occurrences.term_cluster_counts(annotated_runs(spark, folder), by=["run_id"])


@query("term_label_counts", f"WITH {TERMS}, {_TERM_TABLES} SELECT run_id, term, value, n FROM tl")
def term_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = occurrences.term_label_counts(annotated_runs(spark, folder), by=["run_id"], order=TOKEN)
    return counts.select("run_id", "term", "value", F.col("count").alias("n"))


_INSIDE = f"""{_TERM_TABLES},
 part_rows AS (SELECT size, ngram, doc_id, line, k1, part, CASE part WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END AS k
   FROM occ, (SELECT unnest([1, 2, 3]) AS part) AS p WHERE part <= size),
 matched AS (SELECT run_id, size, ngram, q.doc_id, q.line, q.k1, part, SEMCLASS, cluster, q.k
   FROM part_rows q JOIN annotated a ON a.doc_id = q.doc_id AND a.line = q.line AND a.token_index = q.k),
 inside_labels AS (SELECT run_id, size, ngram, part, SEMCLASS AS value, count(*) AS n, min((doc_id, line, k)) AS f
   FROM matched GROUP BY ALL)"""


def _matched(spark: SparkSession, folder: str, unmatched: bool = True) -> DataFrame:
    rows = _found(*_tables(spark, folder)[:2])
    return occurrences.matched_parts(
        rows, annotated_runs(spark, folder), sentence_key=SENTENCE, by=["run_id"], runs=_runs(spark), unmatched=unmatched
    )


@query(
    "inside_label_counts",
    f"WITH {_OCCURRENCES}, {_INSIDE} SELECT run_id, ngram, CAST(part AS INTEGER) AS part, value, n FROM inside_labels",
)
def inside_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = occurrences.inside_label_counts(_matched(spark, folder, unmatched=False), by=["run_id"], order=TOKEN)
    return counts.select("run_id", "ngram", "part", "value", F.col("count").alias("n"))


_CLUSTER_TABLE = f"""{_OCCURRENCES}, {_INSIDE},
 all_labels AS (SELECT run_id, term, string_agg(value, ', ' ORDER BY n DESC, f) AS txt FROM tl GROUP BY ALL),
 best AS (SELECT run_id, ngram, part, value FROM (
   SELECT *, row_number() OVER (PARTITION BY run_id, size, ngram, part ORDER BY n DESC, f) AS r FROM inside_labels) AS z WHERE r = 1),
 sets AS (SELECT run_id, term, list(cluster) AS cs FROM tc GROUP BY ALL),
 parts AS (SELECT run_id, size, ngram, c, part, CASE part WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS term
   FROM chosen, (SELECT unnest([1, 2, 3]) AS part) AS p, (SELECT DISTINCT run_id FROM annotated) AS r WHERE part <= size),
 described AS (SELECT p.*, cs, 'dominant in collocation: ' || b.value || chr(10) || 'all: ' || a.txt AS labels
   FROM parts p JOIN sets USING (run_id, term) JOIN all_labels a USING (run_id, term) JOIN best b USING (run_id, ngram, part)),
 gathered AS (SELECT run_id, size, ngram, c, string_agg(term || ': ' || len(cs), chr(10) ORDER BY part) AS cluster_counts,
   max(cs) FILTER (WHERE part = 1) AS s1, max(cs) FILTER (WHERE part = 2) AS s2, max(cs) FILTER (WHERE part = 3) AS s3,
   max(term) FILTER (WHERE part = 1) AS p1, max(term) FILTER (WHERE part = 2) AS p2, max(term) FILTER (WHERE part = 3) AS p3,
   max(labels) FILTER (WHERE part = 1) AS l1, max(labels) FILTER (WHERE part = 2) AS l2, max(labels) FILTER (WHERE part = 3) AS l3
   FROM described GROUP BY ALL)"""


@query(
    "collocation_cluster_table",
    f"""WITH {_CLUSTER_TABLE} SELECT run_id, ngram AS collocation, c AS frequency, p1 AS part_1, l1 AS part_1_semclasses,
      p2 AS part_2, l2 AS part_2_semclasses, coalesce(p3, '') AS part_3, coalesce(l3, '') AS part_3_semclasses, cluster_counts,
      CAST(CASE size WHEN 2 THEN len(list_intersect(s1, s2)) ELSE len(list_intersect(list_intersect(s1, s2), s3)) END AS INTEGER)
        AS intersecting_cluster_count FROM gathered""",
)
def collocation_cluster_table(spark: SparkSession, folder: str) -> DataFrame:
    documents, found, chosen = _tables(spark, folder)
    rows = _found(documents, found)
    report = occurrences.collocation_cluster_table(
        chosen,
        rows,
        stored_runs(spark, folder),
        sentence_key=SENTENCE,
        by=["run_id"],
        order=TOKEN,
        runs=_runs(spark),
    )
    return report.select("run_id", *occurrences.TABLE_COLUMNS)


@query(
    "exact_cluster_metrics",
    f"""WITH {_OCCURRENCES}, {_INSIDE}, per AS (
      SELECT run_id, size, ngram, doc_id, line, k1, count(*) AS m, min(cluster) = max(cluster) AS one,
        max(cluster) FILTER (WHERE part = 1) AS a, max(cluster) FILTER (WHERE part = 2) AS b, max(cluster) FILTER (WHERE part = 3) AS c
      FROM matched GROUP BY ALL)
     SELECT run_id, ngram, count(*) AS exact_occurrence_count, count(*) FILTER (WHERE one) AS exact_all_parts_same_cluster_count,
       CAST(sum((a = b)::INT + coalesce((a = c)::INT, 0) + coalesce((b = c)::INT, 0)) AS BIGINT) AS exact_same_cluster_pair_count,
       {sql_round("sum((a = b)::INT + coalesce((a = c)::INT, 0) + coalesce((b = c)::INT, 0)) / sum(CASE size WHEN 2 THEN 1.0 ELSE 3.0 END)")}
         AS exact_same_cluster_pair_rate
     FROM per GROUP BY ALL""",
)
def exact_cluster_metrics(spark: SparkSession, folder: str) -> DataFrame:
    matches = occurrences.occurrence_matches(_matched(spark, folder), sentence_key=SENTENCE, by=["run_id"], carried=())
    return occurrences.exact_metrics(matches, by=["run_id"]).select(
        "run_id",
        "ngram",
        "exact_occurrence_count",
        "exact_all_parts_same_cluster_count",
        "exact_same_cluster_pair_count",
        rounded("exact_same_cluster_pair_rate").alias("exact_same_cluster_pair_rate"),
    )


@query(
    "marginal_cluster_metrics",
    f"""WITH {_CHOSEN}, {_TERM_TABLES}, pc AS (
      SELECT run_id, ngram, size, part, cluster, n FROM (SELECT ngram, size, part, CASE part WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS term
        FROM chosen, (SELECT unnest([1, 2, 3]) AS part) AS p WHERE part <= size) AS x JOIN tc USING (term)),
     per AS (SELECT run_id, ngram, size, cluster, coalesce(max(n) FILTER (WHERE part = 1), 0)::DOUBLE AS a,
       coalesce(max(n) FILTER (WHERE part = 2), 0)::DOUBLE AS b, coalesce(max(n) FILTER (WHERE part = 3), 0)::DOUBLE AS c FROM pc GROUP BY ALL)
     SELECT run_id, ngram, sum(a) * sum(b) AS pair_total_1_2, sum(a * b) AS same_1_2,
       {sql_round('sum(a * b) / (sum(a) * sum(b))')} AS pair_rate_1_2,
       sum(CASE size WHEN 2 THEN a * b ELSE a * b * c END) AS all_parts_same_count,
       count(*) FILTER (WHERE a > 0 AND b > 0 AND (size = 2 OR c > 0)) AS shared_cluster_count FROM per GROUP BY ALL""",
)
def marginal_cluster_metrics(spark: SparkSession, folder: str) -> DataFrame:
    chosen = _tables(spark, folder)[2]
    clusters = occurrences.term_cluster_counts(annotated_runs(spark, folder), by=["run_id"])
    return occurrences.marginal_metrics(chosen, clusters, by=["run_id"]).select(
        "run_id",
        "ngram",
        F.col("pair_total_1_2").cast("double").alias("pair_total_1_2"),
        F.col("same_1_2").cast("double").alias("same_1_2"),
        rounded("pair_rate_1_2").alias("pair_rate_1_2"),
        F.col("all_parts_same_count").cast("double").alias("all_parts_same_count"),
        "shared_cluster_count",
    )


@query(
    "shared_cluster_texts",
    f"""WITH {_CHOSEN}, {_TERM_TABLES}, pc AS (
      SELECT run_id, ngram, size, part, cluster, n FROM (SELECT ngram, size, part, CASE part WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS term
        FROM chosen, (SELECT unnest([1, 2, 3]) AS part) AS p WHERE part <= size) AS x JOIN tc USING (term)),
     per AS (SELECT run_id, ngram, cluster, CAST(round(product(n)) AS BIGINT) AS tuples, string_agg(n, ',' ORDER BY part) AS counts
       FROM pc GROUP BY run_id, ngram, size, cluster HAVING count(*) = size),
     top AS (SELECT *, row_number() OVER (PARTITION BY run_id, ngram ORDER BY tuples DESC, cluster DESC) AS r FROM per)
     SELECT run_id, ngram, string_agg(cluster || ':cluster_' || cluster || ': counts=' || counts || ' tuples=' || tuples, chr(10) ORDER BY r)
       AS shared_clusters FROM top WHERE r <= 12 GROUP BY run_id, ngram""",
)
def shared_cluster_texts(spark: SparkSession, folder: str) -> DataFrame:
    annotated = stored_runs(spark, folder)
    return occurrences.shared_cluster_text(
        _tables(spark, folder)[2],
        occurrences.term_cluster_counts(annotated, by=["run_id"]),
        occurrences.cluster_names(annotated, by=["run_id"], order=TOKEN),
        by=["run_id"],
    ).select("run_id", "ngram", "shared_clusters")


@query(
    "part_statistics",
    f"""WITH {_CHOSEN}, {_TERM_TABLES},
     cl AS (SELECT run_id, LEMMA AS term, cluster, count(*) AS n, min((doc_id, line, token_index)) AS f FROM annotated GROUP BY ALL),
     totals AS (SELECT run_id, term, CAST(sum(n) AS BIGINT) AS token_count, count(*) AS cluster_count FROM cl GROUP BY ALL),
     top AS (SELECT *, row_number() OVER (PARTITION BY run_id, term ORDER BY n DESC, f) AS r FROM cl),
     texts AS (SELECT run_id, term, string_agg(cluster || ': ' || n, chr(10) ORDER BY r) AS clusters FROM top WHERE r <= 12 GROUP BY ALL),
     lab AS (SELECT run_id, term, arg_max(value, n) AS v, string_agg(value || ': ' || n, chr(10) ORDER BY n DESC, f) AS semclasses FROM tl GROUP BY ALL),
     parts AS (SELECT ngram, part, CASE part WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS term
       FROM chosen, (SELECT unnest([1, 2, 3]) AS part) AS p WHERE part <= size)
     SELECT run_id, ngram, CAST(part AS INTEGER) AS part, term, token_count, cluster_count, clusters, semclasses
     FROM parts JOIN totals USING (term) JOIN texts USING (run_id, term) JOIN lab USING (run_id, term)""",
)
def part_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = occurrences.part_statistics(
        _tables(spark, folder)[2], stored_runs(spark, folder), by=["run_id"], order=TOKEN
    )
    return found.select("run_id", "ngram", "part", "term", "token_count", "cluster_count", "clusters", "semclasses")


