"""Text-feature queries over the whole ``documents`` table (F1-F8).

Oracle queries use the ASCII token class, identical in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.functions import exprs as X
from catalog_engine.functions import sqltext as Q
from catalog_engine.operators import text as TX
from catalog_engine.plans.registry import register
from catalog_engine.sources.catalog import read_table

SPEC = TX.TfidfSpec(pattern=TX.ASCII_TOKEN)
TRAIN_SHARE_TEST = 0.2


def _docs(spark, d):
    return TX.spread(read_table(spark, d, "documents").select("doc_id", "text"))


def _vocabulary(docs):
    n = docs.count()
    return TX.select_vocabulary(TX.bounded_stats(docs, "text", n, SPEC), n, SPEC)


def _weights(docs, vocab):
    hits = TX.vocabulary_counts(TX.analyze(docs, "text", SPEC), "doc_id", vocab)
    return TX.tfidf_long(hits, None, "doc_id")


def _split(df, test: bool):
    t = X.is_test_row("doc_id", TRAIN_SHARE_TEST)
    return df.filter(t if test else ~t)


def _terms_sql(where: str = "") -> str:
    stop = Q.sql_list(TX.ENGLISH_STOP_WORDS)
    return f"""
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '{TX.ASCII_TOKEN}') AS toks
         FROM documents {where}),
kept AS (SELECT doc_id, toks, list_filter(toks, lambda t: NOT list_contains([{stop}], t)) AS k FROM docs),
grams AS (SELECT doc_id, toks, k,
  k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])
    || list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]) AS terms
  FROM kept)"""


def _vocab_sql(where: str = "") -> str:
    return f"""{_terms_sql(where)},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM grams)
       GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents {where}),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
top AS (SELECT dfs.* FROM dfs, nd WHERE df >= {SPEC.min_df} AND df <= {Q.dbl(SPEC.max_df)} * n
        ORDER BY cf DESC, term LIMIT {SPEC.max_features}),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, cf,
          ln(({Q.dbl(1)} + n) / ({Q.dbl(1)} + df)) + {Q.dbl(1)} AS idf FROM top, nd)"""


def _weights_sql(tf_src: str = "tf") -> str:
    return f""",
w AS (SELECT t.doc_id, t.term, v.idx, t.tf * v.idf AS w FROM {tf_src} t JOIN vocab v USING (term)),
wn AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@register("f1_f3_token_counts", f"""WITH {_terms_sql()}
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(k) AS INTEGER) AS n_kept,
       CAST(len(terms) AS INTEGER) AS n_terms FROM grams""")
def f1_f3_token_counts(spark, d):
    docs = _docs(spark, d)
    t = TX.tokenize(docs, "text", SPEC.pattern, "toks")
    k = TX.remove_stop_words(t, "toks", SPEC.stop_words, "kept")
    g = TX.with_ngrams(k, "kept", SPEC.ngram_max, "terms")
    return g.select("doc_id", F.size("toks").alias("n_tokens"), F.size("kept").alias("n_kept"),
                    F.size("terms").alias("n_terms"))


@register("f4_f5_vocabulary", f"""WITH {_vocab_sql()}
SELECT term, idx, df, CAST(cf AS BIGINT) AS cf, round_even(idf, 9) AS idf FROM vocab""")
def f4_f5_vocabulary(spark, d):
    v = _vocabulary(_docs(spark, d))
    return v.select("term", "idx", "df", "cf", F.bround("idf", 9).alias("idf"))


FULL = TX.TfidfSpec(pattern=TX.ASCII_TOKEN, max_features=None)


@register("f5_full_vocabulary", f"""WITH {_terms_sql()},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM grams) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, CAST(cf AS BIGINT) AS cf
FROM dfs, nd WHERE df >= {FULL.min_df} AND df <= {Q.dbl(FULL.max_df)} * n""")
def f5_full_vocabulary(spark, d):
    """Every term within the document-frequency bounds, numbered in order: no top-N."""
    docs = _docs(spark, d)
    n = docs.select(F.count(F.lit(1))).scalar()
    return TX.select_vocabulary(TX.term_stats(TX.analyze(docs, "text", FULL)), n, FULL).select("term", "idx", "df", "cf")


@register("f6_tfidf_relational", f"""WITH {_vocab_sql()}{_weights_sql()}
SELECT doc_id, term, idx, round_even(weight, 9) AS weight FROM wn""")
def f6_tfidf_relational(spark, d):
    docs = _docs(spark, d)
    out = _weights(docs, _vocabulary(docs))
    return out.select("doc_id", "term", "idx", F.bround("weight", 9).alias("weight"))


@register("f6_tfidf_vectors", f"""WITH {_vocab_sql()}{_weights_sql()}
SELECT doc_id, term, idx, round_even(weight, 9) AS weight FROM wn""")
def f6_tfidf_vectors(spark, d):
    docs = _docs(spark, d)
    model = TX.TfidfModel(SPEC).fit(docs, "doc_id")
    vec = model.transform(docs)
    out = TX.vector_long(vec, "tfidf", "doc_id", model.vocabulary_frame(spark))
    return out.select("doc_id", "term", "idx", F.bround("weight", 9).alias("weight"))


_TEST_WHERE = f"WHERE {Q.is_test_row('doc_id', TRAIN_SHARE_TEST, X.MULT_SPLIT)}"
_TRAIN_WHERE = f"WHERE NOT {Q.is_test_row('doc_id', TRAIN_SHARE_TEST, X.MULT_SPLIT)}"


def _apply_sql() -> str:
    test_terms = _terms_sql(_TEST_WHERE).replace("docs AS", "tdocs AS").replace(
        "FROM docs)", "FROM tdocs)").replace("kept AS", "tkept AS").replace(
        "FROM kept)", "FROM tkept)").replace("grams AS", "tgrams AS")
    return f"""WITH {_vocab_sql(_TRAIN_WHERE)}, {test_terms},
ttf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tgrams)
        GROUP BY doc_id, term){_weights_sql('ttf')}
SELECT doc_id, term, idx, round_even(weight, 9) AS weight FROM wn"""


@register("f7_tfidf_apply", _apply_sql())
def f7_tfidf_apply(spark, d):
    """Fit on the training documents, apply to the held-out ones."""
    docs = _docs(spark, d)
    train, test = _split(docs, False), _split(docs, True)
    out = _weights(test, _vocabulary(train))
    return out.select("doc_id", "term", "idx", F.bround("weight", 9).alias("weight"))


@register("f8_tfidf_slice", f"""WITH {_vocab_sql()}{_weights_sql()},
first_docs AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20)
SELECT doc_id, idx, round_even(weight, 9) AS weight FROM wn
WHERE idx < 20 AND doc_id IN (SELECT doc_id FROM first_docs)""")
def f8_tfidf_slice(spark, d):
    """The first 20 documents x first 20 vocabulary columns, non-zero cells."""
    docs = _docs(spark, d)
    first = docs.orderBy("doc_id").limit(20)  # the norm needs all terms of these documents, and no other document
    out = _weights(first, _vocabulary(docs)).filter(F.col("idx") < 20)
    return out.select("doc_id", "idx", F.bround("weight", 9).alias("weight"))
