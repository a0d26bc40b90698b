"""The functions that a session can use from SQL."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..operators import text


#: Functions whose rule SQL can say, as parameters, type and body: Spark puts the body in place of the call, so it stays in the JVM.
SQL_FUNCTIONS = {
    "bare_doi": ("doi STRING", "STRING", r"regexp_replace(trim(doi), '(?i)^https?://(dx[.])?doi[.]org/', '')"),
    "first_year": ("raw STRING", "INT", "try_cast(nullif(regexp_extract(raw, '(1[89][0-9]{2}|20[0-9]{2})', 1), '') AS INT)"),
    "hyphenated_issn": ("raw STRING", "STRING", "CASE WHEN upper(regexp_replace(raw, '[^0-9Xx]', '')) RLIKE '^[0-9]{7}[0-9X]$' THEN regexp_replace(upper(regexp_replace(raw, '[^0-9Xx]', '')), '^(.{4})', '$1-') END"),
    "lexical_tokens": ("value STRING", "ARRAY<STRING>", "array_remove(split(lower(value), '[ \\n\\t\\r]+'), '')"),
    "vector_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Install the functions of SQL_FUNCTIONS; clean_term, title_similarity, repaired_markup, keyword_key (Arrow); and the table function split_terms."""
    def clean(s: pd.Series) -> pd.Series:
        return s.map(text.clean_term_py)

    def repaired(s: pd.Series) -> pd.Series:
        return s.map(text.repaired_py)

    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([text.title_ratio(x, y) for x, y in zip(a, b)])

    def key(name: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or k is None else f"{k}:{text.words_casefold_py(n)}" for n, k in zip(name, lang)])

    @udtf(returnType="lang string, term string")
    class SplitTerms:
        def eval(self, value: str) -> Iterator[tuple]:
            ko, en = text.by_language_py(value)
            yield from (("ko", t) for t in ko)
            yield from (("en", t) for t in en)

    spark.udf.register("clean_term", pandas_udf(clean, "string"))
    spark.udf.register("repaired_markup", pandas_udf(repaired, "string"))
    spark.udf.register("title_similarity", pandas_udf(similarity, "double"))
    spark.udf.register("keyword_key", pandas_udf(key, "string"))
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("split_terms", SplitTerms)
    return ["clean_term", "repaired_markup", "title_similarity", "keyword_key", "split_terms", *SQL_FUNCTIONS]
