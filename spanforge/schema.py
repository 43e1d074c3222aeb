"""The fact relation: its columns, the predicates and their categories, and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = (
    "id bigint, source string, span_start bigint, span_end bigint, predicate string, confidence double, value_type string, "
    "value_number bigint, value_float double, value_text string, value_atom int, value_ref bigint, value_span struct<start:bigint,end:bigint>, "
    "generation int, ingest_ts timestamp"
)

# The predicates of each category, in the order of their codes.
PREDICATES = {
    "lexical": "is_token has_text has_kind is_whitespace is_comment is_identifier is_keyword is_string is_number is_operator is_delimiter",
    "structural": "is_boundary starts_block ends_block indent_level is_foldable is_error_region has_parent has_child precedes follows",
    "semantic": "defines_symbol references_symbol has_type has_value has_scope is_function is_variable is_type_def is_class is_method is_parameter is_field",
    "diagnostic": "has_error has_warning has_info has_hint has_suggestion is_deprecated is_unused",
    "language_specific": "json_is_object json_is_array json_is_key json_is_value json_is_null json_is_boolean html_is_tag html_is_attribute html_is_text html_is_self_closing css_is_selector css_is_property css_is_value css_is_rule",
}
CATEGORY = {p: c for c, names in PREDICATES.items() for p in names.split()}

# Confidence levels and presets.
CONFIDENT, CERTAIN, UNCERTAIN = 0.8, 1.0, 0.5
PRESETS = {"certain": 1.0, "likely": 0.8, "possible": 0.5, "unlikely": 0.2}


def category(predicate: Column) -> Column:
    """The category of a predicate; `unknown` for others."""
    out = F
    for name in PREDICATES:
        out = out.when(predicate.isin(PREDICATES[name].split()), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def predicate_table(spark: SparkSession) -> DataFrame:
    """predicate, code, category: a dimension of fixed size."""
    return spark.createDataFrame([(p, i, c) for i, (p, c) in enumerate(CATEGORY.items())], "predicate string, code int, category string")


def span_length(start: Column | str = "span_start", end: Column | str = "span_end") -> Column:
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.greatest(end - start, F.lit(0).cast("bigint"))


def subject() -> Column:
    """The packed span: start in the upper, length in the lower 32 bits. Order by the parts, not by this."""
    return F.shiftleft(F.col("span_start"), 32).bitwiseOR(span_length())


def complete(df: DataFrame) -> DataFrame:
    """df with every column of the fact relation, null where it is missing, in the relation's order and types."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(FACTS).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
