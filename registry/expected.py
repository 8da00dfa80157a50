"""Fixed values that the queries must come out with, written down a second time: a wrong constant in the library shows."""

NO_VALUE_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

#: Rule type, its default severity, and how often its suggested fix works.
TYPE_SCORES = [
    ("not_null", "high", 0.95), ("unique", "high", 0.90), ("range", "medium", 0.85), ("regex", "medium", 0.80),
    ("email", "medium", 0.75), ("date", "low", 0.85), ("phone", "low", 0.80), ("allowed_values", "medium", 0.90),
    ("numeric", "medium", 0.95), ("positive", "medium", 0.90), ("min_length", "low", 0.85), ("max_length", "low", 0.85),
    ("duplicate_row", "high", 0.88), ("future_date", "medium", 0.90), ("date_format", "low", 0.85),
    ("placeholder", "medium", 0.92), ("missing_threshold", "high", 0.80), ("customer_id_pattern", "medium", 0.85),
    ("email_domain", "medium", 0.88), ("currency", "medium", 0.90), ("country", "low", 0.85),
    ("date_order", "medium", 0.85), ("age", "medium", 0.85), ("salary", "medium", 0.80),
    ("transaction_amount", "high", 0.85), ("outlier", "medium", 0.70), ("cross_field", "high", 0.75),
    ("business_rule", "high", 0.70), ("data_consistency", "high", 0.70), ("data_freshness", "low", 0.90),
]
RATES = ", ".join(f"('{t}', {rate})" for t, _, rate in TYPE_SCORES)
SEVERITIES = ", ".join(f"('{t}', '{s}')" for t, s, _ in TYPE_SCORES)

#: Rule type: root cause, SQL fix, code fix; the last is for all other types.
EXPLANATIONS = [
    ("not_null", "Column '{column}' contains {failed} null values.",
     "DELETE FROM table_name WHERE {column} IS NULL;", "df = df.na.drop(subset=['{column}'])"),
    ("unique", "Column '{column}' has {failed} duplicate values.",
     "DELETE FROM table_name WHERE rowid NOT IN (SELECT MIN(rowid) FROM table_name GROUP BY {column});",
     "df = keep_first(df, ['{column}'], row_key)"),
    ("range", "Column '{column}' has values outside expected range.",
     "UPDATE table_name SET {column} = NULL WHERE {column} < {min} OR {column} > {max};",
     "df = null_outside(df, '{column}', {min}, {max})"),
    ("positive", "Column '{column}' has negative values.",
     "UPDATE table_name SET {column} = 0 WHERE {column} < 0;", "df = zero_negatives(df, '{column}')"),
    ("outlier", "Column '{column}' has statistical outliers.",
     "-- Review outliers in {column}", "# Review and cap outliers in {column}"),
    ("email", "Column '{column}' has invalid email formats.",
     "UPDATE table_name SET {column} = NULL WHERE {column} NOT LIKE '%_@_%.__%';", "df = null_bad_addresses(df, '{column}')"),
    ("date", "Column '{column}' has invalid date formats.",
     "UPDATE table_name SET {column} = NULL WHERE {column} NOT LIKE '____-__-__';", "df = text_to_date(df, '{column}')"),
    (None, "Column '{column}' failed {type} with {failed} failures.",
     "-- Manual review needed for {column}", "# Manual review needed for {column}"),
]
