"""Declared schemas (DDL) of every table the package reads or writes."""

RAW_CORPUS = (
    "file_id BIGINT, text STRING, repo_name STRING, license STRING, size BIGINT, language STRING, score DOUBLE"
)

LINT_REPORT = "STRUCT<statistics: STRUCT<messageTypeCount: MAP<STRING,INT>, score: DOUBLE>>"

SUBMISSIONS = (
    "id BIGINT, user_id BIGINT, raw_code STRING, extracted_features MAP<STRING,DOUBLE>, "
    "prediction_output DOUBLE, model_version STRING, created_at TIMESTAMP, message STRING"
)

RUNS = (
    "run_id STRING, run_name STRING, tags MAP<STRING,STRING>, params MAP<STRING,STRING>, "
    "metrics MAP<STRING,DOUBLE>, end_time TIMESTAMP"
)
MODEL_VERSIONS = ("name STRING, version INT, run_id STRING, created_at TIMESTAMP")
ALIASES = ("name STRING, alias STRING, version INT, moved_at TIMESTAMP, move BIGINT")

EFFECTS = ("model_version INT, feature STRING, kind STRING, lo DOUBLE, hi DOUBLE")
DEPENDENCIES = ("model_version INT, feature STRING, pos INT, dependency STRING, min_value DOUBLE")
MESSAGES = ("model_version INT, feature STRING, direction STRING, message STRING")

PUBLICATIONS = ("model_version INT, part STRING, publication STRING, published_at TIMESTAMP")

LEAVES = ("tree INT, leaf INT, value DOUBLE, feature INT, lo DOUBLE, hi DOUBLE")
ATTRIBUTION = ("row_id BIGINT, feature STRING, pos INT, value DOUBLE, phi DOUBLE")

# One analysed file. Lists keep source order and repeats unless noted.
CODE_FACTS = (
    "STRUCT<"
    "parsed: BOOLEAN, "  # the text is valid Python
    "has_logic: BOOLEAN, "  # at least one executable statement
    "module_doc: BOOLEAN, "
    "functions: ARRAY<STRUCT<name: STRING, lines: INT, chars: INT, args: ARRAY<STRING>, has_doc: BOOLEAN>>, "
    "async_functions: ARRAY<STRING>, "
    "classes: ARRAY<STRUCT<name: STRING, lines: INT, chars: INT, methods: ARRAY<STRING>, "
    "init_args: ARRAY<STRING>, has_doc: BOOLEAN>>, "
    "assigned: ARRAY<STRING>, "
    "imports: ARRAY<STRING>, "  # distinct
    "used_names: ARRAY<STRING>, "  # distinct
    "comments: ARRAY<INT>, "  # length of each comment
    "blocks: ARRAY<STRUCT<name: STRING, kind: STRING, decisions: INT, closures: INT, methods: INT>>"
    ">"
)

# The long form of the same facts.
FACT_ROWS = (
    "file_id BIGINT, kind STRING, name STRING, owner INT, n_args INT, lines INT, chars INT, has_doc BOOLEAN, value DOUBLE"
)
