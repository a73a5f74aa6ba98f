"""Fixed values shared by the whole package.

Everything below is data, not logic: names, lists, thresholds and texts that
have to be exactly these for results to be comparable between deployments.
"""

# --- fixed values: licenses that allow training ------------------------------
SAFE_LICENSES = ["mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause", "isc", "cc0-1.0"]

# --- fixed values: lint directives that disqualify a file (regular expressions)
LINT_DIRECTIVES = ["pylint: "]

# --- fixed values: size limit used while exploring ----------------------------
FIXED_SIZE_LIMIT = 75000

# --- fixed values: feature names, first generation ----------------------------
FEATURES_V1 = [
    "characters",
    "code_compactness",
    "chars_per_line",
    "comment_ratio",
    "has_docstring",
    "variable_ratio",
    "avg_var_name",
    "num_funcs_and_classes",
    "avg_func_class_name",
    "avg_func_class_chars",
    "avg_func_class_args",
    "func_class_docstring_ratio",
]

# --- fixed values: feature names, second generation ---------------------------
FEATURES_V2 = [
    "characters",
    "code_compactness",
    "line_length_std",
    "cyclomatic_complexity",
    "long_line_ratio",
    "bad_name_ratio",
    "comment_ratio",
    "has_docstring",
    "variable_density",
    "func_density",
    "too_many_args_ratio",
    "class_density",
    "avg_class_methods",
    "func_class_docstring_ratio",
    "unused_imports_ratio",
]

# --- fixed values: feature names after transformation --------------------------
TRANSFORMED_FEATURES = [
    "characters",
    "code_compactness",
    "line_length_std",
    "cyclomatic_complexity",
    "long_line",
    "bad_name",
    "comment_ratio",
    "has_docstring",
    "variable_density",
    "func_density",
    "too_many_args",
    "class_density",
    "avg_class_methods",
    "func_class_docstring_ratio",
    "unused_imports",
]

# --- fixed values: which features are logged / turned into flags ---------------
LOG_FEATURES = ["characters", "line_length_std", "cyclomatic_complexity"]
FLAG_SOURCES = {
    "long_line": "long_line_ratio",
    "bad_name": "bad_name_ratio",
    "too_many_args": "too_many_args_ratio",
    "unused_imports": "unused_imports_ratio",
}

# --- fixed values: naming rules and limits --------------------------------------
SNAKE_CASE = "^[a-z_][a-z0-9_]*$"
PASCAL_CASE = "^[A-Z][a-zA-Z0-9]+$"
LONG_LINE = 100
MANY_ARGS = 5

# --- fixed values: monitoring thresholds ----------------------------------------
DECLINE_THRESHOLD = 0.25
DRIFT_SHARE_THRESHOLD = 0.2
DISTANCE_THRESHOLD = 0.1
P_VALUE_THRESHOLD = 0.05
LARGE_REFERENCE_ROWS = 1000
FEW_DISTINCT_VALUES = 5
MIN_REFERENCE_STD = 0.001

# --- fixed values: retraining ----------------------------------------------------
HALF_LIFE_DAYS = 30
TEST_SHARE = 0.3
STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss'_UTC'"
PRODUCTION_ALIAS = "production"
SEARCH_TRIALS = 50
SEARCH_FOLDS = 5

# --- fixed values: token windows ---------------------------------------------------
WINDOW_TOKENS = 512
SPECIAL_TOKENS = 2
WINDOW_OVERLAP = 128

# --- fixed values: effects that do not come from mined ranges ------------------------
ONE_DIRECTIONAL_EFFECTS = {
    "long_line": "never",
    "bad_name": "never",
    "too_many_args": "never",
    "unused_imports": "never",
    "has_docstring": "always",
    "func_class_docstring_ratio": "always",
}

# --- fixed values: what must be present before a feature is worth advising on ---------
DEPENDENCIES = {
    "code_compactness": {"effective_lines": 10},
    "line_length_std": {"effective_lines": 10},
    "avg_class_methods": {"class_density": 0},
    "func_class_docstring_ratio": {"func_density": 0, "class_density": 0},
}

# --- fixed values: advice texts (feature, direction, text) -----------------------------
MESSAGES = [
    ("characters", "increase", "The file appears very small. Consider adding meaningful structure or consolidating related files."),
    ("characters", "decrease", "The file is quite large. Consider splitting it into smaller, more focused modules."),
    ("effective_lines", "increase", "The file appears very small. Consider adding meaningful structure or consolidating related files."),
    ("effective_lines", "decrease", "The file is quite large. Consider splitting it into smaller, more focused modules."),
    ("code_compactness", "increase", "The code has excessive spacing. Tighten layout where it does not affect readability."),
    ("code_compactness", "decrease", "The code appears overly dense. Add blank lines to improve readability."),
    ("line_length_std", "increase", "Line lengths are very uniform. Slight variation is fine if it improves readability."),
    ("line_length_std", "decrease", "Line lengths are inconsistent. Keep them more uniform for better readability."),
    ("cyclomatic_complexity", "increase", "The code may be overly trivial. Ensure logic is meaningful and not overly fragmented."),
    ("cyclomatic_complexity", "decrease", "The code is complex. Simplify logic, reduce branching, or break into smaller functions."),
    ("comment_ratio", "increase", "Add comments where the intent or logic is not immediately clear."),
    ("comment_ratio", "decrease", "Reduce redundant comments and focus on explaining intent rather than obvious code."),
    ("variable_density", "increase", "Introduce well-named intermediate variables where they improve clarity."),
    ("variable_density", "decrease", "Too many variables may hurt readability. Simplify where possible."),
    ("func_density", "increase", "Refactor repeated or complex logic into functions."),
    ("func_density", "decrease", "The code may be over-fragmented into too many small functions. Consolidate where appropriate."),
    ("class_density", "increase", "Use classes where grouped state or behavior would improve structure."),
    ("class_density", "decrease", "The code may use unnecessary classes. Prefer simpler structures where appropriate."),
    ("avg_class_methods", "increase", "Classes may be too minimal. Consider grouping related behavior."),
    ("avg_class_methods", "decrease", "Some classes have too many methods. Split responsibilities into smaller classes."),
    ("long_line", "decrease", "Break long lines to improve readability and follow style conventions."),
    ("bad_name", "decrease", "Use naming conventions that improve readability and maintainability for classes (PascalCase), functions (snake_case) and variables (snake_case)."),
    ("too_many_args", "decrease", "Reduce the number of function/method parameters by grouping related inputs or refactoring."),
    ("unused_imports", "decrease", "Remove unused imports."),
    ("has_docstring", "increase", "Add a module docstring describing the purpose of the file."),
    ("func_class_docstring_ratio", "increase", "Add docstrings to functions and classes to explain their purpose and usage."),
]

INVALID_MESSAGE = "Not a valid python code or code contains no logic\n\n"
SCORE_HEADER = "Estimated score: %.2f\n\n"
PERFECT_MESSAGE = "Code is perfect! No suggestions\n\n"
ADVICE_HEADER = "Suggested improvements:\n\n"
