"""Profiling, cell flagging, imputation and column similarity over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gleanframe.functions.missing import DEFAULT_TOKENS, is_missing, normalise_missing  # noqa: E402
from gleanframe.functions.numbers import render_number, token_kind  # noqa: E402
from gleanframe.operators.correlation import correlated_pairs  # noqa: E402
from gleanframe.operators.impute import impute  # noqa: E402
from gleanframe.operators.names import similar_names, similar_strings  # noqa: E402
from gleanframe.operators.outliers import (  # noqa: E402
    fit_rules, flag_outliers, outlier_verdicts, with_verdicts,
)
from gleanframe.operators.profile import (  # noqa: E402
    describe_feature, feature_state, feature_values, features_by_state, incompatible_cells, profile, summarise,
)
from gleanframe.operators.report import evaluation_report  # noqa: E402
from gleanframe.operators.status import cell_status, clean, curated  # noqa: E402
from gleanframe.plans.curate import CurationResult, curate, curate_file  # noqa: E402
from gleanframe.sources.readers import dedup_names, read_dataset  # noqa: E402
from gleanframe.sources.writers import write_reports  # noqa: E402

__all__ = [
    "CurationResult", "DEFAULT_TOKENS", "cell_status", "clean", "correlated_pairs", "curate", "curate_file", "curated",
    "dedup_names", "describe_feature", "evaluation_report", "feature_state", "feature_values", "features_by_state", "fit_rules", "flag_outliers",
    "impute", "incompatible_cells", "is_missing", "normalise_missing", "outlier_verdicts", "profile",
    "read_dataset", "render_number", "similar_names", "similar_strings", "summarise", "token_kind",
    "with_verdicts", "write_reports",
]
