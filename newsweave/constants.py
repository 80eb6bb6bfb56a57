"""Table layouts and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The input and output formats other programs read and write.
BEHAVIOR_COLUMNS = ["impression_id", "user_id", "time", "history", "impressions"]
NEWS_COLUMNS = [
    "news_id", "category", "subcategory", "title",
    "abstract", "url", "title_entities", "text_entities",
]
CRAWLED_COLUMNS = ["_id", "title", "author", "link", "summary", "excerpt", "published_date"]
TIME_FORMAT = "M/d/yyyy h:mm:ss a"
INTERVAL_FORMAT = "yyyy-MM-dd HH:mm:ss"
NON_TEXT_PATTERN = "[^a-zA-Z0-9 ]"
UNKNOWN_CATEGORY = "unknown"
EXCLUDED_SOURCES = ["blogspot.com", "yahoo.com", "amazonaws.com"]

# The default parameters of the jobs.
NPRATIO = 4
TOP_K = 10
PAGE_SIZE = 100
MAX_PAGES = 5
SOURCE_CAP = 80
COARSE_CELLS = 100
CONTENT_PCA_COMPONENTS = 128
CLUSTER_PCA_COMPONENTS = 50
CLUSTERS = 3
CLUSTER_SEED = 42
CLUSTER_STARTS = 10
SPLIT_RATIO = 0.8
SPLIT_SEED = 47
ALS_PARAMS = {"rank": 40, "maxIter": 15, "regParam": 0.1, "alpha": 1.0}
GRID_RANKS = [10, 20, 30, 40]
GRID_REG_PARAMS = [0.01, 0.05, 0.1, 0.2]
GRID_ALPHAS = [1.0, 5.0, 10.0]
GRID_FOLDS = 3
GRID_PARALLELISM = 4
# Rows above which a table counts as loaded.
LOAD_THRESHOLDS = {
    "behaviors_train": 1_000_000,
    "news_train": 100_000,
    "behaviors_valid": 50_000,
    "news_valid": 300_000,
}

BEHAVIORS_SCHEMA = T.StructType(
    [T.StructField("impression_id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in BEHAVIOR_COLUMNS[1:]]
)
NEWS_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in NEWS_COLUMNS])
CRAWLED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in CRAWLED_COLUMNS])
