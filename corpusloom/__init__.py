"""A Spark-native analytics engine for crawled pages and text corpora."""
