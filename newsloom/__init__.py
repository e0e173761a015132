"""newsloom: a Spark-native engine for sampling and labelling news articles."""
