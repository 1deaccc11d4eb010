"""crosswise: a Spark-native engine for comparing labelled extraction runs."""
