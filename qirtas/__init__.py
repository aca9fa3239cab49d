"""qirtas: a Spark-native engine for bilingual legal-text processing."""
