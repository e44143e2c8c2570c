"""quern: a PySpark-native engine for building and analysing language-model corpora."""
