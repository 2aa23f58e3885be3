"""weftline: Spark-native curation and evaluation analytics for conversational and question-answering corpora."""
