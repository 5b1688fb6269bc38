"""pageloom: Spark-native analytics for document-page text regions."""
