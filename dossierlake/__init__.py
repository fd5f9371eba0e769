"""Analytics engine for document-verification data, written for Spark SQL."""
