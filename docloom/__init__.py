"""docloom: Spark-native document retrieval, evidence and corpus analytics."""
