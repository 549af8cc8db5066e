"""shardlore: Spark-native hybrid document retrieval over federated corpora."""
