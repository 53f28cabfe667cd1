"""saltmarsh: a Spark-native engine for commerce, logistics and text-corpus analytics."""
