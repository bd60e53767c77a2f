"""packetlane: Spark-native processing of captured survey packets and text corpora."""
