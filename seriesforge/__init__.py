"""Spark-native operators over keyed, ordered observations."""
