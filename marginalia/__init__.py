"""Spark-native evaluation analytics for budgeted multiple-choice question answering."""
