"""Spark-native segmentation and text analytics for scripts written without spaces."""
