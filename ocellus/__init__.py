"""PySpark-native operators for image- and video-derived screening data."""
