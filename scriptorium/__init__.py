"""A PySpark-native engine for messy document text: repair, structure, extract, match, vote, track."""
