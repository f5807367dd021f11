"""PySpark-native analytics for paired sequences, and for the corpora that train on them."""
